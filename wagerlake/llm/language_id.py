"""Language ID: Kneser-Ney models of letters in UTF-8 bytes, one for each language; the lowest cross-entropy a symbol wins."""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import same_rows, staged
from .kneser_ney import ORDER, cross_entropies

#: Symbols' worth of evidence in a score, so that long texts don't all score 1.
WEIGHT = 16
#: Quantile of the calibration documents' own cross-entropy beyond which a document is rejected, and slack in bits.
QUANTILE, SLACK, SHORT = 0.999, 0.3, 32

_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[0] = 0
_LETTERS[128:] = np.arange(128, 256)
_LETTERS[ord("a") : ord("z") + 1] = _LETTERS[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTER = regex.compile(r"\p{L}")


def letters(raw: np.ndarray) -> np.ndarray:
    """ASCII letters in lower case, bytes of other characters as they are, anything else as one space."""
    s = _LETTERS[raw]
    space = s == 32
    return s[~(space & np.concatenate([[False], (space | (s == 0))[:-1]]))]


def lettered(raw: bytes) -> bool:
    return _LETTER.search(raw.decode("utf-8", "replace")) is not None


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5


def identify(docs: DataFrame, teach: DataFrame, calibrate: DataFrame, order: int = ORDER, quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy, accepted for each row of docs (doc_id, text).

    teach and calibrate have (doc_id, lang): the first are counted, the second, not counted, set how high the cross-entropy of a
    language's documents may be. lang_pred is the language of the least cross-entropy a symbol, of equal ones the first by name; 'und'
    with score 0, not accepted, if the text is null or has no letter, or nothing was learned. score is that language's
    share of 2^(-WEIGHT * cross-entropy) over all. Texts under SHORT symbols, and languages without calibration, are not rejected.
    Repeated rows come back each, judged by their own text, also where they share a doc_id (whose least lang teaches then); null ids have no row; an empty table gives no rows.
    """
    docs = same_rows(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    scored, classes = cross_entropies(docs, teach.select("doc_id", F.col("lang").alias("cls")), letters, order, mark=lettered)
    least = F.array_min("bits")
    best = F.element_at(F.array(*map(F.lit, classes)), F.array_position("bits", least).cast("int")) if classes else F.lit(None).cast("string")
    share = 1 / F.aggregate("bits", F.lit(0.0), lambda s, b: s + F.pow(F.lit(2.0), WEIGHT * (least - b)))
    scored = staged(scored.select("doc_id", "n", "mark", best.alias("best"), least.alias("cross_entropy"), share.alias("share")), "scores")
    limits = scored.where(F.col("n") >= SHORT).join(calibrate.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("lang").alias("best")), ["doc_id", "best"], "left_semi")
    limits = limits.groupBy("best").agg((F.percentile_approx("cross_entropy", quantile, 10_000) + slack).alias("limit"))
    known = scored.join(F.broadcast(limits), "best", "left")  # a row a language at most, and cross_entropies() bounds their number
    heard = F.col("mark") & F.col("best").isNotNull()
    high = (F.col("n") >= SHORT) & (F.col("cross_entropy") > F.col("limit"))
    return known.select("doc_id", F.when(heard, F.col("best")).otherwise("und").alias("lang_pred"), F.when(heard, F.col("share")).otherwise(0.0).alias("score"), "cross_entropy", (heard & ~F.coalesce(high, F.lit(False))).alias("accepted"))
