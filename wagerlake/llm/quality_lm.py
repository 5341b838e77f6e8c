"""Quality classifier: perplexity under Kneser-Ney models of trusted text, judged by quantiles of each language."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import same_rows, staged
from .kneser_ney import ORDER, cross_entropies

#: Share of a language's trusted documents, kept out of the counts, whose bits a byte stay under the upper threshold; and slack beyond both, in bits.
QUANTILE, SLACK = 0.98, 0.05
#: One in FOLDS of the trusted documents is not counted but sets the thresholds; fewer bytes than SHORT say too little.
FOLDS, SHORT = 5, 64

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[*range(9, 14)]] = 32
_FOLD[[*range(ord("0"), ord("9") + 1)]] = ord("0")


def written(raw: np.ndarray) -> np.ndarray:
    """Bytes as they are, but for digits (all 0) and runs of white space (one space)."""
    s = _FOLD[raw]
    space = s == 32
    return s[~(space & np.concatenate([[False], space[:-1]]))]


def classify(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, slack: float = SLACK, order: int = ORDER) -> DataFrame:
    """doc_id, lang, n_bytes, bits, perplexity, threshold, kept for each row of docs (doc_id, text, lang).

    trusted holds the doc_id of trusted documents. Each language's model is counted on its trusted documents but for one in FOLDS,
    whose bits a byte give the language's threshold: the quantile, with slack. A document is rejected if its own language's model
    gives it more. Null lang counts as a language of its own. Kept without a verdict are documents of fewer than SHORT bytes (null and empty
    texts too) and those of languages with no trusted document to set a threshold; perplexity is null where the language has no model.
    Repeated rows are judged each; of several languages of one doc_id the least by name counts; null ids have no row; extra columns are ignored; an empty table gives no rows.
    """
    docs = same_rows(docs, "doc_id", "text", "lang").select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))
    sure = same_rows(trusted, "doc_id").select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct()
    langs = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min("lang").alias("lang"))
    sure = staged(langs.join(sure, "doc_id"), "trusted")
    fold = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(FOLDS))
    scored, classes = cross_entropies(docs, sure.where(fold > 0).select("doc_id", F.col("lang").alias("cls")), written, order)
    place = F.array_position(F.array(*map(F.lit, classes)) if classes else F.array().cast("array<string>"), F.col("lang")).cast("int")
    scored = scored.join(langs, "doc_id").select("doc_id", "lang", F.col("n").alias("n_bytes"), F.get("bits", place - 1).alias("bits"))
    scored = staged(scored, "scores")
    judges = scored.where(f"n_bytes >= {SHORT} and bits is not null").join(sure.where(fold == 0).select("doc_id"), "doc_id", "left_semi")
    limits = judges.groupBy("lang").agg((F.percentile_approx("bits", quantile, 10_000) + slack).alias("threshold"))
    judged = scored.join(F.broadcast(limits), "lang", "left")  # a row a language, as many as the driver has models
    bad = (F.col("n_bytes") >= SHORT) & (F.col("bits") > F.col("threshold"))
    return judged.select("doc_id", "lang", "n_bytes", "bits", F.pow(F.lit(2.0), "bits").alias("perplexity"), "threshold", (~F.coalesce(bad, F.lit(False))).alias("kept"))
