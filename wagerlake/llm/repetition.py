"""Repetition coverage: how much of a text stands inside n-grams and lines that it has had before."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import Words, blocks, mix, runs_hash, same_rows

#: Most of a text's word characters that may stand in repeated word n-grams, by n.
MOST_IN_NGRAMS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Most of its lines, and of its characters, that may be repeated lines.
MOST_LINES, MOST_LINE_CHARS = 0.30, 0.20
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ngram_shares array<double>, dup_line_share double, dup_line_char_share double, base_failed boolean, kept boolean"


def _sums(flags: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[ends] - total[begins]


def repeated(key: np.ndarray, owner: np.ndarray, first_too: bool) -> np.ndarray:
    """Which keys their owner has more than once; without first_too, only those it has had before."""
    if not len(key):
        return np.zeros(0, bool)
    both = mix(key + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(both, kind="stable")
    same = both[order[1:]] == both[order[:-1]]
    out = np.zeros(len(key), bool)
    out[order[1:]] = same
    if first_too:
        out[order[:-1]] |= same
    return out


def _lines_again(raw: bytes, text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which lines are equal, byte by byte, to an earlier one of their text."""
    out, seen, now = np.zeros(len(begin), bool), set(), -1
    for i, (t, a, b) in enumerate(zip(text.tolist(), begin.tolist(), end.tolist(), strict=True)):
        if t != now:
            seen, now = set(), t
        line = raw[a:b]
        out[i] = line in seen
        seen.add(line)
    return out


def _covered(w: Words, owner: np.ndarray, n: int, first_too: bool) -> np.ndarray:
    """Which words stand in a repeated run of n words of their text."""
    h = runs_hash(w.hash, n)
    inside = np.flatnonzero(owner[: len(h)] == owner[n - 1 :]) if len(h) else np.zeros(0, np.int64)
    hit = inside[repeated(h[inside], owner[inside], first_too)]
    edge = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measured(raws: list[bytes]) -> pd.DataFrame:
    """The measures of each text, as in SCHEMA without doc_id."""
    w, k = Words(raws), len(raws)
    owner = np.repeat(np.arange(k), np.diff(w.bounds))
    point = np.concatenate([[0], np.cumsum((w.buf & 0xC0) != 0x80)])
    chars = point[w.end] - point[w.start]
    of = lambda weight, mask=None: np.bincount(owner if mask is None else owner[mask], weight if mask is None else weight[mask], k).astype(np.int64)
    out = pd.DataFrame({"n_words": np.diff(w.bounds), "word_chars": of(chars), "n_symbols": _sums(_SYMBOL[w.buf], w.begins, w.ends)})
    close = np.flatnonzero(w.buf == 10)
    begin = np.concatenate([[0], close[:-1] + 1]) if len(close) else close
    counted = np.searchsorted(w.start, close) > np.searchsorted(w.start, begin)
    begin, close = begin[counted], close[counted]
    line_of = np.searchsorted(w.ends, begin)
    again = _lines_again(w.buf.tobytes(), line_of, begin, close)
    length = point[close] - point[begin]
    lines, dup = np.bincount(line_of, minlength=k), np.bincount(line_of[again], minlength=k)
    out["n_dup_lines"] = dup
    out["n_repeat_words"] = np.bincount(owner[_covered(w, owner, 3, True)], minlength=k)
    words = np.maximum(out["word_chars"].to_numpy(), 1)
    shares = np.stack([of(chars, _covered(w, owner, n, False)) / words for n in MOST_IN_NGRAMS], axis=1)
    out["ngram_shares"] = list(shares)
    out["dup_line_share"] = dup / np.maximum(lines, 1)
    out["dup_line_char_share"] = np.bincount(line_of[again], length[again], k) / np.maximum(np.bincount(line_of, length, k), 1)
    failed = (out["n_words"] < 50) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
    calm = (shares <= np.array(list(MOST_IN_NGRAMS.values()))).all(axis=1) & (out["dup_line_share"] <= MOST_LINES) & (out["dup_line_char_share"] <= MOST_LINE_CHARS)
    return out.assign(base_failed=failed, kept=~failed & calm)


def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for first, raws in blocks(batch["text"].tolist()):
            out = measured(raws)
            out.insert(0, "doc_id", batch["doc_id"].to_numpy()[first : first + len(raws)])
            yield out


def repetition(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): counts, shares of repeated n-grams and lines, base_failed and kept.

    A null text, like an empty one, has no words, all counts 0, and fails. Repeated rows come back each; an empty
    table gives none. Words are [^\\x20\\x09-\\x0D]+; a line counts if it has a word. Lines are compared by their bytes, n-grams
    by 64-bit hashes within their own text.
    """
    return same_rows(docs, "doc_id", "text").mapInPandas(_run, SCHEMA)
