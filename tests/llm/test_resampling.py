import math
import random
import re
import zlib
from hashlib import sha256

import pytest

from wagerlake.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    w = WORD.findall((text or "").translate(UP))
    return w, [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]


def buckets(texts, n):
    out = [0] * n
    for t in texts:
        for f in features(t)[1]:
            out[zlib.crc32(f.encode()) % n] += 1
    return out


def plain(rows, target, percent=25, least=20, n=importance.BUCKETS):
    s, t = buckets([r[1] for r in rows], n), buckets(target, n)
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (sum(s) + n) / ((s[b] + 1.0) * (sum(t) + n)))) for b in range(n)]
    out = []
    for i, text in rows:
        w, f = features(text)
        weight = sum(gain[zlib.crc32(x.encode()) % n] for x in f) // len(f) if f else 0
        h = int(sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None, len(w) >= least and i is not None])
    may = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0], -r[1]))
    for k, r in enumerate(may[: percent * len(may) // 100], 1):
        r[4] = k
    return sorted(map(str, (tuple(r[:5]) for r in out)))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    words = ["The", "fox", "é", "ñu", "x9", "中文", "dog", "İ", "ß"]
    made = ["".join(rnd.choice(words) + rnd.choice(" -\n,.\x00") for _ in range(rnd.randint(0, 60))) for _ in range(120)]
    texts = [None, "", " .,;", "a", "A" * 300, "é" * 200, *made, "long " * 700, made[5], made[5]]
    return [*enumerate(texts), (None, made[3]), (7, made[9]), (7, made[9]), (-4, made[2])]


@pytest.mark.parametrize("limit", [importance.RUN, 64])
def test_draw_matches_plain_python(spark, rows, limit):
    """Nulls, empty and long texts, repeated rows and ids, extra columns; the same with texts cut in small pieces."""
    target = ["the dog and the fox", None, "", "ñu 中文 " * 9]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, score int, rank string").repartition(3)
    found = importance.resampled(docs, spark.createDataFrame([(t, 0) for t in target], "text string, n_features int"), limit=limit)
    assert sorted(str(tuple(r)) for r in found.select("doc_id", "n_features", "weight", "score", "rank").collect()) == plain(rows, target)


def test_empty_tables_and_targets(spark, rows):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resampled(none, none).collect() == []
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = importance.resampled(docs, none, percent=100, least_words=1)
    assert sorted(str(tuple(r)) for r in found.collect()) == plain(rows, [], 100, 1)


def test_pieces_hold_every_word_once():
    raw = b"  one two   three four-teen five " * 20
    parts = list(importance.pieces(raw, 10))
    words = [w for again, p in parts for w in p.split()[again:]]
    assert words == raw.split() and len(parts) > 20 and parts[0][0] is False
    assert list(importance.pieces(b"x" * 50, 10)) == [(False, b" " + b"x" * 50)]
