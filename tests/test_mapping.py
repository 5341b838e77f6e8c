"""The mapping of two catalogues against one by one greedy matching in plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wagerlake.plans import mapping as M
from wagerlake.plans import matching as T
from wagerlake.plans.reports import by_tokens

MARKET = "side int, id long, label string, v array<double>, words array<string>, numbers array<string>, period string"


def adjusted(raw, words, numbers, same):
    """The token rules for words without teams and leagues."""
    w, coins, macro = set(words), {"btc", "eth"} & set(words), {"fed"} & set(words)
    if same and numbers and w:
        return min(1, max(raw + 0.25, 0.85)), "token_heuristic"
    if len(w) >= 2:
        return min(1, raw + 0.125), "token_boost"
    if coins and raw >= 0.55:
        return min(1, raw + 0.25), "token_boost"
    if macro and raw >= 0.6:
        return min(1, raw + 0.1875), "token_boost"
    return raw, "vector"


def plain(rows, structural, rounds=M.ROUNDS, fallback=True):
    least, half = rounds[-1] if fallback else rounds[0], lambda x: np.floor(x * 10_000 + 0.5) / 10_000
    cos = lambda x, y: float(half(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)))
    pairs = []
    for x in (r for r in rows if r[0] == 0 and r[2]):
        for y in (r for r in rows if r[0] == 1 and r[2] == x[2]):
            raw = cos(x[3], y[3])
            s, how = adjusted(raw, set(x[4]) & set(y[4]), set(x[5]) & set(y[5]), x[6] is not None and x[6] == y[6])
            if raw >= least - 0.25 and half(s) >= least:
                pairs.append((-float(half(s)), x[1], y[1], how))
    used, out = set(), {}
    for s, a, b, how in sorted(pairs):
        if ("a", a) not in used and ("b", b) not in used:
            used |= {("a", a), ("b", b)}
            out[a, b] = (-s, how, next(t for t in rounds if -s >= t))
    for a, b, s in structural:
        if (a, b) not in out or s > out[a, b][0]:
            out[a, b] = (s, "deterministic", out[a, b][2] if (a, b) in out else None)
    return sorted((a, b, *v) for (a, b), v in out.items())


@pytest.fixture(scope="module")
def rows():
    rng, rnd = np.random.default_rng(4), random.Random(4)
    centres = rng.normal(size=(6, 8))
    some = lambda xs, n: rnd.sample(xs, rnd.randint(0, n))
    out = [(i % 2, i, rnd.choice(["x", "x", "y", None]), [float(z) for z in centres[i % 6] + rng.normal(size=8) * 0.9], some(["btc", "fed", "k", "m"], 3), some(["1", "2"], 2), rnd.choice(["q1", "q2", None])) for i in range(90)]
    return [*out, *((s, i + 100, *out[4][2:3], *out[4][3:]) for i, s in enumerate([0, 0, 1, 1, 1]))]


@pytest.mark.parametrize("fallback", [True, False])
def test_mapping_is_greedy_by_rounds(spark, rows, fallback):
    known = [(0, 1, 0.9), (2, 77, 0.3)]
    got = M.mapped(spark.createDataFrame(rows, MARKET), spark.createDataFrame(known, "a long, b long, score double"), fallback=fallback)
    assert sorted((r.a, r.b, round(r.score, 4), r.method, r["round"]) for r in got.collect()) == [(a, b, round(s, 4), m, t) for a, b, s, m, t in plain(rows, known, fallback=fallback)]


def test_empty_catalogues_leave_the_structural_pairs(spark):
    none = spark.createDataFrame([], MARKET)
    assert M.mapped(none).collect() == []
    assert [tuple(r) for r in M.mapped(none, spark.createDataFrame([(1, 2, 0.8)], "a long, b long, score double")).collect()] == [(1, 2, 0.8, "deterministic", None)]


def by_turns(spark, links, members, monkeypatch, ahead):
    """matched() with nothing left to the driver, and how many tables it wrote."""
    written, write = [], T.checkpointed
    monkeypatch.setattr(T, "REST", 0)
    monkeypatch.setattr(T, "AHEAD", ahead, raising=False)
    monkeypatch.setattr(T, "checkpointed", lambda df: written.append(1) or write(df))
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    left, right = (frame([(k, i) for side, k, i in members if side == n], f"{k} long, {i} long") for n, k, i in ((0, "p", "a"), (1, "q", "b")))
    got = T.matched(frame(links, "p long, q long, score double"), left, right)
    return sorted(map(tuple, got.collect())), len(written)


def one_by_one(links, members):
    of = {n: {k: sorted(i for s, x, i in members if (s, x) == (n, k)) for k in {x for s, x, _ in members if s == n}} for n in (0, 1)}
    used, out = set(), []
    for s, a, b in sorted((-s, a, b) for p, q, s in links for a in of[0][p] for b in of[1][q]):
        if ("a", a) not in used and ("b", b) not in used:
            used |= {("a", a), ("b", b)}
            out.append((a, b, -s))
    return sorted(out)


def test_near_copies_with_equal_scores_are_no_chain_of_rounds(spark, monkeypatch):
    links, members = [(p, q, 0.85) for p in range(30) for q in range(30)], [(side, k, 2 * k + side) for side in (0, 1) for k in range(30)]
    got, written = by_turns(spark, links, members, monkeypatch, 1_000_000)
    assert got == one_by_one(links, members) and written <= 20


@pytest.mark.parametrize("ahead", [0, 12])
def test_first_links_of_any_number_give_the_same_pairs(spark, monkeypatch, ahead):
    rnd = random.Random(ahead)
    ids = rnd.sample(range(1000), 20)
    members = [(side, rnd.randrange(6), ids.pop()) for side in (0, 1) for _ in range(10)]
    some = [sorted({k for s, k, _ in members if s == n}) for n in (0, 1)]
    links = [(p, q, rnd.choice([0.9, 0.9, 0.85, 0.7, 0.7001, 0.70015])) for p in some[0] for q in some[1] if rnd.random() < 0.7]
    assert by_turns(spark, links, members, monkeypatch, ahead)[0] == one_by_one(links, members)


def test_mapping_in_small_tiles(spark, rows, monkeypatch):
    monkeypatch.setattr(T, "TILE", 7)
    got = M.mapped(spark.createDataFrame(rows, MARKET))
    assert sorted((r.a, r.b, round(r.score, 4), r.method, r["round"]) for r in got.collect()) == [(a, b, round(s, 4), m, t) for a, b, s, m, t in plain(rows, [])]


def test_tiles_give_only_pairs_that_tokens_can_raise(spark, monkeypatch):
    rng, written, write = np.random.default_rng(1), [], M.checkpointed
    monkeypatch.setattr(M, "checkpointed", lambda df: written.append(write(df)) or written[-1])
    monkeypatch.setattr(T, "checkpointed", lambda df: written.append(write(df)) or written[-1])
    rows = [(i % 2, i, "x", [1.0, *map(float, rng.normal(size=3))], [f"w{i}"], [str(i)], "q") for i in range(200)]
    M.mapped(spark.createDataFrame(rows, MARKET))
    most = max(t.count() for t in written if {"p", "q"} <= set(t.columns))
    assert most <= sum(np.dot(x[3], y[3]) / np.linalg.norm(x[3]) / np.linalg.norm(y[3]) >= 0.5198 for x in rows[::2] for y in rows[1::2])


def test_reach_is_no_less_than_the_token_rules(spark):
    rnd = random.Random(2)
    kinds = {"team:a": 1, "team:b": 1, "world_cup": 2, "nfl": 3, "btc": 4, "fed": 5, "k": 6, "m": 6}
    cases = [(rnd.randrange(27, 100) / 100, rnd.sample(["1", "2"], rnd.randint(0, 2)), rnd.sample(list(kinds), rnd.randint(0, 4)), rnd.random() < 0.5) for _ in range(1500)]
    said = spark.createDataFrame(cases, "raw double, n array<string>, w array<string>, same boolean").select(by_tokens(F.col("raw"), F.col("n"), F.col("w"), F.col("same"))["adjusted"])
    code = lambda xs, f: np.array([[f(x) for x in c] + [0] * (4 - len(c)) for c in xs])
    words = code([c[2] for c in cases], lambda x: 8 * (1 + list(kinds).index(x)) + kinds[x])
    most = M.reach(np.array([c[0] for c in cases]), words, code([c[1] for c in cases], int), np.array([c[3] for c in cases]))
    assert all(min(1, m) >= r[0] - 1e-12 for m, r in zip(most, said.collect()))


def plain_whole(rows, rounds=M.ROUNDS):
    """plain() without structural pairs, where tokens pair two markets whatever their cosine."""
    half, pairs, used, out = lambda x: float(np.floor(x * 10_000 + 0.5) / 10_000), [], set(), []
    for x in (r for r in rows if r[0] == 0 and r[2]):
        for y in (r for r in rows if r[0] == 1 and r[2] == x[2]):
            raw = half(np.dot(x[3], y[3]) / np.linalg.norm(x[3]) / np.linalg.norm(y[3])) if x[3] and y[3] else 0.0
            s, how = adjusted(raw, set(x[4]) & set(y[4]), set(x[5]) & set(y[5]), x[6] is not None and x[6] == y[6])
            pairs.append((-half(s), x[1], y[1], how))
    for s, a, b, how in sorted(p for p in pairs if -p[0] >= rounds[-1]):
        if ("a", a) not in used and ("b", b) not in used:
            used |= {("a", a), ("b", b)}
            out.append((a, b, -s, how, next(t for t in rounds if -s >= t)))
    return sorted(out)


@pytest.mark.parametrize("rest", [0, 20_000])
def test_tokens_pair_markets_whatever_their_cosine(spark, rows, monkeypatch, rest):
    monkeypatch.setattr(T, "REST", rest)
    # a vector that is missing, and pairs of just 0.85 by their cosines or two words, beside those of 0.85 by tokens
    b, d = [0.7250, float(np.sqrt(1 - 0.7250**2))], [0.8500, float(np.sqrt(1 - 0.8500**2))]
    more = [(0, 201, "x", None, ["btc"], ["1"], "q1"), (1, 200, "x", [1.0] * 8, ["btc", "k"], ["1", "2"], "q1"), (0, 202, "x", [0.0] * 7 + [1.0], ["btc"], ["2"], "q1")]
    more += [(0, 300, "z", [1.0, 0.0], ["k", "m"], ["1"], None), (1, 301, "z", b, ["k", "m"], ["1"], "q1"), (1, 302, "z", d, [], [], None), (0, 303, "z", [-1.0, 0.0], ["k"], ["1"], "q1"), (0, 299, "z", [0.0, -1.0], ["m"], ["1"], "q1"), (1, 298, "z", [0.0, -1.0], ["w"], ["1"], "q1")]
    got = M.mapped(spark.createDataFrame([*rows, *more], MARKET), whole=True)
    want = plain_whole([*rows, *more])
    assert sorted((r.a, r.b, round(r.score, 4), r.method, r["round"]) for r in got.collect()) == [(a, b, round(s, 4), m, t) for a, b, s, m, t in want]
    assert len({(a, b) for a, b, s, *_ in want if s == 0.85}) > 3


def test_query_maps_unlike_vectors_with_equal_tokens(spark, tmp_path):
    spark.createDataFrame([(2, [1.0, 0.0], 1), (3, [0.0, 1.0], 1), (4, [1.0, 0.0], 1), (61, [-1.0, 0.0], 1), (9, [-1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted((r.a, r.b, r.score, r.method) for r in M.market_mapping(spark, str(tmp_path)).collect()) == [(2, 3, 0.85, "token_heuristic"), (4, 61, 0.85, "token_heuristic")]
