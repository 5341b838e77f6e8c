"""Collocations of two to four words by depth-limited count tries.

A task turns runs of its texts into tries of words, four deep: sorted arrays of node labels (64-bit hashes of language and word), parents and counts.
Tries of one task are merged until they are large, then cut by prefix ranges (leading bits of the first two words) and sent in pieces, serialised in sorted order.
One task for each range merges its pieces into whole counts. There a walk down the trie gives the counts of a phrase's left parts
and of its extensions to the right; its right parts are followed by suffix links, the phrase without its first word, as joins
between the levels of frequent phrases.

A phrase with 30 occurrences has only parts with as many, so whatever is rarer can stay behind in its range.
Two words with one hash are noticed where their range is merged, and raise.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, same_rows, staged, word_hashes
from .text_blocks import expand, pack_keys, pack_numbers, squeeze, unpack_keys, unpack_numbers

DEPTH = 4
#: Bytes of text that become a trie at once; nodes that a task holds before it sends them; bytes of text for each prefix range; groups a language's ranking is dealt to.
RUN, HELD, RANGE_BYTES, DEALT = 8 << 20, 2_000_000, 8 << 20, 64
#: Tries that are merged at once.
FAN_IN = 16
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[list(b".,;:!?\x0a\x0b\x0c\x0d")] = 2
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_END = re.compile(rb"[\x20\x09.,;:!?\x0a-\x0d]")
_AHEAD = re.compile(rb"(?:[\x20\x09]+[^\x20\x09.,;:!?\x0a-\x0d]+){0,%d}" % (DEPTH - 1))
PIECES = "range int, trie array<binary>"
NODES = "depth int, h1 long, h2 long, h3 long, h4 long, a long, p2 long, p3 long, child long, lang string, word string"


@dataclass
class Trie:
    """Levels 1 to 4. Level 1 has words with their language, level 2 its pairs of labels; levels 3 and 4 a label and the place of their parent a level above."""

    label: list[np.ndarray] = field(default_factory=lambda: [np.zeros(0, np.uint64) for _ in range(DEPTH)])
    above: list[np.ndarray] = field(default_factory=lambda: [np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)])
    count: list[np.ndarray] = field(default_factory=lambda: [np.zeros(0, np.int64) for _ in range(DEPTH)])
    words: list[tuple[str, bytes]] = field(default_factory=list)

    def size(self) -> int:
        return sum(map(len, self.label))


def _distinct(high: np.ndarray, low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (high, low) in order, their summed counts, and the place of each given pair among them."""
    ranks, low_at = np.unique(low, return_inverse=True)
    if high.dtype == np.uint64:
        tops, high_at = np.unique(high, return_inverse=True)
    else:
        tops, high_at = None, high
    key, at = np.unique(high_at.astype(np.uint64) << np.uint64(32) | low_at.astype(np.uint64), return_inverse=True)
    top = (key >> np.uint64(32)).astype(np.int64)
    return (top if tops is None else tops[top]), ranks[(key & np.uint64(0xFFFFFFFF)).astype(np.int64)], np.bincount(at, count, len(key)).astype(np.int64), at


def merged(tries: list[Trie]) -> Trie:
    """One trie with the counts of all; raises where one hash stands for two words."""
    out = Trie()
    every = np.concatenate([t.label[0] for t in tries])
    out.label[0], first, at = np.unique(every, return_index=True, return_inverse=True)
    out.above[0] = out.label[0]
    out.count[0] = np.bincount(at, np.concatenate([t.count[0] for t in tries]), len(first)).astype(np.int64)
    words = [w for t in tries for w in t.words]
    out.words = [words[i] for i in first]
    if any(out.words[i] != w for i, w in zip(at.tolist(), words, strict=True)):
        raise ValueError("two words of one hash")
    place: list[np.ndarray] = []
    for d in range(1, DEPTH):
        if d == 1:
            above = np.concatenate([t.above[1] for t in tries])
        else:
            shift = np.cumsum([0, *(len(t.label[d - 1]) for t in tries)])
            above = np.concatenate([place[-1][t.above[d] + s] for t, s in zip(tries, shift, strict=False)])
        out.above[d], out.label[d], out.count[d], at = _distinct(above, np.concatenate([t.label[d] for t in tries]), np.concatenate([t.count[d] for t in tries]))
        place.append(at)
    return out


def trie_of(texts: list[tuple[str, bytes, int]]) -> Trie:
    """The trie of (language, lower-case text, bytes of it that count); words that begin behind these only follow others."""
    raw = b"\n".join([*(t for _, t, _ in texts), b""])
    buf = np.frombuffer(raw, np.uint8)
    sizes = np.fromiter((len(t) for _, t, _ in texts), np.int64, len(texts))
    begins = np.cumsum(sizes + 1) - sizes - 1
    kind = _KIND[buf]
    gap = kind > 0
    before = np.concatenate([[True], gap[:-1]])
    start, end = np.flatnonzero(before & ~gap), np.flatnonzero(~before & gap)
    out = Trie()
    if not len(start):
        return out
    text = np.searchsorted(begins, start, "right") - 1
    salt = np.fromiter((xxhash.xxh3_64_intdigest(lang.encode()) for lang, _, _ in texts), np.uint64, len(texts))
    h = mix(word_hashes(buf, start, end) + salt[text])
    piece = np.cumsum(kind == 2)[start]
    on = start < (begins + np.fromiter((n for _, _, n in texts), np.int64, len(texts)))[text]
    mine = np.flatnonzero(on)
    out.label[0], first, at = np.unique(h[mine], return_index=True, return_inverse=True)
    out.above[0] = out.label[0]
    out.count[0] = np.bincount(at, minlength=len(first)).astype(np.int64)
    out.words = [(texts[text[i]][0], raw[start[i] : end[i]]) for i in mine[first].tolist()]
    above = h
    for d in range(1, DEPTH):
        mine = mine[mine + d < len(h)]
        mine = mine[piece[mine] == piece[mine + d]]
        out.above[d], out.label[d], out.count[d], at = _distinct(above[mine], h[mine + d], np.ones(len(mine)))
        above = np.zeros(len(h), np.int64)
        above[mine] = at
    return out


def texts_of(lang: str, raw: bytes, limit: int) -> Iterator[tuple[str, bytes, int]]:
    """A text in parts of about limit bytes, each with the three words behind it that its last ones may need."""
    at = 0
    while len(raw) - at > limit:
        last = max(raw.rfind(bytes([c]), at + 1, at + limit) for c in b" \t.,;:!?\n\x0b\x0c\r")
        if last < 0:
            found = _END.search(raw, at + limit)
            if not found:
                break
            last = found.start()
        yield lang, raw[at : _AHEAD.match(raw, last).end()], last - at
        at = last
    yield lang, raw[at:], len(raw) - at


def _bits(h1: np.ndarray, h2: np.ndarray, bits: tuple[int, int]) -> np.ndarray:
    a, b = bits
    top = (h1 >> np.uint64(64 - a)).astype(np.int64) if a else np.zeros(len(h1), np.int64)
    return top << b | ((h2 >> np.uint64(64 - b)).astype(np.int64) if b else 0)


def cut(trie: Trie, bits: tuple[int, int]) -> Iterator[tuple[int, list[bytes]]]:
    """(range, serialised trie) of the parts of a trie by prefix range; a word lies in one of the ranges of pairs that begin with it."""
    at = [_bits(trie.label[0], trie.label[0] << np.uint64(bits[0]), bits), _bits(trie.above[1], trie.label[1], bits)]
    for d in range(2, DEPTH):
        at.append(at[-1][trie.above[d]])
    order = [np.argsort(x, kind="stable") for x in at]
    many = 1 << sum(bits)
    edge = [np.searchsorted(x[o], np.arange(many + 1)) for x, o in zip(at, order, strict=True)]
    place = []
    for o in order:
        p = np.empty(len(o), np.int64)
        p[o] = np.arange(len(o))
        place.append(p)
    for k in range(many):
        rows = [order[d][edge[d][k] : edge[d][k + 1]] for d in range(DEPTH)]
        if not any(map(len, rows)):
            continue
        above = [None, trie.above[1][rows[1]], *(place[d - 1][trie.above[d][rows[d]]] - edge[d - 1][k] for d in range(2, DEPTH))]
        yield k, serialised([trie.label[d][rows[d]] for d in range(DEPTH)], above, [trie.count[d][rows[d]] for d in range(DEPTH)], [trie.words[i] for i in rows[0].tolist()])


def serialised(label: list[np.ndarray], above: list[np.ndarray | None], count: list[np.ndarray], words: list[tuple[str, bytes]]) -> list[bytes]:
    """Sorted distinct labels, then for each level places among them, differences of parents, and counts; last the words and their languages."""
    names = np.unique(np.concatenate([*label, above[1]]))
    to = lambda x: pack_numbers(np.searchsorted(names, x))
    out = [pack_keys(names), to(above[1])]
    for d in range(DEPTH):
        out += [to(label[d]), pack_numbers(count[d])]
        if d > 1:
            out.append(pack_numbers(np.diff(above[d], prepend=0)))
    langs = {lang: i for i, lang in enumerate(dict.fromkeys(lang for lang, _ in words))}
    return [*out, squeeze(b"\n".join(w for _, w in words)), json.dumps([*langs]).encode(), pack_numbers(np.array([langs[lang] for lang, _ in words], np.int64))]


def restored(raw: list[bytes]) -> Trie:
    out, names, rest = Trie(), unpack_keys(raw[0]), list(raw[1:])
    out.above[1] = names[unpack_numbers(rest.pop(0))]
    for d in range(DEPTH):
        out.label[d], out.count[d] = names[unpack_numbers(rest.pop(0))], unpack_numbers(rest.pop(0))
        if d > 1:
            out.above[d] = np.cumsum(unpack_numbers(rest.pop(0)))
    out.above[0] = out.label[0]
    words, langs, of = expand(rest[0]).split(b"\n"), json.loads(rest[1]), unpack_numbers(rest[2])
    out.words = [(langs[i], w) for i, w in zip(of.tolist(), words, strict=False)]
    return out


def _sent(bits: tuple[int, int], limit: int, held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: list[Trie] = []

        def flush() -> Iterator[pa.RecordBatch]:
            rows = list(cut(merged(tries), bits))
            tries.clear()
            step = max(1, len(rows) // 8)
            for i in range(0, len(rows), step):
                some = rows[i : i + step]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.int32()), pa.array([t for _, t in some], pa.list_(pa.binary()))], names=["range", "trie"])

        def runs() -> Iterator[list[tuple[str, bytes, int]]]:
            run, size = [], 0
            for batch in batches:
                for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                    for part in texts_of(lang, text.as_py().encode().translate(_LOWER), limit):
                        if run and size + len(part[1]) > limit:
                            yield run
                            run, size = [], 0
                        run.append(part)
                        size += len(part[1])
            if run:
                yield run

        for run in runs():
            tries.append(trie_of(run))
            if sum(t.size() for t in tries) > held:
                tries[:] = [merged(tries)]
                if tries[0].size() > held // 2:
                    yield from flush()
        if tries:
            yield from flush()

    return run


def _whole(least: int):
    def run(pieces: pa.Table) -> pa.Table:
        trie, waiting = Trie(), pieces["trie"]
        for i in range(0, len(waiting), FAN_IN):
            trie = merged([trie, *(restored(x) for x in waiting.slice(i, FAN_IN).to_pylist())])
        sums: dict[str, int] = {}
        for (lang, _), n in zip(trie.words, trie.count[0].tolist(), strict=True):
            sums[lang] = sums.get(lang, 0) + n
        none = lambda n: np.zeros(n, np.int64)
        out = [{"depth": np.zeros(len(sums), np.int64), "a": np.array([*sums.values()], np.int64), "lang": [*sums]}]
        path, left = [], []
        for d in range(DEPTH):
            if d == 1:
                path = [trie.above[1], trie.label[1]]
            else:
                path = [*(x[trie.above[d]] for x in path), trie.label[d]]
                left = [*(x[trie.above[d]] for x in left), *([trie.count[d - 1][trie.above[d]]] if d else [])]
            child = none(len(trie.label[d]))
            if 0 < d < DEPTH - 1:
                many = trie.count[d + 1] >= least
                np.maximum.at(child, trie.above[d + 1][many], trie.count[d + 1][many])
            kept = np.flatnonzero(trie.count[d] >= least)
            cols = {"depth": np.full(len(kept), d + 1), "a": trie.count[d][kept], "child": child[kept]}
            cols |= {f"p{k}": x[kept] for k, x in enumerate(left, 2)} | {f"h{k}": x.view(np.int64)[kept] for k, x in enumerate(path, 1)}
            if d == 0:
                cols |= {"lang": [trie.words[i][0] for i in kept], "word": [trie.words[i][1].decode() for i in kept]}
            out.append(cols)
        long = lambda k: pa.array(np.concatenate([x.get(k, none(len(x["a"]))) for x in out]).astype(np.int32 if k == "depth" else np.int64))
        text = lambda k: pa.array([v for x in out for v in x.get(k, [None] * len(x["a"]))], pa.string())
        names = [(c.split()[0], text if c.endswith("string") else long) for c in NODES.split(", ")]
        return pa.table({k: make(k) for k, make in names})

    return run


def _cut_score(a: Column, cuts: list[tuple[Column, Column]]) -> Column:
    """The least struct (score, k, l, r) over the cuts; the products need up to 28 digits."""
    wide = lambda x: x.cast("decimal(20,0)")
    each = []
    for k, (left, right) in enumerate(cuts, 1):
        score = F.call_function("div", wide(a) * F.lit(2_000_000).cast("decimal(7,0)"), wide(left) + wide(right))
        each.append(F.struct(score.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
    return F.array_min(F.array(*each))


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, share: int = 80, limit: int = RUN, held: int = HELD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first top phrases of each language, for rows (text, lang).

    Texts are lower-cased in A-Z and cut at .,;:!? and line ends into pieces, pieces at blanks and tabs into words; phrases don't reach over pieces.
    a is the number of occurrences (least at least), l and r those of the parts of the cut with the lowest score floor(2000000 a / (l + r)), the first one of ties; n is the
    number of words of the language. Phrases inside a longer one with share percent of their occurrences or more are left out: the longer one
    may be taken a word longer, as its own parts have as many occurrences. Order is by score and a, descending, then by the phrase's bytes.
    Null and empty texts have no word, a null lang is und; repeated rows count each; doc_id isn't read; extra columns are ignored; an
    empty table, or one without a phrase of least occurrences, gives no row. Long texts are cut into parts of limit bytes that lose no phrase.
    """
    rows = same_rows(docs, "text", "lang").select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    both = min(24, max(5, (size // RANGE_BYTES).bit_length()))
    bits = (both - both // 2, both // 2)
    nodes = rows.mapInArrow(_sent(bits, limit, held), PIECES).groupBy("range").applyInArrow(_whole(least), NODES)
    nodes = staged(nodes, "collocation-nodes")
    words = nodes.where("depth = 1").select("h1", "lang", F.col("word").alias("phrase"), "a")
    first = words.select("h1", F.col("lang"), F.col("phrase").alias("word"), F.col("a").alias("l1"))
    level, levels = words.select(F.col("h1").alias("r1"), F.col("phrase").alias("rest"), F.array("a").alias("rs")), []
    for d in range(2, DEPTH + 1):
        link = {f"h{k + 1}": f"r{k}" for k in range(1, d)}
        met = nodes.where(F.col("depth") == d).drop("lang", "word").join(first, "h1")
        met = met.join(level, [F.col(h) == F.col(r) for h, r in link.items()]).withColumn("phrase", F.concat_ws(" ", "word", "rest"))
        lefts = [F.col("l1"), F.col("p2"), F.col("p3")][: d - 1]
        met = met.withColumn("best", _cut_score(F.col("a"), [(x, F.get("rs", F.lit(k))) for k, x in enumerate(lefts)]))
        met = staged(met.select(*(f"h{k}" for k in range(1, d + 1)), "lang", "phrase", "a", "child", "best", F.concat(F.array("a"), "rs").alias("rs")), f"phrases-{d}")
        levels.append(met)
        level = met.select(*(F.col(f"h{k}").alias(f"r{k}") for k in range(1, d + 1)), F.col("phrase").alias("rest"), "rs")
    found = []
    for d, mine in enumerate(levels, 2):
        if d < DEPTH:
            key = [f"h{k}" for k in range(1, d + 1)]
            longer = levels[d - 1].groupBy(*(F.col(f"h{k + 1}").alias(f"h{k}") for k in range(1, d + 1))).agg(F.max("a").alias("before"))
            mine = mine.join(longer, key, "left").where(100 * F.greatest("child", F.coalesce("before", F.lit(0))) < share * F.col("a"))
        found.append(mine.select("lang", "phrase", "a", "best.l", "best.r", "best.score"))
    every = found[0].unionByName(found[1]).unionByName(found[2])
    order = [F.desc("score"), F.desc("a"), "phrase"]
    dealt = every.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(DEALT)))
    dealt = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order))).where(F.col("rank") <= top)
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    n = nodes.where("depth = 0").groupBy("lang").agg(F.sum("a").alias("n"))
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
