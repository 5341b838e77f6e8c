import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from wagerlake.llm import collocations

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top=2000, share=80):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UP)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for d in range(1, 5):
                f[lang].update(tuple(w[i : i + d]) for i in range(len(w) - d + 1))
    out = []
    for lang, count in f.items():
        may = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for q, a in may.items():
            for d in range(2, len(q)):
                for i in range(len(q) - d + 1):
                    longer[q[i : i + d]] = max(longer[q[i : i + d]], a)
        rows = []
        for p, a in may.items():
            if 100 * longer[p] >= share * a:
                continue
            score, _, left, right = min((2_000_000 * a // (count[p[:k]] + count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    """Null texts and languages, empty ones, odd white space, ties, repeated rows, a text of 30,000 words, one language with nearly all."""
    rnd = random.Random(12)
    words = ["of", "The", "the", "new", "york", "city", "é", "ñandú", "中文", "x y", "a" * 40, "ok"]
    say = lambda k: "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "\t ", ", ", ". ", "\n", "\r\n", ";"]) for _ in range(k))
    out = [(say(rnd.randint(0, 80)), rnd.choice(["en", "en", "en", "en", None, "und", "fr\n"])) for _ in range(80)]
    return [*out, (None, "en"), ("", None), (" .,", "en"), (say(30_000), "en"), ("new york city " * 200, "en"), *out[:5]]


@pytest.mark.parametrize(("limit", "held"), [(collocations.RUN, collocations.HELD), (300, 500)])
def test_phrases_match_plain_python(spark, rows, limit, held):
    docs = spark.createDataFrame([(t, g, "p", i) for i, (t, g) in enumerate(rows)], "text string, lang string, phrase string, rank long").repartition(3)
    for least, top in ((5, 2000), (30, 7)):
        found = collocations.collocations(docs, least, top, limit=limit, held=held)
        assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, found.collect())) == plain(rows, least, top)


def test_no_rows_and_no_phrases(spark):
    none = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(none).collect() == []
    assert collocations.collocations(spark.createDataFrame([(None, None), ("one two three", "en")], "text string, lang string")).collect() == []


def test_scores_beyond_64_bits(spark):
    df = spark.createDataFrame([(7 * 10**13, 9 * 10**13, 7 * 10**13 + 1)], "a long, l long, r long")
    score = df.select(collocations._cut_score(df.a, [(df.l, df.r), (df.r, df.r)]).alias("b")).first().b
    assert tuple(score) == (2_000_000 * 7 * 10**13 // (16 * 10**13 + 1), 1, 9 * 10**13, 7 * 10**13 + 1)


def test_tries_come_back_from_their_pieces_and_merge():
    rnd = random.Random(5)
    texts = [("en" if i % 3 else "de", " ".join(rnd.choice("abcdefgh") for _ in range(50)).encode(), 99) for i in range(40)]
    whole = collocations.trie_of(texts)
    parts = [collocations.trie_of(texts[i::4]) for i in range(4)]
    sent = [collocations.restored(raw) for t in parts for _, raw in collocations.cut(t, (3, 2))]
    back = collocations.merged(sent)
    for d in range(collocations.DEPTH):
        assert np.array_equal(back.label[d], whole.label[d]) and np.array_equal(back.count[d], whole.count[d]) and np.array_equal(back.above[d], whole.above[d])
    assert back.words == whole.words


def test_two_words_of_one_hash_are_noticed():
    a, b = collocations.trie_of([("en", b"one", 3)]), collocations.trie_of([("en", b"two", 3)])
    b.label[0] = a.label[0]
    with pytest.raises(ValueError, match="one hash"):
        collocations.merged([a, b])
