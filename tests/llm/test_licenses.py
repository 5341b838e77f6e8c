import random
import re

import pytest

from wagerlake.llm import license_scan

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))


def plain(text):
    """The contract and the voting rule over word lists, without hashes."""
    w = words(text)
    places = [(i, label) for t, label in license_scan.BASE for i in range(len(w)) if w[i : i + len(t.split())] == t.split()]
    labels, best = {label for _, label in places}, 1.0 if places else 0.0
    for t, label in license_scan.TEMPLATES:
        t, k = words(t), license_scan.K
        votes = {}
        for j in range(len(t) - k + 1):
            for i in range(len(w) - k + 1):
                if w[i : i + k] == t[j : j + k]:
                    votes.setdefault(i - j, set()).add(i)
        groups, before = [], None
        for d in sorted(votes):
            if before is None or d - before > license_scan.SHIFT:
                groups.append([])
            groups[-1].append(d)
            before = d
        for g in groups:
            if 100 * sum(len(votes[d]) for d in g) < license_scan.VOTES * (len(t) - k + 1):
                continue
            same = {i - d for d in g for i in range(min(votes[d]), max(votes[d]) + k) if w[i] == t[i - d]}
            if 100 * len(same) >= license_scan.VERIFIED * len(t):
                labels.add(label)
                best = max(best, len(same) / len(t)) if not places else 1.0
    at = [i for i, _ in places]
    return (len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), best)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(13)
    common = ["the", "software", "license", "mit", "of", "this", "é", "中文", "X1"]
    say = lambda n: " ".join(rnd.choice(common) for _ in range(n))
    texts = [None, "", " -- ", "MIT-License mit\nlicense", "mit licenses", "general public public license", "General  PUBLIC license general public license", "é" * 400]
    for t, _ in license_scan.TEMPLATES:
        w = t.split()
        for changes in (0, 1, len(w) // 8, len(w) // 3, len(w) // 2):
            v = list(w)
            for _ in range(changes):
                i = rnd.randrange(len(v))
                rnd.choice([lambda i=i, v=v: v.insert(i, "inserted"), lambda i=i, v=v: v.pop(i), lambda i=i, v=v: v.__setitem__(i, "other")])()
            texts.append(f"{say(rnd.randint(0, 30))} {' '.join(v)} {say(rnd.randint(0, 30))}")
    texts += [say(3000) + " apache license " + say(3000), "Released under the MIT License. " * 300]
    return [*enumerate(texts), (None, texts[9]), (3, texts[6]), (3, texts[6]), (3, texts[12]), (-9, "mit license")]


@pytest.mark.parametrize("limit", [license_scan.RUN, 50])
def test_scan_matches_plain_python(spark, rows, limit):
    """Nulls, long texts, repeated rows and ids, clashing columns; the same with texts cut in small parts."""
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, labels string, k int").repartition(3)
    found = license_scan.scan(docs, limit)
    assert found.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(str((i, *plain(t))) for i, t in rows)


def test_labels_beyond_the_base_ones(spark):
    said = {1: "Text. Licensed under CC BY-NC 4.0.", 2: "This is free and unencumbered software, released into the public domain!", 3: "We licensed a film under terms of four."}
    found = license_scan.scan(spark.createDataFrame([*said.items()], "doc_id long, text string"))
    assert {r.doc_id: (r.base_labels, r.labels) for r in found.collect()} == {1: ("", "cc-by-nc"), 2: ("", "unlicense"), 3: ("", "")}


def test_empty_table(spark):
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
