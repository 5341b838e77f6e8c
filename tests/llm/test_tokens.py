import random

import pandas as pd
import pytest

P = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from wagerlake.llm import bpe_stream, queries, token_counts  # noqa: E402

DOCS = "doc_id long, text string, lang string"


def odd_texts():
    rnd = random.Random(1)
    letters = "aeiou thn'sİΣßéñ<|>12٣½ \t\n　 é中文🙂ǅ!?.-_"
    made = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    return [None, "", " ", "<|endoftext|>hi<|startoftext|>", "<s> </s>", "a" * 3000, "ab" * 2000, "!" * 2000, "".join(rnd.choice("etaoinsr") for _ in range(5000)), "it's we'll Don'T", *made]


def test_bpe_streams_as_the_library_encodes(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = odd_texts()
    docs = spark.createDataFrame([(i, t, "xx") for i, t in enumerate(texts)], DOCS)
    coded = bpe_stream.encode(docs, P.path("word_bpe_49k.json"))
    back = {r.doc_id: r.text for r in bpe_stream.decode(coded, P.path("word_bpe_49k.json")).collect()}
    ids = {r.doc_id: list(r.ids) for r in coded.collect()}
    for i, t in enumerate(texts):
        want = lib.encode(t or "", add_special_tokens=False).ids
        assert ids[i] == want
        assert back[i] == lib.decode(want, skip_special_tokens=False)


def test_bpe_of_controls_and_repeated_rows(spark):
    """Every C0 and C1 control and white space of any kind between, before and behind letters; clashing columns, null ids, repeated rows."""
    import hashlib

    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    odd = [chr(i) for i in (*range(32), *range(127, 161), 0x1680, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)]
    texts = [t for c in odd for t in (f"a{c}b", f"{c}!{c}{c}x", f"it{c}'s", c)] + ["x\u0308\u2000e\u0301 <|endoftext|>\x1c", "q" * 70 + "\x1d" + "é" * 300, None]
    rows = [(i if i % 7 else None, t, "ids", i) for i, t in enumerate(texts)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    want = []
    for i, t, *_ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_stream.digests(docs, path).collect()) == sorted(want)


def test_bpe_holds_a_bounded_number_of_tokens(monkeypatch):
    coder = bpe_stream.loaded(P.path("word_bpe_49k.json"))
    monkeypatch.setattr(bpe_stream, "RUN", 5)
    names = {i: str(i) for i in coder.token}
    text = "streams of words, é and 🙂 " * 40 + "z" * 500
    ids, digest = list(coder.encode(text)), bpe_stream.digest(coder, names, text)
    import hashlib

    assert digest == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256("".join(coder.decode(ids)).encode()).hexdigest())


def test_bpe_splits_alike_in_small_windows(monkeypatch):
    coder = bpe_stream.loaded(P.path("word_bpe_49k.json"))
    texts = [t for t in odd_texts() if t] + ["a\x1cb c\x1dd  \x1f e" * 9]
    want = [list(coder.encode(t)) for t in texts]
    monkeypatch.setattr(bpe_stream, "WINDOW", 5)
    assert [list(coder.encode(t)) for t in texts] == want


def test_bpe_window_is_bounded():
    coder = bpe_stream.loaded(P.path("word_bpe_49k.json"))
    seen = []
    whole = coder.merged
    coder.merged = lambda s: seen.append(len(s)) or whole(s)
    try:
        ids = list(coder.word(coder.symbols("the" * 5000)))
    finally:
        coder.merged = whole
    assert max(seen) <= 4 * coder.reach + 64
    assert ids == [coder.ids[t] for t in coder.merged(list(coder.symbols("the" * 5000)))]


def test_byte_decoder_holds_back_partial_characters():
    coder = bpe_stream.loaded(P.path("word_bpe_49k.json"))
    letters = [coder.ids[coder.letters[b]] for b in "é🙂".encode()]
    coder_joint, coder.joint = coder.joint, ""
    known = dict(coder.bytes)
    coder.bytes |= {i: bytes([b]) for i, b in zip(letters, "é🙂".encode(), strict=True)}
    try:
        assert "".join(coder.decode(letters, run=1)) == "é🙂"
        assert "".join(coder.decode(letters[:-1], run=2)) == "é�"
    finally:
        coder.joint, coder.bytes = coder_joint, known


@pytest.mark.parametrize(("chunk", "overlap"), [(1 << 16, 1 << 10), (40, 8), (64, 30)])
def test_token_counts_as_the_library_counts(spark, chunk, overlap):
    lib = token_counts.processor(P.path("piece_bpe_32k.model"))
    texts = [*odd_texts(), " ".join(["the  cat", "sat "] * 300), "x" * 500 + " y" * 40]
    docs = spark.createDataFrame([(None if i == 9 else i // 2, t, "xx") for i, t in enumerate(texts + texts[-3:])], DOCS)
    got = token_counts.token_counts(docs, P.path("piece_bpe_32k.model"), chunk, overlap).toPandas()
    want = pd.DataFrame([(None if i == 9 else i // 2, len((t or "").encode()), len(lib.encode(t or ""))) for i, t in enumerate(texts + texts[-3:])], columns=got.columns)
    key = lambda f: sorted(map(str, f.astype(float).itertuples(index=False)))
    assert key(got) == key(want)


def test_token_counts_ignore_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "one two", 7, "x"), (1, "one two", 8, "y"), (None, None, 9, "z")], "doc_id long, text string, n_tokens int, row string")
    got = sorted((str(r.doc_id), r.n_tokens) for r in token_counts.token_counts(docs, P.path("piece_bpe_32k.model")).collect())
    n = len(token_counts.processor(P.path("piece_bpe_32k.model")).encode("one two"))
    assert got == [("1", n), ("1", n), ("None", 0)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    assert token_counts.token_counts(docs, P.path("piece_bpe_32k.model")).count() == 0
    assert bpe_stream.digests(docs, P.path("word_bpe_49k.json")).count() == 0


def test_packing_places_model_tokens(spark, tmp_path):
    texts = ["Unbelievably tokenizable words, repeatedly.", "漢字" * 6000, "aGVsbG8gd29ybGQ" * 900, "", None, "one two " * 5000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    lib = token_counts.processor(P.path("piece_bpe_32k.model"))
    want = {i: len(lib.encode(x)) for i, x in enumerate(texts) if x}
    assert max(want.values()) > 4096
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for run in (lambda: queries.op10_best_fit_packing(spark, str(tmp_path)), lambda: corpus_pipeline.packed(spark, docs, str(tmp_path))):
        sums = {}
        for r in run().collect():
            sums[r.doc_id] = sums.get(r.doc_id, 0) + r.n_tokens
            assert r.bin_offset + r.n_tokens <= r.bin_length
        assert sums == want
