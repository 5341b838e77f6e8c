"""Byte-level BPE with word ends as a streaming transducer of bounded lookahead, and its decoder.

Merges form tokens by rank. What stands to the right of a token can change it only through merges of lower and lower rank,
so the merge list itself bounds how far that reaches: lookahead() computes the bound. The encoder keeps a window of that
many symbols, emits every token that ends further left, and goes on from there, so memory doesn't grow with the text.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import islice, pairwise

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import same_rows

#: The code points with the property White_Space, which is what the tokenizers library takes for \\s.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Distinct words whose ids a worker remembers before it starts anew.
MEMORY = 600_000
NEVER = 1 << 60
#: Tokens that are held at once, and characters that are split at once.
RUN, WINDOW = 4096, 1 << 16
_loaded: dict[str, BytePairs] = {}


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class BytePairs:
    """A tokenizers file of the kind: NFC, white space, lower case, a split pattern, byte letters, merges with a word end."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.ids |= self.special
        self.token = {i: t for t, i in self.ids.items()}
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): r for r, m in enumerate(model["merges"])}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]"))
        self.pieces, self.white, self.separators = regex.compile(f"[^{WHITE}]+"), regex.compile(f"[{WHITE}]"), regex.compile("[\x1c-\x1f]")
        self.parts = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.joint = "" if spec.get("decoder") else " "
        self.letters = byte_letters()
        self.byte_of = {c: b for b, c in enumerate(self.letters)}
        self.decoder = (spec.get("decoder") or {}).get("type")
        self.reach = lookahead(self.rank)
        self.bytes = {i: self.raw(i) for i in self.token}
        self.known: dict[str, tuple[int, ...]] = {}
        self.words_known: dict[str, tuple[int, ...]] = {}

    def normal(self, text: str) -> str:
        """NFC and every code point's own lower case of a piece without white space."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def merged(self, symbols: list[str]) -> list[str]:
        """The symbols after all merges, least rank first and the leftmost of equal ones first."""
        rank, out = self.rank.get, [*symbols]
        ranks = [rank(p, NEVER) for p in pairwise(out)]
        while ranks and (best := min(ranks)) != NEVER:
            i = ranks.index(best)
            out[i] += out.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = rank((out[i - 1], out[i]), NEVER)
            if i < len(ranks):
                ranks[i] = rank((out[i], out[i + 1]), NEVER)
        return out

    def word(self, symbols: Iterator[str]) -> Iterator[int]:
        """Ids of one word's symbols, each as soon as nothing further right can change it."""
        window: list[str] = []
        for ended in (False, True):
            while True:
                if not ended:
                    more = [s for _, s in zip(range(4 * self.reach + 64 - len(window)), symbols, strict=False)]
                    window += more
                    if not more or len(window) < 4 * self.reach + 64:
                        break
                at, tokens = 0, self.merged(window)
                for t in tokens:
                    size = len(t) if not ended else len(t.removesuffix(self.end))
                    if not ended and at + size + self.reach > len(window):
                        break
                    yield self.ids[t]
                    at += size
                window = window[at:]
                if ended:
                    return

    def symbols(self, word: str) -> Iterator[str]:
        for c in word[:-1]:
            yield from map(self.letters.__getitem__, c.encode("utf-8", "surrogatepass"))
        raw = word[-1].encode("utf-8", "surrogatepass")
        yield from map(self.letters.__getitem__, raw[:-1])
        yield self.letters[raw[-1]] + self.end

    def of_word(self, word: str) -> Iterable[int]:
        """Ids of a match of the split pattern; those of short ones are remembered, those of long ones come as they are found."""
        if len(word) > 64:
            return self.word(self.symbols(word))
        if (ids := self.words_known.get(word)) is None:
            symbols = list(self.symbols(word))
            ids = tuple(map(self.ids.__getitem__, self.merged(symbols))) if len(symbols) < self.reach else tuple(self.word(iter(symbols)))
            if len(self.words_known) >= MEMORY:
                self.words_known.clear()
            self.words_known[word] = ids
        return ids

    def plain(self, text: str) -> Iterator[tuple[str, bool]]:
        """(part, whether it is a special token's own string), from left to right."""
        at = 0
        for m in self.parts.finditer(text) if self.parts else ():
            yield text[at : m.start()], False
            yield m[0], True
            at = m.end()
        yield text[at:] if at else text, False

    def split(self, part: str) -> Iterator[str]:
        """Runs of other than white space, some WINDOW characters at a time. str.split parts at U+001C to U+001F too, so it serves where there are none."""
        at = 0
        while at < len(part):
            end = at + WINDOW
            gap = self.white.search(part, end) if end < len(part) else None
            some = part[at : gap.start() if gap else len(part)]
            yield from self.pieces.findall(some) if self.separators.search(some) else some.split()
            at += len(some)

    def encode(self, text: str) -> Iterator[int]:
        """Ids of text, word by word; a special token's own string is that token. White space parts words, so each is normalised by itself."""
        known = self.known
        for part, special in self.plain(text):
            if special:
                yield self.special[part]
                continue
            for piece in self.split(part):
                if (ids := known.get(piece)) is None:
                    if len(piece) > 64:
                        for w in self.words.finditer(self.normal(piece)):
                            yield from self.of_word(w[0])
                        continue
                    ids = tuple(i for w in self.words.findall(self.normal(piece)) for i in self.of_word(w))
                    if len(known) >= MEMORY:
                        known.clear()
                    known[piece] = ids
                yield from ids

    def raw(self, i: int) -> bytes:
        token = self.token[i]
        return bytes(map(self.byte_of.__getitem__, token)) if self.decoder == "ByteLevel" and token not in self.special else token.encode()

    def decode(self, ids: Iterable[int], run: int = RUN) -> Iterator[str]:
        """Text of ids, a run of tokens at a time: an incremental UTF-8 machine holds back what no character is yet."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        ids, lead, joint = iter(ids), b"", self.joint.encode()
        while some := list(islice(ids, run)):
            yield machine.decode(lead + joint.join(map(self.bytes.__getitem__, some)))
            lead = joint
        yield machine.decode(b"", final=True)


def lookahead(rank: dict[tuple[str, str], int]) -> int:
    """Symbols to the right of a token that can decide about it.

    need[y] bounds what decides whether token y forms at a place: its own length, and for each symbol x at its right end that
    waits for its own merge, what decides about a rival (x, z) of lower rank. Such a rival, and z, have lower ranks
    than y, so need is filled in rank order. A finished token waits for any (t, z): the bound is the largest need.
    """
    made: dict[str, tuple[int, str]] = {}
    rivals: dict[str, tuple[list[int], list[int]]] = {}
    need: dict[str, int] = {}
    most = 1
    for (a, b), r in sorted(rank.items(), key=lambda x: x[1]):
        if a + b not in made:
            made[a + b] = (r, b)
            reach, y = 0, a + b
            while y in made:
                bound, y = made[y]
                ranks, worst = rivals.get(y, ([], []))
                if k := bisect_left(ranks, bound):
                    reach = max(reach, worst[k - 1])
            need[a + b] = len(a + b) + reach
        ranks, worst = rivals.setdefault(a, ([], []))
        ranks.append(r)
        worst.append(max(worst[-1] if worst else 0, need.get(b, 1)))
        most = max(most, need.get(b, 1), need[a + b])
    return most


def loaded(path: str) -> BytePairs:
    if path not in _loaded:
        _loaded[path] = BytePairs(path)
    return _loaded[path]


def _coded(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = loaded(path)
        for batch in batches:
            ids = [list(coder.encode(t)) if isinstance(t, str) else [] for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": ids})

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids of every whole text; a null or empty text has none, rows stay one to one, an empty table gives none."""
    return same_rows(docs, "doc_id", "text").mapInPandas(_coded(path), "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of every row's ids; null ids are no ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = loaded(path)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": ["".join(coder.decode(x if x is not None else ())) for x in batch["ids"]]})

    return same_rows(coded, "doc_id", "ids").mapInPandas(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: texts go through the coder and back a run of tokens at a time.

    One row for each row of docs, also where rows repeat; a null text is the empty one; a null doc_id keeps its row; an empty table gives none; extra
    columns are ignored. Beside the text itself a task holds one word at most and RUN tokens.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = loaded(path)
        names: dict[int, str] = {i: str(i) for i in coder.token}
        for batch in batches:
            rows = [digest(coder, names, t if isinstance(t, str) else "") for t in batch["text"]]
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", batch["doc_id"])
            yield out

    return same_rows(docs, "doc_id", "text").mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def digest(coder: BytePairs, names: dict[int, str], text: str) -> tuple[int, str, str]:
    """Tokens of text, and the digests of ids and of what they decode to: one generator feeds both, RUN tokens at a time."""
    ids, n, there, back = coder.encode(text), 0, hashlib.sha256(), hashlib.sha256()
    machine, joint = codecs.getincrementaldecoder("utf-8")("replace"), coder.joint.encode()
    while some := list(islice(ids, RUN)):
        there.update((" " if n else "").encode() + " ".join(map(names.__getitem__, some)).encode())
        back.update(machine.decode((joint if n else b"") + joint.join(map(coder.bytes.__getitem__, some))).encode())
        n += len(some)
    back.update(machine.decode(b"", final=True).encode())
    return n, there.hexdigest(), back.hexdigest()
