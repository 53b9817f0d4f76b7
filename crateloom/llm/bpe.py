"""Byte-level BPE encoding by backtracking and decoding by an offset table.

The vocabulary's merges, in their order, number its tokens: bytes first, then one token a merge.  Encoding a part of a text
needs no merge queue:

* One pass of an Aho-Corasick automaton over the part finds the longest token that starts at each byte.
* From the left, the longest token at the position is tried, then its longest prefix that is a token, and so on.  It
  is taken if it may stand next to the token before it; if none may, that position is no border of the result, the token before
  is given up and its shorter prefixes are tried.  A position is ruled out at most once, so the work is linear.
* Two tokens may stand side by side if merging their bytes leaves a border between them.  That is read off a table of merges:
  the token formed later is unwound into the half that touches the border, and no merge across the border may come earlier.  Answers
  are kept in a pair-compatibility table.

This gives exactly the merges of the greedy definition.  Texts are first cut at the vocabulary's added tokens and then into
words, numbers, symbols and blanks by its pattern; parts that recur in a task are looked up in a bounded table.

Decoding looks up each id's slice of one byte string in an offset table and gathers all bytes of a stretch at once.

Defined results: null texts give null ids and a null decoded text, empty texts no ids; a text of any length is encoded whole, in
memory that grows with the text; equal texts get equal ids, so ties and repeated rows need no rule; ids of any type pass
through; an empty table gives no rows; ids outside the vocabulary decode to nothing; bytes that are no UTF-8 decode to U+FFFD.
Only the named columns are read, so others may have any name.
"""
from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from crateloom.llm.common import parts_of

# The words, numbers, symbols and blanks of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Code points that newer Unicode tables call letters or numbers, but the tables of the vocabulary's pattern (version 16) do not.
NEWER = ((0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
         (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF),
         (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9),
         (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3),
         (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191),
         (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81),
         (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED),
         (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479),
         (0x3D000, 0x3FC3F))
#: Parts and pairs a task remembers, ids decoded at once.
TABLE_SIZE, PAIRS, STRETCH = 500_000, 500_000, 1 << 18


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary file: itself if it is printable, else the next letter from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """Tokens of a vocabulary, numbered by their merge; ``ids`` are the vocabulary's own numbers."""

    def __init__(self, pairs: list[tuple[bytes, bytes]], ids: dict[bytes, int], added: dict[str, int] | None = None):
        self.tokens = [bytes([b]) for b in range(256)] + [a + b for a, b in pairs]
        number = {t: i for i, t in enumerate(self.tokens)}
        self.left, self.right = list(range(256)), list(range(256))
        self.merge: dict[tuple[int, int], int] = {}
        for i, (a, b) in enumerate(pairs, 256):
            self.left.append(number[a])
            self.right.append(number[b])
            self.merge[number[a], number[b]] = i
        self.size = [len(t) for t in self.tokens]
        self.prefix = [next((number[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in number), -1) for t in self.tokens]
        self.ids = [ids[t] for t in self.tokens]
        self.auto = ahocorasick.Automaton()
        for i, t in enumerate(self.tokens[256:], 256):
            self.auto.add_word(t.decode("latin-1"), i)
        if pairs:
            self.auto.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.seen: dict[str, bytes] = {}
        self.added = added or {}
        self.find_added = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        newer = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in NEWER)
        self.newer = np.array(NEWER, np.uint32).T.copy()
        self.cut = regex.compile(PATTERN)
        letters, numbers = f"[\\p{{L}}--[{newer}]]", f"[\\p{{N}}--[{newer}]]"
        self.cut_newer = regex.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^\\s{letters}{numbers}]").replace(r"?\p{L}", f"?{letters}")
                                       .replace(r"?\p{N}", f"?{numbers}"), regex.V1)
        # the offset table: bytes of id i are blob[start[i]:start[i + 1]]
        by_id = {ids[t]: t for t in self.tokens} | {i: t.encode() for t, i in self.added.items()}
        parts = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.blob = np.frombuffer(b"".join(parts), np.uint8)
        self.start = np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    @classmethod
    def load(cls, path: str) -> Merges:
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in whole["added_tokens"]):
            raise ValueError("added tokens that take blanks or whole words only are not supported")
        letters, vocabulary = byte_letters(), whole["model"]["vocab"]
        added = {t["content"]: t["id"] for t in whole["added_tokens"]}
        raw = {w: bytes(letters[c] for c in w) for w in vocabulary if w not in added}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in whole["model"]["merges"]]
        return cls([(raw[a], raw[b]) for a, b in pairs], {raw[w]: i for w, i in vocabulary.items() if w in raw}, added)

    def apart(self, a: int, b: int) -> bool:
        """Whether merging leaves a border between the bytes of two tokens."""
        limit = len(self.tokens)
        while True:
            if self.merge.get((a, b), limit) < limit:
                return False
            if max(a, b) < 256:
                return True
            if a > b:                                # it was formed later: before that, its right half touched the border
                limit, a = a, self.right[a]
            else:                                    # a merge of the same rank further left comes first
                limit, b = b + 1, self.left[b]

    def split(self, data: bytes) -> list[int]:
        """Token numbers of one part."""
        size, prefix, pairs = self.size, self.prefix, self.pairs
        n = len(data)
        longest = list(data)                         # a byte's token has its number
        for end, t in self.auto.iter(data.decode("latin-1")) if n > 1 and self.merge else ():
            longest[end + 1 - size[t]] = t           # ends ascend, so the longest stays
        border = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token, last = 0, longest[0], -1
        while True:
            end = at + size[token]
            fits = border[end]
            if fits and last >= 0:
                fits = pairs.get((last, token))
                if fits is None:
                    if len(pairs) >= PAIRS:
                        pairs.clear()
                    fits = pairs[last, token] = self.apart(last, token)
            if fits:
                out.append(token)
                if end == n:
                    return out
                at, last, token = end, token, longest[end]
            elif prefix[token] >= 0:
                token = prefix[token]
            else:
                border[at] = 0
                token = out.pop()
                at -= size[token]
                last = out[-1] if out else -1

    def _part(self, part: str) -> bytes:
        ids = self.ids
        packed = array("i", [ids[t] for t in self.split(part.encode("utf-8", "replace"))]).tobytes()
        if len(part) <= 32:
            if len(self.seen) >= TABLE_SIZE:
                self.seen.clear()
            self.seen[part] = packed
        return packed

    def _newer(self, text: str) -> bool:
        """Whether a code point of ``NEWER`` is in the text."""
        if text.isascii():
            return False
        c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        c = c[c >= NEWER[0][0]]
        return bool((c <= self.newer[1][np.searchsorted(self.newer[0], c, "right") - 1]).any())

    def _plain(self, text: str) -> bytes:
        cut = self.cut_newer if self._newer(text) else self.cut
        known, part = self.seen.get, self._part
        return b"".join([known(p) or part(p) for p in cut.findall(text)])

    def encode(self, text: str) -> bytes:
        """Ids as packed 32-bit numbers."""
        if self.find_added is None or not self.find_added.search(text):
            return self._plain(text)
        out, at = [], 0
        for hit in self.find_added.finditer(text):
            out += [self._plain(text[at:hit.start()]), np.int32(self.added[hit.group()]).tobytes()]
            at = hit.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: np.ndarray) -> str:
        out = []
        for at in range(0, len(ids), STRETCH):
            part = ids[at:at + STRETCH].astype(np.int64)
            part = part[(part >= 0) & (part < len(self.start) - 1)]
            first, size = self.start[part], self.start[part + 1] - self.start[part]
            before = np.cumsum(size) - size
            out.append(self.blob[np.repeat(first - before, size) + np.arange(size.sum())].tobytes())
        return b"".join(out).decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """Columns: the id, n_tokens, ids; with ``decoded`` also the text that the ids decode to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Merges.load(path)
        for b in parts_of(batches, 1):
            packed = [None if t is None else model.encode(t) for t in b.column(1).to_pylist()]
            ids = [np.frombuffer(p or b"", np.int32) for p in packed]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)), mask=pa.array([p is None for p in packed]))
            cols = [b.column(0), pa.array([None if p is None else len(x) for p, x in zip(packed, ids)], pa.int64()), lists]
            if decoded:
                cols.append(pa.array([None if p is None else model.decode(x) for p, x in zip(packed, ids)], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, ["_id", "n_tokens", "ids", "decoded"][:len(cols)])

    slim = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    out = StructType([slim.schema["_id"], StructField("n_tokens", LongType()), StructField("ids", ArrayType(IntegerType())),
                      *[StructField("decoded", StringType())] * decoded])
    return slim.mapInArrow(run, out).withColumnRenamed("_id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Columns: the id and text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Merges.load(path)
        for b in batches:
            texts = [None if x is None else model.decode(np.array([i for i in x if i is not None], np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["_id", "text"])

    slim = encoded.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{ids_col}`").alias("_ids"))
    return slim.mapInArrow(run, StructType([slim.schema["_id"], StructField("text", StringType())])).withColumnRenamed("_id", id_col)
