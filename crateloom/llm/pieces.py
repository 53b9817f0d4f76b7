"""SentencePiece encoding and decoding with an Aho-Corasick automaton and a single-pass Viterbi.

The pieces of a vocabulary file form an automaton.  One pass over a text visits every piece that ends at each position
(the automaton follows its output links); each relaxes the best score of that position from the position where the
piece starts, so the best segmentation by the sum of piece scores is known at the end of the pass.  Characters that no
piece covers get the unknown score and are written as byte pieces.  Ties go to the longer piece.

Blanks are written as U+2581 and one is put in front of the text.  A piece has that mark at its start only, so the text is cut
before each run of marks and every part is encoded alone; parts that recur in a task are looked up in a bounded table.

Decoding joins the pieces' bytes, puts blanks back and removes the one in front.  It returns the text exactly unless the text
contains U+2581 itself, which reads as a blank.

Defined results: null texts give null ids and a null decoded text; empty texts give no ids; a text of any length is
encoded whole; equal texts get equal ids; an empty table gives no rows.  Only the named columns are read.
"""
from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MARK = "▁"
UNKNOWN_PENALTY = 10.0
TABLE_SIZE = 200_000
PART = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+$")


class Pieces:
    """A vocabulary: list of (piece, score, kind), kind one of ``normal``, ``byte``, ``other``."""

    def __init__(self, vocabulary: list[tuple[str, float, str]]):
        self.bytes_of: list[bytes] = []
        self.byte_id: dict[int, int] = {}
        self.auto = ahocorasick.Automaton()
        least = 0.0
        for i, (piece, score, kind) in enumerate(vocabulary):
            if kind == "byte":
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif kind == "normal":
                self.auto.add_word(piece, (len(piece), score, i))
                self.bytes_of.append(piece.replace(MARK, " ").encode())
                least = min(least, score)
            else:
                self.bytes_of.append(b"")
        self.auto.make_automaton()
        self.single = {p for p, _, kind in vocabulary if kind == "normal" and len(p) == 1}
        # parts can be encoded alone only if no piece reaches over a mark from before it
        self.cut = all(MARK not in p.lstrip(MARK) for p, _, kind in vocabulary if kind == "normal")
        self.unknown = least - UNKNOWN_PENALTY
        self.seen: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = [("byte" if sp.is_byte(i) else "other" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "normal") for i in range(len(sp))]
        return cls([(sp.id_to_piece(i), sp.get_score(i), kinds[i]) for i in range(len(sp))])

    def best(self, part: str) -> list[int]:
        """Ids of the best segmentation of one part."""
        n = len(part)
        score, back = [0.0] + [None] * n, [None] * (n + 1)
        done = 0                                     # positions up to here have their final score

        def settle(upto: int) -> None:               # a character that is no piece can be passed as unknown
            nonlocal done
            while done < upto:
                done += 1
                if part[done - 1] not in self.single:
                    s = score[done - 1] + self.unknown
                    if score[done] is None or s > score[done]:
                        score[done], back[done] = s, (done - 1, -1)
        for end, (length, gain, i) in self.auto.iter(part):
            settle(end)                              # all positions before this end are final
            start = end + 1 - length
            s = score[start] + gain
            if score[end + 1] is None or s > score[end + 1]:
                score[end + 1], back[end + 1] = s, (start, i)
        settle(n)
        ids: list[int] = []
        at = n
        while at:
            start, i = back[at]
            if i < 0:
                ids += [self.byte_id.get(b, 0) for b in reversed(part[start:at].encode("utf-8", "replace"))]
            else:
                ids.append(i)
            at = start
        return ids[::-1]

    def encode(self, text: str) -> bytes:
        """Ids as packed 32-bit numbers."""
        if not text:
            return b""
        seen, out = self.seen, []
        whole = MARK + text.replace(" ", MARK)
        for part in PART.findall(whole) if self.cut else [whole]:
            ids = seen.get(part)
            if ids is None:
                ids = array("i", self.best(part)).tobytes()
                if len(part) <= 64:
                    if len(seen) >= TABLE_SIZE:
                        seen.clear()
                    seen[part] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids) -> str:
        table = self.bytes_of
        data = b"".join([table[i] for i in ids])
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


def _run(df: DataFrame, path: str, schema: str, work) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces.load(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                yield work(model, b.slice(at, 256))
    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", check: bool = False) -> DataFrame:
    """Columns: id, n_pieces, ids; with ``check`` round_trip: decoding the ids gives the text back."""
    def work(model: Pieces, b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column(1).to_pylist()
        packed = [None if t is None else model.encode(t) for t in texts]
        sizes = [0 if p is None else len(p) // 4 for p in packed]
        flat = np.frombuffer(b"".join(p for p in packed if p), np.int32)
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        gone = pa.array([p is None for p in packed], pa.bool_())
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()), mask=gone)
        cols = [b.column(0), pa.array([None if p is None else n for p, n in zip(packed, sizes)], pa.int64()), ids]
        if check:
            cols.append(pa.array([None if t is None else model.decode(flat[a:z].tolist()) == t for t, a, z in zip(texts, ends, ends[1:])], pa.bool_()))
        return pa.RecordBatch.from_arrays(cols, [id_col, "n_pieces", "ids", "round_trip"][:len(cols)])
    slim = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return _run(slim, path, f"{id_col} bigint, n_pieces bigint, ids array<int>" + ", round_trip boolean" * check, work)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Columns: id, text."""
    def work(model: Pieces, b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [None if x is None else model.decode(x) for x in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [id_col, "text"])
    return _run(encoded.select(F.col(id_col).cast("long").alias("_id"), F.col(ids_col).alias("_ids")), path, f"{id_col} bigint, text string", work)
