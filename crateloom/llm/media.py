"""Media columns with content-defined chunking.

A payload becomes a mono 8-bit PCM file (44 bytes of header, one sample a byte).  The file is cut where a rolling gear hash of
the last 32 bytes has its top bits zero, so equal passages give equal chunks wherever they stand.  Chunks are known by their
digest; a Spark join finds the first medium that has each of them, and only that one's pack holds its bytes.  A medium is
restored from its ordered chunk list: own chunks from its pack, the others joined by digest, then checked against the digest
of the whole file that was taken before it was stored.

The bytes are shuffled once on their way into the store, block-sorted and packed; afterwards only media that borrow chunks
move again.  Chunks that many media borrow are one row in the store.

Defined results: a null text is an empty text; the payload is the text's UTF-8 and zero bytes up to a positive multiple of 64;
equal texts give equal rows and are stored once, so ties need no rule; texts of any length are cut whole; repeated and null ids are ordinary; an empty table gives no rows.  Only id and
text are read.  A medium that does not pass its check raises an error.
"""
from __future__ import annotations

import bz2
import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from crateloom.llm.common import stored

UNIT, HEADER, RATE, SLICE = 64, 44, 16000, 1 << 22
_X = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
GEAR = ((_X ^ (_X >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32)


class Cutting(NamedTuple):
    """Chunk sizes in bytes: least, most, and the bits that set the mean distance of cuts (2 ** bits)."""

    least: int = 2048
    most: int = 32768
    bits: int = 13


def payload_of(text: bytes | None) -> bytes:
    data = text or b""
    return data + bytes(-len(data) % UNIT if data else UNIT)


def wave(payload: bytes) -> bytes:
    """A mono 8-bit PCM file of the payload's bytes as samples."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def samples(media: bytes) -> bytes:
    """The samples of a file made by :func:`wave`."""
    tag, size = struct.unpack_from("<4sI", media, 36)
    if media[:4] != b"RIFF" or tag != b"data" or size != len(media) - HEADER:
        raise ValueError("not a PCM file of this store")
    return media[HEADER:]


def gear_hits(data: bytes, bits: int) -> np.ndarray:
    """Positions after which the rolling hash allows a cut."""
    out = []
    for at in range(0, len(data), SLICE):
        lead = min(at, 31)
        h = GEAR[np.frombuffer(data, np.uint8, min(SLICE + lead, len(data) - at + lead), at - lead)]
        for k in (1, 2, 4, 8, 16):                  # sums over 2, 4, .. 32 bytes, each byte shifted by its distance
            h[k:] = h[k:] + (h[:-k] << np.uint32(k))
        out.append(np.flatnonzero(h[lead:] >> np.uint32(32 - bits) == 0) + at + 1)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def cut(data: bytes, how: Cutting, hits: np.ndarray | None = None) -> list[bytes]:
    if len(data) <= how.least:
        return [data]
    hits = gear_hits(data, how.bits) if hits is None else hits
    out, at = [], 0
    while at < len(data):
        i = np.searchsorted(hits, at + how.least)
        to = min(int(hits[i]) if i < len(hits) else len(data), at + how.most, len(data))
        out.append(data[at:to])
        at = to
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def feature(payload: bytes) -> str:
    """Mean, power and level crossings of the samples about the midpoint, in whole numbers."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    return f"mean={int(x.sum() * 1000 // len(x))};power={int((x * x).sum() // len(x))};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())}"


def _little_endian(n: Column) -> Column:
    """A whole number as four bytes, the lowest first."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(n, 8 * i).bitwiseAND(255)), 2, "0") for i in range(4)]))


def media_key(text: Column) -> Column:
    """Digest of the whole file that :func:`wave` makes of a text's payload; by it a medium is known and checked."""
    n = F.octet_length(text).cast("long")
    size = F.greatest(F.lit(UNIT), F.ceil(n / UNIT) * UNIT)
    head = wave(b"")
    parts = [F.lit(bytearray(head[:4])), _little_endian(size + 36), F.lit(bytearray(head[8:40])), _little_endian(size), text.cast("binary"),
             F.unhex(F.repeat(F.lit("00"), (size - n).cast("int")))]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _media(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(media_key(text).alias("media"), text.cast("binary").alias("_text"))


def _batches(fn, size: int = 64):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, size):
                yield fn(b.slice(at, size))
    return run


def chunk_lists(docs: DataFrame, how: Cutting, text_col: str) -> DataFrame:
    """A row a medium: its key and ``chunks``, in order: digest, own (its bytes are in the medium's pack), lent."""
    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        lists = [[digest(c) for c in cut(wave(payload_of(t)), how)] for t in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(lists, pa.list_(pa.binary()))], ["media", "digests"])
    lists = _media(docs, text_col).mapInArrow(_batches(work), "media binary, digests array<binary>")
    rows = lists.groupBy("media").agg(F.first("digests").alias("digests")).select("media", F.posexplode("digests").alias("pos", "digest"))
    first = rows.groupBy("digest").agg(F.min(F.struct("media", "pos")).alias("first"), F.count("*").alias("uses"))
    both = rows.join(first, "digest").withColumn("own", (F.col("first.media") == F.col("media")) & (F.col("first.pos") == F.col("pos")))
    return both.groupBy("media").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "own", (F.col("uses") > 1).alias("lent")))).alias("chunks"))


def pack_media(docs: DataFrame, how: Cutting = Cutting(), text_col: str = "text") -> DataFrame:
    """Store all media of ``docs``; returns the stored packs: media (digest of the file), chunks, data (of own chunks, in order)."""
    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        data = [[bz2.compress(c) for c in cut(wave(payload_of(t)), how)] for t in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.list_(pa.binary()))], ["media", "data"])
    packed = _media(docs, text_col).mapInArrow(_batches(work), "media binary, data array<binary>")
    single = packed.groupBy("media").agg(F.first("data").alias("_data"))
    lists = chunk_lists(docs, how, text_col)
    own = F.expr("transform(filter(arrays_zip(chunks, _data), c -> c.chunks.own), c -> c._data)")
    out = single.join(lists, "media").select("media", "chunks", own.alias("data"))
    return stored(out, "media-packs", compression="uncompressed")


RESTORED = "media binary, size bigint, payload_bytes bigint, payload_sha binary, tail_crc32 bigint, feature string"


def _restore(rows: DataFrame) -> DataFrame:
    """``rows``: media, chunks and data (of all chunks, in order)."""
    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(5)]
        for sha, chunks, data in zip(*(b.column(i).to_pylist() for i in range(3))):
            parts = [bz2.decompress(d) for d in data]
            media = b"".join(parts)
            if [digest(p) for p in parts] != [c["digest"] for c in chunks] or hashlib.sha256(media).digest() != sha:
                raise ValueError("a stored medium does not match its digests")
            payload = samples(media)
            for o, v in zip(out, (len(media), len(payload), hashlib.sha256(payload).digest(), zlib.crc32(payload[-UNIT:]), feature(payload))):
                o.append(v)
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(o, k) for o, k in zip(out, kinds))],
                                          [c.split()[0] for c in RESTORED.split(", ")])
    return rows.select("media", "chunks", "data").mapInArrow(_batches(work), RESTORED)


def restore_media(packs: DataFrame) -> DataFrame:
    """Every medium rebuilt from its chunk list and checked, with what is computed from the bytes read back."""
    whole = packs.where("forall(chunks, c -> c.own)")
    partly = packs.where("exists(chunks, c -> not c.own)")
    lent = (packs.where("exists(chunks, c -> c.own and c.lent)")
            .select(F.explode(F.expr("arrays_zip(filter(chunks, c -> c.own), data)")).alias("c")).where("c.`0`.lent").select("c.`0`.digest", "c.data"))
    asked = partly.select("media", F.explode("chunks").alias("c")).where("not c.own").select("media", "c.pos", "c.digest")
    came = asked.join(lent, "digest").groupBy("media").agg(F.collect_list(F.struct("pos", "data")).alias("came"))
    own = F.expr("transform(arrays_zip(filter(chunks, c -> c.own), data), c -> struct(c.`0`.pos as pos, c.data as data))")
    full = (partly.withColumn("own", own).join(came, "media")
            .withColumn("data", F.expr("transform(array_sort(concat(own, came)), c -> c.data)")))
    return _restore(whole).unionByName(_restore(full))


def media_rows(docs: DataFrame, how: Cutting = Cutting(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document with what its restored medium holds."""
    packs = pack_media(docs, how, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.octet_length(text).cast("long").alias("n_bytes"), media_key(text).alias("media"))
    return rows.join(restore_media(packs), "media").select(
        F.col("_id").alias(id_col), "n_bytes", "payload_bytes", F.lower(F.hex("payload_sha")).alias("payload_sha256"), "tail_crc32",
        F.col("size").alias("media_bytes"), F.lower(F.hex("media")).alias("media_sha256"), "feature")
