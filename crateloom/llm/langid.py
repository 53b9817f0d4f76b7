"""Language identification with a blended-spectrum string kernel.

A text is the set of character n-grams (lengths 1 to 3, lower case, of all characters the landmarks have) it shares with the landmarks.  The kernel of two texts
is the number of n-grams both have, over the root of the product of their set sizes (presence kernel).  Landmarks
are a seeded, bounded sample per language; Nystroem features are the kernel values to all landmarks times the
inverse root of the landmark kernel; a one-versus-rest ridge regression is fitted on them.  All maps after the
presence matrix are linear but for the norm, so a batch is scored by two matrix products.

Bounds (parameters): ``landmarks`` and ``samples`` labelled rows a language, lowest seeded hash first.  Only they are
read whole by the fit, their n-grams are taken in Spark tasks, and the driver sees landmark n-gram counts and bit sets only.
Every other row is scored, over its whole text.

The score compares the two best languages, so it does not depend on how many there are: 1 / (1 + exp(-4 * margin)), 0.5 for a tie and 1 for
a single language; the margin itself is the difference of their ridge outputs.

Defined results: null texts and texts without a letter get ``und`` with score 0; with nothing to learn from every row does;
equal texts get equal predictions; a text with letters but no known n-gram gets the most frequent language of the sample with
score 0; equal outputs go to the language with more sampled texts, then to the first by name; texts of any length are read whole, slice by
slice; an empty table gives no rows.  Predictions read the text only; other columns may have any name.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from crateloom.llm.common import unused

SLICE = 1 << 20
ORDERS = 3


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def _grams(text: str, letters: np.ndarray) -> np.ndarray:
    """Different n-grams as numbers in base len(alphabet) + 1, where 0 means no further character; slice by slice."""
    base = np.int64(len(letters) + 2)
    found = np.zeros(0, np.int64)
    for at in range(0, max(len(text), 1), SLICE):
        raw = _codes(text[at:at + SLICE + ORDERS - 1])
        a = np.searchsorted(letters, raw)
        known = letters[np.minimum(a, len(letters) - 1)] == raw
        x = np.where(known, a + 1, base - 1).astype(np.int64)       # base - 1: a character no landmark has
        parts = [x, x[:-1] * base + x[1:], (x[:-2] * base + x[1:-1]) * base + x[2:]]
        ok = [known, known[:-1] & known[1:], known[:-2] & known[1:-1] & known[2:]]
        for n, (g, k) in enumerate(zip(parts, ok)):
            found = np.union1d(found, (g[k] + n * base ** ORDERS))
    return found


class _Columns:
    """The column of each n-gram number (the last one for numbers without): two hash tables, the second for numbers whose place is taken."""

    def __init__(self, numbers: np.ndarray):
        self.bits, self.none = max(10, int(4 * len(numbers)).bit_length()), np.int32(len(numbers))
        while not self._fill(numbers):
            self.bits += 1

    def _at(self, x: np.ndarray, table: int) -> np.ndarray:
        factor = np.uint64((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[table])
        return ((x.astype(np.uint64) * factor) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _fill(self, numbers: np.ndarray) -> bool:
        self.keys, self.cols = np.full((2, 1 << self.bits), -1, np.int64), np.full((2, 1 << self.bits), len(numbers), np.int32)
        left = np.arange(len(numbers))
        for table in (0, 1):
            at, first = np.unique(self._at(numbers[left], table), return_index=True)
            self.keys[table, at], self.cols[table, at] = numbers[left[first]], left[first]
            left = np.delete(left, first)
        return not len(left)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        a, b = self._at(x, 0), self._at(x, 1)
        return np.where(self.keys[0, a] == x, self.cols[0, a], np.where(self.keys[1, b] == x, self.cols[1, b], self.none))

    def __getitem__(self, number: int) -> int:
        return int(self(np.array([number], np.int64))[0])


class KernelModel:
    """The fitted maps; small enough to be sent with the tasks (``features`` x ``landmarks`` single-precision numbers)."""

    def __init__(self, letters, features, marks, weights, langs):
        self.parts = letters, features, marks, weights, langs       # plain values, which is what tasks are sent
        self.letters, self.features, self.marks, self.weights, self.langs = self.parts
        self.base = len(letters) + 2
        self.column = _Columns(features)
        self.place = np.full(0x110000, self.base - 1, np.int64)
        self.place[letters] = np.arange(1, len(letters) + 1)

    def presence(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.features) + 1), np.float32)
        b, size, column = self.base, self.base ** ORDERS, self.column
        for row, text in zip(out, texts):
            for at in range(0, len(text), SLICE):
                x = self.place[_codes(text[at:at + SLICE + ORDERS - 1].lower())]
                two = x[:-1] * b + x[1:]
                for gram in (x, two + size, two[:-1] * b + x[2:] + 2 * size):
                    row[column(gram)] = 1
        return out[:, :-1]

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the best language, a score of 0 to 1 and the margin to the second."""
        p = self.presence(texts)
        n = p.sum(1)
        k = (p @ self.marks) / np.sqrt(np.maximum(n, 1))[:, None]   # kernel to all landmarks
        f = k @ self.weights                                        # Nystroem map and ridge weights in one
        best = f.argmax(1)
        top = np.sort(f, 1)[:, -2:]
        margin = top[:, 1] - top[:, 0] if f.shape[1] > 1 else np.full(len(f), np.inf)
        share = 1 / (1 + np.exp(-4 * np.minimum(margin, 100)))
        return np.where(n > 0, best, 0), np.where(n > 0, share, 0.0), np.where(n > 0, margin, 0.0)


def _sample(labelled: DataFrame, landmarks: int, samples: int, seed: int) -> DataFrame:
    """At most ``samples`` different texts a language, lowest hash first; _mark: it is one of the landmarks.

    The bounds are found on hashes alone (a row a language comes back), then only rows within them are read.
    """
    hashed = labelled.withColumn("_h", F.xxhash64(F.lit(seed), "_text"))
    place = F.row_number().over(Window.partitionBy("_lang").orderBy("_h"))
    low = hashed.select("_lang", "_h").distinct().withColumn("_at", place).where(F.col("_at") <= samples)
    bounds = low.groupBy("_lang").agg(F.max("_h").alias("last"), F.max(F.when(F.col("_at") <= landmarks, F.col("_h"))).alias("mark")).collect()
    if not bounds:
        return hashed.where("false").withColumn("_mark", F.lit(True))
    last = F.create_map(*[F.lit(v) for r in bounds for v in (r["_lang"], r["last"])])
    mark = F.create_map(*[F.lit(v) for r in bounds for v in (r["_lang"], r["mark"])])
    return (hashed.where(F.col("_h") <= last[F.col("_lang")]).withColumn("_mark", F.col("_h") <= mark[F.col("_lang")])
            .dropDuplicates(["_lang", "_h"]))


def fit(labelled: DataFrame, landmarks: int = 32, samples: int = 256, ridge: float = 1e-2, seed: int = 5) -> KernelModel | None:
    """``labelled``: _text, _lang (neither null).  None if there is nothing to learn from."""
    rows = _sample(labelled, landmarks, samples, seed)
    texts = rows.where("_mark").select("_lang", "_h", F.lower("_text").alias("_text"))
    alphabet = texts.select(F.explode(F.array_distinct(F.split("_text", ""))).alias("c")).where("c != ''").groupBy("c").agg(F.count("*").alias("n"))
    letters = np.array(sorted({ord(r.c) for r in alphabet.collect() if len(r.c) == 1}), np.uint32)      # at most all code points
    if not len(letters):
        return None

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, at, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                g = _grams(text, letters)
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(g), "at": [at] * len(g), "g": g}, schema=pa.schema(
                    [("lang", pa.string()), ("at", pa.int64()), ("g", pa.int64())]))
    marks = texts.mapInArrow(grams, "lang string, at bigint, g bigint").toArrow().to_pydict()      # landmarks x their n-grams
    features, col = np.unique(np.array(marks["g"], np.int64), return_inverse=True)
    ids = {k: i for i, k in enumerate(sorted(set(zip(marks["lang"], marks["at"]))))}
    m = np.zeros((len(ids), len(features)), np.float32)
    m[[ids[k] for k in zip(marks["lang"], marks["at"])], col] = 1
    m /= np.sqrt(np.maximum(m.sum(1, keepdims=True), 1))
    probe = KernelModel(letters, features, m.T.copy(), np.zeros((len(m), 1), np.float32), [])

    sent = rows.sparkSession.sparkContext.broadcast(probe.parts)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = KernelModel(*sent.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                p = model.presence(b.column(1).to_pylist())
                k = (p @ model.marks) / np.sqrt(np.maximum(p.sum(1), 1))[:, None]
                yield pa.RecordBatch.from_pydict({"lang": b.column(0), "k": list(k.astype(np.float64))}, schema=pa.schema(
                    [("lang", pa.string()), ("k", pa.list_(pa.float64()))]))
    fitted = rows.select("_lang", "_text").mapInArrow(kernel, "lang string, k array<double>").toArrow().to_pydict()
    order = np.lexsort((np.array([x[0] for x in fitted["k"]]), np.array(fitted["lang"])))    # the same order on every run
    k = np.array(fitted["k"])[order]
    lang = np.array(fitted["lang"])[order]
    langs = sorted(set(lang), key=lambda x: (-int((lang == x).sum()), x))
    values, vectors = np.linalg.eigh((m @ m.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    z = k @ root
    y = np.array([[1.0 if a == b else -1.0 for b in langs] for a in lang])
    heft = np.array([1.0 / (lang == a).sum() for a in lang])[:, None]              # every language weighs the same
    zy, zz = z.T @ (heft * y), z.T @ (heft * z)
    w = np.linalg.solve(zz + ridge * len(langs) / max(len(z), 1) * np.eye(zz.shape[0]), zy)
    return KernelModel(letters, features, probe.marks, (root @ w).astype(np.float32), langs)


def identify(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             batch: int = 128, keep: str = "", **options) -> DataFrame:
    """Predict the language of every row; learn from rows where ``training`` holds and text and language are not null.

    Columns: id, lang_pred, score; with ``keep``, a name that no column has, all columns of ``docs`` and a struct of that name with
    lang_pred, score and margin.
    """
    labelled = docs.where(training & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    model = fit(labelled.select(F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang")), **options)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model.parts if model else None)           # bounded by landmarks and alphabet

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = KernelModel(*shared.value) if shared.value else None
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                texts = part.column(part.num_columns - 1).to_pylist()
                named = [t is not None and any(map(str.isalpha, t)) for t in texts]
                pred, score, margin = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
                if m is not None and any(named):
                    rows = [i for i, ok in enumerate(named) if ok]
                    best, score[rows], margin[rows] = m.score([texts[i] for i in rows])
                    for i, j in zip(rows, best):
                        pred[i] = m.langs[j]
                cols = [part.column(i) for i in range(part.num_columns - 1)]
                seen = pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score), pa.array(margin)], ["lang_pred", "score", "margin"])
                yield pa.RecordBatch.from_arrays([*cols, seen], [*part.schema.names[:-1], keep or "_seen"])

    text = F.col(text_col).cast("string")
    seen_type = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("margin", DoubleType())])
    if keep:
        slim = docs.withColumn(unused("_text_read", docs), text)
        return slim.mapInArrow(run, StructType([*docs.schema.fields, StructField(keep, seen_type)]))
    slim = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    out = slim.mapInArrow(run, StructType([slim.schema["_id"], StructField("_seen", seen_type)]))
    return out.select(F.col("_id").alias(id_col), "_seen.lang_pred", "_seen.score")

