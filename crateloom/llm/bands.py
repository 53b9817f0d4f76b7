"""Quality rule by compression bands: how well a text compresses, held against limits for its length.

The zstandard ratio (compressed / plain bytes) of the whole text and of each fixed chunk of it is compared
with the band of its length: below the lower limit the text repeats itself, above the upper limit it is noise.  Short
texts compress badly by nature, so the limits are given per length; between two given lengths they are
interpolated over the logarithm of the length.  A text is rejected when its whole ratio is outside its band or when more
than ``bad_share`` of its chunks are outside theirs.  :func:`fit_bands` takes the limits from texts labelled good: for each power of two of
the length the ``share`` and 1 - ``share`` quantiles of their ratios with a margin.  It takes every text
that is labelled so; lengths with fewer than ``least`` of them keep the wide limits of ``BANDS``.

Before the bands, the base rules count words, symbols, repeated lines and words in repeated 5-word windows.

Defined results: null texts count as having no words (all counts 0, base_failed); the last piece of a text is a
chunk only from half a chunk on; texts of any length are taken whole; repeated rows get equal results, so ties need no rule; an empty table
gives no rows, and without labels the limits are ``BANDS``.  Only the id and the text are read, other columns may have any name.
"""
from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import zstandard
from pyspark.sql import DataFrame, functions as F

from crateloom.llm.common import per_batch
from crateloom.operators.ordering import exact_percentiles
from crateloom.session import cut

#: (bytes, least ratio, most ratio) where no labels tell more; the ratio of ordinary prose falls with the length.
BANDS = ((64, 0.42, 1.16), (128, 0.36, 1.04), (256, 0.30, 0.92), (512, 0.26, 0.84), (1024, 0.23, 0.76), (2048, 0.20, 0.70),
         (4096, 0.18, 0.66), (8192, 0.17, 0.63), (16384, 0.16, 0.61), (65536, 0.14, 0.60))
SYMBOLS = b"[#*$%&|<>]"


def limits(n: int, bands=BANDS) -> tuple[float, float]:
    if n <= bands[0][0]:
        return 0.0, math.inf                    # too short to tell
    for (a, lo, hi), (b, lo2, hi2) in zip(bands, bands[1:]):
        if n <= b:
            x = math.log(n / a) / math.log(b / a)
            return lo + x * (lo2 - lo), hi + x * (hi2 - hi)
    return bands[-1][1:]


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of ``width`` words found twice or more in the list."""
    if len(words) <= width:
        return 0
    windows = list(zip(*(words[i:] for i in range(width))))
    count = Counter(windows)
    if len(count) == len(windows):
        return 0
    hit = np.fromiter((count[w] > 1 for w in windows), bool, len(windows))
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def base_counts(data: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = data.split()                         # splits on exactly the white space of the word rule
    raw = np.frombuffer(b"".join(words), np.uint8)
    chars = int(((raw & 0xC0) != 0x80).sum())
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(words), chars, len(re.findall(SYMBOLS, data)), len(lines) - len(set(lines)), repeated_words(words)


def band_verdict(data: bytes, pack: zstandard.ZstdCompressor, chunk: int, bad_share: float, bands=BANDS) -> tuple[float, int, int, str]:
    """Whole ratio, chunks, chunks outside their band, verdict (``ok``, ``repetitive``, ``incompressible``)."""
    if not data:
        return 0.0, 0, 0, "ok"

    def place(part: bytes) -> tuple[float, int]:
        ratio = len(pack.compress(part)) / len(part)
        low, high = limits(len(part), bands)
        return ratio, -1 if ratio < low else int(ratio > high)

    ratio, side = place(data)
    sides = [place(part)[1] for i in range(0, len(data), chunk) if len(part := data[i:i + chunk]) * 2 >= chunk] if len(data) > chunk else []
    bad = sum(s != 0 for s in sides)
    if not side and sides and bad > bad_share * len(sides):
        side = 1 if sum(s > 0 for s in sides) * 2 > bad else -1
    return ratio, len(sides), bad, ("repetitive", "ok", "incompressible")[side + 1]


def fit_bands(docs: DataFrame, good: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: int = 3, share: float = 0.005,
              margins: tuple[float, float] = (0.004, 0.03), least: int = 40) -> tuple[tuple[float, float, float], ...]:
    """Limits per length from all documents whose ids are in ``good`` and which pass the base rules.

    Texts are measured where they lie; only ids, lengths and ratios are joined with the labels and put in order.
    """
    ids = good.select(F.col(id_col).cast("long").alias("_id")).where("_id is not null").distinct()
    slim = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("binary").alias("_text"))

    def measure(cols: dict[str, list], pack: zstandard.ZstdCompressor) -> dict[str, object]:
        rows = [(i, t) for i, t in zip(cols["_id"], cols["_text"]) if i is not None and t and len(t) >= 256 and not failed(base_counts(t))]
        return {"_id": [i for i, _ in rows], "n": [len(t) for _, t in rows], "ratio": [len(pack.compress(t)) / len(t) for _, t in rows]}

    seen = per_batch(slim, measure, "_id bigint, n bigint, ratio double", setup=lambda: zstandard.ZstdCompressor(level=level))
    seen = cut(seen.join(ids, "_id", "left_semi").select("_id", F.floor(F.log2("n")).cast("int").alias("power"), "ratio"))
    enough = seen.groupBy("power").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    rows = exact_percentiles(seen, ["power"], "ratio", {"low": share, "high": 1 - share}).join(enough, "power").select("power", F.array("low", "high").alias("q")).collect()
    found = {r["power"]: r["q"] for r in rows}
    if not found:
        return BANDS
    points = [b for b in BANDS if b[0] < 2 ** min(found)]
    for power in range(min(found), max(found) + 1):
        middle = 2 ** (power + 0.5)
        points.append((middle, found[power][0] - margins[0], found[power][1] + margins[1]) if power in found else (middle, *limits(middle)))
    return tuple(points + [b for b in BANDS if b[0] >= 2 ** (max(found) + 1)])


def failed(counts: tuple[int, ...]) -> bool:
    """The base rule on counts as :func:`base_counts` gives them."""
    return counts[0] < 10 or 100 * counts[4] > 20 * counts[0]


def compression_bands(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: int = 3, chunk: int = 4096,
                      bad_share: float = 0.34, bands=BANDS) -> DataFrame:
    """One row a document: the base counts, base_failed, kept, ratio, n_chunks, n_bad_chunks, verdict."""
    def work(cols: dict[str, list], pack: zstandard.ZstdCompressor) -> dict[str, object]:
        texts = [t or b"" for t in cols["_text"]]
        counts = [base_counts(t) for t in texts]
        seen = [band_verdict(t, pack, chunk, bad_share, bands) for t in texts]
        bad = [failed(c) for c in counts]
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        return {id_col: cols["_id"], **{n: [c[i] for c in counts] for i, n in enumerate(names)}, "base_failed": bad,
                "kept": [not f and s[3] == "ok" for f, s in zip(bad, seen)], "ratio": [s[0] for s in seen],
                "n_chunks": [s[1] for s in seen], "n_bad_chunks": [s[2] for s in seen], "verdict": [s[3] for s in seen]}

    slim = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    return per_batch(slim, work, f"{id_col} bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
                     "n_repeat_words bigint, base_failed boolean, kept boolean, ratio double, n_chunks bigint, n_bad_chunks bigint, verdict string",
                     setup=lambda: zstandard.ZstdCompressor(level=level))
