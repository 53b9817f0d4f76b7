"""Text folding and path helpers."""
from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def _accent_table() -> tuple[str, str]:
    """Latin letters whose canonical decomposition is a base letter plus marks."""
    src, dst = [], []
    for cp in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        parts = unicodedata.normalize("NFD", chr(cp))
        if len(parts) > 1 and all(unicodedata.combining(c) for c in parts[1:]):
            src.append(chr(cp))
            dst.append(parts[0])
    return "".join(src), "".join(dst)


_ACCENTED, _BASE = _accent_table()


def let(value: Column, body) -> Column:
    """Use ``value`` several times in ``body`` without repeating its expression.

    Chains of rules would otherwise double in size with every step that mentions its input
    twice; the lambda variable keeps them linear, also when the optimizer inlines them."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip_accents(c: Column) -> Column:
    """Drop accents; letters without a decomposition (ß ø æ ł) stay as they are."""
    return F.regexp_replace(F.translate(c, _ACCENTED, _BASE), "[\\u0300-\\u036F]", "")


def strip_accents_py(s: str) -> str:
    return "".join(ch for ch in unicodedata.normalize("NFD", s) if not 0x300 <= ord(ch) <= 0x36F)


def fold(c: Column) -> Column:
    """Case- and accent-insensitive form used by search and matching."""
    return strip_accents(F.lower(F.coalesce(c, F.lit(""))))


def fold_py(s: str) -> str:
    return strip_accents_py(s.lower())


def normalizer(form: str):
    """Arrow UDF for a Unicode normal form; Spark has no built-in for it."""
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else unicodedata.normalize(form, v))
    return run


def _only_non_ascii(c: Column) -> Column:
    """Python functions run on every row of a batch whatever the condition around them, so plain
    ASCII values are sent as nulls, which cost next to nothing."""
    return F.when(c.rlike("[^\\x00-\\x7F]"), c)


def nfc(c: Column) -> Column:
    return F.coalesce(normalizer("NFC")(_only_non_ascii(c)), c)


def nfd(c: Column) -> Column:
    return F.coalesce(normalizer("NFD")(_only_non_ascii(c)), c)


def norm_key(c: Column) -> Column:
    """Same path apart from case and Unicode form (NFC + case folding)."""
    @F.pandas_udf(T.StringType())
    def casefolded(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else unicodedata.normalize("NFC", v).casefold())
    return F.coalesce(casefolded(_only_non_ascii(c)), F.lower(c))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case extension without the dot, '' if there is none (dot files have none)."""
    return F.lower(F.regexp_extract(basename(path), "^.+\\.([^.]*)$", 1))


def stem(path: Column) -> Column:
    base = basename(path)
    return F.regexp_replace(base, "(?<=.)\\.[^.]+$", "")


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def collapse(c: Column) -> Column:
    """Lower case, blanks collapsed and trimmed; null becomes ''."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "\\s+", " "))
