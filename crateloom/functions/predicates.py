"""Search predicates: typed terms that become one boolean column.

Terms side by side are ANDed.  Text comparison ignores case and accents through one folded form,
so the filters stay inside generated code.
"""
from __future__ import annotations

import calendar
import datetime as dt
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, functions as F

from crateloom.functions.music import key_letter, key_number, mood_names, normalize_key
from crateloom.functions.text import blank, fold, fold_py

DEFAULT_SCOPE = ("artist", "title", "album", "path")


@dataclass(frozen=True)
class Term:
    field: str                      # column, or "text" for the default scope
    op: str                         # see OPS below
    value: object = None
    negate: bool = False


def text_contains(cols: Sequence[str], word: str) -> Column:
    needle = F.lit(fold_py(word))
    return reduce(lambda a, b: a | b, [fold(F.col(c)).contains(needle) for c in cols])


def phrase(cols: Sequence[str], text: str) -> Column:
    return text_contains(cols, text)


def exact(col: str, value: str) -> Column:
    return fold(F.trim(F.col(col).cast("string"))) == fold_py(value.strip())


def is_empty(col: str, numeric: bool = False) -> Column:
    if numeric:
        return F.coalesce(F.col(col), F.lit(0)) == 0
    return blank(F.col(col).cast("string"))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def negate(condition: Column) -> Column:
    """NOT that keeps rows whose condition is unknown."""
    return ~F.coalesce(condition, F.lit(False))


def _number(text: str) -> float:
    return float(text.strip().replace(",", "."))


def _seconds(text: str) -> float:
    return reduce(lambda total, part: total * 60 + _number(part), text.strip().split(":"), 0.0)


def _range(col: Column, spec: str, parse, unit: float = 0.0) -> Column:
    """Comparison, range or value as plain bounds on the bare column, which the file reader can
    use.  With ``unit`` a value stands for everything up to the next unit."""
    spec = str(spec).strip()
    if spec[:1] in ("<", ">"):
        bound = parse(spec.lstrip("<>=").strip())
        inclusive = "=" in spec[:2]
        if spec[0] == ">":
            return col >= bound if inclusive else (col >= bound + unit if unit else col > bound)
        below = (col < bound + unit if unit else col <= bound) if inclusive else col < bound
        return below & (col > 0)
    m = re.fullmatch(r"([^-]+)-([^-]+)", spec)
    low, high = sorted((parse(m.group(1)), parse(m.group(2)))) if m else (parse(spec), parse(spec))
    if unit:
        return (col >= low) & (col < high + unit)
    return col.between(low, high) if m else col == low


def num_cmp(col: str, spec: str) -> Column:
    """``>128``, ``<90``, ``124-128`` or a value; 0 and null mean missing and match no ``<``."""
    return _range(F.col(col), spec, _number)


def duration_cmp(col: str, spec: str) -> Column:
    """As num_cmp with ``m:ss``, in whole seconds."""
    return _range(F.col(col), spec, _seconds, unit=1.0)


def _epoch(day: dt.date) -> int:
    return calendar.timegm(day.timetuple())


def added_cmp(col: str, spec: str, now: dt.date) -> Column:
    """Added time (epoch seconds, UTC days) against a day, a month, a year, ``>``/``<`` of one, or
    ``30d`` (within)."""
    c, spec = F.col(col), spec.strip()
    m = re.fullmatch(r"(\d+)\s*d", spec)
    if m:
        return (c > 0) & (c >= _epoch(now - dt.timedelta(days=int(m.group(1)))))
    sign, text = (spec[:1], spec.lstrip("<>")) if spec[:1] in ("<", ">") else ("", spec)
    parts = [int(x) for x in text.split("-")]
    first = dt.date(parts[0], parts[1] if len(parts) > 1 else 1, parts[2] if len(parts) > 2 else 1)
    if len(parts) == 1:
        after = dt.date(parts[0] + 1, 1, 1)
    elif len(parts) == 2:
        after = (first.replace(day=28) + dt.timedelta(days=4)).replace(day=1)
    else:
        after = first + dt.timedelta(days=1)
    if sign == ">":
        return (c > 0) & (c >= _epoch(first))
    if sign == "<":
        return (c > 0) & (c < _epoch(first))
    return (c > 0) & (c >= _epoch(first)) & (c < _epoch(after))


def key_match(col: str, value: str) -> Column:
    """Any notation; a bare number matches both modes of that position."""
    if re.fullmatch(r"\d{1,2}", value.strip()):
        return key_number(F.col(col)) == int(value)
    wanted = normalize_key(F.lit(value))
    return (key_number(F.col(col)) == key_number(wanted)) & (key_letter(F.col(col)) == key_letter(wanted))


def status(col: str, value: str) -> Column:
    return F.lower(F.col(col)).startswith(value.strip().lower())


def flag(col: str, wanted: bool = True) -> Column:
    return F.coalesce(F.col(col).cast("boolean"), F.lit(False)) == wanted


def _octets(c: Column) -> Column:
    """A character per UTF-8 byte."""
    return F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")


def fuzzy_word(col: str, word: str, tolerance: float = 0.8, least_letters: int = 4, octets: bool = False) -> Column:
    """Some word within the allowed edits (a quarter of the length times the tolerance, none below
    ``least_letters``), or the word as a part of the text.  With ``octets`` UTF-8 bytes are edited, not characters:
    another letter outside ASCII is then two edits or more."""
    needle = fold_py(word)
    k = int(len(needle) * tolerance / 4) if len(needle) >= least_letters else 0
    text = fold(F.col(col))
    whole = text.contains(needle)
    if k == 0:
        return whole
    words = F.split(text, "[^\\p{L}\\p{N}]+")
    unit = _octets if octets else (lambda c: c)
    return whole | F.exists(words, lambda w: F.levenshtein(unit(w), unit(F.lit(needle)), k) >= 0)


def has_hot_cue(edits: Column, snapshot: Column, live: Column) -> Column:
    """Edited cues decide when present (even without a hot one), then the snapshot, then live."""
    def hot(cues):
        return F.exists(cues, lambda c: c["kind"] == "hot")
    return F.coalesce(hot(edits), hot(snapshot), hot(live), F.lit(False))


def has_mood_or_tag(moods: Column, tags: Column, value: str) -> Column:
    names = F.array_union(mood_names(moods), F.coalesce(tags, F.array().cast("array<string>")))
    return F.exists(names, lambda n: F.lower(n) == value.strip().lower())


def starts_with(col: str, v: str) -> Column:
    return fold(F.col(col)).startswith(fold_py(v))


def ends_with(col: str, v: str) -> Column:
    return fold(F.col(col)).endswith(fold_py(v))


def _in_last(col: str, days, now) -> Column:
    return F.col(col) >= _epoch(now) - int(days) * 86400


OPS = ("contains", "phrase", "is", "starts", "ends", "empty", "eq", "at_least", "at_most", "gt", "lt", "cmp", "duration",
       "added", "key", "status", "flag", "fuzzy", "has", "in_last_days", "before_days", "after_days")


def term_column(term: Term, now: dt.date | None = None) -> Column:
    cols = DEFAULT_SCOPE if term.field == "text" else (term.field,)
    f, v = cols[0], term.value
    table = {
        "contains": lambda: text_contains(cols, v), "phrase": lambda: phrase(cols, v), "is": lambda: exact(f, v),
        "starts": lambda: starts_with(f, v), "ends": lambda: ends_with(f, v), "empty": lambda: is_empty(f, bool(v)),
        "eq": lambda: F.col(f) == v, "at_least": lambda: F.col(f) >= v, "at_most": lambda: F.col(f) <= v,
        "gt": lambda: F.col(f) > v, "lt": lambda: F.col(f) < v, "cmp": lambda: num_cmp(f, v),
        "duration": lambda: duration_cmp(f, v), "added": lambda: added_cmp(f, v, now), "key": lambda: key_match(f, v),
        "status": lambda: status(f, v), "flag": lambda: flag(f), "fuzzy": lambda: any_of([fuzzy_word(c, v) for c in cols]),
        "has": lambda: F.array_contains(F.col(f), v), "in_last_days": lambda: _in_last(f, v, now),
        "after_days": lambda: F.col(f) > _epoch(now) - int(v) * 86400,
        "before_days": lambda: (F.col(f) > 0) & negate(_in_last(f, v, now))}
    cond = table[term.op]()
    # a filter drops unknowns by itself; wrapping them would hide the bounds from the file reader
    return negate(cond) if term.negate else cond
