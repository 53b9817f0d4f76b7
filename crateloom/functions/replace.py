"""Find and replace with user terms, as Unicode-aware regular expressions.

A term matches a whole word, a word start, a word end, a part or an exact phrase.  Accents and
letter case are ignored unless asked for; ignoring accents means that every letter of the needle
is a class of itself and its accented forms, so one regular expression does all the matching
inside the JVM.
"""
from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

from crateloom.functions.text import _ACCENTED, _BASE, fold_py, let, strip_accents_py

LETTER = "[\\p{L}\\p{N}]"
_FORMS: dict[str, str] = {}
for _a, _b in zip(_ACCENTED, _BASE):
    _FORMS[_b.lower()] = _FORMS.get(_b.lower(), "") + _a


@dataclass(frozen=True)
class Term:
    needle: str
    mode: str = "word"          # word, prefix, suffix, part

    def __post_init__(self):
        if self.mode not in ("word", "prefix", "suffix", "part"):
            raise ValueError(f"unknown term mode {self.mode}")


@dataclass(frozen=True)
class Rule:
    id: str
    terms: tuple[Term, ...]
    replacement: str
    fields: tuple[str, ...] = field(default=("title",))
    case_sensitive: bool = False
    accent_sensitive: bool = False


def _is_letter(ch: str) -> bool:
    return unicodedata.category(ch)[0] in "LN"


def _needle(term: Term, case_sensitive: bool, accent_sensitive: bool) -> str:
    text = term.needle
    if accent_sensitive:
        body = re.escape(text)
    else:
        text = strip_accents_py(text) if case_sensitive else fold_py(text)
        cells = []
        for ch in text:
            forms = _FORMS.get(ch.lower(), "")
            if case_sensitive:
                forms = "".join(f for f in forms if strip_accents_py(f) == ch)
            cells.append((f"[{re.escape(ch)}{forms}]" if forms else re.escape(ch)) + "[̀-ͯ]*")
        body = "".join(cells)
    if term.mode in ("word", "prefix") and _is_letter(text[0]):
        body = f"(?<!{LETTER})" + body
    if term.mode in ("word", "suffix") and _is_letter(text[-1]):
        body = body + f"(?!{LETTER})"
    return body


def term_pattern(terms: Sequence[Term], case_sensitive: bool = False, accent_sensitive: bool = False) -> str:
    """Longest needle first, so "ft." wins over "ft" at the same place."""
    ordered = sorted((t for t in terms if t.needle), key=lambda t: (-len(t.needle), t.needle))
    flags = "" if case_sensitive else "(?iu)"
    return flags + "(?:" + "|".join(_needle(t, case_sensitive, accent_sensitive) for t in ordered) + ")"


def replace_terms(c: Column, terms: Sequence[Term], replacement: str, case_sensitive: bool = False,
                  accent_sensitive: bool = False) -> Column:
    """Replace every hit.  Punctuation ending the replacement swallows the same character behind
    a hit; an empty replacement also takes one blank where two would meet."""
    if not any(t.needle for t in terms):
        return c
    hit = term_pattern(terms, case_sensitive, accent_sensitive)
    if not replacement:
        return _remove(c, hit)
    tail = replacement[-1]
    if not _is_letter(tail) and tail.strip():
        hit += f"{re.escape(tail)}?"
    quoted = replacement.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(c, hit, quoted)


def _remove(c: Column, hit: str) -> Column:
    flags, body = (hit[:5], hit[5:]) if hit.startswith("(?iu)") else ("", hit)
    return F.regexp_replace(c, f"{flags}(?:(?<![^\\s]){body}\\s|{body})", "")


def has_term(c: Column, rule: Rule) -> Column:
    return c.rlike(term_pattern(rule.terms, rule.case_sensitive, rule.accent_sensitive))


def apply_rule(c: Column, rule: Rule) -> Column:
    """Value after one rule; a result without content is never written."""
    new = F.trim(replace_terms(c, rule.terms, rule.replacement, rule.case_sensitive, rule.accent_sensitive))
    return let(new, lambda n: F.when(n != "", n).otherwise(c))
