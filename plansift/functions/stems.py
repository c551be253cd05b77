"""English word stems (Porter's algorithm of 1980), from one list of rules: as a column, as SQL and for one word.

A step is a list of (suffix, pattern, replacement).  The first suffix that a word ends in decides; where its pattern does
not hold, the step leaves the word alone.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The stop words of the usual English list.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs "
    "themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or "
    "because as until while of at by for with about against between into through during before after above below to from up down in out on off over under "
    "again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t "
    "can will just don should now"
).split()

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_M1 = f"(?:{_C})?{_V}{_C}"  # at least one change from vowels to consonants
_M2 = _M1 + _V + _C
_VOWEL = f"(?:{_C})?[aeiouy].*"
_SHORT = "[aeiouy][^aeiouwxy]"  # a vowel and a consonant other than w, x, y

#: Suffixes and what stands for them, of the algorithm's steps 2 to 4.
STEP2 = (
    "ational ate, tional tion, enci ence, anci ance, izer ize, bli ble, alli al, entli ent, eli e, ousli ous, ization ize, ation ate, ator ate, alism al, "
    "iveness ive, fulness ful, ousness ous, aliti al, iviti ive, biliti ble, logi log"
)
STEP3 = "icate ic, ative , alize al, iciti ic, ical ic, ful , ness "
STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize"


def _table(text: str) -> list[tuple[str, str, str]]:
    pairs = [p.split(" ") for p in text.split(", ")]
    return [(s, rf"^({_M1}.*){s}$", rf"\1{r}") for s, r in pairs]


def _steps() -> list[list[tuple[str, str, str]]]:
    doubles = [(f"{c}{c}~", f"{c}{c}~$", c) for c in "bcdfghjkmnpqrtvwx"]
    return [
        [("sses", "sses$", "ss"), ("ies", "ies$", "i"), ("ss", "ss$", "ss"), ("s", "^(.+)s$", r"\1")],
        [("eed", rf"^({_M1}.*)eed$", r"\1ee"), ("ed", rf"^({_VOWEL})ed$", r"\1~"), ("ing", rf"^({_VOWEL})ing$", r"\1~")],
        [("at~", "at~$", "ate"), ("bl~", "bl~$", "ble"), ("iz~", "iz~$", "ize"), *doubles, ("~", rf"^({_C}{_SHORT})~$", r"\1e")],
        [("~", "~$", "")],
        [("y", rf"^({_VOWEL})y$", r"\1i")],
        _table(STEP2),
        _table(STEP3),
        [*((s, rf"^({_M2}.*){s}$", r"\1") for s in STEP4.split()), ("ion", rf"^({_M2}.*[st]|{_M1}{_V}[st])ion$", r"\1")],
        # with one change only where the end is not short
        [("e", rf"^({_M2}.*|{_M1}{_V}|(?:{_C})?{_V}[^aeiou][^aeiouy]+|(?:{_C})?{_V}[wxy]|(?:{_C})?[aeiouy][aeiou]+[^aeiou]|[aeiouy][aeiou]*{_C})e$", r"\1")],
        [("ll", rf"^({_M1}{_V}l|{_M2}.*l)l$", r"\1")],
    ]


STEPS = [sorted(s, key=lambda r: -len(r[0])) for s in _steps()]
_STOP, _ENDS = frozenset(STOP_WORDS), [tuple(r[0] for r in s) for s in STEPS]


def clean(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), "[^a-z0-9]+", "")


def stems(words: Column) -> Column:
    """The stem of each word of an array, empty for stop words and words without letters or digits."""
    out = F.transform(F.transform(words, clean), lambda w: F.when(w.isin(*STOP_WORDS), "").otherwise(w))
    for step in STEPS:
        out = F.transform(out, lambda w: _applied(w, step))  # noqa: B023
    return out


def _applied(w: Column, step: list[tuple[str, str, str]]) -> Column:
    cases = None
    for suffix, pattern, new in step:
        hit = (F.length(w) > 2) & w.endswith(suffix)
        value = F.regexp_replace(w, pattern, new.replace("\\1", "$1"))
        cases = F.when(hit, value) if cases is None else cases.when(hit, value)
    return cases.otherwise(w)


def stems_sql(words: str) -> str:
    """DuckDB SQL for `stems`."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    out = f"list_transform(list_transform({words}, lambda w: regexp_replace(lower(w), '[^a-z0-9]+', '', 'g')), lambda w: CASE WHEN w IN ({stop}) THEN '' ELSE w END)"
    for step in STEPS:
        cases = " ".join(f"WHEN len(w) > 2 AND suffix(w, '{s}') THEN regexp_replace(w, '{p}', '{n}')" for s, p, n in step)
        out = f"list_transform({out}, lambda w: CASE {cases} ELSE w END)"
    return out


def stem(word: str) -> str:
    """The stem of one word, as of a query."""
    w = re.sub("[^a-z0-9]+", "", word.lower())
    if w in _STOP:
        return ""
    for step, ends in zip(STEPS, _ENDS, strict=True):
        if len(w) > 2 and w.endswith(ends):
            hit = next(r for r in step if w.endswith(r[0]))
            w = re.sub(hit[1], hit[2], w, count=1)
    return w
