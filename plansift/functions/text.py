"""Text predicates and code forms, in regular expressions that every engine reads alike."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that do not count in descriptions.
STOP_WORDS = (
    "a", "an", "the", "and", "or", "of", "for", "in", "on", "at", "to", "by", "with", "from", "as", "is", "are", "was", "were", "be", "been",
    "not", "no", "all", "any", "each", "other", "such", "than", "that", "this", "its", "per", "new",
)
DRAWING_NUMBER = r"^([A-Z]{1,4})-?([0-9]{1,4})(?:\.([0-9]{1,2}))?$"
#: Disciplines by drawing-number prefix, sheet kinds by the number's first digit.
DISCIPLINES = {
    "T": "Title/Cover", "G": "General", "C": "Civil", "L": "Landscape", "A": "Architectural", "I": "Interior", "ID": "Interior Design",
    "DM": "Demolition", "S": "Structural", "M": "Mechanical", "E": "Electrical", "P": "Plumbing", "FP": "Fire Protection", "FA": "Fire Alarm", "SP": "Sprinkler",
}
SERIES = {
    "0": "General/Cover", "1": "Floor Plan", "2": "Elevation", "3": "Section", "4": "Enlarged Plan",
    "5": "Detail", "6": "Schedule/Diagram", "7": "Diagram", "8": "Detail", "9": "3D/Rendering",
}


#: Letters whose upper case is more than one letter, and the one letter that the surveyed database has for it.
_SEVERAL = [c for c in map(chr, range(0x10000)) if not "\ud800" <= c <= "\udfff" and len(c.upper()) > 1]
UPPER = {c: "\u1e9e" if c == "\u00df" else c.title() if len(c.title()) == 1 else c for c in _SEVERAL}


def upper(text: Column) -> Column:
    """Upper case letter by letter, as the database has it: no letter becomes several (a sharp s its capital, not SS)."""
    own, one = "".join(UPPER), F.upper(text)
    letter = lambda c: F.when(F.instr(F.lit(own), c) > 0, F.translate(c, own, "".join(UPPER.values()))).otherwise(F.upper(c))
    each = F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), letter), "")
    return F.when(F.char_length(one) > F.char_length(text), each).otherwise(one)


def whole_word(text: Column, keyword: str) -> Column:
    """The keyword occurs, in any case, with no ASCII word character beside its word-character ends."""
    left = "(^|[^A-Za-z0-9_])" if re.match(r"\w", keyword, re.A) else ""
    right = "([^A-Za-z0-9_]|$)" if re.search(r"\w$", keyword, re.A) else ""
    return text.rlike(f"(?i){left}{re.escape(keyword)}{right}")


def stem(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def stem_match(a: Column, b: Column) -> Column:
    """Equal stems, or one the start of the other where both have over two characters."""
    a, b = stem(a), stem(b)
    prefix = a.startswith(b) | b.startswith(a)
    return F.when((F.length(a) <= 2) | (F.length(b) <= 2), (a == b) & (a != "")).otherwise(prefix)


def normal_code(code: Column) -> Column:
    """Six digits as three pairs, two digits or one as a division; anything else trimmed."""
    digits = F.regexp_replace(F.trim(code), "[^0-9]", "")
    return (
        F.when(digits == "", F.trim(code))
        .when(F.length(digits) <= 2, F.lpad(digits, 2, "0"))
        .when(F.length(digits) == 6, F.concat_ws(" ", F.substring(digits, 1, 2), F.substring(digits, 3, 2), F.substring(digits, 5, 2)))
        .otherwise(F.trim(code))
    )


def significant(words: Column) -> Column:
    """Words of over two characters that are no stop words."""
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))


def looked_up(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def discipline(prefix: Column) -> Column:
    """By the whole prefix, else by its first two characters, else by its first."""
    return F.coalesce(*(looked_up(DISCIPLINES, p) for p in (prefix, F.substring(prefix, 1, 2), F.substring(prefix, 1, 1))))


def csv_field(text: Column) -> Column:
    """Quoted where it holds a comma, a quote or a line break."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\n\r]'), quoted).otherwise(F.coalesce(text, F.lit("")))
