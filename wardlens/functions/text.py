"""Text tests and case rules. All stay inside generated code; none is a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A new word starts after anything that is no letter, digit, accent mark or
# underscore; dots, colons and apostrophes between letters join a word.
_WORD_BREAK = r"[^\p{L}\p{N}\p{M}_'’.:·]|(?<!\p{L})['’.:·]"

# A new sentence starts at the first letter or digit, after ! or ? with blanks,
# after a full stop with blanks unless a small letter follows, and on a new line.
_SENTENCE_BREAK = (
    r"^[^\p{L}\p{N}]+|[!?…][\"'»)\]]*\u0002+|\.[\"'»)\]]*\u0002+(?!\p{Ll})|[\r\n]+"
)

_BLANK = "\u0002"  # stands for a blank while the only blanks left mark the breaks


def _capitalise_after(c: Column, breaks: str) -> Column:
    held = F.translate(c, " ", _BLANK)
    marked = F.regexp_replace(held, breaks, "$0 ")
    cased = F.initcap(marked)
    return F.translate(F.replace(cased, F.lit(" "), F.lit("")), _BLANK, " ")


def title_case(c: Column) -> Column:
    """Capital at each word start, small letters elsewhere: ``Contacto/Gotas Y Aéreo``."""
    return _capitalise_after(c, _WORD_BREAK)


def sentence_case(c: Column) -> Column:
    """Capital at each sentence start, small letters elsewhere."""
    return _capitalise_after(c, _SENTENCE_BREAK)


def detect(c: Column, pattern: str, negate: bool = False) -> Column:
    """Regex search whose result is null for a null text, so a filter drops it."""
    found = c.rlike(pattern)
    return ~found if negate else found


def contains_pattern(c: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Regex search that is false for a null text, so its negation keeps the row."""
    text = F.lower(c) if ignore_case else c
    return F.coalesce(text.rlike(pattern), F.lit(False))


def contains_text(c: Column, text: str) -> Column:
    """Search for a literal text that is false for a null text."""
    return F.coalesce(c.contains(text), F.lit(False))


def starts_with_pattern(c: Column, pattern: str) -> Column:
    return c.rlike(f"^(?:{pattern})")


def ends_with(c: Column, text: str) -> Column:
    return c.endswith(text)


def first_digit(c: Column) -> Column:
    """First digit in the text; null (not an empty string) when it has none."""
    return F.nullif(F.regexp_extract(c, r"\d", 0), F.lit(""))


def last_character(c: Column) -> Column:
    return F.right(c, F.lit(1))


def replace_all(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def paste(*cols: Column, sep: str = " ") -> Column:
    """Join with a separator; a null part prints as ``NA``."""
    parts = [F.coalesce(c.cast("string"), F.lit("NA")) for c in cols]
    return F.concat_ws(sep, *parts)


def paste_tight(*cols: Column) -> Column:
    return paste(*cols, sep="")


def in_locale(col: Column, locale: str = "es") -> Column:
    """A text that sorts, groups and compares as readers of a language expect: accents after the bare letter,
    ñ after n, small letters before capitals."""
    return F.collate(col, locale)
