"""Text expressions that keep the audit's notion of white space and words."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space; Java's and Python's own classes differ from it and from each other.
SPACE = "\\t\\n\\x0b\\f\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPACES = "\t\n\x0b\f\r \x85\xa0                　"
_WORDS = re.compile(f"[^{SPACE}]+")
_JAVA_WORD = f"[^{SPACE}]+"
#: Word borders by ASCII, as the reports define them; Java's ``\b`` follows Unicode.
B = "(?<![A-Za-z0-9_])"
E = "(?![A-Za-z0-9_])"


def fields(text: str) -> list[str]:
    return _WORDS.findall(text)


def collapse_py(text: str) -> str:
    return " ".join(fields(text))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(_JAVA_WORD), F.lit(0))


def word_count(c: Column) -> Column:
    return F.coalesce(F.size(words(c)), F.lit(0)).cast("long")


def collapse(c: Column) -> Column:
    return F.array_join(words(c), " ")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def redact(c: Column) -> Column:
    """The first and last two characters; short values vanish."""
    n = F.char_length(c)
    return F.when(n <= 4, "****").otherwise(F.concat(F.substring(c, 1, 2), F.repeat(F.lit("*"), n - 4), F.right(c, F.lit(2))))


def half_away(c: Column, digits: int) -> Column:
    """Rounds the scaled double, not its decimal expansion."""
    return F.floor(c * 10**digits + 0.5) / float(10**digits)


#: Words that carry no campaign meaning.
STOPWORDS = ["the", "and", "for", "with", "you", "your", "are", "our", "from", "this", "that", "all", "een", "van", "het", "met", "voor", "del"]


def tokens(c: Column) -> Column:
    """Distinct lower-case tokens of three bytes or more, in order."""
    parts = F.split(F.lower(c), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(parts, lambda t: (F.octet_length(t) >= 3) & ~t.isin(STOPWORDS)))


#: Words that open a question.
INTERROGATIVES = [
    "how", "what", "why", "when", "where", "who", "which", "can", "do", "does", "is", "are", "should", "will", "could", "would", "did",
]


def is_question(c: Column) -> Column:
    first = F.btrim(F.get(words(F.lower(c)), 0), F.lit(",.:;\"'"))
    return F.coalesce(F.endswith(strip(c), F.lit("?")) | first.isin(INTERROGATIVES), F.lit(False))
