r"""Text normalisation as native column expressions.

White space is Unicode white space throughout: Spark's ``trim`` strips U+0020 only and Java's ``\s`` is ASCII
without ``(?U)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 4
TRIM_AT = 100_000
# Titles and suffixes dropped from names, generic words dropped from places.
TITLES = "Mr|Mrs|Miss|Ms|Dr|Rev|Sir|Lady|Lord|Captain|Col|Major|Gen"
SUFFIXES = "Jr|Sr|III|IV|Esq"
PLACE_WORDS = "County|Parish|Plantation|Estate|Town|City"
SPECIAL_FILE = "920_ROS1_(unformatted)"


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def visible(c: Column) -> Column:
    """Whether a text begins and ends with visible ASCII characters, so that there is nothing to strip. Cheap, for columns that are at hand."""
    low, high, raw = F.lit(b"!"), F.lit(b"~"), c.cast("binary")  # by bytes, as characters would be counted through
    return F.substring(raw, 1, 1).between(low, high) & F.substring(raw, -1, 1).between(low, high)


def strip_at_hand(c: Column) -> Column:
    """strip() of a column that costs nothing to read twice; the pattern runs only where there may be white space."""
    return F.when(visible(c), c).otherwise(strip(c))


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def newlines(c: Column) -> Column:
    """All line ends as a line feed."""
    return F.regexp_replace(c, "\r\n?", "\n")


def token_estimate(c: Column) -> Column:
    """A token for every four characters."""
    return F.floor(F.length(c) / CHARS_PER_TOKEN).cast("int")


def flatten_special(c: Column, is_special: Column) -> Column:
    """For special files: non-ASCII runs, then line breaks, then white space become one blank each."""
    flat = F.regexp_replace(c, r"[^\x00-\x7F]+", " ")
    flat = F.regexp_replace(F.regexp_replace(flat, r"[\r\n]+", " "), r"(?U)\s+", " ")
    return F.when(is_special, flat).otherwise(c)


def is_special(name: Column) -> Column:
    """Whether a file's name marks it as one that models stumble over."""
    return F.coalesce(F.contains(name, F.lit(SPECIAL_FILE)), F.lit(False))


def trim_long(c: Column, most: int = TRIM_AT) -> Column:
    """At most so many characters."""
    return F.substring(c, 1, most)


def prompt(chunk: Column, number: Column, total: Column, name: Column) -> Column:
    """A chunk behind the header that tells the model where it stands; chunks count from 1."""
    return F.concat(F.format_string("[Processing chunk %d of %d from %s]\n\n", number, total, name), chunk)


def stem(name: Column) -> Column:
    """A file name without its last suffix."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def eval_key(c: Column) -> Column:
    """Lower case, stripped of what Python takes for white space; null is empty. Inner white space stays."""
    low = F.lower(c.cast("string"))
    return F.when(visible(c.cast("string")), low).otherwise(F.coalesce(F.regexp_replace(low, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""), F.lit("")))


def clean_name(c: Column) -> Column:
    """A name without titles (their period is required), suffixes and bracketed parts."""
    for pattern in (rf"(?iU)\b({TITLES})\.\s*", rf"(?iU)\b({SUFFIXES})\b", r"\([^)]*\)"):
        c = F.regexp_replace(c, pattern, "")
    return collapse(c)


def normal_place(c: Column) -> Column:
    """A place without generic words, lower case. May be empty."""
    return F.lower(collapse(F.regexp_replace(c, rf"(?iU)\b({PLACE_WORDS})\b", "")))


def html_escape(c: Column) -> Column:
    """The five characters that mean something in HTML, ampersand first."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def tokens(c: Column) -> Column:
    """White-space separated tokens; none for a blank text."""
    s = strip(c)
    return F.when(F.length(s) > 0, F.split(s, r"(?U)\s+")).otherwise(F.array().cast("array<string>"))


def rfind(text: Column, needle: str) -> Column:
    """Zero-based position of the last occurrence, -1 if none."""
    at = F.locate(needle[::-1], F.reverse(text))
    return F.when(at == 0, -1).otherwise(F.length(text) - at - len(needle) + 1)
