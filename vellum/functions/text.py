"""Column expressions on lines and titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEADING = r"^#{1,6}[ \t]+[^ \t]"
NUMBER = r"^([0-9]+(?:\.[0-9]+)*)[.、]?[ \t　]+(.*)$"
#: A digit or an ampersand as a character reference: what begins with it is a title, not a number.
LITERAL = r"^&#(38|4[89]|5[0-7]);"
FENCE = r"^ {0,3}(`{3,}|~{3,})"
FIGURE = r"!\[[^\]]*\]\([^)]*\)"
LABEL = r"\{#([a-z]+:[^}]+)\}"
#: References to sections and chapters, as one pattern so that all are rewritten at once.
REFERENCE = r"[0-9]+(?:\.[0-9]+)+ ?节|第 ?[0-9]+ ?章"
COLON = "[：:]"


def heading_level(line: Column) -> Column:
    """1 to 6, or null."""
    return F.when(line.rlike(HEADING), F.length(F.regexp_extract(line, "^(#+)", 1)))


def heading_text(line: Column) -> Column:
    """Title with its number."""
    return F.regexp_replace(F.regexp_replace(line, r"^#+[ \t]+", ""), r"[ \t\r]+$", "")


def number_of(text: Column) -> Column:
    """The section number as a string, or null."""
    found = F.regexp_extract(text, NUMBER, 1)
    return F.when(found != "", found)


def title_of(text: Column) -> Column:
    """Title without its number; a title without one may begin with a character reference (``LITERAL``)."""
    plain = F.concat(F.char(F.regexp_extract(text, LITERAL, 1).try_cast("long")), F.regexp_replace(text, LITERAL, ""))
    return F.when(text.rlike(NUMBER), F.regexp_extract(text, NUMBER, 2)).when(text.rlike(LITERAL), plain).otherwise(text)


def written(num: Column, title: Column) -> Column:
    """Number and title as they stand in a heading; a title without number that would be read as one with is made ``LITERAL``."""
    literal = F.concat(F.lit("&#"), F.ascii(title).cast("string"), F.lit(";"), F.substring(title, 2, 1 << 30))
    return F.concat_ws(" ", num, F.when(num.isNull() & (title.rlike(NUMBER) | title.rlike(LITERAL)), literal).otherwise(title))


def dollars(line: Column) -> Column:
    """How many ``$$`` a line has; runs of three and more are not counted."""
    clean = F.regexp_replace(line, r"\${3,}", "")
    return F.floor((F.length(clean) - F.length(F.replace(clean, F.lit("$$"), F.lit("")))) / 2).cast("long")


def figures(line: Column) -> Column:
    """Number of images."""
    return F.regexp_count(line, F.lit(FIGURE)).cast("long")


def references(line: Column) -> Column:
    """All references of a line as they stand there."""
    return F.regexp_extract_all(line, F.lit(REFERENCE), F.lit(0))


def reference_number(reference: Column) -> Column:
    """The number in a reference."""
    return F.regexp_extract(reference, r"[0-9]+(?:\.[0-9]+)*", 0)


def put_references(line: Column, new: Column) -> Column:
    """``line`` with its references replaced by those of the array ``new``, in order."""
    pairs = F.zip_with(F.split(line, REFERENCE, -1), new, lambda p, r: F.concat(p, F.coalesce(r, F.lit(""))))
    return F.array_join(pairs, "")


def renumber(reference: Column, number: Column) -> Column:
    """The reference with another number."""
    return F.concat(F.regexp_extract(reference, r"^[^0-9]*", 0), number, F.regexp_extract(reference, r"[^0-9.]*$", 0))
