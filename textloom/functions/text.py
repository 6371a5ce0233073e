"""Text cleaning as column expressions; everything stays inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# white space as Python's str.split sees it
BLANK = r"[\s\x1c-\x1f\x85\xa0\p{Z}]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
MAX_BODY_TOKENS = 300
MIN_TOKENS = 20


def split_lines(text: Column) -> Column:
    """Lines at every Unicode break; the empty piece after a closing break is dropped, once."""
    lines = F.split(text, LINE_BREAK)
    last = F.element_at(lines, -1)
    return F.when(last == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def first_index(lines: Column, pattern: str) -> Column:
    """Position from 0 of the first line that matches, null if none."""
    at = F.transform(lines, lambda x, i: F.when(x.rlike(pattern), i))
    return F.get(F.filter(at, lambda i: i.isNotNull()), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return strip(F.regexp_replace(text, f"{BLANK}+", " "))


def subject(text: Column) -> Column:
    """The first ``Subject:`` line anywhere, less one reply or forward prefix; '' if there is none."""
    lines = split_lines(text)
    line = F.get(F.filter(lines, lambda x: x.rlike(rf"(?i)^Subject:{BLANK}*.+")), F.lit(0))
    value = strip(F.regexp_extract(line, rf"(?i)^Subject:{BLANK}*(.+)", 1))
    return F.coalesce(strip(F.regexp_replace(value, rf"(?i)^(Re|Fwd|Fw):{BLANK}*", "")), F.lit(""))


def body(text: Column) -> Column:
    """What follows the header block, up to a signature or armour mark, without quoted lines.

    A text without a blank line is all header: its body is ''.
    """
    lines = split_lines(text)
    blank = first_index(lines, f"^{BLANK}*$")
    rest = F.when(blank.isNull(), F.array().cast("array<string>")).otherwise(F.slice(lines, blank + 2, F.size(lines)))
    stop = first_index(rest, rf"^--{BLANK}*$|^-{{5}}BEGIN PGP")
    kept = F.when(stop.isNull(), rest).otherwise(F.slice(rest, F.lit(1), stop))
    return collapse(F.array_join(F.filter(kept, lambda x: ~x.rlike(f"^{BLANK}*>")), " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, f"{BLANK}+"), lambda x: x != "")


def first_tokens(text: Column, n: int) -> Column:
    return F.array_join(F.slice(tokens(text), 1, n), " ")


def clean_post(text: Column, most: int = MAX_BODY_TOKENS) -> Column:
    """Subject and the first ``most`` tokens of the body as one line. Null text: null."""
    head, rest = subject(text), first_tokens(body(text), most)
    joined = F.when(head != "", strip(F.concat(head, F.lit(". "), rest))).otherwise(rest)
    return F.when(text.isNotNull(), joined)


def is_meaningful(clean: Column, least: int = MIN_TOKENS) -> Column:
    return F.size(tokens(clean)) >= least


def content_id(raw: Column) -> Column:
    """Twelve hex digits of the raw text's MD5: the same for identical texts."""
    return F.substring(F.md5(raw), 1, 12)


def prefix(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def score_bar(value: Column, cells: int = 20) -> Column:
    """A text bar of a score in [0, 1]; 'n/a' where it is missing."""
    full = F.floor(value * cells).cast("int")
    return F.when(value.isNull() | F.isnan(value), "n/a").otherwise(F.concat(F.repeat(F.lit("#"), full), F.repeat(F.lit("."), F.lit(cells) - full)))
