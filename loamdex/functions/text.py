"""Scalar text functions as column expressions; white space is Unicode's in all of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PUNCTUATION = r"[!-/:-@\[-`{-~]"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    return trimmed(c) == ""


def words(c: Column) -> Column:
    """Words between white space."""
    return F.regexp_extract_all(c, F.lit(r"(?U)(\S+)"), 1)


def estimated_tokens(c: Column) -> Column:
    """Words divided by 0.75 plus a tenth of the ASCII punctuation, rounded down; in integers: (40 w + 3 p) div 30."""
    w = F.regexp_count(c, F.lit(r"(?U)\S+")).cast("long")
    p = F.regexp_count(c, F.lit(_PUNCTUATION)).cast("long")
    return F.floor((40 * w + 3 * p) / 30).cast("long")


def has_code(c: Column) -> Column:
    """A fence, or a line that starts with four blanks."""
    return c.contains("```") | c.rlike("(?m)^ {4}")


def overlap_tail(c: Column, tokens: int) -> Column:
    """The last words that ``tokens`` stand for (three quarters of them), or nothing if that would be all."""
    n = int(tokens * 0.75)
    w = words(c)
    return F.when((F.size(w) > n) & F.lit(n > 0), F.array_join(F.slice(w, -max(n, 1), max(n, 1)), " ")).otherwise("")


def heading_path(stack: Column) -> Column:
    """Titles of the open headings, ``Content`` where there are none."""
    return F.when(F.size(stack) > 0, F.array_join(stack, " > ")).otherwise("Content")


def display(code: Column) -> Column:
    """A status code as a label."""
    return F.initcap(code)


def iso_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def plain_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def seconds_between(earlier: Column, later: Column) -> Column:
    """Whole seconds."""
    return F.floor((F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1_000_000).cast("long")


def percent(done: Column, total: Column) -> Column:
    """Rounded down from a quotient of doubles; 0 of nothing."""
    return F.when(total > 0, ((done / total) * F.lit(100.0)).cast("long")).otherwise(F.lit(0).cast("long"))


def code_language(css_class: Column) -> Column:
    """What follows ``language-`` in a class attribute."""
    return F.regexp_extract(css_class, r"language-(\S+)", 1)


def clean_attribute(c: Column) -> Column:
    """Line breaks with the blanks after them as one line break; the pattern is a fixed value."""
    return F.regexp_replace(c, r"(\n+\s*)+", "\n")


def retryable(message: Column) -> Column:
    """Whether an error may pass: timeouts, connections, the network, server errors and throttling."""
    m = F.lower(message)
    return F.coalesce(m.contains("timeout") | m.contains("connection") | m.contains("network") | m.contains("http error 5") | m.contains("http error 429"), F.lit(False))


def valid_identifier(c: Column) -> Column:
    """Not blank, and above 0 if it is a number."""
    t = trimmed(c)
    return F.coalesce((t != "") & ~(t.rlike("^-?[0-9]+$") & ~(t.try_cast("decimal(38,0)") > 0)), F.lit(False))


def valid_name(c: Column, most_bytes: int = 100) -> Column:
    """Not blank, at most so many bytes, in one line."""
    return F.coalesce(~is_blank(c) & (F.octet_length(c) <= most_bytes) & ~c.rlike(r"[\n\r\t]"), F.lit(False))


def valid_version(c: Column) -> Column:
    return valid_name(c, 40)


def pretty_json(row: Column) -> Column:
    return F.to_json(row, {"pretty": "true"})
