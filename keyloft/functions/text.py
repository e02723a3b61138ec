"""ASCII text helpers as column expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column, functions as F

#: What C's ``isspace`` takes for white space.
SPACE = " \t\n\x0b\f\r"
SPACE_CLASS = r"[ \t\n\x0B\f\r]"


def ascii_lower(c: Column) -> Column:
    """Small letters for A-Z; every other character stays, unlike with ``lower``."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def ascii_trim(c: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(c, F.lit(SPACE))


def fits(c: Column, size: int) -> Column:
    """The text if it has at most ``size`` bytes, else null."""
    return F.when(F.octet_length(c) <= size, c)


def may_have_timezone(c: Column) -> Column:
    """Whether a date or time ends in what may be a time zone.

    That is a name other than AM or PM, or a signed number: after ``+``, or after
    ``-`` when the text has no other ``-`` or at least two more.
    """
    s = F.regexp_replace(c, rf"{SPACE_CLASS}+\z", "")
    name = s.rlike(r"[A-Za-z]\z") & ~s.rlike(rf"(?i){SPACE_CLASS}[ap]m\z")
    plus = s.rlike(r"\+[0-9 \t]*[0-9]\z")
    minus = s.rlike(r"-[0-9 \t]*[0-9]\z")
    others = F.length(s) - F.length(F.replace(s, F.lit("-"), F.lit(""))) - 1
    return name | plus | (minus & ((others == 0) | (others > 1)))
