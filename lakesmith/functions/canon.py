"""Canonical spellings and time conversions that do not depend on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that may surround a stored identifier.
BLANKS = " \t\n\r\x0b\x0c\x85\xa0\u2002\u2003\u2009\u2028\u2029\u202f\u3000\ufeff"

DAY_US = 86_400_000_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def canonical_text(c: Column | str) -> Column:
    """Lower case without surrounding white space; NULL stays NULL, a blank text becomes ''."""
    return F.lower(F.btrim(_col(c), F.lit(BLANKS)))


def canonical_id(c: Column | str) -> Column:
    """The one spelling by which identifiers are compared. A blank identifier identifies nothing and becomes NULL."""
    return F.nullif(canonical_text(c), F.lit(""))


def micros(c: Column | str) -> Column:
    """Microseconds since 1970-01-01 UTC of a TIMESTAMP."""
    return F.unix_micros(_col(c))


def utc_date(us: Column | str) -> Column:
    """The UTC calendar day of microseconds since the epoch."""
    return F.date_from_unix_date(F.floor(_col(us) / F.lit(DAY_US)).cast("int"))
