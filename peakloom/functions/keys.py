"""The identity key of a structure, however it is written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind, zero-width characters included.
SPACE = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200D}\x{2028}\x{2029}\x{202F}\x{205F}\x{2060}\x{3000}\x{FEFF}]*"
KEY_PATTERN = rf"^{SPACE}(?:[Ii][Nn][Cc][Hh][Ii][Kk][Ee][Yy]=)?{SPACE}([A-Za-z]{{14}})(?:-[A-Za-z]{{10}}(?:-[A-Za-z])?)?{SPACE}$"


def structure_key(c: Column | str) -> Column:
    """Fourteen upper-case letters, or null where the value has no key."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.upper(F.regexp_extract(c, KEY_PATTERN, 1)), F.lit(""))


def structure_key_sql(expr: str) -> str:
    """The same as SQL text (for a dialect with RE2 patterns)."""
    return f"nullif(upper(regexp_extract({expr}, '{KEY_PATTERN}', 1)), '')"


def record_key(first: str = "inchikey14", second: str = "inchikey") -> Column:
    """The key of a record: that of ``first``, or that of ``second`` where the first has none."""
    return F.coalesce(structure_key(first), structure_key(second))


def record_key_sql(first: str = "inchikey14", second: str = "inchikey") -> str:
    return f"coalesce({structure_key_sql(first)}, {structure_key_sql(second)})"
