"""Text predicates and formats of the input contracts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Device names that no identifier may have.
RESERVED = ["con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10))]
IDENTIFIER = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,63}$"


def safe_path(path: Column) -> Column:
    """Whether a path is relative, has no empty, ``.`` or ``..`` part, no backslash, drive or NUL. Null is unsafe."""
    parts = F.split(path, "/")
    bad = F.exists(parts, lambda p: (p == "") | (p == ".") | (p == ".."))
    return F.coalesce(~path.rlike(r"[\\:\x00]") & ~bad, F.lit(False))


def identifier_ok(name: Column) -> Column:
    """Whether a name is an identifier and not a reserved device name, in any letter case. Null is not."""
    return F.coalesce(name.rlike(IDENTIFIER) & ~F.lower(name).isin(RESERVED), F.lit(False))


def upload_name(path: Column, default: str = "upload", most: int = 180) -> Column:
    """The last part of a path, trimmed, at most ``most`` characters; ``default`` for nothing."""
    last = F.trim(F.regexp_extract(path, r"([^/\\]*)$", 1))
    return F.coalesce(F.nullif(F.substring(last, 1, most), F.lit("")), F.lit(default))


def timestamp_ok(text: Column, now: Column, after: Column | None = None) -> Column:
    """Whether an ISO timestamp names a zone, is no later than ``now`` and, if given, later than ``after``."""
    zoned = text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d(:\d\d(\.\d{1,9})?)?(Z|[+-]\d\d:\d\d)$")
    at = F.try_to_timestamp(text)
    ok = zoned & (at <= now)
    return F.coalesce(ok & (at > after) if after is not None else ok, F.lit(False))


def percent(value: Column, places: int = 1) -> Column:
    """A share as a percentage, a dash for nothing."""
    return F.when(value.isNull(), "-").otherwise(F.format_string(f"%.{places}f%%", value * 100))


def signed(value: Column, places: int = 3) -> Column:
    """A number with its sign, a dash for nothing."""
    return F.when(value.isNull(), "-").otherwise(F.format_string(f"%+.{places}f", value))
