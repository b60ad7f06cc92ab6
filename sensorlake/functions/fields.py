"""Column helpers for the two-map row: text in ``sensor_data``, numbers in ``normalized_data``."""

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what counts as a number in sensor text (so "+5", "5.", "NaN", " 5" do not).
NUMERIC_TEXT = r"^-?\d*\.?\d+([eE][-+]?\d+)?$"

# Fixed value: the spellings under which devices report their own id.
SENSOR_ID_KEYS = ("sensorId", "sensorid", "sensor_id")


def numeric_or_null(c: Column) -> Column:
    """Double where the text is a plain number, null otherwise; never raises under ANSI mode."""
    text = c.cast("string")
    return F.when(text.rlike(NUMERIC_TEXT), text.try_cast("double"))


def drop_nulls(m: Column) -> Column:
    return F.map_filter(m, lambda k, v: v.isNotNull())


def compact_map(entries: Mapping[str, Column], value_type: str) -> Column:
    """Map of the non-null entries. Built by joining one-entry maps, which compiles; filtering a
    full map would run the interpreted lambda on every row."""
    if not entries:
        return F.lit(None).cast(f"map<string,{value_type}>")
    empty = F.expr(f"cast(map() as map<string,{value_type}>)")
    return F.map_concat(empty, *[
        F.when(value.isNull(), empty).otherwise(F.create_map(F.lit(key), value))
        for key, value in entries.items()])


def last_wins(m: Column) -> Column:
    """A map column without repeated keys (JSON may repeat them), the last value staying. Rows
    without repeats, nearly all, are only checked."""
    keys = F.map_keys(m)
    last = F.filter(F.map_entries(m), lambda e, i: ~F.array_contains(
        F.slice(keys, i + 2, F.size(keys)), e["key"]))
    return F.when(F.size(F.array_distinct(keys)) < F.size(keys), F.map_from_entries(last)).otherwise(m)


def overlay(base: Column, over: Column) -> Column:
    """Merge two map columns, ``over`` winning on shared keys, whatever the session's dedup policy.

    Pass columns, not expressions: ``over`` is read once per key of ``base``.
    """
    kept = F.map_filter(base, lambda k, v: ~F.map_contains_key(over, k))
    return F.when(base.isNull(), over).when(over.isNull(), base).otherwise(F.map_concat(kept, over))


def overlay_keys(base: Column, entries: Mapping[str, Column], value_type: str) -> Column:
    """``overlay`` for keys known at plan time: a literal key test instead of a map lookup per
    entry. A null new value removes the key."""
    if not entries:
        return base
    over = compact_map(entries, value_type)
    kept = F.map_filter(base, lambda k, v: ~k.isin(*entries))
    return F.when(base.isNull(), over).otherwise(F.map_concat(kept, over))


def extract_field(name: str, prefer_normalized: bool = True) -> Column:
    """One field of a union row: as a number (normalised first), or as text (raw first)."""
    text = F.col("sensor_data")[name]
    number = F.col("normalized_data")[name]
    if prefer_normalized:
        return F.coalesce(number, text.try_cast("double"))
    return F.coalesce(text, number.cast("string"))


def as_text(name: str) -> Column:
    return extract_field(name, prefer_normalized=False)


def sensor_id(fallback: bool = True) -> Column:
    """The device's own id, else (if ``fallback``) the source id, else 'unknown'."""
    found = F.coalesce(*[F.col("sensor_data")[k] for k in SENSOR_ID_KEYS])
    rest = [F.col("ingestion_id")] if fallback else []
    return F.coalesce(found, *rest, F.lit("unknown"))


def valid_reading(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c)


def stable_avg(c: Column, scale: int = 2) -> Column:
    """Rounded mean of doubles. Summing gives a different last bit per task layout; rounding to a
    few more digits first takes that bit away, so that a tie goes the same way on a retried task."""
    return F.round(F.round(F.avg(c), scale + 6), scale)
