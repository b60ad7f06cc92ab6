"""Event times from sensor text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH_TEXT = r"^-?\d+(\.\d+)?$"
# First second after year 9999: later epochs are not event times (and would overflow).
_EPOCH_LIMIT = 253402300800


def _or_now(as_of: Column | None) -> Column:
    return F.current_timestamp() if as_of is None else as_of.cast("timestamp")


def parse_timestamp(c: Column, as_of: Column | None = None) -> Column:
    """ISO-like text to timestamp, ``as_of`` (default: now) where it does not parse.

    Spark's own parser takes every shape sensors send - ``T`` or blank between date and time, no
    fraction or up to nanoseconds, with or without offset - so no list of patterns is tried.
    """
    return F.coalesce(F.try_to_timestamp(c.cast("string")), _or_now(as_of))


def normalize_event_time(c: Column, as_of: Column | None = None) -> Column:
    """ISO text (``Z`` allowed) or epoch seconds; anything else becomes ``as_of``."""
    text = F.trim(c.cast("string"))
    seconds = text.try_cast("double")
    epoch = F.when(F.abs(seconds) < _EPOCH_LIMIT, F.timestamp_seconds(seconds))
    return F.coalesce(F.when(text.rlike(_EPOCH_TEXT), epoch).otherwise(F.try_to_timestamp(text)),
                      _or_now(as_of))
