"""Source ids derived from message topics, resource paths and registrations."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _base(base_id: Column | str) -> Column:
    return F.lit(base_id) if isinstance(base_id, str) else base_id


def topic_source_id(topic: Column, base_id: Column | str) -> Column:
    """Broker topic ``city/a/#`` under base ``x`` becomes ``x_city_a_wildcard``."""
    safe = F.translate(topic, "/", "_")
    safe = F.replace(F.replace(safe, F.lit("#"), F.lit("wildcard")), F.lit("+"), F.lit("plus"))
    return F.concat_ws("_", _base(base_id), safe)


def path_source_id(path: Column, base_id: Column | str) -> Column:
    """Resource path ``/sensors/t1`` under base ``x`` becomes ``x_sensors_t1``; none is the base."""
    safe = F.ltrim(F.translate(path, "/", "_"), F.lit("_"))
    return F.concat_ws("_", _base(base_id), F.nullif(safe, F.lit("")))


def stable_ingestion_id(name: Column, type_name: Column) -> Column:
    """Same (name, type), same id: 8 hex digits of a hash, then a readable name and the type."""
    digest = F.substring(F.md5(F.concat_ws("_", name, type_name)), 1, 8)
    readable = F.regexp_replace(F.lower(F.trim(name)), "[^a-zA-Z0-9]+", "_")
    return F.concat_ws("_", digest, readable, type_name)
