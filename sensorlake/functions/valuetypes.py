"""Names of JSON value types, and how two of them combine."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Type names and their generality, lowest first; equal ranks keep the first seen.
TYPE_RANK = {
    "null": 0,
    "boolean": 1,
    "integer": 2,
    "double": 3,
    "string": 4,
    "timestamp": 4,
    "uuid": 4,
    "array": 5,
    "object": 6,
    "unknown": 7,
}

UUID_TEXT = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"

_NUMBER = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"


def infer_type(value: Column) -> Column:
    """Type name of a VARIANT value; every number is a ``double``, as bronze stores it."""
    found = F.schema_of_variant(value)
    return (F.when(value.isNull() | F.is_variant_null(value), "null")
            .when(found == "BOOLEAN", "boolean")
            .when(found.rlike(_NUMBER), "double")
            .when(found == "STRING",
                  F.when(value.cast("string").rlike(UUID_TEXT), "uuid").otherwise("string"))
            .when(found.startswith("ARRAY"), "array")
            .when(found.startswith("OBJECT"), "object")
            .otherwise("unknown"))


def type_rank(name: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in TYPE_RANK.items() for x in pair])
    return F.coalesce(ranks[name], F.lit(TYPE_RANK["unknown"]))


def merged_type(name: Column, seen_at: Column) -> Column:
    """Aggregate: the most general type of a group, the earliest seen among equals."""
    return F.min_by(name, F.struct(-type_rank(name), seen_at, name))
