"""All fields of a reading in one column, where the names are not known or are too many for columns of their own.

A column per field needs every name in the plan. Here a reading's fields form one VARIANT object instead: it is made row
by row, no name reaches the driver, and a field is read by its path. What fields there are is a table, not a list.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import infer_type, merged_type
from .profile import stored_type


def _entries(prefer_normalized: bool) -> Column:
    """Entries (key, value variant) of both maps, the preferred map's first; values that are null are left out."""
    def of(name: str, kind: str, other: str | None) -> Column:
        entries = F.coalesce(F.map_entries(name), F.expr(f"cast(array() as array<struct<key:string,value:{kind}>>)"))
        seen = F.col(other) if other else None
        fresh = F.filter(entries, lambda e: e["value"].isNotNull() & (
            F.coalesce(seen[e["key"]].isNull(), F.lit(True)) if seen is not None else F.lit(True)))
        value = (lambda e: e["value"]) if prefer_normalized else (lambda e: e["value"].cast("string"))
        return F.transform(fresh, lambda e: F.struct(e["key"].alias("key"), value(e).cast("variant").alias("value")))

    text, number = ("sensor_data", "string"), ("normalized_data", "double")
    first, second = (number, text) if prefer_normalized else (text, number)
    return F.concat(of(*first, None), of(*second, first[0]))


def field_object(df: DataFrame, prefer_normalized: bool = True, into: str = "fields") -> DataFrame:
    """The union frame with one VARIANT object of all its fields in place of the two maps.

    A field is its number where it has one, else its text; with ``prefer_normalized=False`` it is its text, a number
    without text as text. Fields that are null are left out, a row without fields (null or empty maps) has an
    empty object. Other columns stay (one named as ``into`` is replaced). One row may hold what a VARIANT holds, 16 MB.
    """
    made = F.to_variant_object(F.map_from_entries(_entries(prefer_normalized)))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("sensor_data", "normalized_data") and c.lower() != into.lower()]
    return df.select(*kept, made.alias(into))


def field_path(name: str) -> str:
    """The path of a field, whatever dots or blanks its name holds."""
    quote = "'" if "'" not in name else '"'
    if quote in name:
        raise ValueError(f"no path for a field whose name holds both kinds of quotes: {name}")
    return f"$[{quote}{name}{quote}]"


def field_value(name: str, kind: str = "double", of: str = "fields") -> Column:
    """A field of the object by its name; null where it is absent or is no ``kind``."""
    return F.try_variant_get(F.col(of), field_path(name), kind)


def object_entries(df: DataFrame, of: str = "fields") -> DataFrame:
    """One row per field of each row: the other columns, then ``field`` and its ``value`` as VARIANT."""
    kept = [F.col(f"`{c}`") for c in df.columns if c != of]
    return df.select(*kept, F.explode(F.col(of).cast("map<string,variant>")).alias("field", "value"))


def field_dictionary(df: DataFrame, seen_at: Column, of: str = "fields") -> DataFrame:
    """(field, type, uses, first_seen, last_seen) of every field of the objects.

    The type is the most general of the field's values. Uses are counted per type inside the tasks before anything is
    shuffled, so a field in every row is no heavy key. The result is a table like any other, to be stored and joined.
    """
    typed = object_entries(df.select(seen_at.alias("_seen"), F.col(of)), of).select(
        "_seen", "field", infer_type(F.col("value")).alias("type"))
    per_type = typed.groupBy("field", "type").agg(
        F.count("*").alias("uses"), F.min("_seen").alias("first_seen"), F.max("_seen").alias("last_seen"))
    return per_type.groupBy("field").agg(
        merged_type(F.col("type"), F.col("first_seen")).alias("type"), F.sum("uses").alias("uses"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def stored_object(df: DataFrame, dictionary: DataFrame, key: list[str], of: str = "fields") -> DataFrame:
    """The objects with every value in the type in which its field is stored: boolean, double or text.

    In a field that is text somewhere, numbers and booleans become text, lists and objects JSON text; in a field of
    numbers and booleans these become 1 and 0. Nulls inside an object stay. ``key`` names the columns that tell rows
    apart; they and the object are returned. Only the values to change move; where the dictionary is small Spark
    broadcasts it.
    """
    entries = object_entries(df.select(*key, of), of).withColumn("_own", infer_type(F.col("value")))
    stored = dictionary.select("field", stored_type(F.col("type")).alias("_stored")).where("_stored <> 'boolean'")
    no_text, number = ~F.col("_own").isin("null", "string", "uuid", "timestamp"), F.col("_stored") == "double"
    changed = entries.join(stored, "field").where(F.when(number, F.col("_own") == "boolean").otherwise(no_text)).select(
        *key, "field", F.when(number, F.col("value").try_cast("double").cast("variant"))
        .otherwise(F.col("value").try_cast("string").cast("variant")).alias("value"))
    per_row = changed.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_new"))
    old = F.col(of).cast("map<string,variant>")
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key("_new", k)), F.col("_new"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return df.select(*key, of).alias("a").join(per_row.alias("b"), condition, "left").select(
        *[F.col(f"a.{k}").alias(k) for k in key],
        F.when(F.col("_new").isNull(), F.col(of)).otherwise(F.to_variant_object(merged)).alias(of))
