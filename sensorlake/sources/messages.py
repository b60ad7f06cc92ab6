"""Raw messages: decode, cut into records, flatten into bronze payloads."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import normalize_event_time
from ..functions.fields import last_wins, overlay

_TEXT_MAP = "map<string,string>"


def parse_messages(df: DataFrame, value: str = "value", content_type: Column | None = None) -> DataFrame:
    """Add ``data``: the payload object as a text map. A payload that is no JSON object becomes
    ``{content, raw: true}``, or ``{content, content_type}`` if a content type is given."""
    text = F.col(value)
    mark = (F.lit("raw"), F.lit("true")) if content_type is None else (F.lit("content_type"), content_type)
    plain = F.create_map(F.lit("content"), text, *mark)
    return df.withColumn("data", F.coalesce(F.from_json(text, _TEXT_MAP), plain)) \
        .withColumn("data", last_wins(F.col("data")))


def extract_records(df: DataFrame, path: str = "", value: str = "value") -> DataFrame:
    """One row per record of a response document, as JSON text in ``record``.

    ``path`` is dotted, numbers index lists (``items.0.data``). A list gives a row per element,
    anything else one row; a path that leads nowhere gives the whole document; text that is not
    JSON is a document with its ``content``.
    """
    if "'" in path:
        raise ValueError("quotes are not allowed in a data path")
    plain = F.to_variant_object(F.struct(F.col(value).alias("content")))
    document = F.coalesce(F.try_parse_json(value), plain)
    rows = df.withColumn("_document", document).withColumn("_found", F.col("_document"))
    for step in filter(None, path.split(".")):
        options = [F.try_variant_get("_found", f"$['{step}']", "variant")]
        if step.isdigit():
            options.append(F.try_variant_get("_found", f"$[{step}]", "variant"))
        rows = rows.withColumn("_found", F.coalesce(*options))
    rows = rows.withColumn("_found", F.coalesce("_found", "_document"))
    many = F.when(F.schema_of_variant("_found").startswith("ARRAY"), F.col("_found").try_cast("array<variant>")) \
        .otherwise(F.array("_found"))
    return rows.select(*df.columns, F.explode(many).alias("_record")) \
        .select(*df.columns, F.to_json("_record").alias("record"))


def build_bronze(df: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Flatten message envelopes to bronze payloads.

    Input: ``data`` and ``metadata`` text maps, ``source_id``, ``timestamp`` text. Ids and times
    win over data keys of the same name, metadata wins over both (its ``source_type`` aside).
    """
    arrival = F.current_timestamp() if as_of is None else as_of.cast("timestamp")
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
    stamped = df.withColumn("_time", normalize_event_time(F.col("timestamp"), arrival)) \
        .withColumn("_ids", F.create_map(
            F.lit("ingestion_id"), F.col("source_id"), F.lit("timestamp"), F.date_format("_time", iso),
            F.lit("source_type"), F.col("metadata")["source_type"],
            F.lit("ingestion_timestamp"), F.date_format(arrival, iso))) \
        .withColumn("_meta", F.map_filter("metadata", lambda k, v: k != "source_type"))
    once = stamped.withColumn("_payload", overlay(F.col("data"), F.col("_ids")))
    return once.select(F.col("source_id").alias("ingestion_id"), F.col("_time").alias("event_time"),
                       overlay(F.col("_payload"), F.col("_meta")).alias("payload"))


def payload_columns(df: DataFrame, schema: T.StructType, payload: str = "payload") -> DataFrame:
    """Payload maps as the wide columns of a merged schema; values that do not fit are null."""
    return df.select(*[F.col(payload)[f.name].try_cast(f.dataType).alias(f.name) for f in schema.fields])
