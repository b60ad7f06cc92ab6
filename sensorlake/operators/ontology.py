"""Permitted sensor types and fields, read from an OWL file in RDF/XML."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Value types by XML Schema name, and fields that are not sensor data.
VALUE_TYPES = {"float": "float", "double": "float", "decimal": "float", "integer": "int",
               "string": "str", "dateTime": "datetime", "boolean": "bool"}
STRUCTURAL_FIELDS = ("ingestion_id", "timestamp", "device_id", "sensor_type", "raw_json",
                     "source_protocol", "date", "hour")

_LINK = T.StructType([T.StructField("_rdf:resource", T.StringType())])
_ELEMENT = T.StructType([
    T.StructField("_rdf:about", T.StringType()),
    T.StructField("rdfs:label", T.StringType()),
    T.StructField("rdfs:comment", T.StringType()),
    T.StructField("rdfs:subClassOf", _LINK),
    T.StructField("rdfs:domain", _LINK),
    T.StructField("rdfs:range", _LINK),
])


def _elements(spark: SparkSession, path: str, tag: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(_ELEMENT).load(path)


def _local(uri: Column) -> Column:
    return F.substring_index(uri, "#", -1)


def _resource(name: str) -> Column:
    return F.col(f"`rdfs:{name}`")["_rdf:resource"]


def read_classes(spark: SparkSession, path: str) -> DataFrame:
    """Classes: ``(uri, name, label, comment, parent)``."""
    rows = _elements(spark, path, "owl:Class").where("`_rdf:about` is not null")
    uri = F.col("`_rdf:about`")
    return rows.select(uri.alias("uri"), _local(uri).alias("name"),
                       F.coalesce("`rdfs:label`", _local(uri)).alias("label"),
                       F.coalesce("`rdfs:comment`", F.lit("")).alias("comment"),
                       _local(_resource("subClassOf")).alias("parent"))


def read_properties(spark: SparkSession, path: str) -> DataFrame:
    """Properties: ``(uri, name, label, domain, range, kind, value_type)``."""
    known = F.create_map(*[F.lit(x) for pair in VALUE_TYPES.items() for x in pair])
    uri, target = F.col("`_rdf:about`"), _resource("range")
    kinds = {"owl:ObjectProperty": "object", "owl:DatatypeProperty": "data"}
    frames = [_elements(spark, path, tag).where("`_rdf:about` is not null").select(
        uri.alias("uri"), _local(uri).alias("name"),
        F.coalesce("`rdfs:label`", _local(uri)).alias("label"),
        _local(_resource("domain")).alias("domain"), _local(target).alias("range"),
        F.lit(kind).alias("kind"), known[_local(target)].alias("value_type"))
        for tag, kind in kinds.items()]
    return reduce(DataFrame.unionByName, frames)


def canonical_fields(properties: DataFrame) -> DataFrame:
    """Names sensor fields may have: the data properties."""
    return properties.where("kind = 'data'").select(F.col("name").alias("field"))


def valid_sensor_types(types: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of ``types`` (column ``type``) that are 'Sensor' or one of its direct subclasses."""
    valid = classes.where("name = 'Sensor' or parent = 'Sensor'").select(F.col("name").alias("type"))
    return types.join(valid, "type", "left_semi")


def unrecognized_fields(fields: DataFrame, rules: DataFrame, known: DataFrame) -> DataFrame:
    """An info row per field (``field``) that, after global renaming, the ontology does not know."""
    structural = F.col("field").isin(*STRUCTURAL_FIELDS)
    renames = rules.where("enabled and ingestion_id is null").groupBy(F.lower("raw_key").alias("_raw")) \
        .agg(F.min_by("canonical_key", "id").alias("_canonical"))
    canonical = (fields.where(~structural).select("field").distinct()
                 .join(renames, F.lower("field") == F.col("_raw"), "left")
                 .select(F.coalesce("_canonical", "field").alias("field")).distinct().where(~structural))
    return canonical.join(known, "field", "left_anti").select(
        F.concat(F.lit("ontology-unknown-"), "field").alias("id"), "field",
        F.concat(F.lit('Sensor field "'), "field", F.lit('" is not defined in the ontology.')).alias("message"),
        F.lit("info").alias("variant")).orderBy("field")


def collect_alerts(*frames: DataFrame) -> DataFrame:
    """Rows ``(id, message, variant)`` of every checker."""
    return reduce(DataFrame.unionByName, [f.select("id", "message", "variant") for f in frames])
