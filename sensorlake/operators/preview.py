"""What renaming rules would do to a frame's columns, before they are switched on."""

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .normalize import normalize_columns


def _columns(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(c, c.lower()) for c in df.columns], "column string, lower string")


def _matches(mode: str) -> Column:
    if mode == "exact":
        return F.col("lower") == F.col("raw_key")
    if mode == "contains":
        return F.contains("lower", "raw_key")
    raise ValueError("mode is 'exact' or 'contains'")


def _candidates(rules: DataFrame, custom: Iterable[Mapping[str, str]], ingestion_id: str | None) -> DataFrame:
    own = F.col("ingestion_id").isNull()
    if ingestion_id is not None:
        own = own | (F.col("ingestion_id") == ingestion_id)
    saved = rules.where("enabled").where(own if ingestion_id is not None else F.lit(True)).select(
        F.col("id").cast("string").alias("rule_id"), F.lit("existing").alias("type"),
        F.lower("raw_key").alias("raw_key"), "canonical_key")
    rows = [(f"custom_{i}", "custom", r["raw_key"].lower(), r["canonical_key"]) for i, r in enumerate(custom)]
    return saved.unionByName(rules.sparkSession.createDataFrame(rows, saved.schema)) if rows else saved


def preview_rules(df: DataFrame, rules: DataFrame, custom: Iterable[Mapping[str, str]] = (),
                  ingestion_id: str | None = None, mode: str = "exact") -> DataFrame:
    """One row per (column, rule) hit, and one with no rule per column no rule hits.

    'exact' matches as the normaliser does; 'contains' shows every column whose name includes the
    raw key. Columns starting with ``_`` are not offered as unmapped.
    """
    hits = _columns(df).join(_candidates(rules, custom, ingestion_id), _matches(mode), "left")
    return hits.where("rule_id is not null or not startswith(column, '_')").select(
        "column", "rule_id", "type", "raw_key", "canonical_key")


def preview_summary(preview: DataFrame) -> DataFrame:
    return preview.agg(
        F.count_distinct("column").alias("columns"), F.count("rule_id").alias("rules_applied"),
        F.count_distinct(F.when(F.col("rule_id").isNotNull(), F.col("column"))).alias("columns_mapped"),
        F.count_if(F.col("rule_id").isNull()).alias("unmapped_columns"))


def renamed_sample(df: DataFrame, rules: Mapping[str, str], n: int = 10) -> DataFrame:
    """The first ``n`` rows as they would look."""
    return normalize_columns(df.limit(n), rules)


def compare_scenarios(df: DataFrame, rules: DataFrame, a: Iterable[Mapping[str, str]],
                      b: Iterable[Mapping[str, str]], mode: str = "exact") -> DataFrame:
    """Per column the canonical names under scenario a and b, and whether they agree."""
    def names(custom, name: str) -> DataFrame:
        return preview_rules(df, rules, custom, mode=mode).groupBy("column").agg(
            F.array_join(F.array_sort(F.collect_set("canonical_key")), ",").alias(name))
    return names(a, "scenario_a").join(names(b, "scenario_b"), "column", "full_outer") \
        .withColumn("same", F.col("scenario_a").eqNullSafe(F.col("scenario_b")))


def check_rules(rules: DataFrame, df: DataFrame, mode: str = "exact") -> DataFrame:
    """Per rule: is its raw key a column, has it a canonical name, is that name used twice?"""
    keyed = rules.select("id", F.lower("raw_key").alias("raw_key"), "canonical_key")
    found = keyed.join(_columns(df), _matches(mode), "left_semi").select("id").withColumn("_found", F.lit(True))
    uses = keyed.groupBy("canonical_key").agg(F.count("*").alias("_uses"))
    return (keyed.join(found, "id", "left").join(uses, "canonical_key")
            .select("id", "raw_key", "canonical_key",
                    F.coalesce("_found", F.lit(False)).alias("raw_key_found"),
                    (F.trim("canonical_key") != "").alias("has_name"),
                    (F.col("_uses") > 1).alias("name_shared"))
            .withColumn("valid", F.col("raw_key_found") & F.col("has_name")))
