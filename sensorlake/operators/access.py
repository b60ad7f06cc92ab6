"""Sensitivity labels: of a computation, from the devices it reads; and who may see them."""

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels from lowest to highest, and the highest each role may see.
LEVELS = ("public", "internal", "confidential", "restricted")
ROLE_LEVEL = {"viewer": "public", "user": "internal", "admin": "restricted"}
DEVICE_COLUMNS = ("ingestion_id", "sensor_id", "device_id", "sensorid")

_QUOTED = r"""['"]([^'"]+)['"]"""


def level_rank(label: Column) -> Column:
    """Position of a label; unknown or missing labels count as public."""
    ranks = F.create_map(*[F.lit(x) for i, name in enumerate(LEVELS) for x in (name, i)])
    return F.coalesce(ranks[F.lower(label)], F.lit(0))


def level_name(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(name) for name in LEVELS]), rank)


def _names_device(text: str) -> bool:
    return "ingestion_id" in text.lower() or "sensor_id" in text.lower()


def definition_devices(definition: Mapping) -> set[str]:
    """Device ids a computation names: in where (one or a list), or quoted in select."""
    found: set[str] = set()
    for condition in definition.get("where") or []:
        if str(condition.get("col", "")).lower() in DEVICE_COLUMNS:
            value = condition.get("value")
            found.update(v for v in (value if isinstance(value, list) else [value])
                         if isinstance(v, str) and v)
    for item in definition.get("select") or []:
        if isinstance(item, str) and _names_device(item):
            found.update(re.findall(_QUOTED, item))
    return found


def definition_references(definitions: DataFrame) -> DataFrame:
    """``definition_devices`` for a table ``(id, definition JSON)``: one row per named device, or
    one row with a null ``ref``; ``filtered`` says whether any condition is on a device column."""
    layout = "select array<string>, where array<struct<col string, op string, value string>>"
    parsed = definitions.withColumn("_d", F.from_json("definition", layout))
    on_device = F.filter(F.coalesce("_d.where", F.array()), lambda w: F.lower(w["col"]).isin(*DEVICE_COLUMNS))
    named = F.flatten(F.transform(on_device, lambda w: F.coalesce(
        F.from_json(w["value"], "array<string>"), F.array(w["value"]))))
    quoted = F.flatten(F.transform(
        F.filter(F.coalesce("_d.select", F.array()), lambda s: F.lower(s).rlike("ingestion_id|sensor_id")),
        lambda s: F.regexp_extract_all(s, F.lit(_QUOTED), 1)))
    refs = F.array_distinct(F.filter(F.concat(named, quoted), lambda r: r != ""))
    return parsed.withColumns({"filtered": F.size(on_device) > 0, "_refs": refs}) \
        .select("id", "filtered", F.explode_outer("_refs").alias("ref"))


def computation_sensitivity(definitions: DataFrame, devices: DataFrame) -> DataFrame:
    """Each computation's label: the highest among the devices it names.

    One that names no known device and does not filter by device reads them all, and takes the
    highest label of the enabled devices; one that filters on unknown devices is public.
    """
    known = devices.where("ingestion_id is not null").select(
        F.col("ingestion_id").alias("ref"), level_rank(F.col("sensitivity")).alias("_rank"))
    enabled = devices.where("enabled").agg(
        F.max(level_rank(F.col("sensitivity"))).alias("rank"), F.count("*").alias("n"))
    labelled = definition_references(definitions).join(known, "ref", "left").groupBy("id").agg(
        F.max("_rank").alias("_rank"), F.count("_rank").alias("_n"),
        F.bool_or("filtered").alias("_filtered"))
    reads_all = (F.col("_n") == 0) & ~F.col("_filtered")
    rank = F.when(reads_all, enabled.select("rank").scalar()).otherwise(F.col("_rank"))
    return labelled.select(
        "id", level_name(F.coalesce(rank, F.lit(0))).alias("sensitivity"),
        F.when(reads_all, enabled.select("n").scalar()).otherwise(F.col("_n")).alias("n_devices"))


def highest_role_rank(roles: Iterable[str]) -> int:
    """Highest level a set of roles may see; no or unknown roles see public only."""
    return max([LEVELS.index(ROLE_LEVEL[r.lower()]) for r in roles if r.lower() in ROLE_LEVEL],
               default=0)


def readable(df: DataFrame, roles: Iterable[str], label: str = "sensitivity") -> DataFrame:
    """Rows whose label the roles may see."""
    return df.where(level_rank(F.col(label)) <= highest_role_rank(roles))


def access_filter(tiles: DataFrame, roles: DataFrame, label: str = "sensitivity") -> DataFrame:
    """Mark the rows ``(username, label, ...)`` their user may not see, with the reason.

    ``roles`` holds ``(username, role)``; users without a known role see public data only.
    """
    role_ranks = F.create_map(*[F.lit(x) for role, top in ROLE_LEVEL.items()
                                for x in (role, LEVELS.index(top))])
    top = roles.groupBy("username").agg(
        F.max(F.coalesce(role_ranks[F.lower("role")], F.lit(0))).alias("_top"))
    restricted = level_rank(F.col(label)) > F.coalesce("_top", F.lit(0))
    required = F.when(F.col(label) == "internal", "user or admin") \
        .when(F.col(label) == "restricted", "admin with audit access").otherwise("admin")
    reason = F.concat(F.lit("This tile contains "), F.initcap(F.col(label)),
                      F.lit(" data. Required role: "), required, F.lit("."))
    return tiles.join(top, "username", "left").withColumns({
        "access_restricted": restricted,
        "restriction_message": F.when(restricted, reason)}).drop("_top")
