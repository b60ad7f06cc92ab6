"""Wide rows to the two-map layout and back, with rule-driven renaming.

Rules are rows ``(id, ingestion_id, raw_key, canonical_key, enabled, ...)``; a null
``ingestion_id`` makes a rule global, and a rule of the row's own source beats a global one.
"""

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import (compact_map, extract_field, numeric_or_null, overlay_keys,
                         parse_timestamp)
from ..functions.fields import overlay

RULE_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("ingestion_id", T.StringType()),
    T.StructField("raw_key", T.StringType()),
    T.StructField("canonical_key", T.StringType()),
    T.StructField("enabled", T.BooleanType()),
    T.StructField("applied_count", T.LongType()),
    T.StructField("last_applied_at", T.TimestampType()),
])

# The mappings every new installation starts with.
DEFAULT_RULES = {
    "sensorid": "sensorId",
    "sensor_id": "sensorId",
    "sensor-id": "sensorId",
    "temperature": "temperature",
    "humidity": "humidity",
    "timestamp": "timestamp",
    "time": "timestamp",
    "ts": "timestamp",
}

# Rule tables up to this many rows are compiled into the plan; larger ones are joined.
MAX_INLINE_RULES = 500
MAX_INLINE_SOURCES = 50


# ---------------------------------------------------------------- wide columns

def lower_columns(df: DataFrame) -> DataFrame:
    """Lower-case every column name; of names differing only in case the first stays."""
    first = {}
    for position, name in enumerate(df.columns):
        first.setdefault(name.lower(), position)
    # by position: under case-insensitive resolution two such names are ambiguous
    numbered = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return numbered.select(*[F.col(f"_{i}").alias(name) for name, i in first.items()])


def normalize_columns(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """Rename raw columns to canonical ones; several raws of one name are coalesced in order."""
    lowered = lower_columns(df)
    sources: dict[str, list[str]] = {}
    for name in lowered.columns:
        sources.setdefault(rules.get(name, name), []).append(name)
    return lowered.select(*[F.coalesce(*[F.col(f"`{r}`") for r in raws]).alias(canonical)
                            for canonical, raws in sources.items()])


# ---------------------------------------------------------------- wide -> union

def _number(df: DataFrame, name: str) -> Column | None:
    """The column as a finite double; None where its type never is one. A column the schema
    types as numeric is widened without going through text."""
    c, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(kind, T.NumericType):
        value = c.cast("double")
        return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    return numeric_or_null(c) if isinstance(kind, T.StringType) else None


def _typed(df: DataFrame, id_col: str, number, as_of: Column | None,
           keep: list[str]) -> tuple[DataFrame, dict[str, Column], dict[str, Column]]:
    """Every data column as text and, where it can be one, as a number.

    A projection of its own, so that each text and number is computed once however many map
    entries use it (Catalyst does not merge projections that would repeat such work).
    """
    names = [n for n in df.columns if n not in (id_col, "timestamp", *keep)]
    numbers = {n: c for n in names if (c := number(n)) is not None}
    time = F.col("timestamp") if "timestamp" in df.columns else F.lit(None).cast("string")
    source = F.col(id_col) if id_col in df.columns else F.lit("unknown")
    typed = df.select(source.alias("ingestion_id"), parse_timestamp(time, as_of).alias("timestamp"),
                      *[F.col(f"`{n}`").cast("string").alias(f"text:{n}") for n in names],
                      *[c.alias(f"number:{n}") for n, c in numbers.items()], *keep)
    return (typed, {n: F.col(f"`text:{n}`") for n in names},
            {n: F.col(f"`number:{n}`") for n in numbers})


def _union_rows(typed: DataFrame, text: Mapping[str, Column], numbers: Mapping[str, Column],
                keep: list[str]) -> DataFrame:
    return typed.select("ingestion_id", "timestamp",
                        compact_map(text, "string").alias("sensor_data"),
                        compact_map(numbers, "double").alias("normalized_data"), *keep)


def to_union(df: DataFrame, id_col: str = "ingestion_id", as_of: Column | None = None,
             keep: Iterable[str] = (), rules: DataFrame | Mapping[str, str] | None = None) -> DataFrame:
    """Wide rows to ``(ingestion_id, timestamp, sensor_data, normalized_data)``.

    ``keep`` names columns to carry along unchanged (say, an arrival time). With ``rules`` the
    result equals ``normalize_union(to_union(df), rules)``, but both maps are built once, from
    columns, instead of being built and then taken apart again.
    """
    keep = list(keep)
    typed, text, numbers = _typed(df, id_col, lambda n: _number(df, n), as_of, keep)
    scopes = {None: {}} if rules is None else _inline_rules(rules, MAX_INLINE_RULES)
    if scopes is None:
        return normalize_union(_union_rows(typed, text, numbers, keep), rules)

    def first(options: Iterable[Column | None], kind: str) -> Column:
        present = [c for c in options if c is not None]
        return F.coalesce(*present) if present else F.lit(None).cast(kind)

    def per_source(value) -> Column:
        """One value for all sources, or a branch per source that has rules of its own."""
        result = value(scopes[None])
        for source, groups in scopes.items():
            if source is not None:
                result = F.when(F.col("ingestion_id") == source, value(groups)).otherwise(result)
        return result

    def renamed_number(raw: str) -> Column | None:
        """A renamed number is read from the text; for these types that is the number itself."""
        if raw not in text:
            return None
        kind = df.schema[raw].dataType
        same = isinstance(kind, (T.IntegralType, T.DoubleType, T.StringType))
        return numbers.get(raw) if same else numeric_or_null(text[raw])

    def renamed(canonical: str) -> tuple[Column, Column]:
        raws = lambda groups: groups.get(canonical, [])
        return (per_source(lambda g: first([*map(text.get, raws(g)), text.get(canonical)], "string")),
                per_source(lambda g: first([numbers.get(canonical), *map(renamed_number, raws(g))],
                                           "double")))

    entries = {c: renamed(c) for c in dict.fromkeys(c for g in scopes.values() for c in g)}
    return _union_rows(typed, {**text, **{c: t for c, (t, _) in entries.items()}},
                       {**numbers, **{c: n for c, (_, n) in entries.items()}}, keep)


def to_union_fixed(df: DataFrame, as_of: Column | None = None,
                   keep: Iterable[str] = ()) -> DataFrame:
    """The bypass: plain casts, no text pattern, no rules."""
    keep = list(keep)
    typed, text, numbers = _typed(
        df, "ingestion_id", lambda n: F.col(f"`{n}`").cast("string").try_cast("double"), as_of, keep)
    return _union_rows(typed, text, numbers, keep)


# ---------------------------------------------------------------- rules

def rules_frame(spark: SparkSession, rows: Iterable[Mapping]) -> DataFrame:
    """Rule rows given as dicts; missing columns take their defaults."""
    defaults = {"id": None, "ingestion_id": None, "enabled": True, "applied_count": 0,
                "last_applied_at": None}
    names = RULE_SCHEMA.fieldNames()
    filled = [{**defaults, "id": i, **row} for i, row in enumerate(rows, 1)]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in filled], RULE_SCHEMA)


def default_rules(spark: SparkSession) -> DataFrame:
    return rules_frame(spark, [{"raw_key": r, "canonical_key": c}
                               for r, c in DEFAULT_RULES.items()])


def seed_rules(existing: DataFrame) -> DataFrame:
    """Default rules whose raw key (ignoring case) has no rule yet."""
    known = existing.select(F.lower("raw_key").alias("raw_key"))
    return default_rules(existing.sparkSession).join(known, "raw_key", "left_anti").select(
        "raw_key", "canonical_key")


def _enabled(rules: DataFrame) -> DataFrame:
    return rules.where("enabled").select("id", "ingestion_id", F.lower("raw_key").alias("raw_key"),
                                         "canonical_key")


def field_keys(df: DataFrame) -> DataFrame:
    """Distinct (source, raw key) pairs seen in a union frame, with uses and last use."""
    return df.select("ingestion_id", "timestamp", F.explode(F.map_keys("sensor_data")).alias("raw_key")) \
        .groupBy("ingestion_id", "raw_key") \
        .agg(F.count("*").alias("uses"), F.max("timestamp").alias("last_used"))


def resolve_rules(rules: DataFrame, fields: DataFrame) -> DataFrame:
    """The rule in force for each (``ingestion_id``, ``raw_key``) row of ``fields``.

    Only enabled rules count; the source's own rule beats a global one, then the lowest id wins.
    Fields without a rule are left out.
    """
    enabled = _enabled(rules)
    own = enabled.where("ingestion_id is not null").groupBy("ingestion_id", "raw_key").agg(
        F.min_by("canonical_key", "id").alias("own_key"), F.min("id").alias("own_id"))
    shared = enabled.where("ingestion_id is null").groupBy("raw_key").agg(
        F.min_by("canonical_key", "id").alias("shared_key"), F.min("id").alias("shared_id"))
    return (fields.join(own, ["ingestion_id", "raw_key"], "left").join(shared, "raw_key", "left")
            .withColumn("canonical_key", F.coalesce("own_key", "shared_key"))
            .withColumn("rule_id", F.when(F.col("own_key").isNotNull(), F.col("own_id"))
                        .otherwise(F.col("shared_id")))
            .where("canonical_key is not null")
            .drop("own_key", "own_id", "shared_key", "shared_id"))


def rule_usage(df: DataFrame, rules: DataFrame) -> DataFrame:
    """How often, and when last, each rule renamed something in a union frame."""
    return resolve_rules(rules, field_keys(df)).groupBy("rule_id", "raw_key", "canonical_key").agg(
        F.sum("uses").alias("applied_count"), F.max("last_used").alias("last_applied_at"))


# ---------------------------------------------------------------- applying rules to a union frame

def _by_canonical(pairs: Iterable[tuple[str, str]]) -> dict[str, list[str]]:
    groups: dict[str, list[str]] = {}
    for raw, canonical in pairs:
        groups.setdefault(canonical, []).append(raw)
    return groups


def _renamed_maps(groups: Mapping[str, list[str]]) -> tuple[Column, Column]:
    """Both maps of a row with the canonical keys laid over them; raw keys stay.

    The text prefers the raw keys over a value already under the canonical name, the number
    prefers the value already there.
    """
    text, numbers = F.col("sensor_data"), F.col("normalized_data")
    return (overlay_keys(text, {c: F.coalesce(*[text[r] for r in raws], text[c])
                                for c, raws in groups.items()}, "string"),
            overlay_keys(numbers, {c: F.coalesce(numbers[c], *[numeric_or_null(text[r]) for r in raws])
                                   for c, raws in groups.items()}, "double"))


def _inline_rules(rules: DataFrame | Mapping[str, str],
                  limit: int) -> dict[str | None, dict[str, list[str]]] | None:
    """``{source: {canonical: [raw, ...]}}`` with None for all other sources, or None if the rule
    table is too large to compile into a plan."""
    if isinstance(rules, Mapping):
        return {None: _by_canonical((r.lower(), c) for r, c in rules.items())}
    rows = _enabled(rules).orderBy("id").limit(limit + 1).collect()
    if len(rows) > limit or len({r.ingestion_id for r in rows}) > MAX_INLINE_SOURCES:
        return None
    shared: dict[str, str] = {}
    own: dict[str, dict[str, str]] = {}
    for row in rows:
        scope = shared if row.ingestion_id is None else own.setdefault(row.ingestion_id, {})
        scope.setdefault(row.raw_key, row.canonical_key)
    return {None: _by_canonical(shared.items()),
            **{s: _by_canonical({**shared, **keys}.items()) for s, keys in own.items()}}


def _normalize_inline(df: DataFrame, scopes: Mapping[str | None, Mapping[str, list[str]]]) -> DataFrame:
    text, numbers = _renamed_maps(scopes[None])
    for source, groups in scopes.items():
        if source is not None:
            own_text, own_numbers = _renamed_maps(groups)
            mine = F.col("ingestion_id") == source
            text = F.when(mine, own_text).otherwise(text)
            numbers = F.when(mine, own_numbers).otherwise(numbers)
    return df.withColumns({"sensor_data": text, "normalized_data": numbers})


def _normalize_joined(df: DataFrame, rules: DataFrame) -> DataFrame:
    """The same, with each source's rules joined on as an array instead of compiled in."""
    enabled = _enabled(rules)
    entry = F.struct("id", "raw_key", "canonical_key")
    own = enabled.where("ingestion_id is not null") \
        .groupBy("ingestion_id", "raw_key").agg(F.min(entry).alias("rule")) \
        .groupBy("ingestion_id").agg(F.array_sort(F.collect_list("rule")).alias("own"))
    shared = enabled.where("ingestion_id is null").groupBy("raw_key").agg(F.min(entry).alias("rule")) \
        .agg(F.array_sort(F.collect_list("rule")).alias("shared"))

    def grouped(rule_list: Column) -> Column:
        names = F.array_distinct(F.transform(rule_list, lambda r: r["canonical_key"]))
        return F.transform(names, lambda name: F.struct(
            name.alias("canonical"),
            F.transform(F.filter(rule_list, lambda r: r["canonical_key"] == name),
                        lambda r: r["raw_key"]).alias("raws")))

    # an own rule takes the place of the global one it replaces
    replaced = F.transform("shared", lambda s: F.coalesce(
        F.get(F.filter("own", lambda o: o["raw_key"] == s["raw_key"]), 0), s))
    added = F.filter("own", lambda o: ~F.exists("shared", lambda s: s["raw_key"] == o["raw_key"]))
    own = own.withColumn("shared", shared.scalar()) \
        .select("ingestion_id", F.concat(replaced, added).alias("all_rules")) \
        .select("ingestion_id", grouped(F.col("all_rules")).alias("own_rules"))
    shared_rules = shared.select(grouped(F.col("shared"))).scalar()

    def first_present(values: Column) -> Column:
        return F.get(F.filter(values, lambda v: v.isNotNull()), 0)

    def new_entries(value) -> Column:
        pairs = F.transform("_rules", lambda g: F.struct(g["canonical"].alias("key"),
                                                         value(g).alias("value")))
        return F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull()))

    text, numbers = F.col("sensor_data"), F.col("normalized_data")
    with_rules = df.join(own, "ingestion_id", "left") \
        .withColumn("_rules", F.coalesce("own_rules", shared_rules))
    # new entries as columns of their own: an expression inside the overlay's lambda would be
    # evaluated once per key of every row
    with_entries = with_rules.withColumns({
        "_text": new_entries(lambda g: F.coalesce(
            first_present(F.transform(g["raws"], lambda r: text[r])), text[g["canonical"]])),
        "_numbers": new_entries(lambda g: F.coalesce(
            numbers[g["canonical"]],
            first_present(F.transform(g["raws"], lambda r: numeric_or_null(text[r]))))),
    })
    return with_entries.withColumns({"sensor_data": overlay(text, F.col("_text")),
                                     "normalized_data": overlay(numbers, F.col("_numbers"))}) \
        .select(*df.columns)


def normalize_union(df: DataFrame, rules: DataFrame | Mapping[str, str],
                    max_inline: int = MAX_INLINE_RULES) -> DataFrame:
    """Add canonical keys to both maps of a union frame.

    ``rules`` is a rule frame, or a plain ``{raw: canonical}`` dict of global rules. A rule table
    of up to ``max_inline`` rows becomes literal expressions; a larger one is joined by source,
    so neither plan nor driver grows with it.
    """
    scopes = _inline_rules(rules, max_inline)
    return _normalize_joined(df, rules) if scopes is None else _normalize_inline(df, scopes)


# ---------------------------------------------------------------- union -> wide

def available_fields(df: DataFrame) -> DataFrame:
    """Every key of ``sensor_data`` over the whole frame, one row each."""
    return df.select(F.explode(F.map_keys("sensor_data")).alias("field")).distinct()


def _column_names(df: DataFrame, limit: int) -> list[str]:
    found = available_fields(df).orderBy("field").limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"more than {limit} fields: name the columns to extract, or use wide.field_object")
    return [r.field for r in found]


def from_union(df: DataFrame, columns: Iterable[str] | None = None,
               max_columns: int = 2000) -> DataFrame:
    """Union rows to one column per field, numbers preferred.

    Without ``columns`` the fields are looked up first (one aggregation over the map keys).
    """
    names = list(columns) if columns is not None else _column_names(df, max_columns)
    return df.select("ingestion_id", "timestamp", *[extract_field(n).alias(n) for n in names])


def extract_all(df: DataFrame, prefer_normalized: bool = True, max_columns: int = 2000) -> DataFrame:
    """The frame with one more column per field found in it."""
    names = _column_names(df, max_columns)
    return df.withColumns({n: extract_field(n, prefer_normalized) for n in names})


def merge_sensor_data(df: DataFrame, extra: Mapping[str, object]) -> DataFrame:
    """Add constant entries to every row's ``sensor_data``; they win over existing ones."""
    return df.withColumn("sensor_data", overlay_keys(
        F.col("sensor_data"), {k: F.lit(str(v)) for k, v in extra.items()}, "string"))


def add_enrichment_metadata(df: DataFrame, as_of: Column | None = None, site: str = "default",
                            source: Column | None = None) -> DataFrame:
    """Event and arrival time, arrival date and hour, origin and site.

    The origin is the reading's ``source_type`` where it has one, else 'mqtt'.
    """
    arrival = F.current_timestamp() if as_of is None else as_of.cast("timestamp")
    origin = source if source is not None else F.coalesce(F.col("sensor_data")["source_type"],
                                                          F.lit("mqtt"))
    return df.withColumn("event_time", F.col("timestamp")).withColumn("ingest_ts", arrival) \
        .withColumns({"ingest_date": F.to_date("ingest_ts"),
                      "ingest_hour": F.date_format("ingest_ts", "HH"),
                      "source": origin, "site": F.lit(site)})
