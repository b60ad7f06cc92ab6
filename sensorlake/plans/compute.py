"""User-written computations: ``{select, where, groupBy, orderBy, limit}`` over a data set.

A definition becomes one lazy DataFrame plan; pushdown, pruning and top-k are Catalyst's.
"""

import re
from collections.abc import Mapping
from difflib import get_close_matches

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Vocabulary of definitions.
KEYS = ("select", "where", "orderBy", "limit", "groupBy")
OPERATORS = (">", ">=", "<", "<=", "==", "!=", "contains", "IS NULL", "IS NOT NULL")
DATASETS = ("bronze", "silver", "gold", "enriched", "alerts", "sensors", "gold_temp_avg",
            "gold_alerts")
ALIASES = {
    "silver": {"temperature": "avg_temp", "ts": "time_start", "timestamp": "time_start"},
    "sensors": {"timestamp": "ts"},
    "alerts": {"timestamp": "ts"},
}
MAX_LIMIT = 10000

_NAME = r"[A-Za-z_][\w.\-]*"
_ITEM = re.compile(
    rf"""^\s*(?:
        window\(\s*(?P<time>{_NAME})\s*,\s*['"](?P<size>[^'"]+)['"](?:\s*,\s*['"](?P<slide>[^'"]+)['"])?\s*\)
            (?:\.(?P<edge>start|end))?
      | (?P<function>count|avg|min|max|sum|first|last)\(\s*(?P<argument>\*|{_NAME})\s*\)
      | (?P<column>{_NAME})
    )(?:\s+as\s+(?P<alias>\w+))?\s*$""", re.IGNORECASE | re.VERBOSE)


# ---------------------------------------------------------------- checks

def check_dataset(name: str) -> str:
    """Lower-cased data set name, or ValueError."""
    if name.lower() not in DATASETS:
        raise ValueError(f"unknown data set {name!r}; use one of {', '.join(sorted(DATASETS))}")
    return name.lower()


def check_definition(definition: Mapping) -> None:
    """Raise ValueError unless the definition is well formed."""
    if not isinstance(definition, Mapping):
        raise ValueError("a definition is an object")
    unknown = set(definition) - set(KEYS)
    if unknown:
        raise ValueError(f"unknown keys: {', '.join(sorted(unknown))}")
    for key in ("select", "where", "orderBy", "groupBy"):
        if not isinstance(definition.get(key, []), list):
            raise ValueError(f"{key} must be a list")
    for i, condition in enumerate(definition.get("where", [])):
        if not isinstance(condition, Mapping) or not {"col", "op"} <= set(condition):
            raise ValueError(f"where[{i}] needs col and op")
        if str(condition["op"]).upper() not in ("IS NULL", "IS NOT NULL") and "value" not in condition:
            raise ValueError(f"where[{i}] needs a value")
    for i, order in enumerate(definition.get("orderBy", [])):
        if not isinstance(order, Mapping) or "col" not in order:
            raise ValueError(f"orderBy[{i}] needs col")
        if str(order.get("dir", "asc")).lower() not in ("asc", "desc"):
            raise ValueError(f"orderBy[{i}].dir is asc or desc")
    if not all(isinstance(c, str) for c in definition.get("groupBy", [])):
        raise ValueError("groupBy holds column names")
    if "limit" in definition:
        limit = definition["limit"]
        if isinstance(limit, bool) or not str(limit).isdigit() or not 1 <= int(limit) <= MAX_LIMIT:
            raise ValueError(f"limit is between 1 and {MAX_LIMIT}")


def check_types(definition: Mapping, schema: T.StructType) -> list[str]:
    """Conditions whose operator or value does not suit the column's type."""
    by_kind = {"string": ("==", "!=", "contains"), "boolean": ("==", "!="),
               "number": (">", ">=", "<", "<=", "==", "!=")}
    expected = {"number": (int, float), "boolean": (bool,), "string": (str,)}
    kinds = {f.name: "string" if isinstance(f.dataType, T.StringType) else
             "boolean" if isinstance(f.dataType, T.BooleanType) else
             "number" if isinstance(f.dataType, T.NumericType) else None for f in schema.fields}
    problems = []
    for i, condition in enumerate(definition.get("where", [])):
        kind, op, value = kinds.get(condition["col"]), condition["op"], condition.get("value")
        if kind is None or op.upper() in ("IS NULL", "IS NOT NULL"):
            continue
        if op not in by_kind[kind]:
            problems.append(f"where[{i}]: {op} does not suit a {kind}")
        elif (kind != "string" or op == "contains") and (
                not isinstance(value, expected[kind])
                or (kind == "number" and isinstance(value, bool))):
            problems.append(f"where[{i}]: value should be a {kind}")
    return problems


# ---------------------------------------------------------------- select items

class _Item:
    """One entry of select or groupBy, with the data set's aliases applied to its column."""

    def __init__(self, text: str, aliases: Mapping[str, str]):
        match = _ITEM.match(str(text))
        if match is None:
            raise ValueError(f"not a column, aggregate or window: {text!r}")
        parts = match.groupdict()
        self.function = (parts["function"] or "").lower()
        self.size, self.slide, self.edge = parts["size"], parts["slide"], parts["edge"]
        source = parts["time"] or parts["argument"] or parts["column"]
        self.source = aliases.get(source, source)
        self.alias = parts["alias"]

    @property
    def is_window(self) -> bool:
        return self.size is not None

    @property
    def name(self) -> str:
        if self.alias:
            return self.alias
        if self.is_window:
            return f"time_{self.edge}" if self.edge else "window"
        leaf = self.source.split(".")[-1]
        if not self.function:
            return leaf
        return "reading_count" if self.source == "*" else f"{self.function}_{leaf}"

    @property
    def key(self) -> tuple:
        """What identifies a grouping: the column, or the window over it."""
        return (self.source, self.size, self.slide)

    def window(self) -> Column:
        args = [self.size] + ([self.slide] if self.slide else [])
        return F.window(_column(self.source), *args)

    def value(self) -> Column:
        """The item of a single row."""
        if not self.is_window:
            return _column(self.source)
        return self.window()[self.edge] if self.edge else self.window()

    def aggregate(self, order: Column | None) -> Column:
        if self.function == "count":
            return F.count("*" if self.source == "*" else _column(self.source))
        value = _column(self.source)
        if self.function in ("first", "last", ""):
            # a fixed choice: the value at the lowest (highest) order key, not the row that
            # happened to arrive first
            pick = F.max_by if self.function == "last" else F.min_by
            return pick(value, value if order is None else order)
        return {"avg": F.avg, "min": F.min, "max": F.max, "sum": F.sum}[self.function](value)


def _column(name: str) -> Column:
    """A column, or ``map.key`` / ``struct.field``; dashes are allowed in keys."""
    head, *rest = name.split(".")
    out = F.col(f"`{head}`")
    for part in rest:
        out = out[part]
    return out


# ---------------------------------------------------------------- clauses

def _check_columns(names: list[str], df: DataFrame) -> None:
    missing = [n for n in dict.fromkeys(names) if n != "*" and n.split(".")[0] not in df.columns]
    if missing:
        hints = {m: get_close_matches(m, df.columns, n=3, cutoff=0.5) for m in missing}
        raise ValueError(f"unknown column(s): {', '.join(missing)}; available: "
                         f"{', '.join(sorted(df.columns))}; close: {hints}")


def _literal(value, kind: T.DataType) -> Column:
    """A literal of the column's type, so that "30.0" compares with numbers as a number."""
    if isinstance(value, str) and not isinstance(kind, T.StringType):
        return F.lit(value).try_cast(kind)
    if not isinstance(value, str) and isinstance(kind, T.StringType):
        return F.lit(str(value))
    return F.lit(value)


def _condition(df: DataFrame, condition: Mapping, name: str) -> Column:
    op, value, column = condition["op"], condition.get("value"), _column(name)
    if op.upper() == "IS NULL":
        return column.isNull()
    if op.upper() == "IS NOT NULL":
        return column.isNotNull()
    if op == "contains":
        return column.cast("string").contains(str(value))
    if op not in OPERATORS:
        raise ValueError(f"unsupported operator: {op}")
    other = _literal(value, df.select(column.alias("c")).schema["c"].dataType)
    return {">": column > other, ">=": column >= other, "<": column < other,
            "<=": column <= other, "==": column == other, "!=": column != other}[op]


def compute(definition: Mapping, df: DataFrame, dataset: str | None = None,
            order_key: str | None = None, default_limit: int | None = None) -> DataFrame:
    """The computation as a DataFrame: where, then groupBy or select, then orderBy, then limit.

    Aggregates without groupBy summarise the whole set. ``order_key`` names the column by which
    'first' and 'last' of a group are decided (default: the value itself). Without a limit of its
    own a definition returns all rows; a caller that shows pages passes ``default_limit``.
    """
    check_definition(definition)
    limit = definition.get("limit", default_limit)

    def limited(result: DataFrame) -> DataFrame:
        return result if limit is None else result.limit(int(limit))
    aliases = ALIASES.get(dataset or "", {})
    rename = lambda name: aliases.get(name, name)
    select = [_Item(t, aliases) for t in definition.get("select") or []]
    groups = [_Item(t, aliases) for t in definition.get("groupBy") or []]
    where = [(c, rename(c["col"])) for c in definition.get("where") or []]
    made = {item.name for item in select}
    order = [(rename(o["col"]) if o["col"] not in made else o["col"],
              str(o.get("dir", "asc")).lower()) for o in definition.get("orderBy") or []]
    _check_columns([i.source for i in select + groups] + [n for _, n in where]
                   + [n for n, _ in order if n not in made], df)

    for condition, name in where:
        df = df.where(_condition(df, condition, name))
    key = _column(order_key) if order_key else None
    if groups:
        df = _grouped(df, groups, select, key)
    elif any(i.function for i in select):
        if not all(i.function for i in select):
            raise ValueError("select mixes columns and aggregates: add a groupBy")
        df = df.agg(*[i.aggregate(key).alias(i.name) for i in select])
    elif select:
        # by position: two items may share a name, and ordering columns need not be selected
        place = {i.name: f"_item{p}" for p, i in reversed(list(enumerate(select)))}
        shown = [i.value().alias(f"_item{p}") for p, i in enumerate(select)]
        unseen = [n for n in dict.fromkeys(n for n, _ in order) if n not in place]
        place |= {n: f"_sort{p}" for p, n in enumerate(unseen)}
        df = df.select(*shown, *[_column(n).alias(place[n]) for n in unseen])
        if order:
            df = df.orderBy(*[_sorted(F.col(place[n]), d) for n, d in order])
        return limited(df).select(*[F.col(f"_item{p}").alias(i.name) for p, i in enumerate(select)])
    if order:
        df = df.orderBy(*[_sorted(_column(n), d) for n, d in order])
    return limited(df)


def _sorted(column: Column, direction: str) -> Column:
    return column.desc() if direction == "desc" else column.asc()


def _grouped(df: DataFrame, groups: list[_Item], select: list[_Item],
             order: Column | None) -> DataFrame:
    keys = {g.key: f"_key{i}" for i, g in enumerate(groups)}
    grouped = df.groupBy(*[(g.window() if g.is_window else _column(g.source)).alias(keys[g.key])
                           for g in groups])
    if not select:
        return grouped.agg(F.count("*").alias("reading_count")).select(
            *[F.col(keys[g.key]).alias(g.name) for g in groups], "reading_count")
    wanted, aggregates = [], []
    for i, item in enumerate(select):
        if item.is_window or (not item.function and item.key in keys):
            if item.key not in keys:
                raise ValueError("a window in select must be in groupBy")
            key = F.col(keys[item.key])
            wanted.append((key[item.edge] if item.edge else key).alias(item.name))
        else:
            aggregates.append(item.aggregate(order).alias(f"_value{i}"))
            wanted.append(F.col(f"_value{i}").alias(item.name))
    return (grouped.agg(*aggregates) if aggregates else grouped.agg(F.lit(1).alias("_any"))) \
        .select(*wanted)


# ---------------------------------------------------------------- examples

# The example computations offered to users.
EXAMPLES = {
    "hot-temps": ("gold_temp_avg", {
        "select": ["sensorId", "avg_temp", "time_start"],
        "where": [{"col": "avg_temp", "op": ">", "value": 25}],
        "orderBy": [{"col": "avg_temp", "dir": "desc"}],
        "limit": 50}),
    "sensor-summary-table": ("enriched", {
        "select": ["ingestion_id", "sensor_data.sensorId as sensor_id",
                   "normalized_data.temperature as latest_temp",
                   "normalized_data.humidity as latest_humidity", "ingest_date", "source"],
        "where": [{"col": "ingest_date", "op": ">=", "value": "2024-08-20"}],
        "orderBy": [{"col": "ingest_ts", "dir": "desc"}],
        "limit": 100}),
    "daily-readings-summary": ("enriched", {
        "select": ["ingest_date", "ingestion_id", "COUNT(*) as reading_count",
                   "AVG(normalized_data.temperature) as avg_temperature",
                   "MIN(normalized_data.temperature) as min_temperature",
                   "MAX(normalized_data.temperature) as max_temperature",
                   "AVG(normalized_data.humidity) as avg_humidity"],
        "where": [{"col": "normalized_data.temperature", "op": "IS NOT NULL"}],
        "groupBy": ["ingest_date", "ingestion_id"],
        "orderBy": [{"col": "ingest_date", "dir": "desc"}, {"col": "reading_count", "dir": "desc"}],
        "limit": 50}),
    "alerts-keyword": ("alerts", {
        "select": ["id", "level", "message", "ts"],
        "where": [{"col": "message", "op": "contains", "value": "overheat"}],
        "orderBy": [{"col": "ts", "dir": "desc"}],
        "limit": 20}),
    "below-zero": ("sensors", {
        "where": [{"col": "metric", "op": "==", "value": "temperature"},
                  {"col": "value", "op": "<", "value": 0}],
        "orderBy": [{"col": "ts", "dir": "desc"}],
        "limit": 100}),
    "average-temperature": ("enriched", {
        "select": ["window(ingest_ts, '1 minute').start as time_start",
                   "window(ingest_ts, '1 minute').end as time_end",
                   "AVG(normalized_data.temperature) as avg_temperature",
                   "COUNT(*) as reading_count",
                   "MIN(normalized_data.temperature) as min_temperature",
                   "MAX(normalized_data.temperature) as max_temperature"],
        "where": [{"col": "normalized_data.temperature", "op": "IS NOT NULL"}],
        "groupBy": ["window(ingest_ts, '1 minute')"],
        "orderBy": [{"col": "time_start", "dir": "asc"}],
        "limit": 50}),
    "temperature-over-threshold": ("enriched", {
        "select": ["ingestion_id as sensorId", "MAX(normalized_data.temperature) as temperature",
                   "MAX(ingest_ts) as event_time",
                   "window(ingest_ts, '1 minute').start as window_start",
                   "window(ingest_ts, '1 minute').end as window_end"],
        "where": [{"col": "normalized_data.temperature", "op": "IS NOT NULL"},
                  {"col": "normalized_data.temperature", "op": ">", "value": "30.0"}],
        "groupBy": ["window(ingest_ts, '1 minute')", "ingestion_id"],
        "orderBy": [{"col": "window_start", "dir": "desc"}],
        "limit": 100}),
}
