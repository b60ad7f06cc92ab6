"""User-defined value rules: filter, convert, validate, aggregate a field.

A rule is a dict ``{id, ingestion_id, field_name, transformation_type, config, order_priority,
enabled}``. Rules work on a column of that name or, failing that, on the field of a union row;
results on union rows are written back to the maps at the end. A rule with an ``ingestion_id``
touches only the rows of that source.
"""

import json
import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import extract_field, overlay_keys
from ..functions.fields import NUMERIC_TEXT

# Rule vocabulary.
COMPARISONS = (">", ">=", "<", "<=", "==", "!=")
TRUE_TEXTS = ("true", "1", "yes", "on")
FALSE_TEXTS = ("false", "0", "no", "off")
REQUIRED_CONFIG = {
    "filter": ("operator", "value"),
    "aggregate": ("function", "window"),
    "convert": ("operation",),
    "validate": ("validation_rules",),
}

# strptime directives and the Spark pattern letters for them
_DATE_LETTERS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss",
                 "%f": "SSSSSS", "%y": "yy", "%z": "XXX", "%b": "MMM", "%j": "DDD", "%p": "a",
                 "%I": "hh"}


# ---------------------------------------------------------------- rules

def check_transformation(kind: str, config: Mapping) -> None:
    """Raise ValueError if the config lacks what its rule type needs."""
    if kind not in REQUIRED_CONFIG:
        raise ValueError(f"unknown transformation type {kind!r}")
    missing = [k for k in REQUIRED_CONFIG[kind] if k not in config]
    if kind == "convert" and not missing:
        operation = config["operation"]
        if operation == "type_conversion":
            missing = [k for k in ("target_type",) if k not in config]
        elif operation == "mathematical":
            missing = [k for k in ("math_operation",) if k not in config]
            if "operand" not in config and "operand_field" not in config:
                missing.append("operand or operand_field")
        else:
            raise ValueError(f"unknown convert operation {operation!r}")
    if missing:
        raise ValueError(f"{kind} rule lacks {', '.join(missing)}")


def order_rules(rules: Iterable[Mapping], ingestion_id: str | None = None) -> list[dict]:
    """Enabled rules for all sources (or global ones plus those of one source), in the order they
    apply. Configs given as JSON text are decoded; a rule whose config is not valid is left out."""
    chosen = []
    for rule in rules:
        if not rule.get("enabled", True):
            continue
        if ingestion_id is not None and rule.get("ingestion_id") not in (None, ingestion_id):
            continue
        config = rule["config"]
        try:
            config = json.loads(config) if isinstance(config, str) else config
        except ValueError:
            continue
        chosen.append({**rule, "config": config})
    return sorted(chosen, key=lambda r: (r.get("order_priority", 100), r.get("id", 0)))


def spark_date_format(pattern: str) -> str:
    """A strptime pattern as a Spark one; a pattern without ``%`` is already Spark's."""
    if "%" not in pattern:
        return pattern
    quoted = pattern.replace("T", "'T'")
    for directive, letters in _DATE_LETTERS.items():
        quoted = quoted.replace(directive, letters)
    return quoted


# ---------------------------------------------------------------- predicates

def _compare(value: Column, operator: str, operand, text: Column | None = None) -> Column:
    """Comparison that is null, not an error, where a value is not comparable. A text operand is
    compared with the field's text, unless both are numbers."""
    text = value.cast("string") if text is None else text
    if isinstance(operand, bool):
        return _ordered(F.lower(text), operator, str(operand).lower())
    if isinstance(operand, str):
        as_text = _ordered(text, operator, operand)
        if re.match(NUMERIC_TEXT, operand) is None:
            return as_text
        return F.coalesce(_ordered(value.try_cast("double"), operator, float(operand)), as_text)
    return _ordered(value.try_cast("double"), operator, operand)


def _ordered(value: Column, operator: str, operand) -> Column:
    other = F.lit(operand)
    return {">": value > other, ">=": value >= other, "<": value < other, "<=": value <= other,
            "==": value == other, "!=": value != other}[operator]


def filter_condition(value: Column, config: Mapping, text: Column | None = None) -> Column:
    """Predicate of a filter rule. ``contains`` and ``regex`` look at the field's text."""
    operator, operand = config["operator"], config["value"]
    text = value.cast("string") if text is None else text
    if operator in COMPARISONS:
        return _compare(value, operator, operand, text)
    if operator == "contains":
        if config.get("case_sensitive", False):
            return text.contains(str(operand))
        return F.lower(text).contains(str(operand).lower())
    if operator == "regex":
        return text.rlike(str(operand))
    raise ValueError(f"unknown filter operator {operator!r}")


def validation_condition(value: Column, checks: Iterable[Mapping],
                         text: Column | None = None) -> Column | None:
    """All checks ANDed; a comparison with a missing value stays null."""
    text = value.cast("string") if text is None else text
    parts = []
    for check in checks:
        kind, params = check.get("rule"), check.get("params", {})
        if kind == "range":
            if params.get("min") is not None:
                parts.append(_compare(value, ">=", params["min"], text))
            if params.get("max") is not None:
                parts.append(_compare(value, "<=", params["max"], text))
        elif kind == "regex" and params.get("pattern"):
            parts.append(text.rlike(params["pattern"]))
        elif kind == "enum" and params.get("values"):
            allowed = params["values"]
            numeric = all(isinstance(a, (int, float)) for a in allowed)
            parts.append((value.try_cast("double") if numeric else text).isin(allowed))
        elif kind == "not_null":
            parts.append(value.isNotNull())
    condition = None
    for part in parts:
        condition = part if condition is None else condition & part
    return condition


# ---------------------------------------------------------------- values

def converted(value: Column, config: Mapping) -> Column:
    """Type conversion; failures become null, or the default."""
    target, default = config["target_type"], config.get("default_value")
    text = F.lower(value.cast("string"))
    if target in ("string", "float"):
        out = value.try_cast(target)
    elif target == "int":
        # decimal text is cut, as a number would be; exponents do not count as integers
        decimal = F.when(text.rlike(r"^\s*[+-]?\d*\.?\d*\s*$"), text.try_cast("double"))
        out = F.coalesce(value.try_cast("int"), decimal.try_cast("int"))
    elif target == "boolean":
        out = F.when(text.isin(*TRUE_TEXTS), True).when(text.isin(*FALSE_TEXTS), False)
    elif target == "datetime":
        pattern = config.get("format")
        args = [F.lit(spark_date_format(pattern))] if pattern else []
        out = F.try_to_timestamp(value.cast("string"), *args)
    else:
        raise ValueError(f"unknown target type {target!r}")
    if default is None:
        return out
    kind = {"datetime": "timestamp"}.get(target, target)
    return F.coalesce(out, F.lit(default).cast(kind))


def calculated(value: Column, config: Mapping, operand: Column) -> Column:
    """Arithmetic; division and remainder by zero are null."""
    number, operand = value.try_cast("double"), operand.try_cast("double")
    operation = config["math_operation"]
    if operation == "add":
        return number + operand
    if operation == "subtract":
        return number - operand
    if operation == "multiply":
        return number * operand
    if operation == "divide":
        return F.try_divide(number, operand)
    if operation == "modulo":
        return F.try_mod(number, operand)
    if operation == "power":
        return F.pow(number, operand)
    raise ValueError(f"unknown operation {operation!r}")


# ---------------------------------------------------------------- the chain

def _is_union(df: DataFrame) -> bool:
    return {"sensor_data", "normalized_data"} <= set(df.columns)


def _field_text(df: DataFrame, name: str, temporary: bool) -> Column | None:
    """Text of a field nobody has changed yet; numbers alone would hide words."""
    return extract_field(name, prefer_normalized=False) if temporary else None


def _only_for(rule: Mapping) -> Column | None:
    source = rule.get("ingestion_id")
    return None if source is None else F.col("ingestion_id") == source


def apply_transformations(df: DataFrame, rules: Iterable[Mapping], ingestion_id: str | None = None,
                          on_missing: str = "drop", usage: dict[int, Observation] | None = None) -> DataFrame:
    """Run every rule, field by field in rule order, as one lazy plan.

    ``usage`` is filled with an observation per rule id: ``n`` rows of its sources had the field when the rule came to
    them. Whatever action runs the plan makes these counts, at no pass of their own.

    ``on_missing`` says what a filter (or a dropping validation) does to rows without the field:
    'drop' removes them, 'keep' lets other devices' rows pass, 'skip' ignores the rule if no row
    of the whole (batch) frame has the field and drops otherwise.
    """
    if on_missing not in ("drop", "keep", "skip"):
        raise ValueError("on_missing is 'drop', 'keep' or 'skip'")
    by_field: dict[str, list[dict]] = {}
    for rule in order_rules(rules, ingestion_id):
        by_field.setdefault(rule["field_name"], []).append(rule)

    written: list[str] = []
    for field, field_rules in by_field.items():
        temporary = field not in df.columns
        if temporary:
            if not _is_union(df):
                continue
            df = df.withColumn(field, extract_field(field))
        touched = False
        for rule in field_rules:
            if usage is not None:
                usage[rule["id"]] = Observation()
                df = df.observe(usage[rule["id"]], F.count_if(_uses(df, field, rule, temporary and not touched)).alias("n"))
            df, changed = _apply(df, field, rule, temporary and not touched, on_missing)
            touched = touched or changed
        if temporary:
            if touched:
                written.append(field)
            else:
                df = df.drop(field)
    return write_back(df, written)


def _uses(df: DataFrame, field: str, rule: Mapping, untouched: bool) -> Column:
    """Whether a rule finds its field in a row of its source."""
    only, text = _only_for(rule), _field_text(df, field, untouched)
    present = F.col(f"`{field}`").isNotNull() if text is None else F.col(f"`{field}`").isNotNull() | text.isNotNull()
    return present if only is None else F.coalesce(only, F.lit(False)) & present


def _apply(df: DataFrame, field: str, rule: Mapping, untouched: bool,
           on_missing: str) -> tuple[DataFrame, bool]:
    """One rule; the flag says whether the field's values may have changed."""
    kind, config, only = rule["transformation_type"], rule["config"], _only_for(rule)
    value = F.col(f"`{field}`")
    text = _field_text(df, field, untouched)

    def keep_where(condition: Column) -> DataFrame:
        present = value.isNotNull() if text is None else value.isNotNull() | text.isNotNull()
        if on_missing == "keep":
            condition = condition | ~present
        elif on_missing == "skip":
            condition = condition | ~F.coalesce(df.agg(F.bool_or(present)).scalar(), F.lit(False))
        return df.where(condition if only is None else ~only | only.isNull() | condition)

    def assign(new: Column) -> DataFrame:
        return df.withColumn(field, new if only is None else F.when(only, new).otherwise(value))

    if kind == "filter":
        return keep_where(filter_condition(value, config, text)), False
    if kind == "convert":
        if config.get("operation", "type_conversion") == "mathematical":
            other = config.get("operand_field")
            if other is None:
                operand = F.lit(config["operand"])
            else:
                operand = F.col(f"`{other}`") if other in df.columns else extract_field(other)
            return assign(calculated(value, config, operand)), True
        source = value if text is None or config["target_type"] in ("int", "float") else text
        return assign(converted(source, config)), True
    if kind == "validate":
        condition = validation_condition(value, config["validation_rules"], text)
        if condition is None:
            return df, False
        on_fail = config.get("on_fail", "flag")
        if on_fail == "drop":
            return keep_where(condition), False
        if on_fail == "default":
            return assign(F.when(condition, value)), True
        flag = condition if only is None else F.when(only, condition)
        return df.withColumn(f"{field}_valid", flag), False
    if kind == "aggregate":
        # windowed aggregates change the grain, so they are a query of their own: vt_aggregate
        return df, False
    raise ValueError(f"unknown transformation type {kind!r}")


def write_back(df: DataFrame, fields: Iterable[str]) -> DataFrame:
    """Put changed fields back into the maps and drop their columns.

    Numbers go to ``normalized_data``; a value that is not a number goes to ``sensor_data`` as
    text. A null (failed validation or conversion) removes the key from ``normalized_data``.
    """
    fields = [f for f in fields if f in df.columns]
    if not fields or not _is_union(df):
        return df
    kinds = {f: df.schema[f].dataType.typeName() for f in fields}
    numbers = {f: F.col(f"`{f}`").cast("string").try_cast("double")
               if kinds[f] in ("string", "timestamp", "timestamp_ntz") else F.col(f"`{f}`").cast("double")
               for f in fields if kinds[f] != "boolean"}
    texts = {f: F.coalesce(F.when(F.col(f"`{f}`").cast("string").try_cast("double").isNull(),
                                  F.col(f"`{f}`").cast("string")), F.col("sensor_data")[f])
             for f in fields if kinds[f] in ("string", "boolean", "timestamp", "timestamp_ntz")}
    numbers.update({f: F.lit(None).cast("double") for f in fields if kinds[f] == "boolean"})
    return df.withColumns({
        "normalized_data": overlay_keys(F.col("normalized_data"), numbers, "double"),
        **({"sensor_data": overlay_keys(F.col("sensor_data"), texts, "string")} if texts else {}),
    }).drop(*fields)


# ---------------------------------------------------------------- aggregate rules

_AGGREGATES = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count,
               "stddev": F.stddev}


def vt_aggregate(df: DataFrame, field: str, config: Mapping, time: str = "timestamp") -> DataFrame:
    """``config['function']``, a name or a list of names, of a field per ``window`` and ``group_by`` keys, in one pass.

    Works on a batch or a stream; put a watermark on ``time`` first to bound a stream's state.
    """
    def get(name: str) -> Column:
        return F.col(f"`{name}`") if name in df.columns else extract_field(name)

    def key(name: str) -> Column:
        return F.col(f"`{name}`") if name in df.columns else extract_field(name, prefer_normalized=False)

    keys = list(config.get("group_by", []))
    names = [config["function"]] if isinstance(config["function"], str) else list(config["function"])
    rows = df.select(F.col(time), get(field).alias("_value"), *[key(k).alias(k) for k in keys])
    return (rows.where("_value is not null")
            .groupBy(F.window(time, config["window"]).alias("_window"), *keys)
            .agg(*[_AGGREGATES[n]("_value").alias(f"{field}_{n}") for n in names])
            .select(F.col("_window.start").alias("window_start"),
                    F.col("_window.end").alias("window_end"), *keys,
                    *[f"{field}_{n}" for n in names]))
