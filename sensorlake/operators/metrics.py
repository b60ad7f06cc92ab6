"""Rates, latencies and freshness over message and batch logs."""

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..storage import materialize

# Histogram bounds in seconds.
PIPELINE_BOUNDS = (1, 2, 5, 10, 20, 30, 60, 120, 300, 600, 1800, 3600)
STAGE_BOUNDS = (0.1, 0.5, 1, 2, 5, 10, 30, 60, 120, 300)
BATCH_BOUNDS = (0.5, 1, 2, 5, 10, 20, 30, 60, 120, 300)
DELAY_BOUNDS = (0.1, 0.5, 1, 2, 5, 10, 30, 60, 300)
MAX_LATENCY = 3600


def seconds_between(start: str | Column, end: str | Column) -> Column:
    start, end = (F.col(c) if isinstance(c, str) else c for c in (start, end))
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6


def message_rate(log: DataFrame, time: str, window: str = "5 minutes", keys: Iterable[str] = ()) -> DataFrame:
    """Messages and messages per second in each window, per ``keys``."""
    keys = list(keys)
    counted = log.groupBy(F.window(time, window).alias("_w"), *keys).agg(F.count("*").alias("messages"))
    return counted.select(F.col("_w.start").alias("window_start"), *keys, "messages",
                          (F.col("messages") / seconds_between("_w.start", "_w.end")).alias("per_second"))


def bytes_rate(log: DataFrame, time: str, payload: str, file: Column, window: str = "5 minutes") -> DataFrame:
    """Payload bytes and distinct files per window; files are counted after grouping by file."""
    by_file = log.groupBy(F.window(time, window).alias("_w"), file.alias("_file")).agg(
        F.sum(F.octet_length(payload)).alias("bytes"))
    return by_file.groupBy("_w").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("files")) \
        .select(F.col("_w.start").alias("window_start"), "bytes", "files")


def success_rate(log: DataFrame, processed: Column, keys: Iterable[str] = ()) -> DataFrame:
    """Received, processed, and their share in percent."""
    return log.groupBy(*keys).agg(
        F.count("*").alias("received"), F.count_if(processed).alias("processed"),
        F.round(F.try_divide(F.count_if(processed), F.count("*")) * 100, 2).alias("success_percent"))


def timestamp_delay(log: DataFrame, event_time: str, ingest_time: str, keys: Iterable[str] = ()) -> DataFrame:
    """Delay from event to arrival; clocks that run ahead (negative delays) do not count."""
    delay = seconds_between(event_time, ingest_time)
    return log.select(*keys, delay.alias("_d")).where("_d >= 0").groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("_d").alias("shortest"), F.max("_d").alias("longest"),
        F.round(F.avg("_d"), 6).alias("mean"))


def latency_histogram(df: DataFrame, seconds: Column, bounds: Iterable[float] = PIPELINE_BOUNDS,
                      keys: Iterable[str] = ()) -> DataFrame:
    """Cumulative counts per upper bound ``le`` (null: all). One aggregate, then unpivoted."""
    bounds, keys = list(bounds), list(keys)
    value = F.col("_s")
    counts = df.select(*keys, seconds.alias("_s")).where("_s is not null").groupBy(*keys).agg(
        *[F.count_if(value <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count("*").alias("all"))
    buckets = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n"))
                        for i, b in enumerate(bounds)],
                      F.struct(F.lit(None).cast("double").alias("le"), F.col("all").alias("n")))
    return counts.select(*keys, F.explode(buckets).alias("_b")).select(*keys, "_b.le", "_b.n")


#: groups up to which their bounds pass through the driver to every task; more are written and joined by a shuffle
BROADCAST_GROUPS = 10_000
#: distinct values of a segment that one task may rank
SEGMENT = 200_000


def _settled(df: DataFrame, name: str) -> tuple[DataFrame, list[dict] | None]:
    """The rows once and for all, to be broadcast if they are few; then they come along as a list."""
    rows = df.limit(BROADCAST_GROUPS + 1).toArrow()
    if rows.num_rows <= BROADCAST_GROUPS:
        return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)), rows.to_pylist()
    return materialize(df, name), None


def _bounds(rows: DataFrame, groups: list[str], shares: list[float], accuracy: int) -> DataFrame:
    """(groups, n, t0, t1, ...): rows of a group and, per share, struct(pos, low, high): a rank and values around it, null where
    a sketch knows none."""
    points = sorted({min(max(p + d, 0.0), 1.0) for p in shares for d in (-2.0 / accuracy, 2.0 / accuracy)})

    def target(p: float) -> Column:
        low = max((i for i, x in enumerate(points) if x <= p - 1.0 / accuracy), default=None)
        high = min((i for i, x in enumerate(points) if x >= p + 1.0 / accuracy), default=None)
        low, high = (F.lit(None).cast("double") if i is None else F.col("_cuts")[i] for i in (low, high))
        return F.struct((F.lit(p) * (F.col("n") - 1)).alias("pos"), low.alias("low"), high.alias("high"))

    cuts = rows.groupBy(*groups).agg(F.count("*").alias("n"), F.percentile_approx("_v", points, accuracy).alias("_cuts"))
    return cuts.select(*groups, "n", *[target(p).alias(f"t{i}") for i, p in enumerate(shares)])


def _within(target: str) -> Column:
    low, high = F.col(f"{target}.low"), F.col(f"{target}.high")
    return (low.isNull() | (F.col("_v") >= low)) & (high.isNull() | (F.col("_v") <= high))


def _counted(bounds: DataFrame, rows: DataFrame, groups: list[str], ts: list[str]) -> DataFrame:
    """Targets with the rows below and between their bounds; bounds that miss their rank are given up."""
    counts = rows.join(bounds, groups).groupBy(*groups).agg(*[c for t in ts for c in (
        F.count_if(F.col("_v") < F.col(f"{t}.low")).alias(f"{t}_below"), F.count_if(_within(t)).alias(f"{t}_inside"))])
    state, none = bounds.join(counts, groups), F.lit(None).cast("double")
    for t in ts:
        pos, below, inside = F.col(f"{t}.pos"), F.col(f"{t}_below"), F.col(f"{t}_inside")
        caught = (below <= F.floor(pos)) & (F.ceil(pos) < below + inside)
        state = state.withColumn(t, F.struct(
            pos.alias("pos"), *[F.when(caught, F.col(f"{t}.{c}")).otherwise(none).alias(c) for c in ("low", "high")],
            F.when(caught, below).otherwise(0).alias("below"), F.when(caught, inside).otherwise(F.col("n")).alias("inside")))
    return state.select(*groups, *ts)


def _narrowed(values: DataFrame, wanted: DataFrame, groups: list[str], segment: int) -> tuple[DataFrame, DataFrame]:
    """Distinct values with their counts, cut into cells of equally many until the cells that hold a rank are small."""
    grid = [i / 64 for i in range(65)]
    before = W.partitionBy(*groups).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    while True:
        values = materialize(values, "percentile-values")
        if (values.groupBy(*groups).count().agg(F.max("count")).first()[0] or 0) <= segment:
            return values, wanted
        cuts = values.groupBy(*groups).agg(F.percentile_approx("_v", grid, 1000).alias("_cuts"))
        cells = values.join(cuts, groups).withColumn("_cell", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
        sizes = cells.groupBy(*groups, "_cell").agg(F.sum("_c").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        kept = sizes.join(wanted, groups).where((F.floor("_pos") < F.col("_start") + F.col("_n")) & (F.ceil("_pos") >= F.col("_start")))
        first = kept.groupBy(*groups).agg(F.min("_start").alias("_from"), F.max("_pos").alias("_pos"))
        values = cells.join(kept.select(*groups, "_cell"), [*groups, "_cell"], "left_semi").drop("_cell")
        wanted = materialize(first.select(*groups, (F.col("_pos") - F.col("_from")).alias("_pos")), "percentile-ranks")


def exact_percentiles(df: DataFrame, value: str, shares: Mapping[str, float], keys: Iterable[str] = (),
                      accuracy: int = 1000, segment: int = SEGMENT, costly: bool = False) -> DataFrame:
    """Interpolated percentiles, exact, by distributed selection.

    A sketch gives values around every wanted rank; the rows below and between them are counted where they are, and only
    those between are shuffled, as distinct values with their counts. Segments of more than ``segment``
    distinct values are narrowed by further pivots before they are ranked. A rank that the sketch missed takes its whole group
    along, so the sketch never decides the answer. The input is read three times; a ``costly`` one is read once and its keys and
    values written down.
    """
    keys, names = list(keys), list(shares)
    groups = keys or ["_all"]
    rows = df.select(*(keys or [F.lit(0).alias("_all")]), F.col(value).cast("double").alias("_v")).where("_v is not null")
    rows = materialize(rows, "percentile-input") if costly else rows
    ts = [f"t{i}" for i in range(len(names))]
    bounds, _ = _settled(_bounds(rows, groups, list(shares.values()), accuracy), "percentile-bounds")
    state, few = _settled(_counted(bounds, rows, groups, ts), "percentile-state")
    if few is None:
        largest = state.select(F.greatest(*[F.col(f"{t}.inside") for t in ts], F.lit(0)).alias("n")).agg(F.max("n")).first()[0] or 0
    else:
        largest = max((r[t]["inside"] for r in few for t in ts), default=0)
    hits = F.filter(F.array(*[F.when(_within(t), F.lit(i)) for i, t in enumerate(ts)]), lambda i: i.isNotNull())
    values = (rows.join(state, groups).select(*groups, "_v", F.explode(hits).alias("_t"))
              .groupBy(*groups, "_t", "_v").agg(F.count("*").alias("_c")))
    ranks = F.array(*[F.struct(F.lit(i).alias("_t"), (F.col(f"{t}.pos") - F.col(f"{t}.below")).alias("_pos")) for i, t in enumerate(ts)])
    wanted = state.select(*groups, F.explode(ranks).alias("_w")).select(*groups, "_w.*")
    own = [*groups, "_t"]
    if largest > segment:
        values, wanted = _narrowed(values, wanted, own, segment)

    upto = W.partitionBy(*own).orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = values.withColumn("_next", F.sum("_c").over(upto)).join(wanted if few is None else F.broadcast(wanted), own)

    def holds(rank: Column) -> Column:
        return F.when((F.col("_next") - F.col("_c") <= rank) & (rank < F.col("_next")), F.col("_v"))

    low, high = F.max(holds(F.floor("_pos"))), F.max(holds(F.ceil("_pos")))
    share = F.max("_pos") - F.floor(F.max("_pos"))
    by_target = ranked.groupBy(*own).agg((low + (high - low) * share).alias("_p"))
    columns = [F.max(F.when(F.col("_t") == i, F.col("_p"))).alias(n) for i, n in enumerate(names)]
    return by_target.groupBy(*keys).agg(*columns)


def latency_percentiles(df: DataFrame, seconds: Column, keys: Iterable[str] = ()) -> DataFrame:
    """p50, p95 and p99 of a latency."""
    keys = list(keys)
    return exact_percentiles(df.select(*keys, seconds.alias("_seconds")), "_seconds",
                             {"p50": 0.5, "p95": 0.95, "p99": 0.99}, keys, costly=True)


def gold_latency(gold: DataFrame, as_of: Column, last: int = 5) -> DataFrame:
    """Age of the newest gold rows: since window start and since earliest enrichment, 0..3600 s."""
    newest = gold.orderBy(F.desc("time_start"), "sensorId").limit(last)

    def age(name: str) -> Column:
        seconds = seconds_between(F.col(name), as_of)
        return F.when(seconds.between(0, MAX_LATENCY), seconds)
    return newest.select("sensorId", "time_start", age("time_start").alias("sensor_to_gold"),
                         age("min_enrichment_ts").alias("enrichment_to_gold"))


def top_rules(usage: DataFrame, n: int = 10) -> DataFrame:
    """The raw keys with most rule applications."""
    return usage.groupBy("raw_key").agg(F.sum("applied_count").alias("total")) \
        .orderBy(F.desc("total"), "raw_key").limit(n)


def batch_status(log: DataFrame, status: str) -> DataFrame:
    return log.groupBy(status).agg(F.count("*").alias("batches"))


def step_durations(log: DataFrame, step: str, time: Column, seconds: Column) -> DataFrame:
    """Latest duration of every step, longest first."""
    return log.groupBy(step).agg(F.max_by(seconds, time).alias("last_seconds")) \
        .orderBy(F.desc("last_seconds"), step)


def layer_freshness(layers: Mapping[str, tuple[DataFrame, str]], as_of: Column) -> DataFrame:
    """Age in seconds of the newest row of each layer, given as ``{name: (frame, time column)}``."""
    out = None
    for name, (frame, time) in layers.items():
        row = frame.agg(F.max(time).alias("newest")).select(
            F.lit(name).alias("layer"), "newest", seconds_between(F.col("newest"), as_of).alias("age_seconds"))
        out = row if out is None else out.unionByName(row)
    return out
