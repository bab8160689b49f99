"""Descriptive analytics of log events: DataFrame in, tidy DataFrame out.

Every operator is one pass of partial and final hash aggregation; ties are broken by value
or by the smallest id, so results don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cindertrail.functions.cleaning import with_scalars
from cindertrail.functions.logcols import LEVELS, in_ms, is_error, normalize_message, ts_ms
from cindertrail.operators.incidents import detect_incidents
from cindertrail.session import materialise

#: Range presets: milliseconds and number of buckets.
RANGES = {"5m": (300_000, 10), "15m": (900_000, 10), "1h": (3_600_000, 12), "6h": (21_600_000, 24), "24h": (86_400_000, 24)}


def preset(name: str | None) -> tuple[int, int]:
    return RANGES.get(name or "1h", RANGES["1h"])


def _pct(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(part * 100.0 / whole)


def _counts() -> list[Column]:
    n, bad = F.count("*"), F.count_if(is_error(F.col("level")))
    return [n.alias("events"), bad.alias("errors"), F.count_if(F.col("level") == "WARN").alias("warnings"), _pct(bad, n).alias("error_rate_pct")]


def severity_distribution(events: DataFrame) -> DataFrame:
    """level, ord, events of the six levels, zero-filled."""
    spark = events.sparkSession
    scale = spark.createDataFrame([(name, i) for i, name in enumerate(LEVELS)], "level string, ord int")
    return scale.join(events.groupBy("level").agg(F.count("*").alias("events")), "level", "left").select("level", "ord", F.coalesce("events", F.lit(0)).cast("long").alias("events"))


def frequency_analysis(events: DataFrame) -> DataFrame:
    """dimension, key, events by level, service, status (0 skipped) and endpoint, in one pass of grouping sets."""
    dims = ("level", "service", "status", "endpoint")
    d = events.select("level", "service", F.nullif(F.col("status"), F.lit(0)).cast("string").alias("status"), "endpoint")
    g = d.groupingSets([[F.col(c)] for c in dims], *[F.col(c) for c in dims]).agg(F.grouping_id().alias("g"), F.count("*").alias("events"))
    name = F.when(F.col("g") == 7, "level").when(F.col("g") == 11, "service").when(F.col("g") == 13, "status").otherwise("endpoint")
    return g.select(name.alias("dimension"), F.coalesce(*dims).alias("key"), "events").where("key is not null")


def response_summary(events: DataFrame) -> DataFrame:
    """Sum, least, most and average response time, unrecorded zeros included."""
    rt = F.coalesce(F.col("response_ms"), F.lit(0))
    return events.agg(
        F.count("*").alias("events"), F.coalesce(F.sum(rt), F.lit(0)).alias("sum_ms"), F.coalesce(F.min(rt), F.lit(0)).alias("min_ms"),
        F.coalesce(F.max(rt), F.lit(0)).alias("max_ms"), F.coalesce(F.sum(rt) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("avg_ms"),
    )


def dataset_stats(events: DataFrame) -> DataFrame:
    """One row: totals, distinct services and addresses, mean recorded latency, requests per minute."""
    ms = ts_ms()
    minutes = (F.max(ms) - F.min(ms)) / 60_000.0
    return events.agg(
        F.count("*").alias("total_logs"),
        F.count_if(is_error(F.col("level"))).alias("errors"),
        F.count_if(F.col("level") == "WARN").alias("warnings"),
        F.count_distinct("service").alias("services"),
        F.count_distinct("ip").alias("unique_ips"),
        F.coalesce(F.avg(F.when(F.col("response_ms") > 0, F.col("response_ms"))), F.lit(0.0)).alias("avg_response_ms"),
        F.coalesce(F.count("*") / F.nullif(minutes, F.lit(0.0)), F.lit(0.0)).alias("requests_per_minute"),
    )


def service_rollup(events: DataFrame, limit: int | None = None, service: str | None = None) -> DataFrame:
    """Per service: events, errors, warnings, error percentage, hosts, latest time."""
    e = events if service is None else events.where(F.col("service") == service)
    out = e.groupBy(F.coalesce("service", F.lit("(unknown)")).alias("name")).agg(
        *_counts(), F.count_distinct("host").alias("hosts"), F.max(ts_ms()).alias("latest_ms"), F.min("id").alias("first_id")
    )
    out = out if limit is None else out.orderBy(F.desc("events"), "first_id").limit(limit)
    return out.drop("first_id")


def service_severity(events: DataFrame) -> DataFrame:
    return events.groupBy(F.coalesce("service", F.lit("(unknown)")).alias("name"), "level").agg(F.count("*").alias("events")).where("level is not null")


def host_rollup(events: DataFrame, limit: int | None = None) -> DataFrame:
    out = events.groupBy(F.coalesce("host", F.lit("(no host)")).alias("host")).agg(*_counts(), F.min("id").alias("first_id"))
    out = out if limit is None else out.orderBy(F.desc("events"), "first_id").limit(limit)
    return out.drop("first_id")


def value_ranks(events: DataFrame, by: list[str], probs: dict[str, float], value: str = "response_ms") -> DataFrame:
    """by, sampled, largest and per name the value at its nearest rank, from the counts of the distinct values.

    Rows are folded to value counts before they are sorted, so a group costs its distinct values.
    """
    counts = events.groupBy(*by, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    counts = counts.withColumn("upto", F.sum("n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(w))
    at = [F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * F.lit(p)), F.col(value))).alias(name) for name, p in probs.items()]
    return counts.groupBy(*by).agg(F.coalesce(F.max("all"), F.lit(0)).alias("sampled"), F.max(value).alias("largest"), *at)


def latency_percentiles(events: DataFrame, by: str = "service") -> DataFrame:
    """Nearest-rank p50, p95, p99 over recorded (positive) response times."""
    return value_ranks(events.where("response_ms > 0"), [by], {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}).drop("largest")


def http_rows(events: DataFrame) -> DataFrame:
    return events.where(F.col("http_method").isNotNull() | (F.coalesce("status", F.lit(0)) != 0))


def http_stats(events: DataFrame, endpoints: int = 10) -> DataFrame:
    """section, key, value over HTTP rows: statuses, methods, top endpoints, latency figures."""
    h = http_rows(events)

    def counts(section: str, key: Column) -> DataFrame:
        return h.groupBy(key.cast("string").alias("key")).agg(F.count("*").alias("value")).where("key is not null").select(F.lit(section).alias("section"), "key", "value")

    status = counts("status", F.nullif(F.col("status"), F.lit(0)))
    top = counts("endpoint", F.col("endpoint")).orderBy(F.desc("value"), F.desc("key")).limit(endpoints)
    ranks = value_ranks(h.where("response_ms > 0"), [], {"p50": 0.5, "p95": 0.95})
    latency = ranks.select(*[F.coalesce(c, F.lit(0)).alias(c) for c in ("p50", "p95")], F.coalesce("largest", F.lit(0)).alias("max"), "sampled")
    figures = latency.unpivot([], ["p50", "p95", "max", "sampled"], "key", "value").select(F.lit("latency").alias("section"), "key", "value")
    return status.unionByName(counts("method", F.col("http_method"))).unionByName(top).unionByName(figures)


def top_error(events: DataFrame) -> DataFrame:
    """The most frequent message among ERROR rows; ties go to the smallest message."""
    return events.where("level = 'ERROR'").groupBy("message").agg(F.count("*").alias("events")).orderBy(F.desc("events"), "message").limit(1)


def top_errors(events: DataFrame, limit: int = 10) -> DataFrame:
    """Most frequent messages among ERROR and WARN rows."""
    return events.where(F.col("level").isin("ERROR", "WARN")).groupBy("message").agg(F.count("*").alias("events")).orderBy(F.desc("events"), "message").limit(limit)


def top_k(events: DataFrame, dimension: str, limit: int = 10) -> DataFrame:
    """key, events of the most frequent values; ties in descending order of the key."""
    return events.where(F.col(dimension).isNotNull()).groupBy(F.col(dimension).alias("key")).agg(F.count("*").alias("events")).orderBy(F.desc("events"), F.desc("key")).limit(limit)


def histogram(events: DataFrame, dimension: str) -> DataFrame:
    return events.where(F.trim(F.col(dimension)) != "").groupBy(F.col(dimension).alias("key")).agg(F.count("*").alias("events"))


def distinct_services(events: DataFrame) -> DataFrame:
    """service, first_id: the services in order of first appearance."""
    return events.where("service is not null").groupBy("service").agg(F.min("id").alias("first_id"))


def hour_weekday_heatmap(events: DataFrame) -> DataFrame:
    """weekday (Monday 0), hour, events in UTC, all 168 cells."""
    spark = events.sparkSession
    grid = spark.range(168).select((F.col("id") / 24).cast("int").alias("weekday"), (F.col("id") % 24).cast("int").alias("hour"))
    secs = F.floor(ts_ms() / 1000)
    days = F.floor(secs / 86_400)
    cells = events.where("ts is not null").groupBy(F.pmod(days + 3, F.lit(7)).cast("int").alias("weekday"), F.floor(F.pmod(secs, F.lit(86_400)) / 3600).cast("int").alias("hour"))
    return grid.join(cells.agg(F.count("*").alias("events")), ["weekday", "hour"], "left").select("weekday", "hour", F.coalesce("events", F.lit(0)).cast("long").alias("events"))


def _densify(filled: DataFrame, shape: DataFrame, buckets: int, extra: list[Column]) -> DataFrame:
    grid = shape.select("*", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    return grid.join(filled, "bucket", "left").select("bucket", *extra)


def time_windows(events: DataFrame, buckets: int = 10) -> DataFrame:
    """bucket, start_ms, end_ms, events, errors: equal windows over the whole span, all emitted."""
    e = events.where("ts is not null").select(ts_ms().alias("ms"), is_error(F.col("level")).alias("bad"))
    span = e.agg(F.min("ms").alias("lo"), F.max("ms").alias("hi")).where("lo is not null")
    span = span.select("lo", F.expr(f"cast(ceil((hi - lo + 1) / {buckets}) as bigint)").alias("width"))
    idx = F.least(F.lit(buckets - 1), F.expr("(ms - lo) div width")).cast("int")
    filled = with_scalars(e, span).groupBy(idx.alias("bucket")).agg(F.count("*").alias("n"), F.count_if("bad").alias("e"))
    start = F.col("lo") + F.col("bucket") * F.col("width")
    return _densify(filled, span, buckets, [start.alias("start_ms"), (start + F.col("width") - 1).alias("end_ms"), F.coalesce("n", F.lit(0)).cast("long").alias("events"), F.coalesce("e", F.lit(0)).cast("long").alias("errors")])


def range_buckets(events: DataFrame, from_ms: int, to_ms: int, buckets: int) -> DataFrame:
    """Buckets of [from, to], ``to`` included; what the width leaves over goes to the last one."""
    spark = events.sparkSession
    width = max(1, (to_ms - from_ms) // buckets)
    e = events.where(in_ms(from_ms, to_ms, closed=True)).select(ts_ms().alias("ms"), is_error(F.col("level")).alias("bad"))
    idx = F.least(F.lit(buckets - 1), F.expr(f"(ms - {from_ms}) div {width}")).cast("int")
    filled = e.groupBy(idx.alias("bucket")).agg(F.count("*").alias("n"), F.count_if("bad").alias("e"))
    shape = spark.createDataFrame([(from_ms, width)], "lo long, width long")
    start = F.col("lo") + F.col("bucket") * F.col("width")
    return _densify(filled, shape, buckets, [start.alias("start_ms"), (start + F.col("width")).alias("end_ms"), F.coalesce("n", F.lit(0)).cast("long").alias("events"), F.coalesce("e", F.lit(0)).cast("long").alias("errors")])


def latest_window(events: DataFrame, range_ms: int) -> DataFrame:
    """Rows of the closed window [latest - range, latest], anchored on the data."""
    last = events.agg((F.max(ts_ms()) - range_ms).alias("since"))
    return events.where(in_ms(last.scalar()))


def service_activity(events: DataFrame, service: str, hours: int = 24) -> DataFrame:
    """The last ``hours`` hours up to the data's end, by hour, of one service."""
    span = events.agg((F.max(ts_ms()) + 1).alias("stop")).where("stop is not null").withColumn("lo", F.col("stop") - hours * 3_600_000)
    mine = events.where(F.col("service") == service).select(ts_ms().alias("ms"), is_error(F.col("level")).alias("bad"))
    inside = with_scalars(mine, span).where("ms >= lo and ms < stop")
    filled = inside.groupBy(F.expr("cast((ms - lo) div 3600000 as int)").alias("bucket")).agg(F.count("*").alias("n"), F.count_if("bad").alias("e"))
    return _densify(filled, span, hours, [(F.col("lo") + F.col("bucket") * 3_600_000).alias("start_ms"), F.coalesce("n", F.lit(0)).cast("long").alias("events"), F.coalesce("e", F.lit(0)).cast("long").alias("errors")])


def recent_events(events: DataFrame, service: str | None = None, limit: int = 50) -> DataFrame:
    e = events if service is None else events.where(F.col("service") == service)
    return e.orderBy(F.desc_nulls_last("ts"), "id").limit(max(1, min(500, limit)))


def recent_critical(events: DataFrame, limit: int = 12) -> DataFrame:
    return events.where(is_error(F.col("level"))).orderBy(F.desc("ts"), F.desc("id")).limit(limit)


def message_patterns(events: DataFrame, limit: int | None = None, level: str | None = None) -> DataFrame:
    """template, count, example and its level (of the smallest id)."""
    if level and level.lower() != "all":
        if level.upper() not in LEVELS:
            raise ValueError(f"unknown level {level!r}")
        events = events.where(F.col("level") == level.upper())
    g = events.where("message is not null").groupBy(normalize_message(F.col("message")).alias("template"))
    out = g.agg(F.count("*").alias("count"), F.min("id").alias("first_id"), F.min_by("message", "id").alias("example"), F.min_by("level", "id").alias("level"))
    return out if limit is None else out.orderBy(F.desc("count"), "first_id").limit(limit)


def pattern_examples(events: DataFrame, template: str, limit: int = 20) -> DataFrame:
    if len(template) > 2000 or not 1 <= limit <= 200:
        raise ValueError("template of at most 2000 characters, limit of 1 to 200")
    return events.where(normalize_message(F.col("message")) == template).orderBy("id").limit(limit)


def overview(events: DataFrame, range_name: str = "24h", services: int = 6, patterns: int = 8, critical: int = 12) -> DataFrame:
    """section, key, value of the latest window: totals, severity, top services and patterns, statuses, timeline, latest errors, incidents, heatmap.

    One pass of grouping sets counts everything; latest errors and incidents read the window's errors only.
    """
    range_ms, buckets = preset(range_name)
    w = latest_window(events, range_ms)
    span = events.agg((F.max(ts_ms()) - range_ms).alias("lo"))
    width = max(1, range_ms // buckets)
    secs = F.floor(ts_ms() / 1000)
    cols = {
        "level": F.col("level"), "service": F.coalesce("service", F.lit("(unknown)")), "host": F.col("host"), "pattern": normalize_message(F.col("message")),
        "status": F.nullif(F.col("status"), F.lit(0)).cast("string"), "timeline": F.least(F.lit(buckets - 1), F.expr(f"(unix_millis(ts) - lo) div {width}")).cast("string"),
        "heatmap": F.concat_ws("/", F.pmod(F.floor(secs / 86_400) + 3, F.lit(7)).cast("string"), F.floor(F.pmod(secs, F.lit(86_400)) / 3600).cast("string")),
    }
    e = with_scalars(w, span).select("id", F.col("service").isNotNull().alias("named"), *[c.alias(n) for n, c in cols.items()])
    g = e.groupingSets([[F.col(n)] for n in cols], *[F.col(n) for n in cols])
    g = g.agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.min("id").alias("first_id"), F.count_if("named").alias("named"))
    whole = (1 << len(cols)) - 1
    dim = F.lit(None).cast("string")
    for i, n in enumerate(cols):
        dim = F.when(F.col("g") == whole - (1 << (len(cols) - 1 - i)), n).otherwise(dim)
    g = materialise(g.select(dim.alias("dim"), F.coalesce(*cols).alias("key"), "n", "first_id", "named").where("key is not null"), "overview")

    def part(section: str, df: DataFrame, key: Column = F.col("key"), value: Column = F.col("n")) -> DataFrame:
        return df.select(F.lit(section).alias("section"), key.cast("string").alias("key"), value.cast("double").alias("value"))

    def of(name: str) -> DataFrame:
        return g.where(F.col("dim") == name)

    def top(name: str, limit: int) -> DataFrame:
        return of(name).orderBy(F.desc("n"), "first_id").limit(limit)

    spark = events.sparkSession
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("double")
    totals = g.agg(
        total(F.col("dim") == "service").alias("events"), total((F.col("dim") == "level") & F.col("key").isin("ERROR", "FATAL")).alias("errors"),
        total((F.col("dim") == "level") & (F.col("key") == "WARN")).alias("warnings"),
        F.count_if((F.col("dim") == "service") & (F.col("named") > 0)).cast("double").alias("services"), F.count_if(F.col("dim") == "host").cast("double").alias("hosts"),
    )
    totals = totals.withColumn("events_per_minute", F.col("events") / (range_ms / 60_000))
    levels = spark.createDataFrame([(name,) for name in LEVELS], "level string").join(of("level"), F.col("level") == F.col("key"), "left")
    grid = spark.range(168).select(F.concat_ws("/", F.floor(F.col("id") / 24).cast("string"), (F.col("id") % 24).cast("string")).alias("cell"))
    out = part("totals", totals.unpivot([], totals.columns, "key", "n"))
    for p in (
        part("severity", levels, F.col("level"), F.coalesce("n", F.lit(0))),
        part("service", top("service", services)),
        part("pattern", top("pattern", patterns)),
        part("status", of("status")),
        part("timeline", of("timeline")),
        part("heatmap", grid.join(of("heatmap"), F.col("cell") == F.col("key"), "left"), F.col("cell"), F.coalesce("n", F.lit(0))),
        part("critical", recent_critical(w, critical), F.col("id"), ts_ms()),
        part("incident", detect_incidents(w), F.concat_ws("-", F.col("start_ms").cast("string"), F.col("end_ms").cast("string")), F.col("errors")),
    ):
        out = out.unionByName(p)
    return out
