"""Measuring helpers: matcher comparison, reduce/scan/sort sweeps, schedule analysis, run history, text commands."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Sequence
from statistics import median

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cindertrail.functions import covers, flows, textalgos
from cindertrail.functions import numbers as nums
from cindertrail.functions.logcols import overlapping_count
from cindertrail.operators import engines, parallel


def timed(action: Callable[[], object], repeats: int = 3) -> float:
    """Median seconds after one warm-up."""
    action()
    runs = []
    for _ in range(max(1, min(20, repeats))):
        t = time.perf_counter()
        action()
        runs.append(time.perf_counter() - t)
    return median(runs)


def compare_matchers(rows: DataFrame, text: str, pattern: str) -> DataFrame:
    """matcher, seconds, matches of the SQL and the Arrow matchers over a text column, fastest first."""
    plans = {
        "native": rows.select(F.coalesce(F.sum(overlapping_count(F.col(text), pattern)), F.lit(0))),
        "arrow": rows.select(F.coalesce(F.sum(F.size(engines.positions(text, F.lit(pattern)))), F.lit(0))),
        "automaton": engines.multi_pattern(rows.withColumn("id", F.lit(0)), text, [pattern]).select(F.count("*")),
    }
    out = [(name, timed(p.collect, 1), int(p.first()[0])) for name, p in plans.items()]
    return rows.sparkSession.createDataFrame(sorted(out, key=lambda r: r[1]), "matcher string, seconds double, matches long")


def sweep(spark: SparkSession, sizes: Sequence[int] = (1_000, 10_000, 100_000), repeats: int = 3, seed: int = 42) -> DataFrame:
    """operation, size, seconds of reduce, scan and sort over seeded columns."""
    rows = []
    for n in list(sizes)[:12]:
        if n > 2_000_000:
            raise ValueError("sizes of at most 2,000,000")
        df = spark.range(n).select("id", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1000)).alias("v"))
        for name, plan in (("reduce", parallel.reduce_column(df, "SUM", F.col("v"))), ("scan", parallel.scan(df, ["id"], "v")), ("sort", parallel.sorted_rows(df, ["v", "id"]))):
            rows.append((name, n, timed(lambda p=plan: p.write.format("noop").mode("overwrite").save(), repeats)))
    return spark.createDataFrame(rows, "operation string, size long, seconds double")


def work_span(task: tuple) -> tuple[float, float, list[str]]:
    """(work, span, critical path) of a schedule: ("leaf", name, cost), ("seq", *parts) or ("par", *parts)."""
    kind, *rest = task
    if kind == "leaf":
        return rest[1], rest[1], [rest[0]]
    parts = [work_span(p) for p in rest]
    work = sum(p[0] for p in parts)
    if kind == "seq":
        return work, sum(p[1] for p in parts), [n for p in parts for n in p[2]]
    best = max(parts, key=lambda p: p[1])
    return work, best[1], best[2]


class RunHistory:
    """The last runs of engines with status, result or error; the oldest go first."""

    def __init__(self, keep: int = 64):
        self.keep, self.runs, self.count = keep, OrderedDict(), 0

    def run(self, name: str, action: Callable[[], object]) -> int:
        self.count += 1
        t = time.perf_counter()
        try:
            record = {"name": name, "status": "done", "result": action()}
        except Exception as e:  # kept as the run's outcome
            record = {"name": name, "status": "failed", "error": f"{type(e).__name__}: {e}"}
        self.runs[self.count] = record | {"seconds": time.perf_counter() - t}
        while len(self.runs) > self.keep:
            self.runs.popitem(last=False)
        return self.count

    def get(self, run: int) -> dict:
        if run not in self.runs:
            raise LookupError(f"no run {run}")
        return self.runs[run]


def text_command(command: str, **args):
    """The six text commands by name."""
    if command == "PATTERN_SEARCH":
        return textalgos.occurrences(args["text"], args["pattern"])
    if command == "FUZZY_MATCH":
        lines = args["text"].split("\n")
        near = [(textalgos.edit_distance(line, args["query"]), i + 1, line) for i, line in enumerate(lines) if abs(len(line) - len(args["query"])) <= args.get("max_distance", 2)]
        return sorted(x for x in near if x[0] <= args.get("max_distance", 2))
    if command == "DOCUMENT_SIMILARITY":
        return textalgos.identity_pct(textalgos.align(args["a"].split(), args["b"].split())["columns"])
    if command == "CITATION_FLOW":
        return flows.max_flow(args["n"], args["edges"], args["source"], args["sink"])[0]
    if command == "PROJECT_SCHEDULING":
        return covers.vertex_cover(args["edges"])
    if command == "PRIME_TESTING":
        return nums.probably_prime(args["n"])
    raise LookupError(f"no command {command}")
