"""Algorithm engines over many instances: one row, or one group of rows, per problem.

Text engines are Arrow-batched column functions. Engines over a graph, a sequence or a set
system take one group of rows per instance and run it in one task; they scale with the
number of instances, and each states the largest instance it takes.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cindertrail.functions import covers, dynamic, flows, textalgos
from cindertrail.functions import numbers as nums
from cindertrail.functions.logcols import universal_hash, universal_hash_columns
from cindertrail.operators.parallel import ranked
from cindertrail.session import materialise

MAX_TEXT = 5000
MAX_EDGES = 200_000


# --- texts -------------------------------------------------------------------------------


def column_function(fn: Callable, returns: str) -> Callable[..., Column]:
    """A plain function of non-null values as an Arrow-batched column function; null in, null out."""

    def apply(*cols: Column | str) -> Column:
        if len(cols) == 1:

            @F.pandas_udf(returns)
            def one(a: pd.Series) -> pd.Series:
                return pd.Series([None if x is None else fn(x) for x in a], dtype=object)

            return one(*cols)

        @F.pandas_udf(returns)
        def two(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([None if x is None or y is None else fn(x, y) for x, y in zip(a, b)], dtype=object)

        return two(*cols)

    return apply


positions = column_function(textalgos.occurrences, "array<int>")
hash_positions = column_function(lambda t, p: textalgos.hash_matches(t, p, mods=(1_000_000_007, 1_000_000_009))[0], "array<int>")
lps = column_function(textalgos.border_array, "array<int>")
z_values = column_function(textalgos.z_array, "array<int>")
suffixes = column_function(textalgos.suffix_array, "array<int>")
suffix_lcp = column_function(lambda t: textalgos.lcp_array(t, textalgos.suffix_array(t)), "array<int>")
edit_script = column_function(textalgos.edit_script, "array<string>")
prime = column_function(nums.is_prime, "boolean")
mixed = column_function(nums.split_mix, "long")
text_key = column_function(nums.text_key, "long")


def damerau(a: Column | str, b: Column | str) -> Column:
    """Edits with adjacent swaps, no part edited twice."""
    return column_function(lambda x, y: textalgos.edit_distance(_short(x), _short(y), swaps=True), "int")(a, b)


def weighted_edit(a: Column | str, b: Column | str, insert: int = 1, delete: int = 1, substitute: int = 1) -> Column:
    return column_function(lambda x, y: textalgos.edit_distance(_short(x), _short(y), insert, delete, substitute), "int")(a, b)


def _short(text: str) -> str:
    if len(text) > MAX_TEXT:
        raise ValueError(f"texts of at most {MAX_TEXT} characters")
    return text


ALIGNED = "struct<score:int,identity_pct:int,length:int,gaps:int,a_from:int,a_to:int,b_from:int,b_to:int>"


def alignment(a: Column | str, b: Column | str, match: int = 1, mismatch: int = -1, gap: int = -1, local: bool = False) -> Column:
    """Global or local alignment of two texts word by word."""

    def run(x: str, y: str) -> dict:
        r = textalgos.align(_short(x).split(), _short(y).split(), match, mismatch, gap, local)
        cols = r.pop("columns")
        return r | {"identity_pct": textalgos.identity_pct(cols), "length": len(cols), "gaps": sum(p is None or q is None for p, q in cols)}

    @F.pandas_udf(ALIGNED)
    def both(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        rows = [run(x or "", y or "") for x, y in zip(xs, ys)]
        return pd.DataFrame(rows, columns=["score", "identity_pct", "length", "gaps", "a_from", "a_to", "b_from", "b_to"])

    return both(a, b)


def multi_pattern(rows: DataFrame, text: str, patterns: list[str], key: str = "id") -> DataFrame:
    """key, pattern, start of every occurrence of every pattern in one pass over each text.

    The automaton is built once per task from the pattern list (at most 200,000 characters).
    """
    if len(patterns) > 1024 or sum(map(len, patterns)) > 200_000:
        raise ValueError("at most 1024 patterns of 200,000 characters together")

    def scan(batches):
        machine = textalgos.Dictionary(patterns)
        for b in batches:
            out = [(k, patterns[i], s) for k, t in zip(b[key], b[text]) if isinstance(t, str) for s, i in machine.find(t)]
            yield pd.DataFrame(out, columns=[key, "pattern", "start"])

    return rows.select(key, text).mapInPandas(scan, f"{key} {dict(rows.dtypes)[key]}, pattern string, start int")


def distributed_suffix_ranks(chars: DataFrame) -> DataFrame:
    """pos, rank of the suffixes of one long text given as (pos, ch): prefix doubling by joins.

    Each round joins ranks with those ``step`` further on and re-ranks the distinct pairs over
    ranges; it ends when all ranks differ, after at most log2(length) rounds. No task holds
    the text.
    """
    n = chars.count()
    first = ranked(chars.select("ch").distinct(), ["ch"]).withColumnRenamed("position", "rank")
    ranks = materialise(chars.join(first, "ch").select("pos", "rank"), "ranks")
    step = 1
    while step < n:
        ahead = ranks.select((F.col("pos") - step).alias("pos"), F.col("rank").alias("next"))
        pairs = ranks.join(ahead, "pos", "left").withColumn("next", F.coalesce("next", F.lit(0)))
        dense = ranked(pairs.select("rank", "next").distinct(), ["rank", "next"])
        ranks = materialise(pairs.join(dense, ["rank", "next"]).select("pos", F.col("position").alias("rank")), "ranks")
        if ranks.agg(F.max("rank")).first()[0] == n:
            break
        step *= 2
    return ranks


# --- instances ---------------------------------------------------------------------------


def per_instance_rows(rows: DataFrame, key: str, fn: Callable[[pd.DataFrame], list[tuple]], schema: str, limit: int = MAX_EDGES) -> DataFrame:
    """The rows ``fn`` makes of each instance's rows, which must be at most ``limit``."""
    names = [c.split()[0].strip("`") for c in schema.split(",")]

    def run(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > limit:
            raise ValueError(f"instance {k[0]} has {len(pdf)} rows, at most {limit} are taken")
        return pd.DataFrame([(k[0], *r) for r in fn(pdf)], columns=[key, *names])

    return rows.groupBy(key).applyInPandas(run, f"`{key}` {dict(rows.dtypes)[key]}, {schema}")


def per_instance(rows: DataFrame, key: str, fn: Callable[[pd.DataFrame], dict], schema: str, limit: int = MAX_EDGES) -> DataFrame:
    """One result row per instance: ``fn`` of its rows, which must be at most ``limit``."""
    names = [c.split()[0].strip("`") for c in schema.split(",")]

    def run(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > limit:
            raise ValueError(f"instance {k[0]} has {len(pdf)} rows, at most {limit} are taken")
        return pd.DataFrame([{key: k[0], **fn(pdf)}], columns=[key, *names])

    return rows.groupBy(key).applyInPandas(run, f"`{key}` {dict(rows.dtypes)[key]}, {schema}")


def _vertices(pdf: pd.DataFrame, *also: str) -> tuple[list[str], dict[str, int]]:
    names = sorted({*pdf["source"], *pdf["target"], *also})
    return names, {x: i for i, x in enumerate(names)}


def _edges(pdf: pd.DataFrame, at: dict[str, int]) -> list[tuple[int, int, int]]:
    pdf = pdf.sort_values(["source", "target"])
    return [(at[u], at[v], int(w)) for u, v, w in zip(pdf["source"], pdf["target"], pdf["weight"])]


def max_flows(edges: DataFrame, key: str, source: str, sink: str, method: str = "dinic") -> DataFrame:
    """key, max_flow, rounds, vertices of each network (key, source, target, weight)."""

    def run(pdf: pd.DataFrame) -> dict:
        names, at = _vertices(pdf, source, sink)
        value, rounds, _ = flows.max_flow(len(names), _edges(pdf, at), at[source], at[sink], method)
        return {"max_flow": value, "rounds": rounds, "vertices": len(names)}

    return per_instance(edges, key, run, "max_flow long, rounds int, vertices int")


def flow_edges(edges: DataFrame, key: str, source: str, sink: str, method: str = "dinic") -> DataFrame:
    """key, source, target, capacity, flow, residual of every edge under a largest flow."""

    def run(pdf: pd.DataFrame) -> list[tuple]:
        names, at = _vertices(pdf, source, sink)
        arcs = _edges(pdf, at)
        _, _, net = flows.max_flow(len(names), arcs, at[source], at[sink], method)
        return [(names[u], names[v], c, net.flow(k), c - net.flow(k)) for k, (u, v, c) in enumerate(arcs)]

    return per_instance_rows(edges, key, run, "source string, target string, capacity long, flow long, residual long")


def flow_balance(edge_flows: DataFrame, key: str) -> DataFrame:
    """key, service, net (what leaves less what enters), over_capacity (edges with a flow outside 0..capacity)."""
    over = F.when((F.col("flow") < 0) | (F.col("flow") > F.col("capacity")), 1).otherwise(0).cast("long")
    out = edge_flows.select(key, F.col("source").alias("service"), F.col("flow").alias("net"), over.alias("over"))
    into = edge_flows.select(key, F.col("target").alias("service"), (-F.col("flow")).alias("net"), F.lit(0).cast("long").alias("over"))
    return out.unionByName(into).groupBy(key, "service").agg(F.sum("net").alias("net"), F.sum("over").alias("over_capacity"))


def min_cuts(edges: DataFrame, key: str, source: str, sink: str) -> DataFrame:
    """key, capacity, source_side, crossing (edges as source>target) of the least cut with the smallest source side."""

    def run(pdf: pd.DataFrame) -> dict:
        names, at = _vertices(pdf, source, sink)
        arcs = _edges(pdf, at)
        value, side, crossing = flows.min_cut(len(names), arcs, at[source], at[sink])
        cut = ",".join(f"{names[arcs[k][0]]}>{names[arcs[k][1]]}" for k in crossing)
        return {"capacity": value, "source_side": ",".join(names[i] for i in sorted(side)), "crossing": cut}

    return per_instance(edges, key, run, "capacity long, source_side string, crossing string")


def min_cost_flows(edges: DataFrame, key: str, source: str, sink: str) -> DataFrame:
    """Needs a ``cost`` column beside source, target, weight."""

    def run(pdf: pd.DataFrame) -> dict:
        names, at = _vertices(pdf, source, sink)
        pdf = pdf.sort_values(["source", "target"])
        net = flows.Network(len(names), _edges(pdf, at), [int(c) for c in pdf["cost"]])
        flow, cost = net.cheapest(at[source], at[sink])
        return {"max_flow": flow, "cost": cost}

    return per_instance(edges, key, run, "max_flow long, cost long")


def matching_pairs(edges: DataFrame, key: str) -> DataFrame:
    """key, source, target: a largest matching between sources and targets; unmatched ones with a null partner."""

    def run(pdf: pd.DataFrame) -> list[tuple]:
        left, right = sorted(set(pdf["source"])), sorted(set(pdf["target"]))
        pairs = flows.matching(left, right, list(zip(pdf["source"], pdf["target"])))
        alone = [(x, None) for x in sorted(set(left) - {a for a, _ in pairs})] + [(None, y) for y in sorted(set(right) - {b for _, b in pairs})]
        return [*pairs, *alone]

    return per_instance_rows(edges, key, run, "source string, target string")


def matchings(edges: DataFrame, key: str) -> DataFrame:
    """key, matched, unmatched_left, unmatched_right of a largest matching between sources and targets."""
    both = F.col("source").isNotNull() & F.col("target").isNotNull()
    counts = {"matched": both, "unmatched_left": F.col("target").isNull(), "unmatched_right": F.col("source").isNull()}
    return matching_pairs(edges, key).groupBy(key).agg(*[F.count_if(c).cast("int").alias(n) for n, c in counts.items()])


def vertex_covers(edges: DataFrame, key: str, most: int = 20) -> DataFrame:
    """key, cover, size, matched, kernel_forced, smallest: 2-approximate cover, what the kernel rules force for its size, and the least size.

    The least size is searched from the number of matched edges up to ``most`` vertices beyond what
    the kernel forces (the search doubles with each); null if it lies beyond.
    """

    def run(pdf: pd.DataFrame) -> dict:
        names, at = _vertices(pdf)
        e = [(u, v) for u, v, _ in _edges(pdf, at)]
        cover, matched = covers.vertex_cover(e), covers.matched_edges(e)
        reduced = covers.kernel(e, len(cover))
        return {
            "cover": ",".join(names[i] for i in cover), "size": len(cover), "matched": len(matched),
            "kernel_forced": len(reduced[0]) if reduced else -1, "smallest": covers.smallest_cover(e, len(matched), len(cover), most),
        }

    return per_instance(edges, key, run, "cover string, size int, matched int, kernel_forced int, smallest int", 20_000)


def set_covers(members: DataFrame, key: str) -> DataFrame:
    """key, chosen, sets, uncovered: greedy cover of all ``item`` by sets named ``set``."""

    def run(pdf: pd.DataFrame) -> dict:
        groups = pdf.groupby("set")["item"].apply(list).sort_index()
        chosen, left = covers.set_cover(sorted(set(pdf["item"])), list(groups))
        return {"chosen": ",".join(groups.index[i] for i in chosen), "sets": len(chosen), "uncovered": len(left)}

    return per_instance(members, key, run, "chosen string, sets int, uncovered int")


def sequences(rows: DataFrame, key: str, fn: Callable[[list[int]], dict], schema: str, limit: int = 70_000) -> DataFrame:
    """``fn`` of each key's integer ``value``s in order of ``pos``."""
    return per_instance(rows, key, lambda pdf: fn([int(v) for v in pdf.sort_values("pos")["value"]]), schema, limit)


def matrix_chains(rows: DataFrame, key: str) -> DataFrame:
    return sequences(rows, key, lambda v: dict(zip(("cost", "bracketing"), dynamic.matrix_chain(v))), "cost long, bracketing string", 201)


def search_trees(rows: DataFrame, key: str) -> DataFrame:
    return sequences(rows, key, lambda v: dict(zip(("cost", "root"), dynamic.optimal_search_tree(v))), "cost long, root int", 400)


def subset_sums(rows: DataFrame, key: str) -> DataFrame:
    """key, total, top: sums over all subsets of the masks 0..2^bits - 1, padded with zeros."""

    def run(v: list[int]) -> dict:
        out = dynamic.subset_totals(v + [0] * ((1 << max(0, len(v) - 1).bit_length()) - len(v)))
        return {"full": out[-1], "checksum": sum(out)}

    return sequences(rows, key, run, "full long, checksum long", 1 << 16)


def subset_sums_joined(values: DataFrame, bits: int) -> DataFrame:
    """mask, value summed over all submasks, by one join per bit (mask, value)."""
    out = values.select("mask", "value")
    for b in range(bits):
        low = out.where(F.col("mask").bitwiseAND(1 << b) == 0).select((F.col("mask") + (1 << b)).alias("mask"), F.col("value").alias("low"))
        out = out.join(low, "mask", "left").select("mask", (F.col("value") + F.coalesce("low", F.lit(0))).alias("value"))
    return out


def tours(rows: DataFrame, key: str) -> DataFrame:
    """key, length, path from distances (source, target, weight); missing pairs are no edges."""

    def run(pdf: pd.DataFrame) -> dict:
        names, at = _vertices(pdf)
        m = [[-1] * len(names) for _ in names]
        for u, v, w in _edges(pdf, at):
            m[u][v] = w
        length, path = dynamic.shortest_tour(m)
        return {"length": length, "path": ",".join(names[i] for i in path)}

    return per_instance(rows, key, run, "length long, path string", 324)


def hamiltonian_paths(edges: DataFrame, key: str) -> DataFrame:
    def run(pdf: pd.DataFrame) -> dict:
        names, at = _vertices(pdf)
        path = dynamic.hamiltonian_path(len(names), [(u, v) for u, v, _ in _edges(pdf, at)])
        return {"found": path is not None, "path": ",".join(names[i] for i in path or [])}

    return per_instance(edges, key, run, "found boolean, path string", 400)


def _tree(pdf: pd.DataFrame) -> dynamic.Tree:
    return dynamic.Tree(len(pdf), [(int(p), int(v), int(w)) for v, p, w in zip(pdf["node"], pdf["parent"], pdf["weight"]) if p >= 0])


def modular_powers(n: Column | str, exponent: int, modulus: int) -> Column:
    """n^exponent mod modulus by repeated squaring in exact decimals; the modulus is at most 10^18."""
    base = F.pmod((F.col(n) if isinstance(n, str) else n).cast("decimal(19,0)"), F.lit(modulus).cast("decimal(19,0)")).cast("decimal(19,0)")
    times = lambda a, b: F.pmod((a * b).cast("decimal(38,0)"), F.lit(modulus).cast("decimal(19,0)")).cast("decimal(19,0)")
    bits = F.array(*[F.lit(b == "1") for b in f"{exponent:b}"])
    step = lambda acc, bit: F.when(bit, times(times(acc, acc), base)).otherwise(times(acc, acc))
    return F.aggregate(bits, F.lit(1 % modulus).cast("decimal(19,0)"), step).cast("long")


def tree_distance_sums(rows: DataFrame, key: str) -> DataFrame:
    """key, node, distance_sum: per node the sum of distances to all others."""
    return per_instance_rows(rows, key, lambda pdf: list(enumerate(_tree(pdf).distance_sums())), "node int, distance_sum long")


def tree_subset_sums(rows: DataFrame, key: str) -> DataFrame:
    """key, sums, largest: how many sums the ``value``s of vertex sets closed under parents have, the root always in."""

    def run(pdf: pd.DataFrame) -> dict:
        sums = _tree(pdf).subset_sums([int(v) for v in pdf.sort_values("node")["value"]])
        return {"sums": len(sums), "largest": max(sums)}

    return per_instance(rows, key, run, "sums int, largest long")


def complement_graphs(edges: DataFrame, key: str) -> DataFrame:
    """key, source, target: the pairs of vertices without an edge, source before target; at most 2,000 edges an instance."""

    def run(pdf: pd.DataFrame) -> list[tuple]:
        names, at = _vertices(pdf)
        return [(names[u], names[v]) for u, v in covers.complement_edges(len(names), [(u, v) for u, v, _ in _edges(pdf, at)])]

    return per_instance_rows(edges, key, run, "source string, target string", 2000)


def cover_reductions(edges: DataFrame, key: str) -> DataFrame:
    """key, vertices, cover, independent, clique_holds: a cover leaves an independent set, which is a clique of the complement graph."""

    def run(pdf: pd.DataFrame) -> dict:
        names, at = _vertices(pdf)
        e = [(u, v) for u, v, _ in _edges(pdf, at)]
        cover = set(covers.vertex_cover(e))
        rest = set(range(len(names))) - cover
        holds = covers.is_cover(cover, e) and covers.is_independent(rest, e) and covers.is_clique(rest, len(names), covers.complement_edges(len(names), e))
        return {"vertices": len(names), "cover": len(cover), "independent": ",".join(names[i] for i in sorted(rest)), "clique_holds": holds}

    return per_instance(edges, key, run, "vertices int, cover int, independent string, clique_holds boolean", 20_000)


def trees(rows: DataFrame, key: str) -> DataFrame:
    """key, vertices, diameter, best_sum, centroids, subset_sums of trees given by (node, parent, weight); the root's parent is -1."""

    def run(pdf: pd.DataFrame) -> dict:
        t = _tree(pdf)
        length, a, b = t.diameter()
        sums = t.distance_sums()
        return {"vertices": t.n, "diameter": length, "end_a": a, "end_b": b, "least_sum": min(sums), "centroids": ",".join(map(str, t.centroids()))}

    return per_instance(rows, key, run, "vertices int, diameter long, end_a int, end_b int, least_sum long, centroids string")


def knapsacks(rows: DataFrame, key: str, share: float = 0.25, eps: float = 0.2) -> DataFrame:
    """key, value, weight, items of (weight, value) rows under ``share`` of their total weight."""

    def run(pdf: pd.DataFrame) -> dict:
        pdf = pdf.sort_values(["weight", "value"])
        items = [(int(w), int(v)) for w, v in zip(pdf["weight"], pdf["value"])]
        value, weight, chosen = dynamic.knapsack_fptas(items, int(share * sum(w for w, _ in items)), eps)
        return {"value": value, "weight": weight, "items": len(chosen)}

    return per_instance(rows, key, run, "value long, weight long, items int", 2_000_000)


# --- numbers and hashing -----------------------------------------------------------------


def reservoirs(rows: DataFrame, key: str, item: str, k: int = 10, seed: int = 42) -> DataFrame:
    """key, item, slot: exactly k (or all, if fewer) of each key's rows, uniformly.

    The k smallest seeded hashes are a uniform sample; ranks are taken within hash slots
    first, so that a hot key is not one sort.
    """
    h = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string"), F.col(item).cast("string")).cast("binary"))
    e = rows.select(key, item, h.alias("h")).withColumn("part", F.pmod(F.xxhash64(F.lit(seed + 1), "h"), F.lit(64)))
    first = e.withColumn("r", F.row_number().over(Window.partitionBy(key, "part").orderBy("h", item))).where(F.col("r") <= k)
    slot = F.row_number().over(Window.partitionBy(key).orderBy("h", item))
    return first.withColumn("slot", slot).where(F.col("slot") <= k).select(key, item, "slot")


def bucket_statistics(rows: DataFrame, column: str, buckets: int = 64, seed: int = 1337) -> DataFrame:
    """One row: keys, collisions, largest bucket, load factor of distinct values under one universal function."""
    a, b = nums.family(seed)
    per = rows.select(column).where(F.col(column).isNotNull()).distinct().groupBy(universal_hash(F.col(column), a, b, buckets).alias("bucket")).agg(F.count("*").alias("n"))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return per.agg(total.alias("keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("collisions"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"), (total / F.lit(float(buckets))).alias("load"))


def static_membership(rows: DataFrame, column: str, keys: list[int]) -> DataFrame:
    """Rows whose value is one of ``keys``, through a two-level perfect hash in column expressions; at most 10,000 keys."""
    if len(keys) > 10_000:
        raise ValueError("at most 10,000 keys; join larger sets")
    table = nums.PerfectHash(sorted(set(keys)))
    sizes = [len(cells) for _, cells in table.rows]
    starts = [sum(sizes[:i]) for i in range(len(sizes))]
    flat = F.array(*[F.lit(x).cast("long") for _, cells in table.rows for x in cells], F.lit(None).cast("long"))

    def pick(values: list[int], at: Column) -> Column:
        return F.array(*[F.lit(v).cast("long") for v in values])[at]

    key = F.col(column).cast("long")
    slot = universal_hash(key, *table.top, table.m).cast("int")
    size = pick(sizes, slot)
    mine = universal_hash_columns(key, pick([ab[0] for ab, _ in table.rows], slot), pick([ab[1] for ab, _ in table.rows], slot), size)
    return rows.where(F.coalesce((size > 0) & (flat[(pick(starts, slot) + mine).cast("int")] == key), F.lit(False)))
