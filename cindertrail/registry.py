"""Engines by (query type, algorithm), and scalar functions for SQL."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cindertrail.functions import covers, dynamic, flows, textalgos
from cindertrail.functions import numbers as nums
from cindertrail.operators import engines, parallel
from cindertrail.search import engine as search

#: Dispatch keys and what answers them: plain cores for one instance, or DataFrame operators.
ENGINES: dict[tuple[str, str], Callable] = {
    ("PATTERN_SEARCH", "NAIVE"): textalgos.occurrences,
    ("PATTERN_SEARCH", "KMP"): lambda text, pattern: {"positions": textalgos.occurrences(text, pattern), "lps": textalgos.border_array(pattern)},
    ("PATTERN_SEARCH", "Z"): lambda text, pattern: {"positions": textalgos.occurrences(text, pattern), "z": textalgos.z_array(pattern)},
    ("PATTERN_SEARCH", "RABIN_KARP"): textalgos.hash_matches,
    ("MULTI_PATTERN_SEARCH", "AHO_CORASICK"): lambda text, patterns: textalgos.Dictionary(patterns).find(text),
    ("FUZZY_SEARCH", "LEVENSHTEIN"): search.fuzzy_lines,
    ("SUFFIX_ANALYSIS", "SUFFIX_ARRAY"): textalgos.suffix_array,
    ("EDIT_DISTANCE", "LEVENSHTEIN"): textalgos.edit_distance,
    ("EDIT_DISTANCE", "DAMERAU_LEVENSHTEIN"): lambda a, b: textalgos.edit_distance(a, b, swaps=True),
    ("EDIT_DISTANCE", "WEIGHTED_EDIT_DISTANCE"): textalgos.edit_distance,
    ("GLOBAL_ALIGNMENT", "NEEDLEMAN_WUNSCH"): textalgos.align,
    ("LOCAL_ALIGNMENT", "SMITH_WATERMAN"): lambda a, b, **k: textalgos.align(a, b, local=True, **k),
    ("INTERVAL_DP", "MATRIX_CHAIN"): dynamic.matrix_chain,
    ("INTERVAL_DP", "OPTIMAL_BINARY_SEARCH_TREE"): dynamic.optimal_search_tree,
    ("BITMASK_DP", "BITMASK_TSP"): dynamic.shortest_tour,
    ("BITMASK_DP", "HAMILTONIAN_PATH"): dynamic.hamiltonian_path,
    ("TREE_DP", "TREE_DIAMETER"): lambda n, edges: dynamic.Tree(n, edges).diameter(),
    ("TREE_DP", "REROOTING_DP"): lambda n, edges: dynamic.Tree(n, edges).distance_sums(),
    ("SOS_DP", "SOS_DP"): dynamic.subset_totals,
    ("SERVICE_FLOW", "FORD_FULKERSON"): lambda n, edges, s, t: flows.max_flow(n, edges, s, t, "ford-fulkerson")[0],
    ("SERVICE_FLOW", "EDMONDS_KARP"): lambda n, edges, s, t: flows.max_flow(n, edges, s, t, "edmonds-karp")[0],
    ("SERVICE_FLOW", "DINIC"): lambda n, edges, s, t: flows.max_flow(n, edges, s, t)[0],
    ("MIN_CUT", "MIN_CUT"): flows.min_cut,
    ("MATCHING", "BIPARTITE_MATCHING"): flows.matching,
    ("MIN_COST_FLOW", "MIN_COST_MAX_FLOW"): lambda n, edges, costs, s, t: flows.Network(n, edges, costs).cheapest(s, t),
    ("APPROXIMATE_COVER", "VERTEX_COVER"): covers.vertex_cover,
    ("APPROXIMATE_COVER", "MAXIMAL_MATCHING"): covers.matched_edges,
    ("SET_COVER", "SET_COVER"): covers.set_cover,
    ("PRIMALITY_TEST", "MILLER_RABIN"): nums.probably_prime,
    ("STREAM_SAMPLE", "RESERVOIR_SAMPLING"): nums.reservoir,
    ("HASH", "UNIVERSAL_HASH"): engines.bucket_statistics,
    ("RANDOMIZED_SORT", "RANDOMIZED_QUICKSORT"): parallel.sorted_rows,
    ("PARALLEL_REDUCE", "PARALLEL_REDUCE"): parallel.reduce_column,
    ("PARALLEL_SCAN", "PARALLEL_PREFIX_SCAN"): parallel.scan,
    ("PARALLEL_SORT", "PARALLEL_SORT"): parallel.sorted_rows,
}


def engine(query_type: str, algorithm: str) -> Callable:
    try:
        return ENGINES[query_type.upper(), algorithm.upper()]
    except KeyError:
        raise LookupError(f"no engine for {query_type}/{algorithm}") from None


@dataclass(frozen=True)
class Answer:
    """What an engine gave, with what it was asked and how long it took."""

    query_type: str
    algorithm: str
    input_size: int
    result: object
    seconds: float
    notes: tuple[str, ...] = ()


def answer(query_type: str, algorithm: str, *args, notes: tuple[str, ...] = (), **kw) -> Answer:
    """Run an engine and put its result in an envelope; the input size is that of the first argument, if it has one.

    A DataFrame as result is a plan: the time is that of making it.
    """
    run = engine(query_type, algorithm)
    size = len(args[0]) if args and hasattr(args[0], "__len__") else 0
    t = time.perf_counter()
    result = run(*args, **kw)
    return Answer(query_type.upper(), algorithm.upper(), size, result, time.perf_counter() - t, notes)


def register_functions(spark: SparkSession) -> None:
    """Scalar engines as SQL functions: ct_positions, ct_damerau, ct_is_prime, ct_edit_script."""
    def pair(fn, returns):
        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([None if x is None or y is None else fn(x, y) for x, y in zip(a, b)], dtype=object)

        return F.pandas_udf(run, returns)

    def single(fn, returns):
        def run(a: pd.Series) -> pd.Series:
            return pd.Series([None if x is None or pd.isna(x) else fn(int(x)) for x in a], dtype=object)

        return F.pandas_udf(run, returns)

    spark.udf.register("ct_positions", pair(textalgos.occurrences, "array<int>"))
    spark.udf.register("ct_damerau", pair(lambda a, b: textalgos.edit_distance(a, b, swaps=True), "int"))
    spark.udf.register("ct_edit_script", pair(textalgos.edit_script, "array<string>"))
    spark.udf.register("ct_is_prime", single(nums.is_prime, "boolean"))
