import pytest

from cindertrail.functions.traces import TRACES, trace
from cindertrail.operators import harness as H

EDGES = [(0, 1, 10), (0, 2, 5), (1, 2, 5), (1, 3, 5), (2, 3, 10)]
ARGS = {
    "naive": ("abab", "ab"), "kmp": ("ababab", "abab"), "z": ("abab", "ab"), "rabin-karp": ("abab", "ab"), "levenshtein": ("kitten", "sitting"),
    "matrix-chain": ([10, 20, 30, 40],), "ford-fulkerson": (4, EDGES, 0, 3), "edmonds-karp": (4, EDGES, 0, 3), "dinic": (4, EDGES, 0, 3),
    "vertex-cover": ([(0, 1), (1, 2), (3, 3)],), "miller-rabin": (221,), "reservoir": (list(range(9)), 3), "universal-hash": ([1, 2, 3], 2),
}


@pytest.mark.parametrize("name", TRACES)
def test_traces(name):
    steps, cut = trace(name, *ARGS[name])
    assert steps and not cut and [s[0] for s in steps] == list(range(len(steps)))
    if name in ("naive", "kmp", "z", "rabin-karp"):
        assert sum(s[1] == "match" for s in steps) == 2
    if name in ("ford-fulkerson", "edmonds-karp", "dinic"):
        assert "15" in steps[-1][2]


def test_trace_is_capped():
    steps, cut = trace("naive", "a" * 1000, "b")
    assert len(steps) == 400 and cut


def test_work_and_span():
    leaf = lambda n, c: ("leaf", n, c)
    assert H.work_span(("seq", leaf("a", 1), ("par", leaf("b", 2), leaf("c", 5)), leaf("d", 1))) == (9, 7, ["a", "c", "d"])


def test_history_keeps_the_last():
    h = H.RunHistory(2)
    ids = [h.run("x", lambda i=i: 1 / (i - 1)) for i in range(3)]
    assert h.get(ids[1])["status"] == "failed" and h.get(ids[2])["result"] == 1
    with pytest.raises(LookupError):
        h.get(ids[0])


def test_commands():
    assert H.text_command("PATTERN_SEARCH", text="aaa", pattern="aa") == [0, 1]
    assert H.text_command("FUZZY_MATCH", text="abc\nabd\nxyz", query="abc") == [(0, 1, "abc"), (1, 2, "abd")]
    assert H.text_command("DOCUMENT_SIMILARITY", a="a b c", b="a x c") == 67
    assert H.text_command("CITATION_FLOW", n=4, edges=EDGES, source=0, sink=3) == 15
    assert H.text_command("PROJECT_SCHEDULING", edges=[(0, 1)]) == [0, 1] and H.text_command("PRIME_TESTING", n=97)
    with pytest.raises(LookupError):
        H.text_command("NONE")


def test_measurements(spark, logs):
    df = logs([{"message": "aaa"}, {"message": None}])
    assert {r.matches for r in H.compare_matchers(df, "message", "aa").collect()} == {2}
    assert H.sweep(spark, [10], 1).count() == 3
