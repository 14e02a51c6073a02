"""Ports, caches and retries, and the pipelines with a port of their own."""

import pytest

from graphloom.operators import pipelines as P
from graphloom.sources.ports import FifoCache, expand, first_that_works, scores_by_index, with_retries


def test_fifo_cache_drops_the_first_in():
    c = FifoCache(2)
    for k in "ab":
        c.put(k, k)
    assert c.get("a") == "a"  # a read does not keep it
    c.put("c", "c")
    assert (c.get("a"), c.get("b"), c.get("c")) == (None, "b", "c")


def test_expand_falls_back_and_remembers():
    asked = []

    def port(q, kind):
        asked.append((q, kind))
        if q == "bad":
            raise RuntimeError
        return "" if q == "none" else f"long {q}"

    c = FifoCache()
    assert expand("bad", None, port, c) == "bad"
    assert expand("none", None, port, c) == "none"
    assert expand("x", None, None, c) == "x"
    assert expand("Query ", "k", port, c) == "long Query "
    assert expand("query", "k", port, c) == "long Query "
    assert expand("query", "other", port, c) == "long query"
    assert len(asked) == 4


def test_retries_double_their_waits_and_stop():
    waits, calls = [], []

    def call():
        calls.append(1)
        raise ValueError("429")

    with pytest.raises(ValueError):
        with_retries(call, lambda e: "429" in str(e), sleep=waits.append)
    assert (len(calls), waits) == (4, [15.0, 30.0, 60.0])
    with pytest.raises(ValueError):
        with_retries(call, lambda e: False, sleep=waits.append)
    assert len(calls) == 5
    assert first_that_works([call, lambda: 7], lambda e: True, sleep=waits.append) == 7
    assert waits[3:] == [2.0]


def test_backend_results_go_by_index():
    assert scores_by_index([{"index": 2, "relevance_score": 0.5}, {"index": 0, "relevance_score": 1}, {"index": 9, "relevance_score": 3}], 3) == [1.0, None, 0.5]


def test_rerank_by_a_port_and_its_failure(spark):
    rows = spark.createDataFrame([(i, f"text {i}", i + 1) for i in range(5)], "chunk_id long, chunk_text string, rk int")
    got = P.cut(P.reranked(rows, "q", 4, lambda q, texts: [len(texts) - i if i else 0.5 for i in range(len(texts))]), 3)
    assert [(r.chunk_id, r.place) for r in got.orderBy("place").collect()] == [(1, 1), (2, 2), (3, 3)]

    def fails(q, texts):
        raise RuntimeError

    got = P.cut(P.reranked(rows, "q", 4, fails), 3)
    assert [r.chunk_id for r in got.orderBy("place").collect()] == [0, 1, 2]
    assert (P.adaptive_budget(12_000, 9_000, 1_000), P.adaptive_budget(12_000, 9_000, 1_001)) == (12_000, 6_000)
