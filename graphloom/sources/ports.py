"""Ports to remote models: embedding, reranking and query expansion, with a bounded cache and retries.

The engine calls models only through these. A port that fails leaves the query, or the order, as it was."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Sequence

#: A text to its vector; a query and texts to their scores; a query and its kind to a longer query.
Embedder = Callable[[str], Sequence[float]]
Reranker = Callable[[str, list[str]], Sequence[float]]
Expander = Callable[[str, str | None], str]

CACHE_SIZE = 128
#: Seconds before the first retry, doubled each time, and the tries in all.
RETRY_S, TRIES = 15.0, 4


class FifoCache:
    """At most `size` values; the one that came first leaves first, however often it is read."""

    def __init__(self, size: int = CACHE_SIZE):
        self.size, self.held = size, OrderedDict()

    def get(self, key):
        return self.held.get(key)

    def put(self, key, value) -> None:
        if key not in self.held and len(self.held) >= self.size:
            self.held.popitem(last=False)
        self.held[key] = value


def expand(query: str, kind: str | None, port: Expander | None, cache: FifoCache) -> str:
    """The port's longer query, from the cache if it is there; the query itself without a port, without text or on failure."""
    key = (query.strip().lower(), kind)
    known = cache.get(key)
    if known is not None or port is None:
        return known or query
    try:
        found = port(query, kind)
    except Exception:
        return query
    if not found or not found.strip():
        return query
    cache.put(key, found)
    return found


def scores_by_index(results: list[dict], n: int, score: str = "relevance_score") -> list[float | None]:
    """Scores in the order of the texts, of a backend's results (index, score); None where it gave none."""
    out: list[float | None] = [None] * n
    for r in results:
        if 0 <= r["index"] < n:
            out[r["index"]] = float(r[score])
    return out


def with_retries(call: Callable, is_rate_limit: Callable[[Exception], bool], tries: int = TRIES, first_s: float = RETRY_S, sleep: Callable[[float], None] = time.sleep):
    """The call's result, tried again after rate-limit errors with waits that double; other errors are raised at once."""
    for n in range(1, tries + 1):
        try:
            return call()
        except Exception as e:
            if n == tries or not is_rate_limit(e):
                raise
            sleep(first_s * 2 ** (n - 1))


def first_that_works(calls: list[Callable], is_rate_limit: Callable[[Exception], bool], tries: int = 2, sleep: Callable[[float], None] = time.sleep):
    """The first provider's result; after its tries the next provider is asked, and the last error is raised."""
    for i, call in enumerate(calls):
        try:
            return with_retries(call, is_rate_limit, tries, 2.0, sleep)
        except Exception:
            if i == len(calls) - 1:
                raise
