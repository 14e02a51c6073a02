"""Operator 13: quality rules, a table of thresholds compiled into one projection of built-in functions.

Every measure of a text is a number of words, characters or lines. RULES holds ratios of two measures with bounds in
per cent; `compiled` turns the table into one struct column, so that all rules of all rows are one narrow projection
without a shuffle and without a user function.

Defined results: a null or empty text has no words, fails the base and is not kept; rows are judged one by one, so
ties, repeated rows and null ids get results of their own, equal for equal texts; extra columns are ignored, whatever
their names; an empty table gives an empty result. Texts of any length are judged whole, in time n log n of their
words. Windows are compared by a 64-bit hash of their five words.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 5

#: Fixed values of the base: fewest words, most words in repeated windows in per cent.
LEAST_WORDS, MOST_REPEATED = 10, 20

#: Frequent function words of four languages, in lower case.
STOP_WORDS = tuple(
    dict.fromkeys(
        (
            "the of and to a in is that it for was on with as be by this are at from or an not have but "
            "de la que el en y los se del las un por con no su una para es al lo como más o pero sus "
            "le et les des une du pour est par dans qui pas sur au ce il plus ne "
            "der die und den von zu das mit sich auf für ist im nicht dem ein eine als auch aus"
        ).split()
    )
)


class Rule(NamedTuple):
    """Kept texts have low <= 100 * top / bottom <= high, from so many words on; None: no bound."""

    name: str
    top: str
    bottom: str
    low: int | None
    high: int | None
    from_words: int = LEAST_WORDS


RULES = (
    Rule("word_length", "word_chars", "n_words", 200, 1200),
    Rule("symbols", "n_symbols", "n_words", None, 10),
    Rule("stop_words", "n_stop", "n_words", 5, None, 25),
    Rule("double_words", "n_double", "n_words", None, 30),
    Rule("dup_lines", "n_dup_lines", "n_lines", None, 50),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once: a lambda over a one-element array binds it."""
    return F.transform(F.array(value), body)[0]


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def repeated_words(words: Column) -> Column:
    """Words in windows of WINDOW words that occur twice or more, the first included."""
    window = F.transform(words, lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, WINDOW))))

    def covered(places: Column) -> Column:
        # ascending window starts: each adds its words up to the next start
        return total(F.transform(places, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(places, j + 1) - p, F.lit(WINDOW)))))

    def again(order: Column) -> Column:
        same = lambda e, j: e["h"].eqNullSafe(F.get(order, j)["h"])
        twice = F.filter(order, lambda e, j: same(e, j - 1) | same(e, j + 1))
        return let(F.array_sort(F.transform(twice, lambda e: e["i"])), covered)

    def counted(hashes: Column) -> Column:
        order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(order, again)).otherwise(0)

    return F.when(F.size(words) > WINDOW, let(F.slice(window, 1, F.greatest(F.lit(1), F.size(words) - WINDOW + 1)), counted)).otherwise(0)


def measured(text: Column) -> Column:
    """A struct of all measures of a text."""
    words = F.array_remove(F.split(text, BLANK), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    measures = lambda t, w, ln: {
        "n_words": F.size(w),
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": F.size(F.split(t, SYMBOL)) - 1,
        "n_lines": F.size(ln),
        "n_dup_lines": F.size(ln) - F.size(F.array_distinct(ln)),
        "n_repeat_words": repeated_words(w),
        "n_stop": F.size(F.filter(w, lambda x: x.isin(*STOP_WORDS))),
        "n_double": total(F.transform(w, lambda x, i: (x == F.coalesce(F.get(w, i - 1), F.lit(""))).cast("int"))),
    }
    return let(text, lambda t: let(words, lambda w: let(lines, lambda ln: F.struct(*(c.cast("long").alias(n) for n, c in measures(t, w, ln).items())))))


def compiled(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a struct of measures fails, as an array in the order of the table."""

    def fails(r: Rule) -> Column:
        top, bottom = 100 * m[r.top], m[r.bottom]
        out = F.lit(False)
        if r.low is not None:
            out |= top < r.low * bottom
        if r.high is not None:
            out |= top > r.high * bottom
        return out & (m["n_words"] >= r.from_words)

    return F.filter(F.array(*(F.when(fails(r), F.lit(r.name)) for r in rules)), lambda x: x.isNotNull())


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the measures, base_failed, kept, and the failed rules joined by commas."""

    def verdict(m: Column) -> Column:
        base = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED * m["n_words"])
        failed = compiled(m, rules)
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop", "n_double")
        return F.struct(*(m[n].alias(n) for n in names), base.alias("base_failed"), (~base & (F.size(failed) == 0)).alias("kept"), F.array_join(failed, ",").alias("failed_rules"))

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), let(measured(text), verdict).alias("v")).select("doc_id", "v.*")


def oracle() -> str:
    """DuckDB SQL for `judged` over documents."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
win AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS k FROM win) WHERE k > 1) GROUP BY r),
m AS (SELECT w.r, doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
  coalesce(cov.n, 0) AS n_repeat_words, len(ls) AS n_lines, len(list_filter(ws, lambda x: x IN ({stop}))) AS n_stop,
  len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_double
  FROM w LEFT JOIN cov ON w.r = cov.r),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  list_filter([
    CASE WHEN n_words >= 10 AND (100 * word_chars < 200 * n_words OR 100 * word_chars > 1200 * n_words) THEN 'word_length' END,
    CASE WHEN n_words >= 10 AND 100 * n_symbols > 10 * n_words THEN 'symbols' END,
    CASE WHEN n_words >= 25 AND 100 * n_stop < 5 * n_words THEN 'stop_words' END,
    CASE WHEN n_words >= 10 AND 100 * n_double > 30 * n_words THEN 'double_words' END,
    CASE WHEN n_words >= 10 AND 100 * n_dup_lines > 50 * n_lines THEN 'dup_lines' END], lambda x: x IS NOT NULL) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop, n_double, base_failed,
  NOT base_failed AND len(failed) = 0 AS kept, array_to_string(failed, ',') AS failed_rules FROM f"""
