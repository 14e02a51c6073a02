"""Operator 7: personal data, by base patterns and bootstrapped contextual extraction.

One scan finds the base entities (seeds) and other strings of a related form (mentions), each with its lexical
pattern: the two words before it and its kind. Spark then scores the graph of patterns and instances: a pattern is as
good as the mean of its instances, an unseen instance as good as DAMP times its best pattern with MIN_SEEDS distinct
seeds. Rounds from below and from above bound the only fixpoint of that, until it is settled for every pattern on which
side of MIN_SCORE it lies. Patterns with MIN_SEEDS and a score of MIN_SCORE or more are trusted, and the mentions in
their slot become spans beside the base ones. Only base entities are seeds, not what trusted patterns find.

Defined results: a null text counts as empty, n_* count base spans, offsets are code points. Rows are kept apart
even where doc_id repeats or is null. Extra columns are ignored. Work is linear in the length of a text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved

KINDS = ("email", "ip", "card", "phone")
DAMP, MIN_SEEDS, MIN_SCORE = 0.8, 3, 0.6
#: Decimals of a score; rounds end at such a distance of the bounds too, for a score that is MIN_SCORE itself.
DECIMALS = 9

# Fixed patterns of the base entities.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Forms of mentions that only a trusted pattern makes a span.
_LOOSE = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]++)+| at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++)+)")),
    ("ip", re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|-|,)[0-9]{1,3}){3}(?![0-9])")),
    ("card", re.compile(r"(?<![0-9.])[0-9](?:[\x20.-]?[0-9]){11,18}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+.])\(?[0-9]{2,4}\)?(?:[\x20.-][0-9]{2,4})+(?![0-9])")),
)
_DIGIT, _AT = re.compile("[0-9]"), re.compile(r"@|\(at\)|\[at\]| at ")
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base entities, by kind and start."""
    found: list[tuple[int, int, int]] = []
    at, free = text.find("@"), 0
    while at >= 0:  # the run of name characters before each @, then the domain: leftmost matches in linear time
        s = at
        while s > free and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            found.append((0, s, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if not _DIGIT.search(text):
        return found
    for m in _DOTTED.finditer(text):
        numbers, s = m[0].split("."), m.start()
        for i in range(0, len(numbers) - 3, 4):
            four = numbers[i : i + 4]
            e = s + sum(map(len, four)) + 3
            if all(len(n.lstrip("0")) <= 3 and int(n) <= 255 for n in four):
                found.append((1, s, e))
            s = e + 1
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            found.append((3, m.start(), m.end()))
    return found


def _holds(kind: str, value: str) -> bool:
    digits = "".join(c for c in value if "0" <= c <= "9")
    if kind == "ip":
        return all(int(n) <= 255 for n in re.findall("[0-9]+", value))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 7 <= len(digits) <= 15


def left_patterns(text: str, starts: list[int]) -> list[str]:
    """The two words before each position, lower-cased; empty where there are none. One pass over the words of the text."""
    out, last, words = [], ("", ""), _WORD.finditer(text)
    word = next(words, None)
    for start in starts:  # ascending
        while word is not None and word.end() <= start:
            last = last[1], word[0].lower()
            word = next(words, None)
        cut = text[word.start() : start].lower() if word is not None and word.start() < start else ""
        out.append(" ".join(x for x in ((last[1], cut) if cut else last) if x))
    return out


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple]:
    """(kind, start, end, pattern, value, seed) of the base entities and of strings of a related form."""
    found = [(s, e, k, True) for k, s, e in base]
    digit, at = bool(_DIGIT.search(text)), bool(_AT.search(text))
    taken = sorted((s, e) for _, s, e in base)
    begins = [s for s, _ in taken]
    reach = list(accumulate((e for _, e in taken), max))
    for k, (kind, form) in enumerate(_LOOSE):
        if not (at if kind == "email" else digit):
            continue
        for m in form.finditer(text):
            s, e = m.span()
            i = bisect_left(begins, e)
            if _holds(kind, m[0]) and not (i and reach[i - 1] > s):
                found.append((s, e, k, False))
    if not found:
        return []
    found.sort(key=lambda x: (x[0], x[2], x[1]))
    rows = zip(found, left_patterns(text, [x[0] for x in found]), strict=True)
    return sorted((k, s, e, p, text[s:e].lower(), seed) for (s, e, k, seed), p in rows)


_MENTION = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("pattern", pa.string()), ("value", pa.string()), ("seed", pa.bool_())])


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts: list[list[int]] = [[], [], [], []]
        texts, digests, found = [], [], []
        for t in b.column(2):
            text = t.as_py() or ""
            base = base_spans(text)
            for k in range(4):
                counts[k].append(sum(x[0] == k for x in base))
            texts.append(spans_text(base))
            digests.append(hashlib.sha256(texts[-1].encode()).hexdigest())
            found.append([dict(zip(_MENTION.names, x, strict=True)) for x in mentions(text, base)])
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests), pa.array(texts), pa.array(found, pa.list_(_MENTION))],
            names=["row", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "mentions"],
        )


def scan(docs: DataFrame) -> DataFrame:
    """One row a document: base counts, digest and spans, and all mentions with their patterns."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(_scanned, f"row long, doc_id long, {counts}, base_sha256 string, base string, mentions array<struct<kind:int,start:long,end:long,pattern:string,value:string,seed:boolean>>")


def score_patterns(found: DataFrame) -> DataFrame:
    """(pattern, kind, seeds, score) on the graph of (pattern, kind, value, seed) edges; the side of MIN_SCORE is that of the fixpoint."""
    edges = saved(found.filter("pattern <> ''").groupBy("pattern", "kind", "value").agg(F.max("seed").alias("seed")), "edges")
    value = edges.groupBy("kind", "value").agg(F.max(F.col("seed").cast("double")).alias("low")).withColumn("high", F.greatest("low", F.lit(DAMP)))
    before = []
    while True:
        scored = edges.join(value, ["kind", "value"]).groupBy("pattern", "kind").agg(F.avg("low").alias("low"), F.avg("high").alias("high"), F.count_if("seed").alias("seeds"))
        scored = saved(scored, "patterns")
        dropped(*before)
        if scored.filter((F.col("seeds") >= MIN_SEEDS) & (F.col("low") < MIN_SCORE) & (F.col("high") >= MIN_SCORE) & (F.col("high") - F.col("low") > 0.1**DECIMALS)).isEmpty():
            break
        best = edges.join(scored, ["pattern", "kind"]).groupBy("kind", "value")
        value = best.agg(*(F.when(F.max("seed"), 1.0).otherwise(F.max(F.when(F.col("seeds") >= MIN_SEEDS, F.col(x) * DAMP).otherwise(0.0))).alias(x) for x in ("low", "high")))
        before = [scored]
    dropped(edges)
    return scored.select("pattern", "kind", "seeds", F.round((F.col("low") + F.col("high")) / 2, DECIMALS).alias("score"))


def private_spans(docs: DataFrame) -> DataFrame:
    """Base counts and digest, and all spans, of every document."""
    rows = saved(scan(docs), "scan")
    found = rows.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    trusted = score_patterns(found).filter((F.col("seeds") >= MIN_SEEDS) & (F.col("score") >= MIN_SCORE)).select("pattern", "kind")
    new = found.filter("not seed").join(trusted, ["pattern", "kind"]).groupBy("row").agg(F.collect_set(F.struct("kind", "start", "end")).alias("more"))
    kinds = F.array(*map(F.lit, KINDS))
    base = F.transform(F.filter("mentions", lambda m: m.seed), lambda m: F.struct(m.kind.alias("kind"), m.start.alias("start"), m.end.alias("end")))
    spans = F.array_join(F.transform(F.array_sort(F.concat(base, F.col("more"))), lambda m: F.concat_ws(":", kinds[m.kind], m.start, m.end)), ",")
    out = rows.join(new, "row", "left").withColumn("spans", F.when(F.col("more").isNull(), F.col("base")).otherwise(spans))
    return out.select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_discovered"))
