"""Replies of models as VARIANT values: objects and arrays in fences, or by balanced brackets in the text, as columns.

Nothing here runs row by row in Python: brackets are found by cutting the text at them and folding over the pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The row of a judge's reply without an object, and the defaults of an enrichment's entries.
VERDICT, SCORE, SUMMARY_CHARS = "CONFIRMED", 70, 300
UNKNOWN, UNTRUSTED, INFERRED = "unknown", "UNTRUSTED", "inferred"
STRINGS = "array<string>"


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _after(text: Column, mark: str) -> Column:
    """The text after the first mark; null without one."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substring(text, at + len(mark), F.length(text)))


def _until_fence(text: Column) -> Column:
    """The text before the next fence; null without one."""
    at = F.instr(text, "```")
    return F.when(at > 0, F.substring(text, F.lit(1), at - 1))


def balanced_object(text: Column) -> Column:
    """From the first { to the } that balances it, braces in strings counted too; null where none does."""

    def fold(tail: Column) -> Column:
        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"), F.lit(False).alias("done"))

        def step(a: Column, piece: Column) -> Column:
            depth = a["depth"] + F.when(piece.endswith("{"), 1).otherwise(-1)
            return F.when(a["done"], a).otherwise(F.struct(depth.alias("depth"), (a["size"] + F.length(piece)).alias("size"), (depth == 0).alias("done")))

        pieces = F.regexp_extract_all(tail, F.lit(r"[^{}]*[{}]"), F.lit(0))
        return F.aggregate(pieces, start, step, lambda a: F.when(a["done"], F.substring(tail, F.lit(1), a["size"])))

    at = F.instr(text, "{")
    return F.when(at > 0, _let(F.substring(text, at, F.length(text)), fold))


def balanced_array(text: Column) -> Column:
    """From the first [ to the ] that balances it, brackets in strings left out; null where none does."""

    def fold(tail: Column) -> Column:
        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"), F.lit(False).alias("quoted"), F.lit(False).alias("done"))

        def step(a: Column, piece: Column) -> Column:
            last = F.right(piece, F.lit(1))  # of an escaped letter outside of strings the letter counts
            closes = a["quoted"] & (piece == '"')
            quoted = F.when(a["quoted"], ~closes).otherwise(last == '"')
            depth = a["depth"] + F.when(a["quoted"], 0).when(last == "[", 1).when(last == "]", -1).otherwise(0)
            done = ~a["quoted"] & (last == "]") & (depth == 0)
            return F.when(a["done"], a).otherwise(F.struct(depth.alias("depth"), (a["size"] + F.length(piece)).alias("size"), quoted.alias("quoted"), done.alias("done")))

        pieces = F.regexp_extract_all(tail, F.lit(r'(?s)\\.|["\[\]]|\\|[^"\\\[\]]+'), F.lit(0))
        return F.aggregate(pieces, start, step, lambda a: F.when(a["done"], F.substring(tail, F.lit(1), a["size"])))

    at = F.instr(text, "[")
    return F.when(at > 0, _let(F.substring(text, at, F.length(text)), fold))


def json_array(text: Column) -> Column:
    """The text of a reply's first array: in a json fence, in a plain fence, else by balanced brackets."""
    fenced = [F.trim(F.regexp_extract(text, rf"(?s){mark}\s*(.*?)```", 1), F.lit(" \t\n\r")) for mark in ("```json", "```")]
    return F.coalesce(*(F.when(f.startswith("["), f) for f in fenced), balanced_array(text))


def any_object(text: Column) -> Column:
    """The VARIANT of a reply: a closed json fence, a closed plain fence, else the balanced object; null if none is JSON."""
    parse = lambda x: F.try_parse_json(F.trim(x, F.lit(" \t\n\r")))
    return F.coalesce(parse(_until_fence(_after(text, "```json"))), parse(_until_fence(_after(text, "```"))), F.try_parse_json(balanced_object(text)))


def fenced_object(text: Column) -> Column:
    """The VARIANT of a reply whose fence, json or else plain, may lack its end; without JSON inside, the balanced object there."""
    inside = lambda mark: _let(_after(text, mark), lambda x: F.coalesce(_until_fence(x), x))
    body = F.trim(F.coalesce(inside("```json"), inside("```"), text), F.lit(" \t\n\r"))
    return _let(body, lambda b: F.coalesce(F.try_parse_json(b), F.try_parse_json(balanced_object(b))))


def _field(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def verdicts(replies: DataFrame, key: list[str], text: str) -> DataFrame:
    """key, verdict, confidence_score, summary, gates (passed ones): a judge's replies; without an object the default row."""
    v = F.col("v")
    rows = replies.select(*key, F.col(text).alias("text"), any_object(F.col(text)).alias("v"))
    gates = F.filter(F.array(*(F.when(_field(v, f"$.gate_{i}.passed", "boolean"), F.lit(i)) for i in range(1, 5))), lambda x: x.isNotNull())
    return rows.select(
        *key,
        F.when(v.isNull(), VERDICT).otherwise(F.coalesce(F.upper(_field(v, "$.verdict")), F.lit(VERDICT))).alias("verdict"),
        F.coalesce(_field(v, "$.confidence_score", "int"), F.lit(SCORE)).alias("confidence_score"),
        F.when(v.isNull(), F.substring("text", 1, SUMMARY_CHARS)).otherwise(F.coalesce(_field(v, "$.summary"), F.lit(""))).alias("summary"),
        gates.alias("gates"),
    )


def _entries(replies: DataFrame, key: list[str], path: str) -> DataFrame:
    """One row (key, place, e) for each element of an array of the reply."""
    return replies.select(*key, F.posexplode(_field(F.col("v"), path, "array<variant>")).alias("place", "e"))


def enrichment(replies: DataFrame, key: list[str], text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The nodes (key, type, id, name, level, actors, description, source, formal), the DEPENDS_ON edges (key, src, dst) to
    all named variables, and the metadata (key, protocol_type, protocol_purpose, notes) of an enrichment's replies."""
    parsed = replies.select(*key, fenced_object(F.col(text)).alias("v")).filter("v is not null")
    e, none = F.col("e"), F.lit(None).cast("string")
    name = F.coalesce(_field(e, "$.name"), F.lit(UNKNOWN))
    empty = F.array().cast(STRINGS)
    trust = _entries(parsed, key, "$.trust_boundaries").select(
        *key, F.lit("TrustBoundary").alias("type"), F.concat(F.lit("trust:"), name).alias("id"), name.alias("name"),
        F.coalesce(_field(e, "$.trust_level"), F.lit(UNTRUSTED)).alias("level"), F.coalesce(_field(e, "$.related_modifiers", STRINGS), empty).alias("actors"),
        F.coalesce(_field(e, "$.description"), F.lit("")).alias("description"), none.alias("source"), none.alias("formal"),
    )
    own = F.coalesce(_field(e, "$.id"), F.concat(F.lit("INV-"), F.col("place") + 1))
    entries = _entries(parsed, key, "$.invariants").withColumn("own", own)
    invariants = entries.select(
        *key, F.lit("Invariant").alias("type"), F.concat(F.lit("invariant:"), "own").alias("id"), F.col("own").alias("name"), none.alias("level"), empty.alias("actors"),
        F.coalesce(_field(e, "$.description"), F.lit("")).alias("description"), F.coalesce(_field(e, "$.source"), F.lit(INFERRED)).alias("source"), F.coalesce(_field(e, "$.formal"), F.lit("")).alias("formal"),
    )
    edges = entries.select(*key, F.concat(F.lit("invariant:"), "own").alias("src"), F.explode(_field(e, "$.related_vars", STRINGS)).alias("dst"))
    metadata = parsed.select(
        *key, F.coalesce(_field(F.col("v"), "$.protocol_type"), F.lit(UNKNOWN)).alias("protocol_type"), F.coalesce(_field(F.col("v"), "$.protocol_purpose"), F.lit("")).alias("protocol_purpose"),
        F.coalesce(_field(F.col("v"), "$.attack_surface_notes", STRINGS), empty).alias("notes"),
    )
    return trust.unionByName(invariants), edges, metadata
