"""Operator 10: licence scans with a positional rare-token index, all in DataFrame functions.

Each template is indexed by its RARE words of highest inverse document frequency, counted over all documents. A
file's index words are looked up; every posting votes for the place where the template would start. Places with
votes of two different words or more are verified: each mandatory key phrase must stand at its relative position,
and MIN_COVER of the template's words at theirs.

Defined results: a null text counts as empty (no words, no labels, score 0); words are numbered from 0; ties in
frequency go to the word that sorts first. Rows are kept apart even where doc_id repeats or is null; extra columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved

#: What stands between words. Cutting there is linear; extracting all matches copies the text at every match.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RARE, MIN_COVER = 4, 0.6

#: The base phrases.
BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}

#: Label, template, mandatory key phrases (parts of the template). Openings and notices of public licences.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge", "associated documentation files")),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license", "version 2")),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("general public license", "version 3")),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ("general public license", "version 2")),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3", ("lesser general public license", "version 3")),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ("affero general public license", "version 3")),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license", "2 0")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee", ("permission to use copy modify", "with or without fee")),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
)


def words_of(text: Column) -> Column:
    """Words of a text with A-Z in lower case. lower() changes other letters too, but neither where words end nor
    whether a word is one of the ASCII words looked for (apart from the Kelvin sign, which no base phrase has)."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def places(words: Column, phrase: str) -> Column:
    """Numbers of the words where a phrase begins."""
    want = phrase.split()
    here = lambda w, i: (w == want[0]) & (F.slice(words, i + 1, len(want)) == F.array(*map(F.lit, want)))
    every = F.filter(F.transform(words, lambda w, i: F.when(here(w, i), i)), lambda i: i.isNotNull())
    return F.when(F.array_contains(words, want[1]) & F.array_contains(words, want[0]), every).otherwise(F.array().cast("array<int>"))


def document_frequency(words: DataFrame) -> tuple[int, dict[str, int]]:
    """Documents, and documents by licence word. The result is bounded by the words of TEMPLATES."""
    known = sorted({w for _, t, _ in TEMPLATES for w in t.split()})
    own = words.select(F.explode(F.array_union(F.array_intersect("words", F.array(*map(F.lit, known))), F.array(F.lit("")))).alias("word"))
    counts = {r[0]: r[1] for r in own.groupBy("word").count().collect()}
    return counts.pop("", 0), counts


def rare_index(n: int, frequency: dict[str, int]) -> list[tuple[int, str, int]]:
    """(template, word, position) of every template's RARE words of highest IDF."""
    idf = lambda w: math.log((1 + n) / (1 + frequency.get(w, 0)))
    out = []
    for k, (_, text, _) in enumerate(TEMPLATES):
        own = text.split()
        rare = sorted(set(own), key=lambda w: (-idf(w), w))[:RARE]
        out += [(k, w, i) for i, w in enumerate(own) if w in rare]
    return out


def license_labels(docs: DataFrame) -> DataFrame:
    """Base places and labels, and the labels of verified templates, of every document."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), words_of(F.col("text").cast("string")).alias("words"))
    index = rare_index(*document_frequency(docs))
    rare = F.array(*map(F.lit, sorted({w for _, w, _ in index})))
    labelled = lambda n: lambda i: F.struct(i.alias("at"), F.lit(n).alias("label"))
    # one lambda over a one-element array binds the words, so that they are cut once a row
    scanned = F.transform(
        F.array("words"),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.array_sort(F.flatten(F.array(*(F.transform(places(w, p), labelled(n)) for n, p in BASE.items())))).alias("base"),
            # only files with two different index words can have a verified place; the others' words are not kept
            F.when(F.size(F.array_intersect(w, rare)) >= 2, w).alias("words"),
        ),
    )[0]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", scanned.alias("s")).select("row", "doc_id", "s.*")
    rows = saved(rows, "words")
    files = rows.filter("words is not null").select("row", "words")

    postings = _rows(spark, "template int, word string, at int", index)
    hits = files.select("row", F.posexplode("words").alias("pos", "word")).filter(F.col("word").isin(sorted({w for _, w, _ in index})))
    votes = hits.join(F.broadcast(postings), "word").groupBy("row", "template", (F.col("pos") - F.col("at")).alias("start"))
    votes = votes.agg(F.count_distinct("word").alias("votes")).filter("votes >= 2")
    wanted = _rows(
        spark,
        "template int, label string, want array<string>, keys array<struct<at:int,want:array<string>>>",
        [(k, n, t.split(), [{"at": _at(t, p), "want": p.split()} for p in keys]) for k, (n, t, keys) in enumerate(TEMPLATES)],
    )
    seen = votes.join(F.broadcast(wanted), "template").join(files, "row")
    word = lambda i: F.get("words", F.when(i >= 0, i).otherwise(-1))
    part = lambda at, n: F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.coalesce(word(F.col("start") + at + j), F.lit("")))
    cover = F.size(F.filter(F.transform("want", lambda w, i: w == F.coalesce(word(F.col("start") + i), F.lit(""))), lambda same: same)) / F.size("want")
    good = seen.withColumn("cover", cover).filter((F.col("cover") >= MIN_COVER) & F.forall("keys", lambda k: part(k.at, F.size(k.want)) == k.want))
    labels = good.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("cover").alias("cover"))

    base = F.array_sort(F.array_distinct(F.col("base.label")))
    out = rows.drop("words").join(labels, "row", "left")
    return out.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.at").cast("long").alias("first_word"),
        F.array_max("base.at").cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("more", F.lit([]).cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("cover", F.lit(0.0))).alias("score"),
    )


def _rows(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A small constant table, as one literal that the optimizer sees."""
    names = [f.name for f in T._parse_datatype_string(schema)]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    kind = f"array<struct<{', '.join(f'{f.name}:{f.dataType.simpleString()}' for f in T._parse_datatype_string(schema))}>>"
    return spark.range(1).select(F.explode(F.from_json(F.lit(text), kind)).alias("r")).select("r.*")


def _at(template: str, phrase: str) -> int:
    """Place of a phrase in a template."""
    t, p = template.split(), phrase.split()
    return next(i for i in range(len(t)) if t[i : i + len(p)] == p)
