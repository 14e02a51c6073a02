"""Full-text search: stemmed lexemes, all of which must occur, ranked by cover density.

Two ways lead to the places of a query's lexemes: a scan of the texts, which looks at words that begin like a lexeme
only, and a positional inverted table, which is written once and read by its buckets. A cover is a shortest stretch of
words with all lexemes; each adds WEIGHT / (1 + other words in it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stem import SPECIAL, is_stop, stem

#: Fixed value: what a cover of plain words adds.
WEIGHT = 0.1
#: Buckets of a stored index; a query reads those of its lexemes.
BUCKETS = 64


def query_lexemes(spark: SparkSession, text: str) -> list[str]:
    """Distinct stems of the words of a query that are no stop words, in their order."""
    words = F.filter(T.tokens(F.lit(text)), lambda w: ~is_stop(w))
    return list(spark.range(1).select(F.array_distinct(F.transform(words, stem))).first()[0])


def beginning(lexeme: str) -> str:
    """What all words with this stem begin with. Stems are cut from words, but that a last e or i may be new, as what comes
    after the b of `ble` or `bl` (from `biliti`) and the last two letters of a few special stems."""
    if lexeme.endswith("ble") or lexeme in SPECIAL.values():
        return lexeme[: max(1, len(lexeme) - 2)]
    return lexeme[: max(1, len(lexeme) - 1)] if lexeme.endswith(("e", "i", "y", "bl")) else lexeme


def places(chunks: DataFrame, lexemes: list[str]) -> DataFrame:
    """(chunk_id, hits): places from 1 and numbers of the lexemes in each chunk that has all of them, by a scan."""
    rows = chunks
    for x in lexemes:  # a cheap test on the text comes before it is cut into words
        rows = rows.filter(F.lower("chunk_text").contains(beginning(x)))
    like = lambda w: _any([w.startswith(beginning(x)) for x in lexemes])
    words = F.filter(F.transform(T.tokens("chunk_text"), lambda w, i: F.struct((i + 1).alias("pos"), w.alias("word"))), lambda x: like(x["word"]))
    each = rows.select("chunk_id", F.explode(words).alias("x")).select("chunk_id", "x.*").filter(~is_stop(F.col("word")))
    return gathered(each.select("chunk_id", "pos", stem(F.col("word")).alias("lexeme")), lexemes)


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out |= c
    return out


def gathered(each: DataFrame, lexemes: list[str]) -> DataFrame:
    """(chunk_id, hits) of the chunks with all lexemes, from rows (chunk_id, pos, lexeme). A chunk's own hits come together, not more."""
    number = F.array_position(F.array(*map(F.lit, lexemes)), F.col("lexeme")).cast("int")
    rows = each.filter(F.col("lexeme").isin(*lexemes)).groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("pos", number.alias("term")))).alias("hits"))
    return rows.filter(F.size(F.array_distinct("hits.term")) == len(lexemes))


def cover_rank(hits: Column, n: int) -> Column:
    """Cover density of n lexemes over places in ascending order.

    The fold keeps, for each lexeme, its last place and how many hits stood before it. A hit ends a cover if the earliest
    of these last places has moved on since the last cover."""
    start = F.struct(
        F.array_repeat(F.lit(0), n).alias("last"),
        F.array_repeat(F.lit(0), n).alias("order"),
        F.lit(0).alias("seen"),
        F.lit(0).alias("begin"),
        F.lit(0.0).alias("rank"),
    )

    def step(a: Column, h: Column) -> Column:
        mine = lambda own, new: F.transform(own, lambda x, i: F.when(i + 1 == h["term"], new).otherwise(x))
        last, order = mine(a["last"], h["pos"]), mine(a["order"], a["seen"] + 1)

        def grown(both: Column) -> Column:
            begin = F.array_min(both["last"])
            noise = (h["pos"] - begin) - (a["seen"] + 1 - F.array_min(both["order"]))
            new = begin > a["begin"]
            return F.struct(
                both["last"].alias("last"),
                both["order"].alias("order"),
                (a["seen"] + 1).alias("seen"),
                F.when(new, begin).otherwise(a["begin"]).alias("begin"),
                F.when(new, a["rank"] + WEIGHT / (1 + noise)).otherwise(a["rank"]).alias("rank"),
            )

        return F.transform(F.array(F.struct(last.alias("last"), order.alias("order"))), grown)[0]

    return F.aggregate(hits, start, step, lambda a: a["rank"])


def ranked_matches(hits: DataFrame, n: int) -> DataFrame:
    """(chunk_id, score) of all chunks with hits."""
    return hits.select("chunk_id", F.round(cover_rank(F.col("hits"), n), 9).alias("score"))


def search(chunks: DataFrame, text: str, where: Column | None = None) -> DataFrame:
    """(chunk_id, score) of all chunks that have all lexemes of a query; none if it has no lexemes."""
    lexemes = query_lexemes(chunks.sparkSession, text)
    rows = chunks.filter(where) if where is not None else chunks
    if not lexemes:
        return rows.select("chunk_id", F.lit(0.0).alias("score")).limit(0)
    return ranked_matches(places(rows, lexemes), len(lexemes))


def positional_index(chunks: DataFrame) -> DataFrame:
    """The inverted table: (lexeme, chunk_id, positions) of all words but stop words. Only distinct words are stemmed."""
    words = chunks.select("chunk_id", F.posexplode(T.tokens("chunk_text")).alias("pos", "word")).filter(~is_stop(F.col("word")))
    own = words.groupBy("word", "chunk_id").agg(F.collect_list(F.col("pos") + 1).alias("positions"))
    stems = words.select("word").distinct().select("word", stem(F.col("word")).alias("lexeme"))
    return own.join(stems, "word").groupBy("lexeme", "chunk_id").agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))


def write_index(chunks: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Store the inverted table in folders by bucket, each sorted by lexeme, so that a query's filter prunes both. A frequent
    lexeme is spread over files by chunk."""
    rows = positional_index(chunks).withColumn("bucket", F.pmod(F.xxhash64("lexeme"), F.lit(buckets)).cast("int"))
    rows.repartition("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(8))).sortWithinPartitions("lexeme", "chunk_id").write.mode("overwrite").partitionBy("bucket").parquet(path)


def search_index(spark: SparkSession, path: str, text: str, buckets: int = BUCKETS) -> DataFrame:
    """(chunk_id, score) as `search`, from a stored inverted table."""
    lexemes = query_lexemes(spark, text)
    index = spark.read.parquet(path)
    if not lexemes:
        return index.select("chunk_id", F.lit(0.0).alias("score")).limit(0)
    wanted = [r[0] for r in spark.range(1).select(F.explode(F.array(*(F.pmod(F.xxhash64(F.lit(x)), F.lit(buckets)).cast("int") for x in lexemes)))).collect()]
    rows = index.filter(F.col("bucket").isin(*wanted) & F.col("lexeme").isin(*lexemes))
    return ranked_matches(gathered(rows.select("chunk_id", F.explode("positions").alias("pos"), "lexeme"), lexemes), len(lexemes))
