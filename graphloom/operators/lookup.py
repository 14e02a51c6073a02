"""Source lookups: from a place such as `Vault.withdraw:L12-20` to functions, files and windows of lines.

Files are (path, content); function nodes are (id, name, contract, file, line_start, line_end, ord). Which file is the
first to mention a name is answered by an index of the files' words, joined by equality, instead of a search of every
name in every file. Texts are read only for the distinct places that are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines shown around a function and a reported line, characters of the budgets and of a file's head.
BEFORE, AFTER, BODY = 5, 3, 60
JUDGE_CHARS, PROOF_CHARS, HEAD_CHARS = 6000, 8000, 3000
CALLEES, SHOWN = 3, 12
NOT_AVAILABLE, NOT_FOUND, NOT_HERE = "(source not available)", "(source not found for specified functions)", "(source not found for this location)"

WORD = r"[^A-Za-z0-9_$]+"


def first_files(files: DataFrame, names: DataFrame) -> DataFrame:
    """(name, path): the first file by path whose content contains each name of (name). Names are identifiers, so a file
    contains one if and only if one of its words does; other names find no file.

    Words are cut to every stretch of a name's length, the lengths being those of the names: a few dozen at most."""
    own = names.filter(F.col("name").rlike(r"^[A-Za-z0-9_$]+$")).select("name").distinct()
    lengths = sorted(r[0] for r in own.select(F.length("name")).distinct().collect())
    words = files.select("path", F.explode(F.array_distinct(F.split("content", WORD))).alias("word")).groupBy("word").agg(F.min("path").alias("path"))
    if not lengths:
        return words.select(F.col("word").alias("name"), "path").limit(0)

    def of(n: int) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length("word") - n + 1), lambda i: F.substring(F.col("word"), i, F.lit(n)))
        return F.when(F.length("word") >= n, cut).otherwise(F.array().cast("array<string>"))

    parts = F.flatten(F.array(*map(of, lengths)))
    stretches = words.select(F.explode(F.array_distinct(parts)).alias("name"), "path")
    return stretches.join(own, "name", "left_semi").groupBy("name").agg(F.min("path").alias("path"))


def with_files(defs: DataFrame, files: DataFrame) -> DataFrame:
    """Function nodes with `path`: their own file if there is one of that path, else the first that contains the contract's name."""
    exact = files.select(F.col("path").alias("file"), F.lit(True).alias("there"))
    known = defs.join(exact, "file", "left")
    first = first_files(files, known.filter("there is null").select(F.col("contract").alias("name")))
    return known.join(first.select(F.col("name").alias("contract"), F.col("path").alias("found")), "contract", "left").withColumn("path", F.when(F.col("there"), F.col("file")).otherwise(F.col("found"))).drop("there", "found")


def lines_between(content: Column, start: Column, end: Column) -> Column:
    """Lines start (from 0) to end (exclusive), joined."""
    return F.array_join(F.when(end > start, F.slice(F.split(content, "\n"), start + 1, F.greatest(end - start, F.lit(1)))).otherwise(F.array().cast("array<string>")), "\n")


def n_lines(content: Column) -> Column:
    return F.size(F.split(content, "\n"))


def snippets(defs: DataFrame, files: DataFrame) -> DataFrame:
    """(id, file, start, end, code) of all functions with a first line and a file."""
    rows = with_files(defs.filter("line_start > 0"), files).join(files, "path")
    end = F.least(n_lines(F.col("content")), F.when(F.col("line_end") > 0, F.col("line_end")).otherwise(F.col("line_start") + BODY))
    code = lines_between(F.col("content"), F.greatest(F.lit(0), F.col("line_start") - 1), end)
    cut = rows.select("id", F.col("path").alias("file"), F.col("line_start").alias("start"), "line_end", code.alias("code"))
    return cut.select("id", "file", "start", F.when(F.col("line_end") > 0, F.col("line_end")).otherwise(F.col("start") + n_lines(F.col("code"))).alias("end"), "code")


def blocks(defs: DataFrame, files: DataFrame) -> DataFrame:
    """(id, block, n_code): the titled source of all functions with a first line and a file, with lines around it."""
    rows = with_files(defs.filter("line_start > 0 and contract <> ''"), files).join(files, "path")
    last = F.coalesce("line_end", F.lit(0))
    end = F.least(n_lines(F.col("content")), F.when(last > 0, last + AFTER).otherwise(F.col("line_start") + BODY))
    code = lines_between(F.col("content"), F.greatest(F.lit(0), F.col("line_start") - BEFORE), end)
    title = F.format_string("// %s — %s.%s() (L%d-%d)\n", "path", "contract", "name", "line_start", last)
    return rows.select("id", title.alias("title"), code.alias("code")).select("id", F.concat("title", "code").alias("block"), F.length("code").alias("n_code"))


def soft_join(items: Column, most: int) -> Column:
    """Texts of (text, n) in turn, joined by empty lines, up to and with the one that reaches the budget."""
    start = F.struct(F.array().cast("array<string>").alias("texts"), F.lit(0).alias("used"))
    step = lambda a, x: F.when(a["used"] >= most, a).otherwise(F.struct(F.array_append(a["texts"], x["text"]).alias("texts"), (a["used"] + x["n"]).alias("used")))
    return F.aggregate(items, start, step, lambda a: F.array_join(a["texts"], "\n\n"))


def parsed(location: Column) -> tuple[Column, Column]:
    """Contract and function of a location such as `Vault.withdraw:L12`; function null without a dot before the colon."""
    parts = F.split(F.split(location, ":")[0], r"\.")
    return F.trim(parts[0]), F.trim(F.get(parts, F.lit(1)))


def function_sources(defs: DataFrame, calls: DataFrame, degrees: DataFrame, files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, source) of the wanted functions: their block and those of their first CALLEES callees, the ones with most edges
    first. calls: (src, dst, ord); degrees: (id, degree)."""
    callee = calls.join(wanted.select(F.col("id").alias("src")), "src", "left_semi").join(defs.select(F.col("id").alias("dst")), "dst", "left_semi")
    callee = callee.withColumn("place", F.row_number().over(Window.partitionBy("src").orderBy("ord", "dst"))).filter(F.col("place") <= CALLEES)
    parts = wanted.select(F.col("id").alias("root"), "id", F.lit(0).alias("place")).unionByName(callee.select(F.col("src").alias("root"), F.col("dst").alias("id"), "place"))
    own = parts.join(degrees, "id", "left").join(blocks(defs.join(parts.select("id").distinct(), "id", "left_semi"), files), "id", "left")
    # at most 1 + CALLEES rows of a function come together
    item = F.struct((-F.coalesce("degree", F.lit(0))).alias("first"), "place", F.col("block").alias("text"), F.col("n_code").alias("n"))
    items = F.filter(F.array_sort(F.collect_list(item)), lambda x: x["text"].isNotNull())
    rows = own.groupBy(F.col("root").alias("id")).agg(items.alias("items"))
    return rows.select("id", F.when(F.size("items") > 0, soft_join(F.col("items"), JUDGE_CHARS)).otherwise(NOT_FOUND).alias("source"))


def finding_sources(findings: DataFrame, defs: DataFrame, calls: DataFrame, degrees: DataFrame, files: DataFrame) -> DataFrame:
    """(id, source) of findings (id, location): the function that the location names with its callees, else the head of the
    first file that mentions what stands before the first dot."""
    contract, function = parsed(F.col("location"))
    head = F.trim(F.split("location", r"\.")[0])
    fn = F.when(function.isNotNull(), F.concat(F.lit("fn:"), contract, F.lit("."), function))
    placed = findings.select("id", fn.alias("fn"), head.alias("name"))
    found = placed.select(F.col("fn").alias("id")).distinct().join(defs.select("id"), "id", "left_semi")
    sources = function_sources(defs, calls, degrees, files, found)
    rest = placed.join(found.select(F.col("id").alias("fn")), "fn", "left_anti").select("name").distinct()
    heads = first_files(files, rest).join(files, "path").select("name", F.substring("content", 1, HEAD_CHARS).alias("head"))
    out = placed.join(sources.select(F.col("id").alias("fn"), "source"), "fn", "left").join(heads, "name", "left")
    return out.select("id", F.coalesce("source", "head", F.lit(NOT_AVAILABLE)).alias("source"))


def proof_sources(findings: DataFrame, files: DataFrame) -> DataFrame:
    """(id, source) of findings (id, location): for every part of a comma list such as `Vault.withdraw:L12-20` the lines
    around the reported one in the first file that mentions the contract, up to the part that exceeds the budget."""
    part = findings.select("id", F.posexplode(F.split("location", ",")).alias("place", "part")).withColumn("part", F.trim("part"))
    line = F.regexp_extract("part", r"^(?s:.*):L([^-]*)", 1).try_cast("int")
    name = F.split(F.split("part", ":")[0], r"\.")[0]
    part = part.filter(F.col("part").contains(".") & F.col("part").contains(":L")).select("id", "place", name.alias("name"), line.alias("line")).filter("line is not null")
    asked = part.select("name", "line").distinct()
    start = F.greatest(F.lit(0), F.col("line") - BEFORE)
    windows = asked.join(first_files(files, asked), "name").join(files, "path").withColumn("end", F.least(n_lines(F.col("content")), F.col("line") + BODY))
    windows = windows.select("name", "line", F.concat(F.format_string("// %s (L%d-%d)\n", F.col("path"), start + 1, F.col("end")), lines_between(F.col("content"), start, F.col("end"))).alias("text"))
    # the parts of one location come together; a joint of two characters stands before all but the first
    item = F.struct("place", "text", (F.length("text") + 2).alias("n"))
    own = part.join(windows, ["name", "line"]).groupBy("id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    own = own.select("id", soft_join(F.col("items"), PROOF_CHARS + 3).alias("source"))
    return findings.select("id").join(own, "id", "left").select("id", F.coalesce("source", F.lit(NOT_HERE)).alias("source"))


def named_nodes(hits: DataFrame, defs: DataFrame) -> DataFrame:
    """hits (file, name) with the first function node of that name, whatever its contract."""
    return hits.join(defs.groupBy("name").agg(F.min_by("id", "ord").alias("id")), "name", "left")


def related_functions(findings: DataFrame, defs: DataFrame, most: int = SHOWN) -> DataFrame:
    """(id, fn_ids): of findings (id, location) the functions that the location names, the last first, then others of its
    contract in order, `most` together.

    Of a contract only the first `most` of each name and the first 2 * most of these can be needed, so that a contract
    with very many functions and findings is not multiplied out."""
    dotted = F.col("location").contains(".")
    parts = F.split("location", r"\.")
    placed = findings.select("id", parts[0].alias("contract"), F.when(dotted, F.split(F.get(parts, F.lit(1)), ":")[0]).otherwise("").alias("name"))
    asked = placed.select("contract", "name").distinct()
    nodes = defs.select("contract", "name", F.col("id").alias("fn"), "ord")
    exact = nodes.join(asked, ["contract", "name"]).withColumn("r", F.row_number().over(Window.partitionBy("contract", "name").orderBy(F.desc("ord")))).filter(F.col("r") <= most)
    exact = exact.select("contract", "name", F.lit(0).alias("kind"), (-F.col("ord")).alias("key"), "fn")
    few = nodes.withColumn("r", F.row_number().over(Window.partitionBy("contract", "name").orderBy("ord"))).filter(F.col("r") <= most)
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("contract").orderBy("ord"))).filter(F.col("r") <= 2 * most)
    others = asked.join(few.select("contract", F.col("name").alias("other"), F.lit(1).alias("kind"), F.col("ord").alias("key"), "fn"), "contract").filter("name <> other").drop("other")
    every = exact.unionByName(others).groupBy("contract", "name").agg(F.slice(F.array_sort(F.collect_list(F.struct("kind", "key", "fn"))), 1, most).alias("found"))
    return placed.join(every, ["contract", "name"], "left").select("id", F.coalesce(F.col("found.fn"), F.array().cast("array<string>")).alias("fn_ids"))
