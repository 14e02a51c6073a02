"""Reports, listings, replies and paths as column expressions: what the scrapers, parsers and file sinks compute."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ingest import SKIPPED

#: Markers of vendored paths.
VENDOR = ("node_modules", "/forge-std/", "/openzeppelin/", "/solmate/", "/solady/", "/@openzeppelin/", "/test/", "/tests/", "/mock/", "/mocks/", "/script/", "/artifacts/", "/cache/", "/out/", "/build/")
#: Ids of test pings, and the headings that cut a report without Markdown headers.
PINGS = ("TEST", "TESTTASK", "PING", "DUMMY")
HEADINGS = (
    "Root Cause Analysis", "1. Incident Overview", "2. Key Background", "3. Vulnerability Analysis", "4. Detailed Root Cause", "5. Adversary Flow", "6. Impact", "7. References", "Code Analysis", "Execution Trace",
    "Report Content",
)
_EDGE = r"^\s+|\s+$"


def stripped(text: Column | str) -> Column:
    return F.regexp_replace(text, _EDGE, "")


def scope_entries(rows: DataFrame, line: str) -> DataFrame:
    """Rows with a scope line that is neither blank nor a comment, as `entry` without leading dots and slashes."""
    own = rows.withColumn("entry", stripped(line)).filter((F.col("entry") != "") & ~F.col("entry").startswith("#"))
    return own.withColumn("entry", F.ltrim("entry", F.lit("./")))


def in_scope(path: Column | str) -> Column:
    """Whether no vendor marker occurs in a path."""
    return ~F.col(path).rlike("|".join(re.escape(m) for m in VENDOR))


def scanned(path: Column | str) -> Column:
    """Whether no component of a path is one that the scan passes over."""
    return ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, SKIPPED)))


def is_ping(task_id: Column, url: Column) -> Column:
    return (F.coalesce(task_id, F.lit("")) == "") | F.upper(task_id).isin(*PINGS) | (F.coalesce(url, F.lit("")) == "")


def run_folder(parent: Column, stamp: Column) -> Column:
    """Name of an audit's folder: its parent in word characters and hyphens, `audit` if nothing is left, and a time."""
    slug = F.regexp_replace(F.regexp_replace(parent, r"[^\w-]", "_"), "^_+|_+$", "")
    return F.concat(F.when(slug == "", "audit").otherwise(slug), F.lit("_"), stamp)


def safe_id(finding: Column) -> Column:
    return F.regexp_replace(finding, "[/:]", "_")


def contracts_dir(files: DataFrame) -> DataFrame:
    """(repo, folder) of files (repo, path): contracts, src or src/contracts if it is there, else the folder of the first
    source file, else the root."""
    has = lambda d: F.bool_or(F.col("path").startswith(f"{d}/"))
    first = F.min(F.when(F.col("path").endswith(".sol"), F.col("path")))
    rows = files.groupBy("repo").agg(has("contracts").alias("c"), has("src").alias("s"), first.alias("first"))
    folder = F.when(F.col("c"), "contracts").when(F.col("s"), "src").otherwise(F.coalesce(F.regexp_extract("first", "^(.*)/[^/]*$", 1), F.lit("")))
    return rows.select("repo", folder.alias("folder"))


def next_data(html: Column | str, literal: tuple[str, ...]) -> Column:
    """Ids of a listing page: of the first of incidents, data and reports that is not empty, else the literal ones."""
    body = F.regexp_extract(html, r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)
    ids = lambda k: F.transform(F.from_json(F.get_json_object(body, f"$.props.pageProps.{k}"), "array<struct<id:string>>"), lambda x: x.id)
    own = [F.when(F.size(ids(k)) > 0, ids(k)) for k in ("incidents", "data", "reports")]
    return F.coalesce(*own, F.array(*map(F.lit, literal)))


LISTING = r'\\"id\\":\\"([^"\\]+)\\",\\"title\\":\\"([^"\\]+)\\",\\"time\\":\\"([^"\\]+)\\",\\"loss\\":\\"([^"\\]+)\\"'


def listing(text: Column | str) -> Column:
    """Array of (id, title, day, loss) of an escaped listing; times are cut to their day."""
    groups = [F.regexp_extract_all(text, F.lit(LISTING), F.lit(i)) for i in range(1, 5)]
    rows = F.arrays_zip(*(g.alias(n) for g, n in zip(groups, ("id", "title", "time", "loss"), strict=True)))
    return F.transform(rows, lambda r: F.struct(r["id"].alias("id"), r["title"].alias("title"), F.split(r["time"], "T")[0].alias("day"), r["loss"].alias("loss")))


def header_fields(content: Column | str, stem: Column) -> dict[str, Column]:
    """Title, date, loss and link of a report, each with its default."""
    found = lambda p: F.nullif(F.regexp_extract(content, p, 1), F.lit(""))
    return {
        "title": F.coalesce(F.trim(found("## \U0001f6a8 (.+)")), stem),
        "date": F.coalesce(F.trim(found(r"\*\*Date:\*\* (.+?)  \|")), F.lit("unknown")),
        "loss": F.coalesce(F.trim(found(r"\*\*Loss:\*\* (.+)")), F.lit("unknown")),
        "link": F.coalesce(F.trim(found(r"\*\*Link:\*\* \[.+?\]\((.+?)\)")), F.lit("")),
    }


def split_sections(content: Column | str) -> Column:
    """Array of (heading, body): cut before Markdown headers, else at the known headings, else one part; empty bodies go."""
    text = F.col(content) if isinstance(content, str) else content
    cut = F.split(text, r"\n(?=#{1,4} )")
    whole = F.transform(cut, lambda p: stripped(p))
    marked = F.transform(whole, lambda p: F.struct(stripped(F.regexp_replace(F.substring_index(p, "\n", 1), "^#+", "")).alias("heading"), F.when(p.contains("\n"), stripped(F.regexp_replace(p, r"^[^\n]*\n", ""))).otherwise("").alias("body")))
    known = F.slice(F.split(F.regexp_replace(text, "(?m)^(" + "|".join(re.escape(h) for h in HEADINGS) + ")", "\u0001$1\u0002"), "\u0001"), 2, 1 << 30)
    named = F.transform(known, lambda p: F.struct(F.substring_index(p, "\u0002", 1).alias("heading"), stripped(F.substring_index(p, "\u0002", -1)).alias("body")))
    full = lambda a: F.filter(a, lambda s: s.body != "")
    one = F.array(F.struct(F.lit("Report Content").alias("heading"), stripped(text).alias("body")))
    return F.when(F.size(cut) > 1, full(marked)).when(F.size(full(named)) > 0, full(named)).otherwise(one)


def first_fence(text: Column | str, language: str = "solidity") -> Column:
    """Source in the first fence of a language; empty where there is none."""
    return stripped(F.regexp_extract(text, f"(?s)```{language}\\n(.*?)```", 1))


def bullets(text: Column | str, least: int = 20) -> Column:
    """Lines without bullet signs that are longer than `least`."""
    lines = F.transform(F.split(text, "\n"), lambda x: stripped(F.regexp_replace(stripped(x), r"^[-•* ]+", "")))
    return F.filter(lines, lambda x: F.length(x) > least)


REPLY = "array<struct<id:string,title:string,severity:string,category:string,location:string>>"


def reply_rows(text: Column | str) -> Column:
    """Objects of the JSON array of a reply: in a json fence, in a plain fence, or from the first to the last bracket."""
    found = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    body = F.coalesce(found(r"(?s)```json\s*(\[.*?\])\s*```"), found(r"(?s)```\s*(\[.*?\])\s*```"), found(r"(?s)(\[.*\])"))
    return F.from_json(body, REPLY)


def hypotheses(replies: DataFrame, key: str, text: str, hunter: Column) -> DataFrame:
    """(key, id, title, severity, category, location) of the findings in replies, with defaults for what is missing."""
    rows = replies.select(key, hunter.alias("hunter"), F.posexplode(reply_rows(text)).alias("i", "r"))
    number = F.concat(F.upper(F.substring("hunter", 1, 3)), F.lit("-"), F.lpad((F.col("i") + 1).cast("string"), 3, "0"))
    low = F.lower(F.trim("r.severity"))
    severity = F.when(low.isin("critical", "high", "medium", "low", "info"), F.initcap(low)).otherwise("Medium")
    default = lambda c, v: F.coalesce(c, F.lit(v))
    return rows.select(key, F.coalesce("r.id", number).alias("id"), default(F.col("r.title"), "Untitled").alias("title"), severity.alias("severity"), default(F.col("r.category"), "Unknown").alias("category"), default(F.col("r.location"), "").alias("location"))


def match_positions(rows: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(key, at, line, match): places (from 0), lines (from 1) and texts of all matches. Offsets are running sums of the
    parts between matches, so the work is linear in the text."""
    parts = F.transform(F.split(text, pattern), lambda p: F.struct(F.length(p).alias("n"), (F.size(F.split(p, "\n")) - 1).alias("lines")))
    zipped = F.arrays_zip(parts.alias("part"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    own = rows.filter(F.col(text).rlike(pattern)).select(key, F.posexplode(zipped).alias("i", "z")).select(key, "i", "z.part", "z.match")
    w = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    at = F.sum(F.col("part.n") + F.coalesce(F.length("match"), F.lit(0))).over(w) - F.coalesce(F.length("match"), F.lit(0))
    line = F.sum("part.lines").over(w) + 1
    return own.select(key, at.cast("long").alias("at"), line.cast("long").alias("line"), "match").filter("match is not null")


def escaped(text: Column | str) -> Column:
    """HTML-escaped."""
    out = F.col(text) if isinstance(text, str) else text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out
