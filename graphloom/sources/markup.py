"""HTML and Markdown sources as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements without visible main text, and limits of reports.
HIDDEN = ("script", "style", "nav", "footer", "header", "aside")
MIN_REPORT, MIN_BODY, MAX_SECTION = 300, 50, 3500


def without_elements(html: Column | str, tags: tuple[str, ...] = HIDDEN) -> Column:
    out = F.col(html) if isinstance(html, str) else html
    for t in tags:
        out = F.regexp_replace(out, f"(?is)<{t}[^>]*>.*?</{t}>", " ")
    return out


def visible_text(html: Column | str) -> Column:
    """Text outside hidden elements and markup, with single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(without_elements(html), "(?s)<[^>]*>", " "), r"\s+", " "))


def text_lines(html: Column | str) -> Column:
    """Trimmed text lines that are not empty, one for each run between tags."""
    cut = F.split(F.regexp_replace(without_elements(html), "(?s)<[^>]*>", "\n"), "\n")
    return F.filter(F.transform(cut, lambda x: F.trim(x)), lambda x: x != "")


def title(html: Column | str) -> Column:
    return F.regexp_extract(F.col(html) if isinstance(html, str) else html, "(?is)<title>(.*?)</title>", 1)


def sections(docs: DataFrame, key: str, content: str) -> DataFrame:
    """(key, section, heading, body) of Markdown cut before headings of one to four signs; short bodies are left out."""
    parts = F.split(F.col(content), r"\n(?=#{1,4} )")
    rows = docs.filter(~F.col(content).contains("Incident Locked") & (F.length(content) >= MIN_REPORT)).select(key, F.posexplode(parts).alias("section", "part"))
    body = F.trim(F.regexp_replace("part", r"^#{1,4} [^\n]*\n?", ""))
    heading = F.trim(F.regexp_extract("part", r"^#{1,4} ([^\n]*)", 1))
    return rows.select(key, F.col("section").cast("long").alias("section"), heading.alias("heading"), F.substring(body, 1, MAX_SECTION).alias("body")).filter(F.length("body") > MIN_BODY)
