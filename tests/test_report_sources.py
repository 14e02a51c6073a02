"""Reports and their sink, traversal from many sources, archives, and logs that are written again."""

import io
import random
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from graphloom.operators import traversal
from graphloom.plans.audit_queries import inputs
from graphloom.plans.views import Views
from graphloom.sources import audit_report, ingest

SF = "/root/testdata/sf0.001"


def test_written_reports_are_the_sections_in_order(spark, tmp_path):
    sections = audit_report.report(*inputs(Views(spark, SF))).cache()
    audit_report.write_report(sections, f"{tmp_path}/reports")
    want = {}
    for r in sorted(sections.collect(), key=lambda r: (r.audit, r.part, r.rank, r.seq)):
        want.setdefault(r.audit, []).append(r.text)
    got = {p.name.removeprefix("audit="): "".join(f.read_text() for f in sorted(p.glob("part-*"))) for p in Path(f"{tmp_path}/reports").glob("audit=*")}
    assert got == {a: "\n".join(t) + "\n" for a, t in want.items()}


def test_report_of_an_audit_without_findings(spark):
    kinds = "audit string, id long, title string, severity string, category string, location string, hunter string, confidence string, description string, attack_scenario string, impact string, evidence array<string>"
    audits = spark.sql("SELECT 'a' AS audit, 'T' AS title, 'me' AS author, DATE'2026-02-03' AS day, 'src' AS target, 1.5D AS seconds, 4 AS raw_count UNION ALL SELECT 'b', 'U', 'me', DATE'2026-02-03', 'src', 0D, 0")
    one = spark.createDataFrame([("b", 1, "x", "High", None, "C.f", "h", "Confirmed", None, None, None, None)], kinds)
    none = (spark.createDataFrame([], "id long, ord int, challenge string, verdict string"), spark.createDataFrame([], "id long, code string"), spark.createDataFrame([], "audit string, id long, structural int, critic int, grave int, history int, total int, tier string"))
    rows = audit_report.report(audits, one, *none).collect()
    text = {a: "\n".join(r.text for r in sorted(rows, key=lambda r: r[:4]) if r.audit == a) for a in "ab"}
    assert "yielded **0 verified finding(s)** from 4 raw hypotheses (4 refuted" in text["a"]
    assert "| Severity | Count |" not in text["a"]
    assert "**1 verified finding(s)** from 1 raw hypotheses (0 refuted" in text["b"]
    assert "### H-01 — x" in text["b"] and "#### Evidence" not in text["b"] and "#### Impact" not in text["b"]


@pytest.mark.parametrize("most", [None, 2])
def test_shortest_paths_of_many_roots(spark, tmp_path, most):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rng = random.Random(4)
    edges = [(f"n{rng.randrange(30):02}", f"n{rng.randrange(30):02}") for _ in range(45)] + [(f"c{i:02}", f"c{(i + 1) % 25:02}") for i in range(25)]
    roots = ["n00", "n01", "c00", "alone", "n00"]
    want = {}
    for root in roots:
        front, seen = {root: [root]}, {root: [root]}
        while front:
            new = {}
            for n, path in front.items():
                for s, d in edges:
                    if s == n and d not in seen:
                        new[d] = min(new.get(d, [*path, d]), [*path, d])
            front = new if most is None or len(next(iter(new.values()), [0])) - 1 <= most else {}
            seen |= front
        want |= {(root, n): p for n, p in seen.items()}
    e, r = spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([(x,) for x in roots], "root string")
    got = {(x.root, x.id): (list(x.path), x.depth) for x in traversal.reach_all(e, r, most).collect()}
    assert got == {k: (p, len(p) - 1) for k, p in want.items()}
    chains = traversal.call_chains(e, r, 1).collect()
    assert {(x.root, x.id) for x in chains} == {k for k, p in want.items() if len(p) <= 2 and any(s == k[1] for s, _ in edges)}


def test_paths_are_stored_as_tables(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rows = traversal.reach_all(spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string"), spark.createDataFrame([("a",)], "root string"))
    assert {r.id: list(r.path) for r in rows.collect()} == {"a": ["a"], "b": ["a", "b"], "c": ["a", "b", "c"]}
    assert not list(tmp_path.rglob("rdd-*")) and not list(tmp_path.rglob("edges-*"))


def archive(path, files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, text)
    path.write_bytes(out.getvalue())


def test_archives(spark, tmp_path, monkeypatch):
    archive(tmp_path / "one.zip", {"repo-main/a.sol": "é", "repo-main/src/b.sol": "b" * 5000, "repo-main/test/t.sol": "t", "repo-main/readme.md": "r", "repo-main/empty/": ""})
    archive(tmp_path / "two.zip", {"x/a.sol": "2", "y.sol": "3"})
    archive(tmp_path / "none.zip", {})
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    (tmp_path / "other.txt").write_text("x")
    whole = {(r.archive.rsplit("/", 1)[1], r.path): r.failed for r in ingest.read_archives(spark, str(tmp_path)).collect()}
    assert {k for k, failed in whole.items() if failed} == {("bad.zip", None)}
    assert ("one.zip", "readme.md") in whole
    got = {(r.archive.rsplit("/", 1)[1], r.path): r.content for r in ingest.scan_archives(spark, str(tmp_path)).collect()}
    assert got == {("one.zip", "a.sol"): "é", ("one.zip", "src/b.sol"): "b" * 5000, ("two.zip", "x/a.sol"): "2", ("two.zip", "y.sol"): "3"}


def test_a_batch_that_runs_again_adds_no_row(spark, tmp_path):
    log = f"{tmp_path}/log"
    rows = spark.createDataFrame([(i, "agent", "call") for i in range(10)], "id long, agent string, action string")
    for part in (rows.filter("id < 4"), rows.filter("id >= 4")):
        part.write.mode("append").parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run starts after the first and finds nothing new
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        ingest.log_stream(stream, log, f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.json(log).count() == 10
    again = spark.read.json(f"{log}/batch=0").select("id", "agent", "action").collect()
    ingest.append_batch(spark.createDataFrame(again), log, 0)
    assert spark.read.json(log).count() == 10
    ingest.append_log(rows.withColumn("action", F.lit("more")), f"{tmp_path}/plain")
    ingest.append_log(rows, f"{tmp_path}/plain")
    assert spark.read.json(f"{tmp_path}/plain").count() == 20
