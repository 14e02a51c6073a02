"""Incremental ingestion: rows that a keyed target does not have yet, and file sources and sinks."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

#: Path components that the source-tree scan passes over.
SKIPPED = ("node_modules", "forge-std", "openzeppelin-contracts", "test", "tests", "mock", "mocks", ".git", "artifacts", "cache", "out", "build", "script")
#: Bytes of unpacked files that a task hands on at once.
UNZIP_BYTES = 16 << 20
ENTRY = pa.schema([("archive", pa.string()), ("path", pa.string()), ("content", pa.binary()), ("failed", pa.string())])


def insert_if_absent(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the batch to append: those whose key the target lacks, one for each key."""
    return batch.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")


def get_or_create(target: DataFrame, names: DataFrame) -> DataFrame:
    """Existing and new rows (name, id); a new id is a digest of the name, so that runs agree."""
    new = names.select("name").distinct().join(target.select("name"), "name", "left_anti").select("name", F.sha2("name", 256).alias("id"))
    return target.unionByName(new)


def scan_sources(spark: SparkSession, root: str, suffix: str = ".sol") -> DataFrame:
    """(path, content) of all files below root with the suffix, without skipped folders."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").text(root, wholetext=True)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return rows.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, SKIPPED))))


def write_graph(nodes: DataFrame, edges: DataFrame, flags: DataFrame, root: str) -> None:
    for name, df in (("nodes", nodes), ("edges", edges), ("flags", flags)):
        df.write.mode("overwrite").parquet(f"{root}/{name}")


def read_graph(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{root}/{n}") for n in ("nodes", "edges", "flags"))


def _unzipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The files of archives (path, content), some megabytes at a time; of an archive with one top folder without that."""
    for b in batches:
        for archive, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            try:
                files = zipfile.ZipFile(io.BytesIO(data.as_py() or b""))
            except zipfile.BadZipFile:
                yield pa.RecordBatch.from_pylist([{"archive": archive, "path": None, "content": None, "failed": "no zip archive"}], schema=ENTRY)
                continue
            names = [x for x in files.infolist() if not x.is_dir()]
            tops = {x.filename.split("/", 1)[0] for x in names}
            wrapped = len(tops) == 1 and all("/" in x.filename for x in names)
            held, size = [], 0
            for x in names:
                row = {"archive": archive, "path": x.filename.split("/", 1)[1] if wrapped else x.filename, "content": None, "failed": None}
                try:
                    row["content"] = files.read(x)
                except (zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError, zlib.error) as e:  # broken, encrypted or of an unknown method
                    row["failed"] = str(e)[:200]
                held.append(row)
                size += len(row["content"] or b"")
                if size >= UNZIP_BYTES:
                    yield pa.RecordBatch.from_pylist(held, schema=ENTRY)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=ENTRY)


def read_archives(spark: SparkSession, root: str) -> DataFrame:
    """(archive, path, content, failed) of all files in the zip archives below root. An archive without files has no row; a
    file that cannot be read has its reason in `failed`. Tasks hold one archive and UNZIP_BYTES, or one file, unpacked."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(root)
    return files.select("path", "content").mapInArrow(_unzipped, "archive string, path string, content binary, failed string")


def scan_archives(spark: SparkSession, root: str, suffix: str = ".sol") -> DataFrame:
    """(archive, path, content) of all text files with the suffix in archives, without skipped folders."""
    rows = read_archives(spark, root).filter(F.col("path").endswith(suffix) & F.col("content").isNotNull())
    own = rows.select("archive", "path", F.decode("content", "UTF-8").alias("content"))
    return own.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, SKIPPED))))


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def append_batch(rows: DataFrame, path: str, batch: int) -> None:
    """Write one numbered batch of a log; a batch that is written again replaces itself."""
    rows.write.mode("overwrite").json(f"{path}/batch={batch}")


def log_stream(rows: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A stream into a log, each row once: batches that run again after a failure replace what they wrote."""
    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda b, i: append_batch(b, path, i))
