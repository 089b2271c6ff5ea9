"""Directories as DataFrames: the driver walks names, executors look at contents."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.config import NAME, OUTPUTS, ScanOptions
from marlstone.functions import kinds
from marlstone.functions.text import lines, markup_text
from marlstone.operators import audit, chunk
from marlstone.session import cut_lineage, ensure_importable
from marlstone.sources import extract

PROBE = 8192
REASONS = ("Ignored directory", "Filtered path", "Too large", "Binary")


def _inside(name: str, prefixes: tuple[str, ...]) -> bool:
    parts = name.split("/")
    return any(parts[: len(p)] == p for p in ([x for x in prefix.split("/") if x not in ("", ".")] for prefix in prefixes))


def _leads_to(name: str, prefixes: tuple[str, ...]) -> bool:
    """Whether a folder lies in a prefix, or a prefix in it."""
    return not prefixes or _inside(name, prefixes) or any(_inside(prefix, (name,)) for prefix in prefixes)


def walk(source: str, options: ScanOptions) -> Iterator[tuple[str, int, int, str | None]]:
    """(path, size, modified ns, reason) of files to look at (no reason) and of what is left out.

    Links are followed; a loop or anything unreadable ends the scan with an error.
    """
    if not os.path.exists(source):
        raise FileNotFoundError(source)
    if not os.path.isdir(source):
        raise NotADirectoryError(source)

    def visit(folder: str) -> Iterator[tuple[str, int, int, str | None]]:
        for name in sorted(os.listdir(os.path.join(source, folder))):
            path = f"{folder}/{name}" if folder else name
            full = os.path.join(source, path)
            held = os.stat(full)
            if _inside(path, options.excluded):
                yield path, held.st_size, held.st_mtime_ns, "Filtered path"
            elif os.path.isdir(full):
                hidden = name.startswith(".") and name != ".github"
                if not _leads_to(path, options.included):
                    yield path, 0, held.st_mtime_ns, "Filtered path"
                elif hidden or name in options.ignored or sum(os.path.isfile(os.path.join(full, o)) for o in OUTPUTS) >= 2:
                    yield path, 0, held.st_mtime_ns, "Ignored directory"
                else:
                    yield from visit(path)
            elif os.path.isfile(full):
                if options.included and not _inside(path, options.included):
                    yield path, held.st_size, held.st_mtime_ns, "Filtered path"
                elif name not in (*OUTPUTS, NAME):
                    yield path, held.st_size, held.st_mtime_ns, None

    yield from visit("")


def looks_binary(probe: bytes, cut: bool) -> bool:
    """A NUL byte, or bytes that aren't UTF-8; a character cut off by the probe's end doesn't count."""
    if b"\0" in probe:
        return True
    try:
        probe.decode("utf-8")
    except UnicodeDecodeError as e:
        return not (cut and e.reason == "unexpected end of data")
    return False


@dataclass
class Scan:
    """files(path, size, modified, kind) and skipped(path, reason)."""

    source: str
    options: ScanOptions
    files: DataFrame
    skipped: DataFrame

    def kind_counts(self) -> DataFrame:
        return self.files.groupBy(kinds.label(F.col("kind")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))

    def skip_counts(self) -> DataFrame:
        return self.skipped.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def scan(spark: SparkSession, source: str, options: ScanOptions = ScanOptions()) -> Scan:
    ensure_importable(spark)
    listed = spark.createDataFrame(list(walk(source, options)), "path string, size long, modified long, reason string").withColumn("kind", kinds.kind_of(F.col("path")))
    packaged = F.col("kind").isin(*kinds.PACKAGED)
    large = F.col("size") > F.when(packaged, options.max_document_bytes).otherwise(options.max_file_bytes)
    judged = listed.withColumn("reason", F.coalesce("reason", F.when(large, "Too large")))
    top = os.path.abspath(source)

    def sniff(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reasons = batch.column("reason").to_pylist()
            for i, (path, kind) in enumerate(zip(batch.column("path").to_pylist(), batch.column("kind").to_pylist(), strict=True)):
                if reasons[i] is None and kind not in kinds.PACKAGED:
                    with open(os.path.join(top, path), "rb") as held:
                        probe = held.read(PROBE)
                        reasons[i] = "Binary" if looks_binary(probe, bool(held.read(1))) else None
            yield batch.set_column(batch.schema.names.index("reason"), "reason", pa.array(reasons, pa.string()))

    sniffed = cut_lineage(judged.mapInArrow(sniff, judged.schema))  # a listing; every file is opened once
    return Scan(source, options, sniffed.where("reason is null").select("path", "size", "modified", "kind"), sniffed.where("reason is not null").select("path", "reason"))


def documents(files: DataFrame, source: str, options: ScanOptions = ScanOptions()) -> tuple[DataFrame, DataFrame]:
    """(documents(path, kind, text), issues(path, message)) of scanned files; one read in part gives both, kinds without an extractor neither."""
    top, seconds = os.path.abspath(source), options.pdf_timeout_seconds
    ensure_importable(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, kind in zip(batch.column("path").to_pylist(), batch.column("kind").to_pylist(), strict=True):
                text = message = None
                try:
                    text, message = extract.read(os.path.join(top, path), kind, seconds)
                except Exception as e:  # noqa: BLE001  a document that can't be read is an issue, not the end
                    message = str(e) or type(e).__name__
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.string()) for v in (path, kind, text, message)], names=["path", "kind", "text", "message"])

    # the texts are stored, so that no file is extracted again for its issues or for another chunker
    read = cut_lineage(files.where("kind != 'other'").select("path", "kind").mapInArrow(run, "path string, kind string, text string, message string"))
    marked = F.when(F.col("kind").isin("html", "xml"), markup_text(F.col("text"))).otherwise(F.col("text"))
    return read.where("text is not null").select("path", "kind", marked.alias("text")), read.where("message is not null").select("path", "message")


@dataclass
class Corpus:
    scan: Scan
    documents: DataFrame
    chunks: DataFrame
    findings: DataFrame
    issues: DataFrame


def load(spark: SparkSession, source: str, options: ScanOptions = ScanOptions()) -> Corpus:
    found = scan(spark, source, options)
    docs, issues = documents(found.files, source, options)
    return Corpus(found, docs, chunk.split(docs), audit.audit(docs), issues)


def from_table(df: DataFrame, path, text, kind: str = "text") -> DataFrame:
    """documents(path, kind, text) from any table."""
    return df.select(path.cast("string").alias("path"), F.lit(kind).alias("kind"), text.cast("string").alias("text"))


def line_count(docs: DataFrame) -> DataFrame:
    return docs.select("path", F.size(lines(F.col("text"))).alias("n"))
