"""Incremental index: Parquet snapshots of files and passages, refreshed by comparing listings.

An index lies in a folder on any file system that driver and executors share. A small pointer file,
put in its place in one step, names the parts that count, with the schema version, the scan's
fingerprint and the time. A part is a snapshot, or what a stream's batch added to it. Parts that
the pointer no longer names stay for `GRACE_SECONDS`, for readers that began with them.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.session import Folder, cut_lineage

VERSION = 2
POINTER = "current.json"
KEYS = ["size", "modified", "kind"]
#: Age at which parts that nothing names are deleted, and parts to which appending grows before they are joined.
GRACE_SECONDS, MOST_PARTS = 3600, 32


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, state) of files in either listing: reused, updated, added or removed."""
    mine = before.select("path", F.struct(*KEYS).alias("was"))
    theirs = after.select("path", F.struct(*KEYS).alias("now"))
    state = F.when(F.col("now").isNull(), "removed").when(F.col("was").isNull(), "added").when(F.col("was") == F.col("now"), "reused").otherwise("updated")
    return mine.join(theirs, "path", "full_outer").select("path", state.alias("state"))


def is_fresh(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: whether two listings are the same."""
    return difference(before, after).agg((F.count(F.when(F.col("state") != "reused", 1)) == 0).alias("fresh"))


@dataclass
class Refresh:
    created: bool
    rebuilt: bool
    reused: int
    updated: int
    removed: int
    indexed: int
    chunks: int
    written: bool


class Index:
    """files(path, size, modified, kind, issue) and chunks(..) in the parts of a folder."""

    def __init__(self, spark: SparkSession, folder: str, fingerprint: str = "", grace: float = GRACE_SECONDS):
        self.spark, self.fingerprint, self.grace = spark, fingerprint, grace
        self.folder = Folder(spark, folder)

    def _pointer(self) -> dict | None:
        """What counts, None without an index; a pointer that can't be understood is a ValueError."""
        text = self.folder.read(POINTER)
        if text is None:
            return None
        held = json.loads(text)
        if not isinstance(held, dict) or "version" not in held:
            raise ValueError("the index's pointer names no version")
        if held["version"] == VERSION and not isinstance(held.get("parts"), list):
            raise ValueError("the index's pointer names no parts")
        return held

    def _table(self, pointer: dict, name: str) -> DataFrame:
        """All parts together; of a path that several parts have, the last part counts."""
        parts = [self.spark.read.parquet(self.folder.path(f"{p}/{name}")).withColumn("_part", F.lit(k)) for k, p in enumerate(pointer["parts"])]
        if len(parts) == 1:
            return parts[0].drop("_part")
        files = reduce(DataFrame.unionByName, [self.spark.read.parquet(self.folder.path(f"{p}/files")).select("path").withColumn("_part", F.lit(k)) for k, p in enumerate(pointer["parts"])])
        last = files.groupBy("path").agg(F.max("_part").alias("_part"))
        return reduce(DataFrame.unionByName, parts).join(last, ["path", "_part"], "left_semi").drop("_part")

    def status(self, listing: DataFrame) -> str:
        """missing, corrupt, incompatible, stale or fresh."""
        try:
            pointer = self._pointer()
        except ValueError:
            return "corrupt"
        if pointer is None:
            return "missing"
        if pointer["version"] != VERSION or pointer.get("fingerprint") != self.fingerprint:
            return "incompatible"
        try:
            files = self._table(pointer, "files")
        except AnalysisException:  # a part is missing or holds no table
            return "corrupt"
        if not {"path", *KEYS} <= set(files.columns):
            return "corrupt"
        return "fresh" if is_fresh(files, listing).first().fresh else "stale"

    def refresh(self, listing: DataFrame, extract, force: bool = False) -> Refresh:
        """Bring the index up to date. extract(files) gives (chunks, issues(path, message)) of a part of the listing."""
        listing = cut_lineage(listing)
        state = self.status(listing)
        usable = state in ("fresh", "stale") and not force
        pointer = self._pointer() if usable else None
        if usable and state == "fresh":
            n = self._table(pointer, "files").count()
            return Refresh(False, False, n, 0, 0, n, self._table(pointer, "chunks").count(), False)
        changes = cut_lineage(difference(self._table(pointer, "files"), listing)) if usable else listing.select("path", F.lit("added").alias("state"))
        count = {r.state: r.n for r in changes.groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()}
        chunks, issues = extract(listing.join(changes.where("state in ('added', 'updated')"), "path", "left_semi"))
        files = listing.join(issues.groupBy("path").agg(F.min("message").alias("issue")), "path", "left")
        if usable:
            kept = changes.where("state = 'reused'")
            chunks = chunks.unionByName(self._table(pointer, "chunks").join(kept, "path", "left_semi"))
            old = self._table(pointer, "files").join(kept, "path", "left_semi").select("path", F.col("issue").alias("_old"))
            files = files.join(old, "path", "left").withColumn("issue", F.coalesce("issue", "_old")).drop("_old")
        part = self._store(files, chunks)
        self._point([part])
        new = count.get("added", 0) + count.get("updated", 0)
        return Refresh(state == "missing", force or state in ("corrupt", "incompatible"), count.get("reused", 0), new, count.get("removed", 0), new + count.get("reused", 0), self.chunks().count(), True)

    def append(self, files: DataFrame, chunks: DataFrame) -> None:
        """Add a part; its files replace those of the same path. What is there is read only when parts are joined."""
        try:
            pointer = self._pointer()
        except ValueError:
            pointer = None
        parts = pointer["parts"] if pointer and pointer["version"] == VERSION else []
        # of a path that a batch holds twice, the latest counts
        latest = Window.partitionBy("path").orderBy(F.col("modified").desc())
        files = files.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")
        self._point([*parts, self._store(files if "issue" in files.columns else files.withColumn("issue", F.lit(None).cast("string")), chunks)])
        if len(parts) + 1 >= MOST_PARTS:
            self._point([self._store(self.files(), self.chunks())])

    def _store(self, files: DataFrame, chunks: DataFrame) -> str:
        part = f"part-{uuid.uuid4().hex}"
        files.write.parquet(self.folder.path(f"{part}/files"))
        chunks.write.parquet(self.folder.path(f"{part}/chunks"))
        return part

    def _point(self, parts: list[str]) -> None:
        self.folder.write(POINTER, json.dumps({"version": VERSION, "fingerprint": self.fingerprint, "parts": parts, "updated": int(time.time())}))
        self.folder.write(".gitignore", "*\n")
        for name in self.folder.names():
            if name.startswith("part-") and name not in parts and self.folder.modified(name) <= time.time() - self.grace:
                self.folder.delete(name)

    def issues(self) -> DataFrame:
        return self.files().where("issue is not null").select("path", F.col("issue").alias("message"))

    def files(self) -> DataFrame:
        return self._table(self._pointer(), "files")

    def chunks(self) -> DataFrame:
        return self._table(self._pointer(), "chunks")

    def clear(self) -> bool:
        """Remove the index's own files; whether there were any."""
        own = [n for n in self.folder.names() if n.startswith(("part-", f".{POINTER}", "..gitignore")) or n in (POINTER, ".gitignore", f".{POINTER}.crc", "..gitignore.crc")]
        for name in own:
            self.folder.delete(name)
        self.folder.remove_if_empty()
        return bool(own)
