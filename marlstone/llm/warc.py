"""WARC records with a Merkle fixity audit of replicas.

Records are dealt into segments (WARC files) and ordered; each has an offset range in its
segment. A leaf is the SHA-256 of a record; a node hashes its ordered children's offset ranges
and digests, FAN to a node, up to each segment's root and on to one root of the replica. Two
replicas are tables of their own, each placed and ranged by itself. They are compared from the
root down, level by level, and only children of nodes that differ are looked at, so intact
branches are never read below their top. Leaves that differ are aligned by record name.

States: intact; moved (the same bytes at another offset range); corrupt (other bytes under the
same name); missing (not in the replica); extra (only in the replica, without a digest, place and
range of the original's).

Defined cases: null html or URLs are empty; repeated rows are records of their own; ties in
the order are told apart by the record's digest; an empty table has no records and equal
(absent) roots; other columns are ignored. The reader takes a record to the end that its header
states; where no record follows there, to the next record's first line, so that damage stays in
its record.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.session import cut_lineage, shared_folder

FAN = 16
#: Records in a segment on average.
SEGMENT = 1000
#: Partitions that segments are dealt to at most; beyond it a task writes several, one after the other.
PARTITIONS = 20_000


MARK = b"WARC/1.0\r\n"
FIELD = re.compile(rb"\r\n(WARC-Record-ID: <urn:md5:(?P<name>[^>]*)>|WARC-Page: (?P<page>-?\d+)|Content-Length: (?P<size>\d+))(?=\r\n)")


def record(url: Column, html: Column, page_id: Column) -> Column:
    """A WARC/1.0 resource record as text."""
    url, html = F.coalesce(url, F.lit("")), F.coalesce(html, F.lit(""))
    page = F.coalesce(F.concat(F.lit("\r\nWARC-Page: "), page_id.cast("string")), F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.regexp_replace(url, "[\r\n]", " "), F.lit("\r\nWARC-Record-ID: <urn:md5:"), name_of(url, page_id), F.lit(">"), page,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"), html, F.lit("\r\n\r\n"),
    )


def name_of(url: Column, page_id: Column) -> Column:
    return F.md5(F.concat_ws("|", page_id.cast("string"), F.coalesce(url, F.lit(""))))


def segment(url: Column, page_id: Column, segments: int) -> Column:
    return (F.conv(F.substring(name_of(url, page_id), 1, 8), 16, 10).cast("long") % F.lit(segments)).cast("int")


def placed(records: DataFrame) -> DataFrame:
    """Add `place` and the byte range [`first`, `last`) in its segment to (segment, page_id, digest, bytes, ..)."""
    order = Window.partitionBy("segment").orderBy(F.col("page_id").asc_nulls_first(), "digest")
    upto = F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return records.withColumn("place", (F.row_number().over(order) - 1).cast("long")).withColumn("last", upto).withColumn("first", F.col("last") - F.col("bytes"))


def write_segments(pages: DataFrame, path: str, segments: int) -> None:
    """Store the pages' records as compressed WARC files, a folder for each segment, in the order of page_id."""
    rows = pages.select(segment(F.col("url"), F.col("page_id"), segments).alias("segment"), "page_id", record(F.col("url"), F.col("html"), F.col("page_id")).alias("value"))
    _store(rows.repartition(min(segments, PARTITIONS), "segment").sortWithinPartitions("segment", F.col("page_id").asc_nulls_first(), F.sha2("value", 256)), path)


def _store(rows: DataFrame, path: str) -> None:
    """Write (segment, value), each segment's rows in one partition and in order; every value ends with a line end."""
    # the writer ends each record with the last byte of its closing line ends
    rows.select("segment", F.expr("substring(value, 1, length(value) - 1)").alias("value")).write.partitionBy("segment").option("lineSep", "\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def records_in(data: bytes) -> Iterator[tuple[int, int, str | None, int | None]]:
    """(first, last, name, page id) of each record in a WARC file."""
    at = 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        fields: dict[str, bytes] = {}
        for m in FIELD.finditer(data, at, head + 2) if head >= 0 else ():
            fields |= {k: v for k, v in m.groupdict().items() if v is not None and k not in fields}
        end = head + 8 + int(fields["size"]) if "size" in fields else at
        if end != len(data) and not (end > at and data.startswith(MARK, end)):
            # a record whose bytes are fewer than stated ends before that, one with more after it
            following = data.find(b"\r\n" + MARK, max(at, head))
            end = following + 2 if following >= 0 else len(data)
        yield at, end, fields["name"].decode("utf-8", "replace") if "name" in fields else None, int(fields["page"]) if "page" in fields else None
        at = end


RECORDS = pa.schema([
    ("segment", pa.int32()), ("place", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("name", pa.string()), ("page_id", pa.int64()),
    ("digest", pa.string()), ("bytes", pa.int64()), ("record", pa.binary()),
])
RECORDS_DDL = "segment int, place long, first long, last long, name string, page_id long, digest string, bytes long, record binary"


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Every record of stored WARC files with its place, byte range and digest; a file is read by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, content in zip(batch.column("segment").to_pylist(), batch.column("content"), strict=True):
                packed = zlib.decompressobj(47)
                data = packed.decompress(content.as_buffer())
                while packed.unused_data:  # one member for each record is usual
                    left, packed = packed.unused_data, zlib.decompressobj(47)
                    data += packed.decompress(left)
                found = [(number, k, a, b, name, page, hashlib.sha256(data[a:b]).hexdigest(), b - a, data[a:b]) for k, (a, b, name, page) in enumerate(records_in(data))]
                for k in range(0, len(found), 500):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found[k : k + 500], strict=True), RECORDS, strict=True)], schema=RECORDS)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"segment=(-?\d+)", 1).cast("int").alias("segment"), "content").mapInArrow(run, RECORDS_DDL)


def tree(leaves: DataFrame, last_place: int, last_segment: int) -> list[DataFrame]:
    """Levels from the leaves (segment, place, first, last, digest) up to the one root.

    Nodes are keyed by (segment, place); above the segments' roots, segments are grouped the
    same way under segment -1. The last place and segment of either replica give both the same height.
    """
    levels = [leaves.select("segment", "place", "first", "last", "digest")]
    for kind, width in (("within", last_place), ("across", last_segment)):
        base = levels[-1]
        if kind == "across":
            base = base.select(F.lit(-1).alias("segment"), F.col("segment").cast("long").alias("place"), "first", "last", "digest")
            levels[-1] = base
        while width:
            grouped = base.groupBy("segment", F.floor(F.col("place") / FAN).cast("long").alias("up"))
            children = F.array_sort(F.collect_list(F.struct("place", "first", "last", "digest")))
            nodes = grouped.agg(children.alias("c")).select(
                "segment", F.col("up").alias("place"), F.col("c")[0]["first"].alias("first"), F.element_at("c", -1)["last"].alias("last"),
                F.sha2(F.concat_ws(",", F.transform("c", lambda c: F.concat_ws(":", c["place"].cast("string"), c["first"].cast("string"), c["last"].cast("string"), c["digest"]))), 256).alias("digest"),
            )
            base = cut_lineage(nodes)
            levels.append(base)
            width //= FAN
    return levels


def differences(mine: list[DataFrame], theirs: list[DataFrame], segment_level: int) -> DataFrame:
    """(segment, place) of the leaves that differ or are missing on a side, found from the root down.

    `segment_level` is the level whose nodes are the segments' roots.
    """
    bad = None
    for level in range(len(mine) - 1, -1, -1):
        sides = []
        for levels in (mine, theirs):
            rows = levels[level].select("segment", "place", F.struct("first", "last", "digest").alias("node"))
            if bad is not None:
                if level == segment_level - 1:  # from segments' roots to the nodes in them
                    top = bad.select(F.col("place").cast("int").alias("segment")).distinct()
                    rows = rows.join(top, "segment", "left_semi")
                else:
                    up = bad.select("segment", F.col("place").alias("up")).distinct()
                    rows = rows.withColumn("up", F.floor(F.col("place") / FAN).cast("long")).join(up, ["segment", "up"], "left_semi").drop("up")
            sides.append(rows)
        other = sides[1].withColumnRenamed("node", "other")
        bad = sides[0].join(other, ["segment", "place"], "full_outer").where(~F.col("node").eqNullSafe(F.col("other"))).select("segment", "place")
        bad = cut_lineage(bad)
    return bad


def aligned(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Leaves that differ, paired by name: records of equal bytes first, then what is left in order."""
    theirs = theirs.select("segment", "name", F.col("page_id").alias("replica_page_id"), F.col("digest").alias("replica_digest"), F.col("place").alias("replica_place"), F.col("first").alias("replica_first"), F.col("last").alias("replica_last"))
    alike = Window.partitionBy("segment", "name", "digest").orderBy("place")
    mine = mine.withColumn("nth", F.row_number().over(alike))
    theirs = theirs.withColumn("digest", F.col("replica_digest")).withColumn("nth", F.row_number().over(alike.orderBy("replica_place")))
    key = ["segment", "name", "digest", "nth"]
    same = mine.join(theirs, key).drop("nth")
    named = Window.partitionBy("segment", "name")
    left = mine.join(theirs.select(key), key, "left_anti").withColumn("nth", F.row_number().over(named.orderBy("place")))
    right = theirs.join(mine.select(key), key, "left_anti").drop("digest").withColumn("nth", F.row_number().over(named.orderBy("replica_place")))
    rest = left.join(right, ["segment", "name", "nth"], "full_outer").drop("nth")
    moved = F.when((F.col("first") == F.col("replica_first")) & (F.col("last") == F.col("replica_last")), "intact").otherwise("moved")
    state = F.when(F.col("replica_digest").isNull(), "missing").when(F.col("digest").isNull(), "extra").when(F.col("digest") == F.col("replica_digest"), moved).otherwise("corrupt")
    return same.unionByName(rest).withColumn("state", state).withColumn("page_id", F.when(F.col("digest").isNull(), F.col("replica_page_id")).otherwise(F.col("page_id"))).drop("replica_page_id", "replica_place")


def audit(records: DataFrame, replica: DataFrame | None = None) -> DataFrame:
    """The original's and the replica's records (segment, page_id, digest, bytes, name) with ranges and `state`.

    Records that come with place, first and last, as the reader gives them, keep these; others are
    placed by page_id. Without `replica`, its digests are those that `records` has as
    replica_digest; without `name`, records are named by page_id.
    """
    if replica is None:
        replica = records.drop("digest").withColumnRenamed("replica_digest", "digest")
    sides = []
    for side in (records, replica):
        name = F.col("name") if "name" in side.columns else F.coalesce(F.col("page_id").cast("string"), F.lit(""))
        columns = ["segment", "page_id", name.alias("name"), "digest", "bytes"]
        if "place" in side.columns:
            sides.append(cut_lineage(side.select(*columns, "place", "last", "first")))
        else:
            sides.append(cut_lineage(placed(side.select(*columns))))
    most = sides[0].unionByName(sides[1]).agg(F.max("place").alias("place"), F.max("segment").alias("segment")).first()
    last_place, last_segment = most.place or 0, most.segment or 0
    segment_level, width = 0, last_place
    while width:
        width //= FAN
        segment_level += 1
    bad = differences(*(tree(side, last_place, last_segment) for side in sides), segment_level)
    if segment_level == 0:  # one record to a segment: the leaves are the segments' roots
        bad = bad.select(F.col("place").cast("int").alias("segment"), F.lit(0).cast("long").alias("place"))
    on = ["segment", "place"]
    intact = sides[0].join(bad, on, "left_anti").withColumns({"replica_digest": F.col("digest"), "replica_first": F.col("first"), "replica_last": F.col("last"), "state": F.lit("intact")})
    return intact.unionByName(aligned(*(side.join(bad, on, "left_semi") for side in sides)))


#: Harm that the drill does, each to the records whose names begin with the given digits.
HARMS = {"damage": "0", "lose": "11", "lengthen": "12", "add": "20"}


def harmed(records: DataFrame, harms: Mapping[str, str]) -> DataFrame:
    """(segment, value) of stored records as a bad copy has them: one byte damaged, lost, lengthened, or followed by one more."""
    value, name = F.col("record").cast("string"), F.coalesce(F.col("name"), F.lit(""))
    hit = {k: name.startswith(v) for k, v in harms.items()}
    if "damage" in hit:
        value = F.when(hit["damage"], F.concat(F.expr("substring(cast(record as string), 1, length(cast(record as string)) - 2)"), F.lit("X\n"))).otherwise(value)
    if "lengthen" in hit:
        value = F.when(hit["lengthen"], F.concat(value, F.lit("more\r\n"))).otherwise(value)
    copies = F.array(value)
    if "add" in hit:
        copies = F.when(hit["add"], F.array(value, F.replace(value, name, F.md5(F.concat(name, F.lit("added")))))).otherwise(copies)
    if "lose" in hit:
        copies = F.when(hit["lose"], F.array().cast("array<string>")).otherwise(copies)
    return records.select("segment", "place", F.posexplode(copies).alias("nth", "value")).sortWithinPartitions("segment", "place", "nth").select("segment", "value")


def drill(pages: DataFrame, harms: Mapping[str, str] = HARMS) -> DataFrame:
    """Store the pages as WARC files, store a copy of those with `harms` done to it, read both and audit them."""
    spark = pages.sparkSession
    segments = max(1, -(-pages.count() // SEGMENT))
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_segments(pages, f"{folder}/original", segments)
    _store(harmed(read_segments(spark, f"{folder}/original"), harms), f"{folder}/replica")
    found = audit(*(read_segments(spark, f"{folder}/{side}").drop("record") for side in ("original", "replica")))
    stored = spark._jvm.org.apache.hadoop.fs.Path(folder)
    stored.getFileSystem(spark._jsc.hadoopConfiguration()).delete(stored, True)  # the audit holds checkpoints of its own
    return found.select("page_id", F.col("segment").cast("long").alias("segment"), "place", "first", "last", F.col("digest").alias("record_sha256"), "replica_digest", "replica_first", "replica_last", "state")


DRILL_SQL = r"""
WITH n AS (SELECT greatest(1, CAST(ceil(count(*) / 1000.0) AS BIGINT)) AS s FROM pages),
r AS (SELECT page_id, coalesce(url, '') AS u, coalesce(html, '') AS h, md5(concat_ws('|', CAST(page_id AS VARCHAR), coalesce(url, ''))) AS name FROM pages),
t AS (SELECT page_id, name, CAST(('0x' || substr(name, 1, 8)) AS BIGINT) % (SELECT s FROM n) AS segment, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || u || chr(13) || chr(10) || 'WARC-Record-ID: <urn:md5:' || name || '>' || coalesce(chr(13) || chr(10) || 'WARC-Page: ' || CAST(page_id AS VARCHAR), '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || CAST(octet_length(encode(h)) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || h || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM r),
o AS (SELECT page_id, name, segment, record, sha256(record) AS digest, row_number() OVER (PARTITION BY segment ORDER BY page_id NULLS FIRST, sha256(record)) - 1 AS place FROM t),
copied AS (SELECT page_id, name, segment, place, 0 AS nth, CASE WHEN starts_with(name, '0') THEN substr(record, 1, length(record) - 2) || 'X' || chr(10) WHEN starts_with(name, '12') THEN record || 'more' || chr(13) || chr(10) ELSE record END AS record FROM o WHERE NOT starts_with(name, '11')
  UNION ALL SELECT page_id, md5(name || 'added'), segment, place, 1, replace(record, name, md5(name || 'added')) FROM o WHERE starts_with(name, '20')),
a AS (SELECT page_id, name, segment, place, digest, sum(octet_length(encode(record))) OVER (PARTITION BY segment ORDER BY place ROWS UNBOUNDED PRECEDING) AS last, octet_length(encode(record)) AS bytes FROM o),
b AS (SELECT page_id, name, segment, sha256(record) AS digest, sum(octet_length(encode(record))) OVER (PARTITION BY segment ORDER BY place, nth ROWS UNBOUNDED PRECEDING) AS last, octet_length(encode(record)) AS bytes FROM copied)
SELECT coalesce(a.page_id, b.page_id) AS page_id, coalesce(a.segment, b.segment) AS segment, a.place, CAST(a.last - a.bytes AS BIGINT) AS first, CAST(a.last AS BIGINT) AS last, a.digest AS record_sha256, b.digest AS replica_digest,
  CAST(b.last - b.bytes AS BIGINT) AS replica_first, CAST(b.last AS BIGINT) AS replica_last,
  CASE WHEN b.name IS NULL THEN 'missing' WHEN a.name IS NULL THEN 'extra' WHEN a.digest <> b.digest THEN 'corrupt' WHEN a.last = b.last AND a.bytes = b.bytes THEN 'intact' ELSE 'moved' END AS state
FROM a FULL OUTER JOIN b ON a.segment = b.segment AND a.name = b.name
"""
