"""N-gram Jaccard join by chosen paths.

Each distinct set of word n-grams gets min-hash tokens (place, minimum). In every run a set
follows, from each node, the tokens that the node's own random choice selects, so that a pair
of similarity `threshold` is expected to go on together along one path. Buckets are split
this way until they are small, then compared by brute force; runs are repeated until a pair at
the threshold is missed with a chance of less than about one in a thousand. Buckets too large
for one task are cut into blocks, and pairs of blocks are compared instead.

Candidates are compared by their min-hash signatures with a margin of four standard deviations
and joined to candidate groups; in each group the exact Jaccard similarity of every pair is
computed from the n-grams themselves, in blocks when the group is large. A document's class is
the least id that exact links reach; its links are the other documents at the threshold.

Defined cases: words are those of the contracts (A-Z lower-cased); a text of fewer than n words
is one n-gram; a text without words, or null, links to nothing and is its own class; equal
texts are in one class and count as links; a null id stays null and never names a class that
has another id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm._text import U64, Words, mix, slices
from marlstone.llm.components import components
from marlstone.session import cut_lineage, files_for

WIDTH, THRESHOLD = 5, 0.8
TOKENS, RUNS = 64, 16
#: Buckets of up to SMALL sets are compared at once; up to LARGE in one task; groups are exact in blocks of BLOCK sets and of BLOCK_GRAMS n-grams.
SMALL, LARGE, BLOCK, BLOCK_GRAMS = 64, 4096, 2048, 1 << 20
DEPTH = 3
MARGIN = 0.2
_seeds = np.random.default_rng(5).integers(1, 1 << 63, TOKENS, dtype=np.uint64) | U64(1)
MULTIPLY = (_seeds >> U64(32)).astype(np.uint32) | np.uint32(1)
ADD = _seeds.astype(np.uint32)


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every text's n-grams (not yet distinct) and each text's bounds in them."""
    sizes = np.diff(words.bounds)
    counts = np.where(sizes >= width, sizes - width + 1, (sizes > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    first = np.repeat(words.bounds[:-1], counts) + np.arange(bounds[-1]) - np.repeat(bounds[:-1], counts)
    length = np.repeat(np.minimum(sizes, width), counts)
    total = length.astype(U64)
    padded = np.concatenate([words.hashes, np.zeros(width, dtype=U64)])
    for k in range(width):
        total = mix(total * U64(0x9E3779B97F4A7C15) + np.where(k < length, padded[first + k], U64(0)))
    return total, bounds


def signature(grams: np.ndarray) -> np.ndarray:
    """The minimum of each of TOKENS hash functions over a set of n-grams."""
    least = np.full(TOKENS, 0xFFFFFFFF, dtype=np.uint32)
    folded = (grams ^ (grams >> U64(32))).astype(np.uint32)
    for k in range(0, len(grams), 2048):
        x = folded[k : k + 2048, None] * MULTIPLY + ADD
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        np.minimum(least, x.min(axis=0), out=least)
    return least


def _key(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


def _distinct(words: Words, width: int) -> Iterator[np.ndarray]:
    grams, bounds = shingles(words, width)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield np.unique(grams[a:b])


def sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, row_key, set_key, sig, grams) for each document; set_key is null without words, grams counts distinct n-grams."""
    schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.binary()), ("set_key", pa.binary()), ("sig", pa.binary()), ("grams", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, bounds in slices(batch, "text"):
                found = [(_key(g), signature(g).tobytes(), len(g)) if len(g) else (None, None, 0) for g in _distinct(Words(data, bounds), width)]
                made = [pa.array([f[k] for f in found], schema.types[k + 2]) for k in range(3)]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), rows.column("row_key"), *made], schema=schema)

    return docs.select("doc_id", "text", _row_key().alias("row_key")).mapInArrow(run, "doc_id long, row_key binary, set_key binary, sig binary, grams long")


def _row_key() -> Column:
    """128 bits of a row's id and text, nulls told apart from empty texts."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce(F.concat(F.lit("|"), F.col("text")), F.lit("")))))


def _chosen(path: np.ndarray, sig: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, next path) for every token that a row's node selects."""
    token = mix(sig.astype(U64) + (np.arange(TOKENS, dtype=U64) << U64(32)))
    onward = mix(token + path[:, None] * U64(0x9E3779B97F4A7C15), 0x51)
    row, at = np.nonzero(mix(onward, 0x7F) < U64(int(2.0**64 / (threshold * TOKENS))))
    return row, onward[row, at]


def paths(found: DataFrame, threshold: float, runs: int) -> DataFrame:
    """(path, set_key): the first nodes of every run for each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 1000):
                batch = whole.slice(first, 1000)
                sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint32).reshape(-1, TOKENS)
                for r in range(runs):
                    row, path = _chosen(np.full(len(sig), mix(np.array([r + 1], dtype=U64))[0]), sig, threshold)
                    yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), batch.column("set_key").take(pa.array(row))], names=["path", "set_key"])

    return found.select("set_key", "sig").mapInArrow(run, "path long, set_key binary")


def _forest(sig: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Edges that join all rows connected by similar signatures.

    A search from row to row compares each newly reached row with the rows not yet reached.
    """
    left, edges = np.arange(len(sig)), []
    while len(left):
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            at = stack.pop()
            near = (sig[left] == sig[at]).sum(axis=1) >= least
            edges += [(int(at), int(j)) for j in left[near]]
            stack += left[near].tolist()
            left = left[~near]
    return edges


def _split(sig: np.ndarray, rows: np.ndarray, path: np.ndarray, depth: int, threshold: float, least: int) -> Iterator[tuple[int, int]]:
    """Compare a bucket of one task, split along further chosen tokens while it is large."""
    if len(rows) <= SMALL or depth >= DEPTH:
        yield from ((int(rows[a]), int(rows[b])) for a, b in _forest(sig[rows], least))
        return
    row, onward = _chosen(path, sig[rows], threshold)
    order = np.argsort(onward, kind="stable")
    row, onward = row[order], onward[order]
    cuts = np.flatnonzero(np.append(True, onward[1:] != onward[:-1])) if len(onward) else np.zeros(0, np.int64)
    for a, b in zip(cuts, np.append(cuts[1:], len(onward)), strict=True):
        if b - a > 1:
            yield from _split(sig, rows[row[a:b]], onward[a:b], depth + 1, threshold, least)


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, from rows sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_pylist()
        cuts = [0] + [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] + [len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.Table.from_batches(held)


def _blocked(rows: DataFrame, blocks: Column, id_column: str) -> DataFrame:
    """Add `part`: one part for a group of one block, else one for each pair of blocks."""
    spread = rows.withColumn("blocks", blocks.cast("int")).withColumn("own", F.pmod(F.xxhash64(id_column), F.col("blocks")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return spread.withColumn("part", F.struct(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))).drop("other")


def candidates(found: DataFrame, threshold: float, runs: int) -> DataFrame:
    """(a, b): keys of sets whose signatures are similar, enough of them to join every such group."""
    least = int(np.ceil((threshold - MARGIN) * TOKENS))
    walked = paths(found, threshold, runs)
    sizes = walked.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = walked.join(sizes, "path").join(found.select("set_key", "sig"), "set_key")
    parts = _blocked(members, F.ceil(F.col("n") / F.lit(LARGE)), "set_key")
    dealt = parts.withColumn("bucket", F.xxhash64("path", "part.i", "part.j")).select("bucket", "path", "set_key", "sig")
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, "bucket"):
            keys = group.column("set_key").to_pylist()
            sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), dtype=np.uint32).reshape(-1, TOKENS)
            path = group.column("path").to_numpy().view(U64)
            edges = set(_split(sig, np.arange(len(sig)), path, 1, threshold, least))
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([keys[a] for a, _ in edges], pa.binary()), pa.array([keys[b] for _, b in edges], pa.binary())], names=["a", "b"])

    return dealt.mapInArrow(run, "a binary, b binary")


def _shared(mine: list[np.ndarray], theirs: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """For each set of `mine`, how many n-grams it shares with each of `theirs`."""
    grams = np.concatenate(theirs)
    owner = np.repeat(np.arange(len(theirs)), [len(t) for t in theirs])
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    for i, m in enumerate(mine):
        a, b = np.searchsorted(grams, m), np.searchsorted(grams, m, side="right")
        n = b - a
        at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        yield i, np.bincount(owner[at], minlength=len(theirs))


def _exact(keys: list[bytes], grams: list[np.ndarray], own: np.ndarray, weights: np.ndarray, threshold: float, between: tuple[int, int] | None) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of each set (in documents) and enough edges to join what is linked.

    `between` names two blocks: then only pairs across them count, or within if they are the same.
    """
    links, edges = np.zeros(len(keys), dtype=np.int64), []
    sizes = np.array([len(g) for g in grams])
    parent = np.arange(len(keys))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    left = np.arange(len(keys)) if between is None else np.flatnonzero(own == between[0])
    right = left if between is None or between[0] == between[1] else np.flatnonzero(own == between[1])
    if not len(left) or not len(right):
        return links, edges
    for i, shared in _shared([grams[k] for k in left], [grams[k] for k in right]):
        x = left[i]
        near = right[shared >= threshold * (sizes[x] + sizes[right] - shared) - 1e-9]
        near = near[near != x]
        links[x] += weights[near].sum()
        if right is not left:
            links[near] += weights[x]
        r = root(x)
        for y in near:
            s = root(y)
            if s != r:
                parent[s] = r
                edges.append((int(x), int(y)))
    return links, edges


def links(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, runs: int = RUNS) -> DataFrame:
    """(doc_id, class_id, n_links, row_key, root) for each document; root names the class, null without words."""
    files = files_for(docs)
    rows = cut_lineage(sets(docs, width), files)
    distinct = rows.where("set_key is not null").groupBy("set_key").agg(F.first("sig").alias("sig"), F.first("grams").alias("grams"), F.count(F.lit(1)).alias("weight"), F.min("doc_id").alias("least_id"), F.min("row_key").alias("row_key"))
    distinct = cut_lineage(distinct, files)
    grouped = components(candidates(distinct, threshold, runs), files)
    wanted = grouped.withColumnRenamed("node", "set_key").join(distinct.select("set_key", "row_key", "weight", "grams"), "set_key")
    wanted = wanted.join(wanted.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("grams").alias("held")), "root")
    texts = docs.select("text", _row_key().alias("row_key")).join(wanted, "row_key").select("root", "n", "held", "set_key", "weight", "text")
    dealt = _blocked(texts, F.greatest(F.ceil(F.col("n") / F.lit(BLOCK)), F.ceil(F.col("held") / F.lit(BLOCK_GRAMS))), "set_key").withColumn("bucket", F.xxhash64("root", "part.i", "part.j"))
    dealt = dealt.select("bucket", "set_key", "weight", "blocks", "own", F.col("part.i").alias("i"), F.col("part.j").alias("j"), "text").repartition("bucket").sortWithinPartitions("bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, "bucket"):
            sets_found: dict[bytes, np.ndarray] = {}
            weight, own = {}, {}
            for batch in group.to_batches(max_chunksize=256):
                for part, data, bounds in slices(batch, "text"):
                    for grams, key, w, o in zip(_distinct(Words(data, bounds), width), *(part.column(c).to_pylist() for c in ("set_key", "weight", "own")), strict=True):
                        if key not in sets_found and _key(grams) == key:
                            sets_found[key], weight[key], own[key] = grams, w, o
            keys = list(sets_found)
            pair = (group.column("i")[0].as_py(), group.column("j")[0].as_py())
            between = None if group.column("blocks")[0].as_py() == 1 else pair
            n, edges = _exact(keys, list(sets_found.values()), np.array([own[k] for k in keys]), np.array([weight[k] for k in keys]), threshold, between)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.nulls(len(keys), pa.binary()), pa.array(n)], names=["a", "b", "n"])
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([keys[a] for a, _ in edges], pa.binary()), pa.array([keys[b] for _, b in edges], pa.binary()), pa.array(np.zeros(len(edges), dtype=np.int64))], names=["a", "b", "n"])

    verified = cut_lineage(dealt.mapInArrow(run, "a binary, b binary, n long"), files)
    counted = verified.where("b is null").groupBy(F.col("a").alias("set_key")).agg(F.sum("n").alias("n"))
    joined = components(verified.where("b is not null").select("a", "b"), files).withColumnRenamed("node", "set_key")
    named = distinct.select("set_key", "weight", "least_id").join(joined, "set_key", "left").join(counted, "set_key", "left")
    named = named.withColumn("root", F.coalesce("root", "set_key"))
    classes = named.groupBy("root").agg(F.min("least_id").alias("class_id"))
    named = named.join(classes, "root").select("set_key", "root", "class_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    wordless = rows.where("set_key is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "row_key", F.lit(None).cast("binary").alias("root"))
    return rows.where("set_key is not null").join(named, "set_key").select("doc_id", "class_id", "n_links", "row_key", "root").union(wordless)


def digest(docs: DataFrame) -> DataFrame:
    return links(docs).select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, runs: int = RUNS) -> DataFrame:
    """`docs` with one document of each class: the one with the least id.

    Rows that repeat both id and text stay once.
    """
    found = links(docs, width, threshold, runs)
    first = found.where("n_links > 0").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("least")).select("least.row_key")
    chosen = found.where("n_links = 0").select("row_key").union(first).withColumnRenamed("row_key", "__row_key")
    return docs.withColumn("__row_key", _row_key()).join(chosen, "__row_key", "left_semi").dropDuplicates(["__row_key"]).select(docs.columns)
