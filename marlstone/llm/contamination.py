"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of `width` consecutive words of each benchmark item (a shorter item
is one window). For each window length there is one searcher: a table gives, for each block of
two words, how far the window may move on; blocks that end a window lead to a bucket of
windows, which are compared word by word, bytes included.

Windows aren't stored: a window is a place in the items' words, and the tables are sorted arrays,
some twenty bytes for each byte of an item. Items travel to executors in blocks of at most
`ITEM_BYTES` of text, so what is broadcast and what a worker holds stay bounded; each block takes
one more pass over the documents. A worker builds a block's tables once.

Defined cases: a null text or item has no words; items without words give no window; equal
items are all reported; an empty table of items contaminates nothing; other columns are kept
out of the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm._text import Words, find, result, slices

WIDTH = 13
ITEM_BYTES = 4 << 20
BLOCK = 2


class Searcher:
    """All windows of one length: places in the items' word numbers `ids`."""

    def __init__(self, length: int, ids: np.ndarray, codes: np.ndarray, first: np.ndarray, last: np.ndarray):
        """codes: of the block that ends at each word; first, last: the bounds of the items that have windows of this length."""
        self.length, self.ids = length, ids
        self.block = min(BLOCK, length)
        self.far = length - self.block + 1
        codes = ids if self.block == 1 else codes
        sizes = last - first
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = inside + np.repeat(first, sizes)
        ends = inside >= self.block - 1
        # a block's least way to the end of a window that holds it is the first window's
        way, block = np.maximum(length - 1 - inside[ends], 0), codes[at[ends]]
        order = np.lexsort((way, block))
        self.blocks, least = np.unique(block[order], return_index=True)
        self.shift = way[order][least].astype(np.int16)
        starts = at[inside <= np.repeat(sizes, sizes) - length]
        suffix = codes[starts + length - 1]
        order = np.argsort(suffix, kind="stable")
        self.suffix, self.starts = suffix[order], starts[order].astype(np.int32)

    def search(self, ids: np.ndarray, codes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(text, first word, places of equal windows) of every occurrence in texts given by word numbers and block codes."""
        codes = ids if self.block == 1 else codes
        found = find(self.blocks, codes)
        step = np.where(found >= 0, self.shift[found] if len(self.shift) else 0, self.far)
        m = self.length
        for d, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            steps, n = step[a:b].tolist(), b - a
            i = m - 1
            while i < n:
                if steps[i]:
                    i += steps[i]
                    continue
                code, start = codes[a + i], a + i - m + 1
                bucket = self.starts[np.searchsorted(self.suffix, code) : np.searchsorted(self.suffix, code, side="right")]
                same = bucket[(self.ids[bucket[:, None] + np.arange(m)] == ids[start : a + i + 1]).all(axis=1)]
                if len(same):
                    yield d, start, same
                i += 1


class Patterns:
    """The searchers of a block of items."""

    def __init__(self, items: list[tuple[int, bytes]], width: int):
        data = np.frombuffer(b"".join(t for _, t in items), dtype=np.uint8)
        self.items = [i for i, _ in items]
        self.words = words = Words(data, np.concatenate([[0], np.cumsum([len(t) for _, t in items])]).astype(np.int64))
        self.hashes, ids = np.unique(words.hashes, return_inverse=True)
        words.hashes = None
        self.base = len(self.hashes) + 1
        codes = self._codes(ids)
        sizes = np.diff(words.bounds)
        lengths = np.minimum(sizes, width)
        self.searchers = [Searcher(int(m), ids, codes, words.bounds[:-1][lengths == m], words.bounds[1:][lengths == m]) for m in np.unique(lengths[lengths > 0])]

    def _codes(self, ids: np.ndarray) -> np.ndarray:
        """The code of each word and the one before it, -1 where either isn't in any item."""
        codes = np.full(len(ids), -1, dtype=np.int64)
        both = (ids[1:] >= 0) & (ids[:-1] >= 0)
        codes[1:][both] = ids[:-1][both] * self.base + ids[1:][both]
        return codes

    def hits(self, words: Words) -> Iterator[tuple[int, int, int, list[int]]]:
        """(text, first word, length, items) of every occurrence of a window."""
        ids = find(self.hashes, words.hashes)
        codes = self._codes(ids)
        mine = self.words
        for searcher in self.searchers:
            m = searcher.length
            for d, start, places in searcher.search(ids, codes, words.bounds):
                wanted = [words.word(start + k) for k in range(m)]
                same = [p for p in places.tolist() if all(mine.word(p + k) == w for k, w in enumerate(wanted))]
                if same:
                    yield d, start, m, [self.items[i] for i in np.unique(np.searchsorted(mine.bounds, same, side="right") - 1)]


class Items:
    """A block of items as it is broadcast; a worker makes its patterns once."""

    def __init__(self, items: list[tuple[int, bytes]], width: int):
        self.items, self.width, self._patterns = items, width, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_patterns": None}

    def patterns(self) -> Patterns:
        if self._patterns is None:
            self._patterns = Patterns(self.items, self.width)
        return self._patterns


def _blocks(benchmark: DataFrame, item_bytes: int) -> Iterator[list[tuple[int, bytes]]]:
    """The items in runs of bounded size; rows are streamed to the driver a partition at a time."""
    held, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).cast("binary")).toLocalIterator():
        if held and size + len(row[1]) > item_bytes:
            yield held
            held, size = [], 0
        held.append((row[0], bytes(row[1])))
        size += len(row[1])
    yield held


FOUND = ("starts", "lengths", "items")
#: A batch, its starts, lengths and items for each text, and its words, to a batch of the result.
Finish = Callable[[pa.RecordBatch, list[list], list[list], list[list], Words], pa.RecordBatch]


def _searched(docs: DataFrame, benchmark: DataFrame, width: int, item_bytes: int, schema: T.StructType | str, finish: Finish) -> DataFrame:
    """`finish` of what all blocks of items find; blocks before the last one hand on what they found in columns of their own."""
    put = tuple(f"__found_{c}" for c in FOUND)
    sent = [docs.sparkSession.sparkContext.broadcast(Items(items, width)) for items in _blocks(benchmark, item_bytes)]
    carried = docs.columns
    between = T.StructType([*docs.schema.fields, *(T.StructField(c, T.ArrayType(k)) for c, k in zip(put, (T.LongType(), T.IntegerType(), T.LongType()), strict=True))])
    for k, block in enumerate(sent):
        first, last = k == 0, k == len(sent) - 1

        def run(batches: Iterator[pa.RecordBatch], block=block, first=first, last=last) -> Iterator[pa.RecordBatch]:
            patterns = block.value.patterns()
            for batch in batches:
                for rows, data, bounds in slices(batch, "text"):
                    starts, lengths, items = ([[] for _ in range(rows.num_rows)] for _ in put) if first else (rows.column(c).to_pylist() for c in put)
                    words = Words(data, bounds)
                    for d, start, length, found in patterns.hits(words):
                        starts[d].append(start - int(words.bounds[d]))
                        lengths[d].append(length)
                        items[d] = sorted({*items[d], *(i for i in found if i is not None)})
                    mine = rows if first else rows.select(carried)
                    if last:
                        yield finish(mine, starts, lengths, items, words)
                    else:
                        found = [pa.array(starts, pa.list_(pa.int64())), pa.array(lengths, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.int64()))]
                        yield pa.RecordBatch.from_arrays([*mine.columns, *found], names=[*mine.schema.names, *put])

        docs = docs.mapInArrow(run, schema if last else between)
    return docs


def find_spans(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, item_bytes: int = ITEM_BYTES, put: tuple[str, str, str] = FOUND) -> DataFrame:
    """`docs` with every occurrence: `starts` and `lengths` in words, and the `items` they belong to.

    Columns of `docs` with these names (or those in `put`) are replaced.
    """
    base = docs.select(*[c for c in docs.columns if c.lower() not in put])
    kinds = (pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()))
    schema = T.StructType([*base.schema.fields, *(T.StructField(c, T.ArrayType(k)) for c, k in zip(put, (T.LongType(), T.IntegerType(), T.LongType()), strict=True))])

    def finish(rows: pa.RecordBatch, starts: list, lengths: list, items: list, words: Words) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(x, k) for x, k in zip((starts, lengths, items), kinds, strict=True))], names=[*rows.schema.names, *put])

    return _searched(base, benchmark, width, item_bytes, schema, finish)


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])
DIGEST_DDL = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> int:
    """How many of n words lie inside any of the spans."""
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + lengths, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def judge(starts: list[int], lengths: list[int], n_words: int) -> tuple[int, bool]:
    hit = covered(np.array(starts, dtype=np.int64), np.array(lengths, dtype=np.int64), n_words) if starts else 0
    return hit, hit > 0 and 20 * hit >= n_words


def _judged(starts: list, lengths: list, words: Words) -> list[tuple[int, bool]]:
    return [judge(s, k, n) for s, k, n in zip(starts, lengths, np.diff(words.bounds).tolist(), strict=True)]


def digest(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, item_bytes: int = ITEM_BYTES) -> DataFrame:
    def finish(rows: pa.RecordBatch, starts: list, lengths: list, items: list, words: Words) -> pa.RecordBatch:
        judged = _judged(starts, lengths, words)
        return result(DIGEST, {
            "doc_id": rows.column("doc_id").cast(pa.int64()), "n_words": np.diff(words.bounds), "n_hit": [h for h, _ in judged], "n_items": [len(i) for i in items],
            "items_sha256": [hashlib.sha256(",".join(sorted(map(str, i))).encode()).hexdigest() for i in items], "contaminated": [c for _, c in judged],
        })

    return _searched(docs.select("doc_id", "text"), benchmark, width, item_bytes, DIGEST_DDL, finish)


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """`docs` without the contaminated rows."""

    def finish(rows: pa.RecordBatch, starts: list, lengths: list, items: list, words: Words) -> pa.RecordBatch:
        return rows.filter(pa.array([not dirty for _, dirty in _judged(starts, lengths, words)], pa.bool_()))

    return _searched(docs, benchmark, width, item_bytes, docs.schema, finish)
