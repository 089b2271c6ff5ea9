"""Language-model scores: the probability of a text summed over all its segmentations into pieces.

A text is its tokens (A-Z lower-cased, cut at ASCII white space), each a blank and the token,
and one end. Unigram weights score every way to spell a token in pieces; a log-space forward
recursion over the token's lattice sums them. Pieces never cross a blank, so a text's log
probability is the sum over its tokens and the end. The weights begin as the vocabulary's and are
estimated from the texts that are not held out: each of `rounds` passes over their distinct tokens
takes every piece's expected count (forward and backward), and the new weights are then frozen.

Beside it stands a word model with add-half smoothing, whose counts come from the texts that
are not held out. Tokens are counted in each task first, then by key, and scored once for the
whole corpus. Texts are dealt into blocks of bounded size; each block lists its distinct tokens
once, and what was found goes back to the blocks that listed them. So no row stands for a single
occurrence, and a common token has a row for each block.

Defined cases: a null text is empty and has the end only; equal texts get equal scores; a null
id counts as an empty one when texts are held out; without any training text all counts are 0,
base_score is 0 and the weights stay the vocabulary's; an empty table gives no rows; other
columns are ignored. Tokens are told apart by 64-bit hashes whose equality is confirmed by bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm import _trie
from marlstone.llm._text import IS_TOKEN, Words, find, result, slices, word_hashes
from marlstone.session import cut_lineage, files_for

#: Bytes of text in a block on average.
BLOCK_BYTES = 20 << 20
#: Partitions that the blocks are dealt to at most; beyond it a partition has several blocks, one after the other.
PARTITIONS = 20_000
#: Distinct tokens that a task holds before it lists them; twice as many before it merges what its slices hold.
HELD = 500_000
#: Passes that estimate the weights, and parts of a count that are told apart in them.
ROUNDS, SHARES = 1, 1 << 20


def held_out(id_column: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1


def _gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """data[start:end] of each pair as one binary array."""
    sizes = ends - starts
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    flat = data[np.repeat(starts - bounds[:-1], sizes) + np.arange(bounds[-1])]
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(flat)])


def _distinct(hashes: np.ndarray, tokens: pa.Array | None, bytes_of) -> tuple[np.ndarray, np.ndarray]:
    """(first place, number) of distinct tokens: by their hashes, and by themselves where `bytes_of` finds a collision."""
    first, inverse = np.unique(hashes, return_index=True, return_inverse=True)[1:]
    if bytes_of(first, inverse):
        return first, inverse
    number: dict[bytes, int] = {}
    inverse = np.array([number.setdefault(t, len(number)) for t in (tokens() if callable(tokens) else tokens.to_pylist())], dtype=np.int64)
    return np.unique(inverse, return_index=True)[1], inverse


def _same_bytes(words: Words, first: np.ndarray, inverse: np.ndarray) -> bool:
    """Whether every word is the one that stands for it."""
    sizes, twin = words.ends - words.starts, first[inverse]
    if (sizes != sizes[twin]).any():
        return False
    begin = np.cumsum(sizes) - sizes
    at = np.arange(int(sizes.sum()))
    return bool((words.low[at + np.repeat(words.starts - begin, sizes)] == words.low[at + np.repeat(words.starts[twin] - begin, sizes)]).all())


def _listed(dealt: DataFrame) -> DataFrame:
    """(block, token, n): distinct tokens of each block (or of a part of it) and their places in training texts."""
    schema = pa.schema([("block", pa.int32()), ("token", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = None, [], 0

        def merged() -> tuple[np.ndarray, np.ndarray, pa.Array]:
            hashes, tokens = np.concatenate([h for h, _, _ in held]), pa.concat_arrays([t for _, _, t in held])
            first, inverse = _distinct(hashes, tokens, lambda f, i: pc.all(pc.equal(tokens.take(pa.array(f[i])), tokens), min_count=0).as_py())
            return hashes[first], np.bincount(inverse, np.concatenate([c for _, c, _ in held])), tokens.take(pa.array(first))

        def out() -> pa.RecordBatch:
            hashes, n, tokens = merged()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(hashes), block, dtype=np.int32)), tokens, pa.array(n.astype(np.int64))], schema=schema)

        for batch in batches:
            blocks = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if held and blocks[a] != block:
                    yield out()
                    held, size = [], 0
                block = int(blocks[a])
                for rows, data, bounds in slices(batch.slice(a, b - a), "text"):
                    words = Words(data, bounds, IS_TOKEN)
                    if not len(words):
                        continue
                    train = np.repeat(rows.column("train").to_numpy(zero_copy_only=False), np.diff(words.bounds))
                    first, inverse = _distinct(words.hashes, lambda w=words: [w.word(i) for i in range(len(w))], lambda f, i, w=words: _same_bytes(w, f, i))
                    held.append((words.hashes[first], np.bincount(inverse, train), _gather(words.low, words.starts[first], words.ends[first])))
                    size += len(first)
                    if size > 2 * HELD:
                        held = [merged()]
                        size = len(held[0][0])
                        if size > HELD:
                            yield out()
                            held, size = [], 0
        if held:
            yield out()

    return dealt.mapInArrow(run, "block int, token binary, n long")


def _marked(batch: pa.RecordBatch) -> list[str]:
    return [" " + t.decode("utf-8", "replace") for t in batch.column("token").to_pylist()]


def _scored(counted: DataFrame, pieces: Broadcast) -> DataFrame:
    """Add `logp`, the natural logarithm of each token's probability."""
    schema = pa.schema([("token", pa.binary()), ("c", pa.int64()), ("logp", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker = _trie.Walker(pieces.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("token"), batch.column("c"), pa.array(list(walker.likelihood(_marked(batch))), pa.float64())], schema=schema)

    return counted.sortWithinPartitions("token").mapInArrow(run, "token binary, c long, logp double")


def estimated(counted: DataFrame, pieces: _trie.Pieces, ends: int, rounds: int = ROUNDS) -> _trie.Pieces:
    """Weights from the pieces' expected counts in all training tokens; what comes to the driver is one number a piece."""
    schema = pa.schema([("piece", pa.int32()), ("n", pa.int64())])
    for _ in range(rounds):
        sent = counted.sparkSession.sparkContext.broadcast(pieces)  # as large as the vocabulary

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            walker = _trie.Walker(sent.value)
            into = [0.0] * len(sent.value.texts)
            for batch in batches:
                walker.expected(_marked(batch), batch.column("c").to_pylist(), into)
            n = np.rint(np.array(into) * SHARES).astype(np.int64)  # whole numbers, whose sum doesn't depend on the order
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n), pa.int32()), pa.array(n[n > 0])], schema=schema)

        found = counted.where("c > 0").sortWithinPartitions("token").mapInArrow(run, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        counts = [0.0] * len(pieces.texts)
        for r in found:
            counts[r.piece] = r.n / SHARES
        pieces = pieces.estimated(counts, ends)
        sent.unpersist()
    return pieces


SCORES = pa.schema([
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()),
    ("base_score", pa.float64()), ("score", pa.float64()),
])
SCORES_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class Totals(NamedTuple):
    """Training tokens, distinct ones, ends among them, and the end's natural log probability."""

    tokens: int
    distinct: int
    ends: int
    end_logp: float


def _score_block(docs: pa.Table, known: pa.Table, totals: Totals) -> pa.Table:
    tokens = known.column("token").combine_chunks()
    tokens = tokens if isinstance(tokens, pa.Array) else pa.concat_arrays([*tokens.chunks, pa.array([], pa.binary())])
    hashes, first, inverse = np.unique(word_hashes(tokens.to_pylist()), return_index=True, return_inverse=True)
    exact = None
    if not pc.all(pc.equal(tokens.take(pa.array(first[inverse])), tokens), min_count=0).as_py():  # two tokens collide
        exact, first = {w: i for i, w in enumerate(tokens.to_pylist())}, np.arange(len(tokens))
    c = np.append(known.column("c").to_numpy()[first], totals.ends).astype(np.int64)
    logp = np.append(known.column("logp").to_numpy()[first], totals.end_logp) / math.log(10)
    base = np.log10((c + 0.5) / (totals.tokens + 0.5 * (totals.distinct + 1))) if totals.tokens else np.zeros(len(c))
    out = []
    for batch in docs.to_batches():
        for part, data, bounds in slices(batch, "text"):
            found = Words(data, bounds, IS_TOKEN)
            at = find(hashes, found.hashes) if exact is None else np.array([exact.get(found.word(i), -1) for i in range(len(found))], dtype=np.int64)
            if (at < 0).any():
                raise LookupError("a token is missing from its block's list")
            n_known = np.diff(np.concatenate([[0], np.cumsum(c[at] > 0)])[found.bounds]) + (c[-1] > 0)
            # summed text by text, so that equal texts get equal sums
            sums = [np.array([math.fsum(values[at[a:b]]) + values[-1] for a, b in zip(found.bounds[:-1], found.bounds[1:], strict=True)]) for values in (base, logp)]
            out.append(result(SCORES, {
                "doc_id": part.column("doc_id").cast(pa.int64()), "held_out": part.column("held"), "n_tokens": np.diff(found.bounds) + 1, "n_known": n_known,
                "train_tokens": np.full(part.num_rows, totals.tokens), "base_score": sums[0], "score": sums[1],
            }))
    return pa.Table.from_batches(out, SCORES)


def digest(docs: DataFrame, model: str = _trie.DEFAULT_MODEL, rounds: int = ROUNDS) -> DataFrame:
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text", held_out().alias("held"), (~held_out()).alias("train"))
    counted = _listed(texts.select(F.lit(0).alias("block"), "text", "train")).groupBy("token").agg(F.sum("n").alias("c"))
    counted = cut_lineage(counted, files_for(docs))
    seen = counted.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    sizes = texts.agg(F.sum(F.octet_length("text")).alias("n"), F.count(F.when(F.col("train"), 1)).alias("ends")).first()
    pieces = estimated(counted, _trie.load(model), sizes.ends, rounds if seen.n else 0)
    totals = Totals((seen.n or 0) + sizes.ends, seen.v + (sizes.ends > 0), sizes.ends, pieces.end)
    n_blocks = max(1, -(-(sizes.n or 0) // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int").alias("block")
    dealt = texts.withColumn("block", block).repartition(min(n_blocks, PARTITIONS), "block")
    # with all columns, as the scoring needs them, so that both read one exchange
    listed = _listed(dealt.sortWithinPartitions("block")).select("block", "token")
    known = listed.join(_scored(counted, spark.sparkContext.broadcast(pieces)), "token")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return _score_block(left, right, totals)

    return dealt.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, SCORES_DDL)
