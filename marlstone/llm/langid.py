"""Language identification by prediction by partial matching over bytes.

For each language a context tree of order up to `ORDER` holds how often each byte followed
each context in labelled texts. A seen symbol has probability c / (n + d) in its context (n
occurrences, d distinct successors); the escape d / (n + d) leads to the next shorter context,
down to a uniform one. Statistics are frozen after learning, so the code length of a text is a
sum of table entries; the language with the shortest code wins, the first in order on a tie.
Above order 1 the tables hold only what occurred in the sample, so the order doesn't depend on
how many languages there are; memory grows with the languages' sampled text.

Symbols are the 256 byte values as they are, without folding.

Learning takes at most about `SAMPLE` texts of each language (a documented parameter, drawn
by a hash of the row); each text is used whole, and prediction reads every byte.

Defined cases: a null text, and one without a letter, is `und` with score 0; equal texts get
equal answers; without any labelled row everything is `und`; an empty table gives no rows; a
null id counts as an empty one; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm._text import find, result, slices

ORDER = 3
CLASSES = 256
SAMPLE = 1500
UNKNOWN = "und"
#: Bits a byte of a guess without any statistics.
BLIND = float(np.log2(CLASSES))
LETTER = re.compile(r"[^\W\d_]")
SPACE = 32
#: The symbol of each byte: every byte is its own.
FOLD = np.arange(CLASSES, dtype=np.uint8)


def codes(data: np.ndarray, bounds: np.ndarray, order: int) -> np.ndarray:
    """For each byte the number of its context and itself; each text starts after white space."""
    symbols = FOLD[data].astype(np.uint32 if CLASSES ** (order + 1) <= 1 << 32 else np.uint64)
    out = symbols.copy()
    begins, sizes = bounds[:-1], np.diff(bounds)
    for back in range(1, order + 1):
        shifted = np.full_like(symbols, SPACE)
        shifted[back:] = symbols[:-back] if back < len(symbols) else symbols[:0]
        for k in range(back):
            shifted[begins[sizes > k] + k] = SPACE
        out += shifted * symbols.dtype.type(CLASSES**back)
    return out


class Tree:
    """One language's code lengths: dense up to order 1, above it only the contexts and symbols that occurred."""

    def __init__(self, code: np.ndarray, n: np.ndarray, order: int):
        self.order, self.low, self.levels = order, min(order, 1), []
        lengths = np.full(1, BLIND)
        for o in range(self.low + 1):
            level = np.bincount(self.ending(code, o).astype(np.int64), n, minlength=CLASSES ** (o + 1)).reshape(-1, CLASSES)
            total, distinct = level.sum(axis=1, keepdims=True), (level > 0).sum(axis=1, keepdims=True)
            bits = np.log2(np.maximum(total + distinct, 1))
            lengths = np.where(level > 0, bits - np.log2(np.maximum(level, 1)), bits - np.log2(np.maximum(distinct, 1)) + lengths)
        self.dense = lengths.ravel()
        for o in range(self.low + 1, order + 1):
            grams, at = np.unique(self.ending(code, o), return_inverse=True)
            seen = np.bincount(at, n)
            contexts, first, distinct = np.unique(grams // grams.dtype.type(CLASSES), return_index=True, return_counts=True)
            bits = np.log2((np.add.reduceat(seen, first) if len(first) else seen) + distinct)
            self.levels.append((o, contexts, (bits - np.log2(distinct)).astype(np.float32), grams, (np.repeat(bits, distinct) - np.log2(seen)).astype(np.float32)))

    def ending(self, code: np.ndarray, o: int) -> np.ndarray:
        """The numbers of the contexts' last `o` symbols and the symbol itself."""
        return code if o == self.order else code % code.dtype.type(CLASSES ** (o + 1))

    def lengths(self, code: np.ndarray) -> np.ndarray:
        """Negative log2 probabilities of these symbols in their contexts."""
        out = self.dense[self.ending(code, self.low)]
        for o, contexts, escape, grams, bits in self.levels:
            gram = self.ending(code, o)
            at = find(contexts, gram // gram.dtype.type(CLASSES))
            known = np.flatnonzero(at >= 0)
            out[known] += escape[at[known]]
            at = find(grams, gram[known])
            out[known[at >= 0]] = bits[at[at >= 0]]
        return out


class Model:
    """Sparse counts for each language. A worker makes trees of them once; they go with the broadcast that holds the model."""

    def __init__(self, languages: list[str], order: int, language: np.ndarray, code: np.ndarray, n: np.ndarray):
        self.languages, self.order = languages, order
        self.language, self.code, self.n = language, code, n
        self._trees: list[Tree] = []

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_trees": []}

    def trees(self) -> list[Tree]:
        if not self._trees:
            ends = np.searchsorted(self.language, np.arange(len(self.languages) + 1))
            self._trees = [Tree(self.code[a:b], self.n[a:b], self.order) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return self._trees

    def bits(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Code lengths in bits: a row for each text, a column for each language."""
        out = np.zeros((len(bounds) - 1, len(self.languages)))
        some = np.flatnonzero(np.diff(bounds) > 0)
        if len(some) and self.languages:
            distinct, at = np.unique(codes(data, bounds, self.order), return_inverse=True)
            for k, tree in enumerate(self.trees()):
                out[some, k] = np.add.reduceat(tree.lengths(distinct)[at], bounds[some])
        return out

    def predict(self, data: np.ndarray, bounds: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, posterior probability and least bits a byte of each text."""
        bits = self.bits(data, bounds)
        sizes = np.maximum(np.diff(bounds), 1)
        letters = np.array([LETTER.search(data[a:b].tobytes().decode("utf-8", "replace")) is not None for a, b in zip(bounds[:-1], bounds[1:], strict=True)], dtype=bool)
        if not self.languages:
            return [UNKNOWN] * len(sizes), np.zeros(len(sizes)), np.full(len(sizes), 8.0)
        best = bits.argmin(axis=1)
        least = bits.min(axis=1)
        share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)], np.where(letters, share, 0.0), least / sizes


def held_out(id_column: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def learn(docs: DataFrame, order: int = ORDER, sample: int = SAMPLE) -> Model:
    """Count contexts in a bounded sample of rows that have a language and aren't held out."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    number = {k: i for i, k in enumerate(languages)}
    cut = F.lit(0)
    for language in languages:
        cut = F.when(F.col("lang") == language, F.lit(min(1 << 30, (sample << 30) // sizes[language]))).otherwise(cut)
    drawn = labelled.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < cut).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[int, list] = {}
            for rows, data, bounds in slices(batch, "text"):
                code = codes(data, bounds, order)
                language = np.repeat([number[x] for x in rows.column("lang").to_pylist()], np.diff(bounds))
                for k in np.unique(language):
                    held.setdefault(int(k), []).append(code[language == k])
            for k, parts in held.items():
                code, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_pydict({"language": pa.array(np.full(len(code), k), pa.int32()), "code": pa.array(code.astype(np.int64), pa.int64()), "n": pa.array(n, pa.int64())})

    counts = drawn.mapInArrow(run, "language int, code long, n long").groupBy("language", "code").agg(F.sum("n").alias("n")).orderBy("language", "code").toArrow()
    language, code, n = (counts.column(c).to_numpy() for c in ("language", "code", "n"))
    return Model(languages, order, language, code.astype(np.uint32 if CLASSES ** (order + 1) <= 1 << 32 else np.uint64), n.astype(np.int32))


DIGEST = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
DIGEST_DDL = "doc_id long, held_out boolean, lang_pred string, score double"


def digest(docs: DataFrame, order: int = ORDER, sample: int = SAMPLE) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, order, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, bounds in slices(batch, "text"):
                language, score, _ = sent.value.predict(data, bounds)
                yield result(DIGEST, {"doc_id": rows.column("doc_id").cast(pa.int64()), "held_out": rows.column("held"), "lang_pred": language, "score": score})

    return docs.select("doc_id", "text", held_out().alias("held")).mapInArrow(run, DIGEST_DDL)


def keep_known(docs: DataFrame, most_bits: float = BLIND, order: int = ORDER, sample: int = SAMPLE) -> DataFrame:
    """`docs` without the rows that no learned language explains: no letters, or a code of over
    `most_bits` a byte, by default as long as one without any statistics.
    """
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, order, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, bounds in slices(batch, "text"):
                language, _, bits = sent.value.predict(data, bounds)
                yield rows.filter(pa.array([k != UNKNOWN and b <= most_bits for k, b in zip(language, bits, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
