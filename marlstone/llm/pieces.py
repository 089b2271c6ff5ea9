"""SentencePiece encoding and decoding with shared-prefix Viterbi.

A text gets a blank in front and is cut into marked words (blanks and what follows them) and
line ends, which no piece crosses. The distinct words that a task meets are sorted into a trie
and walked depth-first, so common prefixes share their forward scores; occurrences then look
up their word's ids. Decoding joins the pieces' bytes and drops the first blank, and gives back
the very text, also with bare word marks, control characters and runs of blanks.

Defined cases: a null text has null ids and decodes to null; an empty one has the ids of its
leading blank; equal texts get equal ids; an empty table gives no rows.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm import _trie
from marlstone.llm._text import slices

MARKED = re.compile(r"\n| +[^ \n]*|[^ \n]+")
#: Words, and characters of words, whose ids a task remembers before it starts anew.
REMEMBERED, REMEMBERED_CHARS = 100_000, 4 << 20


class Encoder:
    def __init__(self, pieces: _trie.Pieces):
        self.walker = _trie.Walker(pieces)
        self.known: dict[str, int] = {}
        self.ids: list[bytes] = []  # of 32-bit numbers
        self.chars = 0

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and each text's bounds in them."""
        words = [MARKED.findall(" " + t) for t in texts]
        if len(self.ids) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.known, self.ids, self.chars = {}, [], 0
        new = sorted({w for ws in words for w in ws}.difference(self.known))
        for w, ids in zip(new, self.walker.segment(new), strict=True):
            self.known[w] = len(self.ids)
            self.ids.append((ids if isinstance(ids, array) else array("i", ids)).tobytes())
            self.chars += len(w)
        known = self.known
        at = np.array([known[w] for ws in words for w in ws], dtype=np.int64)
        used, at = np.unique(at, return_inverse=True)
        held = [self.ids[k] for k in used.tolist()]
        sizes = np.array([len(x) // 4 for x in held], dtype=np.int64)
        flat = np.frombuffer(b"".join(held), dtype=np.int32)
        begins = np.cumsum(sizes) - sizes
        n = sizes[at]
        ends = np.cumsum(n)
        out = flat[np.repeat(begins[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        word_bounds = np.concatenate([[0], np.cumsum([len(ws) for ws in words])])
        return out, np.concatenate([[0], ends])[word_bounds]


class Decoder:
    def __init__(self, pieces: _trie.Pieces):
        self.sizes = np.array([len(t) for t in pieces.texts], dtype=np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(pieces.texts), dtype=np.uint8)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes, leading blanks included, and each text's bounds in them."""
        n = self.sizes[ids]
        ends = np.cumsum(n)
        out = self.bytes[np.repeat(self.begins[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        return out, np.concatenate([[0], ends])[bounds]


def encode(docs: DataFrame, model: str = _trie.DEFAULT_MODEL, check: bool = False) -> DataFrame:
    """`docs` with `ids` (array of int), and with `round_trip`: whether decoding gives the text back."""
    sent = docs.sparkSession.sparkContext.broadcast(_trie.load(model))  # as large as the vocabulary
    made = ("ids", "round_trip") if check else ("ids",)
    kept = [c for c in docs.columns if c.lower() not in made]
    base = docs.select(*kept)
    fields = T.StructType([*base.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    if check:
        fields = T.StructType([*fields.fields, T.StructField("round_trip", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(sent.value), Decoder(sent.value)
        for batch in batches:
            for rows, data, bounds in slices(batch, "text", 1 << 20):
                texts = rows.column("text").to_pylist()
                null = np.array([t is None for t in texts])
                ids, of_text = encoder.encode([t or "" for t in texts])
                coded = pa.ListArray.from_arrays(pa.array(of_text.astype(np.int32)), pa.array(ids), mask=pa.array(null))
                columns = [*rows.columns, coded]
                if check:
                    back, ends = decoder.decode(ids, of_text)
                    same = [a == b for a, b in zip(_bodies(back, ends), _bodies(data, bounds, 0), strict=True)]
                    columns.append(pa.array(same, mask=null))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return base.mapInArrow(run, fields)


def _bodies(data: np.ndarray, bounds: np.ndarray, skip: int = 1) -> list[bytes]:
    return [data[a + skip : b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def decode(encoded: DataFrame, model: str = _trie.DEFAULT_MODEL, column: str = "text") -> DataFrame:
    """`encoded` with `column`: the text of each row's ids."""
    sent = encoded.sparkSession.sparkContext.broadcast(_trie.load(model))
    base = encoded.select(*[c for c in encoded.columns if c != column])
    fields = T.StructType([*base.schema.fields, T.StructField(column, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(sent.value)
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                rows = whole.slice(first, 500)
                lists = rows.column("ids")
                sizes = np.array([0 if x is None else x for x in pc.list_value_length(lists).to_pylist()], dtype=np.int64)
                back, ends = decoder.decode(lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)]))
                null = lists.is_null().to_numpy(zero_copy_only=False)
                texts = [None if gone else t.decode("utf-8", "replace") for t, gone in zip(_bodies(back, ends), null, strict=True)]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string())], names=[f.name for f in fields])

    return base.mapInArrow(run, fields)


def _size() -> Column:
    return F.coalesce(F.octet_length(F.col("text")), F.lit(0)).cast("long")


def digest(docs: DataFrame, model: str = _trie.DEFAULT_MODEL) -> DataFrame:
    """doc_id, n_bytes, n_pieces, ids and round_trip for each document."""
    found = encode(docs.select("doc_id", "text", _size().alias("n_bytes")), model, check=True)
    return found.select("doc_id", "n_bytes", F.when(F.col("ids").isNull(), 0).otherwise(F.size("ids")).cast("long").alias("n_pieces"), "ids", "round_trip")
