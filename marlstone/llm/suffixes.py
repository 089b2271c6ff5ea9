"""Suffix-array dedup: remove every byte covered by a long string that also starts elsewhere.

Any string of `LENGTH` bytes holds a run of WINDOW consecutive anchors of GRAM bytes, and the
least of their hashes (the rightmost on a tie) is chosen alike wherever the string stands. So
two equal strings share a chosen anchor at the same place, and it is enough to sort the
suffixes (and reversed prefixes) that start at chosen anchors with equal hashes.

Each anchor has the bytes around it that any such string can hold: WINDOW - 1 before it and
LENGTH from it on. Anchors of one hash form a group. Members with the very same bytes around
them share every string there; what differs is sorted: prefix polynomial hashes and binary
search give the common extension of two suffixes, a bottom-up mergesort orders all groups of a
batch at once, and neighbours' extensions tell, for each offset, which anchors share the whole
string. What is found is confirmed byte by byte; if two strings collide in their hashes, the
batch is sorted again under another base. Groups of one context only (many copies of one text)
are dealt out in parts, for each part's bytes confirm each other.

Other groups too large for one task are dealt out in parts too, and each part is sorted by itself.
A string found twice in a part is settled there, and one of its rows goes on as a witness for other
parts; what a row shares with none goes on as well. So for each string either all rows are settled
or those that are not meet a row that has it. Rows go on with quarters of their interval of offsets,
grouped by the bytes that all strings at these offsets hold, so that four rounds end with single
strings, whose groups agree in all that counts.

Defined cases: a null text is empty; a text shorter than LENGTH loses nothing; equal texts (also
repeated rows) of at least LENGTH bytes lose everything; an empty table gives no rows; strings
are bytes and may begin or end inside a character; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm._text import BASE, U64, mix, powers, prefix_hashes, range_hashes, result, slices, utf8
from marlstone.session import cut_lineage, files_for

LENGTH, GRAM = 200, 48
WINDOW = LENGTH - GRAM + 1
#: Groups above this many rows are sorted in parts, round by round; one task sorts as many in about 250 MB.
LARGE = 100_000
#: Rows of a part of a group, and of a group that the join by anchor hash takes as one.
PART, HOT = 20_000, 10_000
#: Groups that are split in that join at most.
MOST_HOT = 2_000
#: Parts of an interval of offsets in the next round.
SPLIT = 4
#: Rows that one vectorised sort takes.
BATCH = 6_000
LEFT, RIGHT = WINDOW - 1, LENGTH
_PLACE = 1 << 20
#: Columns that name a row while texts and spans meet; callers' columns may have any other name.
KEYS, WANTED, FOUND = ("__row_key", "__crc"), "__wanted", "__spans"
#: Bases of the prefix hashes; a batch goes on to the next one when strings collide.
BASES = (BASE, 0xA24BAED4963EE407, 0x9FB21C651E98DF25)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=U64)
    padded[:n] = values
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    back = np.minimum.accumulate(table, axis=1).ravel()
    return np.minimum(ahead[: n - width + 1], back[width - 1 : n])


def choices(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(starts, chosen anchors) of every string of LENGTH bytes inside one of the texts, in runs."""
    if len(data) < LENGTH:
        return
    text_of_end = bounds[1:]
    starts = np.arange(len(data) - GRAM + 1)
    hashes = mix(range_hashes(prefix_hashes(data), starts, starts + GRAM))
    step = _PLACE - WINDOW
    for first in range(0, len(data) - LENGTH + 1, step):
        part = hashes[first : first + step + WINDOW - 1]
        place = np.arange(len(part), dtype=U64)
        least = _least((part & ~U64(_PLACE - 1)) | (U64(_PLACE - 1) - place), WINDOW)
        at = np.arange(first, first + len(least))
        text = np.searchsorted(text_of_end, at, side="right")
        inside = at + LENGTH <= text_of_end[np.minimum(text, len(text_of_end) - 1)]
        yield at[inside], first + (U64(_PLACE - 1) - (least[inside] & U64(_PLACE - 1))).astype(np.int64)


def anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, text, hash) of every chosen anchor of texts that lie one after the other."""
    found = [chosen[np.append(True, chosen[1:] != chosen[:-1])] for _, chosen in choices(data, bounds) if len(chosen)]
    at = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
    hashes = mix(range_hashes(prefix_hashes(data), at, at + GRAM))
    return at, np.searchsorted(bounds[1:], at, side="right"), hashes


def _row_keys() -> tuple[Column, Column]:
    return F.xxhash64("doc_id", "text").alias(KEYS[0]), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias(KEYS[1])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*docs.columns, *_row_keys())


ANCHORS = pa.schema([("row_key", pa.int64()), ("crc", pa.int64()), ("at", pa.int64()), ("gram", pa.int64()), ("context", pa.int64())])
ANCHORS_DDL = "row_key long, crc long, at long, gram long, context long"


def anchor_rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, bounds in slices(batch, "text"):
                at, text, gram = anchors(data, bounds)
                if not len(at):
                    continue
                low, high = np.maximum(at - LEFT, bounds[text]), np.minimum(at + RIGHT, bounds[text + 1])
                raw = data.tobytes()
                # the distances to the text's ends are part of the context
                context = [xxhash.xxh3_64_intdigest(raw[a:b], b - a + 1000 * (p - a)) for a, b, p in zip(low.tolist(), high.tolist(), at.tolist(), strict=True)]
                take = pa.array(text)
                yield pa.RecordBatch.from_arrays([rows.column("row_key").take(take), rows.column("crc").take(take), pa.array(at - bounds[text]), pa.array(gram.view(np.int64)), pa.array(np.array(context, dtype=U64).view(np.int64))], schema=ANCHORS)

    return docs.select("text", F.col(KEYS[0]).alias("row_key"), F.col(KEYS[1]).alias("crc")).mapInArrow(run, ANCHORS_DDL)


class Contexts:
    """Anchors' surroundings as rows of a matrix, the anchor at column LEFT, with prefix hashes."""

    def __init__(self, left: pa.ChunkedArray | pa.Array, right: pa.ChunkedArray | pa.Array, base: int = BASE):
        self.base = base
        (before, b), (after, a) = utf8(left), utf8(right)
        self.before, self.after = np.diff(b), np.diff(a)
        self.bytes = np.zeros((len(left), LEFT + RIGHT), dtype=np.uint8)
        for data, bounds, sizes, place in ((before, b, self.before, LEFT - self.before), (after, a, self.after, np.full(len(left), LEFT))):
            for k in range(0, len(sizes), 2048):
                n, first = sizes[k : k + 2048], bounds[k]
                held = data[first : first + n.sum()]
                shift = np.repeat(place[k : k + 2048] - (bounds[k : k + len(n)] - first), n)
                self.bytes[np.repeat(np.arange(k, k + len(n)), n), shift + np.arange(len(held))] = held
        self._side, self._held = None, None

    def _sums(self, backward: bool) -> np.ndarray:
        """Prefix hashes from the anchor on, or back from it; one side is held at a time."""
        if self._side != backward:
            self._held = None
            columns = self.bytes[:, LEFT - 1 :: -1] if backward else self.bytes[:, LEFT:]
            n, width = columns.shape
            self._side, self._held = backward, np.zeros((n, width + 1), dtype=U64)
            for k in range(0, n, 4096):
                np.cumsum((columns[k : k + 4096].astype(U64) + U64(1)) * powers(self.base, width)[:width], axis=1, out=self._held[k : k + 4096, 1:])
        return self._held

    def extension(self, i: np.ndarray, j: np.ndarray, backward: bool) -> np.ndarray:
        """How many bytes rows i and j have in common from the anchor on, or back from it."""
        sums, size = self._sums(backward), self.before if backward else self.after
        low, high = np.zeros(len(i), dtype=np.int64), np.minimum(size[i], size[j])
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = sums[i, middle] == sums[j, middle]
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def below(self, i: np.ndarray, j: np.ndarray, backward: bool, or_equal: bool) -> np.ndarray:
        """Whether suffix i sorts before suffix j (a proper prefix first)."""
        size = self.before if backward else self.after
        common = self.extension(i, j, backward)
        ended = (common == size[i]) | (common == size[j])
        at = np.minimum(common, (LEFT if backward else RIGHT) - 1)
        column = LEFT - 1 - at if backward else LEFT + at
        a, b = self.bytes[i, column], self.bytes[j, column]
        less, equal = np.where(ended, size[i] < size[j], a < b), ended & (size[i] == size[j])
        return less | equal if or_equal else less


class Collision(ArithmeticError):
    """Different strings with equal hashes."""


def mergesort(contexts: Contexts, begins: np.ndarray, sizes: np.ndarray, backward: bool) -> np.ndarray:
    """Rows of every group in suffix order; all groups are merged level by level together."""
    n = int(sizes.sum())
    order = np.arange(n)
    start, end = np.repeat(begins, sizes), np.repeat(begins + sizes, sizes)
    width = 1
    while width < sizes.max(initial=0):
        place = np.flatnonzero(end - start > width)
        run = (place - start[place]) // width
        first_run = run % 2 == 0
        pair = start[place] + run // 2 * 2 * width
        other_low = np.where(first_run, np.minimum(pair + width, end[place]), pair)
        other_high = np.where(first_run, np.minimum(pair + 2 * width, end[place]), pair + width)
        low, high = other_low.copy(), other_high.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) // 2
            mine, theirs = order[place[open_]], order[middle]
            ahead = np.empty(len(open_), dtype=bool)  # whether the sibling's element goes before mine
            for is_first in (True, False):
                k = first_run[open_] == is_first
                ahead[k] = contexts.below(theirs[k], mine[k], backward, or_equal=not is_first)
            low[open_], high[open_] = np.where(ahead, middle + 1, low[open_]), np.where(ahead, high[open_], middle)
        merged = order.copy()
        merged[pair + (place - (pair + np.where(first_run, 0, width))) + (low - other_low)] = order[place]
        order, width = merged, 2 * width
    return order


def covered(contexts: Contexts, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How far before and after each anchor bytes lie in strings that another anchor of its group shares.

    Also, for each row and offset, whether an earlier row has the string that begins so far before the anchor.
    """
    n = int(sizes.sum())
    before, after = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    again = np.zeros((n, LEFT + 1), dtype=bool)
    if not n:
        return before, after, again
    orders, shared = [], []
    for backward in (False, True):
        order = mergesort(contexts, begins, sizes, backward)
        common = np.full(n, -1, dtype=np.int64)
        inner = np.ones(n, dtype=bool)
        inner[begins] = False
        k = np.flatnonzero(inner)
        common[k] = contexts.extension(order[k - 1], order[k], backward)
        orders.append(order)
        shared.append(common)
    block = np.empty((2, n), dtype=np.int64)
    twins = np.full((2, n), -1, dtype=np.int64)  # of the string that reaches furthest after, and before
    for back in range(LEFT + 1):
        ahead = LENGTH - back
        for side, reach in ((0, ahead), (1, back)):
            block[side, orders[side]] = np.cumsum(shared[side] < reach)
        able = np.flatnonzero((contexts.before >= back) & (contexts.after >= ahead))
        key = block[0, able] * (n + 1) + block[1, able]
        by_key = np.argsort(key, kind="stable")
        key, able = key[by_key], able[by_key]
        twin = np.flatnonzero(key[1:] == key[:-1])
        a, b = able[twin], able[twin + 1]
        again[b, back] = True
        for hit, other in ((a, b), (b, a)):
            new = after[hit] == 0
            after[hit[new]], twins[0, hit[new]] = ahead, other[new]
            before[hit], twins[1, hit] = back, other
    hit = np.flatnonzero(after)
    for first, twin in ((LENGTH - after[hit], twins[0, hit]), (before[hit], twins[1, hit])):
        for c in range(0, len(hit), 4096):  # byte for byte, what the hashes say
            i, j, columns = hit[c : c + 4096, None], twin[c : c + 4096, None], LEFT - first[c : c + 4096, None] + np.arange(LENGTH)
            if not (contexts.bytes[i, columns] == contexts.bytes[j, columns]).all():
                raise Collision
    return before, after, again


SPANS = pa.schema([("row_key", pa.int64()), ("crc", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])
SPANS_DDL = "row_key long, crc long, first long, last long"


def _extract(joined: DataFrame) -> DataFrame:
    """(gram, part, row_key, crc, at, left, right): the bytes around each listed anchor."""
    schema = pa.schema([("gram", pa.int64()), ("part", pa.int32()), ("row_key", pa.int64()), ("crc", pa.int64()), ("at", pa.int64()), ("left", pa.binary()), ("right", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, bounds in slices(batch, "text"):
                raw, out = data.tobytes(), []
                for key, crc, wanted, a, b in zip(*(rows.column(c).to_pylist() for c in (*KEYS, WANTED)), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    for w in wanted:
                        p = a + w["at"]
                        out.append((w["gram"], w["part"], key, crc, w["at"], raw[max(a, p - LEFT) : p], raw[p : min(b, p + RIGHT)]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return joined.mapInArrow(run, "gram long, part int, row_key long, crc long, at long, left binary, right binary")


def settled(left: pa.ChunkedArray, right: pa.ChunkedArray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far before and after each anchor bytes lie in strings that another row of its group shares."""
    return matched(left, right, begins, sizes)[:2]


def matched(left: pa.ChunkedArray, right: pa.ChunkedArray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `settled`, and for each row and offset whether another row stands for the string there."""
    group = np.repeat(np.arange(len(sizes)), sizes).tolist()
    number: dict[tuple, int] = {}
    of_row = np.array([number.setdefault(k, len(number)) for k in zip(group, left.to_pylist(), right.to_pylist(), strict=True)], dtype=np.int64)
    n, first = np.unique(of_row, return_index=True, return_counts=True)[1:][::-1]
    take = pa.array(first)
    kinds_of_group = np.bincount(np.array(group)[first], minlength=len(sizes))
    for k, base in enumerate(BASES):
        contexts = Contexts(left.take(take), right.take(take), base)
        try:
            before, after, again = covered(contexts, np.cumsum(kinds_of_group) - kinds_of_group, kinds_of_group)
            break
        except Collision:
            if k == len(BASES) - 1:
                raise
    # copies of one context share all its strings, which take the whole of it if there is any
    copied = (n > 1) & (contexts.before + contexts.after >= LENGTH)
    before[copied], after[copied] = contexts.before[copied], contexts.after[copied]
    again = again[of_row]
    again[np.setdiff1d(np.arange(len(of_row)), first)] = True
    return before[of_row], after[of_row], again


def _group_begins(rows: pa.Table) -> np.ndarray:
    """Where the groups after the first begin."""
    return np.flatnonzero(np.any([(k := rows.column(c).to_numpy())[1:] != k[:-1] for c in ("gram", "part")], axis=0)) + 1


def _spans_of(rows: pa.Table, before: np.ndarray, after: np.ndarray) -> list[pa.Array]:
    at, hit = rows.column("at").to_numpy(), after > 0
    return [pa.array(rows.column(c).to_numpy()[hit]) for c in ("row_key", "crc")] + [pa.array((at - before)[hit]), pa.array((at + after)[hit])]


def _settle(rows: pa.Table, begins: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(_spans_of(rows, *settled(rows.column("left"), rows.column("right"), begins, sizes)), schema=SPANS)


def quarters(low: int, high: int) -> list[tuple[int, int]]:
    """An interval's parts, the same for all rows that have it."""
    size = -(-(high - low + 1) // SPLIT)
    return [(k, min(high, k + size - 1)) for k in range(low, high + 1, size)]


NARROWED = pa.schema([*SPANS, ("at", pa.int64()), ("gram", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("left", pa.binary()), ("right", pa.binary())])
NARROWED_DDL = f"{SPANS_DDL}, at long, gram long, low int, high int, left binary, right binary"


def _narrow(rows: pa.Table, begins: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    """Spans that parts of groups show, and rows (first is null) that go on, each with an interval of offsets."""
    before, after, again = matched(rows.column("left"), rows.column("right"), begins, sizes)
    found = _spans_of(rows, before, after)
    low, high = (rows.column(c).to_numpy() for c in ("low", "high"))
    n_left, n_right = (np.diff(utf8(rows.column(c))[1]) for c in ("left", "right"))
    back = np.arange(LEFT + 1)
    stays = ~again & (back >= low[:, None]) & (back <= high[:, None]) & (back <= n_left[:, None]) & (LENGTH - back <= n_right[:, None])
    pairs = np.unique(np.stack([low, high], axis=1), axis=0).tolist()
    pieces = [(a, b, np.flatnonzero((low == x) & (high == y) & stays[:, a : b + 1].any(axis=1))) for x, y in pairs for a, b in quarters(x, y)]
    take = np.concatenate([k for _, _, k in pieces])
    rest = rows.take(pa.array(take)).combine_chunks()
    none = pa.nulls(len(take), pa.int64())
    more = [pa.array(np.repeat([p[k] for p in pieces], [len(p[2]) for p in pieces]), pa.int32()) for k in range(2)]
    goes_on = {"first": none, "last": none, "low": more[0], "high": more[1]}
    on = [goes_on[f.name] if f.name in goes_on else rest.column(f.name) for f in NARROWED]
    first = [*found, *(pa.nulls(len(found[0]), f.type) for f in list(NARROWED)[len(SPANS) :])]
    whole = pa.concat_tables([pa.Table.from_arrays(first, schema=NARROWED), pa.Table.from_arrays(on, schema=NARROWED)]).combine_chunks()
    return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in whole.columns], schema=NARROWED)


def _by_group(contexts: DataFrame, settle: Callable[[pa.Table, np.ndarray, np.ndarray], pa.RecordBatch], ddl: str) -> DataFrame:
    """`settle` over runs of whole groups of contexts (rows, where groups begin, their sizes), dealt out by gram and part."""

    def grouped(rows: pa.Table) -> pa.RecordBatch:
        begins = np.append(0, _group_begins(rows))
        return settle(rows, begins, np.diff(np.append(begins, rows.num_rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            while held.num_rows > BATCH:
                ends = _group_begins(held)
                if not len(ends):
                    break
                fit = ends[ends <= BATCH]
                cut = int(fit[-1] if len(fit) else ends[0])
                yield grouped(held.slice(0, cut))
                held = held.slice(cut).combine_chunks()
        if held is not None and held.num_rows:
            yield grouped(held)

    return contexts.repartition("gram", "part").sortWithinPartitions("gram", "part").mapInArrow(run, ddl)


def _core_hash() -> Column:
    """Names a group of rows that go on: by the bytes that all strings at an interval's offsets hold."""
    before = F.substring("left", F.length("left") - F.col("low") + 1, F.col("low"))
    return F.xxhash64("gram", "low", "high", before, F.substring("right", F.lit(1), F.lit(LENGTH) - F.col("high")))


def _narrowed(contexts: DataFrame, files: int) -> DataFrame:
    """Spans from the contexts of groups too large for one task, which lie in parts."""
    todo, out = contexts.withColumn("low", F.lit(0)).withColumn("high", F.lit(LEFT)), None
    while True:
        made = cut_lineage(_by_group(todo, _narrow, NARROWED_DDL), files)
        on = made.where("first is null").withColumn("gram", _core_hash()).withColumn("context", F.xxhash64("left", "right"))
        shared = cut_lineage(_shared(on.drop("first", "last"), files), files)
        too_large = ~F.col("alike") & (F.col("n") > LARGE) & (F.col("low") < F.col("high"))
        found = made.where("first is not null").select(SPANS.names).union(_by_group(shared.where(~too_large), _settle, SPANS_DDL))
        out = found if out is None else out.union(found)
        todo = shared.where(too_large)
        if not todo.limit(1).count():
            break
    return out


def _meet(rows: DataFrame, groups: DataFrame, key: str, spread: Column) -> DataFrame:
    """Rows with what `groups` (key, n, ..) says of their key; the rows of large groups are dealt out to many tasks."""
    total = groups.agg(F.sum("n")).first()[0] or 0
    # at most MOST_HOT groups hold more than this, so that they can be told to every task
    hot = max(HOT, -(-total // MOST_HOT))
    large = groups.where(F.col("n") > hot).select(key, F.ceil(F.col("n") / hot).cast("int").alias("slices"))
    dealt = rows.join(F.broadcast(large), key, "left").withColumn("slice", F.coalesce(F.pmod(spread, F.col("slices")), F.lit(0))).drop("slices")
    each = F.sequence(F.lit(0), F.when(F.col("n") > hot, F.ceil(F.col("n") / hot).cast("int") - 1).otherwise(0))
    return dealt.join(groups.withColumn("slice", F.explode(each)), [key, "slice"])


def _shared(found: DataFrame, files: int) -> DataFrame:
    """The anchors whose group has others too, with its size `n`, whether it has one context, and their part of it.

    Parts hold PART / 2 rows or more on average, so that none is left with a single row.
    """
    groups = found.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("a"), F.max("context").alias("b")).where("n > 1")
    groups = cut_lineage(groups.select("gram", "n", (F.col("a") == F.col("b")).alias("alike")), files)
    in_parts = F.col("alike") | (F.col("n") > LARGE)
    part = F.when(in_parts, F.pmod(F.hash("gram", "at", "row_key"), F.ceil(F.col("n") / PART).cast("int"))).otherwise(F.lit(0))
    return _meet(found, groups, "gram", F.hash("row_key", "at")).withColumn("part", part)


def spans(keyed: DataFrame) -> DataFrame:
    """`keyed` with, for each text that has any, the spans of bytes to remove; they may overlap or pass the text's ends.

    Texts meet the anchors that are wanted of them, and the spans in the end, by one exchange with
    all columns.
    """
    files = files_for(keyed)
    shared = _shared(anchor_rows(keyed), files).withColumn("large", ~F.col("alike") & (F.col("n") > LARGE))
    listed = cut_lineage(shared.groupBy("row_key", "crc").agg(F.collect_set(F.struct("at", "gram", "part", "large")).alias("wanted")), files)

    def extracted(large: bool) -> DataFrame:
        wanted = listed.select(F.col("row_key").alias(KEYS[0]), F.col("crc").alias(KEYS[1]), F.filter("wanted", lambda w: w["large"] == F.lit(large)).alias(WANTED))
        return _extract(keyed.join(wanted.where(F.size(WANTED) > 0), list(KEYS)))

    out = _by_group(extracted(False), _settle, SPANS_DDL)
    if listed.where(F.exists("wanted", lambda w: w["large"])).limit(1).count():
        out = out.union(_narrowed(extracted(True), files))
    found = out.groupBy(F.col("row_key").alias(KEYS[0]), F.col("crc").alias(KEYS[1])).agg(F.collect_set(F.struct("first", "last")).alias(FOUND))
    return keyed.join(found, list(KEYS), "left")


def kept_runs(found: list[dict] | None, n: int) -> list[tuple[int, int]]:
    """The runs of bytes that stay of n bytes, without those inside any span."""
    kept, at = [], 0
    for first, last in sorted((max(0, s["first"]), min(n, s["last"])) for s in found or ()):
        if first > at:
            kept.append((at, first))
        at = max(at, last)
    if at < n:
        kept.append((at, n))
    return kept


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
DIGEST_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def digest(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, bounds in slices(batch, "text"):
                out = []
                for found, a, b in zip(rows.column(FOUND).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    kept = kept_runs(found, b - a)
                    inner = [0, *(k for run in kept for k in run), b - a]
                    removed = [y - x for x, y in zip(inner[::2], inner[1::2], strict=True) if y > x]
                    stays = b"".join(data[a + x : a + y].tobytes() for x, y in kept)
                    out.append((b - a, sum(removed), len(removed), hashlib.sha256(stays).hexdigest()))
                yield result(DIGEST, {"doc_id": rows.column("doc_id").cast(pa.int64())} | dict(zip(DIGEST.names[1:], map(list, zip(*out, strict=True)), strict=True)))

    return spans(_keyed(docs.select("doc_id", "text"))).mapInArrow(run, DIGEST_DDL)


def cut(docs: DataFrame, length_column: str = "n_chars") -> DataFrame:
    """`docs` with repeated strings cut out of `text`; halves of characters at a cut go too.

    If there is a column of that name, `length_column` gets the characters left. A null text stays null.
    """
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, bounds in slices(batch, "text"):
                texts = []
                for found, text, a, b in zip(rows.column(FOUND).to_pylist(), rows.column("text").is_null().to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    kept = [data[a + x : a + y].tobytes().decode("utf-8", "ignore") for x, y in kept_runs(found, b - a)]
                    texts.append(None if text else "".join(kept))
                columns = {"text": texts, length_column: [None if t is None else len(t) for t in texts]}
                names = schema.names
                yield pa.RecordBatch.from_arrays([pa.array(columns[n], rows.schema.field(n).type) if n in columns else rows.column(n) for n in names], names=names)

    return spans(_keyed(docs)).mapInArrow(run, schema)
