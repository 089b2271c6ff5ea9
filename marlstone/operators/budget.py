"""Relevance floor and the two-pass token budget."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions import text as T
from marlstone.operators.rank import order
from marlstone.session import cut_lineage


@dataclass(frozen=True)
class Policy:
    max_tokens: int = 6000
    share_percent: int = 60

    @property
    def per_file(self) -> int:
        return max(1, self.max_tokens * self.share_percent // 100)


def _up(value: Column, by: int) -> Column:
    return F.floor((value + (by - 1)) / by)


def floored(ranked: DataFrame) -> DataFrame:
    """`ranked` with `kept` and, where it is false, `reason`: whether a passage passes the relevance floor."""
    top = ranked.agg(F.max("score").alias("_top"))
    by_file = Window.partitionBy("path")
    named = (F.col("path_match_score") > 0) | (F.col("title_match_score") > 0) | (F.col("file_name_match_score") > 0)
    judged = ranked.crossJoin(F.broadcast(top)).withColumn("_best", F.max("score").over(by_file))
    judged = judged.withColumn("_named", F.max(F.when(F.col("score") == F.col("_best"), named)).over(by_file))
    least, dominant, local = _up(F.col("_top"), 4), _up(F.col("_top"), 2), _up(F.col("_best"), 10)
    kept = (F.col("_best") >= least) & (F.col("_named") | (F.col("_best") >= dominant)) & (F.col("score") >= local)
    reason = F.format_string("automatic relevance floor: score %d, file best %d, file minimum %d, dominant minimum %d, metadata match %s, local minimum %d", "score", "_best", least, dominant, F.col("_named").cast("string"), local)
    return judged.withColumn("kept", kept).withColumn("reason", F.when(~kept, reason)).drop("_top", "_best", "_named")


def with_rendering_cost(chunks: DataFrame) -> DataFrame:
    """Add what a passage's heading and line label cost to its estimate."""
    label = F.format_string("### %s\n\nLines %d-%d\n\n", "path", "start_line", "end_line")
    return chunks.withColumn("token_estimate", F.col("token_estimate") + T.token_estimate(label))


def select(ranked: DataFrame, policy: Policy = Policy(), query_column: str | None = None) -> DataFrame:
    """`ranked` with `decision` (selected, global, per-file), `reason` and `position` in rank order.

    Each query's candidates pass one task in rank order, without their texts; it holds the tokens
    used by each file and the passages put off, and decides on those at the end. Queries run side
    by side, and the decisions meet the passages by a row number.
    """
    held = ranked.drop("decision", "reason", "position").withColumn("_row", F.monotonically_increasing_id())
    held = cut_lineage(held)  # row numbers stay as they are
    query = F.coalesce(F.col(query_column).cast("string"), F.lit("")) if query_column else F.lit("")
    narrow = held.select(query.alias("_query"), "_row", "path", "start_line", "score", "token_estimate")
    dealt = narrow.repartition("_query").sortWithinPartitions("_query", *order()).select("_query", "_row", "path", "token_estimate")
    most, per_file = policy.max_tokens, policy.per_file
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, used, by_file, put_off, position = None, 0, {}, [], 0
        decided: list[tuple] = []

        def second() -> None:
            nonlocal used
            for row, cost, had, at in put_off:
                if cost > most - used:
                    decided.append((row, "per-file", f"per-file budget limit: current {had}, candidate {cost}, limit {per_file}", at))
                else:
                    used += cost
                    decided.append((row, "selected", None, at))

        def out() -> pa.RecordBatch:
            made = [pa.array(c, k) for c, k in zip(zip(*decided, strict=True), kinds, strict=True)]
            decided.clear()
            return pa.RecordBatch.from_arrays(made, names=["_row", "decision", "reason", "position"])

        for batch in batches:
            for key, row, path, cost in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != query:
                    second()
                    query, used, by_file, put_off, position = key, 0, {}, [], 0
                position += 1
                had = by_file.get(path, 0)
                if cost > most - used:
                    decided.append((row, "global", f"global budget limit: current {used}, candidate {cost}, limit {most}", position))
                elif had and had + cost > per_file:
                    put_off.append((row, cost, had, position))
                else:
                    used += cost
                    by_file[path] = had + cost
                    decided.append((row, "selected", None, position))
            if decided:
                yield out()
        second()
        if decided:
            yield out()

    return held.join(dealt.mapInArrow(run, "_row long, decision string, reason string, position long"), "_row").drop("_row")
