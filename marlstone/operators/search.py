"""Search over passages: scope and kind filters, phrase filter, grouped top-k."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions import kinds
from marlstone.functions import text as T
from marlstone.operators import rank


@dataclass(frozen=True)
class SearchOptions:
    exact: bool = False
    file_types: tuple[str, ...] = ()
    included: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()


def under(path: Column, prefixes: tuple[str, ...]) -> Column:
    """Whether a path is one of the prefixes or lies in it, name by name."""
    inside = F.lit(False)
    for prefix in prefixes:
        bare = "/".join(p for p in prefix.split("/") if p not in ("", "."))
        inside = inside | (path == bare) | path.startswith(f"{bare}/") if bare else F.lit(True)
    return inside


def in_scope(options: SearchOptions) -> Column:
    path, kept = F.col("path"), F.lit(True)
    if options.included:
        kept = kept & under(path, options.included)
    if options.excluded:
        kept = kept & ~under(path, options.excluded)
    if options.file_types:
        kept = kept & F.col("kind").isin(*[k for group in options.file_types for k in kinds.GROUPS[group]])
    return kept


def holds_phrase(phrase: str) -> Column:
    """Whether the passage's text, title or path holds the phrase, in search form."""
    wanted = T.search_form(F.lit(phrase))
    return T.search_form(F.col("text")).contains(wanted) | F.coalesce(T.search_form(F.col("title")).contains(wanted), F.lit(False)) | T.search_form(F.col("path")).contains(wanted)


def search(chunks: DataFrame, query: str, options: SearchOptions = SearchOptions(), profile: rank.Profile = rank.Profile()) -> DataFrame:
    """Ranked hits. Scope and kinds narrow the corpus before its statistics; the phrase only the hits."""
    found = rank.rank(chunks.where(in_scope(options)), query, profile)
    return found.where(holds_phrase(query)) if options.exact else found


def grouped(hits: DataFrame, limit: int = 10, per_file: int = 2) -> DataFrame:
    """The best hits with at most `per_file` of a file and `limit` in all (0: no limit), in rank order."""
    kept = hits
    if per_file:
        kept = kept.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy(*rank.order()))).where(F.col("_n") <= per_file).drop("_n")
    kept = kept.orderBy(*rank.order())
    return kept.limit(limit) if limit else kept


def totals(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count(F.lit(1)).alias("passages"), F.countDistinct("path").alias("files"))


def as_json(hits: DataFrame, explain: bool = False) -> DataFrame:
    """One JSON object for each file, its hits in rank order; files in the order of their best hits."""
    hit = ["start_line", "end_line", "title", "preview"]
    if explain:
        hit += ["score", F.col("chunk_kind").alias("kind"), F.concat_ws("; ", "reasons").alias("reason")]
    best = F.struct((-F.col("score")).alias("s"), F.split("path", "/").alias("p"), F.col("start_line").alias("l"))
    listed = hits.groupBy("path", "kind").agg(F.array_sort(F.collect_list(F.struct(best.alias("o"), F.struct(*hit).alias("hit")))).alias("h"))
    ordered = listed.orderBy(F.col("h")[0]["o"])
    return ordered.select(F.to_json(F.struct("path", kinds.label(F.col("kind")).alias("file_type"), F.transform("h", lambda x: x["hit"]).alias("hits"))).alias("json"))
