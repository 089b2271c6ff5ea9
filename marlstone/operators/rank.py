"""BM25 and the composite, explained score of passages for a query."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from marlstone.functions import kinds
from marlstone.functions import text as T
from marlstone.session import cut_lineage

K1, B = 1.2, 0.75
#: Terms of a batch of queries, with repeats, up to which every task is told them.
TOLD_TERMS = 200_000
#: Numbers in a table of terms or queries by passages, which bounds what a task of such a batch holds.
TOLD_CELLS = 250_000


@dataclass(frozen=True)
class Profile:
    """Weights of the score's parts; fixed values by default."""

    bm25: int = 10
    text: int = 3
    coverage: int = 6
    full: int = 18
    path: int = 2
    title: int = 4
    filename: int = 3
    density: int = 2


Scorer = Callable[[DataFrame, list[str]], Column]


def parse_terms(spark: SparkSession, query: str) -> list[str]:
    """The distinct tokens of a query in the order of their first places."""
    return list(spark.range(1).select(F.array_distinct(T.tokens(F.lit(query)))).first()[0])


def frequencies(text: Column, terms: list[str]) -> Column:
    """(tf of each term, number of tokens) of a text; one transform holds the tokens, so they are made once."""
    wanted = F.array(*map(F.lit, terms))
    counted = lambda w, hits: F.struct(F.transform(wanted, lambda q: F.size(F.filter(hits, lambda x: x == q))).alias("tf"), F.size(w).cast("long").alias("dl"))
    return F.transform(F.array(T.tokens(text)), lambda w: F.transform(F.array(F.filter(w, lambda x: x.isin(terms))), lambda hits: counted(w, hits))[0])[0]


def statistics(n_terms: int) -> list[Column]:
    """Number of passages, mean length (1 at least) and document frequency of each term, over columns tf and dl."""
    hits = [F.coalesce(F.sum((F.col("tf")[i] > 0).cast("long")), F.lit(0)).alias(f"df{i}") for i in range(n_terms)]
    return [F.count(F.lit(1)).alias("n_chunks"), F.greatest(F.lit(1.0), F.coalesce(F.avg("dl"), F.lit(0.0))).alias("mean_length"), *hits]


def vocabulary(chunks: DataFrame) -> DataFrame:
    """(term, df): in how many passages each token occurs."""
    return chunks.select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def bm25(tf: Column, dl: Column, df: Column, n: Column, mean: Column) -> Column:
    """Summed in the order of the terms, so that the last digits don't depend on a shuffle."""
    length = F.lit(1 - B) + F.lit(B) * (F.greatest(dl, F.lit(1)).cast("double") / mean)

    def part(f: Column, d: Column) -> Column:
        idf = F.log(F.lit(1.0) + (n - d + F.lit(0.5)) / (d + F.lit(0.5)))
        return F.when(f == 0, 0.0).otherwise(idf * (f * F.lit(K1 + 1) / (f + F.lit(K1) * length)))

    return F.aggregate(F.zip_with(tf.cast("array<double>"), df.cast("array<double>"), part), F.lit(0.0), lambda a, x: a + x)


def score(chunks: DataFrame, terms: list[str], profile: Profile = Profile(), path_prefix: str = "") -> DataFrame:
    """`chunks` with the score's parts, `score` and `reasons`; passages without any match go.

    Paths count without the source folder's own name; `path_prefix` puts it back. Every text is
    read once: the statistics of all passages are observed while those that match are stored.
    """
    if not terms:
        return score(chunks.limit(0), ["_"], profile, path_prefix)
    wanted, n_terms = F.array(*map(F.lit, terms)), len(terms)
    names = {"_path": T.search_form(F.concat(F.lit(path_prefix), F.col("path"))), "_title": F.coalesce(T.search_form(F.col("title")), F.lit("")), "_name": T.search_form(kinds.file_name(F.col("path")))}
    counted = chunks.withColumn("_f", frequencies(F.col("text"), terms)).withColumns({"tf": F.col("_f.tf"), "dl": F.col("_f.dl")} | names).drop("_f")
    seen = Observation()
    somewhere = F.exists(wanted, lambda q: F.col("_path").contains(q) | F.col("_title").contains(q) | F.col("_name").contains(q))
    joined = cut_lineage(counted.observe(seen, *statistics(n_terms)).where(F.exists("tf", lambda f: f > 0) | somewhere))
    stats = seen.get
    df = F.array(*[F.lit(stats[f"df{i}"]) for i in range(n_terms)])

    def matches(column: str) -> Column:
        return F.aggregate(wanted, F.lit(0).cast("long"), lambda n, q: n + T.substring_count(F.col(column), q))

    somewhere = F.transform(F.zip_with("tf", wanted, lambda f, q: (f > 0) | F.col("_path").contains(q) | F.col("_title").contains(q) | F.col("_name").contains(q)), lambda x: x.cast("int"))
    total = lambda array: F.aggregate(array, F.lit(0).cast("long"), lambda a, x: a + x)
    joined = joined.withColumns({
        "text_matches": total(F.col("tf")), "matched_terms": F.size(F.filter("tf", lambda f: f > 0)).cast("long"), "covered": total(somewhere),
        "path_matches": matches("_path"), "title_matches": matches("_title"), "name_matches": matches("_name"),
    }).where("text_matches + path_matches + title_matches + name_matches > 0")
    parts = {
        "lexical_score": F.round(bm25(F.col("tf"), F.col("dl"), df, F.lit(float(stats["n_chunks"])), F.lit(float(stats["mean_length"]))) * profile.bm25).cast("long"),
        "text_match_score": F.col("matched_terms") * profile.text,
        "term_coverage_score": F.col("covered") * profile.coverage,
        "full_coverage_score": F.when((F.lit(n_terms) > 1) & (F.col("covered") == n_terms), profile.full).otherwise(0).cast("long"),
        "path_match_score": F.col("path_matches") * profile.path,
        "title_match_score": F.col("title_matches") * profile.title,
        "file_name_match_score": F.col("name_matches") * profile.filename,
        "file_kind_score": kinds.extension_bonus(F.col("path")) + kinds.chunk_bonus(F.col("chunk_kind")),
        "density_score": F.when(F.col("text_matches") < n_terms, 0).otherwise(F.least(F.col("text_matches") * profile.density, F.lit(8))).cast("long"),
    }
    joined = joined.withColumns(parts).withColumn("score", sum((F.col(p) for p in list(parts)[1:]), F.col("lexical_score")))
    said = lambda shown, form, *values: F.when(shown, F.format_string(form, *values))
    c = F.col
    reasons = F.array(
        said(c("lexical_score") > 0, "BM25 lexical score: %d", c("lexical_score")),
        said(c("text_matches") > 0, f"exact text matches: %d, unique terms %d/{n_terms} x {profile.text}", c("text_matches"), c("matched_terms")),
        said(c("term_coverage_score") > 0, f"term coverage: %d/{n_terms} x {profile.coverage}", c("covered")),
        said(c("full_coverage_score") > 0, "full query coverage bonus: %d", c("full_coverage_score")),
        said(c("path_matches") > 0, f"path matches: %d x {profile.path}", c("path_matches")),
        said(c("title_matches") > 0, f"title matches: %d x {profile.title}", c("title_matches")),
        said(c("name_matches") > 0, f"file name matches: %d x {profile.filename}", c("name_matches")),
        said(c("file_kind_score") > 0, "file kind bonus: %d", c("file_kind_score")),
        said(c("density_score") > 0, "term density bonus: %d", c("density_score")),
    )
    joined = joined.withColumn("reasons", F.filter(reasons, lambda r: r.isNotNull())).withColumn("preview", T.preview(c("text")))
    return joined.drop("_path", "_title", "_name")


def score_with(chunks: DataFrame, terms: list[str], scorer: Scorer) -> DataFrame:
    """`chunks` with the `score` of a caller's own column; null scores go."""
    return chunks.withColumn("score", scorer(chunks, terms)).where(F.col("score").isNotNull()).withColumn("preview", T.preview(F.col("text")))


def order() -> list[Column]:
    """Best first; ties by path, part by part, and line."""
    return [F.col("score").desc(), F.split("path", "/").asc(), F.col("start_line").asc()]


def rank(chunks: DataFrame, query: str, profile: Profile = Profile(), path_prefix: str = "") -> DataFrame:
    terms = parse_terms(chunks.sparkSession, query)
    return score(chunks, terms, profile, path_prefix).orderBy(*order())


def rank_batch(chunks: DataFrame, queries: DataFrame, id_column: str = "query_id", query_column: str = "query") -> DataFrame:
    """(id, path, start_line, bm25) of every passage that holds a term of a query, for many queries at once.

    Texts are read once: tokens that no query has are left out where they are made, and what is left is
    stored as postings. If the queries' terms are few enough to be told to every task, a passage's
    postings are one row, which meets all queries in its task, without a shuffle; else they are joined.
    """
    terms = cut_lineage(queries.select(F.col(id_column), F.posexplode(F.array_distinct(T.tokens(F.col(query_column)))).alias("at", "term")))
    seen = Observation()
    tokens = chunks.select("path", "start_line", T.tokens(F.col("text")).alias("w")).withColumn("dl", F.size("w"))
    tokens = tokens.observe(seen, F.count(F.lit(1)).alias("n"), F.greatest(F.lit(1.0), F.coalesce(F.avg("dl"), F.lit(0.0))).alias("mean"))
    return (_joined if terms.count() > TOLD_TERMS else _told)(tokens, seen, terms, id_column)


def _joined(tokens: DataFrame, seen: Observation, terms: DataFrame, id_column: str) -> DataFrame:
    postings = tokens.select("path", "start_line", "dl", F.explode("w").alias("term")).join(terms.select("term").distinct(), "term", "left_semi")
    postings = cut_lineage(postings.groupBy("path", "start_line", "dl", "term").agg(F.count(F.lit(1)).cast("double").alias("tf")))
    n, mean = F.lit(float(seen.get["n"])), F.lit(float(seen.get["mean"]))
    df = postings.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    hits = postings.join(df.join(terms, "term"), "term").groupBy(id_column, "path", "start_line", "dl").agg(F.array_sort(F.collect_list(F.struct("at", "tf", "df"))).alias("h"))
    value = bm25(F.transform("h", lambda x: x["tf"]), F.col("dl"), F.transform("h", lambda x: x["df"]), n, mean)
    return hits.select(id_column, "path", "start_line", value.alias("bm25"))


def _told(tokens: DataFrame, seen: Observation, terms: DataFrame, id_column: str) -> DataFrame:
    held = sorted(terms.select("at", id_column, "term").collect(), key=lambda r: r.at)
    words = sorted({r.term for r in held})
    ids = list(dict.fromkeys(r[id_column] for r in held))
    number, place = {w: i for i, w in enumerate(words)}, {q: i for i, q in enumerate(ids)}
    # for each place in a query: which queries have a term there, and which one; an id that comes again has places of its own
    layers, times = defaultdict(list), Counter()
    for r in held:
        layers[r.at, times[r.at, r[id_column]]].append((place[r[id_column]], number[r.term]))
        times[r.at, r[id_column]] += 1
    places = [np.array(layers[at], np.int64).T for at in sorted(layers)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The numbers of a passage's terms and how often each occurs; passages without any go."""
        for batch in batches:
            lists = batch.column("w")
            found = pc.index_in(lists.flatten(), value_set=pa.array(words, lists.type.value_type))
            row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            hit = found.is_valid().to_numpy(zero_copy_only=False)
            both, tf = np.unique(row[hit].astype(np.int64) * len(words) + found.drop_null().to_numpy(), return_counts=True)
            rows, starts = np.unique(both // max(1, len(words)), return_index=True)
            ends = pa.array(np.append(starts, len(both)), pa.int32())
            kept = batch.select(["path", "start_line", "dl"]).take(pa.array(rows))
            lists = [pa.ListArray.from_arrays(ends, pa.array(v, pa.int32())) for v in (both % max(1, len(words)), tf)]
            yield pa.RecordBatch.from_arrays([*kept.columns, *lists], names=["path", "start_line", "dl", "terms", "tf"])

    fields = {f.name: f.dataType.simpleString() for f in tokens.schema}
    postings = tokens.select("path", "start_line", "dl", "w").mapInArrow(count, f"path {fields['path']}, start_line {fields['start_line']}, dl int, terms array<int>, tf array<int>")
    postings = cut_lineage(postings)
    n, mean = float(seen.get["n"]), float(seen.get["mean"])
    df = postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    idf = np.zeros(len(words))
    for term, value in df.select("term", F.log(F.lit(1.0) + (F.lit(n) - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))).collect():
        idf[term] = value
    step = max(1, TOLD_CELLS // max(1, len(words), len(ids)))
    id_field = terms.schema[id_column]
    id_type = to_arrow_type(id_field.dataType)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A table of the terms' parts, a column for each of some passages, summed for each query in the order of its terms."""
        known = pa.array(ids, id_type)
        for whole in batches:
            for first in range(0, whole.num_rows, step):
                batch = whole.slice(first, step)
                dl = batch.column("dl").to_numpy(zero_copy_only=False)
                length = (1 - B) + B * (np.maximum(dl, 1).astype(np.float64) / mean)
                lists, m = batch.column("terms"), batch.num_rows
                row, term = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
                tf = batch.column("tf").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                part = np.zeros((len(words), m))
                part[term, row] = idf[term] * (tf * (K1 + 1) / (tf + K1 * length[row]))
                total = np.zeros((len(ids), m))
                for query, term_of in places:
                    total[query] += part[term_of]
                query, row = np.nonzero(total)  # every part is above 0
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([known.take(pa.array(query)), batch.column("path").take(at), batch.column("start_line").take(at), pa.array(total[query, row])], names=[id_column, "path", "start_line", "bm25"])

    return postings.mapInArrow(weigh, f"`{id_column}` {id_field.dataType.simpleString()}, path {fields['path']}, start_line {fields['start_line']}, bm25 double")
