"""Chunkers: documents (path, kind, text) to passages addressed by lines.

Each passage is (path, kind, chunk_kind, title, start_line, end_line, text, token_estimate,
src_lines), src_lines being the line of the document that each line of the passage comes from.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions import text as T
from marlstone.functions.text import once

ROWS = 25
TARGET_CHARS, MOST_CHARS = 700, 1200
COLUMNS = ["path", "kind", "chunk_kind", "title", "start_line", "end_line", "text", "token_estimate", "src_lines"]


def _lines(text: Column) -> Column:
    """A text's lines with their numbers."""
    return F.transform(T.lines(text), lambda line, i: F.struct((i + 1).cast("long").alias("line"), line.alias("content")))


def _places(of: Column) -> Column:
    return F.when(F.size(of) > 0, F.sequence(F.lit(0), F.size(of) - 1)).otherwise(F.array().cast("array<int>"))


def parts(cuts: Column, of: Column) -> Column:
    """The pieces of an array from each cut to the next."""
    return F.transform(cuts, lambda c, i: F.slice(of, c + 1, F.coalesce(F.get(cuts, i + 1), F.size(of)) - c))


def _cut(docs: DataFrame, kept: Column, cuts: Callable[[Column], Column]) -> DataFrame:
    """(path, kind, part, lines) of each document: its kept lines, cut without a shuffle at the places that `cuts` tells.

    The pieces are exploded, not the places, so that no row holds more than its own lines. They have no
    column of their own: the planner would ask it for null and for its size where texts are read, and cut each text three times.
    """
    return docs.select("path", "kind", F.posexplode(once(kept, lambda of: once(cuts(of), lambda c: parts(c, of)))).alias("part", "lines"))


def _chunks(parts: DataFrame, chunk_kind: Column, title: Column) -> DataFrame:
    """One passage for each row of lines; chunk_kind and title may use `part` and `lines`."""
    filled = F.exists("lines", lambda x: ~T.blank(x["content"]))  # asked of the lines, so that no text is made for the question
    made = parts.where(filled).select(
        "path", "kind", chunk_kind.alias("chunk_kind"), title.alias("title"), F.col("lines")[0]["line"].alias("start_line"), F.element_at("lines", -1)["line"].alias("end_line"),
        F.array_join(F.transform("lines", lambda x: x["content"]), "\n").alias("text"), F.transform("lines", lambda x: x["line"]).alias("src_lines"),
    )
    return made.withColumn("token_estimate", T.token_estimate(F.col("text"))).select(*COLUMNS)


def paragraphs(docs: DataFrame) -> DataFrame:
    """Islands of lines that aren't blank."""
    filled = F.filter(_lines(F.col("text")), lambda x: ~T.blank(x["content"]))
    gaps = lambda of: F.filter(_places(of), lambda i: (i == 0) | (F.get(of, i)["line"] != F.get(of, i - 1)["line"] + 1))
    return _chunks(_cut(docs, filled, gaps), F.lit("paragraph"), F.lit(None).cast("string"))


def markdown_sections(docs: DataFrame) -> DataFrame:
    """Sections from heading to heading; a document without a heading is cut into paragraphs."""
    headed = F.exists(T.lines(F.col("text")), lambda line: line.rlike(T.HEADING))
    starts = lambda of: F.filter(_places(of), lambda i: (i == 0) | F.get(of, i)["content"].rlike(T.HEADING))
    sections = _cut(docs.where(headed), _lines(F.col("text")), starts)
    return _chunks(sections, F.lit("markdown section"), T.heading_title(F.col("lines")[0]["content"])).unionByName(paragraphs(docs.where(~headed)))


def _item(item: str, title_of: Callable[[Column], Column]) -> tuple[Column, Column]:
    """The kind and title of a piece that begins with an item, or of what precedes the first one."""
    title = title_of(F.col("lines")[0]["content"])
    begins = title.isNotNull()
    return F.when(begins, item).otherwise("paragraph"), F.when(begins, title)


def rust_items(docs: DataFrame) -> DataFrame:
    """Items that start outside of all braces; what precedes the first is a paragraph.

    One fold over the lines keeps the depth of braces, which doesn't fall below 0, and the places of the cuts.
    """
    count = lambda x, brace: F.length(x) - F.length(F.replace(x, F.lit(brace), F.lit("")))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("cuts"))

    def step(s: Column, x: Column) -> Column:
        begins = (s["at"] == 0) | ((s["depth"] == 0) & T.rust_title(x["content"]).isNotNull())
        depth = F.greatest(F.lit(0), s["depth"] + count(x["content"], "{") - count(x["content"], "}"))
        return F.struct(depth.alias("depth"), (s["at"] + 1).alias("at"), F.when(begins, F.concat(s["cuts"], F.array(s["at"]))).otherwise(s["cuts"]).alias("cuts"))

    parts = _cut(docs, _lines(F.col("text")), lambda of: F.aggregate(of, start, step, lambda s: s["cuts"]))
    return _chunks(parts, *_item("rust item", T.rust_title))


def code_items(docs: DataFrame) -> DataFrame:
    """Items cut at lines that start one; blank lines at the document's beginning are left out."""
    # the first filled line is found once: a count of lines told inside of the numbering split the text again for each of them
    filled = lambda of: F.get(F.filter(of, lambda x: ~T.blank(x["content"])), F.lit(0))["line"].cast("int")
    kept = once(_lines(F.col("text")), lambda of: once(F.coalesce(filled(of), F.size(of) + 1), lambda first: F.slice(of, first, F.greatest(F.size(of) - first + 1, F.lit(0)))))
    starts = lambda of: F.filter(_places(of), lambda i: (i == 0) | T.code_title(F.get(of, i)["content"]).isNotNull())
    return _chunks(_cut(docs, kept, starts), *_item("code item", T.code_title))


def table_rows(docs: DataFrame) -> DataFrame:
    """The header and 25 rows to a passage."""
    filled = F.filter(_lines(F.col("text")), lambda x: ~T.blank(x["content"]))
    rows = lambda of: F.when(F.size(of) > 1, F.sequence(F.lit(1), F.size(of) - 1, F.lit(ROWS))).otherwise(_places(of))
    # each piece takes the header along: a column beside the pieces would bring all of them into every row
    headed = lambda of: F.transform(once(rows(of), lambda c: parts(c, of)), lambda p: F.struct(F.get(of, F.lit(0)).alias("header"), p.alias("rows")))
    held = docs.select("path", "kind", F.explode(once(filled, headed)).alias("h")).select("path", "kind", "h.header", "h.rows")
    # the header is part of every passage's text, but its line isn't where the passage begins
    made = _chunks(held.withColumn("lines", F.when(F.col("rows")[0]["line"] == F.col("header.line"), F.col("rows")).otherwise(F.concat(F.array("header"), "rows"))), F.lit("table rows"), F.col("header.content"))
    return made.withColumn("start_line", F.coalesce(F.get("src_lines", F.lit(1)), F.col("start_line")))


def listed_rows(rows: DataFrame, header: str) -> DataFrame:
    """What `table_rows` makes of delimited documents that come row by row: (path, kind, at, content), in the order of `at`, then content, below the header.

    No document is put together, so its length is bounded by no task's memory: rows are counted in a
    sort by path, which goes to disk, and meet only the 25 of their passage.
    """
    if not header.strip() or "\n" in header:
        raise ValueError("the header is a line that isn't blank")
    by_place = Window.partitionBy("path").orderBy("at", "content")
    filled = ~T.blank(F.col("content"))
    counted = rows.select("path", "kind", "content", (F.row_number().over(by_place) + 1).cast("long").alias("line"), F.sum(filled.cast("long")).over(by_place.rowsBetween(Window.unboundedPreceding, 0)).alias("n"))
    part = F.floor(F.greatest(F.col("n") - 1, F.lit(0)) / ROWS)  # blank rows go with what precedes them
    held = counted.groupBy("path", "kind", part.alias("part")).agg(F.array_sort(F.collect_list(F.when(filled, F.struct("line", "content")))).alias("rows"))
    first = F.struct(F.lit(1).cast("long").alias("line"), F.lit(header).alias("content"))
    made = _chunks(held.select("path", "kind", F.concat(F.array(first), "rows").alias("lines")), F.lit("table rows"), F.lit(header))
    return made.withColumn("start_line", F.coalesce(F.get("src_lines", F.lit(1)), F.col("start_line")))


def extracted(docs: DataFrame) -> DataFrame:
    """Passages of extracted documents: cut before headings and at 1200 characters, and after a sentence from 700 on.

    One fold over a document's lines keeps the running size and the places of the cuts.
    """
    filled = F.filter(F.transform(T.lines(F.col("text")), lambda line, i: F.struct((i + 1).cast("long").alias("line"), T.trim(line).alias("content"))), lambda x: x["content"] != "")
    marked = F.transform(filled, lambda x: F.struct(x["line"].alias("line"), x["content"].alias("content"), (F.length(x["content"]) + 1).alias("size"), T.extracted_heading(x["content"]).alias("heading"), T.ends_sentence(x["content"]).alias("sentence")))
    start = F.struct(F.lit(0).alias("size"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("cuts"))

    def step(s: Column, x: Column) -> Column:
        fresh = (s["size"] == 0) | x["heading"] | (s["size"] + x["size"] > MOST_CHARS)
        size = F.when(fresh, F.lit(0)).otherwise(s["size"]) + x["size"]
        return F.struct(
            F.when((size >= TARGET_CHARS) & x["sentence"], F.lit(0)).otherwise(size).alias("size"), (s["at"] + 1).alias("at"),
            F.when(fresh, F.concat(s["cuts"], F.array(s["at"]))).otherwise(s["cuts"]).alias("cuts"),
        )

    parts = _cut(docs, marked, lambda of: F.aggregate(of, start, step, lambda s: s["cuts"]))
    first = F.col("lines")[0]
    return _chunks(parts, F.lit("paragraph"), F.when(first["heading"], first["content"]))


CHUNKERS = (
    (("markdown",), markdown_sections),
    (("rust",), rust_items),
    (("code",), code_items),
    (("csv", "tsv"), table_rows),
    (("text", "toml", "json", "yaml", "xml", "html"), paragraphs),
    (("pdf", "docx", "epub"), extracted),
)


def split(docs: DataFrame, kinds: set[str] | None = None) -> DataFrame:
    """Passages of documents of every kind; `kinds` names those that occur, if they are known."""
    parts = [cut(docs.where(F.col("kind").isin(*found))) for found, cut in CHUNKERS if kinds is None or kinds & set(found)]
    return reduce(DataFrame.unionByName, parts)
