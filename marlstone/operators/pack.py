"""Packing: findings of what was selected, gate, redaction, spans, statistics and the three documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import audit, budget, chunk, rank

DETAILS = 50


class PackError(ValueError):
    pass


def overhead_text(goal: str) -> str:
    return f"# Context Bundle\n\n## Goal\n\n{goal}\n\n## Selected Context\n\n"


def selected_findings(findings: DataFrame, chunks: DataFrame) -> DataFrame:
    """Findings on a line of a passage."""
    inside = (F.col("f.path") == F.col("c.path")) & F.col("f.line").between(F.col("c.start_line"), F.col("c.end_line"))
    return findings.alias("f").join(chunks.select("path", "start_line", "end_line").alias("c"), inside, "left_semi")


def gate_count(findings: DataFrame, threshold: str) -> DataFrame:
    return findings.where(audit.at_least(F.col("severity"), threshold)).agg(F.count(F.lit(1)).alias("n"))


def redact(chunks: DataFrame, findings: DataFrame, strict_compat: bool = False) -> DataFrame:
    """`chunks` with lines that have a finding replaced by its kind, and `redacted`.

    A line is known by where it comes from (`src_lines`). With `strict_compat` it is taken to be the
    passage's first line plus its place, which is wrong for tables and extracted documents.
    """
    by_line = findings.groupBy("path", "line").agg(F.min("kind").alias("kind")).groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("line", "kind"))).alias("_kinds"))
    placed = T.lines(F.col("text"))
    at = F.transform(placed, lambda _, i: F.col("start_line") + i) if strict_compat else F.col("src_lines")
    joined = chunks.join(by_line, "path", "left")
    kind_of = lambda line: F.try_element_at(F.col("_kinds"), line)
    shown = F.zip_with(placed, at, lambda text, line: F.when(kind_of(line).isNotNull(), F.concat(F.lit("[REDACTED: "), kind_of(line), F.lit("]"))).otherwise(text))
    hit = F.exists(at, lambda line: F.coalesce(kind_of(line).isNotNull(), F.lit(False)))
    out = joined.withColumn("redacted", F.coalesce(hit, F.lit(False)))
    out = out.withColumn("text", F.when(F.col("redacted"), F.array_join(shown, "\n")).otherwise(F.col("text"))).drop("_kinds")
    return out.withColumn("preview", T.preview(F.col("text"))) if "preview" in chunks.columns else out


def spans(chunks: DataFrame) -> DataFrame:
    """Passages of a file that follow the span before them within two lines, as one: (path, start_line, end_line, text, redacted).

    A fold over a file's passages in order keeps the end of the last span; a passage that overlaps it starts a span of its own.
    """
    held = chunks.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start_line", "end_line", "text", "redacted"))).alias("all"))
    start = F.struct(F.lit(None).cast("long").alias("end"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("cuts"))

    def step(s: Column, x: Column) -> Column:
        follows = F.coalesce((x["start_line"] > s["end"]) & (x["start_line"] <= s["end"] + 2), F.lit(False))
        return F.struct(
            F.when(follows, F.greatest(s["end"], x["end_line"])).otherwise(x["end_line"]).cast("long").alias("end"), (s["at"] + 1).alias("at"),
            F.when(follows, s["cuts"]).otherwise(F.concat(s["cuts"], F.array(s["at"]))).alias("cuts"),
        )

    parts = chunk.once(F.col("all"), lambda of: chunk.once(F.aggregate(of, start, step, lambda s: s["cuts"]), lambda c: chunk.parts(c, of)))
    part = held.select("path", F.explode(parts).alias("p"))
    return part.select(
        "path", F.col("p")[0]["start_line"].alias("start_line"), F.array_max(F.transform("p", lambda x: x["end_line"])).alias("end_line"),
        F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"), F.exists("p", lambda x: x["redacted"]).alias("redacted"),
    )


def label_counts(df: DataFrame, *columns: str) -> DataFrame:
    """(label, n) of each value of each column, in one pass."""
    labels = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("of"), F.col(c).alias("label")) for c in columns))).alias("x"))
    return labels.groupBy("x.of", "x.label").agg(F.count(F.lit(1)).alias("n")).select("label", "n")


def _as_map(df: DataFrame, column: str) -> dict[str, int]:
    return {r["label"]: r["n"] for r in sorted(label_counts(df, column).collect(), key=lambda r: r["label"])}


@dataclass
class Packed:
    """Lazy results, and the three documents as text once `render` is asked for."""

    goal: str
    policy: budget.Policy
    budget_tokens: int
    candidates: int
    selected: DataFrame
    excluded: DataFrame
    findings: DataFrame
    chosen_findings: DataFrame
    issues: DataFrame
    redaction: bool
    used: int

    def bundle(self) -> DataFrame:
        """The bundle's text in one row; what is selected is bounded by the budget."""
        whole = spans(self.selected).join(self.selected.groupBy("path").agg(F.min("position").alias("first")), "path")
        part = F.concat(F.format_string("Lines %d-%d\n\n", "start_line", "end_line"), F.col("text"), F.lit("\n\n"))
        files = whole.groupBy("path", "first").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_line", part.alias("p")))), lambda x: x["p"]), "").alias("body"))
        texts = F.transform(F.array_sort(F.collect_list(F.struct("first", F.concat(F.lit("### "), F.col("path"), F.lit("\n\n"), F.col("body")).alias("t")))), lambda x: x["t"])
        return files.agg(F.concat(F.lit(overhead_text(self.goal)), F.when(F.count(F.lit(1)) == 0, "No matching context was selected.\n\n").otherwise(F.array_join(texts, ""))).alias("value"))

    def manifest(self) -> dict:
        listed = lambda df, columns, order, n=None: [r.asDict(True) for r in (df.orderBy(*order).limit(n) if n else df.orderBy(*order)).select(*columns).toLocalIterator()]
        found = ["path", "line", "kind", "severity", "evidence"]
        by_place = [F.split("path", "/"), "line", "kind"]
        return {
            "goal": self.goal, "budget": self.budget_tokens, "used_tokens": self.used, "remaining_tokens": self.budget_tokens - self.used,
            "per_file_budget_limit": self.policy.per_file, "candidate_chunks": self.candidates, "redaction_enabled": self.redaction,
            "redacted": bool(self.selected.where("redacted").limit(1).count()), "selected_chunk_types": _as_map(self.selected, "chunk_kind"),
            "privacy_severity_counts": _as_map(self.chosen_findings, "severity"), "privacy_kind_counts": _as_map(self.chosen_findings, "kind"),
            "selected_chunks": listed(self.selected, ["path", F.col("chunk_kind").alias("kind"), "title", "start_line", "end_line", "score", "token_estimate", "reasons", "redacted"], ["position"]),
            "excluded_chunks_total": self.excluded.count(), "excluded_chunks": listed(self.excluded, ["path", "start_line", "end_line", "score", "token_estimate", "reason"], ["phase", *rank.order()], DETAILS),
            "privacy_findings_total": self.findings.count(), "privacy_findings": listed(self.findings, found, by_place, DETAILS),
            "selected_privacy_findings": listed(self.chosen_findings, found, by_place), "extraction_issues": listed(self.issues, ["path", "message"], ["path"]),
        }

    def report(self) -> str:
        whole = spans(self.selected).agg(F.countDistinct("path").alias("files"), F.count(F.lit(1)).alias("spans"), F.sum(F.col("redacted").cast("int")).alias("redacted")).first()
        rows = [
            ("Goal", self.goal), ("Budget", self.budget_tokens), ("Used tokens", self.used), ("Remaining tokens", self.budget_tokens - self.used), ("Per-file budget limit", self.policy.per_file),
            ("Candidate chunks", self.candidates), ("Selected files", whole.files), ("Selected spans", whole.spans), ("Excluded chunks", self.excluded.count()),
            ("Selected privacy findings", self.chosen_findings.count()), ("Source privacy findings", self.findings.count()), ("Extraction warnings", self.issues.count()),
            ("Redaction", "enabled" if self.redaction else "disabled"), ("Redacted spans", whole.redacted or 0),
        ]
        tables = [(f"Selected privacy {what}", _as_map(self.chosen_findings, column)) for what, column in (("severity counts", "severity"), ("finding types", "kind"))]
        listed = [f"## {title}\n\n" + "".join(f"- {k}: {n}\n" for k, n in (held or {"none": 0}).items()) for title, held in tables]
        return "# Context Report\n\n" + "".join(f"- {k}: {v}\n" for k, v in rows) + "\n" + "\n".join(listed) + "\n"


def pack(chunks: DataFrame, findings: DataFrame, issues: DataFrame, goal: str, budget_tokens: int = 6000, redaction: bool = False, gate: str | None = None) -> Packed:
    """Rank, floor, budget, gate and redact; errors come in the order of these checks."""
    spark = chunks.sparkSession
    if not goal.strip():
        raise PackError("the goal is empty")
    if budget_tokens <= 0:
        raise PackError("the budget must be positive")
    overhead = spark.range(1).select(T.token_estimate(F.lit(overhead_text(goal)))).first()[0]
    if budget_tokens <= overhead:
        raise PackError(f"the budget must exceed the fixed overhead of {overhead}")
    if not chunks.limit(1).count():
        raise PackError("there are no passages")
    ranked = rank.rank(chunks, goal)
    judged = budget.floored(ranked).persist()
    candidates = judged.count()
    if not candidates:
        raise PackError("no passage matches the goal")
    policy = budget.Policy(budget_tokens - overhead)
    decided = budget.select(budget.with_rendering_cost(judged.where("kept").drop("kept", "reason")), policy).persist()
    selected = decided.where("decision = 'selected'")
    totals = decided.agg(F.sum(F.when(F.col("decision") == "selected", F.col("token_estimate"))).alias("used"), F.min("token_estimate").alias("least")).first()
    if totals.used is None:
        raise PackError(f"the budget selects nothing; it takes {overhead + (totals.least or 1)} at least")
    chosen = selected_findings(findings, selected)
    if gate and gate_count(chosen, gate).first().n:
        raise PackError(f"selected passages have findings of severity {gate} or more")
    selected = redact(selected, findings) if redaction else selected.withColumn("redacted", F.lit(False))
    phases = F.when(F.col("decision") == "global", 0).otherwise(1)
    excluded = decided.where("decision != 'selected'").withColumn("phase", phases).select("path", "start_line", "end_line", "score", "token_estimate", "preview", "reason", "phase")
    excluded = excluded.unionByName(judged.where("not kept").withColumn("phase", F.lit(2)).select(*excluded.columns))
    return Packed(goal, policy, budget_tokens, candidates, selected, excluded, findings, chosen, issues, redaction, overhead + totals.used)


def as_json(manifest_like: Column) -> Column:
    return F.to_json(manifest_like, {"ignoreNullFields": "false"})
