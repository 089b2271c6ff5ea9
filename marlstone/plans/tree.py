"""A small directory with one file of most kinds, and queries over it that have expected rows written by hand."""

from __future__ import annotations

import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.config import ScanOptions
from marlstone.functions import text as T
from marlstone.operators import audit, chunk, index, pack, rank
from marlstone.plans import literals
from marlstone.session import shared_folder
from marlstone.sources import files


def build(folder: Path) -> Path:
    (folder / "docs/.hidden").mkdir(parents=True)
    (folder / "node_modules").mkdir()
    (folder / "docs/a.md").write_text("# Storage engine\n\nThe storage engine keeps pages.\nAPI_KEY=abcdefgh12345\n\n# Other\n\nnothing here")
    (folder / "docs/b.html").write_text("<h1>Engine</h1><p>fast &amp; small storage</p>")
    (folder / "docs/.hidden/x.md").write_text("storage")
    (folder / "node_modules/y.md").write_text("storage")
    (folder / ".env").write_text("contact=me@mail.example.org")
    (folder / "image.txt").write_bytes(b"a\0b")
    (folder / "bad.pdf").write_bytes(b"nothing")
    (folder / "cut.txt").write_bytes(b"a" * 8191 + "é".encode() + b"z")
    body = b"BT /F1 12 Tf (Paged storage) Tj 0 -14 Td [(in a ) -300 (file\\))] TJ ET"
    (folder / "c.pdf").write_bytes(b"%PDF-1.4\n1 0 obj << /Length 60 >>\nstream\n" + body + b"\nendstream endobj\n")
    with zipfile.ZipFile(folder / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w" xmlns:a="a"><w:p><w:r><w:t>First &amp; storage</w:t></w:r></w:p><w:p><w:r><w:t>x</w:t><w:tab/><w:t>y</w:t></w:r></w:p><w:drawing><a:p><a:t>not text</a:t></a:p></w:drawing></w:document>')
    with zipfile.ZipFile(folder / "e.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        z.writestr("O/p.opf", '<package><manifest><item id="1" href="t%201.xhtml" media-type="application/xhtml+xml"/><item id="2" href="u.xhtml" media-type="application/xhtml+xml"/><item id="n" href="n.xhtml" media-type="application/xhtml+xml" properties="nav"/></manifest><spine><itemref idref="2"/><itemref idref="1"/><itemref idref="n"/></spine></package>')
        z.writestr("O/t 1.xhtml", "<p>second</p>")
        z.writestr("O/u.xhtml", "<p>first storage</p>")
    return folder


def _fresh(spark: SparkSession) -> Path:
    """A new copy among the shared folders, which driver and executors both see."""
    return build(Path(shared_folder(spark).removeprefix("file://")) / f"tree-{uuid.uuid4().hex}")


def scan_tree(spark: SparkSession, sf: str) -> DataFrame:
    found = files.scan(spark, str(_fresh(spark)), ScanOptions(excluded=("cut.txt",)))
    return found.files.select("path", "kind", F.lit(None).cast("string").alias("reason")).unionByName(found.skipped.select("path", F.lit(None).cast("string").alias("kind"), "reason"))


def extract_tree(spark: SparkSession, sf: str) -> DataFrame:
    corpus = files.load(spark, str(_fresh(spark)), ScanOptions(excluded=("cut.txt",)))
    return corpus.documents.select("path", "kind", "text").unionByName(corpus.issues.select("path", F.lit("issue").alias("kind"), F.lit(None).cast("string").alias("text")))


def chunk_tree(spark: SparkSession, sf: str) -> DataFrame:
    corpus = files.load(spark, str(_fresh(spark)), ScanOptions(included=("docs", "d.docx", "e.epub")))
    return corpus.chunks.select("path", "chunk_kind", "title", "start_line", "end_line", "text")


def audit_tree(spark: SparkSession, sf: str) -> DataFrame:
    found = audit.ordered(files.load(spark, str(_fresh(spark))).findings)
    return found.select("path", "line", "kind", "severity")


def index_tree(spark: SparkSession, sf: str) -> DataFrame:
    """An index that is built, found fresh, brought up to date after changes, forced, and cleared."""
    source = _fresh(spark)
    held = index.Index(spark, (source / ".index").as_uri(), grace=0)
    rows = []

    def step(name: str, force: bool = False) -> None:
        scan = files.scan(spark, str(source))

        def extract(listing: DataFrame) -> tuple[DataFrame, DataFrame]:
            docs, issues = files.documents(listing, str(source))
            return chunk.split(docs), issues

        before = held.status(scan.files)
        done = held.refresh(scan.files, extract, force)
        rows.append((name, before, held.status(scan.files), done.created, done.rebuilt, done.reused, done.updated, done.removed, done.indexed, done.written, held.issues().count()))

    step("build")
    step("again")
    (source / "docs/a.md").write_text("# Changed\n\nnew words")
    (source / ".env").unlink()
    (source / "new.txt").write_text("one more")
    step("changed")
    step("forced", True)
    rows.append(("clear", "fresh", "missing" if held.clear() and held.status(files.scan(spark, str(source)).files) == "missing" else "left", None, None, None, None, None, None, None, None))
    return spark.createDataFrame(rows, "step string, before string, after string, created boolean, rebuilt boolean, reused long, updated long, removed long, indexed long, written boolean, issues long")


def pack_tree(spark: SparkSession, sf: str) -> DataFrame:
    """The bundle and the report of the directory, line by line, with redaction."""
    corpus = files.load(spark, str(_fresh(spark)), ScanOptions(included=("docs", "d.docx")))
    made = pack.pack(corpus.chunks, corpus.findings, corpus.issues, "storage engine", 400, redaction=True)
    texts = [("bundle", made.bundle().first().value), ("report", made.report())]
    return spark.createDataFrame([(name, n, line) for name, text in texts for n, line in enumerate(text.split("\n"), 1)], "document string, line long, text string")


CJK_TEXTS = [(1, "数据库engine"), (2, "检索"), (3, "Ａｂｃ１２ ⽂⼈"), (4, "a_b，c、d"), (5, "ΣΑΣ"), (6, "")]


def cjk_tokens(spark: SparkSession, sf: str) -> DataFrame:
    rows = literals.frame(spark, CJK_TEXTS, "id long, text string")
    return rows.select("id", T.search_form(F.col("text")).alias("form"), F.concat_ws("|", T.tokens(F.col("text"))).alias("tokens"))


def rank_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Sections whose titles hold query words: parts of the score beside BM25."""
    sections = chunk.markdown_sections(literals.docs(spark, TITLED, "markdown"))
    found = rank.score(sections, ["storage", "engine"])
    return found.select("path", "start_line", "text_match_score", "term_coverage_score", "full_coverage_score", "path_match_score", "title_match_score", "file_name_match_score", "file_kind_score", "density_score")


TITLED = [("storage/a.md", "# Storage Engine\nengine storage engine\n# Other\nnothing"), ("b/engine.md", "plain words"), ("c/d.md", "storage\n# No match\nx")]

QUERIES = (scan_tree, extract_tree, chunk_tree, audit_tree, index_tree, pack_tree, cjk_tokens, rank_titles)


def _rows(columns: dict[str, str], rows: list[tuple]) -> str:
    """SQL for these rows."""
    picked = ", ".join(f"CAST({c} AS {k}) AS {c}" for c, k in columns.items())
    return f"SELECT {picked} FROM (VALUES {literals.values(rows)}) AS v({', '.join(columns)})"


TEXT, INT, BOOL = "VARCHAR", "BIGINT", "BOOLEAN"


def statements() -> dict[str, str]:
    scanned = [("docs/a.md", "markdown"), ("docs/b.html", "html"), (".env", "text"), ("bad.pdf", "pdf"), ("c.pdf", "pdf"), ("d.docx", "docx"), ("e.epub", "epub")]
    skipped = [("docs/.hidden", "Ignored directory"), ("node_modules", "Ignored directory"), ("image.txt", "Binary"), ("cut.txt", "Filtered path")]
    note = "# Storage engine\n\nThe storage engine keeps pages.\nAPI_KEY=abcdefgh12345\n\n# Other\n\nnothing here"
    texts = [
        ("docs/a.md", "markdown", note), ("docs/b.html", "html", "Engine\nfast & small storage"), (".env", "text", "contact=me@mail.example.org"), ("c.pdf", "pdf", "Paged storage\nin a file)"),
        ("d.docx", "docx", "First & storage\nx y"), ("e.epub", "epub", "first storage\n\nsecond"), ("bad.pdf", "issue", None),
    ]
    chunks = [
        ("docs/a.md", "markdown section", "Storage engine", 1, 5, "# Storage engine\n\nThe storage engine keeps pages.\nAPI_KEY=abcdefgh12345\n"), ("docs/a.md", "markdown section", "Other", 6, 8, "# Other\n\nnothing here"),
        ("docs/b.html", "paragraph", None, 1, 2, "Engine\nfast & small storage"), ("d.docx", "paragraph", None, 1, 2, "First & storage\nx y"), ("e.epub", "paragraph", None, 1, 3, "first storage\nsecond"),
    ]
    steps = [
        ("build", "missing", "fresh", "true", "false", 0, 8, 0, 8, "true", 1), ("again", "fresh", "fresh", "false", "false", 8, 0, 0, 8, "false", 1), ("changed", "stale", "fresh", "false", "false", 6, 2, 1, 8, "true", 1),
        ("forced", "fresh", "fresh", "false", "true", 0, 8, 0, 8, "true", 1), ("clear", "fresh", "missing", None, None, None, None, None, None, None, None),
    ]
    tokens = [
        (1, "数据库engine", "数据库|数据|据库|数据库|engine"), (2, "检索", "检索|检索"), (3, "abc12 文人", "abc12|文人|文人"), (4, "a_b,c d", "a_b|c|d"), (5, "σασ", "σασ"), (6, "", ""),
    ]
    # storage/a.md, line 1: three words, storage twice and engine three times (title and text); its title and folder match too
    titled = [("storage/a.md", 1, 6, 12, 18, 2, 8, 0, 7, 8), ("storage/a.md", 3, 0, 6, 0, 2, 0, 0, 7, 0), ("b/engine.md", 1, 0, 6, 0, 2, 0, 3, 4, 0), ("c/d.md", 1, 3, 6, 0, 0, 0, 0, 7, 0)]
    parts = ["text_match_score", "term_coverage_score", "full_coverage_score", "path_match_score", "title_match_score", "file_name_match_score", "file_kind_score", "density_score"]
    bundle = ["# Context Bundle", "", "## Goal", "", "storage engine", "", "## Selected Context", "", "### docs/a.md", "", "Lines 1-5", "", "# Storage engine", "", "The storage engine keeps pages.", "[REDACTED: API key]", "",
              "### docs/b.html", "", "Lines 1-2", "", "Engine", "fast & small storage", "", ""]
    # tokens: 16 of the head, 18 + 7 and 7 + 7 of the passages and their labels; 60 % of 384 for a file
    report = ["# Context Report", "", "- Goal: storage engine", "- Budget: 400", "- Used tokens: 55", "- Remaining tokens: 345", "- Per-file budget limit: 230", "- Candidate chunks: 3", "- Selected files: 2", "- Selected spans: 2",
              "- Excluded chunks: 1", "- Selected privacy findings: 1", "- Source privacy findings: 1", "- Extraction warnings: 0", "- Redaction: enabled", "- Redacted spans: 1", "", "## Selected privacy severity counts", "", "- High: 1", "",
              "## Selected privacy finding types", "", "- API key: 1", "", ""]
    packed = [(name, n, line) for name, lines in (("bundle", bundle), ("report", report)) for n, line in enumerate(lines, 1)]
    return {
        "pack_tree": _rows({"document": TEXT, "line": INT, "text": TEXT}, packed),
        "scan_tree": _rows({"path": TEXT, "kind": TEXT, "reason": TEXT}, [(p, k, None) for p, k in scanned] + [(p, None, r) for p, r in skipped]),
        "extract_tree": _rows({"path": TEXT, "kind": TEXT, "text": TEXT}, texts),
        "chunk_tree": _rows({"path": TEXT, "chunk_kind": TEXT, "title": TEXT, "start_line": INT, "end_line": INT, "text": TEXT}, chunks),
        "audit_tree": _rows({"path": TEXT, "line": INT, "kind": TEXT, "severity": TEXT}, [(".env", 1, "Email address", "Low"), ("docs/a.md", 4, "API key", "High")]),
        "index_tree": _rows({"step": TEXT, "before": TEXT, "after": TEXT, "created": BOOL, "rebuilt": BOOL, "reused": INT, "updated": INT, "removed": INT, "indexed": INT, "written": BOOL, "issues": INT}, steps),
        "cjk_tokens": _rows({"id": INT, "form": TEXT, "tokens": TEXT}, tokens),
        "rank_titles": _rows({"path": TEXT, "start_line": INT} | dict.fromkeys(parts, INT), titled),
    }
