"""Behaviour of the engine's own operators on small literal inputs."""

import json
import re
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from marlstone import cli, config, session
from marlstone.functions import text as T
from marlstone.operators import audit, budget, chunk, index, pack, rank, search
from marlstone.plans import registry, tree
from marlstone.sources import extract, files


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize(("text", "n"), [("abcdefgh", 2), ("自然语言处", 5), ("", 1), ("abcde", 2), ("ab自cd", 3)])
def test_token_estimate(spark, text, n):
    assert one(spark, T.token_estimate, text) == n


@pytest.mark.parametrize(("text", "want"), [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\n\n", ["a", ""]), ("\n", [""]), ("a\r\nb\rc\r\n", ["a", "b\rc"]), (None, [])])
def test_lines(spark, text, want):
    assert one(spark, T.lines, text) == want


def test_tokens(spark):
    assert one(spark, T.tokens, "Rust rust 检索词") == ["rust", "rust", "检索词", "检索", "索词", "检索词"]
    assert one(spark, T.tokens, "ＡＢ－c_1，ΟΔΟΣ x") == ["ab", "c_1", "οδοσ", "x"]
    assert rank.parse_terms(spark, "b a B 检索") == ["b", "a", "检索"]


def test_statistics_of_terms(spark):
    terms = ["rust", "检索词", "检索", "索词"]
    got = spark.createDataFrame([("Rust rust 检索词",)], "t string").select(rank.frequencies(F.col("t"), terms).alias("f")).first().f
    assert (got.tf, got.dl) == ([2, 2, 1, 1], 6)


def test_document_form(spark):
    assert one(spark, T.document_form, " a\x07\tb \r\n\r\n\r\n\r\nc ") == "a b\n\nc" == extract.tidy(" a\x07\tb \r\n\r\n\r\n\r\nc ")


@pytest.mark.parametrize("html", ["<h1>A</h1><p>b &amp;amp; c</p>", "x<br/>y<i>z</i>w<span>q", "<script>var a='</p>';</script>t<STYLE>p{}</STYLE >u", "a < b > c", "<p", "", "<ul><li>1<li>2</ul>&nbsp;&lt;"])
def test_markup_native_and_by_reading(spark, html):
    assert one(spark, T.markup_text, html) == extract.markup(html)


def test_markup_of_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html", T.markup_text(F.col("html")).alias("t")).collect()
    assert all(extract.markup(r.html) == r.t for r in rows)


def test_titles(spark):
    assert one(spark, T.heading_title, " ##A b ##") == "A b" and one(spark, T.heading_title, "### ") is None and one(spark, T.heading_title, "#######x") is None
    assert one(spark, T.rust_title, "pub fn f() {") == "pub fn f()" and one(spark, T.rust_title, "pub(crate) fn f()") is None
    assert one(spark, T.code_title, "def f(x):") == "def f(x)" and one(spark, T.code_title, "if (x) {") is None
    assert one(spark, T.extracted_heading, "1.2 x") and one(spark, T.extracted_heading, "第三章 x") and not one(spark, T.extracted_heading, "12 x")


def brute_extracted(lines, heading):
    out, held, size = [], [], 0
    for n, line in enumerate(lines, 1):
        t = line.strip()
        if not t:
            continue
        if held and (heading(t) or size + len(t) + 1 > chunk.MOST_CHARS):
            out.append((held[0], held[-1]))
            held, size = [], 0
        held.append(n)
        size += len(t) + 1
        if size >= chunk.TARGET_CHARS and t[-1] in ".。!！?？;；":
            out.append((held[0], held[-1]))
            held, size = [], 0
    return out + ([(held[0], held[-1])] if held else [])


def test_extracted_against_a_loop(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").cast("string").alias("path"), F.lit("pdf").alias("kind"), "text")
    got = {}
    for r in chunk.extracted(docs).select("path", "start_line", "end_line").collect():
        got.setdefault(r.path, []).append((r.start_line, r.end_line))
    import re

    heading = lambda t: len(t) <= 120 and bool(re.match(r"[0-9]+[.)]+[^.)]|#{1,6}(\s+\S|[^#\s])", t))
    for r in docs.collect():
        assert sorted(got.get(r.path, [])) == brute_extracted(r.text.split("\n"), heading)


def ranked(spark, rows):
    """rows: (path, tokens, score, path_match)"""
    return spark.createDataFrame([(p, i, i, t, s, m, 0, 0) for i, (p, t, s, m) in enumerate(rows)], "path string, start_line long, end_line long, token_estimate long, score long, path_match_score long, title_match_score long, file_name_match_score long")


def test_budget(spark):
    a = budget.select(ranked(spark, [("a", 30, 9, 0), ("a", 25, 8, 0), ("a", 30, 7, 0), ("b", 20, 6, 0)]), budget.Policy(100)).collect()
    assert sum(r.token_estimate for r in a if r.decision == "selected") == 75 and [r.reason for r in a if r.decision == "per-file"] == ["per-file budget limit: current 55, candidate 30, limit 60"]
    b = budget.select(ranked(spark, [("a", 30, 9, 0), ("a", 25, 8, 0), ("a", 24, 7, 0)]), budget.Policy(100)).collect()
    assert sum(r.token_estimate for r in b) == 79 and {r.decision for r in b} == {"selected"}
    assert budget.select(ranked(spark, [("a", 1, 1, 0)]).limit(0)).count() == 0


def test_relevance_floor(spark):
    kept = lambda rows: [r.kept for r in budget.floored(ranked(spark, rows)).orderBy("start_line").collect()]
    assert kept([("a", 1, 100, 0), ("a", 1, 20, 0), ("b", 1, 20, 0)]) == [True, True, False]
    assert kept([("a", 1, 100, 0), ("b", 1, 40, 4), ("c", 1, 40, 0)]) == [True, True, False]


def test_grouped_hits(spark):
    hits = ranked(spark, [("a", 1, 30, 0), ("a", 1, 29, 0), ("a", 1, 28, 0), ("b", 1, 27, 0)])
    assert [(r.path, r.score) for r in search.grouped(hits, 3, 2).collect()] == [("a", 30), ("a", 29), ("b", 27)]
    assert search.grouped(hits, 0, 0).count() == 4 and search.totals(hits).first() == (4, 2)


def test_path_order(spark):
    rows = ranked(spark, [("a-b/c", 1, 5, 0), ("a/b", 1, 5, 0), ("a/a", 1, 5, 0)])
    assert [r.path for r in rows.orderBy(*rank.order()).collect()] == ["a/a", "a/b", "a-b/c"]


def test_focused_match_beats_repetition(spark):
    rows = [("x.md", "markdown", "paragraph", None, 1, 1, "alpha beta gamma", 4), ("y.md", "markdown", "paragraph", None, 1, 1, "alpha " * 12, 4), ("z.md", "markdown", "paragraph", None, 1, 1, "nothing", 4)]
    df = spark.createDataFrame(rows, "path string, kind string, chunk_kind string, title string, start_line long, end_line long, text string, token_estimate long")
    got = rank.rank(df, "alpha beta").collect()
    assert [r.path for r in got] == ["x.md", "y.md"] and got[0].full_coverage_score == 18 and any("full query coverage" in x for x in got[0].reasons)
    assert rank.rank(df, "...").count() == 0
    assert [r.path for r in search.search(df, "beta gamma", search.SearchOptions(exact=True)).collect()] == ["x.md"]


def test_redaction_follows_source_lines(spark):
    doc = spark.createDataFrame([("t.csv", "csv", "name,key\n\na,API_KEY=abcdefgh12345\nb,none\n")], "path string, kind string, text string")
    cut, found = chunk.table_rows(doc), audit.audit(doc)
    assert pack.redact(cut, found).first().text == "name,key\n[REDACTED: API key]\nb,none"
    assert "API_KEY" in pack.redact(cut, found, strict_compat=True).first().text


def test_spans(spark):
    rows = [("a", 1, 1, "x", False), ("a", 3, 3, "y", True), ("a", 6, 7, "z", False), ("b", 1, 2, "w", False)]
    got = pack.spans(spark.createDataFrame(rows, "path string, start_line long, end_line long, text string, redacted boolean")).orderBy("path", "start_line").collect()
    assert [tuple(r) for r in got] == [("a", 1, 3, "x\n\ny", True), ("a", 6, 7, "z", False), ("b", 1, 2, "w", False)]


def test_scan_extract_index_and_pack(spark, tmp_path):
    source = tree.build(tmp_path / "s")
    options = config.ScanOptions()
    found = files.scan(spark, str(source), options)
    assert {r.path for r in found.files.collect()} == {"docs/a.md", "docs/b.html", ".env", "bad.pdf", "c.pdf", "cut.txt", "d.docx", "e.epub"}
    assert {(r.path, r.reason) for r in found.skipped.collect()} == {("docs/.hidden", "Ignored directory"), ("node_modules", "Ignored directory"), ("image.txt", "Binary")}
    corpus = files.load(spark, str(source), options)
    texts = {r.path: r.text for r in corpus.documents.collect()}
    assert texts["docs/b.html"] == "Engine\nfast & small storage" and texts["d.docx"] == "First & storage\nx y" and texts["e.epub"] == "first storage\n\nsecond" and texts["c.pdf"] == "Paged storage\nin a file)"
    assert [r.path for r in corpus.issues.collect()] == ["bad.pdf"]
    assert {(r.path, r.kind) for r in corpus.findings.collect()} == {("docs/a.md", "API key"), (".env", "Email address")}
    made = pack.pack(corpus.chunks, corpus.findings, corpus.issues, "storage engine", 400, redaction=True)
    bundle, manifest, report = made.bundle().first().value, made.manifest(), made.report()
    assert "[REDACTED: API key]" in bundle and "abcdefgh12345" not in bundle and "### docs/a.md" in bundle
    assert manifest["used_tokens"] <= 400 and manifest["redacted"] and manifest["privacy_kind_counts"] == {"API key": 1} and json.dumps(manifest)
    assert "- Selected privacy findings: 1" in report
    for goal, tokens, gate in ((" ", 400, None), ("storage", 0, None), ("storage", 3, None), ("zzz", 400, None), ("storage engine", 400, "High"), ("storage", 22, None)):
        with pytest.raises(pack.PackError):
            pack.pack(corpus.chunks, corpus.findings, corpus.issues, goal, tokens, gate=gate)

    held = index.Index(spark, str(tmp_path / "i"), options.fingerprint())
    assert held.status(found.files) == "missing"
    first = cli._refresh(held, found)
    assert first.created and first.written and first.indexed == 8 and held.files().where("issue is not null").count() == 1
    again = cli._refresh(held, files.scan(spark, str(source), options))
    assert not again.written and again.reused == 8
    (source / "docs/a.md").write_text("# Changed\n\nnew words")
    (source / ".env").unlink()
    changed = files.scan(spark, str(source), options)
    assert held.status(changed.files) == "stale"
    third = cli._refresh(held, changed)
    assert (third.reused, third.updated, third.removed, third.rebuilt) == (6, 1, 1, False) and held.status(changed.files) == "fresh"
    assert held.chunks().where("path = 'docs/a.md'").first().title == "Changed"
    assert index.Index(spark, str(tmp_path / "i"), "other").status(changed.files) == "incompatible"
    kept = index.Index(spark, str(tmp_path / "k"), grace=0)
    for _ in range(3):  # nothing is left of parts that no longer count
        assert cli._refresh(kept, changed, force=True).written
        assert len([p for p in (tmp_path / "k").iterdir() if p.name.startswith("part-")]) == 1
    (tmp_path / "i" / index.POINTER).write_text("{")
    assert held.status(changed.files) == "corrupt"
    (tmp_path / "i" / f".{index.POINTER}.crc").unlink(missing_ok=True)
    assert held.status(changed.files) == "corrupt" and cli._refresh(held, changed).rebuilt
    assert held.clear() and not held.clear() and held.status(changed.files) == "missing"


def test_scan_filters(tmp_path):
    source = tree.build(tmp_path)
    names = lambda **o: {p for p, _, _, reason in files.walk(str(source), config.ScanOptions(**o)) if reason is None}
    assert names(included=("docs",), excluded=("docs/b.html",)) == {"docs/a.md"}
    with pytest.raises(FileNotFoundError):
        names_of = files.walk(str(source / "none"), config.ScanOptions())
        next(names_of)


def test_config(tmp_path):
    path = config.write_default(str(tmp_path))
    assert config.load(str(tmp_path)) == config.ScanOptions()
    with pytest.raises(FileExistsError):
        config.write_default(str(tmp_path))
    path.write_text('[scanner]\nmax_file_bytes = 7\nignore_patterns = ["x", "out"]\ninclude_paths = ["a"]\nexclude_paths = ["a/b"]\n\n[output]\nreport = "r.md"\n')
    held = config.load(str(tmp_path))
    assert held.max_file_bytes == 7 and held.ignored == (*config.IGNORED, "x") and held.included == ("a",) and held.excluded == ("a/b",)
    assert config.output_names(str(tmp_path)) == config.OutputNames(report="r.md") and config.output_names(str(tmp_path / "none")) == config.OutputNames()
    path.write_text("[scanner]\nmax_bytes = 7\n[other]\n")
    with pytest.warns(UserWarning, match="unknown key"):
        assert config.load(str(tmp_path)) == config.ScanOptions()


def test_command_line(spark, tmp_path, capsys):
    source = tree.build(tmp_path / "s")
    (source / config.NAME).write_text('[scanner]\nexclude_paths = ["cut.txt"]\n[output]\nbundle = "b.md"\n')
    run = lambda *words: (cli.main([*words, "--source", str(source)]), capsys.readouterr())
    code, said = run("index", "build", "--verbose")
    assert code == 0 and "Files: 7" in said.out and "Warnings: 1" in said.out and "bad.pdf" in said.err
    code, said = run("index", "status")
    assert "Status: fresh" in said.out and "Warnings: 1" in said.out
    code, said = run("search", "storage", "--json", "--explain", "--limit", "2")
    held = json.loads(said.out)
    assert held["query"] == "storage" and held["shown_passages"] == 2 <= held["total_passages"] and held["index"]["reused_files"] == 7 and held["index"]["indexed_chunks"] > 0
    assert held["warning_count"] == 1 == len(held["warnings"]) and {"score", "kind", "reason"} <= set(held["groups"][0]["hits"][0]) and held["groups"][0]["file_type"] != "html"
    code, said = run("search", "zzz")
    assert code == 0 and said.out.startswith("0 passages in 0 files")
    code, said = run("audit", "--json")
    assert {"findings", "extraction_issues"} == set(json.loads(said.out)) and json.loads(said.out)["extraction_issues"][0]["path"] == "bad.pdf"
    code, said = run("pack", "storage engine", "--budget", "400", "--output", str(tmp_path / "o"), "--dry-run", "--explain")
    assert code == 0 and "Selected, the first 5:" in said.out and "score" in said.out and not (tmp_path / "o").exists()
    code, said = run("pack", "storage engine", "--budget", "400", "--output", str(tmp_path / "o"))
    assert code == 0 and {p.name for p in (tmp_path / "o").iterdir()} == {"b.md", *config.OUTPUTS[1:]}
    assert run("index", "clear")[1].out == "cleared\n" and run("pack", " ")[0] == 1


def test_streamed_findings(spark, tmp_path):
    from marlstone.streaming import ingest

    spark.createDataFrame([("a", "text", "x@y.zz\n+1 5550101234", 1, 1)], "path string, kind string, text string, size long, modified long").write.parquet(str(tmp_path / "in"))
    docs = spark.readStream.schema("path string, kind string, text string, size long, modified long").parquet(str(tmp_path / "in"))
    run = ingest.findings(docs).writeStream.format("memory").queryName("streamed").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert {r.kind for r in spark.table("streamed").collect()} == {"Email address", "Phone number"}
    held = index.Index(spark, str(tmp_path / "i"))
    for k in range(3):
        if k:
            rows = [("a", "text", f"new {k}", 1, k + 1), (f"b{k}", "text", "one\n\ntwo", 1, 1)]
            spark.createDataFrame(rows, docs.schema).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.keep_indexed(docs, held, str(tmp_path / "c")).awaitTermination(60)
    assert sorted((r.path, r.text) for r in held.chunks().collect()) == [("a", "new 2"), ("b1", "one"), ("b1", "two"), ("b2", "one"), ("b2", "two")]
    assert held.files().count() == 3 and len(held._pointer()["parts"]) == 3


def test_pdf_streams_that_cannot_be_read(tmp_path):
    import base64
    import zlib

    from marlstone.sources import extract

    def file(name, *streams):
        parts = [b"%d 0 obj << %s >>\nstream\n%s\nendstream endobj\n" % (k, head, body) for k, (head, body) in enumerate(streams, 1)]
        (tmp_path / name).write_bytes(b"%PDF-1.4\n" + b"".join(parts))
        return str(tmp_path / name)

    page, flate = zlib.compress(b"BT (One page) Tj ET"), b"/Filter /FlateDecode"
    image = (b"/Subtype /Image /Filter /DCTDecode", b"xyz")
    assert extract.pdf(file("a.pdf", (flate, page), image), 20) == ("One page", None)
    other = (b"/Filter [/ASCII85Decode /FlateDecode]", base64.a85encode(page) + b"~>")
    assert extract.pdf(file("b.pdf", (flate, page), other), 20) == ("One page", "1 streams of the PDF file could not be read")
    assert extract.pdf(file("c.pdf", (flate, page), (flate, page[:12])), 20)[1] == "1 streams of the PDF file could not be read"
    large = zlib.compress(b"BT (first) Tj ET" + b" " * (65 << 20) + b"BT (last) Tj ET")
    with pytest.raises(ValueError, match="too large"):
        extract.pdf(file("d.pdf", (flate, page), (flate, large)), 20)


def test_listed_rows_are_those_of_the_whole_text(spark):
    texts = {"a": ["1,x", "", "2,y", " ", *map(str, range(60)), ""], "b": [str(i) for i in range(50)], "c": ["", " "], "d": [], "e": ["", "7"]}
    whole = spark.createDataFrame([(p, "csv", "\n".join(["h,k", *rows, "end"][: len(rows) + 1])) for p, rows in texts.items()], "path string, kind string, text string")
    listed = spark.createDataFrame([(p, "csv", i, row) for p, rows in texts.items() for i, row in enumerate(rows)], "path string, kind string, at long, content string").orderBy(F.rand(1))
    want = sorted(map(str, chunk.table_rows(whole).where("path != 'd'").collect()))
    assert sorted(map(str, chunk.listed_rows(listed, "h,k").collect())) == want and len(want) == 3 + 2 + 1 + 1
    with pytest.raises(ValueError, match="header"):
        chunk.listed_rows(listed, " ")


def test_table_passages_carry_no_document(spark):
    """A row for each passage that holds all passages beside its own filled an executor's memory."""
    docs = spark.createDataFrame([("p", "csv", "h\n" + "\n".join(map(str, range(60))))], "path string, kind string, text string")
    plan = chunk.table_rows(docs)._jdf.queryExecution().executedPlan().toString()
    (carried,) = re.findall(r"\[path#\d+((?:, \w+#\d+)*)\], false, \[\w+#\d+\]", plan)
    assert "h#" not in carried
    assert [(r.start_line, r.end_line) for r in chunk.table_rows(docs).collect()] == [(2, 26), (27, 51), (52, 61)]


def test_orders_are_chunked_without_collecting_documents(spark):
    plan = registry.chunk_table_rows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "n#" in plan and plan.count("Exchange hashpartitioning(path") == 1


def test_tokens_with_and_without_wide_characters(spark):
    """A text goes the short way unless it has a wide character; a wide separator at its end sends it the long way."""
    rows = [(f"Ab{chr(c)}C {chr(c)} ΑΣ{chr(c)}Σ",) for c in range(0x2E80)]
    got = spark.createDataFrame(rows, "t string").select("t", T.is_wide(F.col("t")).alias("wide"), T.tokens(F.col("t")).alias("short"), T.tokens(F.concat("t", F.lit("。"))).alias("long"))
    assert got.where("wide or not (short <=> long)").count() == 0
    wide = spark.createDataFrame([(chr(c),) for c in (0x2E80, 0x2F00, 0x3000, 0x3400, 0x9FFF, 0xAC00, 0xF900, 0xFF01, 0xFFFD, 0x20000, 0x10FFFF)], "t string")
    assert wide.where(T.is_wide(F.col("t"))).count() == 11


def test_ranking_measures_no_texts_that_only_the_budget_needs(spark):
    assert not {"token_estimate", "end_line"} & set(registry.ranked(spark, "/root/testdata/sf0.001").columns)


def test_code_of_a_long_document(spark):
    """The leading blank lines are counted once, not for each line: that took minutes for a text of this length."""
    text = "\n \n\n" + "def f():\n  a\n" * 20_000
    began = time.time()
    got = chunk.code_items(spark.createDataFrame([("p", "code", text)], "path string, kind string, text string")).agg(F.count(F.lit(1)).alias("n"), F.min("start_line").alias("first"), F.max("end_line").alias("last")).first()
    assert tuple(got) == (20_000, 4, 40_003) and time.time() - began < 30
    none = spark.createDataFrame([("p", "code", t) for t in (None, "", "\n", " \n\n ", "\r\n")], "path string, kind string, text string")
    assert chunk.code_items(none).count() == 0


def test_statistics_of_labels_take_one_pass(spark):
    plan = registry.pack_statistics(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 2  # passages and findings
    got = pack.label_counts(spark.createDataFrame([("x", "y"), ("x", "x")], "a string, b string"), "a", "b").collect()
    assert sorted(map(tuple, got)) == [("x", 1), ("x", 2), ("y", 1)]


def test_findings_in_any_case(spark):
    """Lower case is taken letter by letter only where another letter would become an ASCII one."""
    kinds = lambda line: [f.kind for f in one(spark, audit.line_findings, line)]
    assert kinds("API_KEY=É23456789") == ["API key"] and kinds("API_KEY=123456789") == [] and kinds("POSTGRES://é") == ["Database URL"]
    assert kinds("Móbile MOBILE 555-1234567") == ["Phone number"] and kinds("x 23913912345678") == [] and kinds("x 13912345678.") == ["Phone number"]


def test_ends_of_lines(spark):
    """White space by its characters and ends by bytes, as the patterns told them."""
    rows = spark.createDataFrame([(f"{chr(c)}{mid}{end}{chr(c)}",) for c in [*range(0x3001), 0xFEFF] for mid, end in (("a b", "."), ("", ""))], "t string")
    pattern = F.regexp_replace("t", rf"\A{T.SPACE}+|{T.SPACE}+\z", "")
    assert rows.where(~T.trim(F.col("t")).eqNullSafe(pattern) | ~T.ends_sentence(F.col("t")).eqNullSafe(F.col("t").rlike(rf"[.。!！?？;；]{T.SPACE}*\z"))).count() == 0


def test_batch_of_queries_told_or_joined(spark, monkeypatch):
    rows = [(f"p{i}", 1, " ".join(["alpha"] * (i % 4) + ["beta"] * (i % 3) + ["gamma", "検索"][: i % 5] + ["x"] * i)) for i in range(40)] + [("none", 1, None), ("empty", 1, "")]
    passages = spark.createDataFrame(rows, "path string, start_line long, text string").repartition(3)
    goals = spark.createDataFrame([(7, "beta alpha beta"), (8, "gamma x 検索 alpha"), (9, "absent"), (10, ""), (11, None), (7, "gamma")], "goal long, said string")
    found = lambda: sorted(map(tuple, rank.rank_batch(passages, goals, "goal", "said").collect()))
    told = found()
    monkeypatch.setattr(rank, "TOLD_CELLS", 10)
    assert found() == told and {r[0] for r in told} == {7, 8}
    plan = rank.rank_batch(passages, goals, "goal", "said")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    monkeypatch.setattr(rank, "TOLD_TERMS", 0)
    joined = found()
    assert [r[:3] for r in joined] == [r[:3] for r in told] and all(a[3] == pytest.approx(b[3], rel=1e-14) for a, b in zip(joined, told, strict=True))
    once = spark.createDataFrame([(8, "gamma x 検索 alpha")], "goal long, said string")
    monkeypatch.setattr(rank, "TOLD_TERMS", 100)
    exact = sorted(map(tuple, rank.rank_batch(passages, once, "goal", "said").collect()))
    monkeypatch.setattr(rank, "TOLD_TERMS", 0)
    assert exact == sorted(map(tuple, rank.rank_batch(passages, once, "goal", "said").collect()))
    monkeypatch.setattr(rank, "TOLD_TERMS", 100)
    assert rank.rank_batch(passages, goals.where("goal > 9"), "goal", "said").count() == 0


def test_texts_without_the_word_are_not_cut(spark):
    """The word is asked of the texts first; that leaves out no passage that has it, in any form."""
    rows = ["Oren a.\r\n\r\nb", "\uff2fREN \u03a3\u03a3\n\n\u3000x oRen\u3000", "or\nen", "\u0130oren\x85", "a\n" * 50, "", None, "oren", "x\n\noren"]
    docs = spark.createDataFrame([(str(i % 8), "pdf", t) for i, t in enumerate(rows)], "path string, kind string, text string")
    got = registry._mentions(docs, "oren", chunk.extracted, chunk.paragraphs)
    every = chunk.extracted(docs).unionByName(chunk.paragraphs(docs)).where(T.search_form(F.col("text")).contains("oren"))
    assert got.count() == every.count() == 11 and got.exceptAll(every).count() == 0
    texts = spark.createDataFrame([(f"{a}{chr(c)}{b}",) for c in [*range(0x3100), *range(0xFF00, 0xFFF0), 0x20000, 0x1F600] for a, b in (("", "ren"), ("O", "en"), ("ore", ""), ("\u03a3", " oren"))], "t string")
    assert texts.where(T.holds(F.col("t"), "oren") != T.search_form(F.col("t")).contains("oren")).count() == 0
    assert texts.where(T.holds(F.col("t"), "oren")).count() > 0x3100


def test_texts_are_cut_once(spark):
    """A column of pieces had the planner ask for its size and for null where texts are read, so that each text was cut three times."""
    for name, cuts in (("span_merge", 2), ("selected_findings", 1), ("chunk_code", 1), ("chunk_paragraphs", 1)):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Generate posexplode(transform(") == cuts and "size(transform(array(" not in plan
    plan = registry.span_merge(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("oren") >= 4  # the texts of both chunkers are asked, then the passages


def test_shuffle_files_behind_a_checkpoint_go(spark):
    """They stayed until the driver's collector found them, beside those of the stages that follow."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: set(re.findall(r"shuffle_\w+", blocks.getAllFiles().mkString("\n")))
    before = held()
    for files in (2, None):
        rows = session.cut_lineage(spark.range(20_000).groupBy((F.col("id") % 997).alias("k")).agg(F.collect_set("id").alias("ids")), files)
        for _ in range(50):
            if not held() - before:
                break
            time.sleep(0.1)
        assert not held() - before
        assert rows.count() == 997 and rows.select(F.sum(F.size("ids"))).first()[0] == 20_000
        before = held()
    assert spark.conf.get(session.CLEANUP_OPTION, None) is None
    spark.conf.set(session.CLEANUP_OPTION, "false")
    session.cut_lineage(spark.range(3))
    assert spark.conf.get(session.CLEANUP_OPTION) == "false"
    spark.conf.unset(session.CLEANUP_OPTION)
