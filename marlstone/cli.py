"""Command line: scan, search, audit, pack, index and init over a directory."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from marlstone import config
from marlstone.operators import audit, index, pack, rank, search
from marlstone.operators.rank import Profile
from marlstone.session import cut_lineage
from marlstone.sources import files

FOLDER = ".marlstone"
#: Passages that a dry run shows of what is selected, and of what is not.
PREVIEWS = 5


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="marlstone", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *positional: str) -> argparse.ArgumentParser:
        found = commands.add_parser(name)
        for p in positional:
            found.add_argument(p)
        found.add_argument("--source", default=".")
        found.add_argument("--config")
        for option in ("--ignore", "--include", "--exclude"):
            found.add_argument(option, action="append", default=[])
        return found

    command("scan")
    command("init")
    kept = command("index", "action")
    kept.add_argument("--force", action="store_true")
    kept.add_argument("--verbose", action="store_true")
    find = command("search", "query")
    find.add_argument("--limit", type=int, default=10)
    find.add_argument("--per-file", type=int, default=2)
    find.add_argument("--exact", action="store_true")
    find.add_argument("--type", action="append", default=[], choices=sorted(search.kinds.GROUPS))
    find.add_argument("--json", action="store_true")
    find.add_argument("--explain", action="store_true")
    look = command("audit")
    look.add_argument("--limit", type=int, default=50)
    look.add_argument("--json", action="store_true")
    put = command("pack", "goal")
    put.add_argument("--budget", type=int, default=6000)
    put.add_argument("--output", default="context-output")
    put.add_argument("--redact", action="store_true")
    put.add_argument("--fail-on", choices=["Low", "Medium", "High"])
    put.add_argument("--dry-run", action="store_true")
    put.add_argument("--explain", action="store_true")
    return top


def _plural(n: int, word: str) -> str:
    return f"{n} {word}" if n == 1 else f"{n} {word}s"


def _warn(issues: DataFrame) -> None:
    for r in issues.orderBy("path").toLocalIterator():
        print(f"warning: {r.path}: {r.message}", file=sys.stderr)


def _print_json(head: dict, lists: dict[str, DataFrame]) -> None:
    """One JSON object; its lists are written row by row as they come, however long they are."""
    print("{")
    for k, v in head.items():
        print(f"  {json.dumps(k)}: {json.dumps(v, ensure_ascii=False)},")
    for n, (name, rows) in enumerate(lists.items()):
        print(f"  {json.dumps(name)}: [", end="")
        for k, r in enumerate(rows.toLocalIterator()):
            text = r.json if rows.columns == ["json"] else json.dumps(r.asDict(True), ensure_ascii=False)
            print(("," if k else "") + "\n    " + text, end="")
        print("\n  ]" + ("," if n < len(lists) - 1 else ""))
    print("}")


def _index(spark: SparkSession, source: str, options: config.ScanOptions) -> index.Index:
    return index.Index(spark, (Path(source).resolve() / FOLDER).as_uri(), options.fingerprint())


def _refresh(held: index.Index, scan: files.Scan, force: bool = False) -> index.Refresh:
    def extract(listing):
        docs, issues = files.documents(listing, scan.source, scan.options)
        return files.chunk.split(docs), issues

    return held.refresh(scan.files, extract, force)


def main(arguments: list[str] | None = None) -> int:
    args = _parser().parse_args(arguments)
    if args.command == "init":
        print(config.write_default(args.source))
        return 0
    spark = SparkSession.builder.appName("marlstone").getOrCreate()
    options = config.load(args.source, args.config)
    scoped = options if args.command == "search" else options.extended(args.ignore, args.include, args.exclude)
    if args.command == "scan":
        found = files.scan(spark, args.source, scoped)
        for title, counts, column in (("Scanned", found.kind_counts(), "kind"), ("Skipped", found.skip_counts(), "reason")):
            rows = counts.orderBy(column).collect()
            print(f"{title}: {sum(r.n for r in rows)}")
            for r in rows:
                print(f"  {r[0]}: {r.n}")
    elif args.command == "index":
        held = _index(spark, args.source, scoped)
        if args.action == "clear":
            print("cleared" if held.clear() else "there was no index")
        elif args.action == "status":
            _print_status(held, files.scan(spark, args.source, scoped).files, args.verbose)
        else:
            done = _refresh(held, files.scan(spark, args.source, scoped), args.force)
            issues = held.issues()
            print(f"Files: {done.indexed} ({done.updated} read, {done.reused} as before, {done.removed} gone)\nPassages: {done.chunks}\nWarnings: {issues.count()}")
            if args.verbose:
                _warn(issues)
    elif args.command == "search":
        held = _index(spark, args.source, options)
        done = _refresh(held, files.scan(spark, args.source, options))
        _print_hits(args, held, done)
    elif args.command == "audit":
        corpus = files.load(spark, args.source, scoped)
        found = audit.ordered(corpus.findings)
        if args.json:
            _print_json({}, {"findings": found, "extraction_issues": corpus.issues.orderBy("path")})
        else:
            total = corpus.findings.count()
            print(_plural(total, "finding"))
            for r in (found.limit(args.limit) if args.limit else found).toLocalIterator():
                print(f"{r.path}:{r.line}  {r.severity}  {r.kind}  {r.evidence}")
            if args.limit and args.limit < total:
                print(f"the first {args.limit} of {total}")
        _warn(corpus.issues)
    else:
        return _pack(spark, args, scoped)
    return 0


def _print_status(held: index.Index, listing: DataFrame, verbose: bool) -> None:
    state = held.status(listing)
    print(f"Status: {state}\nVersion: {index.VERSION}")
    if state in ("fresh", "stale"):
        issues = held.issues()
        print(f"Files: {held.files().count()}\nPassages: {held.chunks().count()}\nWarnings: {issues.count()}")
        if verbose:
            _warn(issues)


def _print_hits(args: argparse.Namespace, held: index.Index, done: index.Refresh) -> None:
    wanted = search.SearchOptions(args.exact, tuple(args.type), tuple(args.include), tuple(args.exclude))
    hits = search.search(held.chunks(), args.query, wanted, Profile())
    total, shown = search.totals(hits).first(), cut_lineage(search.grouped(hits, args.limit, args.per_file))
    part, issues = search.totals(shown).first(), held.issues()
    if args.json:
        head = {
            "query": args.query, "total_passages": total.passages, "total_files": total.files, "shown_passages": part.passages, "shown_files": part.files,
            "index": {
                "created": done.created, "rebuilt": done.rebuilt, "reused_files": done.reused, "updated_files": done.updated, "removed_files": done.removed,
                "indexed_files": done.indexed, "indexed_chunks": done.chunks,
            },
            "warning_count": issues.count(),
        }
        _print_json(head, ({"warnings": issues.orderBy("path")} if args.explain else {}) | {"groups": search.as_json(shown, args.explain)})
        return
    print(f"{_plural(total.passages, 'passage')} in {_plural(total.files, 'file')}, {part.passages} shown")
    for r in shown.orderBy(*rank.order()).toLocalIterator():
        print(f"{r.path}:{r.start_line}-{r.end_line}  {r.title or ''}\n  {r.preview}" + (f"\n  score {r.score}, {r.chunk_kind}: {'; '.join(r.reasons)}" if args.explain else ""))
    _warn(issues)


def _pack(spark: SparkSession, args: argparse.Namespace, options: config.ScanOptions) -> int:
    corpus = files.load(spark, args.source, options.for_packing(args.source, args.output))
    try:
        made = pack.pack(corpus.chunks, corpus.findings, corpus.issues, args.goal, args.budget, args.redact, args.fail_on)
    except pack.PackError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    out, names = Path(args.output), config.output_names(args.source, args.config)
    paths = [out / names.bundle, out / names.manifest, out / names.report]
    if not args.dry_run:
        out.mkdir(parents=True, exist_ok=True)
        for path, text in zip(paths, (made.bundle().first().value, json.dumps(made.manifest(), ensure_ascii=False, indent=2), made.report()), strict=True):
            path.write_text(text, "utf-8")
    for path in paths:
        print(f"{'would write' if args.dry_run else 'wrote'} {path}")
    print(f"Passages: {made.selected.count()} selected, {made.excluded.count()} excluded of {made.candidates}")
    print(f"Tokens: {made.used} of {args.budget}, {made.budget_tokens - made.used} left, {made.policy.per_file} a file at most")
    print(f"Findings: {made.chosen_findings.count()} in what is selected, {made.findings.count()} in all; redaction {'on' if args.redact else 'off'}")
    if args.dry_run:
        for title, rows, order in (("Selected", made.selected, ["position"]), ("Excluded", made.excluded, ["phase", *rank.order()])):
            print(f"{title}, the first {PREVIEWS}:")
            for r in rows.orderBy(*order).limit(PREVIEWS).collect():
                print(f"  {r.path}:{r.start_line}-{r.end_line}" + (f"  score {r.score}, {r.token_estimate} tokens" if args.explain else "") + f"\n    {r.preview}")
                if args.explain:
                    print(f"    {'; '.join(r.reasons) if 'reasons' in rows.columns else r.reason}")
    _warn(corpus.issues)
    return 0


if __name__ == "__main__":
    sys.exit(main())
