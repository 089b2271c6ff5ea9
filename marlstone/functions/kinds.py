"""Kinds of files and their labels, groups and bonuses, as Column functions of a path."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of each kind.
EXTENSIONS = {
    "markdown": "md markdown",
    "rust": "rs",
    "text": "txt text log out err env ini cfg conf properties",
    "toml": "toml",
    "json": "json",
    "yaml": "yaml yml",
    "csv": "csv",
    "tsv": "tsv",
    "xml": "xml xsd svg",
    "html": "html htm",
    "code": "py js jsx ts tsx java c h cc cpp cxx hpp cs go rb php swift kt kts scala sh bash zsh ps1 sql lua r m mm dart ex exs clj cljs fs fsx vb gradle",
    "pdf": "pdf",
    "docx": "docx",
    "epub": "epub",
}
# File names with a kind of their own.
TEXT_NAMES = ".env .env.local .env.sample .env.example .gitignore .dockerignore .npmrc .editorconfig requirements.txt yarn.lock pnpm-lock.yaml"
CODE_NAMES = "Dockerfile Makefile Justfile Rakefile Gemfile Jenkinsfile"
# Points that a file's extension and a passage's kind add to its score.
EXTENSION_BONUS = {"rs": 5} | dict.fromkeys("md markdown".split(), 4) | dict.fromkeys(EXTENSIONS["code"].split(), 4) | dict.fromkeys("toml json yaml yml xml html htm csv tsv pdf docx".split(), 2) | dict.fromkeys("txt text log ini cfg conf properties".split(), 1)
CHUNK_BONUS = {"markdown section": 3, "rust item": 4, "code item": 4, "table rows": 2, "paragraph": 0}
LABELS = {
    "markdown": "Markdown", "rust": "Rust", "code": "Code", "text": "Text", "toml": "TOML", "json": "JSON", "yaml": "YAML", "csv": "CSV",
    "tsv": "TSV", "xml": "XML", "html": "HTML", "pdf": "PDF", "docx": "DOCX", "epub": "EPUB", "other": "Other",
}
#: Groups of kinds that a search may be narrowed to.
GROUPS = {"pdf": ["pdf"], "docx": ["docx"], "epub": ["epub"], "markdown": ["markdown"], "text": ["text"], "code": ["rust", "code"], "data": ["csv", "tsv"], "markup": ["xml", "html"], "config": ["toml", "json", "yaml"]}
PACKAGED = ("pdf", "docx", "epub")


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain(*table.items())]), key)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """What follows the last dot of a file name, in small letters; null for none, or if the dot leads."""
    found = F.regexp_extract(file_name(path), r"\A.+\.([^.]*)\z", 1)
    return F.when(file_name(path).rlike(r"\A.+\.[^.]*\z"), F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def kind_of(path: Column) -> Column:
    name = file_name(path)
    by_extension = {e: kind for kind, found in EXTENSIONS.items() for e in found.split()}
    return (
        F.when(F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").isin(TEXT_NAMES.split()), "text")
        .when(name == "Cargo.lock", "toml")
        .when(name.isin(CODE_NAMES.split()), "code")
        .otherwise(F.coalesce(_lookup(by_extension, F.coalesce(extension(path), F.lit(""))), F.lit("other")))
    )


def label(kind: Column) -> Column:
    return _lookup(LABELS, kind)


def extension_bonus(path: Column) -> Column:
    return F.coalesce(_lookup(EXTENSION_BONUS, F.coalesce(extension(path), F.lit(""))), F.lit(0)).cast("long")


def chunk_bonus(kind: Column) -> Column:
    return F.coalesce(_lookup(CHUNK_BONUS, kind), F.lit(0)).cast("long")
