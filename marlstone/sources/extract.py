"""Bytes of one file to text: plain UTF-8, DOCX, EPUB and PDF."""

from __future__ import annotations

import posixpath
import re
import subprocess
import sys
import unicodedata
import zipfile
from pathlib import Path
from urllib.parse import unquote
from xml.parsers import expat

from marlstone.functions.text import BLOCK_TAGS, ENTITIES, WIDTH_FROM, WIDTH_TO

#: Text that a package may expand to.
MOST_EXPANDED = 128 << 20
FOLD = str.maketrans(WIDTH_FROM, WIDTH_TO)


def read(path: str, kind: str, pdf_seconds: int) -> tuple[str, str | None]:
    """The text, and what could not be read of it."""
    if kind == "docx":
        return docx(path), None
    if kind == "epub":
        return epub(path), None
    if kind == "pdf":
        return pdf(path, pdf_seconds)
    return Path(path).read_bytes().decode("utf-8"), None


def tidy(text: str) -> str:
    """The document form of functions.text, for one string."""
    text = re.sub("\r\n?", "\n", text).translate(FOLD)
    text = "".join(" " if unicodedata.category(c) == "Cc" and c != "\n" else c for c in text)
    kept: list[str] = []
    for line in (" ".join(x.split()) for x in text.split("\n")):
        if line or (kept and kept[-1]):
            kept.append(line)
    return "\n".join(kept).strip()


def markup(html: str) -> str:
    """The text of markup by reading it from the left; the twin of functions.text.markup_text.

    Inside a skipped element a bare < hides what follows up to the next >, as for any tag.
    """
    out: list[str] = []
    skipping, at = "", 0
    blocks = set(BLOCK_TAGS.split())
    while at < len(html):
        opened = html.find("<", at)
        opened = len(html) if opened < 0 else opened
        if not skipping and opened > at:
            out.append(html[at:opened])
        if opened == len(html):
            break
        closed = html.find(">", opened)
        closed = len(html) if closed < 0 else closed
        tag = html[opened + 1 : closed].strip().lower()
        name = re.match(r"/*([^\s/>]*)", tag)[1]
        at = closed + 1
        if skipping:
            if tag.startswith("/") and name == skipping:
                skipping = ""
                _end_with(out, "\n")
        elif name in ("script", "style") and not tag.startswith("/"):
            skipping = name
        elif name in blocks or tag.startswith("/"):
            _end_with(out, "\n")
        else:
            _end_with(out, " ")
    text = "".join(out)
    for entity, char in ENTITIES:
        text = text.replace(entity, char)
    return tidy(text)


def _end_with(out: list[str], char: str) -> None:
    last = out[-1][-1] if out else ""
    if not (last == "\n" if char == "\n" else last.isspace()):
        out.append(char)


def _member(package: zipfile.ZipFile, name: str, left: int) -> bytes:
    with package.open(name) as held:
        data = held.read(left + 1)
    if len(data) > left:
        raise ValueError("expanded text is too large")
    return data


def _local(name: str) -> str:
    return name.rpartition(":")[2]


def docx(path: str) -> str:
    with zipfile.ZipFile(path) as package:
        data = _member(package, "word/document.xml", MOST_EXPANDED)
    out: list[str] = []
    run: list[str] | None = None

    def start(name: str, _: dict) -> None:
        nonlocal run
        if name == "w:t":
            run = []
        elif name in ("w:tab", "w:br"):
            out.append("\t" if name == "w:tab" else "\n")

    def end(name: str) -> None:
        nonlocal run
        if name == "w:t" and run is not None:
            out.append("".join(run).strip())
            run = None
        elif name == "w:p" and out and not out[-1].endswith("\n"):
            out.append("\n")

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda text: run.append(text) if run is not None else None
    parser.Parse(data, True)
    return tidy("".join(out))


def _elements(data: bytes) -> list[tuple[str, dict]]:
    found: list[tuple[str, dict]] = []
    parser = expat.ParserCreate()
    parser.StartElementHandler = lambda name, attributes: found.append((_local(name), {_local(k): v for k, v in attributes.items()}))
    parser.Parse(data, True)
    return found


def member_path(base: str, href: str) -> str:
    """A reference in a package, relative to `base`, as a member's name; it may not leave the package."""
    bare = unquote(re.split("[#?]", href)[0])
    full = posixpath.normpath(posixpath.join(base, bare.lstrip("/") if bare.startswith("/") and not base else bare))
    if full.startswith("..") or full.startswith("/"):
        raise ValueError("a path leaves the package")
    return full


def epub(path: str) -> str:
    with zipfile.ZipFile(path) as package:
        left = MOST_EXPANDED

        def take(name: str) -> bytes:
            nonlocal left
            data = _member(package, name, left)
            left -= len(data)
            return data

        roots = [a["full-path"] for name, a in _elements(take("META-INF/container.xml")) if name == "rootfile" and a.get("full-path")]
        if not roots:
            raise ValueError("the package names no content")
        opf = member_path("", roots[0])
        elements = _elements(take(opf))
        items = {a["id"]: a for name, a in elements if name == "item" and a.get("id") and a.get("href")}
        pages = {i: a["href"] for i, a in items.items() if a.get("media-type") in ("application/xhtml+xml", "text/html") and "nav" not in a.get("properties", "").split()}
        spine = [pages[a["idref"]] for name, a in elements if name == "itemref" and a.get("idref") in pages]
        chapters = dict.fromkeys(member_path(posixpath.dirname(opf), h) for h in (spine or sorted(pages.values())))
        texts = [markup(take(c).decode("utf-8")) for c in chapters]
    text = tidy("\n\n".join(t for t in texts if t))
    if not text:
        raise ValueError("the package holds no text")
    return text


def pdf(path: str, seconds: int) -> tuple[str, str | None]:
    """In a process of its own, which ends with the time limit."""
    try:
        done = subprocess.run([sys.executable, "-m", "marlstone.sources.pdf", path], capture_output=True, timeout=seconds, check=False, cwd=str(Path(__file__).resolve().parents[2]))
    except subprocess.TimeoutExpired:
        raise TimeoutError(f"PDF extraction took more than {seconds} s") from None
    if done.returncode:
        raise ValueError(done.stderr.decode("utf-8", "replace").strip().splitlines()[-1] if done.stderr.strip() else "PDF extraction failed")
    said = done.stderr.decode("utf-8", "replace").strip()
    return tidy(done.stdout.decode("utf-8")), said.splitlines()[-1] if said else None
