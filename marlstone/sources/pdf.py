"""Text of simple PDF files: objects are found by their marks, streams inflated, text operators read in order."""

from __future__ import annotations

import re
import sys
import zlib
from pathlib import Path

TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|[-+]?\d*\.?\d+|[A-Za-z'\"*]+|/[^\s/<>\[\]()]+", re.S)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


#: Bytes that a stream may expand to.
MOST = 64 << 20
#: Marks of streams that hold no page text: images, fonts, cross references, object streams, metadata, color profiles, functions.
NO_TEXT = re.compile(rb"/Subtype\s*/Image|/Length1\b|/Subtype\s*/(?:Type1C|CIDFontType0C|OpenType)\b|/Type\s*/(?:XRef|ObjStm|Metadata)\b|/Alternate\b|/FunctionType\b")


def streams(data: bytes) -> tuple[list[bytes], int]:
    """Streams that could be read, and how many that may hold text could not."""
    found, skipped = [], 0
    for m in re.finditer(rb"obj\b(.*?)\bstream\r?\n(.*?)\r?\n?endstream", data, re.S):
        head, body = m.groups()
        text = not NO_TEXT.search(head)
        if b"/Filter" in head:
            if not re.search(rb"/Filter\s*(?:\[\s*)?/FlateDecode\s*(?:\]|/(?!\w+Decode)|>>)", head):
                skipped += text
                continue
            held = zlib.decompressobj()
            try:
                body = held.decompress(data[m.start(2) : m.end() - len(b"endstream")], MOST)
            except zlib.error:
                skipped += text
                continue
            if held.unconsumed_tail or not held.eof and len(body) >= MOST:
                if text:
                    sys.exit("expanded text is too large")
                continue
            if not held.eof:
                skipped += text
        found.append(body)
    return found, skipped


def literal(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: b"" if m[1].strip() == b"" else bytes([int(m[1], 8) & 255]) if m[1].isdigit() else ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)
    if raw[:2] == b"\xfe\xff":
        return raw[2:].decode("utf-16-be", "replace")
    return raw.decode("cp1252", "replace")


def page_text(content: bytes) -> str:
    out: list[str] = []
    operands: list[bytes] = []
    for m in re.finditer(rb"\bBT\b(.*?)\bET\b", content, re.S):
        for token in TOKEN.findall(m[1]):
            if token[:1] in b"(<[]/" or re.fullmatch(rb"[-+]?\d*\.?\d+", token):
                operands.append(token)
                continue
            held = [t for t in operands if t[:1] in b"(<"]
            if token in (b"Td", b"TD", b"T*", b"Tm", b"'", b'"') and out and not out[-1].endswith("\n"):
                out.append("\n")
            if token == b"TJ":
                for t in operands:
                    if t[:1] in b"(<":
                        out.append(literal(t))
                    elif t[:1] not in b"[]/" and float(t) < -200:
                        out.append(" ")
            elif token in (b"Tj", b"'", b'"'):
                out += [literal(t) for t in held]
            operands = []
        out.append("\n")
    return "".join(out)


def main(path: str) -> None:
    data = Path(path).read_bytes()
    if not data.startswith(b"%PDF-"):
        sys.exit("not a PDF file")
    if b"/Encrypt" in data:
        sys.exit("the PDF file is encrypted")
    found, skipped = streams(data)
    text = "\n".join(t for t in map(page_text, found) if t.strip())
    if not text:
        sys.exit("no text was found in the PDF file")
    if skipped:
        sys.stderr.write(f"{skipped} streams of the PDF file could not be read")
    sys.stdout.buffer.write(text.encode("utf-8", "replace"))


if __name__ == "__main__":
    main(sys.argv[1])
