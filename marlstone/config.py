"""Options of scans and their TOML file."""

from __future__ import annotations

import json
import tomllib
import warnings
from dataclasses import asdict, dataclass, replace
from pathlib import Path

NAME = "marlstone.toml"
# Folders left out by default, and the names of the three documents that packing writes.
IGNORED = (".git", "target", "node_modules", "dist", "build", "out", "demo-output", "venv")
OUTPUTS = ("context-bundle.md", "context-manifest.json", "context-report.md")


@dataclass(frozen=True)
class ScanOptions:
    max_file_bytes: int = 8 << 20
    max_document_bytes: int = 64 << 20
    pdf_timeout_seconds: int = 5
    ignored: tuple[str, ...] = IGNORED
    included: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()

    def fingerprint(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    def extended(self, ignored=(), included=(), excluded=()) -> ScanOptions:
        return replace(self, ignored=(*self.ignored, *ignored), included=(*self.included, *included), excluded=(*self.excluded, *excluded))

    def for_packing(self, source: str, output: str) -> ScanOptions:
        """Leave out the folder that packing writes to, if it lies in the source."""
        inside, top = Path(output).resolve(), Path(source).resolve()
        return self.extended(ignored=[inside.name]) if top in inside.parents else self


@dataclass(frozen=True)
class OutputNames:
    bundle: str = OUTPUTS[0]
    manifest: str = OUTPUTS[1]
    report: str = OUTPUTS[2]


def _read(source: str, explicit: str | None) -> dict:
    """The file named, else the source folder's, else the working folder's, else nothing."""
    if explicit and not Path(explicit).is_file():
        raise FileNotFoundError(explicit)
    places = [Path(explicit)] if explicit else [Path(source) / NAME, Path(NAME)]
    found = next((p for p in places if p.is_file()), None)
    return tomllib.loads(found.read_text("utf-8")) if found else {}


LIMITS = ("max_file_bytes", "max_document_bytes", "pdf_timeout_seconds")
SCANNER = (*LIMITS, "ignore_patterns", "include_paths", "exclude_paths")


def unknown_keys(held: dict) -> list[str]:
    """Keys of a configuration that mean nothing here, by table."""
    known = {"scanner": SCANNER, "output": ("bundle", "manifest", "report")}
    out = [k for k in held if k not in known]
    return out + [f"{t}.{k}" for t, keys in known.items() if isinstance(held.get(t), dict) for k in held[t] if k not in keys]


def load(source: str, explicit: str | None = None) -> ScanOptions:
    """The table [scanner] of the configuration: `ignore_patterns` add to the default folders, `include_paths` and `exclude_paths` replace."""
    held = _read(source, explicit)
    for key in unknown_keys(held):
        warnings.warn(f"{NAME}: unknown key {key}", stacklevel=2)
    scanner = held.get("scanner", {})
    plain = {k: scanner[k] for k in LIMITS if k in scanner}
    more = [p for p in scanner.get("ignore_patterns", ()) if p not in IGNORED]
    return ScanOptions(**plain, included=tuple(scanner.get("include_paths", ())), excluded=tuple(scanner.get("exclude_paths", ()))).extended(ignored=dict.fromkeys(more))


def output_names(source: str, explicit: str | None = None) -> OutputNames:
    """The table [output] of the configuration."""
    held = _read(source, explicit).get("output", {})
    return OutputNames(**{k: held[k] for k in ("bundle", "manifest", "report") if k in held})


def write_default(folder: str) -> Path:
    """A configuration that states every default; one that is there stays, as an error."""
    path, options, names = Path(folder) / NAME, ScanOptions(), OutputNames()
    tables = {
        "scanner": {k: getattr(options, k) for k in LIMITS} | {"ignore_patterns": list(IGNORED), "include_paths": [], "exclude_paths": []},
        "output": asdict(names),
    }
    with path.open("x", encoding="utf-8") as out:
        out.write("\n".join(f"[{t}]\n" + "".join(f"{k} = {json.dumps(v)}\n" for k, v in held.items()) for t, held in tables.items()))
    return path
