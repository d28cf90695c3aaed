"""Files as rows: kinds, roles, bundles, archives, and texts or the reason why there is none."""

from __future__ import annotations

import io
import re
import stat
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path, PurePosixPath
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.functions.html import html_to_markdown
from lodeweave.functions.text import InputError, TextError, decode_text, looks_like_text

# Limits of walks, bundles and archives, and names.
DIR_DEPTH, DIR_MEMBERS = 8, 1000
BUNDLE_FILES, BUNDLE_BYTES, BUNDLE_DEPTH = 2000, 256 << 20, 16
SKIPPED_DIRS = ("node_modules", "__pycache__", "dist", "build", "target", "venv")
SIGNATURES = {b"%PDF": "pdf", b"PK\x03\x04": "zip", b"\x89PNG": "png", b"\xff\xd8\xff": "jpeg", b"\xd0\xcf\x11\xe0": "office"}
MIME = {
    "css": "text/css", "csv": "text/csv", "gif": "image/gif", "htm": "text/html", "html": "text/html", "jpg": "image/jpeg",
    "js": "text/javascript", "json": "application/json", "md": "text/markdown", "pdf": "application/pdf", "png": "image/png",
    "py": "text/x-python", "sh": "text/x-sh", "svg": "image/svg+xml", "ts": "text/typescript", "txt": "text/plain",
    "xml": "application/xml", "yaml": "application/yaml", "yml": "application/yaml", "zip": "application/zip",
}
SCRIPTS = ("bash", "js", "mjs", "py", "rb", "sh", "ts")


class NeedsOcr(ValueError):
    """Pages that have no text."""

    def __init__(self, pages: list[int], page_count: int) -> None:
        super().__init__(f"{len(pages)} of {page_count} pages have no text")
        self.pages, self.page_count = pages, page_count


class Normalizer(Protocol):
    """Markdown of a file's bytes; raises NeedsOcr, or TextError for what it can't read."""

    def __call__(self, data: bytes, filename: str) -> str: ...


def extension(path: str) -> str:
    return PurePosixPath(path).suffix.lstrip(".").lower()


def strip_extension(name: str) -> str:
    return re.sub(r"\.[^./]+$", "", name)


def mime_of(path: str) -> str:
    return MIME.get(extension(path), "application/octet-stream")


def detect(path: str, head: bytes) -> str:
    """skill, archive, html, text, or a format's name; signatures come before extensions."""
    name, ext = PurePosixPath(path).name, extension(path)
    if name == "SKILL.md":
        return "skill"
    found = next((kind for mark, kind in SIGNATURES.items() if head.startswith(mark)), None)
    if found == "zip" and ext in ("zip", "skill"):
        return "archive"
    if found:
        return ext if found in ("zip", "office") else found
    if ext in ("html", "htm"):
        return "html"
    return "text" if mime_of(path).startswith("text/") or ext in ("json", "yaml", "yml", "xml") or looks_like_text(head) else ext or "binary"


def role_of(path: str) -> str:
    """A bundle member's role, by its folder, then its extension."""
    top = path.split("/")[0] if "/" in path else ""
    if path == "SKILL.md":
        return "skill_md"
    if top == "scripts" or extension(path) in SCRIPTS:
        return "script"
    if top == "assets":
        return "asset"
    return "reference" if extension(path) in ("md", "txt") or top in ("reference", "references") else "asset"


def plain_normalizer(data: bytes, filename: str) -> str:
    """Text, Markdown, CSV and HTML; anything else is a TextError."""
    kind = detect(filename, data[:4096])
    if kind not in ("text", "html", "skill"):
        raise TextError(f"no reader for {kind}")
    text = decode_text(data)
    text = html_to_markdown(text) if kind == "html" else text.replace("\r\n", "\n")
    if not text.strip():
        raise TextError("no text")
    return text


@dataclass(frozen=True)
class Found:
    """kind: skill (a folder with a SKILL.md), archive, doc or failed.  name: relative to the folder that was asked for."""

    kind: str
    path: Path
    name: str
    detail: str = ""


def walk(path: Path, name: str | None = None, depth: int = 0) -> Iterator[Found]:
    """What a path holds, folders in order of name: bundles whole, archives, documents.  Links, hidden entries and build folders are left out.

    A folder that is too deep or too full is a failure of its own; its siblings go on.
    """
    name = path.name if name is None else name
    if path.is_symlink() or not (path.is_dir() or path.is_file()):
        yield Found("failed", path, name, "not a regular file or folder")
    elif path.is_file():
        yield Found("archive" if path.suffix.lower() in (".zip", ".skill") else "doc", path, name)
    elif (path / "SKILL.md").is_file():
        yield Found("skill", path, name)
    elif depth >= DIR_DEPTH:
        yield Found("failed", path, name, f"folders nest deeper than {DIR_DEPTH} levels: name a folder further down")
    else:
        members = sorted(p for p in path.iterdir() if not p.name.startswith(".") and p.name not in SKIPPED_DIRS and not p.is_symlink() and (p.is_dir() or p.is_file()))
        if len(members) > DIR_MEMBERS:
            yield Found("failed", path, name, f"{len(members)} entries are over the {DIR_MEMBERS} of one folder: name a folder further down")
            return
        for member in members:
            yield from walk(member, f"{name}/{member.name}" if depth else member.name, depth + 1)


def literal_path(path: str) -> str:
    """A path in which nothing is a pattern."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def read_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length, content) of a tree's files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    hidden = F.col("path").rlike(r"/(?:\.[^/]*|" + "|".join(SKIPPED_DIRS) + ")(?:/|$)")
    return files.where(~hidden).select("path", "length", "content")


def normalized(files: DataFrame, normalizer: Normalizer = plain_normalizer) -> DataFrame:
    """(path, content_hash, size_bytes, markdown, status, detail); what can't be read is a row too."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, data in zip(frame["path"], frame["content"], strict=True):
                try:
                    out.append((normalizer(bytes(data), path), "ready", None))
                except NeedsOcr as e:
                    out.append((None, "needs_ocr", str(e)))
                except (TextError, InputError) as e:
                    out.append((None, "failed", str(e)))
                except Exception as e:  # a plugged-in reader that fails on one file
                    out.append((None, "failed", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame({"path": frame["path"], "content_hash": frame["content_hash"], "size_bytes": frame["length"], "markdown": [m for m, _, _ in out], "status": [s for _, s, _ in out], "detail": [d for _, _, d in out]})

    hashed = files.select("path", "length", "content", F.sha2("content", 256).alias("content_hash"))
    return hashed.mapInPandas(read, "path string, content_hash string, size_bytes long, markdown string, status string, detail string")


@dataclass(frozen=True)
class Member:
    path: str
    role: str
    mime: str
    is_text: bool
    size: int
    data: bytes


def bundle(members: dict[str, bytes]) -> list[Member]:
    """A skill's files, SKILL.md first; InputError beyond the limits."""
    shown = {p: d for p, d in members.items() if not any(s.startswith(".") for s in p.split("/"))}
    if len(shown) > BUNDLE_FILES or sum(map(len, shown.values())) > BUNDLE_BYTES or any(p.count("/") >= BUNDLE_DEPTH for p in shown):
        raise InputError("the bundle is too large")
    rows = [Member(p, role_of(p), mime_of(p), looks_like_text(d), len(d), d) for p, d in shown.items()]
    return sorted(rows, key=lambda m: (m.path != "SKILL.md", m.path.encode()))


def archive_members(data: bytes) -> dict[str, bytes]:
    """An archive's files, after a look at its list: no links, no way out, no more than the limits."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        raise InputError("not a zip archive") from None
    entries = archive.infolist()
    if len(entries) > BUNDLE_FILES or sum(e.file_size for e in entries) > BUNDLE_BYTES:
        raise InputError("the archive is too large")
    for e in entries:
        name = e.orig_filename
        if stat.S_ISLNK(e.external_attr >> 16):
            raise InputError(f"symbolic link in archive: {name!r}")
        if name.startswith("/") or "\\" in name or "\0" in name or ".." in name.split("/") or re.match(r"[A-Za-z]:", name):
            raise InputError(f"unsafe path in archive: {name!r}")
    return {e.filename: archive.read(e) for e in entries if not e.is_dir()}


def bundle_roots(names: list[str]) -> list[str]:
    """Folders that have a SKILL.md, not within another such folder."""
    roots = sorted({n[: -len("SKILL.md")] for n in names if PurePosixPath(n).name == "SKILL.md"})
    return [r for r in roots if not any(r != o and r.startswith(o) for o in roots)]
