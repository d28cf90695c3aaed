"""Addresses of the virtual file system: scheme, realm, source root, path, and an optional chunk."""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import quote, unquote_to_bytes

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the address format.
SCHEME = "ctx://"
INDEX = SCHEME + "index"
REALMS = {"skills": "skill name", "docs": "collection"}
#: Characters that stay as they are in a segment, besides letters and digits.
UNRESERVED = "-_.!~*'()"

_DRIVE = re.compile(r"[A-Za-z]:")
_ESCAPE = re.compile(r"%[0-9A-Fa-f]{2}")
_BAD_ESCAPE = re.compile(r"%(?![0-9A-Fa-f]{2})")


class UriError(ValueError):
    """An address or path that isn't allowed."""


@dataclass(frozen=True)
class Address:
    realm: str
    root: str
    path: str = ""
    chunk: int | None = None


def _loosely_decoded(path: str) -> str:
    """Escapes resolved where that gives text; other percent signs stay."""
    try:
        if not _BAD_ESCAPE.search(path):
            return unquote_to_bytes(path).decode()
    except UnicodeDecodeError:
        pass
    return _ESCAPE.sub(lambda m: chr(int(m[0][1:], 16)), path)


def check_path(path: str) -> None:
    """UriError for what could leave the source root, also behind percent-encoding."""
    while True:
        problems = {
            "null byte": "\0" in path,
            "absolute path": path.startswith("/") or bool(_DRIVE.match(path)),
            "backslash": "\\" in path,
            "unnormalized or home-relative segment": any(s in {".", "..", "~"} for s in path.split("/")),
        }
        for what, wrong in problems.items():
            if wrong:
                raise UriError(f"{what} rejected: {path!r}")
        decoded = _loosely_decoded(path)
        if decoded == path:
            return
        path = decoded


def check_name(name: str, what: str = "name") -> None:
    if not name:
        raise UriError(f"empty {what}")
    if re.search(r"[/\\\0]", name) or name in {".", ".."} or name.startswith("~"):
        raise UriError(f"invalid {what}: {name!r}")


def encode_segment(segment: str) -> str:
    return quote(segment, safe=UNRESERVED)


def build_uri(realm: str, root: str, path: str = "", chunk: int | None = None) -> str:
    if realm not in REALMS:
        raise UriError(f"unknown realm: {realm}")
    check_name(root, REALMS[realm])
    check_path(path)
    parts = [encode_segment(root), *(encode_segment(s) for s in path.split("/") if path)]
    return f"{SCHEME}{realm}/{'/'.join(parts)}" + ("" if chunk is None else f"#chunk={chunk}")


def _decode_segment(segment: str) -> str:
    try:
        if _BAD_ESCAPE.search(segment):
            raise ValueError
        value = unquote_to_bytes(segment).decode()
    except ValueError:
        raise UriError("malformed percent-encoding") from None
    if "/" in value:
        raise UriError("encoded path separator rejected")
    return value


def parse_uri(uri: str) -> Address:
    if not uri.startswith(SCHEME) or uri == SCHEME:
        raise UriError(f"not an address of {SCHEME}: {uri!r}")
    body, _, fragment = uri[len(SCHEME) :].partition("#")
    found = re.fullmatch(r"chunk=([0-9]+)", fragment)
    if fragment and not found:
        raise UriError(f"unsupported fragment: {fragment!r}")
    if "?" in body:
        raise UriError("query strings aren't supported; encode question marks in names")
    realm, *rest = body.split("/")
    if realm not in REALMS:
        raise UriError(f"unknown realm: {realm!r}")
    names = [_decode_segment(s) for s in rest]
    if not names or not names[0]:
        raise UriError(f"missing {REALMS[realm]}")
    path = "/".join(names[1:])
    check_name(names[0], REALMS[realm])
    check_path(path)
    return Address(realm, names[0], path, int(found[1]) if found else None)


def path_to_uri(path: str) -> str | None:
    realm, _, rest = path.strip("/").partition("/")
    root, _, inner = rest.partition("/")
    return build_uri(realm, root, inner) if realm in REALMS and root else None


def uri_to_path(uri: str) -> str:
    a = parse_uri(uri)
    return "/".join(["", a.realm, a.root, *([a.path] if a.path else [])])


def normal_path(path: str | None) -> str:
    inner = (path or "/").strip().strip("/")
    check_path(inner)
    return "/" + inner


#: What form encoding and segment encoding differ in.
_FORM_FIXES = {"+": "%20", "%7E": "~", "%21": "!", "%27": "'", "%28": "(", "%29": ")"}


def encoded(segment: Column) -> Column:
    """encode_segment() as a column."""
    out = F.url_encode(segment)
    for a, b in _FORM_FIXES.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def encoded_path(path: Column) -> Column:
    return F.array_join(F.transform(F.split(path, "/"), encoded), "/")


def source_path(kind: Column, name: Column, collection: Column, path: Column) -> Column:
    """The path that users see."""
    root = F.when(kind == "skill", F.concat(F.lit("skills/"), name)).otherwise(F.concat(F.lit("docs/"), collection))
    return F.concat(F.lit("/"), root, F.lit("/"), path)
