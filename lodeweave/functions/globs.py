"""Globs as anchored regular expressions, and what of them a scan can use."""

from __future__ import annotations

import re
from dataclasses import dataclass

from lodeweave.functions.text import InputError

_TOKEN = re.compile(r"(?P<tree>\*\*/)|(?P<deep>\*\*)|(?P<star>\*)|(?P<one>\?)|(?P<brace>\{[^}]*\}?)|(?P<set>\[[^\]]*\]?)|(?P<text>[^*?{\[]+)", re.S)
_FIXED = {"tree": "(?:.*/)?", "deep": ".*", "star": "[^/]*", "one": "[^/]"}
_META = re.compile(r"[.*+?^${}()|\[\]\\]")


def _plain(text: str) -> str:
    return _META.sub(lambda m: "\\" + m[0], text)


def _set(token: str) -> str:
    if not token.endswith("]"):
        raise InputError("unclosed character class in glob")
    chars = token[1:-1]
    negated = chars[:1] in ("!", "^") and bool(chars)
    chars = chars[1:] if negated else chars
    if not chars or re.search(r"[\\/\[]", chars):
        raise InputError("invalid glob character class")
    return f"[^/{chars}]" if negated else f"[{chars}]"


def _choices(token: str) -> str:
    if not token.endswith("}") or "{" in token[1:]:
        raise InputError("invalid or nested brace glob")
    return f"(?:{'|'.join(_body(part) for part in token[1:-1].split(','))})"


def _body(pattern: str) -> str:
    out = []
    for m in _TOKEN.finditer(pattern):
        kind, token = m.lastgroup or "text", m[0]
        out.append(_FIXED[kind] if kind in _FIXED else {"brace": _choices, "set": _set, "text": _plain}[kind](token))
    return "".join(out)


def glob_regex(pattern: str) -> str:
    """Whole-path form; `.` must match line ends, so compile with (?s)."""
    return f"^{_body(pattern)}$"


@dataclass(frozen=True)
class GlobPlan:
    """The whole-path expression, and literal parts that narrow the scan before it."""

    regex: str
    kind: str | None = None
    root: str | None = None
    prefix: str = ""


def plan_glob(pattern: str) -> GlobPlan:
    full = pattern if pattern == "/" else pattern.rstrip("/")
    full = full if full.startswith("/") else f"**/{full}"
    names = full.removeprefix("/").split("/")
    literal = next((i for i, s in enumerate(names) if re.search(r"[*?{\[]", s)), len(names))
    kind = {"skills": "skill", "docs": "doc"}.get(names[0]) if literal else None
    root = names[1] if kind and literal > 1 else None
    # the last literal segment may be a file's name: it narrows only what a wildcard follows
    inner = names[2:literal] if root and literal < len(names) else []
    return GlobPlan(glob_regex(full), kind, root, "".join(f"{s}/" for s in inner))
