"""The engine's six tools as an agent calls them: text within a budget, a cursor to go on with, errors as data."""

from __future__ import annotations

import base64
from collections.abc import Callable, Sequence
from functools import wraps
from typing import Any

from lodeweave.api import MAX_QUERIES, Engine, TooExpensive
from lodeweave.functions import paging, safety
from lodeweave.functions.text import BUDGETS, InputError
from lodeweave.functions.uri import UriError
from lodeweave.operators.fusion import LINKS
from lodeweave.store import MigrationRequired

# Limits of a call.
GLOB_MOST, GREP_MOST, SEARCH_MOST, READ_LINES = 500, 200, 25, 5000


def error(code: str, message: str, action: str, retryable: bool = False) -> dict[str, Any]:
    return {"text": f"{message}\nNext: {action}", "error": {"code": code, "message": message, "retryable": retryable, "suggested_action": action}, "next_cursor": None}


def _as_data(tool: Callable[..., dict[str, Any]]) -> Callable[..., dict[str, Any]]:
    @wraps(tool)
    def run(*args: Any, **options: Any) -> dict[str, Any]:
        try:
            return tool(*args, **options)
        except paging.CursorError as e:
            return error(e.code, str(e), "Call again without a cursor.")
        except (InputError, UriError) as e:
            return error("INVALID_ARGUMENT", str(e), "Correct the arguments.")
        except TooExpensive as e:
            return error("QUERY_TIMEOUT", str(e), "Narrow the request.", retryable=True)
        except MigrationRequired as e:
            return error("MIGRATIONS_REQUIRED", str(e), "Run migrate() on the store.")
        except Exception as e:
            return error("SERVICE_ERROR", f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}", "Try again later.", retryable=True)

    return run


def _within(value: int, most: int, what: str) -> int:
    if not 1 <= value <= most:
        raise InputError(f"{what} must be between 1 and {most}")
    return value


def links(entries: Sequence[dict]) -> list[str]:
    """Each entry's address once, in their order."""
    return list(dict.fromkeys(e["uri"] for e in entries))[:LINKS]


class Tools:
    def __init__(self, engine: Engine) -> None:
        self.engine = engine

    def _entries(self, entries: Sequence[dict], render: Callable[[dict], str], budget: int, key: str, offset: int, more: bool, head: str = "", framed: bool = False) -> dict[str, Any]:
        """As many whole entries as fit, and a cursor after the last one shown."""
        shown, body = paging.fit_entries(entries, render, budget)
        left = more or len(shown) < len(entries)
        text = "\n".join(filter(None, [head, body])) or "nothing found"
        return {"text": safety.envelope(text) if framed else text, "entries": shown, "next_cursor": paging.encode_cursor(key, offset + len(shown)) if left else None}

    @_as_data
    def ls(self, path: str = "/", offset: int = 0, cursor: str | None = None) -> dict[str, Any]:
        if path.strip("/ ") == "":
            return {"text": self.engine.catalog(), "entries": self.engine.ls("/")["entries"], "next_cursor": None}
        key = f"ls:{path}"
        start = paging.decode_cursor(cursor, key)
        if start is not None and offset:
            raise paging.CursorError("Use a cursor or an offset, not both.")
        start = offset if start is None else start
        listing = self.engine.ls(path, start)
        if listing["missing"]:
            return error("NOT_FOUND", f"{listing['path']}: no such path", "List the folder above.")
        return self._entries(listing["entries"], lambda e: f"  {e['name']}  {e.get('note') or ''}".rstrip(), BUDGETS["ls"], key, start, listing["next_offset"] is not None, listing["path"])

    @_as_data
    def glob(self, pattern: str, limit: int = 100, cursor: str | None = None) -> dict[str, Any]:
        _within(limit, GLOB_MOST, "limit")
        key = f"glob:{pattern}:{limit}"
        start = paging.decode_cursor(cursor, key) or 0
        found = self.engine.glob(pattern, limit + 1, start)
        out = self._entries(found[:limit], lambda e: f"{e['path']}  {e['uri']}", BUDGETS["glob"], key, start, len(found) > limit)
        return out | {"links": links(out["entries"])}

    @_as_data
    def grep(self, pattern: str, path_glob: str | None = None, ignore_case: bool = True, limit: int = 50, cursor: str | None = None) -> dict[str, Any]:
        _within(limit, GREP_MOST, "limit")
        found = self.engine.grep(pattern, path_glob, ignore_case, limit, cursor)
        shown, body = paging.fit_entries(found["matches"], lambda m: f"{m['path']}:{m['line']}: {m['text']}", BUDGETS["grep"] - 256)
        following = found["next"]
        if len(shown) < len(found["matches"]):
            following = self.engine.grep_cursor(pattern, path_glob, ignore_case, shown[-1]["node_id"], shown[-1]["line"])
        return {"text": safety.envelope(body or "no match on this page"), "entries": shown, "scanned_files": found["scanned_files"], "next_cursor": following}

    @_as_data
    def read(self, uri: str, offset: int = 0, limit: int | None = None, cursor: str | None = None) -> dict[str, Any]:
        if limit is not None:
            _within(limit, READ_LINES, "limit")
        got = self.engine.read(uri, cursor, offset, limit)
        out = {"text": got["text"], "next_cursor": got["next"]}
        if "data" in got:
            out["data"] = base64.b64encode(got["data"]).decode()
        return out | ({"neighbours": got["neighbours"]} if "neighbours" in got else {})

    @_as_data
    def search(self, queries: Sequence[str], scope: str | None = None, limit: int = 8, target: str = "passages", cursor: str | None = None) -> dict[str, Any]:
        if not 1 <= len(queries) <= MAX_QUERIES:
            raise InputError(f"give 1 to {MAX_QUERIES} queries")
        _within(limit, SEARCH_MOST, "limit")
        key = repr(("search", list(queries), scope, limit, target))
        mode, warnings = "full_text", []
        if cursor is not None:
            name, _, at = cursor.partition(".")
            hits, start = self.engine.pages.page(name), paging.decode_cursor(at, key) or 0
        elif target == "skills":
            hits, start, name = self.engine.search_skills(queries, scope, limit), 0, ""
        elif target == "passages":
            result = self.engine.search_with_diagnostics(queries, limit, scope=scope)
            mode, warnings = result.retrieval_mode, result.warnings
            hits, start, name = [{"score": h.score, **h.fields} for h in result.hits], 0, ""
        else:
            raise InputError("target must be passages or skills")
        line = (lambda h: f"{h['name']}: {h['description']}\n{h['uri']}") if target == "skills" else (lambda h: f"{h['uri']}  {' > '.join(h['heading_path'])}\n{h['snippet']}")
        shown, body = paging.fit_entries(hits[start:], line, BUDGETS["search"])
        following = None
        if start + len(shown) < len(hits):
            name = name or self.engine.pages.keep(hits)
            following = f"{name}.{paging.encode_cursor(key, start + len(shown))}"
        return {"text": safety.envelope(body or "nothing found"), "entries": shown, "links": links(shown), "retrieval_mode": mode, "warnings": warnings, "next_cursor": following}

    @_as_data
    def skill(self, name: str, cursor: str | None = None) -> dict[str, Any]:
        """The instructions, bare: a skill is there to be followed."""
        s = self.engine.skill(name)
        page = paging.text_page(s["body"], f"skill:{name}", BUDGETS["skill"], cursor)
        head = "" if cursor else f"# {s['name']}\n{s['description']}\n\n"
        tail = "" if page.next_cursor else "\n\nFiles:\n" + "\n".join(f"- {f['path']} ({f['role']}): {f['uri']}" for f in s["files"])
        return {"text": head + page.text + tail, "next_cursor": page.next_cursor}
