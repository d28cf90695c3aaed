"""Markdown as blocks, and blocks as chunks of bounded size under their headings."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

from lodeweave.functions.text import TOKEN_CHARS, estimate_tokens, from_utf16_string, utf16_length, utf16_slice, utf16_string, within_pair

# Sizes in tokens.
TARGET, OVERLAP, LEAST, MARGIN = 800, 100, 40, 40

_FENCE = re.compile(r"\s*(`{3,}|~{3,})")
_HEADING = re.compile(r"(#{1,6})\s+(.*)")
_ROW = re.compile(r"\s*\|.*\|\s*")
_RULED = re.compile(r"\s*\|[\s:|-]+\|\s*")
_LOOSE_ROW = re.compile(r"\s*\|.*")
_RULE = re.compile(r"\s*(?:-{3,}|\*{3,}|_{3,})\s*")
_ITEM = re.compile(r"\s*(?:[-*+]|\d+[.)])\s")
_SENTENCE = re.compile(r"[.!?]\s+|\n")
_TAIL_START = re.compile(r"(?<=[.!?])\s+|\n")


@dataclass(frozen=True)
class Block:
    """kind: heading, paragraph, code, table, list, quote, rule or math."""

    kind: str
    text: str
    level: int | None = None


@dataclass
class Chunk:
    ord: int
    heading_path: list[str]
    content: str
    token_count: int


def _prose(lines: list[str]) -> Iterator[Block]:
    text = "\n".join(lines).strip()
    if text:
        yield Block("list" if _ITEM.match(text) else "quote" if text.startswith(">") else "paragraph", text)
    lines.clear()


def blocks_from_markdown(markdown: str) -> list[Block]:
    return list(_blocks(markdown.split("\n")))


def _blocks(lines: list[str]) -> Iterator[Block]:
    prose: list[str] = []
    at = 0
    while at < len(lines):
        line, start = lines[at], at
        at += 1
        if fence := _FENCE.match(line):
            mark = fence[1]
            closing = re.compile(rf"\s*{re.escape(mark[0])}{{{len(mark)},}}\s*")
            while at < len(lines) and not closing.fullmatch(lines[at]):
                at += 1
            closed = at < len(lines)
            at += closed
            yield from _prose(prose)
            yield Block("code", "\n".join(lines[start:at] + ([] if closed else [mark])))
        elif heading := _HEADING.fullmatch(line):
            yield from _prose(prose)
            yield Block("heading", line.strip(), len(heading[1]))
        elif _ROW.fullmatch(line) and at < len(lines) and _RULED.fullmatch(lines[at]):
            while at < len(lines) and _LOOSE_ROW.fullmatch(lines[at]):
                at += 1
            yield from _prose(prose)
            yield Block("table", "\n".join(lines[start:at]))
        elif _RULE.fullmatch(line):
            yield from _prose(prose)
            yield Block("rule", "---")
        elif line.strip():
            prose.append(line)
        else:
            yield from _prose(prose)
    yield from _prose(prose)


def _row_batches(block: Block, limit: int) -> list[Block] | None:
    """A table's rows in batches under its header; None if a row with the header doesn't fit."""
    header, delimiter, *rows = (block.text.split("\n") + [""])[: max(2, block.text.count("\n") + 1)]
    prefix = f"{header}\n{delimiter}\n"
    base = utf16_length(prefix)
    if base >= limit / 2 or any(utf16_length(r) + base > limit for r in rows):
        return None
    batches: list[list[str]] = []
    used = 0
    for row in rows:
        size = utf16_length(row) + 1
        if not batches or used + size > limit:
            batches.append([])
            used = base
        batches[-1].append(row)
        used += size
    return [replace(block, text=(prefix + "\n".join(b)).rstrip()) for b in batches]


def _cut(window: str, limit: int) -> int:
    """Where to cut a window: after a sentence or line, else after a word, else at its end."""
    last = None
    for last in _SENTENCE.finditer(window):
        pass
    at = last.end() if last and last.start() > limit / 3 else window.rfind(" ") + 1
    return at if at >= limit / 3 else len(window)


def split_block(block: Block, budget: float) -> list[Block]:
    """Blocks of at most `budget` tokens.  Code and headings stay whole; prose joins to what it was."""
    if block.kind in ("code", "heading") or estimate_tokens(block.text) <= budget:
        return [block]
    limit = max(4, int(budget * TOKEN_CHARS))
    if block.kind == "table" and (batches := _row_batches(block, limit)) is not None:
        return batches
    units, at, out = utf16_string(block.text), 0, []
    while len(units) - at > limit:
        end = at + limit - within_pair(units, at + limit)
        cut = at + _cut(units[at:end], limit)
        out.append(replace(block, text=from_utf16_string(units[at:cut])))
        at = cut
    return [*out, replace(block, text=from_utf16_string(units[at:]))] if at < len(units) else out


def _joined(blocks: Iterable[Block]) -> str:
    return "\n\n".join(b.text for b in blocks).strip()


def overlap_tail(blocks: list[Block], overlap: int) -> str:
    """The end of the trailing prose, from the start of a sentence or line."""
    prose: list[Block] = []
    for b in reversed(blocks):
        if b.kind in ("heading", "table", "code"):
            break
        prose.insert(0, b)
    text, limit = _joined(prose), overlap * TOKEN_CHARS
    size = utf16_length(text)
    if size <= limit:
        return text
    tail = utf16_slice(text, size - limit)
    found = _TAIL_START.search(tail)
    return tail[found.start() if found else 0 :].strip()


@dataclass
class _Chunker:
    target: int
    overlap: int
    chunks: list[Chunk] = field(default_factory=list)
    path: list[str] = field(default_factory=list)
    open: list[Block] = field(default_factory=list)
    size: int = 0

    @property
    def headings(self) -> list[str]:
        return [h for h in self.path if h]

    def close(self) -> None:
        """Emit what is open; headings alone wait for what they introduce."""
        if all(b.kind == "heading" for b in self.open):
            return
        content = _joined(self.open)
        self.open, self.size = [], 0
        if not content:
            return
        tokens, last = estimate_tokens(content), self.chunks[-1] if self.chunks else None
        if last and tokens < LEAST and last.heading_path == self.headings and last.token_count + tokens <= 1.5 * self.target:
            last.content += "\n\n" + content
            last.token_count = estimate_tokens(last.content)
        else:
            self.chunks.append(Chunk(len(self.chunks), self.headings, content, tokens))

    def heading(self, block: Block) -> None:
        self.close()
        level = min(max(block.level or 1, 1), 6)
        title = re.sub(r"[*_`]", "", re.sub(r"^#{1,6}\s+", "", block.text)).strip()
        self.path = (self.path + [""] * level)[: level - 1] + [title]
        self.open.append(block)
        self.size = estimate_tokens(block.text)

    def body(self, block: Block) -> None:
        tokens = estimate_tokens(block.text)
        if self.open and self.size + tokens > self.target:
            tail = overlap_tail(self.open, self.overlap)
            self.close()
            names = self.headings
            self.open = [Block("heading", f"{'#' * min(len(names), 6)} {names[-1]}", len(names))] if names else []
            self.open += [Block("paragraph", tail)] if tail else []
            self.size = estimate_tokens(_joined(self.open))
        self.open.append(block)
        self.size += tokens
        if block.kind == "code" and self.size >= self.target:
            self.close()


def chunk_blocks(blocks: Iterable[Block], target: int = TARGET, overlap: int = OVERLAP) -> list[Chunk]:
    work = _Chunker(target, overlap)
    budget = max(1, target - min(overlap, target / 4) - MARGIN)
    for whole in blocks:
        for block in split_block(whole, budget):
            work.heading(block) if block.kind == "heading" else work.body(block)
    work.close()
    return work.chunks
