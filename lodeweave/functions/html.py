"""HTML as Markdown: the main content of a page, by its text and links."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

_SKIPPED = frozenset(["script", "style", "nav", "footer", "header", "aside", "noscript", "template", "form", "svg", "button"])
_VOID = frozenset(["br", "hr", "img", "input", "meta", "link", "source", "wbr", "area", "base", "col", "embed", "track"])
_PARAGRAPHS = frozenset(["p", "div", "section", "article", "main", "body", "figure", "figcaption", "dl", "dt", "dd"])
_INLINE = {"strong": "**", "b": "**", "em": "_", "i": "_", "del": "~~", "s": "~~", "code": "`"}


@dataclass
class _Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[_Node | str] = field(default_factory=list)
    parent: _Node | None = None

    def all(self, tag: str) -> list[_Node]:
        found = [self] if self.tag == tag else []
        for c in self.children:
            if isinstance(c, _Node):
                found += c.all(tag)
        return found

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else "" if c.tag in _SKIPPED else c.text() for c in self.children)

    def link_text(self) -> int:
        return sum(len(a.text().strip()) for a in self.all("a"))


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("#root")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        cell = ("td", "th")
        if self.at.parent and (self.at.tag == tag in ("li", "p", "tr", "option") or (tag in cell and self.at.tag in cell)):
            self.at = self.at.parent
        node = _Node(tag, {k: v or "" for k, v in attrs}, parent=self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        node: _Node | None = self.at
        while node and node.tag != tag:
            node = node.parent
        if node and node.parent:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def _tree(html: str) -> _Node:
    parser = _Tree()
    parser.feed(html)
    parser.close()
    return parser.root


def _main_content(root: _Node) -> _Node:
    """The article or main element, else the block with most text outside links, else everything."""
    named = [n for tag in ("article", "main") for n in root.all(tag) if n.text().strip()]
    if named:
        return max(named, key=lambda n: len(n.text()))
    blocks = [n for tag in ("section", "div") for n in root.all(tag)]
    best = max(blocks, key=lambda n: sum(len(c.text()) for c in n.children if isinstance(c, _Node) and c.tag == "p") - n.link_text(), default=None)
    body = root.all("body")
    return best if best and best.all("p") else body[0] if body else root


def _spaced(text: str) -> str:
    return re.sub(r"\s+", " ", text)


def _inline(node: _Node) -> str:
    out = []
    for c in node.children:
        if isinstance(c, str):
            out.append(_spaced(c))
        elif c.tag == "br":
            out.append("\n")
        elif c.tag == "a" and c.attrs.get("href") and c.text().strip():
            out.append(f"[{_inline(c).strip()}]({c.attrs['href']})")
        elif c.tag == "img" and c.attrs.get("src"):
            out.append(f"![{c.attrs.get('alt', '')}]({c.attrs['src']})")
        elif c.tag in _INLINE and c.text().strip():
            out.append(f"{_INLINE[c.tag]}{_inline(c).strip()}{_INLINE[c.tag]}")
        elif c.tag == "input" and c.attrs.get("type") == "checkbox":
            out.append("[x] " if "checked" in c.attrs else "[ ] ")
        elif c.tag not in _SKIPPED:
            out.append(_inline(c))
    return "".join(out)


def _table(node: _Node) -> str:
    rows = [[_inline(c).strip().replace("|", "\\|").replace("\n", " ") for c in r.children if isinstance(c, _Node) and c.tag in ("td", "th")] for r in node.all("tr")]
    rows = [r for r in rows if r]
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def _list(node: _Node, depth: int = 0) -> str:
    lines = []
    for k, item in enumerate(c for c in node.children if isinstance(c, _Node) and c.tag == "li"):
        own = _Node("li", children=[c for c in item.children if isinstance(c, str) or c.tag not in ("ul", "ol")])
        lines.append("  " * depth + (f"{k + 1}. " if node.tag == "ol" else "- ") + _inline(own).strip())
        lines += [_list(c, depth + 1) for c in item.children if isinstance(c, _Node) and c.tag in ("ul", "ol")]
    return "\n".join(lines)


def _parts(node: _Node) -> list[str]:
    out: list[str] = []
    loose = _Node("p")

    def settle() -> None:
        text = _inline(loose).strip()
        if text:
            out.append(text)
        loose.children = []

    for c in node.children:
        if isinstance(c, str) or not (c.tag in _PARAGRAPHS or c.tag in _SKIPPED or re.fullmatch(r"h[1-6]|ul|ol|table|pre|blockquote|hr|html|head|title", c.tag)):
            loose.children.append(c)
            continue
        settle()
        if c.tag in _SKIPPED or c.tag in ("head", "title"):
            continue
        if re.fullmatch(r"h[1-6]", c.tag):
            title = _spaced(_inline(c)).strip()
            out += [f"{'#' * int(c.tag[1])} {title}"] if title else []
        elif c.tag in ("ul", "ol"):
            out.append(_list(c))
        elif c.tag == "table":
            out.append(_table(c))
        elif c.tag == "pre":
            out.append(f"```\n{c.text().strip(chr(10))}\n```")
        elif c.tag == "blockquote":
            out.append("\n".join(f"> {line}" for line in "\n\n".join(_parts(c)).split("\n")))
        elif c.tag == "hr":
            out.append("---")
        else:
            out += _parts(c)
    settle()
    return [p for p in out if p.strip()]


def html_title(html: str) -> str:
    titles = _tree(html).all("title")
    return _spaced(titles[0].text()).strip() if titles else ""


def html_to_markdown(html: str | None) -> str:
    """The title as a first heading, unless the content begins with it, and the main content.  Empty for nothing."""
    if not html or not html.strip():
        return ""
    root = _tree(html)
    titles = root.all("title")
    title = _spaced(titles[0].text()).strip() if titles else ""
    parts = _parts(_main_content(root))
    if title and (not parts or parts[0].lstrip("# ") != title):
        parts.insert(0, f"# {title}")
    return "\n\n".join(parts)
