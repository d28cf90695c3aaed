"""Analysis of text for full-text search, and the query language.

`simple` keeps lower-case words.  `english` stems them by the Snowball rules and leaves stop words out; each leaves a gap,
an empty term, so that the distances in phrases stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from lodeweave.functions.stemmer import stem
from lodeweave.functions.text import InputError

# Words that `english` leaves out.
STOP_WORDS = frozenset("""
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
    they them their theirs themselves what which who whom this that these those am is are was were be been being have has had
    having do does did doing a an the and but if or because as until while of at by for with about against between into through
    during before after above below to from up down in out on off over under again further then once here there when where why
    how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now
""".split())
ANALYZERS = ("simple", "english")
WORD = re.compile(r"[^\W_]+")


def analyze(text: str, analyzer: str = "simple") -> list[str]:
    """A term for each word, in order; empty for a stop word."""
    words = WORD.findall(text.lower())
    if analyzer == "simple":
        return words
    if analyzer == "english":
        return ["" if w in STOP_WORDS else stem(w) for w in words]
    raise InputError(f"unknown analyzer {analyzer!r}")


@dataclass(frozen=True)
class Phrase:
    """One term, or several that must follow each other; an empty one stands for any word."""

    words: tuple[str, ...]
    negated: bool = False


@dataclass(frozen=True)
class Query:
    """Alternatives of phrases that must all match.  Loosely, any phrase will do, unless one is negated."""

    anyof: tuple[tuple[Phrase, ...], ...]

    @property
    def phrases(self) -> Iterator[Phrase]:
        return (p for group in self.anyof for p in group)

    @property
    def negated(self) -> bool:
        return any(p.negated for p in self.phrases)

    @property
    def words(self) -> list[str]:
        """Distinct terms, those of negated phrases too."""
        return list(dict.fromkeys(w for p in self.phrases for w in p.words if w))

    def loose(self, phrases: bool = True) -> Query:
        """Any of the phrases (or of their words); a query with a negation stays as it is."""
        if self.negated:
            return self
        parts = list(self.phrases) if phrases else [Phrase((w,)) for w in self.words]
        return Query(tuple((p,) for p in dict.fromkeys(parts)))


_PART = re.compile(r'(?P<minus>-?)(?:"(?P<quoted>[^"]*)"?|(?P<word>[^\s"]+))')


def parse_query(text: str, analyzer: str = "simple") -> Query:
    """Words that must all match, "phrases", `or` between alternatives, and -negations."""
    groups: list[list[Phrase]] = [[]]
    for m in _PART.finditer(text):
        if m["word"] and m["word"].lower() == "or" and not m["minus"]:
            groups.append([])
            continue
        words = analyze(m["quoted"] if m["quoted"] is not None else m["word"], analyzer)
        full = [i for i, w in enumerate(words) if w]
        if full:
            groups[-1].append(Phrase(tuple(words[full[0] : full[-1] + 1]), bool(m["minus"])))
    return Query(tuple(tuple(g) for g in groups if g))


def cover_density(terms: Sequence[str], query: Query) -> float:
    """The sum of 1 / (1 + other words) over the shortest stretches of terms that satisfy the query.

    From each stretch's second query term on, the next is sought: first its end, then the latest beginning for that end.
    Stretches of equal beginning count once.  Negated phrases aren't looked at.
    """
    wanted = set(query.words)
    entries = [i for i, t in enumerate(terms) if t in wanted]
    groups = [[p.words for p in g if not p.negated] for g in query.anyof]
    latest: dict[tuple[str, ...], int] = {}
    found: list[tuple[int, int]] = []  # for each entry, the latest beginning of a stretch that ends there, in entries
    place = {at: k for k, at in enumerate(entries)}
    for at in entries:
        for words in {w for g in groups for w in g}:
            start = at - len(words) + 1
            if start >= 0 and all(not w or terms[start + k] == w for k, w in enumerate(words)):
                latest[words] = place[start]
        begins = [min(latest[w] for w in g) for g in groups if g and all(w in latest for w in g)]
        found.append((max(begins, default=-1), at))
    total, least = 0.0, 0
    for k, (begin, at) in enumerate(found):
        if begin >= least:
            inside = k - begin
            noise = (at - entries[begin]) - inside
            total += 1 / (1 + noise)
            least = begin + 1
    return total
