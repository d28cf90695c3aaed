"""Text as the engine measures it: UTF-16 lengths, token estimates, strict decoding.

A character outside the basic plane counts twice in every length, limit and offset.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Output budgets in tokens.
BUDGETS = {"index": 2000, "ls": 4000, "glob": 2000, "grep": 6000, "read": 12000, "search": 8000, "skill": 10000}
TOKEN_CHARS = 4
HEAD_BYTES = 4096

_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")
_TAIL_WORD = re.compile(r"\s+\S*\Z")  # not $, which a last line feed stands behind


class InputError(ValueError):
    """The caller's arguments can't be used."""


class TextError(ValueError):
    """Bytes that aren't text."""


def utf16_length(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


def utf16_slice(text: str, start: int, end: int | None = None) -> str:
    """By UTF-16 offsets; an offset within a pair takes the whole character's second half as absent."""
    if text.isascii():
        return text[start:end]
    data = text.encode("utf-16-le", "surrogatepass")
    return data[2 * start : None if end is None else 2 * end].decode("utf-16-le", "ignore")


def utf16_string(text: str) -> str:
    """One character for each UTF-16 unit, so that plain offsets count units."""
    if text.isascii() or max(text) <= "\uffff":
        return text
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2")
    return units.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def from_utf16_string(units: str) -> str:
    return units if units.isascii() else units.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "surrogatepass")


def within_pair(units: str, at: int) -> bool:
    """Whether an offset lies between the halves of a character."""
    return 0 < at < len(units) and "\ud800" <= units[at - 1] <= "\udbff" and "\udc00" <= units[at] <= "\udfff"


def estimate_tokens(text: str) -> int:
    return math.ceil(utf16_length(text) / TOKEN_CHARS)


def conservative_tokens(text: str) -> int:
    return min(32000, math.ceil(utf16_length(text) / 3))


def clip(text: str | None, limit: int) -> str:
    """At most `limit` units; a word that the cut would break goes."""
    if not text:
        return ""
    return text if utf16_length(text) <= limit else _TAIL_WORD.sub("", utf16_slice(text, 0, limit - 1)) + "…"


def looks_like_text(head: bytes) -> bool:
    """No NUL, and over nine tenths printable among the first bytes."""
    head = head[:HEAD_BYTES]
    fine = sum(b in (9, 10, 13) or 32 <= b <= 126 or b >= 128 for b in head)
    return not head or (0 not in head and fine > 0.9 * len(head))


def decode_text(data: bytes) -> str:
    """UTF-8, or UTF-16 with a byte order mark; TextError for anything else and for control characters."""
    kind = {b"\xff\xfe": "utf-16-le", b"\xfe\xff": "utf-16-be"}.get(data[:2])
    try:
        text = data[2:].decode(kind) if kind else data.decode("utf-8-sig")
    except UnicodeDecodeError as e:
        raise TextError(f"not valid {kind or 'utf-8'}: {e.reason}") from None
    if _CONTROL.search(text):
        raise TextError("control characters")
    return text


def utf16_units(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("long")


def token_estimate(text: Column) -> Column:
    return F.ceil(utf16_units(text) / TOKEN_CHARS).cast("long")


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
