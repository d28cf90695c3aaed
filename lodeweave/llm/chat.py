r"""Chat formatting with a grammar round trip.

A conversation is rendered with control strings around its turns.  Each rendered turn is parsed again by a deterministic
parser; where the parser doesn't give back the source turn, the turn's content is escaped until it does.  An escape puts
a backslash after the first character of a control string; content that already has such backslashes gets one more, so
one backslash less is always the source.

Defined cases: a null text or role is empty; turns go by turn (nulls first), then role, then text, so ties and repeated
rows have one order; rows with a null conv_id are one conversation; an empty table gives no rows.  A conversation is one
row of output, so its turns must fit into memory.  Other columns aren't read and may have any name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The control strings, and what stands around a turn of each role.
CONTROL = r"<</?SYS>>|</?s>|\[/?INST\]|\[/?ROLE\]"
AROUND = {"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", " </s>")}
OTHER, OTHER_MIDDLE, OTHER_END = "[ROLE] ", " [/ROLE] ", " </s>"
#: The same pattern works in SQL.
CONFLICT = r"([\[<])(\\*)(/?INST\]|/?ROLE\]|/?s>|</?SYS>>)"

_CONTROL = re.compile(CONTROL)
_CONFLICT = re.compile(CONFLICT)
_ESCAPED = re.compile(r"([\[<])\\(\\*)(/?INST\]|/?ROLE\]|/?s>|</?SYS>>)")


class ChatSyntaxError(ValueError):
    """The text isn't of the template's grammar."""


def escaped(content: str) -> str:
    return _CONFLICT.sub(r"\1\\\2\3", content)


def unescaped(content: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", content)


def rendered_turn(role: str, text: str) -> tuple[str, int]:
    """The turn as it is written, and where its text begins."""
    if role in AROUND:
        before, after = AROUND[role]
    else:
        before, after = f"{OTHER}{role}{OTHER_MIDDLE}", OTHER_END
    return before + text + after, len(before)


def _until(text: str, at: int, end: str) -> tuple[str, int]:
    """The content from `at` up to the next control string, which must be the one in `end`; what follows `end`."""
    found = _CONTROL.search(text, at)
    mark = _CONTROL.search(end)
    if not found or not mark:
        raise ChatSyntaxError(f"nothing ends the content at {at}")
    stop = found.start() - mark.start()
    if stop < at or text[stop : stop + len(end)] != end:
        raise ChatSyntaxError(f"{found[0]!r} at {found.start()} where {end!r} is due")
    return text[at:stop], stop + len(end)


def parse_chat(text: str) -> list[tuple[str, str]]:
    """Roles and unescaped texts of a rendered conversation."""
    turns: list[tuple[str, str]] = []
    at = 0
    while at < len(text):
        role = next((r for r in ("system", "user") if text.startswith(AROUND[r][0], at)), None)
        if role:
            content, at = _until(text, at + len(AROUND[role][0]), AROUND[role][1])
        elif text.startswith(OTHER, at):
            name, at = _until(text, at + len(OTHER), OTHER_MIDDLE)
            role = unescaped(name)
            content, at = _until(text, at, OTHER_END)
        elif text.startswith(AROUND["assistant"][0], at):
            role = "assistant"
            content, at = _until(text, at + len(AROUND[role][0]), AROUND[role][1])
        else:
            raise ChatSyntaxError(f"no turn begins at {at}")
        turns.append((role, unescaped(content)))
    return turns


def _returns(written: str, turns: list[tuple[str, str]]) -> bool:
    try:
        return parse_chat(written) == turns
    except ChatSyntaxError:
        return False


def render_chat(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]], int]:
    """The rendered conversation, the spans under the loss mask (the assistant's written texts), and how many turns were escaped."""
    parts: list[str] = []
    mask: list[tuple[int, int]] = []
    at = changed = 0
    for role, text in turns:
        written = (role, text)
        for _ in range(3):
            part, start = rendered_turn(*written)
            if _returns(part, [(role, text)]):
                break
            written = (role if role in AROUND else escaped(role), escaped(text))
        else:
            raise ChatSyntaxError("a turn can't be escaped")
        changed += written != (role, text)
        if role == "assistant":
            mask.append((at + start, at + start + len(written[1])))
        parts.append(part)
        at += len(part)
    whole = "".join(parts)
    if not _returns(whole, turns):
        raise ChatSyntaxError("the conversation doesn't survive the round trip")
    return whole, mask, changed


def format_chats(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """id, formatted, loss_spans (code points of `formatted`, ends exclusive) and escaped_turns of every conversation."""
    kind = rows.schema[id_col].dataType.simpleString()
    gathered = (
        rows.select(F.col(id_col).alias("id"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).alias("t"))
        .groupBy("id")
        .agg(F.sort_array(F.collect_list("t")).alias("turns"))
        .select("id", "turns.role", "turns.text")
    )
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [render_chat(list(zip(r, t, strict=True))) for r, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            masks = [[{"start": a, "end": b} for a, b in mask] for _, mask, _ in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([w for w, _, _ in out], pa.string()), pa.array(masks, spans), pa.array([n for _, _, n in out], pa.int64())], [id_col, "formatted", "loss_spans", "escaped_turns"])

    return gathered.mapInArrow(formatted, f"{id_col} {kind}, formatted string, loss_spans array<struct<start:long,end:long>>, escaped_turns long")


def chat_digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What format_chats() gave, read back: turns by the parser, loss texts by the mask."""
    names = [id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kind = formatted.schema[id_col].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for whole, mask in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = parse_chat(whole)
                loss = "".join(unescaped(whole[m["start"] : m["end"]]) for m in mask)
                digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                rows.append((len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return formatted.select(id_col, "formatted", "loss_spans").mapInArrow(read, f"{id_col} {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
