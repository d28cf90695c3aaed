"""Byte-level BPE encoding and decoding by DuckDB recursive queries, one database in each Python worker.

A text is cut into the pattern's pieces.  Each distinct piece is a list of byte tokens; a recursive query unnests the
lists to token-position rows, joins neighbouring tokens with the merge table, and contracts each piece's leftmost pair
of minimum rank, until no piece has a pair.  Decoding joins the ids with the token table and aggregates the bytes in
order.  A piece that is itself a token is its own encoding, as in the library.

Pieces never reach over a space that has a character other than white space on its left or its right, so texts are cut
at spaces first and the encodings of the parts are remembered: when CACHED have come, those that weren't used since as many
came before are forgotten.  A text with any other space is cut by the pattern as a whole.  Each distinct piece is decoded by the query when it is encoded, and refused if
it doesn't come back.  Each document is decoded from its own ids: rows of document, position and token, whose token
column has the token table as its dictionary, are aggregated in the order of their positions.  The encoding query takes as
many steps as a piece has merges, so a piece of over LONG_PIECE bytes is contracted by a heap instead, to the same result.

Defined cases: a null text counts as empty, no tokens; a null id stays null; rows with equal texts get equal results;
an empty table gives no rows.  Only the id and text columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts, and pieces, of a generation that is remembered; two of them are.
CACHED = 300_000
LONG_PIECE = 1_024
#: Pieces a query; all steps of a query are held until it ends.
PIECES = 20_000
#: Documents, and bytes of their texts (or one document), that are encoded and decoded at once.
BLOCK_DOCS, BLOCK_BYTES = 700, 4_000_000
#: Tokens, in whole documents, that one query decodes.
DECODED = 250_000

#: A space between white space, or between white space and the end.
_INNER_SPACE = re.compile(r" (?=\s|\Z)(?<=\s )")

#: start: pieces as lists of byte tokens, live; or as their ids, not live.
_CODE = """
WITH RECURSIVE step(w, toks, live) AS (
  SELECT w, toks, live FROM start
  UNION ALL
  SELECT s.w,
    CASE WHEN b.k IS NULL THEN s.toks ELSE list_concat(s.toks[:b.k % 65536 - 1], [(b.k // 65536)::INTEGER], s.toks[b.k % 65536 + 2:]) END,
    b.k IS NOT NULL
  FROM step s LEFT JOIN (
    SELECT w, min(m.rank::BIGINT * 65536 + i) AS k
    FROM (SELECT w, unnest(toks)::UINTEGER * 65536 + unnest(toks[2:])::UINTEGER AS pair, generate_subscripts(toks, 1) AS i FROM step WHERE live) p
    JOIN merges m ON p.pair = m.pair GROUP BY w) b ON s.w = b.w
  WHERE s.live),
encoded AS (SELECT w, toks FROM step WHERE NOT live),
decoded AS (
  SELECT w, string_agg(t.hex, '' ORDER BY i) AS hex
  FROM (SELECT w, unnest(toks) AS id, generate_subscripts(toks, 1) AS i FROM encoded) e JOIN tokens t ON e.id = t.id GROUP BY w)
SELECT array_to_string(toks, ' ') AS ids, hex FROM encoded JOIN decoded USING (w) ORDER BY w
"""

_DECODE = "SELECT doc, string_agg(token, '' ORDER BY position) AS hex FROM coded GROUP BY doc"


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file: base64 of a token and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class BytePairs:
    """An encoder and decoder with one vocabulary.  Ranks are ids, under 65536."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        if max(ranks.values()) >= 1 << 16:
            raise ValueError("ids must be below 65536")
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        #: Ids, as text, of pieces; and of parts, which have a space before them.
        self._pieces: dict[str, str] = {}
        self._parts: dict[str, str] = {}
        self._old: dict[str, str] = {}
        #: The token table: each id's bytes in hexadecimal, null for numbers that are no id.
        self.tokens: list[str | None] = [None] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.tokens[r] = t.hex()

    @cached_property
    def _db(self) -> duckdb.DuckDBPyConnection:
        db = duckdb.connect(config={"threads": 1})
        pairs = [(self.ranks[t[:i]] << 16 | self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        merges = pa.table({"pair": pa.array([p for p, _ in pairs], pa.uint32()), "rank": pa.array([r for _, r in pairs], pa.int32())})
        tokens = pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "hex": [t.hex() for t in self.ranks]})
        for name, rows in (("merges", merges), ("tokens", tokens)):
            db.register("given", rows)
            db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            db.unregister("given")
        return db

    def code(self, pieces: list[bytes]) -> Iterator[tuple[str, str]]:
        """Ids of each piece as text, and in hexadecimal the bytes that these decode to."""
        for at in range(0, len(pieces), PIECES):
            some = pieces[at : at + PIECES]
            fixed = {i: [self.ranks[p]] if p in self.ranks else self.contract_long(p) for i, p in enumerate(some) if p in self.ranks or len(p) > LONG_PIECE}
            live = [i for i in range(len(some)) if i not in fixed]
            toks = np.concatenate([self.byte[np.frombuffer(b"".join([some[i] for i in live]), np.uint8)], *(np.array(x, np.int32) for x in fixed.values())])
            ends = np.cumsum([0, *(len(some[i]) for i in live), *map(len, fixed.values())]).astype(np.int32)
            w = np.array([*live, *fixed], np.int32)
            start = pa.table({"w": w, "toks": pa.ListArray.from_arrays(pa.array(ends), pa.array(toks)), "live": np.arange(len(w)) < len(live)})
            self._db.register("start", start)
            out = self._db.sql(_CODE).to_arrow_table()
            self._db.unregister("start")
            yield from zip(out.column("ids").to_pylist(), out.column("hex").to_pylist(), strict=True)

    def contract_long(self, piece: bytes) -> list[int]:
        """The same for one piece by a heap of pairs: n log n, where the query would take n steps of n rows."""
        n = len(piece)
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n

        def pair(i: int) -> int | None:
            return None if end[i] >= n else self.ranks.get(piece[i : end[end[i]]])

        heap = [(r, i, end[end[i]]) for i in range(n) if (r := pair(i)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            alive[end[i]] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
            for j in (before[i], i):
                if j >= 0 and (r := pair(j)) is not None:
                    heapq.heappush(heap, (r, j, end[end[j]]))
        return [self.ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def _learn(self, parts: Iterable[str], pieces: Iterable[str]) -> None:
        """Ids of new parts that are one piece with the space before them, and of new pieces."""
        parts = self._unknown(set(parts))
        fresh = [(self._parts, c, " " + c) for c in parts] + [(self._pieces, p, p) for p in pieces if p not in self._pieces]
        data = [p.encode() for _, _, p in fresh]
        for (kept, key, piece), d, (ids, decoded) in zip(fresh, data, self.code(data), strict=True):
            if decoded != d.hex():
                raise ValueError(f"ids of {piece!r} decode to something else")
            kept[key] = ids

    def _unknown(self, parts: set[str]) -> set[str]:
        """Parts that must be learned; of the others, those of the older generation move to the younger."""
        missing = parts - self._parts.keys()
        again = missing & self._old.keys()
        self._parts.update((c, self._old[c]) for c in again)
        return missing - again

    def _ids(self, pieces: list[str]) -> str:
        return " ".join([self._parts[p[1:]] if p[0] == " " else self._pieces[p] for p in pieces])

    def encode_texts(self, texts: list[str]) -> list[str]:
        """For each text its ids as decimal text."""
        whole = {t: self.pattern.findall(t) for t in texts if _INNER_SPACE.search(t)}
        split = {t: t.split(" ") for t in texts if t not in whole}
        inner = set().union(*(parts[1:] for parts in split.values())) if split else set()
        if len(self._parts) + len(inner) > CACHED:
            self._parts, self._old = {}, self._parts
        if len(self._pieces) > CACHED:
            self._pieces.clear()
        fresh = self._unknown(inner)
        cut = {c: self.pattern.findall(" " + c) for c in fresh if not c.isalpha()}
        first = {parts[0]: self.pattern.findall(parts[0]) for parts in split.values()}
        seen = set(chain.from_iterable(chain(whole.values(), cut.values(), first.values())))
        self._learn({*(c for c in fresh if c not in cut), *(p[1:] for p in seen if p[0] == " ")}, (p for p in seen if p[0] != " "))
        for c, pieces in cut.items():
            self._parts[c] = self._ids(pieces)
        ids_of = self._parts.__getitem__
        done: dict[str, str] = {t: self._ids(pieces) for t, pieces in whole.items()}
        for t, parts in split.items():
            ids = self._ids(first[parts[0]])
            done[t] = " ".join([ids, *map(ids_of, parts[1:])] if ids else map(ids_of, parts[1:]))
        return [done[t] for t in texts]

    def decode_ids(self, documents: list[np.ndarray]) -> list[bytes]:
        """The bytes of each document's ids, by ordered aggregation."""
        table, absent = pa.array(self.tokens, pa.string()), np.array([t is None for t in self.tokens])
        out = [b""] * len(documents)
        ends = np.cumsum([len(x) for x in documents])
        for part in np.split(np.arange(len(documents)), np.flatnonzero(np.diff(ends // DECODED)) + 1):
            lengths = [len(documents[i]) for i in part]
            if not sum(lengths):
                continue
            ids = np.concatenate([documents[i] for i in part]).astype(np.int32)
            if absent[ids].any():
                raise ValueError("an id is not in the vocabulary")
            token = pa.DictionaryArray.from_arrays(ids, table)
            self._db.register("coded", pa.table({"doc": np.repeat(part.astype(np.int32), lengths), "position": np.arange(len(ids), dtype=np.int32), "token": token}))
            got = self._db.sql(_DECODE).to_arrow_table()
            self._db.unregister("coded")
            for doc, data in zip(got.column("doc").to_pylist(), got.column("hex").to_pylist(), strict=True):
                out[doc] = bytes.fromhex(data)
        return out


#: One encoder a worker process, kept between tasks.
_MADE: dict[tuple[bytes, str], BytePairs] = {}


def _encoder(data: bytes, pattern: str) -> BytePairs:
    key = (hashlib.sha256(data).digest(), pattern)
    if key not in _MADE:
        _MADE[key] = BytePairs(parse_ranks(data), pattern)
    return _MADE[key]


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices with at most BLOCK_DOCS rows and BLOCK_BYTES of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
    start = size = 0
    for i, n in enumerate(sizes):
        if i > start and (size + n > BLOCK_BYTES or i - start >= BLOCK_DOCS):
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield batch.slice(start)


def bpe_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_tokens: bool = True) -> DataFrame:
    """The id, ids and decoded text (if kept), n_tokens and both digests of every document.

    ranks_path is read at the driver; its bytes, under 65536 tokens, are broadcast.
    """
    with open(ranks_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    names = [id_col, "ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256"]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _encoder(shared.value, pattern)
        for batch in chain.from_iterable(map(_blocks, batches)):
            out = pairs.encode_texts([t or "" for t in batch.column(1).to_pylist()])
            ids = [np.fromstring(i, np.int32, sep=" ") if i else np.zeros(0, np.int32) for i in out]
            decoded = pairs.decode_ids(ids)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(ids if keep_tokens else [None] * len(ids), pa.list_(pa.int32())),
                pa.array([d.decode() if keep_tokens else None for d in decoded], pa.string()), pa.array([len(i) for i in ids], pa.int64()),
                pa.array([hashlib.sha256(i.encode()).hexdigest() for i in out], pa.string()), pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string()),
            ], names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, ids array<int>, decoded string, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(encoded, schema)
