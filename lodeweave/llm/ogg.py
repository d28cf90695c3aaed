"""Media columns: Ogg.

A payload is stored as two logical streams in one Ogg file: 8-bit samples, and a note with the rate and number of
samples.  read_ogg() verifies each page's checksum, reassembles packets from lacing values, demultiplexes the streams
by serial number and derives timestamps from granule positions.

Defined cases: a null text counts as empty; an empty text gives 64 zero bytes; equal texts give equal values in every
column but the id; a damaged file raises OggError when it is read.  Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.shared import as_bytes

BLOCK = 64
RATE = 8000
PACKET = 4000
#: An Ogg page has at most 255 lacing values.
PAGE_LACES = 255
SAMPLES, NOTES = 1, 2
_HEAD = struct.Struct("<4sBBqIIIB")
_CONTINUED, _FIRST, _LAST = 1, 2, 4
_FLIPPED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class OggError(ValueError):
    """The bytes aren't a sound Ogg file."""


def ogg_checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, bits not reflected, from 0 and not inverted.

    zlib computes the reflected kind, so the input's and the result's bits are flipped and its inversions undone.
    """
    crc = zlib.crc32(page.translate(_FLIPPED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_FLIPPED), "big")


def _page(flags: int, granule: int, serial: int, number: int, laces: list[int], body: bytes) -> bytes:
    page = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(laces)) + bytes(laces) + body
    return page[:22] + struct.pack("<I", ogg_checksum(page)) + page[26:]


def _pages(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """Pages of one logical stream.  packets: bytes and the granule position where each ends; the first is alone on its page."""
    out: list[bytes] = []
    laces: list[int] = []
    body: list[bytes] = []
    granule, carried = -1, False

    def flush(last: bool, opens: bool) -> None:
        nonlocal laces, body, granule, carried
        flags = _CONTINUED * carried | _FIRST * (not out) | _LAST * last
        out.append(_page(flags, granule, serial, len(out), laces, b"".join(body)))
        laces, body, granule, carried = [], [], -1, opens

    for k, (packet, at) in enumerate(packets):
        values = [255] * (len(packet) // 255) + [len(packet) % 255]
        start = 0
        for j, value in enumerate(values):
            if len(laces) == PAGE_LACES:
                flush(False, j > 0)
            laces.append(value)
            body.append(packet[start : start + value])
            start += value
        granule = at
        if k == 0 or k == len(packets) - 1:
            flush(k == len(packets) - 1, False)
    return out


def write_ogg(payload: bytes, rate: int = RATE, packet: int = PACKET) -> bytes:
    """payload as 8-bit samples, beside a note stream; pages of the two are interleaved."""
    samples = [(b"PCM8" + struct.pack("<I", rate), 0)]
    samples += [(payload[i : i + packet], min(i + packet, len(payload))) for i in range(0, len(payload), packet)]
    notes = [(b"NOTE", 0), (b"samples=%d;rate=%d" % (len(payload), rate), len(payload))]
    first, second = _pages(SAMPLES, samples), _pages(NOTES, notes)
    return b"".join([first[0], second[0], *first[1:-1], *second[1:], *first[-1:]])


@dataclass
class LogicalStream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    #: Granule positions of the pages on which a packet ends.
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    _open: list[bytes] = field(default_factory=list)

    def seconds(self, rate: int) -> list[float]:
        """When each page's last packet ends."""
        return [g / rate for g in self.granules]


def read_ogg(data: bytes) -> dict[int, LogicalStream]:
    """The logical streams by serial number, after all checks."""
    streams: dict[int, LogicalStream] = {}
    at = 0
    while at < len(data):
        if len(data) < at + _HEAD.size:
            raise OggError(f"a page header is cut off at byte {at}")
        mark, version, flags, granule, serial, number, crc, count = _HEAD.unpack_from(data, at)
        if mark != b"OggS" or version:
            raise OggError(f"no page begins at byte {at}")
        body = at + _HEAD.size + count
        laces = data[at + _HEAD.size : body]
        end = body + sum(laces)
        if len(laces) < count or end > len(data):
            raise OggError(f"the page at byte {at} is cut off")
        if ogg_checksum(data[at : at + 22] + bytes(4) + data[at + 26 : end]) != crc:
            raise OggError(f"the page at byte {at} fails its checksum")
        if bool(flags & _FIRST) != (serial not in streams):
            raise OggError(f"stream {serial} begins twice or not at all")
        stream = streams.setdefault(serial, LogicalStream(serial))
        if number != stream.pages or stream.ended:
            raise OggError(f"page {number} of stream {serial} is out of order")
        if bool(flags & _CONTINUED) != bool(stream._open):
            raise OggError(f"page {number} of stream {serial} continues the wrong packet")
        stream.pages += 1
        ends = False
        for value in laces:
            stream._open.append(data[body : body + value])
            body += value
            if value < 255:
                stream.packets.append(b"".join(stream._open))
                stream._open.clear()
                ends = True
        if ends != (granule >= 0):
            raise OggError(f"page {number} of stream {serial} has a wrong granule position")
        if ends:
            if stream.granules and granule < stream.granules[-1]:
                raise OggError(f"granule positions of stream {serial} fall")
            stream.granules.append(granule)
        stream.ended = bool(flags & _LAST)
        at = end
    if any(s._open or not s.ended for s in streams.values()):
        raise OggError("a stream has no end")
    return streams


def read_payload(data: bytes) -> tuple[bytes, dict[int, LogicalStream], int]:
    """The samples of a file from write_ogg(), its streams and its rate."""
    streams = read_ogg(data)
    if SAMPLES not in streams or NOTES not in streams:
        raise OggError("a logical stream is missing")
    head, *packets = streams[SAMPLES].packets
    if head[:4] != b"PCM8":
        raise OggError("the sample stream has no header")
    rate = struct.unpack("<I", head[4:8])[0]
    payload = b"".join(packets)
    if streams[NOTES].packets[1] != b"samples=%d;rate=%d" % (len(payload), rate) or streams[SAMPLES].granules[-1] != len(payload):
        raise OggError("the note doesn't fit the samples")
    return payload, streams, rate


def audio_features(payload: bytes, streams: dict[int, LogicalStream], rate: int) -> str:
    """Duration, pages, packets and the last page's timestamp; mean, deviation and crossings of the mean."""
    x = np.frombuffer(payload, np.uint8)
    mean = float(x.mean())
    above = x > mean
    crossings = int(np.count_nonzero(above[1:] != above[:-1]))
    stream = streams[SAMPLES]
    return f"seconds={len(payload) / rate:.6f};pages={stream.pages};packets={len(stream.packets)};last={stream.seconds(rate)[-1]:.6f};mean={mean:.6f};deviation={float(x.std()):.6f};crossings={crossings}"


def ogg_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """id, n_bytes, media (the stored file, if kept) and what was read back from it."""
    names = [id_col, "n_bytes", "media", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in as_bytes(batch.column(1)):
                media = write_ogg(text + bytes(max(BLOCK, -(-len(text) // BLOCK) * BLOCK) - len(text)))
                payload, streams, rate = read_payload(media)
                rows.append((len(text), media if keep_media else None, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), audio_features(payload, streams, rate)))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(id_col, F.col(text_col).cast("string").alias(text_col)).mapInArrow(stored, schema)
