"""Settings from the environment: LODEWEAVE_ and the setting's name in capitals."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from datetime import datetime
from email.utils import parsedate_to_datetime

from lodeweave.functions.text import InputError

PREFIX = "LODEWEAVE_"
# Default, least, most, whether whole.
SETTINGS: dict[str, tuple[float, float, float, bool]] = {
    "search_timeout_ms": (10_000, 1, 3_600_000, True),
    "grep_timeout_ms": (5_000, 1, 3_600_000, True),
    "max_distance": (1, 0, 2, False),
    "bulk_index_threshold": (2_000, 0, 1_000_000_000, True),
    "max_resource_blob_bytes": (12_582_912, 1, 1_073_741_824, True),
    "resource_page": (100, 1, 1_000, True),
    "watch_ms": (3_000, 50, 3_600_000, True),
    "embed_timeout_ms": (30_000, 1, 3_600_000, True),
    "embed_max_attempts": (6, 1, 10, True),
    "embed_retry_max_ms": (120_000, 1, 3_600_000, True),
    "upload_max_bytes": (33_554_432, 1_024, 268_435_456, True),
    "upload_max_files": (20, 1, 200, True),
    "local_embed_timeout_ms": (30_000, 1, 3_600_000, True),
    "ocr_timeout_ms": (60_000, 1, 3_600_000, True),
    "ocr_document_timeout_ms": (300_000, 1, 3_600_000, True),
    "ocr_max_pages": (200, 1, 10_000, True),
}


def number(name: str, environment: Mapping[str, str] | None = None) -> float:
    """A setting's value; InputError if the environment has one that can't be used."""
    default, least, most, whole = SETTINGS[name]
    text = (os.environ if environment is None else environment).get(PREFIX + name.upper())
    if text is None:
        return int(default) if whole else default
    kind = "a whole number" if whole else "a number"
    try:
        value = float(text)
    except ValueError:
        value = float("nan")
    if not least <= value <= most or (whole and value != int(value)):
        raise InputError(f"{PREFIX}{name.upper()} must be {kind} from {least:g} to {most:g}")
    return int(value) if whole else value


def check(environment: Mapping[str, str] | None = None) -> dict[str, float]:
    """All settings, or the first fault."""
    return {name: number(name, environment) for name in SETTINGS}


def retry_after_ms(header: str | None, now: datetime) -> int | None:
    """A Retry-After header, seconds or a date, in milliseconds; None if there is none that can be read."""
    text = (header or "").strip()
    if not text:
        return None
    if re.fullmatch(r"\d+(\.\d+)?", text):
        return round(float(text) * 1000)
    try:
        return max(0, round((parsedate_to_datetime(text) - now).total_seconds() * 1000))
    except (TypeError, ValueError):
        return None
