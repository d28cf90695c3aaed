"""Skill files: a YAML head with checked fields, and a body."""

from __future__ import annotations

import re
from collections.abc import Callable, Collection
from dataclasses import dataclass
from typing import Any

import yaml

# Fixed values of the skill format.
NAME = re.compile(r"[a-z0-9]+(?:-[a-z0-9]+)*")
LIMITS = {"name": 64, "description": 1024, "compatibility": 500}
KEYS = ("name", "description", "license", "allowed-tools", "metadata", "compatibility")
RESERVED = ("anthropic", "claude")

_HEAD = re.compile("﻿?---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\\Z)", re.S)
_TAG = re.compile(r"</?[A-Za-z][^>]*>")


class SkillError(ValueError):
    """issues: everything that is wrong."""

    def __init__(self, issues: list[str]) -> None:
        super().__init__("; ".join(issues))
        self.issues = issues


@dataclass(frozen=True)
class Skill:
    name: str
    description: str
    allowed_tools: list[str] | None
    compatibility: str | None
    license: str | None
    metadata: dict[str, Any] | None
    body: str
    raw: str


def tokenize_tools(tools: str) -> list[str]:
    """Split at commas and spaces outside of parentheses."""
    out, depth, word = [], 0, ""
    for c in tools + " ":
        if depth == 0 and (c == "," or c.isspace()):
            out += [word] if word else []
            word = ""
            continue
        depth = max(0, depth + (c == "(") - (c == ")"))
        word += c
    return [*out, word.strip()] if word.strip() else out


def _text_issues(key: str, value: Any, required: bool) -> list[str]:
    if not isinstance(value, str) or (required and not value.strip()):
        return [f"{key} must be a {'non-empty ' if required else ''}string"]
    issues = [f"{key} has {len(value)} characters; the limit is {LIMITS[key]}"] if len(value) > LIMITS[key] else []
    return issues + ([f"{key} must not contain XML tags"] if _TAG.search(value) else [])


def frontmatter_issues(head: dict[str, Any], reserved: Collection[str] = RESERVED, lenient: bool = False, warn: Callable[[str], None] | None = None) -> list[str]:
    issues: list[str] = []
    for key in head:
        if key not in KEYS:
            (warn or (lambda _: None))(f"unknown key {key!r} is ignored") if lenient else issues.append(f"unknown key {key!r}")
    name = head.get("name")
    issues += _text_issues("name", name, True)
    if isinstance(name, str) and name.strip():
        issues += [] if NAME.fullmatch(name) else [f"name {name!r} may have only a-z, 0-9 and, between these, one - at a time"]
        issues += [f"name has the reserved word {w!r}" for w in reserved if w in name.lower().split("-")]
    issues += _text_issues("description", head.get("description"), True)
    if "compatibility" in head:
        issues += _text_issues("compatibility", head["compatibility"], False)
    tools = head.get("allowed-tools")
    if "allowed-tools" in head and not (isinstance(tools, str) or (isinstance(tools, list) and all(isinstance(t, str) for t in tools))):
        issues.append("allowed-tools must be a list of strings or a string")
    if "license" in head and not isinstance(head["license"], str):
        issues.append("license must be a string")
    if "metadata" in head and not isinstance(head["metadata"], dict):
        issues.append("metadata must be a mapping")
    return issues


def strip_frontmatter(raw: str) -> str:
    found = _HEAD.match(raw)
    return raw[found.end() :] if found else raw


def parse_skill(raw: str, allow_reserved: bool = False, lenient: bool = False, warn: Callable[[str], None] | None = None) -> Skill:
    found = _HEAD.match(raw)
    if not found:
        raise SkillError(["no YAML head between --- lines"])
    try:
        head = yaml.safe_load(found[1])
    except yaml.YAMLError as e:
        raise SkillError([f"the head isn't valid YAML: {e}"]) from None
    if not isinstance(head, dict):
        raise SkillError(["the head must be a mapping"])
    if issues := frontmatter_issues(head, () if allow_reserved else RESERVED, lenient, warn):
        raise SkillError(issues)
    tools = head.get("allowed-tools")
    compatibility = head.get("compatibility")
    return Skill(head["name"].strip(), head["description"].strip(), tokenize_tools(tools) if isinstance(tools, str) else tools, compatibility.strip() if compatibility else compatibility, head.get("license"), head.get("metadata"), raw[found.end() :].strip(), raw)
