"""Frontmatter: the YAML block between two ``---`` lines, and what it declares."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from ..errors import FrontmatterError, UnreadableDocument
from ..functions.batches import slices
from . import yaml12

LAYERS = ("design", "technical", "production")
AUTHORITIES = ("binding", "derived", "exploratory")
#: Keys that only a node would have; with one of these but no id, a document is a mistake.
INTENT = ("authority", "derives_from", "tickets")
KEYS = ("id", "title", "layer", "authority", "derives_from", "tickets")
_CONTROL = re.compile(r"[\x00-\x1f\x7f-\x9f]")

PARSED = (
    "path string, disposition string, reused_anchors boolean, id string, title string, layer string, authority string, tickets array<string>, "
    "derives_from array<struct<ref:string,seen:string>>, body string, error_code string, error_message string"
)
_ARROW = pa.schema(
    [
        ("path", pa.string()),
        ("disposition", pa.string()),
        ("reused_anchors", pa.bool_()),
        ("id", pa.string()),
        ("title", pa.string()),
        ("layer", pa.string()),
        ("authority", pa.string()),
        ("tickets", pa.list_(pa.string())),
        ("derives_from", pa.list_(pa.struct([("ref", pa.string()), ("seen", pa.string())]))),
        ("body", pa.string()),
        ("error_code", pa.string()),
        ("error_message", pa.string()),
    ]
)


@dataclass(frozen=True)
class Parts:
    """Every piece of a document; together they are the text again."""

    prefix: str
    open_fence: str
    meta: str
    close_fence: str
    newline: str
    body: str

    def text(self, meta: str | None = None) -> str:
        return f"{self.prefix}{self.open_fence}\n{self.meta if meta is None else meta}{self.close_fence}{self.newline}{self.body}"


def decode(data: bytes, path: str) -> str:
    """Strict UTF-8, with newlines normalised."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError as error:
        raise UnreadableDocument(f"{path!r} is not UTF-8: {error.reason} at byte {error.start}", path) from error
    return text.replace("\r\n", "\n").replace("\r", "\n")


def split(text: str, path: str) -> Parts | None:
    """None if the first line, after byte order marks, is no fence. Raises if the block isn't closed."""
    rest = text.lstrip("﻿")
    first, newline, after = rest.partition("\n")
    if first.strip() != "---":
        return None
    at = 0
    while newline and at <= len(after):
        end = after.find("\n", at)
        line = after[at:] if end < 0 else after[at:end]
        if line.strip() == "---":
            return Parts(text[: len(text) - len(rest)], first, after[:at], line, "" if end < 0 else "\n", "" if end < 0 else after[end + 1 :])
        if end < 0:
            break
        at = end + 1
    raise UnreadableDocument(f"the frontmatter of {path!r} has no closing '---'", path)


def _text(problems: list[str], where: str, value: object, null: bool = True) -> str | None:
    if value is None and null:
        return None
    if not isinstance(value, str):
        problems.append(f"{where}: must be a string")
        return None
    if m := _CONTROL.search(value):
        problems.append(f"{where}: has the control character U+{ord(m[0]):04X} at {m.start()}")
    return value


def _list(problems: list[str], where: str, value: object) -> list:
    if not isinstance(value, list):
        problems.append(f"{where}: must be a list")
        return []
    return value


def validate(data: dict) -> tuple[dict, list[str]]:
    """(the node's fields, what is wrong with them). Types are strict: nothing is converted."""
    wrong: list[str] = []
    for key in data:
        if key not in KEYS:
            wrong.append(f"{key}: unknown key; there are {', '.join(KEYS)}")
    node: dict = {"id": _text(wrong, "id", data.get("id"), null=False), "title": _text(wrong, "title", data.get("title"))}
    if node["id"] and "#" in node["id"]:
        wrong.append("id: must not have '#'")
    for key, domain in (("layer", LAYERS), ("authority", AUTHORITIES)):
        value = data.get(key)
        if value is not None and not (isinstance(value, str) and value in domain):
            wrong.append(f"{key}: must be one of {', '.join(domain)}")
        node[key] = value
    node["tickets"] = [_text(wrong, f"tickets.{i}", x, null=False) for i, x in enumerate(_list(wrong, "tickets", data.get("tickets", [])))]
    node["derives_from"] = []
    for i, edge in enumerate(_list(wrong, "derives_from", data.get("derives_from", []))):
        if not isinstance(edge, dict):
            wrong.append(f"derives_from.{i}: must be a mapping of ref and seen")
            continue
        for key in edge:
            if key not in ("ref", "seen"):
                wrong.append(f"derives_from.{i}.{key}: unknown key; there are ref, seen")
        node["derives_from"].append({"ref": _text(wrong, f"derives_from.{i}.ref", edge.get("ref"), null=False), "seen": _text(wrong, f"derives_from.{i}.seen", edge.get("seen"))})
    return node, wrong


def parse(meta: str | None, path: str) -> dict:
    """``disposition`` 'tracked' with the node's fields, 'id-less' (metadata of something else) or 'untracked'."""
    if meta is None:
        return {"disposition": "untracked"}
    try:
        data, reused = yaml12.load(meta)
    except yaml12.LOAD_ERRORS as error:
        raise UnreadableDocument(f"cannot parse the frontmatter of {path!r}: {' '.join(str(error).split())!r}", path) from error
    if not isinstance(data, dict):
        return {"disposition": "untracked"}
    if "id" not in data:
        if intent := [k for k in INTENT if k in data]:
            raise FrontmatterError(f"{path!r} declares {', '.join(map(repr, intent))} but has no 'id'", path)
        return {"disposition": "id-less"}
    node, wrong = validate(data)
    if wrong:
        raise FrontmatterError(f"invalid frontmatter in {path!r}:\n" + "\n".join(f"  {w}" for w in wrong), path)
    return node | {"disposition": "tracked", "reused_anchors": reused}


def parse_document(path: str, data: bytes) -> dict:
    """A row of PARSED. What is wrong with a document is part of its row; who reads all rows can raise the first by path."""
    try:
        text = decode(data, path)
        parts = split(text, path)
        return {"path": path, "body": text if parts is None else parts.body, "reused_anchors": False} | parse(None if parts is None else parts.meta, path)
    except (UnreadableDocument, FrontmatterError) as error:
        return {"path": path, "error_code": error.code, "error_message": str(error)}


def parsed(files: DataFrame) -> DataFrame:
    """PARSED of (path, content), a narrow transformation. Null content counts as an empty file."""

    def run(batches):
        for part in (x for batch in batches for x in slices(batch, "content")):
            rows = [parse_document(p, c or b"") for p, c in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return files.select("path", "content").mapInArrow(run, PARSED)
