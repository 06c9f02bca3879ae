"""YAML with version 1.2 typing on top of PyYAML: ``on`` and ``yes`` are strings, ``12:30:00`` too, keys are unique.

A ``%YAML 1.1`` directive brings the older typing back. An anchor name that is defined twice is rebound, and reported.
"""

from __future__ import annotations

import re
from typing import Any

import yaml

_V11 = re.compile(r"\A(?:[ \t]*(?:#[^\n]*)?\n|%(?!YAML)[^\n]*\n)*%YAML[ \t]+1\.1\b")


class _Shared:
    reused = False

    def compose_node(self, parent, index):
        event = self.peek_event()
        anchor = getattr(event, "anchor", None)
        if anchor is not None and not isinstance(event, yaml.AliasEvent) and anchor in self.anchors:
            del self.anchors[anchor]
            self.reused = True
        return super().compose_node(parent, index)

    def construct_mapping(self, node, deep=False):
        if isinstance(node, yaml.MappingNode):
            seen = set()
            for key, _ in node.value:
                if key.tag == "tag:yaml.org,2002:merge":
                    continue
                name = self.construct_object(key, deep=True)
                if isinstance(name, (list, dict)):
                    raise yaml.constructor.ConstructorError(None, None, "a key must be a scalar", key.start_mark)
                if name in seen:
                    raise yaml.constructor.ConstructorError(None, None, f"duplicate key {name!r}", key.start_mark)
                seen.add(name)
        return super().construct_mapping(node, deep)


class Loader11(_Shared, yaml.SafeLoader):
    """Version 1.1 typing."""


class Loader12(_Shared, yaml.SafeLoader):
    """Version 1.2 core schema, besides timestamps and the merge key."""

    yaml_implicit_resolvers: dict = {}


for _tag, _pattern, _first in (
    ("bool", r"(?:true|True|TRUE|false|False|FALSE)\Z", "tTfF"),
    ("int", r"(?:[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+)\Z", "-+0123456789"),
    ("float", r"(?:[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))\Z", "-+.0123456789"),
    ("null", r"(?:~|null|Null|NULL|)\Z", ["~", "n", "N", ""]),
    ("merge", r"<<\Z", "<"),
    ("timestamp", r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?:(?:[Tt]|[ \t]+)[0-9]{1,2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]*)?(?:[ \t]*(?:Z|[-+][0-9]{1,2}(?::[0-9]{2})?))?)?\Z", "0123456789"),
):
    Loader12.add_implicit_resolver(f"tag:yaml.org,2002:{_tag}", re.compile(_pattern), list(_first))


def _omap(loader, node):
    out: dict = {}
    yield out
    if not isinstance(node, yaml.SequenceNode):
        raise yaml.constructor.ConstructorError(None, None, "an ordered map is written as a sequence", node.start_mark)
    for item in node.value:
        if not isinstance(item, yaml.MappingNode) or len(item.value) != 1:
            raise yaml.constructor.ConstructorError(None, None, "an ordered map's items have one key", item.start_mark)
        key, value = item.value[0]
        out[loader.construct_object(key, deep=True)] = loader.construct_object(value, deep=True)


def _int(loader, node):
    text = loader.construct_scalar(node)
    sign, digits = (-1, text[1:]) if text[0] == "-" else (1, text.lstrip("+"))
    return sign * int(digits, 8 if digits[:2] == "0o" else 16 if digits[:2] == "0x" else 10)


def _float(loader, node):
    text = loader.construct_scalar(node).lower()
    return float(text.replace(".inf", "inf").replace(".nan", "nan"))


for _loader in (Loader11, Loader12):
    _loader.add_constructor("tag:yaml.org,2002:omap", _omap)
Loader12.add_constructor("tag:yaml.org,2002:int", _int)
Loader12.add_constructor("tag:yaml.org,2002:float", _float)

#: What an invalid document may raise, from scanner to constructor.
LOAD_ERRORS = (yaml.YAMLError, ValueError, TypeError, KeyError, AttributeError, RecursionError)


def loader_for(text: str) -> type:
    return Loader11 if _V11.match(text) else Loader12


def load(text: str) -> tuple[Any, bool]:
    """(the single document's value, whether an anchor name was defined more than once)."""
    loader = loader_for(text)(text)
    try:
        return loader.get_single_data(), loader.reused
    finally:
        loader.dispose()


def load_events(events: list[yaml.Event], loader: type) -> Any:
    """The single document's value from all events of its text, which isn't scanned again."""
    left = events[::-1]
    replay = loader("")
    replay.peek_event = lambda: left[-1] if left else None
    replay.get_event = lambda: left.pop() if left else None
    replay.check_event = lambda *kinds: bool(left) and (not kinds or isinstance(left[-1], kinds))
    try:
        return replay.get_single_data()
    finally:
        replay.dispose()


def compose(text: str) -> yaml.Node | None:
    """The node tree of the single document, aliases resolved to the nodes they name."""
    loader = loader_for(text)(text)
    try:
        return loader.get_single_node()
    finally:
        loader.dispose()
