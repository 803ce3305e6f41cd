"""Structured data of a page: JSON-LD, microdata and RDFa as nodes with their types and the text of their properties."""

from __future__ import annotations

import json
from collections.abc import Iterator

# Attributes that open a node, name its types and name a property; attributes that hold a property's value;
# properties of a nested node that stand for it.
VOCABULARIES = (("itemscope", "itemtype", "itemprop"), ("typeof", "typeof", "property"))
VALUES = ("content", "href", "src", "datetime", "value", "data")
NAMES = ("name", "headline", "title", "@id", "url")
#: Keys of a node that are no property.
KEYWORDS = {"@type", "@context", "@graph"}


def squeeze(text: str) -> str:
    return " ".join(text.split())


def local_name(raw: object) -> str:
    """The last part of a type or property that is given as a URL or with a prefix."""
    name = str(raw).strip()
    if name.startswith(("http://", "https://")):
        name = name[name.rfind("/") + 1 :]
    for mark in "#:":
        name = name[name.rfind(mark) + 1 :]
    return name.strip()


def types_of(node: dict) -> list[str]:
    raw = node.get("@type")
    several = raw if isinstance(raw, list) else [raw] if isinstance(raw, str) else []
    return [name for name in map(local_name, several) if name]


def objects(value: object) -> Iterator[dict]:
    """value, if it is an object, and all objects in it."""
    if isinstance(value, dict):
        yield value
        value = list(value.values())
    if isinstance(value, list):
        for item in value:
            yield from objects(item)


def text_of(value: object) -> str:
    """Text of a property: of a list its first text, of an object its name."""
    if isinstance(value, list):
        return next((t for t in map(text_of, value) if t), "")
    if isinstance(value, dict):
        return next((t for t in (text_of(value.get(n)) for n in NAMES) if t), "")
    return "" if value is None else str(value).strip()


def filled(value: object) -> bool:
    if isinstance(value, str):
        return bool(value.strip())
    return bool(value) if isinstance(value, (list, dict)) else value is not None


def rows(nodes: list[dict]) -> list[dict]:
    """Distinct nodes as types and fields: the text of each property that has a value, empty where the value has none."""
    once = {json.dumps(n, sort_keys=True): n for n in reversed(nodes)}
    return [{"types": types_of(n), "fields": {k: text_of(v) for k, v in n.items() if k not in KEYWORDS and filled(v)}} for n in reversed(once.values())]


class Markup:
    """Nodes of microdata and RDFa, followed while elements open and close; add() takes those of JSON-LD."""

    def __init__(self) -> None:
        self.nodes: list[dict] = []
        self.said: list[str] = []
        #: For each open element: nodes it opens, by attribute, the properties it gives, its value, and where its text starts.
        self.elements: list[tuple[dict, list, str, int]] = []

    def add(self, raw: str) -> None:
        """Nodes of a JSON-LD script; ValueError or RecursionError where it can't be read."""
        if raw.strip():
            self.nodes.extend(objects(json.loads(raw)))

    def opened(self, attrs: dict[str, str], void: bool) -> None:
        own, gives = {}, []
        for opens, types, gives_name in VOCABULARIES:
            holder = next((nodes[opens] for nodes, *_ in reversed(self.elements) if opens in nodes), None)
            if opens in attrs:
                names = list(dict.fromkeys(n for n in map(local_name, attrs.get(types, "").split()) if n))
                own[opens] = {"@type": names} if names else None
                if names:
                    self.nodes.append(own[opens])
            if holder is not None:
                gives += [(holder, name, own.get("itemscope") if gives_name == "itemprop" else None) for name in map(local_name, attrs.get(gives_name, "").split()) if name]
        value = next((v for v in (squeeze(attrs.get(n, "")) for n in VALUES) if v), "") if gives else ""
        self.elements.append((own, gives, value, len(self.said)))
        if void:
            self.closed()

    def closed(self) -> None:
        _, gives, value, start = self.elements.pop()
        for holder, name, nested in gives:
            found = nested or value or squeeze("".join(self.said[start:]))
            if not found:
                continue
            held = holder.setdefault(name, found)
            if held is found:
                continue
            several = held if isinstance(held, list) else [held]
            holder[name] = several if found in several else [*several, found]

    def finished(self) -> list[dict]:
        while self.elements:
            self.closed()
        return rows(self.nodes)
