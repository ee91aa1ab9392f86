"""Rule and fixture files: safe YAML, strict where a document's exact content decides."""

from __future__ import annotations

import json
from pathlib import Path

import yaml

MAX_BYTES, MAX_DEPTH, MAX_NODES = 65_536, 12, 512


class DocumentError(ValueError):
    pass


class _Strict(yaml.SafeLoader):
    """No repeated keys, anchors, aliases, tags of their own or merge keys; timestamps stay text."""

    def compose_node(self, parent, index):
        if self.check_event(yaml.AliasEvent) or getattr(self.peek_event(), "anchor", None):
            raise DocumentError("anchors and aliases are not allowed")
        if getattr(self.peek_event(), "tag", None):
            raise DocumentError("tags are not allowed")
        return super().compose_node(parent, index)

    def construct_mapping(self, node, deep=False):
        keys = [self.construct_object(k, deep=True) for k, _ in node.value]
        if any(not isinstance(k, str) for k in keys) or "<<" in keys:
            raise DocumentError("keys must be plain texts")
        if len(set(keys)) != len(keys):
            raise DocumentError("a key repeats")
        return {k: self.construct_object(v, deep=True) for k, (_, v) in zip(keys, node.value)}


_Strict.yaml_implicit_resolvers = {c: [(t, r) for t, r in rs if t not in ("tag:yaml.org,2002:timestamp", "tag:yaml.org,2002:merge")] for c, rs in yaml.SafeLoader.yaml_implicit_resolvers.items()}
_Strict.add_constructor("tag:yaml.org,2002:map", lambda loader, node: loader.construct_mapping(node, deep=True))


def _measure(value, depth: int = 1) -> int:
    if depth > MAX_DEPTH:
        raise DocumentError(f"nested deeper than {MAX_DEPTH}")
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return 1 + sum(_measure(v, depth + 1) for v in inner)


def parse_strict(text: str) -> dict:
    """One mapping, within the bounds of size, depth and number of nodes."""
    if len(text.encode()) > MAX_BYTES:
        raise DocumentError(f"more than {MAX_BYTES} bytes")
    try:
        docs = list(yaml.load_all(text, _Strict))
    except yaml.YAMLError as e:
        raise DocumentError(str(e)) from e
    if len(docs) != 1 or not isinstance(docs[0], dict):
        raise DocumentError("one mapping is expected")
    if _measure(docs[0]) > MAX_NODES:
        raise DocumentError(f"more than {MAX_NODES} nodes")
    return docs[0]


def load_directory(path: str | Path, strict: bool = False) -> list[dict]:
    """All ``*.yml`` below a folder, by name; any error rejects the whole set."""
    files = sorted(Path(path).rglob("*.yml"))
    if not files:
        raise DocumentError(f"no rules in {path}")
    return [parse_strict(f.read_text()) if strict else yaml.safe_load(f.read_text()) for f in files]


def shipped(kind: str) -> list[dict]:
    """The rules that come with the package: ``detection`` or ``correlation``."""
    return load_directory(Path(__file__).parent.parent / "rules" / kind, strict=kind == "correlation")


def fixture(text: str, keys: set[str]) -> dict:
    """A fixture's JSON object: no repeated keys, no unknown ones."""

    def pairs(items):
        if len({k for k, _ in items}) != len(items):
            raise DocumentError("a key repeats")
        return dict(items)

    doc = json.loads(text, object_pairs_hook=pairs)
    if not isinstance(doc, dict) or set(doc) - keys:
        raise DocumentError("unknown keys in a fixture")
    return doc


def fixtures(spark, path: str | Path, keys: set[str], schema: str):
    """All ``*.json`` fixtures of a folder, by name, as rows; any error rejects the whole bundle."""
    files = sorted(Path(path).glob("*.json"))
    if not files:
        raise DocumentError(f"no fixtures in {path}")
    return spark.createDataFrame([fixture(f.read_text(), keys) for f in files], schema)
