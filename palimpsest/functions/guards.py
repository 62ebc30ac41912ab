"""A guard on JSON schemas that callers may ask model answers to follow: a small subset, bounded in size."""

from __future__ import annotations

import json
from typing import Any

# The keywords and types a schema may use, and its limits (levels, properties of one object, UTF-8 bytes).
KEYWORDS = {"type", "properties", "items", "required", "additionalProperties", "enum", "description"}
TYPES = {"object", "array", "string", "integer", "number", "boolean"}
MAX_DEPTH, MAX_PROPERTIES, MAX_BYTES = 5, 40, 16384


def _complaint(node: Any, depth: int) -> str | None:
    """What is wrong with one node by itself."""
    if depth > MAX_DEPTH:
        return f"there are more than {MAX_DEPTH} levels"
    if not isinstance(node, dict):
        return "a schema is an object"
    if unknown := sorted(set(node) - KEYWORDS):
        return f"{unknown[0]!r} is no keyword of the subset"
    kind = node.get("type")
    if not isinstance(kind, str) or kind not in TYPES:
        return f"type must be one of {', '.join(sorted(TYPES))}"
    inner = node.get("properties", {})
    if not isinstance(inner, dict):
        return "properties are an object of schemas"
    if len(inner) > MAX_PROPERTIES:
        return f"one object has {len(inner)} properties, {MAX_PROPERTIES} are accepted"
    return None


def check_schema(schema: str | dict) -> dict:
    """The parsed schema, or ValueError: every node names one type; properties and items are schemas in turn."""
    text = schema if isinstance(schema, str) else json.dumps(schema, ensure_ascii=False)
    if not text.strip():
        raise ValueError("no schema given")
    if (size := len(text.encode())) > MAX_BYTES:
        raise ValueError(f"{size} bytes of schema, {MAX_BYTES} are accepted")
    root = json.loads(text)
    todo = [("schema", root, 0)]
    while todo:
        path, node, depth = todo.pop()
        if wrong := _complaint(node, depth):
            raise ValueError(f"{path}: {wrong}")
        todo += [(f"{path}.{name}", child, depth + 1) for name, child in node.get("properties", {}).items()]
        if "items" in node:
            todo.append((f"{path}[]", node["items"], depth + 1))
    return root
