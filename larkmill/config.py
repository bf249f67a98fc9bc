"""Layered configuration on the driver, and the checks of configuration and template documents."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any


def merge_layers(*layers: Mapping[str, Any] | None) -> dict[str, Any]:
    """Later layers win; nested mappings are merged key by key. Layers are defaults, user, project, explicit, env."""
    out: dict[str, Any] = {}
    for layer in layers:
        for key, value in (layer or {}).items():
            both = isinstance(value, Mapping) and isinstance(out.get(key), Mapping)
            out[key] = merge_layers(out[key], value) if both else value
    return out


def flatten(config: Mapping[str, Any], prefix: str = "") -> list[tuple[str, str]]:
    """(dotted name, value as text) of every leaf, in order of name."""
    rows: list[tuple[str, str]] = []
    for key, value in config.items():
        name = f"{prefix}{key}"
        rows += flatten(value, f"{name}.") if isinstance(value, Mapping) else [(name, str(value))]
    return sorted(rows)


TYPES = {
    "object": dict, "array": list, "string": str, "integer": int, "number": (int, float), "boolean": bool,
}


def schema_errors(value: Any, schema: Mapping[str, Any], at: str = "$") -> list[str]:
    """What in a document breaks a JSON schema: type, enum, const, bounds, pattern, required, properties and items."""
    import re

    kind = schema.get("type")
    if kind and (not isinstance(value, TYPES[kind]) or (isinstance(value, bool) and kind in ("integer", "number"))):
        return [f"{at}: not of type {kind}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not one of the allowed values")
    if "const" in schema and value != schema["const"]:
        out.append(f"{at}: not the fixed value")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            out.append(f"{at}: below the minimum")
        if value > schema.get("maximum", value):
            out.append(f"{at}: over the maximum")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            out.append(f"{at}: too short")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{at}: doesn't match the pattern")
    if isinstance(value, list):
        if len(value) < schema.get("minItems", 0):
            out.append(f"{at}: too few items")
        for i, item in enumerate(value):
            out += schema_errors(item, schema.get("items", {}), f"{at}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{name}: missing" for name in schema.get("required", []) if name not in value]
        for name, item in value.items():
            if name in known:
                out += schema_errors(item, known[name], f"{at}.{name}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{name}: not allowed")
    return out
