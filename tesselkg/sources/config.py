"""Configuration trees from YAML or JSON files (driver side)."""

from __future__ import annotations

import json
from pathlib import Path

try:
    import yaml
except ImportError:  # JSON only
    yaml = None


def load(path: str) -> dict:
    """A configuration by its extension; an empty file is an empty tree."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        if yaml is None:
            raise RuntimeError("YAML is not installed; use JSON")
        return yaml.safe_load(text) or {}
    if path.endswith(".json"):
        return json.loads(text or "{}")
    raise ValueError(f"unknown kind of configuration: {path}")


def save(tree: dict, path: str) -> None:
    text = yaml.safe_dump(tree, sort_keys=False) if yaml and path.endswith((".yaml", ".yml")) else json.dumps(tree, indent=2)
    Path(path).write_text(text, encoding="utf-8")


def merge(base: dict, over: dict) -> dict:
    """``over`` wins; trees are merged only where both sides are trees."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def apply_preset(tree: dict, presets: dict, path: str, name: str) -> dict:
    """The tree with the named preset under ``path`` (dots between keys); what the tree says itself wins."""
    if name not in presets:
        raise ValueError(f"no preset {name!r}; there are {sorted(presets)}")
    inner = presets[name]
    for key in reversed(path.split(".")):
        inner = {key: inner}
    return merge(inner, tree)


def validate(tree: dict, required: dict[str, type | tuple[type, ...]]) -> list[str]:
    """What is missing or of another type, one message per dotted path; none for a valid tree."""
    faults = []
    for path, kind in required.items():
        at = tree
        for key in path.split("."):
            at = at.get(key) if isinstance(at, dict) else None
        if at is None:
            faults.append(f"{path} is missing")
        elif not isinstance(at, kind) or (isinstance(at, bool) and kind is not bool):
            faults.append(f"{path} is a {type(at).__name__}")
    return faults
