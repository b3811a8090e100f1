"""Configurations that inherit: a mapping's _base names one or more others; the child wins, mappings merge, lists are replaced."""

from __future__ import annotations

from typing import Any


def merge(base: dict[str, Any], child: dict[str, Any]) -> dict[str, Any]:
    out = dict(base)
    for k, v in child.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def resolve(name: str, configs: dict[str, dict[str, Any]], above: tuple[str, ...] = ()) -> dict[str, Any]:
    """The configuration of a name with all it inherits."""
    if name in above:
        raise ValueError("configurations inherit from one another: " + " > ".join([*above, name]))
    own = configs[name]
    bases = own.get("_base", [])
    out: dict[str, Any] = {}
    for b in [bases] if isinstance(bases, str) else bases:
        out = merge(out, resolve(b, configs, (*above, name)))
    return merge(out, {k: v for k, v in own.items() if k != "_base"})
