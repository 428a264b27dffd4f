"""JSON whose every key is expected, present once, and of its type."""

from __future__ import annotations

import json


class BadJson(ValueError):
    pass


def _unique(pairs):
    out = dict(pairs)
    if len(out) != len(pairs):
        raise BadJson("repeated key")
    return out


def _refuse(name):
    raise BadJson(name)


def _depth(value, left: int) -> None:
    if left < 0:
        raise BadJson("too deep")
    for child in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
        _depth(child, left - 1)


def loads(payload: bytes, most_bytes: int, depth: int = 32):
    """One bounded document of UTF-8, with nothing after it."""
    if not payload or len(payload) > most_bytes:
        raise BadJson("size")
    try:
        value = json.loads(payload.decode("utf-8"), object_pairs_hook=_unique, parse_constant=_refuse)
        _depth(value, depth)
    except (UnicodeDecodeError, json.JSONDecodeError, RecursionError):
        raise BadJson("malformed") from None
    return value


def shaped(value, shape: dict) -> dict:
    """``value`` if its keys are exactly those of ``shape`` and each value has its type. Integers aren't booleans."""
    if not isinstance(value, dict) or value.keys() != shape.keys():
        raise BadJson("keys")
    for key, kind in shape.items():
        if not isinstance(value[key], kind) or (kind is int and isinstance(value[key], bool)):
            raise BadJson("type")
    return value
