"""UTF-8, base64, hex and JSON with the engine's strictness."""

from __future__ import annotations

import hmac
import json
import math
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_JSON_DEPTH = 64


def utf8_valid(data: Column) -> Column:
    return F.is_valid_utf8(data)


def utf8_length(text: Column) -> Column:
    return F.char_length(text)


def base64_strict(text: Column) -> Column:
    """Bytes of a base64 text; null unless it is well-formed with its padding."""
    sound = text.rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
    return F.when(sound, F.unbase64(text))


def hex_strict(text: Column) -> Column:
    """Bytes of a text of pairs of hexadecimal digits, else null."""
    return F.when(text.rlike("^(?:[0-9A-Fa-f]{2})*$"), F.unhex(text))


def same_secret(a: bytes, b: bytes) -> bool:
    return hmac.compare_digest(a, b)


def parse_json(text: str) -> Any:
    """Strict JSON; of a repeated key the last holds; NaN and infinities are no JSON."""

    def no(word: str):
        raise ValueError(f"{word} is no JSON")

    value = json.loads(text, parse_constant=no)
    if _depth(value) > MAX_JSON_DEPTH:
        raise ValueError("nested too deep")
    return value


def _depth(value: Any) -> int:
    depth, level = 0, [value]
    while level := [x for x in level if isinstance(x, (dict, list))]:
        depth += 1
        level = [y for x in level for y in (x.values() if isinstance(x, dict) else x)]
    return depth


def dump_json(value: Any) -> str:
    """Numbers that are not finite become null."""

    def clean(x: Any) -> Any:
        if isinstance(x, float) and not math.isfinite(x):
            return None
        if isinstance(x, dict):
            return {k: clean(v) for k, v in x.items()}
        return [clean(v) for v in x] if isinstance(x, list) else x

    return json.dumps(clean(value), ensure_ascii=False, separators=(",", ":"))
