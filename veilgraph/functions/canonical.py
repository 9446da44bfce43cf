"""Canonical JSON that keeps every decimal's written form.

Spark's VARIANT, `get_json_object` and `from_json` turn 4.20 into 4.2, so documents stay
strings and pass through this codec.
"""

from __future__ import annotations

import json
import re
from decimal import Decimal

_quoted = json.encoder.encode_basestring  # escapes what JSON demands and no more


class BadJson(ValueError):
    """The text is no strict JSON; the message never quotes it."""


def _no_constant(_: str):
    raise BadJson("a number is not finite")


def _distinct(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise BadJson("a name is repeated")
    return out


_decoder = json.JSONDecoder(parse_float=Decimal, parse_constant=_no_constant, object_pairs_hook=_distinct)


def parse(text: str):
    """The value of a strict JSON text: decimals as Decimal, integers as int."""
    try:
        value = _decoder.decode(text)
        text.encode()
        if "\\ud" in text or "\\uD" in text:  # an escaped lone surrogate decodes to what UTF-8 can't hold
            render(value).encode()
    except BadJson:
        raise
    except (ValueError, RecursionError):
        raise BadJson("invalid JSON") from None
    return value


def _object(value: dict) -> str:
    # strings, which are most of all, need no call
    return "{" + ",".join([f"{_quoted(name)}:{_quoted(v) if type(v := value[name]) is str else _RENDER[type(v)](v)}" for name in sorted(value)]) + "}"


def _decimal(value: Decimal) -> str:
    if not value.is_finite():
        raise BadJson("a number is not finite")
    return str(value)


_RENDER = {
    str: _quoted,
    Decimal: _decimal,
    dict: _object,
    list: lambda value: "[" + ",".join([_RENDER[type(v)](v) for v in value]) + "]",
    tuple: lambda value: "[" + ",".join([_RENDER[type(v)](v) for v in value]) + "]",
    int: str,
    bool: lambda value: "true" if value else "false",
    type(None): lambda value: "null",
}


class _Encoder(json.JSONEncoder):
    """The library's encoder, which is compiled, with a mark for each decimal, as it would write these by its own rules."""

    def __init__(self):
        super().__init__(ensure_ascii=False, check_circular=False, allow_nan=False, sort_keys=True, separators=(",", ":"))
        self.decimals: list[str] = []

    def default(self, value) -> str:
        self.decimals.append(_decimal(value))
        return "\0"


#: `render` of a small object, for which the library's encoder is not worth its start.
small = _object
_MARK = '"\\u0000"'


def render(value) -> str:
    """Canonical text: names sorted, no blanks, Unicode unescaped, array order kept."""
    if type(value) is not dict:
        return _RENDER[type(value)](value)
    encoder = _Encoder()
    text = encoder.encode(value)
    if not encoder.decimals and _MARK not in text:
        return text
    parts = text.split(_MARK)
    if len(parts) != len(encoder.decimals) + 1:  # a string looks like the mark
        return _object(value)
    return "".join([x for pair in zip(parts, encoder.decimals) for x in pair]) + parts[-1]


_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]{0,17})(?:\.[0-9]{1,18})?")


def scalar(text: str):
    """`parse` of a value's canonical text; plain strings and numbers, which most values are, need no parser."""
    if text[:1] == '"' and text[-1:] == '"' and "\\" not in text and text.count('"') == 2 and text.isprintable():
        return text[1:-1]
    if _NUMBER.fullmatch(text):
        return Decimal(text) if "." in text else int(text)
    return parse(text)


def path_text(path: tuple) -> str:
    """A typed path as stored in keys: pairs of kind and name, with blanks after commas and colons."""
    return json.dumps(path, ensure_ascii=False)


def pretty(value, indent: int = 0) -> str:
    """Indented by two, decimals as written."""
    if not value or not isinstance(value, (dict, list)):
        return render(value)
    pad = "\n" + "  " * (indent + 1)
    if isinstance(value, dict):
        inside = [f"{render(name)}: {pretty(part, indent + 1)}" for name, part in value.items()]
    else:
        inside = [pretty(part, indent + 1) for part in value]
    left, right = "{}" if isinstance(value, dict) else "[]"
    return left + ",".join(pad + part for part in inside) + "\n" + "  " * indent + right
