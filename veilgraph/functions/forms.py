"""Canonical texts taken apart by what all documents of an outline have in common, without a parser.

A form is a regular expression over the whole text: names, lengths of arrays and types of resources stand in it as they are, values by their
kind, as in `walk.sketch`.  A text that it matches is canonical and of that outline; strings with escapes, long numbers and those with exponents are
left to the parser.
"""

from __future__ import annotations

import re
from decimal import Decimal

from .canonical import render

#: Numbers whose canonical text is the text itself.
_KINDS = {int: r"(?:0|-?[1-9][0-9]{0,17})", Decimal: r"-?(?:0|[1-9][0-9]{0,17})\.[0-9]{1,6}", bool: r"(?:true|false)", type(None): "null"}
_STRING = r'"[^"\\\x00-\x1f]+"'


def _sorted(value) -> bool:
    if isinstance(value, dict):
        return list(value) == sorted(value) and all(map(_sorted, value.values()))
    return all(map(_sorted, value)) if isinstance(value, list) else True


def form(document: dict, cuts: list[tuple]) -> re.Pattern | None:
    """A pattern with the text of each value in `cuts` (paths of keys, in the order of the text) as a group, and what stands before, between and after them as groups, too. None if one lies in another, or if names aren't sorted."""
    if any(b[: len(a)] == a for a in cuts for b in cuts if a is not b) or not _sorted(document):
        return None
    out, wanted = ["("], set(cuts)

    def emit(value, path):
        if path in wanted:
            out.append(")(")
        if isinstance(value, dict):
            for nth, name in enumerate(sorted(value)):
                out.append(("," if nth else r"\{") + re.escape(render(name)) + ":")
                fixed = name == "resourceType" and isinstance(value[name], str)
                out.append(re.escape(render(value[name]))) if fixed else emit(value[name], (*path, name))
            out.append(r"\}" if value else r"\{\}")
        elif isinstance(value, list):
            for nth, part in enumerate(value):
                out.append("," if nth else r"\[")
                emit(part, (*path, nth))
            out.append(r"\]" if value else r"\[\]")
        else:
            out.append((_STRING if value else '""') if isinstance(value, str) else _KINDS[type(value)])
        if path in wanted:
            out.append(")(")

    emit(document, ())
    return re.compile("".join([*out, ")"]))
