"""Typed walk over documents: datatypes come from definitions, never from names or values."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from importlib.resources import files
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import canonical, keyed

#: Elements that all resources with "!" share, and those of every complex type.
_DOMAIN = "id:id meta:Meta implicitRules:uri language:code text:Narrative contained*:Resource extension*:Extension modifierExtension*:Extension"
#: And those that all published ones with "!!" share.
_PUBLISHED = "url:uri version:string name:string title:string status:code experimental:boolean date:dateTime publisher:string contact*:ContactDetail description:markdown useContext*:UsageContext jurisdiction*:CodeableConcept purpose:markdown copyright:markdown"
_ELEMENT = "id:string extension*:Extension"
_BACKBONE = f"{_ELEMENT} modifierExtension*:Extension"
#: What sets measurements of one path apart. Fixed values.
CONTEXT_NAMES = ("code", "type", "medicationCodeableConcept", "medicationReference", "itemCodeableConcept", "itemReference", "substanceCodeableConcept", "substanceReference")
EMBEDDED, UNKNOWN_FIELD, UNKNOWN_TYPE = "embedded_resource_preserved", "unknown_field", "unknown_resource_type"
_PROTECTED = {"Extension": "extension_contents_preserved", "Narrative": "narrative_or_attachment_preserved", "Attachment": "narrative_or_attachment_preserved", "Age": "age_duration_count_preserved", "Duration": "age_duration_count_preserved", "Count": "age_duration_count_preserved"}


class Shape(NamedTuple):
    """Where a child's own children are looked up: a place among the elements of a definition."""

    datatype: str
    elements: dict | None  # None: a primitive


class Types:
    """Definitions by name; elements are dicts of name to (types, elements of a backbone)."""

    def __init__(self, text: str):
        self.text = text
        self.version, self.digest = "4.0.1", keyed.sha256(text)
        self.definitions: dict[str, dict] = {}
        for line in text.splitlines():
            if line and not line.startswith("#"):
                name, _, rest = line.partition(":")
                shared = _DOMAIN if name.endswith("!") else "" if name in ("Parameters", "Bundle", "Binary") else _ELEMENT
                shared += f" {_PUBLISHED}" * name.endswith("!!")
                tokens = iter(f"{shared} {rest}".split())
                self.definitions[name.rstrip("!")] = self._elements(tokens, {})
        self.child = lru_cache(maxsize=1 << 15)(self._child)
        self._tables: dict[int, dict] = {id(d): d for d in self.definitions.values()}

    def _elements(self, tokens: Iterator[str], named: dict) -> dict:
        out: dict = {}
        for token in tokens:
            if token == "}":
                break
            name, colon, types = token.partition(":")
            if colon:
                out[name.rstrip("*")] = (types.split(","), None)
            elif token.endswith("{"):
                name = name.rstrip("{").rstrip("*")
                inside: dict = {}
                named[name] = inside
                out[name] = (["BackboneElement"], inside)
                inside.update(self._elements(iter(_BACKBONE.split()), named))
                inside.update(self._elements(tokens, named))
            else:  # elements of a backbone that stands elsewhere
                name, _, other = token.partition("@")
                out[name.rstrip("*")] = (["BackboneElement"], named[other])
        return out

    def root(self, kind: object) -> Shape | None:
        return Shape(kind, self.definitions[kind]) if kind in self.definitions else None

    def of(self, shape: Shape | None, name: str) -> Shape | None:
        """The shape of a child, or None if there is no such element."""
        if shape is None or shape.elements is None:
            return None
        self._tables.setdefault(id(shape.elements), shape.elements)
        return self.child(id(shape.elements), name)

    def _child(self, table: int, name: str) -> Shape | None:
        elements, plain = self._tables[table], name.removeprefix("_")
        found = elements.get(plain)
        kind = found[0][0] if found else None
        if found is None:
            for choice, (types, _) in elements.items():
                stem = choice.removesuffix("[x]")
                if stem != choice and plain.startswith(stem):
                    kind = next((t for t in types if plain == stem + t[0].upper() + t[1:]), None)
                    if kind:
                        found = (types, None)
                        break
        if kind is None:
            return None
        if plain != name:  # _name holds the metadata of a primitive
            return Shape("Element", self.definitions["Element"]) if kind not in self.definitions and kind not in ("Resource", "BackboneElement") else None
        return Shape(kind, found[1] if found[1] is not None else self.definitions.get(kind))


@lru_cache(maxsize=1)
def types() -> Types:
    return Types(files("veilgraph.data").joinpath("types.txt").read_text())


class Slot(NamedTuple):
    """A visited place of a document."""

    path: tuple  # of ("key", name) and ("index", number)
    value: object
    datatype: str | None
    parent_type: str | None
    holder: object  # the object or array with the slot
    key: object
    reason: str | None  # why it is left as it is, inherited
    quantity: dict | None  # the enclosing measurement
    concept: tuple  # (statistical path, canonical text) of codes around it


def statistical(path: tuple) -> tuple:
    """The path with every array place alike."""
    return tuple(("item", None) if kind == "index" else (kind, key) for kind, key in path)


def dotted(path: tuple) -> str:
    return "".join(f"[{key}]" if kind == "index" else f".{key}" for kind, key in path).removeprefix(".")


def shown(path: tuple | list) -> str:
    """The statistical path as reports show it."""
    return "$" + "".join("[*]" if kind == "item" else f"[{canonical.render(key)}]" for kind, key in path)


def walk(document: dict, types: Types, context: bool = True) -> Iterator[Slot]:
    """All slots, depth first, the document itself before all. Slots are read when visited, so a consumer may change the one it has got."""
    kind = document.get("resourceType")
    shape = types.root(kind)
    # what is still to visit, the next one last
    todo = [(Slot((), document, kind, None, None, None, None if shape else UNKNOWN_TYPE, None, ()), shape)]
    while todo:
        slot, shape = todo.pop()
        value, reason = slot.value, slot.reason
        if isinstance(value, dict):
            datatype, concept, quantity = slot.datatype, slot.concept, slot.quantity
            if datatype == "Resource" and reason is None:
                datatype = value.get("resourceType")
                shape = types.root(datatype)
                if shape is None:
                    reason = UNKNOWN_TYPE
                elif kind != "Bundle" and not (len(slot.path) == 2 and slot.path[0] == ("key", "contained")):
                    reason = EMBEDDED
            reason = reason or _PROTECTED.get(datatype)
            if context and (codes := {n: value[n] for n in CONTEXT_NAMES if isinstance(value.get(n), (dict, list))}):
                concept = (*concept, (statistical(slot.path), canonical.render(codes)))
            if datatype in ("Quantity", "Distance"):
                quantity = value
            slot = slot._replace(datatype=datatype, reason=reason, concept=concept, quantity=quantity)
            yield slot
            children = []
            for name, child in value.items():
                inner = Shape("code", None) if name == "resourceType" else types.of(shape, name)
                why = reason if inner else reason or UNKNOWN_FIELD
                children.append((Slot((*slot.path, ("key", name)), child, inner and inner.datatype, datatype, value, name, why, quantity, concept), inner))
            todo += reversed(children)
        else:
            yield slot
            if isinstance(value, list):
                todo += [(slot._replace(path=(*slot.path, ("index", i)), value=value[i], holder=value, key=i), shape) for i in reversed(range(len(value)))]


def sketch(value):
    """What a walk depends on: names in order, kinds of values, types of resources; an empty string is a kind of its own."""
    kind = type(value)
    if kind is dict:
        resource = value.get("resourceType")
        # strings, which are most of all, need no call
        return tuple(value), tuple([(str if v else 0) if type(v) is str else sketch(v) for v in value.values()]), resource if type(resource) is str else None
    if kind is list:
        return tuple([sketch(v) for v in value])
    return 0 if kind is str and not value else kind


#: What a worker keeps by outline, and slots of a document up to which it is kept.
OUTLINES, SLOTS = 2048, 1000


def keep(kept: dict, name: tuple, found, slots: int) -> None:
    """Keep what was found out for an outline, in bounded room."""
    if slots <= SLOTS:
        if len(kept) >= OUTLINES:
            kept.clear()
        kept[name] = found


def slot_at(document, path) -> object:
    for _, key in path:
        document = document[key]
    return document


def node_counts(docs: DataFrame, payload: str) -> DataFrame:
    """(type, path, kind, n): nodes of documents by root type, shown statistical path and JSON kind, summed per batch; a walk for each outline in a batch."""
    kinds = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}

    def run(batches):
        from collections import Counter

        for batch in batches:
            counts, alike = Counter(), {}
            for text in batch.column(0).to_pylist():
                document = canonical.parse(text)
                alike.setdefault(sketch(document), [document, 0])[1] += 1
            for document, n in alike.values():
                for slot in walk(document, types(), context=False):
                    counts[document.get("resourceType"), shown(statistical(slot.path)), kinds.get(type(slot.value), "number")] += n
            if counts:
                kind, path, what = zip(*counts)
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(path), pa.array(what), pa.array(counts.values(), pa.int64())], ["type", "path", "kind", "n"])

    return docs.select(F.col(payload)).mapInArrow(run, "type string, path string, kind string, n long")


RESOURCE_TYPE = re.compile(r"[A-Z][A-Za-z0-9]+")
FHIR_ID = re.compile(r"[A-Za-z0-9\-.]{1,64}")
