"""URL filter: a sort-merge range join of canonical keys with nested rule intervals.

A host with its labels reversed (`com.example.www.`) has all its subdomains in
one interval of the key order, and intervals of two hosts are nested or
disjoint.  A task sorts its own urls by key and sweeps them along the sorted
rules: a stack holds the host rules whose interval is open, outermost first.
A url is judged by the stack alone.  Urls are never shuffled, so a host with a
third of all pages is no group at all.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, passing, slices

#: Rules sent to the tasks at once, in characters; more are swept in further passes.
RULES_AT_ONCE = 4 << 20


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def canonical(host: str) -> str:
    """Labels reversed, each ended by a sign lower than any in a host."""
    return "".join(f"{label}\x01" for label in reversed(host.split(".")))


class Sweep:
    """Walks keys in order along the sorted rules; `stack` has the open host rules, innermost last."""

    def __init__(self, rules: list[tuple[str, list[Rule]]]):
        self.rules, self.at, self.stack, self.last = rules, 0, [], None

    def to(self, key: str) -> list[tuple[str, list[Rule]]]:
        if key != self.last:
            while self.stack and not key.startswith(self.stack[-1][0]):
                self.stack.pop()
            while self.at < len(self.rules) and self.rules[self.at][0] <= key:
                # an interval that begins at or before the key is open if the key begins with its bound
                if key.startswith(self.rules[self.at][0]):
                    self.stack.append(self.rules[self.at])
                self.at += 1
            self.last = key
        return self.stack

    def rule(self, key: str, path: str) -> Rule | None:
        for _, group in reversed(self.to(key)):
            for rule in group:
                if path.startswith(rule.path):
                    return rule
        return None


def _prepared(rules: Sequence[Rule]) -> list[tuple[str, list[Rule]]]:
    by_key: dict[str, list[Rule]] = {}
    for rule in sorted(set(rules)):
        by_key.setdefault(canonical(rule.host), []).append(rule)
    return [(k, sorted(v, key=lambda r: (-len(r.path), r.verdict != "block"))) for k, v in sorted(by_key.items())]


def judge(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", url: str = "url", rules_at_once: int = RULES_AT_ONCE) -> DataFrame:
    """pages with host, path, rule (`host` + `path` of the rule, else null) and verdict.

    The host is what stands between the first `://` and `/`, `?`, `#` or the end,
    A-Z lower-cased; the path goes on up to `?`, `#` or the end. A rule fits its host
    and its subdomains if the path starts with the rule's; of fitting rules the one
    with the longest host, then the longest path, wins, then a block.

    Null urls and urls without `://` have an empty host and path, fit no rule and
    get `default`. Urls of any length are judged whole; repeated rows are judged alike; an empty table gives no rows;
    other columns pass through and those named as new ones are replaced, the url too.
    """
    new = ("host", "path", "rule", "verdict")
    keep = passing(pages, new)
    rest = F.coalesce(F.expr(f"CASE WHEN instr(`{url}`, '://') > 0 THEN substring(`{url}`, instr(`{url}`, '://') + 3) END"), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    (key,) = fresh([*pages.columns, *new], "key")
    # the key of the order is the canonical host; \x01 sorts below all that stands in hosts
    none = F.lit(None).cast("string")
    out = pages.select(*keep, host.alias("host"), path.alias("path"), none.alias("rule"), none.alias("verdict"))
    out = out.withColumn(key, F.when(F.col("host") != "", F.concat(F.array_join(F.reverse(F.split("host", r"\.")), "\x01"), F.lit("\x01"))).otherwise(F.lit("")))
    out = out.sortWithinPartitions(key)
    names = out.columns
    for some in slices(sorted(set(rules)), lambda r: sum(map(len, r)) + 32, rules_at_once) or [[]]:
        shared = pages.sparkSession.sparkContext.broadcast(_prepared(some))

        def sweep(batches, shared=shared):
            sweeper = Sweep(shared.value)
            for batch in batches:
                keys, paths, rule, verdict = (batch.column(c).to_pylist() for c in (key, "path", "rule", "verdict"))
                for i, (k, path) in enumerate(zip(keys, paths)):
                    hit = sweeper.rule(k, path)
                    if hit is not None and (rule[i] is None or (len(hit.host), len(hit.path)) > tuple(map(len, _parts(rule[i])))):
                        rule[i], verdict[i] = hit.host + hit.path, hit.verdict
                made = {"rule": pa.array(rule, pa.string()), "verdict": pa.array(verdict, pa.string())}
                yield pa.RecordBatch.from_arrays([made.get(c, batch.column(c)) for c in names], names)

        out = out.mapInArrow(sweep, T.StructType([T.StructField(f.name, f.dataType, True) for f in out.schema]))
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default))).drop(key)


def _parts(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path
