"""Exact arithmetic on written decimals: scaling, relative change, and an order for tokens."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Context, Decimal
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import canonical, keyed

STEPS = (1 << 53) - 1


def factor(key: bytes, root: str, path: tuple | list, strength: Decimal) -> tuple[int, int]:
    """1 plus or minus a draw from 0.01 to `strength`, as numerator and denominator; 1 at strength 0.

    Root and path make each slot's draw its own. With n the draw, M its highest value and strength s / q, the
    factor is 1 +- (q M + (100 s - q) n) / (100 q M), in integers throughout.
    """
    if strength == 0:
        return 1, 1
    n = keyed.below(key, "quantity-magnitude", (root, path), STEPS + 1)
    return _ratios(strength, [n], [keyed.below(key, "quantity-sign", (root, path), 2)])[0]


def ratio(key: bytes, slot: str, strength: Decimal) -> tuple[int, int]:
    """The factor of a slot, given by the canonical text of its root and path."""
    if strength == 0:
        return 1, 1
    least, step, whole = _steps(strength)
    part = least + step * keyed.draw(key, "quantity-magnitude", slot, STEPS + 1)
    return whole + part if keyed.draw(key, "quantity-sign", slot, 2) else whole - part, whole


def ratios(key: bytes, slots: Sequence[str], strength: Decimal) -> list[tuple[int, int]]:
    """The factor of each slot, given by the canonical text of its root and path; strength is not 0."""
    return _ratios(strength, keyed.draws(key, "quantity-magnitude", slots, STEPS + 1), keyed.draws(key, "quantity-sign", slots, 2))


def _ratios(strength: Decimal, drawn: Sequence[int], up: Sequence[int]) -> list[tuple[int, int]]:
    least, step, whole = _steps(strength)
    return [(whole + least + step * n if more else whole - least - step * n, whole) for n, more in zip(drawn, up)]


@lru_cache(maxsize=8)
def _steps(strength: Decimal) -> tuple[int, int, int]:
    """Least part, what a draw adds to it, and the whole."""
    s, q = strength.as_integer_ratio()
    return q * STEPS, 100 * s - q, 100 * q * STEPS


def scale(value: int | Decimal, by: tuple[int, int]) -> int | Decimal:
    """value times a ratio, rounded half to even at the last written place of `value`."""
    if by[0] == by[1]:
        return value
    if isinstance(value, int):
        out = _rounded(abs(value), by)
        return -out if value < 0 else out
    sign, digits, exponent = _parts(str(value))
    return Decimal(f"{sign}{_rounded(int(digits), by)}E{exponent}")


def _parts(token: str) -> tuple[str, str, int]:
    """Sign, digits and exponent of a written decimal."""
    sign, token = ("-", token[1:]) if token[0] == "-" else ("", token)
    number, _, power = token.partition("E")
    whole, _, part = number.partition(".")
    return sign, whole + part, int(power or 0) - len(part)


def _rounded(size: int, by: tuple[int, int]) -> int:
    out, rest = divmod(size * by[0], by[1])
    return out + (2 * rest > by[1] or (2 * rest == by[1] and out % 2))


_QUOTIENTS = Context(prec=34)


def relative_change(before: int | Decimal, after: int | Decimal) -> Decimal | None:
    """What a value grew by as a share of its size, to 34 digits; None from zero."""
    was = Decimal(before)
    return _QUOTIENTS.divide(_QUOTIENTS.subtract(Decimal(after), was), _QUOTIENTS.abs(was)) if was else None


_REVERSED = str.maketrans("0123456789", "9876543210")


def order_key(token: str) -> str:
    """A string that sorts as the decimal does; equal decimals have equal keys."""
    sign, digits, exponent = _parts(token)
    text = digits.lstrip("0")
    if not text:
        return "o"
    place = f"{len(text) + exponent + 500_000_000:010d}"
    text = text.rstrip("0")
    if not sign:
        return f"p{place}{text}"
    return "n" + (place + text).translate(_REVERSED) + "~"


def with_scaled(df: DataFrame, strength_percent: int, **cells: tuple[Column, Column, Column]) -> DataFrame:
    """df with a column for each (hundredths, draw, up): hundredths of up to 18 digits scaled as `factor` and `scale` do, exactly, in integers.

    Each step is computed once a row. Half of the divisor is added before the whole quotient is taken, and a tie gives back its odd one.
    """
    most = F.lit(100 * STEPS).cast("decimal(18,0)")
    double = (most * 2).cast("decimal(19,0)")

    def product(cents: Column, drawn: Column, up: Column) -> Column:
        part = F.lit(STEPS).cast("decimal(20,0)") + F.lit(strength_percent - 1).cast("decimal(4,0)") * drawn.cast("decimal(16,0)")
        ratio = F.when(up == 1, most + part).otherwise(most - part).cast("decimal(20,0)")
        return ((F.abs(cents).cast("decimal(18,0)") * ratio).cast("decimal(38,0)") * 2 + most).cast("decimal(38,0)")

    df = keyed.once(df, **{f"_p_{n}": product(*cell) for n, cell in cells.items()})
    df = keyed.once(df, **{f"_r_{n}": F.col(f"_p_{n}") % double for n in cells})
    df = keyed.once(df, **{f"_q_{n}": ((F.col(f"_p_{n}") - F.col(f"_r_{n}")) / double).cast("long") for n in cells})
    odd = lambda n: F.when((F.col(f"_r_{n}") == 0) & (F.col(f"_q_{n}") % 2 == 1), 1).otherwise(0)
    made = {n: F.signum(cell[0]).cast("long") * (F.col(f"_q_{n}") - odd(n)) for n, cell in cells.items()}
    return keyed.once(df, **made).drop(*[f"_{x}_{n}" for x in "pqr" for n in cells])


def scaled_rows(df: DataFrame, key: bytes, strength: Decimal, root: str, identity: str, cells: dict[str, str], kept: Sequence[str]) -> DataFrame:
    """The columns `kept`, the new id of each row as `root`, and for each cell (column with hundredths: name of its slot) what it is scaled to, as `<slot>_after`.

    The new id is that of a resource whose digest is that of its identity; with it and the slot's name come the cell's own draws. A cell of null stays null.
    """
    ids = lambda names: ["pert-" + d.hex()[:32] for d in keyed.digests(key, "resource", [f"[{canonical.render(n)},\"{keyed.sha256(n)}\"]" for n in names])]

    def run(batches):
        for batch in batches:
            new = ids(batch.column(identity).to_pylist())
            columns = [*(batch.column(c) for c in kept), pa.array(new, pa.string())]
            for column, slot in cells.items():
                texts = [f'["{n}",[["key","{slot}"]]]' for n in new]
                made = zip(batch.column(column).to_pylist(), ratios(key, texts, strength))
                columns.append(pa.array([None if v is None else scale(v, by) for v, by in made], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names)

    names = [*kept, root, *(f"{slot}_after" for slot in cells.values())]
    kinds = [f"{c} {df.schema[c].dataType.simpleString()}" for c in kept] + [f"{root} string"] + [f"{slot}_after long" for slot in cells.values()]
    return df.mapInArrow(run, ", ".join(kinds))
