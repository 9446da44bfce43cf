"""Keyed pseudo-random draws: HMAC-SHA256 over a canonical JSON message.

A draw depends on a 32-byte key, a purpose and a value, so every draw can be
made again from the key, and draws of different purposes don't tell on each
other.  Each function comes for Python values, for code that walks documents,
and, with suffix `_col`, as an expression that Catalyst compiles.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterable, Sequence
from functools import lru_cache, reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .canonical import render

#: Fixed value: names the algorithm in every message.
ALGORITHM = "hmac-sha256-v1"
KEY_BYTES, BLOCK, SPACE = 32, 64, 1 << 256


def new_key() -> bytes:
    return secrets.token_bytes(KEY_BYTES)


def check_key(key: object) -> bytes:
    if not isinstance(key, bytes) or len(key) != KEY_BYTES:
        raise ValueError(f"a run key has exactly {KEY_BYTES} bytes")
    return key


@lru_cache(maxsize=1 << 10)
def frame(purpose: str, counter: int = 0) -> tuple[str, str]:
    """What stands before and after a value's canonical text in the message of a draw; both forms of the draws use it."""
    return f'["{ALGORITHM}",{render(purpose)},', f",{counter}]"


@lru_cache(maxsize=8)
def _pads(key: bytes) -> tuple:
    """What a key's messages, and then their digests, are hashed after."""
    return tuple(hashlib.sha256(bytes(b ^ pad for b in key.ljust(BLOCK, b"\0"))) for pad in (0x36, 0x5C))


def _hmac(inside, outside, message: bytes) -> bytes:
    """HMAC from pads made once for a key, which takes less than half of the time of `hmac.digest`."""
    inside, outside = inside.copy(), outside.copy()
    inside.update(message)
    outside.update(inside.digest())
    return outside.digest()


def digest(key: bytes, purpose: str, value, counter: int = 0) -> bytes:
    return _hmac(*_pads(check_key(key)), render(value).join(frame(purpose, counter)).encode())


def digests(key: bytes, purpose: str, texts: Iterable[str | None], counter: int = 0) -> list[bytes | None]:
    """`digest` of each value, given by its canonical text; None for None."""
    pads = _pads(check_key(key))
    before, after = (part.encode() for part in frame(purpose, counter))
    return [None if text is None else _hmac(*pads, before + text.encode() + after) for text in texts]


def draws(key: bytes, purpose: str, texts: Sequence[str | None], upper: int) -> list[int | None]:
    """`below` of each value, given by its canonical text; None for None."""
    most = fair(upper)
    found = [None if d is None else int.from_bytes(d) for d in digests(key, purpose, texts)]
    for turn in count(1):
        again = [i for i, n in enumerate(found) if n is not None and n > most]
        if not again:
            return [None if n is None else n % upper for n in found]
        for i, d in zip(again, digests(key, purpose, [texts[i] for i in again], turn)):
            found[i] = int.from_bytes(d)


def draw(key: bytes, purpose: str, text: str, upper: int) -> int:
    """`below` of a value given by its canonical text."""
    inside, outside = _pads(key)
    most = fair(upper)
    for turn in count():
        n = int.from_bytes(_hmac(inside, outside, text.join(frame(purpose, turn)).encode()))
        if n <= most:
            return n % upper


def label(key: bytes, purpose: str, value) -> str:
    return digest(key, purpose, value).hex()


@lru_cache(maxsize=1 << 10)
def fair(upper: int) -> int:
    """The largest digest that a draw below `upper` may come from: what is above would favour small numbers."""
    return SPACE - SPACE % upper - 1


def below(key: bytes, purpose: str, value, upper: int) -> int:
    """A uniform draw from 0 to upper - 1, from the first fair digest."""
    if type(upper) is not int or not 0 < upper <= SPACE:
        raise ValueError("a draw needs an upper limit from 1 to 2**256")
    most = fair(upper)
    numbers = (int.from_bytes(digest(key, purpose, value, turn)) for turn in count())
    return next(n for n in numbers if n <= most) % upper


# ---------------------------------------------------------------- as Catalyst expressions


def json_string_col(text: Column) -> Column:
    """A string as a JSON string, escaped as `render` does it."""
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    short = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
    controls = [chr(i) for i in range(32)]
    escaped = reduce(lambda c, x: F.replace(c, F.lit(x), F.lit(short.get(x) or f"\\u{ord(x):04x}")), controls, plain)
    return F.concat(F.lit('"'), F.when(text.rlike(r"[\x00-\x1f]"), escaped).otherwise(plain), F.lit('"'))


def json_array_col(*parts: Column) -> Column:
    """Rendered parts as a JSON array."""
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def _pad(key: bytes, byte: int) -> Column:
    return F.lit(bytearray(b ^ byte for b in key.ljust(BLOCK, b"\0")))


def digest_col(key: bytes, purpose: str, value_json: Column, counter: int = 0) -> Column:
    """Hex digest; `value_json` is the canonical text of the value."""
    check_key(key)
    before, after = frame(purpose, counter)
    message = F.concat(F.lit(before), value_json, F.lit(after))
    inner = F.sha2(F.concat(_pad(key, 0x36), F.encode(message, "utf-8")), 256)
    return F.sha2(F.concat(_pad(key, 0x5C), F.unhex(inner)), 256)


def label_col(key: bytes, purpose: str, value_json: Column) -> Column:
    return digest_col(key, purpose, value_json)


def modulo_col(hex_digest: Column, upper: Column) -> Column:
    """A 256-bit hex number modulo `upper` (a long up to 2**37), by Horner's rule over 24 bits at a time; `hex_digest` stands in it often, so let it be a column."""
    rest = F.lit(0).cast("long")
    for at in range(0, 64, 6):
        width = min(6, 64 - at)
        limb = F.conv(F.substring(hex_digest, at + 1, width), 16, 10).cast("long")
        rest = (rest * (1 << 4 * width) + limb) % upper
    return rest


def draw_col(hex_digest: Column, upper: int) -> Column:
    """The draw below a fixed limit that a digest gives; null if it isn't a fair one."""
    if upper & (upper - 1) == 0:  # a power of two: the low bits, and every digest is fair
        bits = upper.bit_length() - 1
        return F.conv(F.substring(hex_digest, -15, 15), 16, 10).cast("long").bitwiseAND(F.lit(upper - 1).cast("long")) if bits else F.lit(0).cast("long")
    return F.when(hex_digest <= f"{fair(upper):064x}", modulo_col(hex_digest, F.lit(upper).cast("long")))


def with_draws(df: DataFrame, key: bytes, tries: int = 2, **draws: tuple[str, Column, int | None]) -> DataFrame:
    """df with a column for each draw (purpose, canonical text of the value, limit; None: the hex digest itself).

    Digests are computed once a row and then used, however often: the optimizer would copy them into each use. A
    draw is null if `tries` digests in a row aren't fair, a chance below 2**-200 each for small limits.
    """
    df = once(df, **{f"_{n}": digest_col(key, purpose, value) for n, (purpose, value, _) in draws.items()})
    made = {}
    for n, (purpose, value, upper) in draws.items():
        again = [] if upper is None or upper & (upper - 1) == 0 else [draw_col(digest_col(key, purpose, value, t), upper) for t in range(1, tries)]
        made[n] = F.coalesce(draw_col(F.col(f"_{n}"), upper), *again) if upper else F.col(f"_{n}")
    return once(df, **made).drop(*[f"_{n}" for n in draws])


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row."""
    one = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.withColumn("_once", one).select("*", "_once.*").drop("_once")


def below_col(key: bytes, purpose: str, value_json: Column, upper: int, tries: int = 2) -> Column:
    """A uniform draw from 0 to upper - 1 for a fixed limit, in one expression, which repeats the digest; `with_draws` doesn't."""
    return F.coalesce(*[draw_col(digest_col(key, purpose, value_json, t), upper) for t in range(tries)])


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
