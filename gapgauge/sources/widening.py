"""Types a drifting column may come in, and the one that holds all its values.

Nothing is rounded: a column is read as a wider type only if every value of the
narrower ones has its exact place there, and as text otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import types as T

# Digits of the largest value.
WHOLE = {"int": 10, "bigint": 19}
#: Whole numbers up to here are doubles without loss.
EXACT_IN_DOUBLE = 1 << 53
#: Decimal numbers of so many digits come back from a double as they were.
EXACT_DIGITS = 15
DECIMAL = re.compile(r"decimal\((\d+),(-?\d+)\)")


def storage_type(data_type: T.DataType) -> str | None:
    """Type a column is stored as; None for a column that holds nothing at all."""
    if isinstance(data_type, T.NullType):
        return None
    if isinstance(data_type, (T.ByteType, T.ShortType)):
        return "int"
    if isinstance(data_type, T.FloatType):
        return "double"
    return data_type.simpleString()


def _decimal(data_type: str) -> tuple[int, int] | None:
    """Digits before and after the point."""
    found = DECIMAL.fullmatch(data_type)
    return (int(found[1]) - int(found[2]), int(found[2])) if found else None


def common_type(types: Iterable[str], large_whole: bool = False) -> str:
    """The type all values of the given types can be read as.

    ``large_whole`` says that some whole number among them is beyond the range
    in which a double holds every whole number.
    """
    types = set(types)
    if len(types) == 1:
        return types.pop()
    decimals = [d for d in map(_decimal, types) if d]
    if not all(t in WHOLE or t == "double" or _decimal(t) for t in types):
        return "string"
    if "double" in types:
        exact = not large_whole and all(sum(d) <= EXACT_DIGITS for d in decimals)
        return "double" if exact else "string"
    if not decimals:
        return max(types, key=WHOLE.get)
    before = max([d[0] for d in decimals] + [WHOLE[t] for t in types if t in WHOLE])
    after = max(d[1] for d in decimals)
    return f"decimal({before + after},{after})" if before + after <= 38 else "string"


def wider_type(a: str, b: str) -> str:
    return common_type((a, b))


def physical_name(name: str, data_type: str, taken: Iterable[str]) -> str:
    """Name of one more stored column, different from all others in any case."""
    taken = {t.lower() for t in taken}
    wanted = f"{name}__{re.sub(r'[^a-z0-9]+', '_', data_type).strip('_')}" if data_type else name
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
