"""Checks of scalar arguments, on the driver."""

from __future__ import annotations

import math
from collections.abc import Iterable
from numbers import Integral, Real


def as_bool(value: object, name: str = "value") -> bool:
    if isinstance(value, bool) or (isinstance(value, Integral) and value in (0, 1)):
        return bool(value)
    raise ValueError(f"{name} must be True or False, not {value!r}")


def _within(x, name, low, high, inclusive):
    left, right = inclusive
    if low is not None and (x < low or (x == low and not left)):
        raise ValueError(f"{name} is {x}; it must be {'at least' if left else 'more than'} {low}")
    if high is not None and (x > high or (x == high and not right)):
        raise ValueError(f"{name} is {x}; it must be {'at most' if right else 'less than'} {high}")
    return x


def as_int(value: object, name: str = "value", low: int | None = None, high: int | None = None, inclusive: tuple[bool, bool] = (True, True)) -> int:
    if isinstance(value, bool) or not isinstance(value, Real) or not math.isfinite(value) or value != int(value):
        raise ValueError(f"{name} must be a whole number, not {value!r}")
    return _within(int(value), name, low, high, inclusive)


def as_float(value: object, name: str = "value", low: float | None = None, high: float | None = None, inclusive: tuple[bool, bool] = (True, True), allow_nan: bool = False) -> float:
    if isinstance(value, bool) or not isinstance(value, Real) or (math.isnan(value) and not allow_nan):
        raise ValueError(f"{name} must be a number, not {value!r}")
    return _within(float(value), name, low, high, inclusive)


def as_list(value: object, name: str = "value", least: int = 0, most: int | None = None, kind: type | None = None) -> list:
    if isinstance(value, (str, bytes, type)) or not isinstance(value, Iterable):
        raise ValueError(f"{name} must be a list or the like, not {value!r}")
    out = list(value)
    if len(out) < least or (most is not None and len(out) > most):
        raise ValueError(f"{name} has {len(out)} entries")
    if kind and not all(isinstance(x, kind) for x in out):
        raise ValueError(f"all entries of {name} must be {kind.__name__}")
    return out
