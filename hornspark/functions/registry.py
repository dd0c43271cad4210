"""The registry of functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from hornspark.kinds import ANY, BOT, FLOAT, NUMBER, Kind, Typed, narrow
from hornspark.lang.syntax import LanguageError

Builder = Callable[..., Typed]
FUNCTIONS: dict[str, Builder] = {}


def function(*names: str) -> Callable[[Builder], Builder]:
    def register(f: Builder) -> Builder:
        for n in names:
            FUNCTIONS[n] = f
        return f

    return register


def apply(name: str, args: list[Typed]) -> Typed:
    """The call as a typed column. Calls on values of a wrong kind are compile-time errors, or run-time ones for any."""
    if name not in FUNCTIONS:
        raise LanguageError(f"unknown function {name}")
    try:
        out = FUNCTIONS[name](*args)
    except TypeError as e:
        raise LanguageError(f"{name}: wrong number of arguments ({len(args)})") from e
    return Typed(out.col, out.kind, out.nullable or any(a.nullable for a in args), out.value)


def need(x: Typed, *kinds: Kind, what: str) -> Column:
    """The column of an argument of one of these kinds."""
    if x.kind in kinds:
        return x.col
    if x.kind == ANY and len(kinds) == 1:
        return narrow(x.col, kinds[0], what)
    if x.kind == BOT:
        return x.col
    raise LanguageError(f"{what}: expected {' or '.join(map(str, kinds))}, got {x.kind}")


def number(x: Typed, what: str) -> Column:
    return need(x, NUMBER, what=what)


def double(x: Typed, what: str) -> Column:
    if x.kind == ANY:
        c = x.col
        return F.when(c["kind"] == "float64", c["d"]).when(c["kind"] == "number", c["n"].cast("double")).otherwise(F.raise_error(F.lit(f"{what}: expected a number")).cast("double"))
    return need(x, NUMBER, FLOAT, what=what).cast("double")
