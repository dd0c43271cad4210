"""Arithmetic, strings and conversions. Overflow and division by zero are errors, as Spark's ANSI mode has them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from hornspark.functions.registry import double, function, need, number
from hornspark.functions.text import shown
from hornspark.kinds import FLOAT, NAME, NUMBER, STRING, Typed
from hornspark.lang.syntax import LanguageError


def _fold(name: str, args: tuple[Typed, ...], take, op, empty=None, alone=None) -> Column:
    cols = [take(a, name) for a in args]
    if not cols:
        if empty is None:
            raise LanguageError(f"{name} needs an argument")
        return empty
    if len(cols) == 1:
        return alone(cols[0]) if alone else cols[0]
    return reduce(op, cols)


@function("fn:plus")
def plus(*args):
    return Typed(_fold("fn:plus", args, number, lambda a, b: a + b, F.lit(0).cast("long")), NUMBER)


@function("fn:minus")
def minus(*args):
    return Typed(_fold("fn:minus", args, number, lambda a, b: a - b, alone=lambda a: -a), NUMBER)


@function("fn:mult")
def mult(*args):
    return Typed(_fold("fn:mult", args, number, lambda a, b: a * b, F.lit(1).cast("long")), NUMBER)


@function("fn:div")
def div(*args):
    """Truncating; a quotient of 0 stays 0, whatever is left to divide by."""
    over = lambda a, b: F.call_function("div", a, b)
    cols = [number(a, "fn:div") for a in args]
    if not cols:
        raise LanguageError("fn:div needs an argument")
    if len(cols) == 1:
        return Typed(over(F.lit(1).cast("long"), cols[0]), NUMBER)
    out = over(cols[0], cols[1])
    for c in cols[2:]:
        out = F.when(out == 0, F.lit(0).cast("long")).otherwise(over(out, c))
    return Typed(out, NUMBER)


@function("fn:float:plus", "fn:float_plus")
def float_plus(*args):
    return Typed(_fold("fn:float:plus", args, double, lambda a, b: a + b, F.lit(0.0)), FLOAT)


@function("fn:float:minus", "fn:float_minus")
def float_minus(*args):
    return Typed(_fold("fn:float:minus", args, double, lambda a, b: a - b, alone=lambda a: -a), FLOAT)


@function("fn:float:mult", "fn:float_mult")
def float_mult(*args):
    return Typed(_fold("fn:float:mult", args, double, lambda a, b: a * b, F.lit(1.0)), FLOAT)


@function("fn:float:div", "fn:float_div")
def float_div(*args):
    return Typed(_fold("fn:float:div", args, double, lambda a, b: a / b, alone=lambda a: F.lit(1.0) / a), FLOAT)


@function("fn:sqrt")
def sqrt(x):
    return Typed(F.sqrt(double(x, "fn:sqrt")), FLOAT)


@function("fn:string:concat")
def concat(*args):
    return Typed(F.concat(*[shown(a.col, a.kind) for a in args]) if args else F.lit(""), STRING)


@function("fn:string:replace")
def replace(s, old, new, count):
    """The first `count` occurrences, or all if it is negative. An empty string occurs before each character and at the end."""
    text, o, w = (need(x, STRING, what="fn:string:replace") for x in (s, old, new))
    n = number(count, "fn:string:replace").cast("int")
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    limit = F.when(n < 0, F.size(chars) + 1).otherwise(n)
    between = F.concat(F.array_join(F.transform(chars, lambda c, i: F.when(i < limit, F.concat(w, c)).otherwise(c)), ""), F.when(F.size(chars) < limit, w).otherwise(F.lit("")))
    pattern = F.concat(F.lit("\\Q"), F.replace(o, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    pieces = F.split(text, pattern, n + 1)
    some = F.aggregate(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), F.get(pieces, F.lit(0)), lambda a, p: F.concat(a, w, p))
    return Typed(F.when(o == "", between).when(n < 0, F.replace(text, o, w)).when(n == 0, text).otherwise(some), STRING)


@function("fn:number:to_string")
def number_to_string(x):
    return Typed(number(x, "fn:number:to_string").cast("string"), STRING)


@function("fn:float64:to_string")
def float_to_string(x):
    return Typed(shown(need(x, FLOAT, what="fn:float64:to_string"), FLOAT), STRING)


@function("fn:name:to_string")
def name_to_string(x):
    return Typed(need(x, NAME, what="fn:name:to_string"), STRING)
