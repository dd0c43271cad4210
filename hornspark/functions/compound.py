"""Lists, pairs, maps and structs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from hornspark.functions.registry import function, number
from hornspark.kinds import BOT, NAME, NUMBER, Kind, Typed, convert, equal, list_of, map_of, pair_of, spark_type, struct_of, unify
from hornspark.lang.syntax import LanguageError


def _all(args: list[Typed]) -> Kind:
    return reduce(unify, (a.kind for a in args), BOT)


def _array(args: list[Typed], k: Kind) -> Column:
    return F.array(*[convert(a.col, a.kind, k) for a in args]).cast(f"array<{spark_type(k).simpleString()}>") if args else F.array().cast(f"array<{spark_type(k).simpleString()}>")


def _of(x: Typed, *names: str, what: str) -> Kind:
    if x.kind.name not in names:
        raise LanguageError(f"{what}: expected {' or '.join(names)}, got {x.kind}")
    return x.kind


def _missing(what: str, k: Kind) -> Column:
    return F.raise_error(F.lit(what)).cast(spark_type(k))


@function("fn:list")
def make_list(*args):
    k = _all(args)
    return Typed(_array(args, k), list_of(k))


@function("fn:pair")
def make_pair(a, b):
    return Typed(F.struct(a.col.alias("first"), b.col.alias("second")), pair_of(a.kind, b.kind))


@function("fn:tuple")
def make_tuple(*args):
    if len(args) == 1:
        return args[0]
    return make_pair(args[0], args[1] if len(args) == 2 else make_tuple(*args[1:]))


@function("fn:map")
def make_map(*args):
    if len(args) % 2:
        raise LanguageError("fn:map: a key without a value")
    k, v = _all(args[::2]), _all(args[1::2])
    kind = map_of(k, v)
    entries = [F.struct(convert(a.col, a.kind, k).alias("key"), convert(b.col, b.kind, v).alias("value")) for a, b in zip(args[::2], args[1::2], strict=True)]
    return Typed(F.array(*entries).cast(spark_type(kind)), kind)


@function("fn:struct")
def make_struct(*args):
    if len(args) % 2 or any(a.kind != NAME or a.value is None for a in args[::2]):
        raise LanguageError("fn:struct: needs names of fields, each with a value")
    fields = {str(f.value): v for f, v in zip(args[::2], args[1::2], strict=True)}
    return Typed(F.struct(*[v.col.alias(f) for f, v in fields.items()]), struct_of({f: v.kind for f, v in fields.items()}))


@function("fn:list:get")
def list_get(x, i):
    """From 0; an index out of range is an error. Other compounds count their parts one by one."""
    n = number(i, "fn:list:get").cast("int")
    k = _of(x, "list", "pair", "map", "struct", what="fn:list:get")
    if k.name == "list":
        return Typed(F.when((n < 0) | (n >= F.size(x.col)), _missing("fn:list:get: index out of range", k.args[0])).otherwise(F.get(x.col, n)), k.args[0])
    if k.name == "map":
        one = unify(*k.args)
        flat = F.flatten(F.transform(x.col, lambda e: F.array(convert(e["key"], k.args[0], one), convert(e["value"], k.args[1], one))))
        return Typed(F.when((n < 0) | (n >= F.size(flat)), _missing("fn:list:get: index out of range", one)).otherwise(F.get(flat, n)), one)
    if not isinstance(i.value, int):
        raise LanguageError("fn:list:get: parts of pairs and structs are taken by a constant")
    parts = [(x.col["first"], k.args[0]), (x.col["second"], k.args[1])] if k.name == "pair" else [p for f, a in zip(k.fields, k.args, strict=True) for p in ((F.lit(f), NAME), (x.col.getField(f), a))]
    if not 0 <= i.value < len(parts):
        raise LanguageError("fn:list:get: index out of range")
    return Typed(*parts[i.value])


@function("fn:list:append")
def list_append(x, e):
    k = unify(_of(x, "list", what="fn:list:append").args[0], e.kind)
    return Typed(F.concat(convert(x.col, x.kind, list_of(k)), F.array(convert(e.col, e.kind, k))), list_of(k))


@function("fn:list:len", "fn:len")
def length(x):
    """Parts: those of a list, two of a pair and of each entry of a map or struct."""
    k = _of(x, "list", "pair", "map", "struct", what="fn:len")
    n = {"list": lambda: F.size(x.col), "map": lambda: F.size(x.col) * 2, "pair": lambda: F.lit(2), "struct": lambda: _fields(x) * 2}[k.name]()
    return Typed(n.cast("long"), NUMBER)


def _fields(x: Typed) -> Column:
    return sum((x.col.getField(f).isNotNull().cast("int") for f in x.kind.fields), F.lit(0))


@function("fn:pair:first")
def first(x):
    return _part(x, 0, "fn:pair:first")


@function("fn:pair:second")
def second(x):
    return _part(x, 1, "fn:pair:second")


def _part(x: Typed, i: int, what: str) -> Typed:
    k = _of(x, "pair", "list", what=what)
    return Typed(x.col["first" if i == 0 else "second"], k.args[i]) if k.name == "pair" else list_get(x, Typed(F.lit(i), NUMBER, value=i))


@function("fn:struct:get", "fn:map:get", "fn:struct_get")
def get(x, key):
    """The value of the first entry with this key; without one it is an error."""
    k = _of(x, "map", "struct", what="fn:map:get")
    if k.name == "struct":
        if key.value not in k.fields:
            raise LanguageError(f"fn:struct:get: no field {key.value} in {k}")
        a = k.args[k.fields.index(key.value)]
        c = x.col.getField(str(key.value))
        return Typed(F.coalesce(c, _missing(f"fn:struct:get: no field {key.value}", a)), a)
    entry = F.get(F.filter(x.col, lambda e: _same(e["key"], k.args[0], key)), F.lit(0))
    return Typed(F.when(entry.isNull(), _missing("fn:map:get: no such key", k.args[1])).otherwise(entry["value"]), k.args[1])


def _same(c: Column, k: Kind, x: Typed) -> Column:
    same = equal(Typed(c, k), x)
    return F.lit(False) if same is None else same


@function("fn:map:len", "fn:struct:len")
def entries(x):
    k = _of(x, "map", "struct", what="fn:map:len")
    return Typed((F.size(x.col) if k.name == "map" else _fields(x)).cast("long"), NUMBER)


@function("fn:map:keys")
def keys(x):
    k = _of(x, "map", "struct", what="fn:map:keys")
    if k.name == "struct":
        return Typed(F.array_compact(F.array(*[F.when(x.col.getField(f).isNotNull(), F.lit(f)) for f in k.fields])), list_of(NAME))
    return Typed(F.transform(x.col, lambda e: e["key"]), list_of(k.args[0]))


@function("fn:map:values", "fn:struct:values")
def values(x):
    k = _of(x, "map", "struct", what="fn:map:values")
    if k.name == "struct":
        one = reduce(unify, k.args, BOT)
        return Typed(F.array_compact(F.array(*[convert(x.col.getField(f), a, one) for f, a in zip(k.fields, k.args, strict=True)])), list_of(one))
    return Typed(F.transform(x.col, lambda e: e["value"]), list_of(k.args[1]))

