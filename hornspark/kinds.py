"""Kinds of values, their Spark types, and equality and order between columns of two kinds.

Kinds are known when a program is compiled. number is a long, float64 a double, name a string with a kind of its own,
time a timestamp in UTC and duration a day-time interval, both in microseconds. A map keeps order and repeated keys, so
it is an array of entries. A column that holds scalars of several kinds is of kind any: a struct of a rank, a kind and
one value, so that Spark can group, join and compare it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F, types as T

from hornspark.lang.syntax import LanguageError


@dataclass(frozen=True)
class Kind:
    name: str
    args: tuple[Kind, ...] = ()
    fields: tuple[str, ...] = ()

    def __str__(self) -> str:
        if self.fields:
            return f".Struct<{', '.join(f'{f} : {k}' for f, k in zip(self.fields, self.args, strict=True))}>"
        return f".{self.name.title()}<{', '.join(map(str, self.args))}>" if self.args else f"/{self.name}"


NUMBER, FLOAT, STRING, NAME, TIME, DURATION, BYTES, ANY, BOT = map(Kind, ("number", "float64", "string", "name", "time", "duration", "bytes", "any", "bot"))
SCALARS = (NUMBER, FLOAT, STRING, NAME, TIME, DURATION, BYTES, ANY, BOT)
#: Order between kinds: fixed values.
RANK = {"number": 0, "float64": 0, "string": 1, "name": 2, "time": 3, "duration": 4, "list": 5, "pair": 5, "map": 5, "struct": 5, "bytes": 5, "any": 6, "bot": 6}
EPOCH = "timestamp'1970-01-01 00:00:00'"
_ANY = T.StructType([T.StructField("rank", T.ByteType()), T.StructField("kind", T.StringType()), T.StructField("n", T.LongType()), T.StructField("d", T.DoubleType()), T.StructField("s", T.StringType())])
_PLAIN = {"number": T.LongType(), "float64": T.DoubleType(), "string": T.StringType(), "name": T.StringType(), "time": T.TimestampType(), "duration": T.DayTimeIntervalType(), "bytes": T.BinaryType(), "any": _ANY, "bot": T.StringType()}


def list_of(k: Kind) -> Kind:
    return Kind("list", (k,))


def pair_of(a: Kind, b: Kind) -> Kind:
    return Kind("pair", (a, b))


def map_of(k: Kind, v: Kind) -> Kind:
    return Kind("map", (k, v))


def struct_of(fields: dict[str, Kind]) -> Kind:
    return Kind("struct", tuple(fields.values()), tuple(fields))


def spark_type(k: Kind) -> T.DataType:
    match k.name:
        case "list":
            return T.ArrayType(spark_type(k.args[0]))
        case "pair":
            return T.StructType([T.StructField(n, spark_type(a)) for n, a in zip(("first", "second"), k.args, strict=True)])
        case "map":
            return T.ArrayType(T.StructType([T.StructField(n, spark_type(a)) for n, a in zip(("key", "value"), k.args, strict=True)]))
        case "struct":
            return T.StructType([T.StructField(n, spark_type(a)) for n, a in zip(k.fields, k.args, strict=True)])
    return _PLAIN[k.name]


def of_spark(t: T.DataType) -> Kind:
    """The kind that a column of outside data gets; see adapted() for the values."""
    match t:
        case T.ByteType() | T.ShortType() | T.IntegerType() | T.LongType() | T.BooleanType():
            return NUMBER
        case T.FloatType() | T.DoubleType() | T.DecimalType():
            return FLOAT
        case T.DateType() | T.TimestampType() | T.TimestampNTZType():
            return TIME
        case T.DayTimeIntervalType():
            return DURATION
        case T.BinaryType():
            return BYTES
        case T.ArrayType():
            return list_of(of_spark(t.elementType))
        case T.MapType():
            return map_of(of_spark(t.keyType), of_spark(t.valueType))
        case T.StructType():
            return struct_of({f"/{f.name}": of_spark(f.dataType) for f in t.fields})
    return STRING


def adapted(c: Column, t: T.DataType) -> Column:
    """A column of outside data as one of its kind."""
    match t:
        case T.MapType():
            return F.transform(F.map_entries(c), lambda e: F.struct(adapted(e["key"], t.keyType).alias("key"), adapted(e["value"], t.valueType).alias("value")))
        case T.ArrayType() if spark_type(of_spark(t.elementType)) != t.elementType:
            return F.transform(c, lambda e: adapted(e, t.elementType))
        case T.StructType():
            return F.when(c.isNotNull(), F.struct(*[adapted(c.getField(f.name), f.dataType).alias(f"/{f.name}") for f in t.fields]))
    want = spark_type(of_spark(t))
    return c if t == want else c.cast(want)


def unify(a: Kind, b: Kind) -> Kind:
    """The least kind that holds values of both."""
    if a == b or b == BOT:
        return a
    if a == BOT:
        return b
    if a.name == b.name == "struct":
        fields = dict(zip(a.fields, a.args, strict=True))
        for f, k in zip(b.fields, b.args, strict=True):
            fields[f] = unify(fields.get(f, BOT), k)
        return struct_of(fields)
    if a.name == b.name:
        return Kind(a.name, tuple(unify(x, y) for x, y in zip(a.args, b.args, strict=True)))
    if a in SCALARS and b in SCALARS and BYTES not in (a, b):
        return ANY
    raise LanguageError(f"one column cannot hold both {a} and {b}")


def convert(c: Column, a: Kind, b: Kind) -> Column:
    """A column of kind a as one of kind b, which holds it."""
    if a == b:
        return c
    if a == BOT:
        return F.lit(None).cast(spark_type(b))
    if b == ANY:
        n = {"number": c, "time": F.unix_micros(c) * 1000 if a == TIME else None, "duration": micros(c) * 1000 if a == DURATION else None}.get(a.name)
        d, s = (c if a == FLOAT else None), (c if a in (STRING, NAME) else None)
        parts = {"rank": F.lit(RANK[a.name]), "kind": F.lit(a.name), "n": n, "d": d, "s": s}
        made = F.struct(*[(F.lit(None) if x is None else x).cast(_ANY[f].dataType).alias(f) for f, x in parts.items()])
        return F.when(c.isNotNull(), made)
    if b.name == "list":
        return F.transform(c, lambda e: convert(e, a.args[0], b.args[0]))
    if b.name == "map":
        return F.transform(c, lambda e: F.struct(convert(e["key"], a.args[0], b.args[0]).alias("key"), convert(e["value"], a.args[1], b.args[1]).alias("value")))
    if b.name == "pair":
        return F.struct(*[convert(c[f], x, y).alias(f) for f, x, y in zip(("first", "second"), a.args, b.args, strict=True)])
    if b.name == "struct":
        own = dict(zip(a.fields, a.args, strict=True))
        return F.struct(*[(convert(c.getField(f), own[f], k) if f in own else F.lit(None).cast(spark_type(k))).alias(f) for f, k in zip(b.fields, b.args, strict=True)])
    raise LanguageError(f"{a} is no {b}")


def narrow(c: Column, k: Kind, what: str) -> Column:
    """The values of kind k in a column of kind any; others are errors."""
    field = {"number": "n", "float64": "d", "string": "s", "name": "s", "time": "n", "duration": "n"}[k.name]
    v = c[field]
    v = F.timestamp_micros(F.call_function("div", v, F.lit(1000))) if k == TIME else interval(F.call_function("div", v, F.lit(1000))) if k == DURATION else v
    return F.when(c["kind"] == k.name, v).otherwise(F.raise_error(F.concat(F.lit(f"{what}: expected {k}, got /"), F.coalesce(c["kind"], F.lit("null")))).cast(spark_type(k)))


def micros(c: Column) -> Column:
    """Of a duration."""
    return F.unix_micros(F.expr(EPOCH) + c)


def interval(us: Column) -> Column:
    """A duration of so many microseconds."""
    sec = (us.cast("decimal(19,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), sec)


def literal(kind: str, value: object) -> tuple[Column, Kind]:
    """A constant as a column; times and durations are in nanoseconds, of which Spark keeps whole microseconds only."""
    k = Kind(kind)
    if kind in ("time", "duration"):
        if value <= -(2**63) or value >= 2**63 - 1:
            return F.timestamp_micros(F.lit((-1 if value < 0 else 1) * (2**63 // 1000))), k
        if value % 1000:
            raise LanguageError("times and durations have whole microseconds")
        us = value // 1000
        return (F.timestamp_micros(F.lit(us)) if kind == "time" else interval(F.lit(us))), k
    return F.lit(value).cast(spark_type(k)), k


@dataclass(frozen=True)
class Typed:
    """A column, its kind, and whether it may be null."""

    col: Column
    kind: Kind
    nullable: bool = False
    value: object = None  # of a constant


def equal(a: Typed, b: Typed) -> Column | None:
    """Equal values of equal kind; None if that can never be. Null equals null."""
    if a.kind != b.kind:
        if ANY in (a.kind, b.kind):
            if a.kind not in SCALARS or b.kind not in SCALARS:
                return None
            a, b = (Typed(convert(x.col, x.kind, ANY), ANY, x.nullable) for x in (a, b))
        elif a.kind.name != b.kind.name or not a.kind.args and not a.kind.fields:
            if BOT not in (a.kind, b.kind):
                return None
            return F.lit(False)
        else:
            try:
                k = unify(a.kind, b.kind)
            except LanguageError:
                return None
            a, b = (Typed(convert(x.col, x.kind, k), k, x.nullable) for x in (a, b))
    return a.col.eqNullSafe(b.col) if a.nullable and b.nullable else a.col == b.col


def unequal(a: Typed, b: Typed) -> Column:
    same = equal(a, b)
    if same is None:
        return F.lit(True)
    return ~F.coalesce(same, F.lit(False)) if a.nullable or b.nullable else ~same


def _number(x: Typed) -> Column:
    return {"time": lambda: F.unix_micros(x.col) * 1000, "duration": lambda: micros(x.col) * 1000}.get(x.kind.name, lambda: x.col)()


def order_key(x: Typed) -> Column:
    """A column that Spark orders as the values are."""
    if x.kind == ANY:
        return F.struct(x.col["rank"], F.coalesce(x.col["d"], x.col["n"].cast("double")), x.col["s"])
    return x.col


def ordered(op: str, a: Typed, b: Typed) -> Column:
    """a op b for <, <=, >, >=: across kinds by rank, numbers with times and durations as nanoseconds, null last."""
    fn = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
    ka, kb = a.kind.name, b.kind.name
    if ANY in (a.kind, b.kind):
        out = fn(*(order_key(Typed(convert(x.col, x.kind, ANY), ANY)) for x in (a, b)))
    elif ka == kb:
        out = fn(a.col, b.col)
    elif {ka, kb} == {"number", "float64"}:
        out = fn(a.col.cast("double"), b.col.cast("double"))
    elif "number" in (ka, kb) and (ka in ("time", "duration") or kb in ("time", "duration")):
        out = fn(_number(a), _number(b))
    else:
        out = F.lit(bool(fn(RANK[ka], RANK[kb])))
    if not (a.nullable or b.nullable):
        return out
    na, nb = a.col.isNull(), b.col.isNull()
    if a.nullable and not b.nullable:
        return (out | na) if op in (">", ">=") else F.coalesce(out, F.lit(False))
    if b.nullable and not a.nullable:
        return (out | nb) if op in ("<", "<=") else F.coalesce(out, F.lit(False))
    return F.when(na & nb, F.lit(op in ("<=", ">="))).when(na, F.lit(op in (">", ">="))).when(nb, F.lit(op in ("<", "<="))).otherwise(out)
