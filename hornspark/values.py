"""Python values for facts, and back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from hornspark.kinds import BOT, BYTES, DURATION, FLOAT, NAME, NUMBER, STRING, TIME, Kind, list_of, map_of, pair_of, spark_type, struct_of, unify
from hornspark.lang.syntax import Call, Const, LanguageError, Term


#: Stand for no bound of time.
BEGINNING, FOREVER = dt.datetime.min, dt.datetime.max
_LIMIT = 2**63 // 1000


class Name(str):
    """A name constant such as /a/b, which is not the string of the same text."""

    def __repr__(self) -> str:
        return str(self)


class Pair(tuple):
    pass


class Entries(tuple):
    """A map as (key, value) entries in order."""


def kind_of(v: object) -> Kind:
    match v:
        case None:
            return BOT
        case Name():
            return NAME
        case bool() | int():
            return NUMBER
        case float():
            return FLOAT
        case str():
            return STRING
        case bytes():
            return BYTES
        case dt.timedelta():
            return DURATION
        case dt.date():
            return TIME
        case Pair():
            return pair_of(*map(kind_of, v))
        case Entries():
            return map_of(_all(k for k, _ in v), _all(x for _, x in v))
        case dict():
            return struct_of({_field(f): kind_of(x) for f, x in v.items()})
        case list() | tuple():
            return list_of(_all(v))
    raise LanguageError(f"no kind for {v!r}")


def _all(values) -> Kind:
    k = BOT
    for v in values:
        k = unify(k, kind_of(v))
    return k


def _field(f: str) -> str:
    return f if f.startswith("/") else "/" + f


def spark_value(v: object, k: Kind) -> object:
    """A value for createDataFrame with the type of its kind."""
    if v is None:
        return None
    match k.name:
        case "any":
            own = kind_of(v)
            n = int(v) if own == NUMBER else _nanos(v) if own in (TIME, DURATION) else None
            from hornspark.kinds import RANK

            return (RANK[own.name], own.name, n, v if own == FLOAT else None, str(v) if own in (STRING, NAME) else None)
        case "number":
            return int(v)
        case "float64":
            return float(v)
        case "string" | "name":
            return str(v)
        case "time":
            v = v if isinstance(v, dt.datetime) else dt.datetime(v.year, v.month, v.day)
            return v if v.tzinfo else v.replace(tzinfo=dt.timezone.utc)
        case "list":
            return [spark_value(x, k.args[0]) for x in v]
        case "pair":
            return tuple(spark_value(x, a) for x, a in zip(v, k.args, strict=True))
        case "map":
            return [(spark_value(a, k.args[0]), spark_value(b, k.args[1])) for a, b in v]
        case "struct":
            own = {_field(f): x for f, x in v.items()}
            return tuple(spark_value(own.get(f), a) for f, a in zip(k.fields, k.args, strict=True))
    return v


def _nanos(v: object) -> int:
    if v in (BEGINNING, FOREVER):
        return -(2**63) if v == BEGINNING else 2**63 - 1
    if isinstance(v, dt.timedelta):
        return (v.days * 86_400 + v.seconds) * 10**9 + v.microseconds * 1000
    t = v if isinstance(v, dt.datetime) else dt.datetime(v.year, v.month, v.day)
    return _nanos((t.replace(tzinfo=None) if t.tzinfo is None else t.astimezone(dt.timezone.utc).replace(tzinfo=None)) - dt.datetime(1970, 1, 1))


def python_value(v: object, k: Kind) -> object:
    """A collected value as one that can be given back: names as Name, structs as dict, times without a zone in UTC."""
    if v is None:
        return None
    match k.name:
        case "name":
            return Name(v)
        case "any":
            one = {"number": v["n"], "float64": v["d"], "string": v["s"]}
            if v["kind"] in one:
                return one[v["kind"]]
            if v["kind"] == "name":
                return Name(v["s"])
            span = dt.timedelta(microseconds=v["n"] // 1000)
            return span if v["kind"] == "duration" else dt.datetime(1970, 1, 1) + span
        case "list":
            return [python_value(x, k.args[0]) for x in v]
        case "pair":
            return Pair(python_value(x, a) for x, a in zip(v, k.args, strict=True))
        case "map":
            return Entries((python_value(a, k.args[0]), python_value(b, k.args[1])) for a, b in v)
        case "struct":
            return {f: python_value(x, a) for f, x, a in zip(k.fields, v, k.args, strict=True) if x is not None}
    return v


def constant(t: Term) -> object:
    """A constant term, as in a fact, as a Python value."""
    match t:
        case Const("time", n) | Const("duration", n):
            if t.kind == "time" and not -(2**63) < n < 2**63 - 1:
                return BEGINNING if n < 0 else FOREVER
            if n % 1000:
                raise LanguageError("times and durations have whole microseconds")
            span = dt.timedelta(microseconds=n // 1000)
            return span if t.kind == "duration" else dt.datetime(1970, 1, 1) + span
        case Const("name", s):
            return Name(s)
        case Const(_, v):
            return v
        case Call("fn:list", args):
            return [constant(a) for a in args]
        case Call("fn:pair", (a, b)):
            return Pair((constant(a), constant(b)))
        case Call("fn:struct", args) if len(args) % 2 == 0:
            return {constant(f): constant(v) for f, v in zip(args[::2], args[1::2], strict=True)}
        case Call("fn:map", args) if len(args) % 2 == 0:
            return Entries((constant(k), constant(v)) for k, v in zip(args[::2], args[1::2], strict=True))
    raise LanguageError(f"{t} is no constant")


def term(v: object) -> Term:
    """A Python value as a constant term."""
    match kind_of(v).name:
        case "time" | "duration" as k:
            return Const(k, _nanos(v))
        case "list":
            return Call("fn:list", tuple(map(term, v)))
        case "pair":
            return Call("fn:pair", tuple(map(term, v)))
        case "map":
            return Call("fn:map", tuple(term(x) for kv in v for x in kv))
        case "struct":
            return Call("fn:struct", tuple(x for f, y in v.items() for x in (Const("name", _field(f)), term(y))))
        case "number":
            return Const("number", int(v))
        case k:
            return Const(k, str(v) if k in ("string", "name") else v)


def key(row: tuple) -> tuple:
    """Rows are the same if these are: Python takes 1 for 1.0, and a name for the string of the same text."""
    return tuple((kind_of(v), v if v is None or getattr(v, "__hash__", None) and not isinstance(v, tuple) else repr(v)) for v in row)


def once(rows: list[tuple]) -> list[tuple]:
    return list({key(r): r for r in rows}.values())


def rows_frame(spark, rows: list[tuple], kinds: list[Kind]):
    """Rows of Python values as a DataFrame with columns c0, c1, ..."""
    from pyspark.sql import types as T

    # times go as microseconds: Python's cannot stand for the far ends
    schema = T.StructType([T.StructField(f"c{i}", T.LongType() if k == TIME else spark_type(k)) for i, k in enumerate(kinds)])
    made = [tuple(time_micros(v) if k == TIME else spark_value(v, k) for v, k in zip(r, kinds, strict=True)) for r in rows]
    return spark.createDataFrame(made, schema).select(*[(F.timestamp_micros(f"c{i}") if k == TIME else F.col(f"c{i}")).alias(f"c{i}") for i, k in enumerate(kinds)])


def time_micros(v: dt.date | None) -> int | None:
    if v is None:
        return None
    return -_LIMIT if v == BEGINNING else _LIMIT if v == FOREVER else _nanos(v) // 1000


def micros_time(us: int | None) -> dt.datetime | None:
    if us is None:
        return None
    return BEGINNING if us == -_LIMIT else FOREVER if us == _LIMIT else dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=us)


__all__ = ["BEGINNING", "FOREVER", "Entries", "Name", "Pair", "micros_time", "constant", "key", "kind_of", "once", "python_value", "rows_frame", "spark_value", "time_micros", "term"]
