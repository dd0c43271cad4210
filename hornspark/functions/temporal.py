"""Times and durations, in UTC and whole microseconds; integers count nanoseconds."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hornspark.functions.registry import function, need, number
from hornspark.functions.text import time_text
from hornspark.kinds import DURATION, FLOAT, NAME, NUMBER, STRING, TIME, Typed, interval, micros
from hornspark.lang.syntax import LanguageError

_DIV = lambda a, b: F.call_function("div", a, F.lit(b).cast("long"))
#: Precisions and their patterns: fixed values.
FORMATS = {"/year": "yyyy", "/month": "yyyy-MM", "/day": "yyyy-MM-dd", "/hour": "yyyy-MM-dd'T'HH'Z'", "/minute": "yyyy-MM-dd'T'HH:mm'Z'", "/second": "yyyy-MM-dd'T'HH:mm:ss'Z'", "/millisecond": "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "/microsecond": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"}
#: Units of a duration as text, in nanoseconds: fixed values.
UNITS = {"ns": 1, "us": 10**3, "µs": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9}


def _time(x: Typed, what: str) -> Column:
    return need(x, TIME, what=what)


def _span(x: Typed, what: str) -> Column:
    return need(x, DURATION, what=what)


def _nanos(n: Column, what: str) -> Column:
    """Whole microseconds of a number of nanoseconds."""
    return F.when(n % 1000 == 0, _DIV(n, 1000)).otherwise(F.raise_error(F.lit(f"{what}: whole microseconds only")).cast("long"))


@function("fn:time:now")
def now():
    return Typed(F.current_timestamp(), TIME)


@function("fn:time:add")
def add(t, d):
    return Typed(_time(t, "fn:time:add") + _span(d, "fn:time:add"), TIME)


@function("fn:time:sub")
def sub(t, x):
    """A time less a time is a duration, less a duration a time."""
    a = _time(t, "fn:time:sub")
    if x.kind == TIME:
        return Typed(interval(F.unix_micros(a) - F.unix_micros(x.col)), DURATION)
    return Typed(a - _span(x, "fn:time:sub"), TIME)


for _name, _part in {"year": F.year, "month": F.month, "day": F.day, "hour": F.hour, "minute": F.minute, "second": F.second}.items():
    function(f"fn:time:{_name}")(lambda t, n=_name, p=_part: Typed(p(_time(t, f"fn:time:{n}")).cast("long"), NUMBER))


@function("fn:time:from_unix_nanos")
def from_unix_nanos(n):
    return Typed(F.timestamp_micros(_nanos(number(n, "fn:time:from_unix_nanos"), "fn:time:from_unix_nanos")), TIME)


@function("fn:time:to_unix_nanos")
def to_unix_nanos(t):
    return Typed(F.unix_micros(_time(t, "fn:time:to_unix_nanos")) * 1000, NUMBER)


@function("fn:time:trunc")
def trunc(t, unit):
    c = _time(t, "fn:time:trunc")
    units = ("/nanosecond", "/microsecond", "/millisecond", "/second", "/minute", "/hour", "/day")
    if unit.value not in units:
        raise LanguageError(f"fn:time:trunc: the unit is one of {', '.join(units)}")
    return Typed(c if unit.value in units[:2] else F.date_trunc(unit.value[1:], c), TIME)


def _formatted(c: Column, precision: Typed, what: str) -> Typed:
    need(precision, STRING, NAME, what=what)
    p = precision.value
    if p == "/nanosecond":
        return Typed(time_text(c), STRING)
    if p not in FORMATS:
        raise LanguageError(f"{what}: the precision is one of {', '.join([*FORMATS, '/nanosecond'])}")
    return Typed(F.date_format(c, FORMATS[p]), STRING)


@function("fn:time:format")
def format_time(t, precision):
    return _formatted(_time(t, "fn:time:format"), precision, "fn:time:format")


def _offset(zone: Typed, what: str) -> Column:
    """A zone, UTC or +05:30, as microseconds."""
    z = need(zone, STRING, what=what)
    part = lambda i: F.regexp_extract(z, r"^([+-])(\d+):(\d+)$", i)
    us = (part(2).cast("long") * 60 + part(3).cast("long")) * F.when(part(1) == "-", -60_000_000).otherwise(60_000_000)
    return F.when(z == "UTC", F.lit(0).cast("long")).when(z.rlike(r"^[+-]\d+:\d+$"), us).otherwise(F.raise_error(F.concat(F.lit(f"{what}: unknown zone "), z)).cast("long"))


@function("fn:time:format_civil")
def format_civil(t, zone, precision):
    shifted = F.timestamp_micros(F.unix_micros(_time(t, "fn:time:format_civil")) + _offset(zone, "fn:time:format_civil"))
    return _formatted(shifted, precision, "fn:time:format_civil")


@function("fn:time:parse_rfc3339")
def parse_rfc3339(s):
    return Typed(need(s, STRING, what="fn:time:parse_rfc3339").cast("timestamp"), TIME)


@function("fn:time:parse_civil")
def parse_civil(s, zone):
    local = F.regexp_replace(need(s, STRING, what="fn:time:parse_civil"), "Z$", "").cast("timestamp")
    return Typed(F.timestamp_micros(F.unix_micros(local) - _offset(zone, "fn:time:parse_civil")), TIME)


@function("fn:duration:add")
def duration_add(a, b):
    return Typed(_span(a, "fn:duration:add") + _span(b, "fn:duration:add"), DURATION)


@function("fn:duration:mult")
def duration_mult(a, b):
    d, n = (a, b) if a.kind == DURATION else (b, a)
    return Typed(interval(micros(_span(d, "fn:duration:mult")) * number(n, "fn:duration:mult")), DURATION)


for _name, _us in {"hours": 3_600_000_000, "minutes": 60_000_000, "seconds": 1_000_000}.items():
    function(f"fn:duration:{_name}")(lambda d, n=_name, u=_us: Typed(micros(_span(d, f"fn:duration:{n}")) / F.lit(float(u)), FLOAT))
    function(f"fn:duration:from_{_name}")(lambda x, n=_name, u=_us: Typed(interval(number(x, f"fn:duration:from_{n}") * u), DURATION))


@function("fn:duration:nanos")
def duration_nanos(d):
    return Typed(micros(_span(d, "fn:duration:nanos")) * 1000, NUMBER)


@function("fn:duration:from_nanos")
def duration_from_nanos(n):
    return Typed(interval(_nanos(number(n, "fn:duration:from_nanos"), "fn:duration:from_nanos")), DURATION)


@function("fn:duration:parse")
def duration_parse(s):
    """Numbers with units one after another, as in -1h30m1.5s; 0 needs no unit."""
    c = need(s, STRING, what="fn:duration:parse")
    parts = F.regexp_extract_all(c, F.lit(r"[0-9.]+(?:ns|us|µs|ms|s|m|h)"), F.lit(0))
    scale = F.create_map(*[F.lit(x) for u, n in UNITS.items() for x in (u, n)])
    one = lambda p: (F.regexp_extract(p, r"^([0-9.]+)", 1).cast("decimal(28,9)") * F.element_at(scale, F.regexp_extract(p, r"([^0-9.]+)$", 1)).cast("decimal(14,0)")).cast("long")
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a + one(p)) * F.when(c.startswith("-"), -1).otherwise(1)
    ok = c.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?(ns|us|µs|ms|s|m|h))+$|^0$")
    return Typed(interval(F.when(ok, _DIV(total, 1000)).otherwise(F.raise_error(F.concat(F.lit("fn:duration:parse: no duration: "), c)).cast("long"))), DURATION)

