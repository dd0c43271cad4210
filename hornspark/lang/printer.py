"""Constants as program text."""

from __future__ import annotations

import datetime as dt

_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def quoted(s: str) -> str:
    if '"' in s:  # a string ends at the first delimiter, so the other one is used, or an escape
        s2 = "".join(c if c in "\"'" else _ESCAPES.get(c, c) for c in s)
        return f"'{s2}'" if "'" not in s else '"' + s2.replace('"', "\\x22") + '"'
    return '"' + "".join(_ESCAPES.get(c, c) for c in s) + '"'


def time_text(nanos: int) -> str:
    secs, frac = divmod(nanos, 10**9)
    t = dt.datetime(1970, 1, 1) + dt.timedelta(seconds=secs)
    return t.strftime("%Y-%m-%dT%H:%M:%S").rjust(19, "0") + (f".{frac:09d}".rstrip("0") if frac else "") + "Z"


def duration_text(nanos: int) -> str:
    """Hours, minutes and seconds, or one smaller unit, as in 1h30m0s, 2.5s, 500ms."""
    if not nanos:
        return "0s"
    sign, n = ("-" if nanos < 0 else ""), abs(nanos)

    def part(n, unit, digits, name):
        whole, rest = divmod(n, unit)
        return f"{whole}" + (f".{rest:0{digits}d}".rstrip("0") if rest else "") + name

    if n >= 10**9:
        h, n = divmod(n, 3600 * 10**9)
        m, n = divmod(n, 60 * 10**9)
        return sign + (f"{h}h" if h else "") + (f"{m}m" if h or m else "") + part(n, 10**9, 9, "s")
    for unit, digits, name in ((10**6, 6, "ms"), (10**3, 3, "µs")):
        if n >= unit:
            return sign + part(n, unit, digits, name)
    return f"{sign}{n}ns"


def float_text(x: float) -> str:
    """The shortest digits that give the same number, without an exponent; whole numbers without a point."""
    if x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "inf" if x > 0 else "-inf"
    from decimal import Decimal

    s = format(Decimal(repr(x)), "f")
    s = s.rstrip("0").rstrip(".") if "." in s else s
    return "-0" if s == "0" and str(x)[0] == "-" else s


def constant(c) -> str:
    match c.kind:
        case "number":
            return str(c.value)
        case "float64":
            s = float_text(c.value)
            return s if "." in s or not s.lstrip("-").isdigit() else s + ".0"
        case "string":
            return quoted(c.value)
        case "bytes":
            return 'b"' + "".join(chr(b) if 32 <= b < 127 and b not in (34, 92) else f"\\x{b:02x}" for b in c.value) + '"'
        case "time":
            return time_text(c.value)
        case "duration":
            return f"fn:duration:from_nanos({c.value})"
    return str(c.value)
