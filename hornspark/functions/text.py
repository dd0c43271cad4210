"""Values as text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hornspark.kinds import DURATION, TIME, Kind, interval, micros

_DIV = lambda a, b: F.call_function("div", a, F.lit(b).cast("long"))


def let(c: Column, f) -> Column:
    """f of a column that is worked out once, which keeps large expressions small."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def float_text(x: Column) -> Column:
    """The shortest digits, without an exponent; whole numbers without a point."""

    def plain(s: Column) -> Column:
        digits = F.regexp_extract(s, r"^-?([0-9.]+)E", 1)
        parts = F.struct(
            F.regexp_replace(F.regexp_replace(digits, r"\.0$", ""), r"\.", "").alias("bare"),
            (F.instr(digits, ".") - 1 + F.regexp_extract(s, r"E(-?[0-9]+)$", 1).cast("int")).alias("before"),
            F.when(s.startswith("-"), "-").otherwise("").alias("sign"),
        )
        return let(parts, placed)

    def placed(p: Column) -> Column:
        bare, before = p["bare"], p["before"]  # digits, and how many of them are before the point
        out = F.when(before <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -before), bare)).when(before >= F.length(bare), F.rpad(bare, before, "0"))
        return F.concat(p["sign"], out.otherwise(F.concat(F.substring(bare, F.lit(1), before), F.lit("."), F.substring(bare, before + 1, F.length(bare)))))

    s = x.cast("string")
    simple = F.when(s == "Infinity", "inf").when(s == "-Infinity", "-inf").otherwise(F.regexp_replace(s, r"\.0$", ""))
    return F.when(s.contains("E"), plain(F.regexp_replace(s, "^(-?[0-9]+)E", "$1.0E"))).otherwise(simple)


def fraction(us: Column) -> Column:
    """Microseconds below a second as .5 or .000001, nothing if none."""
    return F.when(us == 0, "").otherwise(F.concat(F.lit("."), F.regexp_replace(F.lpad(us.cast("string"), 6, "0"), "0+$", "")))


def time_text(t: Column) -> Column:
    us = F.pmod(F.unix_micros(t), F.lit(1_000_000))
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), fraction(us), F.lit("Z"))


def duration_text(d: Column) -> Column:
    """Hours, minutes and seconds, or milliseconds or microseconds alone."""

    def said(n: Column) -> Column:
        h, m, sec = _DIV(n, 3_600_000_000), _DIV(n, 60_000_000) % 60, _DIV(n, 1_000_000) % 60
        hours = F.when(h > 0, F.concat(h.cast("string"), F.lit("h"))).otherwise("")
        minutes = F.when(n >= 60_000_000, F.concat(m.cast("string"), F.lit("m"))).otherwise("")
        ms = F.concat(_DIV(n, 1000).cast("string"), F.when(n % 1000 == 0, "").otherwise(F.concat(F.lit("."), F.regexp_replace(F.lpad((n % 1000).cast("string"), 3, "0"), "0+$", ""))), F.lit("ms"))
        long = F.concat(hours, minutes, sec.cast("string"), fraction(n % 1_000_000), F.lit("s"))
        return F.when(n == 0, "0s").when(n >= 1_000_000, long).when(n >= 1000, ms).otherwise(F.concat(n.cast("string"), F.lit("µs")))

    return let(micros(d), lambda n: F.concat(F.when(n < 0, "-").otherwise(""), let(F.abs(n), said)))


def shown(c: Column, k: Kind, inner: bool = False) -> Column:
    """As fn:string:concat shows it; strings within compounds are quoted, null is null."""
    match k.name:
        case "string":
            out = F.concat(F.lit('"'), F.replace(F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t")), F.lit('"')) if inner else c
        case "float64":
            out = float_text(c)
        case "time":
            out = time_text(c)
        case "duration":
            out = duration_text(c)
        case "list":
            out = F.concat(F.lit("["), F.array_join(F.transform(c, lambda e: shown(e, k.args[0], True)), ", "), F.lit("]"))
        case "pair":
            out = F.concat(F.lit("["), shown(c["first"], k.args[0], True), F.lit(", "), shown(c["second"], k.args[1], True), F.lit("]"))
        case "map":
            out = F.concat(F.lit("["), F.array_join(F.transform(c, lambda e: F.concat(shown(e["key"], k.args[0], True), F.lit(": "), shown(e["value"], k.args[1], True))), ", "), F.lit("]"))
        case "struct":
            parts = [F.when(c.getField(f).isNotNull(), F.concat(F.lit(f"{f}: "), shown(c.getField(f), a, True))) for f, a in zip(k.fields, k.args, strict=True)]
            out = F.concat(F.lit("{"), F.array_join(F.array(*parts), ", ") if parts else F.lit(""), F.lit("}"))
        case "any":
            us = _DIV(c["n"], 1000)
            out = F.when(c["kind"] == "number", c["n"].cast("string")).when(c["kind"] == "float64", float_text(c["d"])).when(c["kind"] == "name", c["s"]).when(c["kind"] == "time", shown(F.timestamp_micros(us), TIME)).when(c["kind"] == "duration", shown(interval(us), DURATION)).otherwise(shown(c["s"], Kind("string"), inner))
        case _:
            out = c.cast("string")
    return F.coalesce(out, F.lit("null"))


__all__ = ["duration_text", "float_text", "fraction", "shown", "time_text"]
