"""Error kinds and the number and text formats of the sinks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def error_kind(name: Column, message: Column) -> Column:
    """The kind of an error: its name if it has one; none for no error; the text before the first colon, if that isn't empty; the whole text if it is one word; else `error`. '' counts as no error."""
    colon = F.instr(message, ":")
    text = F.when(colon > 1, F.substring(message, F.lit(1), colon - 1)).when(F.instr(message, " ") == 0, message).otherwise("error")
    return F.coalesce(name, F.when(message.isNotNull(), text), F.lit(""))


def seconds(nanoseconds: Column) -> Column:
    return nanoseconds / F.lit(1e9)


# The short escapes of quoted text.
ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\a", "\\a"), ("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\v", "\\v"))


def quoted(text: Column) -> Column:
    """text in double quotes: quotes, backslashes and the usual control characters by their short escapes, others that don't print, spaces but the ASCII one included, as \\x, \\u or \\U and their number."""

    def shown(c: Column) -> Column:
        code = F.ascii(c)
        number = F.when(code < 128, F.concat(F.lit("\\x"), _hex(code, 2))).when(code < 65536, F.concat(F.lit("\\u"), _hex(code, 4))).otherwise(F.concat(F.lit("\\U"), _hex(code, 8)))
        out = F.when(c == ESCAPES[0][0], ESCAPES[0][1])
        for raw, short in ESCAPES[1:]:
            out = out.when(c == raw, short)
        return out.when(c.rlike(r"^[\p{C}\p{Z}&&[^ ]]$"), number).otherwise(c)

    plain = ~text.rlike(r'[\p{C}\p{Z}\\"&&[^ ]]')
    return F.concat(F.lit('"'), F.when(plain, text).otherwise(F.array_join(F.transform(F.split(text, ""), shown), "")), F.lit('"'))


def _hex(code: Column, digits: int) -> Column:
    return F.lpad(F.lower(F.hex(code)), digits, "0")


def label_value(text: Column) -> Column:
    """text in double quotes as the exposition format wants it: only backslashes, quotes and newlines are escaped."""
    for raw, shown in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        text = F.replace(text, F.lit(raw), F.lit(shown))
    return F.concat(F.lit('"'), text, F.lit('"'))


def shortest(x: Column) -> Column:
    """A double as the shortest text that gives it back: 0.25, 1e+06, 1.5e-05. An exponent stands from 1e+06 up and below 1e-04.

    The number is formatted once, to 17 digits; 15 and 16 are those rounded as whole numbers, to a power of ten at times.
    Generated code shares what stands twice where it is always needed, as text and d do in the first condition, and
    makes anew whatever stands in branches only.
    """
    a = F.abs(x)
    text = F.format_string("%.16e", a)
    d17, e17 = F.replace(F.substring(text, 1, 18), F.lit("."), F.lit("")).try_cast("long"), F.substring(text, 20, 9).try_cast("int")
    d16, d15 = (_div(d17 + 10**k // 2, 10**k) for k in (1, 2))
    same = lambda d, k: F.concat(d.cast("string"), F.lit("e"), (e17 - k).cast("string")).cast("double") == a
    d = F.when(same(d15, 14), d15 * 100).when(same(d16, 15), d16 * 10).otherwise(d17)
    digits, exp = F.rtrim(d.cast("string"), F.lit("0")), e17 + (d >= 10**17).cast("int")
    pointed = lambda whole, at: F.rtrim(F.concat(whole, F.lit("."), F.substring(digits, at, F.lit(17))), F.lit("."))
    long = F.concat(pointed(F.substring(digits, 1, 1), F.lit(2)), F.format_string("e%+03d", exp))
    whole = pointed(F.rpad(F.substring(digits, F.lit(1), exp + 1), exp + 1, "0"), exp + 2)
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exp - 1), digits)
    named = F.when(F.isnan(x), "NaN").when(x > 0, "+Inf").when(x < 0, "-Inf")
    return F.when((F.length(digits) + exp).isNull(), named).otherwise(F.concat(F.when(x < 0, "-").otherwise(""), F.when((exp < -4) | (exp >= 6), long).when(exp >= 0, whole).otherwise(small)))


def _div(n: Column, by: int) -> Column:
    return F.call_function("div", n, F.lit(by).cast("long"))


def escaped(text: Column) -> Column:
    """text for HTML and SVG, also in attributes."""
    for raw, shown in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(shown))
    return text


def nines(p: Column, most: Column) -> Column:
    """The percentile axis: log10(1 / (1 - p)), and `most` at p = 1."""
    return F.when(p >= 1.0, most.cast("double")).otherwise(F.log10(F.lit(1.0) / F.when(p >= 1.0, 1.0).otherwise(F.lit(1.0) - p)))


def nines_label(i: Column) -> Column:
    """The axis label of i nines: 0%, 90%, 99%, 99.9%, ..."""
    return F.when(i == 0, "0%").when(i == 1, "90%").when(i == 2, "99%").otherwise(F.concat(F.lit("99."), F.repeat(F.lit("9"), i - 2), F.lit("%")))


def duration(nanoseconds: Column) -> Column:
    """A duration as text, a fraction of a nanosecond cut off: hours, minutes and seconds from a second up (1h2m3.5s), else the largest unit that is not below one (1.5ms, 20µs, 7ns); 0s for zero."""
    signed = nanoseconds.cast("long")
    n = F.abs(signed)

    def part(value: Column, digits: int) -> Column:
        text = F.concat(_div(value, 10**digits).cast("string"), F.lit("."), F.lpad((value % 10**digits).cast("string"), digits, "0"))
        return F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))

    hour, minute = 3_600_000_000_000, 60_000_000_000
    hours = F.when(n >= hour, F.concat(_div(n, hour).cast("string"), F.lit("h"))).otherwise("")
    minutes = F.when(n >= minute, F.concat((_div(n, minute) % 60).cast("string"), F.lit("m"))).otherwise("")
    clock = F.concat(hours, minutes, part(n % minute, 9), F.lit("s"))
    out = F.when(n == 0, "0s").when(n < 1000, F.concat(n.cast("string"), F.lit("ns"))).when(n < 1_000_000, F.concat(part(n, 3), F.lit("µs"))).when(n < 1_000_000_000, F.concat(part(n, 6), F.lit("ms"))).otherwise(clock)
    return F.concat(F.when(signed < 0, "-").otherwise(""), out)


def with_viewbox(svg: Column, width: int, height: int) -> Column:
    """svg with a viewBox in its first tag; unchanged if it has no tag's end."""
    end = F.instr(svg, ">")
    box = F.concat(F.substring(svg, F.lit(1), end - 1), F.lit(f' viewBox="-0.5 -0.5 {width} {height}">'), F.substring(svg, end + 1, F.length(svg)))
    return F.when(end > 0, box).otherwise(svg)
