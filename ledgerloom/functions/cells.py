"""Validation and conversion of text cells as column expressions: amounts, times, ports, quoted records.

Everything stays in the JVM.  No expression backtracks or recurses over a cell, so cells may be of any length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_MARK = "\x01"
#: Largest magnitude of a signed 64-bit integer.
_MOST, _LEAST = "9223372036854775807", "9223372036854775808"


def trimmed(c: Column) -> Column:
    """Without the blanks (U+0020) around the value."""
    return F.trim(c)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, also where a lambda within uses it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def quoting_ok(line: Column) -> Column:
    """Whether each quoted cell of a comma-separated record is closed and followed by a comma or the end.

    Split at the quotes, every second part lies outside of quotes: such a part must be empty (a doubled quote)
    or begin and end with a comma; the first may be empty or end with one, the last be empty or begin with one.
    """

    def all_ok(parts: Column) -> Column:
        n = F.size(parts)

        def part_ok(x: Column, i: Column) -> Column:
            inside = F.pmod(i, F.lit(2)) == 1
            begins = (i == 0) | F.startswith(x, F.lit(","))
            ends = (i == n - 1) | F.endswith(x, F.lit(","))
            return inside | (x == "") | (begins & ends)

        return (F.pmod(n, F.lit(2)) == 1) & F.forall(F.transform(parts, part_ok), lambda x: x)

    return F.when(~F.contains(line, F.lit('"')), True).otherwise(_let(F.split(line, '"', -1), all_ok))


def cells(line: Column) -> Column:
    """The cells of a record whose quoting is right, unquoted; doubled quotes are read as one."""
    # outside of quotes a comma becomes a mark followed by "s"; a mark of the text itself becomes one followed by "e"
    safe = F.replace(line, F.lit(_MARK), F.lit(_MARK + "e"))

    def joined(parts: Column) -> Column:
        n = F.size(parts)

        def part(x: Column, i: Column) -> Column:
            outside = F.pmod(i, F.lit(2)) == 0
            doubled = outside & (x == "") & (i > 0) & (i < n - 1)
            return F.when(doubled, F.lit('"')).when(outside, F.replace(x, F.lit(","), F.lit(_MARK + "s"))).otherwise(x)

        return F.array_join(F.transform(parts, part), "")

    quoted = F.transform(F.split(_let(F.split(safe, '"', -1), joined), _MARK + "s", -1), lambda x: F.replace(x, F.lit(_MARK + "e"), F.lit(_MARK)))
    return F.when(F.contains(line, F.lit('"')), quoted).otherwise(F.split(line, ",", -1))


def _amount_parts(text: Column) -> tuple[Column, Column, Column]:
    """Is the form right; is it negative; the satoshis' digits without leading zeros."""
    t = trimmed(text)
    well_formed = t.rlike(r"\A[+-]?(?:[0-9]++(?:\.[0-9]{0,8})?|\.[0-9]{1,8})\z")
    bare = F.regexp_replace(t, r"\A[+-]", "")
    whole = F.substring_index(bare, ".", 1)
    fraction = F.when(F.contains(bare, F.lit(".")), F.substring_index(bare, ".", -1)).otherwise("")
    digits = F.regexp_replace(F.concat(whole, F.rpad(fraction, 8, "0")), r"\A0++", "")
    return well_formed, F.startswith(t, F.lit("-")), digits


def amount_ok(text: Column) -> Column:
    """An amount in BTC: optional sign, digits with at most one point and 8 decimals, within 64 bits as satoshis."""
    well_formed, negative, digits = _amount_parts(text)
    most = F.when(negative, _LEAST).otherwise(_MOST)
    fits = (F.length(digits) < 19) | ((F.length(digits) == 19) & (digits <= most))
    return F.coalesce(F.when(well_formed, fits).otherwise(False), F.lit(False))


def satoshis(text: Column) -> Column:
    """The amount as exact satoshis, null unless ``amount_ok``."""
    _, negative, digits = _amount_parts(text)
    return F.when(amount_ok(text), F.concat(F.when(negative, "-").otherwise(""), F.when(digits == "", "0").otherwise(digits)).try_cast("bigint"))


def amounts_ok(text: Column) -> Column:
    """Blank as a whole, or amounts parted by ``;``, none of them missing."""
    return F.coalesce((trimmed(text) == "") | F.forall(F.split(text, ";", -1), amount_ok), F.lit(False))


def amounts(text: Column) -> Column:
    """The list of satoshis, empty for a blank cell."""
    return F.when(trimmed(text) == "", F.expr("cast(array() as array<bigint>)")).otherwise(F.transform(F.split(text, ";", -1), satoshis))


def port_ok(text: Column) -> Column:
    """Blank, or ASCII digits only with a value of at most 65535."""
    t = trimmed(text)
    value = F.regexp_replace(t, r"\A0++", "")
    return F.coalesce((t == "") | (t.rlike(r"\A[0-9]++\z") & (F.length(value) <= 5) & (F.coalesce(F.when(F.length(value) <= 5, value).try_cast("int"), F.lit(0)) <= 65535)), F.lit(False))


def port(text: Column) -> Column:
    """The port, null for a blank cell and unless ``port_ok``."""
    return F.when(port_ok(text) & (trimmed(text) != ""), F.concat(F.lit("0"), F.substring(F.regexp_replace(trimmed(text), r"\A0++", ""), 1, 5)).try_cast("int"))


_TIME = r"\A([0-9]{4})-([0-9]{2})-([0-9]{2})T([0-9]{2}):([0-9]{2}):([0-9]{2})(?:\.([0-9]{1,9}))?(?:Z|([+-])([0-9]{2}):([0-9]{2}))\z"


def _time_parts(text: Column) -> tuple[Column, dict[str, Column]]:
    t = trimmed(text)
    form = t.rlike(_TIME)
    number = lambda k: F.when(form, F.regexp_extract(t, _TIME, k)).try_cast("int")
    names = ("year", "month", "day", "hour", "minute", "second")
    return form, {n: number(i + 1) for i, n in enumerate(names)} | {"off_h": F.coalesce(number(9), F.lit(0)), "off_m": F.coalesce(number(10), F.lit(0)), "fraction": F.regexp_extract(t, _TIME, 7), "sign": F.regexp_extract(t, _TIME, 8)}


def timestamp_ok(text: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SS[.f]`` with ``Z`` or an offset; a real date and time of day, offset to 23:59."""
    form, p = _time_parts(text)
    leap = (p["year"] % 4 == 0) & ((p["year"] % 100 != 0) | (p["year"] % 400 == 0))
    days = F.when(p["month"].isin(4, 6, 9, 11), 30).when(p["month"] == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    real = (p["year"] >= 1) & p["month"].between(1, 12) & (p["day"] >= 1) & (p["day"] <= days)
    clock = (p["hour"] <= 23) & (p["minute"] <= 59) & (p["second"] <= 59) & (p["off_h"] <= 23) & (p["off_m"] <= 59)
    return F.coalesce(form & real & clock, F.lit(False))


def micros(text: Column, apply_offset: bool = True) -> Column:
    """Microseconds since the epoch, null unless ``timestamp_ok``; digits beyond the sixth are cut off.

    With ``apply_offset=False`` the offset is read and left out, as evidence files are customarily taken in.
    """
    _, p = _time_parts(text)
    ok = timestamp_ok(text)
    days = F.unix_date(F.when(ok, F.make_date(p["year"], p["month"], p["day"]))).cast("bigint")
    seconds = days * 86400 + p["hour"] * 3600 + p["minute"] * 60 + p["second"]
    if apply_offset:
        offset = p["off_h"] * 3600 + p["off_m"] * 60
        seconds = seconds - F.when(p["sign"] == "-", -offset).otherwise(offset)
    return F.when(ok, seconds * 1_000_000 + F.rpad(F.substring(p["fraction"], 1, 6), 6, "0").try_cast("bigint"))


_EVIDENCE_TIME = r"\A([0-9]{1,6})-([0-9]{1,2})-([0-9]{1,2})T([0-9]{1,4}):([0-9]{1,4})(?::([0-9]{1,4}))?(?:\.(?:([0-9]{6})[^+\-]*|([0-9]{1,5})))?(?:[+\-].*)?\z"


def evidence_micros(text: Column) -> Column:
    """Microseconds of an evidence timestamp as it is customarily read: an offset is cut off, not applied; the fraction
    is cut at six digits; days run to 31 in any month and roll over; missing seconds are 0.  Null if malformed."""
    t = F.regexp_replace(F.trim(F.regexp_replace(text, r"^\s+|\s+$", "")), r"Z+\z", "")
    ok = t.rlike(_EVIDENCE_TIME)
    part = lambda i: F.when(ok, F.regexp_extract(t, _EVIDENCE_TIME, i))
    number = lambda i: part(i).try_cast("bigint")
    month, day = number(2), number(3)
    first = F.when(ok & month.between(1, 12) & day.between(1, 31), F.make_date(number(1).cast("int"), month.cast("int"), F.lit(1)))
    days = F.unix_date(first).cast("bigint") + day - 1
    seconds = days * 86400 + number(4) * 3600 + number(5) * 60 + F.coalesce(number(6), F.lit(0))
    fraction = F.rpad(F.concat(F.coalesce(part(7), F.lit("")), F.coalesce(part(8), F.lit(""))), 6, "0").try_cast("bigint")
    return seconds * 1_000_000 + F.coalesce(fraction, F.lit(0))
