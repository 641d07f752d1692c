"""Column functions: evidence bounds, scores, hashes, random numbers, dates, checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

M32 = 0xFFFFFFFF


def recode(value: Column | str, unrelated: Column | str) -> Column:
    """A stored answer as it is shown: unrelated answers are 2."""
    return F.when(F.col(unrelated) if isinstance(unrelated, str) else unrelated, 2).otherwise(F.col(value) if isinstance(value, str) else value)


def rate(part: Column | str, whole: Column | str) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def wilson_lower(agree: Column | str, seen: Column | str, z: float = 1.96) -> Column:
    """Lower end of the Wilson interval, not under 0; 0 where nothing was seen. Counts that are
    negative or where agree exceeds seen raise."""
    if not 0 <= z <= 10:
        raise ValueError("z must be between 0 and 10")
    a, n = (F.col(c) if isinstance(c, str) else c for c in (agree, seen))
    a, n = a.cast("double"), n.cast("double")
    p, z2 = a / n, z * z
    low = (p + z2 / (2 * n) - z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)
    bad = (a < 0) | (n < a)
    return F.when(bad, F.raise_error(F.lit("invalid counts")).cast("double")).when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), low))


def has_evidence(agree: Column | str, seen: Column | str, min_votes: int = 10, min_rate: float = 0.6, z: float = 1.96, min_bound: float = 0.5) -> Column:
    """Whether a group's counts support an opinion; a bound of 0 turns that part off."""
    a, n = (F.col(c) if isinstance(c, str) else c for c in (agree, seen))
    enough = (n >= min_votes) & (rate(a, n) >= min_rate)
    return enough if min_bound == 0 else enough & (wilson_lower(a, n, z) > min_bound)


def consensus(counts: Column | str) -> Column:
    """Product of (agree + 1) / (seen + 2) over an array of structs of agree and seen."""
    return F.aggregate(counts, F.lit(1.0), lambda s, c: s * (c["agree"] + 1) / (c["seen"] + 2))


def multiply32(value: Column, factor: int) -> Column:
    """value * factor mod 2 ** 32, in halves so that no 64-bit product overflows."""
    high = F.shiftleft((value * F.lit(factor >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)
    return (high + value * F.lit(factor & 0xFFFF)).bitwiseAND(F.lit(M32))


def _xor_shift(value: Column, bits: int) -> Column:
    return value.bitwiseXOR(F.shiftrightunsigned(value, bits))


def utf16_units(text: Column | str) -> Column:
    """The UTF-16 units of a text as an array of numbers: a character beyond the first 65,536 is two."""
    t = F.col(text) if isinstance(text, str) else text
    points = F.transform(F.filter(F.split(t, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    high = lambda p: F.lit(0xD800) + F.shiftright(p - 0x10000, 10)
    low = lambda p: F.lit(0xDC00) + (p - 0x10000).bitwiseAND(F.lit(0x3FF))
    return F.flatten(F.transform(points, lambda p: F.when(p < 0x10000, F.array(p)).otherwise(F.array(high(p), low(p)))))


def text_hash(text: Column | str, salt: int = 0) -> Column:
    """A salted 32-bit FNV-1a hash over a text's UTF-16 units with a two-multiply finish, as a long."""
    value = F.aggregate(utf16_units(text), F.lit((2166136261 ^ salt) & M32).cast("long"), lambda h, c: multiply32(h.bitwiseXOR(c), 16777619))
    value = _xor_shift(multiply32(_xor_shift(value, 16), 0x7FEB352D), 15)
    return _xor_shift(multiply32(value, 0x846CA68B), 16)


def local_day(millis: Column | str, hours: int = 9) -> Column:
    """The civil day, at a fixed offset from UTC, of a time in milliseconds."""
    return F.date_format(F.timestamp_millis(F.col(millis) if isinstance(millis, str) else millis) + F.make_dt_interval(hours=F.lit(hours)), "yyyy-MM-dd")


def iso_day(millis: Column | str) -> Column:
    """The UTC date of a time in milliseconds; null for 0."""
    m = F.col(millis) if isinstance(millis, str) else millis
    return F.when(m != 0, F.date_format(F.timestamp_millis(m), "yyyy-MM-dd"))


def is_uuid(text: Column | str) -> Column:
    return F.coalesce((F.col(text) if isinstance(text, str) else text).rlike("^[a-f0-9-]{36}$"), F.lit(False))


def is_token(text: Column | str) -> Column:
    return F.coalesce((F.col(text) if isinstance(text, str) else text).rlike("^[a-f0-9]{64}$"), F.lit(False))


def is_opinion_text(text: Column | str) -> Column:
    return F.coalesce(F.length(F.trim(text)).between(8, 280), F.lit(False))


def finite(*coordinates: str) -> Column:
    """Whether all coordinates are numbers other than the infinities."""
    good = F.lit(True)
    for c in coordinates:
        good = good & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return good


def random_at(seed: Column | str, k: Column | int) -> Column:
    """Draw k (from 0) of the mulberry generator of a seed: any draw without those before it."""
    s = F.col(seed) if isinstance(seed, str) else seed
    n = k + 1 if isinstance(k, Column) else F.lit(k + 1)
    a = (s.cast("long") + multiply32(n.cast("long"), 0x6D2B79F5)).bitwiseAND(F.lit(M32))

    def times(x: Column, y: Column) -> Column:
        high = F.shiftleft((x * F.shiftrightunsigned(y, 16)).bitwiseAND(F.lit(0xFFFF)), 16)
        return (high + x * y.bitwiseAND(F.lit(0xFFFF))).bitwiseAND(F.lit(M32))

    v = times(_xor_shift(a, 15), a.bitwiseOR(F.lit(1)))
    v = v.bitwiseXOR((v + times(_xor_shift(v, 7), v.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(M32)))
    return _xor_shift(v, 14) / F.lit(4294967296.0)
