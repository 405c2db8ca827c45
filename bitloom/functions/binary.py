"""Native Column functions over binary values: everything here stays inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def window(data: Column, at: Column | int, n: Column | int) -> Column:
    """n bytes from the 0-based byte `at`."""
    at = F.lit(at) if isinstance(at, int) else at
    n = F.lit(n) if isinstance(n, int) else n
    return F.substring(data, (at + 1).try_cast("int"), n.try_cast("int"))


def once(value: Column) -> Column:
    """value, computed once a row: Catalyst neither copies a nondeterministic column into what uses
    it nor pushes a filter below it. (A partition's number is never below 0, which Catalyst doesn't know.)"""
    return F.when(F.spark_partition_id() >= 0, value)


def digits(raw: Column, size: int, big: bool) -> Column:
    """Hex digits of `size` bytes, most significant first."""
    h = F.hex(raw)
    return h if big or size == 1 else F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(size))])


def unsigned(raw: Column, size: int, big: bool = True) -> Column:
    """An unsigned integer: a long, or DECIMAL(20,0) for 8 bytes."""
    n = F.conv(digits(raw, size, big), 16, 10)
    return n.cast("decimal(20,0)") if size == 8 else n.cast("long")


def signed(raw: Column, size: int, big: bool = True) -> Column:
    if size == 8:
        return F.conv(digits(raw, 8, big), 16, -10).cast("long")
    n = unsigned(raw, size, big)
    return n - F.when(n >= 1 << 8 * size - 1, 1 << 8 * size).otherwise(0)


def real(raw: Column, size: int, big: bool = True) -> Column:
    """IEEE 754 from its bits: sign, exponent and mantissa, with infinities, NaN and -0.0."""
    h = digits(raw, size, big)
    high = F.conv(F.substring(h, 1, 8), 16, 10).cast("long")
    below, width, bias = (20, 11, 1075) if size == 8 else (23, 8, 150)
    mantissa = high.bitwiseAND((1 << below) - 1).cast("double")
    if size == 8:
        mantissa = mantissa * float(1 << 32) + F.conv(F.substring(h, 9, 8), 16, 10).cast("double")
    one, top = float(1 << (52 if size == 8 else 23)), (1 << width) - 1
    exponent = F.shiftright(high, below).bitwiseAND(top)
    sign = F.when(high >= 1 << 31, F.lit(-1.0)).otherwise(F.lit(1.0))
    normal = (mantissa + one) * F.pow(F.lit(2.0), (exponent - bias).cast("double"))
    value = F.when(exponent == 0, mantissa * math.ldexp(1.0, 1 - bias)).when(exponent < top, normal).when(mantissa == 0, F.lit(math.inf)).otherwise(F.lit(math.nan))
    return (value * sign).cast("double" if size == 8 else "float")


def text(raw: Column, encoding: str = "utf8", big: bool = True, padded: bool = False) -> Column:
    """Text of bytes; bad UTF-8 is replaced. padded: it ends at the first NUL."""
    if encoding == "utf8":
        out = F.make_valid_utf8(raw.cast("string"))
    else:
        out = F.decode(raw, {"utf16": "UTF-16BE" if big else "UTF-16LE"}.get(encoding, "ISO-8859-1"))
    return F.substring_index(out, "\0", 1) if padded else out


def hex_integer(value: Column, size: int, big: bool = True, signed_: bool = False) -> Column:
    """Hex digits of an integer in `size` bytes; out of range is an error."""
    if size == 8 and not signed_:
        h = F.lpad(F.conv(value.cast("string"), 10, 16), 16, "0")
        bad = (value < 0) | (value > F.lit("18446744073709551615").cast("decimal(20,0)"))
    else:
        v = value.cast("long")
        h = F.substring(F.lpad(F.hex(v), 16, "0"), 17 - 2 * size, 2 * size)
        low, high = (-(1 << 8 * size - 1), (1 << 8 * size - 1) - 1) if signed_ else (0, (1 << 8 * size) - 1)
        bad = F.lit(False) if size == 8 else (v < low) | (v > high)
    if not big and size > 1:
        h = F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(size))])
    return F.when(bad, F.raise_error(F.concat(F.lit(f"INVALID_VALUE: no {size}-byte integer: "), value.cast("string")))).otherwise(h)


def leb128(data: Column, at: Column | int = 0, most: int = 9) -> Column:
    """struct(value, size) of an unsigned LEB128 integer of at most `most` bytes and 63 bits; an
    error where it goes on, or where the data end within it."""
    start = F.struct(F.lit(0).cast("long").alias("value"), F.lit(0).alias("size"), F.lit(True).alias("open"))
    wrong = F.raise_error(F.lit("INVALID_ENCODING: a leb128 integer is too long or ends early"))

    def step(acc: Column, k: Column) -> Column:
        b = unsigned(window(data, F.lit(at) + k if isinstance(at, int) else at + k, 1), 1)
        return F.when(acc["open"], F.struct((acc["value"] + b.bitwiseAND(127) * F.pow(F.lit(128.0), k.cast("double")).cast("long")).alias("value"), (acc["size"] + 1).alias("size"), (b >= 128).alias("open"))).otherwise(acc)

    done = lambda a: F.struct(F.when(F.coalesce(a["open"], F.lit(True)), wrong.cast("long")).otherwise(a["value"]).alias("value"), a["size"].alias("size"))
    return F.when(data.isNotNull(), F.aggregate(F.sequence(F.lit(0), F.lit(most - 1)), start, step, done))


def crc32(data: Column) -> Column:
    return F.crc32(data)
