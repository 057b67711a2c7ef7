"""Barcode string algebra of the ballot vendors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Interleaved-2-of-5 symbols, narrow N and wide W, of the digits 0 to 9.
I2OF5 = ("NNWWN", "WNNNW", "NWNNW", "WWNNN", "NNWNW", "WNWNN", "NWWNN", "NNNWW", "WNNWN", "NWNWN")
#: Fixed value: the leading bits of a front page's code.
FRONT_BITS = "01111011110"


def _sub(c: Column, start: int, stop: int) -> Column:
    return F.substring(c, start + 1, stop - start)


def hart_fields(code: Column) -> dict[str, Column]:
    """Fields of a 14-digit code: sheet, precinct, page, language, party, checksum."""
    return {"sheet": _sub(code, 0, 1), "precinct": _sub(code, 1, 7), "page": _sub(code, 8, 9), "lang": _sub(code, 9, 10), "party": _sub(code, 10, 12), "checksum": _sub(code, 12, 14)}


def hart_weights(n: int = 12) -> list[int]:
    """82 times powers of 68, modulo 97."""
    return [82 * pow(68, i, 97) % 97 for i in range(n)]


def hart_checksum(code: Column, seed: int = 1) -> Column:
    """The check number of the first 12 digits: the weighted sum with a seed modulo 97, 1 written as 98 and 0 as 97."""
    total = reduce(lambda a, b: a + b, [_sub(code, i, i + 1).try_cast("int") * w for i, w in enumerate(hart_weights())], F.lit(seed)) % 97
    return F.when(total == 1, 98).when(total == 0, 97).otherwise(total)


def hart_valid(code: Column) -> Column:
    return F.coalesce(code.rlike(r"^\d{14}$") & (hart_checksum(code) == _sub(code, 12, 14).try_cast("int")), F.lit(False))


def i2of5_digit(symbol: Column) -> Column:
    """The digit of a five-bar symbol; null for any other string."""
    at = F.array_position(F.array(*[F.lit(s) for s in I2OF5]), symbol)
    return F.when(at > 0, (at - 1).cast("string"))


def i2of5_decode(bars: Column) -> Column:
    """Digits of a bar string: four guard bars, then ten bars for two digits (black and white interleaved), three guard bars at the end."""
    body = F.substring(bars, 5, 1 << 20)
    n = F.floor((F.length(bars) - 7) / 10).cast("int")
    ten = lambda i: F.split(F.substring(body, i * 10 + 1, F.lit(10)), "")
    every = lambda i, first: F.array_join(F.transform(F.sequence(F.lit(first), F.lit(9), F.lit(2)), lambda k: F.get(ten(i), k)), "")
    digits = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(i2of5_digit(every(i, 0)), i2of5_digit(every(i, 1))))
    return F.when(n > 0, F.when(~F.exists(digits, lambda d: d.isNull()), F.array_join(digits, "")))


def diebold_fields(bits: Column) -> dict[str, Column]:
    """Fields of a 32-bit string, most significant bit left: check bits, ballot, card, type and the page's marker."""
    return {"check": _sub(bits, 30, 32), "precinct": F.conv(_sub(bits, 17, 30), 2, 10), "card": F.conv(_sub(bits, 4, 17), 2, 10), "seq": F.conv(_sub(bits, 1, 4), 2, 10), "start": _sub(bits, 0, 1)}


def ones(bits: Column) -> Column:
    return F.length(F.regexp_replace(bits, "0", ""))


def diebold_valid(bits: Column) -> Column:
    """The number of ones in the first 30 bits modulo 4 is what the last two say."""
    return F.coalesce((F.length(bits) == 32) & (ones(_sub(bits, 0, 30)) % 4 == F.conv(_sub(bits, 30, 32), 2, 10).cast("int")), F.lit(False))


def diebold_page(bits: Column) -> Column:
    return F.when(bits.startswith(FRONT_BITS), 1).otherwise(0)


def diebold_sane(raw: Column) -> Column:
    """A raw string has 34 bits and a set guard bit at either end."""
    return F.coalesce((F.length(raw) == 34) & (_sub(raw, 0, 1) == "1") & (_sub(raw, 33, 34) == "1"), F.lit(False))


def strip_guards(raw: Column) -> Column:
    return F.substring(raw, 2, 32)


def sequoia_sane(left: Column, right: Column) -> Column:
    return F.coalesce((F.length(left) == 8) & (F.length(right) == 8), F.lit(False))
