"""64-bit SimHash as four 16-bit counters in each of sixteen sums, so that it is one ordinary aggregation.

Bit k + 16 * lane of a feature's hash is added to counter `lane` of sum k. Up to 16383 features fit; longer inputs take two 32-bit
counters in each of thirty-two sums (`wide_sums`, `wide_fingerprint`), which give the same fingerprint.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PIECE = 16383
_ONES = 0x0001000100010001

# Words for fuzzy comparison: letters, marks and digits in lower case; everything else separates. Ranges tell a-z and 0-9, most of all
# characters, without a look at their category.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x{10FFFF}&&[^\p{L}\p{M}\p{N}]]+"


def words(text: Column | str) -> Column:
    return F.array_remove(F.split(F.lower(text), SEPARATORS), "")


def sums(h: Column) -> list[Column]:
    """The sixteen sums of 64-bit feature hashes."""
    return [F.sum(F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_ONES))).alias(f"_s{k}") for k in range(16)]


def fingerprint(count: Column | str) -> Column:
    """The majority bit of every counter: 2 * counter > count. Adding 16383 - count / 2 sets a counter's bit 14 then."""
    c = F.col(count) if isinstance(count, str) else count
    bias = (F.lit(16383) - F.floor(c / 2).cast("long")) * F.lit(_ONES)
    bits = [F.shiftleft(F.shiftrightunsigned(F.col(f"_s{k}") + bias, 14).bitwiseAND(F.lit(_ONES)), k) for k in range(16)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def wide_sums(h: Column) -> list[Column]:
    """The same counts in thirty-two sums, for up to 2^31 - 1 features."""
    return [F.sum(F.shiftrightunsigned(h, k).bitwiseAND(F.lit(0x0000000100000001))).alias(f"_s{k}") for k in range(32)]


def wide_fingerprint(count: str) -> Column:
    def bit(k: int, lane: int) -> Column:
        counter = F.shiftrightunsigned(F.col(f"_s{k}"), 32 * lane).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.shiftleft((2 * counter > F.col(count)).cast("long"), k + 32 * lane)
    return reduce(lambda a, b: a.bitwiseOR(b), [bit(k, lane) for k in range(32) for lane in range(2)])


def block(fp: Column | str, number: int, width: int) -> Column:
    c = F.col(fp) if isinstance(fp, str) else fp
    return F.shiftrightunsigned(c, number * width).bitwiseAND(F.lit((1 << width) - 1))
