"""Column expressions of vertices, partitions and integers; all of them stay in generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

M32 = 0xFFFFFFFF


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def div(a: Column, b: Column | int) -> Column:
    """Integer quotient."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def synthetic_weight(src: Column | str, dst: Column | str) -> Column:
    return (col(src) % 10 + col(dst) % 10).cast("double")


def ring_weight(i: Column | str) -> Column:
    """1 to 10, from an id."""
    return col(i) % 10 + 1


def grid_dimension(n: int) -> int:
    """Partitions of each axis of a grid over n vertices."""
    p = n * 8 // 1024 // 20
    return 256 if p > 2000 else 4 if p == 0 else p


def partition_id(v: Column | str, n: int, p: int) -> Column:
    """Of p ranges of n vertices, that of v: the first n % p ranges hold one vertex more."""
    v, size, more = col(v), n // p, n % p
    if more == 0:
        return div(v, max(size, 1)).cast("long")
    split = more * (size + 1)
    if size == 0:  # fewer vertices than ranges
        return v.cast("long")
    return F.when(v < split, div(v, size + 1)).otherwise(div(v - split, size) + more).cast("long")


def partition_range(i: Column | str, n: int, p: int) -> tuple[Column, Column]:
    """First vertex of range i, and the one after its last."""
    i, size, more = col(i), n // p, n % p
    begin = lambda k: k * size + F.least(k, F.lit(more))
    return begin(i).cast("long"), begin(i + 1).cast("long")


def sub_partition_id(v: Column | str, n: int, p: int, q: int) -> Column:
    """Of q ranges of the vertices of v's range, that of v."""
    v = col(v)
    begin, end = partition_range(partition_id(v, n, p), n, p)
    m, at = end - begin, v - begin
    size, more = div(m, q), m % q
    split = more * (size + 1)
    spread = F.when(at < split, div(at, size + 1)).otherwise(div(at - split, F.greatest(size, F.lit(1))) + more)
    return spread.cast("long")


def parse_uint(text: Column | str) -> Column:
    """The decimal number that a string begins with; zero without one."""
    digits = F.regexp_extract(col(text), "^[0-9]*", 0)
    return F.when(digits == "", F.lit(0)).otherwise(digits.try_cast("bigint")).cast("bigint")


def digits_read(text: Column | str) -> Column:
    """How many characters parse_uint reads."""
    return F.length(F.regexp_extract(col(text), "^[0-9]*", 0)).cast("long")


def bits(x: Column | str, offset: int, width: int) -> Column:
    return F.shiftright(col(x), offset).bitwiseAND(F.lit((1 << width) - 1))


def log2_up(i: Column | str) -> Column:
    """The least k with 2**k >= i, for i >= 1."""
    less = col(i) - 1
    return F.when(less <= 0, F.lit(0)).otherwise(F.length(F.bin(less))).cast("long")


#: Fixed steps of the integer hashes: constant, operator that takes it, operator between, shift, its direction.
HASH32 = [
    (0x7ED55D16, "+", "+", 12, "<<"),
    (0xC761C23C, "^", "^", 19, ">>"),
    (0x165667B1, "+", "+", 5, "<<"),
    (0xD3A2646C, "+", "^", 9, "<<"),
    (0xFD7046C5, "+", "+", 3, "<<"),
    (0xB55A4F09, "^", "^", 16, ">>"),
]
HASH64 = [
    (0x7ED55D166BEF7A1D, "+", "+", 12, "<<"),
    (0xC761C23C510FA2DD, "^", "^", 9, ">>"),
    (0x165667B183A9C0E1, "+", "+", 59, "<<"),
    (0xD3A2646CAB3487E3, "+", "^", 49, "<<"),
    (0xFD7046C5EF9AB54C, "+", "+", 3, "<<"),
    (0xB55A4F090DD4A67B, "^", "^", 32, ">>"),
]


def hash_int32(x: Column | str) -> Column:
    """A hash of unsigned 32-bit integers, in a long."""
    mask = lambda c: c.bitwiseAND(F.lit(M32))
    x = mask(col(x).cast("long"))
    for constant, first, between, shift, way in HASH32:
        a = mask(x + F.lit(constant)) if first == "+" else x.bitwiseXOR(F.lit(constant))
        b = mask(F.shiftleft(x, shift)) if way == "<<" else F.shiftright(x, shift)
        x = mask(a + b) if between == "+" else a.bitwiseXOR(b)
    return x


def add64(a: Column, b: Column) -> Column:
    """Sum modulo 2**64, by halves: ANSI addition would fail on overflow."""
    low = a.bitwiseAND(F.lit(M32)) + b.bitwiseAND(F.lit(M32))
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftright(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(M32)))


def hash_int64(x: Column | str) -> Column:
    """A hash of unsigned 64-bit integers, as a signed long of the same bits."""
    x = col(x).cast("long")
    # one lambda for each step: its argument is made once, where plain nesting would copy it
    for step in HASH64:
        x = F.transform(F.array(x), step64(step))[0]
    return x


def step64(step: tuple[int, str, str, int, str]) -> Callable[[Column], Column]:
    constant, first, between, shift, way = step
    k = F.lit(constant - (1 << 64) if constant >> 63 else constant)

    def apply(v: Column) -> Column:
        a = add64(v, k) if first == "+" else v.bitwiseXOR(k)
        b = F.shiftleft(v, shift) if way == "<<" else F.shiftrightunsigned(v, shift)
        return add64(a, b) if between == "+" else a.bitwiseXOR(b)

    return apply
