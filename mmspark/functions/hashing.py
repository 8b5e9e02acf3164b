"""FNV-1a hashes and arithmetic modulo 2**61 - 1 as column expressions, safe under ANSI mode."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of FNV-1a and of the permutation family.
FNV32_BASIS, FNV32_PRIME = 2166136261, 16777619
FNV64_BASIS, FNV64_PRIME = 0xCBF29CE484222325, 0x100000001B3
MERSENNE = 2**61 - 1
DEFAULT_SEED, SECOND_SEED = 0x9E3779B97F4A7C15, 0xDEADBEEF
_M32 = 2**32 - 1


def utf8_view(s: Column) -> Column:
    """The UTF-8 bytes of a string, one Latin-1 character each."""
    return F.decode(F.encode(s, "UTF-8"), "ISO-8859-1")


def utf8_bytes(s: Column) -> Column:
    """The UTF-8 bytes of a string as an array of integers."""
    letters = F.filter(F.split(utf8_view(s), ""), lambda c: c != "")
    return F.transform(letters, lambda c: F.ascii(c).cast("long"))


def fnv1a32(s: Column) -> Column:
    """FNV-1a of 32 bits, as a non-negative long."""
    return F.aggregate(utf8_bytes(s), F.lit(FNV32_BASIS).cast("long"), lambda h, b: (h.bitwiseXOR(b) * F.lit(FNV32_PRIME)).bitwiseAND(F.lit(_M32)))


def fnv1a64(s: Column) -> Column:
    """FNV-1a of 64 bits as struct(hi, lo) of 32-bit halves; the prime is 2**40 + 435."""

    def step(h: Column, b: Column) -> Column:
        x = h["lo"].bitwiseXOR(b)
        low = x * F.lit(435)
        high = F.shiftright(low, 32) + h["hi"] * F.lit(435) + F.shiftleft(x, 8)
        return F.struct(high.bitwiseAND(F.lit(_M32)).alias("hi"), low.bitwiseAND(F.lit(_M32)).alias("lo"))

    start = F.struct(F.lit(FNV64_BASIS >> 32).cast("long").alias("hi"), F.lit(FNV64_BASIS & _M32).cast("long").alias("lo"))
    return F.aggregate(utf8_bytes(s), start, step)


def reduce_mersenne(h: Column) -> Column:
    """A 64-bit hash (hi, lo) modulo 2**61 - 1."""
    folded = F.shiftleft(h["hi"].bitwiseAND(F.lit(2**29 - 1)), 32) + h["lo"] + F.shiftright(h["hi"], 29)
    return F.pmod(folded, F.lit(MERSENNE))


def mulmod(a: Column, x: Column) -> Column:
    """a * x modulo 2**61 - 1 for a, x below it, in limbs of 30 and 31 bits."""
    low31, low30 = F.lit(2**31 - 1), F.lit(2**30 - 1)
    a1, a0, x1, x0 = F.shiftright(a, 31), a.bitwiseAND(low31), F.shiftright(x, 31), x.bitwiseAND(low31)
    mid = a1 * x0 + a0 * x1
    return F.pmod(F.lit(2) * a1 * x1 + F.shiftright(mid, 30) + F.shiftleft(mid.bitwiseAND(low30), 31) + a0 * x0, F.lit(MERSENNE))


def permute(x: Column, a: Column, b: Column) -> Column:
    """(a * x + b) modulo 2**61 - 1."""
    return F.pmod(mulmod(a, x) + b, F.lit(MERSENNE))


def fnv1a64_bytes(data: bytes, seed: int = 0) -> int:
    h = FNV64_BASIS ^ seed
    for b in data:
        h = (h ^ b) * FNV64_PRIME % 2**64
    return h


def permutation_seeds(k: int, master: int = DEFAULT_SEED) -> list[tuple[int, int]]:
    """The (a, b) of k permutations."""
    names = [i.to_bytes(4, "little") for i in range(k)]
    return [(fnv1a64_bytes(n, master) % (MERSENNE - 1) + 1, fnv1a64_bytes(n, master ^ SECOND_SEED) % MERSENNE) for n in names]
