"""Column functions over hex strings and binary values.

Everything here builds Catalyst expressions (no Python per row), so the
work stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hex words are handled 8 digits (4 bytes) at a time so ``conv`` results
# always fit a signed long.
WORD_HEX = 8
UNROLL_WORDS = 8
#: Bytes of a long payload that are compared at a time.
WORD_BYTES = 7


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hex_valid(h) -> Column:
    """True when ``h`` parses as bytes: even length and only hex digits."""
    h = _c(h)
    return h.isNotNull() & (F.length(h) % 2 == 0) & h.rlike("^[0-9a-fA-F]*$")


def hex_len_bytes(h) -> Column:
    return (F.length(_c(h)) / 2).cast("int")


def hex_byte_at(h, i) -> Column:
    """Byte value (0..255) at 0-based byte position ``i`` of hex string ``h``."""
    h = _c(h)
    i = i if isinstance(i, Column) else F.lit(i)
    return F.conv(F.substr(h, i * 2 + 1, F.lit(2)), 16, 10).cast("int")


def hex_to_bytes(h) -> Column:
    """Binary value, or NULL for odd-length or non-hex input.

    Spark's ``unhex`` left-pads odd input; the parity guard makes it strict.
    """
    h = _c(h)
    return F.when(hex_valid(h), F.unhex(h))


def bytes_to_hex(b) -> Column:
    return F.lower(F.hex(_c(b)))


def hamming_hex(a, b) -> Column:
    """Bitwise Hamming distance between two hex payloads (double).

    Only the shorter length is compared; a null, invalid or empty input
    gives 0.0.
    """
    a, b = _c(a), _c(b)
    m = F.least(F.length(a), F.length(b))
    nwords = F.ceil(m / WORD_HEX).cast("int")

    def word(s, k):
        start = k * WORD_HEX + 1
        ln = F.least(F.lit(WORD_HEX), m - k * WORD_HEX)
        return F.conv(F.substr(s, start, ln), 16, 10).cast("long")

    def term(k):
        kk = k if isinstance(k, Column) else F.lit(k)
        return F.bit_count(word(a, kk).bitwiseXOR(word(b, kk)))

    # The first UNROLL_WORDS words (a 32-byte prefix) are plain expressions
    # that compile into generated code. Longer payloads become bytes once: a
    # place in a string is found by counting characters from its begin.
    acc = F.lit(0).cast("long")
    for k in range(UNROLL_WORDS):
        acc = acc + F.when(F.lit(k) < nwords, term(k)).otherwise(F.lit(0))

    def over_bytes(p):
        n = F.least(F.length(p["a"]), F.length(p["b"]))

        def at(x, k):
            return F.conv(F.hex(F.substr(x, k * WORD_BYTES + 1, F.least(F.lit(WORD_BYTES), n - k * WORD_BYTES))), 16, 10).cast("long")

        return F.aggregate(F.sequence(F.lit(0), F.ceil(n / WORD_BYTES).cast("int") - 1), F.lit(0).cast("long"),
                           lambda s, k: s + F.bit_count(at(p["a"], k).bitwiseXOR(at(p["b"], k))))

    both = F.struct(F.unhex(a).alias("a"), F.unhex(b).alias("b"))
    rest = F.element_at(F.transform(F.array(both), over_bytes), 1)
    total = F.when((nwords > UNROLL_WORDS) & hex_valid(a) & hex_valid(b), rest).otherwise(acc)
    return F.when(hex_valid(a) & hex_valid(b) & (m > 0),
                  total.cast("double")).otherwise(F.lit(0.0))


def be_uint(b, offset: int, nbytes: int) -> Column:
    """Unsigned big-endian integer at 0-based ``offset`` of binary ``b``."""
    return F.conv(F.hex(F.substring(_c(b), offset + 1, nbytes)), 16, 10).cast("long")


def le_uint32(b, offset) -> Column:
    """Unsigned little-endian 32-bit integer at 0-based ``offset`` (binary)."""
    b = _c(b)
    off = offset if isinstance(offset, Column) else F.lit(offset)
    parts = [F.conv(F.hex(F.substr(b, off + k + 1, F.lit(1))), 16, 10).cast("long")
             for k in range(4)]
    return parts[0] + F.shiftleft(parts[1], 8) + F.shiftleft(parts[2], 16) + \
        F.shiftleft(parts[3], 24)


def float32_from_bits(bits) -> Column:
    """IEEE-754 single precision value of an unsigned 32-bit pattern (double).

    Sign, exponent and mantissa are taken apart arithmetically; subnormals,
    infinities and NaN follow the standard.
    """
    bits = _c(bits)
    sign = F.when(F.shiftright(bits, 31).bitwiseAND(1) == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    exp = F.shiftright(bits, 23).bitwiseAND(0xFF)
    man = bits.bitwiseAND(0x7FFFFF).cast("double")
    normal = sign * (F.lit(1.0) + man / F.lit(float(1 << 23))) * F.pow(F.lit(2.0), exp - 127)
    sub = sign * (man / F.lit(float(1 << 23))) * F.pow(F.lit(2.0), F.lit(-126))
    special = F.when(man == 0, sign * F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return (F.when(exp == 0, sub).when(exp == 255, special).otherwise(normal))


def float32_at(b, offset, endian: str = "little") -> Column:
    """float32 at ``offset`` of binary ``b``; host order (little) by default."""
    if endian == "little":
        bits = le_uint32(b, offset)
    else:
        bits = be_uint(b, offset, 4)
    return float32_from_bits(bits)
