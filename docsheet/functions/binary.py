"""Scalars of the binary formats as column functions: little-endian integers, variable-length integers, lengths, checksums.

Decoders take a binary column and an offset from 0; beyond the end the result is null. Encoders give binary.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _at(offset) -> Column:
    return offset if isinstance(offset, Column) else F.lit(offset)


def uint(data: Column, offset, size: int) -> Column:
    """Unsigned little-endian integer of ``size`` bytes."""
    part = F.substring(data, (_at(offset) + 1).cast("int"), F.lit(size))
    turned = F.concat(*[F.substring(part, F.lit(k), F.lit(1)) for k in range(size, 0, -1)])
    return F.when((F.length(part) == size) & (_at(offset) >= 0), F.conv(F.hex(turned), 16, 10).cast("long"))


def sint(data: Column, offset) -> Column:
    """32 bits, the highest of them the sign."""
    raw = uint(data, offset, 4)
    return F.when(raw >= 1 << 31, (1 << 31) - raw).otherwise(raw)


def s_varint(data: Column, offset) -> Column:
    """(value, size): low bits 10 one byte, low bits 101 two bytes; null for others."""
    one, two = uint(data, offset, 1), uint(data, offset, 2)
    return F.when(one.bitwiseAND(3) == 2, F.struct(F.shiftright(one, 2).alias("value"), F.lit(1).alias("size"))).when(one.bitwiseAND(7) == 5, F.struct(F.shiftright(two, 3).alias("value"), F.lit(2).alias("size")))


def x_varint(data: Column, offset) -> Column:
    """(value, size): low bit 0 one byte, low bits 01 two, low bits 011 four; null for others."""
    one, two, four = (uint(data, offset, k) for k in (1, 2, 4))
    made = lambda raw, bits, size: F.struct(F.shiftright(raw, bits).alias("value"), F.lit(size).alias("size"))
    return F.when(one.bitwiseAND(1) == 0, made(one, 1, 1)).when(one.bitwiseAND(3) == 1, made(two, 2, 2)).when(one.bitwiseAND(7) == 3, made(four, 3, 4))


def little(value: Column, size: int) -> Column:
    """The bytes of an unsigned integer; null for what doesn't fit."""
    whole = value.cast("long")
    digits = F.lpad(F.hex(whole), 2 * size, "0")
    return F.when((whole >= 0) & (F.lit(True) if size == 8 else whole < 1 << 8 * size), F.unhex(F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in range(size - 1, -1, -1)])))


def s_encode(value: Column) -> Column:
    """0 to 0x1FFF; null beyond."""
    return F.when(value < 0x40, little(value * 4 + 2, 1)).when(value < 0x2000, little(value * 8 + 5, 2))


def x_encode(value: Column) -> Column:
    """0 to 0x1FFFFFFF; null beyond."""
    return F.when(value < 0x80, little(value * 2, 1)).when(value < 0x4000, little(value * 4 + 1, 2)).when(value < 0x20000000, little(value * 8 + 3, 4))


def boolean(data: Column, offset) -> Column:
    """A byte that is 0 or true."""
    return uint(data, offset, 1) != 0


def bool_encode(value: Column) -> Column:
    return little(value.cast("int"), 1)


def double(data: Column, offset) -> Column:
    """IEEE double, little-endian, from its sign, exponent and fraction."""
    low, high = uint(data, offset, 4), uint(data, _at(offset) + 4, 4)
    exponent = F.shiftright(high, 20).bitwiseAND(0x7FF)
    fraction = (high.bitwiseAND(0xFFFFF) * float(1 << 32) + low) / float(1 << 52)
    size = F.when(exponent == 0, fraction * F.lit(2.0**-1022)).when(exponent < 0x7FF, (1 + fraction) * F.pow(F.lit(2.0), exponent - 1023)).when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return F.when(high >= 1 << 31, -size).otherwise(size)


def counted_string(data: Column, offset, length: Column) -> Column:
    """``length`` bytes of text at ``offset``; null if they go beyond the end."""
    part = F.substring(data, (_at(offset) + 1).cast("int"), length.cast("int"))
    return F.when((F.length(part) == length) & (_at(offset) >= 0), F.decode(part, "UTF-8"))


def short_string(data: Column, offset) -> Column:
    """(value, size): one byte with the number of bytes, and the text."""
    n = uint(data, offset, 1)
    return F.struct(counted_string(data, _at(offset) + 1, n).alias("value"), (n + 1).alias("size"))


def s_string(data: Column, offset) -> Column:
    """(value, size): an S integer with the number of bytes, and the text."""
    n = s_varint(data, offset)
    return F.struct(counted_string(data, _at(offset) + n["size"], n["value"]).alias("value"), (n["value"] + n["size"]).alias("size"))


def s_string_encode(text: Column) -> Column:
    """Up to 0x1FFF bytes; null beyond."""
    raw = F.encode(text, "UTF-8")
    return F.concat(s_encode(F.length(raw)), raw)


def cell_offset(raw: Column) -> Column:
    """(offset, absolute) of half a packed cell reference of 16 bits: bit 15 the sign, bit 14 set for absolute, 14 bits of size."""
    size = raw.bitwiseAND(0x3FFF)
    return F.struct(F.when(raw.bitwiseAND(0x8000) != 0, -size).otherwise(size).alias("offset"), (raw.bitwiseAND(0x4000) != 0).alias("absolute"))


def sint_encode(value: Column) -> Column:
    """32 bits, the highest of them the sign; null beyond 31 bits of size."""
    return F.when(F.abs(value) < 1 << 31, little(F.abs(value.cast("long")) + F.when(value < 0, F.lit(1 << 31)).otherwise(F.lit(0)).cast("long"), 4))


def flags(value: Column, names: list[str]) -> Column:
    """A struct of booleans, the first name for the lowest bit; empty names are bits without one."""
    return F.struct(*[(F.shiftright(value, k).bitwiseAND(1) == 1).alias(n) for k, n in enumerate(names) if n])


def length_raw(cm: Column) -> Column:
    """The 1/1440 inches of a length, to the nearest."""
    return F.floor(cm * 1440 / F.lit(2.54) + 0.5)


def size_raw(points: Column) -> Column:
    return F.floor(points * 20 + 0.5)


def length_cm(raw: Column) -> Column:
    """Centimetres of a length in 1/1440 inch."""
    return raw * F.lit(2.54) / 1440


def size_pt(raw: Column) -> Column:
    return raw / F.lit(20.0)


def _crc16(codes: list[Column]) -> Column:
    """CRC-16 (polynomial 0x1021, start 0) of byte values: a fold over bytes of eight shifts each."""
    step = lambda acc, b: F.aggregate(F.sequence(F.lit(1), F.lit(8)), acc.bitwiseXOR(F.shiftleft(b, 8)), lambda c, _: F.when(c.bitwiseAND(0x8000) != 0, F.shiftleft(c, 1).bitwiseXOR(0x1021)).otherwise(F.shiftleft(c, 1)).bitwiseAND(0xFFFF))
    return F.aggregate(F.array(*codes), F.lit(0), step)


def uid_checksum(uid1: Column, uid2: Column, uid3: Column) -> Column:
    """The fourth identifier of a file header: CRC-16 of the even bytes, and of the odd ones in the high half."""
    codes = [F.shiftright(u.cast("long"), 8 * k).bitwiseAND(255).cast("int") for u in (uid1, uid2, uid3) for k in range(4)]
    return F.shiftleft(_crc16(codes[1::2]).cast("long"), 16).bitwiseOR(_crc16(codes[0::2]).cast("long"))


def pack_bits(values: list[Column], bits: int) -> Column:
    """Little-endian packing of pixel values, ``bits`` each, into one integer."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(v.cast("long"), k * bits) for k, v in enumerate(values)])


def unpack_bits(packed: Column, bits: int, count: int) -> Column:
    return F.array(*[F.shiftright(packed, k * bits).bitwiseAND((1 << bits) - 1) for k in range(count)])


def unpack_rows(data: Column, width: Column, bits: int) -> Column:
    """Pixels of a picture, row by row: each row's pixels of ``bits`` (1, 2, 4 or 8) bits lie from the low bits on in bytes, and rows begin at multiples of four bytes."""
    a_byte = 8 // bits
    row = F.ceil(width * bits / 32).cast("int") * 4
    byte = lambda k: F.conv(F.hex(F.substring(data, k + 1, F.lit(1))), 16, 10).cast("int")
    value = lambda y, x: F.floor(byte(y * row + F.floor(x / a_byte).cast("int")) / F.pow(F.lit(2), (x % a_byte) * bits)).cast("int") % (1 << bits)
    rows = F.sequence(F.lit(0), F.floor(F.length(data) / row).cast("int") - 1)
    return F.when((width > 0) & (F.length(data) >= row), F.flatten(F.transform(rows, lambda y: F.transform(F.sequence(F.lit(0), width.cast("int") - 1), lambda x: value(y, x)))))


def grey_rgb(pixel: Column, depth: int) -> Column:
    """Red, green and blue from 0 to 1 of a grey value of ``depth`` bits."""
    g = pixel / F.lit(float((1 << depth) - 1))
    return F.struct(g.alias("red"), g.alias("green"), g.alias("blue"))


def split_rgb(pixel: Column, red: int, green: int, blue: int) -> Column:
    """Red, green and blue from 0 to 1 of a pixel with so many bits of each, red lowest."""
    part = lambda at, bits: F.shiftright(pixel, at).bitwiseAND((1 << bits) - 1) / F.lit(float((1 << bits) - 1))
    return F.struct(part(0, red).alias("red"), part(red, green).alias("green"), part(red + green, blue).alias("blue"))


def palette_rgb(pixel: Column, palette: list[tuple[float, float, float]]) -> Column:
    """The palette's colour of a pixel (256 at most, else an error); its first one for pixels beyond the palette. Palettes that are tables: ``operators.palettes``."""
    if len(palette) > 256:
        raise ValueError("a palette has 256 colours at most")
    colours = F.array(*[F.struct(F.lit(r).alias("red"), F.lit(g).alias("green"), F.lit(b).alias("blue")) for r, g, b in palette])
    return F.coalesce(F.when(pixel >= 0, F.get(colours, pixel.cast("int"))), F.get(colours, F.lit(0)))


def luma(red: Column, green: Column, blue: Column) -> Column:
    """Grey value of a colour (fixed weights)."""
    return 0.212671 * red + 0.715160 * green + 0.072169 * blue
