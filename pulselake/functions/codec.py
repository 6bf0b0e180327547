"""Storage formats of digital samples, as column expressions over arrays of samples and of bytes.

All run on the JVM. Bytes are integers from 0 to 255.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats that pack several samples into some bytes: samples and bytes of a group.
GROUPS = {"212": (2, 3), "310": (3, 4), "311": (3, 4)}


def _groups(values: Column, size: int, build: object) -> Column:
    """Concatenates ``build(value 0, value 1, ...)`` over groups of ``size``; a last group is filled
    up with zeros."""
    n = F.ceil(F.size(values) / size).cast("int")

    def one(g: Column) -> Column:
        return build(*[F.coalesce(F.get(values, g * size + i), F.lit(0)) for i in range(size)])

    return F.when(F.size(values) == 0, F.array().cast("array<bigint>")).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), n - 1), one)))


def _signed(v: Column, bits: int) -> Column:
    return F.when(v >= 1 << (bits - 1), v - (1 << bits)).otherwise(v)


def _bits(v: Column, shift: int, width: int) -> Column:
    """``width`` bits of ``v`` from bit ``shift`` on."""
    return F.shiftright(v, shift).bitwiseAND((1 << width) - 1)


def required_bytes(n: Column, fmt: Column, write: bool = False) -> Column:
    """Bytes that ``n`` samples of a format take in a file."""
    thirds = F.ceil(n * 4 / 3)
    whole = F.ceil(n * 4 / 3 / 4) * 4
    full = (fmt == "310") | F.lit(write)
    out = F.when(fmt == "212", F.ceil(n * 1.5))
    out = out.when(fmt.isin("310", "311"), F.when((n % 3 == 2) & full, whole).otherwise(thirds))
    for width, names in ((1, ("8", "80")), (2, ("16", "61", "160")), (3, ("24",)), (4, ("32",))):
        out = out.when(fmt.isin(*names), n * width)
    return out.cast("long")


def encode(samples: Column, fmt: str) -> Column:
    """Bytes of an array of samples (long) in a format."""
    if fmt == "80":
        return F.transform(samples, lambda s: s + 128)
    if fmt in ("16", "24", "32", "61", "160"):
        width = {"16": 2, "61": 2, "160": 2, "24": 3, "32": 4}[fmt]
        order = range(width - 1, -1, -1) if fmt == "61" else range(width)
        moved = F.transform(samples, lambda s: s + 32768) if fmt == "160" else samples
        return F.flatten(F.transform(moved, lambda s: F.array(*[_bits(s, 8 * i, 8) for i in order])))
    if fmt == "212":
        packed = _groups(samples, 2, lambda a, b: F.array(_bits(a, 0, 8), _bits(a, 8, 4) + 16 * _bits(b, 8, 4), _bits(b, 0, 8)))
        return F.slice(packed, 1, F.ceil(F.size(samples) * 1.5).cast("int"))
    if fmt == "310":
        return _groups(samples, 3, lambda a, b, c: F.array(2 * _bits(a, 0, 7), _bits(a, 7, 3) + 8 * _bits(c, 0, 5), 2 * _bits(b, 0, 7), _bits(b, 7, 3) + 8 * _bits(c, 5, 5)))
    if fmt == "311":
        return _groups(samples, 3, lambda a, b, c: F.array(_bits(a, 0, 8), _bits(a, 8, 2) + 4 * _bits(b, 0, 6), _bits(b, 6, 4) + 16 * _bits(c, 0, 4), _bits(c, 4, 6)))
    raise ValueError(f"format {fmt} can't be written here")


def decode(data: Column, fmt: str, n: Column, first: Column | None = None) -> Column:
    """The first ``n`` samples (long) of an array of bytes in a format; ``first`` is the value before
    the first difference of format 8."""
    if fmt == "8":
        differences = F.transform(data, lambda b: _signed(b, 8))
        sums = F.aggregate(differences, F.array(first), lambda acc, d: F.concat(acc, F.array(F.element_at(acc, -1) + d)))
        out = F.slice(sums, 2, F.size(data))
    elif fmt == "80":
        out = F.transform(data, lambda b: b - 128)
    elif fmt in ("16", "24", "32", "61", "160"):
        width = {"16": 2, "61": 2, "160": 2, "24": 3, "32": 4}[fmt]

        def value(*b: Column) -> Column:
            ordered = b[::-1] if fmt == "61" else b
            total = sum((x * (1 << 8 * i) for i, x in enumerate(ordered)), F.lit(0).cast("long"))
            return F.array(total - 32768 if fmt == "160" else _signed(total, 8 * width))

        out = _groups(data, width, value)
    elif fmt == "212":
        out = _groups(data, 3, lambda x, y, z: F.array(_signed(x + 256 * _bits(y, 0, 4), 12), _signed(z + 256 * _bits(y, 4, 4), 12)))
    elif fmt == "310":
        out = _groups(data, 4, lambda w, x, y, z: F.array(*[_signed(v, 10) for v in (_bits(w, 1, 7) + 128 * _bits(x, 0, 3), _bits(y, 1, 7) + 128 * _bits(z, 0, 3), _bits(x, 3, 5) + 32 * _bits(z, 3, 5))]))
    elif fmt == "311":
        out = _groups(data, 4, lambda w, x, y, z: F.array(*[_signed(v, 10) for v in (w + 256 * _bits(x, 0, 2), _bits(x, 2, 6) + 64 * _bits(y, 0, 4), _bits(y, 4, 4) + 16 * _bits(z, 0, 6))]))
    else:
        raise ValueError(f"format {fmt} can't be read here")
    return F.slice(out, 1, n.cast("int"))
