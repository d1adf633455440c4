"""The bit registry, flag literals, masks and column expressions.

A flag is an INT between 0 and 65535.  A mask asks that all bits of
``required`` are set and none of ``forbidden``.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FLAG_MASK = 0xFFFF
N_FLAGS = 65536

#: Bit, label, description, include option, exclude option.
BITS: tuple[tuple[int, str, str, str, str | None], ...] = (
    (0x001, "paired", "read paired", "paired", "not-paired"),
    (0x002, "proper", "read mapped in proper pair", "proper-pair", "not-proper-pair"),
    (0x004, "unmapped", "read unmapped", "unmapped", "mapped"),
    (0x008, "mate_unmapped", "mate unmapped", "mate-unmapped", "mate-mapped"),
    (0x010, "reverse", "read reverse strand", "reverse", "forward"),
    (0x020, "mate_reverse", "mate reverse strand", "mate-reverse", "mate-forward"),
    (0x040, "first", "first in pair", "first-in-pair", None),
    (0x080, "second", "second in pair", "second-in-pair", None),
    (0x100, "secondary", "not primary alignment", "secondary", None),
    (0x200, "qcfail", "read fails platform/vendor quality checks", "qc-fail", None),
    (0x400, "dup", "read is PCR or optical duplicate", "duplicate", "non-duplicate"),
    (0x800, "supp", "supplementary alignment", "supplementary", None),
)
INCLUDE = {row[3]: row[0] for row in BITS}
EXCLUDE = {row[4]: row[0] for row in BITS if row[4]}


def parse_flag(literal: str) -> int:
    """A decimal, ``0x`` or ``0b`` literal of 16 bits; surrounding white space is ignored."""
    text = literal.strip()
    head, body = text[:2].lower(), text[2:]
    base, digits = (16, body) if head == "0x" else (2, body) if head == "0b" else (10, text)
    allowed = "0123456789abcdef"[:base]
    if not digits or any(c not in allowed for c in digits.lower()):
        raise ValueError(f"not a flag: {literal!r}")
    value = int(digits, base)
    if value > FLAG_MASK:
        raise ValueError(f"more than 16 bits: {literal!r}")
    return value


def parse_flags(literals: str) -> list[int]:
    """A comma-separated list of flag literals."""
    return [parse_flag(x) for x in literals.split(",")]


@dataclass(frozen=True)
class Mask:
    """All bits of ``required``, none of ``forbidden``."""

    required: int = 0
    forbidden: int = 0

    def __post_init__(self) -> None:
        object.__setattr__(self, "required", self.required & FLAG_MASK)
        object.__setattr__(self, "forbidden", self.forbidden & FLAG_MASK)

    @classmethod
    def of(cls, required: int | str = 0, forbidden: int | str = 0, options: Iterable[str] = ()) -> Mask:
        """From numbers or literals and named options, all joined by OR."""
        number = lambda x: parse_flag(x) if isinstance(x, str) else x
        r, f = number(required), number(forbidden)
        for name in options:
            plain = name.removeprefix("--")
            if plain in INCLUDE:
                r |= INCLUDE[plain]
            elif plain in EXCLUDE:
                f |= EXCLUDE[plain]
            else:
                raise ValueError(f"unknown option: {name!r}")
        return cls(r, f)

    @property
    def is_empty(self) -> bool:
        """No flag can match."""
        return bool(self.required & self.forbidden)

    @property
    def is_all(self) -> bool:
        return not (self.required | self.forbidden)

    def matches(self, flag: int) -> bool:
        return flag & self.required == self.required and not flag & self.forbidden

    def column(self, flag: str | Column = "flag") -> Column:
        """The normalised predicate: constant where it can be, else one bit test and one comparison."""
        if self.is_empty:
            return F.lit(False)
        if self.is_all:
            return F.lit(True)
        c = F.col(flag) if isinstance(flag, str) else flag
        return c.bitwiseAND(F.lit(self.required | self.forbidden)) == self.required

    def apply(self, df: DataFrame, flag: str = "flag") -> DataFrame:
        """Filter rows; no filter for the mask that matches everything."""
        return df if self.is_all else df.filter(self.column(flag))


UNMAPPED, MAPPED, PAIRED, PROPERLY_PAIRED = Mask(4, 0), Mask(0, 4), Mask(1, 0), Mask(3, 0)
CANNED = {"unmapped": UNMAPPED, "mapped": MAPPED, "paired": PAIRED, "properly_paired": PROPERLY_PAIRED}


def flag_bits(spark: SparkSession) -> DataFrame:
    """The registry as a table of 12 rows: ``bit, label, description``."""
    return spark.createDataFrame([row[:3] for row in BITS], "bit int, label string, description string")


def set_bits(flag: str | Column = "flag") -> Column:
    """Array of (bit, label, description) of the named bits that are set, ascending."""
    c = F.col(flag) if isinstance(flag, str) else flag
    every = F.array(*[F.struct(F.lit(b).alias("bit"), F.lit(n).alias("label"), F.lit(d).alias("description")) for b, n, d, _, _ in BITS])
    return F.filter(every, lambda x: c.bitwiseAND(x["bit"]) != 0)


def labels(flag: str | Column = "flag") -> Column:
    """Comma-joined labels, ``none`` without a named bit."""
    c = F.col(flag) if isinstance(flag, str) else flag
    joined = F.concat_ws(",", *[F.when(c.bitwiseAND(F.lit(b)) != 0, F.lit(n)) for b, n, _, _, _ in BITS])
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("none"))


def hex_flag(flag: str | Column = "flag") -> Column:
    """``0x`` and at least three hexadecimal digits."""
    return F.format_string("0x%03x", flag)


def binary_flag(flag: str | Column = "flag") -> Column:
    """At least twelve binary digits."""
    digits = F.bin(flag)
    return F.lpad(digits, F.greatest(F.lit(12), F.length(digits)), F.lit("0"))


def age(created: str | Column, now: str | Column) -> Column:
    """``Ns ago``, ``N.Nm ago``, ``N.Nh ago`` or ``N.Nd ago`` of epoch seconds; ``in N.Nh`` ahead of now."""
    c, n = (F.col(x) if isinstance(x, str) else x for x in (created, now))
    gone = n - c
    return (
        F.when(gone < 0, F.format_string("in %.1fh", -gone / 3600.0))
        .when(gone < 60, F.format_string("%ds ago", gone.cast("long")))
        .when(gone < 3600, F.format_string("%.1fm ago", gone / 60.0))
        .when(gone < 86400, F.format_string("%.1fh ago", gone / 3600.0))
        .otherwise(F.format_string("%.1fd ago", gone / 86400.0))
    )


def memory(mb: str | Column) -> Column:
    """``x.xGB`` from 1024 MB on, else ``xMB``."""
    c = F.col(mb) if isinstance(mb, str) else mb
    return F.when(c >= 1024, F.format_string("%.1fGB", c / 1024.0)).otherwise(F.format_string("%.0fMB", c.cast("double")))


def threads_label(threads: str | Column, unit: str = "") -> Column:
    """``auto`` for 0, else the number with ``unit``."""
    c = F.col(threads) if isinstance(threads, str) else threads
    return F.when(c == 0, F.lit("auto")).otherwise(F.concat(c.cast("string"), F.lit(unit)))


def used_flags(flags: Iterable[int], mask: Mask) -> list[int]:
    """Those of the given flags that match, ascending."""
    return sorted({f for f in flags if mask.matches(f)})


def any_of(columns: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))
