"""File names and sizes for people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of the file types, and their names on disk.
MANIFEST, JOURNAL, TABLE, TEMP = 1, 2, 4, 8
ALL = MANIFEST | JOURNAL | TABLE | TEMP
EXTENSIONS = {"log": JOURNAL, "ldb": TABLE, "sst": TABLE, "tmp": TEMP}


def file_name(kind: Column, number: Column) -> Column:
    """Name of a file; null for an unknown type."""
    padded = F.format_string("%06d", number)
    return (
        F.when(kind == MANIFEST, F.concat(F.lit("MANIFEST-"), padded))
        .when(kind == JOURNAL, F.concat(padded, F.lit(".log")))
        .when(kind == TABLE, F.concat(padded, F.lit(".ldb")))
        .when(kind == TEMP, F.concat(padded, F.lit(".tmp")))
    )


def file_type(name: Column) -> Column:
    """Type bit of a name, old table names included; 0 for other names."""
    out = F.when(name.rlike(r"^MANIFEST-\d+$"), MANIFEST)
    for extension, kind in EXTENSIONS.items():
        out = out.when(name.rlike(rf"^\d+\.{extension}$"), kind)
    return out.otherwise(0)


def file_number(name: Column) -> Column:
    return F.when(file_type(name) > 0, F.regexp_extract(name, r"(\d+)", 1).cast("long"))


def of_types(name: Column, mask: int) -> Column:
    """Whether a name's type is among the bits of ``mask``."""
    return file_type(name).bitwiseAND(F.lit(mask)) != 0


def short_bytes(size: Column) -> Column:
    """Whole units, divided by 1024 while over 1024, up to TiB; of whole numbers of any
    type, decimals of 38 digits too."""
    size = size.cast("decimal(38,0)")

    def text(k: int, unit: str) -> Column:
        # A multiple of the divisor, so that nothing is rounded.
        whole = ((size - size % F.lit(1024**k)) / F.lit(1024**k)).cast("decimal(38,0)") if k else size
        return F.concat(whole.cast("string"), F.lit(f"{unit}B"))

    out = F.when(size <= 1024, text(0, ""))
    for k, unit in enumerate(("Ki", "Mi", "Gi"), 1):
        out = out.when(size < F.lit(1025 * 1024**k), text(k, unit))
    return out.otherwise(text(4, "Ti"))
