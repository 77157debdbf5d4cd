"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of sizes, all powers of 1024.
UNITS = ["", "K", "M", "G", "T"]


def parse_size(s: Column) -> Column:
    """"128KiB", "1.5M", "7": a number of bytes (fractions are cut off); null if it cannot be read."""
    t = F.upper(F.trim(s))
    number = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?) ?([KMGT]?)(?:I?B)?$", 1)
    unit = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?) ?([KMGT]?)(?:I?B)?$", 2)
    power = F.instr(F.lit("KMGT"), unit)
    return F.when(number != "", F.floor(number.cast("double") * F.pow(F.lit(1024.0), F.when(unit == "", 0).otherwise(power))).cast("long"))


def format_size(n: Column) -> Column:
    out = F.concat(n.cast("string"), F.lit(" B"))
    for i, u in enumerate(UNITS[1:], 1):
        out = F.when(n >= 1024**i, F.concat(F.format_string("%.1f", F.bround(n / float(1024**i), 1)), F.lit(f" {u}iB"))).otherwise(out)
    return out


def one_decimal(x: Column) -> Column:
    """A double with one decimal, rounded as C's %.1f: from its exact binary value, and halves to even. Java's %.1f rounds the
    shortest decimal digits, and halves up."""
    return F.call_function("format_number", x, F.lit("0.0"))


def format_ns(n: Column) -> Column:
    out = F.concat(n.cast("string"), F.lit("ns"))
    for size, u in ((10**3, "us"), (10**6, "ms"), (10**9, "s")):
        out = F.when(n >= size, F.concat(one_decimal(n / float(size)), F.lit(u))).otherwise(out)
    return out


def is_hex_key(s: Column) -> Column:
    return s.rlike(r"^[0-9a-f]{64}\z")


def object_path(key: Column) -> Column:
    return F.concat_ws("/", F.substring(key, 1, 2), F.substring(key, 3, 2), key)


def parse_ref(s: Column) -> Column:
    """manifest://<hex> or file://<path>[@digest:[<scheme>:]<hex>][@location:<name>] as a struct; fields are null if absent."""
    scheme = F.regexp_extract(s, "^(manifest|file)://", 1)
    body = F.regexp_replace(s, "^(manifest|file)://", "")

    def part(pattern: str, group: int = 1) -> Column:
        return F.nullif(F.regexp_extract(body, pattern, group), F.lit(""))

    return F.when(
        scheme != "",
        F.struct(
            scheme.alias("scheme"), part("^([^@]*)").alias("path"), part("@digest:([0-9a-f]{64})").alias("digest"),
            part("@location:([A-Za-z0-9._-]+)").alias("location"), ((scheme == "manifest") | body.contains("@location:")).alias("portable"),
        ),
    )


def parse_mode(s: Column) -> Column:
    """Octal file modes with set-id and sticky bits as a number; null if not octal."""
    return F.when(s.rlike(r"^[0-7]{1,5}\z"), F.conv(s, 8, 10).cast("long"))


def next_pow2(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.ceil(F.log2(F.greatest(n, F.lit(1)).cast("double"))).cast("int"))


def align_down(pos: Column, least: int) -> Column:
    """The page at or before a position, or the position itself if the page is before the least."""
    page = pos - pos % 4096
    return F.when(page < least, pos).otherwise(page)


def retry_delay_ms(attempt: Column) -> Column:
    return F.call_function("shiftleft", F.lit(250).cast("long"), attempt.cast("int") - 1)


def format_count(n: Column) -> Column:
    out = n.cast("string")
    for size, u in ((10**3, "k"), (10**6, "M"), (10**9, "G")):
        out = F.when(n >= size, F.concat(one_decimal(n / float(size)), F.lit(u))).otherwise(out)
    return out


def sorted_json(m: Column) -> Column:
    """A map as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))
