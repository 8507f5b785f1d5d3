"""Text functions: tokenizing, switches, quoted arguments, sizes and message rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Lower-cased pieces between spaces; full stops, commas, quotes and hyphens count as spaces."""
    return F.filter(F.split(F.translate(F.lower(text), '.,"-', "    "), " "), lambda w: w != "")


def switches(pieces: Column) -> Column:
    """A map from the pieces at even places to those that follow them."""
    n = F.floor(F.size(pieces) / 2).cast("int")
    even = F.filter(pieces, lambda x, i: (i % 2 == 0) & (i < 2 * n))
    odd = F.filter(pieces, lambda x, i: (i % 2 == 1) & (i < 2 * n))
    return F.map_from_arrays(even, odd)


def quoted(text: Column) -> Column:
    """The arguments that stand in double quotes."""
    return F.regexp_extract_all(text, F.lit('"([^"]*)"'), F.lit(1))


def size_text(n: Column) -> Column:
    """A size in b, Kb, Mb or Gb with two decimals."""
    def scaled(unit: str, by: int) -> Column:
        return F.concat(F.round(n / by, 2).cast("decimal(20,2)").cast("string"), F.lit(unit))

    return (F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit("b"))).when(n < 1024**2, scaled("Kb", 1024))
            .when(n < 1024**3, scaled("Mb", 1024**2)).otherwise(scaled("Gb", 1024**3)))


def message(**fields: Column) -> Column:
    """A message as JSON text."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def partition_id(word: Column) -> Column:
    """A reproducible 512-bit partition id of a word, from four digests over its UTF-16LE bytes."""
    raw = F.encode(word, "UTF-16LE")
    back = F.reverse(word)
    half = F.substring(back, F.lit(1), F.ceil(F.length(word) / 2).cast("int"))
    return F.concat(F.md5(raw), F.md5(F.octet_length(raw).cast("string").cast("binary")), F.md5(F.encode(back, "UTF-16LE")), F.md5(F.encode(half, "UTF-16LE")))
