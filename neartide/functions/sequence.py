"""Column functions on sequences, orientations and hashes; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hashes are whole numbers below this, the same in every engine that has MD5.
HASH_RANGE = 1 << 60


def reverse_complement(seq: Column) -> Column:
    """Bases and their lower case are complemented, other letters stay."""
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def sibling(read_id: Column) -> Column:
    """The same read in the other orientation: forward ids are even, reverse ids odd."""
    return read_id.bitwiseXOR(F.lit(1))


def forward_id(read_id: Column) -> Column:
    return read_id - F.pmod(read_id, F.lit(2))


def is_forward(read_id: Column) -> Column:
    return F.pmod(read_id, F.lit(2)) == 0


def flip_strand(strand: Column) -> Column:
    return F.translate(strand, "+-", "-+")


def portable_hash(text: Column, seed: int | str = "") -> Column:
    """60 bits of the MD5 of seed:text."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), text.cast("string"))), 1, 15), 16, 10).cast("long")


def uniform(text: Column, seed: int | str = "") -> Column:
    """A number in (0, 1) that depends on text and seed alone."""
    return (portable_hash(text, seed).cast("double") + 1.0) / float(HASH_RANGE + 2)


def rounded(value: Column, digits: int = 6) -> Column:
    """Rounded, and never negative zero."""
    return F.round(value, digits) + F.lit(0.0)


def species(taxonomy: Column) -> Column:
    """The two words after the last s__, or null."""
    return F.nullif(F.regexp_extract(taxonomy, r"^.*s__(\S+ \S+)", 1), F.lit(""))


def accession_prefix(accession: Column) -> Column:
    return F.when(accession.startswith("GCA"), F.concat(F.lit("GB_"), accession)).otherwise(F.concat(F.lit("RS_"), accession))


def taxon_code(record_id: Column) -> Column:
    """The first six characters of an accession, which name its species."""
    return F.substring(record_id, 1, 6)


def source_record(read_name: Column) -> Column:
    """Which record, from 0, a simulated read S<n>_... comes from."""
    return F.nullif(F.regexp_extract(read_name, r"S(\d+)_", 1), F.lit("")).cast("long") - 1
