"""BAM files as rows, after the published layout of the format: gzip blocks of little-endian records.

A file is read whole by one task; files are read in parallel.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENTS = (
    "segment_id long, reference_name string, reference_start long, reference_end long, reference_strand string, mismatch long, query_name string, "
    "query_alignment_start long, query_length long, query_alignment_length long, mapping_quality int, secondary boolean"
)

# fixed values: the letters of CIGAR operations by code, and which of them move along the reference and the query
_CIGAR = "MIDNSHP=X"
_ON_REFERENCE, _ON_QUERY = "MDN=X", "MI=X"
# fixed values: the bytes of a tag's value by its type
_WIDTH = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_FORMAT = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}
_REVERSE, _SECONDARY = 0x10, 0x100  # bits of a segment's flag


def _edit_distance(tags: bytes) -> int:
    """The value of the tag NM, 0 without it."""
    at = 0
    while at + 3 <= len(tags):
        name, kind = tags[at : at + 2], chr(tags[at + 2])
        at += 3
        if name == b"NM" and kind in _FORMAT:
            return struct.unpack_from(_FORMAT[kind], tags, at)[0]
        if kind in "ZH":
            at = tags.index(0, at) + 1
        elif kind == "B":
            at += 5 + _WIDTH[chr(tags[at])] * struct.unpack_from("<I", tags, at + 1)[0]
        else:
            at += _WIDTH[kind]
    return 0


def segments(data: bytes) -> Iterator[tuple]:
    """The rows of a BAM file's bytes, in its order."""
    data = gzip.decompress(data)
    if data[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    at = 8 + struct.unpack_from("<i", data, 4)[0]
    names = []
    (n,) = struct.unpack_from("<i", data, at)
    at += 4
    for _ in range(n):
        (size,) = struct.unpack_from("<i", data, at)
        names.append(data[at + 4 : at + 4 + size - 1].decode())
        at += 8 + size
    number = 0
    while at < len(data):
        (size,) = struct.unpack_from("<i", data, at)
        record = data[at + 4 : at + 4 + size]
        at += 4 + size
        ref, start, name_size, quality, _, n_cigar, flag, length, _, _, _ = struct.unpack_from("<iiBBHHHiiii", record)
        name = record[32 : 32 + name_size - 1].decode()
        cigar = [(x >> 4, _CIGAR[x & 15]) for x in struct.unpack_from(f"<{n_cigar}I", record, 32 + name_size)]
        tags = record[32 + name_size + 4 * n_cigar + (length + 1) // 2 + length :]
        clipped = next((n for n, c in cigar if c != "H"), 0) if next((c for _, c in cigar if c != "H"), "") == "S" else 0
        yield (
            number, names[ref] if ref >= 0 else None, start, start + sum(n for n, c in cigar if c in _ON_REFERENCE), "-" if flag & _REVERSE else "+", _edit_distance(tags), name,
            clipped, length, sum(n for n, c in cigar if c in _ON_QUERY), quality, bool(flag & _SECONDARY),
        )
        number += 1


def read_bam(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row for each segment, numbered within its file; the edit distance is 0 where it is not given."""
    fields = [f.split()[0] for f in SEGMENTS.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    kinds = [types[f.split()[1]] for f in SEGMENTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column(0):
                rows: list[tuple] = []
                for row in segments(cell.as_py()):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=fields)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=fields)

    files = spark.read.format("binaryFile").load(paths).select("content")
    return files.mapInArrow(run, SEGMENTS)


def in_region(bam: DataFrame, chromosome: str, start: int, end: int) -> DataFrame:
    """The segments that meet [start, end) of a reference sequence."""
    return bam.where((F.col("reference_name") == chromosome) & (F.col("reference_start") < end) & (F.col("reference_end") > start))


def intervals(bam: DataFrame, index: DataFrame) -> DataFrame:
    """(read_id, grp, start_pos, end_pos) of the primary segments of known reads; ``index`` is (name, id)."""
    named = bam.where("not secondary").join(index.select(F.col("name").alias("query_name"), F.col("id").alias("read_id")), "query_name")
    return named.select("read_id", F.concat("reference_name", "reference_strand").alias("grp"), F.col("reference_start").alias("start_pos"), F.col("reference_end").alias("end_pos"))
