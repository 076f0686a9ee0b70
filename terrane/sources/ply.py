"""Headers of point files: text lines that name the type of each property of a point."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Property types of the format, as little-endian NumPy types; unsigned ones widen in Spark.
TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "<i2", "int16": "<i2", "ushort": "<u2", "uint16": "<u2", "int": "<i4", "int32": "<i4", "uint": "<u4", "uint32": "<u4", "float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8"}
SPARK = {"i1": T.ByteType(), "u1": T.ShortType(), "<i2": T.ShortType(), "<u2": T.IntegerType(), "<i4": T.IntegerType(), "<u4": T.LongType(), "<i8": T.LongType(), "<f4": T.FloatType(), "<f8": T.DoubleType()}


@dataclass(frozen=True)
class Header:
    text: bool
    count: int
    size: int
    lines: int
    names: tuple[str, ...]
    kinds: tuple[str, ...]

    @property
    def record(self) -> np.dtype:
        return np.dtype(list(zip(self.names, self.kinds, strict=True)))

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("row", T.LongType())] + [T.StructField(n, SPARK[k]) for n, k in zip(self.names, self.kinds, strict=True)])


def parse_header(raw: bytes) -> Header:
    """The header of a file's first bytes; only scalar properties of the vertex element are read."""
    end = raw.find(b"end_header\n")
    if not raw.startswith(b"ply") or end < 0:
        raise ValueError("no header of this format")
    text, count, names, kinds, inside = True, 0, [], [], False
    for line in raw[:end].decode("ascii").split("\n"):
        word = line.split()
        if word[:1] == ["format"]:
            if word[1] not in ("ascii", "binary_little_endian"):
                raise ValueError(f"format {word[1]}")
            text = word[1] == "ascii"
        elif word[:1] == ["element"]:
            inside = word[1] == "vertex"
            count = int(word[2]) if inside else count
        elif word[:1] == ["property"] and inside:
            if word[1] == "list":
                raise ValueError("list properties of vertices are not read")
            names.append(word[2])
            kinds.append(TYPES[word[1]])
    return Header(text, count, end + len(b"end_header\n"), raw[:end].count(b"\n") + 1, tuple(names), tuple(kinds))


def header_text(kinds: dict[str, str], count: int, text: bool) -> bytes:
    """The header of a file of `count` points with properties of `kinds`."""
    lines = "".join(f"property {k} {c}\n" for c, k in kinds.items())
    return f"ply\nformat {'ascii' if text else 'binary_little_endian'} 1.0\nelement vertex {count}\n{lines}end_header\n".encode()


def header_of(spark: SparkSession, path: str) -> Header:
    """The header of the first of the files at `path`."""
    from terrane.sources import scans

    return parse_header(scans.head_of(scans.files_of(path)[0]))


def read(spark: SparkSession, path: str, header: Header, stride: int = 1) -> DataFrame:
    """Points of the files at `path`, all with this header, with their row in the file; every `stride`th row of each."""
    from terrane.sources import scans

    found = scans.text_points(spark, path, stride) if header.text else scans.read(spark, path, stride=stride)
    return found.drop("file").select(*header.schema.names)
