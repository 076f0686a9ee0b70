"""Files of fixed-width records, read in byte ranges, fetched by row and written a file for each partition.

A file is opened by its layout: some arrays, each of as many records of one width from one offset on. Point files have
one array of whole points, LAS files one whose records the point format lays out, region inputs one for each
quantity of a cell. `Records` is the data source of all of them: what a task reads is decided when partitions
are planned, from headers alone, so a sampled or fetched scan never reads the rows between.
"""

from __future__ import annotations

import io
import itertools
import struct
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import ExitStack
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from terrane.operators import lineage
from terrane.sources import ply

#: Bytes of records that a partition reads, rows that a batch holds, and bytes up to which a gap between rows is read over.
PARTITION_BYTES, BATCH, GAP = 64 << 20, 1 << 16, 1 << 16
#: Ranges beyond which those smaller than PARTITION_BYTES grow, so that their number doesn't follow the input.
MOST_RANGES = 512
#: Bytes of a file that its header is looked for in.
HEAD = 1 << 16


@dataclass(frozen=True)
class Section:
    """Records of `kind` one after another from `offset` on."""

    offset: int
    kind: np.dtype


@dataclass(frozen=True)
class Layout:
    """A file's number of rows, the sections that hold their fields, and the numbers that its header gives besides."""

    count: int
    sections: tuple[Section, ...]
    facts: dict[str, float] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return [n for s in self.sections for n in s.kind.names]

    @property
    def width(self) -> int:
        return sum(s.kind.itemsize for s in self.sections)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store and the path in it: a URI of any store that Arrow opens, or a path of this machine."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[str]:
    """A file itself, or the files of a folder in order of name, but those that begin with a dot or an underscore."""
    store, own = opened(path)
    info = store.get_file_info(own)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    found = store.get_file_info(fs.FileSelector(own))
    return [f"{path.rstrip('/')}/{f.base_name}" for f in sorted(found, key=lambda f: f.base_name) if f.type == fs.FileType.File and f.base_name[0] not in "._"]


def head_of(path: str, most: int = HEAD) -> bytes:
    store, own = opened(path)
    with store.open_input_file(own) as file:
        return file.read(most)


def point_layout(raw: bytes) -> Layout:
    """Points with a text header and binary records."""
    header = ply.parse_header(raw)
    if header.text:
        raise ValueError("text records have no fixed width; see text_points")
    return Layout(header.count, (Section(header.size, header.record),))


#: The fields of a LAS point by its format, as little-endian NumPy types in the order of the format's records.
LAS_BASE = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("returns", "u1"), ("classification", "u1"), ("scan_angle", "i1"), ("user_data", "u1"), ("source_id", "<u2")]
LAS_WIDE = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("returns", "u1"), ("flags", "u1"), ("classification", "u1"), ("user_data", "u1"), ("scan_angle", "<i2"), ("source_id", "<u2"), ("gps_time", "<f8")]
LAS_COLOR, LAS_TIME, LAS_WAVE = [("red", "<u2"), ("green", "<u2"), ("blue", "<u2")], [("gps_time", "<f8")], [("wave", "V29")]
LAS_FORMATS = {
    0: LAS_BASE, 1: LAS_BASE + LAS_TIME, 2: LAS_BASE + LAS_COLOR, 3: LAS_BASE + LAS_TIME + LAS_COLOR, 4: LAS_BASE + LAS_TIME + LAS_WAVE, 5: LAS_BASE + LAS_TIME + LAS_COLOR + LAS_WAVE,
    6: LAS_WIDE, 7: LAS_WIDE + LAS_COLOR, 8: LAS_WIDE + LAS_COLOR + [("infrared", "<u2")], 9: LAS_WIDE + LAS_WAVE, 10: LAS_WIDE + LAS_COLOR + [("infrared", "<u2")] + LAS_WAVE,
}


def las_layout(raw: bytes) -> Layout:
    """LAS points: the header's point format says what a record holds, which may be followed by bytes of the writer's own."""
    if raw[:4] != b"LASF":
        raise ValueError("no LAS header")
    begin, = struct.unpack_from("<I", raw, 96)
    kind, width, count = raw[104], *struct.unpack_from("<HI", raw, 105)
    if kind & 0x80:
        raise ValueError("compressed points are not read: decompress them first")
    if kind not in LAS_FORMATS:
        raise ValueError(f"point format {kind}")
    if raw[25] >= 4 and struct.unpack_from("<H", raw, 94)[0] >= 375:
        count = struct.unpack_from("<Q", raw, 247)[0] or count
    own = np.dtype(LAS_FORMATS[kind])
    if width < own.itemsize:
        raise ValueError(f"records of {width} bytes are too short for point format {kind}")
    named = [(n, own.fields[n][0], own.fields[n][1]) for n in own.names if own.fields[n][0].kind != "V"]
    record = np.dtype({"names": [n for n, _, _ in named], "formats": [k for _, k, _ in named], "offsets": [o for _, _, o in named], "itemsize": width})
    names = ("x_scale", "y_scale", "z_scale", "x_offset", "y_offset", "z_offset", "x_max", "x_min", "y_max", "y_min", "z_max", "z_min")
    return Layout(count, (Section(begin, record),), dict(zip(names, struct.unpack_from("<12d", raw, 131), strict=True)))


#: Marks of region inputs and of label vectors, and the arrays of the former in order.
REGION_MARK, LABEL_MARK = b"GPRGv1\n", b"GPRGlabels1\n"
REGION_ARRAYS = [("xyz", "<f4", 3), ("rgb", "<f4", 3), ("normal", "<f4", 3), ("roughness", "<f4", 1), ("planarity", "<f4", 1), ("linearity", "<f4", 1), ("local_color_std", "<f4", 1), ("height_range", "<f4", 1), ("buckets", "<i2", 1)]
REGION_PARTS = {"xyz": ("x", "y", "z"), "rgb": ("red", "green", "blue"), "normal": ("nx", "ny", "nz")}


def _region(raw: bytes) -> tuple[int, int, list[Section], int]:
    if not raw.startswith(REGION_MARK):
        raise ValueError("no region input")
    n, m = struct.unpack_from("<qq", raw, len(REGION_MARK))
    at, sections = len(REGION_MARK) + 16, []
    for name, kind, width in REGION_ARRAYS:
        record = np.dtype([(c, kind) for c in REGION_PARTS.get(name, (name,))])
        sections.append(Section(at, record))
        at += n * width * np.dtype(kind).itemsize
    return n, m, sections, at


def region_layout(raw: bytes) -> Layout:
    """The cells of a region input: nine arrays one after another."""
    n, _, sections, _ = _region(raw)
    return Layout(n, tuple(sections))


def region_edge_layout(raw: bytes) -> Layout:
    """The edges of a region input, after its cells: sources, then destinations."""
    _, m, _, at = _region(raw)
    return Layout(m, (Section(at, np.dtype([("src", "<i4")])), Section(at + 4 * m, np.dtype([("dst", "<i4")]))))


def label_layout(raw: bytes) -> Layout:
    """A label for each cell."""
    if not raw.startswith(LABEL_MARK):
        raise ValueError("no label vector")
    (n,) = struct.unpack_from("<q", raw, len(LABEL_MARK))
    return Layout(n, (Section(len(LABEL_MARK) + 8, np.dtype([("label", "<i4")])),))


def field_layout(path: str) -> Layout:
    """The arrays of one length of an uncompressed archive of arrays, each from where its member's data begins; shorter ones are facts.

    Members' places come from the directory at the archive's end, the types from the arrays' own headers.
    """
    store, own = opened(path)
    sections, count, facts = [], 0, {}
    with store.open_input_file(own) as file, zipfile.ZipFile(file) as archive:
        arrays = {}
        for info in archive.infolist():
            if info.compress_type != zipfile.ZIP_STORED:
                raise ValueError("compressed arrays cannot be read in ranges: store them plain")
            file.seek(info.header_offset)
            names = struct.unpack("<26x2H", file.read(30))
            begin = info.header_offset + 30 + sum(names)
            file.seek(begin)
            raw = io.BytesIO(file.read(min(info.file_size, 4096)))
            version = np.lib.format.read_magic(raw)
            shape, _, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(raw)
            arrays[info.filename.removesuffix(".npy")] = (begin + raw.tell(), shape[0] if shape else 1, kind)
        count = max((n for _, n, _ in arrays.values()), default=0)
        for name, (begin, n, kind) in arrays.items():
            if n == count:
                sections.append(Section(begin, np.dtype([(name, kind)])))
            else:
                file.seek(begin)
                facts |= {f"{name}_{k}": float(v) for k, v in enumerate(np.frombuffer(file.read(n * kind.itemsize), kind))}
    return Layout(count, tuple(sections), facts)


def layout_of(path: str, kind: str) -> Layout:
    """The layout of one file, from its header or, of an archive, its directory."""
    return field_layout(path) if kind == "field" else LAYOUTS[kind](head_of(path))


LAYOUTS = {"points": point_layout, "las": las_layout, "region": region_layout, "region_edges": region_edge_layout, "labels": label_layout}


def read_rows(file, layout: Layout, first: int, count: int, stride: int = 1) -> dict[str, np.ndarray]:
    """The fields of rows first, first + stride, ...: each section's range at once, or row by row where those between are many."""
    out = {}
    for section in layout.sections:
        width = section.kind.itemsize
        if stride * width <= GAP:
            file.seek(section.offset + first * width)
            raw = file.read(((count - 1) * stride + 1) * width)
            if len(raw) < ((count - 1) * stride + 1) * width:
                raise ValueError(f"the file ends within row {first + len(raw) // width}")
            rows = np.frombuffer(raw, section.kind)[::stride]
        else:
            parts = []
            for k in range(count):
                file.seek(section.offset + (first + k * stride) * width)
                parts.append(file.read(width))
            rows = np.frombuffer(b"".join(parts), section.kind)
        out |= {n: rows[n] for n in section.kind.names}
    return placed(layout, out)


def placed(layout: Layout, fields: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The fields, with x, y, z in their unit in place of whole numbers where the header has a scale."""
    if "x_scale" not in layout.facts:
        return fields
    return {n.lower() if n in "XYZ" else n: v * layout.facts[f"{n.lower()}_scale"] + layout.facts[f"{n.lower()}_offset"] if n in "XYZ" else v for n, v in fields.items()}


def spark_schema(layout: Layout) -> T.StructType:
    kinds = placed(layout, {n: np.empty(0, s.kind.fields[n][0]) for s in layout.sections for n in s.kind.names})
    fields = [T.StructField(n, ply.SPARK[v.dtype.str.replace("|", "")]) for n, v in kinds.items()]
    return T.StructType([T.StructField("file", T.StringType()), T.StructField("row", T.LongType()), *fields])


ARROW = {T.StringType(): pa.string(), T.ByteType(): pa.int8(), T.ShortType(): pa.int16(), T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.FloatType(): pa.float32(), T.DoubleType(): pa.float64()}


def batch_of(schema: T.StructType, path: str, rows: np.ndarray, fields: dict[str, np.ndarray]) -> pa.RecordBatch:
    arrays = [pa.array([path] * len(rows), pa.string()), pa.array(rows)]
    for f in schema.fields[2:]:
        arrays.append(pa.array(np.ascontiguousarray(fields[f.name].astype(ARROW[f.dataType].to_pandas_dtype()))))
    return pa.RecordBatch.from_arrays(arrays, names=schema.names)


@dataclass
class Stretch(InputPartition):
    """Rows `first`, `first + stride`, ... of a file."""

    path: str
    layout: Layout
    first: int
    count: int
    stride: int


class Records(DataSource):
    """`spark.read.format("terrane_records")` with options kind, stride, max_points, partition_bytes and rows (numbers with commas)."""

    @classmethod
    def name(cls) -> str:
        return "terrane_records"

    def layouts(self) -> list[tuple[str, Layout]]:
        kind = self.options.get("kind", "points")
        return [(path, layout_of(path, kind)) for path in files_of(self.options["path"])]

    def schema(self) -> T.StructType:
        found = self.layouts()
        if not found:
            raise FileNotFoundError(f"no files in {self.options['path']}")
        if any([s.kind for s in one.sections] != [s.kind for s in found[0][1].sections] for _, one in found):
            raise ValueError("files with different records")
        return spark_schema(found[0][1])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return RecordReader(self, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return PointWriter(dict(self.options), schema, overwrite)


class RecordReader(DataSourceReader):
    def __init__(self, source: Records, schema: T.StructType):
        self.source, self.columns = source, schema

    def partitions(self) -> list[Stretch]:
        options = self.source.options
        stride, most = max(1, int(options.get("stride", 1))), int(options.get("max_points", 0))
        size = int(options.get("partition_bytes", PARTITION_BYTES))
        out, layouts = [], list(self.source.layouts())
        size = max(size, min(PARTITION_BYTES, sum(layout.count // stride * layout.width for _, layout in layouts) // MOST_RANGES))
        for path, layout in layouts:
            if options.get("rows"):
                wanted = np.unique(np.array([int(r) for r in options["rows"].split(",")]))
                wanted = wanted[(wanted >= 0) & (wanted < layout.count)]
                for run in np.split(wanted, np.flatnonzero(np.diff(wanted) != 1) + 1):
                    if len(run):
                        out.append(Stretch(path, layout, int(run[0]), len(run), 1))
                continue
            kept = -(-layout.count // stride)
            kept = min(kept, most) if most > 0 else kept
            each = max(1, size // (layout.width * (stride if stride * layout.width <= GAP else 1)))
            out += [Stretch(path, layout, k * stride, min(each, kept - k), stride) for k in range(0, kept, each)]
        return out

    def read(self, partition: Stretch | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        store, own = opened(partition.path)
        with store.open_input_file(own) as file:
            for k in range(0, partition.count, BATCH):
                n = min(BATCH, partition.count - k)
                first = partition.first + k * partition.stride
                rows = first + np.arange(n, dtype=np.int64) * partition.stride
                yield batch_of(self.columns, partition.path, rows, read_rows(file, partition.layout, first, n, partition.stride))


@dataclass
class Written(WriterCommitMessage):
    path: str | None
    count: int


class PointWriter(DataSourceArrowWriter):
    """A file for each partition, in the folder of option path: binary points, text ones with option text, or LAS ones with option kind.

    Option types names the property type of each column, as "x:float,y:float". A file appears under its own name only
    when all are written; a task that is tried again leaves no second one.
    """

    def __init__(self, options: dict[str, str], schema: T.StructType, overwrite: bool):
        self.folder, self.overwrite = options["path"].rstrip("/"), overwrite
        self.form = FORMS[options.get("kind", "points")](options, schema.names)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        count, form = 0, self.form
        # the header comes first and names the number of rows, which is known at the end; arrays are held apart
        with ExitStack() as stack:
            held = [stack.enter_context(tempfile.TemporaryFile()) for _ in range(form.arrays)]
            for batch in iterator:
                parts = form.records({n: batch.column(k).to_numpy(zero_copy_only=False) for k, n in enumerate(batch.schema.names)}, batch.num_rows)
                for file, part in zip(held, parts, strict=True):
                    file.write(part)
                count += batch.num_rows
            if not count:
                return Written(None, 0)
            store, own = opened(self.folder)
            store.create_dir(own, recursive=True)
            path = f"{own}/_{uuid.uuid4().hex}"
            for file in held:
                file.seek(0)
            with store.open_output_stream(path) as out:
                form.finish(out, held, count)
        return Written(path, count)

    def commit(self, messages: list[Written | None]) -> None:
        store, own = opened(self.folder)
        if self.overwrite and store.get_file_info(own).type == fs.FileType.Directory:
            for f in files_of(self.folder):
                store.delete_file(opened(f)[1])
        for message in messages:
            if message is not None and message.path:
                store.move(message.path, f"{own}/part-{message.path.rsplit('_', 1)[1]}{self.form.ending}")

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = opened(self.folder)
        for message in messages:
            if message is not None and message.path:
                store.delete_file(message.path)


def copied(file, out) -> None:
    while part := file.read(1 << 22):
        out.write(part)


class Form:
    """How rows become a file: a header, then `arrays` arrays one after another."""

    ending, arrays = "", 1

    def header(self, count: int) -> bytes:
        raise NotImplementedError

    def finish(self, out, held: list, count: int) -> None:
        out.write(self.header(count))
        for file in held:
            copied(file, out)


class PointForm(Form):
    """Records and header of point files."""

    ending = ".ply"

    def __init__(self, options: dict[str, str], names: list[str]):
        types = dict(pair.split(":") for pair in options["types"].split(","))
        self.kinds = {n: types[n] for n in names}
        self.text, self.digits = options.get("text", "false").lower() == "true", int(options.get("digits", 6))

    def records(self, columns: dict[str, np.ndarray], count: int) -> list[bytes]:
        if self.text:
            real = {n for n, k in self.kinds.items() if k in ("float", "float32", "double", "float64")}
            shown = [[f"{v:.{self.digits}f}" for v in columns[n].tolist()] if n in real else [str(int(v)) for v in columns[n].tolist()] for n in self.kinds]
            return ["".join(" ".join(row) + "\n" for row in zip(*shown, strict=True)).encode()]
        rows = np.empty(count, np.dtype([(n, ply.TYPES[k]) for n, k in self.kinds.items()]))
        for n in self.kinds:
            rows[n] = columns[n]
        return [rows.tobytes()]

    def header(self, count: int) -> bytes:
        return ply.header_text(self.kinds, count, self.text)


class LasForm(Form):
    """Records and header of LAS 1.2 files of point format 2: places in whole steps of option scale, colors of 16 bits."""

    ending = ".las"

    def __init__(self, options: dict[str, str], names: list[str]):
        self.scale, self.record = float(options.get("scale", 0.001)), np.dtype(LAS_FORMATS[2])
        self.least, self.most = np.full(3, np.inf), np.full(3, -np.inf)

    def records(self, columns: dict[str, np.ndarray], count: int) -> list[bytes]:
        rows = np.zeros(count, self.record)
        for k, c in enumerate("xyz"):
            rows[c.upper()] = steps = np.rint(columns[c] / self.scale).astype(np.int64)
            if count:
                self.least[k], self.most[k] = min(self.least[k], steps.min() * self.scale), max(self.most[k], steps.max() * self.scale)
        for c in ("red", "green", "blue"):
            rows[c] = columns[c]
        return [rows.tobytes()]

    def header(self, count: int) -> bytes:
        raw = bytearray(227)
        raw[:4], raw[24:26] = b"LASF", bytes((1, 2))
        struct.pack_into("<HIIBHI", raw, 94, 227, 227, 0, 2, self.record.itemsize, count)
        bounds = [v for pair in zip(self.most, self.least, strict=True) for v in pair]
        struct.pack_into("<12d", raw, 131, *[self.scale] * 3, *[0.0] * 3, *bounds)
        return bytes(raw)


class RegionForm(Form):
    """The arrays of a region input's cells, without edges."""

    ending, arrays = ".region", len(REGION_ARRAYS)

    def __init__(self, options: dict[str, str], names: list[str]):
        pass

    def records(self, columns: dict[str, np.ndarray], count: int) -> list[bytes]:
        return [np.stack([columns[c].astype(kind) for c in REGION_PARTS.get(name, (name,))], axis=1).tobytes() for name, kind, _ in REGION_ARRAYS]

    def header(self, count: int) -> bytes:
        return REGION_MARK + struct.pack("<qq", count, 0)


class LabelForm(Form):
    """A label for each cell."""

    ending = ".labels"

    def __init__(self, options: dict[str, str], names: list[str]):
        pass

    def records(self, columns: dict[str, np.ndarray], count: int) -> list[bytes]:
        return [columns["label"].astype("<i4").tobytes()]

    def header(self, count: int) -> bytes:
        return LABEL_MARK + struct.pack("<q", count)


class FieldForm(Form):
    """An uncompressed archive with an array for each column: its type is that of option types."""

    ending = ".npz"

    def __init__(self, options: dict[str, str], names: list[str]):
        types = dict(pair.split(":") for pair in options["types"].split(","))
        self.kinds = {n: np.dtype(types[n]) for n in names}
        self.arrays = len(names)

    def records(self, columns: dict[str, np.ndarray], count: int) -> list[bytes]:
        return [columns[n].astype(kind).tobytes() for n, kind in self.kinds.items()]

    def finish(self, out, held: list, count: int) -> None:
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
            for (name, kind), file in zip(self.kinds.items(), held, strict=True):
                with archive.open(f"{name}.npy", "w", force_zip64=True) as member:
                    np.lib.format.write_array_header_1_0(member, {"descr": np.lib.format.dtype_to_descr(kind), "fortran_order": False, "shape": (count,)})
                    copied(file, member)


FORMS = {"points": PointForm, "las": LasForm, "region": RegionForm, "labels": LabelForm, "field": FieldForm}


def read(spark: SparkSession, path: str, kind: str = "points", **options: object) -> DataFrame:
    """(file, row, fields...) of a file, or of all files of a folder, read in byte ranges; for options see Records.

    `stride` keeps rows 0, stride, 2 stride, ... of each file and `max_points` the first so many of those; `rows`
    fetches rows by number. Each is decided from headers alone, and rows between are not read where they are far.
    """
    spark.dataSource.register(Records)
    return spark.read.format(Records.name()).options(kind=kind, **{k: str(v) for k, v in options.items()}).load(path)


def fetch(rows: DataFrame, path: str, kind: str = "points") -> DataFrame:
    """(file, row, fields...) of `rows` (file, row) of the file or folder at `path`, as often as they are asked for; those that no file has are left out.

    Rows are sorted by file and row, so a task goes through its files once, and rows that are near are read at once.
    """
    spark = rows.sparkSession
    schema = read(spark, path, kind).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, layout, file = None, None, None
        for batch in batches:
            asked = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for own, group in itertools.groupby(asked, key=lambda r: r[0]):
                if own != name:
                    if file is not None:
                        file.close()
                    name, layout = own, layout_of(own, kind)
                    store, at = opened(own)
                    file = store.open_input_file(at)
                wanted = np.array([r for _, r in group], np.int64)
                wanted = wanted[(wanted >= 0) & (wanted < layout.count)]
                near = max(1, GAP // layout.width)
                for part in np.split(wanted, np.flatnonzero(np.diff(wanted) > near) + 1) if len(wanted) else ():
                    for k in range(0, len(part), BATCH):
                        some = part[k : k + BATCH]
                        fields = read_rows(file, layout, int(some[0]), int(some[-1] - some[0]) + 1)
                        yield batch_of(schema, own, some, {n: v[some - some[0]] for n, v in fields.items()})
        if file is not None:
            file.close()

    known = rows.filter("file is not null and row is not null").select(F.col("file").cast("string"), F.col("row").cast("long"))
    return known.repartitionByRange("file", "row").sortWithinPartitions("file", "row").mapInArrow(run, schema)


def write_points(points: DataFrame, path: str, types: dict[str, str], text: bool = False, digits: int = 6, overwrite: bool = False) -> None:
    """Point files of `points` in the folder `path`, one for each partition, rows in the order that they have there."""
    _written(points.select(*types), path, overwrite, kind="points", types=",".join(f"{c}:{k}" for c, k in types.items()), text=str(text).lower(), digits=digits)


def write_las(points: DataFrame, path: str, scale: float = 0.001, overwrite: bool = False) -> None:
    """LAS files of `points` (x, y, z, red, green, blue) in the folder `path`, one for each partition."""
    _written(points.select("x", "y", "z", "red", "green", "blue"), path, overwrite, kind="las", scale=scale)


def write_region(cells: DataFrame, path: str, overwrite: bool = False) -> None:
    """Region inputs of cells (the columns of REGION_ARRAYS) in the folder `path`, one for each partition."""
    _written(cells.select(*[c for name, _, _ in REGION_ARRAYS for c in REGION_PARTS.get(name, (name,))]), path, overwrite, kind="region")


def write_labels(cells: DataFrame, path: str, overwrite: bool = False) -> None:
    """Label vectors of cells (label) in the folder `path`, one for each partition."""
    _written(cells.select("label"), path, overwrite, kind="labels")


def write_field(cells: DataFrame, path: str, types: dict[str, str], overwrite: bool = False) -> None:
    """Archives of arrays in the folder `path`, one for each partition; `types` names each column's NumPy type."""
    _written(cells.select(*types), path, overwrite, kind="field", types=",".join(f"{c}:{k}" for c, k in types.items()))


def _written(points: DataFrame, path: str, overwrite: bool, **options: object) -> None:
    points.sparkSession.dataSource.register(Records)
    points.write.format(Records.name()).mode("overwrite" if overwrite else "append").options(**{k: str(v) for k, v in options.items()}).save(path)


def las_voxels(spark: SparkSession, path: str, size: float, **options: object) -> DataFrame:
    """(ix, iy, iz, n, x, y, z, red, green, blue) of the LAS files at `path`: means of the points of each cell of `size`.

    A color whose largest value in its file is above 255 is of 16 bits: a 256th of it, rounded half to even, counts.
    Points become partial sums of both readings of a color within each partition; which one holds is settled by a
    join of the partial sums with their files' largest values, so files are read once.
    """
    colors = ("red", "green", "blue")
    points = read(spark, path, "las", **options)
    if not set(colors) <= set(points.columns):
        raise ValueError("points without colors")
    key = ["ix", "iy", "iz"]
    cells = points.select("file", *[F.floor(F.col(c) / size).alias(k) for c, k in zip("xyz", key, strict=True)], "x", "y", "z", *colors)
    sums = [F.sum(c).alias(f"sum_{c}") for c in "xyz"]
    for c in colors:
        sums += [F.sum(F.rint(F.col(c) / 256.0)).alias(f"wide_{c}"), F.sum(F.least(F.col(c), F.lit(255)).cast("double")).alias(f"plain_{c}"), F.max(c).alias(f"most_{c}")]
    partial, _ = lineage.Scratch(spark, "las").keep(cells.groupBy("file", *key).agg(F.count("*").alias("n"), *sums))
    most = partial.groupBy("file").agg(*[(F.max(f"most_{c}") > 255).alias(f"is_wide_{c}") for c in colors])
    whole = partial.join(most, "file").groupBy(*key).agg(
        F.sum("n").alias("n"), *[(F.sum(f"sum_{c}") / F.sum("n")).alias(c) for c in "xyz"], *[(F.sum(F.when(F.col(f"is_wide_{c}"), F.col(f"wide_{c}")).otherwise(F.col(f"plain_{c}"))) / F.sum("n")).alias(c) for c in colors]
    )
    return whole.select(*key, "n", "x", "y", "z", *colors)


def text_points(spark: SparkSession, path: str, stride: int = 1) -> DataFrame:
    """(file, row, fields...) of point files with text records, split by Spark as any text; lines with too few or malformed fields are left out but counted.

    A line's row follows from its place in its block of the file and the lines of the blocks before, of which a first
    scan counts one number each.
    """
    header = ply.parse_header(head_of(files_of(path)[0]))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    # files share properties, not counts or comments: each file's own header says where its points start and how many there are
    named = F.regexp_extract("value", r"^element\s+vertex\s+(\d+)", 1).try_cast("long")
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.min(F.when(F.trim("value") == "end_header", F.col("at"))).alias("ended"), F.max(named).alias("points"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    file = Window.partitionBy("file")
    before = F.min(F.col("base") + F.col("ended") - F.col("first") + 1).over(file)
    blocks = blocks.select("file", "block", "first", "base", before.alias("before"), F.max("points").over(file).alias("points"))
    row = F.col("base") + F.col("at") - F.col("first") - F.col("before")
    # a row for each block that Spark reads, so far fewer than files have megabytes
    words = F.split(F.trim("value"), r"\s+")
    fields = [F.try_element_at(words, F.lit(k + 1)).try_cast(f.dataType).alias(f.name) for k, f in enumerate(header.schema.fields[1:])]
    rows = lines.join(F.broadcast(blocks), ["file", "block"]).select("file", row.alias("row"), F.col("points").alias("__points"), *fields)
    whole = F.lit(True)
    for name in header.names:
        whole &= F.col(name).isNotNull()
    return rows.filter((F.col("row") >= 0) & (F.col("row") < F.col("__points")) & (F.col("row") % stride == 0) & whole).drop("__points")
