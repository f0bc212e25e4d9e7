"""Raster files (TIFF, in strips) as a Spark source and sink: tasks read strips and write whole images, which appear when all of them are written.

The file form is the public one: a header, one directory of tags, strips of rows. Files lie where pyarrow reaches: a local or shared folder, HDFS, an object store.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

ROWS = "image string, band string, y int, x int, value double"
#: Bytes of a file that one task reads at most, about.
SPLIT = 64 << 20
#: Rows of a strip as written.
STRIP_ROWS = 64
#: Numbers of tags, and struct letters of their types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, STRIP, COUNTS, PLANES, PREDICTOR, TILE_WIDTH, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 339
SCALE, TIEPOINT, MATRIX, KEYS, DESCRIPTION, NODATA = 33550, 33922, 34264, 34735, 270, 42113
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
KINDS = {1: "u", 2: "i", 3: "f"}


def _at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


@dataclass(frozen=True)
class Header:
    """What a file says of itself: its size, bands, sample type, strips, place and tags."""

    tags: dict[int, Any]
    order: str

    def one(self, tag: int, default: Any = None) -> Any:
        value = self.tags.get(tag, default)
        return value[0] if isinstance(value, tuple) else value

    @property
    def samples(self) -> int:
        return self.one(SAMPLES, 1)

    @property
    def planar(self) -> bool:
        return self.one(PLANES, 1) == 2

    @property
    def kind(self) -> np.dtype:
        return np.dtype(f"{self.order}{KINDS[self.one(FORMAT, 1)]}{self.one(BITS, 1) // 8}")

    @property
    def described(self) -> dict:
        """The tags that were given when it was written; none if the description is something else."""
        try:
            found = json.loads(self.tags.get(DESCRIPTION, b"{}").rstrip(b"\0"))
        except ValueError:
            return {}
        return found if isinstance(found, dict) else {}

    @property
    def bands(self) -> list[str]:
        return self.described.get("bands") or [str(i + 1) for i in range(self.samples)]

    @property
    def nodata(self) -> float | None:
        return float(self.tags[NODATA].rstrip(b"\0 ")) if NODATA in self.tags else None

    @property
    def transform(self) -> list[float] | None:
        """[a, b, c, d, e, f] of x = a col + b row + c, y = d col + e row + f."""
        if MATRIX in self.tags:
            m = self.tags[MATRIX]
            return [m[0], m[1], m[3], m[4], m[5], m[7]]
        if SCALE in self.tags and TIEPOINT in self.tags:
            (sx, sy, _), (i, j, _, x, y, _) = self.tags[SCALE], self.tags[TIEPOINT][:6]
            return [sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy]
        return None

    @property
    def epsg(self) -> int | None:
        keys = self.tags.get(KEYS, ())
        return next((keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k] == 3072 and keys[k + 1] == 0), None)


def read_header(file: Any) -> Header:
    """The tags of an open file's first image. Files of 2**32 bytes and more (another form of header) are refused."""
    start = file.read_at(8, 0)
    order = {b"II": "<", b"MM": ">"}.get(start[:2])
    if order is None or struct.unpack(order + "H", start[2:4])[0] != 42:
        raise ValueError("not a raster file of the plain form")
    at = struct.unpack(order + "I", start[4:])[0]
    n = struct.unpack(order + "H", file.read_at(2, at))[0]
    tags: dict[int, Any] = {}
    for entry in struct.iter_unpack(order + "HHI4s", file.read_at(12 * n, at + 2)):
        tag, kind, count, value = entry
        if kind not in TYPES:
            continue
        letter = TYPES[kind]
        size = count * struct.calcsize("=" + letter)
        raw = value[:size] if size <= 4 else file.read_at(size, struct.unpack(order + "I", value)[0])
        tags[tag] = raw if letter == "s" else struct.unpack(f"{order}{count}{letter}", raw)
    head = Header(tags, order)
    if head.one(COMPRESSION, 1) not in (1, 8, 32946) or head.one(PREDICTOR, 1) != 1 or TILE_WIDTH in tags:
        raise ValueError("only strips without or with plain deflate compression are read")
    return head


def encode_header(width: int, height: int, bands: list[str], *, transform: list[float], epsg: int | None, nodata: float | None, tags: dict) -> tuple[bytes, int]:
    """The head of an uncompressed file of doubles, band after band, and the rows of a strip: all offsets are known before a value is."""
    strips = -(-height // STRIP_ROWS)
    sizes = [8 * width * min(STRIP_ROWS, height - k * STRIP_ROWS) for k in range(strips)] * len(bands)
    a, b, c, d, e, f = transform
    text = json.dumps(tags | {"bands": bands}).encode() + b"\0"
    place = {SCALE: ("d", (a, -e, 0.0)), TIEPOINT: ("d", (0.0, 0.0, 0.0, c, f, 0.0))} if not b and not d and a > 0 > e else {MATRIX: ("d", (a, b, 0.0, c, d, e, 0.0, f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0))}
    entries: dict[int, tuple[str, Any]] = {
        WIDTH: ("I", (width,)), HEIGHT: ("I", (height,)), BITS: ("H", (64,) * len(bands)), COMPRESSION: ("H", (1,)), PHOTOMETRIC: ("H", (1,)), DESCRIPTION: ("s", text), OFFSETS: ("I", tuple([0] * len(sizes))),
        SAMPLES: ("H", (len(bands),)), STRIP: ("I", (STRIP_ROWS,)), COUNTS: ("I", tuple(sizes)), PLANES: ("H", (2,)), FORMAT: ("H", (3,) * len(bands)), **place,
    }
    if epsg is not None:
        entries[KEYS] = ("H", (1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, epsg))
    if nodata is not None:
        entries[NODATA] = ("s", repr(float(nodata)).encode() + b"\0")
    letters = {v: k for k, v in TYPES.items()}

    def laid(first: int) -> bytes:
        at, own = first, []
        for size in sizes:
            own.append(at)
            at += size
        if at >= 1 << 32:
            raise ValueError("an image must be smaller than 4 GiB; cut it into tiles")
        entries[OFFSETS] = ("I", tuple(own))
        rows, rest, end = b"", b"", 8 + 2 + 12 * len(entries) + 4
        for tag, (letter, value) in sorted(entries.items()):
            raw = value if letter == "s" else struct.pack(f"<{len(value)}{letter}", *value)
            put = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", end + len(rest))
            rest += raw + b"\0" * (len(raw) % 2) if len(raw) > 4 else b""
            rows += struct.pack("<HHI4s", tag, letters[letter], len(value), put)
        return b"II*\0" + struct.pack("<IH", 8, len(entries)) + rows + b"\0\0\0\0" + rest

    return laid(len(laid(0))), STRIP_ROWS


@dataclass
class Piece(InputPartition):
    """Part k of n of a file's strips."""

    path: str
    k: int
    n: int


class RasterReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"]

    def partitions(self) -> list[Piece]:
        """Files are listed, not opened; large ones are shared out among tasks."""
        system, root = _at(self.root)
        found = system.get_file_info(root)
        files = [found] if found.type == fs.FileType.File else [x for x in system.get_file_info(fs.FileSelector(root, recursive=True)) if x.type == fs.FileType.File and x.path.endswith((".tif", ".tiff")) and "/_temporary-" not in x.path]
        return [Piece(x.path, k, n) for x in sorted(files, key=lambda x: x.path) for n in [max(1, -(-x.size // SPLIT))] for k in range(n)]

    def read(self, piece: Piece | None) -> Iterator[pa.RecordBatch]:
        if piece is None:  # no files, no parts
            return
        system, _ = _at(self.root)
        with system.open_input_file(piece.path) as file:
            head = read_header(file)
            width, height, rows = head.one(WIDTH), head.one(HEIGHT), min(head.one(STRIP, 1 << 30), head.one(HEIGHT))
            strips, bands, nodata = -(-height // rows), head.bands, head.nodata
            offsets, counts, image = head.tags[OFFSETS], head.tags[COUNTS], piece.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
            for s in range(len(offsets) * piece.k // piece.n, len(offsets) * (piece.k + 1) // piece.n):
                raw = file.read_at(counts[s], offsets[s])
                raw = raw if head.one(COMPRESSION, 1) == 1 else zlib.decompress(raw)
                top, n = s % strips * rows, min(rows, height - s % strips * rows)
                values = np.frombuffer(raw, dtype=head.kind, count=n * width * (1 if head.planar else head.samples)).astype(np.float64)
                planes = {s // strips: values} if head.planar else {i: values.reshape(-1, head.samples)[:, i] for i in range(head.samples)}
                y, x = np.divmod(np.arange(n * width), width)
                for band, own in planes.items():
                    missing = ~np.isfinite(own) if nodata is None else ~np.isfinite(own) | (own == nodata)
                    names = [pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(own), dtype=np.int32)), pa.array([v])).cast(pa.string()) for v in (image, bands[band])]
                    yield pa.RecordBatch.from_arrays([*names, pa.array((top + y).astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(np.ascontiguousarray(own), mask=missing)], ["image", "band", "y", "x", "value"])


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class RasterWriter(DataSourceWriter):
    """Rows come sorted by image, then band in the files' order, y and x; an image's rows come to one task, which holds a strip of them."""

    def __init__(self, options: dict) -> None:
        self.root, self.aside = options["path"], f"_temporary-{uuid.uuid4().hex}"
        self.width, self.height, self.bands = int(options["width"]), int(options["height"]), json.loads(options["bands"])
        self.nodata = float(options["nodata"]) if "nodata" in options else float("nan")
        self.head, self.rows = encode_header(self.width, self.height, self.bands, transform=json.loads(options.get("transform", "[1, 0, 0, 0, -1, 0]")), epsg=int(options["epsg"]) if "epsg" in options else None, nodata=self.nodata, tags=json.loads(options.get("tags", "{}")))

    def write(self, rows: Iterator) -> Written:
        system, root = _at(self.root)
        order, files, out, image, strip, at = {b: k for k, b in enumerate(self.bands)}, [], None, (), np.zeros(0), 0
        strips = -(-self.height // self.rows)
        blank = lambda s: np.full(self.width * min(self.rows, self.height - s % strips * self.rows), self.nodata, dtype="<f8")

        def up_to(last: int) -> None:
            """Write the strip at hand and empty ones before number `last`."""
            nonlocal strip, at
            while at < last:
                out.write(strip.tobytes())
                at += 1
                strip = blank(at)

        system.create_dir(f"{root}/{self.aside}", recursive=True)
        seat = None
        for name, band, y, x, value in rows:
            if name != image:
                if out:
                    up_to(strips * len(self.bands))
                    out.close()
                if name is None or "/" in name:
                    raise ValueError(f"not a name of an image: {name!r}")
                image, path, at, seat = name, f"{root}/{self.aside}/{uuid.uuid4().hex}", 0, None
                files.append((path, f"{root}/{name}.tif"))
                out, strip = system.open_output_stream(path), blank(0)
                out.write(self.head)
            if band not in order or not 0 <= y < self.height or not 0 <= x < self.width:
                raise ValueError(f"no such cell: {band!r}, {y}, {x}")
            now = (order[band], y, x)
            if seat is not None and now <= seat:
                raise ValueError(f"cells of {name!r} come twice or out of order: {now}")
            seat = now
            up_to(order[band] * strips + y // self.rows)
            if value is not None:
                strip[y % self.rows * self.width + x] = value
        if out:
            up_to(strips * len(self.bands))
            out.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        system, root = _at(self.root)
        for message in messages:
            for path, name in message.files if message else ():
                system.move(path, name)
        system.delete_dir(f"{root}/{self.aside}")

    def abort(self, messages: list) -> None:
        system, root = _at(self.root)
        if system.get_file_info(f"{root}/{self.aside}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.aside}")


class RasterSource(DataSource):
    """Format `raster`: rows (image, band, y, x, value), value null where a file says nodata or is not finite."""

    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema: Any) -> RasterReader:
        return RasterReader(dict(self.options))

    def writer(self, schema: Any, overwrite: bool) -> RasterWriter:
        if overwrite:
            raise ValueError("images are added, never overwritten in one go; write with mode append")
        return RasterWriter(dict(self.options))


def read_rasters(spark: SparkSession, path: str) -> DataFrame:
    """image, band, y, x, value of every cell of the files at a path (one, or a folder with what lies below it)."""
    spark.dataSource.register(RasterSource)
    return spark.read.format("raster").load(path)


def write_rasters(cells: DataFrame, path: str, *, width: int, height: int, bands: list[str], transform: list[float], epsg: int | None = None, nodata: float = -9999.0, tags: dict | None = None) -> None:
    """One file `image`.tif for each image of cells (image, band, y, x, value), bands in this order; cells that are missing, or null, are nodata. Files of these names are replaced.

    Images are dealt out to tasks, and a task holds a strip of one, whatever its size; an image is one task's work, so larger scenes are images by tile. Nothing is
    seen at `path` until every image is written, and nothing stays if one fails. Names of images must be usable in paths; cells off the grid or of other bands, and those that come
    twice, fail the query.
    """
    spark = cells.sparkSession
    spark.dataSource.register(RasterSource)
    from pyspark.sql import functions as F

    nth = F.coalesce(*[F.when(F.col("band") == b, F.lit(k)) for k, b in enumerate(bands)], F.lit(len(bands)))
    dealt = cells.select("image", "band", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("value").cast("double").alias("value")).repartition("image").sortWithinPartitions("image", nth, "y", "x")
    options = {"width": width, "height": height, "bands": json.dumps(bands), "transform": json.dumps(transform), "nodata": nodata, "tags": json.dumps(tags or {})} | ({} if epsg is None else {"epsg": epsg})
    dealt.write.format("raster").mode("append").options(**options).save(path)


def header_of(path: str) -> Header:
    system, at = _at(path)
    with system.open_input_file(at) as file:
        return read_header(file)
