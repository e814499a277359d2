"""GeoTIFF rasters as a Spark data source, and their writing.

    register(spark)
    spark.read.format("gridtiff").load("/folder/*.tif")   # grid_id, row, col, embedding

Reads classic and big files, strips and tiles, uncompressed, deflated, LZW or
zstandard, band-interleaved or separate, with a horizontal or floating-point
predictor or none; writes deflated strips of one raster.
"""

from __future__ import annotations

import glob
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridlore.functions.geometry import Grid

_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 8: 2, 9: 4, 11: 4, 12: 8, 13: 4, 16: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q"}
_KINDS = {1: "u", 2: "i", 3: "f"}


@dataclass
class Header:
    order: str
    tags: dict[int, tuple]
    grid: Grid
    dtype: np.dtype

    def get(self, tag: int, default=None):
        found = self.tags.get(tag)
        return default if found is None else found if len(found) > 1 else found[0]


def read_header(path: str) -> Header:
    """A raster's tags and grid; the file's pixels stay unread."""
    with open(path, "rb") as f:
        lead = f.read(16)
        order = {b"II": "<", b"MM": ">"}.get(lead[:2])
        version = struct.unpack(order + "H", lead[2:4])[0] if order and len(lead) >= 8 else 0
        if version not in (42, 43):
            raise ValueError(f"not a TIFF file: {path}")
        big = version == 43
        word, width, entry_size = ("Q", 8, 20) if big else ("I", 4, 12)
        f.seek(struct.unpack(order + word, lead[8:16] if big else lead[4:8])[0])
        tags: dict[int, tuple] = {}
        (many,) = struct.unpack(order + ("Q" if big else "H"), f.read(8 if big else 2))
        for entry in [f.read(entry_size) for _ in range(many)]:
            tag, kind, n = struct.unpack(f"{order}HH{word}", entry[: 4 + width])
            size = _SIZES.get(kind, 1) * n
            value = entry[4 + width :]
            raw = value[:size]
            if size > width:
                here = f.tell()
                f.seek(struct.unpack(order + word, value)[0])
                raw = f.read(size)
                f.seek(here)
            tags[tag] = (raw.rstrip(b"\0").decode("latin-1"),) if kind == 2 else struct.unpack(f"{order}{n}{_CODES[kind]}", raw) if kind in _CODES else (raw,)
    bits, kind = tags.get(258, (1,))[0], tags.get(339, (1,))[0]
    dtype = np.dtype(f"{order}{_KINDS[kind]}{bits // 8}")
    scale, tie = tags.get(33550, (1.0, 1.0, 0.0)), tags.get(33922, (0.0,) * 6)
    keys = tags.get(34735, ())
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4)}
    code = codes.get(3072) or codes.get(2048)
    try:
        nodata = float(tags[42113][0])
    except (KeyError, ValueError):
        nodata = None
    grid = Grid(os.path.splitext(os.path.basename(path))[0], f"EPSG:{code}" if code else "", tags[256][0], tags[257][0], tie[3] - tie[0] * scale[0], scale[0], 0.0, tie[4] + tie[1] * scale[1], 0.0, -scale[1], nodata, tags.get(277, (1,))[0])
    return Header(order, tags, grid, dtype)


def bounds(path: str) -> tuple[float, float, float, float] | None:
    """The envelope of a raster, or none if it cannot be read."""
    try:
        g = read_header(path).grid
    except (OSError, ValueError, KeyError, struct.error):
        return None
    return (g.origin_x, g.origin_y + g.height * g.pixel_h, g.origin_x + g.width * g.pixel_w, g.origin_y)


def _unlzw(raw: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, the highest bit first; 256 clears the table, 257 ends."""
    out, table, width, last = bytearray(), [], 9, b""
    held = bits = 0
    for byte in raw:
        held, bits = (held << 8) | byte, bits + 8
        while bits >= width:
            bits -= width
            code = held >> bits
            held &= (1 << bits) - 1
            if code == 257:
                return bytes(out)
            if code == 256:
                table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
                continue
            now = table[code] if code < len(table) else last + last[:1]
            out += now
            if last:
                table.append(last + now[:1])
            last = now
            width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return bytes(out)


def _unzstd(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(raw)


_UNPACK = {1: bytes, 5: _unlzw, 8: zlib.decompress, 32946: zlib.decompress, 50000: _unzstd}


def read_rows(path: str, first: int, last: int, header: Header | None = None) -> np.ndarray:
    """Rows first:last of all bands, (bands, rows, columns)."""
    h = header or read_header(path)
    g, bands = h.grid, h.grid.bands
    tiled = 322 in h.tags
    bw, bh = (h.tags[322][0], h.tags[323][0]) if tiled else (g.width, min(h.tags.get(278, (g.height,))[0], g.height))
    offsets, sizes = (h.tags[324], h.tags[325]) if tiled else (h.tags[273], h.tags[279])
    packing, separate, predictor = h.tags.get(259, (1,))[0], h.tags.get(284, (1,))[0] == 2, h.tags.get(317, (1,))[0]
    if packing not in _UNPACK or predictor not in (1, 2, 3):
        raise ValueError(f"compression {packing} with predictor {predictor} is not supported")
    across, down = -(-g.width // bw), -(-g.height // bh)
    out = np.zeros((bands, last - first, g.width), dtype=h.dtype.newbyteorder("="))
    with open(path, "rb") as f:
        for plane in range(bands if separate else 1):
            for r in range(first // bh, -(-last // bh)):
                for c in range(across):
                    i = (plane * down + r) * across + c
                    f.seek(offsets[i])
                    raw = f.read(sizes[i])
                    raw = _UNPACK[packing](raw)
                    samples = 1 if separate else bands
                    rows = bh if tiled else min(bh, g.height - r * bh)
                    if predictor == 3:
                        # rows of byte planes, the highest byte first, each byte the difference to the one `samples` before it
                        planes = np.frombuffer(raw, dtype=np.uint8, count=rows * bw * samples * h.dtype.itemsize).reshape(rows, -1, samples)
                        planes = np.cumsum(planes, axis=1, dtype=np.uint8).reshape(rows, h.dtype.itemsize, bw * samples)
                        block = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(h.dtype.newbyteorder(">")).reshape(rows, bw, samples)
                    else:
                        block = np.frombuffer(raw, dtype=h.dtype, count=rows * bw * samples).reshape(rows, bw, samples)
                    if predictor == 2:
                        block = np.cumsum(block, axis=1, dtype=h.dtype)
                    top, bottom = max(first, r * bh), min(last, r * bh + rows, g.height)
                    wide = min(bw, g.width - c * bw)
                    part = block[top - r * bh : bottom - r * bh, :wide]
                    where = slice(plane, plane + 1) if separate else slice(None)
                    out[where, top - first : bottom - first, c * bw : c * bw + wide] = part.transpose(2, 0, 1)
    return out


def write_raster(path: str, cube: np.ndarray, grid: Grid, nodata: float | None = None) -> None:
    """One raster of (bands, rows, columns), or one band, in deflated strips; 64-bit integers become 32-bit, other types it has not become doubles."""
    cube = cube[None] if cube.ndim == 2 else cube
    if cube.dtype == np.int64:
        cube = cube.astype(np.int32)
    elif cube.dtype == bool:
        cube = cube.astype(np.uint8)
    if cube.dtype.kind not in "iuf" or cube.dtype.itemsize > 8 or (cube.dtype.kind in "iu" and cube.dtype.itemsize > 4) or cube.dtype == np.float16:
        cube = cube.astype(np.float64)
    bands, rows, cols = cube.shape
    step = max(1, min(rows, (1 << 20) // max(1, cols * bands * cube.dtype.itemsize)))
    strips = [zlib.compress(np.ascontiguousarray(cube[:, a : a + step].transpose(1, 2, 0)).astype(cube.dtype.newbyteorder("<")).tobytes(), 6) for a in range(0, rows, step)]
    code = grid.crs.upper().removeprefix("EPSG:")
    kind = {"u": 1, "i": 2, "f": 3}[cube.dtype.kind]
    start = 8 + sum(map(len, strips))
    offsets = np.cumsum([8, *map(len, strips[:-1])]).tolist()
    tags: list[tuple[int, int, list | bytes]] = [
        (256, 4, [cols]), (257, 4, [rows]), (258, 3, [cube.dtype.itemsize * 8] * bands), (259, 3, [8]), (262, 3, [1]), (273, 4, offsets), (277, 3, [bands]), (278, 4, [step]), (279, 4, [len(s) for s in strips]), (284, 3, [1]),
        (339, 3, [kind] * bands), (33550, 12, [grid.pixel_w, -grid.pixel_h, 0.0]), (33922, 12, [0.0, 0.0, 0.0, grid.origin_x, grid.origin_y, 0.0]),
    ]
    if code.isdigit():
        tags.append((34735, 3, [1, 1, 0, 2, 1024, 0, 1, 2 if code == "4326" else 1, 2048 if code == "4326" else 3072, 0, 1, int(code)]))
    if nodata is not None:
        tags.append((42113, 2, f"{nodata:g}".encode() + b"\0"))
    if bands > 1:
        tags.append((338, 3, [0] * (bands - 1)))
    tags.sort(key=lambda t: t[0])
    table, extra = struct.pack("<H", len(tags)), b""
    at = start + 2 + 12 * len(tags) + 4
    for tag, form, values in tags:
        raw = values if isinstance(values, bytes) else struct.pack(f"<{len(values)}{_CODES[form]}", *values)
        table += struct.pack("<HHI", tag, form, len(values))
        if len(raw) <= 4:
            table += raw.ljust(4, b"\0")
        else:
            table += struct.pack("<I", at + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
    own = f"{path}.{uuid.uuid4().hex}"  # a second attempt of a task replaces the file, it does not mix with the first
    with open(own, "wb") as f:
        f.write(struct.pack("<2sHI", b"II", 42, start) + b"".join(strips) + table + struct.pack("<I", 0) + extra)
    os.replace(own, path)


#: bytes of a file that one partition reads, about
PART_BYTES = 16 << 20


class _Part(InputPartition):
    def __init__(self, path: str, no: int, of: int):
        self.path, self.no, self.of = path, no, of


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.paths = sorted(p for x in path.split(",") for p in glob.glob(os.path.join(x, "*.tif*") if os.path.isdir(x) else x))

    def partitions(self) -> list[InputPartition]:
        """Parts of files by their size alone; headers are read by the tasks."""
        out = []
        for p in self.paths:
            of = max(1, -(-os.path.getsize(p) // PART_BYTES))
            out += [_Part(p, i, of) for i in range(of)]
        return out

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        header = read_header(part.path)
        # whole strips or rows of tiles, so that none is unpacked by two parts
        step = header.tags[323][0] if 322 in header.tags else min(header.tags.get(278, (header.grid.height,))[0], header.grid.height)
        blocks = -(-header.grid.height // step)
        first, last = (min(header.grid.height, blocks * i // part.of * step) for i in (part.no, part.no + 1))
        for a in range(first, last, 16):
            cube = read_rows(part.path, a, min(a + 16, last), header)
            bands, rows, cols = cube.shape
            flat = pa.array(cube.reshape(bands, -1).T.astype(np.float32).ravel())
            n = rows * cols
            yield pa.RecordBatch.from_arrays(
                [pa.array([header.grid.grid_id] * n), pa.array(np.repeat(np.arange(a, a + rows, dtype=np.int32), cols)), pa.array(np.tile(np.arange(cols, dtype=np.int32), rows)), pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands, dtype=np.int32)), flat)],
                names=["grid_id", "row", "col", "embedding"],
            )


class GeoTiffSource(DataSource):
    """Pixels of GeoTIFF files that every executor can open."""

    @classmethod
    def name(cls) -> str:
        return "gridtiff"

    def schema(self) -> str:
        return "grid_id string, row int, col int, embedding array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GeoTiffSource)


def grids(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A row of grid data a file; files that cannot be read have NULLs."""
    schema = "path string, grid_id string, crs string, width int, height int, origin_x double, pixel_w double, row_rot double, origin_y double, col_rot double, pixel_h double, nodata double, bands int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                try:
                    g = read_header(path).grid
                    rows.append((path, g.grid_id, g.crs, g.width, g.height, *g.transform, g.nodata, g.bands))
                except (OSError, ValueError, KeyError, struct.error):
                    rows.append((path, *[None] * 12))
            names = [c.split()[0] for c in schema.split(", ")]
            kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[c.split()[1]]) for i, c in enumerate(schema.split(", "))], names=names)

    asked = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 16)))
    return asked.mapInArrow(run, schema)


def write_geotiff(pixels: DataFrame, folder: str, grid: Grid, columns: list[str], nodata: float | None = None, name: str | None = None) -> DataFrame:
    """Write one raster a grid_id (and year, if there is one): a raster is one file, so one task's; large areas are many grids. Returns the paths.

    columns: a band each, or one array column with all bands.  name: the file's,
    for a single raster only; ValueError if there are several.
    """
    keys = ["grid_id", *(["year"] if "year" in pixels.columns else [])]
    if name is not None and len(pixels.select(*keys).distinct().take(2)) > 1:
        raise ValueError(f"{name} cannot hold several rasters; without a name each gets its own file")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        os.makedirs(folder, exist_ok=True)
        path = os.path.join(folder, "_".join(str(k.as_py()) for k in key) + ".tif") if name is None else os.path.join(folder, name)
        row, col = table.column("row").to_numpy(), table.column("col").to_numpy()
        if len(columns) == 1 and pa.types.is_list(table.column(columns[0]).type):
            values = np.array(table.column(columns[0]).to_pylist(), dtype=np.float32).T
        else:
            values = np.stack([table.column(c).to_numpy() for c in columns])
        cube = np.full((len(values), grid.height, grid.width), 0 if nodata is None else nodata, dtype=values.dtype)
        cube[:, row, col] = values
        write_raster(path, cube, grid, nodata)
        return pa.table({"path": [path]})

    return pixels.select(*keys, "row", "col", *columns).groupBy(*keys).applyInArrow(run, "path string")
