"""Acquisitions as DataFrames: a Python data source for the binary files, header tables, sessions and listings."""

from __future__ import annotations

import io
import json
import struct
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from ionlake.sources import header as H

TILES = "acq_id string, plane int, ch_idx int, label string, height int, width int, counts array<long>"
FULL = (
    "basic map<string,double>, bfield map<string,long>, primary map<string,double>, secondary map<string,long>, "
    "mass_table map<int,struct<row_index:int,mass_amu:double,radius_mm:double,neg_plate_dac:int,pos_plate_dac:int,exit_slit_um:double>>, "
    "detectors map<int,struct<hv_v:int,threshold_mv:double>>, selectors string, pending map<string,double>, layout_problems array<string>"
)


#: Bytes of planes that one split reads about.
SPLIT_BYTES = 1 << 27
#: With more files than this, a file is a split and tasks read the headers.
MANY_FILES = 64


def open_file(path: str):
    """A file that a task reads in ranges."""
    from pyarrow import fs as pafs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = f"file://{path[5:]}"
    fs, inner = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    return fs.open_input_file(inner)


def head_of(path: str) -> dict:
    with open_file(path) as f:
        size = f.size()
        return H.parse_header(f.read_at(min(size, H.HEADER_BYTES), 0), size)


class _Split(InputPartition):
    """Planes of a file; all of them, by the header that the task reads, where head is None."""

    def __init__(self, path: str, planes: list[int], head: dict | None):
        self.path, self.planes, self.head = path, planes, head
        self.plane = planes[0] if planes else -1


class StackReader(DataSourceReader):
    """Splits of planes; equality filters on plane, ch_idx and label skip splits, planes and blocks before they are read."""

    def __init__(self, options):
        paths = options.get("paths") or options.get("path") or ""
        self.paths = json.loads(paths) if paths.startswith("[") else [p for p in paths.split(",") if p]
        if not self.paths:
            raise ValueError("a path is needed")
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if name in ("plane", "ch_idx", "label"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name] = self.wanted[name] & values if name in self.wanted else values
            else:
                yield f

    def _planes(self, head: dict) -> list[int]:
        planes = range(head["n_planes"])
        return [p for p in planes if p in self.wanted.get("plane", planes)]

    def partitions(self):
        if len(self.paths) > MANY_FILES:
            return [_Split(path, [], None) for path in self.paths]
        out = []
        for path in self.paths:
            head = head_of(path)
            planes = self._planes(head)
            each = max(1, SPLIT_BYTES // max(1, 4 * head["width"] * head["height"] * head["n_masses"]))
            out += [_Split(path, planes[k : k + each], head) for k in range(0, len(planes), each)]
        return out or [_Split("", [], None)]

    def read(self, split):
        if not split.path:
            return
        head = split.head or head_of(split.path)
        cells = head["width"] * head["height"]
        with open_file(split.path) as f:
            for plane in split.planes if split.head else self._planes(head):
                for ch in head["channels"]:
                    if ch["ch_idx"] not in self.wanted.get("ch_idx", {ch["ch_idx"]}) or ch["label"] not in self.wanted.get("label", {ch["label"]}):
                        continue
                    data = f.read_at(cells * 4, head["data_offset"] + (plane * head["n_masses"] + ch["ch_idx"]) * cells * 4)
                    counts = pa.ListArray.from_arrays(pa.array([0, cells], pa.int32()), pa.array(np.frombuffer(data, "<u4").astype(np.int64)))
                    scalars = ((split.path.rsplit("/", 1)[-1], pa.string()), (plane, pa.int32()), (ch["ch_idx"], pa.int32()), (ch["label"], pa.string()), (head["height"], pa.int32()), (head["width"], pa.int32()))
                    yield pa.RecordBatch.from_arrays([*(pa.array([v], t) for v, t in scalars), counts], names=[c.split()[0] for c in TILES.split(", ")])


class StackSource(DataSource):
    """spark.read.format('ionstack').load(path): tiles of one file, or of several by option paths (a JSON list, or separated by commas)."""

    @classmethod
    def name(cls):
        return "ionstack"

    def schema(self):
        return TILES

    def reader(self, schema):
        return StackReader(self.options)


def read_stack(spark: SparkSession, *paths: str) -> DataFrame:
    """Tiles of the files.  Filters reach the files where spark.sql.python.filterPushdown.enabled is set, as plans.batch.session does; elsewhere it is set here."""
    if spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") != "true":
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StackSource)
    return spark.read.format("ionstack").option("paths", json.dumps(paths)).load()


def to_voxels(tiles: DataFrame) -> DataFrame:
    """(acq_id, plane, ch_idx, channel, y, x, counts) of tiles."""
    held = tiles.select("acq_id", "plane", "ch_idx", F.col("label").alias("channel"), "width", F.posexplode("counts").alias("i", "counts"))
    return held.select("acq_id", "plane", "ch_idx", "channel", F.expr("i div width").cast("int").alias("y"), (F.col("i") % F.col("width")).cast("int").alias("x"), F.col("counts"))


def to_tiles(voxels: DataFrame, height: int, width: int) -> DataFrame:
    """(acq_id, plane, channel, height, width, counts): dense images, absent pixels 0."""
    cells = voxels.groupBy("acq_id", "plane", "channel").agg(F.map_from_entries(F.collect_list(F.struct((F.col("y") * width + F.col("x")).alias("i"), "counts"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)))
    return cells.select("acq_id", "plane", "channel", F.lit(height).alias("height"), F.lit(width).alias("width"), dense.alias("counts"))


def list_files(spark: SparkSession, folder: str, pattern: str = "*.im") -> DataFrame:
    """(path, length, modificationTime) of a folder's files, contents unread."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length", "modificationTime")


HEADER = "data_offset long, stage_x int, stage_y int, stage_z int, duration_s long, planned_planes long, n_masses int, dwell_us long, instrument string, date string, time string, width int, height int, raster_nm long, pixel_nm double, field_um double, n_planes long, channels array<struct<ch_idx:int,label:string,nom_mass:double>>"


def read_headers(spark: SparkSession, folder: str, pattern: str = "*.im") -> DataFrame:
    """One row a file: its basic header, extended groups and capture time as a timestamp where it parses."""
    held = list_files(spark, folder, pattern).select("path", "length")

    @F.pandas_udf(f"header struct<{_struct(HEADER)}>, full struct<{_struct(FULL)}>")
    def parse(path: pd.Series, length: pd.Series) -> pd.DataFrame:
        rows = []
        for name, size in zip(path, length, strict=True):
            with open_file(name) as f:
                data = f.read_at(min(size, H.HEADER_BYTES), 0)
            basic = H.parse_header(bytes(data), size)
            full = H.full_metadata(bytes(data), [c["nom_mass"] for c in basic["channels"]])
            full["basic"] = {k: None if v is None else float(v) for k, v in full["basic"].items()}
            full["primary"] = {k: None if v is None else float(v) for k, v in full["primary"].items()}
            rows.append({"header": basic, "full": full | {"selectors": json.dumps(full["selectors"])}})
        return pd.DataFrame(rows)

    out = held.select("path", "length", parse("path", "length").alias("p")).select("path", "length", "p.header.*", "p.full")
    return out.withColumn("captured", F.try_to_timestamp(F.concat_ws(" ", "date", "time"), F.lit("dd.MM.yy HH:mm")))


def _struct(ddl: str) -> str:
    """Top-level 'name type' pairs as 'name:type'."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, kind = ddl[start:i].strip().split(" ", 1)
            out.append(f"{name}:{kind}")
            start = i + 1
    return ",".join(out)


# --- sessions: one folder of Parquet tables each


def save_session(folder: str, tiles: DataFrame, corrected: DataFrame | None = None, shifts: DataFrame | None = None, metadata: dict | None = None) -> None:
    """Raw and corrected tiles, shifts and metadata with provenance; view settings aren't kept."""
    spark = tiles.sparkSession
    tiles.write.mode("overwrite").partitionBy("acq_id").parquet(f"{folder}/tiles")
    for name, df in (("corrected", corrected), ("shifts", shifts)):
        if df is not None:
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
    row = spark.createDataFrame([(json.dumps(metadata or {}, default=str), uuid.uuid4().hex, spark.version)], "metadata string, session_id string, engine string").withColumn("saved", F.current_timestamp())
    row.write.mode("overwrite").parquet(f"{folder}/provenance")


def load_session(spark: SparkSession, folder: str) -> dict:
    """Tables of a session; tiles must be there, the others are None where they were not saved."""

    def table(name):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}") if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else None

    out = {n: table(n) for n in ("tiles", "corrected", "shifts", "provenance")}
    if out["tiles"] is None:
        raise FileNotFoundError(f"{folder} has no tiles")
    out["metadata"] = json.loads(out["provenance"].first()["metadata"]) if out["provenance"] is not None else {}
    return out


def add_to_journal(spark: SparkSession, folder: str, kind: str, caption: str, payload: str) -> None:
    """Appends one entry (kind, caption, added, payload) to the journal table."""
    spark.createDataFrame([(kind, caption, payload)], "kind string, caption string, payload string").withColumn("added", F.current_timestamp()).write.mode("append").parquet(f"{folder}/journal")


def export_stack(tiles: DataFrame, folder: str, corrected: DataFrame | None = None) -> None:
    """Tiles for other tools as Parquet, corrected ones where given."""
    (tiles if corrected is None else corrected).write.mode("overwrite").parquet(folder)


def npz_bytes(stack: np.ndarray, names: list[str]) -> bytes:
    """A NumPy archive with arrays stack (axes ZCYX) and channels."""
    out = io.BytesIO()
    np.savez_compressed(out, stack=stack, channels=np.array(names), axes="ZCYX")
    return out.getvalue()


def tiff_bytes(stack: np.ndarray, names: list[str]) -> bytes:
    """A TIFF of 32-bit pages in the order Z, C, uncompressed, described as a hyperstack."""
    z, c, height, width = stack.shape
    kind = 3 if stack.dtype.kind == "f" else 1
    pages = stack.reshape(z * c, height, width).astype("<f4" if kind == 3 else "<u4")
    text = f"ImageJ=1.11a\nimages={z * c}\nchannels={c}\nslices={z}\nhyperstack=true\naxes=ZCYX\nlabels={'|'.join(names)}\n".encode() + b"\0"
    size, tags = height * width * 4, 11
    first = 8 + len(text) + len(text) % 2
    block = 2 + tags * 12 + 4
    data_at = first + block * len(pages)
    out = [struct.pack("<2sHI", b"II", 42, first), text, b"\0" * (len(text) % 2)]
    for k in range(len(pages)):
        # tag, type (2 text, 3 short, 4 long), number, value
        entries = [(256, 4, 1, width), (257, 4, 1, height), (258, 3, 1, 32), (259, 3, 1, 1), (262, 3, 1, 1), (270, 2, len(text), 8), (273, 4, 1, data_at + k * size), (277, 3, 1, 1), (278, 4, 1, height), (279, 4, 1, size), (339, 3, 1, kind)]
        out.append(struct.pack("<H", tags) + b"".join(struct.pack("<HHII", *e) for e in entries) + struct.pack("<I", first + (k + 1) * block if k + 1 < len(pages) else 0))
    return b"".join([*out, pages.tobytes()])


ENCODERS = {"npz": npz_bytes, "tiff": tiff_bytes}


def export_arrays(tiles: DataFrame, folder: str, kind: str = "npz") -> DataFrame:
    """Writes a file an acquisition, folder/<acq_id>.<kind>, with axes ZCYX; (acq_id, path, planes, channels, bytes).

    kind is npz or tiff.  tiles(acq_id, plane, label or channel, height, width,
    counts): whole numbers stay so, others become 32-bit floats; planes and
    channels that an acquisition lacks are 0.  An acquisition is held by one
    task.  A file is written under another name first, so a repeated task leaves
    whole files.
    """
    encode = ENCODERS[kind]
    name = "channel" if "channel" in tiles.columns else "label"
    held = tiles.select("acq_id", "plane", F.col(name).alias("name"), *(("ch_idx",) if "ch_idx" in tiles.columns else (F.lit(0).alias("ch_idx"),)), "height", "width", "counts")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs as pafs

        planes = sorted(pdf["plane"].unique())
        names = list(pdf.sort_values(["ch_idx", "name"])["name"].drop_duplicates())
        height, width = int(pdf["height"].iloc[0]), int(pdf["width"].iloc[0])
        whole = all(np.asarray(c).dtype.kind in "iu" for c in pdf["counts"])
        stack = np.zeros((len(planes), len(names), height, width), np.uint32 if whole else np.float32)
        for plane, channel, counts in zip(pdf["plane"], pdf["name"], pdf["counts"], strict=True):
            stack[planes.index(plane), names.index(channel)] = np.asarray(counts).reshape(height, width)
        data, acq = encode(stack, names), str(pdf["acq_id"].iloc[0])
        fs, inner = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)
        fs.create_dir(inner, recursive=True)
        target, part = f"{inner}/{acq}.{kind}", f"{inner}/.{acq}.{uuid.uuid4().hex}"
        with fs.open_output_stream(part, compression=None) as f:
            f.write(data)
        fs.move(part, target)
        return pd.DataFrame({"acq_id": [acq], "path": [f"{folder}/{acq}.{kind}"], "planes": [len(planes)], "channels": [len(names)], "bytes": [len(data)]})

    return held.groupBy("acq_id").applyInPandas(run, "acq_id string, path string, planes int, channels int, bytes long")
