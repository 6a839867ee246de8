"""Recordings out of archives: a data source with a partition a member, read as a stream.

    spark.dataSource.register(ArchiveMembers)
    spark.read.format("archive_members").option("path", "s3://bucket/study.zip").option("members", r"S\\d+/.*\\.npy").load()

An executor opens the archive where it is (any file system that pyarrow knows by its URI, or a shared folder), seeks to its member and
reads that in blocks. Members are arrays (npy, of numbers) or CSV of numbers. Nothing is unpickled.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Values of one block, and the bytes that are read for it.
BLOCK = 1 << 16
KIND = "archive string, member string, subject string, channel string, i bigint, v array<double>"


@contextmanager
def opened(path: str):
    """The zip archive at a path or URI."""
    files, name = pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)
    with files.open_input_file(name) as raw, zipfile.ZipFile(pa.PythonFile(raw, mode="r") if not hasattr(raw, "seek") else raw) as archive:
        yield archive


@dataclass
class Member(InputPartition):
    archive: str
    name: str


def arrays(stream: io.BufferedIOBase, block: int = BLOCK) -> Iterator[np.ndarray]:
    """The rows of an npy array of numbers, a bounded number of values at a time. Arrays of objects are refused."""
    version = np.lib.format.read_magic(stream)
    shape, by_columns, kind = np.lib.format.read_array_header_1_0(stream) if version == (1, 0) else np.lib.format.read_array_header_2_0(stream)
    if kind.hasobject or kind.names or kind.kind not in "biuf":
        raise ValueError(f"not an array of numbers: {kind}")
    if by_columns and len(shape) > 1 and min(shape) > 1:
        raise ValueError("an array stored by columns can't be read as a stream of rows")
    width = int(np.prod(shape[1:])) if len(shape) > 1 else 1
    left, many = (shape[0] if shape else 1), max(1, block // max(width, 1))
    while left:
        n = min(left, many)
        raw = stream.read(n * width * kind.itemsize)
        if len(raw) < n * width * kind.itemsize:
            raise ValueError("the array ends early")
        yield np.frombuffer(raw, kind).astype(float).reshape(n, width)
        left -= n


def lines(stream: io.BufferedIOBase, block: int = BLOCK) -> Iterator[np.ndarray]:
    """The rows of a CSV of numbers; a first row of names is passed over, an empty or other cell is not a number."""
    held: list[list[float]] = []

    def number(cell: str) -> float:
        try:
            return float(cell)
        except ValueError:
            return np.nan

    for k, row in enumerate(csv.reader(io.TextIOWrapper(stream, "utf-8", newline=""))):
        if not row:
            continue
        values = [number(c) for c in row]
        if k == 0 and all(v != v for v in values) and any(c.strip() for c in row):
            continue
        held.append(values)
        if len(held) * len(values) >= block:
            yield np.array(held)
            held = []
    if held:
        yield np.array(held)


FORMATS = {".npy": arrays, ".csv": lines}


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("option path: where is the archive?")
        self.paths = [p for p in options["path"].split(",") if p]
        self.members = re.compile(options.get("members", r".*\.(npy|csv)$"))
        self.prefix = re.compile(options.get("prefix", ""))
        self.subject = re.compile(options.get("subject", r"(?:^|/)(S?\d+)/"))
        self.block = int(options.get("block", BLOCK))

    def partitions(self) -> list[Member]:
        """Only the archives' directories are read here. Members are in numeric order of their names' numbers."""
        found = []
        for path in self.paths:
            with opened(path) as archive:
                found += [Member(path, m.filename) for m in archive.infolist() if not m.is_dir() and self.members.search(m.filename)]
        return sorted(found, key=lambda m: (m.archive, [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", m.name)]))

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        suffix = partition.name[partition.name.rfind(".") :].lower()
        if suffix not in FORMATS:
            raise ValueError(f"{partition.name}: neither {' nor '.join(FORMATS)}")
        name = self.prefix.sub("", partition.name, count=1)
        subject = self.subject.search(partition.name)
        channel = name.rpartition("/")[2][: -len(suffix)]
        at = 0
        with opened(partition.archive) as archive, archive.open(partition.name) as stream:
            for rows in FORMATS[suffix](stream, self.block):
                n = len(rows)
                fixed = [pa.array([x] * n, pa.string()) for x in (partition.archive, name, subject[1] if subject else None, channel)]
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1] or 1)[: n + 1].astype(np.int32)), pa.array(np.ascontiguousarray(rows).ravel(), from_pandas=True))
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(np.arange(at, at + n)), values], ["archive", "member", "subject", "channel", "i", "v"])
                at += n


class ArchiveMembers(DataSource):
    """A row a sample (archive, member without prefix, subject, channel, i, v) of the members of zip archives.

    Options: path (several with commas), members (an expression that their names must hold), prefix (an expression for what is stripped
    from the front of names), subject (one whose first group is the subject), block (values that are read at a time).
    """

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return KIND

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def members(spark: SparkSession, path: str, **options: str | int) -> DataFrame:
    """The samples of an archive's members; see ArchiveMembers. An archive without such members gives no rows."""
    spark.dataSource.register(ArchiveMembers)
    reader = spark.read.format("archive_members").option("path", path)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    if not ArchiveReader({"path": path, **{k: str(v) for k, v in options.items()}}).partitions():
        return spark.createDataFrame([], KIND)
    return reader.load()


def recording(samples: DataFrame, positive: tuple[int, ...], negative: tuple[int, ...], labels: str = "label", rates: dict[str, float] | None = None) -> DataFrame:
    """Samples (subject, channel, i, t_s, v, label) of the channels, with the label code of the channel labels at the same time: 1 for the
    positive codes, 0 for the negative ones; samples of other codes are dropped. rates: Hz by channel, that of labels included. A label
    holds from its sample's time to the next one's."""
    given = rates or {}
    hz = F.create_map(*(F.lit(x) for k, r in given.items() for x in (k, float(r)))) if given else F.create_map().cast("map<string,double>")
    rate = F.coalesce(F.try_element_at(hz, F.col("channel")), F.lit(1.0))
    code = samples.where(F.col("channel") == labels).select("subject", F.col("i").alias("at"), F.get("v", F.lit(0)).cast("int").alias("code"))
    label = F.when(F.col("code").isin(*positive), 1).when(F.col("code").isin(*negative), 0)
    own = samples.where(F.col("channel") != labels).select("subject", "channel", "i", (F.col("i") / rate).alias("t_s"), F.get("v", F.lit(0)).alias("v"))
    return own.withColumn("at", F.floor(F.col("t_s") * float(given.get(labels, 1.0)) + 1e-9)).join(code, ["subject", "at"]).withColumn("label", label).where("label is not null").drop("at", "code")


def extract(spark: SparkSession, path: str, target: str, members: str = ".*", prefix: str = "") -> DataFrame:
    """Copy members to the folder target, with prefix stripped from the front of their names, one task a member and a block at a time;
    (member, bytes) of what was written. Raises for names that would leave the folder."""
    listed = ArchiveReader({"path": path, "members": members}).partitions()
    strip = re.compile(prefix)

    def copy(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            for archive_path, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                short = strip.sub("", name, count=1).lstrip("/")
                if ".." in short.split("/") or not short:
                    raise ValueError(f"unfit member name {name}")
                files, root = pyarrow.fs.FileSystem.from_uri(target) if "://" in target or target.startswith("file:") else (pyarrow.fs.LocalFileSystem(), target)
                place, total = f"{root.rstrip('/')}/{short}", 0
                files.create_dir(place.rpartition("/")[0], recursive=True)
                with opened(archive_path) as archive, archive.open(name) as stream, files.open_output_stream(place) as out:
                    while block := stream.read(1 << 20):
                        out.write(block)
                        total += len(block)
                yield pa.RecordBatch.from_arrays([pa.array([short]), pa.array([total], pa.int64())], ["member", "bytes"])

    rows = spark.createDataFrame([(m.archive, m.name) for m in listed], "archive string, name string")
    return rows.repartition(max(1, len(listed)), "name").mapInArrow(copy, "member string, bytes bigint")
