"""``spark.read.format("osm_pbf")``: map extracts as a Python data source.

Options: ``path`` (a file, folder, comma list or glob; any file system pyarrow knows),
``type`` (nodes, ways, relations), ``splitbytes`` (blob bytes of one task, 32 MB).  Planning
only seeks from header to header; every task reads its own byte ranges.
"""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..schema import NODES, RELATIONS, WAYS
from .blocks import Block, blob_headers, header_features, inflate

SCHEMAS = {"nodes": NODES, "ways": WAYS, "relations": RELATIONS}
SUFFIX = ".pbf"
BATCH = 16_384


def list_files(path: str) -> list[str]:
    """The extracts that a path names; an error when there are none or a name has another suffix."""
    if not isinstance(path, str):
        raise ValueError("the path must be a string")
    found: list[str] = []
    for part in path.split(","):
        system, inner = _system(part)
        folder, name = os.path.split(inner)
        if any(c in name for c in "*?["):
            infos = system.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
            found += [i.path for i in infos if fnmatch.fnmatch(i.base_name, name) and i.base_name.endswith(SUFFIX)]
            continue
        info = system.get_file_info([inner])[0]
        if info.type == pafs.FileType.NotFound:
            raise ValueError(f"{part} does not exist")
        if info.type == pafs.FileType.Directory:
            found += [i.path for i in system.get_file_info(pafs.FileSelector(inner)) if i.base_name.endswith(SUFFIX)]
        elif not inner.endswith(SUFFIX):
            raise ValueError(f"{part} must end with {SUFFIX}")
        else:
            found.append(inner)
    if not found:
        raise ValueError(f"{path} holds no {SUFFIX} file")
    return sorted(found)


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), os.path.abspath(path))


@dataclass
class Blobs(InputPartition):
    path: str
    spans: list[tuple[int, int]]


class PbfReader(DataSourceReader):
    def __init__(self, path: str, kind: str, split: int, schema: StructType):
        self.path, self.kind, self.split, self.schema = path, kind, split, schema
        self.base = path.split(",")[0]

    def partitions(self) -> Sequence[InputPartition]:
        parts: list[InputPartition] = []
        system, _ = _system(self.base)
        for path in list_files(self.path):
            spans: list[tuple[int, int]] = []
            held = 0
            with system.open_input_file(path) as f:
                for kind, at, size in blob_headers(f):
                    if kind == "OSMHeader":
                        f.seek(at)
                        header_features(inflate(f.read(size)))
                    elif kind == "OSMData":
                        if spans and held + size > self.split:
                            parts.append(Blobs(path, spans))
                            spans, held = [], 0
                        spans.append((at, size))
                        held += size
            if spans:
                parts.append(Blobs(path, spans))
        return parts or [Blobs("", [])]

    def read(self, partition: Blobs) -> Iterator[pa.RecordBatch]:
        if not partition.spans:
            return
        schema = _arrow(self.kind)
        system, _ = _system(self.base)
        with system.open_input_file(partition.path) as f:
            for at, size in partition.spans:
                f.seek(at)
                for columns in Block(inflate(f.read(size))).columns(self.kind):
                    found = pa.RecordBatch.from_arrays([columns[c.name].cast(c.type) for c in schema], schema=schema)
                    for start in range(0, found.num_rows, BATCH):
                        yield found.slice(start, BATCH)


def _arrow(kind: str) -> pa.Schema:
    own = {"nodes": [("lon", pa.float64()), ("lat", pa.float64())], "ways": [("refs", pa.list_(pa.int64()))], "relations": [("members", pa.list_(pa.struct([("ref", pa.int64()), ("type", pa.int32()), ("role", pa.string())])))]}
    return pa.schema([("id", pa.int64()), *own[kind], ("tags", pa.map_(pa.string(), pa.string())), ("version", pa.int32()), ("timestamp", pa.int64()), ("changeset", pa.int64())])


class PbfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def _kind(self) -> str:
        kind = self.options.get("type", "nodes")
        if kind not in SCHEMAS:
            raise ValueError(f"type must be one of {', '.join(SCHEMAS)}")
        return kind

    def schema(self) -> StructType:
        """Timestamps are milliseconds here; ``read_pbf`` makes them TIMESTAMP."""
        plain = StructType()
        for field in SCHEMAS[self._kind()]:
            plain = plain.add(field.name, "long" if field.name == "timestamp" else field.dataType)
        return plain

    def reader(self, schema: StructType) -> DataSourceReader:
        path = self.options.get("path")
        if not path:
            raise ValueError("the path option is needed")
        list_files(path)
        return PbfReader(path, self._kind(), int(self.options.get("splitbytes", 32 << 20)), schema)


def read_pbf(spark: SparkSession, path: str, kind: str, split_bytes: int = 32 << 20) -> DataFrame:
    spark.dataSource.register(PbfSource)
    raw = spark.read.format("osm_pbf").option("type", kind).option("splitbytes", split_bytes).load(path)
    return raw.withColumn("timestamp", F.timestamp_millis("timestamp"))


def features(path: str) -> dict[str, list[str]]:
    """Required and optional features of the files' headers."""
    out: dict[str, list[str]] = {"required": [], "optional": []}
    system, _ = _system(path.split(",")[0])
    for file in list_files(path):
        with system.open_input_file(file) as f:
            for kind, at, size in blob_headers(f):
                if kind == "OSMHeader":
                    f.seek(at)
                    for name, found in zip(out, header_features(inflate(f.read(size))), strict=True):
                        out[name] += [x for x in found if x not in out[name]]
                    break
    return out


def blob_counts(spark: SparkSession, path: str) -> DataFrame:
    """``kind, blocks``: how many data blobs hold each type of element."""
    spark.dataSource.register(PbfSource)
    system, _ = _system(path.split(",")[0])
    spans = []
    for file in list_files(path):
        with system.open_input_file(file) as f:
            spans += [(file, at, size) for kind, at, size in blob_headers(f) if kind == "OSMData"]
    base = path.split(",")[0]

    def count(batches):
        for batch in batches:
            kinds = []
            for row in batch.to_pylist():
                with _system(base)[0].open_input_file(row["path"]) as f:
                    f.seek(row["at"])
                    kinds += Block(inflate(f.read(row["size"]))).kinds()
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string())], ["kind"])

    places = spark.createDataFrame(spans, "path string, at long, size long") if spans else spark.createDataFrame([], "path string, at long, size long")
    return places.mapInArrow(count, "kind string").groupBy("kind").agg(F.count("*").alias("blocks"))

