"""A stored table as a stream that follows an order.

``write_ordered`` lays a table out in files by ranges of an order, one generation of files for each call.
``OrderedTable`` is a streaming source over such a folder: an offset counts files in their order, a micro-batch takes the
next ``files_per_batch`` of them and each file is a partition of its own. So batches follow the order while the files of a
batch are read side by side, and generations that are added later come after all earlier ones.

The source steps by itself, so a query must run on its default trigger until no file is left (``streams.drained``); the
trigger ``availableNow`` would stop after one step. Spark does not tell a source where a restarted query stands, so
``read_ordered`` looks it up in the query's checkpoint; without one, all files that are left go into one batch. Files are
opened by ``pyarrow.fs``: the folder must lie in a store that it knows (local or shared folders,
HDFS, S3, GCS).
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from loomframe.session import ship

#: The reader's Python also starts beside the driver, where added files are not seen: its code travels along.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def generations(path: str) -> tuple[pafs.FileSystem, list[str]]:
    """The committed generations below ``path``, oldest first."""
    fs, base = pafs.FileSystem.from_uri(path)
    found = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
    folders = sorted(f.path for f in found if f.type == pafs.FileType.Directory)
    return fs, [f for f in folders if fs.get_file_info(f"{f}/_SUCCESS").type == pafs.FileType.File]


def ordered_files(path: str) -> tuple[pafs.FileSystem, list[str]]:
    """The files of all generations, in order."""
    fs, folders = generations(path)
    files = []
    for folder in folders:
        listed = fs.get_file_info(pafs.FileSelector(folder))
        files += sorted(f.path for f in listed if f.path.endswith(".parquet"))
    return fs, files


def write_ordered(df: DataFrame, path: str, files: int, *order: str) -> None:
    """Append ``df`` to the ordered table at ``path``: up to ``files`` files by ranges of ``order``, nulls first."""
    n = len(generations(path)[1])
    df.repartitionByRange(files, *order).sortWithinPartitions(*order).write.parquet(f"{path}/generation={n:08d}")


class FilePartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


class OrderedReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.step = options["path"], int(options.get("files_per_batch", "1"))
        self.at = int(options["start"]) if "start" in options else None  # files planned so far
        self.arrow = to_arrow_schema(schema)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": 0, "path": self.path}

    def latestOffset(self) -> dict:  # noqa: N802
        n = len(ordered_files(self.path)[1])
        return {"files": n if self.at is None else min(n, self.at + self.step), "path": self.path}

    def partitions(self, start: dict, end: dict) -> list[FilePartition]:
        if self.at is not None:
            self.at = end["files"]
        return [FilePartition(f) for f in ordered_files(self.path)[1][start["files"] : end["files"]]]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        fs = pafs.FileSystem.from_uri(self.path)[0]
        with fs.open_input_file(partition.path) as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=10_000, columns=self.arrow.names):
                yield batch.select(self.arrow.names).cast(self.arrow)


class OrderedTable(DataSource):
    """Options: ``path``, ``files_per_batch`` (1), ``start`` (files that the query has planned before)."""

    @classmethod
    def name(cls) -> str:
        return "ordered_table"

    def schema(self) -> StructType:
        fs, files = ordered_files(self.options["path"])
        if not files:
            raise ValueError(f"no ordered table at {self.options['path']}: give a schema")
        with fs.open_input_file(files[0]) as f:
            return from_arrow_schema(pq.ParquetFile(f).schema_arrow)

    def streamReader(self, schema: StructType) -> OrderedReader:  # noqa: N802
        return OrderedReader(dict(self.options), schema)


def planned(checkpoint: str, path: str) -> int:
    """How many files of the ordered table at ``path`` the query with this checkpoint has planned."""
    fs, base = pafs.FileSystem.from_uri(checkpoint)
    logs = fs.get_file_info(pafs.FileSelector(f"{base}/offsets", allow_not_found=True))
    logs = sorted((f for f in logs if f.base_name.isdigit()), key=lambda f: int(f.base_name))
    for log in reversed(logs):
        with fs.open_input_file(log.path) as f:
            for line in f.read().decode().splitlines():
                said = json.loads(line) if line.startswith("{") else {}
                if said.get("path") == path:
                    return said["files"]
    return 0


def read_ordered(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int, checkpoint: str | None = None) -> DataFrame:
    """The ordered table at ``path`` as a streaming DataFrame, for a query that keeps its ``checkpoint`` there."""
    ship(spark)
    spark.dataSource.register(OrderedTable)
    source = spark.readStream.format("ordered_table").schema(schema).option("path", path).option("files_per_batch", str(files_per_batch))
    return (source.option("start", str(planned(checkpoint, path))) if checkpoint else source).load()
