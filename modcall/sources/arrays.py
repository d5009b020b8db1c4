"""Training data as numpy array files by split: a Spark sink with a commit step, and the source that reads them back.

Every task writes, for each split, files of at most ROWS rows: data (rows x features), labels and weights. They get
hidden names until all tasks are done; then the driver moves them and writes a manifest of files and their rows, which is
what readers go by. A failed task or job leaves no file that a reader would see.
"""

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .bam import _open

SCHEMA = "split string, label double, weight double, features array<double>"
#: Rows of a file; a task holds so many for each split.
ROWS = 4096
MANIFEST = "manifest.json"
_ARROW = pa.schema([("split", pa.string()), ("label", pa.float64()), ("weight", pa.float64()), ("features", pa.list_(pa.float64()))])


@dataclass
class _Done(WriterCommitMessage):
    #: (temporary stem, split, final stem, rows) of each group of three files.
    files: list


def _save(fs, path: str, array) -> None:
    held = io.BytesIO()
    np.save(held, array, allow_pickle=False)
    with fs.open_output_stream(path) as out:
        out.write(held.getbuffer())


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.kind, self.rows = options["path"], options.get("dtype", "float32"), int(options.get("rows", ROWS))

    def write(self, iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        fs, root = _open(self.path)
        fs.create_dir(root)
        task, done, held, numbers = TaskContext.get().partitionId(), [], {}, {}

        def flush(split):
            labels, weights, features = zip(*held.pop(split), strict=True)
            if len({len(f) for f in features}) > 1:
                raise ValueError("rows have different numbers of features")
            stem = f"{root}/.{uuid.uuid4().hex}"
            for name, array in (("data", np.array(features, self.kind)), ("labels", np.array(labels, np.float64)), ("weights", np.array(weights, np.float64))):
                _save(fs, f"{stem}-{name}.npy", array)
            n = numbers[split] = numbers.get(split, -1) + 1
            done.append((stem, split, f"part-{task:05d}-{n:05d}", len(labels)))

        for row in iterator:
            held.setdefault(row["split"], []).append((row["label"], row["weight"], row["features"]))
            if len(held[row["split"]]) == self.rows:
                flush(row["split"])
        for split in list(held):
            flush(split)
        return _Done(done)

    def commit(self, messages) -> None:
        fs, root = _open(self.path)
        fs.create_dir(root)
        listed = []
        for temporary, split, final, rows in (f for m in messages if m is not None for f in m.files):
            fs.create_dir(f"{root}/{split}")
            for name in ("data", "labels", "weights"):
                fs.move(f"{temporary}-{name}.npy", f"{root}/{split}/{final}-{name}.npy")
            listed.append({"split": split, "file": f"{split}/{final}", "rows": rows})
        with fs.open_output_stream(f"{root}/.{MANIFEST}") as out:
            out.write(json.dumps(sorted(listed, key=lambda x: x["file"])).encode())
        fs.move(f"{root}/.{MANIFEST}", f"{root}/{MANIFEST}")

    def abort(self, messages) -> None:
        fs, _ = _open(self.path)
        for temporary, *_ in (f for m in messages if m is not None for f in m.files):
            for name in ("data", "labels", "weights"):
                fs.delete_file(f"{temporary}-{name}.npy")


@dataclass
class _File(InputPartition):
    stem: str
    split: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self):
        return [_File(f"{self.path}/{x['file']}", x["split"]) for x in manifest(self.path)] or [_File("", "")]

    def read(self, part: _File) -> Iterator[pa.RecordBatch]:
        if not part.stem:
            return
        loaded = []
        for name in ("data", "labels", "weights"):
            fs, path = _open(f"{part.stem}-{name}.npy")
            with fs.open_input_stream(path) as stream:
                loaded.append(np.load(io.BytesIO(stream.read()), allow_pickle=False))
        data, labels, weights = loaded
        flat = np.ascontiguousarray(data, np.float64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array([part.split] * len(flat)), pa.array(labels), pa.array(weights), lists], schema=_ARROW)


def manifest(path: str) -> list[dict]:
    """What a finished job has written: split, file (without -data.npy, -labels.npy, -weights.npy) and rows."""
    fs, root = _open(path)
    with fs.open_input_stream(f"{root}/{MANIFEST}") as stream:
        return json.loads(stream.read())


class ArraySource(DataSource):
    """Format "modcall_arrays". Options: path; for writing, dtype of the features (float32) and rows of a file."""

    @classmethod
    def name(cls) -> str:
        return "modcall_arrays"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def write_arrays(rows: DataFrame, path: str, shape: str = "float32", limit: int = ROWS) -> None:
    """Rows (split, label, features, and weight, 1 by default) as arrays of `shape`, a file for each task, split and
    `limit` rows. Features may be nested; they are laid out flat. A null split, label or feature list is an error."""
    rows.sparkSession.dataSource.register(ArraySource)
    features = F.col("features")
    kind = rows.schema["features"].dataType
    while kind.elementType.typeName() == "array":
        features, kind = F.flatten(features), kind.elementType
    weight = F.col("weight").cast("double") if "weight" in rows.columns else F.lit(1.0)
    whole = F.when(F.col("split").isNotNull() & F.col("label").isNotNull() & F.col("features").isNotNull(), F.col("split")).otherwise(F.raise_error(F.lit("a row without split, label or features")))
    made = rows.select(whole.cast("string").alias("split"), F.col("label").cast("double").alias("label"), weight.alias("weight"), features.cast("array<double>").alias("features"))
    made.write.format("modcall_arrays").mode("append").option("dtype", shape).option("rows", limit).save(path)


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """The rows of what write_arrays has written: SCHEMA."""
    spark.dataSource.register(ArraySource)
    return spark.read.format("modcall_arrays").load(path)
