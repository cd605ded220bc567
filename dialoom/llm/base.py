"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any
from urllib.parse import unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.session import ensure_checkpoint_dir


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: lineage is cut, lost executors reread it."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _TABLES.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables written in this process and not removed yet.
_TABLES: list[str] = []


def tables_so_far() -> int:
    return len(_TABLES)


def remove_tables(spark: SparkSession, since: int = 0, but: tuple[DataFrame, ...] = ()) -> None:
    """Remove the tables written since then, except those that the frames kept still read."""
    read = [unquote(file) for frame in but for file in frame.inputFiles()]
    for path in _TABLES[since:]:
        if not any(f"/{path.rsplit('/', 1)[1]}/" in file for file in read):
            _TABLES.remove(path)
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores in front as make it differ from every column, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def words_of(text: Column) -> Column:
    """Runs of anything but ASCII white space; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) from md5 of the parts joined by ':', the same in any SQL engine."""
    joined = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def per_row(df: DataFrame, columns: list[str], row: Callable[..., tuple], schema: str,
            prepare: Callable[[], Any] | None = None) -> DataFrame:
    """Apply row(state, *values) to every row, Arrow batch by Arrow batch.

    prepare() makes the state once per task (a vocabulary, an automaton).
    """
    out = _arrow_schema(schema)
    slim = df.select(*columns)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = prepare() if prepare else None
        for batch in source:
            values = [c.to_pylist() for c in batch.columns]
            rows = [row(state, *v) for v in zip(*values)]
            made = zip(*rows) if rows else ([] for _ in out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(v), f.type) for v, f in zip(made, out)], schema=out)

    return slim.mapInArrow(batches, schema)


def row_numbers() -> Iterator[int]:
    """Numbers no two rows of one job share: the partition above, a counter below."""
    number = TaskContext.get().partitionId() << 33
    while True:
        yield number
        number += 1


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
          "boolean": pa.bool_(), "binary": pa.binary()}


def _arrow_schema(schema: str) -> pa.Schema:
    def arrow(kind: str) -> pa.DataType:
        if kind.startswith("array<"):
            return pa.list_(arrow(kind[6:-1]))
        return _ARROW[kind]

    return pa.schema([(name, arrow(kind)) for name, kind in
                      (part.split() for part in schema.split(","))])
