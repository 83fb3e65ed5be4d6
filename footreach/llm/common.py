"""What the corpus operators share: tables, Arrow slices, kept and written intermediates, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a task holds as Python objects at once.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; one of our own only on a single machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/footreach-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame) -> DataFrame:
    """df, computed once, from a table in the shared folder: this cuts its lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_core(df: DataFrame) -> DataFrame:
    """df, which comes from a shuffle, in no more partitions than there are cores, and so in as many files."""
    return df.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism))


def discard(df: DataFrame) -> None:
    """Removes the files of a table that materialize() has returned, once nothing reads it any more.

    Shuffles and broadcasts of the plans behind it stay on the executors' disks and in the driver until the driver's garbage
    is collected, which in a loop of small jobs may be late: it is asked for."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    spark._jvm.System.gc()


def held(df: DataFrame) -> DataFrame:
    """df, computed once and kept on the executors' disks for those who read it again. What is lost with an executor is
    worked out anew from its lineage, which is short where this is used: rounds and chains of joins go to materialize()."""
    return df.persist(StorageLevel.DISK_ONLY)


def scratch(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def cuts(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of a string column that hold about `limit` bytes, and one row at least."""
    ends = np.cumsum(np.nan_to_num(pc.binary_length(column).to_numpy(zero_copy_only=False).astype("float64")))
    start = 0
    while start < len(column):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield start, stop - start
        start = stop


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in order, cut so that a slice holds about `limit` bytes of text, and one row at least."""
    for batch in batches:
        for start, size in cuts(batch.column(batch.schema.get_field_index(text)), limit):
            yield batch.slice(start, size)


def text_function(make: Callable[[], Callable[..., pa.Array]], returns: str) -> Callable[..., Column]:
    """A function of columns, the first of which is a text. make() is called in each task, and what it returns gets slices
    of the columns as lists. Other columns of a row stay in the JVM: only these go to Python and only the result comes back."""

    def run(batches: Iterator) -> Iterator[pa.Array]:
        each = make()
        for batch in batches:
            columns = batch if isinstance(batch, tuple) else (batch,)
            parts = [each(*(c.slice(start, size).to_pylist() for c in columns)) for start, size in cuts(columns[0], SLICE_BYTES)]
            yield pa.concat_arrays(parts or [each(*([] for _ in columns))])

    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return run(batches)

    def two(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        return run(batches)

    # a deterministic function would be called again for each filter and field that reads its result
    return lambda *columns: F.arrow_udf(one if len(columns) == 1 else two, returns).asNondeterministic()(*columns)


def with_columns(batch: pa.RecordBatch, schema: pa.Schema, made: dict[str, object]) -> pa.RecordBatch:
    """A batch of that schema: columns in `made` from there, the others from the batch."""
    arrays = [pa.array(made[f.name], type=f.type) if f.name in made else batch.column(batch.schema.get_field_index(f.name)).cast(f.type) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def extended(df: DataFrame, new: dict[str, T.DataType]) -> T.StructType:
    """df's schema with the new fields at the end; a column of df that has the name of a new one gives way to it."""
    kept = [f for f in df.schema.fields if f.name not in new]
    return T.StructType([*kept, *(T.StructField(k, v) for k, v in new.items())])


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads every input bit over the output."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


class LocalComponents:
    """Union-find over positions 0..n-1 whose links come in arrays."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return up
            self.parent = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            roots = self.roots()
            a, b = roots[a], roots[b]
            open_ = a != b
            a, b = a[open_], b[open_]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def components_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of edges (u, v) that one task has room for."""
    parts = [tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v")) for batch in batches]
    if parts:
        u, v = (np.concatenate(c) for c in zip(*parts, strict=True))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        local = LocalComponents(len(nodes))
        local.link(at[: len(u)], at[len(u) :])
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[local.roots()])], names=["node", "root"])


def connected_components(edges: DataFrame, rounds: int = 60, task_rows: int = 500_000) -> DataFrame:
    """(node, root) for every end of the edges (u, v), longs; root is the smallest node that can be reached.

    At most `task_rows` edges (16 bytes each, counted first) are closed in one task. More go through rounds: alternating large-star and small-star steps over the edge list. Each step is a minimum by node, which is
    partly taken before the shuffle, and a join that Spark may split where a node has many edges. A round is
    written to the shared folder, in files that follow the number of edges; the number of rounds grows with the
    logarithm of the longest path.
    """

    marks = F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("hash")
    e = first = held(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = tuple(e.agg(*marks).first())
    if before[0] <= task_rows:
        found = materialize(e.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).coalesce(1).mapInArrow(components_of, "node long, root long"))
        first.unpersist()
        return found
    for _ in range(rounds):
        if not before[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        seen = Observation()
        new = materialize(new.coalesce(1 + before[0] // max(1, task_rows)).observe(seen, *marks))
        if e is first:
            first.unpersist()
        else:
            discard(e)
        e, now = new, (seen.get["n"], seen.get["hash"])
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
