"""Session settings, the shared folder for cut lineage, and bounded broadcasting."""

from __future__ import annotations

import os
import re
import uuid
import weakref
import zipfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import _parse_datatype_string

#: A side is broadcast only when its measured rows and bytes stay under these.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
#: A scan is dealt to all cores only when its plan's estimate stays under this.
SPREAD_BYTES = 1 << 30
#: Shared folder used only where the session names none and runs on one machine, as in tests.
LOCAL_CHECKPOINTS = "/tmp/patchlake-checkpoints"

_shipped: "weakref.WeakSet" = weakref.WeakSet()


def local_session(app: str = "patchlake", cores: int | str = 8, memory: str = "12g", shared: str = f"file://{LOCAL_CHECKPOINTS}") -> SparkSession:
    """A session for one machine; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", shared)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package: by path on one machine, by archive elsewhere."""
    sc = spark.sparkContext
    if sc in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    known = sc.environment.get("PYTHONPATH", "")
    if str(root) not in known.split(":"):
        sc.environment["PYTHONPATH"] = f"{root}:{known}" if known else str(root)
    if not sc.master.startswith("local"):
        target = Path(os.environ.get("TMPDIR", "/tmp")) / f"patchlake-{uuid.uuid4().hex}.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in (root / "patchlake").rglob("*.py"):
                z.write(p, p.relative_to(root))
        sc.addPyFile(str(target))
    _shipped.add(sc)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where there is none, a local one on one machine; a cluster must name one."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        folder = f"file://{LOCAL_CHECKPOINTS}"
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        if jvm is None:
            return
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already
        pass


_written: dict[str, list[str]] = {}


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: later stages see a table, not a lineage.

    The table outlives lost executors. Tables of a session are removed by release(); a lazily evaluated result may still
    read them, so nothing is removed before that call or the end of the process.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/patchlake/{name}-{uuid.uuid4().hex}"
    df.write.mode("error").option("compression", "zstd").parquet(path)
    if not _written:
        import atexit

        atexit.register(release, spark)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Remove the tables that materialize() wrote in this session."""
    try:
        app = spark.sparkContext.applicationId
    except Exception:
        return
    for path in _written.pop(app, []):
        _remove(spark, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end of the block, the tables written in it: for sessions that run long, around each query and its write."""
    app = spark.sparkContext.applicationId
    before = len(_written.get(app, []))
    try:
        yield
    finally:
        mine = _written.get(app, [])[before:]
        del _written.get(app, [])[before:]
        for path in mine:
            _remove(spark, path)


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: texts and binaries by their length, nested columns by that of their JSON, others 8."""
    sizes = [F.lit(16)]
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            sizes.append(F.coalesce(F.octet_length(f.name), F.lit(0)) + 8)
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            sizes.append(F.coalesce(F.octet_length(F.to_json(F.struct(f.name))), F.lit(0)))
        else:
            sizes.append(F.lit(8))
    return sum(sizes[1:], sizes[0])


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """True when df has at most so many rows and bytes; reads no more than that many rows."""
    got = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(row_bytes(df)), F.lit(0)).alias("b")).first()
    return got["n"] <= rows and got["b"] <= size


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint where the side was measured to be small; otherwise the join stays a shuffle join."""
    return F.broadcast(df) if small(df, rows, size) else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_group(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """fold over the rows of each group, in order: rows come as tuples of the keys and the other columns of df.

    Rows are brought together by key and sorted in the JVM, and each worker walks through its groups as they come, so that
    many small groups cost no call each. A group is held whole by its worker: callers bound its size.
    """
    ship_package(df.sparkSession)
    rest = [c for c in df.columns if c not in keys]
    plain = df.select(*keys, *rest)
    from pyspark.sql.pandas.types import to_arrow_schema

    out_schema = to_arrow_schema(_parse_datatype_string(schema))
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []

        def made() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * len(out_schema)
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out_schema)], schema=out_schema)
            out.clear()
            return batch

        for rb in batches:
            for row in zip(*(c.to_pylist() for c in rb.columns)):
                if held and row[:n] != key:
                    out.extend(fold(held))
                    held = []
                key = row[:n]
                held.append(row)
            if len(out) >= 20_000:
                yield made()
        if held:
            out.extend(fold(held))
        yield made()

    return plain.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def spread(df: DataFrame) -> DataFrame:
    """A small scan of fewer parts than there are cores, dealt to as many as there are; larger scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size <= SPREAD_BYTES and df.rdd.getNumPartitions() < cores else df


def once(df: DataFrame, key: str, delivered: str) -> DataFrame:
    """Each key's first delivery, without moving the rows where few keys were delivered again.

    Keys and times alone are counted first. Keys delivered again are joined back with the time that stays: by broadcast
    where they are counted to be few, else by a shuffle join. Where a key may have been delivered twice at one time, the rest is
    dropped by key.
    """
    seen = df.select(key, delivered).groupBy(key).agg(F.count("*").alias("_n"), F.min(delivered).alias("_keep"), F.max(delivered).alias("_last"))
    again = seen.where("_n > 1")
    many = again.agg(F.count("*").alias("n"), F.coalesce(F.max((F.col("_n") > 2) | F.coalesce(F.col("_keep") == F.col("_last"), F.lit(True))), F.lit(False)).alias("tied")).first()
    df = spread(df)
    if not many["n"]:
        return df
    held = again.select(F.col(key).alias("_key"), "_keep")
    out = df.join(F.broadcast(held) if many["n"] <= BROADCAST_ROWS else held, F.col(key).eqNullSafe(F.col("_key")), "left")
    # a key that was not delivered again meets no row and stays
    out = out.where(F.col("_keep").isNull() | (F.col(delivered) == F.col("_keep"))).drop("_key", "_keep")
    return out.dropDuplicates([key]) if many["tied"] else out
