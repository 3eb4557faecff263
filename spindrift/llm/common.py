"""What the training-data operators share: table access and lineage cuts in the cluster's shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, one machine runs everything (master local) and gets a
    folder of its own; on a cluster it is an error, since no folder of one machine is read by the others."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.conf.set("spark.checkpoint.dir", at := tempfile.mkdtemp(prefix="spindrift-"))
    return at


def shared(df: DataFrame) -> DataFrame:
    """df written once as Parquet into the shared folder and read back: later readers start from the files, so a lost
    executor costs no recomputation of what came before. The folder is removed by drop_shared(), at the latest when the
    driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/spindrift-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _OWN:
        atexit.register(drop_shared)
    _OWN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_shared() -> None:
    """Removes what shared() has written so far; for long sessions, once the results that read it are written."""
    for spark, path in _OWN:
        try:
            jvm, at = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
        except Exception:  # the session may have ended already
            pass
    _OWN.clear()


#: Bytes of a batch that goes to Python and back, where the session leaves Spark's own limit, 64 MB, as it is: both sides hold
#: a batch several times over, and texts may be long.
BATCH, _LIMIT, _DEFAULT = "8m", "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def by_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow(run, schema) in smaller batches; what Arrow has taken goes back to the system with the task."""
    spark = df.sparkSession
    if spark.conf.get(_LIMIT, _DEFAULT) == _DEFAULT:
        spark.conf.set(_LIMIT, BATCH)

    def lean(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(lean, schema)


#: A key with more than one in so many of all rows is hot; there are fewer of them than this.
HOT = 1_000


def hot_join(rows: DataFrame, named: DataFrame, keys: str | list[str], n: str, total: int) -> DataFrame:
    """rows joined with named (the keys, once each, and any columns; n: its rows in `rows`, of which there are `total`).

    Keys with more than about one in HOT of the rows, of which there are fewer than twice as many as HOT, are broadcast, so that
    no task gets all rows of one key; the others are joined by a shuffle. The limit is a power of two over HOT, so that
    the steps of a loop have the same code."""
    many = (1 << max(0, total.bit_length() - 1)) / HOT
    keys = [keys] if isinstance(keys, str) else keys
    columns = [c for c in named.columns if c not in (*keys, n)]
    packed = named.select(*keys, n, F.struct(F.lit(True).alias("met"), *columns).alias("named"))
    hot = packed.where(F.col(n) > many).select(*keys, F.col("named").alias("hot"))
    # One row that stands for no key, so that the plan is the same without hot keys; what meets it is as if it met nothing.
    none = [F.lit(None if f.name == "hot" else 0).cast(f.dataType).alias(f.name) for f in hot.schema]
    hot = hot.unionByName(rows.sparkSession.range(1).select(*none))
    met = rows.join(F.broadcast(hot), keys, "left")
    cold = met.where("hot IS NULL").drop("hot").join(packed.where(F.col(n) <= many).drop(n), keys)
    both = met.where("hot IS NOT NULL").withColumnRenamed("hot", "named").unionByName(cold)
    return both.select(*rows.columns, *[F.col("named").getField(c).alias(c) for c in columns])


#: Rows of a side that is broadcast: a bound on its size, with a shuffle beyond it.
SMALL = 500_000


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, a written table of a few columns of fixed width, broadcast if it has at most SMALL rows."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= SMALL else df
