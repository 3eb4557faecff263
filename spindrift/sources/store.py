"""Tables that are written once and read by others: in the folder that a cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[tuple[SparkSession, str]] = []
_HELD: dict[tuple, object] = {}
#: Rows of a side that is broadcast; beyond that it meets the other by a shuffle.
SMALL = 500_000
T = TypeVar("T")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, one machine runs everything (master local) and gets a
    folder of its own; on a cluster it is an error, since no folder of one machine is read by the others."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.conf.set("spark.checkpoint.dir", at := tempfile.mkdtemp(prefix="spindrift-"))
    return at


def new_dir(spark: SparkSession, name: str) -> str:
    """A folder for `name` in the shared folder, which drop() removes, at the latest when the driver's Python ends."""
    at = f"{shared_dir(spark)}/spindrift-{name}-{uuid.uuid4().hex}"
    if not _OWN:
        atexit.register(drop)
    _OWN.append((spark, at))
    return at


def kept(df: DataFrame) -> DataFrame:
    """df written as Parquet and read back, so that those who read it more than once don't compute it again."""
    at = new_dir(df.sparkSession, "table")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def held(spark: SparkSession, name: str, of: str, make: Callable[[], T]) -> T:
    """make(), once for each application, name and what it is made of."""
    key = (spark.sparkContext.applicationId, name, of)
    if key not in _HELD:
        _HELD[key] = make()
    return _HELD[key]  # type: ignore[return-value]


def small(df: DataFrame) -> DataFrame:
    """df broadcast if it has at most SMALL rows; it is counted, so it should be cheap to read."""
    return F.broadcast(df) if df.count() <= SMALL else df


def drop() -> None:
    """Removes what has been written so far."""
    for spark, path in _OWN:
        try:
            jvm, at = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
        except Exception:  # the session may have ended already
            pass
    _OWN.clear()
    _HELD.clear()
