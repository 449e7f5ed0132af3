"""Tables and files that every executor can reach.

On a cluster the session names the shared folder in ``spark.checkpoint.dir``. Only where that is
unset, as in tests on one machine, is a folder of the driver's own used.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The shared folder of this session. Without one, a cluster's executors would each write to a disk of their own: that raises."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        app = spark.sparkContext.applicationId
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="tracklattice-")
        root = _own[app]
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path below this application's part of the shared folder that no one has used yet."""
    return f"{shared_root(spark)}/tracklattice/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    _made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_table = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_shared_table", None)
        if path:
            delete(df.sparkSession, path)
            if path in _made:
                _made.remove(path)


def made() -> list[str]:
    """Paths of the tables that this process has materialized and not discarded, in their order."""
    return list(_made)


def sweep(spark: SparkSession, paths: list[str]) -> None:
    """Delete these paths of ``made``."""
    for path in paths:
        delete(spark, path)
        _made.remove(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder, if it is there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def forget(spark: SparkSession) -> None:
    """Delete what ``materialize`` and ``shared_path`` of this application left in the shared folder."""
    delete(spark, f"{shared_root(spark)}/tracklattice/{spark.sparkContext.applicationId}")


def planned_bytes(df: DataFrame) -> int:
    """The planner's estimate of the table's bytes, 0 where it has none. Nothing is read."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 60 else 0


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
