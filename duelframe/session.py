"""Session settings that the library relies on, its code on the executors, and where lineage is cut."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: dict[str, str] = {}


def session(app: str = "duelframe", **settings: str) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; settings override, with _ for dots."""
    builder = SparkSession.builder.appName(app)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.cleaner.referenceTracking.cleanCheckpoints": "true"}
    for k, v in (fixed | {k.replace("_", "."): v for k, v in settings.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application; what runs in Python there needs it."""
    sc = spark.sparkContext
    if _shipped.get("app") == sc.applicationId:
        return
    top = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="duelframe-"), "duelframe.zip")  # on the driver, which serves it
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(path)
    _shipped["app"] = sc.applicationId


def checkpoints(spark: SparkSession) -> str:
    """The folder that checkpoints go to: the one named in spark.checkpoint.dir, which all executors share.

    Where it is unset a temporary one will do on a single machine; on a cluster that raises.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", "")
        if not named and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="duelframe-"))
    return sc._jsc.sc().getCheckpointDir().get()


#: Folders of checkpoints and stored tables that are still there.
_made: dict[str, None] = {}


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the checkpoint folder: later plans begin there. drop() or scratch() delete it."""
    checkpoints(df.sparkSession)
    out = df.checkpoint(eager=True)
    if (file := out._jdf.queryExecution().analyzed().rdd().getCheckpointFile()).isDefined():
        _made[file.get()] = None
    return out


def stored(df: DataFrame, *by: str) -> DataFrame:
    """df as a Parquet table in the checkpoint folder, in folders by columns: narrower than cut(), for what is large. drop() or scratch() delete it."""
    spark = df.sparkSession
    path = f"{checkpoints(spark)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    made(path)
    spark._jvm.System.gc()  # shuffles that nothing refers to any more are deleted then
    return spark.read.schema(df.schema).parquet(path)


def made(path: str) -> None:
    """Have a stored table deleted by drop() and scratch(), too."""
    _made[path] = None


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _made.pop(path, None)


def drop(*frames: DataFrame) -> None:
    """Delete what cut() stored and the stored tables that these frames read; nothing may read them afterwards.

    Spark itself deletes checkpoints only if spark.cleaner.referenceTracking.cleanCheckpoints
    is set, and then only when the driver happens to collect garbage.
    """
    for df in frames:
        leaves = df._jdf.queryExecution().analyzed().collectLeaves()
        files = [f.rpartition("/")[0] for f in df.inputFiles()]
        for i in range(leaves.size()):
            leaf = leaves.apply(i)
            if leaf.nodeName() == "LogicalRDD" and (file := leaf.rdd().getCheckpointFile()).isDefined():
                files.append(file.get())
        for path in {_known(f) for f in files} - {None}:
            delete(df.sparkSession, path)


def _known(path: str) -> str | None:
    """The registered name of a folder, whose scheme may be written in several ways."""
    bare = lambda p: re.sub(r"^\w+:/*", "/", p)
    return next((m for m in _made if bare(m) == bare(path)), None)


@contextmanager
def scratch(spark: SparkSession, keep: int = 0) -> Iterator[None]:
    """What cut() and stored tables leave behind inside is deleted at the end, but for the keep last; other results have to be stored or collected by then."""
    before = set(_made)
    try:
        yield
    finally:
        left = [p for p in _made if p not in before]
        for path in left[: len(left) - keep]:
            delete(spark, path)
