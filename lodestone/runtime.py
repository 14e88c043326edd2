"""Sessions, table loading and lineage cuts that survive the loss of executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import lodestone
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Functions that run in Python workers travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(lodestone)

_OWN_DIRS: dict[str, str] = {}
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def session(app: str = "lodestone", master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings the engine assumes; ``conf`` wins over them."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.master(master).appName(app).config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, a session of one machine (tests) gets a
    folder of its own; on a cluster it is an error, as executors would write to their own disks."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.applicationId not in _OWN_DIRS:
        own = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, own, True)
        _OWN_DIRS[sc.applicationId] = f"file://{own}"
    return _OWN_DIRS[sc.applicationId]


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage of ``df`` in a written table of the shared folder.

    A written table is smaller than ``checkpoint()``'s serialised rows, outlives every executor,
    and gives the optimizer real sizes for the joins after it. All tables of a session lie under its application's
    name, so that they can be removed together when its results are no longer needed. The shuffles it was made by are
    removed with the write, not when the driver happens to collect its garbage: nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._written = path
    return table


def drop(*tables: DataFrame) -> None:
    """Removes tables ``cut`` has written, once nothing made of them is still to be computed."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._written)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
