"""One place for the session and the settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings every part of the engine assumes; sizing of partitions stays with the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, app: str = "tablewright", **conf: str) -> SparkSession:
    """The running session, or a new one with SETTINGS and `conf` (dots written as __)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local
    session (tests) gets a temporary one; a cluster without it is an error."""
    import tempfile

    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="tablewright-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def parallelism(spark: SparkSession) -> int:
    """Tasks that the session runs at once, or has partitions for in a shuffle, whichever are more."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    import uuid

    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def put(spark: SparkSession, path: str, content: bytes, forget: bool = False) -> str:
    """A file with this content, through Spark's file systems; with `forget` it goes when the
    application ends."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(target)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    if forget:
        fs.deleteOnExit(target)
    return path


def reachable(spark: SparkSession) -> SparkSession:
    """Lets Python workers on this machine import the package from where it is, whatever folder the
    application was started in. Elsewhere it has to be installed or sent along."""
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)
    return spark
