"""Session helpers: shared scratch tables and a local session for tests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_PREFIX = "quorumfit-"
_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors see, as named by ``spark.checkpoint.dir``.

    A local session without the setting gets a temporary folder of its own; a
    cluster session must name one, since a machine-local folder would not be
    readable by the other executors.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix=_PREFIX)
    return _local_dirs[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/{_PREFIX}{label}-{uuid.uuid4().hex}"


def hadoop_path(spark: SparkSession, path: str):
    """The path and its file system, as Hadoop objects."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table made through :func:`fresh_path`; refuses others."""
    if not path.startswith(f"{shared_dir(spark)}/{_PREFIX}"):
        raise ValueError(f"not a scratch path: {path}")
    target, files = hadoop_path(spark, path)
    files.delete(target, True)


def local_session(cpus: int | str = "*", name: str = "quorumfit", **conf: str) -> SparkSession:
    """Local session with the settings the tests and the benchmark use."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
