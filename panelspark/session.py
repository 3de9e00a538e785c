"""Session defaults and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Semantics the operators rely on; everything about size is left to the cluster.
CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    # copies of ended steps are deleted with the frames that read them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}
UNKNOWN_SIZE = 2**63 - 1  # the estimate of rows that Spark knows nothing of


def build_session(app: str = "panelspark", master: str | None = None,
                  **conf: str) -> SparkSession:
    """A session with the settings above; ``conf`` wins over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df`` in the folder the cluster names.

    The copy is on shared storage, so a lost executor costs a re-read and never
    a replay of the rounds before. Only a local session may fall back to a
    temporary folder.

    Spark hands a plan's estimated size on to its checkpoint, and an estimate of a join
    is the product of its sides. In rounds that read their own checkpoints the number of
    its digits doubles until the driver does nothing but multiply. Where it passes what
    stands for an unknown size, the copy is made of the rows alone and takes that.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="panelspark-")
        sc.setCheckpointDir(folder)
    if int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > UNKNOWN_SIZE:
        df = DataFrame(spark._jsparkSession.createDataFrame(
            df._jdf.toJavaRDD(), df._jdf.schema()), spark)
    return df.checkpoint(eager=True)


def stage_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder that the cluster names.

    All of an application's folders lie in one that bears its id; what is left of them
    may go once the application has ended.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        # one folder for the application, checkpoints and stages alike
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="panelspark-"))
        root = sc.getCheckpointDir()
    app = spark.sparkContext.applicationId
    return f"{root.rstrip('/')}/panelspark-{app}/{name}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Workers unpickle functions by module name, so they need the package whatever
    folder the driver was started from.
    """
    sc = spark.sparkContext
    if getattr(sc, "_panelspark_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="panelspark-code-"), "panelspark.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._panelspark_shipped = True
