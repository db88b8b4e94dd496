"""Session settings and the table loader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def open_session(app: str = "tessera", master: str | None = None, **settings: str) -> SparkSession:
    """A session with UTC time and adaptive execution; cluster sizes stay the submitter's."""
    b = SparkSession.builder.appName(app).config(map=SETTINGS | settings)
    spark = (b.master(master) if master else b).getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each context: they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_tessera_shipped", False):
        return
    import tempfile
    import zipfile
    from pathlib import Path

    package = Path(__file__).parent
    path = Path(tempfile.mkdtemp(prefix="tessera-")) / "tessera_package.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(path))
    context._tessera_shipped = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in ``spark.checkpoint.dir``; a temporary folder of our own only where that is unset."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or own_folder(df.sparkSession))
    return df.checkpoint()


def own_folder(spark: SparkSession) -> str:
    """A temporary folder for a local session; an error on a cluster, whose executors would not see it."""
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    import tempfile

    return tempfile.mkdtemp(prefix="tessera-")
