"""A session with the settings that results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that fix results (time zone) or let Spark adapt plans at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app: str = "statloom", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for k, v in {**SETTINGS, **settings}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per context, so that their Python workers can import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_statloom_shipped", False):
        return
    import tempfile
    import zipfile
    from pathlib import Path

    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="statloom-")) / "statloom_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(str(path))
    sc._statloom_shipped = True
