"""Sessions for scripts and tests, and making the package importable on executors."""

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_shipped: set[str] = set()


def local_session(cores: str = "8", partitions: int = 8, **conf: str) -> SparkSession:
    """A session of this machine with adaptive execution; conf: further settings, dots written as __."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("modcall")
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that their workers can import it.

    Rows can hold texts of any length, so Arrow batches are bounded by bytes too unless the session says otherwise.
    """
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(8 << 20))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="modcall-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "modcall_pkg.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for top, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(top, name)
                    z.write(path, os.path.join("modcall", os.path.relpath(path, here)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
