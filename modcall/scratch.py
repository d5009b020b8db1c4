"""The shared folder of a run: stream state, chunks and intermediate tables."""

import tempfile
import uuid
from contextlib import contextmanager


_own: dict = {}


def shared_folder(spark) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset a folder of this machine is made, which only a
    local master can do with."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        # the setting cannot be changed once a session runs, so the folder is kept here
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="modcall-")
        root = _own[app]
    return f"{root.rstrip('/')}/modcall/{uuid.uuid4().hex}"


def materialize(df):
    """df written below the shared folder and read back: what follows reads it more than once."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def setting(spark, name: str, value: str):
    """A setting of the session for what runs inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def children(spark, path: str) -> list[str]:
    """Names of what a folder holds, sorted; none if it is absent. Any file system that Spark can write will do."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(folder)) if fs.exists(folder) else []


def remove(spark, path: str) -> None:
    """Delete a folder with all that it holds."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def written(spark, path: str, name: str) -> list[int]:
    """The numbers n of the folders `name`=n below path whose writer has committed."""
    numbers = [int(x.partition("=")[2]) for x in children(spark, path) if x.startswith(f"{name}=")]
    return sorted(n for n in numbers if "_SUCCESS" in children(spark, f"{path}/{name}={n}"))
