"""Folders for intermediate tables, below the one that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Temporary folders of local sessions that name none (tests on one machine), by application.
_OWN: dict[str, str] = {}
#: What each application has put below its folder.
_MADE: dict[str, list[str]] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``.

    A local session without that setting gets a temporary folder, which goes when Python ends; on a cluster the
    setting is needed, as executors do not see one another's disks.
    """
    application = spark.sparkContext.applicationId
    top = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get(application)
    if not top:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        made = tempfile.mkdtemp(prefix="zonarium-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        top = _OWN[application] = f"file://{made}"
    path = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(application, []).append(path)
    return path


def materialised(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again: cuts the lineage and survives lost executors."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Deletes the intermediate tables of this application, once no result that reads them is needed; returns how many there were."""
    made = _MADE.pop(spark.sparkContext.applicationId, [])
    for path in made:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return len(made)
