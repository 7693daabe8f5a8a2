"""Where intermediate tables go."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_root(spark: SparkSession) -> str:
    """This application's own folder in the one that the cluster shares (spark.checkpoint.dir). Where none is named, a
    temporary one of this machine is set, but only if all of Spark runs in this one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        root = "file://" + tempfile.mkdtemp(prefix="linesieve-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/linesieve/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Deletes what this application left there. Results that haven't been read or written yet are lost."""
    remove(spark, scratch_root(spark))
