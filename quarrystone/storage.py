"""Tables that cut a job's lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names. Where it is unset (local tests), one of this process."""
    base = spark.sparkContext.getConf().get(SETTING) or spark.conf.get(SETTING, None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"{SETTING} must name a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="quarrystone-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        base = _own[0]
    return base.rstrip("/")


class Work:
    """A job's own folder of Parquet tables: written once, read by any executor, so a lost one costs no recomputation."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark, self.path = spark, f"{shared_folder(spark)}/{job}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.get(name)

    def get(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Frees the named tables; without names, all."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for x in [f"{self.path}/{n}" for n in names] or [self.path]:
            path = jvm.org.apache.hadoop.fs.Path(x)
            path.getFileSystem(conf).delete(path, True)
