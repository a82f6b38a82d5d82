"""Written tables that cut lineage, kept in the folder all executors share."""

from __future__ import annotations

import atexit
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: A table that took longer may leave shuffle files that are worth a wait.
SLOW_S = 5


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a temporary folder only where it is unset (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="docloom-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


class Scratch:
    """Parquet tables of one operator call.

    `keep` writes a frame once and gives it back as a scan, so that a lost executor costs the
    re-read of a file and not a recomputation. `drop` deletes tables that nothing reads any
    more; the rest go when the application ends, because the returned frame may still read them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/docloom/{name}-{uuid.uuid4().hex}"
        self.tables: list[str] = []
        self.took = 0.0
        atexit.register(self.close)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def keep(self, df: DataFrame, table: str) -> DataFrame:
        began = time.time()
        df.write.mode("overwrite").parquet(self.path(table))
        self.took = max(self.took, time.time() - began)
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def keep_bucketed(self, df: DataFrame, table: str, buckets: int, by: str | list[str], order: list[str]) -> DataFrame:
        """As keep, dealt by the hash of a column or several, so that joins and groups on them need no exchange."""
        name = f"{table}_{uuid.uuid4().hex}"
        began = time.time()
        dealt = df.write.option("compression", "zstd").bucketBy(buckets, by)
        (dealt.sortBy(*order) if order else dealt).option("path", self.path(table)).saveAsTable(name)
        self.took = max(self.took, time.time() - began)
        self.tables.append(name)
        return self.spark.table(name)

    def free(self) -> None:
        """Shuffle files of tables that are written already are freed when the driver collects its
        garbage, which it may put off until disks are full; this asks for it. What still watches a query
        that has just ended keeps its files past the first request, so that large tables get a second."""
        self.spark._jvm.java.lang.System.gc()
        if self.took > SLOW_S:
            time.sleep(0.5)
            self.spark._jvm.java.lang.System.gc()
        self.took = 0.0

    def drop(self, *tables: str) -> None:
        for table in tables:
            self._delete(self.path(table))

    def close(self) -> None:
        try:
            for name in self.tables:  # a metastore may outlive the session
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self._delete(self.root)
        except Exception:  # noqa: BLE001  the session has ended before the interpreter
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
