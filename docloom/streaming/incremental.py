"""Incremental processing: files that arrive are read once, each content is kept once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import content_hash
from docloom.scratch import shared_dir


def new_contents(stream: DataFrame) -> DataFrame:
    """doc_id and content_hash of the first row of each content. The state holds one key for each content."""
    return stream.select("doc_id", content_hash("text").alias("content_hash")).dropDuplicates(["content_hash"])


def stream_documents(spark: SparkSession, path: str) -> DataFrame:
    """Runs all that is there through the stream and returns the hashes it has kept."""
    schema = spark.read.parquet(path).schema
    root = f"{shared_dir(spark)}/docloom/stream-{uuid.uuid4().hex}"
    source = spark.readStream.schema(schema).format("parquet").load(path if not path.endswith(".parquet") or _is_dir(spark, path) else path + "*")
    run = new_contents(source).writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("doc_id long, content_hash string").parquet(f"{root}/rows").select("content_hash")


def _is_dir(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory()
