"""Tables in files: JSON lines, JSON arrays, whole texts, Parquet by strategy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import url_hash

MANIFEST = T.StructType([T.StructField(c, T.StringType()) for c in ("url", "source_url", "brand", "category", "status", "content_hash", "title", "page_type", "error")])


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def stamps(spark: SparkSession, table: DataFrame) -> list[tuple[str, int, int]]:
    """Path, length and time of change of each file of a table, to tell whether it is still the same."""
    out = []
    for name in sorted(table.inputFiles()):
        target = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target)
        out.append((name, status.getLen(), status.getModificationTime()))
    return out


def json_lines(spark: SparkSession, path: str, schema: T.StructType = MANIFEST) -> DataFrame:
    """Rows of a JSON-lines table; none if the path is missing. Blank lines are passed over."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path).dropna("all")


def append_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def json_items(spark: SparkSession, path: str, schema: T.StructType, list_only: bool = False) -> DataFrame:
    """Items of a file that holds an array or, unless list_only, an object with `items`; another kind of
    file is an error."""
    text = spark.read.text(path, wholetext=True).select("value")
    whole = T.ArrayType(schema)
    inner = T.StructType([T.StructField("items", whole)])
    held = F.lit(None).cast(whole) if list_only else F.from_json("value", inner)["items"]
    items = F.coalesce(F.when(F.ltrim("value").startswith("["), F.from_json("value", whole)), held, F.raise_error(F.lit("no array of items")).cast(whole))
    return text.select(F.inline(items))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """brand, category, name, text of files under brand/category/."""
    parts = F.split(F.col("_metadata.file_path"), "/")
    rows = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return rows.select(F.element_at(parts, -3).alias("brand"), F.element_at(parts, -2).alias("category"), F.element_at(parts, -1).alias("name"), F.col("value").alias("text"))


def repaired_path(path: Column, root: str, brand: Column, category: Column) -> Column:
    """Where a stored path's file stands under another root."""
    return F.concat_ws("/", F.lit(root), brand, category, F.element_at(F.split(path, "/"), -1))


def found_paths(rows: DataFrame, listing: DataFrame, root: str, path: str = "path") -> DataFrame:
    """rows whose file is in the listing (path), with its path: the stored one, else where it stands
    under root; rows of files that are nowhere go."""
    moved = repaired_path(F.col(path), root, F.col("brand"), F.col("category"))
    there = listing.select(F.col("path").alias("there")).distinct()
    tried = rows.select("*", F.posexplode(F.array_distinct(F.array(F.col(path), moved))).alias("turn", "there")).join(there, "there", "left_semi")
    keys = [c for c in rows.columns if c != path]
    return tried.groupBy(*(F.col(f"`{c}`") for c in keys), F.col(path).alias("stored")).agg(F.min(F.struct("turn", "there")).alias("best")).select(*(F.col(f"`{c}`") for c in keys), F.col("best.there").alias(path))


def write_chunks(chunks: DataFrame, path: str) -> None:
    """One folder for each strategy; those in chunks are replaced, others stay."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("strategy").parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def replace(spark: SparkSession, new: str, path: str) -> None:
    """Gives a written folder the name of another, which is kept beside it until then."""
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    old = path.rstrip("/") + "_old"
    fs.delete(at(old), True)
    if fs.exists(at(path)) and not fs.rename(at(path), at(old)):
        raise OSError(f"{path} cannot be renamed")
    if not fs.rename(at(new), at(path)):
        raise OSError(f"{new} cannot be renamed")
    fs.delete(at(old), True)


def read_chunks(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The chunk table; no rows if there is none yet."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def without_ids(rows: DataFrame, ids: DataFrame, id_column: str = "id") -> DataFrame:
    """The vector table without the ids given."""
    return rows.join(ids.select(id_column), id_column, "left_anti")


def write_blobs(rows: DataFrame, path: str) -> None:
    """Raw pages (url, content, is_pdf, brand, category) under brand and category, named by the address."""
    rows.withColumn("name", F.concat(url_hash("url"), F.when(F.col("is_pdf"), ".pdf").otherwise(".html"))).write.mode("append").partitionBy("brand", "category").parquet(path)


def vector_store(rows: DataFrame, dimension: int, id_column: str = "id", embedding: str = "embedding") -> DataFrame:
    """rows, failing on a vector of another dimension or a repeated id."""
    checked = rows.withColumn(embedding, F.when(F.size(embedding) == dimension, F.col(embedding)).otherwise(F.raise_error(F.lit(f"dimension is not {dimension}"))))
    again = rows.groupBy(id_column).agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if again:
        raise ValueError("ids repeat")
    return checked
