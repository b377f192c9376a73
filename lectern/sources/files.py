"""Book files of any supported kind as rows: ``binaryFile`` scan, routing by extension, decoding, metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import clean_text, infer_metadata, strip_front_matter
from lectern.operators.segment import sections
from lectern.sources.decode import decoded
from lectern.sources.epub import epub_rows

#: Kinds of files that can be imported.
KINDS = ("txt", "md", "epub")


def kind_of(path):
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)\z", 1))


def check(spark: SparkSession, path: str) -> None:
    """Refuses a path (or glob) that names nothing, and a single file of another kind."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    if not found:
        raise ValueError(f"{path} does not exist")
    if len(found) == 1 and found[0].isFile() and found[0].getPath().getName().rsplit(".", 1)[-1].lower() not in KINDS:
        raise ValueError(f"{path} is no file of kind {', '.join(KINDS)}")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """``path, content, kind`` of the supported files under a path or glob."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content", kind_of(F.col("path")).alias("kind")).where(F.col("kind").isin(*KINDS))


def text_books(files: DataFrame) -> DataFrame:
    """``path, kind, title, author, original, sections, error`` of text and Markdown files."""
    t = files.where(F.col("kind").isin("txt", "md")).select("path", "kind", decoded(F.col("content")).alias("raw"))
    m = t.withColumn("meta", infer_metadata(F.col("raw"), F.col("path")))
    body = F.when(F.col("kind") == "md", strip_front_matter(F.col("raw"))).otherwise(clean_text(F.col("raw")))
    body = F.when(F.col("raw").rlike(r"^\s*---"), strip_front_matter(F.col("raw"))).otherwise(body)
    x = m.select("path", "kind", "meta.title", "meta.author", body.alias("original"))
    return x.select("*", sections(F.col("original")).alias("sections"), F.when(F.col("original") == "", "no text").alias("error"))


def epub_books(files: DataFrame) -> DataFrame:
    """The same columns for EPUB files."""
    rows = epub_rows(files.where(F.col("kind") == "epub"))
    per = rows.groupBy("path").agg(
        F.first("title", ignorenulls=True).alias("title"), F.first("author", ignorenulls=True).alias("author"), F.first("error", ignorenulls=True).alias("error"),
        F.array_sort(F.collect_list(F.when(F.col("section_no").isNotNull(), F.struct("section_no", F.col("section_title").alias("title"), "text")))).alias("s"),
    )
    parts = F.transform("s", lambda x: F.struct(x["title"].alias("title"), x["text"].alias("text")))
    original = F.array_join(F.transform("s", lambda x: F.concat(F.lit("# "), x["title"], F.lit("\n\n"), x["text"])), "\n\n")
    return per.select("path", F.lit("epub").alias("kind"), "title", "author", original.alias("original"), parts.alias("sections"), "error")


def books(spark: SparkSession, path: str) -> DataFrame:
    files = scan(spark, path)
    return text_books(files).unionByName(epub_books(files))
