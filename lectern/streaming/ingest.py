"""Incremental ingest: new files of a folder become chunks and term counts; progress updates become state.

Both streams are extensions of the batch library: the same functions run on
each micro-batch, and the sinks are idempotent by batch id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators import index as I
from lectern.operators import segment as G
from lectern.operators import state as P
from lectern.runtime import ship
from lectern.sources import files


def ingest_folder(spark: SparkSession, folder: str, out: str, checkpoint: str, *, max_chars: int = G.MAX_CHARS) -> StreamingQuery:
    """Text, Markdown and EPUB files that appear in ``folder`` are segmented into ``out/chunks`` and counted into ``out/terms``.

    A batch writes into folders named by its id and overwrites them if it is
    run again, so a restart neither loses nor doubles a file.
    """
    ship(spark)
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
    found = raw.select("path", "content", files.kind_of(F.col("path")).alias("kind")).where(F.col("kind").isin(*files.KINDS))

    def batch(df: DataFrame, no: int) -> None:
        books = files.text_books(df).unionByName(files.epub_books(df)).where("error IS NULL").select(F.sha2("path", 256).alias("book_id"), "original")
        chunks = G.segment(books, max_chars=max_chars, text="original")
        chunks.write.mode("overwrite").parquet(f"{out}/chunks/batch={no}")
        made = df.sparkSession.read.parquet(f"{out}/chunks/batch={no}")
        I.term_counts(made).write.mode("overwrite").parquet(f"{out}/terms/batch={no}")

    return found.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress_windows(updates: DataFrame, *, late: str = "30 days", size: str = "1 day") -> DataFrame:
    """Streaming counts of updates by book and day of reading; updates up to ``late`` behind still count."""
    u = updates.where("last_read_at IS NOT NULL AND book_id IS NOT NULL").withWatermark("last_read_at", late)
    return u.dropDuplicatesWithinWatermark(["update_id"]).groupBy(F.window("last_read_at", size).alias("day"), "book_id").agg(F.count(F.lit(1)).alias("updates"), F.max("received_at").alias("last_received_at"))


def progress_state(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str) -> StreamingQuery:
    """Progress state by book, a new version with each micro-batch of updates.

    From one batch to the next only the updates that decide a field are kept
    (at most one for each field of a book), so a batch costs its own rows and
    the books, however long the log has become.
    """
    ship(spark)
    raw = spark.readStream.schema(schema).parquet(source)

    def batch(df: DataFrame, no: int) -> None:
        read = df.sparkSession.read.schema(df.schema)
        known = df.unionByName(read.parquet(f"{out}/deciding/version={no - 1}")) if no else df
        P.deciding_updates(known).write.mode("overwrite").parquet(f"{out}/deciding/version={no}")
        P.latest_progress(read.parquet(f"{out}/deciding/version={no}")).write.mode("overwrite").parquet(f"{out}/state/version={no}")

    return raw.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
