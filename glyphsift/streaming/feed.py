"""Ordered changes applied to a snapshot, in batches or as a stream.

The snapshot keeps the highest key of each id, of deleted ones too, and keys are compared by id. So it doesn't
matter in which order changes come, or whether one comes twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import live, newest, reduced
from ..sources import snapshot

STORED = "id STRING, key LONG, doc STRING"
UPDATE = "key LONG, id STRING, deleted BOOLEAN, doc STRING"
#: Changes that a batch reads at once.
BATCH = 1000


def after(updates: DataFrame, last: int, most: int = BATCH) -> DataFrame:
    """The next changes from the last key on; that one again does no harm, as changes can be applied twice."""
    return updates.where(F.col("key") >= last).orderBy("key").limit(most)


def apply(spark: SparkSession, updates: DataFrame, folder: str) -> int:
    """Applies changes to the snapshot as its next version, in work that grows with the changes and not with the corpus.
    Returns the highest key seen. A failure leaves the version before as it was."""
    if not snapshot.current(spark, folder):
        snapshot.init(spark, folder, {"documents": STORED})
    last = snapshot.offset(spark, folder)
    top = lambda rows: max(last, rows.agg(F.max("key")).first()[0])
    snapshot.append(reduced(updates), folder, "documents", newest, top)
    return snapshot.offset(spark, folder)


def run(spark: SparkSession, updates: DataFrame, folder: str, most: int = BATCH) -> int:
    """Applies a feed in batches of its order, from where the snapshot is on, until one isn't full."""
    if not snapshot.current(spark, folder):
        snapshot.init(spark, folder, {"documents": STORED})
    with snapshot.writer(spark, folder):
        while True:
            last = snapshot.offset(spark, folder)
            batch = after(updates, last, most).persist()
            try:
                full = batch.count() == most
                top = apply(spark, batch, folder)
            finally:
                batch.unpersist()
            if not full or top == last:
                return top


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """(id, key, doc) of what is there now."""
    return live(newest(snapshot.load(spark, folder, "documents")))


def start(spark: SparkSession, source: str, folder: str, checkpoint: str, files: int = 1, schema: str = UPDATE):
    """A stream of the change files that a folder has or gets, in any order: each micro-batch is one apply(). It ends
    when the files there are done; with the same checkpoint it goes on from where it was."""
    changes = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)

    def put(batch: DataFrame, _: int) -> None:
        with snapshot.writer(batch.sparkSession, folder):
            apply(batch.sparkSession, batch, folder)

    return changes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
