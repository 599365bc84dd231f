"""Windows over event streams, and the job queue as keyed state. The windows are an addition of this engine."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from draftlake.operators import jobs


def tumbling(events: DataFrame, time: str, width: str, by: list[str], late: str | None = None) -> DataFrame:
    """Counts and sums by window; with `late`, a watermark bounds the state of a stream."""
    own = events if late is None else events.withWatermark(time, late)
    return own.groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sliding(events: DataFrame, time: str, width: str, step: str, late: str | None = None) -> DataFrame:
    own = events if late is None else events.withWatermark(time, late)
    return own.groupBy(F.window(time, width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, time: str, gap: str, key: str, late: str | None = None) -> DataFrame:
    own = events if late is None else events.withWatermark(time, late)
    return own.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def enqueue(requests: DataFrame, time: str, late: str) -> DataFrame:
    """The first request of each dedup_key within the watermark."""
    return requests.withWatermark(time, late).dropDuplicatesWithinWatermark(["dedup_key"])


STATE = "state string, attempts int, owner string, lease_until double"


def queue(events: DataFrame, lease: float = 300.0, most: int = 3) -> DataFrame:
    """State of each job after every batch of its events (job_id, event, owner, at, seq)."""

    def one(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = state.get if state.exists else ("QUEUED", 0, None, 0.0)
        for part in rows:
            for r in part.sort_values(["at", "seq"]).itertuples():
                own = jobs.step(own, r.event, r.owner, r.at, lease, most)
        state.update(own)
        yield pd.DataFrame([(key[0], *own)], columns=["job_id", "state", "attempts", "owner", "lease_until"])

    return events.groupBy("job_id").applyInPandasWithState(one, jobs.FOLD, STATE, "update", GroupStateTimeout.NoTimeout)


def ingest(spark: SparkSession, path: str, checkpoint: str, handle: Callable[[DataFrame, int], None], glob: str = "*"):
    """New files of a folder in batches, all that are there, then the end: resumable by its checkpoint."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
