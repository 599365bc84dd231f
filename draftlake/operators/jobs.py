"""The leased job queue in batches: order, enqueue, and the state of each job as a fold of its events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def order(jobs: DataFrame) -> DataFrame:
    """Queued jobs as they are claimed: priority, newest source, age, id."""
    return jobs.where("state = 'QUEUED'").orderBy(F.coalesce("priority", F.lit(100)), F.col("mtime").desc_nulls_last(), "created_at", "id")


def enqueue(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests that are new by dedup_key, the first of each."""
    first = requests.withColumn("_n", F.row_number().over(Window.partitionBy("dedup_key").orderBy("created_at", "id"))).where("_n = 1").drop("_n")
    return first.join(jobs.select("dedup_key"), "dedup_key", "left_anti")


FOLD = "job_id long, state string, attempts int, owner string, lease_until double"


def step(state: tuple[str, int, str | None, float], event: str, owner: str | None, at: float, lease: float, most: int) -> tuple[str, int, str | None, float]:
    """One event of a job: claim, heartbeat, finish, fail, defer or retry. Leases that ran out count before it."""
    name, attempts, holder, until = state
    if name == "RUNNING" and until < at:
        name, holder = ("FAILED" if attempts >= most else "QUEUED"), None
    if event == "claim" and name == "QUEUED":
        return "RUNNING", attempts + 1, owner, at + lease
    if name == "RUNNING" and owner == holder:
        if event == "heartbeat":
            return name, attempts, holder, at + lease
        if event in ("finish", "fail"):
            return ("SUCCEEDED" if event == "finish" else "FAILED"), attempts, None, 0.0
        if event == "defer":
            return "QUEUED", attempts - 1, None, 0.0
    if event == "retry" and name == "FAILED":
        return "QUEUED", 0, None, 0.0
    return name, attempts, holder, until


def fold(events: DataFrame, lease: float = 300.0, most: int = 3) -> DataFrame:
    """State of each job after its events (job_id, event, owner, at, seq), in order of time and seq."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        state: tuple = ("QUEUED", 0, None, 0.0)
        for r in rows.sort_values(["at", "seq"]).itertuples():
            state = step(state, r.event, r.owner, r.at, lease, most)
        return pd.DataFrame([(rows.job_id.iloc[0], *state)], columns=["job_id", "state", "attempts", "owner", "lease_until"])

    return events.groupBy("job_id").applyInPandas(one, FOLD)


def hourly(events: DataFrame, time: str) -> DataFrame:
    return events.groupBy(F.date_trunc("hour", time).alias("hour")).agg(F.count("*").alias("n"))


def failures(jobs: DataFrame, message: str, most: int = 5) -> DataFrame:
    """The commonest failures with numbers and paths taken out."""
    own = F.substring(F.regexp_replace(F.regexp_replace(message, r"(/[^\s]+)+", "<path>"), r"[0-9a-f]{8,}|\d+", "<n>"), 1, 120)
    return jobs.groupBy(own.alias("failure")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "failure").limit(most)


