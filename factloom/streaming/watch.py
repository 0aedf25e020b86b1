"""Structured Streaming: facts of changed files as they arrive, and windowed counts of events with late data.

The batch model has no streams; these are extensions that reuse its per-file functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.extract import code
from factloom.sources.files import FILES


def changed_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of file versions (repo, path, content, version) from JSON lines that land in `folder`."""
    return spark.readStream.schema(f"{FILES}, version long").json(folder)


def follow(changes: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Facts of each micro-batch's latest version of every file, given to `sink` with the batch's number.

    A batch that is run again after a failure gives the same rows, so an idempotent sink sees each change once.
    """

    def each(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("repo", "path").agg(F.max_by("content", "version").alias("content"), F.max("version").alias("version"))
        facts = code.facts(latest.select("repo", "path", "content"))
        sink(facts.join(latest.select(F.col("repo").alias("_r"), F.col("path").alias("_p"), "version"), F.col("repo").eqNullSafe(F.col("_r")) & (F.col("path") == F.col("_p"))).drop("_r", "_p"), number)

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, at: str, keys: list[str], size: str = "5 minutes", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """n of each key and window; rows later than `late` behind the newest are dropped by the watermark."""
    win = F.window(at, size, slide) if slide else F.window(at, size)
    return events.withWatermark(at, late).groupBy(win.alias("window"), *keys).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, at: str, keys: list[str], gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """n of each key's sessions: runs of events less than `gap` apart."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("session"), *keys).agg(F.count("*").alias("n"))


def last_states(moves: DataFrame) -> DataFrame:
    """key, state, moves: each key's latest state over a stream of (key, state, at), kept between batches.

    A row that is older than the one already seen counts as a move but doesn't set the state back.
    """
    import pandas as pd

    def each(key, frames, state):
        at, name, n = state.get if state.exists else (None, None, 0)
        for pdf in frames:
            n += len(pdf)
            newest = pdf.sort_values(["at", "state"]).iloc[-1]
            if at is None or int(newest["at"]) >= at:
                at, name = int(newest["at"]), newest["state"]
        state.update((at, name, n))
        yield pd.DataFrame({"key": [key[0]], "state": [name], "moves": [n]})

    return moves.groupBy("key").applyInPandasWithState(each, "key string, state string, moves long", "at long, state string, moves long", "update", "NoTimeout")
