"""Records as streams: upserts into a store, activations, captured experience."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.store import STORE, RecordStore

EVERY = "120 seconds"


def upsert(stream: DataFrame, store: RecordStore, checkpoint: str, after: Callable[[DataFrame, int], None] | None = None, every: str | None = EVERY, once: bool = False):
    """Appends each micro-batch (id, payload) to the store's log; `after` is called with the batch and its number, as a hook for what follows a store."""

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            store.append(batch.select("id", "payload"), STORE)
            if after:
                after(batch, number)

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()


def activations(events: DataFrame, late: str = "1 hour", slot: str = "10 minutes") -> DataFrame:
    """user_id, start, n, rate (activations a day) of each slot of time, on a stream (append mode) or a table."""
    w = F.window("ts", slot)
    g = events.withWatermark("ts", late).groupBy("user_id", w).agg(F.count(F.lit(1)).alias("n"))
    seconds = F.unix_timestamp("window.end") - F.unix_timestamp("window.start")
    return g.select("user_id", F.col("window.start").alias("start"), "n", F.least(F.col("n") * 86400 / seconds, F.lit(100.0)).alias("rate"))


def experience(turns: DataFrame) -> DataFrame:
    """Commitments, doubts and claims in a stream or table of turns (conv_id, turn, role, text): a row for each sentence that an assistant says."""
    s = turns.where("role = 'assistant'").select("conv_id", "turn", F.explode(T.sentences(F.col("text"))).alias("text"))
    low = F.lower("text")
    return s.select("conv_id", "turn", T.claim_kind(low).alias("kind"), T.certainty(low).alias("certainty"), T.deadline(low).alias("deadline"), "text")
