"""Streams over the ledger and the outbox."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from crateforge.functions.session import dropped, written

CLAIM = "identity_key string, id bigint, admitted boolean"
STATE = "live_id bigint"


def admitted(requests: DataFrame) -> DataFrame:
    """At most one live claim of each identity, atomically: the state of a key has a single writer.

    ``requests``: identity_key, id, action ('claim' or 'release'), queued_at.
    Requests of one key in a batch act in order of queued_at and id. A release
    frees the key for later claims.
    """

    def run(key, frames, state):
        import pandas as pd

        live = state.get[0] if state.exists else -1
        rows = pd.concat(list(frames)).sort_values(["queued_at", "id"])
        out = []
        for r in rows.itertuples():
            if r.action == "release":
                live = -1
            else:
                out.append((key[0], int(r.id), live < 0))
                live = int(r.id) if live < 0 else live
        state.update((live,))
        yield pd.DataFrame(out, columns=["identity_key", "id", "admitted"])

    return requests.groupBy("identity_key").applyInPandasWithState(run, CLAIM, STATE, "append", "NoTimeout")


def deliver(outbox: DataFrame, send: Callable[[list], list], done_path: str, checkpoint: str, at_most_once: bool = False) -> StreamingQuery:
    """At-least-once delivery of a stream of notifications (id, event, payload).

    ``send`` gets the rows of a partition-bounded batch and returns the ids that
    were delivered; only those are written as done, so that a failure between
    sending and marking sends again but never loses. Ids already marked are not
    sent again. With ``at_most_once`` all are marked before they are sent: a failure
    loses them but none is sent twice.
    """

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        done = spark.read.schema("id bigint").parquet(done_path)
        open_ = df.dropDuplicates(["id"]).join(done, "id", "left_anti")
        schema = "id bigint"

        def act(frames):
            import pyarrow as pa

            for b in frames:
                yield pa.RecordBatch.from_arrays([pa.array(send(b.to_pylist()), pa.int64())], ["id"])

        if at_most_once:
            taken = written(open_, "taken")
            taken.select("id").write.mode("append").parquet(done_path)
            taken.mapInArrow(act, schema).write.format("noop").mode("overwrite").save()
            dropped(taken)
            return
        open_.mapInArrow(act, schema).write.mode("append").parquet(done_path)

    return outbox.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def settled(files: DataFrame, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Folders without a new file for ``gap``: event-time session windows with a watermark; column ``ts``, ``folder``."""
    from pyspark.sql import functions as F

    w = files.withWatermark("ts", late).groupBy("folder", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("files"))
    return w.select("folder", "files", F.col("w.start").alias("began"), F.col("w.end").alias("settled_at"))
