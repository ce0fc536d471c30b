"""Edits as a stream: the latest value of each cell of a micro-batch goes to a versioned log; counts by time windows.

The log is append-only Parquet with the batch number, so a batch that is run again after a failure replaces its own part;
the present value of a cell is the one with the highest (batch, ts).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest(edits: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each cell: that of the last edit by ts, ties by value."""
    rest = [c for c in edits.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct("ts", "value")).alias("r")
    return edits.groupBy(*keys).agg(row).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def to_log(edits: DataFrame, keys: list[str], log: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes the stream ``edits(keys, value, ts, ...)`` to the log below ``log``."""

    def write(batch: DataFrame, number: int) -> None:
        latest(batch, keys).write.mode("overwrite").parquet(f"{log}/batch={number}")

    return edits.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def present(log: DataFrame, keys: list[str], by_time: bool = False) -> DataFrame:
    """The present value of each cell in a log that was read back: that of the edit which arrived last or, ``by_time``, was made last."""
    order = F.struct("ts", "batch") if by_time else F.struct("batch", "ts")
    return log.groupBy(*keys).agg(F.max_by("value", order).alias("value"))


def to_model(edits: DataFrame, store: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Saves the stream ``edits(sheet_id, coord, value_str, user_id, ts)`` in a model and recalculates what depends on them.

    ``store`` holds a folder for each batch, ``state-0`` being written by ``begin``; a batch reads the one before and writes its own, so a
    batch that is run again gives the same. Each folder has the cells, the history and the calculation as they are after it.
    """
    from ..operators import workflow

    def run(batch: DataFrame, number: int) -> None:
        spark, old, new = batch.sparkSession, f"{store}/state-{number}", f"{store}/state-{number + 1}"
        cells, log = spark.read.parquet(f"{old}/cells"), spark.read.parquet(f"{old}/history")
        done, more, result = workflow.save(cells, workflow.kept(spark, old, "calculation"), batch, (log.agg(F.max("seq")).first()[0] or 0) + 1)
        done.write.mode("overwrite").parquet(f"{new}/cells")
        log.unionByName(more.select(*log.columns)).write.mode("overwrite").parquet(f"{new}/history")
        if result is not None:
            workflow.keep(result, new, "calculation")

    return edits.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def begin(cells: DataFrame, result, store: str) -> None:
    """The state that a stream of edits starts from: cells, an empty history and, if there is one, the calculation."""
    from ..operators import workflow

    cells.write.mode("overwrite").parquet(f"{store}/state-0/cells")
    empty = "sheet_id string, coord array<bigint>, user_id string, old_value string, new_value string, created_at timestamp, seq bigint"
    cells.sparkSession.createDataFrame([], empty).write.mode("overwrite").parquet(f"{store}/state-0/history")
    if result is not None:
        workflow.keep(result, f"{store}/state-0", "calculation")


def rates(edits: DataFrame, width: str = "1 day", late: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Edits in each window; on a stream ``late`` sets the watermark."""
    rows = edits.withWatermark("ts", late) if late else edits
    got = rows.groupBy(F.window("ts", width).alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("w.start").alias("start"), *by, "n", "total")
