"""The cache step on a stream of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from recollect.config import DEFAULT, CacheConfig
from recollect.operators.step import cache_step


def stream_cache(
    queries: DataFrame,
    responses: DataFrame,
    root: str,
    checkpoint: str,
    dim: int,
    thresholds: DataFrame | None = None,
    cfg: CacheConfig = DEFAULT,
    every: str | None = None,
    now: Column | None = None,
) -> StreamingQuery:
    """Answer each micro-batch with ``cache_step``; the batch number is the version written.

    ``every`` is the trigger interval (for example "30 seconds"); without it what is there is
    processed and the query ends.  A replayed batch starts from the same version as before.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        at = F.current_timestamp() if now is None else now
        cache_step(batch.sparkSession, root, batch_id, batch, responses, at, dim, thresholds, cfg)

    writer = queries.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return writer.trigger(**trigger).start()
