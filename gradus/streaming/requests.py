"""Answering requests as they arrive in a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from gradus.plans.recommend import split_requests
from gradus.schemas import schema


def answer_requests(
    spark: SparkSession, incoming: str, outgoing: str, checkpoint: str, kind: str,
    answer: Callable[[DataFrame], DataFrame], trigger: dict | None = None,
) -> StreamingQuery:
    """Read JSON requests, write answers and rejected requests per micro-batch.

    A batch writes to a folder named by its number, so a batch that runs again after a
    failure replaces its own output. ``kind`` is ``recommend``, ``from_text`` or ``closest``.
    """
    table = {"recommend": "recommend_requests", "from_text": "text_requests", "closest": "closest_requests"}[kind]
    requests = spark.readStream.schema(schema(table)).json(incoming)

    def run(batch: DataFrame, number: int) -> None:
        valid, rejected = split_requests(batch, kind)
        answer(valid).write.mode("overwrite").parquet(f"{outgoing}/answers/batch={number}")
        rejected.write.mode("overwrite").parquet(f"{outgoing}/rejected/batch={number}")

    stream = requests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return stream.trigger(**(trigger or {"availableNow": True})).start()
