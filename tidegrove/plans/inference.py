"""Calls of a model or judge for every row, in batches, from the tasks.

The client is made once a task, takes a list of texts and returns as many. Rows keep their order within a batch, a
batch is tried again before the task fails, and calls of a task are held under a rate. A task that is lost is repeated, so a client
must stand being asked twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..registry import query, table


def infer(rows: DataFrame, column: str, out: str, make_client: Callable[[], Callable[[list[str]], list[str]]], batch: int = 64, tries: int = 3, calls_a_second: float | None = None) -> DataFrame:
    """``rows`` with the client's reply to ``column`` as ``out``; a null text has a null reply and is not sent."""
    if out in rows.columns:
        raise ValueError(f"column {out} is there already")
    schema = StructType([*rows.schema.fields, StructField(out, StringType())])
    place = rows.columns.index(column)

    def ask(client, texts: list[str]) -> list[str]:
        for left in reversed(range(tries)):
            try:
                replies = list(client(texts))
            except Exception:
                if not left:
                    raise
                time.sleep(0.1)
            else:
                if len(replies) != len(texts):
                    raise ValueError(f"{len(texts)} texts, {len(replies)} replies")
                return replies
        return []

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, ready = make_client(), time.monotonic()
        for part in parts:
            texts = part.column(place).to_pylist()
            replies: list[str | None] = [None] * len(texts)
            asked = [i for i, t in enumerate(texts) if t is not None]
            for at in range(0, len(asked), batch):
                if calls_a_second:
                    time.sleep(max(0.0, ready - time.monotonic()))
                    ready = max(ready, time.monotonic()) + 1 / calls_a_second
                some = asked[at : at + batch]
                for i, reply in zip(some, ask(client, [texts[i] for i in some]), strict=True):
                    replies[i] = reply
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(replies, pa.string())], names=[*part.schema.names, out])

    return rows.mapInArrow(run, schema)


@query("SELECT conv_id, turn, CASE WHEN contains(text, '?') THEN 'question' ELSE 'statement' END AS verdict, length(text) % 7 AS k FROM conversations WHERE text IS NOT NULL")
def judge_turns(spark, sf_dir):
    """A judge that needs no model: whether a turn asks something."""

    def client():
        return lambda texts: [f"{'question' if '?' in t else 'statement'} {len(t) % 7}" for t in texts]

    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").where("text is not null")
    reply = F.split("reply", " ")
    return infer(c, "text", "reply", client).select("conv_id", "turn", reply[0].alias("verdict"), reply[1].cast("bigint").alias("k"))
