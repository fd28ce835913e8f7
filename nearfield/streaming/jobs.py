"""Streams: keep a vector store current, and answer arriving queries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nearfield.functions.encoders import Encoder, encode_column
from nearfield.operators.knn import nearest
from nearfield.operators.store import VectorStore


def stream_ingest(
    rows: DataFrame,
    store: VectorStore,
    checkpoint: str,
    *,
    encoder: Encoder,
    content: str,
    dataset_name: str,
    newest: Sequence[Column] = (),
    version: str | None = None,
    name: str = "ingest",
) -> StreamingQuery:
    """Encode arriving ``id, <content>`` rows and upsert them; drains the source, then stops.

    Each micro-batch writes one tagged change folder, so a batch that is run again after a
    failure replaces its own output. ``newest`` picks among rows of one batch. ``version`` names a
    column that orders the rows of an id over the whole stream: its state keeps the newest encoded
    row of each id, so a late row with an older version changes nothing, whichever batch it comes
    with. Rows of equal version are ordered by their other columns.
    """

    if version is not None:
        # Encoded first, so that the state holds vectors of fixed width and no contents.
        encoded = encode_column(rows, content, encoder).drop(content)
        others = [c for c in encoded.columns if c not in ("id", version)]
        latest = encoded.groupBy("id").agg(F.max(F.struct(version, *others)).alias("row"))
        rows = latest.select("id", "row.*")

    def write(batch: DataFrame, epoch: int) -> None:
        if version is None:
            batch = encode_column(batch, content, encoder).drop(content)
        store.add(
            batch,
            model_name=encoder.name,
            dataset_name=dataset_name,
            newest=newest,
            tag=f"{name}.{epoch}",
        )

    return (
        rows.writeStream.foreachBatch(write)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_search(
    queries: DataFrame,
    gallery: DataFrame,
    k: int,
    output: str,
    checkpoint: str,
    *,
    metric: str = "cosine",
    search: Callable[..., DataFrame] = nearest,
) -> StreamingQuery:
    """Top-k of every micro-batch of ``qid, embedding`` rows, written under ``epoch=<n>``."""

    def answer(batch: DataFrame, epoch: int) -> None:
        hits = search(gallery, batch, k, metric)
        hits.write.mode("overwrite").parquet(f"{output}/epoch={epoch}")

    return (
        queries.writeStream.foreachBatch(answer)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
