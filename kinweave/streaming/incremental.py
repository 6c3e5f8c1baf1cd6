"""Linking a stream of new corpus records to a fixed clean list, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..operators import retrieval


def link_stream(records: DataFrame, clean: DataFrame, out: str, state: str, cfg: Config = Config()) -> StreamingQuery:
    """Appends (country, q, c, score) of equal token bags to `out`; state is the stream's checkpoint folder.

    Both sides hold normal forms (country, id, src, name, addr). A rerun of a batch replaces its own folder.
    """

    def step(batch: DataFrame, number: int) -> None:
        both = clean.unionByName(batch)
        retrieval.canonical(both, "name", cfg.canonical_cap).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return records.writeStream.foreachBatch(step).option("checkpointLocation", state).trigger(availableNow=True).start()
