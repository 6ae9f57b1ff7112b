"""Block sums kept up to date over a stream of new markers (an extension: block sums add up)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelica.operators import jackknife


def running_sums(terms: DataFrame) -> DataFrame:
    """qid, block, top, bot, n of a stream of marker terms (qid, block, top, bot); state is a row per block."""
    return terms.groupBy("qid", "block").agg(F.sum("top").alias("top"), F.sum("bot").alias("bot"), F.count("*").alias("n"))


def start(terms: DataFrame, path: str, checkpoint: str):
    """A query that keeps jackknifed estimates over all markers so far under ``path``, as Parquet."""

    def refresh(batch: DataFrame, _: int) -> None:
        jackknife.ratio(batch, ["qid"]).write.mode("overwrite").parquet(path)

    writer = running_sums(terms).writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(refresh).start()
