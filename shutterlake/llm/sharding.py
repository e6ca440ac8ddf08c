"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash within their source and ranked; the rank
divided by the source's size spreads every source evenly over (0, 1]. All rows
sorted by that fraction form one sequence whose every stretch has the corpus's
mixture, and the sequence is cut into shards whose sizes are at most one apart.

Both rankings are distributed: rows go to blocks of about `block_rows` by the
leading bits of the hash, or by the fraction, are numbered within their block,
and get the number of rows in the blocks before. Hash and fraction are uniform
whatever the sources' sizes, so a source with most of the rows is spread over
as many blocks as any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def interleaved(rows: DataFrame, shards: int, id_col: str = "doc_id", source_col: str = "source", seed: int = 42, block_rows: int = 1024, tie_cols: tuple[str, ...] = ()) -> DataFrame:
    """rows with shard (int, from 0) and slot (long, gapless from 0 in a shard).

    Null sources form a source of their own. Null ids are shuffled like any
    other id, and rows of one id by their tie_cols, so that neither meet in a task. Rows equal in id and tie_cols are interchangeable: which of them
    gets which place is not defined, but the set of places is. Fewer rows than
    shards leave shards empty; an empty table gives an empty result. Other
    columns of rows are kept, whatever their names.
    """
    n = rows.count()
    blocks = max(1, -(-n // block_rows))
    held = rows.select(
        F.struct("*").alias("row"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")).alias("stratum"),
        F.xxhash64(F.lit(seed), F.col(id_col), *(F.col(c) for c in tie_cols)).alias("h"),
        F.struct(F.col(id_col), *(F.col(c) for c in tie_cols)).alias("tie"),
    ).withColumn("block", F.shiftright((F.shiftright("h", 32) + F.lit(2**31)) * F.lit(blocks), 32))

    before = Window.partitionBy("stratum").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = held.groupBy("stratum", "block").agg(F.count("*").alias("n")).select(
        "stratum", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"), F.sum("n").over(Window.partitionBy("stratum")).alias("of")
    )
    ranked = held.join(sizes, ["stratum", "block"]).withColumn("rank", F.col("earlier") + F.row_number().over(Window.partitionBy("stratum", "block").orderBy("h", "tie")))

    # Whatever the mixture, the fractions are uniform, and so are blocks of them.
    spread = ranked.select("row", "stratum", "tie", ((2 * F.col("rank") - 1) / (2 * F.col("of"))).alias("at")).withColumn("block", F.least(F.floor(F.col("at") * blocks), F.lit(blocks - 1)))
    starts = spread.groupBy("block").agg(F.count("*").alias("n")).select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    placed = spread.join(starts, "block").withColumn("pos", F.col("earlier") + F.row_number().over(Window.partitionBy("block").orderBy("at", "stratum", "tie")) - 1)
    shard = F.expr(f"(pos * {shards}L) div {max(n, 1)}L")
    return placed.withColumn("shard", shard).select("row.*", F.col("shard").cast("int").alias("shard"), F.expr(f"pos - (shard * {n}L + {shards - 1}L) div {shards}L").alias("slot"))


def op5(docs: DataFrame, shards: int = 40) -> DataFrame:
    """A place for every row, as interleaved() gives it, by law `rows`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), "source")
    out = interleaved(slim, shards, tie_cols=("text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
