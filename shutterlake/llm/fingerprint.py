"""Document fingerprints: threshold-scaled sketches, DataFrame functions only.

A sketch retains every distinct 64-bit shingle hash below a fixed fraction of
the hash space, so its size follows the text's. A text with fewer than FLOOR
such hashes retains its FLOOR smallest instead, that is all below a higher
threshold of its own, which its last hash shows; one with fewer shingles than
that retains them all. Two sketches are compared at the lower of their
thresholds, below which both are whole: so estimates have no bias between very
unequal texts, and merging two sketches gives just the sketch of both texts'
shingles together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled, shingle_hashes, words

FRACTION = 1 / 8
FLOOR = 16
WIDTH = 5
#: Ids to a block in which a row's successor is looked up.
BLOCK_IDS = 128
#: First rows of blocks (keys of 24 bytes) that are broadcast at most.
BROADCAST_ROWS = 200_000


def _limit(fraction: float) -> int:
    return -(2**63) + round(2**64 * fraction)


def _trimmed(h: Column, fraction: float) -> Column:
    """The part of sorted distinct hashes that a sketch retains."""
    low = F.filter(h, lambda x: x < F.lit(_limit(fraction)))
    return F.when(F.size(low) >= FLOOR, low).otherwise(F.slice(h, 1, FLOOR))


def sketch(text: Column, fraction: float = FRACTION, width: int = WIDTH) -> Column:
    """Sorted array<long>. Null and empty texts: empty. Fewer words than width:
    the whole sequence is the one shingle."""

    def retained(h: Column) -> Column:
        low = F.array_distinct(F.filter(h, lambda x: x < F.lit(_limit(fraction))))
        return F.when(F.size(low) >= FLOOR, F.sort_array(low)).otherwise(F.slice(F.sort_array(F.array_distinct(h)), 1, FLOOR))

    # One lambda binds the hashes, so that they are computed once.
    return F.element_at(F.transform(F.array(shingle_hashes(words(text), width)), retained), 1)


def threshold(s: Column, fraction: float = FRACTION) -> Column:
    """The largest hash up to which a sketch is whole."""
    last = F.element_at(s, -1)
    return F.when(F.size(s) < FLOOR, F.lit(2**63 - 1)).otherwise(F.greatest(last, F.lit(_limit(fraction) - 1)))


def merged(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """The sketch of two texts' shingles together."""
    return _trimmed(F.sort_array(F.array_union(a, b)), fraction)


def _sizes(a: Column, b: Column, fraction: float) -> tuple[Column, Column, Column]:
    """Hashes of a, of b and of both up to the lower threshold."""
    top = F.least(threshold(a, fraction), threshold(b, fraction))
    size = lambda s: F.size(F.filter(s, lambda x: x <= top))
    return size(a), size(b), size(F.array_intersect(a, b))


def likeness(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Estimated Jaccard similarity of two texts' shingles; 1 if neither has any."""
    one, two, both = _sizes(a, b, fraction)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / F.greatest(one + two - both, F.lit(1)))


def containment(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Estimated share of the first text's shingles that the second has; 1 if
    the first has none, null where none of its hashes is below the second's
    threshold, so that nothing can be told."""
    one, _, both = _sizes(a, b, fraction)
    return F.when(F.size(a) == 0, F.lit(1.0)).when(one > 0, both / F.greatest(one, F.lit(1)))


def printed(s: Column) -> Column:
    """The fingerprint as text: 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(s, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def next_blocks(blocks: DataFrame, span: int = 1024) -> DataFrame:
    """block, next_block: the next lower block that there is; after the lowest
    the highest. Numbered within spans of blocks, then over the spans."""
    part = blocks.distinct().withColumn("span", F.floor(F.col("block") / span))
    inside = part.withColumn("inner", F.lead("block").over(Window.partitionBy("span").orderBy(F.desc("block"))))
    down = Window.orderBy(F.desc("span"))
    tops = part.groupBy("span").agg(F.max("block").alias("top"))
    after = tops.select("span", F.coalesce(F.lead("top").over(down), F.first("top").over(down)).alias("outer"))
    return inside.join(after, "span").select("block", F.coalesce("inner", "outer").alias("next_block"))


def with_next(rows: DataFrame, derived: dict[str, Column], block_ids: int = BLOCK_IDS) -> DataFrame:
    """rows (doc_id, text) with the derived columns and next: a struct of text and
    those of the row that follows in descending doc_id; after the last comes the
    first. Null ids are last; equal and null ids follow in order of a hash of the
    text. A single row follows itself.

    The rows move once, dealt by blocks of ids (of hashes, without an id); a
    block's last row gets its successor from the first rows of blocks, which are
    found by their keys alone and derived apart.
    """
    key = F.xxhash64("text").bitwiseAND(F.lit(2**63 - 1))
    block = F.coalesce(F.floor(F.col("doc_id") / block_ids), -F.shiftright(key, 50) - 2**61)
    keyed = rows.select("doc_id", "text", key.alias("key"), block.alias("block"))
    first = settled(keyed.groupBy("block").agg(F.max(F.struct("doc_id", (-F.col("key")).alias("key"))).alias("at")).select("block", "at.doc_id", (-F.col("at.key")).alias("key")), "first")
    first = first.join(next_blocks(first.select("block")).withColumnsRenamed({"block": "to", "next_block": "block"}), "block").withColumnsRenamed({"doc_id": "first_id", "key": "first_key"}).drop("block")
    first = settled(first, "first")
    wanted = (F.broadcast(first) if first.count() <= BROADCAST_ROWS else first).withColumnRenamed("to", "of")
    payload = ["text", *derived]
    found = keyed.join(wanted, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("key") == F.col("first_key"))).select("of", "text").withColumns(derived)
    other = found.groupBy("of").agg(F.first(F.struct(*payload)).alias("other"))
    order = Window.partitionBy("block").orderBy(F.col("doc_id").desc_nulls_last(), "key")
    held = keyed.withColumns(derived).withColumn("next", F.lead(F.struct(*payload)).over(order))
    joined = held.join(other, (F.col("block") == F.col("of")) & F.col("next").isNull(), "left")
    return joined.select("doc_id", *payload, F.coalesce("next", "other").alias("next"))


def op1(docs: DataFrame) -> DataFrame:
    """Of every row its fingerprint and its edited text's, and how like they are.
    Null texts are empty; repeated rows have a result each; an empty table gives
    an empty result; other columns of docs may have any names."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(rows, {"sketch": sketch(F.col("text"))}).withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring(F.col("next")["text"], F.lit(1), cut))
    rows = rows.select("doc_id", "n_chars", "sketch", F.col("next")["sketch"].alias("next_sketch"), edited.alias("edited"))
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        printed(F.col("sketch")).alias("fingerprint"),
        printed(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("within_edited"),
        containment(F.col("sketch"), F.col("next_sketch")).alias("within_next"),
    )
