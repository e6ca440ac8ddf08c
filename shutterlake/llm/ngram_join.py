"""N-gram Jaccard join by T-occurrence search with DivideSkip.

A document's lists are the inverted lists of its distinct shingles. A link needs
T = ceil(3/4 of its shingles) of them in common, so with its T - 1 longest lists
set aside, a partner is in at least one of the others. The short lists are
merged and counted; for pairs whose count and positions can still reach the
required overlap, the long ones are probed by binary search.

All is exact, and spread:

* Documents with equal sets are one class, found by a 128-bit hash of the set;
  only a class's least document goes on.
* Lists are long or short by counts over the whole corpus, of `BUCKETS` hash
  buckets (a fixed size). The order is total, and the same for all documents, so
  only short lists need to be built: a posting is (shingle, document).
* Of each list and band of sizes, documents are first held against one leader,
  so a large group of near copies costs links in proportion to its size. Lists
  that are in one component are then done. Documents of the others that are in
  different components are compared pairwise inside a task, once for each least
  document ("head") of the lists that they share, and only pairs that may link
  leave it. Lists that are too long for a task are dealt by salts, and pairs of
  salts meet in cells.
* Before any text is fetched, pairs must pass an exact bound: a set's parity
  bitmap has a bit for each hash modulo a power of two of at least `BITS` times
  its size, set if an odd number of its shingles fall there, so two bitmaps
  differ in no more places than the sets. The halves of a bitmap, one laid on
  the other, are the bitmap of half the length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import grams
from .common import lean, settled, small_batches
from .graph import components

WIDTH = 5
BUCKETS_BITS = 16
#: Bits of a set's parity bitmap for each shingle, and least bits.
BITS, LEAST_BITS = 4, 512
#: Documents of a group, or of a salt of it, that are compared in one task.
GROUP_ROWS = 512
#: Documents of a component, or of a salt of it, whose links are counted in one task.
COUNT_ROWS = 256
#: Postings of a list's bucket for each salt.
LIST_ROWS = 1_000_000
#: Ids and keys (of 24 bytes) that are broadcast at most.
BROADCAST_IDS = 200_000
#: Postings to a task.
TASK_ROWS = 1_000_000

shingles = grams.set_of


def bucket_counts(docs: DataFrame, bits: int = BUCKETS_BITS, width: int = WIDTH) -> np.ndarray:
    """Documents' distinct shingles by the leading bits of their hash, over the whole table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, waiting = np.zeros(1 << bits, np.int64), [], 0
        for batch in batches:
            for found in grams.sets(batch.column(0), width):
                held.append(found >> np.uint64(64 - bits))
                waiting += len(held[-1])
                if waiting > 1 << 20:
                    total += np.bincount(np.concatenate(held).astype(np.int64), minlength=1 << bits)
                    held, waiting = [], 0
        if held:
            total += np.bincount(np.concatenate(held).astype(np.int64), minlength=1 << bits)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(lean(count), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # 2**bits rows at most
    total = np.zeros(1 << bits, np.int64)
    for bucket, n in rows:
        total[bucket] = n
    return total


def ordered(h: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Hashes renamed one to one, so that their order is from rare to frequent buckets; sorted."""
    bits = np.uint64(len(rank).bit_length() - 1)
    return np.sort((rank[(h >> (np.uint64(64) - bits)).astype(np.int64)] << (np.uint64(64) - bits)) | (h & ((np.uint64(1) << (np.uint64(64) - bits)) - np.uint64(1))))


def required(n: int) -> int:
    """Least overlap of a set of n with any partner: ceil(3n/4)."""
    return -(-3 * n // 4)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether 100 * overlap >= 75 * union, for sorted sets: binary probes of the smaller set's entries."""
    if len(a) > len(b):
        a, b = b, a
    need = -(-3 * (len(a) + len(b)) // 7)
    if not len(a) or len(a) < need:
        return False
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) >= need


def parity(grams: np.ndarray) -> bytes:
    size = max(LEAST_BITS, 1 << (BITS * len(grams) - 1).bit_length()) if len(grams) else LEAST_BITS
    odd = np.bincount((grams & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def apart(a: bytes, b: bytes) -> int:
    """In how many places two bitmaps differ, at the length of the shorter."""
    x, y = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def described(docs: DataFrame, rank: np.ndarray, width: int = WIDTH) -> DataFrame:
    """row (a number of its own), doc_id, text_key (64-bit hash), n_shingles,
    set_key, bits: the parity bitmap, short: the short lists' shingles in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, short, bits = [], [], [], []
            for found in grams.sets(batch.column(2), width):
                found = ordered(found, rank)
                sizes.append(len(found))
                keys.append(xxhash.xxh3_128_digest(found.tobytes()))
                short.append(found[: len(found) - required(len(found)) + 1] if len(found) else found)
                bits.append(parity(found))
            ends = np.concatenate([[0], np.cumsum([len(s) for s in short])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*short, np.empty(0, np.uint64)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bits, pa.binary()), lists], ["doc_id", "text_key", "n_shingles", "set_key", "bits", "short"])

    rows = docs.select("doc_id", "text_key", "text").mapInArrow(lean(run), "doc_id long, text_key long, n_shingles long, set_key binary, bits binary, short array<long>")
    return rows.withColumn("row", F.monotonically_increasing_id())


def postings(held: DataFrame, salts: np.ndarray) -> DataFrame:
    """s, salt, hot, node, n, pos: a row an entry of a row's short lists. salts:
    among how many the lists of a bucket are dealt, by rank."""
    shift = np.uint64(64 - (len(salts).bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n, lists = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(2)
            long = np.diff(np.asarray(lists.offsets))
            s = np.asarray(lists.flatten()).view(np.uint64)
            pos = np.arange(len(s)) - np.repeat(np.cumsum(long) - long, long)
            node, n, many = np.repeat(node, long), np.repeat(n, long), salts[(s >> shift).astype(np.int64)]
            salt = grams.mixed(node.astype(np.uint64)) % many.astype(np.uint64)
            out = {"s": s.view(np.int64), "salt": salt.astype(np.int32), "hot": many > 1, "node": node, "n": n.astype(np.int32), "pos": pos.astype(np.int32)}
            for at in range(0, len(s), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(v[at : at + 100_000]) for v in out.values()], list(out))

    return held.select("node", "n_shingles", "short").mapInArrow(lean(run), "s long, salt int, hot boolean, node long, n int, pos int")


def _arrays(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
    held = list(batches)
    return {c: np.concatenate([np.asarray(b.column(i)) for b in held]) for i, c in enumerate(held[0].schema.names)} if held else {}


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys, and the end."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), len(new))


def _lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of lists with two documents or more, each with the leader (the
    least document) of its list and band of sizes."""
    x = _arrays(batches)
    if not x:
        return
    band = np.floor(np.log(x["n"]) / math.log(4 / 3)).astype(np.int16)
    order = np.lexsort((x["node"], band, x["s"], x["salt"]))
    x = {c: v[order] for c, v in x.items()}
    whole = _runs(x["s"], x["salt"])
    kept = np.repeat((np.diff(whole) > 1) | (x["hot"][whole[:-1]]), np.diff(whole))
    part = _runs(x["s"], x["salt"], band[order])
    first = np.repeat(part[:-1], np.diff(part))
    out = {"s": x["s"], "salt": x["salt"], "hot": x["hot"], "node": x["node"], "n": x["n"], "pos": x["pos"], "leader": x["node"][first], "leader_pos": x["pos"][first], "leader_n": x["n"][first], "head": np.minimum.reduceat(x["node"], whole[:-1]).repeat(np.diff(whole)), "band": band[order].astype(np.int32)}
    for at in range(0, len(kept), 50_000):
        k = slice(at, at + 50_000)
        if kept[k].any():
            yield pa.RecordBatch.from_arrays([pa.array(v[k][kept[k]]) for v in out.values()], list(out))


LED = "s long, salt int, hot boolean, node long, n int, pos int, leader long, leader_pos int, leader_n int, head long, band int"
PAIRS = "a long, b long"


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a group's documents that are in different components and may
    link by their sizes and bitmaps. A cell (lo, hi) of two salts pairs across
    them only."""
    held = [b for b in batches if len(b)]
    if not held:
        return
    x = {c: np.concatenate([np.asarray(b.column(i)) for b in held]) for i, c in enumerate(held[0].schema.names) if c != "bits"}
    bits = [v for b in held for v in b.column(b.schema.get_field_index("bits")).to_pylist()]
    order = np.lexsort((x["n"], x["hi"], x["lo"], x["key"], x["hot"]))
    x, bits = {c: v[order] for c, v in x.items()}, [bits[i] for i in order]
    runs = _runs(x["hot"], x["key"], x["lo"], x["hi"])
    found: list[np.ndarray] = []
    for s, e in zip(runs[:-1], runs[1:], strict=True):
        n, node, comp, salt, cell = x["n"][s:e].astype(np.int64), x["node"][s:e], x["component"][s:e], x["salt"][s:e], x["lo"][s] != x["hi"][s]
        # Two of one band were held against each other before, by all that they
        # share, unless they share a list of an earlier head, whose group has them too.
        if len(n) < 2 or (comp == comp[0]).all() or len(n) == 2 and not cell and not x["hot"][s] and (x["band"][s:e] == x["band"][s]).all():
            continue
        # Rows are in order of size, so fitting partners are a stretch behind
        # each, with bitmaps of the same length or of twice it.
        last, long = np.searchsorted(3 * n, 4 * n, "right"), np.array([len(v) for v in bits[s:e]])
        for size in np.unique(long):
            low, high, top = (int(np.searchsorted(long, v, side)) for v, side in ((size, "left"), (size, "right"), (2 * size, "right")))
            maps = np.frombuffer(b"".join(bits[s + low : s + high]), np.uint64).reshape(high - low, -1)
            if top > high and long[high] == 2 * size:
                twice = np.frombuffer(b"".join(bits[s + high : s + top]), np.uint64).reshape(top - high, 2, -1)
                maps = np.concatenate([maps, twice[:, 0] ^ twice[:, 1]])
            for i in range(low, high):
                j = slice(i + 1, min(last[i], low + len(maps)))
                if j.stop <= j.start:
                    continue
                far = np.bitwise_count(maps[i - low] ^ maps[j.start - low : j.stop - low]).sum(axis=1, dtype=np.int64)
                fit = (7 * far <= n[i] + n[j]) & (comp[j] != comp[i])
                if cell:
                    fit &= salt[j] != salt[i]
                if fit.any():
                    other = node[j][fit]
                    found.append(np.stack([np.minimum(node[i], other), np.maximum(node[i], other)]))
    if found:
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        for at in range(0, pairs.shape[1], 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in pairs[:, at : at + 50_000]], ["a", "b"])


def _reaching(pairs: DataFrame) -> DataFrame:
    """a, b of the pairs whose counted overlap in short lists, and what may
    follow after the last common place, reach the required overlap."""
    merged = pairs.groupBy("a", "b").agg(F.count("*").alias("common"), F.max("a_pos").alias("a_pos"), F.max("b_pos").alias("b_pos"), F.first("a_n").alias("a_n"), F.first("b_n").alias("b_n"))
    rest = F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos")) - 1
    return merged.where(7 * (F.col("common") + rest) >= 3 * (F.col("a_n") + F.col("b_n"))).where(4 * F.least("a_n", "b_n") >= 3 * F.greatest("a_n", "b_n")).select("a", "b")


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose bitmaps differ in few enough places to link."""
    side = lambda c: sets.select(F.col("row").alias(c), F.col("bits").alias(f"{c}_bits"), F.col("n_shingles").alias(f"{c}_n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            n = np.asarray(batch.column(4)) + np.asarray(batch.column(5))
            yield batch.select(["a", "b"]).filter(pa.array([7 * apart(v, w) <= k for v, w, k in zip(a, b, n.tolist(), strict=True)], pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_bits", "b_bits", "a_n", "b_n").mapInArrow(lean(run), PAIRS)


def texts_of(nodes: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """node, text of the rows wanted (once for each equal row of docs). Only
    these texts move; while they are few (BROADCAST_IDS, counted), their keys are
    sent to the scan."""
    wanted = settled(sets.join(nodes.withColumnRenamed("node", "row"), "row", "left_semi").select(F.col("row").alias("node"), F.col("doc_id").alias("its_id"), F.col("text_key").alias("its_key")), "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    return docs.join(wanted, (F.col("text_key") == F.col("its_key")) & F.col("doc_id").eqNullSafe(F.col("its_id"))).select("node", "text")


class Recent:
    """Sets of the rows met last, of at most `most` bytes besides the newest."""

    def __init__(self, width: int, most: int = 32 << 20):
        self.width, self.most, self.size, self.held = width, most, 0, {}

    def get(self, node: int, text: pa.Scalar) -> np.ndarray:
        if (found := self.held.get(node)) is None:
            found = shingles(text.as_py(), self.width)
            while self.held and self.size + found.nbytes > self.most:
                self.size -= self.held.pop(next(iter(self.held))).nbytes
            self.held[node] = found
            self.size += found.nbytes
        return found


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """The pairs (a, b) that link, by their rows' whole texts."""
    pairs = settled(pairs, "pairs")
    texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), sets, docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Recent(width)
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = [linked(held.get(x, s), held.get(y, t)) for x, y, s, t in zip(a, b, batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("s")), "a")
    both = first.join(texts.select(F.col("node").alias("b"), F.col("text").alias("t")), "b").select("a", "b", "s", "t")
    return both.mapInArrow(lean(run), PAIRS)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and text_key. Rows are told apart by the first and the last;
    rows equal in both have equal texts."""
    text = F.col("text").cast("string")
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("text_key"))


def compared(docs: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of keyed docs: sets (see described, settled); classes: set_key, node (the
    least row of the class), class_id (its least doc_id), copies; near: node and
    component, a number, of classes with links."""
    spark: SparkSession = docs.sparkSession
    counts = bucket_counts(docs, width=width)
    rank = np.empty(len(counts), np.uint64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts), dtype=np.uint64)
    sets = settled(described(docs, rank, width), "sets")
    classes = settled(sets.where("n_shingles > 0").groupBy("set_key").agg(F.min("row").alias("node"), F.min("doc_id").alias("class_id"), F.count("*").alias("copies")), "classes")

    copies = classes.where("copies > 1").select("set_key", F.col("node").alias("first"))
    copies = settled(sets.select("row", "set_key").join(copies, "set_key").where("row <> first").select("row"), "copies")
    copies = F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies
    held = sets.where("n_shingles > 0").join(copies, "row", "left_anti").withColumnRenamed("row", "node")
    # A bucket holds many shingles, so its count bounds each list from above.
    salts = np.maximum(1, np.sort(counts) // LIST_ROWS).astype(np.int32)  # by rank
    total = sets.select(F.sum(F.size("short"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_ROWS))
    led = settled(postings(held, salts).repartition(parts, "s", "salt").mapInArrow(lean(_lead), LED), "led")

    star = led.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b"), F.col("leader_n").alias("a_n"), F.col("n").alias("b_n"), F.col("leader_pos").alias("a_pos"), F.col("pos").alias("b_pos"))
    # Leaders of one list's salts are held against the first of them.
    tops = led.where("hot and node = leader").groupBy("s", "band").agg(F.min(F.struct("node", "n", "pos")).alias("top"))
    across = led.where("hot and node = leader").join(tops, ["s", "band"]).where(F.col("node") != F.col("top.node"))
    star = star.unionByName(across.select(F.col("top.node").alias("a"), F.col("node").alias("b"), F.col("top.n").alias("a_n"), F.col("n").alias("b_n"), F.col("top.pos").alias("a_pos"), F.col("pos").alias("b_pos")))
    links = settled(_verified(_alike(_reaching(star), sets), sets, docs, width), "links")
    near = settled(components(links), "near")

    # What is left: lists with documents of several components, by their heads.
    key = F.when(F.col("hot"), F.col("s")).otherwise(F.col("head")).alias("key")
    told = led.select("hot", key, "s", "node", "n", "band").join(near, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_lists = told.groupBy("hot", "key", "s").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("hot", "key", "s")
    rows = settled(told.join(open_lists, ["hot", "key", "s"]).select("hot", "key", "node", "n", "band", "component").distinct(), "open")
    # Only large groups are dealt by salts; there are few, and most rows have one.
    large = settled(rows.groupBy("hot", "key").agg(F.count("*").alias("members")).where(F.col("members") > GROUP_ROWS).select("hot", "key", F.ceil(F.col("members") / GROUP_ROWS).cast("int").alias("salts")), "large")
    large = F.broadcast(large) if large.count() <= BROADCAST_IDS else large
    cells = rows.join(large, ["hot", "key"], "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    cells = cells.withColumn("salt", F.pmod(F.hash("node"), F.col("salts")).cast("int")).join(sets.select(F.col("row").alias("node"), "bits"), "node")
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    cells = cells.select("hot", "key", F.least("salt", "other").alias("lo"), F.greatest("salt", "other").alias("hi"), "salt", "node", "n", "band", "component", "bits")
    more = cells.repartition(parts, "hot", "key", "lo", "hi").mapInArrow(lean(_cross), PAIRS).distinct()
    links = links.unionByName(settled(_verified(more, sets, docs, width), "more"))
    return sets, classes, settled(components(links), "components")


def named(sets: DataFrame, classes: DataFrame, near: DataFrame) -> DataFrame:
    """row, doc_id, text_key, n_shingles, node, class_id, component_id, copies."""
    least = near.join(classes.select("node", "class_id"), "node").groupBy("component").agg(F.min("class_id").alias("component_id"))
    linked_ = near.join(least, "component").select("node", "component_id")
    at = classes.join(linked_, "node", "left").select("set_key", "node", "class_id", "copies", F.coalesce("component_id", "class_id").alias("component_id"))
    rows = sets.select("row", "doc_id", "text_key", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_key")).alias("set_key")).join(at, "set_key", "left")
    alone = lambda c: F.when(F.col("n_shingles") > 0, F.col(c)).otherwise(F.col("doc_id")).alias(c)
    return rows.select("row", "doc_id", "text_key", "n_shingles", "node", alone("class_id"), alone("component_id"), "copies")


def joined(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id, a row a row of docs.

    class_id is the least doc_id with the same set, component_id the least that
    links reach. Documents link if 100 * intersection >= 75 * union of their
    sets of shingles. Without words, or with a null text, a document is in no
    class but its own. Rows of one doc_id, or without one, are documents of
    their own; a class or component of none but null ids has null. An empty
    table gives an empty result; other columns of docs may have any names.
    """
    return named(*compared(keyed(docs), width)).select("doc_id", "n_shingles", "class_id", "component_id")


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, links: a document's links in a cell, each counted as the rows of
    the other's class. Rows come in order of cells; one cell is held at a time."""

    def count(cell: list[tuple]) -> pa.RecordBatch:
        cell = list({r[3]: r for r in cell}.values())  # equal rows of docs come with one node
        nodes = np.array([r[3] for r in cell], np.int64)
        salt, weight = np.array([r[4] for r in cell]), np.array([r[5] for r in cell], np.int64)
        sets = [shingles(r[6], r[7]) for r in cell]
        n = np.array([len(v) for v in sets], np.int64)
        owner = np.repeat(np.arange(len(cell)), n)
        _, list_ = np.unique(np.concatenate(sets), return_inverse=True)
        owners, ends = owner[np.argsort(list_, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(list_))])
        apart, at, links = cell[0][1] != cell[0][2], np.concatenate([[0], np.cumsum(n)]), []
        for i in range(len(cell)):
            met = np.concatenate([owners[ends[k] : ends[k + 1]] for k in list_[at[i] : at[i + 1]]])
            fit = 7 * np.bincount(met, minlength=len(cell)) >= 3 * (n + n[i])
            fit &= (nodes != nodes[i]) & ((salt != salt[i]) if apart else True)
            links.append(int(weight[fit].sum()))
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(links, pa.int64())], ["node", "links"])

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][:3] != row[:3]:
                yield count(held)
                held = []
            held.append(row)
    if held:
        yield count(held)


def counted(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """joined() with n_links: how many other rows a document links with, those
    with the same set among them.

    Links are inside components, so the least rows of classes meet there, in
    cells of at most COUNT_ROWS by COUNT_ROWS; overlaps are counted on all
    inverted lists of a cell, and a link counts as the rows of the other's class.
    """
    spark: SparkSession = docs.sparkSession
    docs = keyed(docs)
    sets, classes, near = compared(docs, width)
    groups = near.groupBy("component").agg(F.count("*").alias("members"))
    large = settled(groups.where(F.col("members") > COUNT_ROWS).select("component", F.ceil(F.col("members") / COUNT_ROWS).cast("int").alias("salts")), "large")
    large = F.broadcast(large) if large.count() <= BROADCAST_IDS else large
    members = near.join(large, "component", "left").join(classes.select("node", "copies"), "node")
    members = settled(members.select("component", "node", "copies", F.coalesce("salts", F.lit(1)).alias("salts")), "members")
    cells = members.withColumn("salt", F.pmod(F.hash("node"), F.col("salts")).cast("int")).join(texts_of(members.select("node"), sets, docs), "node")
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    cells = cells.select("component", F.least("salt", "other").alias("lo"), F.greatest("salt", "other").alias("hi"), "node", "salt", "copies", "text", F.lit(width).alias("width"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = cells.repartition(parts, "component", "lo", "hi").sortWithinPartitions("component", "lo", "hi").mapInArrow(lean(_links), "node long, links long")
    found = settled(found, "counts").groupBy("node").agg(F.sum("links").alias("links"))
    held = named(sets, classes, near).join(found, "node", "left")
    links = F.when(F.col("n_shingles") > 0, F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(F.lit(0))
    return held.select("doc_id", "n_shingles", "class_id", "component_id", links.cast("long").alias("n_links"))


def representatives(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row of docs of each component, all columns: that of least doc_id
    (null ids last). Rows without words stay."""
    rows = settled(named(*compared(keyed(docs), width)), "rows").where("n_shingles > 0")
    group = F.coalesce(F.col("component_id"), F.col("node"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row"))
    kept = rows.groupBy(F.col("component_id").isNull().alias("unnamed"), group.alias("group")).agg(first.alias("first")).select(F.col("first.row").alias("row"), F.lit(1).alias("stays"))
    fate = rows.join(kept, "row", "left").groupBy("doc_id", "text_key").agg(F.sum("stays").alias("stay"), F.count("*").alias("equal"))
    fate = settled(fate.where("stay is null or equal > 1").select(F.struct("doc_id", "text_key", "stay").alias("fate")), "fate")
    fate = F.broadcast(fate) if fate.count() <= BROADCAST_IDS else fate
    held = docs.select(F.struct("*").alias("doc"), F.coalesce(F.xxhash64(F.col("text").cast("string")), F.lit(0)).alias("its_key"))
    held = held.join(fate, (F.col("fate.text_key") == F.col("its_key")) & F.col("fate.doc_id").eqNullSafe(F.col("doc.doc_id").cast("long")), "left")
    sure = held.where("fate is null").select("doc.*")
    # Of equal rows one stays.
    one = held.where("fate.stay is not null").withColumn("at", F.row_number().over(Window.partitionBy("fate.doc_id", "its_key").orderBy(F.xxhash64("doc")))).where("at = 1")
    return sure.unionByName(one.select("doc.*"))


def op4(docs: DataFrame) -> DataFrame:
    """A row a row of docs, as counted() gives it."""
    return counted(docs).select("doc_id", "n_shingles", "component_id", "class_id", "n_links")
