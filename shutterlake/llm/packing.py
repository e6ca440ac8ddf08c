"""Best-fit packing of documents into sequences, as vector bin packing.

A sequence has three capacities: tokens, documents, and attention cost (the sum
of squared lengths). A piece of a document demands (n, 1, n*n) of them, so what
a piece demands follows from its length alone, and the packing is decided on the
histogram of lengths (at most `tokens` rows, whatever the corpus): lengths in
decreasing order, each put into the open bins that fit under every constraint
and score best, by weighted residual norm (least) or weighted dot-product of
demand and residual (most). Bins with equal contents are one class with a
multiplicity; placing a length splits at most two classes, so there are at most
4 * tokens classes, and the plan is small.

The pieces then take the plan's places by their rank among pieces of their
length. Ranks are distributed: rows are numbered within hash blocks of about
`block_rows` and get the count of the blocks before, so a length that most
pieces have is spread over many tasks.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, settled, small_batches

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Words kept with their ids by each Python worker in each of two generations;
#: when the younger is full it becomes the older, whose words are met again or go.
CACHE_WORDS = 200_000
#: New words that are encoded at a time, and texts whose words are looked up together.
TOGETHER, TEXTS = 2000, 100

#: Letters of Latin-1, then marks of ASCII: a stretch of two pre-tokens at most.
PLAIN = re.compile(r"([A-Za-zªµºÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
#: How a tokenizer must split and normalize for its model to be asked about such
#: letters alone, in lower case, with a character for each byte.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters that stand for the bytes of Latin-1 letters.
BYTES = {c: "".join(chr(b if b > 0xA0 and b != 0xAD else 256 + (b - 0x80 + 34 if b < 0xAD else 67)) for b in chr(c).encode()) for c in range(0xAA, 0x100)}


class WordIds(dict):
    """uint32 ids of stretches of text without spaces or line feeds, as bytes.

    The tokenizer treats white space as a break that it drops, and none of its
    normalization looks across it, so a text's ids are those of its stretches
    in order. The test holds this against whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.tokenizer, self.older = Tokenizer.from_file(path), {}
        self.model = self.tokenizer.model if self._splits() else None
        self.four = [i.to_bytes(4, "little") for i in range(1 + max(self.tokenizer.get_vocab().values()))]

    def _splits(self) -> bool:
        """Whether PLAIN stretches may go to the model by themselves."""
        how = json.loads(self.tokenizer.to_str())
        normal, pre = how["normalizer"] or {}, how["pre_tokenizer"] or {}
        first, *others = pre.get("pretokenizers") or [{}]
        return (
            [n["type"] for n in normal.get("normalizers", ())] == NORMALIZERS
            and normal["normalizers"][1]["pattern"] == {"Regex": r"\s+"}
            and first.get("pattern") == {"Regex": SPLIT}
            and (first["behavior"], first["invert"]) == ("Removed", True)
            and [(o["type"], o["add_prefix_space"], o["use_regex"]) for o in others] == [("ByteLevel", False, False)]
            and how["post_processor"] is None
            and how["model"]["dropout"] is None
            and all(PLAIN.fullmatch(t["content"][:2]) is None for t in how["added_tokens"])
        )

    def _plain(self, low: str) -> bytes:
        """The ids of a run of PLAIN letters in lower case."""
        return b"".join([self.four[t.id] for t in self.model.tokenize(low if low.isascii() else low.translate(BYTES))])

    def learn(self, words: set[str]) -> None:
        """Sees to it that all these words are kept. New ones are encoded many at a time."""
        if len(self) > CACHE_WORDS:
            self.older = dict(self)
            self.clear()
            self[""] = b""
        new, marked, older, younger = [], [], self.older.get, self.get
        for word in words.difference(self):
            ids = older(word)
            if ids is None:
                if self.model is None or not (found := PLAIN.fullmatch(word)):
                    new.append(word)
                    continue
                letters, marks = found.groups()
                low = letters.lower()
                # The same letters may be known without marks and in lower case.
                if low == word or ((ids := younger(low)) is None and (ids := older(low)) is None):
                    ids = self._plain(low)
                if marks:
                    marked.append((word, marks))
            self[word] = ids
        new += {marks for _, marks in marked if marks not in self}.difference(new)
        for at in range(0, len(new), TOGETHER):
            part = new[at : at + TOGETHER]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            starts = np.cumsum([0, *(len(w) + 1 for w in part)])
            ids = np.array(found.ids, "<u4")
            # Pieces come in order, each with the place in the text where it begins.
            ends = np.searchsorted(np.array([o[0] for o in found.offsets], np.int64), starts[1:], "left")
            begin = 0
            for word, end in zip(part, ends.tolist(), strict=True):
                self[word] = ids[begin:end].tobytes()
                begin = end
        for word, marks in marked:
            self[word] += self[marks]


_caches: dict[str, WordIds] = {}


def texts_ids(texts: list[str], path: str) -> list[bytes]:
    """The ids of each text, as bytes."""
    cache = _caches.get(path) or _caches.setdefault(path, WordIds(path))
    split = [t.replace("\n", " ").split(" ") for t in texts]
    cache.learn(set().union(*split))
    return [b"".join(map(cache.__getitem__, words)) for words in split]


def text_ids(text: str, path: str) -> bytes:
    return texts_ids([text], path)[0]


def tokenized_pieces(docs: DataFrame, tokenizer: str, tokens: int, end_id: int = 0) -> DataFrame:
    """A row a piece: doc_id, piece, start, length, ids_crc32. A document's ids
    are its text's (null: none), then end_id; longer ones are cut into pieces of
    `tokens`, the last may be shorter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, step = np.array([end_id], "<u4").tobytes(), 4 * tokens
        for batch in batches:
            rows: list[tuple] = []
            for at in range(0, batch.num_rows, TEXTS):
                ids_of, texts = batch.column(0).slice(at, TEXTS).to_pylist(), batch.column(1).slice(at, TEXTS).to_pylist()
                for doc_id, ids in zip(ids_of, texts_ids([t or "" for t in texts], tokenizer), strict=True):
                    ids += end
                    rows += [(doc_id, k, place // 4, len(part) // 4, zlib.crc32(part)) for k, place in enumerate(range(0, len(ids), step)) for part in (ids[place : place + step],)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(cut), PIECES)


def best_fit(histogram: dict[int, int], tokens: int, documents: int, attention: int, weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rule: str = "residual_norm") -> tuple[np.ndarray, int]:
    """The plan and its number of sequences. Plan rows: length, first rank,
    first sequence, copies in each sequence, offset of the first copy, number of
    sequences, in order of length and first rank."""
    caps, w = np.array([tokens, documents, attention], float), np.array(weights)
    left = np.zeros((0, 3))  # of each class
    many: list[int] = []
    holds: list[list[tuple[int, int, int]]] = []  # (length, copies, first rank)

    def put(k: int, bins: int, length: int, copies: int, rank: int) -> None:
        """Puts copies into each of the first bins of class k; the rest is split off."""
        nonlocal left
        if bins < many[k]:
            left = np.vstack([left, left[k]])
            holds.append([(n, c, at + bins * c) for n, c, at in holds[k]])
            many.append(many[k] - bins)
        many[k] = bins
        holds[k].append((length, copies, rank))
        left[k] -= copies * np.array([length, 1, length * length], float)

    for length in sorted(histogram, reverse=True):
        need, rank, count = np.array([length, 1, length * length], float), 0, histogram[length]
        if (need > caps).any():
            raise ValueError(f"a piece of {length} tokens is over a capacity of {tuple(caps)}")
        while count:
            if len(fits := np.flatnonzero((left >= need).all(axis=1))):
                rest, want = left[fits] / caps, need / caps
                score = (w * (rest - want) ** 2).sum(axis=1) if rule == "residual_norm" else -(w * rest * want).sum(axis=1)
                k = int(fits[np.argmin(score)])
            else:
                k, room = len(many), int((caps // need).min())
                left, bins = np.vstack([left, caps]), -(-count // room)
                many.append(bins)
                holds.append([])
            room = int((left[k] // need).min())
            full = min(many[k], count // room)
            if full:
                put(k, full, length, room, rank)
                rank, count = rank + full * room, count - full * room
            else:
                put(k, 1, length, count, rank)
                rank, count = rank + count, 0
    rows, first = [], 0
    for bins, content in zip(many, holds, strict=True):
        offset = 0
        for length, copies, rank in content:
            rows.append((length, rank, first, copies, offset, bins))
            offset += length * copies
        first += bins
    plan = np.array(sorted(rows), np.int64).reshape(-1, 6)
    assert all(a[0] < b[0] or a[1] + a[3] * a[5] == b[1] for a, b in pairwise(plan.tolist()))
    return plan, first


def packed(pieces: DataFrame, tokens: int, documents: int | None = None, attention: int | None = None, block_rows: int = 4096, **how) -> DataFrame:
    """pieces (doc_id, piece, length, ...), settled, with sequence_id (long, from
    0) and offset (long). Rows equal in doc_id and piece are interchangeable. An
    empty table gives an empty result. None: no limit beside tokens. Other
    columns may have any names but those two."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `tokens` rows
    plan, _ = best_fit(counts, tokens, documents or tokens, attention or tokens * tokens, **how)
    blocks = max(1, -(-sum(counts.values()) // block_rows))
    dealt = pieces.select(F.struct("*").alias("row"), F.col("length").alias("length"), F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)).alias("block"))
    sizes = dealt.groupBy("length", "block").agg(F.count("*").alias("n"))
    sizes = sizes.select("length", "block", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    own = F.row_number().over(Window.partitionBy("length", "block").orderBy("row.doc_id", "row.piece"))
    # The rank comes last, under a name that pieces don't have.
    ranked = dealt.join(sizes, ["length", "block"]).withColumn("rank", F.col("earlier") + own - 1).select("row.*", F.col("rank").alias("rank" + max(pieces.columns, key=len)))
    at = pieces.columns.index("length")
    keys = (plan[:, 0] << 44) + plan[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = np.asarray(batch.column(at)), np.asarray(batch.column(batch.num_columns - 1))
            row = plan[np.searchsorted(keys, (length << 44) + rank, "right") - 1]
            which = rank - row[:, 1]
            columns = [batch.column(i) for i in range(len(batch.schema.names) - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(row[:, 2] + which // row[:, 3]), pa.array(row[:, 4] + which % row[:, 3] * length)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    schema = T.StructType(list(pieces.schema.fields)).add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(lean(place), schema)


def pack_documents(docs: DataFrame, tokenizer: str, tokens: int = 2048, documents: int | None = None, attention: int | None = None, **how) -> DataFrame:
    """Null texts are empty: one end token. No document is left out."""
    longest = min(tokens, math.isqrt(attention)) if attention else tokens
    return packed(settled(tokenized_pieces(docs, tokenizer, longest), "pieces"), tokens, documents, attention, **how)


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op2(docs: DataFrame) -> DataFrame:
    """Every piece with its place. Repeated rows have pieces each; an empty table
    gives an empty result; other columns of docs are left out."""
    return pack_documents(docs, tokenizer_path())
