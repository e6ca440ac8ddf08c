"""Language identification by compression.

For each language a raw-content zstandard dictionary is cut from labelled texts
of a bounded sample. A text is compressed with each dictionary; the language
whose dictionary leaves the fewest bytes is predicted. Where the second is
nearly as small the prediction is marked as rejected.

Texts are reduced to lower-case words first, since case, digits and marks say
little about a language, and are compressed whole, in chunks, so that a long
text is held against the dictionary all along and not against its own start.
Very short texts come out alike, since zstandard stores them as they are; where
the margin is narrow a text is compressed once more behind a passage of each
dictionary, and counts as what it adds to that passage.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches

#: Bounds of the labelled sample: rows a language (expected), bytes of its dictionary.
SAMPLE_ROWS, DICTIONARY_BYTES = 800, 112 << 10
LEVEL, CHUNK = 6, 4096
#: Bytes of a dictionary's middle that a text is put behind for the second look.
PASSAGE = 500
#: Least share of the second-best size that the best must save.
MARGIN = 0.01
UNKNOWN = "und"

RESULT = "lang_pred string, score double, margin double, accepted boolean"
_NOT_WORDS = re.compile(r"[\W\d_]+")


def reduced(text: str) -> bytes:
    return f" {_NOT_WORDS.sub(' ', text.lower()).strip()} ".encode("utf-8", "replace")


@dataclass
class Model:
    """languages, most frequent first (ties in size go to the first), and their dictionaries."""

    languages: list[str]
    dictionaries: list[bytes]

    def compressors(self) -> list[tuple]:
        """Of each language: a compressor, a passage, and the passage's size compressed."""
        import zstandard as Z

        found = []
        for content in self.dictionaries:
            if len(content) < 8:  # too little to be a dictionary
                run = Z.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
            else:
                held = Z.ZstdCompressionDict(content, dict_type=Z.DICT_TYPE_RAWCONTENT)
                held.precompute_compress(level=LEVEL)
                run = Z.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)
            passage = content[len(content) // 2 :][:PASSAGE]
            found.append((run, passage, len(run.compress(passage))))
        return found


def _best(sizes: list[int]) -> tuple[int, float]:
    """The first of the least, and the share of the second that it saves."""
    k = sizes.index(min(sizes))
    second = min([s for i, s in enumerate(sizes) if i != k], default=None)
    return k, 1.0 if second is None else (second - sizes[k]) / max(second, 1)


def predict(text: str | None, languages: list[str], compressors: list[tuple], margin: float = MARGIN) -> tuple[str, float, float, bool]:
    """Language, score (two to the minus bytes over the best, as a share of all
    languages'), margin and whether it is wide enough. `und`, 0, 0 and false for
    texts without letters, or without languages to choose from."""
    if not text or not languages or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0, 0.0, False
    words = reduced(text)
    sizes = [sum(len(c.compress(words[at : at + CHUNK])) for at in range(0, len(words), CHUNK)) for c, _, _ in compressors]
    k, saved = _best(sizes)
    if saved < margin:
        sizes = [sum(len(c.compress(passage + words[at : at + CHUNK])) - alone for at in range(0, len(words), CHUNK)) for c, passage, alone in compressors]
        k, saved = _best(sizes)
    score = 1 / sum(2.0 ** max(-60, sizes[k] - s) for s in sizes)
    return languages[k], score, saved, saved >= margin


def fit(labelled: DataFrame) -> Model:
    """From columns doc_id, text, lang. Rows of null text or lang are left out.
    The sample: about SAMPLE_ROWS rows a language, all if there are fewer, by a
    hash of doc_id; of these in order of the hash, without repeated texts, those
    that fit whole into DICTIONARY_BYTES. The last bytes of a dictionary are the
    cheapest to refer to, so the first rows of the sample go there."""
    rows = labelled.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null and length(text) > 0")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # as many rows as languages
    if not counts:
        return Model([], [])
    share = F.coalesce(*(F.when(F.col("lang") == k, F.lit(SAMPLE_ROWS / n)) for k, n in counts.items() if n > SAMPLE_ROWS), F.lit(1.0))
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    sample = rows.where(at < share * (1 << 30)).where(F.octet_length("text") <= DICTIONARY_BYTES).select("lang", at.alias("at"), "text").collect()
    texts: dict[str, list[bytes]] = {k: [] for k in counts}
    for r in sorted(sample, key=lambda r: (r["at"], r["text"])):
        words = reduced(r["text"])
        held = texts[r["lang"]]
        if words not in held and sum(map(len, held)) + len(words) <= DICTIONARY_BYTES:
            held.append(words)
    languages = sorted(counts, key=lambda k: (-counts[k], k))
    return Model(languages, [b"".join(reversed(texts[k])) for k in languages])


def identified(model: Model, text: Column, margin: float = MARGIN) -> Column:
    """struct of RESULT for a text column."""

    @F.pandas_udf(RESULT)
    @lean
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compressors = model.compressors()
        for texts in batches:
            yield pd.DataFrame([predict(t, model.languages, compressors, margin) for t in texts], columns=[c.split()[0] for c in RESULT.split(", ")])

    return run(text)


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of its id as text is a multiple
    of 5. A null id counts as held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def learned(docs: DataFrame) -> Model:
    return fit(docs.where(~held_out(F.col("doc_id"))))


def op7(docs: DataFrame) -> DataFrame:
    """A prediction a row. Texts that are null, or have no letter, are `und`;
    equal texts are told alike, ties go to the more frequent language; without
    labelled rows every text is `und`. An empty table gives an empty result;
    other columns may have any names."""
    found = small_batches(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), identified(learned(docs), F.col("text").cast("string")).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score", "found.margin", "found.accepted")


def keep_identified(docs: DataFrame, margin: float = MARGIN) -> DataFrame:
    """The rows whose language is told with a wide enough margin, all columns.
    Texts that are null or without letters go; so do narrow margins. Learns from
    the labelled rows that are not held out; without any, nothing is told and
    all rows stay."""
    model = learned(docs)
    if not model.languages:
        return docs
    return small_batches(docs).where(identified(model, F.col("text").cast("string"), margin).getField("accepted"))
