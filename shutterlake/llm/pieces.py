"""N-best SentencePiece segmentation by backward A-star over the piece lattice.

The lattice of a stretch of text has a node a character and an edge a piece. A
forward Viterbi pass gives each node the score of its best prefix, which is the
exact heuristic for a search from the end: paths leave the queue in order of
their total score, so the first n that reach the start are the n best. Since
every path in the queue is one more whole path of just its score, the queue
needs no more entries than paths are still wanted.

No piece has a space mark after another character, so a text's lattice falls
into words (with the spaces before them). Words not met yet are solved together,
a position of all of them at a time: the forward pass keeps the two best scores
of each node. Of a text only the n - 1 words that lose least by their second best
can differ from the best in its n best, and only these are searched.

The vocabulary file holds the order of BPE merges, no probabilities. Scores here
are logarithms of 1 / ((r + OFFSET) H), the law of Zipf and Mandelbrot for the
piece of rank r in that order (H makes them sum to 1), in units of 1/1024, so that
sums are exact. So the best path is the likeliest segmentation and common words
are whole; it need not be the library's own, which merges pairs greedily. Characters without a piece fall back
to the pieces of their UTF-8 bytes.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

SPACE = "▁"
#: What an unknown character costs below the lowest piece.
UNKNOWN_COST = 10.0
UNIT = 1024
#: Flattens the law at its head: early merges are mostly parts of later ones.
OFFSET = 256
#: Words kept in each of two generations (when the younger is full it becomes the
#: older, whose words are met again or go), and words searched for n.
CACHE, SEARCHED = 300_000, 20_000
#: Characters of a word that is solved with others, words in a block.
SOLVED, BLOCK = 48, 8192
#: Characters of texts that are taken together.
GROUP = 1 << 20

Path = tuple[int, bytes, int]  # score in units, ids as uint32, number of pieces

_LOW = -(1 << 60)
_U = np.uint64
_RADIX = 0x9E3779B97F4A7C15


def _powers(radix: int) -> np.ndarray:
    return np.array([pow(radix, k, 1 << 64) for k in range(SOLVED + 1)], _U)


_UP, _DOWN = _powers(_RADIX), _powers(pow(_RADIX, -1, 1 << 64))


class Lattices:
    """Searches of one vocabulary file, with the words met so far."""

    def __init__(self, path: str, n: int):
        import sentencepiece

        self.processor = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n, self.score, self.ids, merges = n, {}, {}, {}
        self.bytes_ = {}
        self.text = [b""] * sp.get_piece_size()
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes_[int(piece[3:5], 16)] = i
                self.text[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                merges[piece], self.ids[piece] = sp.get_score(i), np.array([i], "<u4").tobytes()
                self.text[i] = piece.replace(SPACE, " ").encode()
        total = math.log(sum(1 / (r + OFFSET) for r in range(len(merges))))
        order = sorted(merges, key=lambda p: (-merges[p], self.ids[p]))
        self.score = {p: -round(UNIT * (math.log(r + OFFSET) + total)) for r, p in enumerate(order)}
        self.longest = max(map(len, self.score))
        self.unknown = min(self.score.values()) - round(UNIT * UNKNOWN_COST)
        self.by_lines = not any("\n" in p for p in self.score)
        #: Scores of pieces; None of what only begins pieces.
        self.table = {p[:k]: None for p in self.score for k in range(1, len(p))} | self.score
        self.words: dict[str, tuple[int, bytes, int, float]] = {}
        self.older: dict[str, tuple[int, bytes, int, float]] = {}
        self.searched: dict[str, list[Path]] = {}
        self._hashed()

    def _hashed(self) -> None:
        """Tables of the pieces' hashes: a first slot, or for the few that meet there a second."""
        pieces = [p for p in self.score if len(p) <= SOLVED]
        codes = [np.frombuffer(p.encode("utf-32-le"), "<u4").astype(_U) + _U(1) for p in pieces]
        key = np.array([int((c * _UP[: len(c)]).sum(dtype=_U)) for c in codes], _U)
        assert len(np.unique(key)) == len(key)
        #: Of the last entry: no piece.
        self.key = np.append(key, _U(0))
        self.value = np.array([self.score[p] for p in pieces] + [_LOW], np.int64)
        self.id = np.array([int(np.frombuffer(self.ids[p], "<u4")[0]) for p in pieces] + [0], np.uint32)
        self.first, self.second = (np.full(1 << 20, len(pieces), np.int32) for _ in range(2))
        for k, (a, b) in enumerate(zip(*self._slots(key), strict=True)):
            if self.first[a] == len(pieces):
                self.first[a] = k
            else:
                assert self.second[b] == len(pieces)
                self.second[b] = k

    @staticmethod
    def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = h * _U(0xD6E8FEB86659FD93)
        return (h >> _U(44)).astype(np.int64), ((h >> _U(24)) & _U((1 << 20) - 1)).astype(np.int64)

    def _solve(self, words: list[str]) -> None:
        """Puts words of at most SOLVED characters, of about one length, among those kept."""
        long = np.array([len(w) for w in words])
        size, many = int(long.max()), len(words)
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        owner = np.repeat(np.arange(many), long)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(long) - long, long)
        codes = np.zeros((size, many), _U)
        codes[place, owner] = flat.astype(_U) + _U(1)
        total = np.zeros((size + 1, many), _U)
        np.cumsum(codes * _UP[:size, None], axis=0, out=total[1:])
        best, next_ = np.full((size + 1, many), _LOW, np.int64), np.full((size + 1, many), _LOW, np.int64)
        best[0] = 0
        back, entry = np.zeros((size + 1, many), np.int64), np.zeros((size + 1, many), np.int64)
        none = len(self.key) - 1
        for j in range(1, size + 1):
            one, two, at, by = best[j], next_[j], back[j], entry[j]
            for k in range(1, min(self.longest, j) + 1):
                i = j - k
                h = (total[j] - total[i]) * _DOWN[i]
                a, b = self._slots(h)
                found = self.first[a]
                miss = np.flatnonzero(self.key[found] != h)
                other = self.second[b[miss]]
                found[miss] = np.where(self.key[other] == h[miss], other, none)
                value = self.value[found]
                if k == 1:
                    value = np.where(found == none, self.unknown, value)
                    live = None
                else:
                    live = np.flatnonzero(found != none)
                    if not len(live):
                        continue
                    value, found = value[live], found[live]
                cut = slice(None) if live is None else live
                c, d = best[i][cut] + value, next_[i][cut] + value
                was, then = one[cut], two[cut]
                two[cut] = np.maximum(np.minimum(was, c), np.maximum(then, d))
                better = c > was
                one[cut] = np.where(better, c, was)
                at[cut] = np.where(better, k, at[cut])
                by[cut] = np.where(better, found, by[cut])
        every = np.arange(many)
        score, then = best[long, every], next_[long, every]
        steps, node, strange = [], long.copy(), np.zeros(many, bool)
        while node.any():
            e = np.where(node > 0, entry[node, every], -1)
            strange |= e == none
            steps.append(e)
            node = node - np.where(node > 0, back[node, every], 0)
        made = np.array(steps)
        pieces = (made >= 0).sum(axis=0)
        ends = np.cumsum(pieces)
        step, word = np.nonzero(made >= 0)
        ids = np.empty(int(ends[-1]), "<u4")
        ids[ends[word] - 1 - step] = self.id[made[step, word]]
        ids, ends = ids.tobytes(), (4 * ends).tolist()
        lost = np.where(then > _LOW // 2, score - then, -1).tolist()
        begin = 0
        for w, s, end, p, gap, odd in zip(words, score.tolist(), ends, pieces.tolist(), lost, strange.tolist(), strict=True):
            own = ids[begin:end]
            begin = end
            if odd:
                s, own, p = self.search(w, 1)[0]
            self.words[w] = (s, own, p, gap if gap >= 0 else math.inf)

    def learn(self, words: set[str]) -> None:
        """Sees to it that all these words are among those kept."""
        if len(self.words) > CACHE:
            self.older, self.words = self.words, {}
        new = []
        for w in words:
            if w not in self.words:
                if (held := self.older.get(w)) is None:
                    new.append(w)
                else:
                    self.words[w] = held
        new.sort(key=len)
        short = [w for w in new if len(w) <= SOLVED]
        for at in range(0, len(short), BLOCK):
            self._solve(short[at : at + BLOCK])
        for w in new[len(short) :]:
            two = self.search(w, 2)
            self.words[w] = (*two[0], two[0][0] - two[1][0] if len(two) > 1 else math.inf)

    def fallback(self, char: str) -> bytes:
        return np.array([self.bytes_[b] for b in char.encode("utf-8", "surrogatepass")], "<u4").tobytes()

    def search(self, text: str, n: int) -> list[Path]:
        """The n best paths of a stretch, best first; equal scores in order of
        discovery, which depends on the stretch alone."""
        get, size, lowest, unknown = self.table.get, len(text), _LOW, self.unknown
        best, ending = [0] + [lowest] * size, [[] for _ in range(size + 1)]
        for i in range(size):
            at = best[i]
            for j in range(i + 1, size + 1):
                s = get(text[i:j], lowest)
                if s is None or s == lowest:
                    if j == i + 1:
                        ending[j].append((i, unknown))
                        if at + unknown > best[j]:
                            best[j] = at + unknown
                    if s is None:
                        continue
                    break
                ending[j].append((i, s))
                if at + s > best[j]:
                    best[j] = at + s
        found: list[Path] = []
        queue, made = [(-best[size], 0, size, 0, None)], 0
        while queue and len(found) < n:
            _, _, node, done, path = queue.pop(0)
            if not node:
                ids, at = [], 0
                while path:
                    end, path = path
                    piece = text[at:end]
                    ids.append(self.ids.get(piece) or self.fallback(piece))
                    at = end
                whole = b"".join(ids)
                found.append((done, whole, len(whole) // 4))
                continue
            room, path = n - len(found), (node, path)
            for i, s in ending[node]:
                made += 1
                total = -(done + s + best[i])
                if len(queue) < room or total < queue[-1][0]:
                    insort(queue, (total, made, i, done + s, path))
                    del queue[room:]
        return found

    def whole(self, word: str) -> list[Path]:
        """The n best paths of a word."""
        if (got := self.searched.get(word)) is None:
            if len(self.searched) >= SEARCHED:
                self.searched.clear()
            got = self.search(word, self.n)
            if len(word) <= SOLVED:
                self.searched[word] = got
        return got

    def split(self, text: str) -> list[str]:
        """Words with the spaces before them, marked; line feeds by themselves,
        since no piece holds one."""
        if not text:
            return []
        if not self.by_lines or SPACE in text or "  " in text or text[0] == " ":
            return re.findall(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+" if self.by_lines else f"{SPACE}*[^{SPACE}]+|{SPACE}+", SPACE + text.replace(" ", SPACE))
        words: list[str] = []
        for n, line in enumerate(text.split("\n")):
            if n:
                words.append("\n")
            first, *rest = line.split(" ")
            if first := first if n else SPACE + first:
                words.append(first)
            words += [SPACE + w for w in rest]
        return words

    def together(self, words: list[str]) -> list[Path]:
        """The n best paths of a text's words, which are kept; of equal scores
        first those that change earlier words less. Of no words the empty path."""
        if not words:
            return [(0, b"", 0)]
        score, ids, pieces, losses = (list(c) for c in zip(*map(self.words.__getitem__, words), strict=True))
        chosen = heapq.nsmallest(self.n - 1, zip(losses, range(len(words)), strict=True))
        choices: list[tuple[int, tuple]] = [(0, ())]
        for lost, k in sorted(chosen, key=lambda x: x[1]):
            if lost < math.inf:
                paths = self.whole(words[k])
                # Of equal paths the kept one may be another than the search's first.
                _, ids[k], pieces[k] = paths[0]
                choices = heapq.nsmallest(self.n, ((less + paths[0][0] - p[0], (*at, (k, p)) if c else at) for less, at in choices for c, p in enumerate(paths)))
        total, count, out = sum(score), sum(pieces), []
        for lost, at in choices:
            row, more = ids, count
            if at:
                row = ids.copy()
                for k, p in at:
                    row[k] = p[1]
                    more += p[2] - pieces[k]
            out.append((total - lost, b"".join(row), more))
        return out

    def best(self, text: str) -> list[Path]:
        """The n best paths of a text, fewer if there are not so many; of an
        empty text the empty path alone."""
        words = self.split(text)
        self.learn(set(words))
        return self.together(words)

    def decode(self, ids: bytes) -> str:
        """The pieces' text; a space that only marks the beginning is left out."""
        whole = b"".join(map(self.text.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return whole[whole[:1] == b" " :].decode("utf-8", "replace")

_open: dict[tuple[str, int], Lattices] = {}

PATHS = "rank int, n_pieces long, score double, ids_crc32 long, ids array<int>, decoded boolean"


def encoded(docs: DataFrame, path: str, n: int, with_ids: bool = True) -> DataFrame:
    """doc_id and PATHS: a row for each of a text's n best segmentations, rank
    from 1. Null texts are empty and have one, of no pieces. decoded: whether
    the pieces give the text back (U+2581 as a space, which is what it stands
    for). Repeated rows are encoded each. ids is null without with_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _open.get((path, n)) or _open.setdefault((path, n), Lattices(path, n))
        for batch in batches:
            group: list[tuple[int | None, str, list[str]]] = []
            waiting = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                group.append((doc_id, text, held.split(text)))
                waiting += len(text)
                if waiting > GROUP:
                    yield _batch(list(_rows(held, group, with_ids)))
                    group, waiting = [], 0
            if group:
                yield _batch(list(_rows(held, group, with_ids)))

    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, {PATHS}")


def _rows(held: Lattices, group: list[tuple[int | None, str, list[str]]], with_ids: bool) -> Iterator[tuple]:
    held.learn({w for _, _, words in group for w in words})
    for doc_id, text, words in group:
        plain = text.replace(SPACE, " ")
        for rank, (score, ids, pieces) in enumerate(held.together(words), 1):
            yield doc_id, rank, pieces, score / UNIT, zlib.crc32(ids), np.frombuffer(ids, "<i4") if with_ids else None, held.decode(ids) == plain


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.int32()), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["doc_id", *(c.split()[0] for c in PATHS.split(", "))])


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """rows (doc_id, ids) with their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _open.get((path, 1)) or _open.setdefault((path, 1), Lattices(path, 1))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([held.decode(np.array(x, "<u4").tobytes()) if x else "" for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def model_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op8(docs: DataFrame, n: int = 3) -> DataFrame:
    """The n best segmentations of every row. An empty table gives an empty
    result; other columns of docs are left out, whatever their names."""
    return encoded(docs, model_path(), n, with_ids=False).drop("ids")
