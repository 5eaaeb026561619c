"""SentencePiece encoding and decoding by a streaming Viterbi search.

Encoding picks the pieces with the largest sum of scores. The search keeps a window of
positions bounded by the longest piece and commits ids whenever the backpointer paths of
all positions that are still reachable meet in one boundary. Where no piece can reach
across (before each word's mark, if the vocabulary has no mark inside a piece), paths
always meet; stretches between such boundaries are searched once and remembered, and
those within the window many at a time, in step.
Characters without a piece become byte pieces. The library only reads the vocabulary file.

Defined results: null text has no ids and decodes to the empty text, as does an empty
one. Any other text decodes to itself, the word mark's own character included, because
that character is always written in bytes. Equal sums go to the longer last piece. Rows are
independent: repeated rows, null ids and extra columns are no special cases.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adpace.llm.common import map_columns, table

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Stretches remembered per task.
MEMORY = 200_000
#: A stretch of at most so many characters is searched at once.
WINDOW = 64
#: An unknown character costs this much more than the worst piece.
UNKNOWN_COST = 10.0

_ABSENT = object()
_ODD = 0x9E3779B97F4A7C15
#: Characters of stretches that are searched together, and of texts that are encoded together.
CELLS = 1 << 18
TOGETHER = 1 << 20


def packed_ids(ids: list[int]) -> bytes:
    """Ids as 32-bit numbers, one after another."""
    return np.array(ids, dtype=np.int32).tobytes()


def unpacked_ids(packed: bytes) -> list[int]:
    return np.frombuffer(packed, dtype=np.int32).tolist()


@dataclass
class Vocabulary:
    """Pieces by text with id and score, and the ids of single bytes."""

    ids: dict[str, int]
    scores: dict[str, float]
    bytes_: list[int]
    texts: list[str] = field(default_factory=list)
    unknown: int = 0

    def __post_init__(self):
        self.longest = max(map(len, self.ids), default=1)
        self.worst = min(self.scores.values(), default=0.0) - UNKNOWN_COST
        #: Every proper start of a piece: a search stops where no piece goes on.
        self.starts = {p[:n] for p in self.ids for n in range(1, len(p))}
        #: Pieces with their scores, and every proper start of a piece with none.
        self.trie = dict.fromkeys(self.starts) | self.scores
        self.cuts_at_mark = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.byte_of = {piece: b for b, piece in enumerate(self.bytes_)}
        self._table: Table | None = None

    def table(self) -> Table:
        if self._table is None:
            self._table = Table(self)
        return self._table


class Table:
    """The pieces and their proper starts by 64-bit key, to search many short stretches in step."""

    def __init__(self, vocabulary: Vocabulary):
        self.bytes_ = vocabulary.bytes_
        self.ascii_ids = np.array(vocabulary.bytes_[:128], dtype=np.int32)
        self.worst = vocabulary.worst
        nodes = list(vocabulary.trie)
        keys = np.array([self._key(x) for x in nodes], dtype=np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one key")
        scores = [vocabulary.scores.get(x, -math.inf) for x in nodes]
        self.scores = np.array(scores, dtype=float)[order]
        self.ids = np.array([vocabulary.ids.get(x, -1) for x in nodes], dtype=np.int32)[order]

    @staticmethod
    def _key(text: str) -> int:
        key = 0
        for c in text:
            key = (key * _ODD + ord(c) + 1) % (1 << 64)
        return key

    def _edges(self, points: np.ndarray, lengths: np.ndarray):
        """``row, start, size, score, id`` of every piece in every stretch, and single characters without one."""
        rows, starts = np.nonzero(np.arange(points.shape[1]) < lengths[:, None])
        key = np.zeros(len(rows), dtype=np.uint64)
        size = 0
        while len(rows):
            size += 1
            key = key * np.uint64(_ODD) + points[rows, starts + size - 1] + np.uint64(1)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[at] == key
            score = np.where(found, self.scores[at], -np.inf)
            ids = np.where(found, self.ids[at], -1)
            if size == 1:
                score = np.where(np.isneginf(score), self.worst, score)
            real = score > -np.inf
            yield rows[real], starts[real], np.full(int(real.sum()), size), score[real], ids[real]
            on = found & (starts + size < lengths[rows])
            rows, starts, key = rows[on], starts[on], key[on]

    def search(self, stretches: list[str]) -> list[bytes]:
        """Packed ids of each stretch: sums grow by end position, longer pieces first, so equal sums keep them."""
        n, longest = len(stretches), max(map(len, stretches))
        lengths = np.array([len(s) for s in stretches])
        flat = np.frombuffer("".join(s.ljust(longest, "\x00") for s in stretches).encode("utf-32-le"), dtype=np.uint32)
        points = flat.reshape(n, longest).astype(np.uint64)
        row, start, size, score, ids = (np.concatenate(x) for x in zip(*self._edges(points, lengths)))
        end = start + size
        # By end, then from the longest piece to the shortest; at most WINDOW * (WINDOW + 1) groups.
        group = (end * (longest + 1) - size).astype(np.int16)
        order = np.argsort(group, kind="stable")
        group = group[order]
        borders = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
        sums = np.full((n, longest + 1), -np.inf)
        sums[:, 0] = 0.0
        back = np.zeros((n, longest + 1), dtype=np.int32)
        piece = np.full((n, longest + 1), -1, dtype=np.int32)
        for a, b in zip(borders[:-1], borders[1:]):
            own = order[a:b]  # one end and one size: each stretch once
            r, e = row[own], end[own[0]]
            total = sums[r, start[own]] + score[own]
            better = total > sums[r, e]
            r, own = r[better], own[better]
            sums[r, e], back[r, e], piece[r, e] = total[better], start[own], ids[own]
        return self._paths(stretches, points, lengths, back, piece)

    def _paths(
        self, stretches: list[str], points: np.ndarray, lengths: np.ndarray, back: np.ndarray, piece: np.ndarray
    ) -> list[bytes]:
        """Walk all best paths back in step; column ``k`` holds each path's piece ``k`` from its end."""
        n = len(stretches)
        columns, wide = [], np.zeros(n, dtype=bool)
        rows, at = np.arange(n), lengths
        while len(rows):
            ids, before = piece[rows, at], back[rows, at]
            bare = np.flatnonzero(ids < 0)
            code = points[rows[bare], before[bare]]
            wide[rows[bare[code >= 128]]] = True
            ids[bare] = self.ascii_ids[np.minimum(code, 127)]
            column = np.full(n, -1, dtype=np.int32)
            column[rows] = ids
            columns.append(column)
            on = before > 0
            rows, at = rows[on], before[on]
        grid = np.stack(columns[::-1], axis=1)
        held = grid >= 0
        packed = grid[held].tobytes()
        ends = (np.cumsum(held.sum(axis=1)) * 4).tolist()
        out = [packed[a:b] for a, b in zip([0, *ends], ends)]
        for i in np.flatnonzero(wide).tolist():  # characters of several bytes
            out[i] = self._path(stretches[i], back[i].tolist(), piece[i].tolist())
        return out

    def _path(self, text: str, back: list[int], piece: list[int]) -> bytes:
        found: list[int] = []
        at = len(text)
        while at:
            if piece[at] >= 0:
                found.append(piece[at])
            else:
                found += [self.bytes_[b] for b in reversed(text[back[at] : at].encode())]
            at = back[at]
        return packed_ids(found[::-1])


def load(path: str = MODEL_PATH) -> Vocabulary:
    """Read a vocabulary file, on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, scores, texts = {}, {}, []
    bytes_ = [0] * 256
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        special = model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
        texts.append("" if special or model.is_byte(i) else piece.replace(MARK, " "))
        if model.is_byte(i):
            bytes_[int(piece[3:5], 16)] = i
        elif not special:
            ids[piece] = i
            scores[piece] = model.get_score(i)
    return Vocabulary(ids, scores, bytes_, texts, model.unk_id())


class Encoder:
    """Encodes texts with one vocabulary; remembers what it has searched."""

    def __init__(self, vocabulary: Vocabulary, memory: int = MEMORY):
        self.vocabulary = vocabulary
        self.memory = memory
        #: Packed ids of stretches within the window.
        self.known: dict[str, bytes] = {}
        self.stretches = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+") if vocabulary.cuts_at_mark else re.compile("(?s:.+)")

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if MARK not in text:
            return self._stretches(MARK + text.replace(" ", MARK))
        # The mark's own character could not be told from a space later, so it is written in bytes.
        mark_bytes = [self.vocabulary.bytes_[b] for b in MARK.encode()]
        first, *rest = text.split(MARK)
        out = self._stretches(MARK + first.replace(" ", MARK))
        for part in rest:
            out += mark_bytes + self._stretches(part.replace(" ", MARK))
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Packed ids of several texts; the stretches new to this task are searched together."""
        split = [[] if not t or MARK in t else self.stretches.findall(MARK + t.replace(" ", MARK)) for t in texts]
        known = self.known
        distinct = set().union(*split)
        new = [s for s in distinct if s not in known]
        if len(known) + len(new) > self.memory:
            known.clear()
            new = list(distinct)
        self._search_together(sorted((s for s in new if len(s) <= WINDOW), key=len))
        long = [s for s in new if len(s) > WINDOW]
        known.update((s, packed_ids(self._search_long(s))) for s in long)
        out = [
            b"".join(map(known.__getitem__, stretches)) if stretches else None for stretches in split
        ]
        for s in long:
            del known[s]
        return [packed_ids(self.encode(t)) if ids is None else ids for t, ids in zip(texts, out)]

    def _search_long(self, text: str) -> list[int]:
        return [i for part in self.commits(text) for i in part] if len(text) > WINDOW else self._search(text)

    def _search_together(self, stretches: list[str]) -> None:
        """Remember the ids of stretches, given by length, each within the window."""
        at = 0
        while at < len(stretches):
            # Stretches of like length, about CELLS characters of them.
            upto = at + max(1, CELLS // len(stretches[at]))
            part = stretches[at:upto]
            while len(part) > 1 and len(part) * len(part[-1]) > 2 * CELLS:
                part = part[: len(part) // 2]
            at += len(part)
            self.known.update(zip(part, self.vocabulary.table().search(part)))

    def _stretches(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.known
        for stretch in self.stretches.findall(text):
            packed = known.get(stretch)
            if packed is None:
                ids = self._search_long(stretch)
                if len(stretch) <= WINDOW:
                    if len(known) >= self.memory:
                        known.clear()
                    known[stretch] = packed_ids(ids)
            else:
                ids = unpacked_ids(packed)
            out += ids
        return out

    def _search(self, text: str) -> list[int]:
        """Ids of a stretch that is no longer than the window: one commit at its end."""
        n = len(text)
        find, worst = self.vocabulary.trie.get, self.vocabulary.worst
        sums, back = [-math.inf] * (n + 1), [0] * (n + 1)
        sums[0] = 0.0
        for at in range(n):
            here = sums[at]
            if (score := find(text[at], worst)) is None:
                score = worst
            end = at + 1
            while True:
                if score is not None and here + score > sums[end]:
                    sums[end], back[end] = here + score, at
                end += 1
                if end > n or (score := find(text[at:end], _ABSENT)) is _ABSENT:
                    break
        return self._path(text, back, 0, n)

    def commits(self, text: str) -> Iterator[list[int]]:
        """Ids of the best path, in parts, each as soon as all surviving paths agree on it."""
        v = self.vocabulary
        ids, scores, starts = v.ids, v.scores, v.starts
        # best[p]: the best sum up to position p since the last commit, and where its last piece starts.
        base = 0
        best: dict[int, tuple[float, int]] = {0: (0.0, -1)}
        for at in range(len(text)):
            sum_here = best[at][0]
            end, single = at, False
            while end < len(text):
                end += 1
                piece = text[at:end]
                score = scores.get(piece)
                if score is not None:
                    single = single or end == at + 1
                    old = best.get(end)
                    if old is None or sum_here + score > old[0]:
                        best[end] = (sum_here + score, at)
                if piece not in starts:
                    break
            if not single:
                old = best.get(at + 1)
                if old is None or sum_here + v.worst > old[0]:
                    best[at + 1] = (sum_here + v.worst, at)
            # Positions that later pieces can still start from: those already reached beyond here.
            alive = [p for p in best if p > at]
            while len(alive) > 1 or alive[0] > at + 1:
                # Walk the farthest path back; all meet when one position is left.
                far = max(alive)
                alive.remove(far)
                before = best[far][1]
                if before not in alive:
                    alive.append(before)
                if before <= base:
                    break
            if len(alive) == 1 and alive[0] > base:
                yield self._path(text, {p: b for p, (_, b) in best.items()}, base, alive[0])
                top = best[alive[0]][0]
                base = alive[0]
                best = {p: (s - top, b) for p, (s, b) in best.items() if p >= base}
        if base < len(text):
            yield self._path(text, {p: b for p, (_, b) in best.items()}, base, len(text))

    def _path(self, text: str, back: dict[int, int] | list[int], start: int, end: int) -> list[int]:
        pieces = []
        while end > start:
            before = back[end]
            pieces.append(text[before:end])
            end = before
        out: list[int] = []
        for piece in reversed(pieces):
            i = self.vocabulary.ids.get(piece)
            out += [self.vocabulary.bytes_[b] for b in piece.encode()] if i is None else [i]
        return out


def decode(ids: list[int], vocabulary: Vocabulary) -> str:
    """The text of a sequence of ids, without the mark that encoding puts in front."""
    byte_of, texts = vocabulary.byte_of, vocabulary.texts
    if byte_of.keys().isdisjoint(ids):
        text = "".join([texts[i] for i in ids])
    else:
        text = b"".join([bytes([byte_of[i]]) if i in byte_of else texts[i].encode() for i in ids]).decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


def encode_documents(docs: DataFrame, path: str = MODEL_PATH) -> DataFrame:
    """``doc_id, ids``."""
    vocabulary = load(path)

    def make():
        encoder = Encoder(vocabulary)

        def apply(rows):
            packed, waiting, size = [], [], 0
            for text in rows["text"]:
                waiting.append(text.decode() if text else "")
                size += len(waiting[-1])
                if size >= TOGETHER:
                    packed += encoder.encode_all(waiting)
                    waiting, size = [], 0
            packed += encoder.encode_all(waiting)
            at = np.cumsum([0, *[len(x) // 4 for x in packed]], dtype=np.int32)
            ids = np.frombuffer(b"".join(packed), dtype=np.int32)
            return {"doc_id": rows["doc_id"], "ids": pa.ListArray.from_arrays(pa.array(at), pa.array(ids))}

        return apply

    return map_columns(docs.select("doc_id", "text"), make, "doc_id bigint, ids array<int>")


def decode_ids(encoded: DataFrame, path: str = MODEL_PATH) -> DataFrame:
    """``doc_id, ids, text``."""
    vocabulary = load(path)

    def make():
        return lambda rows: rows | {"text": [decode(i, vocabulary) for i in rows["ids"]]}

    return map_columns(encoded.select("doc_id", "ids"), make, "doc_id bigint, ids array<int>, text string")


def op7_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and the digest of what they decode to."""
    decoded = decode_ids(encode_documents(table(spark, sf_dir, "documents")))
    return decoded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_ids"), "ids", F.sha2("text", 256).alias("decoded_sha256")
    )
