"""SentencePiece encoding and decoding by a Viterbi pass over a trie of distinct marked words.

A text gets the leading mark and its blanks become marks; it is cut before each run of marks, and around characters that no longer
piece contains, where no piece can cross. The distinct words of a batch are sorted, which lays them out as a trie in
depth-first order; the forward states of the prefix that a word shares with the one before it are kept, only the rest is computed.

Unigram models: the state of a prefix is its best score and last piece. BPE models: the score of a step is 0 if its two pieces are
neighbours in the merge order and minus infinity otherwise, so that exactly one path is finite, the merges' result; two pieces are neighbours if
merging their joined text gives the two again. The ids are those of the sentencepiece library.

Defined cases: a null or empty text has no ids and decodes to the empty text. Unknown characters become their bytes where the model has
byte pieces, else the unknown id. The mark character itself reads as a blank. Repeated rows get equal ids; other columns are kept.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, slices, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"


class Pieces:
    """A vocabulary: pieces with scores, byte pieces, and the forward pass."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[int], bpe: bool, prefix: bool = True, most: int = 300_000):
        #: kinds as in the model file: 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte
        self.pieces, self.scores, self.kinds, self.bpe, self.prefix, self.most = pieces, scores, kinds, bpe, prefix, most
        self.ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds)) if k in (1, 4)}
        self.unknown = kinds.index(2) if 2 in kinds else 0
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == 6}
        self.starts = {p[:k] for p in self.ids for k in range(1, len(p) + 1)}
        self.moves: dict[tuple[str, str], tuple[str, list[tuple]]] = {}
        self.least = min(scores, default=0.0) - 10.0
        inside = {c for p in self.ids if len(p) > 1 for c in p} | {MARK}
        group = "".join(re.escape(c) for c in sorted(inside - {MARK}))
        free = f"[^{group}{MARK}]+"
        self.cut = re.compile(f"{MARK}+[{group}]*|[{group}]+|{free}" if group else f"{MARK}+|{free}").findall
        self.raw = [bytes([int(p[3:5], 16)]) if k == 6 else b"" if k in (2, 3) else p.replace(MARK, " ").encode() for p, k in zip(pieces, kinds)]
        self.known: dict[str, tuple[int, ...]] = {}
        self.aged: dict[str, tuple[int, ...]] = {}  # what known held before; words still in use come back from it
        self.entries: dict[str, tuple] = {}
        self.tried = 0

    def __reduce__(self):
        return _same, (self.pieces, self.scores, self.kinds, self.bpe, self.prefix, self.most)

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        if m.normalizer_spec.name not in ("identity", "") or m.normalizer_spec.remove_extra_whitespaces or m.trainer_spec.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models without text normalisation are read")
        if any(MARK in p.piece.lstrip(MARK) for p in m.pieces):
            raise ValueError("a piece has a blank inside")
        return cls([p.piece for p in m.pieces], [p.score for p in m.pieces], [p.type for p in m.pieces], m.trainer_spec.model_type == 2, m.normalizer_spec.add_dummy_prefix)

    def merged(self, text: str) -> list[str]:
        """The text's pieces by merging the best-scored neighbours, the leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = -math.inf, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and self.scores[k] > best:
                    best, at = self.scores[k], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def ids_of(self, piece: str) -> tuple[int, ...]:
        k = self.ids.get(piece)
        if k is not None:
            return (k,)
        return tuple(self.bytes[b] for b in piece.encode()) if self.bytes else (self.unknown,)

    def _entry(self, piece: str) -> tuple:
        """(piece, length, ids, known neighbours): pieces before it, and whether they may stand there."""
        found = self.entries.get(piece)
        if found is None:
            found = self.entries[piece] = (piece, len(piece), self.ids_of(piece), {})
        return found

    def _suffixes(self, state: str, c: str) -> tuple[str, list[tuple]]:
        """The longest start of a piece that ends the text read so far, after character c, and the entries of the pieces that end there, longest first."""
        if len(self.moves) + self.tried >= self.most:
            self.moves.clear()
            self.entries.clear()
            self.tried = 0
        t = state + c
        ends = [t[k:] for k in range(len(t)) if t[k:] in self.ids]
        if not ends or len(ends[-1]) > 1:
            ends.append(c)
        while t and t not in self.starts:
            t = t[1:]
        found = self.moves[state, c] = (t, [self._entry(p) for p in ends])
        return found

    def forward(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """ids of distinct words, in one depth-first pass over their trie."""
        out: dict[str, tuple[int, ...]] = {}
        root = ("", 0, (), {})
        last, scores, states = [root], [0.0], [""]  # of each prefix: entry of its last piece, score, piece start that ends it
        before, moves, bpe = "", self.moves, self.bpe
        for word in sorted(words):
            same, n = 0, min(len(word), len(before))
            while same < n and word[same] == before[same]:
                same += 1
            del last[same + 1 :], scores[same + 1 :], states[same + 1 :]
            state = states[-1]
            i = same
            for c in word[same:]:
                i += 1
                found = moves.get((state, c))
                state, ends = self._suffixes(state, c) if found is None else found
                if bpe:
                    for e in ends:
                        b = last[i - e[1]][0]
                        ok = e[3].get(b)
                        if ok is None:
                            self.tried += 1
                            ok = e[3][b] = self.merged(b + e[0]) == ([b, e[0]] if b else [e[0]])
                        if ok:
                            break
                else:
                    total, e = -math.inf, ends[-1]
                    for x in ends:
                        at = self.ids.get(x[0])
                        own = scores[i - x[1]] + (self.least if at is None else self.scores[at])
                        if own > total:
                            total, e = own, x
                    scores.append(total)
                last.append(e)
                states.append(state)
            before = word
            got: list[int] = []
            while i:
                e = last[i]
                got.extend(e[2][::-1])
                i -= e[1]
            got.reverse()
            out[word] = tuple(got)
        return out

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets)."""
        units, counts = [], []
        for t in texts:
            own = self.cut((MARK if self.prefix else "") + t.replace(" ", MARK)) if t else []
            units += own
            counts.append(len(own))
        distinct = set(units)
        if len(self.known) > self.most:
            self.aged, self.known = self.known, {}
        known, aged = self.known, self.aged
        fresh = [u for u in distinct if u not in known]
        if aged:
            known |= {u: aged[u] for u in fresh if u in aged}
            fresh = [u for u in fresh if u not in known]
        known |= self.forward(fresh)
        found = [known[u] for u in units]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(itertools.chain.from_iterable(found), np.int32, int(sizes.sum()))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return ids, ends[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]

    def rest(self) -> None:
        """Between tasks only what is known of pieces stays, not the words: the worker may go on to do something else."""
        self.known, self.aged = {}, {}

    def decode(self, ids) -> str:
        text = b"".join([self.raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_workers: dict[int, Pieces] = {}


def _same(*args) -> Pieces:
    """One object per vocabulary and Python worker, so that later tasks find what earlier ones have worked out."""
    key = hash((tuple(args[0]), tuple(args[1]), tuple(args[2]), *args[3:]))
    if key not in _workers:
        _workers.clear()
        _workers[key] = Pieces(*args)
    return _workers[key]


def _held(model: Pieces | str | None) -> Pieces:
    return model if isinstance(model, Pieces) else Pieces.load(model or MODEL)


def encode(docs: DataFrame, model: Pieces | str | None = None, column: str = "text") -> DataFrame:
    """docs with ``ids`` array<int> after its columns (an input column of that name is replaced)."""
    pieces = _held(model)
    small_batches(docs.sparkSession, 12)
    docs = docs.drop("ids")

    def run(batches):
        for batch in batches:
            for b in slices(batch, column, 12 << 20):
                ids, ends = pieces.encode_batch(b.column(column).to_pylist())
                yield b.append_column("ids", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)))
        pieces.rest()

    return docs.mapInArrow(released(run), docs.withColumn("ids", F.array().cast("array<int>")).schema)


def decode(rows: DataFrame, model: Pieces | str | None = None, column: str = "ids") -> DataFrame:
    """rows with ``decoded`` text after its columns; null ids decode to the empty text."""
    pieces = _held(model)
    small_batches(rows.sparkSession)
    rows = rows.drop("decoded")

    def run(batches):
        for b in batches:
            yield b.append_column("decoded", pa.array([pieces.decode(x or ()) for x in b.column(column).to_pylist()], pa.string()))

    return rows.mapInArrow(released(run), rows.withColumn("decoded", F.lit("")).schema)


def digests(docs: DataFrame, model: Pieces | str | None = None) -> DataFrame:
    """doc_id, n_ids, ids_sha256 (of the ids as 4-byte little-endian numbers), decoded_sha256 (of the decoded text), exact (it is the text again)."""
    pieces = _held(model)
    small_batches(docs.sparkSession, 12)

    def run(batches):
        for batch in batches:
            for b in slices(batch, "text", 12 << 20):
                texts = [t or "" for t in b.column("text").to_pylist()]
                ids, ends = pieces.encode_batch(texts)
                own = [ids[a:z] for a, z in zip(ends[:-1], ends[1:])]
                back = [pieces.decode(x.tolist()) for x in own]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(np.diff(ends)), pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in own], pa.string()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back], pa.string()), pa.array([x == t.replace(MARK, " ") for x, t in zip(back, texts)], pa.bool_())],
                    ["doc_id", "n_ids", "ids_sha256", "decoded_sha256", "exact"],
                )
        pieces.rest()

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(released(run), f"doc_id {kind}, n_ids long, ids_sha256 string, decoded_sha256 string, exact boolean")
