"""SentencePiece encoding and decoding with N-best segmentations.

A forward Viterbi pass over the piece lattice gives the best score from the
start to every place. These scores are exact heuristics for an A-star search that
runs backward from the end: it pops complete segmentations in order of their
score. The lattice of a text falls apart at every boundary that no piece of the
vocabulary crosses (before a space, beside a line feed, between punctuation and
letters), so the search runs on the parts, and the N best of the whole are merged
from the N best of its parts: only the N - 1 parts with the smallest loss of a
second choice can differ from their best. The forward pass runs over all new parts of a
slice of texts at once; a worker remembers parts it has seen, in flat arrays.

Characters without a piece are spelled in byte pieces, so decoding gives back
every text exactly.

Defined cases: a null text is an empty text, with one segmentation of no pieces;
a text with fewer than N segmentations gets all it has; ties go to what the
search reaches first, which depends on the text alone; repeated rows are encoded each.
"""

from __future__ import annotations

import heapq
import re
import string
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: What a byte piece costs below the lowest score of the vocabulary.
BYTE_COST = 10.0
#: Distinct parts that a worker remembers before it starts anew.
MOST_PARTS = 400_000
#: Parts of more characters are segmented one by one; of others, so many at once.
LONG, AT_ONCE = 48, 16_384
#: Bytes of the texts that are cut together.
SLICE = 1 << 20
_LOW = -1e300
_ODD, _MASK = 0x9E3779B1, (1 << 40) - 1


def _boundaries(vocabulary) -> re.Pattern:
    """Parts of a text that no piece crosses: before a space, beside a line feed, between marks and other characters.

    Marks are the ASCII punctuation and whatever else that is no letter or digit and stands beside them in a piece.
    """
    if any(re.search("[^ ] |.\n|\n.", p, re.S) for p in vocabulary):
        raise ValueError("a piece of the model has a space inside, or a line feed with other characters")
    pairs = {(a, b) for p in vocabulary for a, b in zip(p, p[1:], strict=False) if a != " "}
    marks, never = set(string.punctuation), set()
    while mixed := next(((a, b) for a, b in sorted(pairs) if (a in marks) != (b in marks)), None):
        mark, other = mixed if mixed[0] in marks else mixed[::-1]
        if other.isalpha() or other in never or other.isascii() and other.isalnum():
            marks.discard(mark)
            never.add(mark)
        else:
            marks.add(other)
    if not marks:
        return re.compile(" *[^ \n]+| +|\n")
    of = re.escape("".join(sorted(marks)))
    return re.compile(f" *[^ \n{of}]+| *[{of}]+| +|\n")


#: Per text: ids of the best segmentation as 32-bit integers, its score, the other segmentations as changes to it, and whether decoding gives the text back.
ENCODED = "pieces binary, n_pieces long, score double, others array<struct<score:double,changes:array<struct<at:int,n:int,ids:array<int>>>>>, exact boolean"


def read_model(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, kind) of a model file in order of their ids; kinds: 0 text, 1 byte, 2 neither."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: 1 if model.is_byte(i) else 2 if model.is_control(i) or model.is_unknown(i) else 0
    return [(model.id_to_piece(i), float(model.get_score(i)), kind(i)) for i in range(model.get_piece_size())]


class _Trie:
    """The pieces by character, for many parts at once: a table from (node, character) to the node below, found by hashing."""

    def __init__(self, pieces: dict[str, tuple[float, int]]):
        alphabet = sorted({c for p in pieces for c in p})
        self.char = np.full(0x110000, -1, np.int32)
        self.char[[ord(c) for c in alphabet]] = np.arange(len(alphabet))
        self.n_chars = len(alphabet)
        node = {p[:i] for p in pieces for i in range(len(p) + 1)}
        node = {p: i for i, p in enumerate(sorted(node))}
        self.score = np.full(len(node), _LOW)
        self.id = np.full(len(node), -1, np.int32)
        for p, (score, i) in pieces.items():
            self.score[node[p]], self.id[node[p]] = score, i
        self.bits = max(4, (4 * len(node)).bit_length())
        keys, below = [-1] * (1 << self.bits), [-1] * (1 << self.bits)
        self.probes = 1
        for p, i in node.items():
            if p:
                key = node[p[:-1]] * self.n_chars + int(self.char[ord(p[-1])])
                at, n = self._hash(key), 1
                while keys[at] >= 0:
                    at, n = (at + 1) & ((1 << self.bits) - 1), n + 1
                keys[at], below[at] = key, i
                self.probes = max(self.probes, n)
        self.keys, self.below = np.array(keys, np.int64), np.array(below, np.int32)

    def _hash(self, key):
        return (key * _ODD & _MASK) >> (40 - self.bits)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The node below each node by a character of the alphabet, or -1."""
        key = node.astype(np.int64) * self.n_chars + char
        at = self._hash(key)
        out = np.where(self.keys[at] == key, self.below[at], -1)
        open_ = np.flatnonzero((out < 0) & (self.keys[at] >= 0))
        for _ in range(1, self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            hit = self.keys[at[open_]] == key[open_]
            out[open_[hit]] = self.below[at[open_[hit]]]
            open_ = open_[~hit & (self.keys[at[open_]] >= 0)]
        return out


class Pieces:
    """A vocabulary, and segmentations by it. Spaces stand for the model's space marks."""

    def __init__(self, model: list[tuple[str, float, int]], n_best: int):
        self.n_best = n_best
        self.piece: dict[str, tuple[float, int]] = {}
        self.text: list[bytes] = []
        self.byte: dict[int, int] = {}
        for i, (piece, score, kind) in enumerate(model):
            plain = piece.replace(MARK, " ")
            if kind == 1:
                self.byte[int(piece[3:-1], 16)] = i
            elif kind == 0:
                self.piece[plain] = (score, i)
            self.text.append((plain.encode(), bytes([int(piece[3:-1], 16)]) if kind == 1 else b"", b"")[kind])
        if len(self.byte) < 256:
            raise ValueError("the model has no byte pieces")
        self.cut = _boundaries(self.piece).findall
        self.longest = max(map(len, self.piece))
        self.byte_score = min(s for s, _ in self.piece.values()) - BYTE_COST
        self.scores = {p: s for p, (s, _) in self.piece.items()}
        self.prefixes = {p[:i] for p in self.piece for i in range(1, len(p))}
        self.trie = _Trie(self.piece)
        self.chosen: dict[str, list] = {}
        self._forget()

    def _forget(self) -> None:
        """What is remembered of parts: a place for each, and there its ids, the loss of its second choice, and its score."""
        self.known: dict[str, int] = {}
        self.known_chars = 0
        self.losses, self.scored = np.zeros(1024), np.zeros(1024)
        self.begin = np.zeros(1025, np.int64)
        self.ids = np.zeros(4096, np.int32)

    def _lattice(self, part: str) -> tuple[list[list[tuple]], list[float]]:
        """For every end the edges (score from the start over this edge, begin, its ids), best first, and the Viterbi scores."""
        get, longest = self.piece.get, self.longest
        edges: list[list[tuple]] = [[]]
        forward = [0.0]
        for end in range(1, len(part) + 1):
            at = [(forward[begin] + hit[0], begin, (hit[1],)) for begin in range(max(0, end - longest), end) if (hit := get(part[begin:end]))]
            if not at or at[-1][1] != end - 1:
                raw = part[end - 1].encode("utf-8", "surrogatepass")
                at.append((forward[end - 1] + self.byte_score * len(raw), end - 1, tuple([self.byte[b] for b in raw])))
            edges.append(at)
            forward.append(max(at)[0])
        return edges, forward

    def best(self, part: str) -> tuple[list[int], float, float]:
        """Ids, loss of the second choice, and score of one part.

        The search's first path is the Viterbi path; as the heuristics are exact,
        the second one leaves it by the edge that loses least.
        """
        get, longest, prefixes = self.scores.get, self.longest, self.prefixes
        n = len(part)
        forward, second, back = [_LOW] * (n + 1), [_LOW] * (n + 1), [0] * (n + 1)
        forward[0] = 0.0
        for begin in range(n):
            base = forward[begin]
            for end in range(begin + 1, min(n, begin + longest) + 1):
                piece = part[begin:end]
                s = get(piece)
                if s is None:
                    if end == begin + 1:  # the character has no piece of its own
                        s = self.byte_score * len(piece.encode("utf-8", "surrogatepass"))
                    elif piece in prefixes:
                        continue
                    else:
                        break
                s += base
                if s > forward[end]:
                    forward[end], second[end], back[end] = s, forward[end], begin
                elif s > second[end]:
                    second[end] = s
        ids: list[int] = []
        least, place = float("inf"), n
        while place:
            begin = back[place]
            least = min(least, forward[place] - second[place])
            own = self.piece.get(part[begin:place])
            ids += (own[1],) if own else [self.byte[b] for b in part[begin:place].encode("utf-8", "surrogatepass")][::-1]
            place = begin
        return ids[::-1], float("inf") if least > -_LOW / 2 else least, forward[-1]

    def _best_of_many(self, chars: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``best`` of parts that are all made of characters with a piece: ids of all, their numbers, losses and scores.

        ``chars`` holds the characters of the trie's alphabet; sizes descend. The same pass, for all parts at once.
        """
        k, n, trie = len(sizes), int(sizes[0]), self.trie
        forward, second = np.full((n + 1, k), _LOW), np.full((n + 1, k), _LOW)
        back, through = np.zeros((n + 1, k), np.int32), np.zeros((n + 1, k), np.int32)
        forward[0] = 0.0
        longer = np.searchsorted(-sizes, -np.arange(n), "left")  # parts with more than so many characters
        for begin in range(n):
            at = np.arange(longer[begin])
            node = np.zeros(len(at), np.int32)
            for end in range(begin + 1, min(n, begin + self.longest) + 1):
                m = longer[end - 1]
                if len(at) and at[-1] >= m:
                    left = at < m
                    at, node = at[left], node[left]
                node = trie.step(node, chars[begins[at] + (end - 1)])
                on = node >= 0
                at, node = at[on], node[on]
                if not len(at):
                    break
                score = trie.score[node]
                piece = np.flatnonzero(score > _LOW)
                if not len(piece):
                    continue
                here = at[piece]
                score = score[piece] + forward[begin][here]
                best, next_ = forward[end][here], second[end][here]
                better = score > best
                second[end][here] = np.where(better, best, np.maximum(next_, score))
                here = here[better]
                forward[end][here], back[end][here], through[end][here] = score[better], begin, node[piece[better]]
        least = np.full(k, np.inf)
        place = sizes.copy()
        rounds: list[tuple[np.ndarray, np.ndarray]] = []
        at = np.arange(k)
        while len(at):
            p = place[at]
            least[at] = np.minimum(least[at], forward[p, at] - second[p, at])
            rounds.append((at, trie.id[through[p, at]]))
            place[at] = back[p, at]
            at = at[place[at] > 0]
        counts = np.bincount(np.concatenate([r[0] for r in rounds]), minlength=k)
        upto = np.cumsum(counts)
        ids = np.zeros(int(upto[-1]), np.int32)
        for i, (which, own) in enumerate(rounds):  # the last piece of a part comes first
            ids[upto[which] - 1 - i] = own
        least[least > -_LOW / 2] = np.inf
        return ids, counts, least, forward[sizes, np.arange(k)]

    def _learn(self, parts: list[str]) -> None:
        """Remember the best segmentations of new, distinct parts."""
        parts = sorted(parts, key=len, reverse=True)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        begins = np.cumsum(sizes) - sizes
        chars = self.trie.char[np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        plain = (np.minimum.reduceat(chars, begins) >= 0) & (sizes <= LONG)
        for many in np.array_split(np.flatnonzero(plain), int(plain.sum()) // AT_ONCE + 1):
            if len(many):
                self._add([parts[i] for i in many], *self._best_of_many(chars, begins[many], sizes[many]))
        for i in np.flatnonzero(~plain):
            ids, loss, score = self.best(parts[i])
            self._add([parts[i]], np.array(ids, np.int32), np.array([len(ids)]), np.array([loss]), np.array([score]))

    def _add(self, parts: list[str], ids: np.ndarray, counts: np.ndarray, losses: np.ndarray, scores: np.ndarray) -> None:
        n, m = len(self.known), int(self.begin[len(self.known)])
        if n + len(parts) >= len(self.losses):
            more = len(self.losses) + len(parts)
            self.losses, self.scored, self.begin = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.losses, self.scored, self.begin))
        if m + len(ids) >= len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids) + len(ids), np.int32)])
        self.known.update(zip(parts, range(n, n + len(parts)), strict=True))
        self.known_chars += sum(map(len, parts))
        self.losses[n : n + len(parts)], self.scored[n : n + len(parts)] = losses, scores
        self.begin[n + 1 : n + len(parts) + 1] = m + np.cumsum(counts)
        self.ids[m : m + len(ids)] = ids

    def choices(self, part: str) -> list[tuple[float, tuple[int, ...]]]:
        """The N best segmentations of a part, best first: (score, ids), by A-star from its end to its start."""
        if hit := self.chosen.get(part):
            return hit
        edges, forward = self._lattice(part)
        found: list[tuple] = []
        # (minus the score of the best completion, place, order of arrival, score from here to the end, ids and the rest)
        heap: list[tuple] = [(-forward[-1], len(part), 0, 0.0, None)]
        arrived = 0
        while heap and len(found) < self.n_best:
            total, place, _, behind, rest = heapq.heappop(heap)
            if not place:
                ids: list[int] = []
                while rest:
                    ids += rest[0]
                    rest = rest[1]
                found.append((-total, tuple(ids)))
                continue
            # of equal edges the first goes first, as on the Viterbi path
            for upto, begin, own in edges[place]:
                arrived += 1
                heapq.heappush(heap, (-(upto + behind), begin, arrived, upto - forward[begin] + behind, (own, rest)))
        if len(part) <= LONG:
            if len(self.chosen) >= MOST_PARTS // 4:
                self.chosen.clear()
            self.chosen[part] = found
        return found

    def encode_all(self, texts: list[str]) -> list[tuple[bytes, float, list[dict], bool]]:
        """Per text: ids and score of the best segmentation, the others, and whether the ids give the text back."""
        if len(self.known) > MOST_PARTS or self.known_chars > 16 * MOST_PARTS:
            self._forget()
        cuts = [self.cut(" " + t) if t else [] for t in texts]
        flat = list(chain.from_iterable(cuts))
        if new := set(flat).difference(self.known):
            self._learn(list(new))
        where = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        begin, count = self.begin[where], self.begin[where + 1] - self.begin[where]
        upto = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.repeat(begin - upto[:-1], count) + np.arange(upto[-1])]
        losses, scored = self.losses[where], self.scored[where]
        out, a = [], 0
        for text, cut in zip(texts, cuts, strict=True):
            z = a + len(cut)
            out.append(self._whole(text, cut, ids[upto[a] : upto[z]], upto[a : z + 1] - upto[a], losses[a:z], scored[a:z]))
            a = z
        return out

    def encode(self, text: str) -> tuple[bytes, float, list[dict], bool]:
        return self.encode_all([text])[0]

    def _whole(self, text: str, cut: list[str], ids: np.ndarray, begins: np.ndarray, loss: np.ndarray, scores: np.ndarray) -> tuple[bytes, float, list[dict], bool]:
        """The N best of a text from those of its parts."""
        score = float(sum(scores.tolist()))
        few = self.n_best - 1
        if len(loss) > few > 0:
            least = np.partition(loss, few - 1)[few - 1]
            near = np.flatnonzero(loss <= least)
            near = near[np.argsort(loss[near], kind="stable")[:few]]
        else:
            near = np.arange(len(loss))[: max(few, 0)]
        choices: list[tuple[float, tuple]] = [(0.0, ())]
        for i in sorted(near.tolist()):
            alternatives = self.choices(cut[i])
            top = alternatives[0][0]
            more = [(lost + (top - s), changed + (((i, k),) if k else ())) for lost, changed in choices for k, (s, _) in enumerate(alternatives)]
            choices = sorted(more)[: self.n_best]
        others = []
        for lost, changed in choices[1:]:
            changes = [{"at": int(begins[i]), "n": int(begins[i + 1] - begins[i]), "ids": list(self.choices(cut[i])[k][1])} for i, k in changed]
            others.append({"score": score - lost, "changes": changes})
        back = b"".join(map(self.text.__getitem__, ids.tolist()))
        return ids.tobytes(), score, others, back == (" " + text).encode("utf-8", "surrogatepass") if text else True

    def decode(self, ids) -> str:
        return b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


_built: dict[tuple[str, int], Pieces] = {}


def _shipped(spark: SparkSession, path: str, n_best: int):
    """A function for workers: the vocabulary, built once in each, with what it remembers. The driver reads the model; workers get its pieces with the job."""
    rows = spark.sparkContext.broadcast(read_model(path))  # as large as the model, whatever the input

    def built() -> Pieces:
        if (path, n_best) not in _built:
            _built.clear()
            _built[path, n_best] = Pieces(rows.value, n_best)
        return _built[path, n_best]

    return built


def _slices(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """First row and texts of slices of at most ``SLICE`` bytes, or one text."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.cumsum(size)
    at = 0
    while at < len(column):
        before = int(upto[at - 1]) if at else 0
        to = max(at + 1, min(at + 1000, int(np.searchsorted(upto, before + SLICE, "right"))))
        yield at, [t or "" for t in column.slice(at, to - at).to_pylist()]
        at = to


def encode(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", n_best: int = 4, model: str = MODEL) -> DataFrame:
    """The columns in ``keep`` with those of ``ENCODED`` for every row."""
    rows = docs.select(*[F.col(c) for c in keep], F.col(text_col).alias("_text"))
    n = len(keep)
    change = pa.struct([("at", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int32()))])
    other = pa.list_(pa.struct([("score", pa.float64()), ("changes", pa.list_(change))]))
    built = _shipped(docs.sparkSession, model, n_best)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = built()
        pa.default_memory_pool().release_unused()  # what an earlier stage left in this worker
        for b in batches:
            for at, texts in _slices(b.column(n)):
                blobs, scores, others, exact = zip(*vocabulary.encode_all(texts), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[b.column(i).slice(at, len(texts)) for i in range(n)],
                        pa.array(blobs, pa.binary()),
                        pa.array([len(x) // 4 for x in blobs], pa.int64()),
                        pa.array(scores, pa.float64()),
                        pa.array(others, other),
                        pa.array(exact, pa.bool_()),
                    ],
                    names=[*keep, "pieces", "n_pieces", "score", "others", "exact"],
                )

    return rows.mapInArrow(run, ", ".join([*[f"`{c}` {t}" for c, t in rows.dtypes[:n]], ENCODED]))


def decode(encoded: DataFrame, keep: tuple[str, ...] = ("doc_id",), pieces_col: str = "pieces", model: str = MODEL) -> DataFrame:
    """The columns in ``keep`` with the text of the pieces (32-bit integers); null gives an empty text."""
    rows = encoded.select(*[F.col(c) for c in keep], F.col(pieces_col).alias("_pieces"))
    n = len(keep)
    built = _shipped(encoded.sparkSession, model, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = built()
        for b in batches:
            texts = [vocabulary.decode(np.frombuffer(x or b"", np.int32)) for x in b.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(n)], pa.array(texts, pa.string())], names=[*keep, "text"])

    return rows.mapInArrow(run, ", ".join([*[f"`{c}` {t}" for c, t in rows.dtypes[:n]], "text string"]))
