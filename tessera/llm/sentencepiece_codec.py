"""SentencePiece encoding and decoding by a streaming Viterbi search.

A lattice has a node at each character boundary and an edge for each piece. At every node one backpointer survives. In a
unigram model that is the edge of the best summed score; in a byte-pair model (the public file at hand) it is the edge whose
piece may follow the piece that survives at its start, which byte-pair merging of the two alone tells: a sequence is
what merging gives exactly if all its neighbours are so compatible, and only one piece per node is. The pieces that end at a
node come from an automaton over the vocabulary, and memos keep which pairs are compatible and where the first characters of spans lead. The search keeps a
window as wide as the longest piece; whenever the backpointer paths of all nodes in the window meet at one boundary, the ids before
it are committed and forgotten. Where no piece can span a boundary (before a word's space mark, around characters that the
vocabulary lacks), the paths always meet, so the spans between are searched one by one and a memo of bounded size keeps their ids.

Results for odd rows: a null text gives null ids, null n_pieces and null round_trip; an empty text gives no ids; a very long text is coded whole, its words one by one; a character that the vocabulary lacks
gives its UTF-8 bytes as byte pieces (or the unknown id where the model has none); rows with the same or a null doc_id are coded one by one; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Memo, map_batches

SPACE = "▁"


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a message in the wire format of protocol buffers: number and value."""
    at = 0

    def whole() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        number, kind = divmod(whole(), 8)
        if kind == 0:
            yield number, whole()
            continue
        size = {1: 8, 5: 4}.get(kind) or whole()
        yield number, data[at : at + size]
        at += size


#: Numbers of fields and of kinds of model in the format of model files.
TRAINER, NORMALIZER, MODEL_TYPE, SUFFIX, CHAR_MAP, DUMMY_PREFIX, EXTRA_SPACES, ESCAPE = 2, 3, 3, 24, 2, 3, 4, 5
UNIGRAM, BPE = 1, 2


def model_type(data: bytes) -> int:
    """The kind of a model; refuses models whose treatment of texts differs from what is done here: no normalisation, a space before the text, no spaces removed."""
    parts = {n: dict(fields(v)) for n, v in fields(data) if n in (TRAINER, NORMALIZER)}
    trainer, normal = parts.get(TRAINER, {}), parts.get(NORMALIZER, {})
    kind = trainer.get(MODEL_TYPE, UNIGRAM)
    if kind not in (UNIGRAM, BPE) or trainer.get(SUFFIX, 0) or normal.get(CHAR_MAP) or not normal.get(DUMMY_PREFIX, 1) or normal.get(EXTRA_SPACES, 1) or not normal.get(ESCAPE, 1):
        raise ValueError("the model's kind, normalisation or treatment of spaces is not supported")
    return kind


class Node(dict):
    """A state of the automaton that reads a text and knows the pieces ending at each place: the longest ending of the text that some piece begins with. As a dictionary it
    gives the state after a character; `out` has the pieces that end here, the longest first, with their lengths. What leads back to shorter endings is learned when met, up to `room` times
    (else found each time anew), so the memory is bounded."""

    __slots__ = ("back", "out", "room")

    def __init__(self, back: Node | None, out: tuple, room: list[int]):
        self.back, self.out, self.room = back, out, room

    def __missing__(self, c: str) -> Node:
        if self.back is None:
            return self
        to = self.back[c]
        if self.room[0] > 0:
            self.room[0] -= 1
            self[c] = to
        return to


def automaton(pieces: Iterable[str], room: int = 200_000) -> Node:
    """The first state for these pieces."""
    root = Node(None, (), [room])
    pieces = frozenset(pieces)
    states = {"": root}
    starts = sorted({p[:n] for p in pieces for n in range(1, len(p) + 1)}, key=len)
    for start in starts:  # the shorter ones first: what a state goes back to is there before it
        back = next(states[start[k:]] for k in range(1, len(start) + 1) if start[k:] in states)
        states[start] = Node(back, ((start, len(start)), *back.out) if start in pieces else back.out, root.room)
    for start in starts:
        dict.__setitem__(states[start[:-1]], start[-1], states[start])
    return root


class PieceModel:
    """Pieces, scores and kinds of a model file, and both directions of coding."""

    #: Fixed value: characters at the begin of a span whose survivors are kept in a memo.
    HEAD = 6

    def __init__(self, path: str, memo: int = 300_000):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.vocab_size()
        self.unknown = lib.unk_id()
        self.byte_id: dict[int, int] = {}
        self.pieces: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.surface: list[bytes] = [b""] * n
        for i in range(n):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
                self.surface[i] = bytes([int(piece[1:-1], 16)])
            elif not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
                self.pieces[piece] = i
                self.score[piece] = lib.get_score(i)
                self.surface[i] = piece.replace(SPACE, " ").encode()
        self.surface[self.unknown] = " ⁇ ".encode()
        self.longest = max(map(len, self.pieces), default=1)
        with open(path, "rb") as f:
            self.pair_model = model_type(f.read()) == BPE
        if any(SPACE in p.lstrip(SPACE) for p in self.pieces):
            raise ValueError("a piece holds a space mark after a letter: spans can't be cut at spaces")
        self.known = frozenset(c for p in self.pieces for c in p) - {SPACE, " "}
        known = "".join(re.escape(c) for c in sorted(self.known))
        self.spans = re.compile(f"[ {SPACE}]*[{known}]+|[ {SPACE}]+|.", re.S).findall
        #: For byte pairs: what stands at a piece's left and right edge while it is merged, each with the score at which it is merged further.
        self.edges: dict[str, tuple[list, list]] = {}
        self.simple = set()
        if self.pair_model:
            for p in self.pieces:
                self._trace(p)
        self.usable = frozenset(self.edges if self.pair_model else self.pieces)
        self.root = automaton(self.usable) if self.pair_model else None
        self.least = min(self.score.values(), default=0.0)
        self.fits = Memo(self._fits, 2 * memo)
        self.heads = Memo(self._head, memo // 4)
        self.ids = Memo(self._chunk, memo)
        self.span_ids = Memo(self._span, memo // 4)
        # decoding gathers bytes: each piece's place in one table and its length
        self.table = np.frombuffer(b"".join(self.surface), np.uint8)
        self.size = np.array([len(x) for x in self.surface], np.int32)
        self.place = np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype(np.int32)

    # -- encoding ------------------------------------------------------------------------------------------------------

    def _merged(self, text: str) -> list[str]:
        """Byte-pair merging of a short text: the best score first, then the leftmost."""
        symbol, n = list(text), len(text)
        right, left = list(range(1, n + 1)), list(range(-1, n))
        heap = [(-self.score[p], i, p) for i in range(n - 1) if (p := symbol[i] + symbol[i + 1]) in self.score]
        heapify(heap)
        while heap:
            _, i, p = heappop(heap)
            j = right[i]
            if j >= n or not symbol[i] or symbol[i] + symbol[j] != p:
                continue
            symbol[i], symbol[j] = p, ""
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if (q := p + symbol[k]) in self.score:
                    heappush(heap, (-self.score[q], i, q))
            if (h := left[i]) >= 0 and (q := symbol[h] + p) in self.score:
                heappush(heap, (-self.score[q], h, q))
        return [s for s in symbol if s]

    def _trace(self, piece: str) -> None:
        """Notes the edges of a piece if merging its characters gives it, and if each merge scores less than those before it."""
        if len(piece) == 1:
            self.edges[piece] = ([(piece, -np.inf)], [(piece, -np.inf)])
            self.simple.add(piece)
            return
        if self._merged(piece) != [piece]:
            return
        symbol, left, right, scores = list(piece), [piece[0]], [piece[-1]], []
        while len(symbol) > 1:
            s, i = max((self.score.get(symbol[i] + symbol[i + 1], -np.inf), -i) for i in range(len(symbol) - 1))
            symbol[-i : 2 - i] = [symbol[-i] + symbol[1 - i]]
            scores.append(s)
            if symbol[0] != left[-1]:
                left.append(symbol[0])
            if symbol[-1] != right[-1]:
                right.append(symbol[-1])
        spine = lambda x: [(a, self.score[b]) for a, b in zip(x, x[1:])] + [(piece, -np.inf)]
        self.edges[piece] = (spine(left), spine(right))
        if all(a > b for a, b in zip(scores, scores[1:])):
            self.simple.add(piece)

    def _fits(self, pair: tuple[str, str]) -> bool:
        """Whether merging the characters of two pieces gives the two again: nothing may merge across, at its score, before both edges have gone on."""
        a, b = pair
        if a not in self.edges:  # the begin, or a character that no piece holds
            return True
        if not (a in self.simple and b in self.simple):
            return self._merged(a + b) == [a, b]
        get, edge, other = self.score.get, iter(self.edges[a][1]), iter(self.edges[b][0])
        r, after_r = next(edge)
        x, after_x = next(other)
        while True:  # the edges that stand side by side, in the order of merges
            s = get(r + x)
            if s is not None and s > after_r and s >= after_x:
                return False
            if after_r == after_x == -np.inf:
                return True
            if after_r >= after_x:
                r, after_r = next(edge)
            else:
                x, after_x = next(other)

    def search(self, span: str) -> list[int]:
        """The ids of one span by the streaming search."""
        out: list[int] = []
        # by boundary of the window: the piece that survives there, and its path's score (byte pairs: the automaton's state at the last)
        if self.pair_model:
            if span in self.usable:
                return [self.pieces[span]]
            last, state = self.heads[span[: self.HEAD]]
            last = last.copy()
        else:
            last, best = [""], [0.0]
        begin, n, step = 0, len(span), 2 * self.longest  # what is before begin is committed
        for to in range(step, n + step, step):
            part = span[begin : min(to, n)]
            if self.pair_model:
                state = self._extend_pairs(part[len(last) - 1 :], last, state)
            else:
                self._extend_scores(part, last, best)
            if to < n and (met := self._met(last)):
                self._emit(last, met, out)
                del last[:met]
                if not self.pair_model:
                    del best[:met]
                begin += met
        self._emit(last, len(last) - 1, out)
        return out

    def _extend_pairs(self, more: str, last: list[str], state: Node) -> Node:
        """Finds the survivors at the boundaries of more, the text after the last boundary; byte pairs. All pieces found begin within the window, as it is as wide as the longest."""
        fits = self.fits
        for c in more:
            state = state[c]
            for piece, size in state.out:
                if fits[last[-size], piece]:
                    last.append(piece)
                    break
            else:  # a character that no piece holds
                last.append(c)
        return state

    def _head(self, begin: str) -> tuple[list[str], Node]:
        """The survivors and the state after the first characters of a span, which many spans share."""
        last = [""]
        return last, self._extend_pairs(begin, last, self.root)

    def _extend_scores(self, part: str, last: list[str], best: list[float]) -> None:
        """The same for a unigram model: the best sum survives, of equal sums that with the longest piece."""
        for end in range(len(last), len(part) + 1):
            found, most = part[end - 1], -np.inf if part[end - 1] in self.pieces else best[end - 1] + self.least - 10.0
            for start in range(max(0, end - self.longest), end):
                piece = part[start:end]
                if piece in self.pieces and best[start] + self.score[piece] > most:
                    found, most = piece, best[start] + self.score[piece]
            last.append(found)
            best.append(most)

    def _met(self, last: list[str]) -> int:
        """The last boundary at which the paths of all nodes that a later piece can start from meet."""
        heads = set(range(max(0, len(last) - self.longest), len(last)))
        while len(heads) > 1:
            x = max(heads)
            heads.remove(x)
            heads.add(x - len(last[x]))
        return heads.pop()

    def _emit(self, last: list[str], end: int, out: list[int]) -> None:
        path, get = [], self.pieces.get
        while end > 0:
            piece = last[end]
            path.append(piece)
            end -= len(piece)
        path.reverse()
        for piece in path:
            if (known := get(piece)) is not None:
                out.append(known)
            elif self.byte_id:
                out += [self.byte_id[b] for b in piece.encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown)

    def _span(self, span: str) -> bytes:
        ids = self.search(span.replace(" ", SPACE))
        return pack(f"<{len(ids)}i", *ids)

    def _chunk(self, word: str) -> bytes:
        """The ids of a word after a space, or after a line break where it begins with one."""
        if self.known.issuperset(word) and word[0] != "\n":  # one span
            return self._span(" " + word)
        return b"".join(map(self._span, self.spans(word if word[0] == "\n" else " " + word)))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers. A space is put before the text, as the model does."""
        if not text:
            return b""
        # no piece goes on over a single space or holds a line break: words are searched for themselves
        words = text.replace("\n", " \n").split(" ")
        if "" in words or SPACE in text or "\n" in self.pieces:  # runs of spaces
            return b"".join(map(self.span_ids.__getitem__, self.spans(" " + text)))
        return b"".join(map(self.ids.__getitem__, words))

    # -- decoding ------------------------------------------------------------------------------------------------------

    def decode(self, ids: np.ndarray | list[int]) -> str:
        ids = np.asarray(ids, np.int64)
        size = self.size[ids]
        end = np.cumsum(size)
        at = np.arange(end[-1] if len(end) else 0, dtype=np.int64) + np.repeat(self.place[ids] - (end - size), size)
        text = self.table[at].tobytes().decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=2)
def model_of(path: str) -> PieceModel:
    """One model for each worker process and file."""
    return PieceModel(path)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, n_pieces of each row."""

    def make():
        coder = model_of(model)

        def step(c: dict[str, list]) -> dict[str, object]:
            coded = [None if t is None else coder.encode(t) for t in c["text"]]
            ends = np.cumsum([0] + [len(x or b"") // 4 for x in coded], dtype=np.int32)
            flat = pa.array(np.frombuffer(b"".join(x or b"" for x in coded), "<i4"))
            ids = pa.ListArray.from_arrays(pa.array(ends), flat, mask=pa.array([x is None for x in coded]))
            return {"doc_id": c["doc_id"], "ids": ids, "n_pieces": pa.array([None if x is None else len(x) // 4 for x in coded], pa.int64())}

        return step

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, make, "doc_id long, ids array<int>, n_pieces long")


def decode(coded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of each row of ids; null ids give a null text."""

    def make():
        coder = model_of(model)

        def step(c: dict[str, list]) -> dict[str, object]:
            return {"doc_id": c["doc_id"], "text": pa.array([None if x is None else coder.decode(x) for x in c["ids"]], pa.string())}

        return step

    rows = coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
    return map_batches(rows, make, "doc_id long, text string")


def encode_checked(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode() with round_trip: the ids decode to the text again (a literal space mark in a text decodes to a space)."""

    def make():
        coder = model_of(model)

        def step(c: dict[str, list]) -> dict[str, object]:
            coded = [None if t is None else coder.encode(t) for t in c["text"]]
            arrays = [np.frombuffer(x or b"", "<i4") for x in coded]
            ends = np.cumsum([0] + [len(x) for x in arrays], dtype=np.int32)
            mask = pa.array([x is None for x in coded])
            same = [None if t is None else coder.decode(a) == t.replace(SPACE, " ") for t, a in zip(c["text"], arrays)]
            flat = pa.array(np.concatenate(arrays) if arrays else np.empty(0, "<i4"))
            return {"doc_id": c["doc_id"], "ids": pa.ListArray.from_arrays(pa.array(ends), flat, mask=mask), "n_pieces": pa.array([None if x is None else len(x) // 4 for x in coded], pa.int64()), "round_trip": pa.array(same, pa.bool_())}

        return step

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, make, "doc_id long, ids array<int>, n_pieces long, round_trip boolean")
