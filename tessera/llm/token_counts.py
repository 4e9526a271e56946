"""Token counts of a byte-level byte-pair vocabulary, by merging on a heap and a linked list.

The initial symbols of a pre-token are its UTF-8 bytes. A heap holds the adjacent pairs by (rank, position); the lowest is
popped again and again, and each pair that is still there merges. The count is the number of initial symbols less the number of
merges; no identifiers are made. Pre-tokens recur, so a memo of bounded size keeps their counts.

Results for odd rows: a null text counts as empty (0 bytes, 0 tokens, not over the limit); a very long text is counted whole; rows with the same or a null doc_id are counted one by
one; other columns are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import json
from functools import lru_cache
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Memo, map_batches

#: The pattern by which byte-level vocabularies cut a text into pre-tokens.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class MergeCounter:
    """Counts tokens of whole texts."""

    def __init__(self, path: str, memo: int = 1_000_000):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.byte_id = [0] * 256
        for c, b in byte_symbols().items():
            self.byte_id[b] = vocab[c]
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault(vocab[a] << 20 | vocab[b], rank)
            self.merged.append(vocab[a + b])
        special = [t["content"] for t in spec.get("added_tokens", ())]
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        # the vocabulary's white space is Unicode's property; the module's \s also holds U+001C to U+001F
        self.pieces = regex.compile(PRETOKEN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")).findall
        self.odd = regex.compile("[^\\P{White_Space} \n]").search
        self.memo = Memo(self._chunk, memo)
        self.piece_memo = Memo(lambda piece: self.merge(piece.encode("utf-8", "surrogatepass")), memo // 4)

    def merge(self, piece: bytes) -> int:
        n = len(piece)
        if n < 2:
            return n
        symbol = [self.byte_id[b] for b in piece]
        right, left = list(range(1, n + 1)), list(range(-1, n))
        rank, get = self.rank, self.rank.get
        heap = [r * n + i for i in range(n - 1) if (r := get(symbol[i] << 20 | symbol[i + 1])) is not None]
        heapify(heap)
        merges = 0
        while heap:
            r, i = divmod(heappop(heap), n)
            j = right[i]
            if j >= n or symbol[i] < 0 or get(symbol[i] << 20 | symbol[j]) != r:
                continue
            merges += 1
            symbol[i], symbol[j] = self.merged[r], -1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if (p := symbol[i] << 20 | symbol[k]) in rank:
                    heappush(heap, rank[p] * n + i)
            h = left[i]
            if h >= 0 and (p := symbol[h] << 20 | symbol[i]) in rank:
                heappush(heap, rank[p] * n + h)
        return n - merges

    def _chunk(self, word: str) -> int:
        """The count of a word after a space, or after a line break where it begins with one."""
        return sum(self.merge(p.encode("utf-8", "surrogatepass")) for p in self.pieces(word if word[0] == "\n" else " " + word))

    def _plain(self, text: str) -> int:
        """The count of a text without special strings. A pre-token begins wherever white space follows something else, so words are counted for themselves."""
        words = text.replace("\n", " \n").split(" ")
        if "" in words or "\n" in words or self.odd(text):  # runs of white space, or rarer kinds
            return sum(map(self.piece_memo.__getitem__, self.pieces(text)))
        return sum(map(self.piece_memo.__getitem__, self.pieces(words[0]))) + sum(map(self.memo.__getitem__, words[1:]))

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


@lru_cache(maxsize=2)
def counter_of(path: str) -> MergeCounter:
    """One counter for each worker process and vocabulary."""
    return MergeCounter(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of each row."""

    def make():
        counter = counter_of(vocabulary)

        def step(c: dict[str, list]) -> dict[str, object]:
            texts = [t or "" for t in c["text"]]
            tokens = [counter.count(t) for t in texts]
            return {"doc_id": c["doc_id"], "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts], "n_tokens": tokens, "over_limit": [t > limit for t in tokens]}

        return step

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
