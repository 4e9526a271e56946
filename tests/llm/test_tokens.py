"""Both tokenisers against the public libraries, on the fixture and on random texts."""

import random

import numpy as np
import pytest

from tessera.llm.queries import tokenizer
from tessera.llm.sentencepiece_codec import PieceModel, automaton, decode, encode, encode_checked, model_type
from tessera.llm.token_counts import MergeCounter, token_counts

POOL = "ab cdé\n\t \r\x0b\x0c\x1c\x85\xa0　​漢字ñ½٣'sldre\U0001f600<|endoftext|>▁ the of  thing\x00\x7f́"


@pytest.fixture(scope="module")
def texts(rows):
    rng = random.Random(2)
    made = ["".join(rng.choices(POOL, k=rng.randrange(60))) for _ in range(2000)]
    return [t for _, t, *_ in rows if t] + made + ["a<|endoftext|>b <|endoftext|><|endoftext|>", " " * 40 + "x", "ab" * 3000 + " " * 300, "a\n\nb \n c", "\n", "\na"]


def test_counts_match_the_library(texts):
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(tokenizer("byte_bpe_50k.json")), MergeCounter(tokenizer("byte_bpe_50k.json"), memo=500)
    assert [own.count(t) for t in texts] == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]


def test_ids_match_the_library(texts):
    import sentencepiece

    lib, own = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model")), PieceModel(tokenizer("piece_bpe_32k.model"), memo=500)
    for t in texts:
        ids = np.frombuffer(own.encode(t), "<i4").tolist()
        assert ids == lib.encode(t)
        assert own.decode(ids) == lib.decode(ids)


def test_unigram_spans():
    """The best summed score, against all ways to cut a span; of equal sums the longest last piece."""
    rng = random.Random(6)
    own = PieceModel(tokenizer("piece_bpe_32k.model"))
    own.pair_model, own.pieces, own.score = False, {}, {}
    for k, p in enumerate(["a", "b", "ab", "ba", "aab", "bb", "abab", "c"]):
        own.pieces[p], own.score[p] = k, -rng.random() * len(p) - 0.5
    own.usable, own.longest, own.least = frozenset(own.pieces), 4, min(own.score.values())

    def best(t):
        return max(((own.score[t[:n]] + s, [t[:n], *rest]) for n in range(1, min(4, len(t)) + 1) if t[:n] in own.score for s, rest in [best(t[n:])]), key=lambda x: x[0]) if t else (0.0, [])

    for _ in range(200):
        t = "".join(rng.choices("abc", k=rng.randrange(1, 14)))
        got = [list(own.pieces)[i] for i in own.search(t)]
        assert "".join(got) == t and sum(own.score[p] for p in got) == pytest.approx(best(t)[0])
    long = "".join(rng.choices("abc", k=500))  # far over the window
    whole, parts = own.search(long), []
    own.longest = 500
    assert [own.score[list(own.pieces)[i]] for i in whole] and sum(own.score[list(own.pieces)[i]] for i in whole) == pytest.approx(sum(own.score[list(own.pieces)[i]] for i in own.search(long)))


def test_other_models_are_refused():
    spec = lambda n, body: bytes([n << 3 | 2, len(body)]) + body
    plain = spec(2, b"\x18\x02") + spec(3, b"\x18\x01\x20\x00")
    assert model_type(plain) == 2 and model_type(spec(3, b"\x20\x00")) == 1
    for odd in (spec(2, b"\x18\x03") + spec(3, b"\x20\x00"), spec(3, b"\x20\x01"), spec(3, b"\x12\x01x\x20\x00"), spec(3, b"\x18\x00\x20\x00")):
        with pytest.raises(ValueError):
            model_type(odd)


def test_window_commits():
    """Spans far longer than the window give what the library gives, in pieces committed on the way."""
    import sentencepiece

    lib, own = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model")), PieceModel(tokenizer("piece_bpe_32k.model"))
    rng = random.Random(3)
    kept = []
    emit = own._emit
    own._emit = lambda last, end, out: (kept.append(len(last)), emit(last, end, out))[1]
    for _ in range(20):
        t = "".join(rng.choices("thenrofandigs", k=3000))
        assert np.frombuffer(own.encode(t), "<i4").tolist() == lib.encode(t)
    assert max(kept) < 8 * own.longest


class Asked(dict):
    """Counts how often it is asked what `inner` holds."""

    def __init__(self, inner):
        super().__init__()
        self.inner, self.n = inner, 0

    def __contains__(self, key):
        self.n += 1
        return key in self.inner

    def __getitem__(self, key):
        self.n += 1
        return self.inner[key]


def syllables(n):
    """Made-up words of several languages, most of them found once."""
    rng = random.Random(8)
    parts = "the ing ble tion sh oua eux é qu ñ ción der sch ü ß or. ly, x9 Th".split()
    return ["".join(rng.choices(parts, k=rng.randrange(1, 9))) for _ in range(n)]


def test_work_of_a_search():
    """Only pieces that end at a boundary are tried, not all that lies in the window: a few questions a character, in words and in long spans."""
    own = PieceModel(tokenizer("piece_bpe_32k.model"))
    for text in (" ".join(syllables(3000)), "".join(syllables(800))):
        own.fits, own.usable = Asked(own.fits), Asked(own.usable)
        own.encode(text)
        assert 0 < own.fits.n + own.usable.n < 3 * len(text)
        own.fits, own.usable = own.fits.inner, own.usable.inner


def test_pairs_are_found_out_once():
    """The memo of pairs has room for what many words ask for."""
    own = PieceModel(tokenizer("piece_bpe_32k.model"), memo=8000)
    found, fn = [], own.fits.fn
    own.fits.fn = lambda pair: (found.append(pair), fn(pair))[1]
    words = syllables(6000)
    own.encode(" ".join(words))
    assert 2000 < len(set(found)) < 8000 and len(found) == len(set(found))
    own.encode(" ".join(words[::-1]))
    assert len(found) == len(set(found))


@pytest.mark.parametrize("room", [0, 3, 10_000])
def test_automaton(room):
    """At each place the pieces that end there, the longest first, however little is learned."""
    rng = random.Random(9)
    pieces = {"".join(rng.choices("abc", k=rng.randrange(1, 6))) for _ in range(60)}
    state, read = automaton(pieces, room), ""
    for c in rng.choices("abcd", k=2000):
        state, read = state[c], read + c
        assert [p for p, _ in state.out] == [read[-n:] for n in range(min(5, len(read)), 0, -1) if read[-n:] in pieces]
        assert all(len(p) == n for p, n in state.out)


@pytest.mark.parametrize("memo", [8, 300_000])
def test_made_up_words_match_the_library(memo):
    """Spans shorter and longer than the head that a memo keeps and than the window."""
    import sentencepiece

    lib, own = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model")), PieceModel(tokenizer("piece_bpe_32k.model"), memo=memo)
    words = syllables(3000)
    for t in (*words[:1000], " ".join(words), "\n".join(words), "  ".join(words[:500]), "".join(words[:500])):
        assert np.frombuffer(own.encode(t), "<i4").tolist() == lib.encode(t)


def test_queries_on_odd_rows(docs, empty, rows):
    counts = token_counts(docs, tokenizer("byte_bpe_50k.json")).collect()
    assert len(counts) == len(rows) and {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in counts}[300] == (0, 0, False)
    assert token_counts(empty, tokenizer("byte_bpe_50k.json")).count() == 0
    model = tokenizer("piece_bpe_32k.model")
    coded = encode_checked(docs, model).collect()
    by_id = {r["doc_id"]: r for r in coded}
    assert len(coded) == len(rows) and by_id[300]["ids"] is None and by_id[301]["ids"] == [] and all(r["round_trip"] in (True, None) for r in coded)
    back = {r["doc_id"]: r["text"] for r in decode(encode(docs, model), model).collect() if r["doc_id"] is not None}
    assert all(back[i] == (t if t is None else t.replace("▁", " ")) for i, t, *_ in rows if i is not None)
    assert encode_checked(empty, model).count() == 0
