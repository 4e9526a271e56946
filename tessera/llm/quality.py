"""Quality by weak supervision: rules vote good, vote bad or abstain, and expectation-maximisation weighs them.

Each rule looks at one figure of a text. Votes are coded as one whole number (base 3), so that a corpus of any size has at most 3**rules
patterns; their counts over all rows are all that estimation needs. It starts from the majority, then in turn estimates each
rule's accuracy on good and on bad texts (abstentions count as missing) and each pattern's probability of being good. A text is kept if it does not fail the base rules and
its probability is at least `least`.

Results for odd rows: a null or empty text has no words, fails the base and is not kept; a probability equal to `least` keeps; a very long text is one row like any other; rows with the same or a null doc_id are judged one by one; other
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import U64, Memo, hash64, map_batches, mix, written

SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\x0b\x0c\r"
#: Frequent words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "the of and to in is that it for was on with as at by be this from or an are der die und den von zu das mit sich des ist ein eine nicht auf le la les et un une est que qui dans pour pas sur de du en au aux el los las del se con por para una al lo".split()
)
#: Each rule: the figure, the range in which it votes good, and that outside which it votes bad.
RULES = (
    ("n_words", (80, 200_000), (50, 1_000_000)),
    ("word_length", (3.4, 7.0), (2.5, 12.0)),
    ("symbol_share", (0.0, 0.02), (0.0, 0.1)),
    ("dup_line_share", (0.0, 0.1), (0.0, 0.5)),
    ("repeat_share", (0.0, 0.15), (0.0, 0.3)),
    ("upper_share", (0.0, 0.1), (0.0, 0.3)),
    ("stop_share", (0.1, 0.8), (0.04, 0.9)),
    ("distinct_share", (0.6, 99.0), (0.3, 99.0)),
)
ABSTAIN, BAD, GOOD = 0, 1, 2


def word_code(word: bytes) -> int:
    """A hash of the word; its two lowest bits tell whether it is in capitals and whether it is a stop word."""
    s = word.decode("utf-8", "replace")
    return hash64(word) & ~3 | (len(s) > 1 and s.isupper()) | 2 * (s.lower().strip(".,;:!?\"'()") in STOP_WORDS)


def figures(texts: list[str], code: Memo) -> dict[str, np.ndarray]:
    """The base figures and the rules' figures of a batch of texts."""
    words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    total = int(n.sum())
    h = np.fromiter((x for w in words for x in map(code.__getitem__, w)), U64, total)
    doc = np.repeat(np.arange(len(texts)), n)
    per_doc = lambda x: np.bincount(doc, weights=x, minlength=len(texts)).astype(np.int64)
    repeated = np.zeros(total, bool)
    if total > 2:
        three = mix(mix(h[:-2], h[1:-1]), h[2:])
        three = mix(three, doc[:-2].astype(U64))
        whole = np.flatnonzero(doc[:-2] == doc[2:])
        _, inverse, count = np.unique(three[whole], return_inverse=True, return_counts=True)
        at = whole[count[inverse] > 1]
        for k in range(3):
            repeated[at + k] = True
    own = np.unique(mix(h, doc.astype(U64)), return_index=True)[1] if total else np.empty(0, np.int64)
    lines = [[x for x in t.split("\n") if x.strip(BLANK)] for t in texts]
    n_lines = np.array([len(x) for x in lines], np.int64)
    out = {
        "n_words": n,
        "word_chars": np.array([len(t) - sum(map(t.count, BLANK)) for t in texts], np.int64),
        "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
        "n_repeat_words": per_doc(repeated),
    }
    some = np.maximum(n, 1)
    out |= {
        "word_length": out["word_chars"] / some,
        "symbol_share": out["n_symbols"] / some,
        "dup_line_share": out["n_dup_lines"] / np.maximum(n_lines, 1),
        "repeat_share": out["n_repeat_words"] / some,
        "upper_share": per_doc((h & U64(1)).astype(float)) / some,
        "stop_share": per_doc((h >> U64(1) & U64(1)).astype(float)) / some,
        "distinct_share": np.bincount(doc[own], minlength=len(texts)) / some ** 0.9,
    }
    return out


def vote(x: dict[str, np.ndarray]) -> np.ndarray:
    """The votes as one number: rule j has the digit at 3**j. Shares say nothing about texts of under ten words."""
    code = np.zeros(len(x["n_words"]), np.int64)
    for j, (name, (a, b), (least, most)) in enumerate(RULES):
        v = x[name]
        digit = np.where((v < least) | (v > most), BAD, np.where((v >= a) & (v <= b), GOOD, ABSTAIN))
        code += 3**j * (digit if name == "n_words" else np.where(x["n_words"] < 10, ABSTAIN, digit))
    return code


def votes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base figures, base_failed and the votes of each row."""
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def make():
        code = Memo(word_code)

        def step(c: dict[str, list]) -> dict[str, object]:
            x = figures([t or "" for t in c["text"]], code)
            failed = (x["n_words"] < 50) | (100 * x["n_repeat_words"] > 50 * x["n_words"])
            return {"doc_id": c["doc_id"], "base_failed": failed, "votes": vote(x)} | {k: x[k] for k in base}

        return step

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, make, "doc_id long, " + ", ".join(f"{k} long" for k in base) + ", base_failed boolean, votes long")


def estimate(counts: dict[int, int], rounds: int = 100) -> dict[int, float]:
    """By pattern of votes: the probability that a text is good."""
    if not counts:
        return {}
    patterns = np.array(list(counts), np.int64)
    n = np.array(list(counts.values()), float)
    digit = patterns[:, None] // 3 ** np.arange(len(RULES)) % 3
    good, bad = digit == GOOD, digit == BAD
    p = (good.sum(1) + 1) / (good.sum(1) + bad.sum(1) + 2)
    for _ in range(rounds):
        share = np.clip((n @ p + 1) / (n.sum() + 2), 1e-6, 1 - 1e-6)
        # pseudo-counts hold each rule's accuracy above one half where there is little to go by
        on_good = ((n * p) @ good + 3) / ((n * p) @ (good | bad) + 4)
        on_bad = ((n * (1 - p)) @ bad + 3) / ((n * (1 - p)) @ (good | bad) + 4)
        as_good = good @ np.log(on_good) + bad @ np.log(1 - on_good) + np.log(share)
        as_bad = bad @ np.log(on_bad) + good @ np.log(1 - on_bad) + np.log(1 - share)
        p = 1 / (1 + np.exp(np.clip(as_bad - as_good, -500, 500)))
    return dict(zip(patterns.tolist(), p.tolist()))


def quality(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base figures, base_failed, kept, p_good and votes of each row."""
    table = written(votes(docs, id_col, text_col), "votes")
    # at most 3**len(RULES) rows, whatever the input
    counts = {r["votes"]: r["count"] for r in table.groupBy("votes").count().collect()}
    known = docs.sparkSession.createDataFrame(list(estimate(counts).items()), "votes long, p_good double")
    return table.join(F.broadcast(known), "votes", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("p_good") >= least)).alias("kept"), "p_good", "votes"
    )
