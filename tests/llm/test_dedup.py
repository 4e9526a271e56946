"""Exact and near duplicates and repeated passages against brute force."""

import random
import re
from collections import Counter
from hashlib import sha256

import pytest

from tessera.llm.common import Scratch
from tessera.llm.components import components
from tessera.llm.exact_dedup import directory, exact_groups
from tessera.llm.near_dedup import near_groups, near_kept
from tessera.llm.substring_dedup import levels, without_repeats


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_directory_doubles_where_full(spark):
    def built(counts, capacity, bits):
        slots = spark.createDataFrame(list(counts.items()), "slot int, n long")
        return {r["slot"]: (r["depth"], r["bucket"]) for r in directory(slots, bits, capacity).collect()}

    assert built({0: 5, 1: 5, 2: 1, 7: 1}, 6, 3) == {0: (3, 0), 1: (3, 1), 2: (2, 2), 7: (1, 4)}
    assert built({0: 100, 3: 1}, 6, 2) == {0: (2, 0), 3: (1, 2)}  # one slot can't split further
    assert built({0: 3, 1: 3}, 6, 1) == {0: (0, 0), 1: (0, 0)} and built({0: 9}, 6, 0) == {0: (0, 0)}


def test_exact_groups(docs, empty, rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, *_ in rows]
    size, best = Counter(norm), {}
    for (i, t, *_), n in zip(rows, norm):
        place = (-len(t or ""), i is None, i or 0)
        best[n] = min(best.get(n, place), place)
    wanted = []
    for (i, _, *_), n in zip(rows, norm):
        keep = None if best[n][1] else best[n][2]
        wanted.append((i, keep, size[n], i == keep, sha256(n.encode()).hexdigest()))
    # at 3 bits of key chains hold many texts, which only their bytes tell apart
    for options in ({}, {"capacity": 8}, {"capacity": 2, "key_bits": 3}, {"capacity": 1, "most_bits": 2}):
        got = [tuple(r) for r in exact_groups(docs, **options).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
        assert sorted(got, key=str) == sorted(wanted, key=str)
    assert exact_groups(empty).count() == 0


@pytest.mark.parametrize("width", [2, 5])
def test_near_groups(docs, empty, rows, width):
    sets, parent = {}, {}
    for i, t, *_ in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in split(t)]
        s = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
        if i is not None:
            sets[i], parent[i] = s, i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = near_groups(docs, width=width).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), find(r["doc_id"]), find(r["doc_id"]) == r["doc_id"])
    assert near_groups(empty, width=width).count() == 0


def components_by_force(rows, width):
    """The least doc_id of each row's component; a row is a document."""
    sets = []
    for _, t in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in split(t)]
        sets.append(frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("edits", ["replace", "drop", "mixed"])
def test_group_that_edits_have_split(spark, edits):
    """500 copies of one text, edited so much that many lie just below the threshold of each other: every link is found, few pairs are compared."""
    rng = random.Random(edits)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for k in range(500):
        w = list(base)
        for _ in range(rng.choice((3, 5, 6, 7, 9, 12))):
            at = rng.randrange(len(w))
            how = rng.choice(("replace", "drop", "insert")) if edits == "mixed" else edits
            w[at : at + (how != "insert")] = [] if how == "drop" else [f"e{rng.randrange(60)}"]
        rows.append((1000 - k, " ".join(w)))
    rows += [(2000 + k, rows[k][1] + f" x{k % 3}") for k in range(0, 500, 9)]
    got = near_groups(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == components_by_force(rows, 2)


def test_repeated_ids_keep_their_links(spark):
    c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "cd")
    rows = [(1, c), (1, d), (5, c + " z1"), (6, d + " z2"), (7, c), (7, d), (7, d), (9, "alone here")]
    got = near_groups(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == components_by_force(rows, 2)
    kept = near_kept(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 1, 9] and len({r["mark"] for r in kept}) == 3


def test_repeated_ids_keep_their_windows(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    texts = {"A": passage, "B": "q " + passage}
    rows = [(1, f"pre1 {texts['A']} post1"), (1, f"pre2 {texts['B']} post2"), (2, f"x {texts['A']}"), (3, f"y {texts['B']}"), (4, "twice " * 50), (4, "twice " * 50), (4, "other words")]
    got = sorted(map(tuple, without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    count = Counter(tuple(w[k : k + 35]) for w in (split(t) for _, t in rows) for k in range(len(w) - 34))
    wanted = []
    for i, t in rows:
        w, gone = split(t), set()
        for k in range(len(w) - 34):
            if count[tuple(w[k : k + 35])] > 1:
                gone.update(range(k, k + 35))
        wanted.append((i, len(w), len(gone), sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    assert got == sorted(wanted) and len(got) == len(rows)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("tessera_") and "store" not in t.name]


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(1, 30)] + [(7, 7), (None, 3), (200, 300)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect())
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30)) and got[300] == 200 and len(got) == 41 + 30 + 2


def test_levels():
    assert levels(35) == [9, 18, 35] and levels(8) == [8] and levels(3) == [3]


@pytest.mark.parametrize("width", [35, 8])
def test_without_repeats(docs, empty, rows, width):
    texts = [split(t) for _, t, *_ in rows]
    count = Counter(tuple(w[k : k + width]) for w in texts for k in range(len(w) - width + 1))
    wanted = []
    for (i, *_), w in zip(rows, texts):
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if count[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        wanted.append((i, len(w), sum(gone), sha256(kept.encode()).hexdigest()))
    got = [tuple(r) for r in without_repeats(docs, width=width).collect()]
    assert sorted(got, key=str) == sorted(wanted, key=str)
    assert without_repeats(empty, width=width).count() == 0
