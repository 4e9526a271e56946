"""Near duplicates by b-bit MinHash.

A document's set is its distinct word shingles. Equal sets form one class, found by a fingerprint of the set; all else is on classes. Of `bands * rows` minima each
band of `rows` makes a bucket key; of every minimum one low bit is kept, so a signature packs into a few 64-bit words. Pairs of
candidates come from shared buckets; the share of equal bits, corrected for those that agree by chance, estimates their
similarity, and pairs well below the threshold (by `slack`, over five standard errors) go. The rest are confirmed on the full sets. A pair at the
threshold shares no bucket with a probability of 3e-7 (defaults).

No bucket is expanded into all its pairs. First every member is paired with its bucket's least and greatest member, and the two
of the highest estimate are confirmed. That leaves buckets whose members are still of several components, most of all where edits have
split a large group of near copies. There the members, by the component most frequent in their bucket, form families. A family's base is the set of the
shingles that more than half of its members have, and a member is described by its differences to the base. Two members' sets differ by what only one
of their differences has, so similar members share so many differences that each must have one of the other's among its rarest (a prefix, of a length
that follows from the threshold). Only members that share one there are compared, by their whole differences, which is the exact test of their full sets. So no link
between components is left out, and copies that are edited each in its own way meet nowhere.

A row is a document of its own. Results for odd rows: a null text and one without words have an empty set, n_shingles 0, and are linked with nothing; a text of fewer words
than a shingle has its whole sequence as its one shingle; rows that repeat doc_id and text are in one class; rows of one doc_id with
several texts each have the component of their text; a null doc_id gives a null component_id and
kept true, and links nothing; a very long text is one row like any other; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import U64, Memo, Scratch, hash64, map_batches, mix
from tessera.llm.components import components


def shingle_set(text: str | None, code: Memo, width: int) -> np.ndarray:
    """The sorted distinct hashes of the shingles. Letters A to Z are lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(code.__getitem__, words), U64, len(words))
    if len(h) == 0:
        return h
    if len(h) < width:
        out = U64(len(h)).reshape(1)
        for x in h:
            out = mix(out, x.reshape(1))
        return out
    out = h[: len(h) - width + 1]
    for i in range(1, width):
        out = mix(out, h[i : len(h) - width + 1 + i])
    return np.unique(out)


class Signer:
    def __init__(self, bands: int, rows: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
        self.buffer = np.empty((256, bands * rows), np.uint32)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        h = (shingles >> U64(32)).astype(np.uint32)
        low = None
        for at in range(0, len(h), 256):
            part = h[at : at + 256]
            v = self.buffer[: len(part)]
            np.multiply.outer(part, self.a, out=v)
            v += self.b
            m = v.min(0)
            low = m if low is None else np.minimum(low, m)
        return low

    def sign(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bands' keys, and the low bits in 64-bit words."""
        low = self.minima(shingles).astype(U64)
        keys = np.arange(1, self.bands + 1, dtype=U64)
        parts = low.reshape(self.bands, self.rows)
        for i in range(self.rows):
            keys = mix(keys, parts[:, i])
        bits = (mix(low, low) & U64(1)).astype(np.uint8)
        bits = np.concatenate([bits, np.zeros(-len(bits) % 64, np.uint8)])
        return keys.view(np.int64), np.packbits(bits).view(np.int64)


def marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def signatures(docs: DataFrame, width: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, mark (a hash of the text), n, print (16 bytes), keys and bits of each row; keys and bits are null for an empty set."""

    def make():
        import xxhash

        code, signer = Memo(hash64), Signer(bands, rows)

        def step(c: dict[str, list]) -> dict[str, object]:
            sets = [shingle_set(t, code, width) for t in c["text"]]
            signed: dict[bytes, tuple] = {}
            prints = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            for p, s in zip(prints, sets):
                if len(s) and p not in signed:
                    signed[p] = signer.sign(s)
            got = [signed.get(p) for p in prints]
            return {
                "doc_id": c["doc_id"], "mark": c["mark"], "n": [len(s) for s in sets], "print": pa.array(prints, pa.binary()),
                "keys": pa.array([None if g is None else g[0] for g in got], pa.list_(pa.int64())), "bits": pa.array([None if g is None else g[1] for g in got], pa.list_(pa.int64())),
            }

        return step

    return map_batches(marked(docs, id_col, text_col), make, "doc_id long, mark long, n long, print binary, keys array<long>, bits array<long>", rows=256)


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose full sets are similar: 100 * common >= percent * united."""

    def make():
        code = Memo(hash64)
        known = Memo(lambda key: shingle_set(key[1], code, width), 64)

        def step(c: dict[str, list]) -> dict[str, object]:
            a, b = [], []
            for x, y, s, t in zip(c["a"], c["b"], c["text_a"], c["text_b"]):
                p, q = known[x, s], known[y, t]
                common = len(np.intersect1d(p, q, assume_unique=True))
                if 100 * common >= percent * (len(p) + len(q) - common):
                    a.append(x)
                    b.append(y)
            return {"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())}

        return step

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return map_batches(both, make, "a long, b long", rows=64)


def estimated(pairs: DataFrame, classes: DataFrame, n_bits: int, percent: int, slack: float) -> DataFrame:
    """Adds similar, the estimate, to pairs (a, b), and leaves those that it or their sizes rule out."""
    words = (n_bits + 63) // 64
    a = classes.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    b = classes.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
    apart = sum(F.bit_count(F.col("bits_a")[i].bitwiseXOR(F.col("bits_b")[i])) for i in range(words))
    both = pairs.join(a, "a").join(b, "b").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    # bits of different minima agree half of the time
    return both.select("a", "b", (1 - 2 * apart / F.lit(float(n_bits))).alias("similar")).where(F.col("similar") >= percent / 100 - slack)


def best_stars(tied: DataFrame, classes: DataFrame, n_bits: int, percent: int, slack: float, most: int = 2) -> DataFrame:
    """(a, b): each member b of a bucket with those of its buckets' ends that are most like it."""
    pairs = tied.select(F.col("low").alias("a"), F.col("id").alias("b")).unionByName(tied.select(F.col("high").alias("a"), F.col("id").alias("b"))).where("a <> b").distinct()
    best = W.partitionBy("b").orderBy(F.col("similar").desc(), "a")  # at most two rows for each band
    ranked = estimated(pairs, classes, n_bits, percent, slack).withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= most).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def families(tied: DataFrame, labels: DataFrame) -> DataFrame:
    """(family, id, label) of the members of buckets of several components; the family is the most frequent component, of equals the least."""
    named = labels.select(F.col("node").alias("id"), "label")
    placed = tied.select("key", "id").join(named, "id", "left").withColumn("label", F.coalesce("label", "id"))
    counts = placed.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    major = counts.groupBy("key").agg(F.max(F.struct("c", (-F.col("label")).alias("minus"))).alias("top"), F.count(F.lit(1)).alias("labels"))
    return placed.join(major.where("labels > 1").select("key", (-F.col("top.minus")).alias("family")), "key").select("family", "id", "label").distinct()


def shingled(members: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Adds shingles to (family, members, id, label)."""

    def make():
        code = Memo(hash64)

        def step(c: dict[str, list]) -> dict[str, object]:
            sets = [shingle_set(t, code, width).view(np.int64) for t in c["text"]]
            return {k: c[k] for k in ("family", "members", "id", "label")} | {"shingles": pa.array(sets, pa.list_(pa.int64()))}

        return step

    size = members.groupBy("family").agg(F.count(F.lit(1)).alias("members"))
    known = members.join(size, "family").join(texts, "id").select("family", "members", "id", "label", "text")
    return map_batches(known, make, "family long, members long, id long, label long, shingles array<long>", rows=64)


def differences(sets: DataFrame, percent: int) -> DataFrame:
    """(family, id, label, diff, need): diff has the shingles in which a member and the base of its family differ. Members x and y are similar if and only if
    their diffs share at least (need_x + need_y) / (2 * (100 + percent)) shingles."""
    held = sets.select("family", "members", F.explode("shingles").alias("shingle")).groupBy("family", "members", "shingle").agg(F.count(F.lit(1)).alias("c"))
    # no longer than twice the mean set of the family
    base = held.where(F.col("c") * 2 > F.col("members")).groupBy("family").agg(F.collect_list("shingle").alias("base"))
    both = sets.join(base, "family", "left").withColumn("base", F.coalesce("base", F.array().cast("array<bigint>")))
    diff = F.concat(F.array_except("shingles", "base"), F.array_except("base", "shingles"))
    return both.select("family", "id", "label", diff.alias("diff"), F.size("shingles").alias("n")).select("family", "id", "label", "diff", ((100 + percent) * F.size("diff") - (100 - percent) * F.col("n")).cast("long").alias("need"))


def links_between(diffs: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b): labels of components that a pair of members links."""
    step = 2 * (100 + percent)
    outside = F.col("label") != F.col("family")
    figures = diffs.groupBy("family").agg(F.min("need").alias("least"), F.min_by("label", "need").alias("least_label"), F.min(F.when(outside, F.col("need"))).alias("least_outside"))
    known = diffs.join(figures, "family")
    # needs of at most 0 together: similar whatever is shared; then both are so with the member of the least need
    sure = known.where((F.col("need") + F.col("least") <= 0) & (F.col("label") != F.col("least_label"))).select(F.col("label").alias("a"), F.col("least_label").alias("b"))

    # of every pair one is outside its family's component: it is sought among the outsiders' prefixes, by the prefixes of all. The more an outsider needs, the
    # shorter are the prefixes that have to seek it, so outsiders are told apart by levels of their need, of doubling widths: each member seeks on each level
    level = F.floor(F.log2((F.col("need") - F.col("least_outside")) / F.lit(float(step)) + 1)).cast("int")
    outsiders = known.where(outside).select("family", "need", level.alias("level"))
    floors = outsiders.groupBy("family", "level").agg(F.min("need").alias("floor")).groupBy("family").agg(F.collect_list(F.struct("level", "floor")).alias("floors"))
    prefix = lambda other: F.greatest(F.size("diff") + 1 - F.greatest(F.lit(1), F.ceil((F.col("need") + other) / step)), F.lit(0))
    roles = known.join(floors, "family").withColumn("seeking", F.transform("floors", lambda x: F.struct(x["level"].alias("level"), prefix(x["floor"]).alias("length"))))
    roles = roles.withColumn("level", F.when(outside, level)).withColumn("sought", F.when(outside, prefix(F.col("least"))).otherwise(0))
    roles = roles.withColumn("most", F.greatest("sought", F.array_max(F.transform("seeking", lambda x: x["length"])))).where("most > 0")
    each = roles.select("family", "id", "label", "seeking", "level", "sought", "most", F.explode("diff").alias("shingle"))
    often = diffs.select("family", F.explode("diff").alias("shingle")).groupBy("family", "shingle").agg(F.count(F.lit(1)).alias("c"))
    rarest = W.partitionBy("family", "id").orderBy("c", "shingle")  # the shingles of one document
    placed = each.join(often, ["family", "shingle"]).withColumn("place", F.row_number().over(rarest)).where("c > 1 and place <= most")
    placed = placed.select("family", "shingle", "id", "label", "level", (F.col("place") <= F.col("sought")).alias("sought"), F.expr("transform(filter(seeking, x -> place <= x.length), x -> x.level)").alias("levels"))
    placed = scratch.write(placed, "prefixes")
    one = placed.select("family", "shingle", F.col("id").alias("x"), F.col("label").alias("label_x"), F.explode("levels").alias("level"))
    two = placed.where("sought").select("family", "shingle", F.col("id").alias("y"), F.col("label").alias("label_y"), "level")
    # two outsiders seek each other: once is enough
    met = one.join(two, ["family", "level", "shingle"]).where("label_x <> label_y and (label_x = family or x < y)").select("family", "x", "y").distinct()

    x = diffs.select("family", F.col("id").alias("x"), F.col("label").alias("a"), F.col("diff").alias("diff_x"), F.col("need").alias("need_x"))
    y = diffs.select("family", F.col("id").alias("y"), F.col("label").alias("b"), F.col("diff").alias("diff_y"), F.col("need").alias("need_y"))
    similar = F.size(F.array_intersect("diff_x", "diff_y")) * step >= F.col("need_x") + F.col("need_y")
    found = met.join(x, ["family", "x"]).join(y, ["family", "y"]).where(similar).select("a", "b")
    return scratch.write(found.unionByName(sure).distinct(), "links")


def near_rows(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 64, rows: int = 7, slack: float = 0.16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, mark (a hash of the text), n, component (a number of its own), component_id of each row."""
    scratch, n_bits = Scratch(docs.sparkSession), bands * rows
    signed = scratch.write(signatures(docs, width, bands, rows, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "signed")
    full = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    # a class goes by one of its rows
    members = scratch.write(signed.where(full).groupBy("print").agg(F.min("row").alias("id"), F.min("doc_id").alias("first")), "members")
    classes = scratch.write(signed.select(F.col("row").alias("id"), "doc_id", "mark", "n", "bits", "keys").join(members.select("id"), "id"), "classes")

    # the buckets with two or more members
    entries = classes.select("id", F.explode("keys").alias("key"))
    ends = entries.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    tied = scratch.write(entries.join(ends, "key"), "tied")
    wanted = classes.select("id", "doc_id", "mark").join(tied.select("id").distinct(), "id", "left_semi")
    texts = scratch.write(marked(docs, id_col, text_col).join(wanted, ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"]).select("id", "text"), "texts")

    links = scratch.write(confirmed(best_stars(tied, classes, n_bits, percent, slack), texts, width, percent), "confirmed")
    labels = components(links, scratch)
    kin = scratch.write(families(tied, labels), "families")
    sets = scratch.write(shingled(kin, texts, width), "sets")
    diffs = scratch.write(differences(sets, percent), "differences")
    between = links_between(diffs, percent, scratch)
    wider = components(between, scratch).select(F.col("node").alias("label"), F.col("label").alias("component"))
    scratch.drop(classes, tied, texts, links, kin, sets, diffs, between)

    # classes of several documents get their component's least doc_id, the others have their own
    linked = labels.unionByName(wider.select(F.col("label").alias("node"), F.col("label")).join(labels.select("node"), "node", "left_anti"))
    placed = linked.select(F.col("node").alias("id"), "label").join(wider, "label", "left").select("id", F.coalesce("component", "label").alias("component"))
    known = members.join(placed, "id", "left").withColumn("component", F.coalesce("component", "id"))
    first = known.groupBy("component").agg(F.min("first").alias("component_id"))
    known = known.select("print", "component").join(first, "component")
    own = signed.select("doc_id", "mark", "n", "print", "row")
    some = own.where(full).drop("row").join(known, "print").select("doc_id", "mark", "n", "component", "component_id")
    return some.unionByName(own.where(~full).select("doc_id", "mark", "n", F.col("row").alias("component"), F.col("doc_id").alias("component_id")))


def near_groups(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row; options as of near_rows."""
    rows = near_rows(docs, **options)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id and mark (xxhash64 of the text as a string) of one row of each component: the one of the least doc_id, of these that of the least mark."""
    rows = near_rows(docs, id_col=id_col, text_col=text_col, **options).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return rows.groupBy("component").agg(F.min("doc_id").alias("doc_id"), F.min("mark").alias("mark")).select("doc_id", "mark")
