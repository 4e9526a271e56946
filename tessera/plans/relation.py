"""Solution sequences as DataFrames: a column for each variable, with static types, and the joins of SPARQL on them."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.values import VT, E, common, same_term, to


#: Joins on up to so many variables that may be unbound are taken apart by which are bound.
MOST_LOOSE = 3


@dataclass
class Rel:
    df: DataFrame
    vt: dict[str, VT]
    size: float = 1e9  # bytes, roughly: for the order of joins
    keys: tuple[frozenset[str], ...] = ()  # variables that together tell a row, or nearly so: for the order of joins

    def e(self, name: str, prefix: str = "") -> E | None:
        return E(F.col(f"`{prefix}{name}`"), self.vt[name]) if name in self.vt else None

    def keep(self, names) -> Rel:
        names = [n for n in names if n in self.vt]
        return Rel(self.df.select(*[F.col(f"`{n}`") for n in names]), {n: self.vt[n] for n in names}, self.size)


def both(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _renamed(r: Rel, prefix: str) -> DataFrame:
    return r.df.select(*[F.col(f"`{n}`").alias(prefix + n) for n in r.vt])


def _match(a: Rel, b: Rel, name: str, compatible: bool) -> tuple[Column | None, E]:
    """The condition on one shared variable, and the joined value. None: they never match."""
    x, y = E(F.col(f"`l_{name}`"), a.vt[name]), E(F.col(f"`r_{name}`"), b.vt[name])
    same = same_term(x, y)
    if not compatible:
        value = x if y.vt.kind == "poly" or x.vt.kind != "poly" else y
        return same, E(value.col, replace(value.vt, opt=False))
    vt = common(x.vt, y.vt)
    cond = x.col.isNull() | y.col.isNull()
    return (cond if same is None else cond | same), E(F.coalesce(to(x, vt), to(y, vt)), replace(vt, opt=x.vt.opt and y.vt.opt))


def join(a: Rel, b: Rel, how: str = "inner", extra=None) -> Rel:
    """Joins compatible solutions. extra(lookup) gives a further condition. how: inner or left.

    A variable that can't be unbound on either side is an equality, so Spark can hash or merge. In an inner join, variables that
    can be unbound are taken apart into bound and unbound rows, so that each part is an equality join too; in a left join, those that can be
    unbound on the left side only.
    """
    shared = [n for n in a.vt if n in b.vt]
    loose = [n for n in shared if a.vt[n].opt or b.vt[n].opt]
    if how == "inner" and loose and len(loose) <= MOST_LOOSE and extra is None:
        return _join_apart(a, b, loose)
    if how == "left" and loose and len(loose) <= MOST_LOOSE and not any(b.vt[n].opt for n in loose):
        return union([join(_parted(a, loose, bound), b, how, extra) for bound in product((True, False), repeat=len(loose))])
    left, right = _renamed(a, "l_"), _renamed(b, "r_")
    conditions, values = [], {}
    for n in shared:
        cond, value = _match(a, b, n, n in loose)
        if how == "left":
            x, y = E(F.col(f"`l_{n}`"), a.vt[n]), E(F.col(f"`r_{n}`"), b.vt[n])
            vt = common(x.vt, y.vt) if a.vt[n].opt else a.vt[n]
            value = E(F.coalesce(to(x, vt), to(y, vt)) if a.vt[n].opt else x.col, replace(vt, opt=a.vt[n].opt))
        conditions.append(F.lit(False) if cond is None else cond)
        values[n] = value
    for n in a.vt:
        values.setdefault(n, E(F.col(f"`l_{n}`"), a.vt[n]))
    for n in b.vt:
        values.setdefault(n, E(F.col(f"`r_{n}`"), replace(b.vt[n], opt=True) if how == "left" else b.vt[n]))
    if extra is not None:
        def look(n: str) -> E | None:
            if n in a.vt and n in b.vt:
                return _match(a, b, n, n in loose)[1]
            return E(F.col(f"`l_{n}`"), a.vt[n]) if n in a.vt else E(F.col(f"`r_{n}`"), b.vt[n]) if n in b.vt else None

        conditions.append(extra(look))
    if conditions:
        df = left.join(right, both(conditions), how)
    else:
        df = left.crossJoin(right) if how == "inner" else left.join(right, F.lit(True), how)
    size = min(a.size, b.size) if shared and how == "inner" else a.size if shared else a.size * max(b.size, 1)
    return Rel(df.select(*[v.col.alias(n) for n, v in values.items()]), {n: v.vt for n, v in values.items()}, size)


def _join_apart(a: Rel, b: Rel, loose: list[str]) -> Rel:
    """The union of the joins of rows that are alike in which of the loose variables they bind."""
    parts = []
    for bound_a, bound_b in product(product(*[(True, False) if a.vt[n].opt else (True,) for n in loose]), product(*[(True, False) if b.vt[n].opt else (True,) for n in loose])):
        p, q = a, b
        for n, x, y in zip(loose, bound_a, bound_b):
            p, q = _part(p, n, x), _part(q, n, y)
        parts.append(join(p, q))
    return union(parts)


def _parted(r: Rel, names: list[str], bound: tuple[bool, ...]) -> Rel:
    for n, x in zip(names, bound):
        r = _part(r, n, x)
    return r


def _part(r: Rel, name: str, bound: bool) -> Rel:
    if not r.vt[name].opt:
        return r
    if bound:
        return Rel(r.df.where(F.col(f"`{name}`").isNotNull()), r.vt | {name: replace(r.vt[name], opt=False)}, r.size)
    return Rel(r.df.where(F.col(f"`{name}`").isNull()).drop(name), {n: t for n, t in r.vt.items() if n != name}, r.size)


def union(parts: list[Rel]) -> Rel:
    """The bag union; a variable that a part lacks is unbound in its rows."""
    names = list(dict.fromkeys(n for p in parts for n in p.vt))
    vt: dict[str, VT] = {}
    for n in names:
        found = [p.vt[n] for p in parts if n in p.vt]
        made = found[0]
        for t in found[1:]:
            made = common(made, t)
        vt[n] = replace(made, opt=made.opt or len(found) < len(parts))
    frames = []
    for p in parts:
        cols = [to(p.e(n), vt[n]).alias(n) if n in p.vt else F.lit(None).alias(n) for n in names]
        frames.append(p.df.select(*cols) if cols else p.df)
    if len(frames) > 1 and names:  # nulls take the type of the other parts
        kinds = {}
        for f, p in zip(frames, parts):
            for field in f.schema:
                if field.name in p.vt:
                    kinds.setdefault(field.name, field.dataType)
        frames = [f.select(*[F.col(f"`{n}`").cast(kinds[n]).alias(n) for n in names]) for f in frames]
    return Rel(reduce(DataFrame.unionAll, frames), vt, sum(p.size for p in parts))


def minus(a: Rel, b: Rel) -> Rel:
    """Removes solutions that are compatible with one of b and share a bound variable with it."""
    shared = [n for n in a.vt if n in b.vt]
    if not shared:
        return a
    right = b.keep(shared)
    right = Rel(right.df.distinct(), right.vt, right.size)
    loose = [n for n in shared if a.vt[n].opt or right.vt[n].opt]
    if len(loose) <= MOST_LOOSE:
        return _semi_apart(a, right, loose, "left_anti", None, True) if loose else semi(a, right, "left_anti")
    conditions, some = [], []
    for n in shared:
        cond, _ = _match(a, right, n, a.vt[n].opt or right.vt[n].opt)
        conditions.append(F.lit(False) if cond is None else cond)
        some.append(F.col(f"`l_{n}`").isNotNull() & F.col(f"`r_{n}`").isNotNull())
    if all(a.vt[n].opt or right.vt[n].opt for n in shared):
        conditions.append(reduce(lambda x, y: x | y, some))
    df = _renamed(a, "l_").join(_renamed(right, "r_"), both(conditions), "left_anti")
    return Rel(df.select(*[F.col(f"`l_{n}`").alias(n) for n in a.vt]), a.vt, a.size)


def _semi_apart(a: Rel, b: Rel, loose: list[str], how: str, extra, some_shared: bool) -> Rel:
    """Rows that are alike in which of the loose variables they bind, against each such part of b, by equality of what both bind."""
    out = []
    for bound_a in product(*[(True, False) if a.vt[n].opt else (True,) for n in loose]):
        rest, hits = _parted(a, loose, bound_a), []
        for bound_b in product(*[(True, False) if b.vt[n].opt else (True,) for n in loose]):
            q = _parted(b, loose, bound_b)
            if some_shared and not set(rest.vt) & set(q.vt):
                continue
            if how == "left_semi":
                hits.append(semi(rest, q, how, extra))
            rest = semi(rest, q, "left_anti", extra)
        out.append(union(hits) if how == "left_semi" else rest)
    made = union(out)
    return Rel(made.keep(a.vt).df, {n: replace(made.vt[n], opt=a.vt[n].opt) for n in a.vt}, a.size)


def semi(a: Rel, b: Rel, how: str, extra=None) -> Rel:
    """left_semi or left_anti on the shared variables; extra(lookup) is a further condition over both."""
    shared = [n for n in a.vt if n in b.vt]
    loose = [n for n in shared if a.vt[n].opt or b.vt[n].opt]
    if loose and len(loose) <= MOST_LOOSE:
        return _semi_apart(a, b, loose, how, extra, False)
    conditions = []
    for n in shared:
        cond, _ = _match(a, b, n, a.vt[n].opt or b.vt[n].opt)
        conditions.append(F.lit(False) if cond is None else cond)
    if extra is not None:
        conditions.append(extra(lambda n: E(F.col(f"`l_{n}`"), a.vt[n]) if n in a.vt else E(F.col(f"`r_{n}`"), b.vt[n]) if n in b.vt else None))
    df = _renamed(a, "l_").join(_renamed(b, "r_"), both(conditions) if conditions else F.lit(True), how)
    return Rel(df.select(*[F.col(f"`l_{n}`").alias(n) for n in a.vt]), a.vt, a.size)
