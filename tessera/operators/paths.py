"""Property paths. Sequences, inverses and alternatives are joins, swaps and unions; repetition is a semi-naive fixpoint.

A fixpoint starts at the bound end, if one is, or at the nodes that the rest of the pattern leaves for an end, so it follows only what can be reached from there. Each round joins
the newest pairs with the edges and removes what is known by an anti-join; where nothing is bound it joins them with all known pairs, so path lengths double. Rounds are settled on
shared files, so plans do not grow.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.lineage import settled, settled_with_count
from tessera.plans.relation import Rel, join, semi, union
from tessera.terms import Iri, Var
from tessera.values import VT, constant, same_term, to

S, O = "__s", "__o"
#: So many hops from a bound end are one job.
HOPS = 3


class PathMixin:
    def path(self, s, path, o, g) -> Rel:
        """Solutions of a path between two terms or variables."""
        if isinstance(path, Iri):
            return self.bgp([(s, path, o)], g)
        kind = path[0]
        if kind == "inv":
            return self.path(o, path[1], s, g)
        if kind == "alt":
            return union([self.path(s, path[1], o, g), self.path(s, path[2], o, g)])
        if kind == "seq":
            self.marks += 1
            middle = Var(f"__m{self.marks}")
            r = join(self.path(s, path[1], middle, g), self.path(middle, path[2], o, g))
            return r.keep([n for n in r.vt if n != middle.name]) if len(r.vt) > 1 else Rel(r.df.select(F.lit(1).alias("__unit")), {}, r.size)
        if kind == "neg":
            parts = [self._negated(s, o, path[1], g)] if path[1] or not path[2] else []
            if path[2]:
                parts.append(self._negated(o, s, path[2], g))
            return union(parts)
        return self._closure(s, kind, path[1], o, g)

    def _negated(self, s, o, listed: list[str], g) -> Rel:
        """Triples whose predicate is not listed."""
        names = [x.name for x in (s, o) if isinstance(x, Var)]
        found = [p for p in self.partitions(s, Var("__p"), o, g) if p.predicate not in listed]
        if not found:
            return self.empty(names)
        return union([self.scan([((s, Iri(p.predicate), o), p)], g) for p in found])

    def edges(self, path, g) -> Rel:
        """All pairs of a path, once each, in one form."""
        r = self.path(Var(S), path, Var(O), g)
        vt = r.vt[S]
        for t in (r.vt[O],):
            vt = vt if vt.same(t) else VT("iri") if vt.kind == t.kind == "iri" else VT("poly")
        vt = vt.bound()
        return Rel(r.df.select(to(r.e(S), vt).alias(S), to(r.e(O), vt).alias(O)).distinct(), {S: vt, O: vt}, r.size)

    def path_from(self, s: Var, path: tuple, o: Var, g, r: Rel, end: int) -> Rel:
        """A repeated path of which one end (0: s, 1: o) is among the values that r has for it."""
        kind, inner = path
        if end:
            return self.path_from(o, (kind, ("inv", inner)), s, g, r, 0)
        seeds = r.keep([s.name])
        return self._closure(s, kind, inner, o, g, Rel(settled(seeds.df.select(F.col(f"`{s.name}`").alias(S)).distinct()), {S: seeds.vt[s.name].bound()}, seeds.size))

    def _closure(self, s, kind: str, path, o, g, seeds: Rel | None = None) -> Rel:
        if isinstance(s, Var) and not isinstance(o, Var):  # from the bound end
            return self._closure(o, kind, ("inv", path), s, g)
        step = self.edges(path, g)
        vt = step.vt[S]
        step_df = step.df
        if kind != "opt":
            step_df = settled(step_df)
        if seeds is not None:
            newest = semi(Rel(step_df, step.vt, step.size), seeds, "left_semi").df
        elif isinstance(s, Var):
            newest = step_df
        else:
            start = constant(s)
            same = same_term(step.e(S), start)
            newest = step_df.where(F.lit(False) if same is None else same)
        known = newest
        if kind != "opt":
            known, n = settled_with_count(newest)
            newest, free = known, seeds is None and isinstance(s, Var)
            while n:
                hop = (known if free else step_df).select(F.col(S).alias("__m"), F.col(O).alias("__n"))
                found, parts = newest, []
                for _ in range(1 if free else HOPS):
                    found = found.join(hop, F.col(O) == F.col("__m")).select(S, F.col("__n").alias(O)).distinct()
                    parts.append(found)
                found = reduce(DataFrame.unionAll, parts).distinct() if len(parts) > 1 else found
                newest, n = settled_with_count(found.join(known, [S, O], "left_anti"))
                known = known.unionAll(newest)
        pairs = Rel(known, {S: vt, O: vt}, step.size)
        if kind in ("star", "opt"):
            pairs = self._with_self(pairs, s, g, seeds)
        return self._named(pairs, s, o)

    def _with_self(self, pairs: Rel, s, g, seeds: Rel | None = None) -> Rel:
        """Paths of length zero: each node, or the given term even if it is not in the data."""
        if not isinstance(s, Var):
            e = constant(s)
            one = Rel(self.spark.range(1).select(e.col.alias(S), e.col.alias(O)), {S: e.vt, O: e.vt}, 1.0)
            both = union([pairs, one])
        else:
            nodes = seeds or self.nodes(g)
            both = union([pairs, Rel(nodes.df.select(F.col(S), F.col(S).alias(O)), {S: nodes.vt[S], O: nodes.vt[S]}, nodes.size)])
        return Rel(both.df.distinct(), both.vt, both.size)

    def nodes(self, g) -> Rel:
        """All subjects and objects of the active graph."""
        triple, parts = (Var(S), Var("__p"), Var(O)), []
        for r in self.scans(triple, self.partitions(*triple, g), g):
            parts += [r.keep([S]), Rel(r.df.select(F.col(O).alias(S)), {S: r.vt[O]}, r.size)]
        if not parts:
            return self.empty([S])
        r = union(parts)
        return Rel(r.df.distinct(), r.vt, r.size)

    def _named(self, r: Rel, s, o) -> Rel:
        """The pairs with the path's ends for names; a bound end is a condition, the same variable at both ends an equality."""
        df, names, vt = r.df, [], {}
        for term, col in ((s, S), (o, O)):
            if not isinstance(term, Var):
                same = same_term(r.e(col), constant(term))
                df = df.where(F.lit(False) if same is None else same)
            elif term.name in vt:
                df = df.where(same_term(r.e(S), r.e(O)))
            else:
                names.append(F.col(col).alias(term.name))
                vt[term.name] = r.vt[col]
        return Rel(df.select(*names) if names else df.select(F.lit(1).alias("__unit")), vt, r.size)

