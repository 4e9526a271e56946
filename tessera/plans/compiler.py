"""From the algebra to DataFrames: static typing of variables, merging of star patterns into one scan, join order, modifiers and forms."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import Catalog, Partition, TermMap
from tessera.functions.scalar import evaluate, number_term, truth
from tessera.lineage import settled
from tessera.operators.paths import PathMixin
from tessera.plans.relation import Rel, both, join, minus, semi, union
from tessera.sparql.parser import Query, SparqlError, mentioned, variables
from tessera.terms import DECIMAL, DOUBLE, FLOAT, INTEGER, STRING, WHOLE, BNode, Iri, Lit, Var
from tessera.values import BNODE_KIND, IRI_KIND, LIT_KIND, POLY, VT, E, common, constant, is_wide, lexical, lit, native_columns, number, numeric, order_key, output, physical, poly, same_term, to


@dataclass(frozen=True)
class Graphs:
    """The active graph: none of these set means all graphs together."""

    default: tuple[str, ...] = ()
    named: tuple[str, ...] = ()
    one: str | None = None
    var: str | None = None


def unit(spark: SparkSession) -> Rel:
    return Rel(spark.range(1).select(F.lit(1).alias("__unit")), {}, 1.0)


class Compiler(PathMixin):
    def __init__(self, spark: SparkSession, catalog: Catalog, base: str = "", bindings: dict | None = None):
        self.spark, self.catalog, self.base, self.bindings = spark, catalog, base, bindings or {}
        self.marks = 0
        self.unused: set[str] = set()

    # -- scans ---------------------------------------------------------------------------------------------------------

    @staticmethod
    def vt_of(t: TermMap) -> VT:
        return VT("poly") if t.wide or t.mixed else VT(t.kind, t.dt, t.lang, None if t.const is not None else t.prefix)

    def can_be(self, t: TermMap, term, at_subject: bool = False) -> bool:
        """Whether a term may stand there, by kind, datatype, language and template."""
        if isinstance(term, Var):
            return True
        if isinstance(term, Iri):
            if t.kind != "iri":
                return False
            return t.const == term.value if t.const is not None else t.prefix is None or term.value.startswith(t.prefix)
        if isinstance(term, BNode):
            return t.kind == "bnode"
        return t.kind == "lit" and t.dt == term.dt and (t.lang or "").lower() == (term.lang or "").lower() and t.wide == is_wide(term)

    def partitions(self, s, p, o, graphs: Graphs) -> list[Partition]:
        found = self.catalog.of(p.value if isinstance(p, Iri) else None)
        allowed = {graphs.one} if graphs.one else set(graphs.named) if graphs.var and graphs.named else set(graphs.default)
        return [x for x in found if self.can_be(x.subject, s) and self.can_be(x.object, o) and not (x.graphs is None and allowed and x.graph not in allowed)]

    def scan(self, triples: list[tuple[tuple, Partition]], graphs: Graphs) -> Rel:
        """One scan of a source for the triples of one subject, each with its partition."""
        return self._scan_from(self.catalog.frame(triples[0][1].source), triples, graphs, [])

    def _scan_from(self, df: DataFrame, triples: list[tuple[tuple, Partition]], graphs: Graphs, also: list[str]) -> Rel:
        parts = [p for _, p in triples]
        names: dict[str, E] = {}
        conditions = [F.expr(w) for w in dict.fromkeys(p.where for p in parts if p.where)]
        seen_null: set[str] = set()

        def bind(term, t: TermMap, e: E) -> None:
            if isinstance(term, Var):
                if term.name in names:
                    same = same_term(names[term.name], e)
                    conditions.append(F.lit(False) if same is None else same)
                else:
                    names[term.name] = e
            elif t.const is None:
                same = same_term(e, constant(term))
                conditions.append(F.lit(False) if same is None else same)
            if t.const is None and t.expr not in seen_null and isinstance(term, Var):
                seen_null.add(t.expr)
                conditions.append(e.col.isNotNull())

        for (s, p, o), part in triples:
            bind(s, part.subject, E(part.subject.column(), self.vt_of(part.subject)))
            bind(o, part.object, E(part.object.column(), self.vt_of(part.object), Iri(part.object.const) if part.object.const else None))
            if part.predicate is None:
                bind(p, TermMap("iri", "p"), E(F.col("p"), VT("iri")))
            elif isinstance(p, Var):
                bind(p, TermMap("iri", const=part.predicate), E(F.lit(part.predicate), VT("iri"), Iri(part.predicate)))
            if not isinstance(o, Var) and part.object.const is None and part.object.expr not in seen_null:
                seen_null.add(part.object.expr)
        for p in dict.fromkeys(parts):
            wanted = [graphs.one] if graphs.one else list(graphs.named if graphs.var else graphs.default)
            if wanted and p.graphs is not None:
                conditions.append(F.arrays_overlap(F.expr(p.graphs), F.array(*[F.lit(g) for g in wanted])))
        if graphs.var and graphs.var not in names:
            first = parts[0]
            if first.graphs is None:
                names[graphs.var] = E(F.lit(first.graph), VT("iri"))
            else:
                df = df.withColumn("__g", F.explode(F.expr(first.graphs)))
                if graphs.named:
                    conditions.append(F.col("__g").isin(*graphs.named))
                names[graphs.var] = E(F.col("__g"), VT("iri"))
        elif graphs.var:
            raise SparqlError("a graph variable can't stand in its own triples")
        if conditions:
            df = df.where(both(conditions))
        size = self.estimate(triples)
        if not names and not also:
            return Rel(df.select(F.lit(1).alias("__unit")), {}, size)
        return Rel(df.select(*[e.col.alias(n) for n, e in names.items()], *also), {n: e.vt for n, e in names.items()}, size)

    def estimate(self, triples: list[tuple[tuple, Partition]]) -> float:
        """Bytes, roughly: by the catalog's counts where it has them, else by Spark's statistics."""
        part = triples[0][1]
        if part.rows is None:
            bound = any(not isinstance(x, Var) for (s, _, o), p in triples for x, t in ((s, p.subject), (o, p.object)) if t.const is None)
            return self.catalog.size(part.source) * (0.1 if bound else 1.0)
        (s, _, o), rows = triples[0][0], ROW_BYTES * part.rows
        return rows / (max(1, part.subjects or 1) if not isinstance(s, Var) else 1) / (max(1, part.objects or 1) if not isinstance(o, Var) else 1)

    def scans(self, t: tuple, found: list[Partition], graphs: Graphs) -> list[Rel]:
        """Scans of one triple pattern: partitions of the same rows are read together, the objects of a row side by side and then made into rows."""
        s, p, o = t
        if self.catalog.whole and len(found) > 1 and isinstance(p, Var) and isinstance(o, Var):
            return [self.scan_whole(t, found, graphs)]
        groups: dict[tuple, list[Partition]] = {}
        for p in found:
            together = isinstance(s, (Var, Iri)) and isinstance(o, Var) and not (isinstance(s, Var) and s.name == o.name) and not (isinstance(t[1], Var) and t[1].name in (o.name, getattr(s, "name", None)))
            groups.setdefault((p.source, p.subject, p.graph, p.graphs) if together else (id(p),), []).append(p)
        found = [self.scan([(t, g[0])], graphs) if len(g) == 1 else self.scan_rows(t, g, graphs) for g in groups.values()]
        if isinstance(t[1], Var):  # it is used, so a column stays
            found = [r.keep([n for n in r.vt if n not in self.unused]) for r in found]
        return found

    def scan_whole(self, t: tuple, found: list[Partition], graphs: Graphs) -> Rel:
        """One read of a loaded store's files for many of its partitions; objects of several types come as poly."""
        df = self.catalog.whole()
        if len(found) < len(self.catalog.partitions):
            df = df.where(F.col("part").isin([x.source for x in found]))
        subjects, objects = ({getter(x) for x in found} for getter in (lambda x: x.subject, lambda x: x.object))
        if len(subjects) > 1:
            kind = F.when(F.col("s_kind") == "iri", IRI_KIND).otherwise(BNODE_KIND)
            df = df.withColumn("__s", F.struct(kind.alias("kind"), F.col("s").alias("lex"), F.lit(None).cast("string").alias("dt"), F.lit(None).cast("string").alias("lang")).cast(POLY))
        if len(objects) > 1:
            kind = F.when(F.col("o_kind") == "iri", IRI_KIND).when(F.col("o_kind") == "bnode", BNODE_KIND).otherwise(LIT_KIND)
            df = df.withColumn("__o", F.struct(kind.alias("kind"), F.coalesce("o_text", *[lexical(E(F.col(c), lit(dt))) for dt, c in native_columns().items()]).alias("lex"), F.col("o_dt").alias("dt"), F.col("o_lang").alias("lang")).cast(POLY))
        subject = TermMap("lit", "__s", mixed=True) if len(subjects) > 1 else subjects.pop()
        object_ = TermMap("lit", "__o", mixed=True) if len(objects) > 1 else objects.pop()
        whole = Partition(None, found[0].source, subject, object_, graphs="g", rows=sum(x.rows for x in found), subjects=max(x.subjects for x in found), objects=1)
        return self._scan_from(df, [(t, whole)], graphs, [])

    def scan_rows(self, t: tuple, parts: list[Partition], graphs: Graphs) -> Rel:
        s, p, o = t
        objects = [E(x.object.column(), self.vt_of(x.object)) for x in parts]
        vt = objects[0].vt
        for e in objects[1:]:
            vt = common(vt, e.vt)
        # the subject and the graph are found as for one triple; the objects go along
        first = replace(parts[0], object=TermMap("iri", const="x"), where=None)
        df = self.catalog.frame(first.source)
        pairs = []
        for x, e in zip(parts, objects):
            held = F.when(e.col.isNotNull(), F.lit(True)) if o.name in self.unused else to(e, vt)
            held = F.when(F.expr(x.where), held) if x.where else held
            pairs.append(F.struct(F.lit(x.predicate).alias("p"), held.alias("o")))
        wide = df.withColumn("__pairs", F.array(*pairs))
        base = self._scan_from(wide, [((s, Iri(first.predicate), Iri("x")), first)], graphs, ["__pairs"])
        rows = base.df.select(*[F.col(f"`{n}`") for n in base.vt], F.explode("__pairs").alias("__pair")).where("__pair.o is not null")
        made = [F.col(f"`{n}`") for n in base.vt] + [F.col("__pair.o").alias(o.name)]
        types = base.vt | {o.name: vt.bound()}
        if isinstance(p, Var):
            made.append(F.col("__pair.p").alias(p.name))
            types[p.name] = VT("iri")
        return Rel(rows.select(*made), types, base.size * len(parts))

    def empty(self, names: list[str]) -> Rel:
        cols = [F.lit(None).cast("string").alias(n) for n in names] or [F.lit(1).alias("__unit")]
        return Rel(self.spark.range(0).select(*cols), {n: VT("iri") for n in names}, 0.0)

    def bgp(self, triples: list, graphs: Graphs) -> Rel:
        """Stars first: the triples of a subject that lie in one source, where a subject has one row, need one scan. Then joins, smallest first."""
        if not triples:
            return unit(self.spark)
        names = list(dict.fromkeys(x.name for t in triples for x in t if isinstance(x, Var)))
        if graphs.var:
            names.append(graphs.var)
        choices = [(t, self.partitions(*t, graphs)) for t in triples]
        self._narrow(choices)
        if any(not c for _, c in choices):
            return self.empty(names)
        stars: dict[tuple, list] = {}
        rels: list[Rel] = []
        for t, found in choices:
            if len(found) == 1 and found[0].unique:
                p = found[0]
                stars.setdefault((t[0], p.source, p.subject, p.graph if graphs.var or graphs.one else None, p.graphs), []).append((t, p))
            else:
                rels.append(replace(union(self.scans(t, found, graphs)), keys=_keys(t, found)))
        rels += [replace(self.scan(star, graphs), keys=_keys(star[0][0], [star[0][1]])) for star in stars.values()]
        return self.joined(rels)

    def _narrow(self, choices: list[tuple[tuple, list[Partition]]]) -> None:
        """Static typing: a variable's partitions must agree on kind and template in all the triples where it stands."""
        changed = True
        while changed:
            changed = False
            for name in {x.name for t, _ in choices for x in (t[0], t[2]) if isinstance(x, Var)}:
                kinds = None
                for (s, _, o), found in choices:
                    for x, pick in ((s, lambda p: p.subject), (o, lambda p: p.object)):
                        if isinstance(x, Var) and x.name == name:
                            own = {pick(p) for p in found}
                            kinds = own if kinds is None else {a for a in kinds if any(_meet(a, b) for b in own)} | {b for b in own if any(_meet(a, b) for a in kinds)}
                for i, ((s, p_, o), found) in enumerate(choices):
                    for x, pick in ((s, lambda p: p.subject), (o, lambda p: p.object)):
                        if isinstance(x, Var) and x.name == name:
                            kept = [p for p in found if any(_meet(pick(p), k) for k in kinds)]
                            kept = [p for p in kept if all(any(_meet(pick(p), pick2(q)) for q in others) for (s2, _, o2), others in choices for y, pick2 in ((s2, lambda z: z.subject), (o2, lambda z: z.object)) if isinstance(y, Var) and y.name == name)]
                            if len(kept) < len(found):
                                choices[i] = (choices[i][0], kept)
                                found, changed = kept, True

    def joined(self, rels: list[Rel]) -> Rel:
        """From the smallest on, next what makes the smallest result: a join by a key of one side is no larger than the other, any other may be a product."""
        rels = sorted(rels, key=lambda r: r.size)
        out = rels.pop(0)
        while rels:
            linked = [r for r in rels if set(r.vt) & set(out.vt)]
            nxt = min(linked or rels, key=lambda r: _joined_size(out, r))
            rels.remove(nxt)
            out = replace(join(out, nxt), size=_joined_size(out, nxt), keys=_joined_keys(out, nxt))
        return out

    # -- patterns ------------------------------------------------------------------------------------------------------

    def pattern(self, p: tuple, g: Graphs, known: list | None = None) -> Rel:
        """known: conditions that the solutions will have to meet; they are met early where that saves work."""
        kind = p[0]
        if kind == "bgp":
            return self.bgp([self._bound(t) for t in p[1]], g)
        if kind == "path":
            s, _, o = self._bound((p[1], None, p[3]))
            return self.path(s, p[2], o, g)
        if kind == "join":
            parts = self._flat(p)
            if all(x[0] in ("bgp", "path") for x in parts):
                return self.with_paths(parts, g, known or [])
            # triples that stand apart, as after an OPTIONAL, are joined with each other before the rest, which may share few of their variables
            triples = [x for x in parts if x[0] in ("bgp", "path")]
            rels = [self.pattern(x, g) for x in parts if x[0] not in ("bgp", "path")]
            return self.joined(rels + ([self.with_paths(triples, g, known or [])] if triples else []))
        if kind == "left":
            a, b = self.pattern(p[1], g), self.pattern(p[2], g)
            extra = None
            if p[3] is not None:
                if _has_exists(p[3]):
                    return self._optional_exists(a, b, p[3], g)
                extra = lambda look: F.coalesce(truth(self.value(p[3], look)), F.lit(False))
            return join(a, b, "left", extra)
        if kind == "filter":
            return self.filtered(p[1], self.pattern(p[2], g, (known or []) + [c for c in _conjuncts(p[1]) if not _has_exists(c)]), g)
        if kind == "union":
            return union([self.pattern(p[1], g), self.pattern(p[2], g)])
        if kind == "minus":
            return minus(self.pattern(p[1], g), self.pattern(p[2], g))
        if kind == "graph":
            if isinstance(p[1], Var):
                return self.pattern(p[2], replace(g, one=None, var=p[1].name))
            if g.named and p[1].value not in g.named:
                return self.empty(list(variables(p[2])))
            return self.pattern(p[2], replace(g, one=p[1].value, var=None))
        if kind == "extend":
            r = self.pattern(p[1], g)
            if p[2].name in r.vt:
                raise SparqlError(f"?{p[2].name} is bound already")
            return self.extended(r, p[2].name, p[3], g)
        if kind == "values":
            return self.inline(p[1], p[2])
        if kind == "select":
            return self.select(p[1], g)
        if kind == "service":
            raise NotImplementedError("SERVICE would need a network")
        raise SparqlError(f"no pattern {kind}")

    def with_paths(self, parts: list[tuple], g: Graphs, known: list) -> Rel:
        """Triples first, those linked by variables together; a repeated path starts from the nodes that they leave for one of its ends."""
        rels, later = [], []
        for triples in _linked([self._bound(t) for x in parts if x[0] == "bgp" for t in x[1]]):
            rels.append((self.bgp(triples, g), {y.name for t in triples for y in (t[0], t[2]) if isinstance(y, Var)}))
        for x in parts:
            if x[0] == "path":
                s, _, o = self._bound((x[1], None, x[3]))
                if isinstance(x[2], tuple) and x[2][0] in ("plus", "star") and isinstance(s, Var) and isinstance(o, Var) and s != o:
                    later.append((s, x[2], o))
                else:
                    rels.append((self.path(s, x[2], o, g), set()))
        if not rels and not later:
            return unit(self.spark)
        for i, (r, nodes) in enumerate(rels):
            own = [c for c in known if (names := mentioned(c)) and all(n in r.vt and not r.vt[n].opt for n in names)]
            if own:
                rels[i] = (self.filtered(_all(own), r, g), nodes)
        for s, path, o in later:
            ends = sorted(((r.size, k, r) for r, nodes in rels for k, end in enumerate((s, o)) if end.name in nodes), key=lambda x: x[:2])
            if not ends:
                rels.append((self.path(s, path, o, g), set()))
                continue
            _, k, r = ends[0]
            rels.append((self.path_from(s, path, o, g, r, k), set()))
        return self.joined([r for r, _ in rels])

    def _optional_exists(self, a: Rel, b: Rel, e, g: Graphs) -> Rel:
        """OPTIONAL whose condition holds an EXISTS: the joined rows that meet it, and the left rows that have none. Left rows are numbered once and settled."""
        rows = Rel(settled(a.df.withColumn("__row", F.monotonically_increasing_id())), a.vt | {"__row": lit(INTEGER)}, a.size)
        met = self.filtered(e, join(rows, b), g)
        rest = semi(rows, met.keep(["__row"]), "left_anti")
        out = union([met, rest])
        return out.keep([n for n in out.vt if n != "__row"])

    def _flat(self, p: tuple) -> list:
        return self._flat(p[1]) + self._flat(p[2]) if p[0] == "join" else [p]

    def _bound(self, t: tuple) -> tuple:
        """Initial bindings stand in for their variables."""
        return tuple(self.bindings.get(x.name, x) if isinstance(x, Var) else x for x in t)

    def value(self, e, look, exists=None) -> E:
        def with_bindings(name: str) -> E | None:
            return constant(self.bindings[name]) if name in self.bindings else look(name)

        return evaluate(e, with_bindings, exists, self.base)

    def filtered(self, e, r: Rel, g: Graphs) -> Rel:
        for part in _conjuncts(e):
            if isinstance(part, tuple) and part[0] == "not" and isinstance(part[1], tuple) and part[1][0] == "exists":
                part = ("exists", part[1][1], not part[1][2])
            if isinstance(part, tuple) and part[0] == "exists":
                inner, cond = self.inner(part[1], r, g)
                r = semi(r, inner, "left_anti" if part[2] else "left_semi", cond)
                continue
            r, exists = self.marked(part, r, g)
            vt = r.vt
            df = r.df.where(F.coalesce(truth(self.value(part, r.e, exists)), F.lit(False)))
            same = _bound_by(part)
            vt = {n: replace(t, opt=False) if n in same else t for n, t in vt.items()}
            r = Rel(df, vt, r.size * 0.5)
            if exists:
                r = r.keep([n for n in vt if not n.startswith("__mark")])
        return r

    def inner(self, p: tuple, r: Rel, g: Graphs):
        """The pattern of EXISTS. Its filters over variables that only the outer solution binds become join conditions."""
        conditions = []
        while p[0] == "filter":
            scope = set(variables(p[2]))
            outer = [c for c in _conjuncts(p[1]) if not _has_exists(c) and (mentioned(c) - scope) & set(r.vt)]
            rest = [c for c in _conjuncts(p[1]) if c not in outer]
            conditions += outer
            if rest:
                p = ("filter", _all(rest), p[2])
                break
            p = p[2]
        found = self.pattern(p, g)
        needed = {n for n in found.vt if n in r.vt} | {n for c in conditions for n in mentioned(c)}
        found = found.keep(needed) if needed & set(found.vt) else Rel(found.df.limit(1).select(F.lit(1).alias("__unit")), {}, 1.0)
        extra = None
        if conditions:
            extra = lambda look: F.coalesce(truth(self.value(_all(conditions), look)), F.lit(False))
        return found, extra

    def marked(self, e, r: Rel, g: Graphs):
        """Adds a mark column for each EXISTS inside an expression."""
        marks: dict[int, str] = {}
        for x in _find_exists(e):
            inner, cond = self.inner(x[1], r, g)
            self.marks += 1
            name = f"__mark{self.marks}"
            mark = VT("lit", STRING)
            if cond is None:
                flagged = Rel(inner.df.select(*[F.col(f"`{n}`") for n in inner.vt]).distinct().withColumn(name, F.lit("1")) if inner.vt else inner.df.select(F.lit("1").alias(name)), inner.vt | {name: mark}, inner.size)
            else:  # a variable of the outer solution in a filter: rows are numbered once and settled, and those with a match are marked
                row = f"{name}row"
                r = Rel(settled(r.df.withColumn(row, F.monotonically_increasing_id())), r.vt | {row: lit(INTEGER)}, r.size)
                met = semi(r, inner, "left_semi", cond).keep([row])
                flagged = Rel(met.df.withColumn(name, F.lit("1")), met.vt | {name: mark}, met.size)
            r = join(r, flagged, "left")
            marks[id(x)] = name
        if not marks:
            return r, None
        return r, lambda x: F.col(marks[id(x)]).isNull() if x[2] else F.col(marks[id(x)]).isNotNull()

    def extended(self, r: Rel, name: str, e, g: Graphs) -> Rel:
        r, exists = self.marked(e, r, g)
        made = self.value(e, r.e, exists)
        certain = made.term is not None or isinstance(e, Var) and not made.vt.opt
        cols = [F.col(f"`{n}`") for n in r.vt if not n.startswith("__mark")]
        vt = {n: t for n, t in r.vt.items() if not n.startswith("__mark")} | {name: replace(made.vt, opt=not certain)}
        return Rel(r.df.select(*cols, made.col.alias(name)), vt, r.size)

    def inline(self, names: list[Var], rows: list[list]) -> Rel:
        vt, columns = {}, []
        for i, v in enumerate(names):
            terms = [r[i] for r in rows if r[i] is not None]
            made = None
            for t in terms:
                own = constant(t).vt
                made = own if made is None else common(made, own)
            vt[v.name] = replace(made or VT("iri"), opt=len(terms) < len(rows))
        if not rows:
            return self.empty([v.name for v in names])
        parts = []
        for r in rows:
            fields = []
            for v, t in zip(names, r):
                x = vt[v.name]
                kind = POLY if x.kind == "poly" else physical(x.dt) if x.kind == "lit" else "string"
                kind = "decimal(38,18)" if x.kind == "lit" and x.dt == DECIMAL else kind
                fields.append((F.lit(None) if t is None else to(constant(t), x)).cast(kind).alias(v.name))
            parts.append(F.struct(*fields))
        columns = [F.col(f"__row.`{v.name}`").alias(v.name) for v in names]
        df = self.spark.range(1).select(F.explode(F.array(*parts)).alias("__row"))
        return Rel(df.select(*columns) if columns else df, vt, 100.0 * len(rows))

    # -- queries -------------------------------------------------------------------------------------------------------

    def select(self, q: Query, g: Graphs) -> Rel:
        r = self.solutions(q, g)
        return r

    def solutions(self, q: Query, g: Graphs) -> Rel:
        """Everything from WHERE to LIMIT."""
        self.unused = _unused(q)
        r = self.pattern(q.where, g)
        self.unused = set()
        if q.values:
            r = join(r, self.inline(q.values[1], q.values[2]))
        shown = [v.name for v, _ in q.items] or [n for n in variables(q.where) if not n.startswith("__")]
        if q.values and not q.items:
            shown += [v.name for v in q.values[1] if v.name not in shown]
        aggregates = _find_aggregates([e for _, e in q.items] + q.having + [e for e, _ in q.order])
        order = q.order
        if q.group or aggregates:
            r, rewrite = self.grouped(q, r, aggregates, g)
            for e in q.having:
                r = self.filtered(rewrite(e), r, g)
            items = [(v, rewrite(e) if e is not None else None) for v, e in q.items]
            order = [(rewrite(e), d) for e, d in q.order]
        else:
            items = q.items
        for v, e in items:
            if e is not None:
                r = self.extended(r, v.name, e, g)
        if q.form in ("SELECT", "DESCRIBE"):
            missing = [n for n in shown if n not in r.vt]
            for n in missing:
                r = Rel(r.df.withColumn(n, F.lit(None).cast("string")), r.vt | {n: VT("iri", opt=True)}, r.size)
        if q.distinct and q.form == "SELECT":
            r = r.keep(shown) if shown else r
            r = Rel(r.df.distinct(), r.vt, r.size)
        if order:
            keys = []
            for e, descending in order:
                for c in order_key(self.value(e, r.e)):
                    keys.append(c.desc_nulls_last() if descending else c.asc_nulls_first())
            r = Rel(r.df.orderBy(*keys), r.vt, r.size)
        if q.offset:
            r = Rel(r.df.offset(q.offset), r.vt, r.size)
        if q.limit is not None:
            r = Rel(r.df.limit(q.limit), r.vt, min(r.size, 100.0 * q.limit))
        return r.keep(shown) if q.form == "SELECT" and shown else r

    def grouped(self, q: Query, r: Rel, aggregates: list, g: Graphs):
        keys: list[tuple[str, object]] = []
        for i, (e, v) in enumerate(q.group):
            name = v.name if v else f"__key{i}"
            if not (isinstance(e, Var) and v and e.name == v.name):
                r = self.extended(r, name, e, g)
            elif name not in r.vt:
                r = Rel(r.df.withColumn(name, F.lit(None).cast("string")), r.vt | {name: VT("iri", opt=True)}, r.size)
            keys.append((name, e))
        # arguments first, so that each is computed once
        prepared, vt = [], {}
        for i, (_, name, distinct, arg, separator) in enumerate(aggregates):
            out = f"__agg{i}"
            if arg is None:
                cols = [F.col(f"`{n}`") for n in r.vt]
                prepared.append((F.count_distinct(F.struct(*cols)) if distinct and cols else F.count(F.lit(1))).alias(out))
                vt[out] = lit(INTEGER)
                continue
            e = self.value(arg, r.e)
            col, made = self.aggregate(name, distinct, e, separator)
            prepared.append(col.alias(out))
            vt[out] = replace(made, opt=name in ("MIN", "MAX", "SAMPLE", "SUM", "AVG"))
        names = [k for k, _ in keys]
        grouped = r.df.groupBy(*[F.col(f"`{n}`") for n in names])
        df = grouped.agg(*prepared) if prepared else r.df.select(*[F.col(f"`{n}`") for n in names]).distinct()
        out = Rel(df, {n: r.vt[n] for n in names} | vt, r.size * 0.1)

        def rewrite(e):
            if isinstance(e, tuple):
                for i, a in enumerate(aggregates):
                    if e == a:
                        return Var(f"__agg{i}")
                for name, key in keys:
                    if e == key:
                        return Var(name)
                return tuple(rewrite(x) if isinstance(x, (tuple, Var)) else [rewrite(y) for y in x] if isinstance(x, list) else x for x in e)
            return e

        return out, rewrite

    def aggregate(self, name: str, distinct: bool, e: E, separator: str):
        vt, col = e.vt, e.col
        if name == "COUNT":
            return (F.count_distinct(col) if distinct else F.count(col)), lit(INTEGER)
        if name in ("SUM", "AVG") and vt.kind == "poly":
            return self.mixed_total(name, distinct, e)
        if name in ("SUM", "AVG"):
            x = number(e) if vt.dt in (DOUBLE, FLOAT) else col.cast("decimal(38,18)") if vt.dt == DECIMAL else col.cast("bigint") if numeric(vt) else None
            dt = DOUBLE if vt.dt in (DOUBLE, FLOAT) else DECIMAL if vt.dt == DECIMAL else INTEGER
            if x is None:  # an error in every row; no rows at all give 0
                return F.when(F.count(F.lit(1)) == 0, F.lit(0)).cast("bigint"), lit(INTEGER)
            # beyond 64 bits a sum is unbound
            total = F.try_sum(x) if not distinct else F.sum_distinct(x) if dt != INTEGER else F.sum_distinct(x.cast("decimal(20,0)")).try_cast("bigint")
            if name == "SUM":
                zero = F.lit(0).cast("decimal(38,18)" if dt == DECIMAL else "double" if dt == DOUBLE else "bigint")
                return F.when(F.count(x) == 0, zero).otherwise(total.try_cast("decimal(38,18)") if dt == DECIMAL else total), lit(dt)
            n = F.count_distinct(x) if distinct else F.count(x)
            if dt == DOUBLE:
                return F.coalesce(F.try_divide(total, n), F.lit(0.0)), lit(DOUBLE)
            return F.coalesce(F.try_divide(total.cast("decimal(20,0)" if dt == INTEGER else "decimal(38,18)"), n.cast("decimal(20,0)")).try_cast("decimal(38,18)"), F.lit(0).cast("decimal(38,18)")), lit(DECIMAL)
        if name in ("MIN", "MAX"):
            if vt.kind == "poly":
                key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order_key(e))])
                pick = F.min_by if name == "MIN" else F.max_by
                return pick(col, F.when(col.isNotNull(), key)), vt
            x = order_key(e)[0] if vt.kind == "iri" else col
            return (F.min(x) if name == "MIN" else F.max(x)), (VT("iri") if vt.kind == "iri" else vt.bound())
        if name == "SAMPLE":
            return (F.any_value(col, F.lit(True)) if vt.kind == "poly" else F.min(col)), vt.bound()
        if name == "GROUP_CONCAT":
            text = lexical(e)
            items = F.collect_set(text) if distinct else F.collect_list(text)
            return F.array_join(F.sort_array(items), separator), lit(STRING)
        raise SparqlError(f"no aggregate {name}")

    @staticmethod
    def mixed_total(name: str, distinct: bool, e: E):
        """SUM and AVG of numbers of several types: the total has the type to which all are promoted."""
        value, sum_of = number(e), F.sum_distinct if distinct else F.sum
        exact = F.when(e.col["dt"].isin(*WHOLE, DECIMAL), e.col["lex"].try_cast("decimal(38,18)"))
        some = lambda *dts: F.coalesce(F.max(e.col["dt"].isin(*dts)), F.lit(False))
        decimals, doubles = sum_of(exact).try_cast("decimal(38,18)"), sum_of(value)
        all_exact = ~some(DOUBLE, FLOAT)
        if name == "SUM":
            made = number_term(all_exact & ~some(DECIMAL), all_exact, decimals, doubles)
        else:
            n = F.count_distinct(value) if distinct else F.count(value)
            made = number_term(F.lit(False), all_exact, F.try_divide(decimals, n.cast("decimal(20,0)")).try_cast("decimal(38,18)"), F.try_divide(doubles, n))
        return F.when(F.count(value) == 0, poly(constant(Lit("0", INTEGER)))).otherwise(made.col), made.vt

    def run(self, q: Query) -> tuple[DataFrame, dict[str, VT]]:
        """The result as shown, with the types of its columns."""
        g = Graphs(tuple(q.graphs), tuple(q.named))
        if q.form == "SELECT":
            r = self.solutions(q, g)
            cols = [output(r.e(n)).alias(n) for n in r.vt]
            return (r.df.select(*cols) if cols else r.df), r.vt
        if q.form == "ASK":
            r = self.solutions(replace(q, order=[], limit=1, offset=q.offset), g)
            return r.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("ask")), {"ask": lit("http://www.w3.org/2001/XMLSchema#boolean")}
        if q.form == "CONSTRUCT":
            return self.construct(q.template, self.solutions(q, g)), {}
        return self.describe(q, g), {}

    # -- triples as results --------------------------------------------------------------------------------------------

    TRIPLE = ("s", "p", "o")

    def construct(self, template: list, r: Rel) -> DataFrame:
        """The template for each solution; ill-formed triples are left out, and repeated ones."""
        blank = sorted({x.name for t in template for x in t if isinstance(x, Var) and x.name.startswith("__") and x.name not in r.vt})
        df = r.df
        if blank:
            df = df.withColumn("__solution", F.expr("uuid()"))
        parts = []
        for t in template:
            es = []
            for x in t:
                if isinstance(x, Var) and x.name in blank:
                    es.append(E(F.concat(F.col("__solution"), F.lit(x.name)), VT("bnode")))
                else:
                    es.append(r.e(x.name) if isinstance(x, Var) else constant(x))
            if any(e is None for e in es):
                continue
            s, p, o = map(poly, es)
            parts.append(F.when((s["kind"] < 2) & (p["kind"] == 1) & o.isNotNull(), F.struct(s.alias("s"), p.alias("p"), o.alias("o"))))
        if not parts:
            return df.limit(0).select(*[F.lit("").alias(n) for n in self.TRIPLE])
        rows = df.select(F.explode(F.array(*parts)).alias("t")).where(F.col("t").isNotNull()).distinct()
        return rows.select(*[term_text(F.col(f"t.{n}")).alias(n) for n in self.TRIPLE]).distinct()

    def describe(self, q: Query, g: Graphs) -> DataFrame:
        """All triples of which a described resource is the subject."""
        resources = []
        terms = [x for x in q.described if isinstance(x, Iri)]
        names = [x.name for x in q.described if isinstance(x, Var)] or ([] if terms else [n for n in variables(q.where) if not n.startswith("__")])
        if names:
            r = self.solutions(q, g)
            resources += [Rel(r.df.select(F.col(f"`{n}`").alias("__s")), {"__s": r.vt[n]}, r.size) for n in names if n in r.vt and r.vt[n].kind == "iri"]
        out = []
        for t in terms:
            found = self.bgp([(t, Var("__p"), Var("__o"))], g)
            out.append(self.construct([(t, Var("__p"), Var("__o"))], found))
        if resources:
            wanted = union(resources)
            wanted = Rel(wanted.df.where("__s is not null").distinct(), {"__s": wanted.vt["__s"].bound()}, wanted.size)
            triple = (Var("__s"), Var("__p"), Var("__o"))
            for r in self.scans(triple, self.partitions(*triple, g), g):
                if r.vt["__s"].kind == "iri" and same_term(wanted.e("__s"), r.e("__s")) is not None:
                    out.append(self.construct([triple], join(wanted, r)))
        if not out:
            return self.construct([], unit(self.spark))
        made = out[0]
        for x in out[1:]:
            made = made.unionAll(x)
        return made.distinct()


def term_text(p):
    """A term in N-Triples form."""
    quoted = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.regexp_replace(p["lex"], r'([\\"])', r"\\$1"), "\n", r"\\n"), "\r", r"\\r"), F.lit('"'))
    tail = F.when(p["lang"].isNotNull(), F.concat(F.lit("@"), p["lang"])).when(p["dt"] != STRING, F.concat(F.lit("^^<"), p["dt"], F.lit(">"))).otherwise(F.lit(""))
    return F.when(p["kind"] == 1, F.concat(F.lit("<"), p["lex"], F.lit(">"))).when(p["kind"] == 0, F.concat(F.lit("_:"), p["lex"])).otherwise(F.concat(quoted, tail))


def _meet(a: TermMap, b: TermMap) -> bool:
    """Whether two term maps can give the same term."""
    if a.kind != b.kind:
        return False
    if a.kind == "bnode":
        return True
    if a.kind == "lit":
        return a.dt == b.dt and (a.lang or "").lower() == (b.lang or "").lower()
    if a.const is not None and b.const is not None:
        return a.const == b.const
    for x, y in ((a, b), (b, a)):
        if x.const is not None:
            return y.prefix is None or x.const.startswith(y.prefix)
    return a.prefix is None or b.prefix is None or a.prefix.startswith(b.prefix) or b.prefix.startswith(a.prefix)


#: About so many bytes are a row, in estimates.
ROW_BYTES = 64.0
#: Where so large a share of the triples have subjects (objects) of their own, these count as keys.
NEARLY_ALL = 0.9


def _keys(t: tuple, found: list[Partition]) -> tuple[frozenset[str], ...]:
    """The variables of a triple that tell its rows. A subject that stands in several partitions counts as telling them."""
    s, p, o = t
    if isinstance(p, Var):
        return ()
    known = all(x.rows is not None for x in found)
    rows = sum(x.rows or 0 for x in found)
    alone = lambda term, unique: [frozenset({term.name} if isinstance(term, Var) else ())] if unique else []
    subject = all(x.unique for x in found) or known and sum(x.subjects or 0 for x in found) >= NEARLY_ALL * rows
    return tuple(alone(s, subject) + alone(o, known and sum(x.objects or 0 for x in found) >= NEARLY_ALL * rows))


def _told(a: Rel, b: Rel) -> bool:
    """Whether a row of a meets one row of b at most, or few."""
    return any(k <= set(a.vt) for k in b.keys)


def _joined_size(a: Rel, b: Rel) -> float:
    found = [x.size for x, y in ((a, b), (b, a)) if _told(x, y)]
    return min(found) if found else a.size * max(b.size / ROW_BYTES, 1.0)


def _joined_keys(a: Rel, b: Rel) -> tuple[frozenset[str], ...]:
    kept = (a.keys if _told(a, b) else ()) + (b.keys if _told(b, a) else ())
    return tuple(dict.fromkeys(kept)) or tuple(dict.fromkeys(x | y for x in a.keys for y in b.keys))


def _linked(triples: list[tuple]) -> list[list[tuple]]:
    """Triples in groups that share no variable."""
    groups: list[tuple[set, list]] = []
    for t in triples:
        names = {x.name for x in t if isinstance(x, Var)}
        met = [x for x in groups if x[0] & names]
        groups = [x for x in groups if x not in met] + [(names.union(*[x[0] for x in met]), [y for x in met for y in x[1]] + [t])]
    return [x[1] for x in groups]


def _conjuncts(e) -> list:
    return _conjuncts(e[1]) + _conjuncts(e[2]) if isinstance(e, tuple) and e[0] == "and" else [e]


def _all(parts: list):
    out = parts[0]
    for p in parts[1:]:
        out = ("and", out, p)
    return out


def _find_exists(e) -> list:
    if isinstance(e, tuple):
        return [e] if e[0] == "exists" else [y for x in e for y in _find_exists(x)]
    return [y for x in e for y in _find_exists(x)] if isinstance(e, list) else []


def _has_exists(e) -> bool:
    return bool(_find_exists(e))


def _unused(q: Query) -> set[str]:
    """Subjects and objects of triples with a variable for predicate of which a query of triples alone asks only that they are there."""
    shown = [e if e is not None else v for v, e in q.items]
    exprs = shown + [e for e, _ in q.group] + q.having + [e for e, _ in q.order]
    if q.form != "SELECT" or q.where[0] != "bgp" or not q.items or q.values or _has_exists(exprs) or any(a[2] and a[3] is None for a in _find_aggregates(exprs)):
        return set()
    stand = [x.name for t in q.where[1] for x in t if isinstance(x, Var)]
    used = {n for e in exprs for n in mentioned(e)} | {t[1].name for t in q.where[1] if isinstance(t[1], Var)}
    loose = {x.name for t in q.where[1] if isinstance(t[1], Var) for x in (t[0], t[2]) if isinstance(x, Var)}
    return {n for n in loose if stand.count(n) == 1 and n not in used}


def _find_aggregates(e) -> list:
    if isinstance(e, tuple):
        found = [e] if e[0] == "agg" else [y for x in e for y in _find_aggregates(x)]
    else:
        found = [y for x in e for y in _find_aggregates(x)] if isinstance(e, list) else []
    out: list = []
    for x in found:
        if x not in out:
            out.append(x)
    return out


def _bound_by(e) -> set:
    """Variables that a filter proves to be bound: those it compares, or tests with BOUND."""
    if isinstance(e, tuple):
        if e[0] in ("cmp",):
            return {x.name for x in e[2:] if isinstance(x, Var)}
        if e[0] == "call" and e[1] == "BOUND":
            return {e[2][0].name}
    return set()

