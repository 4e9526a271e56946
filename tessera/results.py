"""Result formats: SPARQL JSON, XML, CSV and TSV, and N-Triples and N-Quads, made on the executors a line for each solution."""

from __future__ import annotations

from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.compiler import Compiler, Graphs, term_text
from tessera.terms import LANG_STRING, STRING, BNode, Iri, Lit, Var
from tessera.values import E, poly


def solutions(store, text: str, bindings: dict | None = None) -> DataFrame:
    """A SELECT's solutions with each variable as a struct of kind, lex, dt and lang: no term loses its type."""
    from tessera.sparql.parser import parse

    q = parse(text)
    r = Compiler(store.spark, store.catalog, bindings=bindings).solutions(q, Graphs(tuple(q.graphs), tuple(q.named)))
    return r.df.select(*[poly(r.e(n)).alias(n) for n in r.vt])


def tsv(df: DataFrame) -> DataFrame:
    """Lines of terms in N-Triples form; unbound is empty."""
    return df.select(F.concat_ws("\t", *[F.coalesce(term_text(F.col(f"`{c}`")), F.lit("")) for c in df.columns]).alias("value"))


def csv(df: DataFrame) -> DataFrame:
    def field(c: Column) -> Column:
        text = F.when(c["kind"] == 0, F.concat(F.lit("_:"), c["lex"])).otherwise(c["lex"])
        quoted = F.concat(F.lit('"'), F.regexp_replace(text, '"', '""'), F.lit('"'))
        return F.coalesce(F.when(text.rlike('[",\r\n]'), quoted).otherwise(text), F.lit(""))

    return df.select(F.concat_ws(",", *[field(F.col(f"`{c}`")) for c in df.columns]).alias("value"))


def json_lines(df: DataFrame) -> DataFrame:
    """A line for each solution, the members of a result's `bindings`."""

    def term(c: Column) -> Column:
        kind = F.when(c["kind"] == 0, F.lit("bnode")).when(c["kind"] == 1, F.lit("uri")).otherwise(F.lit("literal"))
        dt = F.when((c["dt"] != STRING) & (c["dt"] != LANG_STRING), c["dt"])
        return F.when(c.isNotNull(), F.struct(kind.alias("type"), c["lex"].alias("value"), dt.alias("datatype"), c["lang"].alias("xml:lang")))

    return df.select(F.to_json(F.struct(*[term(F.col(f"`{c}`")).alias(c) for c in df.columns])).alias("value"))


def xml_lines(df: DataFrame) -> DataFrame:
    """A `result` element for each solution; xml_ends() gives what stands around them."""

    def safe(c: Column) -> Column:
        for found, wanted in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(found), F.lit(wanted))
        return c

    def binding(name: str) -> Column:
        c = F.col(f"`{name}`")
        tag = F.when(c["kind"] == 0, F.lit("bnode")).when(c["kind"] == 1, F.lit("uri")).otherwise(F.lit("literal"))
        more = F.when(c["lang"].isNotNull(), F.concat(F.lit(' xml:lang="'), safe(c["lang"]), F.lit('"'))).when(c["dt"] != STRING, F.concat(F.lit(' datatype="'), safe(c["dt"]), F.lit('"'))).otherwise(F.lit(""))
        return F.when(c.isNotNull(), F.concat(F.lit(f'<binding name="{escape(name)}"><'), tag, more, F.lit(">"), safe(c["lex"]), F.lit("</"), tag, F.lit("></binding>")))

    return df.select(F.concat(F.lit("<result>"), F.concat_ws("", *[binding(c) for c in df.columns]), F.lit("</result>")).alias("value"))


def xml_ends(names: list[str]) -> tuple[str, str]:
    head = "".join(f'<variable name="{escape(n)}"/>' for n in names)
    return f'<?xml version="1.0"?><sparql xmlns="http://www.w3.org/2005/sparql-results#"><head>{head}</head><results>', "</results></sparql>"


def xml_text(df: DataFrame) -> str:
    """A whole SPARQL XML result, for results that a client reads; larger ones are written by xml_lines()."""
    first, last = xml_ends(df.columns)
    return "".join([first, *(r["value"] for r in xml_lines(df).toLocalIterator()), last])


def quads_text(store, graphs: list[str] | None = None) -> DataFrame:
    """The store's quads as lines of N-Quads."""
    from tessera.plans.relation import union

    c = Compiler(store.spark, store.catalog)
    active = Graphs(named=tuple(graphs or ()), var="g")
    triple = (Var("s"), Var("p"), Var("o"))
    found = c.partitions(*triple, active)
    if not found:
        return store.spark.createDataFrame([], "value string")
    r = union(c.scans(triple, found, active))
    terms = [term_text(poly(E(F.col(f"`{n}`"), r.vt[n]))) for n in ("s", "p", "o", "g")]
    return r.df.select(F.concat_ws(" ", *terms, F.lit(".")).alias("value"))


def term_of(row) -> Iri | BNode | Lit:
    """A solution's struct as a term."""
    return BNode(row["lex"]) if row["kind"] == 0 else Iri(row["lex"]) if row["kind"] == 1 else Lit(row["lex"], row["dt"], row["lang"])
