"""Static types of query columns and the conversions between their forms.

A column of one type (mono) holds native values: the key after a template's prefix, or the whole IRI; a label; a literal's value. Where a
variable may hold terms of several types it is poly: a struct of kind, lexical form, datatype and language; so are literals that no native column can hold (dates and times with an
offset, whole numbers beyond 64 bits, decimals beyond 18 places). Null is unbound, and in expressions an error.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.terms import BOOLEAN, DATE, DATE_TIME, DECIMAL, DOUBLE, FLOAT, GYEAR, LANG_STRING, LEXICAL, NATIVE, NUMERIC, STRING, WHOLE, BNode, Iri, Lit

BNODE_KIND, IRI_KIND, LIT_KIND = 0, 1, 2
POLY = "struct<kind:int,lex:string,dt:string,lang:string>"


@dataclass(frozen=True)
class VT:
    kind: str  # iri, bnode, lit or poly
    dt: str | None = None
    lang: str | None = None
    prefix: str | None = None
    opt: bool = False

    def bound(self) -> VT:
        return replace(self, opt=False)

    def same(self, other: VT) -> bool:
        return self.bound() == other.bound()


@dataclass(frozen=True)
class E:
    """An expression: its column and type, and its term where it is constant."""

    col: Column
    vt: VT
    term: object = None


def physical(dt: str | None) -> str:
    if dt in WHOLE:
        return "int" if NATIVE[dt] == "int" else "bigint"
    return NATIVE.get(dt, "string")


def native_columns() -> dict[str, str]:
    """The columns of a loaded store that hold values, by datatype."""
    return {dt: f"o_{i}" for i, dt in enumerate(dt for dt in NATIVE if physical(dt) != "string")}


def parsed(lex: Column, dt: str) -> Column:
    """The value of a lexical form; null where it is not one of the datatype."""
    kind = physical(dt)
    if dt in LEXICAL:
        lex = F.when(lex.rlike(f"^(?:{LEXICAL[dt]})$"), F.trim(lex))
    if dt in (DOUBLE, FLOAT):
        lex = F.when(lex.isin("INF", "+INF"), F.lit("Infinity")).when(lex == "-INF", F.lit("-Infinity")).otherwise(lex)
    if dt == GYEAR:
        lex = F.regexp_extract(lex, "^(-?[0-9]+)", 1)
    if dt == DATE_TIME:  # the local value; an offset is left out
        lex = F.regexp_replace(F.regexp_replace(lex, "(Z|[+-][0-9]{2}:[0-9]{2})$", ""), "T", " ")
    if dt == DATE:
        lex = F.regexp_extract(lex, "^(-?[0-9]+-[0-9]{2}-[0-9]{2})", 1)
    return lex if kind == "string" else lex.try_cast(kind)


DATES = (DATE_TIME, DATE, GYEAR)
OFFSET = r"(Z|[+-][0-9]{2}:[0-9]{2})\s*$"
#: Datatypes whose values have no bound.
UNBOUNDED = tuple(dt for dt, kind in WHOLE.items() if kind == "decimal(38,0)")
SHORT_DECIMAL = r"^\s*[+-]?0*[0-9]{0,20}(\.[0-9]{0,18}0*)?\s*$"


def wide(lex: Column, dt: str) -> Column:
    """Whether a lexical form is a value that no native column can hold."""
    if dt in DATES:
        return parsed(lex, dt).isNotNull() & lex.rlike(OFFSET)
    valid = lex.rlike(f"^(?:{LEXICAL[dt]})$") if dt in LEXICAL else F.lit(False)
    if dt in UNBOUNDED:
        return valid & parsed(lex, dt).isNull()
    return valid & ~lex.rlike(SHORT_DECIMAL) if dt == DECIMAL else F.lit(False)


def is_wide(term: Lit) -> bool:
    """The same for a literal of a query."""
    if term.dt in DATES:
        return bool(re.search(OFFSET, term.lex))
    if not re.fullmatch(LEXICAL.get(term.dt, "(?!)"), term.lex):
        return False
    if term.dt in UNBOUNDED:
        return not -(1 << 63) <= int(term.lex) < 1 << 63
    return term.dt == DECIMAL and not re.match(SHORT_DECIMAL, term.lex)


def literal(lex: Column, dt: Column | str | None, lang: str | None = None) -> Column:
    """A literal as a poly column."""
    dt = dt if isinstance(dt, Column) else F.lit(dt).cast("string")
    made = F.struct(F.lit(LIT_KIND).alias("kind"), lex.alias("lex"), dt.alias("dt"), F.lit(lang).cast("string").alias("lang"))
    return F.when(lex.isNotNull() & dt.isNotNull(), made).cast(POLY)


def instant(lex: Column, dt: Column) -> Column:
    """The moment at which a date, a time or a year begins; without an offset it is one of UTC."""
    offset = F.regexp_extract(lex, OFFSET, 1)
    local = F.regexp_replace(F.trim(lex), OFFSET, "")
    local = F.when(dt == DATE, F.concat(local, F.lit("T00:00:00"))).when(dt == GYEAR, F.concat(local, F.lit("-01-01T00:00:00"))).when(dt == DATE_TIME, local)
    return F.concat(local, F.when(offset == "", F.lit("Z")).otherwise(offset)).try_cast("timestamp")


def constant(term) -> E:
    if isinstance(term, Iri):
        return E(F.lit(term.value), VT("iri"), term)
    if isinstance(term, BNode):
        return E(F.lit(term.label), VT("bnode"), term)
    if is_wide(term):
        return E(literal(F.lit(term.lex.strip()), term.dt), VT("poly"), term)
    col = parsed(F.lit(term.lex), term.dt) if physical(term.dt) != "string" else F.lit(term.lex)
    return E(col, VT("lit", term.dt, term.lang), term)


def iri_text(e: E) -> Column:
    return e.col if e.vt.prefix is None else F.concat(F.lit(e.vt.prefix), e.col.cast("string"))


def double_text(x: Column) -> Column:
    """Java's form of a double, with XSD's names of the infinities."""
    return F.when(F.isnan(x), F.lit("NaN")).when(x == F.lit(float("inf")), F.lit("INF")).when(x == F.lit(float("-inf")), F.lit("-INF")).otherwise(x.cast("string"))


def lexical(e: E) -> Column:
    """The lexical form, or the IRI, or the label."""
    vt, col = e.vt, e.col
    if vt.kind == "poly":
        return col["lex"]
    if vt.kind == "iri":
        return iri_text(e)
    if vt.kind == "bnode" or physical(vt.dt) == "string":
        return col.cast("string")
    if vt.dt in (DOUBLE, FLOAT):
        return double_text(col.cast("double"))
    if vt.dt == DECIMAL:
        return F.regexp_replace(F.regexp_replace(col.cast("decimal(38,18)").cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", ".0")
    if vt.dt == DATE_TIME:
        return F.regexp_replace(F.regexp_replace(F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "0+$", ""), r"\.$", "")
    if vt.dt == GYEAR:
        return F.lpad(col.cast("string"), 4, "0")
    return col.cast("string")


def poly(e: E) -> Column:
    vt = e.vt
    if vt.kind == "poly":
        return e.col
    kind = {"bnode": BNODE_KIND, "iri": IRI_KIND, "lit": LIT_KIND}[vt.kind]
    dt = F.lit(vt.dt if vt.kind == "lit" else None).cast("string")
    lang = F.lit(vt.lang).cast("string")
    made = F.struct(F.lit(kind).alias("kind"), lexical(e).alias("lex"), dt.alias("dt"), lang.alias("lang"))
    return F.when(e.col.isNotNull(), made).cast(POLY)


def common(a: VT, b: VT) -> VT:
    """The type that holds the values of both."""
    opt = a.opt or b.opt
    if a.same(b):
        return replace(a, opt=opt)
    if a.kind == b.kind == "iri":
        return VT("iri", opt=opt)
    return VT("poly", opt=opt)


def to(e: E, vt: VT) -> Column:
    """The column in the form of another type that holds it."""
    if vt.kind == "poly":
        return poly(e)
    if vt.kind == "iri" and vt.prefix is None:
        return iri_text(e)
    return e.col


def same_term(a: E, b: E) -> Column | None:
    """Whether two are the same term; None where their types tell that they never are."""
    x, y = a.vt, b.vt
    if "poly" in (x.kind, y.kind):
        p, q = poly(a), poly(b)
        return (p["kind"] == q["kind"]) & (p["lex"] == q["lex"]) & p["dt"].eqNullSafe(q["dt"]) & p["lang"].eqNullSafe(q["lang"])
    if x.kind != y.kind:
        return None
    if x.kind == "iri":
        if x.prefix == y.prefix:
            return a.col == b.col
        for p, q in ((a, b), (b, a)):
            if isinstance(q.term, Iri) and p.vt.prefix is not None:
                return key_of(p, q.term)
        if x.prefix and y.prefix and not (x.prefix.startswith(y.prefix) or y.prefix.startswith(x.prefix)):
            return None
        return iri_text(a) == iri_text(b)
    if x.kind == "bnode":
        return a.col == b.col
    if x.dt != y.dt or (x.lang or "").lower() != (y.lang or "").lower():
        return None
    return a.col == b.col


def key_of(e: E, term: Iri) -> Column | None:
    """e, an IRI by template, is this IRI: a comparison of the key alone, which a scan can push down."""
    if not term.value.startswith(e.vt.prefix):
        return None
    return e.col.cast("string") == F.lit(term.value[len(e.vt.prefix) :]) if not (key := term.value[len(e.vt.prefix) :]).lstrip("-").isdigit() else e.col == F.lit(key).try_cast("bigint")


def numeric(vt: VT) -> bool:
    return vt.kind == "lit" and vt.dt in NUMERIC


def number(e: E) -> Column:
    """The value of a poly column as a double, null where it is no number."""
    if e.vt.kind != "poly":
        return e.col.cast("double")
    return F.when(e.col["dt"].isin(*NUMERIC), parsed(e.col["lex"], DOUBLE))


def order_key(e: E) -> list[Column]:
    """Columns that sort as SPARQL's ORDER BY: unbound, blank nodes, IRIs, literals (numbers, dates, others by datatype, language and form)."""
    if e.vt.kind != "poly":
        return [iri_text(e) if e.vt.kind == "iri" and e.vt.prefix is not None else e.col]
    p = e.col
    dates = p["dt"].isin(DATE_TIME, DATE, GYEAR)
    rank = F.when(p["kind"] != LIT_KIND, p["kind"]).when(p["dt"].isin(*NUMERIC), F.lit(2)).when(dates, F.lit(3)).otherwise(F.lit(4))
    return [rank, number(e), F.when(dates, instant(p["lex"], p["dt"])), F.when(rank == 4, p["dt"]), p["lang"], p["lex"]]


def output(e: E) -> Column:
    """What a result shows: native values, IRIs as text, poly terms by their lexical form."""
    if e.vt.kind == "lit" and physical(e.vt.dt) != "string":
        return e.col.cast("double") if e.vt.dt == FLOAT else e.col
    return F.concat(F.lit("_:"), e.col) if e.vt.kind == "bnode" else lexical(e)


def lit(dt: str, lang: str | None = None) -> VT:
    return VT("lit", dt, lang)


BOOL, TEXT = lit(BOOLEAN), lit(STRING)


def is_text(vt: VT) -> bool:
    return vt.kind == "lit" and vt.dt in (STRING, LANG_STRING)


