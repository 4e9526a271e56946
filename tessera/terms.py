"""Terms: IRIs, blank nodes, literals, variables; datatypes and their native column types; N-Triples forms."""

from __future__ import annotations

import re
from dataclasses import dataclass

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDF_TYPE, LANG_STRING = RDF + "type", RDF + "langString"
STRING, BOOLEAN, INTEGER, DECIMAL, DOUBLE, FLOAT = (XSD + x for x in ("string", "boolean", "integer", "decimal", "double", "float"))
DATE_TIME, DATE, GYEAR = XSD + "dateTime", XSD + "date", XSD + "gYear"
WHOLE = {XSD + x: t for x, t in {"int": "int", "long": "bigint", "integer": "decimal(38,0)", "short": "int", "byte": "int", "nonNegativeInteger": "decimal(38,0)", "positiveInteger": "decimal(38,0)", "unsignedInt": "bigint", "unsignedLong": "decimal(38,0)", "negativeInteger": "decimal(38,0)", "nonPositiveInteger": "decimal(38,0)", "unsignedShort": "int", "unsignedByte": "int"}.items()}
NUMERIC = {**WHOLE, DECIMAL: "decimal(38,18)", DOUBLE: "double", FLOAT: "float"}
#: The Spark type in which a literal's value is held; other datatypes keep their lexical form.
NATIVE = {**NUMERIC, BOOLEAN: "boolean", DATE_TIME: "timestamp_ntz", DATE: "date", GYEAR: "int", STRING: "string", LANG_STRING: "string"}


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Iri:
    value: str


@dataclass(frozen=True)
class BNode:
    label: str


@dataclass(frozen=True)
class Lit:
    lex: str
    dt: str = STRING
    lang: str | None = None


Term = Iri | BNode | Lit

LEXICAL = {
    **{dt: r"\s*[+-]?[0-9]+\s*" for dt in WHOLE},
    DECIMAL: r"\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)\s*",
    DOUBLE: r"\s*([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?INF|NaN)\s*",
    BOOLEAN: r"\s*(true|false|1|0)\s*",
    DATE_TIME: r"\s*-?[0-9]{4,}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?\s*",
    DATE: r"\s*-?[0-9]{4,}-[0-9]{2}-[0-9]{2}(Z|[+-][0-9]{2}:[0-9]{2})?\s*",
    GYEAR: r"\s*-?[0-9]{4,}(Z|[+-][0-9]{2}:[0-9]{2})?\s*",
}
LEXICAL[FLOAT] = LEXICAL[DOUBLE]

_escape = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def unescape(s: str) -> str:
    """The text of a literal or IRI with its escapes resolved."""
    if "\\" not in s:
        return s
    plain = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}

    def one(m: re.Match) -> str:
        x = m[1]
        return chr(int(x[1:], 16)) if x[0] in "uU" and len(x) > 1 else plain.get(x, x)

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, s, flags=re.S)


def n_triples(t: Term) -> str:
    if isinstance(t, Iri):
        return f"<{t.value}>"
    if isinstance(t, BNode):
        return f"_:{t.label}"
    body = '"' + "".join(_escape.get(c, c) for c in t.lex) + '"'
    return body + (f"@{t.lang}" if t.lang else "" if t.dt == STRING else f"^^<{t.dt}>")


_FORM = re.compile(r"""<([^<>"{}|^`\x00-\x20]*)>|_:(\w(?:[\w.\-]*[\w\-])?)|"((?:[^"\\\n\r]|\\.)*)"(?:@([A-Za-z]+(?:-[A-Za-z0-9]+)*)|\^\^<([^<>\s]*)>)?""", re.S)


def parse_term(text: str) -> Term:
    """The term of an N-Triples form: the inverse of n_triples()."""
    m = _FORM.fullmatch(text.strip())
    if not m:
        raise ValueError(f"not a term: {text!r}")
    iri, label, lex, lang, dt = m.groups()
    if iri is not None:
        return Iri(unescape(iri))
    if label is not None:
        return BNode(label)
    return Lit(unescape(lex), LANG_STRING, lang.lower()) if lang else Lit(unescape(lex), unescape(dt) if dt else STRING)
