"""Relational Parquet tables as virtual quads: nothing is copied, each column is a partition."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from tessera.catalog import Catalog, Partition, TermMap
from tessera.terms import BOOLEAN, DATE_TIME, DOUBLE, GYEAR, LANG_STRING, RDF_TYPE, STRING, XSD

BASE = "http://ex.org/"
VOCABULARY = BASE + "v#"
#: Datatypes by the types of columns.
DATATYPES = {"int": XSD + "int", "bigint": XSD + "long", "double": DOUBLE, "string": STRING, "boolean": BOOLEAN, "timestamp_ntz": DATE_TIME, "timestamp": DATE_TIME}


@dataclass
class Table:
    """How a table maps: key is the expression of the subject's key; links are columns that hold keys of other tables."""

    name: str
    key: str
    columns: dict[str, str] = field(default_factory=dict)  # column: type
    links: dict[str, str] = field(default_factory=dict)  # column: table
    iris: tuple[str, ...] = ()  # columns that hold whole IRIs
    extra: dict[str, tuple[str, str]] = field(default_factory=dict)  # property: (expression, datatype)
    langs: dict[str, tuple[str, tuple[str, ...]]] = field(default_factory=dict)  # column: (language column, languages)
    blank: bool = False
    unique: bool = True
    graph: str | None = None
    graphs: str | None = None


def table_catalog(spark: SparkSession, folder: str, tables: list[Table]) -> Catalog:
    catalog = Catalog(namespaces={"v": VOCABULARY})
    for t in tables:
        catalog.frames[t.name] = lambda t=t: spark.read.parquet(f"{folder}/{t.name}.parquet")
        catalog.partitions += partitions(t)
    return catalog


def partitions(t: Table) -> list[Partition]:
    subject = TermMap("bnode", t.key) if t.blank else TermMap("iri", t.key, f"{BASE}{t.name}/")
    graph = None if t.graphs else t.graph or f"{BASE}g/{t.name}"
    own = dict(source=t.name, subject=subject, graph=graph, graphs=t.graphs, unique=t.unique)
    out = [Partition(RDF_TYPE, object=TermMap("iri", const=VOCABULARY + t.name.capitalize()), **own)]
    for column, kind in t.columns.items():
        p = VOCABULARY + column
        if column in t.links:
            out.append(Partition(p, object=TermMap("iri", f"`{column}`", f"{BASE}{t.links[column]}/"), **own))
        elif column in t.iris:
            out.append(Partition(p, object=TermMap("iri", f"`{column}`"), **own))
        elif column in t.langs:
            by, langs = t.langs[column]
            for lang in langs:
                out.append(Partition(p, object=TermMap("lit", f"`{column}`", dt=LANG_STRING, lang=lang), where=f"`{by}` = '{lang}'", **own))
        else:
            out.append(Partition(p, object=TermMap("lit", f"`{column}`", dt=DATATYPES[kind]), **own))
    for name, (expr, dt) in t.extra.items():
        link = dt[len("link:") :] if dt.startswith("link:") else None
        out.append(Partition(VOCABULARY + name, object=TermMap("iri", expr, f"{BASE}{link}/") if link else TermMap("lit", expr, dt=dt), **own))
    return out


def driver_tables() -> list[Table]:
    """The mapping of the test tables."""
    long, text = "bigint", "string"
    line_key = "concat_ws('_', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)"
    return [
        Table("region", "r_regionkey", {"r_regionkey": "int", "r_name": text}),
        Table("nation", "n_nationkey", {"n_nationkey": "int", "n_name": text, "n_regionkey": "int"}, {"n_regionkey": "region"}),
        Table(
            "customer", "c_custkey", {"c_custkey": long, "c_name": text, "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": text}, {"c_nationkey": "nation"},
            graphs=f"filter(array('{BASE}g/customer', if(c_nationkey = 7, '{BASE}g/seventh', null)), x -> x is not null)",
        ),
        Table("supplier", "s_suppkey", {"s_suppkey": long, "s_name": text, "s_nationkey": "int", "s_acctbal": "double"}, {"s_nationkey": "nation"}),
        Table("part", "p_partkey", {"p_partkey": long, "p_name": text, "p_brand": text, "p_type": text, "p_size": "int", "p_retailprice": "double"}),
        Table(
            "orders", "o_orderkey", {"o_orderkey": long, "o_custkey": long, "o_orderstatus": text, "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": text}, {"o_custkey": "customer"},
            extra={"o_year": ("year(o_orderdate)", GYEAR)},
        ),
        Table(
            "lineitem", line_key,
            {"l_orderkey": long, "l_partkey": long, "l_suppkey": long, "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": text, "l_linestatus": text, "l_shipdate": "timestamp_ntz"},
            {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}, blank=True,
        ),
        Table("events", "event_id", {"event_id": long, "ts": "timestamp_ntz", "user_id": long, "event_type": text, "value": "double", "props": text}),
        Table("documents", "doc_id", {"doc_id": long, "text": text, "lang": text, "source": text, "n_chars": long}, langs={"text": ("lang", ("en", "fr", "de", "es"))}, graphs=f"array(concat('{BASE}g/', source))"),
        Table("labels", "doc_id", {"quality": "int"}, extra={"toxic": ("toxic = 1", BOOLEAN), "labels": ("doc_id", "link:documents")}),
        Table("benchmark", "item_id", {"item_id": long}, extra={"item_text": ("text", STRING)}),
        Table("pages", "page_id", {"page_id": long, "url": text, "html": text}, iris=("url",)),
        Table("conversations", "concat(conv_id, '/', turn)", {"turn": long, "role": text}, extra={"conv": ("conv_id", STRING), "said": ("text", STRING), "next": ("concat(conv_id, '/', turn + 1)", "link:conversations")}),
        Table("embeddings", "vec_id", {"vec_id": long, "label": "int"}),
    ]
