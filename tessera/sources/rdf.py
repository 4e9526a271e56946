"""RDF syntaxes. N-Triples and N-Quads are read line by line, so files split. Turtle, TriG and RDF/XML need a file's lines in order: they are sorted to
one task and parsed as they come, so a task holds a statement or an element's ancestors, never a file. All files of a kind are one scan. Files under xz, lz4 and zst, for
which Spark has no reader, come as one value each (under 2 GB as compressed) and are decompressed in pieces.

All give quads: s, s_kind, p, o_lex, o_kind, o_dt, o_lang, g (null where the syntax names no graph). A blank node's label is made of the number of its
file and its label there, so it is the same when a task runs again.
"""

from __future__ import annotations

import bz2
import codecs
import gzip
import io
import lzma
import re
import xml.sax
import xml.sax.handler
from collections.abc import Iterator
from functools import reduce
from itertools import chain, groupby
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.terms import BOOLEAN, DECIMAL, DOUBLE, INTEGER, LANG_STRING, RDF, RDF_TYPE, STRING, BNode, Iri, Lit, unescape

QUAD = "s string, s_kind string, p string, o_lex string, o_kind string, o_dt string, o_lang string, g string"
SYNTAXES = {"nt": "ntriples", "ntriples": "ntriples", "nq": "nquads", "nquads": "nquads", "ttl": "turtle", "turtle": "turtle", "trig": "trig", "rdf": "rdfxml", "xml": "rdfxml", "owl": "rdfxml"}
CODECS = ("gz", "bz2", "xz", "lz4", "zst", "zstd")


class RdfError(ValueError):
    pass


def syntax_of(path: str) -> str:
    """The syntax that a file name tells, with or without a codec's ending."""
    parts = path.lower().rsplit("/", 1)[-1].split(".")
    if parts[-1] in CODECS:
        parts.pop()
    if len(parts) < 2 or parts[-1] not in SYNTAXES:
        raise RdfError(f"the name of {path} tells no RDF syntax")
    return SYNTAXES[parts[-1]]


def opened(data: bytes, path: str):
    """The decompressed contents as a stream."""
    end = path.lower().rsplit(".", 1)[-1]
    if end == "gz":
        return gzip.GzipFile(fileobj=io.BytesIO(data))
    if end == "bz2":
        return bz2.BZ2File(io.BytesIO(data))
    if end == "xz":
        return lzma.LZMAFile(io.BytesIO(data))
    if end in ("zst", "zstd"):
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True)
    if end == "lz4":
        return pa.CompressedInputStream(pa.BufferReader(data), "lz4")
    return io.BytesIO(data)


def pieces(stream, size: int = 1 << 20) -> Iterator[bytes]:
    while piece := stream.read(size):
        yield piece


def listed(spark: SparkSession, files: list[tuple[str, str, int]]) -> tuple[list[str], DataFrame]:
    """The paths to read, and (file, path, graph, n) of each file that Spark will find there; a folder stands for its files. The list, which the driver holds, goes to
    all tasks: a shuffle by file would put all lines of a file in one task."""
    hadoop, conf, paths, rows = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration(), [], []
    for path, graph, n in files:
        where = hadoop(path)
        found = where.getFileSystem(conf).globStatus(where) or []
        for x in found:
            inner = x.getPath().getFileSystem(conf).listStatus(x.getPath()) if x.isDirectory() else [x]
            own = [y.getPath() for y in inner if not y.isDirectory() and y.getPath().getName()[0] not in "._"]
            paths += [y.toString() for y in own]
            rows += [(plain_path(y.toUri().toString()), path, graph, n) for y in own]
        if not found:
            paths.append(path)  # Spark tells that it is missing
    return paths, F.broadcast(spark.createDataFrame(rows, "file string, path string, graph string, n int"))


def plain_path(x):
    """A path in one of the forms in which it may be given: file:/x for file:///x."""
    return F.regexp_replace(x, "^([a-z0-9]+):/+", "$1:/") if not isinstance(x, str) else re.sub("^([a-z0-9]+):/+", r"\1:/", x)


def row(s, p, o, g, n: int) -> tuple:
    """A quad as a row; n is the number of its file."""
    own = lambda t: f"f{n}_{t.label}"
    subject = (own(s), "bnode") if isinstance(s, BNode) else (s.value, "iri")
    if isinstance(o, Lit):
        obj = (o.lex, "literal", o.dt, o.lang)
    else:
        obj = (own(o), "bnode", None, None) if isinstance(o, BNode) else (o.value, "iri", None, None)
    return (*subject, p.value, *obj, g)


# -- N-Triples, N-Quads --------------------------------------------------------------------------------------------------------

_IRI, _BLANK, _LITERAL = r"<([^<>\"{}|^`\x00-\x20]*)>", r"_:([\w][\w.\-]*)", r"\"((?:[^\"\\\n\r]|\\.)*)\"(?:@([A-Za-z]+(?:-[A-Za-z0-9]+)*)|\^\^<([^<>\s]*)>)?"
LINE = rf"^\s*(?:{_IRI}|{_BLANK})\s*{_IRI}\s*(?:{_IRI}|{_BLANK}|{_LITERAL})\s*(?:{_IRI})?\s*\.\s*(?:#.*)?$"


def read_lines(spark: SparkSession, files: list[tuple[str, str, int]], strict: bool = True) -> DataFrame:
    """N-Triples and N-Quads by Spark's text reader, which decompresses gz and bz2 and splits what can be split. files: path, graph, number."""
    paths, names = listed(spark, files)
    lines = spark.read.text(paths).select("value", plain_path(F.col("_metadata.file_path")).alias("file")).where("trim(value) <> '' and not startswith(trim(value), '#')")
    return quads_of_lines(lines.join(names, "file"), strict, ["graph"]).withColumn("g", F.coalesce("g", "graph")).drop("graph")


def quads_of_lines(lines: DataFrame, strict: bool, also: list[str] | None = None) -> DataFrame:
    """Quads of lines (value, n), by regular expressions alone; strict: a line that is no statement stops the query, else it is left out."""
    held = lambda i: F.get("__parts", F.lit(i - 1))
    part = lambda i: F.nullif(held(i), F.lit(""))
    ok = F.col("value").rlike(LINE)
    if strict:
        lines = lines.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not a statement: "), F.substring("value", 1, 200))).cast("boolean")))
    else:
        lines = lines.where(ok)
    # all groups by one match, parted by what none of them holds; outside of terms a line feed is as good as a carriage return
    groups = "".join(f"${i}\n" for i in range(1, 10))
    lines = lines.withColumn("__parts", F.split(F.regexp_replace(F.replace("value", F.lit("\n"), F.lit("\r")), F.lit(LINE), F.lit(groups)), "\n"))
    label = lambda c: F.concat(F.lit("f"), F.col("n").cast("string"), F.lit("_"), c)
    lang, dt = F.lower(part(7)), part(8)
    literal = part(4).isNull() & part(5).isNull()
    return lines.select(
        F.coalesce(unescaped(part(1)), label(part(2))).alias("s"), F.when(part(1).isNotNull(), F.lit("iri")).otherwise(F.lit("bnode")).alias("s_kind"), unescaped(part(3)).alias("p"),
        F.when(literal, unescaped(held(6))).otherwise(F.coalesce(unescaped(part(4)), label(part(5)))).alias("o_lex"),
        F.when(literal, F.lit("literal")).when(part(4).isNotNull(), F.lit("iri")).otherwise(F.lit("bnode")).alias("o_kind"),
        F.when(literal, F.when(lang.isNotNull(), F.lit(LANG_STRING)).otherwise(F.coalesce(dt, F.lit(STRING)))).alias("o_dt"), F.when(literal, lang).alias("o_lang"), unescaped(part(9)).alias("g"), *(also or []),
    )


def unescaped(c):
    """Most terms have no escapes, and then no Python runs on them."""
    simple = F.replace(F.replace(F.replace(F.replace(F.replace(F.replace(c, F.lit("\\\\"), F.lit("\x00")), F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")), F.lit("\\t"), F.lit("\t")), F.lit("\x00"), F.lit("\\"))
    hexed = lambda s, pattern: F.array_join(
        F.transform(F.split(F.regexp_replace(s, pattern, "\x01$1\x02"), "\x01"), lambda piece: F.when(F.contains(piece, F.lit("\x02")), F.concat(_from_code(F.substring_index(piece, "\x02", 1)), F.substring_index(piece, "\x02", -1))).otherwise(piece)), ""
    )
    return F.when(~F.contains(c, F.lit("\\")), c).when(c.rlike(r"\\[uU]"), hexed(hexed(simple, r"\\u([0-9A-Fa-f]{4})"), r"\\U([0-9A-Fa-f]{8})")).otherwise(simple)


def _from_code(h):
    """The character of a hexadecimal code point, by its UTF-8 bytes."""
    n = F.conv(h, 16, 10).cast("int")
    byte = lambda x: F.lpad(F.hex(x), 2, "0")
    tail = lambda shift: byte(F.lit(128) + F.shiftright(n, shift).bitwiseAND(63))
    two = F.concat(byte(F.lit(192) + F.shiftright(n, 6)), tail(0))
    three = F.concat(byte(F.lit(224) + F.shiftright(n, 12)), tail(6), tail(0))
    four = F.concat(byte(F.lit(240) + F.shiftright(n, 18)), tail(12), tail(6), tail(0))
    return F.decode(F.unhex(F.when(n < 128, byte(n)).when(n < 2048, two).when(n < 65536, three).otherwise(four)), "UTF-8")


# -- Turtle, TriG --------------------------------------------------------------------------------------------------------------

_TOKEN = re.compile(
    r"""(?P<space>(?:\s|\#[^\n\r]*)+)
|(?P<iri><(?:[^<>"{}|^`\\\x00-\x20]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>)
|(?P<string>\"\"\"(?:\"{0,2}(?:[^"\\]|\\.))*\"\"\"|'''(?:'{0,2}(?:[^'\\]|\\.))*'''|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
|(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
|(?P<double>[+-]?(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+)|(?P<decimal>[+-]?\d*\.\d+)|(?P<integer>[+-]?\d+)
|(?P<bnode>_:\w(?:[\w.\-]*[\w\-])?)
|(?P<pname>(?:[^\W\d_](?:[\w.\-]*[\w\-])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w\-:.]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w\-:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
|(?P<word>[A-Za-z]+)
|(?P<op>\^\^|[{}()\[\].,;])""",
    re.X | re.S,
)


class Turtle:
    """A parser of Turtle and TriG; quads() yields (s, p, o, graph or None). The text may come in pieces; what is read is forgotten."""

    AHEAD = 1 << 14

    def __init__(self, text: str | Iterator[str], base: str = ""):
        self.more = iter([text] if isinstance(text, str) else text)
        self.text, self.base, self.prefixes, self.at, self.fresh = "", base, {}, 0, 0
        self.graph: str | None = None
        self.kind, self.value = "", ""
        self.out: list[tuple] = []
        self.advance()

    def fill(self, least: int) -> bool:
        """Reads on until `least` characters lie ahead; tells whether any came."""
        parts, ahead, came = [self.text[self.at :]], len(self.text) - self.at, False
        while ahead < least and (piece := next(self.more, None)) is not None:
            parts.append(piece)
            ahead, came = ahead + len(piece), True
        if came:
            self.text, self.at = "".join(parts), 0
        return came

    def advance(self) -> tuple[str, str]:
        was = (self.kind, self.value)
        while True:
            if len(self.text) - self.at < self.AHEAD:
                self.fill(self.AHEAD)
            if self.at >= len(self.text):
                break
            m = _TOKEN.match(self.text, self.at)
            # a token that ends where the text so far ends, or a long string without its end, may go on
            while (not m or m.end() == len(self.text) or m[0] in ('""', "''") and self.text.startswith(m[0] + m[0][0], self.at)) and self.fill(2 * (len(self.text) - self.at)):
                m = _TOKEN.match(self.text, self.at)
            if not m:
                raise RdfError(f"can't read {self.text[self.at : self.at + 30]!r}")
            self.at = m.end()
            if m.lastgroup != "space":
                self.kind, self.value = m.lastgroup, m[0]
                return was
        self.kind, self.value = "end", ""
        return was

    def took(self, op: str) -> bool:
        if self.kind == "op" and self.value == op:
            self.advance()
            return True
        return False

    def need(self, op: str) -> None:
        if not self.took(op):
            raise RdfError(f"{op} expected, {self.value!r} found")

    def blank(self) -> BNode:
        self.fresh += 1
        return BNode(f"genid{self.fresh}")

    def quads(self) -> Iterator[tuple]:
        while self.kind != "end":
            self.statement()
            yield from self.out
            self.out.clear()

    def statement(self) -> None:
        word = self.value.lower()
        if self.kind == "at" and word in ("@prefix", "@base") or self.kind == "word" and word in ("prefix", "base"):
            self.directive(word)
        elif self.took("{"):
            self.block(None)
        elif self.kind == "word" and word == "graph":
            self.advance()
            name = self.term()
            self.need("{")
            self.block(name)
        else:
            self.triples_or_graph()

    def directive(self, word: str) -> None:
        self.advance()
        if word.endswith("prefix"):
            name = self.advance()[1]
            self.prefixes[name[:-1]] = self.resolve(self.advance()[1][1:-1])
        else:
            self.base = self.resolve(self.advance()[1][1:-1])
        if word[0] == "@":
            self.need(".")

    def block(self, name) -> None:
        if name is not None and not isinstance(name, Iri):
            raise RdfError("a graph's name must be an IRI")
        self.graph = name.value if name else None
        while not self.took("}"):
            self.subject_and_properties()
            if not self.took("."):
                self.need("}")
                break
        self.graph = None

    def triples_or_graph(self) -> None:
        subject, alone = self.subject()
        if not alone and self.took("{"):
            self.block(subject)
            return
        if not (alone and self.kind == "op" and self.value == "."):
            self.properties(subject)
        self.need(".")

    def subject_and_properties(self) -> None:
        subject, alone = self.subject()
        if not (alone and self.kind == "op" and self.value in ".}"):
            self.properties(subject)

    def subject(self):
        """The subject, and whether it can be a whole statement."""
        alone = self.kind == "op" and self.value == "["
        s = self.object()
        if isinstance(s, Lit):
            raise RdfError("a literal can't be a subject")
        return s, alone

    def properties(self, subject) -> None:
        while True:
            if self.kind == "word" and self.value == "a":
                self.advance()
                verb = Iri(RDF_TYPE)
            else:
                verb = self.term()
            if not isinstance(verb, Iri):
                raise RdfError("a predicate must be an IRI")
            while True:
                self.out.append((subject, verb, self.object(), self.graph))
                if not self.took(","):
                    break
            if not self.took(";"):
                return
            while self.took(";"):
                pass
            if self.kind == "op" and self.value in ".]}":
                return

    def object(self):
        if self.took("["):
            b = self.blank()
            if not self.took("]"):
                self.properties(b)
                self.need("]")
            return b
        if self.took("("):
            items = []
            while not self.took(")"):
                items.append(self.object())
            head = Iri(RDF + "nil")
            for x in reversed(items):
                b = self.blank()
                self.out += [(b, Iri(RDF + "first"), x, self.graph), (b, Iri(RDF + "rest"), head, self.graph)]
                head = b
            return head
        return self.term()

    def resolve(self, iri: str) -> str:
        iri = unescape(iri)
        return urljoin(self.base, iri) if self.base and not re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", iri) else iri

    def term(self):
        kind, value = self.advance()
        if kind == "iri":
            return Iri(self.resolve(value[1:-1]))
        if kind == "pname":
            prefix, _, local = value.partition(":")
            if prefix not in self.prefixes:
                raise RdfError(f"prefix {prefix}: is not declared")
            return Iri(self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local))
        if kind == "bnode":
            return BNode(value[2:])
        if kind in ("integer", "decimal", "double"):
            return Lit(value, {"integer": INTEGER, "decimal": DECIMAL, "double": DOUBLE}[kind])
        if kind == "word" and value in ("true", "false"):
            return Lit(value, BOOLEAN)
        if kind == "string":
            quote = value[:3] if value[:3] in ('"""', "'''") else value[0]
            lex = unescape(value[len(quote) : -len(quote)])
            if self.kind == "at":
                return Lit(lex, LANG_STRING, self.advance()[1][1:].lower())
            if self.took("^^"):
                return Lit(lex, self.term().value)
            return Lit(lex)
        raise RdfError(f"a term expected, {value!r} found")


# -- RDF/XML -------------------------------------------------------------------------------------------------------------------

XML = "http://www.w3.org/XML/1998/namespace"


class _RdfXml(xml.sax.handler.ContentHandler):
    """Striped elements: nodes, and properties within nodes."""

    def __init__(self, base: str):
        super().__init__()
        self.base, self.fresh, self.out = base, 0, []
        self.stack: list[dict] = []

    def blank(self) -> BNode:
        self.fresh += 1
        return BNode(f"genid{self.fresh}")

    def iri(self, x: str, base: str) -> Iri:
        return Iri(urljoin(base, x) if base else x)

    def startElementNS(self, name, qname, attrs):
        ns, local = name[0] or "", name[1]
        a = {(k[0] or "") + k[1] if k[0] else k[1]: v for k, v in attrs.items()}
        up = self.stack[-1] if self.stack else {"role": "root", "lang": None, "base": self.base}
        frame = {"lang": a.pop(XML + "lang", up["lang"]), "base": a.pop(XML + "base", up["base"]), "text": [], "tag": ns + local}
        frame["lang"] = (frame["lang"] or "").lower() or None
        self.stack.append(frame)
        if up["role"] == "xml":
            frame["role"] = "xml"
            return
        if up["role"] == "root" and ns + local == RDF + "RDF":
            frame["role"] = "root"
            return
        if up["role"] in ("root", "property"):
            self.node(frame, up, a)
        else:
            self.property(frame, up, a)

    def node(self, frame: dict, up: dict, a: dict) -> None:
        frame["role"] = "node"
        if RDF + "about" in a:
            s = self.iri(a.pop(RDF + "about"), frame["base"])
        elif RDF + "ID" in a:
            s = self.iri("#" + a.pop(RDF + "ID"), frame["base"])
        elif RDF + "nodeID" in a:
            s = BNode("n_" + a.pop(RDF + "nodeID"))
        else:
            s = self.blank()
        frame["s"], frame["li"] = s, 0
        if frame["tag"] != RDF + "Description":
            self.out.append((s, Iri(RDF_TYPE), Iri(frame["tag"])))
        self.attributes(s, a, frame)
        if up["role"] == "property":
            up["used"] = True
            if up.get("items") is not None:
                up["items"].append(s)
            else:
                self.emit(up, s)

    def attributes(self, s, a: dict, frame: dict) -> None:
        for k, v in a.items():
            if k == RDF_TYPE:
                self.out.append((s, Iri(RDF_TYPE), self.iri(v, frame["base"])))
            elif ":" in k and not k.startswith(XML):
                self.out.append((s, Iri(k), Lit(v, LANG_STRING, frame["lang"]) if frame["lang"] else Lit(v)))

    def property(self, frame: dict, up: dict, a: dict) -> None:
        frame.update(role="property", s=up["s"], dt=a.pop(RDF + "datatype", None), used=False, id=a.pop(RDF + "ID", None))
        if frame["tag"] == RDF + "li":
            up["li"] += 1
            frame["tag"] = f"{RDF}_{up['li']}"
        how = a.pop(RDF + "parseType", None)
        if how == "Resource":
            b = self.blank()
            frame["used"] = True
            self.emit(frame, b)
            frame.update(role="node", s=b, li=0)
            return
        if how == "Collection":
            frame["items"], frame["used"] = [], True
            return
        if how:
            frame["role"], frame["literal"] = "xml", True
            frame["dt"] = RDF + "XMLLiteral"
            return
        o = None
        if RDF + "resource" in a:
            o = self.iri(a.pop(RDF + "resource"), frame["base"])
        elif RDF + "nodeID" in a:
            o = BNode("n_" + a.pop(RDF + "nodeID"))
        elif any(":" in k for k in a):
            o = self.blank()
        if o is not None:
            frame["used"] = True
            self.emit(frame, o)
            self.attributes(o, a, frame)

    def emit(self, frame: dict, o) -> None:
        self.out.append((frame["s"], Iri(frame["tag"]), o))
        if frame.get("id"):
            r = self.iri("#" + frame["id"], frame["base"])
            self.out += [(r, Iri(RDF_TYPE), Iri(RDF + "Statement")), (r, Iri(RDF + "subject"), frame["s"]), (r, Iri(RDF + "predicate"), Iri(frame["tag"])), (r, Iri(RDF + "object"), o)]

    def characters(self, content):
        if self.stack[-1].get("role") in ("property", "xml"):
            self.stack[-1]["text"].append(content)

    def endElementNS(self, name, qname):
        frame = self.stack.pop()
        if frame["role"] == "property":
            if frame.get("items") is not None:
                head = Iri(RDF + "nil")
                for x in reversed(frame["items"]):
                    b = self.blank()
                    self.out += [(b, Iri(RDF + "first"), x), (b, Iri(RDF + "rest"), head)]
                    head = b
                self.emit(frame, head)
            elif not frame["used"]:
                text = "".join(frame["text"])
                self.emit(frame, Lit(text, frame["dt"]) if frame["dt"] else Lit(text, LANG_STRING, frame["lang"]) if frame["lang"] else Lit(text))
        elif frame["role"] == "xml" and frame.get("literal"):
            self.emit(frame, Lit("".join(frame["text"]), frame["dt"]))
        elif frame["role"] == "xml" and self.stack:
            self.stack[-1]["text"].append("".join(frame["text"]))


def rdf_xml(data: Iterator[bytes], base: str = "") -> Iterator[tuple]:
    """Statements as their elements end; the parser is fed piece by piece."""
    handler = _RdfXml(base)
    parser = xml.sax.make_parser()
    parser.setFeature(xml.sax.handler.feature_namespaces, True)
    parser.setFeature(xml.sax.handler.feature_external_ges, False)
    parser.setContentHandler(handler)
    try:
        for piece in data:
            parser.feed(piece)
            for s, p, o in handler.out:
                yield s, p, o, None
            handler.out.clear()
        parser.close()
    except xml.sax.SAXException as e:
        raise RdfError(str(e)) from e
    for s, p, o in handler.out:
        yield s, p, o, None


_LINE = re.compile(LINE)


def statements(text: Iterator[str]) -> Iterator[tuple]:
    """N-Triples and N-Quads in files that Spark's text reader can't decompress."""
    for line in _lines(text):
        line = line.strip()
        if not line or line[0] == "#":
            continue
        m = _LINE.match(line)
        if not m:
            raise RdfError(f"not a statement: {line[:200]!r}")
        s, sb, p, o, ob, lex, lang, dt, g = m.groups()
        subject = BNode(sb) if s is None else Iri(unescape(s))
        if o is None and ob is None:
            obj = Lit(unescape(lex), LANG_STRING, lang.lower()) if lang else Lit(unescape(lex), dt or STRING)
        else:
            obj = BNode(ob) if o is None else Iri(unescape(o))
        yield subject, Iri(unescape(p)), obj, None if g is None else unescape(g)


PACKED = ("xz", "lz4", "zst", "zstd")


def by_line(path: str) -> bool:
    """Whether Spark's text reader can read it: lines, plain or by a codec that needs no native library."""
    return syntax_of(path) in ("ntriples", "nquads") and path.lower().rsplit(".", 1)[-1] not in PACKED


def _lines(text: Iterator[str]) -> Iterator[str]:
    rest = ""
    for piece in text:
        *whole, rest = (rest + piece).split("\n")
        yield from whole
    yield rest


def parse(data: Iterator[bytes], path: str, base: str) -> Iterator[tuple]:
    """The statements of a file whose decompressed contents come in pieces."""
    if syntax_of(path) == "rdfxml":
        return rdf_xml(data, base)
    text = codecs.iterdecode(data, "utf-8")
    return statements(text) if syntax_of(path) in ("ntriples", "nquads") else Turtle(text, base).quads()


def parse_file(data: bytes, path: str, base: str) -> Iterator[tuple]:
    return parse(pieces(opened(data, path)), path, base)


NAMES = [f.split()[0] for f in QUAD.split(", ")]


def _rows(found: Iterator[tuple], n: int, graph: str, strict: bool) -> Iterator[pa.RecordBatch]:
    """Batches of quads; what names no graph is in the file's. Not strict: what comes before an error counts."""
    rows = []
    try:
        for s, p, o, g in found:
            rows.append(row(s, p, o, g or graph, n))
            if len(rows) == 10_000:
                yield _batch(rows, NAMES)
                rows = []
    except (RdfError, UnicodeDecodeError):
        if strict:
            raise
    if rows:
        yield _batch(rows, NAMES)


def read_files(spark: SparkSession, files: list[tuple[str, str, int]], strict: bool = True) -> DataFrame:
    """Turtle, TriG, RDF/XML, and lines under xz, lz4 or zst. files: path, graph (and base), number."""
    packed = [x for x in files if x[0].lower().rsplit(".", 1)[-1] in PACKED]
    plain = [x for x in files if x not in packed]
    parts = ([_read_ordered(spark, plain, strict)] if plain else []) + ([_read_packed(spark, packed, strict)] if packed else [])
    return reduce(DataFrame.unionByName, parts)


def _read_packed(spark: SparkSession, files: list[tuple[str, str, int]], strict: bool) -> DataFrame:
    paths, names = listed(spark, files)
    data = spark.read.format("binaryFile").load(paths).select(plain_path(F.col("path")).alias("file"), "content").join(names, "file").select("content", "path", "graph", "n")

    def run(batches):
        for batch in batches:
            for content, path, graph, n in zip(*(c.to_pylist() for c in batch.columns)):
                yield from _rows(parse_file(content, path, graph), n, graph, strict)

    return data.mapInArrow(run, QUAD)


def _read_ordered(spark: SparkSession, files: list[tuple[str, str, int]], strict: bool) -> DataFrame:
    paths, names = listed(spark, files)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("place")
    lines = spark.read.option("lineSep", "\n").text(paths).select(F.col("value").cast("binary").alias("value"), plain_path(F.col("_metadata.file_path")).alias("file"), place)
    lines = lines.join(names, "file").select("n", "file", "place", "value", "path", "graph")
    n = max(1, min(len(paths), 10 * int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def run(batches):
        rows = ((file, value, path, graph, n) for b in batches for file, value, path, graph, n in zip(*(b.column(c).to_pylist() for c in ("file", "value", "path", "graph", "n"))))
        for _, own in groupby(rows, key=lambda r: r[0]):
            first = next(own)
            yield from _rows(parse(_joined(r[1] for r in chain([first], own)), first[2], first[3]), first[4], first[3], strict)

    return lines.repartition(n, "file").sortWithinPartitions("file", "place").mapInArrow(run, QUAD)


def _joined(lines: Iterator[bytes], size: int = 1 << 16) -> Iterator[bytes]:
    held, length = [], 0
    for line in lines:
        held.append(line)
        length += len(line) + 1
        if length >= size:
            yield b"\n".join(held) + b"\n"
            held, length = [], 0
    yield b"\n".join(held) + b"\n"


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names)
