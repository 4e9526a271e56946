"""SPARQL expressions as columns. An error is null, so the three-valued logic of Spark is that of SPARQL."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.sparql.parser import SparqlError
from tessera.terms import BOOLEAN, DATE, DATE_TIME, DECIMAL, DOUBLE, FLOAT, GYEAR, INTEGER, LANG_STRING, NUMERIC, STRING, WHOLE, XSD, Iri, Lit, Var
from tessera.values import BNODE_KIND, BOOL, IRI_KIND, LIT_KIND, OFFSET, TEXT, VT, E, common, constant, instant, iri_text, is_text, lexical, lit, literal, number, numeric, parsed, physical, poly, same_term, to

DECIMAL_TYPE = "decimal(38,18)"


def error(vt: VT = BOOL) -> E:
    return E(F.lit(None).cast(physical(vt.dt) if vt.kind == "lit" else "string"), vt)


def truth(e: E) -> Column:
    """The effective boolean value."""
    vt, col = e.vt, e.col
    if vt.kind == "poly":
        value = F.when(col["dt"] == BOOLEAN, parsed(col["lex"], BOOLEAN)).when(col["dt"] == STRING, F.length(col["lex"]) > 0)
        return value.when(col["dt"].isin(*NUMERIC), F.coalesce((number(e) != 0) & ~F.isnan(number(e)), F.lit(False)))
    if vt.kind != "lit":
        return F.lit(None).cast("boolean")
    if vt.dt == BOOLEAN:
        return col
    if is_text(vt):
        return F.length(col) > 0
    if numeric(vt):
        return (col != 0) & ~F.isnan(col.cast("double"))
    return F.lit(None).cast("boolean")


def _level(vt: VT) -> str:
    """The type in which arithmetic is done."""
    return INTEGER if vt.dt in WHOLE else vt.dt


def promoted(a: E, b: E) -> tuple[Column, Column, str] | None:
    if not (numeric(a.vt) and numeric(b.vt)):
        return None
    x, y = _level(a.vt), _level(b.vt)
    for dt, kind in ((DOUBLE, "double"), (FLOAT, "float")):
        if dt in (x, y):
            return a.col.cast(kind), b.col.cast(kind), dt
    if DECIMAL in (x, y):
        return a.col.cast(DECIMAL_TYPE), b.col.cast(DECIMAL_TYPE), DECIMAL
    return a.col.cast("bigint"), b.col.cast("bigint"), INTEGER


def _math_poly(op: str, a: E, b: E) -> E:
    """Arithmetic on terms whose datatypes rows tell: whole numbers and decimals stay exact."""
    p, q = poly(a), poly(b)
    exact = p["dt"].isin(*WHOLE, DECIMAL) & q["dt"].isin(*WHOLE, DECIMAL)
    whole = p["dt"].isin(*WHOLE) & q["dt"].isin(*WHOLE) & F.lit(op != "/")
    decimals = math(op, *[E(x["lex"].try_cast(DECIMAL_TYPE), lit(DECIMAL)) for x in (p, q)]).col
    doubles = math(op, *[E(number(E(x, VT("poly"))), lit(DOUBLE)) for x in (p, q)]).col
    return number_term(whole, exact, decimals, doubles)


def number_term(whole: Column, exact: Column, decimals: Column, doubles: Column) -> E:
    """A poly number: an integer, a decimal or a double."""
    text = F.when(whole, decimals.try_cast("decimal(38,0)").cast("string")).when(exact, lexical(E(decimals, lit(DECIMAL)))).otherwise(lexical(E(doubles, lit(DOUBLE))))
    return E(literal(text, F.when(whole, F.lit(INTEGER)).when(exact, F.lit(DECIMAL)).otherwise(F.lit(DOUBLE))), VT("poly"))


def math(op: str, a: E, b: E) -> E:
    if "poly" in (a.vt.kind, b.vt.kind) and all(x.vt.kind == "poly" or numeric(x.vt) for x in (a, b)):
        return _math_poly(op, a, b)
    both = promoted(a, b)
    if both is None:
        return error(lit(DOUBLE))
    x, y, dt = both
    if op == "/":
        if dt == INTEGER:
            return E(F.try_divide(x.cast("decimal(20,0)"), y.cast("decimal(20,0)")).try_cast(DECIMAL_TYPE), lit(DECIMAL))
        if dt in (DOUBLE, FLOAT):  # by zero: infinite, or not a number
            zero = F.when((x == 0) | F.isnan(x), F.lit(float("nan"))).when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
            return E(F.when(y == 0, zero).otherwise(F.try_divide(x, y)).cast(physical(dt)), lit(dt))
        return E(F.try_divide(x, y).try_cast(DECIMAL_TYPE), lit(dt))
    made = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y)
    return E(made.try_cast(DECIMAL_TYPE) if dt == DECIMAL else made, lit(dt))


def _ordered(op: str, x: Column, y: Column) -> Column:
    return {"=": x == y, "!=": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]


def compare(op: str, a: E, b: E) -> E:
    both = promoted(a, b) if "poly" not in (a.vt.kind, b.vt.kind) else None
    if both:
        x, y, dt = both
        found = _ordered(op, x, y)
        if dt in (DOUBLE, FLOAT):  # nothing compares with what is not a number
            found = F.when(F.isnan(x) | F.isnan(y), F.lit(op == "!=")).otherwise(found)
            found = F.when(x.isNotNull() & y.isNotNull(), found)
        return E(found, BOOL)
    if "poly" in (a.vt.kind, b.vt.kind):
        return E(_compare_poly(op, a, b), BOOL)
    equal = op in ("=", "!=")
    p, q = a.vt, b.vt
    present = a.col.isNotNull() & b.col.isNotNull()
    if p.kind == q.kind == "lit":
        known = p.dt == q.dt and p.dt in (STRING, BOOLEAN, DATE_TIME, DATE, GYEAR)
        if known:
            return E(_ordered(op, a.col, b.col), BOOL)
        if equal and p.dt == q.dt and (p.lang or "").lower() == (q.lang or "").lower():
            # of other datatypes only equal forms are known to be equal; language-tagged texts are compared as they are
            return E(_ordered(op, a.col, b.col) if p.dt == LANG_STRING else F.when(a.col == b.col, F.lit(op == "=")), BOOL)
        if equal and LANG_STRING in (p.dt, q.dt):
            return E(F.when(present, F.lit(op == "!=")), BOOL)
        if {p.dt, q.dt} == {DATE, DATE_TIME} and not equal:
            return E(_ordered(op, a.col.cast("timestamp_ntz"), b.col.cast("timestamp_ntz")), BOOL)
        return error()
    if not equal:
        return error() if p.kind != "iri" or q.kind != "iri" else E(_ordered(op, iri_text(a), iri_text(b)), BOOL)
    same = same_term(a, b)
    same = F.lit(False) if same is None else same
    return E(F.when(present, same if op == "=" else ~same), BOOL)


def _compare_poly(op: str, a: E, b: E) -> Column:
    p, q = poly(a), poly(b)
    x, y = number(E(p, VT("poly"))), number(E(q, VT("poly")))
    numbers = p["dt"].isin(*NUMERIC) & q["dt"].isin(*NUMERIC)
    by_value = F.when(F.isnan(x) | F.isnan(y), F.lit(op == "!=")).otherwise(_ordered(op, x, y))
    # whole numbers beyond the exact range of doubles
    m, n = p["lex"].try_cast("decimal(38,0)"), q["lex"].try_cast("decimal(38,0)")
    whole = p["dt"].isin(*WHOLE) & q["dt"].isin(*WHOLE) & m.isNotNull() & n.isNotNull()
    alike = p["dt"] == q["dt"]
    dates = alike & p["dt"].isin(DATE_TIME, DATE, GYEAR)
    out = F.when(p.isNull() | q.isNull(), F.lit(None).cast("boolean")).when(whole, _ordered(op, m, n)).when(numbers, by_value)
    out = out.when(dates, _ordered(op, instant(p["lex"], p["dt"]), instant(q["lex"], q["dt"]))).when(alike & (p["dt"] == BOOLEAN), _ordered(op, parsed(p["lex"], BOOLEAN), parsed(q["lex"], BOOLEAN)))
    out = out.when(alike & (p["dt"] == STRING), _ordered(op, p["lex"], q["lex"]))
    if op in ("=", "!="):
        same = (p["kind"] == q["kind"]) & (p["lex"] == q["lex"]) & p["dt"].eqNullSafe(q["dt"]) & p["lang"].eqNullSafe(q["lang"])
        unknown = (p["kind"] == LIT_KIND) & (q["kind"] == LIT_KIND) & p["lang"].isNull() & q["lang"].isNull()
        out = out.when(same, F.lit(op == "=")).when(~unknown, F.lit(op == "!="))
    return out


def text_of(e: E) -> Column:
    """The characters of a text argument; null for what is no text."""
    if e.vt.kind == "poly":
        return F.when(e.col["dt"].isin(STRING, LANG_STRING), e.col["lex"])
    return e.col if is_text(e.vt) else F.lit(None).cast("string")


def fits(a: E, b: E) -> Column | None:
    """The argument compatibility of two texts: the second is simple, or has the first's language."""
    if "poly" in (a.vt.kind, b.vt.kind):
        return None
    return F.lit(b.vt.dt == STRING or (a.vt.lang or "").lower() == (b.vt.lang or "").lower())


def _fit(a: E, b: E, made: Column) -> Column:
    ok = fits(a, b)
    return made if ok is None else F.when(ok, made)


def like_first(e: E) -> VT:
    return VT("lit", e.vt.dt, e.vt.lang) if is_text(e.vt) else TEXT


def cast(dt: str, e: E) -> E:
    vt = lit(dt)
    if e.vt.kind == "bnode" or e.vt.kind == "iri" and dt != STRING:
        return error(vt)
    if dt == STRING:
        return E(lexical(e), vt)
    if e.vt.kind == "poly" or physical(e.vt.dt) == "string":
        text = F.trim(lexical(e))
        if dt == DATE_TIME:  # an offset stays
            return E(literal(F.when(parsed(text, dt).isNotNull(), text), dt), VT("poly"))
        return E(parsed(text, dt), vt)
    x = e.col
    if numeric(vt) and numeric(e.vt):
        if dt in WHOLE and e.vt.dt in (DOUBLE, FLOAT, DECIMAL):
            x = F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)) if e.vt.dt == DECIMAL else F.when(~F.isnan(x) & (F.abs(x) < 9.2e18), F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)))
        return E(x.try_cast(DECIMAL_TYPE if dt == DECIMAL else physical(dt)), vt)
    if dt == BOOLEAN and numeric(e.vt):
        return E((x != 0) & ~F.isnan(x.cast("double")), vt)
    if numeric(vt) and e.vt.dt == BOOLEAN:
        return E(x.cast("int").cast(DECIMAL_TYPE if dt == DECIMAL else physical(dt)), vt)
    if dt == e.vt.dt:
        return E(x, vt)
    if {dt, e.vt.dt} == {DATE, DATE_TIME}:
        return E(x.cast(physical(dt)), vt)
    return error(vt)


def _flags(pattern: E, flags: E | None) -> Column:
    if flags is None:
        return text_of(pattern)
    if isinstance(flags.term, Lit):
        kept = "".join(c for c in flags.term.lex if c in "ismx")
        body = text_of(pattern)
        if "q" in flags.term.lex:
            body = F.concat(F.lit("\\Q"), body, F.lit("\\E"))
        return F.concat(F.lit(f"(?{kept})"), body) if kept else body
    return F.concat(F.lit("(?"), text_of(flags), F.lit(")"), text_of(pattern))


def call(name: str, args: list[E], base: str = "") -> E:
    """A function whose arguments are evaluated first."""
    made = FUNCTIONS.get(name)
    if made is None:
        raise SparqlError(f"no function {name}")
    if name in NEEDS_BASE:
        return made(base, *args)
    return made(*args)


def _kind_test(kind: int, name: str) -> Callable[[E], E]:
    def test(e: E) -> E:
        if e.vt.kind == "poly":
            return E(e.col["kind"] == kind, BOOL)
        return E(F.when(e.col.isNotNull(), F.lit(e.vt.kind == name)), BOOL)

    return test


def _is_numeric(e: E) -> E:
    if e.vt.kind == "poly":
        return E(F.when(e.col.isNotNull(), F.coalesce(e.col["dt"].isin(*NUMERIC) & number(e).isNotNull(), F.lit(False))), BOOL)
    return E(F.when(e.col.isNotNull(), F.lit(numeric(e.vt))), BOOL)


def _lang(e: E) -> E:
    if e.vt.kind == "poly":
        return E(F.when(e.col["kind"] == LIT_KIND, F.coalesce(e.col["lang"], F.lit(""))), TEXT)
    return E(F.when(e.col.isNotNull(), F.lit(e.vt.lang or "")), TEXT) if e.vt.kind == "lit" else error(TEXT)


def _datatype(e: E) -> E:
    if e.vt.kind == "poly":
        return E(e.col["dt"], VT("iri"))
    return E(F.when(e.col.isNotNull(), F.lit(e.vt.dt)), VT("iri")) if e.vt.kind == "lit" else error(VT("iri"))


def _lang_matches(a: E, b: E) -> E:
    x, y = F.lower(text_of(a)), F.lower(text_of(b))
    return E(F.when(y == "*", x != "").otherwise((x == y) | F.startswith(x, F.concat(y, F.lit("-")))), BOOL)


def resolved(base: str, text: Column) -> Column:
    """References against a base IRI."""
    at = urlsplit(base)
    root, home = f"{at.scheme}://{at.netloc}" if at.netloc else f"{at.scheme}:", at.path[: at.path.rfind("/") + 1] or "/"
    path, tail = F.regexp_extract(text, "^([^?#]*)", 1), F.regexp_extract(text, "(?s)^[^?#]*(.*)$", 1)
    steps = F.split(F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(home), path)), "/")
    up = lambda done: F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
    done = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", up(acc)).when(x == ".", acc).otherwise(F.array_append(acc, x)))
    done = F.when(F.element_at(steps, -1).isin(".", ".."), F.array_append(done, F.lit(""))).otherwise(done)
    whole = F.concat(F.lit(root), F.array_join(done, "/"), tail)
    bare = base.split("#", 1)[0]
    out = F.when(text.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), text).when((text == "") | text.startswith("#"), F.concat(F.lit(bare), text))
    return out.when(text.startswith("?"), F.concat(F.lit(bare.split("?", 1)[0]), text)).when(text.startswith("//"), F.concat(F.lit(at.scheme + ":"), text)).otherwise(whole)


def _iri(base: str, e: E) -> E:
    if e.vt.kind == "iri":
        return e
    text = lexical(e)
    if base:
        text = resolved(base, text)
    return E(text if e.vt.kind == "poly" or is_text(e.vt) else F.lit(None).cast("string"), VT("iri"))


def _bnode(e: E | None = None) -> E:
    """A new node; with a text, the same one for the same text within a solution, which goes by the number of its row."""
    if e is None:
        return E(F.regexp_replace(F.expr("uuid()"), "-", ""), VT("bnode"))
    return E(F.concat(F.lit("l"), F.md5(text_of(e).cast("binary")), F.lit("_"), F.monotonically_increasing_id().cast("string")), VT("bnode"))


def _str_dt(a: E, b: E) -> E:
    if not isinstance(b.term, Iri):
        return E(F.when(text_of(a).isNotNull(), F.struct(F.lit(LIT_KIND).alias("kind"), text_of(a).alias("lex"), iri_text(b).alias("dt"), F.lit(None).cast("string").alias("lang"))), VT("poly"))
    dt = b.term.value
    x = text_of(a) if a.vt.kind != "lit" or a.vt.dt == STRING else F.lit(None).cast("string")
    return E(parsed(x, dt) if physical(dt) != "string" else x, lit(dt))


def _str_lang(a: E, b: E) -> E:
    x = text_of(a) if a.vt.kind != "lit" or a.vt.dt == STRING else F.lit(None).cast("string")
    if isinstance(b.term, Lit):
        return E(x, lit(LANG_STRING, b.term.lex.lower()))
    return E(F.when(x.isNotNull(), F.struct(F.lit(LIT_KIND).alias("kind"), x.alias("lex"), F.lit(LANG_STRING).alias("dt"), F.lower(text_of(b)).alias("lang"))), VT("poly"))


def _substr(a: E, start: E, n: E | None = None) -> E:
    """From position start, counted from one; what is before the text is cut off both ends' count."""
    s, first = text_of(a), F.floor(start.col.cast("double") + 0.5).cast("int")
    if n is None:
        return E(F.substring(s, F.greatest(first, F.lit(1)), F.length(s)), like_first(a))
    end = first + F.floor(n.col.cast("double") + 0.5).cast("int")
    begin = F.greatest(first, F.lit(1))
    return E(F.substring(s, begin, F.greatest(end - begin, F.lit(0))), like_first(a))


def _before(a: E, b: E) -> E:
    s, t = text_of(a), text_of(b)
    return E(_fit(a, b, F.when(F.instr(s, t) > 0, F.substring(s, F.lit(1), F.instr(s, t) - 1)).otherwise(F.when(s.isNotNull() & t.isNotNull(), F.lit("")))), like_first(a))


def _after(a: E, b: E) -> E:
    s, t = text_of(a), text_of(b)
    return E(_fit(a, b, F.when(F.instr(s, t) > 0, F.substring(s, F.instr(s, t) + F.length(t), F.length(s))).otherwise(F.when(s.isNotNull() & t.isNotNull(), F.lit("")))), like_first(a))


def _encode(e: E) -> E:
    x = F.url_encode(text_of(e))
    for found, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        x = F.replace(x, F.lit(found), F.lit(wanted))
    return E(x, TEXT)


def _regex(a: E, pattern: E, flags: E | None = None) -> E:
    s = text_of(a)
    if flags is None and isinstance(pattern.term, Lit):  # plain beginnings and ends can be pushed down to a scan
        p = pattern.term.lex
        plain = p.strip("^$").replace("\\.", "")
        if plain.replace(" ", "").replace("_", "").isalnum() and p.count("^") == p.startswith("^") and p.count("$") == p.endswith("$") and "\\" not in p:
            body = F.lit(p.strip("^$"))
            if p[0] == "^" and p[-1] == "$":
                return E(s == body, BOOL)
            return E(F.startswith(s, body) if p[0] == "^" else F.endswith(s, body) if p[-1] == "$" else F.contains(s, body), BOOL)
    return E(F.rlike(s, _flags(pattern, flags)), BOOL)


def _replace(a: E, pattern: E, by: E, flags: E | None = None) -> E:
    full = _flags(pattern, flags)
    return E(F.when(~F.rlike(F.lit(""), full), F.regexp_replace(text_of(a), full, text_of(by))), like_first(a))


def _round(e: E) -> E:
    return _whole(e, lambda x: F.floor(x + F.lit(0.5).cast("decimal(2,1)")) if e.vt.dt == DECIMAL else F.floor(x + 0.5))


def _whole(e: E, made: Callable[[Column], Column]) -> E:
    if e.vt.kind == "poly":
        return E(made(number(e)).cast("double"), lit(DOUBLE))
    if not numeric(e.vt):
        return error(lit(DOUBLE))
    if e.vt.dt in WHOLE:
        return e
    if e.vt.dt == DECIMAL:
        return E(made(e.col).cast(DECIMAL_TYPE), e.vt.bound())
    # beyond 2**53 doubles are whole
    x = e.col.cast("double")
    return E(F.when((F.abs(x) < 9e15) & ~F.isnan(x), made(x).cast("double")).otherwise(x).cast(physical(e.vt.dt)), e.vt.bound())


def _absolute(e: E) -> E:
    return E(F.abs(number(e)), lit(DOUBLE)) if e.vt.kind == "poly" else E(F.when(e.col < 0, _negative(e.col, e.vt.dt)).otherwise(e.col), e.vt.bound()) if numeric(e.vt) else error(lit(DOUBLE))


def _negative(x: Column, dt: str) -> Column:
    """Null where the type can't hold it."""
    return -x if dt in (DOUBLE, FLOAT, DECIMAL) else F.try_subtract(F.lit(0).cast(physical(dt)), x)


def _concat(*args: E) -> E:
    tags = {(a.vt.dt, a.vt.lang) for a in args if a.vt.kind == "lit"}
    same = len(tags) == 1 and all(is_text(a.vt) for a in args)
    return E(F.concat(*[text_of(a) for a in args]) if args else F.lit(""), like_first(args[0]) if same else TEXT)


def _moment(e: E) -> Column:
    if e.vt.kind == "poly":
        return F.coalesce(F.when(e.col["dt"] == DATE_TIME, parsed(e.col["lex"], DATE_TIME)), F.when(e.col["dt"] == DATE, parsed(e.col["lex"], DATE).cast("timestamp_ntz")))
    return e.col.cast("timestamp_ntz") if e.vt.dt in (DATE_TIME, DATE) else F.lit(None).cast("timestamp_ntz")


def _part(made: Callable[[Column], Column]) -> Callable[[E], E]:
    return lambda e: E(e.col if e.vt.dt == GYEAR and made is F.year else made(_moment(e)).cast("bigint"), lit(INTEGER))


def _zone(e: E) -> Column:
    """The offset as written; values held natively have none."""
    if e.vt.kind == "poly":
        return F.when(e.col["dt"].isin(DATE_TIME, DATE), F.regexp_extract(e.col["lex"], OFFSET, 1))
    return F.when(e.col.isNotNull(), F.lit("")) if e.vt.dt in (DATE_TIME, DATE) else F.lit(None).cast("string")


def _timezone(e: E) -> E:
    z = _zone(e)
    hours, minutes = F.regexp_extract(z, "([0-9]{2}):", 1).try_cast("int"), F.regexp_extract(z, ":([0-9]{2})", 1).try_cast("int")
    made = F.concat(F.when(z.startswith("-"), F.lit("-PT")).otherwise(F.lit("PT")), F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(F.lit("")), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(F.lit("")))
    return E(F.when(z == "Z", F.lit("PT0S")).when(z != "", F.when(made.endswith("T"), F.lit("PT0S")).otherwise(made)), lit(XSD + "dayTimeDuration"))


def _hash(made: Callable[[Column], Column]) -> Callable[[E], E]:
    return lambda e: E(made(text_of(e).cast("binary")), TEXT)


def _text_test(made: Callable[[Column, Column], Column]) -> Callable[[E, E], E]:
    return lambda a, b: E(_fit(a, b, made(text_of(a), text_of(b))), BOOL)


def _same(a: E, b: E) -> E:
    same = same_term(a, b)
    return E(F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False) if same is None else same), BOOL)


NEEDS_BASE = {"IRI"}
FUNCTIONS: dict[str, Callable[..., E]] = {
    "STR": lambda e: E(F.lit(None).cast("string") if e.vt.kind == "bnode" else F.when(e.col["kind"] != BNODE_KIND, e.col["lex"]) if e.vt.kind == "poly" else lexical(e), TEXT),
    "LANG": _lang,
    "DATATYPE": _datatype,
    "LANGMATCHES": _lang_matches,
    "IRI": _iri,
    "BNODE": _bnode,
    "STRDT": _str_dt,
    "STRLANG": _str_lang,
    "UUID": lambda: E(F.concat(F.lit("urn:uuid:"), F.expr("uuid()")), VT("iri")),
    "STRUUID": lambda: E(F.expr("uuid()"), TEXT),
    "RAND": lambda: E(F.rand(), lit(DOUBLE)),
    "NOW": lambda: E(F.current_timestamp().cast("timestamp_ntz"), lit(DATE_TIME)),
    "STRLEN": lambda e: E(F.char_length(text_of(e)).cast("bigint"), lit(INTEGER)),
    "SUBSTR": _substr,
    "UCASE": lambda e: E(F.upper(text_of(e)), like_first(e)),
    "LCASE": lambda e: E(F.lower(text_of(e)), like_first(e)),
    "STRSTARTS": _text_test(F.startswith),
    "STRENDS": _text_test(F.endswith),
    "CONTAINS": _text_test(F.contains),
    "STRBEFORE": _before,
    "STRAFTER": _after,
    "ENCODE_FOR_URI": _encode,
    "CONCAT": _concat,
    "REGEX": _regex,
    "REPLACE": _replace,
    "ABS": _absolute,
    "ROUND": _round,
    "CEIL": lambda e: _whole(e, F.ceil),
    "FLOOR": lambda e: _whole(e, F.floor),
    "YEAR": _part(F.year),
    "MONTH": _part(F.month),
    "DAY": _part(F.day),
    "HOURS": _part(F.hour),
    "MINUTES": _part(F.minute),
    "SECONDS": lambda e: E((F.second(_moment(e)).cast(DECIMAL_TYPE) + F.date_format(_moment(e), "SSSSSS").cast("int").cast(DECIMAL_TYPE) / F.lit(1000000)).cast(DECIMAL_TYPE), lit(DECIMAL)),
    "TIMEZONE": _timezone,
    "TZ": lambda e: E(_zone(e), TEXT),
    "MD5": _hash(F.md5),
    "SHA1": _hash(F.sha1),
    "SHA256": _hash(lambda x: F.sha2(x, 256)),
    "SHA384": _hash(lambda x: F.sha2(x, 384)),
    "SHA512": _hash(lambda x: F.sha2(x, 512)),
    "ISIRI": _kind_test(IRI_KIND, "iri"),
    "ISBLANK": _kind_test(BNODE_KIND, "bnode"),
    "ISLITERAL": _kind_test(LIT_KIND, "lit"),
    "ISNUMERIC": _is_numeric,
    "SAMETERM": _same,
}


def evaluate(e, lookup: Callable[[str], E | None], exists: Callable[[tuple], Column] | None = None, base: str = "") -> E:
    """An expression of the algebra; lookup gives variables, exists the mark column of a pattern."""
    if isinstance(e, Var):
        found = lookup(e.name)
        return error(TEXT) if found is None else found
    if not isinstance(e, tuple):
        return constant(e)
    kind, go = e[0], lambda x: evaluate(x, lookup, exists, base)
    if kind in ("or", "and"):
        a, b = truth(go(e[1])), truth(go(e[2]))
        return E(a | b if kind == "or" else a & b, BOOL)
    if kind == "not":
        return E(~truth(go(e[1])), BOOL)
    if kind == "cmp":
        return compare(e[1], go(e[2]), go(e[3]))
    if kind == "math":
        return math(e[1], go(e[2]), go(e[3]))
    if kind == "minus":
        x = go(e[1])
        return _math_poly("-", constant(Lit("0", INTEGER)), x) if x.vt.kind == "poly" else E(_negative(x.col, x.vt.dt), x.vt.bound()) if numeric(x.vt) else error(lit(DOUBLE))
    if kind == "in":
        a, out = go(e[1]), F.lit(False)
        for x in e[2]:
            out = out | compare("=", a, go(x)).col
        return E(~out if e[3] else out, BOOL)
    if kind == "cast":
        return cast(e[1], go(e[2]))
    if kind == "exists":
        return E(exists(e), BOOL)
    if kind == "call":
        name, args = e[1], e[2]
        if name == "BOUND":
            found = lookup(args[0].name)
            return E(F.lit(False) if found is None else found.col.isNotNull(), BOOL)
        if name == "IF":
            c, a, b = truth(go(args[0])), go(args[1]), go(args[2])
            vt = common(a.vt, b.vt).bound()
            if numeric(a.vt) and numeric(b.vt) and a.vt.dt != b.vt.dt:
                return E(F.when(c, poly(a)).when(~c, poly(b)), VT("poly"))
            return E(F.when(c, to(a, vt)).when(~c, to(b, vt)), vt)
        if name == "COALESCE":
            parts = [go(x) for x in args if not (isinstance(x, Var) and lookup(x.name) is None)]
            if not parts:
                return error(TEXT)
            vt = parts[0].vt
            for x in parts[1:]:
                vt = common(vt, x.vt)
            return E(F.coalesce(*[to(x, vt) for x in parts]), vt.bound())
        return call(name, [go(x) for x in args], base)
    raise SparqlError(f"no expression {kind}")


