"""Random queries on a small random graph against a naive evaluator of the algebra."""

import random
from collections import Counter

import pytest

from tessera.sparql.parser import parse, variables
from tessera.store import QuadStore
from tessera.terms import Iri, Lit, Var

E = "http://e/"


def graph(rng):
    nodes = [Iri(f"{E}n{i}") for i in range(5)]
    values = nodes + [Lit("a"), Lit("b"), Lit("1", "http://www.w3.org/2001/XMLSchema#int"), Lit("2", "http://www.w3.org/2001/XMLSchema#int")]
    return {(rng.choice(nodes), Iri(f"{E}p{rng.randrange(3)}"), rng.choice(values)) for _ in range(22)}


def merge(a, b):
    return None if any(a[k] != b[k] for k in a if k in b) else {**a, **b}


def naive(p, data):
    kind = p[0]
    if kind == "bgp":
        out = [{}]
        for t in p[1]:
            found = []
            for m in out:
                for q in data:
                    n = dict(m)
                    for x, y in zip(t, q):
                        if isinstance(x, Var):
                            if n.setdefault(x.name, y) != y:
                                break
                        elif x != y:
                            break
                    else:
                        found.append(n)
            out = found
        return out
    if kind == "join":
        return [m for a in naive(p[1], data) for b in naive(p[2], data) if (m := merge(a, b)) is not None]
    if kind == "union":
        return naive(p[1], data) + naive(p[2], data)
    if kind == "minus":
        right = naive(p[2], data)
        return [a for a in naive(p[1], data) if not any(set(a) & set(b) and merge(a, b) is not None for b in right)]
    if kind == "left":
        out, right = [], naive(p[2], data)
        for a in naive(p[1], data):
            fit = [m for b in right if (m := merge(a, b)) is not None and (p[3] is None or test(p[3], m, data) is True)]
            out += fit or [a]
        return out
    if kind == "filter":
        return [m for m in naive(p[2], data) if test(p[1], m, data) is True]
    if kind == "path":
        s, path, o = p[1:]
        pairs = closure(path, data)
        out = []
        for a, b in pairs:
            m = {}
            if all((x == y) if not isinstance(x, Var) else m.setdefault(x.name, y) == y for x, y in ((s, a), (o, b))):
                out.append(m)
        return out
    raise NotImplementedError(kind)


def closure(path, data):
    nodes = {x for s, _, o in data for x in (s, o)}
    if isinstance(path, Iri):
        return [(s, o) for s, p, o in data if p == path]
    kind = path[0]
    if kind == "seq":
        return [(a, d) for a, b in closure(path[1], data) for c, d in closure(path[2], data) if b == c]
    if kind == "inv":
        return [(b, a) for a, b in closure(path[1], data)]
    if kind == "alt":
        return closure(path[1], data) + closure(path[2], data)
    step = set(closure(path[1], data))
    found = set(step)
    while kind != "opt" and (more := {(a, d) for a, b in found for c, d in step if b == c} - found):
        found |= more
    return list(found | ({(n, n) for n in nodes} if kind in ("star", "opt") else set()))


def test(e, m, data):
    """True, False or None for an error."""
    if e[0] == "exists":
        inner = e[1]
        found = any(merge(m, b) is not None for b in naive(inner, data))
        return found != e[2]
    if e[0] == "not":
        v = test(e[1], m, data)
        return None if v is None else not v
    if e[0] in ("or", "and"):
        a, b, top = test(e[1], m, data), test(e[2], m, data), e[0] == "or"
        return top if top in (a, b) else None if None in (a, b) else not top
    if e[0] == "call" and e[1] == "BOUND":
        return e[2][0].name in m
    if e[0] == "call" and e[1] == "ISIRI":
        return isinstance(m[e[2][0].name], Iri) if e[2][0].name in m else None
    _, op, a, b = e
    x, y = (m.get(v.name) if isinstance(v, Var) else v for v in (a, b))
    if x is None or y is None:
        return None
    if isinstance(x, Lit) and isinstance(y, Lit) and x.dt != y.dt:
        return None  # numbers and texts: an error
    return (x == y) == (op == "=")


test.__test__ = False


def query(rng):
    var = lambda: "?" + rng.choice("xyz")
    term = lambda: rng.choice([var(), var(), f"<{E}n{rng.randrange(5)}>"])
    verb = lambda: rng.choice([f"<{E}p{rng.randrange(3)}>"] * 4 + ["?q"])

    def path():
        p = f"<{E}p{rng.randrange(3)}>"
        return rng.choice([f"{p}+", f"{p}*", f"{p}?", f"^{p}/{p}", f"{p}|<{E}p0>", f"({p}/<{E}p1>)+"])

    def triple():
        return f"{term()} {path() if rng.random() < 0.15 else verb()} {term()} ."

    def condition():
        return rng.choice([f"{var()} = {term()}", f"{var()} != {term()}", f"BOUND({var()})", f"!BOUND({var()}) || {var()} = {var()}", f"isIRI({var()})"])

    def group(depth):
        out = [triple() for _ in range(rng.randrange(1, 3))]
        for _ in range(rng.randrange(0, 3) if depth else 0):
            out.append(rng.choice([f"OPTIONAL {{ {group(depth - 1)} }}", f"{{ {group(0)} }} UNION {{ {group(0)} }}", f"MINUS {{ {triple()} }}", f"FILTER({condition()})", f"FILTER {rng.choice(['', 'NOT '])}EXISTS {{ {triple()} }}"]))
        return " ".join(out)

    return f"SELECT ?x ?y ?z ?q WHERE {{ {group(2)} }}"


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    from tessera.sources.loader import load_quads
    from tessera.terms import n_triples

    data = graph(random.Random(11))
    folder = tmp_path_factory.mktemp("random")
    (folder / "a.nt").write_text("".join(f"{n_triples(s)} {n_triples(p)} {n_triples(o)} .\n" for s, p, o in data))
    return QuadStore.open(spark, load_quads(spark, [(str(folder / "a.nt"), E + "g")], f"file://{folder}/store")), data


@pytest.mark.parametrize("seed", range(30))
def test_random_query(loaded, seed):
    store, data = loaded
    text = query(random.Random(seed))
    q = parse(text)
    names = [v.name for v, _ in q.items]
    show = lambda t: None if t is None else t.value if isinstance(t, Iri) else t.lex
    wanted = Counter(tuple(show(m.get(n)) for n in names) for m in naive(q.where, sorted(data, key=str)))
    got = Counter(tuple(None if x is None else str(x) for x in r) for r in store.sparql(text).collect())
    assert got == wanted, text
    assert set(variables(q.where)) <= {"x", "y", "z", "q"} | {v for v in variables(q.where) if v.startswith("__")}
