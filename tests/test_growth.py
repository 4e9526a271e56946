"""Steps whose cost must not grow faster than their input."""

import json

import tessera.loaded_queries as loaded
import tessera.plans.compiler as compiler
import tessera.sources.loader as loader
from tessera.queries import PREFIXES, QUERIES
from tessera.store import QuadStore


def test_joins_by_key_come_before_products(spark, monkeypatch):
    shared = []

    def noted(a, b, *args, made=compiler.join):
        shared.append(set(a.vt) & set(b.vt))
        return made(a, b, *args)

    monkeypatch.setattr(compiler, "join", noted)
    QuadStore.tables(spark, "/root/testdata/sf0.01").sparql(PREFIXES + QUERIES["join_two_shared"][0])
    assert len(shared) == 3 and {"n"} not in shared  # suppliers and customers of one nation


def test_triples_after_an_optional_are_joined_with_each_other_first(spark, monkeypatch):
    made, shared = compiler.join, []

    def noted(a, b, *args):
        shared.append((set(a.vt) & set(b.vt), args[:1]))
        return made(a, b, *args)

    monkeypatch.setattr(compiler, "join", noted)
    df = QuadStore.tables(spark, "/root/testdata/sf0.01").sparql(PREFIXES + QUERIES["optional_then_join"][0])
    assert all("d" in names for names, _ in shared) and any(how == ("left",) for _, how in shared)  # of one quality are half of all
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()


def test_lines_of_one_file_stay_in_their_splits(spark, tmp_path):
    (tmp_path / "a.nq").write_text("<http://e/a> <http://e/p> <http://e/b> .\n")
    df = loader.read_quads(spark, [(str(tmp_path / "a.nq"), "http://e/g")])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the lines were many
    try:
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan  # by file, these take all its lines to one task
    assert [r["g"] for r in df.collect()] == ["http://e/g"]


def test_buckets_hold_a_bounded_number_of_quads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(loaded, "_stores", {})
    monkeypatch.setattr(loader, "BUCKET_QUADS", 1000)
    store = loaded.customers(spark, "/root/testdata/sf0.01")
    buckets = json.loads("".join(r["value"] for r in spark.read.text(f"{next(iter(loaded._stores.values()))}/catalog").collect()))["buckets"]
    assert buckets >= -(-store.size() // 1000) > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_values_that_are_only_counted_are_not_made(spark):
    store = QuadStore.tables(spark, "/root/testdata/sf0.001")
    df = store.sparql("SELECT ?p (COUNT(*) AS ?c) WHERE { ?s ?p ?o } GROUP BY ?p")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "date_format" not in plan and "kind," not in plan and "concat_ws" not in plan
    wanted = {r["p"]: r["c"] for r in df.collect()}
    assert {r["p"]: r["c"] for r in store.sparql("SELECT ?p (COUNT(?o) AS ?c) WHERE { ?s ?p ?o } GROUP BY ?p").collect()} == wanted
    assert {r["p"]: r["c"] for r in store.sparql("SELECT ?p (COUNT(?s) AS ?c) WHERE { ?s ?p ?o } GROUP BY ?p").collect()} == wanted
    assert len(store.sparql("SELECT DISTINCT ?p WHERE { ?s ?p ?o }").collect()) == len(wanted)
    few = "FROM <http://ex.org/g/nation> FROM <http://ex.org/g/region>"
    assert sum(r["c"] for r in store.sparql(f"SELECT ?p (COUNT(DISTINCT *) AS ?c) {few} WHERE {{ ?s ?p ?o }} GROUP BY ?p").collect()) == store.sparql(f"SELECT ?s ?p ?o {few} WHERE {{ ?s ?p ?o }}").count()
