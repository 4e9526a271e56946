from tessera.streaming.quads import stream_quads


def test_quads_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.nt").write_text("<http://e/a> <http://e/p> <http://e/b> .\n<http://e/a> <http://e/p> <http://e/b> .\n<http://e/a> <http://e/p> 'bad .\n")
    (tmp_path / "in" / "b.nq").write_text('<http://e/a> <http://e/p> "x"@EN <http://e/g2> .\n')
    q = stream_quads(spark, f"file://{tmp_path}/in", "http://e/g").writeStream.format("memory").queryName("quads").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["o_lex"], r["o_lang"], r["g"]) for r in spark.table("quads").collect()) == [("http://e/b", None, "http://e/g"), ("x", "en", "http://e/g2")]
