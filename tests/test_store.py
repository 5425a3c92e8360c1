from quillspark.sources import store


def test_upsert_delete_and_ids(spark, tmp_path):
    writers = spark.createDataFrame([("S-1001", "Ada", None), ("S-1042", "Bo", "n")], "writer_id string, display_name string, notes string")
    new = spark.createDataFrame([("S-1001", None, "x"), ("S-1043", "Cy", None)], "writer_id string, display_name string, notes string")
    up = store.upserted(writers, new, "writer_id")
    assert sorted(map(tuple, up.collect())) == [("S-1001", "Ada", "x"), ("S-1042", "Bo", "n"), ("S-1043", "Cy", None)]
    assert store.next_writer_id(up).first()[0] == "S-1044" and store.next_writer_id(up.limit(0)).first()[0] == "S-1001"
    samples = spark.createDataFrame([("a", "S-1001"), ("b", "S-1042")], "sample_id string, writer_id string")
    notes = spark.createDataFrame([("a", "1"), ("b", "2")], "sample_id string, note string")
    left = store.without_writer({"writers": up, "samples": samples, "notes": notes}, "S-1001")
    assert left["samples"].count() == 1 and left["notes"].first().note == "2" and left["writers"].count() == 2
    names = spark.createDataFrame([(" ada",), ("s-1042",), ("nobody",)], "name string")
    assert {r.name: r.writer_id for r in store.matched_writer(names, up).collect()} == {" ada": "S-1001", "s-1042": "S-1042", "nobody": None}
    store.bundled({"samples": samples}, str(tmp_path / "b"))
    back = store.unbundled(spark, str(tmp_path / "b"), {"samples": "sample_id string, writer_id string"}, {"samples": samples.where("sample_id = 'b'")}, {"samples": ["sample_id"]})
    assert sorted(map(tuple, back["samples"].collect())) == [("a", "S-1001"), ("b", "S-1042")]


def test_sealed_and_stored(spark):
    df = spark.createDataFrame([("secret",), (None,)], "text string")
    shut = store.sealed(df, "text", "'0123456789abcdef'")
    assert shut.first().text != "secret" and [r.text for r in store.opened(shut, "text", "'0123456789abcdef'").collect()] == ["secret", None]
    assert store.stored(df, "t").count() == 2
