"""Sources and changes of the store: dispatch, folders, older forms, layouts, insertion, forgetting, snapshots."""

import json

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from kestrelgraph.functions import confidence as C
from kestrelgraph.operators import console, frames, store
from kestrelgraph.sources import readers

FACT = "instance string, subject string, relation string, object string, confidence string, source_type string, conditions array<string>, speaker_id string"


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_load_tells_its_source(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps([{"s": "a", "r": "is", "o": "b"}]))
    (tmp_path / "a.txt").write_text("c | has | d\n# no\ne, has, f\n")
    want = {("a", "is", "b"), ("c", "has", "d"), ("e", "has", "f")}
    assert rows(readers.load(spark, str(tmp_path))) == want
    assert [(r.path.rsplit("/", 1)[1], r.loaded) for r in readers.folder_report(spark, str(tmp_path)).collect()] == [("b.json", 1), ("a.txt", 2)]
    assert rows(readers.load(spark, str(tmp_path / "b.json"))) == {("a", "is", "b")}
    assert rows(readers.load(spark, [("a", "is", "b"), ("x", "", "y")])) == {("a", "is", "b")}
    assert rows(readers.load(spark, [{"s": "a", "relation": "is", "o": "b"}, {"s": "q"}])) == {("a", "is", "b")}
    assert rows(readers.load(spark, ["Birds can fly."])) == {("birds", "can", "fly")}
    assert readers.load(spark, []).count() == 0 and readers.load(spark, "nature").count() == 30


def test_documents_and_layouts(spark, tmp_path, monkeypatch):
    (tmp_path / "old.json").write_text(json.dumps({"knowledge": {"dog": {"is": ["mammal", "pet"]}, "cat": {"has": []}}}))
    assert rows(readers.read_legacy(spark, str(tmp_path / "old.json"))) == {("dog", "is", "mammal"), ("dog", "is", "pet")}
    f = spark.createDataFrame([("i", "a", "r", "b", "high", None, ["x"], None), ("j", "c", "r", "d", None, None, None, "ann")], FACT)
    readers.write_document(f, str(tmp_path / "doc"))
    assert sorted(map(str, readers.read_document(spark, str(tmp_path / "doc"), FACT).collect())) == sorted(map(str, f.collect()))
    readers.write_indexed(f, str(tmp_path / "ix"))
    for name in ("by_subject", "by_object"):
        assert readers.read_facts(spark, str(tmp_path / "ix" / name), "j").select("subject").first().subject == "c"
    schema = StructType([StructField("id", LongType()), StructField("message_id", StringType())])
    got = readers.evolved(spark.createDataFrame([(1, "x")], "id int, extra string"), schema)
    assert got.columns == ["id", "message_id", "extra"] and tuple(got.first()) == (1, None, "x")
    monkeypatch.setenv("KESTREL_STORE", '"/data/x" ')
    assert readers.location("KESTREL_STORE", "/y") == "/data/x" and readers.location("KESTREL_NOTHING", "/y") == "/y"


def test_insertion(spark):
    stored = spark.createDataFrame([("i", "dog", "can", "swim", "low", "user", None, None), ("j", "dog", "can", "fly", "high", "user", None, None)], FACT)
    arriving = spark.createDataFrame(
        [("i", "dog", "can", "swim", None, "user", None, None), ("i", "dog", "can", "be_calm", None, "inference", None, None), ("i", "dog", "cannot", "swim", None, "user", None, None), ("i", "it", "can", "run", None, "user", None, None),
         ("i", "dog", "can", "fly", None, "user", ["if asked"], None), (None, "dog", "can", "x", None, None, None, None)], FACT)
    out = store.add_facts(stored, arriving)
    got = {tuple(r) for r in out["outcomes"].select("relation", "object", "outcome", "confidence").collect()}
    assert got == {("can", "swim", "repeated", "high"), ("can_be", "calm", "new", "medium"), ("cannot", "swim", "new", "high"), ("can", "run", "invalid", "high"), ("can", "fly", "new", "low")}
    assert rows(out["conflicts"]) == {("i", "dog", "can", "swim")}
    assert out["facts"].count() == 5 and out["facts"].where("instance = 'i' and relation = 'can' and object = 'swim'").first().agreement_count == 1


def test_forgetting_and_constraints(spark):
    f = spark.createDataFrame([("i", "a", "r", "b", None, None, ["x"], " Ann"), ("i", "c", "r", "a", None, None, None, None), ("j", "a", "r", "b", None, None, None, "bob")], FACT)
    assert {r.subject for r in store.forget(f, speaker="ann").collect()} == {"c", "a"} and store.forget(f, speaker="ann").count() == 2
    assert store.forget(f, entity="a").count() == 1 and store.forget(f, entity="a", instance="j").count() == 2 and store.forget(f).count() == 0
    more = spark.createDataFrame([("i", "a", "r", "b", "y"), ("i", "a", "r", "b", "x"), ("i", "c", "r", "a", "z")], "instance string, subject string, relation string, object string, condition string")
    assert {(r.instance, r.subject, tuple(r.conditions)) for r in store.constrained(f, more).collect()} == {("i", "a", ("x", "y")), ("i", "c", ("z",)), ("j", "a", ())}


def test_frame_snapshots(spark, tmp_path):
    s = spark.createDataFrame([("a", "color", "red", True), ("a", "color", "blue", False), ("b", "size", "big", True)], "concept string, attribute string, value string, confirmed boolean")
    frames.save(s, str(tmp_path / "f"))
    assert rows(frames.load(spark, str(tmp_path / "f"))) == rows(s)
    (tmp_path / "old.json").write_text('{"concept": "c", "attribute": "diet", "values": ["fish"]}\n')
    assert rows(frames.load(spark, str(tmp_path / "old.json"))) == {("c", "diet", "fish", True)}
    assert {tuple(r) for r in frames.described(s).collect()} == {("a", "color: red, blue?"), ("b", "size: big")}
    similar = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.8), ("b", "c", 0.5)], "a string, b string, similarity double")
    known = spark.createDataFrame([("c", "similar_to", "a")], "s string, r string, o string")
    assert {tuple(r)[:3] for r in frames.written_back(similar, known).collect()} == {("a", "similar_to", "b"), ("b", "similar_to", "a")}


def test_spoken_facts(spark):
    segments = spark.createDataFrame([("t", 0, "Dogs have tails.", 0.95, "ann"), ("t", 1, "Cats can climb.", 0.75, "bob"), ("t", 2, "Hm.", 0.1, None)], "transcript_id string, idx int, text string, confidence double, speaker_id string")
    got = {(r.at, r.subject, r.relation, r.object, r.speaker_id, r.confidence) for r in readers.spoken_facts(segments).collect()}
    assert got == {(0, "dogs", "has", "tails", "ann", "high"), (1, "cats", "can", "climb", "bob", "medium")}


def test_scratch_tables_go_with_their_space(spark):
    import os

    from kestrelgraph import runtime

    with runtime.scratch_space(spark):
        df = runtime.materialize(spark.range(5).toDF("i"))
        path = df.inputFiles()[0].removeprefix("file://")
        assert df.count() == 5 and os.path.exists(path)
    assert not os.path.exists(path)


def test_console_views(spark):
    rows_ = [("dog", "is", "mammal"), ("mammal", "is", "animal"), ("cat", "is", "mammal"), ("dog", "can", "swim"), ("dog", "cannot", "swim"), ("dog", "color", "brown")]
    f = spark.createDataFrame([("i", *r, "high", "user", None, "ann") for r in rows_], FACT)
    view = lambda text: {tuple(r) for r in console.run(f, text).collect()}
    assert view("/stats") == {("i", 6, 6, 0, 1)}
    assert view("/show dog") == {("i", "dog", "dog\n  can: swim\n  cannot: swim\n  color: brown\n  is: mammal")}
    assert {r[1:5] for r in view("/inferences")} == {("dog", "is", "animal", 2), ("cat", "is", "animal", 2)}
    assert view("/conflicts") == {("i", "dog", "can", "swim")} and view("/frame Dog") == {("dog", "abilities: swim; cannot: swim; color: brown")}
    assert view("/clusters") == {("mammal", 2, 0.4)} and len(view("/entities")) == 6 and len(view("/forget dog")) == 2 and view("/forget-all") == set()
    assert ("stats", True) in view("/help") and {r[3] for r in view("/chain dog")} == {"mammal", "animal", "swim", "brown"}
    with pytest.raises(ValueError):
        console.run(f, "stats")


def test_frame_cycle_and_provenance(spark):
    f = spark.createDataFrame([(x, "has", y, "high") for x in "ab" for y in ("fur", "tail", "legs")] + [("c", "has", "fins", "low")], "s string, r string, o string, confidence string")
    out = frames.cycle(f, spark.createDataFrame([("k", "a"), ("k", "b"), ("m", "a")], "category string, member string"))
    assert {tuple(r) for r in out["similarity"].collect()} == {("a", "b", 0.85)} and out["written"].count() == 2
    assert {tuple(r)[:2] for r in out["offered"].collect()} == {("b", "m")} and out["prototypes"].where("category = 'k'").count() == 3
    p = spark.range(1).select(C.provenance("inference").alias("p"), C.provenance("speech").alias("q")).first()
    assert (p.p.source_type, p.p.confidence, p.p.premises, p.q.confidence) == ("inference", "medium", [], "low")
