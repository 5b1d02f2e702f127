import json

from pyspark.sql import functions as F

from scansio.operators import nested

DIAG = "diag_id long, events array<struct<ts_ms:bigint,event_type:string,data:string>>, extra string, v string"
PAGE = "page_id long, edition string, page int, lines array<struct<line:int,line_type:string,text:string,surah:string,verse_range:string,qpc_v1:string,words:array<struct<location:string,word:string,qpc_v1:string>>>>, label string"


def diag(spark, *datas, key=1):
    return spark.createDataFrame([(key, [None if d is None else (1, "X", d) for d in datas], "e", "v")], DIAG)


def found(df):
    return sorted((r.child, r.root_id, r.outer_pos, r.inner_pos, r.verse_ref) for r in nested.occurrences(nested.event_store(df)).collect())


def test_ways_of_writing_a_reference(spark):
    c = [
        {"surah": 1, "ayah": 2}, {"surah": "3", "ayah": "٤"}, {"ref": "5:6"}, {"ref": {"surah": 7, "ayah": 8}}, {"Surah": 9, "Ayah": 10},
        {"surah": 1, "ayah": None}, {"surah": 1}, {}, None, 5, "x", {"ref": "5"}, {"surah": 2.0, "ayah": 3}, {"surah": "a", "ayah": 1},
    ]
    got = found(diag(spark, json.dumps({"candidates": c})))
    want = {0: "1:2", 1: "3:4", 2: "5:6", 3: "7:8", 4: "9:10", 5: "", 6: "", 7: "", 11: "", 12: "2:3", 13: ""}
    assert got == [("candidate", 1, 0, i, r) for i, r in want.items()]


def test_wrapped_and_broken_data(spark):
    x = json.dumps({"candidates": [{"surah": 1, "ayah": 2}]})
    wrapped = [json.dumps(x), json.dumps({"v": 2, "payload": json.loads(x)}), json.dumps(json.dumps(json.dumps({"payload": x})))]
    got = found(diag(spark, x, None, "", " ", x[:-4], x + " y", x + "," + x, "[1]", "null", *wrapped))
    assert got == [("candidate", 1, i, 0, "1:2") for i in (0, 9, 10, 11)]


def test_identical_objects_are_stored_once(spark):
    a, b = '{"candidates":[{"surah":1,"ayah":2},{"ayah":"2","surah":"1"}]}', '{ "candidates" : [ {"ayah":2, "surah":1} ] }'
    objects = {r.kind: r for r in nested.event_store(diag(spark, a, a, b)).objects.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("occurrences").alias("o")).collect()}
    assert (objects["candidate"].n, objects["candidate"].o) == (1, 5)
    assert (objects["event"].n, objects["event"].o) == (2, 3)


def test_unknown_fields_make_another_object(spark):
    s = nested.event_store(diag(spark, '{"candidates":[{"surah":1,"ayah":2},{"surah":1,"ayah":2,"new":{"a":[1]}}]}'))
    contents = [r.content for r in s.objects.where("kind = 'candidate'").collect()]
    assert len(contents) == 2 and any("new" in c for c in contents)


def test_layouts(spark):
    w = ("1:1:1", "w", None)
    line = (1, "text", None, None, None, None, [w, None, (None, None, None)])
    rows = [(1, "e", 1, [None, line, line], "x"), (1, "e", 1, [None, line, line], "x"), (2, "e", 2, None, "x"), (3, "e", 3, [], "x"), (None, "e", 4, [line], "x"), (4, "e", 5, [(1, None, None, None, None, None, None)], "x")]
    pages = spark.createDataFrame(rows, PAGE)
    got = sorted((r.root_id, r.outer_pos, r.inner_pos, r.verse_ref) for r in nested.occurrences(nested.layout_store(pages)).collect())
    assert got == [(1, 1, 0, "1:1:1"), (1, 1, 2, ""), (1, 2, 0, "1:1:1"), (1, 2, 2, "")]
    assert {r.page_id: r.n_lines for r in nested.pages_table(pages).collect()} == {1: 3, 2: None, 3: 0, 4: 1}
    assert nested.lines_table(pages).count() == 3 and nested.words_table(pages).count() == 4
    assert nested.layout_store(pages).objects.count() == 2 + 2


def test_empty_tables(spark):
    assert nested.all_occurrences(spark.createDataFrame([], PAGE), spark.createDataFrame([], DIAG)).count() == 0
    assert nested.events_table(spark.createDataFrame([], DIAG)).count() == 0


def test_data_of_events_is_flat(spark):
    datas = [
        json.dumps({"surah": 2, "ayah": "٣", "word_index": 4, "total_words": 9, "confidence": 0.5, "matched_indices": [0, None, 2, 2], "kept": [1]}),
        json.dumps(json.dumps({"payload": {"Ref": "5:6", "transcript": "a b", "text": "c", "confidence": "0.25"}})),
        "broken",
        None,
        "[1]",
        json.dumps({"matched_indices": [], "candidates": [{"surah": 1, "ayah": 1}]}),
    ]
    got = {r.outer_pos: r for r in nested.event_fields_table(diag(spark, *datas)).collect()}
    assert sorted(got) == [0, 1, 2, 4, 5]
    assert tuple(got[0])[2:] == (2, 3, 4, 9, 0.5, None, None, 4, '{"kept":[1]}')
    assert tuple(got[1])[2:] == (5, 6, None, None, 0.25, "a b", "c", None, None)
    assert tuple(got[5])[2:] == (None,) * 7 + (0, None) and set(tuple(got[2])[2:]) == set(tuple(got[4])[2:]) == {None}
    rows = sorted((r.outer_pos, r.inner_pos, r.word) for r in nested.indices_table(diag(spark, *datas)).collect())
    assert rows == [(0, 0, 0), (0, 1, None), (0, 2, 2), (0, 3, 2)]


def test_stores_join_back_to_their_records(spark, sf):
    from scansio.plans import nested_queries as nq

    q = {n: f(spark, sf) for n, f in nq.QUERIES.items() if n in ("p3_event_roots", "p3_event_bridge", "p3_layout_roots", "p3_layout_bridge", "p3_store", "p3_found", "p3_events")}
    n = q["p3_event_roots"].join(q["p3_store"].where("kind = 'event'"), F.col("child_id") == F.col("object_id")).count()
    assert n == q["p3_events"].count() > 0
    linked = sum(q[f"p3_{k}_roots"].select(F.col("child_id").alias("parent_id")).join(q[f"p3_{k}_bridge"].where("child_id IS NOT NULL"), "parent_id").count() for k in ("event", "layout"))
    assert linked == q["p3_found"].count() > 0


def test_layers_of_any_number_are_taken_off(spark):
    x = {"candidates": [{"surah": 1, "ayah": 2}]}
    texts = [json.dumps(x)]
    for _ in range(7):
        texts.append(json.dumps(texts[-1]))
    deep, mixed = x, json.dumps(x)
    for i in range(12):
        deep = {"v": i, ("payload" if i % 2 else "Payload"): deep}
    for _ in range(4):
        mixed = json.dumps({"payload": mixed})
    got = found(diag(spark, *texts, json.dumps(deep), mixed))
    assert got == [("candidate", 1, i, 0, "1:2") for i in range(10)]


def test_names_in_any_case(spark):
    got = found(diag(spark, '{"cAndidates":[{"sURAH":1,"AyaH":2},{"REF":{"Surah":3,"aYah":4}},{"rEf":"5:6"}]}'))
    assert [r[-1] for r in got] == ["1:2", "3:4", "5:6"]


def test_what_a_child_holds_stands_in_the_child_only(spark):
    data = '{"candidates":[{"surah":1,"ayah":2,"score":0.125}],"transcript":"said","device":{"model":"m7","os":{"v":3}},"n":[1]}'
    objects = {r.kind: r.content for r in nested.event_store(diag(spark, data)).objects.collect()}
    assert set(objects) == {"event", "candidate", "part"}
    assert "0.125" not in objects["event"] and "m7" not in objects["event"] and "said" in objects["event"]
    assert "0.125" in objects["candidate"] and "m7" in objects["part"] and '"device"' in objects["part"]
    a, b = (nested.event_store(diag(spark, data.replace("0.125", x))).roots.collect()[0].child_id for x in ("0.125", "0.25"))
    assert a != b  # the parent is known by its children's identities


def test_deliveries_that_differ_are_one_record(spark):
    line = lambda w: (1, "text", None, None, None, None, [(f"1:1:{i}", w, None) for i in range(3)])
    rows = [(1, "e", 1, [line("a"), line("b")], "x"), (1, "e", 1, [line("c")], "x"), (1, "e", 1, [line("c")], "x")]
    store = nested.layout_store(spark.createDataFrame(rows, PAGE))
    n = nested.occurrences(store).count()
    assert n in (3, 6) and store.roots.count() == n // 3
    assert store.objects.where("kind = 'word'").agg(F.sum("occurrences")).first()[0] == n


def test_a_common_node_has_its_places(spark):
    pages = spark.range(3000).selectExpr("id AS page_id", "'e' AS edition", "1 AS page", "array(named_struct('line',1,'line_type','t','text',null,'surah',null,'verse_range',null,'qpc_v1',null,'words',array(named_struct('location','1:1:1','word','w','qpc_v1',null)))) AS lines", "'x' AS label")
    pages = spark.createDataFrame(pages.rdd, PAGE)
    store = nested.layout_store(pages)
    assert nested.occurrences(store).count() == 3000 and store.linked.count() == 1
