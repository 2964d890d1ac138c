"""Ranking traps, merges, sources and streams on small literal frames."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph as gr
from tessera.operators import merging as mg
from tessera.operators import ranking as rk
from tessera.operators import retrieval as rt
from tessera.sources import files
from tessera.streaming import events as ev

HIT = "query_id string, list_no int, backend string, rank int, score double, source_id string, doc_type string, text string"


def test_fusion_ties_rounding_and_keys(spark):
    rows = [
        ("q", 0, "v", 1, 0.9, "b", "law", "B"), ("q", 0, "v", 1, 0.9, "z", "law", "Z"), ("q", 0, "v", 0, 0.1, "dropped", "law", ""), ("q", 0, "v", 5, 0.2, "b", "law", "late"),
        ("q", 1, "k", 1, 9.0, "a", "prec", "A"), ("q", 1, "k", 2, 8.0, "", "prec", "Same"), ("q", 0, "v", 3, 0.3, "", "law", "Same"),
    ]
    out = rk.fuse(spark.createDataFrame(rows, HIT), 60, 10).orderBy("rank").collect()
    assert [(r["rank"], r.source_id, r.score) for r in out] == [(1, "", 0.032002), (2, "a", 0.016393), (3, "b", 0.016393), (4, "z", 0.016393)]
    assert out[0].n_backends == 2 and out[0].text == "Same" and out[0].doc_type == "law"
    hits = spark.createDataFrame(rows, HIT)
    assert rk.fuse_or_pass(hits, 1, top=1).count() == len(rows)  # one list is not cut


def test_two_fallback_keys(spark):
    df = spark.createDataFrame([("", "A  b"), ("", "a B"), ("x", "A  b"), (None, None)], "source_id string, text string")
    raw = [r[0] for r in df.select(rk.raw_text_key()).collect()]
    plain = [r[0] for r in df.select(rk.plain_text_key()).collect()]
    assert raw[0] != raw[1] and plain[0] == plain[1] and raw[2] == plain[2] == "x"


@pytest.mark.parametrize(
    ("types", "enforce", "minimum", "status", "kept"),
    [
        ("lpp pl", True, 1, "ok", {0, 1, 2}),
        ("ppp pl", True, 1, "supplemented", {0, 1, 4}),
        ("ppp pp", True, 1, "missing", {0, 1, 2}),
        ("ppp pl", False, 1, "case_only", {0, 1, 2}),
        ("lpp pp", False, 2, "missing", {0, 1, 2}),
        ("ppp ll", True, 0, "ok", {0, 1, 2}),
        ("lll ll", True, 5, "missing", {0, 1, 2}),
    ],
)
def test_policy(spark, types, enforce, minimum, status, kept):
    rows = [("q", str(i), i + 1, 1.0 - i / 10, "law" if c == "l" else "prec", "") for i, c in enumerate(types.replace(" ", ""))]
    out = rk.select_with_policy(spark.createDataFrame(rows, "query_id string, source_id string, rank int, score double, doc_type string, text string"), 3, minimum, enforce).collect()
    assert {int(r.source_id) for r in out} == kept and {r.status for r in out} == {status}
    assert sorted(r["rank"] for r in out) == [1, 2, 3] and {r.added for r in out} == {status in ("ok", "supplemented")}


def test_boost_is_for_normative_only(spark):
    rows = [("n", "a", 1, 0.5, "prec", "normative"), ("n", "b", 2, 0.498, "law", "normative"), ("c", "a", 1, 0.5, "prec", "case_law"), ("c", "b", 2, 0.498, "law", "case_law")]
    out = {(r.query_id, r.source_id): r["rank"] for r in rk.boost_law(spark.createDataFrame(rows, "query_id string, source_id string, rank int, score double, doc_type string, intent string")).collect()}
    assert out == {("n", "b"): 1, ("n", "a"): 2, ("c", "a"): 1, ("c", "b"): 2}


def test_filters(spark):
    df = spark.createDataFrame([("law", "A", None), ("law", "B", ["A"]), ("law", None, None), ("prec", "A", ["A"])], "doc_type string, law_name string, related array<string>")
    keep = lambda *a: df.where(rt.match_filter(*a, ["law_name"], ["related"])).count()
    assert (keep(["law"], ["A"]), keep(None, ["A"]), keep(["law"], None), keep([], [])) == (2, 3, 3, 4)


def test_vector_search_is_exact(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    m = rng.normal(size=(60, 8))
    corpus = spark.createDataFrame([(str(i), m[i].tolist()) for i in range(60)] + [("zero", [0.0] * 8)], "source_id string, vector array<double>")
    out = rt.vector_top(corpus, spark.createDataFrame([("q", m[3].tolist())], "query_id string, vector array<double>"), 5).orderBy("rank").collect()
    cos = m @ m[3] / (np.linalg.norm(m, axis=1) * np.linalg.norm(m[3]))
    assert [r.source_id for r in out] == [str(i) for i in np.argsort(-cos)[:5]] and abs(out[0].score - 1) < 1e-9


def test_snapshot_diff_and_patch(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, v string")
    new = spark.createDataFrame([(1, "a"), (3, "c"), (4, None)], "id int, v string")
    patch = mg.snapshot_diff(old, new, "id")
    assert sorted((r.id, r.op) for r in patch.collect()) == [(2, "delete"), (3, "update"), (4, "insert")]
    assert sorted(map(str, mg.apply_patch(old, patch, "id").collect())) == sorted(map(str, new.collect()))
    assert mg.snapshot_diff(new, new, "id").count() == 0


def test_unique_resolution_does_not_multiply(spark):
    refs = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (4, None)], "r int, k string")
    targets = spark.createDataFrame([(10, "x"), (11, "y"), (12, "y")], "t int, k string")
    assert [(r.r, r.t) for r in mg.resolve_unique(refs, targets, ["k"], "r", "t").collect()] == [(1, 10)]
    audit = {r.r: (r.n, r.status, r.targets) for r in mg.resolution_audit(refs, targets, ["k"], "r", "t").collect()}
    assert audit == {1: (1, "resolved", "10"), 2: (2, "ambiguous", "11,12"), 3: (0, "unresolved_external", ""), 4: (0, "unresolved_external", "")}


def test_descendants_end_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    out = {(r.id, r.depth) for r in gr.descendants(edges, spark.createDataFrame([("a",)], "root string"), 6).collect()}
    assert out == {("b", 1), ("c", 2), ("a", 3), ("d", 3)}


def test_merge_views(spark):
    known = spark.createDataFrame([("a", 0)], "id string, hop int")
    more = spark.createDataFrame([("a",), ("b",), ("b",)], "id string")
    assert sorted((r.id, r.hop) for r in gr.merge_views(known, more, ["id"], 0).collect()) == [("a", 0), ("b", 1)]


def test_sources_and_sinks(spark, tmp_path):
    schema = spark.sql("SELECT 1 AS a, 'x' AS b").schema
    assert files.json_lines(spark, str(tmp_path / "missing"), schema).count() == 0
    (tmp_path / "x.jsonl").write_text('{"a": 1, "b": "p"}\n\n{"a": 2, "extra": 3}\n')
    assert sorted(r.a for r in files.json_lines(spark, str(tmp_path / "x.jsonl"), schema).collect()) == [1, 2]
    (tmp_path / "bad.jsonl").write_text("not json\n")
    with pytest.raises(Exception, match=r"(?i)malformed|parse"):
        files.json_lines(spark, str(tmp_path / "bad.jsonl"), schema).collect()
    (tmp_path / "tree" / "Some_Law").mkdir(parents=True)
    (tmp_path / "tree" / "Some_Law" / "a__parsed_law.json").write_text('{\n"a": 7}')
    (tmp_path / "tree" / "Some_Law" / "other.json").write_text('{"a": 8}')
    assert [(r.a, r.root_name) for r in files.tree(spark, str(tmp_path / "tree"), "*__parsed_law.json", schema).collect()] == [(7, "Some Law")]
    (tmp_path / "gold.csv").write_text('query,intent\n" q1 ",\n,x\n"a, b",c\n')
    assert sorted(map(tuple, files.gold_set(spark, str(tmp_path / "gold.csv"), ["query", "intent", "notes"]).collect())) == [("a, b", "c", ""), ("q1", "", "")]
    rows = spark.createDataFrame([(1, "p"), (2, None)], "id int, kind string")
    manifest = files.write_datasets({"one": rows, "two": rows.limit(1)}, str(tmp_path / "out"), spark)
    assert sorted(map(tuple, manifest.collect())) == [("one", 2), ("two", 1)]
    files.write_bulk(files.bulk_lines(rows, "i", "id", ["kind"]), "id", str(tmp_path / "bulk"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "bulk")).collect()]
    assert len(lines) == 4 and sum('"_id":"1"' in x for x in lines) == 1
    with pytest.raises(Exception, match="not 3 values"):
        files.checked_vectors(spark.createDataFrame([(1, [1.0])], "id int, v array<double>"), "id", "v", 3).collect()


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i % 50:02}:00", i % 3, "ab"[i % 2], float(i)) for i in range(200)]
    batch = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    batch.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = lambda: ev.read_stream(spark, str(tmp_path / "in"), batch)
    key = lambda df: sorted(map(str, df.collect()))
    got = ev.run_all(ev.tumbling(stream(), "10 minutes", late="2 hours"), "tumbled", str(tmp_path / "c1"), "complete")
    assert key(got) == key(ev.tumbling(batch, "10 minutes"))
    twice = ev.read_stream(spark, str(tmp_path / "in"), batch).unionAll(stream())
    assert ev.run_all(ev.once(twice, "event_id", "2 hours"), "seen", str(tmp_path / "c2")).count() == 200


def test_job_states_stream(spark, tmp_path):
    rows = [("r1", 1, "queued"), ("r1", 2, "completed"), ("r1", 3, "running"), ("r1", 4, "completed"), ("r1", 5, "failed"), ("r2", 1, "running"), ("r2", 2, "queued")]
    batch = spark.createDataFrame(rows, "review_id string, seq long, asked string")
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = ev.run_all(ev.job_states(ev.read_stream(spark, str(tmp_path / "in"), batch)), "states", str(tmp_path / "c"))
    got = {(r.review_id, r.seq): (r.state, r.allowed) for r in out.collect()}
    assert got == {("r1", 1): ("queued", True), ("r1", 2): ("queued", False), ("r1", 3): ("running", True), ("r1", 4): ("completed", True), ("r1", 5): ("completed", False), ("r2", 1): (None, False), ("r2", 2): ("queued", True)}


def test_patch_stream(spark, tmp_path):
    first = spark.createDataFrame([("insert", 1, "a"), ("insert", 2, "b")], "op string, id int, v string")
    second = spark.createDataFrame([("delete", 1, None), ("update", 2, "c"), ("insert", 3, "d")], "op string, id int, v string")
    for part in (first, second):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = ev.read_stream(spark, str(tmp_path / "in"), first)
        ev.apply_patches(stream, str(tmp_path / "table"), "id", str(tmp_path / "c")).awaitTermination()
    assert sorted(map(tuple, ev.patched_table(spark, str(tmp_path / "table")).collect())) == [(2, "c"), (3, "d")]
