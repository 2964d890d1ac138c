"""Hand-computed and brute-force cases of references, collection steps, review work and containment."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import references as rf
from tessera.operators import casework as cw
from tessera.operators import collecting as co
from tessera.operators import containment as ct
from tessera.operators import graph as gr
from tessera.operators import nested as ns
from tessera.operators import provenance as pv
from tessera.operators import retrieval as rt
from tessera.operators import vectorindex as vi
from tessera.operators.postings import Postings
from tessera.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("text", "keys"),
    [
        ("제12조, 제14조의3 및 제20조부터 제22조까지", ["20", "21", "22", "12", "14-3"]),
        ("제5조와 그 밖의 제6조", ["5", "6"]),
        ("제5조 제1항 제2호 또는 제5조 제2항", ["5", "5"]),
        ("제8조제1항부터 제10조까지", ["8", "10"]),
        ("article 5 and 제 7 조", ["7"]),
        ("조 제 항", []),
        (None, []),
    ],
)
def test_citation_lists(text, keys):
    assert [r["key"] for r in rf.article_refs(text)] == keys


def test_lists_break_at_other_text():
    text = "제1조, 제2조. 제3조 및 관계 제4조"
    lists = rf.citation_lists(text, rf.scan(text))
    assert [[r["key"] for r in c.refs()] for c in lists] == [["1", "2"], ["3"], ["4"]]


LAW = {"name": "항만법", "level": "법률", "root": "항만법"}
FAMILY = [{"name": "항만법", "level": "법"}, {"name": "항만법 시행령", "level": "대통령령"}, {"name": "항만법 시행규칙", "level": "해양수산부령"}, {"name": None, "level": None}]


def test_whose_articles():
    got = lambda text: [(r["type"], r["target"], r["articles"], r["status"]) for r in rf.law_references(text, LAW, "3", ["1", "2", "3", "3-2"], FAMILY)]
    assert got("항만법 시행령 제4조와 어촌어항법 제5조") == [("explicit_law_article", "항만법 시행령", ["4"], "resolved"), ("explicit_law_article", "어촌어항법", ["5"], "unresolved_external")]
    assert got("청장이 정하는 시행규칙 제6조") == [("relative_scope", "항만법 시행규칙", ["6"], "resolved")]
    assert got("다음 조 및 전조") == [("previous_article", "항만법", ["2"], "resolved"), ("next_article", "항만법", ["3-2"], "resolved")]
    assert got("같은 조례 제7조") == [("relative_scope", None, ["7"], "ambiguous")]
    assert got("제2조와 제2조") == [("same_law_article", "항만법", ["2"], "resolved")]


@pytest.mark.parametrize(("name", "noise"), [("항만법", False), ("항만공사 시행규칙", False), ("위원회 항만법", True), ("법 시행규칙", True), ("하나 둘 셋 넷법", True), ("항만(법)", True), ("그림", True), ("정하고 항만법", True)])
def test_noise_by_reading_backwards(name, noise):
    assert rf.is_noise_name(name) is noise


def test_named_lists_go_on_within_their_line():
    got = rf.named_refs("항만법 제1조, 제2조 그리고 제3조; 민법 제4조와 제5조\n제6조 항만법 제7조", ["항만법"])
    assert [r["key"] for r in got] == ["1", "2", "3", "7"]
    assert rf.named_refs(None, ["항만법"]) == rf.named_refs("제1조", []) == []


def test_point_ids_are_blake_digests(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "source", "lang").collect()
    ids = [f"src::{r.source}::{r.lang}" for r in rows]
    want = {r.doc_id: i if ids.count(i) == 1 else f"{i}::{hashlib.blake2b(f'{i}|{r.doc_id}'.encode(), digest_size=8).hexdigest()}" for r, i in zip(rows, ids, strict=True)}
    assert {r.doc_id: r.point_id for r in catalog.queries()["pj13_blake_point_ids"](spark, DATA).collect()} == want


def test_pages_end_at_a_short_one_or_a_gap(spark):
    pages = lambda counts: spark.createDataFrame([(p, k) for p, n in counts.items() for k in range(n)], "page int, k int")
    seen = lambda counts: dict(co.until_short_page(pages(counts), "page", 3).groupBy("page").count().collect())
    assert seen({1: 3, 2: 3, 3: 2, 4: 3}) == {1: 3, 2: 3, 3: 2}
    assert seen({1: 3, 2: 3}) == {1: 3, 2: 3}
    assert seen({1: 3, 3: 3, 4: 3}) == {1: 3}
    assert seen({0: 1, 1: 3}) == {0: 1}


def test_requests(spark):
    registry = spark.createDataFrame([("a", True, ["x"], ["y", "z"], [("y", "w")]), ("off", False, [], [], [])], "endpoint string, enabled boolean, required array<string>, one_of array<string>, conditional array<struct<given:string,then:string>>")
    rows = [(1, "a", {"x": "1", "z": "2"}), (2, "a", {"x": " ", "y": "2"}), (3, "off", {}), (4, "?", {}), (5, "a", {"x": "1"}), (6, None, {"x": "1"})]
    got = {r.n: list(r.faults) for r in co.request_faults(spark.createDataFrame(rows, "n int, endpoint string, params map<string,string>"), registry).collect()}
    assert got == {1: [], 2: ["missing:x", "needs:w"], 3: ["disabled"], 4: ["unknown_endpoint"], 5: ["one_of:y|z"], 6: ["unknown_endpoint"]}


def test_previews_leave_out_unsound_marks(spark):
    marks = [(0, 2, "a"), (1, 3, "b"), (3, 3, "c"), (4, 6, "d"), (5, 99, "e"), (-1, 2, "f")]
    df = spark.createDataFrame([("<b>&xy", marks), ("", marks), (None, [])], "text string, m array<struct<start:int,finish:int,label:string>>")
    got = [r.h for r in df.select(co.preview_html(F.col("text"), F.col("m")).alias("h")).collect()]
    assert got == ['<mark class="a">&lt;b</mark>&gt;&amp;<mark class="d">xy</mark>', "", ""]


def test_updates_take_only_given_fields(spark):
    rows = spark.createDataFrame([(1, "a", '{"p":"1"}'), (2, "b", None), (3, "c", "{}")], "k int, v string, j string")
    patch = spark.createDataFrame([(1, None, '{"q":"2"}'), (2, "z", '{"r":"3"}')], "k int, v string, j string")
    assert sorted(map(tuple, co.update_given(rows, patch, "k", "j").collect())) == [(1, "a", '{"p":"1","q":"2"}'), (2, "z", '{"r":"3"}'), (3, "c", "{}")]


def test_legacy_rows_only_where_there_are_no_others(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2,), (3,)], "x int")
    assert [r.x for r in co.else_legacy(a, b).collect()] == [1]
    assert sorted(r.x for r in co.else_legacy(a.limit(0), b).collect()) == [2, 3]


def test_boundary_decisions(spark):
    rows = spark.createDataFrame([(1, 1, True, "one two"), (2, 1, True, "three"), (3, 1, True, "four five"), (4, 2, True, "six"), (5, None, False, None)], "n int, clause long, suspect boolean, text string")
    reviews = spark.createDataFrame([(1, "split", "two"), (2, "detach", None), (3, "split", "nowhere"), (4, "keep", None)], "n int, action string, anchor string")
    got = sorted((r.n, r.part, r.clause, r.piece, r.suspect) for r in cw.apply_boundaries(rows, reviews, ["n"]).collect())
    assert got == [(1, 0, 1, "one ", False), (1, 1, None, "two", False), (2, 0, None, "three", False), (3, 0, 1, "four five", True), (4, 0, 2, "six", False), (5, 0, None, "", False)]


def test_prefix_pairs_match_brute_force(spark):
    rng = random.Random(1)
    names = ["".join(rng.choice("ab ") for _ in range(rng.randint(1, 5))) for _ in range(60)] + [None, ""]
    got = {tuple(r) for r in pv.prefix_pairs(spark.createDataFrame([(n,) for n in names], "name string"), "name").collect()}
    plain = {n for n in names if n and n.strip()}
    assert got == {(a, b) for a in plain for b in plain if a != b and b.startswith(a)}


def test_containment_matches_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    words = ["la", "the", "stone", "ando", "a", "", "b"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(k, text(rng.randint(0, 30))) for k in range(60)] + [(99, None)]
    items = [(k, text(rng.randint(1, 6)) or "x") for k in range(25)] + [(50, docs[3][1][2:9] or "y"), (51, "la la"), (52, "stone")]
    want = {(d, i) for d, t in docs for i, w in items if t is not None and w in t}
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, want string")
    assert {tuple(r) for r in ct.containing(d, i, "doc_id", "text", "item_id", "want").collect()} == want
    assert ct.containing(d, i.limit(0), "doc_id", "text", "item_id", "want").count() == 0 == ct.containing(d.limit(0), i, "doc_id", "text", "item_id", "want").count()
    # without broadcasts, hot grams dealt out, a bitmap with many false hits, chunks of a few texts
    for name, value in (("few", lambda df, n=0: False), ("HOT", 5), ("MOST_BITS", 8), ("LEAST_BITS", 8), ("CHUNK", 40)):
        monkeypatch.setattr(ct, name, value)
    assert {tuple(r) for r in ct.containing(d, i, "doc_id", "text", "item_id", "want").collect()} == want


def test_shared_from_matches_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    links = [(rng.randrange(40), 0 if rng.random() < 0.4 else rng.randrange(1, 9)) for _ in range(150)] * 2
    near = {}
    for n, m in links:
        near.setdefault(n, set()).add(m)
    want = {(a, b, len(near[a] & near[b])) for a in near if a % 7 == 0 for b in near if a != b and near[a] & near[b]}
    table, starts = spark.createDataFrame(links, "n long, m long"), spark.createDataFrame([(k,) for k in range(0, 100, 7)], "n long")
    for sent, hub in ((gr.SENT, gr.HUB), (0, 3)):
        monkeypatch.setattr(gr, "SENT", sent)
        assert {tuple(r) for r in gr.shared_from(table, "n", "m", starts, hub).collect()} == want


def test_blocks_of_queries_give_the_same_hits(spark, monkeypatch):
    rng = random.Random(3)
    vectors = spark.createDataFrame([(str(k), [rng.random() for _ in range(4)]) for k in range(40)], "source_id string, vector array<double>")
    queries = spark.createDataFrame([(f"q{k}", [rng.random() for _ in range(4)]) for k in range(9)], "query_id string, vector array<double>")
    rows = lambda: sorted((r.query_id, r["rank"], r.source_id) for r in rt.vector_top(vectors, queries, 5).collect())
    want = rows()
    monkeypatch.setattr(rt, "few", lambda df, n=0: False)
    monkeypatch.setattr(rt, "QUERY_LIMIT", 3)
    assert rows() == want and len(want) == 45


def test_nested_json_of_any_shape(spark):
    deep = "1"
    for k in range(30):
        deep = f'{{"d": {deep}}}' if k % 2 else f"[{deep}]"
    rows = [
        (1, '{"a": [{"text": " x  y "}, "z", null, 1.5], "b": {"text": "{\\"text\\": [true, \\"in\\"]}"}, "": ""}'),
        (2, deep), (3, "no json {"), (4, None), (5, '"one"'), (6, '{"text": "{ no json"}'), (7, "[]"),
    ]
    tree = ns.nodes(spark.createDataFrame(rows, "id long, json string"), "id", "json").cache()
    assert sorted((r.id, r.path, r.value) for r in ns.strings(tree, "id").collect()) == [
        (1, "$.a[0].text", "x y"), (1, "$.a[1]", "z"), (1, "$.b.text.text[1]", "in"), (5, "$", "one"), (6, "$.text", "{ no json"),
    ]
    assert sorted((r.id, r.path) for r in ns.objects_with(tree, "id", "text").collect()) == [(1, "$.a[0]"), (1, "$.b"), (1, "$.b.text"), (6, "$")]
    at = {(r.id, r.path): (r.depth, r.kind, r.value) for r in tree.collect()}
    assert max(d for (k, _), (d, _, _) in at.items() if k == 2) == 30 and at[1, "$.a[2]"][1] == "null" and at[7, "$"][1] == "array"
    assert not any(k in (3, 4) for k, _ in at)
    assert {(r.path, r.value) for r in ns.member(tree.where("id = 6"), "id", "text").collect()} == {("$", "{ no json")}


def test_index_finds_what_the_exact_search_finds(spark, tmp_path):
    rng = random.Random(5)
    centers = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(40)]
    rows = [(str(k), [c + rng.gauss(0, 0.2) for c in centers[k % 40]]) for k in range(900)] + [("null", None), ("zero", [0.0] * 16), ("nan", [float("nan")] * 16)]
    vectors = spark.createDataFrame(rows, "source_id string, vector array<double>")
    queries = vectors.where("source_id IN ('3', '77', '500', '12')").withColumnRenamed("source_id", "query_id")
    index = vi.VectorIndex.build(vectors, str(tmp_path / "index"), vi.train(vectors))
    want = {(r.query_id, r.source_id): r.score for r in rt.vector_top(vectors.where("vector IS NOT NULL AND source_id <> 'nan'"), queries, 10).collect()}
    got = {(r.query_id, r.source_id): (r.score, r.cells_read) for r in vi.VectorIndex.open(spark, index.path).search(queries, 10).collect()}
    assert len(set(want) & set(got)) > 0.95 * len(want) and all(abs(got[k][0] - want[k]) < 1e-9 for k in set(want) & set(got))
    assert all(share < 0.1 for _, share in got.values())
    everything = {(r.query_id, r.source_id) for r in index.search(queries, 10, share=2.0, rerank=10_000).collect()}
    assert everything == set(want)
    assert vi.VectorIndex.build(vectors.limit(0), str(tmp_path / "none"), vi.train(vectors.limit(0))).search(queries, 3).count() == 0


def test_index_recall_on_the_tables(spark):
    """Every vector whose id is divisible by 100 against all: recall of the 30 nearest."""
    from tessera.plans.search import vectors

    for data in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        queries = vectors(spark, data).where("vec_id % 100 = 0").selectExpr("source_id AS query_id", "vector")
        want = {(r.query_id, r.source_id) for r in rt.vector_top(vectors(spark, data), queries, 30).collect()}
        rows = catalog.queries()["vs1_index_topk"](spark, data).collect()
        recall = len(want & {(r.query_id, r.source_id) for r in rows}) / len(want)
        print(data, "recall", recall, "cells", rows[0].cells_read)
        assert recall >= 0.95 and all(r.cells_read < 0.9 for r in rows)


def test_postings_skip_blocks_and_lose_nothing(spark, tmp_path):
    rng = random.Random(6)
    names = [f"w{k}" for k in range(200)]
    text = lambda: " ".join(rng.choice(names[: rng.choice((5, 200))]) for _ in range(rng.randint(0, 60)))
    rows = [(str(k), text()) for k in range(800)] + [("null", None), ("rare", "w1 rare rare"), ("a1", "w1 w2 w3"), ("a2", "w1 w2 w3")]
    docs = spark.createDataFrame(rows, "source_id string, text string")
    terms = spark.createDataFrame([("q1", "w1"), ("q1", "rare"), ("q2", "w150"), ("q2", "w3"), ("q2", "w3"), ("q3", "none"), ("q4", "w77"), ("q4", "w88"), ("q4", "w99")], "query_id string, term string")
    index = Postings.build(docs, str(tmp_path / "index"), range_docs=8)
    key = lambda df: sorted((r.query_id, r["rank"], r.source_id, round(r.score, 6)) for r in df.collect())
    for top in (1, 5, 1000):
        hits, report = index.search(terms, top)
        assert key(hits) == key(rt.keyword_top(docs, terms, top))
        counts = {r.query_id: (r.n_read, r.n_blocks) for r in report.collect()}
        assert set(counts) == {"q1", "q2", "q4"} and all(0 < a <= b for a, b in counts.values())
        if top == 1:
            assert counts["q1"][0] < counts["q1"][1] / 2


class _Cell:
    """A state variable in memory, as the engine's value and list states behave."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    update = put = lambda self, value: setattr(self, "value", value)

    def clear(self):
        self.value = None


class _Clock:
    def __init__(self):
        self.now, self.timers = 1000, []

    def getValueState(self, *a):  # noqa: N802
        return _Cell()

    def getListState(self, *a):  # noqa: N802
        return _Cell()

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return self.now


def test_requests_wait_for_their_turn():
    import pandas as pd

    from tessera.streaming import events as ev

    clock = _Clock()
    jobs = ev.InOrder("id", 50)
    jobs.init(clock)
    give = lambda *rows: [tuple(x) for part in jobs.handleInputRows(("j",), iter([pd.DataFrame(rows, columns=["seq", "asked"])]), clock) for x in part.itertuples(index=False)]
    assert give((2, "running"), (4, "failed")) == [] and clock.timers == [1050]
    assert give((1, "queued"), (1, "queued")) == [("j", 1, "queued", True), ("j", 2, "running", True)] and clock.timers == [1050]
    expired = [tuple(x) for part in jobs.handleExpiredTimer(("j",), clock, None) for x in part.itertuples(index=False)]
    assert expired == [("j", 4, "failed", True)] and not jobs.held.exists()
    assert give((3, "running")) == [] and give((9, "queued")) == [("j", 9, "failed", False)]  # given up; after the end


def test_a_job_costs_few_requests_to_its_state():
    import pandas as pd

    from tessera.streaming import events as ev

    calls = []

    class Counted(_Cell):
        def __getattribute__(self, name):
            if name in ("exists", "get", "update", "put", "clear"):
                calls.append(name)
            return super().__getattribute__(name)

    clock = _Clock()
    clock.getValueState = clock.getListState = lambda *a: Counted()
    jobs = ev.InOrder("id")
    jobs.init(clock)
    got, costs = [], []
    for rows in ([(n, "running") for n in range(5, 50)], [(2, "running"), (3, "queued")], [(1, "queued")], [(4, "failed")]):
        calls.clear()
        parts = list(jobs.handleInputRows(("j",), iter([pd.DataFrame(rows, columns=["seq", "asked"])]), clock))
        costs.append(len(calls))
        got.append([x for part in parts for x in part.itertuples(index=False)])
        assert all(len(part) for part in parts)  # no frame without answers
    assert [len(x) for x in got] == [0, 0, 3, 46] and [x.seq for part in got for x in part] == list(range(1, 50))
    assert costs == [3, 4, 4, 4]  # 4, then 6 when existence was asked for first


def test_ordered_states_over_batches_and_a_restart(spark, tmp_path):
    from tessera.streaming import events as ev

    rng = random.Random(7)
    names = ["queued", "running", "hitl_waiting", "applying", "completed", "failed"]
    rows = [(str(j), n + 1, names[n % 4] if rng.random() < 0.8 else rng.choice(names)) for j in range(5) for n in range(rng.randint(1, 8))]
    want = []
    for j in range(5):
        state = None
        for _, n, asked in sorted((r for r in rows if r[0] == str(j)), key=lambda r: r[1]):
            state, ok = ev.follow(state, asked)
            want.append((str(j), n, state, ok))
    rng.shuffle(rows)
    kind = "review_id string, seq long, asked string"
    like = spark.createDataFrame([], kind)
    half = len(rows) // 2
    for part in (rows[:half], rows[half:]):  # the second half comes after the stream was stopped
        for piece in (part[::2], part[1::2]):
            spark.createDataFrame(piece, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = ev.run_to_files(ev.ordered_states(ev.read_stream(spark, f"{tmp_path}/in", like)), str(tmp_path))
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)


def test_pages_stream_stops_and_goes_on(spark, tmp_path):
    from tessera.sources import pages
    from tessera.streaming import events as ev

    rows = spark.range(23).selectExpr("id * 3 AS k", "concat('n', id) AS name")
    pages.write_pages(rows, f"{tmp_path}/list", 5, "k")
    assert [len(pages.rows_of(f"{tmp_path}/list", p)) for p in range(5)] == [5, 5, 5, 5, 3] and pages.rows_of(f"{tmp_path}/list", 5) is None
    every = sorted((3 * k, f"n{k}", k // 5) for k in range(23))
    some = pages.read_pages(spark, f"{tmp_path}/list", "k long, name string", 5).where("page >= 3 AND k > 60")
    assert sorted(tuple(r) for r in some.collect()) == [r for r in every if r[2] >= 3 and r[0] > 60]
    assert some.rdd.getNumPartitions() == 2  # of pages 3 and 4 only
    stream = lambda: ev.run_to_files(pages.stream_pages(spark, f"{tmp_path}/list", "k long, name string", 5, 2), f"{tmp_path}/run")
    counts = []
    for _ in range(4):
        counts.append(stream().count())
    assert counts[-1] == 23 and sorted(tuple(r) for r in stream().collect()) == every


def test_one_run_reads_every_page(spark, tmp_path):
    from tessera.sources import pages
    from tessera.streaming import events as ev

    for n in (0, 53, 60):  # no page, a short one at the end, none
        pages.write_pages(spark.range(n).selectExpr("id AS k"), f"{tmp_path}/list{n}", 5, "k")
        out = ev.run_to_files(pages.stream_pages(spark, f"{tmp_path}/list{n}", "k long", 5), f"{tmp_path}/run{n}")
        assert sorted(tuple(r) for r in out.collect()) == [(k, k // 5) for k in range(n)]


def test_a_list_without_a_total_ends_at_its_short_page(spark, tmp_path):
    from tessera.sources import pages

    for page, n in ((0, 3), (1, 3), (2, 1), (3, 3)):
        spark.range(n).selectExpr(f"{page} * 10 + id AS k").coalesce(1).write.json(f"{tmp_path}/page={page}")
    got = pages.read_pages(spark, str(tmp_path), "k long", 3)
    assert sorted(r.k for r in got.collect()) == [0, 1, 2, 10, 11, 12, 20]
    assert sorted(r.k for r in got.where("page < 2 AND page > 0").collect()) == [10, 11, 12]


def test_many_pages_are_read_by_few_tasks(spark, tmp_path, monkeypatch):
    from tessera.sources import pages

    reader = pages.PageReader(spark.range(0).schema, {"path": str(tmp_path), "pagesize": "500"})
    monkeypatch.setattr(pages, "total_of", lambda path: 54_000_001)
    runs = reader.partitions()
    assert len(runs) == pages.TASKS and [p for r in runs for p in range(r.first, r.end)] == list(range(108_001))


def test_a_tasks_share_does_not_grow(spark, monkeypatch):
    from tessera.operators import retrieval as rt

    rows = spark.range(3000).selectExpr("id % 100 AS k", "id AS v")
    monkeypatch.setattr(rt, "TASK_ROWS", 50)
    parts = rt.dealt(rows, rows.count(), "k")
    assert parts.rdd.getNumPartitions() == 60 and parts.groupBy("k").count().count() == 100

    def tasks(df):
        return [int(n) for n in re.findall(r"hashpartitioning\([^)]*?, (\d+)\)", df._jdf.queryExecution().executedPlan().toString())]

    links = spark.range(400).selectExpr("id % 40 AS n", "id % 10 AS m")
    shared = gr.shared_neighbours(links, "n", "m")  # 10 middle nodes of 4 nodes each: 60 pairs
    assert shared.count() == 60 and {r.shared for r in shared.collect()} == {1} and set(tasks(shared)) == {8, 4}
    best = pv.best_match(rows.selectExpr("k", "v", "concat('a', v) AS name"), "k", F.col("name"), F.lit("a150"), "v")
    assert set(tasks(best)) == {60} and {r.k: r.v for r in best.collect()} == {k: 150 if k == 50 else 1500 + k if k < 10 else k for k in range(100)}


def test_chunks_leave_a_few_texts_at_a_time(spark):
    from tessera.functions import sequential as sq

    texts = [None, "", "a short one"] + [f"line {k} of words\n" * (40 * k) for k in range(1, 9)]
    rows = spark.createDataFrame([(k, texts[k % len(texts)], "x") for k in range(300)], "doc_id long, text string, other string")
    for structured, cut in ((True, sq.structured_chunks), (False, sq.window_chunks)):
        got = sq.chunk_rows(rows, "text", structured=structured)
        want = {(k, "x", i, c) for k in range(300) for i, c in enumerate(cut(texts[k % len(texts)]))}
        assert got.columns == ["doc_id", "other", "chunk_index", "chunk"] and {tuple(r) for r in got.collect()} == want
    for name in ("fn6_chunks", "fn7_structured_chunks"):  # no column of whole batches of texts and of all their chunks
        assert "ArrowEvalPython" not in catalog.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_postings_of_more_words_have_more_tasks(spark, tmp_path, monkeypatch):
    from tessera.operators import postings as po

    docs = spark.range(200).selectExpr("cast(id AS string) AS source_id", "concat_ws(' ', 'w', 'w', concat('v', id % 7), concat('u', id % 50)) AS text")
    seen = []

    def spied(rows, n, *keys):
        out = rt.dealt(rows, n, *keys)
        seen.append((n, out.rdd.getNumPartitions()))
        return out

    monkeypatch.setattr(po, "dealt", spied)
    for each in (rt.TASK_ROWS, 100):
        monkeypatch.setattr(rt, "TASK_ROWS", each), monkeypatch.setattr(po, "TASK_ROWS", each)
        index = Postings.build(docs, str(tmp_path / f"index{each}"), range_docs=8)
        terms = spark.createDataFrame([("q", "w"), ("q", "v3"), ("q", "u9")], "query_id string, term string")
        assert sorted(map(tuple, index.search(terms, 9)[0].select("source_id", "score").collect())) == sorted(map(tuple, rt.keyword_top(docs, terms, 9).select("source_id", "score").collect()))
    assert seen == [(800, 4), (800, 8)]


def test_index_serves_queries_in_blocks(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    rows = [(str(k), [rng.gauss(0, 1) for _ in range(8)]) for k in range(500)]
    vectors = spark.createDataFrame(rows, "source_id string, vector array<double>")
    queries = vectors.where("source_id % 20 = 0").withColumnRenamed("source_id", "query_id")
    index = vi.VectorIndex.build(vectors, str(tmp_path / "index"), vi.train(vectors))
    want = sorted(map(tuple, index.search(queries, 5, 0.5, rerank=40).select("query_id", "source_id", "rank").collect()))
    assert len(want) == 25 * 5
    monkeypatch.setattr(vi, "QUERIES", 4), monkeypatch.setattr(vi, "SCANNED", 7), monkeypatch.setattr(vi, "OUT_ROWS", 11)
    assert sorted(map(tuple, index.search(queries, 5, 0.5, rerank=40).select("query_id", "source_id", "rank").collect())) == want


def shuffled(spark, since=-1):
    """(last stage, rows written to shuffles by the stages after `since`)."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    rows = [(stages.apply(k).stageId(), stages.apply(k).shuffleWriteRecords()) for k in range(stages.size())]
    return max((k for k, _ in rows), default=since), sum(n for k, n in rows if k > since)


def test_postings_shuffle_finished_blocks_only(spark, tmp_path):
    rng = random.Random(9)
    rows = [(f"d{k:03}", " ".join(f"w{rng.randint(0, 30)}" for _ in range(rng.randint(0, 200)))) for k in range(400)]
    docs = spark.createDataFrame(rows, "source_id string, text string").coalesce(2)
    since, _ = shuffled(spark)
    index = Postings.build(docs, str(tmp_path / "index"), range_docs=40)
    made = index.blocks(spark.createDataFrame([(f"w{k}",) for k in range(31)], "term string"))
    assert made.agg(F.sum("n")).first()[0] == sum(len(set(t.split())) for _, t in rows) and made.count() <= 31 * 10
    _, n = shuffled(spark, since)
    assert n < 400  # neither documents nor their postings: 310 blocks, 10 ranges, a few counts
    assert {p.name for p in (tmp_path / "index").iterdir()} == {"blocks", "size"}  # nor a copy of the words
    terms = spark.createDataFrame([("q1", "w1"), ("q1", "w2"), ("q2", "w30"), ("q3", "none")], "query_id string, term string")
    for top in (3, 500):
        assert sorted(map(tuple, index.search(terms, top)[0].select("query_id", "source_id", "score", "rank").collect())) == sorted(map(tuple, rt.keyword_top(docs, terms, top).select("query_id", "source_id", "score", "rank").collect()))


def test_pairs_of_neighbours_are_sent_as_lists(spark):
    from itertools import combinations

    rng = random.Random(10)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    far = [-(1 << 63), -1, 0, 200, 300, 70_000, 5_000_000_000, (1 << 63) - 1]
    for kind, nodes in (("long", range(-40, 40)), ("long", far), ("long", range(0, 8_000_000, 100_000)), ("int", [-(1 << 31), 5, 6, 900, (1 << 31) - 1]), ("short", range(9)), ("string", [f"n{k}" for k in range(30)])):
        groups = {m: rng.sample(list(nodes), min(len(nodes), rng.randint(0, 60))) for m in range(12)} | {12: list(nodes)[:1], 13: list(nodes)}
        rows = [(n, m) for m, ns in groups.items() for n in ns for _ in range(rng.randint(1, 2))] + [(None, 1), (list(nodes)[0], None)]
        want: dict = {}
        for ns in groups.values():
            for pair in combinations(sorted(ns), 2):
                want[pair] = want.get(pair, 0) + 1
        shared = gr.shared_neighbours(spark.createDataFrame(rows, f"n {kind}, m long"), "n", "m")
        since, _ = shuffled(spark)
        assert sorted(map(tuple, shared.collect())) == sorted((a, b, k) for (a, b), k in want.items())
        assert shared.dtypes == [("source", dict(long="bigint", short="smallint").get(kind, kind)), ("target", dict(long="bigint", short="smallint").get(kind, kind)), ("shared", "bigint")]
        _, n = shuffled(spark, since)
        assert n <= 2 * len(rows)  # a row for each link and a list for each, not one for each pair
        assert kind == "short" or len(nodes) < 20 or sum(want.values()) > 2 * len(rows)
    assert spark.conf.get(key) == before


def test_postings_of_texts_without_words(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{k}", t) for k, t in enumerate([None, "", " ,", None, "one word", ""])], "source_id string, text string").coalesce(1)
    index = Postings.build(docs, str(tmp_path / "index"), range_docs=2)  # two ranges hold no word
    terms = spark.createDataFrame([("q1", "word"), ("q2", "none")], "query_id string, term string")
    assert [(r.query_id, r.source_id, r["rank"]) for r in index.search(terms, 5)[0].collect()] == [("q1", "d4", 1)]
