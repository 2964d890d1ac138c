"""Queries over whole tables: rows that the sampled queries of the same operators never see."""

from itertools import combinations

from tessera.plans import catalog


def run(spark, name, tmp_path, **tables):
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{t}.parquet")
    return catalog.queries()[name](spark, str(tmp_path)).collect()


def test_three_hop_covers_all_customers_and_parts(spark, tmp_path):
    bought = {1: {7, 207, 9}, 2: {7, 9}, 5: {9}, 21: {207}, 40: {300}}  # 7 and 207 are one key modulo 200
    orders = [(c, c) for c in bought] + [(2, 102)]
    lines = [(c, p) for c, parts in bought.items() for p in parts] + [(102, 7)]
    got = run(spark, "jn12_three_hop_all", tmp_path, orders=(orders, "o_custkey long, o_orderkey long"), lineitem=(lines, "l_orderkey long, l_partkey long"))
    want = {(a, b, len(bought[a] & bought[b])) for a, b in combinations(sorted(bought), 2) if bought[a] & bought[b]}
    assert sorted(map(tuple, got)) == sorted(want)


EVENTS = [(1, 10, "view"), (2, 10, "error"), (4, 23, "purchase"), (5, 23, "click"), (7, 23, "click"), (11, 5, "signup"), (3, 10, "view")]
EVENT = "event_id long, user_id long, event_type string"


def test_levels_count_all_events(spark, tmp_path):
    got = {(r.bucket, r.level): (r.n, r.worst) for r in run(spark, "ag13_ordinal_max_all", tmp_path, events=(EVENTS, EVENT))}
    held = {(0, "none"): 2, (0, "crit"): 1, (3, "high"): 1, (3, "low"): 2, (5, "mid"): 1}
    worst = {0: "crit", 3: "high", 5: "mid"}
    assert got == {(b, level): (held.get((b, level), 0), w) for b, w in worst.items() for level in ("none", "low", "mid", "high", "crit")}


def test_queue_holds_all_events(spark, tmp_path):
    got = run(spark, "sc7_delta_queue_all", tmp_path, events=(EVENTS, EVENT), customer=([(23, 4)], "c_custkey long, c_nationkey int"))
    assert sorted((r.law, r.n, r.kinds, r.root) for r in got) == [(5, 1, "article_changed", -1), (10, 3, "article_changed,deleted", -1), (23, 3, "article_changed,law_changed", 4)]


def test_links_cover_all_parts_and_markers(spark, tmp_path):
    parts = [(1, "A", "TIN BOX"), (2, "A", "BOX TIN"), (3, "A", "BIG TIN BOX"), (4, "B", "BOX"), (8, "B", "OLD"), (9, "C", None)]
    got = run(spark, "jn5_appendix_links_all", tmp_path, part=(parts, "p_partkey long, p_brand string, p_type string"))
    want = [(1, 2, "BOX,TIN"), (2, 2, "BOX,TIN"), (3, 3, "BIG,BOX,TIN"), (4, 1, "BOX"), (8, 1, "OLD"), (9, 0, "none")]
    assert sorted((r.p_partkey, r.n, r.markers) for r in got) == want


def test_order_covers_all_sources(spark, tmp_path):
    docs = [(i, f"src{i % 3}" if i % 7 else None, ("de", "en", "fr", None)[i * i % 11 % 4]) for i in range(0, 20_000, 53)]
    got = {r.doc_id: r.place for r in run(spark, "so3_type_order_all", tmp_path, documents=(docs, "doc_id long, source string, lang string"))}
    want = {}
    for source in {d[1] for d in docs}:
        rows = sorted((d for d in docs if d[1] == source), key=lambda d: ({"en": 0, "fr": 1}.get(d[2], 9), d[0]))
        want |= {d[0]: k for k, d in enumerate(rows, 1)}
    assert got == want


def test_one_hop_expands_all_edges(spark, tmp_path):
    got = run(
        spark, "gr8_one_hop_all", tmp_path,
        region=([(0, "R0"), (1, "R1")], "r_regionkey int, r_name string"), nation=([(5, 0, "N5"), (6, 1, "N6")], "n_nationkey int, n_regionkey int, n_name string"),
        customer=([(9, 5, "C9"), (8, 6, "C8")], "c_custkey long, c_nationkey int, c_name string"),
    )
    assert sorted(map(tuple, got)) == [("n5", "c9", "C9"), ("n6", "c8", "C8"), ("r0", "n5", "N5"), ("r1", "n6", "N6")]


def test_hits_hold_the_whole_item(spark, tmp_path):
    item = "The same forty characters stand here at first, then it differs"
    docs = [(1, "x " + item[:45] + " and ends otherwise", "en"), (2, "x " + item.upper(), "de"), (3, "Other words", "en")]
    got = run(spark, "ag12_hit_at_k_all", tmp_path, benchmark=([(0, item), (1, "other words")], "item_id long, text string"), documents=(docs, "doc_id long, text string, lang string"))
    assert {r.intent: (r.n, r.hits) for r in got} == {"all": (2, 1), "normative": (1, 0), "case_law": (1, 1)}


def test_operators_without_a_query_are_not_claimed():
    assert not {"SC6", "SC16"} & set(catalog.coverage())
