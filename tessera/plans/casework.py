"""Queries of review work, graph plans, model calls and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions.models import STATUS_SCORE
from tessera.operators import casework as cw
from tessera.operators import merging as mg
from tessera.operators import review as rv
from tessera.plans.registry import query, table
from tessera.sources import files
from tessera.streaming import events as ev

_SUSPECTS = """c AS (SELECT conv_id, turn, role, text, CASE WHEN sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) > 0 THEN sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) END::BIGINT AS clause FROM conversations),
l AS (SELECT *, max(clause) OVER (PARTITION BY conv_id) AS last FROM c), s AS (SELECT *, CASE WHEN clause IS NULL OR trim(text) = '' THEN '' WHEN clause = last THEN 'last_clause' WHEN role = 'user' THEN '' ELSE concat_ws(',', CASE WHEN length(text) < 120 THEN 'short' END, CASE WHEN contains(text, 'the') THEN 'title_like' END) END AS why FROM l)"""


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rv.segments(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "user")
    rows = rows.withColumn("clause", F.when(F.col("clause") > 0, F.col("clause")))
    return cw.suspects(rows, "conv_id", "turn", {"short": F.length("text") < 120, "title_like": F.contains("text", F.lit("the"))}, F.col("role") == "user")


@query("wn14_suspects", "WN14", f"WITH {_SUSPECTS} SELECT conv_id, turn, why, why <> '' AS suspect FROM s")
def suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of the last clause and those that meet a rule."""
    return _paragraphs(spark, sf_dir).select("conv_id", "turn", "why", "suspect")


@query(
    "wn16_review_blocks", "WN16",
    f"""WITH {_SUSPECTS}, e AS (SELECT conv_id, min(turn) AS low, max(turn) AS high FROM conversations GROUP BY 1)
    SELECT conv_id, clause, count(*) AS suspects, greatest(min(turn) - 1, any_value(low)) AS first, least(max(turn) + 1, any_value(high)) AS last FROM s JOIN e USING (conv_id) WHERE why <> '' GROUP BY conv_id, clause""",
)
def review_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read of each clause with suspects: they and a neighbour on either side."""
    return cw.review_blocks(_paragraphs(spark, sf_dir), "conv_id", "turn")


@query(
    "wf4_boundaries", "WF4",
    f"""WITH {_SUSPECTS}, a AS (SELECT *, CASE turn % 4 WHEN 0 THEN 'keep' WHEN 1 THEN 'detach' WHEN 2 THEN 'split' END AS action, CASE WHEN turn % 4 = 2 THEN strpos(text, 'an') ELSE 0 END AS p FROM s)
    SELECT conv_id, turn, 0 AS part, CASE WHEN action = 'detach' THEN NULL ELSE clause END AS clause, why <> '' AND NOT coalesce(action IN ('keep', 'detach') OR p > 1, FALSE) AS suspect, CASE WHEN p > 1 THEN substr(text, 1, p - 1) ELSE text END AS piece FROM a
    UNION ALL SELECT conv_id, turn, 1, NULL, FALSE, substr(text, p) FROM a WHERE p > 1""",
)
def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs after decisions to keep, detach or split them."""
    p = _paragraphs(spark, sf_dir).select("conv_id", "turn", "clause", "suspect", "text")
    m = F.col("turn") % 4
    reviews = p.where(m < 3).select("conv_id", "turn", F.when(m == 0, "keep").when(m == 1, "detach").otherwise("split").alias("action"), F.lit("an").alias("anchor"))
    return cw.apply_boundaries(p, reviews, ["conv_id", "turn"])


@query(
    "wf1_reduced_reviews", "WF1",
    """WITH f AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'crit' WHEN 'purchase' THEN 'high' WHEN 'signup' THEN 'mid' WHEN 'click' THEN 'low' ELSE 'none' END AS risk FROM events)
    SELECT user_id, count(*) AS n, arg_max(risk, list_position(['none', 'low', 'mid', 'high', 'crit'], risk)) AS worst FROM f GROUP BY user_id""",
)
def reduced_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses reviewed apart, reduced to one verdict a document."""
    t = F.col("event_type")
    said = F.when(t == "error", "critical").when(t == "purchase", "major").when(t == "signup", "medium").when(t == "click", "minor").otherwise("none")
    return cw.worst_of(table(spark, sf_dir, "events").select("user_id", tx.risk_level(said).alias("risk")), "user_id", "risk")


@query(
    "wf3_second_opinion", "WF3 FN37",
    """SELECT conv_id, turn, length(text) < 150 AND trim(text) <> '' AS asked, CASE WHEN trim(text) = '' THEN 'empty' WHEN length(text) < 150 AND turn % 2 = 0 THEN 'heading' ELSE 'body' END AS label FROM conversations""",
)
def second_opinion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by rule; only ambiguous paragraphs are put to the model, whose answers are an input."""
    c = table(spark, sf_dir, "conversations")
    answers = c.where("turn % 2 = 0").select("conv_id", "turn", F.lit("heading").alias("answer"))
    blank = F.trim("text") == ""
    return cw.second_opinion(c, F.when(blank, "empty").otherwise("body"), (F.length("text") < 150) & ~blank, answers, ["conv_id", "turn"])


@query(
    "fn46_findings", "FN46",
    """WITH p AS (SELECT conv_id, turn, text FROM conversations), f AS (SELECT conv_id, min(turn) AS first FROM p GROUP BY 1), r AS (SELECT conv_id, turn AS finding, CASE WHEN turn % 3 = 0 THEN turn + 1 ELSE turn END AS target, CASE turn % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'high' ELSE 'mid' END AS level, CASE WHEN turn % 5 = 0 THEN NULL ELSE turn END AS src FROM p),
    n AS (SELECT r.*, CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.conv_id = r.conv_id AND p.turn = r.target) THEN target ELSE first END AS node FROM r JOIN f USING (conv_id) WHERE level <> 'none' AND src IS NOT NULL)
    SELECT n.conv_id, finding, node, level, src::VARCHAR AS sources, CASE WHEN finding % 2 = 1 AND p.text <> 'new text' THEN 'new text' END AS edit FROM n JOIN p ON p.conv_id = n.conv_id AND p.turn = n.node""",
)
def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload rows as findings: targets fall back, rows without risk or source go, empty edits are dropped."""
    c = table(spark, sf_dir, "conversations")
    t = F.col("turn")
    rows = c.select(
        "conv_id", t.alias("finding"), F.when(t % 3 == 0, t + 1).otherwise(t).alias("target"), F.when(t % 4 == 0, "none").when(t % 4 == 1, "major").otherwise("odd").alias("level"),
        F.when(t % 5 == 0, F.array((t + 1000))).otherwise(F.array(t, t + 1000)).alias("source_ids"), F.when(t % 2 == 1, "new text").otherwise(" ").alias("replacement"),
    )
    return cw.findings(rows, c.select("conv_id", t.alias("node"), "text"), "conv_id")


@query(
    "fn47_decisions", "FN47",
    """SELECT o_orderkey, 'f1' AS finding, 'accepted' AS decision FROM orders WHERE o_orderkey % 4 <> 3 UNION ALL SELECT o_orderkey, 'f2', 'rejected' FROM orders WHERE o_orderkey % 4 IN (0, 1)""",
)
def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions as a list, as a map, as one object; what is none is skipped."""
    m = F.col("o_orderkey") % 4
    said = F.when(m == 0, '[{"finding":"f1","decision":"accepted"},{"finding":"f2","decision":"rejected"},{"finding":"","decision":"accepted"},{"finding":"f3","decision":"?"}]').when(
        m == 1, '{"f1":"accepted","f2":"rejected","f3":"maybe"}'
    )
    said = said.when(m == 2, '{"finding":"f1","decision":"accepted"}').otherwise("no json")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(cw.decisions(said)).alias("d")).select("o_orderkey", "d.finding", "d.decision")


@query(
    "wf5_accepted_edits", "WF5",
    """WITH e AS (SELECT event_id, user_id, CASE event_type WHEN 'error' THEN 'crit' WHEN 'purchase' THEN 'high' WHEN 'signup' THEN 'mid' WHEN 'click' THEN 'low' ELSE 'none' END AS level FROM events)
    SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY list_position(['none', 'low', 'mid', 'high', 'crit'], level) DESC, event_id) = 1 AS applied FROM e""",
)
def accepted_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edit a target, the highest risk first; the others are conflicts."""
    t = F.col("event_type")
    level = F.when(t == "error", "crit").when(t == "purchase", "high").when(t == "signup", "mid").when(t == "click", "low").otherwise("none")
    return cw.accepted_edits(table(spark, sf_dir, "events").select("event_id", "user_id", level.alias("level")), "user_id", "event_id", "level").select("event_id", "user_id", "applied")


@query(
    "ex1_first_success", "EX1",
    """WITH a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt, event_type IN ('purchase', 'signup') AS ok, event_type AS answer FROM events), t AS (SELECT * FROM a WHERE attempt <= 3)
    SELECT user_id, CASE min(attempt) FILTER (ok) WHEN 1 THEN 'ok' ELSE CASE WHEN min(attempt) FILTER (ok) IS NULL THEN 'failed' ELSE 'repaired' END END AS status, coalesce(min(attempt) FILTER (ok), max(attempt)) AS tries, arg_min(answer, attempt) FILTER (ok) AS answer FROM t GROUP BY user_id""",
)
def first_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls tried up to three times: the first usable answer, and whether it took a repair."""
    e = rv.numbered(table(spark, sf_dir, "events"), spark.createDataFrame([], "user_id long, top long"), "user_id", ["event_id"])
    return cw.first_success(e.select("user_id", F.col("seq").alias("attempt"), F.col("event_type").isin("purchase", "signup").alias("ok"), F.col("event_type").alias("answer")), "user_id", 3)


@query(
    "ex2_trace_scores", "EX2",
    """SELECT o_custkey, count(*) AS n, round(avg(CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.7 ELSE 0.5 END), 6) AS score FROM orders GROUP BY 1""",
)
def trace_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces scored by the state of their law context, averaged."""
    s = F.col("o_orderstatus")
    status = F.when(s == "F", "ok").when(s == "O", "supplemented").otherwise("case_only")
    score = F.try_element_at(F.create_map(*[F.lit(x) for kv in STATUS_SCORE.items() for x in kv]), status)
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.avg(score), 6).alias("score"))


@query(
    "ag19_low_scores", "AG19",
    """WITH s AS (SELECT d.doc_id, lang, quality + toxic * 0.5 + (d.doc_id % 10) / 100.0 AS score FROM documents d JOIN labels USING (doc_id)), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score, doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM s)
    SELECT doc_id, lang, round(score::DOUBLE, 6) AS score FROM r WHERE r <= greatest(floor(n * 0.1), 1)""",
)
def low_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tenth of each group's answers with the lowest scores; scores are an input."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    scored = d.select("doc_id", "lang", F.round(F.col("quality") + F.col("toxic") * 0.5 + (F.col("doc_id") % 10) / 100.0, 6).alias("score"))
    return cw.lowest(scored, "lang", "score", 0.1, "doc_id").select("doc_id", "lang", "score")


_PLANS = {"article": ("MATCH (a:Article {law: '{law}', key: '{key}'}) RETURN a", ("law", "key")), "cases": ("MATCH (l:Law {name: '{law}'})<-[:CITES]-(c) RETURN c", ("law",))}


@query(
    "gr11_plans", "GR11 GR12",
    """WITH o AS (SELECT o_orderkey, o_orderkey % 5 AS m, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS law, o_custkey::VARCHAR AS key FROM orders), p AS (SELECT *, CASE WHEN law IS NULL THEN NULL WHEN m IN (0, 1) THEN 'MATCH (a:Article {law: ''' || law || ''', key: ''' || key || '''}) RETURN a' WHEN m IN (2, 3) THEN 'MATCH (l:Law {name: ''' || law || '''})<-[:CITES]-(c) RETURN c' END AS plan FROM o)
    SELECT o_orderkey, CASE m WHEN 1 THEN 'MATCH (a)-[:CITES*1..3]->(b) RETURN b' ELSE plan END AS query, CASE WHEN m = 1 THEN 'free' WHEN plan IS NULL THEN 'none' ELSE 'template' END AS by FROM p""",
)
def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph queries by template where the slots are filled; a free-form one first, if the guard lets it pass."""
    k = F.col("o_orderkey")
    m = k % 5
    slots = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(m < 2, "article").when(m < 4, "cases").otherwise("other").alias("intent"), F.when(k % 7 != 0, F.col("o_orderpriority")).alias("law"), F.col("o_custkey").cast("string").alias("key"),
        F.when(m == 1, "MATCH (a)-[:CITES*1..3]->(b) RETURN b").when(m == 2, "MATCH (a) DETACH DELETE a").when(m == 3, "MATCH (a)-[:OWNS]->(b) RETURN b").alias("free"),
    )
    return cw.guarded(cw.planned(slots, _PLANS), "free", ("CITES",), "plan").select("o_orderkey", "query", "by")


@query(
    "sm1_resumed_tail", "SM1",
    """WITH e AS (SELECT *, min(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id) AS last FROM events), c AS (SELECT c_custkey, max(c_nationkey) AS cursor FROM customer GROUP BY 1)
    SELECT event_id, user_id FROM e LEFT JOIN c ON c_custkey = user_id WHERE event_id > coalesce(cursor, 0) AND (last IS NULL OR event_id <= last)""",
)
def resumed_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each log from where its reader left off to its first terminal event."""
    cursors = table(spark, sf_dir, "customer").groupBy(F.col("c_custkey").alias("user_id")).agg(F.max("c_nationkey").alias("cursor"))
    return cw.tail(table(spark, sf_dir, "events"), cursors, "user_id", "event_id", F.col("event_type") == "error").select("event_id", "user_id")


@query(
    "sm2_token_stream", "SM2",
    r"""WITH w AS (SELECT conv_id, turn, list_filter(regexp_extract_all(text, '\s*\S+\s*|\s+'), lambda x: x <> '') AS p, text FROM conversations)
    SELECT conv_id, turn, CASE WHEN text = '' THEN 0 WHEN regexp_matches(text, '^\s') THEN len(regexp_extract_all(text, '\S+')) + 1 ELSE len(regexp_extract_all(text, '\S+')) END AS tokens, text AS said FROM w""",
)
def token_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as a stream of token events, put together again at the end of the stream."""
    stream = ev.stream_table(spark, sf_dir, "conversations")
    out = ev.run_to_files(ev.token_events(stream, ["conv_id", "turn"], "text"), files.scratch_path(spark, "tokens"))
    parts = F.array_sort(F.collect_list(F.struct("seq", "delta")))
    return out.groupBy("conv_id", "turn").agg(F.count_if(~F.col("done")).alias("tokens"), F.array_join(F.transform(parts, lambda x: x.delta), "").alias("said"))


@query(
    "sm3_patched_stream", "SM3 SM5",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'changed' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 10 <> 4""",
)
def patched_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change events as a stream: the first snapshot as inserts, then the difference to the second; the table they leave is the second."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("v"))
    old, new = o.where("id % 10 <> 3"), o.where("id % 10 <> 4").withColumn("v", F.when(F.col("id") % 7 == 0, "changed").otherwise(F.col("v")))
    top = files.scratch_path(spark, "patches")
    first = old.select(F.lit("insert").alias("op"), "id", "v")
    for patch in (first, mg.snapshot_diff(old, new, "id").select("op", "id", "v")):
        patch.write.mode("append").parquet(f"{top}/in")  # all files of a patch are one batch, as the stream ends before the next patch comes
        ev.apply_patches(ev.read_stream(spark, f"{top}/in", first, 1_000_000), f"{top}/table", "id", f"{top}/checkpoint").awaitTermination()
    return ev.patched_table(spark, f"{top}/table", old)


@query(
    "sm6_job_states", "SM6",
    """WITH RECURSIVE a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, ['queued', 'running', 'hitl_waiting', 'applying', 'completed', 'failed'][(event_id % 6 + 1)::BIGINT] AS asked FROM events),
    f(prev, nxt) AS (VALUES ('', 'queued'), ('queued', 'running'), ('queued', 'failed'), ('running', 'hitl_waiting'), ('running', 'completed'), ('running', 'failed'), ('hitl_waiting', 'applying'), ('hitl_waiting', 'failed'), ('applying', 'completed'), ('applying', 'failed')),
    s AS (SELECT user_id, event_id, r, CASE WHEN asked = 'queued' THEN 'queued' ELSE '' END AS state, asked = 'queued' AS allowed FROM a WHERE r = 1 UNION ALL
          SELECT a.user_id, a.event_id, a.r, CASE WHEN f.nxt IS NOT NULL THEN a.asked ELSE s.state END, f.nxt IS NOT NULL FROM s JOIN a ON a.user_id = s.user_id AND a.r = s.r + 1 LEFT JOIN f ON f.prev = s.state AND f.nxt = a.asked)
    SELECT user_id AS review_id, event_id AS seq, nullif(state, '') AS state, allowed FROM s""",
)
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to review jobs as a stream with a state a job: what does not follow from it changes nothing."""
    e = table(spark, sf_dir, "events")
    names = F.array(*map(F.lit, ("queued", "running", "hitl_waiting", "applying", "completed", "failed")))
    asked = e.select(F.col("user_id").cast("string").alias("review_id"), F.col("event_id").alias("seq"), F.element_at(names, (F.col("event_id") % 6 + 1).cast("int")).alias("asked"))
    top = files.scratch_path(spark, "jobs")
    asked.write.parquet(f"{top}/in")
    return ev.run_to_files(ev.job_states(ev.read_stream(spark, f"{top}/in", asked, 1_000_000)), top).select(F.col("review_id").cast("long").alias("review_id"), "seq", "state", "allowed")


@query(
    "sm6_ordered_states", "SM6 SM1",
    """WITH RECURSIVE a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, ['queued', 'running', 'hitl_waiting', 'applying', 'completed', 'failed'][(event_id % 6 + 1)::BIGINT] AS asked FROM events),
    f(prev, nxt) AS (VALUES ('', 'queued'), ('queued', 'running'), ('queued', 'failed'), ('running', 'hitl_waiting'), ('running', 'completed'), ('running', 'failed'), ('hitl_waiting', 'applying'), ('hitl_waiting', 'failed'), ('applying', 'completed'), ('applying', 'failed')),
    s AS (SELECT user_id, event_id, r, CASE WHEN asked = 'queued' THEN 'queued' ELSE '' END AS state, asked = 'queued' AS allowed FROM a WHERE r = 1 UNION ALL
          SELECT a.user_id, a.event_id, a.r, CASE WHEN f.nxt IS NOT NULL THEN a.asked ELSE s.state END, f.nxt IS NOT NULL FROM s JOIN a ON a.user_id = s.user_id AND a.r = s.r + 1 LEFT JOIN f ON f.prev = s.state AND f.nxt = a.asked)
    SELECT user_id AS review_id, r AS seq, nullif(state, '') AS state, allowed FROM s""",
)
def ordered_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same requests numbered within each job, arriving out of order over several batches: held back until their turn."""
    e = table(spark, sf_dir, "events")
    names = F.array(*map(F.lit, ("queued", "running", "hitl_waiting", "applying", "completed", "failed")))
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    asked = e.select(F.col("user_id").cast("string").alias("review_id"), seq.alias("seq"), F.element_at(names, (F.col("event_id") % 6 + 1).cast("int")).alias("asked"), F.pmod(F.xxhash64("event_id"), F.lit(3)).alias("batch"))
    top = files.scratch_path(spark, "ordered")
    asked.repartition(3, "batch").drop("batch").write.parquet(f"{top}/in")
    stream = ev.read_stream(spark, f"{top}/in", asked.drop("batch"), 1)
    return ev.run_to_files(ev.ordered_states(stream), top).select(F.col("review_id").cast("long").alias("review_id"), "seq", "state", "allowed")


@query(
    "wf6_collection_run", "WF6 WF8",
    """WITH s AS (SELECT c_custkey, count(o_orderkey) AS orders, coalesce(sum(n), 0) AS items FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1)
    SELECT CASE WHEN orders = 0 THEN 'no_scope' WHEN items = 0 THEN 'no_detail' ELSE 'complete' END AS outcome, count(*) AS roots, sum(orders)::BIGINT AS listed, sum(items)::BIGINT AS details FROM s GROUP BY 1""",
)
def collection_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over all roots: scope, list, details, and how each root came out."""
    details = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    listed = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(details, "o_orderkey", "left")
    per_root = listed.groupBy("c_custkey").agg(F.count("*").alias("orders"), F.coalesce(F.sum("n"), F.lit(0)).alias("items"))
    rows = table(spark, sf_dir, "customer").select("c_custkey").join(per_root, "c_custkey", "left").fillna(0)
    outcome = F.when(F.col("orders") == 0, "no_scope").when(F.col("items") == 0, "no_detail").otherwise("complete")
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("roots"), F.sum("orders").alias("listed"), F.sum("items").alias("details"))


@query(
    "fn17_payload_record", "FN17 FN18 FN19",
    """SELECT event_id, coalesce(nullif(trim(json_extract_string(props, '$.page')), ''), nullif(trim(json_extract_string(props, '$.ref')), '')) AS title, CASE WHEN trim(props) IN ('', '{}') THEN 'empty' WHEN coalesce(nullif(trim(json_extract_string(props, '$.page')), ''), nullif(trim(json_extract_string(props, '$.ref')), '')) IS NULL THEN 'image_only' ELSE 'text' END AS kind FROM events""",
)
def payload_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record's title by whichever of its keys is filled, and whether there is any text in it."""
    fields = F.from_json(tx.text_of(F.col("props")), "map<string,string>")
    at = lambda k: F.try_element_at(fields, F.lit(k))
    title = tx.first_filled(at("page"), at("ref"))
    empty = F.trim(tx.text_of(F.col("props"))).isin("", "{}")
    return table(spark, sf_dir, "events").select("event_id", title.alias("title"), F.when(empty, "empty").when(title.isNull(), "image_only").otherwise("text").alias("kind"))
