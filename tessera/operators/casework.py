"""Review work: suspects and their blocks, boundary decisions, findings, edits, attempts and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import RISK_ORDER, filled, risk_level, text_of


def suspects(paragraphs: DataFrame, doc: str, order: str, rules: dict[str, Column], heading: Column) -> DataFrame:
    """suspect and why for each paragraph (with its clause; null outside): all filled members of a document's last clause, and
    members that meet a rule and are no heading."""
    last = F.max("clause").over(Window.partitionBy(doc))
    hits = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    inside = F.col("clause").isNotNull() & (F.trim(text_of(F.col("text"))) != "")
    why = F.when(inside & (F.col("clause") == F.col("_last")), F.array(F.lit("last_clause"))).when(inside & ~heading, hits).otherwise(F.array().cast("array<string>"))
    out = paragraphs.withColumn("_last", last).withColumn("why", F.array_join(why, ",")).drop("_last")
    return out.withColumn("suspect", F.col("why") != "")


def review_blocks(rows: DataFrame, doc: str, order: str) -> DataFrame:
    """One block for each clause with suspects: from one paragraph before its first suspect to one behind its last. order: whole
    numbers without gaps, from `low` to `high` in a document."""
    ends = rows.groupBy(doc).agg(F.min(order).alias("_low"), F.max(order).alias("_high"))
    blocks = rows.where("suspect").groupBy(doc, "clause").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("suspects"))
    blocks = blocks.join(ends, doc)
    return blocks.select(doc, "clause", "suspects", F.greatest(F.col("first") - 1, "_low").alias("first"), F.least(F.col("last") + 1, "_high").alias("last"))


def apply_boundaries(rows: DataFrame, reviews: DataFrame, keys: list[str]) -> DataFrame:
    """Paragraphs (clause, suspect, text) after reviews (action, anchor): keep clears the mark, detach takes the paragraph out of its
    clause, split at the anchor's first place hands the rest on as a second part; an anchor at the very start or not there changes nothing."""
    joined = rows.join(reviews, keys, "left")
    at = F.when(F.col("action") == "split", F.instr(text_of(F.col("text")), F.coalesce("anchor", F.lit("")))).otherwise(0)
    at = F.when(filled(F.col("anchor")).isNull(), 0).otherwise(at)
    cut = at > 1
    text = text_of(F.col("text"))
    part = lambda n, t, clause: F.struct(F.lit(n).alias("part"), t.alias("piece"), clause.alias("in_clause"))
    clause = F.when(F.col("action") == "detach", F.lit(None)).otherwise(F.col("clause"))
    parts = F.when(cut, F.array(part(0, F.substring(text, F.lit(1), at - 1), clause), part(1, F.substring(text, at, F.length(text)), F.lit(None).cast("long")))).otherwise(F.array(part(0, text, clause)))
    still = F.col("suspect") & ~F.coalesce(F.col("action").isin("keep", "detach") | cut, F.lit(False))
    return joined.select(*keys, still.alias("suspect"), F.explode(parts).alias("p")).select(*keys, "suspect", "p.part", F.col("p.in_clause").alias("clause"), "p.piece")


def worst_of(parts: DataFrame, key: str, risk: str) -> DataFrame:
    """key, n, worst: how many parts a key has and their worst risk; combined before the shuffle."""
    place = F.array_position(F.array(*map(F.lit, RISK_ORDER)), F.col(risk))
    return parts.groupBy(key).agg(F.count("*").alias("n"), F.max_by(risk, place).alias("worst"))


def findings(payloads: DataFrame, paragraphs: DataFrame, key: str) -> DataFrame:
    """Payload rows (target, level, source_ids, replacement) as findings: a target that is no paragraph of the key falls back on its first
    one, level none goes, rows without a known source go, and an edit that changes nothing or is blank is dropped.

    paragraphs: key, node, text; sources of a row are the ids in source_ids that are nodes too."""
    first = paragraphs.groupBy(key).agg(F.min("node").alias("_first"), F.array_sort(F.collect_set("node")).alias("_nodes"))
    rows = payloads.withColumn("level", risk_level(F.col("level"))).where("level <> 'none'").join(first, key)
    rows = rows.withColumn("node", F.when(F.array_contains("_nodes", F.col("target")), F.col("target")).otherwise(F.col("_first")))
    rows = rows.withColumn("sources", F.array_intersect("source_ids", "_nodes")).where(F.size("sources") > 0)
    rows = rows.join(paragraphs.select(key, "node", F.col("text").alias("_text")), [key, "node"], "left")
    edit = F.when(filled(F.col("replacement")).isNotNull() & (F.col("replacement") != F.col("_text")), F.col("replacement"))
    return rows.select(key, "finding", "node", "level", F.array_join("sources", ",").alias("sources"), edit.alias("edit"))


def decisions(payload: Column) -> Column:
    """Decisions of a JSON payload as an array of (finding, decision): a list of objects, an object of finding to decision, or a single
    object; entries without a finding or with an unknown decision are skipped."""
    text = F.trim(text_of(payload))
    kind = "struct<finding:string,decision:string>"
    many = F.from_json(text, f"array<{kind}>")
    single = F.from_json(text, kind)
    pairs = F.transform(F.map_entries(F.from_json(text, "map<string,string>")), lambda e: F.struct(e["key"].alias("finding"), e["value"].alias("decision")))
    found = F.when(text.startswith("["), many).when(single["finding"].isNotNull(), F.array(single)).otherwise(pairs)
    return F.filter(F.coalesce(found, F.array().cast(f"array<{kind}>")), lambda d: filled(d["finding"]).isNotNull() & d["decision"].isin("accepted", "rejected", "edited"))


def accepted_edits(rows: DataFrame, target: str, finding: str, level: str) -> DataFrame:
    """One edit a target, that of the highest risk, then of the first finding; the others are conflicts."""
    place = F.array_position(F.array(*map(F.lit, RISK_ORDER)), F.col(level))
    order = Window.partitionBy(target).orderBy(F.desc(place), finding)
    return rows.withColumn("applied", F.row_number().over(order) == 1)


def first_success(attempts: DataFrame, key: str, most: int) -> DataFrame:
    """key, status, tries, answer of calls that are tried again: the first usable answer within `most` tries; repaired if it is not
    the first try's; failed if there is none. attempts: key, attempt (from 1), ok, answer."""
    rows = attempts.where(F.col("attempt") <= most)
    got = rows.groupBy(key).agg(F.min(F.when(F.col("ok"), F.col("attempt"))).alias("_at"), F.max("attempt").alias("_tried"), F.min_by(F.when(F.col("ok"), F.col("answer")), F.when(F.col("ok"), F.col("attempt"))).alias("answer"))
    status = F.when(F.col("_at") == 1, "ok").when(F.col("_at").isNotNull(), "repaired").otherwise("failed")
    return got.select(key, status.alias("status"), F.coalesce("_at", "_tried").alias("tries"), "answer")


def planned(slots: DataFrame, templates: dict[str, tuple[str, tuple[str, ...]]]) -> DataFrame:
    """The query template of each row's intent with its slots put in; null if the intent is unknown or a slot it needs is blank."""
    plan = F.lit(None).cast("string")
    for intent, (template, needs) in templates.items():
        ready, text = F.col("intent") == intent, F.lit(template)
        for slot in needs:
            ready = ready & filled(F.col(slot)).isNotNull()
            text = F.replace(text, F.lit("{" + slot + "}"), F.trim(text_of(F.col(slot))))
        plan = F.when(ready, text).otherwise(plan)
    return slots.withColumn("plan", plan)


def guarded(rows: DataFrame, free: str, relations: tuple[str, ...], plan: str) -> DataFrame:
    """The free-form query if the guard finds nothing wrong with it, else the template's plan; `by` tells which."""
    from tessera.functions.text import guard_violations

    sound = filled(F.col(free)).isNotNull() & (F.size(guard_violations(F.col(free), relations)) == 0)
    return rows.withColumn("query", F.when(sound, F.col(free)).otherwise(F.col(plan))).withColumn("by", F.when(sound, "free").when(F.col(plan).isNotNull(), "template").otherwise("none"))


def tail(events: DataFrame, cursors: DataFrame, key: str, seq: str, terminal: Column) -> DataFrame:
    """Each key's events behind its cursor (0 if it has none), up to and with its first terminal one."""
    ends = events.where(terminal).groupBy(key).agg(F.min(seq).alias("_end"))
    rows = events.join(cursors, key, "left").join(ends, key, "left")
    return rows.where((F.col(seq) > F.coalesce("cursor", F.lit(0))) & (F.col("_end").isNull() | (F.col(seq) <= F.col("_end")))).drop("cursor", "_end")


def second_opinion(rows: DataFrame, label: Column, ambiguous: Column, answers: DataFrame, key: list[str]) -> DataFrame:
    """Labels by rule; ambiguous rows take the answer given for them, else keep the rule's label. asked: the row was put to the model."""
    out = rows.select(*key, label.alias("_rule"), ambiguous.alias("asked")).join(answers, key, "left")
    return out.select(*key, "asked", F.when(F.col("asked"), F.coalesce("answer", "_rule")).otherwise(F.col("_rule")).alias("label"))


def lowest(scores: DataFrame, group: str, score: str, share: float, order: str) -> DataFrame:
    """The lowest-scored share of each group's rows, at least one."""
    w = Window.partitionBy(group)
    rows = scores.withColumns({"_r": F.row_number().over(w.orderBy(score, order)), "_n": F.count("*").over(w)})
    return rows.where(F.col("_r") <= F.greatest(F.floor(F.col("_n") * share), F.lit(1))).drop("_r", "_n")
