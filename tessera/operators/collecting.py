"""Collection steps: what a paged source returns, which requests are sound, which candidates and extractions stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import filled, squeeze, text_of
from tessera.operators.retrieval import small


def until_short_page(rows: DataFrame, page: str, size: int) -> DataFrame:
    """Rows up to the first page that is not full; a page that is missing counts as empty, and ends the list before it."""
    counts = rows.groupBy(page).agg(F.count("*").alias("_n"))
    w = Window.orderBy(page)  # one row a page
    run = counts.withColumns({"_gap": F.col(page) - F.row_number().over(w), "_first": F.min(page).over(w)})
    last = run.agg(F.min(F.when((F.col("_n") < size) | (F.col("_gap") != F.col("_first") - 1), F.struct(page, (F.col("_gap") != F.col("_first") - 1).alias("gap")))).alias("_l"))
    stop = F.col("_l").isNull() | (F.col(page) < F.col(f"_l.{page}")) | ((F.col(page) == F.col(f"_l.{page}")) & ~F.col("_l.gap"))
    return rows.join(F.broadcast(last), stop).drop("_l")  # one row


def wanted_items(rows: DataFrame, kind: str, title: str, excluded: tuple[str, ...], keyword: Column) -> DataFrame:
    """Items whose kind contains none of the excluded words and whose title holds the keyword; a blank kind or title passes."""
    out = rows
    for word in excluded:
        out = out.where(filled(F.col(kind)).isNull() | ~F.contains(F.col(kind), F.lit(word)))
    return out.where(filled(F.col(title)).isNull() | F.contains(F.col(title), keyword))


def first_of_keys(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by the order; one aggregate, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    got = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return got.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def response_format(content_type: Column, body: Column) -> Column:
    """json, xml, html or text: by the content type, else by how the body begins."""
    kind, text = F.lower(text_of(content_type)), F.trim(text_of(body))
    by_type = F.when(kind.contains("json"), "json").when(kind.contains("xml"), "xml").when(kind.contains("html"), "html")
    by_body = F.when(text.rlike(r"^[\[{]"), "json").when(text.rlike(r"(?i)^<(?:!doctype html|html)"), "html").when(text.startswith("<"), "xml")
    return F.coalesce(by_type, by_body, F.lit("text"))


def is_error_payload(body: Column) -> Column:
    """An object with a msg and nothing but result and msg."""
    keys = F.map_keys(F.from_json(text_of(body), "map<string,string>"))
    return F.coalesce(F.array_contains(keys, "msg") & (F.size(F.array_except(keys, F.array(F.lit("result"), F.lit("msg")))) == 0), F.lit(False))


def request_faults(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """Requests (endpoint, params: map) with what is wrong with them. registry: endpoint, enabled, required, one_of (arrays of names) and
    conditional (array of struct given, then: if `given` is there, `then` must be); a small table.

    faults: unknown_endpoint, disabled, missing:name, one_of:a|b, needs:name; an empty array means the request may be sent.
    """
    rows = requests.join(small(registry), "endpoint", "left")
    names = F.map_keys(F.map_filter("params", lambda k, v: filled(v).isNotNull()))
    none = F.array().cast("array<string>")
    missing = F.transform(F.array_except("required", names), lambda n: F.concat(F.lit("missing:"), n))
    one_of = F.when((F.size("one_of") > 0) & ~F.arrays_overlap("one_of", names), F.array(F.concat(F.lit("one_of:"), F.array_join("one_of", "|"))))
    needs = F.transform(F.filter("conditional", lambda c: F.array_contains(names, c["given"]) & ~F.array_contains(names, c["then"])), lambda c: F.concat(F.lit("needs:"), c["then"]))
    checks = F.concat(F.coalesce(missing, none), F.coalesce(one_of, none), F.coalesce(needs, none))
    faults = F.when(F.col("enabled").isNull(), F.array(F.lit("unknown_endpoint"))).when(~F.col("enabled"), F.array(F.lit("disabled"))).otherwise(checks)
    return rows.select(*requests.columns, faults.alias("faults"))


def asset_candidates(links: DataFrame, base: str, known: DataFrame) -> DataFrame:
    """Links (id, link) as typed assets with absolute addresses, each address once for an id; `known` addresses are used again."""
    link = F.trim("link")
    url = F.when(link.rlike("^https?://"), link).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(link, "^/+", "")))
    extension = F.lower(F.regexp_extract(url, r"\.([A-Za-z0-9]{2,5})(?:[?#].*)?$", 1))
    kind = F.when(extension == "pdf", "pdf").when(extension.isin("hwp", "hwpx"), "hwp").when(extension.isin("png", "jpg", "jpeg", "gif"), "image").otherwise("other")
    rows = links.where(filled(F.col("link")).isNotNull()).select("id", url.alias("url"), kind.alias("kind")).distinct()
    return rows.join(known.select("url", F.lit(True).alias("_k")).distinct(), "url", "left").select("id", "url", "kind", F.when(F.col("_k"), "reuse").otherwise("download").alias("action"))


def extraction_score(text: Column) -> Column:
    """What an extracted text holds: characters, lines twice, signs of tables four times."""
    lines = F.size(F.filter(F.split(text_of(text), "\n"), lambda x: F.trim(x) != ""))
    return F.length(squeeze(text)) + 2 * lines + 4 * F.regexp_count(text_of(text), F.lit(r"[│┃|]|\t| {3,}"))


def best_extraction(candidates: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """id, extractor, score of the best extraction (id, extractor, text) of each id; ties go by the order of extractors."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("extractor"))
    rows = candidates.select("id", "extractor", extraction_score(F.col("text")).cast("long").alias("score"), place.alias("_p"))
    return rows.groupBy("id").agg(F.max_by(F.struct("extractor", "score"), F.struct("score", -F.col("_p"))).alias("b")).select("id", "b.extractor", "b.score")


def paragraph_rows(docs: DataFrame, id_col: str, text_col: str, page_chars: int) -> DataFrame:
    """A document's lines as paragraphs: place, page (by characters before it), and features of each."""
    lines = F.split(text_of(F.col(text_col)), "\n")
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(lines).alias("place", "line"))
    before = Window.partitionBy("id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    n, upper = F.length("line"), F.length(F.regexp_replace("line", r"[^\p{Lu}]", ""))
    align = F.when(F.col("line").rlike(r"^\s{4,}\S.*\S\s{4,}$"), "center").when(F.col("line").rlike(r"^\s{8,}\S"), "right").otherwise("left")
    out = rows.withColumn("_at", F.coalesce(F.sum(n + 1).over(before), F.lit(0)))
    return out.select("id", "place", (F.floor(F.col("_at") / page_chars) + 1).cast("long").alias("page"), align.alias("align"), F.col("line").rlike(r"[│┃|]").alias("table"), F.round(upper / F.greatest(n, F.lit(1)), 4).alias("upper"))


def target_status(rows: DataFrame, target: str, enabled: dict[str, bool]) -> DataFrame:
    """skip: null for an enabled target, else why it is left out."""
    table = F.create_map(*[x for k, v in enabled.items() for x in (F.lit(k), F.lit(v))])
    on = F.try_element_at(table, F.col(target))
    return rows.withColumn("skip", F.when(on.isNull(), "unknown_target").when(~on, "target_disabled"))


def hydrate(candidates: DataFrame, details: DataFrame, known: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """case_id, source, status of one row for each candidate group (case_id, source): the primary source by order; its row is
    reused if known, fetched if there is a detail, else missing. details, known: case_id."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col("source")), F.lit(0)), F.lit(len(order) + 1))
    primary = candidates.groupBy("case_id").agg(F.min_by("source", F.struct(place.alias("p"), F.col("source"))).alias("source"), F.count("*").alias("n"))
    have = lambda df, c: df.select("case_id", F.lit(True).alias(c)).distinct()
    rows = primary.join(have(known, "_known"), "case_id", "left").join(have(details, "_detail"), "case_id", "left")
    return rows.select("case_id", "source", "n", F.when(F.col("_known"), "reused").when(F.col("_detail"), "fetched").otherwise("missing").alias("status"))


def else_legacy(canonical: DataFrame, legacy: DataFrame) -> DataFrame:
    """The canonical rows, or the legacy rows where there are none; decided in the plan, by one row."""
    some = canonical.limit(1).agg(F.count("*").alias("_some"))
    return canonical.unionByName(legacy.join(F.broadcast(some), F.col("_some") == 0).drop("_some"))


def whole_families(parents: DataFrame, children: DataFrame, key: str, sound: Column) -> tuple[DataFrame, DataFrame]:
    """Parents and children as one write would leave them: a parent with an unsound child is rolled back with all its children."""
    bad = children.where(~F.coalesce(sound, F.lit(False))).select(key).distinct()
    kept = parents.join(bad, key, "left_anti")
    return kept, children.join(kept.select(key), key, "left_semi")


def update_given(rows: DataFrame, patch: DataFrame, key: str, json_column: str | None = None) -> DataFrame:
    """Rows with the patch's non-null fields; a JSON column is merged by its keys, the patch's winning."""
    p = patch.select(key, *[F.col(c).alias(f"_p_{c}") for c in patch.columns if c != key])
    out = rows.join(p, key, "left")
    for c in patch.columns:
        if c == json_column:
            old, new = (F.from_json(F.coalesce(x, F.lit("{}")), "map<string,string>") for x in (c, f"_p_{c}"))
            kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k))  # noqa: B023
            merged = F.array_sort(F.map_entries(F.map_concat(kept, new)))
            out = out.withColumn(c, F.when(F.col(f"_p_{c}").isNull(), F.col(c)).otherwise(F.to_json(F.map_from_entries(merged))))
        elif c != key:
            out = out.withColumn(c, F.coalesce(f"_p_{c}", c))
    return out.select(*rows.columns)


def preview_html(text: Column, marks: Column) -> Column:
    """The escaped text with <mark> around each annotation (array of struct start, finish, label: code points, in order); one
    that is empty, out of bounds or overlaps the one before it is left out."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    size = F.length(text_of(text))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("html"))

    def add(acc: Column, m: Column) -> Column:
        ok = (m.start >= acc.at) & (m.finish > m.start) & (m.finish <= size)
        more = F.concat(acc.html, escape(F.substring(text_of(text), acc.at + 1, m.start - acc.at)), F.lit('<mark class="'), m.label, F.lit('">'), escape(F.substring(text_of(text), m.start + 1, m.finish - m.start)), F.lit("</mark>"))
        return F.when(ok, F.struct(m.finish.cast("int").alias("at"), more.alias("html"))).otherwise(acc)

    return F.aggregate(marks, start, add, lambda acc: F.concat(acc.html, escape(F.substring(text_of(text), acc.at + 1, size))))
