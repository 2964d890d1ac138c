"""Statute trees, appendices, text variants and article order as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import article_number, content_class, filled, first_filled, squeeze, text_of

#: Fixed value: the entry of an allow-list that stands for both levels below a law.
DIRECT_RULES = "직속하위법령"


def field_text(body: Column, names: tuple[str, ...]) -> Column:
    """The first filled field of a JSON object by name."""
    fields = F.from_json(text_of(body), "map<string,string>")
    return F.coalesce(*[filled(F.try_element_at(fields, F.lit(n))) for n in names], F.lit(""))


def allowed_level(level: Column, allowed: tuple[str, ...]) -> Column:
    """Whether a level is on the allow-list; an empty list allows all."""
    if not allowed:
        return F.lit(True)
    return level.isin(*allowed) | (F.lit(DIRECT_RULES in allowed) & level.isin("시행령", "시행규칙"))


def distinct_parts(parts: DataFrame, keys: list[str]) -> DataFrame:
    return parts.dropDuplicates(keys)


def searchable_part(title: Column, body: Column) -> Column:
    """A narrative part that says more than its title."""
    return (content_class(body) == "narrative") & (F.trim(text_of(title)) != F.trim(text_of(body)))


def table_layout(docs: DataFrame, id_col: str, text_col: str, mark: str) -> DataFrame:
    """Of each text's table lines: the most frequent number of columns (of equal counts the larger), how many have it, and how
    many there are. Counts are combined before the shuffle."""
    lines = docs.select(id_col, F.explode(F.split(text_of(F.col(text_col)), "\n")).alias("line")).where(F.contains("line", F.lit(mark)))
    counts = lines.groupBy(id_col, (F.size(F.split("line", f"\\Q{mark}\\E", -1))).cast("long").alias("columns")).agg(F.count("*").alias("times"))
    best = counts.groupBy(id_col).agg(F.max_by("columns", F.struct("times", "columns")).alias("columns"), F.max("times").alias("times"), F.sum("times").alias("rows"))
    return best.select(id_col, "columns", "times", "rows")


def article_sort_key(no: Column) -> tuple[Column, Column]:
    """(number, branch) of an article as numbers, the branch 0 if it has none."""
    parts = article_number(no)
    return parts["main"].cast("long").alias("sort_main"), F.coalesce(parts["branch"].cast("long"), F.lit(0)).alias("sort_branch")


_LEAF = "struct<no:string,text:string>"
_ITEM = "struct<no:string,text:string,subitems:string>"
_PARAGRAPH = "struct<no:string,text:string,items:string>"


def units(body: Column, kind: str) -> Column:
    """A JSON list of objects, or a single object, as an array."""
    text = F.trim(text_of(body))
    one = F.when(text.startswith("{"), F.array(F.from_json(text, kind)))
    return F.coalesce(F.when(text.startswith("["), F.from_json(text, f"array<{kind}>")), one, F.array().cast(f"array<{kind}>"))


def article_tree(body: Column) -> Column:
    """An article's JSON as a typed tree: paragraphs, their items, and theirs; each level a list or a single object."""
    article = F.from_json(text_of(body), "struct<no:string,title:string,paragraphs:string>")
    items = lambda p: F.transform(units(p["items"], _ITEM), lambda i: F.struct(i["no"].alias("no"), i["text"].alias("text"), units(i["subitems"], _LEAF).alias("subitems")))
    paragraphs = F.transform(units(article["paragraphs"], _PARAGRAPH), lambda p: F.struct(p["no"].alias("no"), p["text"].alias("text"), items(p).alias("items")))
    return F.struct(article["no"].alias("no"), article["title"].alias("title"), paragraphs.alias("paragraphs"))


def _line(depth: int, unit: Column) -> Column:
    return F.concat(F.lit("  " * depth), F.concat_ws(" ", filled(unit["no"]), filled(unit["text"])))


def tree_text(tree: Column) -> Column:
    """The tree as lines, two blanks in a level."""
    sub = lambda i: F.transform(i["subitems"], lambda s: _line(3, s))
    item = lambda p: F.flatten(F.transform(p["items"], lambda i: F.concat(F.array(_line(2, i)), sub(i))))
    below = F.flatten(F.transform(tree["paragraphs"], lambda p: F.concat(F.array(_line(1, p)), item(p))))
    head = F.concat(tree["no"], F.coalesce(F.concat(F.lit("("), filled(tree["title"]), F.lit(")")), F.lit("")))
    return F.array_join(F.concat(F.array(head), below), "\n")


def tree_parts(tree: Column) -> Column:
    """Paragraphs, items and subitems of the tree."""
    n = F.lit(0)
    under = lambda p: F.aggregate(p["items"], n, lambda acc, i: acc + 1 + F.size(i["subitems"]))
    return F.aggregate(tree["paragraphs"], n, lambda acc, p: acc + 1 + under(p))


def text_variant(raw: Column, clean: Column, variant: str) -> Column:
    """The raw or the clean text, whichever is asked for first and filled."""
    return F.coalesce(first_filled(*((raw, clean) if variant == "raw" else (clean, raw))), F.lit(""))


def unwrapped(c: Column) -> Column:
    """A list that was written out as text, as lines; other text as it is."""
    inner = F.regexp_extract(F.trim(text_of(c)), r"^\[\s*['\"](.*)['\"]\s*\]$", 1)
    return F.when(inner != "", F.array_join(F.split(inner, r"['\"]\s*,\s*['\"]"), "\n")).otherwise(text_of(c))


def marker_forms(kind: Column, no: Column) -> Column:
    """The ways an appendix's marker is written."""
    return F.array_distinct(F.array(F.concat_ws(" ", kind, no), F.concat(kind, no), F.concat(F.lit("["), F.concat_ws(" ", kind, no), F.lit("]"))))


def bundle_text(kind: Column, no: Column, sections: Column) -> Column:
    """An appendix's marker and its filled sections, each once, as lines."""
    kept = F.array_distinct(F.filter(F.transform(sections, lambda s: F.trim(text_of(s))), lambda s: s != ""))
    return F.array_join(F.concat(F.array(F.concat(F.lit("["), F.concat_ws(" ", kind, no), F.lit("]"))), kept), "\n")


def appendix_class(title: Column, text: Column) -> Column:
    """form (by its title), image_only (no text), table or text."""
    shape = content_class(text)
    return F.when(text_of(title).rlike("별지|서식"), "form").when(shape == "empty", "image_only").when(shape == "table", "table").otherwise("text")


def text_source(kind: Column) -> Column:
    """Which of an appendix's texts is used: tables as Markdown, texts as the service gives them, images from their file."""
    return F.when(kind == "form", "none").when(kind == "table", "markdown").when(kind == "image_only", "asset").otherwise("api")


def appendix_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, variant, part, value: a raw, a clean and a row for each table line; empty ones are left out."""
    text = text_of(F.col(text_col))
    part = lambda name, n, v: F.struct(F.lit(name).alias("variant"), n.cast("long").alias("part"), v.alias("value"))
    tables = F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit("|")))
    rows = F.concat(F.array(part("raw", F.lit(0), text), part("clean", F.lit(0), squeeze(text))), F.transform(tables, lambda x, i: part("table", i, x)))
    return docs.select(id_col, F.explode(rows).alias("r")).select(id_col, "r.*").where(F.trim("value") != "")


def with_defaults(rows: DataFrame, texts: dict[str, str], numbers: dict[str, float]) -> DataFrame:
    """Blank texts and numbers that can't be read get their defaults; numbers may be written as text, whole ones with a fraction."""
    out = rows.withColumns({c: F.coalesce(filled(F.col(c)), F.lit(v)) for c, v in texts.items()})
    read = lambda c, v: F.coalesce(F.trim(c).try_cast("double"), F.lit(float(v))).cast("int" if isinstance(v, int) else "double")
    return out.withColumns({c: read(F.col(c), v) for c, v in numbers.items()})


def by_model(templates: dict[str, str], other: str, fields: tuple[str, ...]) -> Column:
    """The template of the row's model with its fields put in."""

    def fill(template: str) -> Column:
        out = F.lit(template)
        for f in fields:
            out = F.replace(out, F.lit("{" + f + "}"), text_of(F.col(f)))
        return out

    made = None
    for model, template in templates.items():
        made = F.when(F.col("model") == model, fill(template)) if made is None else made.when(F.col("model") == model, fill(template))
    return made.otherwise(fill(other))


def looked_up(table: dict[str, str], c: Column, other: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c), F.lit(other))


def cut_to_tokens(c: Column, tokens: int, chars_per_token: float = 2.5) -> Column:
    """The text's first `tokens` tokens by the rough estimate."""
    return F.substring(text_of(c), 1, int(tokens * chars_per_token))

