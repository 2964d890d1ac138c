"""Text, identifier and rule functions as column expressions. Blank strings count as null where a first value is sought."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"


def text_of(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def squeeze(c: Column) -> Column:
    """White space of any kind as one space, none at the ends."""
    return F.trim(F.regexp_replace(text_of(c), SPACE, " "))


def filled(c: Column) -> Column:
    """Null for a blank string."""
    return F.when(F.trim(text_of(c)) != "", F.trim(text_of(c)))


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*map(filled, columns))


def tidy_lines(c: Column) -> Column:
    """Each line squeezed, at most one blank line in a row, line feeds only."""
    out = F.regexp_replace(text_of(c), r"\r\n?", "\n")
    out = F.regexp_replace(out, r"[ \t\f\x0B]+", " ")
    out = F.regexp_replace(out, r" ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def without_images(c: Column, keep_lines: bool = False) -> Column:
    plain = F.regexp_replace(text_of(c), r"(?i)<img[^>]*/?>", "")
    return tidy_lines(plain) if keep_lines else squeeze(plain)


def shorten(c: Column, limit: int = 320) -> Column:
    """Squeezed, and cut to `limit` characters with an ellipsis as the last."""
    plain = squeeze(c)
    return F.when(F.length(plain) <= limit, plain).otherwise(F.concat(F.rtrim(F.substring(plain, 1, limit - 1)), F.lit("…")))


def preview(text: Column, anchor: Column, limit: int = 120, before: int = 40) -> Column:
    """A window around the anchor's first place, or the text's beginning if it is not there."""
    plain = squeeze(text)
    at = F.instr(plain, F.coalesce(anchor, F.lit("")))
    start = F.greatest(at - before, F.lit(1))
    return F.when((at > 0) & (F.coalesce(anchor, F.lit("")) != ""), F.substring(plain, start, at - start + limit)).otherwise(F.substring(plain, 1, limit))


def search_fields(body: Column, *heads: Column) -> dict[str, Column]:
    """search_text: the filled heads and the body, a line each; display_text: the heads and the body cut short."""
    head = F.concat_ws("\n", *[filled(h) for h in heads])
    search = F.concat_ws("\n", *[filled(h) for h in heads], filled(body))
    return {"search_text": F.coalesce(F.when(search != "", search), text_of(body)), "display_text": F.concat_ws("\n", F.when(head != "", head), F.when(shorten(body) != "", shorten(body)))}


def identifier(c: Column) -> Column:
    """A token fit for a composite id; `unknown` for blank."""
    out = F.replace(F.trim(text_of(c)), F.lit("::"), F.lit("-"))
    out = F.regexp_replace(F.regexp_replace(F.translate(out, "ㆍ", "·"), SPACE, "_"), r"[\\/]+", "-")
    return F.when(out == "", "unknown").otherwise(out)


def record_id(*parts: Column) -> Column:
    return F.concat_ws("::", *map(identifier, parts))


def joined_key(*parts: Column, joint: str = "::") -> Column:
    """The parts joined, or null if one is blank."""
    ok = F.lit(True)
    for p in parts:
        ok = ok & filled(p).isNotNull()
    return F.when(ok, F.concat_ws(joint, *map(filled, parts)))


def law_level(kind: Column, existing: Column | None = None) -> Column:
    """Level by kind; other kinds keep the existing level, else their own name."""
    text = F.coalesce(filled(kind), filled(existing) if existing is not None else F.lit(None), F.lit(""))
    level = F.when(text.contains("법률") | (text == "법"), "법").when(text.contains("대통령령") | text.contains("시행령"), "시행령").when(text.contains("부령") | text.contains("규칙"), "시행규칙")
    return F.coalesce(level, F.when(text != "", text), F.lit("기타"))


def family_key(name: Column) -> Column:
    """A name without spaces, dots and quotes, in lower case; null for blank."""
    plain = F.lower(F.regexp_replace(F.translate(text_of(name), "ㆍ·'\"", "··"), r"(?U)[\s·]+", ""))
    return F.when(plain != "", plain)


def without_param(url: Column, *names: str) -> Column:
    """The link without these query parameters; the rest stays as it is written."""
    keys = "|".join(names)
    out = F.regexp_replace(text_of(url), rf"(?i)([?&])(?:{keys})=[^&#\s]*", "$1")
    out = F.regexp_replace(out, r"([?&])&+", "$1")
    return filled(F.regexp_replace(F.regexp_replace(out, r"[?&]+(?=#)", ""), r"[?&]+$", ""))


def article_number(text: Column) -> dict[str, Column]:
    """main, branch, key and display of an article number like 0012의3, 12-3 or 제12조의3; leading zeros go."""
    pattern = r"(\d+)\s*조?(?:\s*(?:의|-)\s*(\d+))?"
    plain = lambda i: F.regexp_replace(F.regexp_extract(text_of(text), pattern, i), r"^0+(?=\d)", "")
    main = F.when(plain(1) != "", plain(1))
    branch = F.when((plain(2) != "") & (plain(2) != "0"), plain(2))
    return {
        "main": main,
        "branch": branch,
        "key": F.concat_ws("-", main, branch),
        "display": F.when(main.isNotNull(), F.concat(F.lit("제"), main, F.lit("조"), F.coalesce(F.concat(F.lit("의"), branch), F.lit("")))),
    }


def article_code(number: Column, branch: Column | None = None) -> Column:
    """Six digits: four of the article, two of the branch."""
    return F.concat(F.lpad(number.cast("string"), 4, "0"), F.lpad(F.coalesce(branch.cast("string") if branch is not None else F.lit(None), F.lit("0")), 2, "0"))


def file_name(c: Column) -> Column:
    return F.regexp_replace(F.trim(text_of(c)), r"(?U)[^\w가-힣.-]+", "_")


def filled_lines(c: Column) -> Column:
    return F.filter(F.split(text_of(c), "\n"), lambda x: F.trim(x) != "")


def content_class(c: Column) -> Column:
    """table, list, empty or narrative, by the shape of the lines."""
    lines = filled_lines(c)
    n = F.size(lines)
    tabular = F.size(F.filter(lines, lambda x: x.rlike(r"[│┃|]|\t| {3,}")))
    listed = F.size(F.filter(lines, lambda x: x.rlike(r"^\s*(?:[-*•]|\d{1,3}[.)])\s")))
    return F.when(n == 0, "empty").when(tabular * 2 >= n, "table").when((listed * 2 >= n) & (n > 1), "list").otherwise("narrative")


def in_scope_reason(kind: Column, title: Column, key: Column, out: tuple[str, ...], keep: tuple[str, ...]) -> Column:
    """Why a part is left out, by ordered rules; null if it stays."""
    has = lambda c, words: F.coalesce(text_of(c).rlike("|".join(words)), F.lit(False))
    suffix = F.upper(F.trim(text_of(key)))
    return (
        F.when(has(kind, out), "excluded_non_target_kind")
        .when(has(title, out), "excluded_non_target_title")
        .when(has(kind, keep) | has(title, keep), F.lit(None))
        .when(suffix.endswith("F"), "excluded_non_target_key_suffix")
        .when(suffix.endswith("E"), F.lit(None))
        .otherwise("excluded_not_identified_as_annex_table")
    )


#: Numbering rules of clause starts, in order of priority.
CLAUSE_RULES = {
    "article_kr": r"^제\s*(\d+)\s*조",
    "article_en": r"(?i)^(?:article|section|clause)\s+(\d+)",
    "numeric_dot": r"^(\d+)\.\s",
    "numeric_paren": r"^(\d+)\)\s",
    "circled": r"^([①-⑳])",
}


def numbering(c: Column) -> tuple[Column, Column]:
    """(rule, number) of the first numbering rule that a paragraph's start matches."""
    text = F.trim(text_of(c))
    rule, number = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, pattern in reversed(CLAUSE_RULES.items()):
        hit = text.rlike(pattern)
        rule, number = F.when(hit, name).otherwise(rule), F.when(hit, F.regexp_extract(text, pattern, 1)).otherwise(number)
    return rule, number


def paragraph_category(c: Column, before_first: Column) -> Column:
    """title, heading, clause, signature, preamble, table or body, by ordered rules."""
    text = F.trim(text_of(c))
    rule, _ = numbering(text)
    return (
        F.when(text == "", "empty")
        .when(text.rlike(r"[│┃|].*[│┃|]"), "table")
        .when(rule.isNotNull(), "clause_start")
        .when(text.rlike(r"(?i)\b(?:signature|signed by|in witness)\b|서명|날인"), "signature")
        .when(before_first & (F.length(text) <= 40), "title")
        .when(before_first, "preamble")
        .otherwise("body")
    )


#: Risk levels from least to most, and their other names.
RISK_ORDER = ("none", "low", "mid", "high", "crit")
RISK_ALIASES = {"medium": "mid", "moderate": "mid", "critical": "crit", "severe": "crit", "minor": "low", "major": "high"}


def risk_level(c: Column) -> Column:
    key = F.lower(F.trim(text_of(c)))
    names = F.create_map(*[F.lit(x) for a, b in {**{r: r for r in RISK_ORDER}, **RISK_ALIASES}.items() for x in (a, b)])
    return F.coalesce(F.try_element_at(names, key), F.lit("mid"))


def answer_flag(c: Column) -> tuple[Column, Column]:
    """(answer, answerable): a trailing [ANSWERABLE:yes/no] is split off; without one it counts as yes."""
    pattern = r"(?i)\s*\[ANSWERABLE:\s*(yes|no)\s*\]\s*$"
    return F.regexp_replace(text_of(c), pattern, ""), F.lower(F.regexp_extract(text_of(c), pattern, 1)) != "no"


def suggestions(c: Column, most: int = 4) -> Column:
    """Filled strings of the first JSON list in a text, at most four; empty if there is none."""
    found = F.from_json(F.regexp_extract(text_of(c), r"(?s)(\[.*\])", 1), "array<string>")
    return F.slice(F.coalesce(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>")), 1, most)


def ordered_union(*arrays: Column) -> Column:
    """Filled, trimmed strings of all arrays, each once, in order of first place."""
    every = F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays])
    return F.array_distinct(F.filter(F.transform(every, lambda x: F.trim(x)), lambda x: x != ""))


def id_within(c: Column, limit: int = 512) -> Column:
    return F.when(F.octet_length(c) <= limit, c).otherwise(F.concat(F.lit("sha1::"), F.sha1(c)))


def numeric_id(c: Column) -> Column:
    """Unsigned 64-bit number from the first 16 hex digits of the SHA-1."""
    return F.conv(F.substring(F.sha1(c), 1, 16), 16, 10).cast("decimal(20,0)")


def token_estimate(c: Column, chars_per_token: float = 2.5) -> Column:
    return F.ceil(F.length(text_of(c)) / F.lit(chars_per_token)).cast("long")


def guard_violations(query: Column, relations: tuple[str, ...], depth: int = 5) -> Column:
    """What is wrong with a graph query: writing words, relation types not allowed, unbounded or too deep paths."""
    text = text_of(query)
    kinds = F.transform(F.regexp_extract_all(text, F.lit(r"\[[^\]]*?:([A-Z_|]+)"), F.lit(1)), lambda x: F.split(x, r"\|"))
    unknown = F.array_except(F.flatten(kinds), F.array(*map(F.lit, relations)))
    bounds = F.regexp_extract_all(text, F.lit(r"\*\s*(?:\d*\s*\.\.)?\s*(\d*)"), F.lit(1))
    rules = F.array(
        F.when(text.rlike(r"(?i)\b(?:create|merge|delete|detach|set|remove|drop|call|load|foreach)\b"), "forbidden_keyword"),
        F.when(F.size(unknown) > 0, "relation_not_allowed"),
        F.when(F.exists(bounds, lambda x: (x == "") | (F.try_to_number(x, F.lit("999")) > depth)), "depth"),
    )
    return F.filter(rules, lambda x: x.isNotNull())


def case_numbers(c: Column, exclude: Column | None = None) -> Column:
    """Case numbers in a text, each once, in order, but for those excluded."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(text_of(c), F.lit(r"(?:19|20)?\d{2}\s*[가-힣]{1,3}\s*\d{1,6}"), F.lit(0)), lambda x: F.regexp_replace(x, SPACE, "")))
    return found if exclude is None else F.array_except(found, F.coalesce(exclude, F.array().cast("array<string>")))
