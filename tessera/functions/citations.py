"""Citations of articles in statute text, in the JVM: a text becomes an array of tokens and a string of their kinds, a letter each, and the
grammar of citation lists is a regular expression over that string.

    list  = item { link item }
    item  = article { unit } [ range article [ until ] ]

White space may stand between tokens, and nothing else; any other character is a token of its own, so it breaks a list. All steps are
columns of one row: no shuffle and no Python. The forms are those of `references`, whose parser on plain strings serves small
inputs and tests.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.references import CONFIDENCE, LEVELS, NAME_ENDINGS, NAME_WORDS, OFFICES, PARTICLES, POINTER_WORDS, SCOPE_OF_ENDING, VERB_ENDINGS

# The written forms of citations.
ARTICLE = r"제\s*([0-9]+)\s*조(?:\s*의\s*([0-9]+))?"
UNIT = r"제\s*([0-9]+)\s*([항호목])"
POINTER = r"(?:이|같은|동)\s*(법|영|규칙|조례)"
NEAR = r"(전|다음|같은|동)\s*조"
RANGES = ("부터", "내지")
UNTIL = "까지"
LINKS = (",", "·", "/", "및", "또는", "혹은", "와", "과")
WORD = r"[가-힣0-9ㆍ·()]+"
_AHEAD = r"(?=\s*제\s*[0-9])"
SCAN = rf"{ARTICLE}|{UNIT}|{POINTER}{_AHEAD}|{NEAR}(?!례)|(?:{"|".join(RANGES)}){_AHEAD}|{UNTIL}|{"|".join(LINKS[:3])}|(?:{"|".join(LINKS[3:])})(?![가-힣])|{WORD}|\n|[^\s]"

#: Kinds: article, unit, pointer, near, range, until, link, word, line break, other. Line breaks may stand anywhere in a list.
ITEM = "A(?:B*U)*(?:B*RB*A(?:B*T)?)?"
LIST = f"{ITEM}(?:B*LB*{ITEM})*"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _whole(t: Column, form: str) -> Column:
    return t.rlike(rf"^(?:{form})$")


def _kind(tokens: Column) -> Callable[[Column, Column], Column]:
    def kind(t: Column, i: Column) -> Column:
        # a pointer or a range word is one before an article's number only
        ahead = F.concat(F.coalesce(F.get(tokens, i + 1), F.lit("")), F.coalesce(F.get(tokens, i + 2), F.lit(""))).rlike(r"^\n*제\s*[0-9]")
        scope = t.endswith("법") | t.endswith("영") | t.endswith("규칙") | t.endswith("조례")
        return (  # cheap tests first: most tokens are words
            F.when(t.startswith("제") & _whole(t, ARTICLE), "A")
            .when(t.startswith("제") & _whole(t, UNIT), "U")
            .when(t == "\n", "B")
            .when(t == UNTIL, "T")
            .when(t.isin(*LINKS), "L")
            .when(t.isin(*RANGES) & ahead, "R")
            .when(t.endswith("조") & _whole(t, NEAR), "N")
            .when(scope & _whole(t, POINTER) & ahead, "P")
            .when(t.rlike("^[가-힣0-9ㆍ·()]"), "W")
            .otherwise("O")
        )

    return kind


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt out over all cores if they come in fewer partitions: reading a text costs far more than moving it."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if len(rows.inputFiles()) >= cores else rows.repartition(cores)


#: Distinct texts, and characters in them, whose references are broadcast to the rows; beyond it the join shuffles.
TEXTS_SENT, CHARS_SENT = 50_000, 16 << 20


def once(rows: DataFrame, on: dict[str, Column], find: Callable[[DataFrame], DataFrame], out: str = "refs") -> DataFrame:
    """The rows with what `find` says of the columns in `on`, where each combination of their values is read once, however many rows have
    it: reading a text costs a thousand times what comparing it does. If most rows' values are their own, all are read as they are."""
    keyed = rows.withColumns(on)
    each = keyed.select(*on).distinct()
    n, chars = each.agg(F.count("*"), F.coalesce(F.sum(sum((F.coalesce(F.length(c.cast("string")), F.lit(0)) for c in map(F.col, on)), F.lit(0))), F.lit(0))).first()
    if 2 * n > rows.count():
        return find(spread(keyed)).drop(*on)
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    found = find(each.repartition(tasks)).withColumnsRenamed({c: f"_{c}" for c in on})
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on))
    return keyed.join(F.broadcast(found) if n <= TEXTS_SENT and chars <= CHARS_SENT else found, same).select(*rows.columns, out)


def spans(kinds: Column, form: str) -> Column:
    """array of (at, kinds): where the matches of a form begin, from 1, and their letters."""
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<at:int,kinds:string>>").alias("out"))
    pairs = F.arrays_zip(F.split(kinds, form, -1).alias("gap"), F.regexp_extract_all(kinds, F.lit(form), F.lit(0)).alias("hit"))

    def step(acc: Column, p: Column) -> Column:
        at = acc.at + F.length(p.gap)
        out = F.when(p.hit.isNull(), acc.out).otherwise(F.concat(acc.out, F.array(F.struct(at.alias("at"), p.hit.alias("kinds")))))
        return F.struct((at + F.coalesce(F.length(p.hit), F.lit(0))).alias("at"), out.alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc.out)


def _number(article: Column) -> Column:
    """main and branch of an article's text."""
    return F.struct(_digits(F.regexp_extract(article, ARTICLE, 1)).alias("main"), _digits(F.regexp_extract(article, ARTICLE, 2)).alias("branch"))


def _digits(s: Column) -> Column:
    """The number; null for none. (A failed cast costs more than the test.)"""
    return let(s, lambda s: F.when(s != "", s.try_cast("int")))


def _ref(n: Column, units: Column | None = None) -> Column:
    def unit(kind: str) -> Column:
        if units is None:
            return F.lit(None).cast("string")
        return _digits(F.regexp_extract(F.get(F.filter(units, lambda u: u.endswith(kind)), F.lit(0)), UNIT, 1)).cast("string")

    return F.struct(
        F.concat(n.main.cast("string"), F.coalesce(F.concat(F.lit("-"), n.branch.cast("string")), F.lit(""))).alias("key"),
        F.concat(F.lit("제"), n.main.cast("string"), F.lit("조"), F.coalesce(F.concat(F.lit("의"), n.branch.cast("string")), F.lit(""))).alias("display"),
        unit("항").alias("paragraph"), unit("호").alias("item"), unit("목").alias("subitem"),
    )


def _items(tokens: Column, lists: Column) -> Column:
    """The items of lists of (at, kinds): first article, units and last article of each."""

    def item(own: Column) -> Column:
        articles = F.transform(F.filter(own, lambda t: _whole(t, ARTICLE)), _number)
        parts = let(articles, lambda a: F.struct(F.get(a, F.lit(0)).alias("head"), F.get(a, F.lit(1)).alias("tail")))
        return F.struct(parts.alias("n"), F.filter(own, lambda t: _whole(t, UNIT)).alias("units"))

    def of_list(c: Column) -> Column:
        return F.transform(spans(c.kinds, ITEM), lambda x: let(F.slice(tokens, c.at + x.at - 1, F.length(x.kinds)), item))

    return F.flatten(F.transform(lists, of_list))


def _refs(items: Column) -> Column:
    """What items name, each article with its units once: ranges written out first, then single articles."""

    def written(x: Column) -> Column:
        a, b = x.n.head, x.n.tail
        one = lambda main, branch: F.struct(main.alias("main"), branch.alias("branch"))
        return (
            F.when(a.branch.isNull() & b.branch.isNull() & (a.main <= b.main), F.transform(F.sequence(a.main, F.greatest(a.main, b.main)), lambda n: one(n, F.lit(None).cast("int"))))
            .when((a.main == b.main) & (a.branch <= b.branch), F.transform(F.sequence(a.branch, F.greatest(a.branch, b.branch)), lambda n: one(a.main, n)))
            .otherwise(F.array(a, b))
        )

    def of(items: Column) -> Column:
        runs = F.filter(items, lambda x: x.n.tail.isNotNull())
        ranges = F.transform(F.flatten(F.transform(F.filter(runs, lambda x: F.size(x.units) == 0), written)), lambda n: _ref(n))
        single = F.transform(items, lambda x: _ref(x.n.head, x.units))
        return F.array_distinct(F.concat(ranges, single, F.transform(runs, lambda x: _ref(x.n.tail))))

    return let(items, of)


def scanned(rows: DataFrame, text: str | Column) -> DataFrame:
    """The rows with _raw and _t, the tokens with and without the space behind them, _k, their kinds, and _l, the citation lists."""
    text = F.col(text) if isinstance(text, str) else text
    rows = rows.withColumn("_raw", F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?:{SCAN})[^\S\n]*"), F.lit(0)))
    rows = rows.withColumn("_t", F.transform("_raw", lambda t: F.regexp_replace(t, r"[^\S\n]+$", "")))
    rows = rows.withColumn("_k", F.array_join(F.transform("_t", _kind(F.col("_t"))), ""))
    return rows.withColumn("_l", spans(F.col("_k"), LIST))


def _fenced(rows: DataFrame, refs: Column, out: str) -> DataFrame:
    """The rows without the columns on the way, and refs as column `out`. A generator of one row stands between, so conditions on the
    result (as an explode of it implies) are not evaluated beneath, over all steps once more."""
    return rows.select(*[c for c in rows.columns if c not in _STEPS], F.inline(F.array(F.struct(refs.alias(out)))))


#: Columns on the way to references.
_STEPS = ("_raw", "_t", "_k", "_l", "_i", "_n", "_e", "_law", "_family", "_order", "_s", "_w", "_a", "_all")


def article_refs(rows: DataFrame, text: str | Column, out: str = "refs") -> DataFrame:
    """The rows with the articles that a text names: key, display form, paragraph, item and subitem."""
    found = scanned(rows, text).withColumn("_i", _items(F.col("_t"), F.col("_l")))
    return _fenced(found, _refs(F.col("_i")), out)


def _ends_with(word: Column, endings: tuple[str, ...]) -> Column:
    return word.rlike("(?:" + "|".join(endings) + ")$")


def _words_before(tokens: Column, kinds: Column, at: Column) -> Column:
    """The run of words that ends right before token `at` (from 1), line breaks left out."""
    n = F.length(F.regexp_extract(F.substring(kinds, F.lit(1), at - 1), "([WB]*)$", 1))
    return F.filter(let(n, lambda n: F.slice(tokens, at - n, n)), lambda t: t != "\n")


def own_name(words: Column) -> Column:
    """The name that a run of words ends with, read backwards until a word that can't belong to it; empty if the last is no law's."""
    none = F.array().cast("array<string>")

    def length(words: Column, act: Column) -> Column:
        start = F.struct(F.lit(1).alias("n"), F.lit(False).alias("done"))

        def step(acc: Column, w: Column) -> Column:
            stop = _ends_with(w, PARTICLES + OFFICES + VERB_ENDINGS) | w.isin(*POINTER_WORDS) | w.rlike("[()]") | _whole(w, ARTICLE) | ((acc.n == NAME_WORDS) & act)
            return F.when(acc.done, acc).otherwise(let(stop, lambda s: F.struct((acc.n + F.when(s, 0).otherwise(1)).alias("n"), s.alias("done"))))

        return F.aggregate(F.reverse(F.slice(words, 1, F.size(words) - 1)), start, step, lambda acc: acc.n)

    def name(words: Column) -> Column:
        last = F.element_at(words, -1)
        tail = let(length(words, last.endswith("법")), lambda n: F.slice(words, F.size(words) - n + 1, n))
        return F.when(F.size(words) == 0, none).when(_ends_with(last, NAME_ENDINGS) & ~last.rlike("[()]"), tail).otherwise(none)

    return let(words, name)


def _between(kinds: Column, lists: Column, i: Column, at: Column) -> Column:
    """The kinds of the tokens between the list before number i and place `at`."""
    before = F.get(lists, i - 1)
    start = F.coalesce(F.when(i > 0, before.at + F.length(before.kinds)), F.lit(1))
    return F.substring(kinds, start, at - start)


def _tight(s: Column) -> Column:
    return F.regexp_replace(s, r"\s+", "")


def named_refs(rows: DataFrame, text: str | Column, names: Column, out: str = "refs") -> DataFrame:
    """The rows with law and article of every citation that follows one of the names, or continues such a list: after the name's own
    list, lists without a name of any law before them still belong to it, up to the end of the line."""
    found = scanned(rows, text).withColumn("_n", F.filter(names, lambda n: n != ""))

    def entry(c: Column, i: Column) -> Column:
        longest = lambda said: F.aggregate("_n", F.lit(""), lambda acc, n: F.when(said.endswith(_tight(n)) & (F.length(_tight(n)) > F.length(_tight(acc))), n).otherwise(acc))
        who = lambda words: F.struct(let(_tight(F.array_join(words, "")), longest).alias("law"), (F.size(own_name(words)) > 0).alias("any"))
        return F.struct(
            _between(F.col("_k"), F.col("_l"), i, c.at).contains("B").alias("line"),
            let(_words_before(F.col("_t"), F.col("_k"), c.at), who).alias("who"),
            _refs(_items(F.col("_t"), F.array(c))).alias("refs"),
        )

    found = found.withColumn("_e", F.transform("_l", entry))
    kind = "array<struct<law:string,key:string,display:string>>"
    start = F.struct(F.lit(None).cast("string").alias("owner"), F.array().cast(kind).alias("out"))

    def step(acc: Column, e: Column) -> Column:
        mine = lambda owner: F.transform(e.refs, lambda r: F.struct(owner.alias("law"), r["key"].alias("key"), r.display.alias("display")))
        after = lambda owner: F.struct(owner.alias("owner"), F.when(owner.isNull(), acc.out).otherwise(F.concat(acc.out, mine(owner))).cast(kind).alias("out"))
        return let(F.when(e.who.law != "", e.who.law).when(~e.who.any & ~e.line, acc.owner), after)

    refs = F.aggregate("_e", start, step, lambda acc: acc.out)
    # an article that is named again stands where it is named last
    return _fenced(found, F.reverse(F.array_distinct(F.reverse(refs))), out)


# whose articles ------------------------------------------------------------------------------------


def level_of(kind: Column) -> Column:
    kind = F.trim(F.regexp_replace(F.coalesce(kind, F.lit("")), r"\s+", " "))
    return F.when((kind == "법") | kind.contains("법률"), "법").when(kind.rlike("대통령령|시행령"), "시행령").when(kind.rlike("부령|규칙"), "시행규칙").when(kind != "", kind).otherwise("기타")


def _mapped(pairs: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def scope_of(name: Column) -> Column:
    """The scope that the longest known ending of a name stands for; null if it has none."""
    longest = "|".join(sorted(SCOPE_OF_ENDING, key=len, reverse=True))
    return _mapped(SCOPE_OF_ENDING, F.regexp_extract(name, f"({longest})$", 1))


def noise(name: Column) -> Column:
    """Whether a name as a whole (its words) is no law's own: no name, a bare level, or one that begins with a level."""
    bare = F.forall(name, lambda w: w.isin("법", "영", "시행령", "시행규칙", "규칙", "조례", "법률"))
    return (F.size(name) == 0) | bare | F.get(name, F.lit(0)).isin("법", "영")


def is_noise_name(name: Column) -> Column:
    words = F.filter(F.split(F.coalesce(name, F.lit("")), r"\s+"), lambda w: w != "")
    return noise(words) | (own_name(words) != words)


def scope_members(scope: Column, law: Column, family: Column) -> Column:
    """The laws of the family that "this Act", "this Decree" and so on can mean. law and family have levels (`level_of`)."""

    def of(level: Column) -> Column:
        own = (law["name"] != "") & (law["level"] == level)
        root = (level == "법") & F.exists(family, lambda f: f["name"] == law["root"])
        of_level = F.array_distinct(F.transform(F.filter(family, lambda f: f["level"] == level), lambda f: f["name"]))
        return F.when(own, F.array(law["name"])).when(root, F.array(law["root"])).otherwise(of_level)

    return let(F.coalesce(_mapped(LEVELS, scope), scope), of)


def named_members(name: Column, law: Column, family: Column) -> Column:
    """The laws of the family that a name, a short name or a level means."""

    def of(said: Column) -> Column:
        meant = lambda f: (f.tight == said) | ((f.short != "") & (f.short == said)) | (f["level"].isin(*LEVELS.values()) & (f["level"] == said))
        found = F.array_distinct(F.transform(F.filter(family, meant), lambda f: f["name"]))
        better = lambda found: F.when(F.size(found) <= 1, found).otherwise(let(scope_members(said, law, family), lambda one: F.when(F.size(one) == 1, one).otherwise(found)))
        return let(found, better)

    return let(_tight(name), of)


def _prepared(law: Column, family: Column) -> tuple[Column, Column]:
    """law with its level by kind, and the named members of the family with levels and short names."""
    root = F.coalesce(law["root"], F.lit(""))
    level = F.when(law["level"] != "", level_of(law["level"]))
    short = lambda own: F.when((root != "") & F.startswith(own, root), F.substring(own, F.length(root) + 1, F.length(own))).when(root != "", own).otherwise("")
    member = lambda f: F.struct(f["name"].alias("name"), level_of(f["level"]).alias("level"), _tight(f["name"]).alias("tight"), _tight(short(f["name"])).alias("short"))
    return F.struct(law["name"].alias("name"), level.alias("level"), law["root"].alias("root")), F.transform(F.filter(family, lambda f: f["name"] != ""), member)


#: References to neighbours: type, step, and their place in the order of a text's references.
_NEAR = {"전": ("previous_article", -1, 2), "다음": ("next_article", 1, 3), "같은": ("current_article", 0, 4), "동": ("current_article", 0, 4)}
_STRINGS = "array<string>"


def law_refs(rows: DataFrame, text: str | Column, law: Column, article: Column, order: Column, family: Column, out: str = "refs") -> DataFrame:
    """The rows with the references of a text to articles: by pointer ("this Act, Article 3"), by name, by neighbourhood, and bare ones,
    in that order; each (type, target, articles) once. law: name, level and root of the source; order: its article keys in document order;
    family: names and levels of its family."""
    law, family = _prepared(law, family)
    found = scanned(rows, text).withColumns({"_law": law, "_family": family, "_order": order})
    law, family, t, k, raw = F.col("_law"), F.col("_family"), F.col("_t"), F.col("_k"), F.col("_raw")

    def said(c: Column) -> Column:
        """What stands before a list: the pointer's scope, or the name's words; and how many tokens that is."""

        def before(b: Column) -> Column:
            tail = F.regexp_extract(b, "(PB*)$", 1)
            run = F.regexp_extract(b, "([WB]*)$", 1)
            # line breaks between the name's words count as tokens
            words = lambda name: F.struct(
                F.lit(None).cast("string").alias("pointer"), name.alias("name"), F.length(F.regexp_substr(run, F.concat(F.lit("(?:WB*){"), F.size(name).cast("string"), F.lit("}$")))).alias("back")
            )
            pointed = F.struct(F.regexp_extract(F.get(t, c.at - 1 - F.length(tail)), POINTER, 1).alias("pointer"), F.array().cast(_STRINGS).alias("name"), F.length(tail).alias("back"))
            return F.when(F.length(tail) > 0, pointed).otherwise(let(own_name(_words_before(t, k, c.at)), words))

        return F.struct(c.at.alias("at"), c.kinds.alias("kinds"), let(F.substring(k, F.lit(1), c.at - 1), before).alias("who"))

    found = found.withColumn("_s", F.transform("_l", said))

    def whose(s: Column) -> Column:
        bare, name = noise(s.who["name"]), F.array_join(s.who["name"], " ")
        scope = F.coalesce(s.who.pointer, F.when(bare & (F.size(s.who["name"]) > 0), scope_of(name)))

        def of(scope: Column) -> Column:
            by = F.when(s.who.pointer.isNotNull(), "pointer").when(scope.isNotNull(), "level").when(bare, "none").otherwise("name")
            members = lambda by: F.when(by == "name", named_members(name, law, family)).when(by == "none", F.array(law["name"]).cast(_STRINGS)).otherwise(scope_members(scope, law, family))
            return let(by, lambda by: F.struct(s.at.alias("at"), s.kinds.alias("kinds"), s.who.back.alias("back"), by.alias("by"), name.alias("name"), members(by).alias("members")))

        return let(scope, of)

    found = found.withColumn("_w", F.transform("_s", whose))
    # the articles of each list, at the list's place
    found = found.withColumn("_a", F.transform("_l", lambda c: _refs(_items(t, F.array(c)))))

    def row(w: Column, i: Column) -> Column:
        n = F.size(w.members)
        one = n == 1
        by_name, bare = w.by == "name", w.by == "none"
        said = F.array_join(F.slice(raw, w.at - F.when(bare, 0).otherwise(w.back), F.length(w.kinds) + F.when(bare, 0).otherwise(w.back)), "")
        sure = F.when(one, _mapped_double(0, w.by)).otherwise(_mapped_double(1, w.by))
        return _row(
            F.when(w.by == "pointer", 0).when(bare, 5).otherwise(1), i,
            F.when(by_name, "explicit_law_article").when(bare, "same_law_article").otherwise("relative_scope"),
            said, F.when(one, F.get(w.members, F.lit(0))).when(by_name, w["name"]), F.when(by_name & (n == 0), F.array(w["name"])).otherwise(w.members),
            F.transform(F.get("_a", i), lambda r: F.struct(r["key"].alias("key"), r.paragraph.alias("paragraph"), r["item"].alias("item"), r.subitem.alias("subitem"))),
            F.when(bare | one, "resolved").when(by_name & (n == 0), "unresolved_external").otherwise("ambiguous"),
            F.when(bare, CONFIDENCE["none"][0]).otherwise(sure),
        )

    at = F.array_position("_order", article)
    none = F.lit(None).cast("string")

    def near(x: Column, i: Column) -> Column:
        word = F.regexp_extract(x, NEAR, 1)
        pick = lambda j: F.coalesce(*[F.when(word == w, v[j]) for w, v in _NEAR.items()])
        target = F.when(at > 0, F.get("_order", (at + pick(1) - 1).cast("int")))
        refs = F.array(F.struct(target.alias("key"), none.alias("paragraph"), none.alias("item"), none.alias("subitem")))
        return F.struct(target.alias("to"), _row(pick(2), i, pick(0), x, law["name"], F.array(law["name"]), refs, F.lit("resolved"), F.lit(CONFIDENCE["near"][0])).alias("row"))

    neighbours = F.transform(F.filter("_t", lambda x: _whole(x, NEAR)), near)
    neighbours = F.transform(F.filter(neighbours, lambda x: x["to"].isNotNull()), lambda x: x["row"])
    found = found.withColumn("_all", F.array_sort(F.concat(F.transform("_w", row), neighbours)))
    same = lambda x, y: (x["type"] == y["type"]) & (F.coalesce(x.target, F.lit("")) == F.coalesce(y.target, F.lit(""))) & (x.refs == y.refs)
    first = F.filter("_all", lambda x, i: ~F.exists(F.slice("_all", F.lit(1), i), lambda y: same(x, y)))
    shown = F.transform(first, lambda x: F.struct(x["type"].alias("type"), x.text.alias("text"), F.when(x.target != "", x.target).alias("target"), x.related.alias("related"), F.transform(x.refs, lambda r: r["key"]).alias("articles"), x.status.alias("status"), x.confidence.alias("confidence")))
    return _fenced(found, shown, out)


def _mapped_double(which: int, by: Column) -> Column:
    return F.coalesce(*[F.when(by == name, pair[which]) for name, pair in CONFIDENCE.items()])


def _row(place: Column, i: Column, kind: Column, text: Column, target: Column, related: Column, refs: Column, status: Column, sure: Column) -> Column:
    fields = {"place": place.cast("int"), "i": i.cast("int"), "type": kind, "text": F.trim(F.regexp_replace(text, r"\s+", " ")), "target": target.cast("string"), "related": related.cast(_STRINGS), "refs": refs, "status": status, "confidence": sure.cast("double")}
    return F.struct(*[c.alias(n) for n, c in fields.items()])
