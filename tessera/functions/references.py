"""References to articles in statute text: one scan cuts a text into tokens, a small grammar reads citation lists off them.

Grammar, over tokens with nothing but white space between them:

    list  = item { link item }
    item  = article { unit } [ range article [ until ] ]

What stands before a list tells whose articles it names: a pointer ("this Act"), a law's name, a bare level ("Act") or nothing.
A name is read backwards from the list, word by word, until a word that can't belong to it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The written forms of citations, levels of laws, and words of statute language.
FORMS = {
    "article": r"제\s*(?P<main>\d+)\s*조(?:\s*의\s*(?P<branch>\d+))?",
    "unit": r"제\s*(?P<no>\d+)\s*(?P<unit>[항호목])",
    "pointer": r"(?:이|같은|동)\s*(?P<scope>법|영|규칙|조례)(?=\s*제\s*\d)",
    "near": r"(?P<near>전\s*조|다음\s*조|(?:같은|동)\s*조)(?!례)",
    "range": r"(?:부터|내지)(?=\s*제\s*\d)",
    "until": r"까지",
    "link": r",|·|/|(?:및|또는|혹은|와|과)(?![가-힣])",
    "word": r"[가-힣0-9ㆍ·()]+",
}
UNIT_NAMES = {"항": "paragraph", "호": "item", "목": "subitem"}
LEVELS = {"법": "법", "영": "시행령", "규칙": "시행규칙", "조례": "조례"}
SCOPE_OF_ENDING = {"시행규칙": "규칙", "부령": "규칙", "규칙": "규칙", "시행령": "영", "대통령령": "영", "령": "영", "법률": "법", "법": "법", "조례": "조례"}
NAME_ENDINGS = ("법", "법률", "시행령", "대통령령", "령", "시행규칙", "규칙", "부령", "조례", "규정", "훈령", "예규", "고시")
POINTER_WORDS = ("이", "같은", "동")
PARTICLES = ("은", "는", "이", "가", "을", "를", "과", "와")
VERB_ENDINGS = ("하고", "하며", "하여", "되고", "되며")
OFFICES = ("장관", "위원회", "청장", "협회", "원장", "시장", "군수", "구청장", "도지사")
NEAR_STEPS = {"전": ("previous_article", -1), "다음": ("next_article", 1), "같은": ("current_article", 0), "동": ("current_article", 0)}
#: Confidence of a resolved and of an unresolved reference, by what tells the law.
CONFIDENCE = {"pointer": (0.9, 0.6), "level": (0.88, 0.55), "name": (0.95, 0.45), "near": (0.92, 0.92), "none": (0.9, 0.9)}
#: Words of the longest name that ends in "Act" alone.
NAME_WORDS = 3

_SCAN = re.compile("|".join(f"(?P<{kind}_>{form})" for kind, form in FORMS.items()))


@dataclass(slots=True)
class Token:
    kind: str
    start: int
    end: int
    found: re.Match


@dataclass
class Citations:
    """A list of citations: its tokens' place and what it names, ranges written out."""

    first: int  # index of its first token
    start: int
    end: int
    items: list[tuple[Token, list[Token], Token | None]] = field(default_factory=list)

    def refs(self) -> list[dict]:
        return distinct_refs([self])


def scan(text: str) -> list[Token]:
    # the group of a whole token closes last
    return [Token(m.lastgroup[:-1], *m.span(), m) for m in _SCAN.finditer(text)]


def citation_lists(text: str, tokens: list[Token]) -> list[Citations]:
    """All lists of citations, left to right."""

    def next_is(i: int, kind: str) -> bool:
        return i + 1 < len(tokens) and tokens[i + 1].kind == kind and not text[tokens[i].end : tokens[i + 1].start].strip()

    out, i = [], 0
    while i < len(tokens):
        if tokens[i].kind != "article":
            i += 1
            continue
        found = Citations(i, tokens[i].start, tokens[i].end)
        while True:
            article, units, last = tokens[i], [], None
            while next_is(i, "unit"):
                i += 1
                units.append(tokens[i])
            if next_is(i, "range") and next_is(i + 1, "article"):
                i += 2
                last = tokens[i]
                i += next_is(i, "until")
            found.items.append((article, units, last))
            found.end = tokens[i].end
            if not (next_is(i, "link") and next_is(i + 1, "article")):
                break
            i += 2
        out.append(found)
        i += 1
    return out


def _ref(main: int, branch: int | None, units: list[Token]) -> dict:
    ref = {"key": str(main), "display": f"제{main}조", "paragraph": None, "item": None, "subitem": None}
    if branch is not None:
        ref |= {"key": f"{main}-{branch}", "display": f"제{main}조의{branch}"}
    for u in reversed(units):  # of several units of a kind the first counts
        ref[UNIT_NAMES[u.found["unit"]]] = str(int(u.found["no"]))
    return ref


def _number(article: Token) -> tuple[int, int | None]:
    branch = article.found["branch"]
    return int(article.found["main"]), int(branch) if branch else None


def _written_out(first: Token, last: Token) -> list[tuple[int, int | None]]:
    """The articles from first to last; where these don't form a run, only both ends."""
    (a, ab), (b, bb) = _number(first), _number(last)
    if ab is bb is None and a <= b:
        return [(n, None) for n in range(a, b + 1)]
    if a == b and ab and bb and ab <= bb:
        return [(a, n) for n in range(ab, bb + 1)]
    return [(a, ab), (b, bb)]


def distinct_refs(lists: list[Citations]) -> list[dict]:
    """What lists of citations name, each article with its units once: ranges first, then single articles."""
    ranges = [_ref(*n, []) for c in lists for first, units, last in c.items if last and not units for n in _written_out(first, last)]
    single = [_ref(*_number(first), units) for c in lists for first, units, _ in c.items]
    single += [_ref(*_number(last), []) for c in lists for _, _, last in c.items if last]
    seen: dict[tuple, dict] = {}
    for r in ranges + single:
        seen.setdefault((r["key"], r["paragraph"], r["item"], r["subitem"]), r)
    return list(seen.values())


def article_refs(block: str | None) -> list[dict]:
    """Articles a text names: key, display form, paragraph, item and subitem."""
    return distinct_refs(citation_lists(block or "", scan(block or "")))


# whose articles ------------------------------------------------------------------------------------


@lru_cache(maxsize=4096)
def level_of(kind: str | None) -> str:
    """Level of a law by its kind."""
    kind = " ".join((kind or "").split())
    parts = {"법": "법률", "시행령": "대통령령|시행령", "시행규칙": "부령|규칙"}
    return next((level for level, words in parts.items() if kind == "법" == level or re.search(words, kind)), kind or "기타")


def scope_of(name: str) -> str | None:
    """The scope that the longest known ending of a name stands for."""
    ends = [e for e in SCOPE_OF_ENDING if name.endswith(e)]
    return SCOPE_OF_ENDING[max(ends, key=len)] if ends else None


def _can_stand_inside(word: str) -> bool:
    """A word that can belong to a name without being its last one."""
    return not word.endswith(PARTICLES + OFFICES + VERB_ENDINGS) and word not in POINTER_WORDS


def own_name(words: list[str]) -> list[str]:
    """The name that a run of words ends with: read backwards until a word that can't belong to it. [] if the last word is no
    law's."""
    if not words or not words[-1].endswith(NAME_ENDINGS) or set("()") & set(words[-1]):
        return []
    out = [words[-1]]
    for word in reversed(words[:-1]):
        if not _can_stand_inside(word) or set("()") & set(word) or re.fullmatch(FORMS["article"], word) or len(out) == NAME_WORDS and words[-1].endswith("법"):
            break
        out.insert(0, word)
    return out


def is_bare_level(name: str) -> bool:
    """A level without a name of its own: "Act", "Act Decree"."""
    return all(w in ("법", "영", "시행령", "시행규칙", "규칙", "조례", "법률") for w in name.split())


def is_noise_name(name: str) -> bool:
    """Words before a citation that are no law's own name, as a whole."""
    words = name.split()
    return not words or own_name(words) != words or is_bare_level(name) or words[0] in ("법", "영")


def scope_members(scope: str, law: dict, family: list[dict]) -> list[str]:
    """The laws of the family that "this Act", "this Decree" and so on can mean."""
    level = LEVELS.get(scope, scope)
    named = [f for f in family if f["name"]]
    of_level = list(dict.fromkeys(f["name"] for f in named if level_of(f["level"]) == level))
    choices = (
        [law["name"]] if law.get("name") and law.get("level") and level_of(law["level"]) == level else [],
        [law["root"]] if level == "법" and any(f["name"] == law.get("root") for f in named) else [],
        of_level,
    )
    return next((c for c in choices if c), [])


def named_members(name: str, law: dict, family: list[dict]) -> list[str]:
    """The laws of the family that a name, a short name or a level means."""
    tight = lambda s: "".join((s or "").split())
    root = law.get("root") or ""
    pairs = []
    for f in family:
        if own := f["name"]:
            level = level_of(f["level"])
            pairs += [(tight(own), own), (tight(own.removeprefix(root)) if root else "", own), (level if level in LEVELS.values() else "", own)]
    found = list(dict.fromkeys(own for alias, own in pairs if alias and alias == tight(name)))
    if len(found) > 1:
        one = scope_members(tight(name), law, family)
        found = one if len(one) == 1 else found
    return found


@dataclass
class _Found:
    order: int  # pointers and names, then neighbours, then bare lists
    start: int
    kind: str
    text: str
    target: str | None
    related: list[str]
    refs: list[dict]
    status: str
    confidence: float


def _words_before(text: str, tokens: list[Token], i: int) -> list[Token]:
    """The run of words that ends right before token i."""
    out: list[Token] = []
    while i > 0 and tokens[i - 1].kind == "word" and not text[tokens[i - 1].end : tokens[i].start].strip():
        i -= 1
        if out and tokens[i].end == out[0].start:
            break
        out.insert(0, tokens[i])
    return out


def _of_list(text: str, tokens: list[Token], c: Citations, law: dict, family: list[dict]) -> _Found:
    refs = c.refs()

    def scoped(scope: str, start: int, by: str) -> _Found:
        members = scope_members(scope, law, family)
        one = len(members) == 1
        return _Found(0 if by == "pointer" else 1, start, "relative_scope", text[start : c.end], members[0] if one else None, members, refs, "resolved" if one else "ambiguous", CONFIDENCE[by][not one])

    before = tokens[c.first - 1] if c.first else None
    if before and before.kind == "pointer" and not text[before.end : c.start].strip():
        return scoped(before.found["scope"], before.start, "pointer")
    words = _words_before(text, tokens, c.first)
    name = own_name([text[w.start : w.end] for w in words])
    if name:
        start, said = words[len(words) - len(name)].start, " ".join(name)
        if is_noise_name(said):
            if scope := scope_of(said):
                return scoped(scope, start, "level")
        else:
            found = named_members(said, law, family)
            status = ("unresolved_external", "resolved", "ambiguous")[min(len(found), 2)]
            target = found[0] if len(found) == 1 else said
            return _Found(1, start, "explicit_law_article", text[start : c.end], target, found or [said], refs, status, CONFIDENCE["name"][len(found) != 1])
    return _Found(5, c.start, "same_law_article", text[c.start : c.end], law.get("name"), [law.get("name")], refs, "resolved", CONFIDENCE["none"][0])


def law_references(text: str | None, law: dict, article: str | None, order: list[str], family: list[dict]) -> list[dict]:
    """References of an article's text to articles: by pointer ("this Act, Article 3"), by name, by neighbourhood, and bare ones, in
    that order; each (kind, target, articles) once.

    law: name, level and root of the source; order: its article keys in document order; family: names and levels of its family.
    """
    text = text or ""
    tokens = scan(text)
    found = [_of_list(text, tokens, c, law, family) for c in citation_lists(text, tokens)]
    at = order.index(article) if article in order else None
    for t in tokens:
        if t.kind == "near" and at is not None:
            kind, step = NEAR_STEPS[re.match("전|다음|같은|동", t.found["near"])[0]]
            if 0 <= at + step < len(order):
                found.append(_Found(3 + step if step else 4, t.start, kind, text[t.start : t.end], law.get("name"), [law.get("name")], [{"key": order[at + step]}], "resolved", CONFIDENCE["near"][0]))
    places = {"previous_article": 2, "next_article": 3, "current_article": 4}
    found.sort(key=lambda f: (places.get(f.kind, f.order), f.start))
    out: dict[tuple, dict] = {}
    for f in found:
        signature = tuple((r["key"], r.get("paragraph"), r.get("item"), r.get("subitem")) for r in f.refs)
        row = {"type": f.kind, "text": " ".join(f.text.split()), "target": f.target or None, "related": f.related, "articles": [r["key"] for r in f.refs], "status": f.status, "confidence": f.confidence}
        out.setdefault((f.kind, f.target or "", signature), row)
    return list(out.values())


def named_refs(text: str | None, names: list[str]) -> list[dict]:
    """law and article of every citation that follows one of the names, or continues such a list: after the name's own list, lists
    without a name of any law before them still belong to it, up to the end of the line."""
    text = text or ""
    tokens, out, owner, last = scan(text), [], None, 0
    tight = {"".join(n.split()): n for n in names if n}
    for c in citation_lists(text, tokens):
        if "\n" in text[last : c.start]:
            owner = None
        words = [text[w.start : w.end] for w in _words_before(text, tokens, c.first)]
        said = "".join(words)
        match = max((n for n in tight if said.endswith(n)), key=len, default=None)
        if match:
            owner = tight[match]
        elif own_name(words):
            owner = None  # another law's
        if owner:
            out += [{"law": owner, "key": r["key"], "display": r["display"]} for r in c.refs()]
        last = c.end
    return list({(r["law"], r["key"]): r for r in reversed(out)}.values())[::-1]


_S, _SS = T.StringType(), T.ArrayType(T.StringType())
REF = T.ArrayType(T.StructType([T.StructField(c, _S) for c in ("key", "display", "paragraph", "item", "subitem")]))
_LAW_FIELDS = {"type": _S, "text": _S, "target": _S, "related": _SS, "articles": _SS, "status": _S, "confidence": T.DoubleType()}
LAW_REF = T.ArrayType(T.StructType([T.StructField(c, t) for c, t in _LAW_FIELDS.items()]))
NAMED_REF = T.ArrayType(T.StructType([T.StructField(c, _S) for c in ("law", "key", "display")]))


@F.pandas_udf(REF)
def refs_of(text: pd.Series) -> pd.Series:
    return pd.Series([article_refs(t) for t in text])


@F.pandas_udf(NAMED_REF)
def named_refs_of(text: pd.Series, names: pd.Series) -> pd.Series:
    return pd.Series([named_refs(t, list(n) if n is not None else []) for t, n in zip(text, names, strict=True)])


@F.pandas_udf(T.BooleanType())
def noise_name(name: pd.Series) -> pd.Series:
    return pd.Series([is_noise_name(n or "") for n in name])


@F.pandas_udf(LAW_REF)
def law_refs_of(text: pd.Series, law: pd.DataFrame, article: pd.Series, order: pd.Series, family: pd.Series) -> pd.Series:
    laws = law.to_dict("records")
    lists = [(list(o) if o is not None else [], list(f) if f is not None else []) for o, f in zip(order, family, strict=True)]
    return pd.Series([law_references(t, one, a, o, f) for t, one, a, (o, f) in zip(text, laws, article, lists, strict=True)])
