"""Secret scans: candidate strings, judged by a random forest of column expressions.

Candidates are found by one pattern per shape (assigned values after a key-like word, tokens with a
vendor's prefix, long runs of encoding characters, private-key headers), all in one alternation, so a text is
scanned once. Each candidate gets features in plain SQL: its length, the share of character transitions
between kinds (letter case, digit, mark), distinct characters, dictionary coverage (how much of it common words
of prose cover), hints of a path, and the words to its left and right. A random forest gives the probability of
a real secret; what stays below the threshold is a false positive and is removed.

The forest is learned from labelled findings: strings drawn by a seeded generator from known secret
formats (label 1) and from the look-alikes that scanners report by mistake - identifiers, paths, prose, versions,
placeholders, dates, repeated characters (label 0) - each with neighbouring words. Trees are grown on the driver
from that bounded set (FINDINGS), once a process, and turned into CASE expressions: scoring is JVM code only.

Defined results: null and empty texts have no findings and no row; repeated rows are reported once for each;
equal candidates at other places are findings of their own; offsets are code points, ends exclusive; a run
of any length is one finding. Other columns are not read.
"""

from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

THRESHOLD = 0.5
FINDINGS, TREES, DEPTH, LEAF = 6000, 24, 9, 4
#: Characters of text to each side of a candidate that its neighbouring words are taken from.
CONTEXT = 40

# Words that announce a secret, in assignments, and prefixes of vendors' tokens.
KEY_WORDS = ("password", "passwd", "pwd", "passphrase", "secret", "token", "apikey", "api_key", "api-key", "access_key", "secret_key", "auth", "credential", "private_key", "client_secret")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "sk_live_", "sk_test_", "xoxb-", "xoxp-", "AIza", "ya29.", "eyJ", "npm_", "SG.", "pypi-")
#: Frequent words of prose, identifiers and placeholders, for dictionary coverage.
DICTIONARY = (
    "the and for that with this from your example test sample demo dummy placeholder changeme default value name user users data file files path index main value string number config "
    "version release build image update query table column hello world password secret token key none null true false undefined insert here please enter your public static class function "
    "return import module package service server client request response header content length width height color border background margin left right center"
).split()

_KEY = "|".join(w.replace("-", "[-]") for w in KEY_WORDS)
_PREFIX = "|".join(p.replace(".", "[.]") for p in PREFIXES)
_VALUE = r"[A-Za-z0-9_+/=.~!@#$%^&*:-]"
#: One alternation; group 0 is the whole finding, its value is cut out below.
#: A name may begin with other words (clientSecret, db_password), which stay to the left of the finding, and go on for SUFFIX characters.
SUFFIX = 40
_ASSIGN = rf"(?i:(?:{_KEY})[a-z0-9_-]{{0,{SUFFIX}}}[\"']?)\s{{0,3}}(?::=|=>|[:=])\s{{0,3}}"
CANDIDATE = (
    rf"{_ASSIGN}(?:\"[^\"\n]{{4,}}+\"|'[^'\n]{{4,}}+'|{_VALUE}{{4,}}+)"
    rf"|(?<![A-Za-z0-9])(?:{_PREFIX})[A-Za-z0-9_.-]{{8,}}+"
    r"|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
    r"|(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{24,}+"
)

FEATURES = ("length", "kind_changes", "lower", "upper", "digit", "mark", "distinct", "hex", "dictionary", "slashes", "dots", "underscores", "vowels", "key_left", "assigned", "quoted", "prefix", "repeat", "words_left", "code_right")


def kinds(value: Column) -> Column:
    """The value with each character replaced by its kind."""
    out = F.regexp_replace(value, r"[\p{Ll}]", "a")
    out = F.regexp_replace(out, r"[\p{Lu}]", "A")
    out = F.regexp_replace(out, r"[0-9]", "0")
    return F.regexp_replace(out, r"[^aA0]", "-")


def _count(value: Column, pattern: str) -> Column:
    return (F.length(value) - F.length(F.regexp_replace(value, pattern, ""))).cast("double")


def features(whole: Column, value: Column, left: Column, right: Column) -> list[Column]:
    """The features of a finding, in the order of FEATURES, as doubles."""
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    kind = kinds(value)
    # each change of kind leaves one more run
    runs = F.length(F.regexp_replace(kind, r"(.)\1*", "$1")).cast("double")
    words = "|".join(sorted(DICTIONARY, key=len, reverse=True))
    one = lambda c: c.cast("double")
    of = lambda pattern: (F.length(value) - _count(value, pattern)) / n
    return [
        n,
        (runs - 1) / n,
        _count(kind, "a") / n,
        _count(kind, "A") / n,
        _count(kind, "0") / n,
        _count(kind, "-") / n,
        F.size(F.array_distinct(F.split(value, ""))).cast("double") / n,
        one(value.rlike("^[0-9a-fA-F]+$")),
        _count(value, f"(?i)(?:{words})") / n,
        of(r"[^/\\]"),
        of(r"[^.]"),
        of(r"[^_-]"),
        _count(value, "(?i)[aeiou]") / n,
        one(F.concat(left, F.substring(whole, 1, 40)).rlike(rf"(?i)(?:{_KEY})")),
        one(whole.rlike(r"^[^:=\s]{1,60}\s{0,3}[:=]")),
        one(whole.rlike("[\"']")),
        one(value.rlike(f"^(?:{_PREFIX})")),
        _count(value, r"(.)(?=\1)") / n,
        F.size(F.filter(F.split(F.trim(left), r"\s+"), lambda w: w.rlike(r"^\p{L}{2,}[.,;]?$"))).cast("double"),
        one(F.substring(right, 1, 3).rlike(r"^[;,)\]}>/\\]")),
    ]


# labelled findings ----------------------------------------------------------------------------------


def _draw(rng: random.Random, alphabet: str, n: int) -> str:
    return "".join(rng.choice(alphabet) for _ in range(n))


_HEX, _LOW, _UP, _NUM = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_B64 = _LOW + _UP + _NUM


def labelled_findings(n: int = FINDINGS, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """(whole, value, left, right, label) by rule: real formats and look-alikes, half of each."""
    rng = random.Random(seed)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "sch", "ung", "ment", "tion", "eau", "ado", "ció", "ez"]

    def prose(k: int) -> str:
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(k))

    def ident() -> str:
        parts = [rng.choice(DICTIONARY) for _ in range(rng.randint(2, 6))]
        return rng.choice(["_", "-", "/", ""]).join(p.capitalize() if rng.random() < 0.3 else p for p in parts) + rng.choice(["", "1", "2", "_v2", "01", "2024"])

    def assign(value: str) -> str:
        key = rng.choice(KEY_WORDS)
        key = key.upper() if rng.random() < 0.2 else key.capitalize() if rng.random() < 0.2 else key
        key += rng.choice(["", "", "", "_prod", "Value", "2", "_old"])
        q = rng.choice(["", "", '"', "'"])
        return key + rng.choice(["=", " = ", ": ", ":", " := "]) + q + value + q

    def secret() -> tuple[str, str]:
        kind = rng.randrange(9)
        if kind == 8:  # a quoted value with blanks
            v = " ".join(_draw(rng, _B64 + "!#$%", rng.randint(3, 7)) + rng.choice(_NUM) for _ in range(rng.randint(2, 4)))
            return rng.choice(KEY_WORDS) + rng.choice([" = ", ": ", "="]) + '"' + v + '"', v
        if kind == 0:
            v = "AKIA" + _draw(rng, _UP + "234567" + _NUM, 16)
            return v, v
        if kind == 1:
            v = _draw(rng, _HEX, rng.choice([16, 18, 20, 32, 40, 64]))
            return assign(v), v
        if kind == 2:
            v = _draw(rng, _B64, rng.randint(12, 48))
            return assign(v), v
        if kind == 3:
            v = _draw(rng, _B64 + "+/", rng.choice([40, 44, 64, 86])) + rng.choice(["", "=", "=="])
            return rng.choice([v, assign(v)]), v
        if kind == 4:
            v = rng.choice(PREFIXES) + _draw(rng, _B64, rng.randint(20, 40))
            return rng.choice([v, assign(v)]), v
        if kind == 5:
            v = _draw(rng, _HEX, rng.choice([32, 40, 64]))
            return v, v
        if kind == 6:
            v = _draw(rng, _B64 + "!#$%^&*", rng.randint(10, 24))
            return assign(v), v
        v = "-----BEGIN " + rng.choice(["RSA ", "EC ", "OPENSSH ", ""]) + "PRIVATE KEY-----"
        return v, v

    def mistake() -> tuple[str, str]:
        kind = rng.randrange(12)
        if kind == 9:  # prose after a word that only begins like a key word, or a quoted sentence
            v = rng.choice([prose(1), prose(1).capitalize(), prose(1) + str(rng.randint(1, 9))])[:20] + rng.choice(["", "ing", "ed"])
            return rng.choice(["author", "authority", "tokenization", "secretary", "passwords", "Tokens", "auth_method"]) + rng.choice([": ", ":", " = "]) + v, v
        if kind == 10:
            v = prose(rng.randint(2, 6))
            return rng.choice(KEY_WORDS) + ': "' + v + '"', v
        if kind == 11:  # a long run of letters
            v = "".join(prose(1) for _ in range(rng.randint(4, 12)))
            v = rng.choice([v, v.capitalize(), v.upper()]) + "x" * max(0, 24 - len(v))
            return v, v
        if kind == 0:
            v = ident()
        elif kind == 1:
            v = "/".join(rng.choice(DICTIONARY) for _ in range(rng.randint(3, 7))) + rng.choice(["/index2", "/v1", "/2024/01", "/img10"])
        elif kind == 2:
            v = rng.choice(["changeme", "your_password", "example", "xxxxxxxx", "********", "placeholder", "password123", "<secret>", "none_required", "test1234", "$PASSWORD", "${TOKEN}", "%s.value"])
            return assign(v), v
        elif kind == 3:
            v = rng.choice("xX0*-=_a") * rng.randint(8, 60)
            v = v[:-1] + "0" if rng.random() < 0.5 else v
        elif kind == 4:
            v = f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}-" + "-".join(rng.choice(DICTIONARY) for _ in range(3))
        elif kind == 5:
            v = prose(1) + prose(1)
            v = v.replace(" ", "")
            return assign(v[:20] + "ing"), v[:20] + "ing"
        elif kind == 6:
            v = "-".join(str(rng.randint(0, 9999)) for _ in range(rng.randint(5, 9)))
        elif kind == 7:
            v = "".join(rng.choice(DICTIONARY).capitalize() for _ in range(rng.randint(3, 6))) + str(rng.randint(1, 99))
        else:
            v = rng.choice(DICTIONARY) + _draw(rng, "0", rng.randint(20, 30))
        return (v, v) if rng.random() < 0.6 else (assign(v), v)

    out = []
    for k in range(n):
        whole, value = secret() if k % 2 else mistake()
        left = prose(rng.randint(0, 5)) + rng.choice([" ", " ", "\n", "(", ""])
        right = rng.choice([" ", " ", ";", ",", "\n", ")"]) + prose(rng.randint(0, 5))
        out.append((whole, value, left[-CONTEXT:], right[:CONTEXT], k % 2))
    return out


# forest ---------------------------------------------------------------------------------------------


class Tree:
    """A node: a leaf's share of secrets, or a split `feature <= cut`."""

    __slots__ = ("share", "feature", "cut", "low", "high")

    def __init__(self, share: float):
        self.share, self.feature, self.cut, self.low, self.high = share, -1, 0.0, None, None

    def expression(self, names: list[str]) -> str:
        if self.low is None:
            return f"{self.share:.6f}D"
        return f"CASE WHEN {names[self.feature]} <= {self.cut!r}D THEN {self.low.expression(names)} ELSE {self.high.expression(names)} END"

    def value(self, x: np.ndarray) -> float:
        node = self
        while node.low is not None:
            node = node.low if x[node.feature] <= node.cut else node.high
        return node.share


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int) -> Tree:
    node = Tree(float(y.mean()))
    if depth == 0 or len(y) < 2 * LEAF or node.share in (0.0, 1.0):
        return node
    best = None
    for f in rng.choice(x.shape[1], size=max(2, int(np.sqrt(x.shape[1])) + 1), replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y) + 1)
        at = np.flatnonzero(v[:-1] < v[1:])
        at = at[(n[at] >= LEAF) & (len(y) - n[at] >= LEAF)]
        if not len(at):
            continue
        low, high = t[at] / n[at], (t[-1] - t[at]) / (len(y) - n[at])
        impurity = n[at] * low * (1 - low) + (len(y) - n[at]) * high * (1 - high)
        k = int(impurity.argmin())
        if best is None or impurity[k] < best[0]:
            best = (impurity[k], f, float(np.round((v[at[k]] + v[at[k] + 1]) / 2, 9)))
    if best is None:
        return node
    _, node.feature, node.cut = best
    side = x[:, node.feature] <= node.cut
    if side.all() or not side.any():
        return Tree(node.share)
    node.low, node.high = grow(x[side], y[side], rng, depth - 1), grow(x[~side], y[~side], rng, depth - 1)
    return node


def findings_table(spark: SparkSession, rows: list[tuple[str, str, str, str, int]]) -> DataFrame:
    """The labelled findings as a table of literals: k, whole, value, left, right, label."""
    names = ("k", "whole", "value", "left", "right", "label")
    text = json.dumps([dict(zip(names, (k, *r), strict=True)) for k, r in enumerate(rows)])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), "array<struct<k:int,whole:string,value:string,left:string,right:string,label:int>>")))


_forests: dict[tuple, list[Tree]] = {}


def forest(spark: SparkSession, findings: int = FINDINGS, trees: int = TREES) -> list[Tree]:
    """Trees grown from the labelled findings, whose features the same SQL computes."""
    if (findings, trees) not in _forests:
        rows = labelled_findings(findings)
        table = findings_table(spark, rows)
        cols = features(F.col("whole"), F.col("value"), F.col("left"), F.col("right"))
        got = table.select("k", "label", *[c.alias(n) for c, n in zip(cols, FEATURES, strict=True)]).orderBy("k").collect()
        x = np.array([[r[n] for n in FEATURES] for r in got])
        y = np.array([r.label for r in got], dtype=float)
        rng = np.random.default_rng(3)
        out = []
        for _ in range(trees):
            draw = rng.integers(0, len(y), len(y))
            out.append(grow(x[draw], y[draw], rng, DEPTH))
        _forests[findings, trees] = out
    return _forests[findings, trees]


def find_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, finish (code points), whole, value, left, right: a row for each candidate.

    The text is cut at its candidates: piece i stands before candidate i, so places are running sums of lengths.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").rlike(CANDIDATE))
    rows = rows.select("doc_id", F.monotonically_increasing_id().alias("row"), F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("found"), F.split("text", CANDIDATE, -1).alias("piece"))
    around = F.transform(
        "found",
        lambda f, i: F.struct(
            F.length(F.element_at("piece", i + 1)).alias("gap"),
            f.alias("whole"),
            F.substring(F.element_at("piece", i + 1), -CONTEXT, CONTEXT).alias("left"),
            F.substring(F.element_at("piece", i + 2), 1, CONTEXT).alias("right"),
        ),
    )
    # only candidates with their surroundings are shuffled; a text's own are one sorted run
    before = Window.partitionBy("row").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.select("doc_id", "row", F.posexplode(around).alias("at", "f"))
    placed = placed.select("doc_id", (F.sum(F.col("f.gap") + F.length("f.whole")).over(before) - F.length("f.whole")).cast("int").alias("start"), "f")
    whole = F.col("f.whole")
    bare = F.regexp_replace(whole, rf"^{_ASSIGN}", "")
    value = F.regexp_extract(bare, r"(?s)^([\"']?)(.*?)\1$", 2)
    return placed.select("doc_id", "start", (F.col("start") + F.length(whole)).alias("finish"), whole.alias("whole"), value.alias("value"), F.col("f.left").alias("left"), F.col("f.right").alias("right"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, start, finish, kind, value, score of every finding that the forest takes for a secret."""
    trees = forest(docs.sparkSession)
    found = find_candidates(docs, id_col, text_col)
    cols = features(F.col("whole"), F.col("value"), F.col("left"), F.col("right"))
    names = [f"f_{n}" for n in FEATURES]
    scored = found.select("*", *[c.alias(n) for c, n in zip(cols, names, strict=True)])
    total = None
    for t in trees:
        part = F.expr(t.expression(names))
        total = part if total is None else total + part
    kind = F.when(F.col("f_prefix") == 1, "prefixed").when(F.col("whole").startswith("-----BEGIN"), "private_key").when(F.col("f_assigned") == 1, "assigned").otherwise("encoded")
    scored = scored.select("doc_id", "start", "finish", kind.alias("kind"), "value", F.round(total / len(trees), 6).alias("score"))
    return scored.where(F.col("score") >= threshold)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
