"""Citations by columns against the parser on plain strings, on generated texts."""

import random

from pyspark.sql import functions as F

from tessera.functions import citations as cit
from tessera.functions import references as rf

LAW = {"name": "시험법 시행령", "level": "시행령", "root": "시험법"}
FAMILY = [{"name": "시험법", "level": "법"}, {"name": "시험법 시행령", "level": "시행령"}, {"name": "시험법 시행규칙", "level": "시행규칙"}, {"name": "시험법 안전규칙", "level": "부령"}]
ORDER = ["1", "2", "3", "3-2", "4"]
NAMES = ["민법", "상가건물 임대차보호법", "시험법"]


def texts(n, seed):
    r = random.Random(seed)
    article = lambda: f"제{r.choice(('', ' '))}{r.randint(1, 12)}{r.choice(('', ' '))}조" + r.choice(("", "", f"의{r.randint(2, 4)}", f" 의 {r.randint(2, 4)}"))
    unit = lambda: f"제{r.randint(1, 5)}{r.choice('항호목')}"
    more = ["및 ", "또는 ", ", ", "·", " 와 ", "과 ", "부터 ", " 내지 ", "까지", " ", "", "\n", "를 ", ". ", "제3장 ", "x", "(", ")"]
    words = ["이 법 ", "같은 영 ", "동법 ", "이법", "전조", "다음 조 ", "같은 조", "동조례", "민법 ", "형법 ", "상가건물 임대차보호법 ", "시행령 ", "법 시행령 ", "시험법 ", "시험법\n시행규칙 ", "장관이 정한 제도법 ", "주택 공급에 관한 규칙 ", "대통령령 ", "규칙 ", "안전규칙 ", "법 ", "특례(가)", "전조례 "]
    out = []
    for _ in range(n):
        s = ""
        for _ in range(r.randint(0, 9)):
            s += r.choice((article, unit, lambda: r.choice(more), lambda: r.choice(more), lambda: r.choice(words), article))()
        out.append(s)
    return out


def test_columns_equal_the_parser(spark):
    rows = [(k, t) for k, t in enumerate([*texts(1500, 1), "", "제3조부터 제5조까지", "제9조의2 내지 제9조의4", "제5조부터 제3조까지", "이 법\n제 3조"])] + [(-1, None)]
    table = spark.createDataFrame(rows, "n long, said string").repartition(4).cache()
    lists = {r.n: [tuple(x) for x in r.refs] for r in cit.article_refs(table, "said").collect()}
    named = {r.n: [tuple(x) for x in r.refs] for r in cit.named_refs(table, "said", F.array(*map(F.lit, NAMES))).collect()}
    law = F.struct(*[F.lit(v).alias(k) for k, v in LAW.items()])
    family = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in f.items()]) for f in FAMILY])
    article = F.when(F.col("n") % 7 == 0, "9").otherwise(F.element_at(F.array(*map(F.lit, ORDER)), (F.pmod("n", F.lit(5)) + 1).cast("int")))
    out = cit.law_refs(table, "said", law, article, F.array(*map(F.lit, ORDER)), family)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    laws = {r.n: r.refs for r in out.collect()}
    assert len(lists) == len(rows)
    some = [0, 0, 0]
    for n, t in rows:
        want = [tuple(x[c] for c in ("key", "display", "paragraph", "item", "subitem")) for x in rf.article_refs(t)]
        assert lists[n] == want, t
        want_named = [(x["law"], x["key"], x["display"]) for x in rf.named_refs(t, NAMES)]
        assert named[n] == want_named, t
        own = "9" if n % 7 == 0 else ORDER[n % 5]
        want_law = rf.law_references(t, LAW, own, ORDER, FAMILY)
        got = [{**x.asDict(), "related": list(x.related), "articles": list(x.articles)} for x in laws[n]]
        assert got == want_law, t
        some = [a + len(b) for a, b in zip(some, (want, want_named, want_law))]
    assert min(some) > 40


def test_noise_names_equal_the_parser(spark):
    r = random.Random(3)
    words = ["법", "영", "시행령", "민법", "주택", "공급규칙", "장관이", "정한", "제도법", "특례(가)", "및", "이", "제3조", "훈령"]
    names = [" ".join(r.choice(words) for _ in range(r.randint(0, 5))) for _ in range(400)]
    got = spark.createDataFrame([(n,) for n in names], "name string").select("name", cit.is_noise_name(F.col("name")).alias("noise")).collect()
    assert all(x.noise == rf.is_noise_name(x["name"]) for x in got)


def test_each_text_is_read_once(spark, monkeypatch):
    said = ["제1조 및 제2조", "민법 제7조", None, "", "제1조 및 제2조"]
    rows = spark.createDataFrame([(k, said[k % 5], k % 2) for k in range(200)], "n long, t string, other int")
    read = []

    def find(d):
        read.append(d.count())
        return cit.article_refs(d, "said")

    want = {k: [r["key"] for r in rf.article_refs(said[k % 5])] for k in range(200)}
    for most in (cit.TEXTS_SENT, 0):  # by broadcast, then by shuffle
        monkeypatch.setattr(cit, "TEXTS_SENT", most)
        got = cit.once(rows, {"said": F.col("t")}, find)
        assert got.columns == ["n", "t", "other", "refs"] and {r.n: [x["key"] for x in r.refs] for r in got.collect()} == want
    own = cit.once(rows, {"said": F.concat(F.coalesce("t", F.lit("")), F.lit(" "), F.col("n"))}, find)
    assert own.count() == 200 and read == [4, 4, 200]
