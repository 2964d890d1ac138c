import numpy as np
import pytest

from tessera.llm import langid

DATA = "/root/testdata/sf0.001"


def test_filter_returns_all_languages_of_a_gram():
    f = langid.Filters([f"l{i:03}" for i in range(130)])
    rng = np.random.default_rng(0)
    grams = rng.integers(0, 2**63, 4000).astype(np.uint64)
    for k, lang in enumerate(f.langs):
        f.add(lang, grams[k * 10 : k * 10 + 40])
    f.finish()
    counts = f.counts(grams, np.arange(len(grams)), len(grams))
    for k in range(130):
        assert (counts[k * 10 : k * 10 + 40, k] == 1).all()
    assert abs(counts[2000:].mean() - f.false_rate.mean()) < 0.01


def test_ngrams_do_not_cross_texts():
    a, _ = langid.ngrams(["Hello, world!"])
    both, owner = langid.ngrams(["Hello, world!", "12", "hello world"])
    assert (both[owner == 0] == a).all() and (both[owner == 2] == a).all() and not (owner == 1).any()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


def test_held_out_accuracy(spark, docs):
    got = langid.identify(docs, langid.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    out = got[got.held_out]
    assert len(out) > 30 and (out.lang == out.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_edges(spark, docs):
    model = langid.train(docs)
    rows = [(1, None), (2, ""), (3, "123 ... !!"), (None, "and the of"), (1, "é"), (5, "and the of in " * 50_000)]
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS lang", "true AS held_out", "1 AS score")
    got = {r.doc_id: r for r in langid.identify(table.where("doc_id IS NULL OR text IS NULL OR length(text) <> 1"), model).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and got[None].lang_pred == "en" and not got[None].held_out and got[5].lang_pred == "en"
    assert langid.identify(table.limit(0), model).count() == 0
    kept = langid.keep_identified(table, model)
    assert kept.columns == table.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["5", "None"]
    nothing = langid.train(docs.where("lang IS NULL"))
    assert {r.lang_pred for r in langid.identify(table, nothing).collect()} == {"und"}


def test_training_ignores_the_held_out_fold(spark, docs):
    from pyspark.sql import functions as F

    other = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, "zz").otherwise(F.col("lang")))
    assert (langid.train(docs).table == langid.train(other).table).all()


def test_long_texts_are_learned_from(spark):
    """A language with long texts only, and one whose single text is null."""
    rows = [(k, "zab" + " qux zor vim plo krat" * (6000 + k), "zz") for k in range(9)] + [(k, None, "nn") for k in range(10, 13)] + [(k, "the and of with that", "en") for k in range(20, 29)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(table)
    assert model.langs == ["en", "nn", "zz"]
    got = langid.identify(spark.createDataFrame([(1, "vim plo krat qux"), (2, "with that and the")], "doc_id long, text string"), model)
    assert {r.doc_id: r.lang_pred for r in got.collect()} == {1: "zz", 2: "en"}
    assert langid.train(table, max_langs=1).langs == ["en"]


def test_predictions_match_exact_ngram_sets(spark, docs):
    """The filters against Python sets of the same sample's n-grams, without hashing into bits."""
    import zlib
    from collections import Counter

    def grams(text):
        low = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in (" " + text.lower() + " ").encode())
        out = bytearray(low[:1])
        for b in low[1:]:
            if b != 0x20 or out[-1] != 0x20 or len(out) == 0:
                out.append(b)
        return [bytes(out[i : i + langid.WIDTH]) for i in range(len(out) - langid.WIDTH + 1)]

    rows = docs.select("doc_id", "text", "lang").collect()
    fold = [r for r in rows if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    sets = {}
    for lang in sorted({r.lang for r in fold}):
        sample = [r.text or "" for r in fold if r.lang == lang]
        assert len(sample) <= langid.SAMPLE_DOCS  # all of them are the sample here
        times = Counter(g for t in sample for g in set(grams(t)))
        sets[lang] = {g for g, n in times.items() if n >= min(langid.MIN_DOCS, len(sample))}
    got = {r.doc_id: r for r in langid.identify(docs, langid.train(docs)).collect()}
    same = every = 0
    for r in rows:
        if not (g := grams(r.text or "")) or not any(c.isalpha() for c in r.text):
            continue
        share = {lang: sum(x in s for x in g) / len(g) for lang, s in sets.items()}
        best = max(sorted(share), key=share.get)
        every += 1
        same += got[r.doc_id].lang_pred == best
        if len(g) > 200:
            assert abs(got[r.doc_id].share - share[best]) < 0.03
    assert every > 100 and same >= 0.99 * every


@pytest.mark.parametrize(("text", "has"), [("½", False), ("²", False), ("①②", False), ("Ⅷ", False), ("٣", False), ("_", False), ("é", True), ("字", True), ("1ª", True)])
def test_only_letters_are_letters(text, has):
    filters = langid.Filters(["en"])
    filters.finish()
    assert (filters.predict([text])[0][0] == "en") is has


def test_no_language_is_left_out(spark):
    rows = [(k, f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}zq word{'x' * (k // 676)} text", f"l{k:03}") for k in range(300)]
    assert len(langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").where("crc32(string(doc_id)) % 3 <> 1")).langs) > 190
