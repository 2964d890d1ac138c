"""The pipeline's rows against plain versions of its stages, on the smallest tables."""

import hashlib
import re
from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from tessera.llm import bpe, pii

DATA = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def near_classes(docs):
    sets = {d: Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for d, t in docs.items() if (w := words(t))}
    parent = {d: d for d in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n, m = sets[a].total(), sets[b].total()
            if min(n, m) >= 0.8 * max(n, m) and (low := (sets[a] & sets[b]).total()) >= 0.8 * (n + m - low) - 1e-9 and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {d: root(d) for d in docs}


@pytest.fixture(scope="module")
def result(spark):
    return {r.doc_id: r for r in cp.run(spark, DATA).collect()}


def test_rows(spark, result):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    docs = {r.doc_id: r.text for r in rows if re.search(r"[^\W\d_]", r.text or "")}
    classes = near_classes(docs)
    kept = {d: t for d, t in docs.items() if classes[d] == d}
    items = [" ".join(words(r.text)) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    kept = {d: t for d, t in kept.items() if not any(i in " ".join(words(t)) for i in items if len(i.split()) >= 4)}
    assert set(result) == set(kept)
    library = Tokenizer.from_file(bpe.default_tokenizer())
    for d, t in kept.items():
        masked = pii.redact(t, pii.find(t)[1])
        ids = library.encode(masked, add_special_tokens=False).ids
        assert (result[d].n_tokens, list(result[d].ids)) == (len(ids), ids)
        assert result[d].decoded_sha256 == hashlib.sha256(masked.encode()).hexdigest()


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_dedup", "decontamination", "personal_data", "bpe"]
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()


def test_stages_take_empty_tables_and_nulls(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    empty = docs.limit(0)
    nulls = docs.limit(3).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "CAST(NULL AS STRING) AS text", "CAST(NULL AS STRING) AS lang", "CAST(NULL AS STRING) AS source", "CAST(NULL AS BIGINT) AS n_chars")
    for name, stage in cp.STAGES:
        assert stage(spark, empty, DATA).count() == 0
        assert stage(spark, nulls, DATA).count() == (0 if name == "language_id" else 3)


def test_entry_lists_every_query():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {"pipeline"} <= names and {n.split("_")[0] for n in names if re.match(r"op\d+_", n)} == {f"op{i}" for i in range(1, 11)}


def test_stages_keep_clashing_columns_ties_and_long_texts(spark):
    """Extra columns of the names that stages use inside, repeated rows, one id with two texts, empty and very long texts."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(30)
    text = docs.where("lang = 'en' AND n_chars > 200").first().text
    more = [(900, text, "en", "s", len(text)), (900, text, "en", "s", len(text)), (900, text[::-1], "en", "s", 5), (901, "", None, None, 0), (902, text * 60, "en", "s", 9), (903, "same " * 20_000, "en", "s", 9)]
    rows = docs.unionAll(spark.createDataFrame(more, docs.schema))
    clash = ["_words", "n_words", "copy_a", "copy_b", "class_id", "band", "bands", "sketch", "d", "k", "spans", "held_out", "share", "n", "n_tokens", "ids", "item_id", "a", "b", "lead", "key"]
    rows = rows.selectExpr("*", *[f"'{c}!' AS {c}" for c in clash])
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, rows, DATA)
        assert out.columns == rows.columns, name
        got = out.collect()
        assert got and all(r[c] == f"{c}!" for r in got for c in clash)
    assert stage is not None
    encoded = cp.STAGES[-1][1](spark, rows, DATA).collect()
    assert len(encoded) == rows.count() and all(isinstance(r.n_tokens, int) for r in encoded)
