import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import search as s
from tessera.llm import words

DATA = "/root/testdata/sf0.001"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall((text or "").translate(UP))


def plain(docs, items, top=10):
    """(item, rank, doc, score) by scoring every document for every item."""
    own = [(i, Counter(terms(t))) for i, t in docs]
    own = [(i, c) for i, c in own if c]
    n, total = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(w for _, c in own for w in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for item, ws in asked.items():
        found = []
        for i, c in own:
            m = 100 - 90 + 90 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1000000000 * c[w] // (1000 * c[w] + 8 * m)) for w in ws if c[w])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if null else i, -score) for k, (score, null, i) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def made(n, seed):
    r = random.Random(seed)
    names = ["the", "AND", "é", "x1", "Ärger", "ß", *(f"w{k}" for k in range(60))]
    mark = [" ", "\n", "-", "'", "@", "[", "\x7f", "\t"]
    return [(k * 3 - n, "".join(r.choice(names[: r.choice((6, 66))]) + r.choice(mark) for _ in range(r.choice((0, 1, 3, 40))))) for k in range(n)]


def test_against_brute_force(spark):
    docs = made(300, 1)
    docs += [(5000, None), (5001, ""), (None, "the w1 w2"), (None, "the w1 w2"), (7, "w5 w6 w7"), (7, "w5 w6 w7"), (7, "w5"), (9999, "w9 " * 300_000)]
    items = [(1, "the w1 W2 w2"), (2, "w5 w6"), (3, None), (4, "nothing here"), (None, "w9"), (6, "w1"), (6, "w3"), (8, "the and É é")]
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS shard", "'a' AS term", "2 AS score").repartition(5)
    for size in (1 << 24, 500):
        index = s.build_index(table, shard_bytes=size).cache()
        asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "3 AS w", "'z' AS term")
        assert got(s.search(index, asked)) == plain(docs, items)
        assert got(s.search(index, asked, top=2, block_terms=3)) == plain(docs, items, 2)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert got(s.search(s.build_index(docs), items)) == []
    full = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert got(s.search(s.build_index(full), items.limit(0))) == []
    assert s.search(s.build_index(full), items).first().doc_id == 1


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    assert got(s.op11_search(spark, DATA)) == sorted(con.execute(s.OP11_SQL).fetchall(), key=str)


@pytest.mark.parametrize("seed", range(30))
def test_merge_keeps_the_best(seed):
    r = random.Random(seed)
    lists, every = [], Counter()
    for _ in range(r.randint(1, 8)):
        docs = sorted(r.sample(range(200), r.randint(1, 150)))
        parts = [r.randint(1, r.choice((2, 30))) for _ in docs]
        lists.append((max(parts), docs, parts))
        every.update(dict(zip(docs, parts)))
    for top in (1, 10, 300):
        assert sorted(s.merge(lists, top), key=lambda x: (-x[0], x[1])) == sorted(((v, d) for d, v in every.items()), key=lambda x: (-x[0], x[1]))[:top]


def test_long_lengths_do_not_overflow():
    assert s._norms(np.array([1, 10**9]), 10**11, 10**13).tolist() == [10, 10 + 90 * 10**9 * 10**11 // 10**13]


def test_packing():
    rng = np.random.default_rng(0)
    for bits in (1, 7, 8, 20, 63):
        v = rng.integers(0, 1 << bits, 1000, dtype=np.int64)
        data, at = words.pack(v)
        assert (words.unpack(data.tobytes()) == v).all() and at[-1] == len(data)
    assert len(words.unpack(words.packed(np.empty(0, np.int64)))) == 0


def test_blocks_are_whole_and_bounded():
    texts = ["a" * n for n in (5, 0, 100, 7, 7, 7, 300, 1)] + [None]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + 3)), pa.array(texts[k : k + 3], pa.string())], ["id", "text"]) for k in (0, 3, 6)]
    for limit in (1, 10, 50, 1000):
        out = list(words.text_blocks(iter(batches), 1, limit))
        assert [x for b in out for x in b.column(0).to_pylist()] == list(range(9))
        assert [x for b in out for x in b.column(1).to_pylist()] == [t or "" for t in texts]
        assert all(b.num_rows == 1 or sum(map(len, b.column(1).to_pylist())) <= limit for b in out)


def test_words_of_texts():
    texts = ["Ab c", "", "c", "--", "ÀB ab"]
    w = words.Words(pa.array(texts, pa.large_string()), s.LETTERS)
    names = [x.decode() for x in w.names.to_pylist()]
    assert [names[c] for c in w.codes] == ["ab", "c", "c", "Àb", "ab"] and w.counts.tolist() == [2, 0, 1, 0, 2]
