"""Katz backoff language model: Good-Turing discounted n-gram counts, exactly normalised backoff weights, scores of whole texts.

Model. Tokens are runs without white space, A-Z lower-cased, and one end of text; a text's first token has the begin of text
before it. For c = count(context, w) in the training texts and C = count(context, any token):

    P(w | context) = d(c) * c / C                                    if c > 0
    P(w | context) = weight(context) * P(w | shorter context)        else, if C > 0
    P(w | context) = P(w | shorter context)                          else
    weight(context) = (1 - sum of d(c) * c / C) / (1 - sum of P(w | shorter context)), both sums over the w seen in the context

d(c) is Katz's discount from the counts of counts up to K, 1 above; K is lowered until all discounts lie between 0 and 1. A context
all of whose counts are above K would leave nothing to its unseen tokens; its C is one more. The shortest level has no context: what
its discounts leave is the probability of one more type, the unknown token. So the probabilities after every context sum to 1.

Spark's part. Texts are cut into blocks of bounded size (block table). At each level every block sends its distinct n-grams with
their training counts to the partition of their context (n-grams of a context that holds a large share of all tokens go by the whole
n-gram), packed and sorted, one row for a block and a partition. A partition adds the counts up, stores the
n-grams and the sums that make its contexts' weights, and answers each block in the order of its request; the answers are what the
block needs for the next level and for its scores. Tables are partitioned by kind and written at each level, so a lost executor costs
a re-read. To the driver come the counts of counts and the sums of large contexts, at most four a partition.

Words are told apart by 64-bit hashes, n-grams exactly.

Defined results: null and empty texts are one end token; each row is a text of its own, whatever its id; rows with a null id
are training rows; without training rows every token is the unknown token, of probability 1; an empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm.common import Scratch
from tessera.llm.kernel import mix64
from tessera.llm.words import Words, byte_set, packed, text_blocks, unpack

#: All bytes but blank and the controls 9 to 13.
LETTERS = ~byte_set((0x20, 0x20), (0x09, 0x0D))
ORDER = 2
#: Counts up to this one are discounted.
K = 5
#: Bytes of text in a block, and n-grams a partition receives (on average).
BLOCK_BYTES = 12 << 20
PART_ENTRIES = 1 << 20
#: Contexts with more than a part's share of all tokens divided by this are dealt out by their n-grams.
HOT = 4
#: No word contains a blank.
END, BEGIN = (xxhash.xxh3_64_intdigest(x) for x in (b" end", b" begin"))

_U = np.uint64


_KINDS = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType(), "boolean": T.BooleanType()}
_KINDS |= {f"array<{k}>": T.ArrayType(_KINDS[k]) for k in ("long", "boolean")}


def _struct(**fields: str) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in fields.items()])


BLOCK = _struct(block="long", doc_ids="array<long>", held="array<boolean>", sizes="binary", codes="binary", words="binary", seen="binary", n_words="long", n_tokens="long")
SLIM = _struct(block="long", doc_ids="array<long>", held="array<boolean>", sizes="binary", codes="binary", order="binary", begin="long")
REQUEST = _struct(part="int", block="long", keys="binary", words="binary", seen="binary", lower="binary", under="binary", hot="binary")
COUNTED = _struct(kind="string", block="long", part="int", keys="binary", words="binary", counts="binary", ids="binary", low="binary", sums="binary", rest="binary", hist="array<long>")
SCORE = _struct(doc_id="long", held_out="boolean", n_tokens="long", n_known="long", train_tokens="long", base_score="double", score="double")


def discounts(hist: list[int]) -> list[float]:
    """d(1), d(2) ... from the numbers of n-grams that occur once, twice ... (K + 1 of them); empty if no K gives valid ones."""
    n = [0, *hist]
    for k in range(len(hist) - 1, 0, -1):
        if all(n[1 : k + 2]) and (a := (k + 1) * n[k + 1] / n[1]) < 1:
            d = [((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) for r in range(1, k + 1)]
            if all(0 < x < 1 for x in d):
                return d
    return []


class Level:
    """What is known of one level from its counts in all training texts."""

    def __init__(self, hist: list[int]):
        self.d = np.array([1.0, *discounts(hist), 1.0])  # of 0, 1 to k, and all above
        self.k = len(self.d) - 2

    def mass(self, counts: np.ndarray) -> np.ndarray:
        """d(c) * c"""
        out = self.d[np.minimum(counts, self.k + 1)]
        out *= counts
        return out

    def taken(self, hist: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """The sum of d(c) * c over n-grams: hist, how many of count 1 to K a row; rest, the sum of the greater counts."""
        r = np.arange(1, K + 1)
        return hist @ self.mass(r) + rest


class Unigrams(Level):
    def __init__(self, hist: list[int], types: int, tokens: int, rest: int):
        super().__init__(hist)
        self.types, self.tokens = types, tokens
        full = not any(hist[: self.k])
        self.over = max(tokens + full, 1)
        self.unknown = 1 - float(self.taken(np.array(hist[:K]), np.array(rest))) / self.over

    def probability(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.mass(counts) / self.over, self.unknown)


def to_blocks(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of whole texts: ids, sizes in tokens, and tokens as numbers in the order of their frequency in the block."""
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), held, F.spark_partition_id().cast("long"))
    schema = to_arrow_schema(BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, part in enumerate(text_blocks(batches, 1, block_bytes)):
            w = Words(part.column(1), LETTERS)
            out = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
            hashes = [xxhash.xxh3_64_intdigest(x) for x in w.names.to_pylist()]
            names = np.array([*hashes, END, BEGIN], _U)
            sizes = w.counts + 1
            codes = np.insert(w.codes, np.cumsum(w.counts), len(hashes))
            del w
            times = np.bincount(codes, minlength=len(names))
            order = np.argsort(-times, kind="stable")
            code = np.empty(len(names), np.int32)
            code[order] = np.arange(len(names))
            codes, names = code[codes], names[order]
            seen = np.bincount(codes[np.repeat(~out, sizes)], minlength=len(names))
            seen[code[-1]] = np.count_nonzero(~out)
            values = [(int(part.column(3)[0].as_py()) << 32) + k, part.column(0).to_pylist(), out.tolist(), packed(sizes), _planes(codes), names.tobytes(), packed(seen), len(names), len(codes)]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, BLOCK)


def _rows(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _dicts(table: pa.Table) -> list[dict]:
    """The rows; binary values are views of the table's buffers, not copies."""
    columns = [[x.as_buffer() for x in c] if pa.types.is_binary(c.type) else c.to_pylist() for c in table.columns]
    return [dict(zip(table.column_names, values, strict=True)) for values in zip(*columns, strict=True)]


def _cuts(part: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, from, to) of the parts that sorted rows have."""
    at = np.searchsorted(part, np.arange(parts + 1))
    return [(int(p), int(at[p]), int(at[p + 1])) for p in np.flatnonzero(np.diff(at))]


def _word_order(words: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    part = (mix64(words) % _U(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, part[order]


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32, all first bytes, then all second ones ...: the later ones are mostly zero."""
    return numbers.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.frombuffer(planes, np.uint8).reshape(4, -1).T.copy().view(np.int32).ravel()


def to_slim(blocks: DataFrame, parts: int) -> DataFrame:
    """Blocks for scoring: in place of the words' hashes, the order in which they are asked for, and the number of the begin."""
    schema = to_arrow_schema(SLIM)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, *rest in zip(*(batch.column(k) for k in range(batch.num_columns)), strict=True):
                words = np.frombuffer(words.as_py(), _U)
                begin = int(np.flatnonzero(words == _U(BEGIN))[0])
                values = [x.as_py() for x in rest] + [_planes(_word_order(words, parts)[0]), begin]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    return blocks.select("words", "block", "doc_ids", "held", "sizes", "codes").mapInArrow(run, SLIM)


def word_requests(blocks: DataFrame, parts: int) -> DataFrame:
    """Every block's distinct words with their training counts."""
    schema = to_arrow_schema(REQUEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, seen in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, seen = np.frombuffer(words, _U), unpack(seen)
                order, part = _word_order(words, parts)
                words, seen = words[order], seen[order]
                yield _rows(schema, [{"part": p, "block": block, "keys": words[a:b].tobytes(), "seen": packed(seen[a:b])} for p, a, b in _cuts(part, parts)])

    return blocks.select("block", "words", "seen").mapInArrow(run, REQUEST)


def _hist(counts: np.ndarray) -> list[int]:
    return np.bincount(counts[counts <= K + 1], minlength=K + 2)[1:].tolist()


def count_words(parts: int) -> Callable[[pa.Table], pa.Table]:
    """A partition's words: counts to be stored, answers (count and number of each word asked for), counts of counts."""
    schema = to_arrow_schema(COUNTED)

    def run(rows: pa.Table) -> pa.Table:
        rows = _dicts(rows)
        part = rows[0]["part"]
        keys = [np.frombuffer(r["keys"], _U) for r in rows]
        words, inv = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(words), np.int64)
        np.add.at(total, inv, np.concatenate([unpack(r["seen"]) for r in rows]))
        rank = np.empty(len(words), np.int64)
        rank[np.argsort(-total, kind="stable")] = np.arange(len(words))
        ids = rank * parts + part
        at = np.cumsum([0, *map(len, keys)])
        out = [{"kind": "answer", "block": r["block"], "part": part, "counts": packed(total[inv[a:b]]), "ids": packed(ids[inv[a:b]])} for r, a, b in zip(rows, at, at[1:], strict=False)]
        known = total > 0
        out.append({"kind": "grams", "part": part, "words": words[known].tobytes(), "ids": packed(ids[known]), "counts": packed(total[known])})
        own = total[known & (words != _U(BEGIN))]
        out.append({"kind": "hist", "part": part, "hist": [*_hist(own), len(own), int(own.sum()), int(own[own > K].sum())]})
        return pa.Table.from_pylist(out, schema=schema)

    return run


class Block:
    """A block's tokens, and level by level its distinct n-grams with their counts.

    At level k, gram[i] is the number of the k-gram that ends at token i (-1 where the text has no k tokens up to there, its begin
    counted as one); of the distinct ones, ctx is the number of the (k-1)-gram before the last word, word that word, `at` a token
    where it ends, p its probability. What has an entry a token is in 32 bits, and the floating numbers are those of distinct n-grams,
    so that a block takes a small multiple of its text.
    """

    def __init__(self, row: dict, answers: dict[int, list[dict]], parts: list[int], levels: list[Level], limits: list[int]):
        self.sizes = unpack(row["sizes"])
        code = _numbers(row["codes"])
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.gram, self.word_of, self.levels, self.limits = [code], code, levels, limits
        order = _numbers(row["order"])
        self.count, self.id = [self._restore(order, answers[1], "counts")], [self._restore(order, answers[1], "ids")]
        self.begin = row["begin"]
        self.ctx, self.word, self.at = [None], [np.arange(len(order))], [None]
        self.p = [levels[0].probability(self.count[0])]

    @staticmethod
    def _restore(order: np.ndarray, rows: list[dict], name: str) -> np.ndarray:
        out, a = np.empty(len(order), np.int64), 0
        for r in sorted(rows, key=lambda r: r["part"]):
            values = unpack(r[name])
            out[order[a : a + len(values)]] = values
            a += len(values)
        return out

    def climb(self, parts: int) -> None:
        """Number the n-grams of the next level; `order` is that of the requests, by partition, context and word."""
        k = len(self.gram) + 1
        before = np.empty_like(self.gram[-1])
        before[1:] = self.gram[-1][:-1]
        before[self.begins] = self.begin if k == 2 else -1
        width = len(self.count[0])
        ends = np.flatnonzero(before >= 0).astype(np.int32)
        key = before[ends] * np.int64(width)
        key += self.word_of[ends]
        del before
        order = np.argsort(key)
        key, ends = key[order], ends[order]
        del order
        new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.empty(0, bool)
        gram = np.full(len(self.word_of), -1, np.int32)
        gram[ends] = np.cumsum(new, dtype=np.int32) - 1
        key, at = key[new], ends[new]
        del ends, new
        ctx = (key // width).astype(np.int32)
        word = (key - ctx * np.int64(width)).astype(np.int32)
        del key
        own, total = self.id[-1][ctx], self.count[-1][ctx]
        self.hot = total > self.limits[k - 2]
        del total
        mixed = mix64(own.astype(_U))
        part = np.where(self.hot, mix64(mixed + self.id[0][word].astype(_U)), mixed) % _U(parts)
        self.part = part.astype(np.int32)
        del mixed, part
        self.order = np.lexsort((self.id[0][word], own, self.part))
        self.gram.append(gram), self.ctx.append(ctx), self.word.append(word), self.at.append(at)

    def requests(self, train: np.ndarray, parts: int) -> list[dict]:
        ctx, word, at, o = self.ctx[-1], self.word[-1], self.at[-1], self.order
        seen = np.bincount(self.gram[-1][(self.gram[-1] >= 0) & train], minlength=len(ctx))[o]
        suffix = self.gram[-2][at]
        lower = self.count[-1][suffix][o]
        under = self.count[-2][self.ctx[-2][suffix]][o] if len(self.count) > 1 else None
        full = self.full[suffix][o] if len(self.count) > 1 else None
        del suffix
        own, w, hot = self.id[-1][ctx[o]], self.id[0][word[o]], self.hot[o]
        out = []
        for p, a, b in _cuts(self.part[o], parts):
            first = np.concatenate(([True], own[a + 1 : b] != own[a : b - 1]))
            delta = np.diff(w[a:b], prepend=0)
            delta[first] = w[a:b][first]
            out.append({"part": p, "keys": packed(np.diff(own[a:b], prepend=0)), "words": packed(delta), "seen": packed(seen[a:b]), "lower": packed(lower[a:b]), "hot": packed(np.flatnonzero(hot[a:b][first]))})
            if under is not None:
                out[-1]["under"] = packed(under[a:b] + full[a:b])
        return out

    def take(self, rows: list[dict], level: Level, large: dict[int, tuple], last: bool) -> None:
        """Counts, weights and probabilities of the level just numbered, from the answers and the sums of large contexts."""
        o, rows = self.order, sorted(rows, key=lambda r: r["part"])
        count = self._restore(o, rows, "counts")
        self.count.append(count)
        self.id.append(None if last else self._restore(o, rows, "ids"))
        # a context's rows stand together within a partition
        own, part = self.ctx[-1][o], self.part[o]
        head = np.concatenate(([True], (own[1:] != own[:-1]) | (part[1:] != part[:-1])))
        group = np.cumsum(head, dtype=np.int32) - 1
        of, hot = own[head], np.flatnonzero(self.hot[o][head])
        del own, part, head
        low = np.concatenate([np.frombuffer(r["low"], np.uint8) for r in rows]).astype(np.int64)
        asked = np.zeros(len(low), bool)
        asked[group[count[o] == 0]] = True
        asked = np.flatnonzero(asked & (low > 0))
        back = np.empty(len(o), np.int32)
        back[o] = group
        del o, group
        self.order = self.part = self.hot = None
        shorter, hist = np.zeros(len(low)), np.zeros((len(low), K + 1), np.int64)
        shorter[asked] = np.concatenate([np.frombuffer(r["sums"], np.float64) for r in rows])
        a = 0
        for r in rows:
            rest = unpack(r["rest"]).reshape(-1, K + 1)
            hist[asked[a : a + len(rest)]] = rest
            a += len(rest)
        for g in hot:
            low[g], shorter[g], hist[g] = large[int(self.id[-2][of[g]])]
        total = self.count[-2][of]
        full = (low > level.k) & (low > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            weight = (1 - level.taken(hist[:, :K], hist[:, K]) / (total + full)) / (1 - shorter)
        weight = np.where((total > 0) & (low > 0), weight, 1.0)
        del hist, shorter, of
        self.full = full[back]
        seen = level.mass(count)
        with np.errstate(divide="ignore", invalid="ignore"):
            seen /= (total + full)[back]
        backed = weight[back]
        backed *= self.p[-1][self.gram[-2][self.at[-1]]]
        self.p.append(np.where(count > 0, seen, backed))

    def logs(self) -> np.ndarray:
        """The logarithm of each token's probability, at the highest level it has."""
        out = np.log10(self.p[0])[self.word_of]
        for gram, p in zip(self.gram[1:], self.p[1:], strict=True):
            ends = gram >= 0
            out[ends] = np.log10(p)[gram[ends]]
        return out


def count_grams(parts: int, lower: Level, unigrams: bool, last: bool) -> Callable[[pa.Table], pa.Table]:
    """A partition's n-grams: counts and the sums of their contexts to be stored, answers, counts of counts."""
    schema = to_arrow_schema(COUNTED)

    def run(rows: pa.Table) -> pa.Table:
        rows = _dicts(rows)
        part = rows[0]["part"]
        each = [unpack(r["seen"]) for r in rows]
        at = np.cumsum([0, *map(len, each)])
        ctx, word, heads = [], [], []
        for r in rows:
            c = np.cumsum(unpack(r["keys"]))
            w = unpack(r["words"])
            first = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
            run_ = np.cumsum(w)
            run_ -= np.repeat(run_[first] - w[first], np.diff(np.append(first, len(c))))
            ctx.append(c), word.append(run_), heads.append(first)
        ctx, word, seen = np.concatenate(ctx), np.concatenate(word), np.concatenate(each)
        low_count = np.concatenate([unpack(r["lower"]) for r in rows])
        p = lower.probability(low_count) if unigrams else lower.mass(low_count) / np.maximum(np.concatenate([unpack(r["under"]) for r in rows]), 1)
        order = np.lexsort((word, ctx))
        c, w = ctx[order], word[order]
        new = np.concatenate(([True], (c[1:] != c[:-1]) | (w[1:] != w[:-1])))
        first = np.flatnonzero(new)
        total = np.add.reduceat(seen[order], first)
        gram = np.empty(len(order), np.int64)
        gram[order] = np.cumsum(new) - 1
        c, w, p = c[first], w[first], p[order][first]
        open_ = np.concatenate(([True], c[1:] != c[:-1]))
        start = np.flatnonzero(open_)
        group = np.cumsum(open_) - 1
        names = c[start]
        known = total > 0
        shorter = np.bincount(group, weights=p * known, minlength=len(names))
        hist = np.zeros((len(names), K + 1), np.int64)
        small = known & (total <= K)
        np.add.at(hist, (group[small], total[small] - 1), 1)
        np.add.at(hist[:, K], group[total > K], total[total > K])
        low = np.minimum.reduceat(np.where(known, np.minimum(total, K + 1), K + 2), start)
        low[low == K + 2] = 0
        ids = np.arange(len(c)) * parts + part
        out, hot = [], np.zeros(len(names), bool)
        for r, a, b, head in zip(rows, at, at[1:], heads, strict=False):
            mine = gram[a:b]
            g = group[mine[head]]
            hot[g[unpack(r["hot"])]] = True
            miss = np.logical_or.reduceat(total[mine] == 0, head) & (low[g] > 0)
            out.append({"kind": "answer", "block": r["block"], "part": part, "counts": packed(total[mine]), "low": low[g].astype(np.uint8).tobytes(), "sums": shorter[g[miss]].tobytes(), "rest": packed(hist[g[miss]].ravel())})
            if not last:
                out[-1]["ids"] = packed(ids[mine])
        out += [{"kind": "hot", "part": part, "block": int(names[g]), "sums": shorter[g : g + 1].tobytes(), "hist": [int(low[g]), *hist[g].tolist()]} for g in np.flatnonzero(hot)]
        have = (low > 0) & ~hot
        out.append({"kind": "contexts", "part": part, "keys": packed(np.diff(names[have], prepend=0)), "sums": shorter[have].tobytes(), "rest": packed(hist[have].ravel())})
        out.append({"kind": "grams", "part": part, "keys": packed(np.diff(c[known], prepend=0)), "words": packed(w[known]), "counts": packed(total[known])})
        out.append({"kind": "hist", "part": part, "hist": _hist(total[known])})
        return pa.Table.from_pylist(out, schema=schema)

    return run


def _large(table: DataFrame) -> dict[int, tuple]:
    """Sums of the contexts that were dealt out over partitions: least count, probability in the shorter context, counts of counts."""
    out: dict[int, tuple] = {}
    for r in table.where("kind = 'hot'").select("block", "sums", "hist").toLocalIterator():
        low, shorter, hist = r.hist[0], np.frombuffer(r.sums, np.float64)[0], np.array(r.hist[1:], np.int64)
        if r.block in out:
            a, b, c = out[r.block]
            low, shorter, hist = min(a, low) if a and low else a or low, b + shorter, c + hist
        out[r.block] = (low, shorter, hist)
    return out


def score(docs: DataFrame, held: Column, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, part_entries: int = PART_ENTRIES) -> DataFrame:
    """Learns from the rows where `held` is false and scores all: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    whole = scratch.save(to_blocks(docs, held, id_col, text_col, block_bytes), "blocks")
    size = whole.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("words"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens")).first()
    deal = lambda n: n // part_entries + 1
    parts = [deal(size.words)] + [deal(size.tokens)] * (order - 1)
    blocks = to_slim(whole, parts[0])
    asked = word_requests(whole, parts[0]).groupBy("part").applyInArrow(count_words(parts[0]), COUNTED)
    tables = [scratch.save(asked, "level1", by="kind")]
    hist = [sum(x) for x in zip(*(r.hist for r in _sums(tables[0], K + 4)), strict=True)] or [0] * (K + 4)
    levels: list[Level] = [Unigrams(hist[: K + 1], hist[-3], hist[-2], hist[-1])]
    limits: list[int] = []
    larges: list[dict] = []
    for k in range(2, order + 1):
        limits.append(levels[0].tokens // (HOT * parts[k - 1]) + 1)
        asked = _with_answers(blocks, tables).applyInArrow(_asker(k, parts, levels, limits, larges), REQUEST)
        tables.append(scratch.save(asked.groupBy("part").applyInArrow(count_grams(parts[k - 1], levels[-1], k == 2, k == order), COUNTED), f"level{k}", by="kind"))
        levels.append(Level(_sums(tables[-1], K + 1)[0].hist or [0] * (K + 1)))
        larges.append(_large(tables[-1]))
    return _with_answers(blocks, tables).applyInArrow(_scorer(order, parts, levels, limits, larges), SCORE)


def _sums(table: DataFrame, n: int) -> list:
    """One row: the sums of the n numbers in `hist` over all partitions."""
    hist = table.where("kind = 'hist'")
    return hist.agg(F.array(*[F.coalesce(F.sum(F.col("hist")[i]), F.lit(0)) for i in range(n)]).alias("hist")).collect()


def _with_answers(blocks: DataFrame, tables: list[DataFrame]):
    """Each block together with its answers of all levels."""
    answers = reduce(DataFrame.unionAll, [t.where("kind = 'answer'").select("block", "part", "counts", "ids", "low", "sums", "rest", F.lit(k + 1).alias("level")) for k, t in enumerate(tables)])
    return blocks.groupBy("block").cogroup(answers.groupBy("block"))


def _read(left: pa.Table, right: pa.Table, parts: list[int], levels: list[Level], limits: list[int], larges: list[dict], upto: int) -> tuple[dict, Block]:
    """The block with its levels up to `upto`."""
    row = _dicts(left)[0]
    answers: dict[int, list[dict]] = {}
    for r in _dicts(right):
        answers.setdefault(r["level"], []).append(r)
    block = Block(row, answers, parts, levels, limits)
    for k in range(2, upto + 1):
        block.climb(parts[k - 1])
        block.take(answers[k], levels[k - 1], larges[k - 2], k not in answers or answers[k][0]["ids"] is None)
    return row, block


def _asker(k: int, parts: list[int], levels: list[Level], limits: list[int], larges: list[dict]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    schema = to_arrow_schema(REQUEST)
    levels, limits, larges = list(levels), list(limits), list(larges)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row, block = _read(left, right, parts, levels, limits, larges, k - 1)
        block.climb(parts[k - 1])
        train = np.repeat(~np.array(row["held"], bool), block.sizes)
        return pa.Table.from_pylist([r | {"block": row["block"]} for r in block.requests(train, parts[k - 1])], schema=schema)

    return run


def _scorer(order: int, parts: list[int], levels: list[Level], limits: list[int], larges: list[dict]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    schema = to_arrow_schema(SCORE)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row, block = _read(left, right, parts, levels, limits, larges, order)
        n, types = levels[0].tokens, levels[0].types
        times, of, begins, sizes = block.count[0], block.word_of, block.begins, block.sizes
        add = lambda x: np.add.reduceat(x, begins)  # noqa: E731  every text has a token
        best = add(block.logs())
        del block
        base = np.log10((times + 0.1) / (n + 0.1 * (types + 1)))
        columns = [row["doc_ids"], row["held"], sizes, np.add.reduceat((times > 0)[of], begins, dtype=np.int64), np.full(len(sizes), n), add(base[of]), best]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def op13_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False)))
