"""Exact removal of long repeated byte strings by sparse, distributed prefix doubling.

A window is a string of `length` bytes (200) that starts at some byte of a text. A window that also
starts anywhere else, in the same text or another, is repeated, and each byte that a repeated window
covers is removed.

Sorting a rank pair for every byte of a corpus would shuffle some twenty bytes for each byte of input in each round, so
doubling runs over a synchronising set of positions: of the strings of GRAM bytes that start in a window, the one with the least
hash (of equal ones the last) is the window's anchor. Equal windows have their anchor at the same offset, and about two in
`length` - GRAM positions are anchors. All windows of one anchor are one node: the anchor's position and the range of offsets
its windows lie at. A node's windows share a core and lie in a hull.

1. Positions are ranked by their gram; a gram of one occurrence has no repeated window and its node leaves.
2. Where also the hull occurs again, all windows of the node are repeated and the node is settled.
3. Other nodes are split into ranges of offsets, whose cores reach further to the left and to the right of the anchor, from 50
   over about 125 and 182 to 200 bytes. Each pair (rank so far, bytes at the new offsets) is sorted by Spark and its place in that order is
   the new rank. Ranking goes on until a rank is unique, or its core is a whole window of 200 bytes.

One node of each settled hull goes on as a witness, as its windows may equal some of an open node. Pairs are compared by
their bytes; only grams and hulls are told apart by hashes (of 64 bits, followed by bytes, and of 128 bits).

Scale: distinct pairs are counted with combining before the shuffle, so a line that a third of all texts share costs a row a
task; ranks are sorted once a distinct pair, and joined to one node a class. Nodes that repeat within one text are folded where the text
is read, so a periodic text of any length is a few rows. Open nodes carry their hull (at most 2 * 200 bytes), so whole texts are
joined once with open nodes and once with spans. Nothing is collected; broadcasts are of id lists of a checked size.

Defined results: a null text is empty; texts of under 200 bytes keep everything; repeated rows are texts
of their own, so each of them is removed whole; a null doc_id is a text like any other; an empty table gives an empty table. Columns
other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import BROADCAST_IDS, Scratch, only_ids
from tessera.llm.kernel import chunked, prefix_hash, range_hash, small_batches

LENGTH = 200
GRAM = 50
_U = np.uint64
digest = xxhash.xxh3_128_digest


def _block_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values, from prefix and suffix minima of blocks."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    full = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, dtype=_U)
    full[: len(values)] = values
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


#: Rows of (child, rank, flag) that may be broadcast.
REPS_ROWS = BROADCAST_IDS // 3
_BITS = _U(32)
_ROOM = _U((1 << 32) - 1)


def anchors(parts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, position, gram hash, first window, last window) of every anchor of a chunk of texts; a text's windows tile
    0..len - length. All texts are searched in one buffer; windows across two texts don't count."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    begins = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    if len(data) < length:
        e = np.empty(0, np.int64)
        return e, e, np.empty(0, _U), e, e
    starts = np.arange(len(data) - gram + 1)
    hashes = range_hash(prefix_hash(data), starts, starts + gram)
    # the least hash first, of equal ones the last position; 32 bits of hash decide, 32 hold the position
    key = ((hashes >> _BITS) << _BITS) | (_ROOM - starts.astype(_U))
    least = _block_minima(key, length - gram + 1)
    count = np.maximum(sizes - length + 1, 0)
    owner = np.repeat(np.arange(len(parts)), count)
    local = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    window = begins[owner] + local
    at = (_ROOM - (least[window] & _ROOM)).astype(np.int64)
    new = np.concatenate(([True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1]))) if len(at) else np.empty(0, bool)
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(at)])) - 1 if len(first) else first
    text = owner[first]
    return text, at[first] - begins[text], hashes[at[first]], local[first], local[last]


def rounds(length: int = LENGTH, gram: int = GRAM) -> list[int]:
    """Widths of the ranges of offsets a node is split into, round by round, each a multiple of the next; the last cores are
    whole windows."""
    eighth = -(-(length - gram + 1) // 8)
    return sorted({4 * eighth, eighth, 1}, reverse=True)


_SAMPLE = "gram long, u1 long, u2 long, d long, k long, pos int, far int, n int, times int, span boolean"


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """d, k: the key of a text; rows of equal keys have equal texts."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("d"), F.xxhash64(text).alias("k"), text.alias("text"))


def _grams(texts: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            for _, part in chunked(batch.column(0).to_pylist()):
                found = anchors([t.encode("utf-8", "surrogatepass") for t in part], length, gram)[2]
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["gram"])

    return texts.where(F.octet_length("text") >= length).select("text").mapInArrow(run, "gram long")


def _fold(text: np.ndarray, names: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Nodes whose hull occurs again in the same text: (nodes that stay, times each stands for, spans of all folded ones as
    (a node, start, end)). A periodic text of any length leaves a few nodes and one span."""
    order = np.lexsort((names[1::2], names[0::2], text))
    t, a, b = text[order], names[0::2][order], names[1::2][order]
    first = np.concatenate(([True], (t[1:] != t[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(t) else np.empty(0, bool)
    group = np.cumsum(first) - 1
    count = np.bincount(group) if len(t) else np.empty(0, np.int64)
    many = np.empty(len(t), dtype=bool)
    many[order] = count[group] > 1
    stay = np.sort(order[first])
    times = np.where(many[stay], 2, 1)
    at = np.flatnonzero(many)
    if not len(at):
        return stay, times, []
    new = np.concatenate(([True], (text[at[1:]] != text[at[:-1]]) | (start[at[1:]] > end[at[:-1]])))
    begin = np.flatnonzero(new)
    last = np.concatenate((begin[1:], [len(at)])) - 1
    return stay, times, list(zip(at[begin].tolist(), start[at[begin]].tolist(), end[at[last]].tolist(), strict=True))


def _samples(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """A row for each node: its gram, the name of its hull, its text and place, the offset of its first window, and windows less
    one. Nodes that repeat within a text are one row of times 2; what they cover comes as rows with span set."""
    schema = _arrow(_SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            d, k = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for begin, part in chunked(batch.column(2).to_pylist()):
                data = [t.encode("utf-8", "surrogatepass") for t in part]
                text, at, h, first, last = anchors(data, length, gram)
                far, n = at - first, last - first
                seeds = (far << 20 | n).tolist()
                names = np.frombuffer(b"".join([digest(data[i][p : q + length], s) for i, p, q, s in zip(text.tolist(), first.tolist(), last.tolist(), seeds, strict=True)]), dtype=">i8").astype(np.int64)
                stay, times, spans = _fold(text, names, first, last + length)
                columns = [x[stay] for x in (h.view(np.int64), names[0::2], names[1::2], d[begin + text], k[begin + text], at, far, n)]
                columns += [times, np.zeros(len(stay), dtype=bool)]
                yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
                if spans:
                    i, a, b = (np.array(x) for x in zip(*spans, strict=True))
                    zero = np.zeros(len(i), dtype=np.int64)
                    columns = [h.view(np.int64)[i], zero, zero, d[begin + text[i]], k[begin + text[i]], a, zero, b - a - length, zero, np.ones(len(i), dtype=bool)]
                    yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return texts.where(F.octet_length("text") >= length).select("d", "k", "text").mapInArrow(run, _SAMPLE)


def _ranked(cores: DataFrame, scratch: Scratch, *key: str) -> DataFrame:
    """Sort the distinct (rank, string at the next offsets) pairs; a pair's place in that order is its new rank."""
    return scratch.save(cores.orderBy(*key).select(*key, F.monotonically_increasing_id().alias("new_rank")), "ranked")


def _alive(classes: DataFrame, *key: str) -> DataFrame:
    """The cores that several hulls share of which one is still open; a core of one hull is unique, or settled with it."""
    return classes.groupBy(*key).agg(F.count("*").alias("hulls"), F.min("settled").alias("all_settled")).where("hulls > 1 AND NOT all_settled").select(*key)


def _children(nodes: DataFrame, width: int, before: int | None, length: int) -> DataFrame:
    """The nodes split into ranges of `width` offsets. part: what the child's core adds to its parent's on the left and on the
    right (in the first round, the whole core); h1, h2: a name of the child's hull; cid: a number of the child."""
    near = F.col("far") - F.col("n")
    child = nodes.withColumn("i", F.explode(F.sequence((near / width).cast("int"), (F.col("far") / width).cast("int"))))
    a, b = F.col("i") * width, F.least(F.col("i") * width + width - 1, F.lit(length - 1))
    far, low = F.least("far", b), F.greatest(near, a)

    def cut(start: Column, size: Column) -> Column:  # of the hull, which begins at the largest offset
        return F.substring(F.col("hull"), (F.col("far") - start + 1).cast("int"), size.cast("int"))

    if before is None:
        part = cut(a, a - b + length)
    else:
        up = F.floor(F.col("i") * width / before).cast("int")
        pa_, pb = up * before, F.least(up * before + before - 1, F.lit(length - 1))
        right = F.substring(F.col("hull"), (F.col("far") - pb + length + 1).cast("int"), (pb - b).cast("int"))
        part = F.concat(cut(a, a - pa_), right)
    child = child.select("id", "rank", "i", "d", "k", "pos", "settled", far.alias("c_far"), (far - low).alias("c_n"), part.alias("part"), cut(far, far - low + length).alias("c_hull"))
    name = lambda seed: F.xxhash64(F.lit(seed), "c_far", "c_n", "c_hull")
    return child.select("rank", "i", "part", name(1).alias("h1"), name(2).alias("h2"), (F.col("id") * 256 + F.col("i")).alias("cid"), "d", "k", "pos", F.col("c_far").alias("far"), F.col("c_n").alias("n"), "settled", F.col("c_hull").alias("hull"))


def repeated_spans(texts: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """d, k, spans: for each text with a repeated window, the byte ranges that repeated windows cover."""
    span = lambda: F.struct((F.col("pos") - F.col("far")).alias("start"), (F.col("pos") - F.col("far") + F.col("n") + length).alias("end"))
    listed = lambda rows: scratch.save(rows.groupBy("d", "k").agg(F.collect_list(span()).alias("spans")), "spans")
    # rank 0: the grams at the anchors; unique ones leave with all their windows
    grams = scratch.save(_grams(texts, length, gram).groupBy("gram").count().where("count > 1").select("gram"), "grams")
    shared = scratch.save(only_ids(_samples(texts, length, gram), grams, "gram"), "shared")
    scratch.drop("grams")
    rep = F.min(F.struct("d", "k", "pos", "far", "n")).alias("rep")
    classes = scratch.save(shared.where("NOT span").groupBy("gram", "u1", "u2").agg((F.sum("times") > 1).alias("settled"), rep), "classes")
    # a hull's name also tells its gram
    settled = scratch.save(classes.where("settled").select("u1", "u2"), "settled")
    spans = listed(only_ids(shared.where("times = 1"), settled, "u1", "u2").unionByName(shared.where("span")))
    ranked = _ranked(_alive(classes, "gram"), scratch, "gram")
    nodes = classes.join(ranked, "gram").select("rep.*", F.col("new_rank").alias("rank"), "settled")
    nodes = scratch.save(nodes, "reps")
    scratch.drop("shared", "classes", "settled", "ranked")
    if nodes.limit(1).count():
        # the open nodes take their own hulls along, so whole texts are read once here and not in the rounds
        keys = scratch.save(nodes.select("d", "k").distinct(), "keys")
        hull = F.substring(F.col("text").cast("binary"), F.col("pos") - F.col("far") + 1, F.col("n") + length)
        held = only_ids(texts.select("d", "k", "text"), keys, "d", "k").join(nodes, ["d", "k"])
        nodes = scratch.save(held.select("d", "k", "pos", "far", "n", "rank", "settled", hull.alias("hull"), F.monotonically_increasing_id().alias("id")), "open")
    before = None
    for width in rounds(length, gram):
        if not nodes.limit(1).count():
            break
        pair = ("rank", "i", "part")
        children = _children(nodes, width, before, length)
        classes = children.groupBy(*pair, "h1", "h2").agg(F.count("*").alias("c"), ((F.count("*") > 1) | F.max("settled")).alias("settled"), F.min("cid").alias("cid"))
        classes = scratch.save(classes, "classes")
        again = scratch.save(classes.where("c > 1").select("h1", "h2"), "again")
        listed(only_ids(children.where("NOT settled"), again, "h1", "h2"))
        if width > 1:
            ranked = _ranked(_alive(classes, *pair), scratch, *pair)
            reps = scratch.save(classes.join(ranked, list(pair)).select("cid", "new_rank", F.col("settled").alias("done")), "reps")
            # a child's number is met once, so this join keeps at most the reps
            few = reps.count() <= REPS_ROWS
            kept = children.join(F.broadcast(reps) if few else reps, "cid")
            nodes = scratch.save(kept.select("d", "k", "pos", "far", "n", F.col("new_rank").alias("rank"), F.col("done").alias("settled"), "hull", F.monotonically_increasing_id().alias("id")), "open")
            scratch.drop_but_last("open")
        scratch.drop("classes", "again", "ranked", "reps")
        before = width
    every = scratch.read("spans", spans.schema)
    out = scratch.save(every.groupBy("d", "k").agg(F.flatten(F.collect_list("spans")).alias("spans")), "all-spans")
    scratch.drop("open", "keys", "spans")
    return out


RESULT = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())]
)


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, with_kept: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (the remaining bytes) for every row."""
    scratch = Scratch(docs.sparkSession)
    texts = _keyed(docs, id_col, text_col)
    spans = repeated_spans(texts, scratch, length, gram)
    keys = scratch.save(spans.select("d", "k"), "span-keys")
    schema = T.StructType([*RESULT.fields, T.StructField("kept", T.BinaryType())]) if with_kept else RESULT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, rows=128):
            rows: dict[str, list] = {f.name: [] for f in schema}
            for text, held in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                gone = _merged(held or [])
                kept, at = [], 0
                for a, b in gone:
                    kept.append(data[at:a])
                    at = b
                kept.append(data[at:])
                left = b"".join(kept)
                rows["n_bytes"].append(len(data))
                rows["n_removed"].append(len(data) - len(left))
                rows["n_spans"].append(len(gone))
                rows["kept_sha256"].append(hashlib.sha256(left).hexdigest())
                if with_kept:
                    rows["kept"].append(left)
            rows["doc_id"] = batch.column(0)
            yield pa.RecordBatch.from_pydict(rows)

    # texts without a span stay where they are
    cut = only_ids(texts, keys, "d", "k").join(spans, ["d", "k"]).select("doc_id", "text", "spans")
    whole = only_ids(texts, keys, "d", "k", how="left_anti").select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    return whole.mapInArrow(run, schema).unionAll(cut.mapInArrow(run, schema))


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_kept=False)
