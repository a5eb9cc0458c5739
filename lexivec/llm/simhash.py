"""SimHash near-duplicates by a self-join of binary tries, and connected components.

1. Tasks hash every word shingle of a whole text and take the majority of each bit
   (``signatures``); only ids and signatures go on.
2. Equal signatures become one vertex.  ``tables`` names bit blocks of the signature; rows are dealt by
   (table, block value), the upper levels of a trie whose block comes first.  With more blocks than
   allowed differing bits every link shares a block (64 bits in 4 blocks: exact for 3 bits).
   A block value that holds over ``max_node`` signatures is descended ``SPLIT`` bits further, and its node
   pairs, as far as the error budget allows them, are dealt as groups of their own.
3. Inside a task, node pairs of the tries are traversed together level by level: differing bits add up, a pair
   over the budget is dropped, as is a pair whose leaves are in one component already.  Small node pairs are
   compared leaf by leaf.  A task returns the edges of a spanning forest, each a pair within the budget, never all pairs.
4. Large-star and small-star rounds join the forests; each is checkpointed in the shared folder.

Defined cases: a null text is an empty text; a text without words has signature zero and links like any other;
a text of fewer words than a shingle is one shingle; repeated rows share a signature and so a component;
null ids are never the smallest unless all of a component's are null; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivec.llm.bpe import pieces
from lexivec.llm.common import checkpointed, likely_in, row_key, written

SPLIT = 6
ROUND_ROWS = 20_000  # of edges in a task and file of a components round
BUCKET = 32  # leaf pairs that are compared directly


def blocks(bits: int, width: int) -> list[tuple[int, int, int]]:
    """Word, shift and width of consecutive bit blocks."""
    return [(b // 64, 64 - width - b % 64, width) for b in range(0, bits, width)]


def hashed_shingles(text: str, shingle: int) -> np.ndarray:
    """XXH64 with seed 42 of every word shingle."""
    w = text.encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    s = [b" ".join(x) for x in zip(*(w[i:] for i in range(shingle)), strict=False)] if len(w) >= shingle else [b" ".join(w)]
    return np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in s), np.uint64, len(s))


def majority(h: np.ndarray, words: int) -> np.ndarray:
    """``words`` 64-bit words, the first by the hashes themselves, the others by mixing them."""
    out = np.zeros(words, np.uint64)
    if not len(h):
        return out
    for k in range(words):
        if k:
            x = h + np.uint64((0x9E3779B97F4A7C15 * k) & (2**64 - 1))
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
        else:
            x = h
        ones = np.unpackbits(x.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out[k] = np.packbits(ones * 2 > len(h)).view(">u8")[0]
    return out


def fingerprint(text: str, shingle: int, words: int) -> np.ndarray:
    return majority(hashed_shingles(text, shingle), words)


def signatures(docs: DataFrame, *, text: str = "text", keep: Sequence[str] = ("doc_id",), shingle: int = 3, bits: int = 64) -> DataFrame:
    """``keep`` and ``sig``, an array of ``bits`` / 64 longs."""
    frame = docs.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{text}`").alias("_text"))
    schema = T.StructType([*frame.schema.fields[:-1], T.StructField("sig", T.ArrayType(T.LongType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for whole in batches:
                for batch in pieces(whole):
                    texts = batch.column(batch.num_columns - 1).to_pylist()
                    sig = np.concatenate([fingerprint(t or "", shingle, bits // 64) for t in texts]).view(np.int64)
                    yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _lists(sig.reshape(-1, bits // 64))], [*batch.schema.names[:-1], "sig"])

    return frame.mapInArrow(run, schema)


def trie_links(distinct: DataFrame, *, bits: int, budget: int, tables: list[tuple[int, int, int]], max_node: int = 200_000) -> DataFrame:
    """Edges ``a``, ``b`` between signatures: spanning forests of all links within a table's block."""
    value = lambda t: F.shiftrightunsigned(F.get("sig", F.lit(t[0])), t[1]).bitwiseAND(F.lit((1 << t[2]) - 1))
    dealt = distinct.select(F.posexplode(F.array(*[value(t) for t in tables])).alias("t", "v"), "sig")
    # Few block values are crowded; the table of those has at most rows / max_node entries.
    crowded = dealt.groupBy("t", "v").count().where(F.col("count") > max_node).select("t", "v", F.lit(True).alias("crowded"))
    dealt = dealt.join(F.broadcast(crowded), ["t", "v"], "left")
    node = _node(tables)
    pairs = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit((1 << SPLIT) - 1)), lambda q: F.struct(F.least(node, q).alias("p"), F.greatest(node, q).alias("q"))),
        lambda x: F.bit_count(x["p"].bitwiseXOR(x["q"])) <= budget,
    )
    whole = F.array(F.struct(F.lit(-1).alias("p"), F.lit(-1).alias("q")))
    dealt = dealt.select("t", "v", "sig", node.alias("node"), F.explode(F.when(F.col("crowded"), pairs).otherwise(whole)).alias("n"))
    dealt = dealt.select("t", "v", "n.p", "n.q", F.when(F.col("n.p") >= 0, F.col("node")).otherwise(-1).alias("node"), "sig")
    pair = F.array(F.lit(0).cast("long"))
    schema = distinct.select(pair.alias("a"), pair.alias("b")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        sig = table.column("sig").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, bits // 64)
        group = np.stack([table.column(c).to_numpy() for c in ("t", "v", "p", "q", "node")])
        order = np.lexsort([*sig.T[::-1], *group[::-1]])
        sig, group = sig[order], group[:, order]
        _, a, b = forest(sig, *roots(group), budget)
        for i in range(0, len(a), 50_000):
            yield pa.RecordBatch.from_arrays([_lists(sig[x[i : i + 50_000]]) for x in (a, b)], ["a", "b"])

    return dealt.repartition("t", "v", "p", "q").mapInArrow(run, schema)


def _node(tables: list[tuple[int, int, int]]) -> Column:
    """The SPLIT bits that come after a table's block, by which a crowded value is descended."""
    after = []
    for word, shift, _ in tables:
        word, shift = (word, shift - SPLIT) if shift >= SPLIT else (word, 64 - SPLIT) if shift == 0 else (word, 0)
        after.append(F.shiftrightunsigned(F.get("sig", F.lit(word)), shift).bitwiseAND(F.lit((1 << SPLIT) - 1)).cast("int"))
    return F.get(F.array(*after), F.col("t"))


def roots(group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ranges of rows whose node pairs the traversal starts from."""
    start = np.flatnonzero(np.r_[True, (group[:, 1:] != group[:, :-1]).any(0)])
    stop = np.r_[start[1:], group.shape[1]]
    p, q = group[2, start], group[3, start]
    same = p == q
    key = group[:4, start]
    cross = np.flatnonzero((key[:, 1:] == key[:, :-1]).all(0)) if len(start) > 1 else np.zeros(0, int)
    return np.r_[start[same], start[cross]], np.r_[stop[same], stop[cross]], np.r_[start[same], start[cross + 1]], np.r_[stop[same], stop[cross + 1]]


def forest(
    sig: np.ndarray, lo1: np.ndarray, hi1: np.ndarray, lo2: np.ndarray, hi2: np.ndarray, budget: int, comp: np.ndarray | None = None, size: np.ndarray | None = None, similarity: float = 0.0, every: bool = False, wide: tuple[np.ndarray, int] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Traverse the node pairs: the rows' components, and pairs of rows within the budget that span them.

    ``comp`` are components known before (the first row of each), ``size`` set sizes whose ratio must reach
    ``similarity``; with ``every``, all pairs between different components are returned and none are merged.
    ``wide`` are longer signatures of the rows and their budget, which a pair must keep as well."""
    comp = np.arange(len(sig)) if comp is None else comp
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def link(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal comp
        near = comp[i] != comp[j]
        if size is not None:
            near &= np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9
        i, j = i[near], j[near]
        near = np.bitwise_count(sig[i] ^ sig[j]).sum(1, dtype=np.int64) <= budget
        if wide:
            i, j = i[near], j[near]
            near = np.bitwise_count(wide[0][i] ^ wide[0][j]).sum(1, dtype=np.int64) <= wide[1]
        if every:
            found.append((i[near], j[near]))
        else:
            comp = _union(comp, i[near], j[near], found)

    if not every:
        # The first row of each root links to what is near it; this lets most of a dense group be skipped later.
        link(np.repeat(lo1, hi2 - lo2), _expand(lo2, hi2))
    err = np.zeros(len(lo1), np.int64)
    for level in range(64 * sig.shape[1] + 1):
        live = (err <= budget) & (hi1 > lo1) & (hi2 > lo2) & ((lo1 != lo2) | (hi1 - lo1 > 1))
        lo1, hi1, lo2, hi2, err = (x[live] for x in (lo1, hi1, lo2, hi2, err))
        if not len(lo1):
            break
        # From here on every node has a row, so its first and last index are rows.
        change = np.r_[0, np.cumsum(comp[1:] != comp[:-1])]
        done = (change[hi1 - 1] == change[lo1]) & (change[hi2 - 1] == change[lo2]) & (comp[lo1] == comp[lo2])
        small = ~done & ((hi1 - lo1) * (hi2 - lo2) <= BUCKET)
        for i, j in _leaf_pairs(lo1[small], hi1[small], lo2[small], hi2[small]):
            link(i, j)
        live = ~done & ~small
        if not live.any():
            break
        lo1, hi1, lo2, hi2, err = (x[live] for x in (lo1, hi1, lo2, hi2, err))
        bit = (sig[:, level // 64] >> np.uint64(63 - level % 64)) & np.uint64(1)
        ones = np.r_[0, np.cumsum(bit.astype(np.int64))]
        cut1, cut2 = hi1 - (ones[hi1] - ones[lo1]), hi2 - (ones[hi2] - ones[lo2])
        other = lo1 != lo2  # a node with itself has one mixed child pair, not two
        lo1, hi1, lo2, hi2, err = (
            np.r_[lo1, cut1, lo1, cut1[other]],
            np.r_[cut1, hi1, cut1, hi1[other]],
            np.r_[lo2, cut2, cut2, lo2[other]],
            np.r_[cut2, hi2, hi2, cut2[other]],
            np.r_[err, err, err + 1, err[other] + 1],
        )
    a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    return comp, a, b


def _expand(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    size = hi - lo
    return np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _leaf_pairs(lo1: np.ndarray, hi1: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    step = 20_000
    for k in range(0, len(lo1), step):
        s = slice(k, k + step)
        n1, n2 = hi1[s] - lo1[s], hi2[s] - lo2[s]
        left = _expand(lo1[s], hi1[s])
        width = np.repeat(n2, n1)
        i = np.repeat(left, width)
        j = np.repeat(np.repeat(lo2[s], n1), width) + np.arange(len(i)) - np.repeat(np.cumsum(width) - width, width)
        keep = i != j
        yield i[keep], j[keep]


def _union(comp: np.ndarray, i: np.ndarray, j: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Merge the components of rows i and j; a component's label is its first row.  The pairs that merge go to ``found``."""
    while len(i):
        a, b = comp[i], comp[j]
        differ = a != b
        if not differ.any():
            break
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        high, first = np.unique(np.maximum(a, b), return_index=True)
        found.append((i[first], j[first]))
        comp[high] = np.minimum(a, b)[first]
        while (comp[comp] != comp).any():
            comp = comp[comp]
    return comp


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``v``, ``root`` (the smallest vertex of v's component) for every vertex of ``edges`` (a, b).

    Large-star and small-star in turn (Kiveris et al. 2014): each needs minima by vertex only, which
    are aggregated before the shuffle.  Those of the first are written: both sides of its join are then plain exchanges, and
    Spark splits the rows of a hub or broadcasts the minima where they are small; in the second a vertex meets only smaller ones."""
    edges = checkpointed(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    parts = edges.count() // ROUND_ROWS + 1  # a round never adds edges
    edges, seen = edges.coalesce(parts), None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")).coalesce(parts))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(low.withColumnRenamed("m", "b"))
        edges = checkpointed(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().coalesce(parts))
        state = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(state) == seen:
            return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
        seen = tuple(state)
    raise RuntimeError("components did not settle")


def near_duplicates(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text: str = "text",
    shingle: int = 3,
    bits: int = 64,
    budget: int = 3,
    block: int = 16,
) -> DataFrame:
    """``id_column``, ``sig`` and ``component_id``, the smallest id that links reach, for every row."""
    sigs = checkpointed(signatures(docs, text=text, keep=(id_column,), shingle=shingle, bits=bits))
    vertices = sigs.groupBy("sig").agg(F.min(id_column).alias("_least"))
    roots_of = components(trie_links(vertices.select("sig"), bits=bits, budget=budget, tables=blocks(bits, block)))
    named = vertices.join(roots_of.withColumnRenamed("v", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    least = named.groupBy("root").agg(F.min("_least").alias("component_id"))
    by_sig = named.join(least, "root").select("sig", "component_id")
    return sigs.join(by_sig, "sig").select(id_column, "sig", "component_id")


def set_signatures(rows: DataFrame, *, text: str, keep: Sequence[str], shingle: int, bits: int) -> DataFrame:
    """``keep``, ``set_id`` (a hash of the set of shingles), ``n`` (its size) and ``sig``, the signature of the set."""
    frame = rows.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{text}`").alias("_text"))
    added = [T.StructField("set_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("sig", T.ArrayType(T.LongType(), False))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for whole in batches:
                for batch in pieces(whole):
                    sets = [np.unique(hashed_shingles(t or "", shingle)) for t in batch.column(batch.num_columns - 1).to_pylist()]
                    key = np.array([xxhash.xxh64_intdigest(s.tobytes(), 7) for s in sets], np.uint64).view(np.int64)
                    sig = np.concatenate([majority(s, bits // 64) for s in sets]).view(np.int64)
                    columns = [pa.array(key), pa.array(np.array([len(s) for s in sets], np.int64)), _lists(sig.reshape(-1, bits // 64))]
                    yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*batch.schema.names[:-1], "set_id", "n", "sig"])

    return frame.mapInArrow(run, T.StructType([*frame.schema.fields[:-1], *added]))


def shingle_sets(rows: DataFrame, *, text: str, shingle: int, bits: int) -> DataFrame:
    """``set_id``, ``set``, the sorted hashes of the shingles, and ``wide``, a signature of ``bits`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for whole in batches:
                for batch in pieces(whole):
                    sets = [np.unique(hashed_shingles(t or "", shingle)) for t in batch.column(1).to_pylist()]
                    offsets = pa.array(np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32))
                    wide = np.stack([majority(s, bits // 64) for s in sets])
                    column = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets).view(np.int64)))
                    yield pa.RecordBatch.from_arrays([batch.column(0), column, _lists(wide)], ["set_id", "set", "wide"])

    return rows.select("set_id", F.col(f"`{text}`").alias("_text")).mapInArrow(run, "set_id long, set array<long>, wide array<long>")


def transposed(sig: np.ndarray) -> np.ndarray:
    """The same permutation of every signature's bits, by which a block takes bits from all words."""
    n, words = sig.shape
    bit = np.unpackbits(sig.astype(">u8").view(np.uint8).reshape(n, 8 * words), axis=1)
    order = np.arange(64 * words).reshape(words, 64).T.ravel()
    return np.ascontiguousarray(np.packbits(bit[:, order], axis=1)).view(">u8").astype(np.uint64)


def candidate_pairs(vertices: DataFrame, *, bits: int, compared: int, budget: int, block: int, similarity: float, wide: tuple[int, int] | None = None, max_node: int = 200_000) -> DataFrame:
    """``a``, ``b``: pairs of ``set_id`` whose signatures of ``bits`` agree in a block of the signature or of the transposed one and
    differ in ``budget`` of their first ``compared`` bits or fewer; in each task a forest of them.  Only those first bits are dealt to the blocks.

    With ``wide``, the length and the budget of longer signatures that begin with those of ``bits``, ``sig`` holds the longer ones and every
    pair of different components (``label``) is returned that keeps both budgets; only pairs of one ``family`` are looked for, and only
    where a block of a family has several labels.
    A block value with over ``max_node`` rows is cut into chunks by a hash of the id, and every pair of chunks is a group of its own."""
    tables, length, words = blocks(bits, block), wide[0] if wide else compared, compared // 64
    kept = ["set_id", "n", "label", "family", "sig"] if wide else ["set_id", "n", "sig"]

    def dealer(*names: str):
        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for start in range(0, whole.num_rows, 2000):
                    batch = whole.slice(start, 2000)
                    whole_sig = batch.column("sig").flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)
                    first = np.ascontiguousarray(whole_sig[:, : bits // 64])
                    short = _lists(np.ascontiguousarray(whole_sig[:, : length // 64]))
                    for k, sig in enumerate((first, transposed(first))):
                        for t, (word, shift, width) in enumerate(tables):
                            v = (sig[:, word] >> np.uint64(shift)) & np.uint64((1 << width) - 1)
                            tv = (v.astype(np.int64) | ((k * len(tables) + t) << width)).astype(np.int32)
                            yield pa.RecordBatch.from_arrays([pa.array(tv), *(short if c == "sig" else batch.column(c) for c in names)], ["tv", *names])

        kinds = [f"{c} {'array<long>' if c == 'sig' else 'long'}" for c in names]
        return vertices.select(*kept).mapInArrow(deal, ", ".join(["tv int", *kinds]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        whole = table.column("sig").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, length // 64)
        key, size, label = (table.column(c).to_numpy() for c in ("set_id", "n", "label" if wide else "set_id"))
        group = np.stack([table.column(c).to_numpy() for c in ("family" if wide else "tv", "tv", "p", "q", "node")])
        order = np.lexsort([*whole.T[:words][::-1], *group[::-1]])
        whole, group, key, size, label = whole[order], group[:, order], key[order], size[order], label[order]
        sig = np.ascontiguousarray(whole[:, :words])
        _, first, place = np.unique(label, return_index=True, return_inverse=True)
        nodes = roots(group)
        comp, found = first[place], []
        for most in (budget,) if wide else (budget // 4, budget // 2, 3 * budget // 4, budget):  # the nearest pairs span first
            comp, *near = forest(sig, *nodes, most, comp, size, similarity, bool(wide), (whole, wide[1]) if wide else None)
            found.append(near)
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        pairs = np.unique(np.stack([np.minimum(key[i], key[j]), np.maximum(key[i], key[j])]), axis=1)
        for k in range(0, pairs.shape[1], 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs[:, k : k + 50_000]], ["a", "b"])

    dealt = dealer(*kept)
    if wide:
        several = dealer("family", "label").groupBy("family", "tv").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
        several = written(several.select(F.xxhash64("family", "tv").alias("key")))
        dealt = likely_in(dealt.withColumn("key", F.xxhash64("family", "tv")), several, "key").drop("key")
    crowded = _crowded(vertices, tables, max_node)
    dealt = dealt.join(F.broadcast(crowded), "tv", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("set_id"), F.col("parts")).cast("int")
    dealt = dealt.withColumn("node", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("tv", *kept, "node", F.least("node", "other").alias("p"), F.greatest("node", "other").alias("q"))
    return dealt.repartition(*(["family"] if wide else []), "tv", "p", "q").mapInArrow(run, "a long, b long").distinct()


def _lists(sig: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1) * sig.shape[1], pa.int32()), pa.array(sig.view(np.int64).ravel()))


def _crowded(vertices: DataFrame, tables: list[tuple[int, int, int]], max_node: int) -> DataFrame:
    """``tv`` and ``parts`` of the block values with many rows: all with over 2 ``max_node``.

    A task names the values that it holds more than its share of ``max_node`` of, so what it keeps back is less than ``max_node`` in all."""
    most, share = 2 * len(tables) << tables[0][2], max(1, max_node // max(1, vertices.rdd.getNumPartitions()))
    words = len({word for word, _, _ in tables})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(most, np.int32)  # one for each block value that there can be
        for batch in batches:
            if not batch.num_rows:
                continue
            first = np.ascontiguousarray(batch.column(0).flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)[:, :words])
            for k, sig in enumerate((first, transposed(first))):
                for t, (word, shift, width) in enumerate(tables):
                    v = ((sig[:, word] >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
                    np.add.at(seen, v | ((k * len(tables) + t) << width), 1)
        at = np.flatnonzero(seen >= share)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at].astype(np.int64))], ["tv", "k"])

    counts = vertices.select("sig").mapInArrow(count, "tv int, k long").groupBy("tv").agg(F.sum("k").alias("k"))
    return counts.where(F.col("k") > max_node).select("tv", F.ceil(F.col("k") / max_node).cast("int").alias("parts"))


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sets have Jaccard similarity of ``similarity`` or more, exactly."""
    one, other = sets.select(F.col("set_id").alias("a"), F.col("set").alias("sa")), sets.select(F.col("set_id").alias("b"), F.col("set").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    enough = both >= F.lit(similarity) * (F.size("sa") + F.size("sb") - both) - 1e-9
    return pairs.join(one, "a").join(other, "b").where(enough).select("a", "b")


def of_labels(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """The pairs of different labels that pairs of ``set_id`` stand for."""
    label = named.select("set_id", "label")
    both = pairs.join(label.toDF("a", "la"), "a").join(label.toDF("b", "lb"), "b").where("la <> lb")
    return both.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()


def budget_of(similarity: float, bits: int) -> int:
    """Bits that signatures of sets of this similarity may differ in: sets of one size at similarity ``s`` make an angle of
    ``acos(2 s / (1 + s))``, others a smaller one, and differ in that share of their bits; three standard deviations are added."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * share + 3 * math.sqrt(bits * share * (1 - share)))


def deduplicated(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text: str = "text",
    shingle: int = 5,
    similarity: float = 0.8,
    bits: int = 512,
    compared: int = 384,
    wide: int = 2048,
    block: int = 16,
    max_node: int = 200_000,
) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the smallest id, nulls last.

    Groups are components of pairs whose shingle sets have a Jaccard similarity of ``similarity`` or more; every link
    is checked on the sets.  Candidates come from signatures of the sets whose first ``compared`` bits are within ``budget_of`` the similarity;
    ``2 bits / block`` tables find a pair if a block agrees (at 0.8 in about 99 % of pairs of long texts).
    A forest of candidates is checked first; then, in the families that it leaves in parts, every candidate pair of different parts that
    keeps the budget of ``wide`` bits as well, so that a forest's false edge hides no true one.  Rows that repeat id and text become one."""
    rows = docs.withColumn("_row", row_key(id_column, text))
    sigs = set_signatures(rows, text=text, keep=(id_column, "_row"), shingle=shingle, bits=bits)
    order = F.struct(F.col(f"`{id_column}`").isNull(), F.col(f"`{id_column}`"), F.col("_row"))
    sigs = checkpointed(sigs)
    vertices = checkpointed(sigs.groupBy("set_id").agg(F.min(order).alias("_least"), F.first("n").alias("n"), F.first("sig").alias("sig")))
    find = {"bits": bits, "compared": compared, "budget": budget_of(similarity, compared), "block": block, "similarity": similarity, "max_node": max_node}
    pairs = checkpointed(candidate_pairs(vertices, **find))
    met = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    near = checkpointed(vertices.join(met, "set_id").select("set_id", "n", "_least._row"))
    texts = likely_in(rows.select("_row", F.col(f"`{text}`"), F.col("_row.a").alias("_a")), near.select(F.col("_row.a").alias("_a")), "_a")
    sets = written(shingle_sets(texts.join(near.select("_row", "set_id"), "_row").dropDuplicates(["set_id"]), text=text, shingle=shingle, bits=wide))
    links = checkpointed(similar(pairs, sets, similarity))
    named = near.join(components(links).withColumnRenamed("v", "set_id"), "set_id", "left").withColumn("label", F.coalesce("root", "set_id"))
    named = checkpointed(named.select("set_id", "n", "label"))
    # Whoever has a candidate is in the forest, so in one family with all its candidates; labels stand for what is linked.
    families = components(of_labels(pairs, named)).select(F.col("v").alias("label"), F.col("root").alias("family"))
    labelled = checkpointed(named.join(families, "label", "left").withColumn("family", F.coalesce("family", "label")))
    # A family of two is one pair, which is checked, and one of a single label has nothing left to link.
    open_ = labelled.groupBy("family").agg(F.count("*").alias("k"), F.min("label").alias("x"), F.max("label").alias("y")).where("k > 2 AND x <> y")
    labelled = labelled.join(written(open_.select("family")), "family", "left_semi").join(sets.select("set_id", F.col("wide").alias("sig")), "set_id")
    labelled = checkpointed(labelled.select("set_id", "n", "label", "family", "sig"))
    rest = candidate_pairs(labelled, **find, wide=(wide, budget_of(similarity, wide))).join(pairs, ["a", "b"], "left_anti")
    more = checkpointed(similar(rest, sets, similarity))
    merged = components(of_labels(more, named)).select(F.col("v").alias("label"), "root")
    named = vertices.join(named.select("set_id", "label"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    named = named.join(merged, "label", "left").withColumn("root", F.coalesce("root", "label"))
    kept = named.groupBy("root").agg(F.min("_least").alias("_least")).select("_least._row", F.lit(True).alias("_kept"))
    # A row that stays and occurs once needs no shuffle; all others, and few that look like them, are decided by a join.
    others = sigs.groupBy("_row").agg(F.count("*").alias("k")).join(kept, "_row", "left").where("_kept IS NULL OR k > 1 OR _row IS NULL")
    others = checkpointed(others.select("_row", F.col("_kept").isNotNull().alias("_kept")))
    rows = rows.withColumn("_a", F.col("_row.a"))
    keys = others.select(F.col("_row.a").alias("_a"))
    decided = likely_in(rows, keys, "_a").join(others, "_row", "left").where("coalesce(_kept, true)").dropDuplicates(["_row"])
    return likely_in(rows, keys, "_a", without=True).select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(decided.select(*[F.col(f"`{c}`") for c in docs.columns]))
