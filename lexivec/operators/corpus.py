"""Pre-training corpora: line documents, shards, packed examples, sentence pairs, masks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivec.functions import text as X
from lexivec.operators.relational import dense_ids
from lexivec.sources.storage import checkpointed

TITLE = r"^(=\s*)[^=\s]"
SECTION = r"^(=\s*){2,}"


def running_sum(rows: DataFrame, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """The sum of ``value`` up to each row along an order: inside ranges by a window, across
    ranges by their totals, so no task sees more than its range."""
    dealt = rows.withColumn("_v", value).repartitionByRange(*[F.col(o) for o in order]).withColumn("_p", F.spark_partition_id())
    dealt = checkpointed(dealt)  # range bounds are sampled, so both uses must see the same ranges
    totals = dealt.groupBy("_p").agg(F.sum("_v").alias("_t"))
    before = F.coalesce(F.sum("_t").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select("_p", before.alias("_before"))  # a row per range
    inside = F.sum("_v").over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.join(F.broadcast(totals), "_p").withColumn(name, F.col("_before") + inside).drop("_p", "_v", "_before")


def articles(lines: DataFrame, order: Sequence[str], text: str, least: int = 2) -> DataFrame:
    """``article``, ``title``, ``line``: a title line starts an article, deeper headings go on; short lines
    are left out after grouping, and sentences are joined by the separator."""
    starts = F.when(F.col(text).rlike(TITLE) & ~F.col(text).rlike(SECTION), 1).otherwise(0)
    numbered = running_sum(lines, order, starts, "article").where(F.col("article") > 0)
    is_title = F.col(text).rlike(TITLE) & ~F.col(text).rlike(SECTION)
    parts = F.sort_array(F.collect_list(F.when(~is_title & (F.length(text) >= least), F.struct(*order, text))))
    sentences = F.flatten(F.transform(parts, lambda p: X.split_sentences(X.strip_format(p[text]))))
    return numbered.groupBy("article").agg(F.max(F.when(is_title, F.btrim(text, F.lit("= ")))).alias("title"), X.join_sentences(sentences).alias("line"))


def blank_separated(lines: DataFrame, order: Sequence[str], text: str) -> DataFrame:
    """``doc``, ``n_lines``, ``chars``: documents between blank lines; the last needs none after it."""
    blank = F.trim(F.col(text)) == ""
    marked = running_sum(lines, order, F.when(blank, 1).otherwise(0), "doc").where(~blank)
    return marked.groupBy("doc").agg(F.count("*").alias("n_lines"), F.sum(F.length(text)).alias("chars"))


def word_documents(rows: DataFrame, id_column: str, word: str) -> DataFrame:
    """Words whose dotted ids share the first two parts are a document, in the order of the third."""
    order = F.substring_index(id_column, ".", -1).cast("int")
    return rows.groupBy(F.substring_index(id_column, ".", 2).alias("doc")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), word))), lambda r: r[word]), " ").alias("text"))


def shard_count(docs: DataFrame, text: str, shard_bytes: int, test_share: float = 0.1) -> DataFrame:
    total = docs.agg(F.ceil(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)) / shard_bytes).alias("shards"))
    return total.select("shards", F.ceil(F.col("shards") * test_share).alias("test_shards"))


def shard_plan(docs: DataFrame, doc: str, sentences: Column, shards: int, test_share: float = 0.1, least: int = 2) -> DataFrame:
    """``doc``, ``sentences``, ``shard``, ``split``: documents by size go to the shards to and fro, so that shards
    balance without any task that sees them all."""
    rows = docs.select(doc, sentences.cast("long").alias("sentences")).where(F.col("sentences") >= least)
    ranked = dense_ids(rows, [-F.col("sentences"), F.col(doc)], "_r")
    place = F.col("_r") % (2 * shards)
    shard = F.when(place < shards, place).otherwise(2 * shards - 1 - place)
    tests = -(-int(shards * test_share * 1000) // 1000)
    return ranked.select(doc, "sentences", shard.alias("shard"), F.when(shard < tests, "test").otherwise("train").alias("split"))


def packed_examples(docs: DataFrame, doc: str, sentences: str, max_length: int, seed: int = 42, short_share: float = 0.1) -> DataFrame:
    """``doc``, ``example``, ``n_sentences``, ``n_tokens``, ``target``: sentences fill an example until its target
    length or the document's end.  One in ten targets is short; all follow from hashes of document and example."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        full = max_length - 3
        for batch in batches:
            out = []
            for name, texts in zip(batch[doc], batch[sentences], strict=True):
                sizes = [len((t or "").encode().split()) for t in texts]  # of words parted by space and \t to \r
                k = n = tokens = 0
                for i, size in enumerate(sizes):
                    if n == 0:
                        h = int(hashlib.md5(f"{name}|{k}|{seed}".encode()).hexdigest()[:8], 16)
                        target = 2 + h % (full - 1) if h % 1000 < 1000 * short_share else full
                    n, tokens = n + 1, tokens + size
                    if tokens >= target or i == len(sizes) - 1:
                        out.append((name, k, n, min(tokens, full), target))
                        k, n, tokens = k + 1, 0, 0
            yield pd.DataFrame(out, columns=[doc, "example", "n_sentences", "n_tokens", "target"])

    kind = docs.schema[doc].dataType.simpleString()
    return docs.select(doc, sentences).mapInPandas(run, f"{doc} {kind}, example long, n_sentences long, n_tokens long, target long")


def hash_number(*parts: Column | str, seed: int = 42) -> Column:
    """A number below 2**32 from the stable hash."""
    return F.conv(F.substring(X.stable_hash(*parts, seed=seed), 1, 8), 16, 10).cast("long")


def sentence_pairs(sentences: DataFrame, doc: str, pos: str, sentence: str) -> DataFrame:
    """``doc``, ``pos``, ``first``, ``second``, ``is_random``: each sentence with its successor, or, by a hashed coin,
    with the first sentence of another document chosen by hash."""
    order = Window.partitionBy(doc).orderBy(pos)
    rows = sentences.withColumn("_next", F.lead(sentence).over(order)).where(F.col("_next").isNotNull())
    heads = dense_ids(sentences.groupBy(doc).agg(F.min_by(sentence, pos).alias("_head")), [doc], "_i").select(F.col(doc).alias("_doc"), "_head", "_i")
    heads = checkpointed(heads)
    total = heads.count()
    mine = heads.select(F.col("_doc").alias(doc), F.col("_i").alias("_own"))
    coin = F.lit(total > 1) & (hash_number(F.col(doc), F.col(pos)) % 2 == 0)
    drawn = F.pmod(F.col("_own") + 1 + hash_number(F.col(doc), F.col(pos), "doc") % max(total - 1, 1), F.lit(max(total, 1)))
    rows = rows.join(mine, doc).withColumn("is_random", coin.cast("int")).withColumn("_i", F.when(F.col("is_random") == 1, drawn))
    rows = rows.join(heads.select("_i", "_head"), "_i", "left")
    return rows.select(doc, pos, F.col(sentence).alias("first"), F.when(F.col("is_random") == 1, F.col("_head")).otherwise(F.col("_next")).alias("second"), "is_random")


def truncated_pair(first: Column, second: Column, size: int, front: Column) -> tuple[Column, Column]:
    """Token lists cut to ``size`` together, always from the longer; where ``front`` holds, from its front."""
    over = F.greatest(F.size(first) + F.size(second) - size, F.lit(0))
    gap = F.size(first) - F.size(second)
    cut1 = F.least(F.greatest(gap, F.lit(0)), over)
    cut2 = F.least(F.greatest(-gap, F.lit(0)), over)
    rest = over - cut1 - cut2
    cut1, cut2 = cut1 + F.ceil(rest / 2).cast("int"), cut2 + F.floor(rest / 2).cast("int")
    take = lambda v, c: F.when(front, F.slice(v, c + 1, F.size(v))).otherwise(F.slice(v, F.lit(1), F.size(v) - c))
    return take(first, cut1), take(second, cut2)


def masked_positions(tokens: DataFrame, keys: Sequence[str], pos: str, share: float = 0.15, most: int = 20) -> DataFrame:
    """``keys``, ``pos``, ``action``: a share of each text's positions (one at least, ``most`` at most), by hash; of those
    80 % are masked, 10 % kept and 10 % replaced.  The label is the token that stood there, and IGNORED elsewhere."""
    h = X.stable_hash(*[F.col(k) for k in keys], F.col(pos))
    of_text = Window.partitionBy(*keys)
    ranked = tokens.select(*keys, pos, h.alias("_h"))
    ranked = ranked.withColumn("_r", F.row_number().over(of_text.orderBy("_h"))).withColumn("_n", F.count("*").over(of_text))
    chosen = ranked.where(F.col("_r") <= F.least(F.greatest(F.floor(F.col("_n") * share), F.lit(1)), F.lit(most)))
    die = F.conv(F.substring("_h", 9, 8), 16, 10).cast("long") % 10
    return chosen.select(*keys, pos, F.when(die < 8, "mask").when(die == 8, "keep").otherwise("replace").alias("action"))


def masked_examples(tokens: DataFrame, keys: Sequence[str], pos: str, token: str, words: DataFrame, mask: str = "[MASK]", share: float = 0.15, most: int = 20) -> DataFrame:
    """``keys``, ``pos``, ``input``, ``label``: every token as the model sees it, and the token that stood there where
    ``masked_positions`` chose it, else null.  A replacement comes from ``words`` (``word``, ``idx`` from 0 on) by hash."""
    size = F.lit(max(words.count(), 1))
    drawn = F.conv(F.substring(X.stable_hash(*[F.col(k) for k in keys], F.col(pos)), 17, 8), 16, 10).cast("long") % size
    chosen = masked_positions(tokens, keys, pos, share, most).withColumn("idx", F.when(F.col("action") == "replace", drawn))
    new = chosen.join(words.select("idx", F.col("word").alias("_word")), "idx", "left").drop("idx")
    seen = F.when(F.col("action") == "mask", mask).when(F.col("action") == "replace", F.coalesce("_word", token)).otherwise(F.col(token))
    both = tokens.select(*keys, pos, token).join(new, [*keys, pos], "left")
    return both.select(*keys, pos, seen.alias("input"), F.when(F.col("action").isNotNull(), F.col(token)).alias("label"))
