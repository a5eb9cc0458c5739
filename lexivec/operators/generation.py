"""Generation by joins: a frontier of live sequences meets a table of next tokens, step by step.

The table is counted from given texts (contexts of two tokens), keeps the best next tokens of every context, and stands
where a model's logits would.  Log probabilities are whole millionths, so sums and ties don't depend on the order of adding.
A step is one join and one top-k per sequence; sequences that are done leave the frontier, and each step is checkpointed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivec.functions.text import stable_hash
from lexivec.sources.storage import checkpointed, written

START, END = "<s>", "</s>"


def next_tokens(texts: DataFrame, words: str, keep: int) -> DataFrame:
    """``c1``, ``c2``, ``token``, ``logp``, ``place``: the ``keep`` most frequent tokens after each pair of tokens (ties: the smaller token).
    Texts start after two ``START`` and end with ``END``; null arrays have no tokens at all."""
    w = F.col(f"`{words}`")
    first, second = F.concat(F.array(F.lit(START), F.lit(START)), w), F.concat(F.array(F.lit(START)), w)
    steps = F.arrays_zip(F.slice(first, 1, F.size(w) + 1).alias("c1"), second.alias("c2"), F.concat(w, F.array(F.lit(END))).alias("token"))
    counts = texts.where(w.isNotNull()).select(F.explode(steps).alias("s")).groupBy("s.c1", "s.c2", "s.token").agg(F.count("*").alias("n"))
    counts = written(counts)
    best = counts.withColumn("place", F.row_number().over(Window.partitionBy("c1", "c2").orderBy(F.desc("n"), "token"))).where(F.col("place") <= keep)
    totals = counts.groupBy("c1", "c2").agg(F.sum("n").alias("total"))
    return best.join(totals, ["c1", "c2"]).select("c1", "c2", "token", _millionths(F.log(F.col("n") / F.col("total"))).alias("logp"), "place")


def _millionths(x: Column) -> Column:
    return F.round(x * 1_000_000).cast("long")


def gumbel(*key: Column, seed: int) -> Column:
    """Noise of a hashed key; the largest of log probability plus noise is a draw from the distribution."""
    u = (F.conv(F.substring(stable_hash(*key, seed=seed), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return _millionths(-F.log(-F.log(u)))


def generate(
    prompts: DataFrame, model: DataFrame, *, beams: int = 1, max_length: int = 20, min_length: int = 0, top_k: int | None = None, seed: int | None = None
) -> DataFrame:
    """``id``, ``rank``, ``text``, ``score``, ``n_tokens``, ``ended`` for ``prompts`` (``id``, ``c1``, ``c2``: the last two tokens).

    ``beams`` hypotheses a prompt are kept, best score first (ties: the smaller text); one is greedy search.  ``END`` can't come before
    ``min_length`` tokens.  A hypothesis is done with ``END`` (``ended``), without any next token, or at ``max_length``; done ones still compete, until
    all of their prompt are done.  With ``seed``, tokens are drawn from the ``top_k`` best: hypotheses are then ranked by
    the sum of log probability and noise, and ``score`` holds the log probability alone.  ``model`` needs the ``beams + 1`` (or ``top_k + 1``) best tokens of a context."""
    width = (top_k if seed is not None and top_k else beams) + 1
    table = written(model.where(F.col("place") <= width).select(F.col("c1").alias("m1"), F.col("c2").alias("m2"), "token", "logp", "place"))
    none = F.lit(0).cast("long")
    state = checkpointed(prompts.select("id", "c1", "c2", F.lit("").alias("text"), none.alias("score"), none.alias("noisy"), none.cast("int").alias("n_tokens"), F.lit(False).alias("done"), F.lit(False).alias("ended")))
    finished = []
    for step in range(max_length):
        live = state.where(~F.col("done"))
        # END is left out while it is too early, so of width = k + 1 tokens at least k remain.
        fit = table if step >= min_length else table.where(F.col("token") != END)
        met = live.join(fit, (F.col("c1") == F.col("m1")) & (F.col("c2") == F.col("m2")), "left")
        stuck, end = F.col("token").isNull(), F.coalesce(F.col("token") == END, F.lit(False))
        gain = F.coalesce("logp", F.lit(0))
        if seed is None:
            noise = F.lit(0)
        else:
            if top_k:
                by = Window.partitionBy("id", "text").orderBy("place")
                met = met.withColumn("_nth", F.row_number().over(by)).where(F.col("_nth") <= top_k).drop("_nth")
            noise = F.coalesce(gumbel(F.col("id"), F.col("text"), F.col("token"), seed=seed), F.lit(0))
        text = F.when(stuck | end, F.col("text")).otherwise(F.concat_ws(" ", F.when(F.col("text") != "", F.col("text")), F.col("token")))
        grown = met.select(
            "id", F.when(stuck, F.col("c1")).otherwise(F.col("c2")).alias("c1"), F.coalesce("token", "c2").alias("c2"), text.alias("text"), (F.col("score") + gain).alias("score"),
            (F.col("noisy") + gain + noise).alias("noisy"), F.when(stuck | end, F.col("n_tokens")).otherwise(F.col("n_tokens") + 1).alias("n_tokens"), (stuck | end).alias("done"), end.alias("ended"),
        )
        both = grown.unionByName(state.where("done").select(*grown.columns))
        ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("noisy"), "text", F.desc("ended")))).where(F.col("rank") <= beams)
        # Prompts all of whose hypotheses are done leave the frontier.
        going = F.max(F.when(F.col("done"), 0).otherwise(1)).over(Window.partitionBy("id"))
        state = checkpointed(ranked.withColumn("going", going))
        finished.append(state.where("going = 0"))
        state = state.where("going = 1")
        if state.isEmpty():
            break
    finished.append(state if "rank" in state.columns else state.withColumn("rank", F.lit(1)))
    out = reduce(DataFrame.unionByName, [f.select("id", "rank", "text", "score", "n_tokens", "ended") for f in finished])
    return out
