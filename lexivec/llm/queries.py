"""The thin ``opN_<name>`` queries, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.llm import ann, bpe, langid, linededup, packing, resampling, secrets, simhash, spelling, suffixes, toxicity, warc
from lexivec.llm.common import only, spread, table
from lexivec.llm.quality import BOILERPLATE, MENU, quality_rules

def vocabulary() -> str:
    """The path of the byte-level vocabulary, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(only(table(spark, sf_dir, "documents"), "doc_id", "text"))
    vocab = vocabulary()
    coded = bpe.encode(docs, vocab, bpe.publish_lexicon(docs, vocab)).select(
        F.struct("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256")).alias("of"), "ids"
    )
    back = bpe.decode(coded, vocab, keep=("of",))
    return back.select("of.*", F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    # No vector is scored outside the hash tables, however few there are.
    return ann.nearest(table(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 20 == 0, tables=16, probes=9, exact=0)


def op3_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.archive(table(spark, sf_dir, "pages"))
    return warc.read_packages(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# Base32 by SQL: five hexadecimal digits are four letters.
OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS x FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS first FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(x, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(only(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return packing.pack(docs, vocabulary())


def op8_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(only(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return simhash.near_duplicates(docs).select(
        "doc_id", F.lpad(F.lower(F.hex(F.get("sig", F.lit(0)))), 16, "0").alias("fingerprint"), "component_id"
    )


def op9_secret_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(only(table(spark, sf_dir, "documents"), "doc_id", "text"))
    found = secrets.secret_spans(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(secrets.KINDS[:3])],
        F.sha2(secrets.span_text(F.col("base")), 256).alias("base_sha256"),
        secrets.span_text(F.col("spans")).alias("spans"),
    )


def op5_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(only(table(spark, sf_dir, "documents"), "doc_id", "text"))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model)


def op6_byte_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(only(table(spark, sf_dir, "documents"), "doc_id", "text", "lang"))
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    net = langid.fit(docs, may_learn=~held_out)
    return langid.predict(docs, net).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_template_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    return linededup.drop_recurring_lines(docs).select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("text_sha256")
    )


OP4_COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(only(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return quality_rules(docs).select(*OP4_COLUMNS, "n_lines", "n_lines_removed", "n_words_left")


_WS = r"[\x20\x09-\x0D]+"
_COUNT = "len(list_filter(regexp_split_to_array({0}, '" + _WS + "'), lambda w: w <> ''))"
_MARKS = "(length({0}) - length(translate({0}, '{1}', '')))"
OP4_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '{_WS}'), lambda w: w <> '') AS w FROM d),
win AS (
  SELECT r, p, count(*) OVER (PARTITION BY r, v) AS c FROM (
    SELECT r, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS v
    FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS p FROM w WHERE len(w) >= 3))),
rep AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM win WHERE c > 1) GROUP BY r),
l AS (SELECT r, line, n, lower(line) AS low FROM (
    SELECT r, line, {_COUNT.format("line")} AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)) WHERE n > 0),
lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
    count(*) FILTER (WHERE bad) AS n_lines_removed, coalesce(sum(n) FILTER (WHERE NOT bad), 0) AS n_words_left
  FROM (SELECT *, regexp_matches(low, '{"|".join(BOILERPLATE)}')
      OR 3 * {_MARKS.format("line", "|»›>")} >= n
      OR (n <= 12 AND regexp_matches(low, '^[^a-z]*(({"|".join(MENU)})[^a-z]*)+$'))
      OR (n >= 30 AND {_MARKS.format("line", ".!?:;…")} = 0)
      OR {_MARKS.format("line", "#*$%&|<>")} > n AS bad FROM l)
  GROUP BY r),
x AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
    {_MARKS.format("t", "#*$%&|<>")}::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines,
    coalesce(n_lines_removed, 0)::BIGINT AS n_lines_removed, coalesce(n_words_left, 0)::BIGINT AS n_words_left
  FROM w LEFT JOIN rep USING (r) LEFT JOIN lines USING (r))
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words_left >= 25 AND n_words_left >= 0.5 * n_words AS kept
FROM x
"""

def op11_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(only(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return spelling.spelling_groups(spelling.word_counts(docs, change=spelling.thinned))


# CRC-32 by SQL: a table of 256 remainders, and a fold over the bytes of a string.
_CRC_TABLE = """crc AS (SELECT list(c ORDER BY i) AS rest FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))"""
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen({0})), lambda i: ('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::BIGINT)),
  lambda c, b: xor(c >> 8, rest[(xor(c, b) & 255) + 1])), 4294967295)"""
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP11_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
run AS (SELECT id, run, count(*) AS c FROM (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all({_LOWER}, '[a-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, c, {_CRC.format("(id || ':' || run)")} AS h FROM run, crc),
w AS (SELECT word, sum(c)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
gone AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS s FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
ins AS (SELECT DISTINCT g.word AS a, g.n AS an, w.word AS b, w.n AS bn FROM gone g JOIN w ON w.word = g.s),
pair AS (SELECT a.word AS word, b.word AS other, b.n AS n FROM gone a JOIN gone b ON a.s = b.s AND a.i = b.i AND a.word <> b.word
  UNION ALL SELECT a, b, bn FROM ins UNION ALL SELECT b, a, an FROM ins),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS form_n FROM pair GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * w.n THEN other END AS form, CASE WHEN form_n >= 10 * w.n THEN form_n END AS form_n
  FROM w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root, form AS ahead FROM f UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN f ON f.word = walk.ahead)
SELECT f.word, f.form, walk.root, f.n, f.n_near, f.form_n FROM f JOIN walk USING (word) WHERE walk.ahead IS NULL
"""


def op12_word_trie_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(only(table(spark, sf_dir, "documents"), "doc_id", "text"))
    found = resampling.resample(docs, table(spark, sf_dir, "benchmark"), longest=1, buckets=10_000, min_words=20, percent=10, seed="2024")
    return found.select("doc_id", "n_features", "weight", "score", "rank")


OP12_SQL = f"""
WITH {_CRC_TABLE},
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
word AS (SELECT r, w, count(*) AS c FROM (SELECT r, unnest(w) AS w FROM d) GROUP BY ALL),
every AS (SELECT w, sum(s) AS s, sum(t) AS t FROM (SELECT w, c AS s, 0 AS t FROM word UNION ALL SELECT w, 0, 1 FROM b) GROUP BY w),
bucket AS (SELECT w, s, t, {_CRC.format("w")} % 10000 AS k FROM every, crc),
total AS (SELECT k, sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM bucket GROUP BY k),
gain AS (SELECT k, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM total) + 10000) / ((s + 1) * ((SELECT sum(t) FROM total) + 10000))))::BIGINT AS g FROM total),
sums AS (SELECT r, sum(c * g)::BIGINT AS g FROM word JOIN bucket USING (w) JOIN gain USING (k) GROUP BY r),
x AS (SELECT r, doc_id, len(w)::BIGINT AS n_features, CASE WHEN len(w) > 0 THEN floor(g::DOUBLE / len(w))::BIGINT ELSE 0 END AS weight,
    ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN sums USING (r)),
y AS (SELECT r, doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM x),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM y WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM ranked) * 10 // 100 THEN rank END AS rank FROM y LEFT JOIN ranked USING (r)
"""

def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    return suffixes.without_repeats(docs, length=100).select(
        "doc_id", F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"), F.col("_n_spans").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_transducer": op1_bpe_transducer,
    "op2_cross_polytope": op2_cross_polytope,
    "op3_warc_packages": op3_warc_packages,
    "op4_quality_rules": op4_quality_rules,
    "op5_ordinal_toxicity": op5_ordinal_toxicity,
    "op6_byte_network": op6_byte_network,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_simhash_components": op8_simhash_components,
    "op9_secret_battery": op9_secret_battery,
    "op10_template_line_dedup": op10_template_line_dedup,
    "op11_spelling_groups": op11_spelling_groups,
    "op12_word_trie_resampling": op12_word_trie_resampling,
    "op13_suffix_array_dedup": op13_suffix_array_dedup,
}
ORACLE_SQL: dict[str, str] = {
    "op3_warc_packages": OP3_SQL,
    "op4_quality_rules": OP4_SQL,
    "op11_spelling_groups": OP11_SQL,
    "op12_word_trie_resampling": OP12_SQL,
}
