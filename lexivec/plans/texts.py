"""Text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexivec.functions import text as X
from lexivec.operators import intervals as I
from lexivec.operators import text as O
from lexivec.plans.registry import query, table

_WORDS = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"


@query("F1", "F2", sql=r"""
SELECT doc_id, md5(regexp_replace(text, '\p{Nd}', '0', 'g')) AS digits, md5(regexp_replace(text, '\p{Nd}+', 'N', 'g')) AS runs FROM documents""")
def normalize_digits(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(X.normalize_digits(t)).alias("digits"), F.md5(X.number_runs(t)).alias("runs"))


@query("F2", sql="""
SELECT doc_id, replace(regexp_replace(text, '[^가-힣0-9 ]', ' ', 'g'), '  ', ' ') AS kept FROM documents""")
def hangul_digit_filter(spark, d):
    return table(spark, d, "documents").select("doc_id", X.hangul_or_digit(F.col("text")).alias("kept"))


@query("F3", sql=r"SELECT page_id, md5(regexp_replace(html, '\p{Cf}', '', 'g')) AS clean FROM pages")
def strip_format_chars(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(X.strip_format(F.col("html"))).alias("clean"))


@query("F4", "F5", "F6", sql="""
WITH s AS (SELECT doc_id, list_transform(regexp_split_to_array(replace(text, '다.', '다.' || chr(10)), chr(10) || '+'), lambda x: trim(x)) AS s FROM documents)
SELECT doc_id, md5(array_to_string(s, chr(8232))) AS line, len(list_filter(s, lambda x: length(x) > 1)) AS n_segments FROM s""")
def sentence_segments(spark, d):
    rows = table(spark, d, "documents").select("doc_id", X.join_sentences(X.split_sentences(F.col("text"))).alias("line"))
    return rows.select("doc_id", F.md5("line").alias("line"), F.size(X.segments(F.col("line"))).cast("long").alias("n_segments"))


@query("F7", "S19", sql="""
SELECT doc_id, count(*) AS n, sum(length(rtrim(l)))::BIGINT AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE trim(l) <> '' GROUP BY doc_id""")
def nonblank_lines(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("l")).where(F.trim("l") != "")
    return lines.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length(F.rtrim("l"))).alias("chars"))


@query("F8", "C9", sql=f"SELECT doc_id, len({_WORDS.format('text')}) AS n FROM documents")
def token_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(X.words(F.col("text"))).cast("long").alias("n"))


@query("W1", sql=f"""
WITH t AS (SELECT conv_id, turn, {_WORDS.format('text')} AS t FROM conversations),
p AS (SELECT conv_id, turn, t, unnest(range(len(t))) AS pos FROM t)
SELECT conv_id, turn, pos::INTEGER AS pos, pos + coalesce(list_sum(list_transform(t[1:pos], lambda x: length(x))), 0)::BIGINT AS start,
  pos + coalesce(list_sum(list_transform(t[1:pos + 1], lambda x: length(x))), 0)::BIGINT AS stop FROM p""")
def token_offsets(spark, d):
    return O.token_offsets(table(spark, d, "conversations"), X.words(F.col("text")), ["conv_id", "turn"])


_PIECES = "flatten(list_transform({0}, lambda w: CASE WHEN length(w) > 6 THEN [w[1:4], '##' || w[5:]] ELSE [w] END))"


@query("W2", "F10", sql=f"""
WITH p AS (SELECT conv_id, turn, unnest(t) AS t, unnest(range(len(t))) AS pos FROM (SELECT conv_id, turn, {_PIECES.format(_WORDS.format('text'))} AS t FROM conversations)),
g AS (SELECT *, sum(CASE WHEN t LIKE '##%' AND pos > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS g FROM p),
w AS (SELECT conv_id, turn, g, string_agg(regexp_replace(t, '^##', ''), '' ORDER BY pos) AS w FROM g GROUP BY ALL)
SELECT conv_id, turn, count(*) AS n, md5(string_agg(w, ' ' ORDER BY g)) AS joined FROM w GROUP BY ALL""")
def subtoken_merge(spark, d):
    cut = lambda w: F.when(F.length(w) > 6, F.array(F.substring(w, 1, 4), F.concat(F.lit("##"), F.substring(w, 5, 10**6)))).otherwise(F.array(w))
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.flatten(F.transform(X.words(F.col("text")), cut)).alias("t"))
    rows = rows.where(F.size("t") > 0).select("conv_id", "turn", X.merge_pieces(F.col("t")).alias("w"))
    return rows.select("conv_id", "turn", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ")).alias("joined"))


def _case(names, pattern, other):
    return "CASE " + " ".join(f"WHEN regexp_matches(ch, '{pattern.format(n)}') THEN '{n}'" for n in names) + f" ELSE '{other}' END"


@query("F9", "J9", sql=f"""
SELECT script, category, sum(n)::BIGINT AS n FROM (
  SELECT n, {_case(X.SCRIPTS, '^' + chr(92) + 'p{{{0}}}', 'Unknown')} AS script,
    {_case(X.CATEGORIES, '^' + chr(92) + 'p{{{0}}}', 'Cn')} AS category
  FROM (SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ch)) GROUP BY ALL""")
def script_histogram(spark, d):
    return O.character_classes(table(spark, d, "documents"), "text")


@query("J9", "F9", sql=f"""
SELECT script, sum(n)::BIGINT AS n FROM (
  SELECT n, {_case(X.SCRIPTS, '^' + chr(92) + 'p{{{0}}}', 'Unknown')} AS script
  FROM (SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ch)) GROUP BY ALL""")
def script_lookup(spark, d):
    chars = table(spark, d, "documents").select(F.explode(F.split("text", "")).alias("ch")).where("ch <> ''").groupBy(F.ascii("ch").alias("point")).agg(F.count("*").alias("n"))
    return I.lookup(chars, "point", O.script_ranges(spark), "low", "high", "script").groupBy(F.coalesce("script", F.lit("Unknown")).alias("script")).agg(F.sum("n").alias("n"))


@query("V14", "A12", sql=f"""
WITH t AS (SELECT doc_id, {_WORDS.format('lower(text)')} AS t FROM documents),
b AS (SELECT doc_id, list_transform(range(1, len(t)), lambda i: t[i] || '_' || t[i + 1]) AS b FROM t)
SELECT doc_id, len(b) AS n, len(list_distinct(b)) AS n_distinct FROM b""")
def bigrams(spark, d):
    rows = table(spark, d, "documents").select("doc_id", X.words(F.lower("text")).alias("t")).select("doc_id", X.ngrams(F.col("t")).alias("b"))
    return rows.select("doc_id", F.size("b").cast("long").alias("n"), F.size(F.array_distinct("b")).cast("long").alias("n_distinct"))


_FIRST = """SELECT word, row_number() OVER (ORDER BY conv_id, turn, pos) + {1} AS idx FROM (
  SELECT *, row_number() OVER (PARTITION BY word ORDER BY conv_id, turn, pos) AS r FROM ({0})) WHERE r = 1"""
_ROLE = f"SELECT conv_id, turn, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT conv_id, turn, {_WORDS.format('text')} AS w FROM conversations WHERE role = '{{0}}')"
_SPECIAL = "SELECT unnest(['<pad>', '<unk>', '<bos>', '<eos>']) AS word, unnest([0, 1, 2, 3])::BIGINT AS idx"


def _role_vocabulary(spark, d, role):
    rows = table(spark, d, "conversations").where(F.col("role") == role)
    return O.vocabulary(rows, X.words(F.col("text")), ["conv_id", "turn"])


@query("A7", sql=f"{_SPECIAL} UNION ALL {_FIRST.format(_ROLE.format('user'), 3)}")
def vocab_first_seen(spark, d):
    return _role_vocabulary(spark, d, "user")


@query("A8", sql=f"""
WITH u AS ({_SPECIAL} UNION ALL {_FIRST.format(_ROLE.format('user'), 3)}), a AS ({_FIRST.format(_ROLE.format('assistant'), 3)})
SELECT * FROM u UNION ALL SELECT word, (SELECT max(idx) FROM u) + row_number() OVER (ORDER BY idx) FROM a WHERE word NOT IN (SELECT word FROM u)""")
def vocab_merge(spark, d):
    return O.merge_vocabulary(_role_vocabulary(spark, d, "user"), _role_vocabulary(spark, d, "assistant"))


@query("A8", sql=f"""
WITH u AS ({_SPECIAL} UNION ALL {_FIRST.format(_ROLE.format('user'), 3)}), a AS ({_FIRST.format(_ROLE.format('assistant'), 3)})
SELECT * FROM u WHERE word NOT IN (SELECT word FROM a)""")
def vocab_remove(spark, d):
    words = table(spark, d, "conversations").where(F.col("role") == "assistant").select(F.explode(X.words(F.col("text"))).alias("word")).distinct()
    return O.without_words(_role_vocabulary(spark, d, "user"), words)


@query("A7", sql="""
SELECT DISTINCT event_type || '-' || replace(mk, '-', ' ') AS word FROM events, (SELECT DISTINCT c_mktsegment AS mk FROM customer)""")
def slot_vocabulary(spark, d):
    slots = table(spark, d, "customer").select(F.col("c_mktsegment").alias("mk")).distinct()  # a handful of names
    domains = table(spark, d, "events").select("event_type").distinct()
    return domains.crossJoin(slots).select(O.slot_words(F.col("event_type"), F.col("mk")).alias("word")).distinct()


@query("A13", "A11", sql=f"SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS.format('text')}) AS word FROM documents) GROUP BY word HAVING count(*) >= 4")
def wordpiece_counts(spark, d):
    return O.word_counts(table(spark, d, "documents"), "text", 4)


@query("A13", sql="SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ch ORDER BY n DESC, ch LIMIT 5000")
def alphabet_counts(spark, d):
    chars = table(spark, d, "documents").select(F.explode(F.split("text", "")).alias("ch")).where("ch <> ''")
    return chars.groupBy("ch").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ch").limit(5000)


@query("F11", sql="SELECT p_partkey, replace(replace(replace(url_encode(p_name), '*', '%2A'), '+', '%20'), '%7E', '~') AS quoted FROM part")
def url_segments(spark, d):
    return table(spark, d, "part").select("p_partkey", X.quote_segment(F.col("p_name")).alias("quoted"))
