"""Quality rules, line first, as DataFrame expressions only.

Every ``\\n``-split line of a text is judged by itself:

* *blank*: no word.
* *punctuation*: a line of ``long_line`` or more words that holds no sentence
  mark (``. ! ? : ; …``) at all, or whose symbols outnumber its words.
* *navigation*: separators (``|``, ``»``, ``›``, ``>``) are at least a third of its words,
  or up to ``menu_words`` words that all are menu words.
* *boilerplate*: it holds one of ``BOILERPLATE``'s phrases.

Failing lines are removed.  A document is then rejected if the surviving words are
fewer than ``min_words`` or under ``min_kept`` of all its words (it lost too much text),
or if its base check fails.

Defined cases: a null text counts as empty: no words, base check failed, not kept,
null cleaned text.  Rows that repeat are judged each by itself.  An input with
other columns keeps them out of the result unless ``keep`` names them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOILERPLATE = (
    "lorem ipsum", "javascript", "use cookies", "cookie policy", "privacy policy", "terms of use",
    "terms of service", "all rights reserved", "licensed under", "released under", "copyright",
    "subscribe to our", "sign up for", "log in to", "click here", "powered by", "back to top",
)
MENU = ("home", "menu", "login", "logout", "search", "contact", "about", "next", "previous", "share", "sitemap", "help")
SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text that is not null."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def _window(words: Column, w: Column, i: Column, join) -> Column:
    return join(w, F.get(words, i + 1), F.get(words, i + 2))


def window_hashes(words: Column) -> Column:
    """A hash of every three-word window; no equal hashes, no equal windows."""
    heads = F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0)))
    return F.transform(heads, lambda w, i: _window(words, w, i, F.xxhash64))


def sorted_windows(words: Column) -> Column:
    """Every three-word window with its place, sorted, so that equal windows lie side by side."""
    heads = F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0)))
    join = lambda *w: F.concat_ws(" ", *w)
    return F.sort_array(
        F.transform(heads, lambda w, i: F.struct(_window(words, w, i, join).alias("w"), i.alias("i")))
    )


def quality_rules(
    docs: DataFrame,
    *,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    long_line: int = 30,
    menu_words: int = 12,
    min_words: int = 25,
    min_kept: float = 0.5,
) -> DataFrame:
    """``keep`` columns, counts, ``base_failed``, ``kept``, ``n_lines``, ``n_lines_removed``,
    ``n_words_left`` and ``cleaned_text`` for each row of ``docs``."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    df = docs.select(*[F.col(f"`{k}`") for k in keep], t.alias("_t"))
    df = df.select(
        *keep,
        "_t",
        words_of(F.col("_t")).alias("_w"),
        F.transform(F.split(F.col("_t"), "\n"), lambda x: F.struct(x.alias("line"), _line_words(x).alias("n"))).alias("_l"),
    )
    lines = F.filter(F.col("_l"), lambda x: x["n"] > 0)
    low = F.lower("_t")
    phrase = F.lit(False)
    for words in BOILERPLATE:
        phrase = phrase | F.contains(low, F.lit(words))
    df = df.select(*keep, "_t", "_w", lines.alias("_l"), window_hashes(F.col("_w")).alias("_h"), phrase.alias("_p"))
    # Only texts with equal hashes pay for the sort, only texts with a phrase for its search in every line.
    again = F.size(F.array_distinct("_h")) < F.size("_h")
    df = df.select(
        *keep, "_t", "_w", "_l",
        F.when(again, sorted_windows(F.col("_w"))).alias("_win"),
        F.filter("_l", lambda x: ~_fails(x["line"], x["n"], F.col("_p"), long_line, menu_words)).alias("_left"),
    )
    hit = F.filter(
        F.transform(
            F.col("_win"),
            lambda x, i: F.when(
                F.coalesce(x["w"] == F.get(F.col("_win"), i - 1)["w"], F.lit(False))
                | F.coalesce(x["w"] == F.get(F.col("_win"), i + 1)["w"], F.lit(False)),
                x["i"],
            ),
        ),
        lambda i: i.isNotNull(),
    )
    marked = F.array_distinct(F.flatten(F.transform(F.coalesce(hit, F.array().cast("array<int>")), lambda i: F.array(i, i + 1, i + 2))))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    plain_lines = F.transform(F.col("_l"), lambda x: x["line"])
    df = df.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct(plain_lines))).cast("long").alias("n_dup_lines"),
        F.size(marked).cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size("_left")).cast("long").alias("n_lines_removed"),
        total(F.col("_left")).alias("n_words_left"),
        F.when(F.col("_t") != "", F.array_join(F.transform("_left", lambda x: x["line"]), "\n")).alias("cleaned_text"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    verdict = (F.col("n_words_left") >= min_words) & (F.col("n_words_left") >= F.lit(min_kept) * F.col("n_words"))
    return df.withColumns({"base_failed": failed, "kept": ~failed & verdict})


def _line_words(line: Column) -> Column:
    return F.regexp_count(line, F.lit(WORD)).cast("long")


def _marks(line: Column, marks: str) -> Column:
    return F.length(line) - F.length(F.translate(line, marks, ""))


def _fails(line: Column, n: Column, phrase: Column, long_line: int, menu_words: int) -> Column:
    low = F.lower(line)
    boilerplate = phrase & low.rlike("|".join(BOILERPLATE))
    # No group is repeated in a pattern: the matcher would recurse once for each repetition, and a long line end its stack.
    menu = (n <= menu_words) & low.rlike("[a-z]") & ~F.regexp_replace(low, "|".join(MENU), "").rlike("[a-z]")
    navigation = (3 * _marks(line, "|»›>") >= n) | menu
    punctuation = ((n >= long_line) & (_marks(line, ".!?:;…") == 0)) | (_marks(line, "#*$%&|<>") > n)
    return boilerplate | navigation | punctuation
