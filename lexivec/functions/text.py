"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]+"
SENTENCE_MARK = "\u2028"  # stands between the sentences of a one-line document
SCRIPTS = ("Latin", "Greek", "Cyrillic", "Han", "Hangul", "Hiragana", "Katakana", "Arabic", "Hebrew", "Thai", "Devanagari", "Common", "Inherited")
CATEGORIES = ("Lu", "Ll", "Lt", "Lm", "Lo", "Mn", "Mc", "Me", "Nd", "Nl", "No", "Pc", "Pd", "Ps", "Pe", "Pi", "Pf", "Po", "Sm", "Sc", "Sk", "So", "Zs", "Zl", "Zp", "Cc", "Cf", "Co")


def words(text: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(text, WHITE), lambda w: w != "")


def normalize_digits(text: Column) -> Column:
    """Every Unicode decimal digit becomes 0."""
    return F.regexp_replace(text, r"\p{Nd}", "0")


def number_runs(text: Column, mark: str = "N") -> Column:
    return F.regexp_replace(text, r"\p{Nd}+", mark)


def hangul_or_digit(text: Column) -> Column:
    """Other characters become spaces; pairs of spaces become one, in one pass."""
    return F.replace(F.regexp_replace(text, "[^가-힣0-9 ]", " "), F.lit("  "), F.lit(" "))


def strip_format(text: Column) -> Column:
    """Without characters of the category Cf."""
    return F.regexp_replace(text, r"\p{Cf}", "")


def split_sentences(text: Column) -> Column:
    """Sentences end at line breaks and after the Korean ending da with a full stop; each is trimmed."""
    return F.transform(F.split(text, r"\n+|(?<=다\.)"), lambda s: F.btrim(s))


def join_sentences(sentences: Column) -> Column:
    return F.array_join(sentences, SENTENCE_MARK)


def segments(line: Column) -> Column:
    """Sentences of a one-line document that are longer than one character."""
    return F.filter(F.transform(F.split(line, SENTENCE_MARK), lambda s: F.btrim(s)), lambda s: F.length(s) > 1)


def ngrams(tokens: Column, n: int = 2, glue: str = "_") -> Column:
    """Adjacent tokens, glued; empty if there are fewer than ``n``.  (The lambda reads its own
    element only: what it captured would be evaluated anew for every element.)"""
    size = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    shifted = F.arrays_zip(*[F.slice(tokens, k + 1, size).alias(f"t{k}") for k in range(n)])
    return F.transform(shifted, lambda z: F.concat_ws(glue, *[z[f"t{k}"] for k in range(n)]))


def shingles(tokens: Column, n: int = 5) -> Column:
    """Distinct ``n``-word shingles; the whole text if it is shorter, nothing if it has no word."""
    short = F.when(F.size(tokens) > 0, F.array(F.array_join(tokens, " "))).otherwise(F.slice(tokens, 1, 0))
    return F.array_distinct(F.when(F.size(tokens) >= n, ngrams(tokens, n, " ")).otherwise(short))


def strip_piece_mark(token: Column) -> Column:
    return F.regexp_replace(token, "^##", "")


def merge_pieces(tokens: Column) -> Column:
    """Pieces that begin with ## join the word before them; a leading one starts a word."""
    glued = F.regexp_replace(F.array_join(F.transform(tokens, lambda t: F.concat(F.lit("\x01"), t)), ""), "\x01##", "")
    return F.filter(F.split(glued, "\x01"), lambda t: t != "")


def quote_segment(name: Column) -> Column:
    """Percent-encoding of a path segment (a space is %20, not a plus sign)."""
    coded = F.url_encode(name)
    for written, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        coded = F.replace(coded, F.lit(written), F.lit(wanted))
    return coded


def _first_class(char: Column, names: tuple[str, ...], pattern: str, other: str) -> Column:
    out = F.lit(other)
    for name in reversed(names):
        out = F.when(char.rlike(pattern.format(name)), name).otherwise(out)
    return out


def script(char: Column) -> Column:
    """The Unicode script of a character among ``SCRIPTS``."""
    return _first_class(char, SCRIPTS, r"^\p{{Is{}}}", "Unknown")


def category(char: Column) -> Column:
    return _first_class(char, CATEGORIES, r"^\p{{{}}}", "Cn")


def stable_hash(*parts: Column | str, seed: int = 42) -> Column:
    """A hexadecimal hash that every engine computes alike; the source of all our randomness."""
    return F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts], F.lit(str(seed))))
