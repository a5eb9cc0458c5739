"""Quality rules against a plain version on odd texts, and native plans."""

import re
from collections import Counter

from lexivec.llm.quality import BOILERPLATE, MENU, quality_rules
from lexivec.llm.queries import op4_quality_rules

PROSE = "\n".join(" ".join(f"{w}{i}" for w in "words of one plain text that goes on".split()) + "." for i in range(9))
TEXTS = [
    None, "", " \n\t\n ", "word", PROSE, PROSE + "\n" + PROSE, "same three words " * 60, "a b c\na b c\n\na b c\n" * 20,
    "Home | About | Contact | Login\n" + PROSE + "\nAll rights reserved.\nClick here to subscribe", "Home | About | Contact | Login\n" * 30 + PROSE,
    "home menu login\nsearch\nHELP!\n" + PROSE, ("long line without any mark " * 12 + "\n") * 3 + PROSE, "# $ % & | < > * " * 40, "für größe ñandú 한국어 文字。 " * 30 + ".",
    "\x0b\x0c x\r\ny z\xa0u " * 30, "x" * 100000, "very long text with some words. " * 20000, "Licensed under the X License.", "K Kelvin cookie policy ſ " * 5,
]


def words(t):
    return [w for w in re.split("[\x20\x09-\x0d]+", t) if w]


def bad(line):
    n, low = len(words(line)), line.lower()
    count = lambda marks: sum(line.count(m) for m in marks)
    return (
        any(b in low for b in BOILERPLATE)
        or 3 * count("|»›>") >= n
        or n <= 12 and re.match("^[^a-z]*((" + "|".join(MENU) + ")[^a-z]*)+$", low)
        or n >= 30 and not count(".!?:;…")
        or count("#*$%&|<>") > n
    )


def plain(text):
    t = text or ""
    w = words(t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(windows)
    repeat = {p for i, x in enumerate(windows) if seen[x] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if words(x)]
    left = [x for x in lines if not bad(x)]
    n_left = sum(len(words(x)) for x in left)
    failed = len(w) < 50 or 100 * len(repeat) > 50 * len(w)
    kept = not failed and n_left >= 25 and n_left >= 0.5 * len(w)
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(repeat), "base_failed": failed, "kept": kept, "n_words_left": n_left, "cleaned_text": "\n".join(left) if t else None,
    }


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, _w string, n_words int")


def test_equals_plain_version(spark):
    got = {r.doc_id: r.asDict() for r in quality_rules(frame(spark, TEXTS + TEXTS[:2])).collect()}
    assert len(got) == len(TEXTS) + 2
    for i, t in enumerate(TEXTS + TEXTS[:2]):
        want = plain(t)
        assert {k: got[i][k] for k in want} == want, (i, (t or "")[:80])
    assert got[4]["kept"] and got[8]["kept"] and not got[9]["kept"]


def test_op4_empty_table_and_native_plan(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    out = op4_quality_rules(spark, str(tmp_path))
    assert out.count() == 0
    text = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", text)


def test_long_lines_of_menu_words_and_marks(spark):
    lines = ["home" * 5_000, "home | " * 150_000, "|" * 1_000_000, "menu" * 250_000 + "x", "»home" * 200_000]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(lines)], "doc_id long, text string, n_lines string")
    got = {r.doc_id: r for r in quality_rules(docs).collect()}
    assert [got[i].n_lines_removed for i in range(5)] == [1, 1, 1, 0, 1]
