"""Fill-in-the-middle against plain versions of itself."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import fim

DOC = "doc_id bigint, text string"


def draw(doc_id, seed=1):
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]


def plain_version(doc_id, text, unit="(?s)."):
    text = text or ""
    units = re.findall(unit, text)
    n, (a, b, c, d) = len(units), draw(doc_id)
    if not text or re.search("<[PSM]>", text) or c % 100 >= 90:
        return n, "plain", None, None, text
    lo, hi = sorted((a % (n + 1), b % (n + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if d % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


PIECES = ["a", "Ω", "😀", "é", "\n", " ", "\r\n", "<", "<P", ">", "é", "\x0b", "word ", "\t", "ß"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [(i, "".join(rng.choice(PIECES) for _ in range(rng.choice([0, 1, 2, 5, 127, 128, 129, 256, 700])))) for i in range(300)]
    out += [(1000, None), (None, "no id"), (None, None), (1001, "a<S>b"), (1002, "x" * 300_000), (1003, "ab\ncd" * 40_000), (7, "another text"), *[out[5]] * 3]
    return out


@pytest.mark.parametrize("unit,pattern", [("char", "(?s)."), ("line", r"[^\n]*\n|[^\n]+")])
@pytest.mark.parametrize("block", [1, 3, 128])
def test_against_a_plain_version(spark, rows, unit, pattern, block):
    docs = spark.createDataFrame(rows, DOC).repartition(5)
    got = fim.fill_in_middle(docs, unit=unit, block=block).withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    want = [(i, t, *plain_version(i, t, pattern), t or "") for i, t in rows]
    order = lambda x: sorted(x, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))
    assert order(map(tuple, got)) == order(want)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_words_part_the_text_without_loss(spark, rows):
    docs = spark.createDataFrame(rows, DOC)
    got = fim.fill_in_middle(docs, unit="word", block=4).withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    assert sorted(r.back for r in got) == sorted(t or "" for _, t in rows)
    for r in got:
        if r.form != "plain":  # a cut lies where a word begins or within white space, never within a word
            for at in (r.prefix_chars, r.prefix_chars + r.middle_chars):
                assert at in (0, len(r.text)) or re.search(r"\s$", r.text[:at], re.A) or not re.search(r"^\S", r.text[at:], re.A)


def test_empty_table_and_clashing_names(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], DOC)).count() == 0
    d = spark.createDataFrame([(1, "some text", "x", 3, "y")], "doc_id bigint, text string, rest string, k1 int, output string")
    got = fim.fill_in_middle(d)
    assert got.columns == ["doc_id", "text", "rest", "k1", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert tuple(got.first())[:5] == (1, "some text", "x", 3, 9)


def test_cuts_at_any_number_of_units(spark):
    text = "".join(random.Random(1).choice(PIECES) for _ in range(500))
    units = list(text)
    cuts = [0, 1, 7, len(units) // 2, len(units) - 1, len(units)]
    d = spark.createDataFrame([(1, 1, text, cuts)], "k1 bigint, k2 bigint, text string, cuts array<bigint>")
    got = fim.cut_offsets(d, "char", 16).first().offsets
    assert got == {i: c for i, c in enumerate(cuts)}
