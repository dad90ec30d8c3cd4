"""Near words against comparing every pair; the counting rule; chains of forms."""

import random
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelweave.llm import spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def expected(counts, ratio):
    rows = {}
    for w, n in counts.items():
        others = sorted((-counts[o], o) for o in counts if o != w and near(o, w))
        form = others[0][1] if others and -others[0][0] >= ratio * n else None
        rows[w] = (form, n, len(others), counts[form] if form else None)
    out = {}
    for w, (form, n, k, m) in rows.items():
        root = w
        while rows[root][0]:
            root = rows[root][0]
        out[w] = (form, root, n, k, m)
    return out


@pytest.mark.parametrize("letters, ratio", [("ab", 10), ("aé", 2), ("abcdefgÿ", 3)])
def test_groups_equal_all_pairs(spark, letters, ratio):
    rng = random.Random(7)
    counts = {}
    for _ in range(700):
        word = "".join(rng.choice(letters) for _ in range(rng.randint(1, 8)))
        counts[word] = rng.choice([1, 1, 2, 9, 10, 99, 100, 1000, 5000])
    words = spark.createDataFrame([(w, n, "x") for w, n in counts.items()], "word string, n long, form string").repartition(7)
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.group_variants(words, ratio).collect()}
    assert got == expected(counts, ratio)


def test_groups_cross_batches(spark):
    """A group that many small batches cut is still one group; one prefix holds every letter."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    try:
        letters = [chr(c) for c in (*range(97, 123), *range(0xC0, 0x100))]
        counts = {f"abc{x}efgh": 10 + k for k, x in enumerate(letters)} | {"abcefgh": 5_000}
        words = spark.createDataFrame(list(counts.items()), "word string, n long")
        got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.group_variants(words).collect()}
    finally:
        spark.conf.set(key, before)
    assert got == expected(counts, 10)
    assert got["abcefgh"][3] == len(letters)


def test_counting_rule(spark):
    texts = [(1, "Wonderful WONDERFUL wonderful-short"), (1, "wonderful wonderful"), (2, None), (3, ""), (None, "ÉÀÿabcdef x" * 2), (None, "ÉÀÿabcdef"),
             (5, "anderes " * 5000), (6, "ends with123letters4letters")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, n long")
    for drop in (None, 2):
        counts = {}
        for i, t in texts:
            for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
                run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                if drop and h % drop == 0:
                    run = run[:h % len(run)] + run[h % len(run) + 1:]
                counts[run] = counts.get(run, 0) + 1
        want = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
        assert {r["word"]: r["n"] for r in spelling.word_counts(docs, drop=drop).collect()} == want and want
    assert spelling.group_variants(spelling.word_counts(docs.where(F.lit(False)))).count() == 0


def test_flushed_counts_add_up(monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 2)
    batch = pa.RecordBatch.from_pydict({"doc_id": [None] * 9, "text": ["aaaaaaa bbbbbbb ccccccc"] * 9})
    rows = [r for b in spelling._count(7, None)([batch]) for r in b.to_pylist()]
    assert sum(r["n"] for r in rows) == 27 and len(rows) > 3


def test_roots_of_a_long_chain(spark):
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(18)] + [("x", "w17")], "word string, form string")
    assert {r["root"] for r in spelling.roots(forms).collect()} == {"w18"}
