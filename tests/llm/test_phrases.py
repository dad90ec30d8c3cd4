"""Phrase mining against counting by hand; the quotient filter's round trip."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import assert_same

from panelweave.llm import phrases, quotient
from panelweave.llm.queries import ORACLES, QUERIES


def expected(docs, longest, least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = lang if lang is not None else "und"
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i:i + k])] += 1
    out = []
    for lang, count in f.items():
        cand = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        dropped = {p[i:i + k] for p, a in cand.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if cand[p[i:i + k]] <= a}
        rows = []
        for p, a in cand.items():
            if p in dropped:
                continue
            s, k = min((1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-s, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, r + 1, p.decode(), -a, lf, rf, n[lang], -s) for r, (s, a, p, lf, rf) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def rows(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize("least, longest, top", [(2, 5, 10_000), (3, 3, 7), (1, 4, 50)])
def test_equal_to_counting_by_hand(spark, least, longest, top, monkeypatch):
    monkeypatch.setattr(phrases, "SEGMENT", 16)
    rng = np.random.default_rng(least)
    texts = [(None, "a a a a a a. A\ta"), ("und", "a a a"), ("en", None), ("en", ""), ("en", " \t.,;\x0b\x0c\r\n!"), ("de", "Ärger ärger È È È È")]
    for k in range(120):
        words = rng.choice(list("abcdefgh") + ["new", "york", "city", "É,", "x.", "#$"], size=rng.integers(0, 40))
        texts.append((["en", "de", None][k % 3], " ".join(words) + " new york  city is big" * (k % 4 == 0)))
    texts += [("en", "the same text, the same text")] * 5
    docs = spark.createDataFrame([(lang, t, 1, 2) for lang, t in texts], "lang string, text string, n long, f long").repartition(5)
    got = rows(phrases.collocations(docs, longest, least, top))
    assert got == expected(texts, longest, least, top) and len(got) > 10


def test_no_rows_and_no_words(spark):
    docs = spark.createDataFrame([("en", ""), (None, None)], "lang string, text string")
    assert phrases.collocations(docs).collect() == [] and phrases.collocations(docs.where("false")).collect() == []


def test_query(spark, duck, sf_dir):
    df = QUERIES["op13_phrase_mining"](spark, sf_dir)
    cur = duck.execute(ORACLES["op13_phrase_mining"])
    assert_same(df.columns, [tuple(r) for r in df.collect()], [c[0] for c in cur.description], cur.fetchall())


def test_blocks_are_cut_by_size(monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", 10)
    block = phrases._Block()
    block.add("To be,\tor not to be")
    row = block.row(3, "en")
    assert row["words"] == ["to", "be", "or", "not"] and row["counts"] == [2, 2, 1, 1]
    assert phrases._stretch(row["stream"], "<u4").tolist() == [1, 2, 0, 3, 4, 1, 2, 0]


@pytest.mark.parametrize("n, bits", [(2, 1), (2, 17), (3, 20), (5, 17), (5, 25), (5, 31), (4, 9)])
def test_filter_loses_nothing(n, bits):
    layout, rng = quotient.Layout(n, bits), np.random.default_rng(n * bits)
    words = [rng.integers(0, 1 << bits, 3000, dtype="u4") for _ in range(n)]
    limbs = layout.pack(words)
    assert all((a == b).all() for a, b in zip(layout.unpack(limbs), words))
    by, starts, found = quotient.distinct(limbs, layout)
    assert len(starts) == len(set(zip(*(w.tolist() for w in words))))  # one number each
    counts = rng.integers(1, 1000, len(starts))
    for lead in (0, 1, min(4, bits)):
        back, total = [], 0
        for segment, part in quotient.segments(found, counts, layout, lead):
            limbs, c = part.entries(layout, segment, lead)
            back.append(limbs)
            assert (c == counts[total:total + len(c)]).all()
            total += len(c)
        assert total == len(counts)
        assert all((np.concatenate(x) == y).all() for x, y in zip(zip(*back), found))


def test_merge_adds_counters():
    layout = quotient.Layout(3, 12)
    rng = np.random.default_rng(1)
    want, filters = Counter(), []
    for _ in range(4):
        words = rng.integers(0, 30, (500, 3))
        by, starts, found = quotient.distinct(layout.pack(list(words.T)), layout)
        counts = np.diff(np.r_[starts, len(by)])
        filters.append(dict(quotient.segments(found, counts, layout, 2)))
        want.update(map(tuple, words.tolist()))
    got = Counter()
    for segment in range(4):
        found, sums, held = quotient.merge([f[segment] for f in filters], layout, segment, 2)
        got.update(dict(zip(zip(*(w.tolist() for w in layout.unpack(found))), sums.tolist())))
        assert all(len(h) == len(f[segment].small) for h, f in zip(held, filters))
    assert got == want
