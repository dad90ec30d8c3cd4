"""Near-duplicates, repeats, classifier, HTML, nearest neighbours and the pipeline against brute force."""

import glob
import hashlib
import os
import random
import re
import tempfile
import time
import tracemalloc
from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelweave.llm import bpe, components, html_mincut, minhash, projected_ann, pu_quality, suffix_dedup
from panelweave.llm.queries import QUERIES, tokenizer_path
from panelweave.sources.scratch import SHUFFLES_GO, scratch_path, stage

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCS)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def near_brute(rows, width, percent=80):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return frozenset(tuple(w[k:k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                up[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        t = top(k)
        least[t] = i if least.get(t) is None else min(x for x in (least[t], i) if x is not None) if i is not None else least[t]
    return [(i, len(s), least[top(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets))]


def near_rows():
    rng = random.Random(4)
    rows = [(k, prose(rng, rng.randint(1, 150))) for k in range(60)]
    base = prose(rng, 200).split()
    for k in range(100, 220):  # one large group of near copies, a chain in part
        w = list(base)
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(200)] = prose(rng, 1)
        rows.append((k, " ".join(w)))
    rows += [(300 + k, rows[5][1].upper()) for k in range(40)] + [(5, rows[5][1]), (400, None), (401, ""), (402, " \n\t"), (403, "one two"), (404, "One\x0btwo"),
             (None, "lonely words stand here today"), (None, None), (405, prose(rng, 30_000))]
    return rows


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(spark, width):
    rows = near_rows()
    table = docs(spark, rows).withColumn("component_id", F.lit("clash")).withColumn("node", F.lit(1))
    got = minhash.near_duplicates(table.repartition(5), width=width).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2] or 0)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=key) == sorted(near_brute(rows, width), key=key)
    assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_around_an_absent_text(spark):
    """Copies with edits of their own, many pairs just below or above the limit, the text they stem from missing."""
    rng = random.Random(11)
    base = prose(rng, 150).split()
    rows = []
    for k in range(60):
        own = list(base)
        for at in rng.sample(range(5, 145), 1 + k % 5):
            own[at] = prose(rng, 1) + str(rng.randrange(4))
        rows.append((k, " ".join(own)))
    got = minhash.near_duplicates(docs(spark, rows), width=5).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(near_brute(rows, 5))
    assert 1 < len({r["component_id"] for r in got}) < len(rows)


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    pool = minhash.mix64(np.arange(1, 400, dtype="u8"))
    sets = [np.sort(rng.choice(pool, int(rng.integers(1, 300)), replace=False)) for _ in range(40)]
    sets += [sets[0][1:], sets[0]]
    word = minhash.parities(np.concatenate(sets), np.array([len(x) for x in sets]))
    for x, a in zip(sets, word):
        for y, b in zip(sets, word):
            odd = sum(bin(int(v) & 2**64 - 1).count("1") for v in a ^ b)
            apart = len(np.setxor1d(x, y))
            assert odd <= apart and (apart - odd) % 2 == 0


def staged_tables(spark) -> set[str]:
    folder = scratch_path(spark, "x").rsplit("/", 1)[0].removeprefix("file://")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_only_results_stay_staged(spark):
    """Superseded tables go as soon as nothing reads them; what is left is read by the result."""
    before = staged_tables(spark)
    found = minhash.near_duplicates(docs(spark, near_rows()))
    assert [name.rsplit("-", 1)[0] for name in staged_tables(spark) - before] == ["near-found"]
    assert found.where("kept").count() > 1
    before = staged_tables(spark)
    cut = suffix_dedup.repeated_passages(docs(spark, passage_rows()[0]))
    assert [name.rsplit("-", 1)[0] for name in staged_tables(spark) - before] == ["suffix-spans"] * 2
    assert cut.where("kept IS NOT NULL").count() > 1


def test_staging_keeps_no_shuffles(spark):
    def files():
        return {f for d in roots for f in glob.glob(f"{d}/blockmgr-*/*/shuffle_*") + glob.glob(f"{d}/*/blockmgr-*/*/shuffle_*")}

    roots = (os.environ.get("SPARK_LOCAL_DIRS") or spark.conf.get("spark.local.dir", tempfile.gettempdir())).split(",")
    setting = spark.conf.get(SHUFFLES_GO)
    before = files()
    sums = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    sums.collect()
    assert files() - before  # as long as the driver collects no garbage
    before = files()
    table = stage(sums, "sums")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(SHUFFLES_GO) == setting
    assert table.count() == 7 and sums.count() == 7


def test_one_python_worker_a_task(spark, sf_dir, monkeypatch):
    """Two steps in Python in one plan without a shuffle between them hold two workers a task."""
    plans = []

    def noted(df, name, real=stage):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(suffix_dedup, "stage", noted)
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cut = suffix_dedup.repeated_passages(table)
    coded = corpus_pipeline.tokens(spark, table, sf_dir)
    plans += [x._jdf.queryExecution().executedPlan().toString() for x in (cut, coded)]
    assert [plan.count("MapInArrow") for plan in plans if "MapInArrow" in plan] and all(plan.count("MapInArrow") < 2 for plan in plans)
    apart = bpe.decode(bpe.encode(table.select("doc_id", "text"), tokenizer_path()), tokenizer_path())
    want = {r["doc_id"]: (r["ids"], hashlib.sha256(r["decoded"].encode()).hexdigest()) for r in apart.collect()}
    assert {r["doc_id"]: (r["ids"], r["decoded_sha256"]) for r in coded.collect()} == want


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(docs(spark, [])).count() == 0
    assert [r["kept"] for r in minhash.near_duplicates(docs(spark, [(1, None)])).collect()] == [True]


def test_signature_is_a_shifted_permutation():
    shingle = minhash.mix64(np.arange(1, 50, dtype="u8"))
    got = minhash.signatures(shingle, np.array([49]), 8)[0]
    sigma = minhash._permute((shingle >> np.uint64(32)).astype("u4") ^ shingle.astype("u4"), 0x85EBCA6B, 0xC2B2AE35)
    want = [min(int(minhash._permute(np.array([(int(s) - k) % 2**32], "u4"), 0x7FEB352D, 0x846CA68B)[0]) for s in sigma) for k in range(8)]
    assert got.tolist() == want


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 400)] + [(rng.randrange(500, 600), rng.randrange(500, 600)) for _ in range(60)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x
    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    assert got == {x: top(x) for e in edges if e[0] != e[1] for x in e}


def repeats_brute(texts, length):
    count = Counter(t[k:k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if count[t[k:k + length]] > 1:
                gone[k:k + length] = True
        out.append((int(gone.sum()), bytes(np.frombuffer(t, "u1")[~gone]), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())))
    return out


def repeat_rows():
    rng = random.Random(9)
    passage, other = prose(rng, 120), prose(rng, 90)
    texts = [prose(rng, 100) + passage + prose(rng, 50), passage[:450] + prose(rng, 80) + other, prose(rng, 20) + passage[100:] + other[:401],
             other[:399] + "x", "a" * 1500, "abc" * 300 + "d", "line of words!\n" * 60, prose(rng, 60)[:400], "é" * 500, passage[:399] + "é" + passage[:500],
             None, "", "short"]
    texts += [t for t in texts[:3]] + [passage[k:k + 420] + prose(rng, 5) for k in range(0, 60, 7)]
    return [(k, t) for k, t in enumerate(texts)] + [(None, passage), (2, texts[2])]


def test_repeats(spark):
    rows = repeat_rows()
    table = docs(spark, rows).withColumn("spans", F.lit("clash"))
    found = {(r["doc_id"], bytes(r["kept"])): r["spans"] for r in suffix_dedup.repeats(table).collect()}
    want = repeats_brute([(t or "").encode() for _, t in rows], 400)
    touched = 0
    for (i, t), (gone, kept, n) in zip(rows, want):
        if gone:
            touched += 1
            spans = found[i, kept]
            assert len(spans) == n and sum(s["hi"] - s["lo"] for s in spans) == gone
    assert touched and len(found) == len({(i, k) for (i, t), (g, k, _) in zip(rows, want) if g})
    assert suffix_dedup.repeats(docs(spark, [])).count() == 0
    assert suffix_dedup.repeats(docs(spark, [(1, "x"), (2, None)])).count() == 0


def test_repeats_across_pieces(spark, monkeypatch):
    """A text longer than a piece: the cuts between pieces hide nothing."""
    rng = random.Random(2)
    long = prose(rng, 900)
    text = (long[:3000] + prose(rng, 100) + long[1000:2500] + prose(rng, 300)).encode()
    rows = []
    for at in range(0, len(text) - 399, 500):
        piece = np.frombuffer(text[at:at + 500 + 399], "u1")
        _, lo, n, a, h, c = suffix_dedup._runs(piece, np.array([0, len(piece)]), 400, 160)
        rows += [(at + x, y) for x, y in zip(lo, n)]
    starts = sorted(s for lo, n in rows for s in range(lo, lo + n))
    assert starts == list(range(len(text) - 399))


def test_repeat_query(spark, sf_dir):
    got = {r["doc_id"]: r for r in QUERIES["op2_suffix_dedup"](spark, sf_dir).collect()}
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for (i, t), (gone, kept, n) in zip(rows, repeats_brute([t for _, t in rows], 400)):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(t), gone, n, hashlib.sha256(kept).hexdigest())


def test_repeat_query_returns_the_text(spark, sf_dir):
    got = {r["doc_id"]: r["text"] for r in QUERIES["op2_suffix_dedup"](spark, sf_dir).collect()}
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = {i: kept.decode(errors="replace") for (i, _), (_, kept, _) in zip(rows, repeats_brute([t for _, t in rows], 400))}
    assert got == want and any(got[i] != t.decode() for i, t in rows)


def word_spans_brute(texts, text, length=51):
    def grams(t):
        w = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0d]+", t)]
        return [(w[k][0], w[k + length - 1][1], tuple(t[a:b] for a, b in w[k:k + length])) for k in range(len(w) - length + 1)]

    count = Counter(g for t in texts for _, _, g in grams(t))
    return [(a, b) for a, b, g in grams(text) if count[g] > 1]


def repeated_words_brute(texts, length=51):
    split = [[(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0d]+", t)] for t in texts]
    grams = [[tuple(t[a:b] for a, b in w[k:k + length]) for k in range(len(w) - length + 1)] for t, w in zip(texts, split)]
    count = Counter(g for each in grams for g in each)
    out = []
    for t, w, each in zip(texts, split, grams):
        gone = np.zeros(len(t), bool)
        for k, g in enumerate(each):
            if count[g] > 1:
                gone[w[k][0]:w[k + length - 1][1]] = True
        out.append(bytes(np.frombuffer(t, "u1")[~gone]))
    return out


def removed(t, kept_spans):
    gone = np.zeros(len(t), bool)
    for a, b in kept_spans:
        gone[a:b] = True
    return gone


def passages_brute(texts, length=400, words=51):
    """What neither law removes; the rest of a cut character goes, too."""
    def few_words(t):
        found = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0d]+", t)]
        starts, ends = [a for a, _ in found], [b for _, b in found]
        return any(bisect_right(ends, k + length) - bisect_left(starts, k) < words for k in range(len(t) - length + 1))

    wide = [few_words(t) for t in texts]
    count = Counter(t[k:k + length] for t, w in zip(texts, wide) if w for k in range(len(t) - length + 1))
    split = [[(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0d]+", t)] for t in texts]
    grams = [[tuple(t[a:b] for a, b in w[k:k + words]) for k in range(len(w) - words + 1)] for t, w in zip(texts, split)]
    often = Counter(g for each in grams for g in each)
    out = []
    for t, w, each, few in zip(texts, split, grams, wide):
        spans = [(k, k + length) for k in range(len(t) - length + 1) if few and count[t[k:k + length]] > 1]
        spans += [(w[k][0], w[k + words - 1][1]) for k, g in enumerate(each) if often[g] > 1]
        out.append(bytes(np.frombuffer(t, "u1")[~removed(t, spans)]).decode("utf-8", "ignore"))
    return out


def passage_rows():
    rng = random.Random(12)
    short = " ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(52))  # 155 bytes
    fifty, long = prose(rng, 50), prose(rng, 300)
    texts = [prose(rng, 40) + " " + short + " " + prose(rng, 60), prose(rng, 70) + "\n" + short.replace(" ", " \n") + "\t" + prose(rng, 30),
             fifty + " " + prose(rng, 60), prose(rng, 60) + " " + fifty, long, prose(rng, 9) + " " + long[300:900] + " é\ufffd " + prose(rng, 5),
             "\ufffd " + long[700:1200], "a " * 80, prose(rng, 5) + " " + short + "\n \n" + long[:700], "x" * 900, "y" + "x" * 900, "one two " * 60, short, "", None]
    texts += [" ".join(long.split()[k:k + 60]) + " " + prose(rng, 3) for k in range(0, 90, 7)]
    return [(k, t) for k, t in enumerate(texts)], short


def test_repeated_words(spark):
    rows, _ = passage_rows()
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.repeated_words(docs(spark, rows)).collect()}
    texts = [(t or "").encode() for _, t in rows]
    want = {k: kept for k, (t, kept) in enumerate(zip(texts, repeated_words_brute(texts))) if kept != t}
    assert got == want and len(got) > 15
    assert suffix_dedup.repeated_words(docs(spark, [])).count() == 0


def test_repeat_query_finds_passages_of_short_words(spark, tmp_path):
    """Passages of over 50 words are found below 400 bytes, too; the columns of the contract know only strings of 400."""
    rows, short = passage_rows()
    rows += [(100 + k, t) for k, t in repeat_rows()[:-2]]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op2_suffix_dedup"](spark, str(tmp_path)).collect()}
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[k:k + 400] for t in texts for k in range(len(t) - 399))
    assert len(got) == len(rows)
    for (i, _), t, (gone, kept, n), words in zip(rows, texts, repeats_brute(texts, 400), repeated_words_brute(texts)):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(t), gone, n, hashlib.sha256(kept).hexdigest())
        assert (r["n_passages"] > 0) == (words != t)
        spans = [(k, k + 400) for k in range(len(t) - 399) if count[t[k:k + 400]] > 1]
        gone = removed(t, spans) | removed(t, word_spans_brute(texts, t))
        assert r["rest"] == bytes(np.frombuffer(t, "u1")[~gone]).decode("utf-8", "ignore")
    assert len(short) < 400 and got[0]["n_passages"] == 1 and got[0]["n_removed"] == 0
    assert got[0]["text"] == rows[0][1] and got[0]["rest"].split() == rows[0][1].split()[:40] + rows[0][1].split()[-60:]


def test_pipeline_passages_of_short_words(spark, sf_dir):
    """A passage of 52 short words in two documents goes, though it has less than 400 bytes."""
    rows, short = passage_rows()
    assert len(short.split()) == 52 and len(short) < 400
    got = {r["doc_id"]: r for r in corpus_pipeline.repeated_passages(spark, docs(spark, rows), sf_dir).collect()}
    want = passages_brute([(t or "").encode() for _, t in rows])
    assert len(got) == len(rows)
    for (k, t), kept in zip(rows, want):
        assert (got[k]["text"] or "") == kept
        assert kept == (t or "") or got[k]["n_chars"] == len(kept)
    assert got[0]["text"].split() == rows[0][1].split()[:40] + rows[0][1].split()[-60:]
    assert got[2]["text"] == rows[2][1] and got[9]["text"] == "" and got[10]["text"] == "y"  # 900 letters without white space


def test_quality_features():
    rng = random.Random(3)
    texts = [b"", b" \n", b"one", prose(rng, 50).encode(), b"AB! AB! AB! ab\nx\nx\n", "é ü".encode()]
    alone = np.concatenate([pu_quality.features([t]) for t in texts])
    assert np.allclose(pu_quality.features(texts), alone)
    assert np.isfinite(alone).all() and alone[4, 9] > 0 and alone[4, 11] > 0


def test_quality_classifier(spark, sf_dir):
    rng = random.Random(6)
    rows = [(k, prose(rng, 60) if k % 4 else "### " + " ".join(["JUNK***"] * 60)) for k in range(2000)] + [(None, None), (5000, ""), (7, prose(rng, 60))]
    labels = spark.createDataFrame([(k, int(bool(k % 4)), 0) for k in range(0, 2000, 3)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    table = docs(spark, rows).withColumn("score", F.lit("clash"))
    model = pu_quality.train(table, labels)
    assert 0.6 < model.prior < 0.9
    got = pu_quality.score(table, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert all((r["score"] >= 0.3) == bool(r["doc_id"] % 4) for r in got if r["doc_id"] is not None and r["doc_id"] < 2000)
    assert pu_quality.score(table.limit(0), model).count() == 0
    blank = pu_quality.train(table, labels.limit(0))
    assert {r["score"] for r in pu_quality.score(table, blank).collect()} == {0.5}


def test_quality_held_out(spark):
    """Ranking on rows no label was learned from."""
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op8_pu_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    bad, good = got[got["quality"] == 0]["score"].to_numpy(), got[got["quality"] == 1]["score"].to_numpy()
    assert (good[:, None] > bad).mean() > 0.9
    assert (got["predicted"] == got["quality"]).mean() > 0.9


def test_minimum_cut():
    rng = random.Random(8)
    for _ in range(60):
        n = rng.randint(1, 8)
        unary = [rng.uniform(-2, 2) for _ in range(n)]
        edges = {(a, b): rng.uniform(0, 1.5) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5}
        cost = lambda keep: sum(u for u, k in zip(unary, keep) if u > 0 and not k) - sum(u for u, k in zip(unary, keep) if u < 0 and k) + sum(w for (a, b), w in edges.items() if keep[a] != keep[b])  # noqa: E501, E731
        best = min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))
        assert cost(html_mincut.minimum_cut(unary, edges)) == pytest.approx(best)


PAGE = """<html><head><title>no</title><style>p{}</style></head><body><header><a href="/">Site</a> slogan</header>
<div class="cookie-notice">We use cookies on this site, please accept them all now.</div><nav><ul><li><a>Home</a><li><a>News</a></ul></nav>
<div id="sidebar"><p>Some long teaser text in the side bar that goes on for a while and on.</p></div>
<div class="post-content"><h1>Title</h1><p>First   para &amp; more<br>text, <a href="x>y">link</a>.<p>Second &eacute;&#233; one.</p>
<div class="ad">Buy great things now</div><ul><li>One item</li><li>Two</li></ul><script>var a = "<p>no</p>";</script></div>
<section class="comments"><p>A reader says this is a long comment about the article, well well, and more.</p></section>
<form><label>Email</label><input><button>Go</button></form><footer>c 2020 <!-- hidden --></footer></body></html>"""


def test_main_text(spark):
    want = "Title\n\nFirst para & more text, link.\n\nSecond éé one.\n\nOne item\n\nTwo"
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, "u", None), (3, None, ""), (4, "u", "<nav><a>x</a></nav>"), (5, "u", "<p>cut <b"), (6, "u", "<p>" + "long words here " * 50_000)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = [(r["page_id"], r["text"]) for r in html_mincut.extract(table).collect()]
    assert got[:5] == [(1, want), (1, want), (2, ""), (3, ""), (4, "")]
    assert got[5] == (5, "") or got[5] == (5, "cut") and True
    assert got[6][1] == ("long words here " * 50_000).strip()
    assert html_mincut.extract(table.limit(0)).count() == 0


def test_page_query(spark, sf_dir):
    """The pages of the test tables hold their text in one article."""
    import html
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in QUERIES["op7_html_mincut"](spark, sf_dir).collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", pages[r["page_id"]], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("</?b>|<br>", " ", p)).split()) for p in re.split("</?p>|</?h1>", inner)]
        assert [" ".join(b.split()) for b in r["text"].split("\n\n")] == [p for p in parts if p]


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16)) + rng.normal(size=(12, 16))[rng.integers(0, 12, 3000)] * 2
    x[1000:2000] = x[0]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [(9000, None), (9050, [0.0] * 16), (9100, [float("nan")] * 16), (9150, [1.0] * 15 + [None]), (9200, [float("inf")] * 16), (9250, [1.0]), (9300, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = projected_ann.neighbours(table, F.col("vec_id") % 50 == 0).toPandas()
    norm = np.sqrt((x * x).sum(1))
    hits = 0
    for q, g in got.sort_values("rank").groupby("query_id"):
        c = (x * x[q]).sum(1) / (norm * norm[q])
        c[q] = -2
        order = np.lexsort((np.arange(3000), -c))[:5]
        hits += len(set(order) & set(g["vec_id"]))
        assert list(g["rank"]) == [1, 2, 3, 4, 5] and q < 3000
        assert np.allclose(c[g["vec_id"]], g["score"], rtol=0, atol=1e-12)
        if 1000 <= q < 2000 or q == 0:
            assert list(g["vec_id"]) == list(order)
    assert got["query_id"].nunique() == 60 and hits / 300 >= 0.9
    assert projected_ann.neighbours(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    few = projected_ann.neighbours(table.where("vec_id IN (0, 7, 9050)"), F.col("vec_id") % 50 == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in few] == [(0, 1, 7)]


def test_neighbour_query(spark, sf_dir):
    got = QUERIES["op9_projected_ann"](spark, sf_dir).toPandas()
    d = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    x = np.array(d["embedding"].tolist(), "f8")
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    hits = 0
    for q in d["vec_id"][d["vec_id"] % 50 == 0]:
        c = unit @ unit[d.index[d["vec_id"] == q][0]]
        c[d["vec_id"] == q] = -2
        hits += len(set(d["vec_id"].to_numpy()[np.argsort(-c)[:5]]) & set(got[got["query_id"] == q]["vec_id"]))
    assert hits >= 0.9 * len(got)


def test_pipeline(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = []
    for name, step in corpus_pipeline.STAGES:
        before, table = table, corpus_pipeline.stage(step(spark, table, sf_dir), name)
        sizes.append(table.count())
        if name != "tokens":
            assert table.columns == corpus_pipeline.COLUMNS
        if name == "near_duplicates":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            want = sorted(i for i, _, c in near_brute(rows, 5) if i == c)
            assert sorted(r["doc_id"] for r in table.collect()) == want
        if name == "repeated_passages":
            rows = [(r["doc_id"], (r["text"] or "").encode()) for r in before.collect()]
            want = dict(zip((i for i, _ in rows), passages_brute([t for _, t in rows])))
            assert {r["doc_id"]: r["text"] for r in table.collect()} == want
    assert sizes[0] >= sizes[1] == sizes[2] and sizes[3] == sizes[4] > 0


def test_pipeline_edges(spark, sf_dir):
    good = " ".join(f"word{k} and" for k in range(60))
    rows = [(1, None, None, None, None), (None, good, "en", None, 1), (2, good, "en", "s", 1), (2, good, "en", "s", 1), (3, "", "en", "s", 0)]
    for data in (rows, []):
        table = spark.createDataFrame(data, DOCS).withColumn("ids", F.lit("clash"))
        for name, step in corpus_pipeline.STAGES:
            table = corpus_pipeline.stage(step(spark, table, sf_dir), name)
        assert table.count() == (1 if data else 0) or data and table.count() > 0


def test_runs_of_one_are_not_dealt_out(spark, monkeypatch):
    """Buckets of one run leave before classes are made, and tables that were superseded are gone."""
    rng = random.Random(5)
    shared = prose(rng, 120)
    rows, counts, tables = [(k, prose(rng, 200) + (shared if k < 2 else "")) for k in range(30)], {}, {}

    def counted(df, name, stage=suffix_dedup.stage):
        tables[name] = stage(df, name)
        counts[name] = tables[name].count()
        return tables[name]

    monkeypatch.setattr(suffix_dedup, "stage", counted)
    assert {r["doc_id"] for r in suffix_dedup.repeats(docs(spark, rows)).collect()} == {0, 1}
    assert 0 < counts["suffix-classes"] < counts["suffix-runs"] / 4
    for name in ("suffix-runs", "suffix-classes", "suffix-covers"):
        assert not any(os.path.exists(f.removeprefix("file://")) for f in tables[name].inputFiles())


def test_runs_are_found_in_little_memory():
    rng = random.Random(5)
    texts = [prose(rng, 700) for _ in range(512)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(512)), pa.array(range(512)), pa.array(texts)], names=["doc_id", "text_hash", "text"])
    for length, q, read in ((400, 160, suffix_dedup._bytes), (51, 20, suffix_dedup._words)):
        tracemalloc.start()
        n = sum(r.num_rows for r in suffix_dedup._find(length, q, read)([batch]))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n > 5000 and peak < 40 << 20
