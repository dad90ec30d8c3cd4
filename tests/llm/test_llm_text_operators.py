"""Chat formatting, quality rules, sharding, mixing and BPE on rows made for their edge cases."""

import zlib

import numpy as np
import pytest
from compare import assert_same
from pyspark.sql import functions as F

from panelweave.llm import bpe, chat_format, mixing, quality_rules, shards
from panelweave.llm.queries import ORACLES, QUERIES, tokenizer_path
from panelweave.llm.text import text_or_empty

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], DOCS)


@pytest.mark.parametrize("key", list(ORACLES))
def test_queries_with_sql(spark, duck, sf_dir, key):
    df = QUERIES[key](spark, sf_dir)
    cur = duck.execute(ORACLES[key])
    assert_same(df.columns, [tuple(r) for r in df.collect()], [c[0] for c in cur.description], cur.fetchall())


def native(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_chat_round_trip(spark):
    nasty = ["", None, "<|im_end|>", "a\\e\\p<|x", "<", "|>\n", "\\", "<|image|>", "é\U0001F600\n\n", "\\n<\\p<|<|"]
    rows = [(1, k, role, t) for k, t in enumerate(nasty) for role in ("assistant",)]
    rows += [(2, 0, "us\n<|er\\n", "x"), (2, None, None, None), (2, 0, "us\n<|er\\n", "x"), (None, 0, "assistant", "y")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = turns.withColumn("parts", chat_format.text_parts(F.col("text"))).withColumn("formatted", F.lit("clash"))
    out = chat_format.format_chat(turns)
    assert native(out)
    out = out.select("conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("t"),
                     chat_format.read_loss(F.col("formatted"), F.col("segments")).alias("loss"), "segments")
    got = {r["conv_id"]: r for r in out.collect()}
    assert [(t["role"], t["text"]) for t in got[1]["t"]] == [("assistant", t or "") for t in nasty]
    assert got[1]["loss"] == "".join(t or "" for t in nasty)
    assert [(t["role"], t["text"]) for t in got[2]["t"]] == [("", ""), ("us\n<|er\\n", "x"), ("us\n<|er\\n", "x")]
    assert got[2]["loss"] == "" and got[None]["loss"] == "y"
    f, s = got[1]["formatted"], got[1]["segments"]
    assert all(f[x["start"]:].startswith("<|im_start|>") for x in s)
    assert [f[x["text_start"]:x["text_start"] + x["length"]].count("<|") for x in s] == [0] * len(nasty)


def test_chat_typed_parts(spark):
    part = lambda **k: {"kind": None, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | k
    rows = [(1, 0, "user", [part(kind="text", text="see "), part(kind="image", ref="a.png", width=28, height=15), None,
                            part(kind="audio", ref="b.wav", seconds=1.5)]),
            (1, 1, "assistant", [part(kind="document", ref="c.pdf", pages=2), part(kind="odd", ref="d"), part(kind="text", text="<|image|>")]),
            (2, 0, "assistant", None), (3, 0, "user", [])]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    got = {r["conv_id"]: r for r in chat_format.format_chat(turns).collect()}
    assert got[1]["formatted"] == ("<|im_start|>user\nsee <|image|><|audio|><|im_end|>\n"
                                   "<|im_start|>assistant\n<|document|><|file|><\\pimage|><|im_end|>\n")
    assert [(a["kind"], a["ref"], a["tokens"]) for a in got[1]["attachments"]] == [
        ("image", "a.png", 4), ("audio", "b.wav", 38), ("document", "c.pdf", 512), ("file", "d", 0)]
    assert got[1]["expanded_tokens"] == 554
    assert got[2]["n_turns"] == 1 and got[3]["attachments"] == []


def test_quality_rules_edges(spark):
    clean = " ".join(f"word{k} of" for k in range(40))
    rows = [(1, None, "s"), (2, "", "s"), (3, " \t\r\n\x0b\x0c ", "s"), (4, clean, "s"), (4, clean, "s"), (None, clean, None),
            (5, ("a b c d e f g h " * 30).strip(), "s"), (6, "hello### $$$ " * 30, "s"), (7, "LOUD " + "VERY LOUD WORDS " * 1 + clean.upper(), "s"),
            (8, " ".join(["x"] * 50), "s"), (9, "x " * 100_000, "s")]
    out = quality_rules.cascade(docs(spark, rows).withColumn("kept", F.lit(1)).withColumn("n_words", F.lit(5)), keep_measures=True)
    assert native(out)
    got = [(r["doc_id"], r["n_words"], r["n_repeat_words"], r["kept"]) for r in out.collect()]
    assert [g[1] for g in got[:3]] == [0, 0, 0] and not any(g[3] for g in got[:3])
    assert got[3] == got[4] == (4, 80, 0, True) and got[5] == (None, 80, 0, True)
    assert got[6][1:] == (240, 240, False) and not any(g[3] for g in got[7:])
    assert got[9][1] == 1 and got[10][1:3] == (100_000, 100_000)
    assert quality_rules.cascade(docs(spark, []), order=list(quality_rules.RULES)).count() == 0
    assert quality_rules.estimate(docs(spark, []))[0].rejection == 0


def test_quality_order_is_by_rejection_per_cost():
    rules = quality_rules.RULES
    made = [quality_rules.Estimate(rules[0], 4.0, 0.2), quality_rules.Estimate(rules[1], 1.0, 0.1),
            quality_rules.Estimate(rules[2], 0.5, 0.0), quality_rules.Estimate(rules[3], 0.1, 0.0)]
    assert quality_rules.ordered(made) == [rules[1], rules[0], rules[3], rules[2]]


def test_quality_order_never_changes_the_verdict(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one = quality_rules.cascade(table, order=list(quality_rules.RULES)).select("doc_id", "kept")
    two = quality_rules.cascade(table, order=list(quality_rules.RULES)[::-1]).select("doc_id", "kept")
    assert sorted(one.collect()) == sorted(two.collect())


def shard(spark, table, **kw):
    rows = table.select("doc_id", (F.octet_length(text_or_empty()) + 16).cast("long").alias("size"),
                        F.xxhash64(text_or_empty()).alias("text_hash"), F.lit(9).alias("slot"))
    return shards.shard_rows(rows, **kw).toPandas()


def test_shards(spark, sf_dir):
    hot = [(k, "same text " * 5, "s") for k in range(3000)] + [(7, "again", "s")] * 3000
    hot += [(k, f"text {k}" * (k % 50), "s") for k in range(3000)] + [(None, None, None), (None, "", "s")]
    for table, n in ((docs(spark, hot), 40), (docs(spark, [(1, "a", "s"), (2, None, "s")]), 40), (docs(spark, []), 4)):
        got = shard(spark, table, shards=n)
        assert len(got) == table.count()
        assert all(sorted(s) == list(range(len(s))) for _, s in got.groupby("shard")["slot"])
        assert got["shard"].between(0, n - 1).all()
    got = shard(spark, docs(spark, hot))
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 40 and sums.max() - sums.min() <= 0.02 * sums.mean() + 2 * got["size"].max()


def test_shard_query(spark, sf_dir):
    got = QUERIES["op3_histogram_sort"](spark, sf_dir).toPandas().sort_values("doc_id")
    text = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas().sort_values("doc_id")["text"]
    data = [(t or "").encode() for t in text]
    assert list(got["size"]) == [len(t) + 16 for t in data]
    assert list(got["text_crc32"]) == [zlib.crc32(t) for t in data]
    assert got["grown_shard"].isna().all()


def test_targets():
    assert mixing.targets({"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 2, "c": 3}) == {"a": 5.0, "b": 10.0, "c": 15.0}
    got = mixing.targets({"a": 100, "b": 1, "c": 10}, {"a": 1, "b": 2, "c": 3})
    assert got["b"] == 3 and got["c"] == 30 and got["a"] == pytest.approx(78)
    assert mixing.targets({}, {}) == {}
    assert mixing.cyclic_weights([None, "b", "a", "Z"]) == {"Z": 1, "a": 2, "b": 3, None: 1}


def test_mix(spark, sf_dir):
    rng = np.random.default_rng(3)
    rows = [(k, s, int(n)) for k, (s, n) in enumerate(zip(rng.choice(["a", "b", None, "d"], 9000, p=[0.7, 0.1, 0.1, 0.1]), rng.lognormal(5, 1, 9000)))]
    rows += [(5, "a", 7)] * 50 + [(None, "b", 3), (9999, "empty", 0)]
    table = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.mix(table).toPandas()
    again = mixing.mix(table.repartition(7)).toPandas()
    order = ["source", "doc_id", "size", "copies"]
    assert got[order].sort_values(order).reset_index(drop=True).equals(again[order].sort_values(order).reset_index(drop=True))
    assert len(got) == len(rows) and got["copies"].between(0, 3).all()
    assert ((got["copies"] - got["rate"]).abs() < 1).all()
    for _, g in got.groupby("source", dropna=False):
        assert g["size"].sum() == g["source_size"].iloc[0]
        assert (g["size"] * g["copies"]).sum() == pytest.approx(g["target"].iloc[0], rel=2e-3, abs=1)
        # the optimum: the logarithm of an uncapped rate is linear in the size
        free = g[(g["rate"] < 3) & (g["size"] > 0)]
        if len(free) > 1:
            slope = np.log(free["rate"]) / free["size"]
            assert np.allclose(slope, slope.iloc[0], rtol=1e-6, atol=1e-12)
    assert mixing.mix(table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(table, most_sources=2)


def test_mix_query(spark, sf_dir):
    got = QUERIES["op5_entropy_mix"](spark, sf_dir).toPandas()
    assert (got["taken"] <= 3 * got["size"]).all()
    assert got.drop_duplicates("target")["target"].sum() <= got["size"].sum() + 1e-6


ODD = ["", None, "   ", "a<|endoftext|>b <|startoftext|>", "Σίσυφος ΟΔΟΣ", "İstanbul ẞ Å é", "it's We'Ll don't'D", "a" * 5000,
       "!!!???" * 400, "x​y　z\x85q\x1cw", "½ ² ٣ 12345", "<|EndOfText|> <|endoftext|", "日本語 한국어", "é \U0001F600퟿",
       "abab" * 300, "a\x00b", "<|endoftext|>", "\n\n", "ß ŉ ǅ ﬁ"]


def test_bpe_equals_the_library(spark, sf_dir):
    from tokenizers import Tokenizer
    tool = Tokenizer.from_file(tokenizer_path())
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + ["same"] * 3
    table = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(table, tokenizer_path()), tokenizer_path())
    got = {r["doc_id"]: r for r in out.collect()}
    for k, want in enumerate(tool.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        assert got[k]["ids"] == want.ids, texts[k]
        assert got[k]["decoded"] == tool.decode(want.ids, skip_special_tokens=False)
    assert bpe.encode(table.limit(0), tokenizer_path()).count() == 0


def test_bpe_merges_one_by_one():
    """Batched rounds against the textbook loop."""
    vocab = bpe.vocabulary(tokenizer_path())
    rank = {(a, b): (r, m) for a, b, r, m in zip(vocab.key // vocab.size, vocab.key % vocab.size, vocab.rank, vocab.made)}
    rng = np.random.default_rng(5)
    words = [bytes(rng.choice(list(b"aeinorst"), n).tolist()) for n in rng.integers(1, 60, 200)]
    ids, count = vocab.merge(words)
    at = 0
    for w, n in zip(words, count):
        s = [*(int(vocab.first[c]) for c in w[:-1]), int(vocab.last[w[-1]])]
        while True:
            best = min(((rank[p][0], k) for k, p in enumerate(zip(s, s[1:])) if p in rank), default=None)
            if best is None:
                break
            k = best[1]
            s[k:k + 2] = [int(rank[s[k], s[k + 1]][1])]
        assert ids[at:at + n].tolist() == s
        at += n


def test_bpe_holds_few_chunks():
    encoder = bpe.Encoder(bpe.vocabulary(tokenizer_path()))
    for k in range(0, 140_000, 20_000):
        encoder.encode([" ".join(map(str, range(k, k + 20_000)))])
        assert len(encoder.number) < 125_000


def test_mix_makes_no_table_of_pickled_rows(spark, monkeypatch):
    made = []
    plain = type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **k: made.append(type(data)) or plain(self, data, *a, **k))
    sized = spark.sql("SELECT id AS doc_id, IF(id % 3 = 0, null, 'a') AS source, id % 50 AS size FROM range(600)")
    assert mixing.mix(sized).count() == 600
    assert made and list not in made
