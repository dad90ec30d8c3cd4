"""The byte-level encoder against the library with the same ranks, and decoding of broken bytes."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken

from panelweave.llm import byte_bpe
from panelweave.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def library(path=PATH):
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_query_equals_library(spark, sf_dir):
    theirs = library()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op12_byte_bpe"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r["doc_id"]]
        ids = theirs.encode_ordinary(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_edges_and_clashing_names(spark):
    texts = [None, "", " ", "  \n\n  a", "a\n\n  b \t c\x1c!\x1c d　　e \x85 f", "it's WE'LL 12345 ...!!!", "\U0001f600\U0001f469‍\U0001f4bb",
             "x" * 30_000 + " " * 3000 + "ab" * 5000, "È" * 999, "same", "same"]
    rows = [(k, t, [1], "old") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, IDS array<int>, decoded string")
    for path in (PATH, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")):
        theirs = library(path)
        for packed in (False, True):
            coded = byte_bpe.encode(docs, path, PATTERN, packed)
            got = {r["doc_id"]: r for r in byte_bpe.decode(coded, path).collect()}
            assert coded.columns == ["doc_id", "decoded", "ids"] and len(got) == len(texts)
            for k, t in enumerate(texts):
                ids = np.frombuffer(got[k]["ids"], "<u4").tolist() if packed else got[k]["ids"]
                assert ids == theirs.encode_ordinary(t or "") and got[k]["decoded"] == (t or "")
    none = byte_bpe.decode(byte_bpe.encode(docs.where("false"), PATH, PATTERN), PATH)
    assert none.columns == ["doc_id", "ids", "decoded"] and none.count() == 0


def test_transducer_against_plain_merges():
    machine, rng = byte_bpe.Transducer(byte_bpe.ranks(PATH)), random.Random(3)
    tokens = list(machine.ranks.rank)
    for k in range(4000):
        kind = k % 3
        if kind == 0:
            piece = bytes(rng.choice(b"abAB 0\xc3\xa9\xe2\x82\xac!\n") for _ in range(rng.randint(1, 40)))
        elif kind == 1:
            piece = b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 6)))
        else:
            piece = bytes(rng.choice(b"aehinorst") for _ in range(rng.randint(1, 30)))
        assert machine.encode(piece) == ([machine.ranks.rank[piece]] if piece in machine.ranks.rank else machine.ranks.merged(piece))


def test_tokens_leave_after_bounded_lookahead():
    machine = byte_bpe.Transducer(byte_bpe.ranks(PATH))
    stream, most, whole = byte_bpe.Stream(machine), 0, b"abcdeft" * 3000
    for at in range(0, len(whole), 100):
        stream.feed(whole[at:at + 100])
        most = max(most, len(stream.ended))
    assert stream.close() == machine.encode(whole) and most < byte_bpe.WINDOW + 100 + max(machine.ranks.length)
    assert len(machine.states) < 200  # states repeat with the text


def test_small_caches_change_nothing(monkeypatch):
    for name in ("KEPT_PIECES", "KEPT_STATES", "KEPT_PAIRS"):
        monkeypatch.setattr(byte_bpe, name, 3)
    text = "the cat sat on the mat, the hat; overheated, unthinkably reheated cats " * 5
    assert np.frombuffer(byte_bpe.Encoder(PATH, PATTERN).encode(text), "<u4").tolist() == library().encode_ordinary(text)


def test_streaming_decoder_is_that_of_the_library(spark):
    rng = random.Random(5)
    for _ in range(3000):
        data = bytes(rng.choice([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xED, 0xA0, 0xF0, 0x9F, 0x98, 0x80, 0xF4, 0x90, 0xC0, 0xFF])
                     for _ in range(rng.randint(0, 9)))
        stream, cut = byte_bpe.Utf8Stream(), rng.randint(0, 9)
        assert stream.feed(data[:cut]) + stream.feed(data[cut:]) + stream.close() == data.decode("utf-8", "replace"), data
    byte = byte_bpe.ranks(PATH).rank
    ids = [[byte[b"\xc3"]], [byte[b"\xc3"], byte[b"\xa9"]], [byte[b"\xa9"], byte[b"A"]], [byte[b"\xe2"], byte[b"A"]], None, []]
    coded = spark.createDataFrame([(k, i) for k, i in enumerate(ids)], "k int, ids array<int>")
    got = [r["decoded"] for r in byte_bpe.decode(coded, PATH).orderBy("k").collect()]
    assert got == ["�", "é", "�A", "�A", "", ""]
