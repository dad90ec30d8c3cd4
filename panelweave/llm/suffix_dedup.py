"""Removal of long repeated byte strings by bucket-pointer refinement.

A byte goes if it is covered by a string of `length` bytes that starts at two
places or more.  All starts (suffixes) are put in buckets that are refined until
only equal strings of the full length share one:

0. Initial q-gram buckets.  A start belongs to the bucket of the least q-gram (by
   hash) among those inside its string.  Equal strings have the same least q-gram at
   the same distance, so they meet in one bucket; neighbouring starts that have it in
   common form a run, one row for about a hundred starts.
1. A bucket is refined by the identifier of all text under a run.  Runs that have
   theirs twice are repeats as a whole and are done; so are buckets with one run.
2. Runs still open are cut into cells of 32 starts and refined by the identifier of
   the text that all starts of the cell share, at offsets before and after the q-gram.
   Buckets of one go; cells whose text under all starts occurs twice are done.
3. What is left is refined start by start, by the identifier of the whole string.

Each level reuses the buckets of the one before: only members of a surviving bucket
go on, one member speaking for a class that is done.  Grouping on identifiers stands
for sorting on them, since only equality matters here; identifiers are 64-bit
(levels 0-2, together with the bucket above) and 128-bit (level 3) hashes.

Texts of documents in shared buckets are fetched once; a hot q-gram costs rows,
never a task that holds its whole bucket.

All of this is the same for texts read as words (runs of characters that are not white
space), each of them one 64-bit hash where a byte stands otherwise: a passage is then a
number of words, however short they are and whatever white space lies between them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from panelweave.llm.minhash import _BASE, _INVERSE, _SPACE, _power, _word_hashes, mix64
from panelweave.llm.minhash import _pieces as _text_pieces
from panelweave.llm.text import small_batches, text_or_empty
from panelweave.sources.scratch import drop_staged, stage

LENGTH, Q = 400, 160
CELL = 32
#: Passages of over 50 words.
PASSAGE, WORD_Q, WORD_CELL = 51, 20, 8
PIECE = 200_000  # starts handled at a time, by many arrays as long; positions must fit 24 bits
RUN = "h long, c long, doc_id long, text_hash long, lo long, n int, a int"


def _runs(data: np.ndarray, bounds: np.ndarray, length: int, q: int):
    """Runs of starts in texts laid end to end: text, first start, count, distance of the q-gram, bucket, cover."""
    total = len(data)
    sums = np.zeros(total + 1, "u8")
    np.cumsum((data.astype("u8") + np.uint64(1)) * _power(_BASE, total), out=sums[1:])
    back = _power(_INVERSE, total + 1)
    gram = mix64((sums[q:] - sums[:-q]) * back[:total - q + 1])
    place = np.arange(len(gram), dtype="u8")
    key = (gram >> np.uint64(24) << np.uint64(24)) | place
    width, have = length - q + 1, 1
    while have * 2 <= width:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    if have < width:
        key = np.minimum(key[:len(key) - (width - have)], key[width - have:])
    least = (key & np.uint64(0xFFFFFF)).astype("i8")
    sizes = np.diff(bounds)
    text = np.repeat(np.arange(len(sizes)), np.maximum(sizes - length + 1, 0))
    first = np.cumsum(np.maximum(sizes - length + 1, 0)) - np.maximum(sizes - length + 1, 0)
    start = bounds[text] + np.arange(len(text)) - first[text]
    least = least[start]
    cut = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (text[1:] != text[:-1])]) if len(start) else np.empty(0, "i8")
    lo, n = start[cut], np.diff(np.r_[cut, len(start)])
    cover = mix64((sums[lo + n + length - 1] - sums[lo]) * back[lo] + n.astype("u8"))
    anchor = least[cut]
    return text[cut], lo - bounds[text[cut]], n, anchor - lo, gram[anchor].view("i8"), cover.view("i8")


def _bytes(text: bytes) -> np.ndarray:
    return np.frombuffer(text, "u1")


def _words(text: bytes) -> np.ndarray:
    return np.concatenate([np.empty(0, "u8"), *(_word_hashes(p)[0] for p in _text_pieces(text))])


def _byte_edges(text: bytes, spans: list[list[int]]) -> list[list[int]]:
    return spans


def _word_edges(text: bytes, spans: list[list[int]]) -> list[list[int]]:
    """Spans of words as ranges of bytes, from the first word's start to the last one's end."""
    inside = np.r_[False, ~_SPACE[np.frombuffer(text, "u1")], False]
    change = np.flatnonzero(inside[1:] != inside[:-1])
    return [[int(change[2 * a]), int(change[2 * b - 1])] for a, b in spans]


def _pieces(texts: list[bytes], length: int, read=_bytes):
    """(index of the text, offset, units): long texts in overlapping pieces, so that every start is in one."""
    for k, text in enumerate(texts):
        t = read(text)
        for at in range(0, max(len(t) - length + 1, 0), PIECE):
            yield k, at, t[at:at + PIECE + length - 1]


def _find(length: int, q: int, read):
    def flush(batch, held):
        data = np.concatenate([p for _, _, p in held])
        bounds = np.cumsum([0, *(len(p) for _, _, p in held)])
        text, lo, n, a, h, c = _runs(data, bounds, length, q)
        rows = np.array([k for k, _, _ in held])[text]
        lo = lo + np.array([at for _, at, _ in held])[text]
        return pa.RecordBatch.from_arrays(
            [pa.array(h), pa.array(c), batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)),
             pa.array(lo), pa.array(n.astype("i4")), pa.array(a.astype("i4"))],
            names=["h", "c", "doc_id", "text_hash", "lo", "n", "a"])

    def run(batches):
        for batch in batches:
            held, size = [], 0
            for piece in _pieces(batch.column(2).cast(pa.binary()).to_pylist(), length, read):
                held.append(piece)
                size += len(piece[2])
                if size > PIECE:
                    yield flush(batch, held)
                    held, size = [], 0
            if held:
                yield flush(batch, held)
    return run


def _covers(length: int, read):
    """The text under each open run."""
    def run(batches):
        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            for text, runs in zip(map(read, texts), batch.column(1).to_pylist()):
                for r in runs:
                    r["cover"] = text[r["lo"]:r["lo"] + r["n"] + length - 1].tobytes()
                yield pa.RecordBatch.from_pylist(runs, schema=pa.schema(
                    [("run", pa.int64()), ("h", pa.int64()), ("n", pa.int32()), ("a", pa.int32()), ("active", pa.bool_()),
                     ("cover", pa.binary())]))
    return run


def _long(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _reach(r: dict, j: int, size: int) -> tuple[int, int]:
    """Distances of the q-gram from the starts of a run in one cell."""
    return max(size * j, r["a"] - r["n"] + 1), min(size * j + size - 1, r["a"])


def _cells(length: int, size: int, wide: int):
    """Cells of `size` starts; a unit of the text takes `wide` bytes of the cover."""
    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                for j in range((r["a"] - r["n"] + 1) // size, r["a"] // size + 1):
                    at, (near, far) = r["a"] - size * j, _reach(r, j, size)
                    seed = (r["h"] ^ j) & (1 << 64) - 1
                    core = xxhash.xxh3_64_intdigest(r["cover"][wide * at:wide * (at + length - size + 1)], seed=seed)
                    whole = xxhash.xxh3_64_intdigest(r["cover"][wide * (r["a"] - far):wide * (r["a"] - near + length)], seed=far)
                    out.append((r["run"], _long(core), _long(whole), j, near, far, r["active"]))
            columns = list(zip(*out)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             names=["run", "core", "whole", "cell", "near", "far", "active"])
    return run


def _starts(length: int, size: int, wide: int):
    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                for c in r["cells"]:
                    near, far = _reach(r, c["cell"], size)
                    for o in range(near, far + 1):
                        at = r["a"] - o
                        digest = xxhash.xxh3_128_intdigest(r["cover"][wide * at:wide * (at + length)], seed=o)
                        out.append((r["run"], o, _long(digest >> 64), _long(digest & (1 << 64) - 1), c["active"]))
            columns = list(zip(*out)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             names=["run", "offset", "one", "two", "active"])
    return run


def _merged(raw: list[dict], touch: int) -> list[list[int]]:
    """Spans whose distance is below `touch` are one; between words that touch there is white space, which stays."""
    merged: list[list[int]] = []
    for s in raw:
        if merged and s["lo"] < merged[-1][1] + touch:
            merged[-1][1] = max(merged[-1][1], s["hi"])
        else:
            merged.append([s["lo"], s["hi"]])
    return merged


def _outside(text: bytes, spans: list[list[int]]) -> bytes:
    edges = [0, *(e for s in spans for e in s), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


_SPANS = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))


def _cut(edges_of, touch: int):
    def run(batches):
        for batch in batches:
            spans, kept = [], []
            for text, raw in zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist()):
                merged = edges_of(text, _merged(raw, touch))
                kept.append(_outside(text, merged))
                spans.append([{"lo": a, "hi": b} for a, b in merged])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(spans, _SPANS), pa.array(kept, pa.binary())],
                names=["doc_id", "text_hash", "spans", "kept"])
    return run


def _cut_both(batches):
    """The rows with what is left of their texts; null where neither law removes anything."""
    for batch in batches:
        of_bytes, of_words = (batch.column(name).to_pylist() for name in ("of_bytes", "of_words"))
        kept: list[bytes | None] = []
        for text, some, others in zip(batch.column("text"), of_bytes, of_words):
            if not some and not others:
                kept.append(None)
                continue
            data = text.as_py().encode()
            every = sorted(_merged(some or [], 1) + _word_edges(data, _merged(others or [], 0)))
            joined = _merged([{"lo": a, "hi": b} for a, b in every], 1)
            kept.append(_outside(data, _whole_characters(data, joined)))
        yield batch.drop_columns(["of_bytes", "of_words"]).append_column(
            "kept", pa.array(kept, pa.binary()).cast(pa.string()))


def _cut_apart(batches):
    """The rows with the ranges of either law, what the first leaves and what both leave; null where nothing goes."""
    for batch in batches:
        of_bytes, of_words = (batch.column(name).to_pylist() for name in ("of_bytes", "of_words"))
        spans, kept, passages, rest = [], [], [], []
        for text, some, others in zip(batch.column("text").cast(pa.binary()), of_bytes, of_words):
            data = text.as_py() if some or others else b""
            strings, words = _merged(some or [], 1), _word_edges(data, _merged(others or [], 0))
            both = _merged([{"lo": a, "hi": b} for a, b in sorted(strings + words)], 1)
            spans.append([{"lo": a, "hi": b} for a, b in strings] or None)
            kept.append(_outside(data, strings) if strings else None)
            passages.append([{"lo": a, "hi": b} for a, b in words] or None)
            rest.append(_outside(data, _whole_characters(data, both)) if both else None)
        batch = batch.drop_columns(["of_bytes", "of_words"])
        for name, values, kind in (("spans", spans, _SPANS), ("kept", kept, pa.binary()),
                                   ("passages", passages, _SPANS), ("rest", rest, pa.binary())):
            batch = batch.append_column(name, pa.array(values, kind))
        yield batch


def _same(left: DataFrame, right: DataFrame):
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_hash"] == right["text_hash"])


def repeated_words(docs: DataFrame, length: int = PASSAGE) -> DataFrame:
    """As `repeats`, of every document that holds a passage of `length` words that starts at two places or more.

    spans are ranges of bytes, too, from the start of a word to the end of one; white space counts as
    no part of a passage.
    """
    return repeats(docs, length, WORD_Q, words=True)


def _whole_characters(text: bytes, spans: list[list[int]]) -> list[list[int]]:
    """Spans that would cut a character take all of it."""
    out: list[list[int]] = []
    for lo, hi in spans:
        while lo and text[lo] & 0xC0 == 0x80:
            lo -= 1
        while hi < len(text) and text[hi] & 0xC0 == 0x80:
            hi += 1
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def _long_words(length: int, passage: int):
    """Rows whose text has `length` bytes in a row in which fewer than `passage` words stand whole."""
    def run(batches):
        for batch in batches:
            held = []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                inside = np.r_[False, ~_SPACE[np.frombuffer(text, "u1")], False]
                change = np.flatnonzero(inside[1:] != inside[:-1])
                # such a stretch reaches from behind a word's start to before the end of the passage-th word after it
                first, last = np.r_[-1, change[::2]], np.r_[change[1::2], len(text) + 1]
                ends = last[np.minimum(np.arange(len(first)) + passage - 1, len(last) - 1)]
                held.append(bool((ends - first - 2 >= length).any()))
            yield batch.filter(pa.array(held, pa.bool_()))
    return run


def repeated_passages(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE) -> DataFrame:
    """Every row of docs, and kept: what is left of its text where either law removes something, otherwise null.

    A passage of `passage` words that starts at two places or more goes; so does a string of `length` bytes, in
    texts that have so many bytes in a row with fewer whole words than a passage, such as text without white space.
    (A repeated string with more words holds a repeated passage.)  Both are judged on the input.  A character
    that a string's end would cut goes as a whole, so kept is valid text.  docs has no columns of_bytes, of_words, kept.
    """
    small_batches(docs.sparkSession)
    # staged, so that no task needs a second Python worker for what follows
    wide = stage(docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(
        _long_words(length, passage), "doc_id long, text string"), "wide-texts")
    of_bytes = _spans(wide, length, Q, words=False)
    drop_staged(wide)
    of_words = _spans(docs, passage, WORD_Q, words=True)
    return _with_spans(docs, of_bytes, of_words).mapInArrow(
        _cut_both, StructType([*docs.schema.fields, StructField("kept", StringType())]))


def repeats_and_passages(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE) -> DataFrame:
    """Every row of docs, and spans, kept, passages, rest; null where nothing goes.

    spans and kept are those of `repeats`: strings of `length` bytes.  passages are the ranges of `repeated_words`,
    however few bytes they have.  rest is what is left of the text without either, and takes a character that a
    range's end would cut as a whole.  Both laws are judged on the input, over all texts.  docs has none of these
    columns, nor of_bytes, of_words.
    """
    small_batches(docs.sparkSession)
    of_bytes = _spans(docs, length, Q, words=False)
    of_words = _spans(docs, passage, WORD_Q, words=True)
    ranges = ArrayType(StructType([StructField("lo", LongType()), StructField("hi", LongType())]))
    return _with_spans(docs, of_bytes, of_words).mapInArrow(_cut_apart, StructType([
        *docs.schema.fields, StructField("spans", ranges), StructField("kept", BinaryType()),
        StructField("passages", ranges), StructField("rest", BinaryType())]))


def _spans(docs: DataFrame, length: int, q: int, words: bool) -> DataFrame:
    spans, involved = _places(docs, length, q, words)
    drop_staged(involved)
    return spans.withColumn("words", F.lit(words))


def _with_spans(docs: DataFrame, of_bytes: DataFrame, of_words: DataFrame) -> DataFrame:
    """Every row of docs with the ranges of either law: of_bytes in bytes, of_words in words."""
    # the spans of a text lie in one row for either law
    spans = of_bytes.unionAll(of_words).groupBy("doc_id", "text_hash").agg(
        F.first(F.when(~F.col("words"), F.col("raw")), ignorenulls=True).alias("of_bytes"),
        F.first(F.when(F.col("words"), F.col("raw")), ignorenulls=True).alias("of_words"))
    texts = docs.withColumn("text_hash", F.xxhash64(text_or_empty()))
    return texts.join(spans, _same(texts, spans), "left").select(*(texts[c] for c in docs.columns), "of_bytes", "of_words")


def repeats(docs: DataFrame, length: int = LENGTH, q: int = Q, words: bool = False) -> DataFrame:
    """doc_id, text_hash, spans, kept of every document that holds a repeated string.

    spans: the maximal byte ranges [lo, hi) to remove, in order; kept: the other bytes.
    text_hash is xxhash64 of the text (null: empty); (doc_id, text_hash) names a
    document, null ids included, and repeated rows repeat each other's text.  Strings are
    judged on the input; texts shorter than `length` are never touched.  Other columns
    are ignored.  With `words`, `length` and `q` count words.
    """
    edges, touch = (_word_edges, 0) if words else (_byte_edges, 1)
    every, involved = _places(docs, length, q, words)
    joined = involved.join(every, _same(involved, every)).select(involved["doc_id"], involved["text_hash"], "text", "raw")
    return joined.mapInArrow(
        _cut(edges, touch), "doc_id long, text_hash long, spans array<struct<lo:long,hi:long>>, kept binary")


def _places(docs: DataFrame, length: int, q: int, words: bool) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, raw): the repeated ranges of each document, sorted, in units of the text; and the texts.

    Both are staged tables; the texts (doc_id, text_hash, text) are of every document that the ranges name.
    """
    read, wide, size = (_words, 8, WORD_CELL) if words else (_bytes, 1, CELL)
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("text_hash"), text_or_empty().alias("text"))
    found = stage(docs.where(F.octet_length("text") >= length).mapInArrow(_find(length, q, read), RUN), "suffix-runs")
    # nearly all buckets hold one run, whose strings are nowhere else; they leave before anything wide is dealt out
    shared = found.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("h")
    runs = stage(found.join(shared, "h", "left_semi"), "suffix-shared")
    drop_staged(found)
    where = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "text_hash", "lo", "n", "a")
    classes = stage(runs.groupBy("h", "c").agg(F.count(F.lit(1)).alias("m"), F.min(where).alias("rep")), "suffix-classes")
    whole = runs.join(classes.where("m > 1").select("h", "c"), ["h", "c"]).select(
        "doc_id", "text_hash", "lo", (F.col("lo") + F.col("n") + length - 1).alias("hi"))

    buckets = classes.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("m").alias("least"))
    open_ = classes.join(buckets.where("k > 1 AND least = 1").select("h"), "h").select(
        "h", (F.col("m") == 1).alias("active"), "rep.doc_id", "rep.text_hash", "rep.lo", "rep.n", "rep.a")
    # the number of a run is fixed by writing it
    open_ = stage(open_.withColumn("run", F.monotonically_increasing_id()), "suffix-open")
    spans = stage(whole.distinct(), "suffix-whole")
    drop_staged(runs, classes)

    keys = open_.select("doc_id", "text_hash").union(spans.select("doc_id", "text_hash")).distinct()
    involved = stage(docs.join(keys, _same(docs, keys), "left_semi").dropDuplicates(["doc_id", "text_hash"]), "suffix-texts")

    per_doc = open_.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("run", "h", "lo", "n", "a", "active")).alias("runs"))
    covers = stage(involved.join(per_doc, _same(involved, per_doc)).select("text", "runs").mapInArrow(
        _covers(length, read), "run long, h long, n int, a int, active boolean, cover binary"), "suffix-covers")

    cells = stage(covers.mapInArrow(
        _cells(length, size, wide), "run long, core long, whole long, cell int, near int, far int, active boolean"), "suffix-cells")
    alike = stage(cells.groupBy("core", "whole").agg(
        F.count(F.lit(1)).alias("m"), F.min(F.struct("run", "cell", "active")).alias("rep")), "suffix-alike")
    single = (F.col("m") == 1) & F.col("rep.active")
    met = alike.groupBy("core").agg(F.count(F.lit(1)).alias("k"), F.max(single).alias("any")).where("k > 1 AND any")
    todo = alike.join(met.select("core"), "core").select("rep.run", F.struct("rep.cell", single.alias("active")).alias("cell"))
    done = cells.where("active").join(alike.where("m > 1").select("core", "whole"), ["core", "whole"]).select("run", "near", "far")

    left = todo.groupBy("run").agg(F.collect_list("cell").alias("cells"))
    starts = stage(covers.drop("active").join(left, "run").mapInArrow(
        _starts(length, size, wide), "run long, offset int, one long, two long, active boolean"), "suffix-starts")
    drop_staged(covers)
    equal = starts.groupBy("one", "two").agg(F.count(F.lit(1)).alias("k"), F.max("active").alias("any")).where("k > 1 AND any")
    same = starts.where("active").join(equal.select("one", "two"), ["one", "two"]).select(
        "run", F.col("offset").alias("near"), F.col("offset").alias("far"))
    # all strings of a run hold its q-gram, so their union is one range
    ranges = done.unionAll(same).groupBy("run").agg(F.min("near").alias("near"), F.max("far").alias("far"))
    partial = open_.join(ranges, "run").select(
        "doc_id", "text_hash", (F.col("lo") + F.col("a") - F.col("far")).alias("lo"),
        (F.col("lo") + F.col("a") - F.col("near") + length).alias("hi"))

    every = stage(spans.unionByName(partial).groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("raw")), "suffix-spans")
    drop_staged(open_, spans, cells, alike, starts)
    return every, involved
