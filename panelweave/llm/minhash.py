"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

Two permutations of 32-bit space generate a whole signature: sigma scatters the
shingles, pi is applied circularly shifted, and coordinate k is the least
pi(sigma(s) - k) over the shingles s.  With 28 bands of 4 coordinates a pair of
similarity 0.8 shares no band with odds of 4e-7.

1. One pass makes per row the set's digest, size and band keys; no set is kept.
2. Rows with equal sets form a class, so copies are compared once.
3. In each bucket of a band every class is paired with one pivot, never with all
   others.  Pairs are confirmed on full sets, made anew from the two texts.
4. Confirmed links give components.  Buckets that still hold several components take
   part in further rounds with other pivots.
5. Classes still in such buckets are banded anew from the same signatures, in 160
   bands of 8 coordinates, which part texts that merely share a passage.  A pair of
   similarity 0.8 is missed there with odds of about 3e-6.
6. Shingles that no other class of those buckets has cannot be shared, and parities of
   the others in 256 cells count differences, so both bound the similarity of a pair from
   above, exactly.  The class with the smallest share of shingles of its own is
   its bucket's next pivot: copies with edits of their own link to the text they stem from.
7. Then every pair that lies in two components, has not been compared and could reach
   the similarity by those bounds is compared.  Pairs inside one component are left out,
   so a group of near copies never gives all its pairs.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.components import components
from panelweave.llm.text import small_batches, text_or_empty
from panelweave.sources.scratch import drop_staged, stage

BANDS, ROWS = 28, 4
GROUP_BYTES = 400_000
PIECE_BYTES = 4_000_000
PIVOT_ROUNDS = 2
LONG_BANDS, LONG_ROWS = 160, 8
WORDS = 4  # of 64 parities
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CUT = re.compile(rb"[\x20\x09-\x0d]")
_MIX = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
#: The base of the rolling sums and its inverse modulo 2**64.
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        full = np.full(max(n, GROUP_BYTES * 2), base, "u8")
        full[0] = 1
        _powers[base] = np.multiply.accumulate(full)
    return _powers[base][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit space."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word."""
    raw = np.frombuffer(data, "u1")
    inside = np.r_[False, ~_SPACE[raw], False]
    change = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = change[::2], change[1::2]
    sums = np.zeros(len(raw) + 1, "u8")
    np.cumsum((raw.astype("u8") + np.uint64(1)) * _power(_BASE, len(raw)), out=sums[1:])
    own = (sums[end] - sums[start]) * _power(_INVERSE, len(raw) + 1)[start]
    return mix64(own + (end - start).astype("u8") * _MIX[0]), start


def _pieces(text: bytes):
    at = 0
    while at < len(text):
        cut = _CUT.search(text, at + PIECE_BYTES) if len(text) - at > PIECE_BYTES else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def shingle_sets(texts: list[bytes], width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, flat and sorted in each text, and their number.

    Letters A-Z are lower-cased, words are runs of other characters than white space,
    and a text of fewer words than `width` has its whole sequence as one shingle.
    """
    lower = [t.lower() for t in texts]
    if any(len(t) > PIECE_BYTES for t in lower):
        each = [[_word_hashes(p)[0] for p in _pieces(t)] for t in lower]
        each = [np.concatenate(e) if e else np.empty(0, "u8") for e in each]
        word, n = np.concatenate(each), np.array([len(e) for e in each])
    else:
        word, start = _word_hashes(b" ".join(lower))
        bounds = np.cumsum([0, *(len(t) + 1 for t in lower)])
        n = np.diff(np.searchsorted(start, bounds))
    doc = np.repeat(np.arange(len(texts)), n)
    made = len(word) - width + 1
    full = np.zeros(max(made, 0), "u8")
    for k in range(width):
        if made > 0:
            full += word[k:k + made] * _MIX[k % 4] * np.array(2 * k + 1, "u8")
    full = mix64(full + np.full(1, width, "u8") * _MIX[4])
    whole = doc[:made] == doc[width - 1:] if made > 0 else np.zeros(0, bool)
    first = np.cumsum(n) - n
    short = np.flatnonzero((n > 0) & (n < width))
    rest = np.zeros(len(short), "u8")
    for k in range(width - 1):
        has = n[short] > k
        rest[has] += word[first[short[has]] + k] * _MIX[k % 4] * np.array(2 * k + 1, "u8")
    rest = mix64(rest + n[short].astype("u8") * _MIX[4])
    shingle, owner = np.r_[full[whole], rest], np.r_[doc[:max(made, 0)][whole], short]
    order = np.lexsort((shingle, owner))
    shingle, owner = shingle[order], owner[order]
    fresh = np.r_[True, (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])] if len(shingle) else np.zeros(0, bool)
    return shingle[fresh], np.bincount(owner[fresh], minlength=len(texts))


def _permute(x: np.ndarray, first: int, second: int) -> np.ndarray:
    """A bijection of 32-bit space, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(first)
    x ^= x >> np.uint32(13)
    x *= np.uint32(second)
    x ^= x >> np.uint32(16)
    return x


def signatures(shingle: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """One row of `length` coordinates per non-empty set."""
    sigma = _permute((shingle >> np.uint64(32)).astype("u4") ^ shingle.astype("u4"), 0x85EBCA6B, 0xC2B2AE35)
    starts = (np.cumsum(n) - n)[n > 0]
    out = np.empty((len(starts), length), "u4")
    for k in range(length):
        out[:, k] = np.minimum.reduceat(_permute(sigma - np.uint32(k), 0x7FEB352D, 0x846CA68B), starts)
    return out


def parities(shingle: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether each cell, named by the top eight bits, holds an odd number of a set's shingles; WORDS words per set."""
    cell = np.repeat(np.arange(len(n)) * 64 * WORDS, n) + (shingle >> np.uint64(56)).astype("i8")
    odd = np.bincount(cell, minlength=len(n) * 64 * WORDS).astype("u1") & 1
    return np.packbits(odd.reshape(len(n), -1), axis=1, bitorder="little").view("<i8")


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    cut = signature.reshape(len(signature), bands, rows).astype("u8")
    keys = np.arange(bands, dtype="u8") * _MIX[4]
    for k in range(rows):
        keys = mix64(keys + cut[:, :, k] * _MIX[k % 4])
    return keys


def _reband(batches):
    """Keys of the long bands; each takes other coordinates of the signature."""
    rng = np.random.default_rng(13)
    picks = np.stack([rng.permutation(BANDS * ROWS)[:LONG_ROWS] for _ in range(LONG_BANDS)])
    for batch in batches:
        column = batch.column(3)
        signature = column.flatten().to_numpy().view("u4").reshape(batch.num_rows, BANDS * ROWS)
        keys = band_keys(signature[:, picks.ravel()], LONG_BANDS, LONG_ROWS).view("i8").ravel()
        at = pa.array(np.repeat(np.arange(batch.num_rows), LONG_BANDS))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), pa.array(keys)],
            names=["node", "n", "label", "key"])


def _grouped(texts: list[bytes]):
    first = size = 0
    for k, t in enumerate(texts):
        if k > first and size + len(t) > GROUP_BYTES:
            yield texts[first:k]
            first, size = k, 0
        size += len(t)
    if first < len(texts):
        yield texts[first:]


def _sketch(width: int):
    def run(batches):
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            nodes, sizes, bands, marks, odd = [], [], [], [], []
            for group in _grouped(texts):
                shingle, n = shingle_sets(group, width)
                ends = np.cumsum(n)
                nodes += [xxhash.xxh3_128_digest(shingle[e - c:e].tobytes()) if c else None for e, c in zip(ends, n)]
                sizes.append(n)
                odd.append(parities(shingle, n))
                signature = signatures(shingle, n, BANDS * ROWS)
                keys, marked = iter(band_keys(signature).view("i8")), iter(signature.view("i4"))
                bands += [next(keys) if c else None for c in n]
                marks += [next(marked) if c else None for c in n]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nodes, pa.binary()),
                 pa.array(np.concatenate(sizes) if sizes else [], pa.int64()), pa.array(bands, pa.list_(pa.int64())),
                 pa.array(marks, pa.list_(pa.int32())),
                 pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(odd).ravel() if odd else [], pa.int64()), WORDS).cast(
                     pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "node", "n", "bands", "signature", "parity"])
    return run


def _confirm(width: int, percent: int):
    def run(batches):
        for batch in batches:
            left, right = (batch.column(k).cast(pa.binary()).to_pylist() for k in (2, 3))
            linked = []
            for at in range(0, len(left), 64):
                a, n = shingle_sets(left[at:at + 64], width)
                b, m = shingle_sets(right[at:at + 64], width)
                for end_a, size_a, end_b, size_b in zip(np.cumsum(n), n, np.cumsum(m), m):
                    both = len(np.intersect1d(a[end_a - size_a:end_a], b[end_b - size_b:end_b], assume_unique=True))
                    linked.append(bool(100 * both >= percent * (size_a + size_b - both)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())],
                                             names=["a", "b", "linked"])
    return run


def _texts(nodes: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, text: one text of each class."""
    keys = classes.join(nodes, "node").select("node", F.col("rep.doc_id").alias("id"), F.col("rep.text_hash").alias("hash"))
    found = docs.join(keys, docs["doc_id"].eqNullSafe(keys["id"]) & (F.xxhash64(docs["text"]) == keys["hash"]))
    return found.select("node", "text").dropDuplicates(["node"])


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b and one text of each class."""
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")


def _flat_sets(width: int):
    """shingle, and the two halves of the digest of the class that has it."""
    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            halves = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i8").reshape(-1, 2)
            first = 0
            for group in _grouped(texts):
                shingle, n = shingle_sets(group, width)
                owner = np.repeat(halves[first:first + len(group)], n, axis=0)
                first += len(group)
                yield pa.RecordBatch.from_arrays([pa.array(shingle.view("i8")), pa.array(owner[:, 0]), pa.array(owner[:, 1])],
                                                 names=["shingle", "one", "two"])
    return run


def _split_digest(batches):
    for batch in batches:
        halves = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(halves[:, 0]), pa.array(halves[:, 1])],
                                         names=["node", "one", "two"])


def _bounds(nodes: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """node, own, parity: how many shingles of each class no other has, and the parities of the others."""
    flat = _texts(nodes, classes, docs).mapInArrow(_flat_sets(width), "shingle long, one long, two long")
    # where the count is 1, the greatest halves are those of the only class
    alone = flat.groupBy("shingle").agg(F.count(F.lit(1)).alias("c"), F.max("one").alias("one"), F.max("two").alias("two"))
    bit = F.expr("shiftleft(1L, cast(shiftrightunsigned(shingle, 56) & 63 as int))")
    word = F.expr("shiftrightunsigned(shingle, 62)")
    own = alone.where("c = 1").groupBy("one", "two").agg(
        F.count(F.lit(1)).alias("own"),
        *(F.bit_xor(F.when(word == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"w{k}") for k in range(WORDS)))
    parts = nodes.mapInArrow(_split_digest, "node binary, one long, two long").join(own, ["one", "two"], "left")
    rest = [F.get("parity", F.lit(k)).bitwiseXOR(F.coalesce(f"w{k}", F.lit(0).cast("long"))) for k in range(WORDS)]
    return parts.join(classes.select("node", "parity"), "node").select(
        "node", F.coalesce("own", F.lit(0).cast("long")).alias("own"), F.array(*rest).alias("parity"))


def _mixed_buckets(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The rows of buckets that hold two components or more, with their labels, as a staged table."""
    rows = rows.drop("label")
    if labels is None:
        now = rows.withColumn("label", F.col("node"))
    else:
        now = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = now.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
    return stage(now.join(mixed.select("key"), "key"), "near-open")


def _pairs(rows: DataFrame, percent: int, order=None) -> DataFrame:
    """a < b: each class of a bucket with its bucket's pivot, the least in `order`; without an order all with all.

    Only classes of two components meet, and only if `own` and `parity` allow the similarity.
    """
    mark = F.struct("node", "n", "label", "own", "parity")
    mine, other = rows.select("key", mark.alias("a")), rows.select("key", mark.alias("b"))
    if order is not None:
        other = rows.groupBy("key").agg(F.min(F.struct(order.alias("h"), mark.alias("b"))).alias("p")).select("key", "p.b")
    odd = [F.coalesce(F.bit_count(F.get("a.parity", F.lit(k)).bitwiseXOR(F.get("b.parity", F.lit(k)))), F.lit(0)) for k in range(WORDS)]
    uneven = F.abs(F.col("a.n") - F.col("a.own") - F.col("b.n") + F.col("b.own"))
    # the least number of shingles that one of the two lacks
    apart = F.col("a.own") + F.col("b.own") + F.greatest(uneven, sum(odd[1:], odd[0]).cast("long"))
    size = F.col("a.n") + F.col("b.n")
    reach = (size - apart) * 100 >= (size + apart) * percent
    met = F.col("a.node") != F.col("b.node") if order is not None else F.col("a.node") < F.col("b.node")
    pairs = mine.join(other, "key").where(met & (F.col("a.label") != F.col("b.label")) & reach)
    return pairs.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept for every row of docs.

    Rows are linked where 100 * intersection >= percent * union of their sets of
    `width`-word shingles; component_id is the smallest doc_id of the component, and
    a row is kept where it bears that id.  Null and empty texts have no shingle and
    are their own component.  Null ids come after all others; a component of nulls
    only has a null id and keeps nothing.  Repeated rows are one class, and all that
    bear its smallest id are kept.  Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", text_or_empty().alias("text"))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    wide = stage(keyed.mapInArrow(
        _sketch(width), "doc_id long, text_hash long, node binary, n long, bands array<long>, signature array<int>, parity array<long>"), "near-sketch")
    rep = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    classes = stage(wide.where("node IS NOT NULL").groupBy("node").agg(
        F.min(rep).alias("rep"), F.min("n").alias("n"), F.first("bands").alias("bands"), F.first("signature").alias("signature"),
        F.first("parity").alias("parity")), "near-classes")
    sketch = stage(wide.select("doc_id", "text_hash", "node", "n"), "near-sets")
    drop_staged(wide)
    tried = links = labels = None

    def link(pairs: DataFrame) -> None:
        """Confirm pairs that have not been tried and bring the labels up to date."""
        nonlocal tried, links, labels
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stage(pairs, "near-pairs")
        if pairs.isEmpty():
            drop_staged(pairs)
            return
        needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        texts = stage(_texts(needed, classes, docs), "near-texts")
        done = stage(_with_texts(pairs, texts).mapInArrow(
            _confirm(width, percent), "a binary, b binary, linked boolean"), "near-confirmed")
        drop_staged(pairs, texts)
        tried = done.select("a", "b") if tried is None else tried.unionAll(done.select("a", "b"))
        found = done.where("linked").select("a", "b")
        links = found if links is None else links.unionAll(found)
        parts, old = components(links), labels
        labels = stage(parts, "near-labels")
        drop_staged(parts, *([] if old is None else [old]))

    def still_open(rows: DataFrame, *done: DataFrame) -> DataFrame:
        now = _mixed_buckets(rows, labels)
        drop_staged(*done)
        return now

    # a bucket of one component stays one, so only open ones go on
    rows = _mixed_buckets(classes.select("node", "n", F.explode("bands").alias("key")), labels)
    for turn in range(PIVOT_ROUNDS):
        plain = rows.withColumns({"own": F.lit(0).cast("long"), "parity": F.array().cast("array<long>")})
        link(_pairs(plain, percent, F.xxhash64("node", F.lit(turn))))
        rows = still_open(rows, rows)
    marks = classes.join(rows.select("node", "label").distinct(), "node").select("node", "n", "label", "signature")
    rows = still_open(marks.mapInArrow(_reband, "node binary, n long, label binary, key long"), rows)
    bounds = stage(_bounds(rows.select("node").distinct(), classes, docs, width), "near-bounds")
    link(_pairs(rows.join(bounds, "node"), percent, F.col("own") / F.col("n")))
    rows = still_open(rows, rows)
    link(_pairs(rows.join(bounds, "node"), percent))
    drop_staged(rows, bounds)

    plain = classes.select("node", "rep.doc_id")
    if labels is not None:
        plain = plain.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        least = plain.groupBy("label").agg(F.min("doc_id").alias("component_id"))
        plain = plain.join(least, "label").select("node", "component_id")
    else:
        plain = plain.withColumnRenamed("doc_id", "component_id")
    out = sketch.select("doc_id", "text_hash", "node", "n").join(plain, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    found = stage(out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), component.alias("component_id"),
                             F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept")), "near-found")
    drop_staged(sketch, classes, *(t for t in (tried, labels) if t is not None))
    return found
