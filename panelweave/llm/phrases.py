"""Collocations: phrases whose words follow each other far more often than by chance.

Texts become blocks of word numbers, cut at marks.  A phrase that is frequent has frequent parts, so
phrases grow one word a round: a block offers those whose two shorter parts are frequent, packed into a counting
quotient filter (`quotient`); segments of all blocks' filters meet in one group and are
merged, and every block learns which of its entries are frequent.  The permutation
spreads phrases evenly over segments, so no word, phrase or language makes a group large, and only
counts of different phrases of a block are sent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelweave.llm import quotient
from panelweave.llm.text import byte_slices, small_batches, text_or_empty
from panelweave.sources.scratch import stage

#: Tokens of a block, and of a merged segment (about).
BLOCK, SEGMENT = 1 << 21, 1 << 20
#: A to Z lowered, marks that end a piece as line ends, tabs as blanks; on bytes, so nothing else changes.
BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")


def _squeeze(values: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed, after their count."""
    planes = np.ascontiguousarray(values.view("u1").reshape(len(values), -1).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _stretch(data: bytes, kind: str) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], size, codec="zstd", asbytes=True) if size else b"", "u1")
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).reshape(-1).view(kind)


class _Words(dict):
    """word -> number in order of appearance; 0 stands for nothing, 1 for the end of a piece."""

    def __init__(self):
        super().__init__({"": 0, "\n": 1})

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class _Block:
    def __init__(self):
        self.words, self.parts, self.size = _Words(), [], 0

    def add(self, text: str) -> None:
        plain = text.encode("utf-8").translate(BYTES).decode("utf-8").replace("\n", " \n ")
        numbers = np.fromiter(map(self.words.__getitem__, plain.split(" ")), "i4")
        numbers = numbers[numbers > 0]
        self.parts += [numbers, np.ones(1, "i4")]
        self.size += len(numbers) + 1

    def row(self, block: int, lang: str) -> dict:
        stream = np.concatenate(self.parts)
        counts = np.bincount(stream, minlength=len(self.words))[2:]
        # numbers from 1, 0 for the end of a piece
        return {"block": block, "lang": lang, "words": list(self.words)[2:], "counts": counts.tolist(),
                "stream": _squeeze((np.maximum(stream, 1) - 1).astype("<u4"))}


BLOCKS = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.string())),
                    ("counts", pa.list_(pa.int64())), ("stream", pa.binary())])


def _blocks(batches):
    held: dict[str, _Block] = {}
    made, task = 0, TaskContext.get().partitionId() << 32

    def give(langs):
        nonlocal made
        rows = []
        for lang in langs:
            rows.append(held.pop(lang).row(task + made, lang))
            made += 1
        return pa.RecordBatch.from_pylist(rows, BLOCKS)

    for batch in batches:
        for part in byte_slices(batch, 1):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                block = held.setdefault(lang, _Block())
                block.add(text)
                if block.size >= BLOCK:
                    yield give([lang])
            if len(held) > 4 and sum(b.size for b in held.values()) >= 2 * BLOCK:
                yield give(list(held))
    for lang in list(held):
        yield give([lang])


STATE = "block long, ids binary, alive binary, segment long, bits int, runs binary, remainders binary, small binary, large binary"
_STATE = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("alive", pa.binary()), ("segment", pa.int64()), ("bits", pa.int32()),
                    ("runs", pa.binary()), ("remainders", pa.binary()), ("small", pa.binary()), ("large", pa.binary())])


def _offered(ids: np.ndarray, alive: np.ndarray, layout: quotient.Layout):
    """Starts of the n-grams whose two parts are alive, what sorts them, where different ones start, and those."""
    at = np.flatnonzero(alive[:-1] & alive[1:]) if layout.n > 1 else np.flatnonzero(alive)
    limbs = layout.pack([ids[at + k] for k in range(layout.n)])
    return at, *quotient.distinct(limbs, layout)


def _state(block: int, ids: np.ndarray, alive: np.ndarray, layout: quotient.Layout, lead: int) -> pa.Table:
    """A block's row and the filters of what it offers; nothing where it offers nothing."""
    at, by, starts, found = _offered(ids, alive, layout)
    if not len(at):
        return _STATE.empty_table()
    counts = np.diff(np.r_[starts, len(by)])
    rows = [{"block": block, "ids": _squeeze(ids.astype("<u4")), "alive": _squeeze(np.packbits(alive))}]
    for segment, part in quotient.segments(found, counts, layout, lead):
        rows.append({"block": block, "segment": segment, "bits": part.bits, "runs": part.runs, "remainders": part.remainders,
                     "small": part.small, "large": part.large})
    return pa.Table.from_pylist(rows, _STATE)


def _first(bits: int, lead: int):
    """Local numbers to ids of frequent words, 0 for the others and the ends of pieces; pairs offered."""
    layout = quotient.Layout(2, bits)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _STATE.empty_table()
        stream = _stretch(left.column("stream")[0].as_py(), "<u4")
        local = right.column("local").to_numpy()
        to = np.zeros(int(max(stream.max(initial=0), local.max())) + 1, "u4")
        to[local] = right.column("id").to_numpy()
        ids = to[stream]
        # words without a neighbour are in no phrase; one 0 between runs is enough, and the last place holds one
        known = np.r_[False, ids > 0, False]
        ids = np.where(known[1:-1] & (known[:-2] | known[2:]), ids, 0)
        ids = np.r_[ids[(ids > 0) | np.r_[ids[1:] > 0, False]], np.zeros(1, "u4")]
        return _state(left.column("block")[0].as_py(), ids, ids > 0, layout, lead)
    return run


def _grow(n: int, bits: int, lead: int):
    """Marks of the frequent n-grams of a block taken in; n-grams one word longer offered."""
    layout, longer = quotient.Layout(n, bits), quotient.Layout(n + 1, bits)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _STATE.empty_table()
        ids = _stretch(left.column("ids")[0].as_py(), "<u4")
        alive = np.unpackbits(_stretch(left.column("alive")[0].as_py(), "u1"), count=len(ids)).astype(bool)
        at, by, starts, found = _offered(ids, alive, layout)
        segment = layout.leading(found, lead)
        frequent = np.zeros(len(starts), bool)
        for k, mask in zip(right.column("segment").to_pylist(), right.column("mask").to_pylist()):
            a, b = np.searchsorted(segment, [k, k + 1])
            frequent[a:b] = np.unpackbits(np.frombuffer(mask, "u1"), count=b - a)
        alive = np.zeros(len(ids), bool)
        alive[at[by]] = np.repeat(frequent, np.diff(np.r_[starts, len(by)]))
        # places inside a frequent n-gram stay, with one 0 after each run of them
        reach = np.cumsum(alive)
        inside = (reach - np.r_[np.zeros(n, "i8"), reach[:-n]]) > 0 if len(ids) > n else reach > 0
        keep = inside | np.r_[False, inside[:-1]]
        ids = np.where(inside, ids, 0)[keep]
        return _state(left.column("block")[0].as_py(), ids, alive[keep], longer, lead)
    return run


MERGED = "block long, segment long, mask binary, words array<int>, f long"
_MERGED = pa.schema([("block", pa.int64()), ("segment", pa.int64()), ("mask", pa.binary()), ("words", pa.list_(pa.int32())), ("f", pa.int64())])


def _merge(n: int, bits: int, lead: int, least: int):
    layout = quotient.Layout(n, bits)

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        segment = rows[0]["segment"]
        filters = [quotient.Filter(r["bits"], r["runs"], r["remainders"], r["small"], r["large"]) for r in rows]
        found, sums, held = quotient.merge(filters, layout, segment, lead)
        frequent = sums >= least
        if not frequent.any():
            return _MERGED.empty_table()
        words = np.stack(layout.unpack([x[frequent] for x in found]), axis=1).astype("i4")
        grams = pa.table([pa.nulls(len(words), pa.int64()), pa.nulls(len(words), pa.int64()), pa.nulls(len(words), pa.binary()),
                          pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype="i4") * n), pa.array(words.reshape(-1))),
                          pa.array(sums[frequent])], schema=_MERGED)
        masks = [{"block": r["block"], "segment": segment, "mask": np.packbits(frequent[own]).tobytes()}
                 for r, own in zip(rows, held) if frequent[own].any()]
        return pa.concat_tables([grams, pa.Table.from_pylist(masks, _MERGED)])
    return run


def _numbered(words: DataFrame) -> tuple[DataFrame, int]:
    """words with id, gapless from 1, and their number; the driver holds one count per written partition."""
    placed = stage(words.withColumn("place", F.monotonically_increasing_id()), "frequent-words")
    part = F.shiftright("place", 33)
    counts = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    ends = np.cumsum([n for _, n in counts])
    before = [(p, int(e - n)) for (p, n), e in zip(counts, ends)]
    offsets = placed.sparkSession.createDataFrame(before, "part long, before long")
    numbered = placed.withColumn("part", part).join(offsets, "part").withColumn(
        "id", (F.col("before") + F.col("place") - F.shiftleft("part", 33) + 1).cast("int")).drop("part", "before", "place")
    return stage(numbered, "word-ids"), int(ends[-1]) if len(ends) else 0


def count_phrases(docs: DataFrame, longest: int = 5, least: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, grams, totals) of whole texts per lang (null: `und`).

    words: lang, word, f, id for the words with f >= least.  grams: words (array of ids), f for phrases of 2 to
    `longest` of them inside pieces with f >= least, overlaps included.  totals: lang, n, all word occurrences.
    Ids are the same in no other call.  Fewer than 2**31 words may be frequent.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce(docs["lang"], F.lit("und")).alias("lang"), text_or_empty().alias("text"))
    blocks = stage(rows.mapInArrow(_blocks, "block long, lang string, words array<string>, counts array<long>, stream binary"), "blocks")
    totals = stage(blocks.groupBy("lang").agg(F.sum(F.expr("aggregate(counts, 0L, (a, c) -> a + c)")).alias("n")), "totals")
    # a block's words travel once: their sums are taken where they meet; a word has one row per block
    each = blocks.select("lang", "block", F.posexplode(F.arrays_zip("words", "counts")).alias("local", "w"))
    each = each.select("lang", F.col("w.words").alias("word"), "block", (F.col("local") + 1).alias("local"), F.col("w.counts").alias("c"))
    each = each.withColumn("f", F.sum("c").over(Window.partitionBy("lang", "word"))).where(F.col("f") >= least)
    each = stage(each.drop("c"), "frequent")
    words, size = _numbered(each.select("lang", "word", "f").distinct())
    bits = max(size.bit_length(), 1)
    tokens = totals.agg(F.sum("n")).first()[0] or 0
    lead = min(max(int(tokens // SEGMENT).bit_length(), 0), quotient.Layout(2, bits).most_leading() - 1)

    known = each.join(words.select("lang", "word", "id"), ["lang", "word"]).select(F.col("block").alias("of"), "local", "id")
    state = blocks.select("block", "stream").groupBy("block").cogroup(known.groupBy("of")).applyInArrow(_first(bits, lead), STATE)
    grams = None
    for n in range(2, longest + 1):
        state = stage(state, f"phrases-{n}")
        merged = state.where("segment IS NOT NULL").drop("ids", "alive").groupBy("segment").applyInArrow(_merge(n, bits, lead, least), MERGED)
        merged = stage(merged, f"merged-{n}")
        found = merged.where("f IS NOT NULL").select("words", "f")
        grams = found if grams is None else grams.unionAll(found)
        marks = merged.where("mask IS NOT NULL").select("block", "segment", "mask")
        state = state.where("ids IS NOT NULL").select("block", "ids", "alive").groupBy("block").cogroup(
            marks.groupBy("block")).applyInArrow(_grow(n, bits, lead), STATE)
    return words, grams, totals


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best `top` phrases of each lang.

    A phrase of a occurrences among n words, cut into parts of l and r occurrences, scores floor(1000 a n / (l r)), exactly,
    for counts up to 10**15; its lowest cut counts (ties: the shortest first part).  A phrase that a longer
    one of the same count holds is left out.  Order: score, then a, descending, then the phrase's bytes.
    Null and empty texts have no words; repeated rows count again; no words at all give an empty table.
    """
    words, grams, totals = count_phrases(docs, longest, least)
    inner = F.explode(F.array(F.expr("slice(words, 1, size(words) - 1)"), F.expr("slice(words, 2, size(words) - 1)")))
    # a longer phrase of the same count has one of that count in between at every length
    held = grams.where("size(words) > 2").select(inner.alias("words"), "f")
    kept = grams.join(held, ["words", "f"], "left_anti")
    named = kept.select("words", "f", F.posexplode("words").alias("k", "id")).join(words.select("id", "lang", "word"), "id")
    named = named.groupBy("words", "f").agg(
        F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("k", "word"))).alias("w")).select(
        "lang", "words", F.col("f").alias("a"), F.array_join(F.col("w.word"), " ").alias("phrase"))
    parts = stage(grams.unionAll(words.select(F.array("id").alias("words"), "f")), "parts")
    cuts = named.select("*", F.explode(F.expr("sequence(1, size(words) - 1)")).alias("k")).select(
        "*", F.expr("slice(words, 1, k)").alias("head"), F.expr("slice(words, k + 1, size(words) - k)").alias("tail"))
    cuts = cuts.join(parts.select(F.col("words").alias("head"), F.col("f").alias("l")), "head")
    cuts = cuts.join(parts.select(F.col("words").alias("tail"), F.col("f").alias("r")), "tail").join(totals, "lang")
    score = F.expr("(CAST(a AS DECIMAL(19,0)) * CAST(1000 * n AS DECIMAL(18,0))) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(18,0)))")
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    ranked = best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score").withColumn("rank", F.row_number().over(
        Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
