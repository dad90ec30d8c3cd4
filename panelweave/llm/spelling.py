"""Spelling variants by permuterm rotations.

A word and a terminator, rotated to begin after an edited character, end with that character: words that
differ in it share the whole rotation but its last character, and the word without it has
that prefix as a whole rotation of its own.  So all rotations are sorted by prefix, once
whole and once without their last character, and one scan finds the groups.  A prefix names its
edit's place and both sides of it, so a group holds one word per letter and one
without: its size is bounded by the alphabet, whatever the words are.

A group yields one row per member (how many others are near, which of them is most frequent), not
one per pair; rows of a word are then added up.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.text import byte_slices, small_batches, text_or_empty
from panelweave.sources.scratch import stage

#: Not a letter of any run, and below all of them.
TERMINATOR = "$"
#: Different words counted in a task before their counts are handed on.
HELD_WORDS = 200_000


def _thin(prefix: int, run: str, drop: int | None) -> str:
    """The run, without one code point where drop divides the checksum that the prefix's goes on to."""
    if drop is None:
        return run
    h = zlib.crc32(run.encode("utf-8"), prefix)
    if h % drop:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def _count(least: int, drop: int | None):
    # a shorter run stays shorter, so only maximal runs of the least length count
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % least)

    def batch_of(held: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    def run(batches):
        held: dict[str, int] = {}
        for batch in batches:
            for part in byte_slices(batch, 1):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    own: dict[str, int] = {}
                    # lowering bytes changes A to Z alone
                    for found in runs.findall(text.encode("utf-8").lower().decode("utf-8")):
                        own[found] = own.get(found, 0) + 1
                    prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for found, n in own.items():
                        word = _thin(prefix, found, drop)
                        if len(word) >= least:
                            held[word] = held.get(word, 0) + n
                    if len(held) >= HELD_WORDS:
                        yield batch_of(held)
                        held = {}
        if held:
            yield batch_of(held)
    return run


def word_counts(docs: DataFrame, least: int = 7, least_n: int = 2, drop: int | None = None) -> DataFrame:
    """word, n: runs of Latin letters of whole texts, A-Z lowered, of at least so many code points and occurrences.

    With `drop`, runs of a document lose one code point where drop divides crc32 of `<doc_id>:<run>`
    (a null id: nothing before the colon); that plants variants whose origin is known.  Null and
    empty texts have no words; repeated rows count again.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("string").alias("doc_id"), text_or_empty().alias("text"))
    counted = rows.mapInArrow(_count(least, drop), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def rotations(words: DataFrame) -> DataFrame:
    """prefix, letter, n: every rotation of the marked words, whole (letter is empty) and without its last letter."""
    after = lambda skip: F.expr(f"concat(substring(word, i + {1 + skip}), '{TERMINATOR}', substring(word, 1, i))")
    placed = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.char_length("word"))).alias("i"))
    # after the last letter comes the terminator, which no edit touches
    letter = F.expr("if(i < char_length(word), substring(word, i + 1, 1), NULL)")
    both = placed.select("n", F.stack(F.lit(2), after(0), F.lit(""), after(1), letter).alias("prefix", "letter"))
    return both.where("letter IS NOT NULL").select("prefix", "letter", "n")


def _word(prefix: str, letter: str) -> str:
    tail, _, head = prefix.partition(TERMINATOR)
    return head + letter + tail


def _emit(prefix: str, letters: list[str], counts: list[int], out: list[tuple[str, int, int, str]]) -> None:
    """One row per member of a group: word, how many are near it here, and the first of them by count and word."""
    rows = [(-n, _word(prefix, letter), letter) for letter, n in zip(letters, counts)]
    whole = rows.pop(0) if letters[0] == "" else None
    rows.sort()
    for k, (_, word, letter) in enumerate(rows):
        # of equal letters in a row only the first one counts as left out, so that a pair of words meets once
        joined = whole is not None and letter != prefix[-1]
        near = len(rows) - 1 + joined
        if near:
            best = rows[1 if k == 0 else 0] if len(rows) > 1 else None
            if joined and (best is None or whole < best):
                best = whole
            out.append((word, near, -best[0], best[1]))
    if whole is not None:
        own = [r for r in rows if r[2] != prefix[-1]]
        if own:
            out.append((whole[1], len(own), -own[0][0], own[0][1]))


def _scan(batches):
    """Groups of equal prefixes in sorted rows; the last one of a batch waits for the next."""
    held = None
    fields = ["word", "near", "best_n", "best"]

    def groups(table: pa.Table, cuts: np.ndarray):
        size = np.diff(cuts)
        many = np.flatnonzero(size > 1)
        if not len(many):
            return None
        rows = np.repeat(size > 1, size)
        kept = table.filter(pa.array(rows))
        prefix, letter, n = (kept.column(c).to_pylist() for c in ("prefix", "letter", "n"))
        out: list[tuple[str, int, int, str]] = []
        at = 0
        for k in size[many].tolist():
            _emit(prefix[at], letter[at:at + k], n[at:at + k], out)
            at += k
        if not out:
            return None
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=fields)

    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        if not table.num_rows:
            continue
        prefix = table.column("prefix").combine_chunks()
        turn = pc.not_equal(prefix[1:], prefix[:-1]).to_numpy(zero_copy_only=False)
        cuts = np.r_[0, np.flatnonzero(turn) + 1]
        held = table.slice(cuts[-1])
        if len(cuts) > 1:
            made = groups(table.slice(0, cuts[-1]), cuts)
            if made is not None:
                yield made
    if held is not None and held.num_rows:
        made = groups(held, np.array([0, held.num_rows]))
        if made is not None:
            yield made


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best, best_n for every word that another one differs from by one code point."""
    laid = rotations(words)
    laid = laid.repartition("prefix").sortWithinPartitions("prefix", "letter")
    found = laid.mapInArrow(_scan, "word string, near long, best_n long, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), first.alias("first")).select(
        "word", "n_near", F.col("first.w").alias("best"), (-F.col("first.m")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the chain word -> form -> ... of a table of (word, form) ends.

    The chains must be free of circles.  Each round doubles the steps a word has gone.
    """
    gone = stage(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not gone.where("moved").isEmpty():
        ahead = gone.select(F.col("word").alias("root"), F.col("root").alias("further"))
        gone = stage(gone.join(ahead, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
    return gone.select("word", "root")


def group_variants(words: DataFrame, ratio: int | Column = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n for a table of different words with their counts (word, n).

    Two words are near if one code point inserted, deleted or replaced makes one of the other.  A word's form
    is its most frequent near word (ties: the smallest), if that is at least `ratio` (above 1) times as frequent;
    its root is where forms lead.  Words must not hold the terminator.  An empty table gives an empty one.
    """
    words = stage(words.select("word", "n"), "words")
    near = near_words(words)
    joined = words.join(near, "word", "left").withColumn("formed", F.col("best_n") >= F.col("n") * F.lit(ratio))
    joined = stage(joined.select(
        "word", F.when(F.col("formed"), F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("formed"), F.col("best_n")).alias("form_n")), "forms")
    led = roots(joined.where("form IS NOT NULL"))
    return joined.join(led, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
