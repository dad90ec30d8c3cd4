"""Quality rules as a short-circuit cascade, ordered by rejection per cost.

Every rule is a Spark column, so the whole cascade is one projection without
shuffle and without Python.  `estimate` measures each rule on a small sample: the
share of rows it rejects and the time it takes.  `ordered` sorts by rejection per
cost, and `cascade` evaluates the rules in that order inside one CASE, which stops
at the first rule that rejects.  The order never changes which rows are kept.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.text import let, text_or_empty, words

WINDOW = 8
SYMBOLS = r"[^#*$%&|<>]+"


def _n_symbols(text: Column, _: Column) -> Column:
    return F.char_length(F.regexp_replace(text, SYMBOLS, "")).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def _n_lines(text: Column, _: Column) -> Column:
    return F.size(_lines(text)).cast("long")


def _n_dup_lines(text: Column, _: Column) -> Column:
    return let(_lines(text), lambda lines: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))


def _windows(array: Column) -> Column:
    """A 64-bit hash of every run of WINDOW words."""
    def over(hashed: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(hashed) - WINDOW)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(hashed, i + k) for k in range(WINDOW)]))
    return let(F.transform(array, lambda word: F.xxhash64(word)), over)


def _covered(windows: Column) -> Column:
    """Words in windows that occur twice or more.

    Sorted by (hash, start), equal windows are neighbours; their starts, sorted
    again, add WINDOW words each, less where two of them overlap.
    """
    def twice(pairs: Column) -> Column:
        return F.filter(
            F.transform(pairs, lambda x, k: F.when(
                (x["h"] == F.get(pairs, k - 1)["h"]) | (x["h"] == F.get(pairs, k + 1)["h"]), x["i"])),
            lambda i: i.isNotNull())

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        F.sort_array(let(pairs, twice)), start,
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")),
        lambda acc: acc["n"])


def _n_repeat_words(_: Column, array: Column) -> Column:
    # most texts repeat nothing: the count of distinct hashes settles them
    def count(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")) \
            .otherwise(_covered(windows))
    return F.when(F.size(array) <= WINDOW, F.lit(0).cast("long")).otherwise(let(_windows(array), count))


def _n_stutter(_: Column, array: Column) -> Column:
    return let(array, lambda bound: F.size(F.filter(bound, lambda x, i: x == F.get(bound, i - 1))).cast("long"))


#: What rules measure: functions of the text and its words.
MEASURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda text, array: F.size(array).cast("long"),
    "word_chars": lambda text, array: F.char_length(F.array_join(array, "")).cast("long"),
    "n_symbols": _n_symbols,
    "n_lines": _n_lines,
    "n_dup_lines": _n_dup_lines,
    "n_repeat_words": _n_repeat_words,
    "n_stutter": _n_stutter,
    "n_upper": lambda text, array: F.char_length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long"),
}


@dataclass(frozen=True)
class Rule:
    """A row is rejected where `rejects`, a function of the measures in `uses`, is true."""

    name: str
    uses: tuple[str, ...]
    rejects: Callable[..., Column]


#: Rules of the base, with the thresholds of the contract.
BASE = (
    Rule("few_words", ("n_words",), lambda n: n < 20),
    Rule("repeated_windows", ("n_repeat_words", "n_words"), lambda r, n: r * 100 > n * 30),
)

#: The production rules.
RULES = BASE + (
    Rule("symbols", ("n_symbols", "n_words"), lambda s, n: s * 10 > n),
    Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda d, n: d * 100 > n * 40),
    Rule("stutter", ("n_stutter", "n_words"), lambda s, n: s * 100 > n * 30),
    Rule("long_words", ("word_chars", "n_words"), lambda c, n: c > n * 14),
    Rule("short_words", ("word_chars", "n_words"), lambda c, n: c < n * 2),
    Rule("shouting", ("n_upper", "word_chars"), lambda u, c: u * 10 > c * 4),
)


@dataclass(frozen=True)
class Estimate:
    """What a rule does on the sample: seconds per row beyond reading it, share of rows rejected."""

    rule: Rule
    cost: float
    rejection: float


def _rejects(rule: Rule, measured: dict[str, Column]) -> Column:
    return F.coalesce(rule.rejects(*[measured[m] for m in rule.uses]), F.lit(False))


def _expressions(text: Column, array: Column) -> dict[str, Column]:
    return {name: measure(text, array) for name, measure in MEASURES.items()}


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = 400, rounds: int = 2) -> list[Estimate]:
    """Cost and rejection of each rule on the first `rows` rows.

    take() reads as few partitions as hold so many rows, and only the verdicts
    leave the executors.  The sample may be lopsided; that can make the order
    slower and never the result wrong.  The least of `rounds` times counts.
    """
    text = text_or_empty()
    measured = _expressions(text, words(text))

    def timed(column: Column) -> tuple[float, list]:
        best, got = float("inf"), []
        for _ in range(rounds):
            began = time.perf_counter()
            got = docs.select(column.alias("x")).take(rows)
            best = min(best, time.perf_counter() - began)
        return best, got

    timed(F.octet_length(text))
    base, _ = timed(F.octet_length(text))
    found = []
    for rule in rules:
        took, got = timed(_rejects(rule, measured))
        n = max(1, len(got))
        found.append(Estimate(rule, max(took - base, 1e-4) / n, sum(r["x"] for r in got) / n))
    return found


def ordered(estimates: list[Estimate]) -> list[Rule]:
    """Most rejection per cost first; among rules that reject nothing the cheapest first."""
    return [e.rule for e in sorted(estimates, key=lambda e: (-e.rejection / e.cost, e.cost))]


def verdict(rules: list[Rule], measured: dict[str, Column]) -> Column:
    """The name of the first rule that rejects, null for a row that passes; later rules are then not evaluated."""
    cascade = None
    for rule in rules:
        hit = _rejects(rule, measured)
        cascade = F.when(hit, rule.name) if cascade is None else cascade.when(hit, rule.name)
    return cascade if cascade is not None else F.lit(None).cast("string")


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, order: list[Rule] | None = None,
            keep_measures: bool | tuple[str, ...] = False) -> DataFrame:
    """docs with `kept` and `rejected_by` (the first rule that rejects in the order used).

    Null texts count as empty ones.  `keep_measures` (True: all) are computed first and returned; each
    other one only where the row gets as far as a rule that asks for it.  A text is split into words once.
    Columns of docs that bear one of the added names are replaced.
    """
    order = ordered(estimate(docs, rules)) if order is None else order
    kept = tuple(MEASURES) if keep_measures is True else tuple(keep_measures or ())
    added = ["kept", "rejected_by", *kept]
    own = [c for c in docs.columns if c.lower() not in added]
    split = docs.select(*own, text_or_empty().alias("__text"))

    def judged(array: Column) -> Column:
        """Kept measures, then the verdict that uses them; inside the lambda the words are bound."""
        measured = _expressions(F.col("__text"), array)
        if not kept:
            return verdict(order, measured)
        first = F.struct(*[measured[m].alias(m) for m in kept])
        return let(first, lambda have: F.struct(
            *[have[m].alias(m) for m in kept], verdict(order, measured | {m: have[m] for m in kept}).alias("rejected_by")))

    result = let(words(F.col("__text")), judged)
    if not kept:
        out = split.withColumn("rejected_by", result)
    else:
        out = split.select(*own, result.alias("__result")).select(*own, "__result.*")
    return out.select(*own, *kept, "rejected_by", F.col("rejected_by").isNull().alias("kept"))
