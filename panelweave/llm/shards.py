"""Sharding by histogram sort.

Rows get a 128-bit sort key: a hash of the text, then a hash of doc_id, then a hash
of the row.  Copies are neighbours in that order, yet no key is indivisible: a hot
text is split by doc_id and repeated rows by their row hash.

1. The rows and their keys are written once to the shared folder.
2. The driver sends candidate boundaries (probes).  Every partition counts the
   exact bytes and rows between them, and the sums come back, as many numbers as
   probes.  Intervals that hold a boundary and miss the tolerance get new probes:
   evenly spaced ones and a key from the middle of their bytes.
3. When all boundaries meet the tolerance, the rows are exchanged once, by
   sub-range.  A slot is the exact count of rows in front of the sub-range, known
   from step 2, plus the rank inside it.

No task sorts more than a sub-range (a shard has `parts` of them), and the driver
holds shards x parts boundaries whatever the data.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.sources.scratch import stage

SPACE = 1 << 128
FIRST_PROBES = 8192
FAN = 16
MOST_ROUNDS = 80


def _flat(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Signed pairs as 16 bytes in the order of the unsigned 128-bit key."""
    out = np.empty((len(hi), 2), ">u8")
    out[:, 0], out[:, 1] = hi.view("u8"), lo.view("u8")
    return out.view("S16").ravel()


def _as_bytes(keys: list[int]) -> np.ndarray:
    return np.array([k.to_bytes(16, "big") for k in keys], "S16")


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _counter(probes: list[int], wanted: set[int]):
    """Sums per interval in one partition; for wanted intervals also the key in the middle of the bytes."""
    cuts = _as_bytes(probes)

    def count(batches):
        size, rows = np.zeros(len(cuts) + 1, "i8"), np.zeros(len(cuts) + 1, "i8")
        middle: dict[int, tuple[int, bytes]] = {}
        for batch in batches:
            keys, own = _flat(_column(batch, "k_hi"), _column(batch, "k_lo")), _column(batch, "size")
            at = np.searchsorted(cuts, keys, side="right")
            np.add.at(size, at, own)
            rows += np.bincount(at, minlength=len(rows))
            order = np.lexsort((keys, at))
            inside, starts = np.unique(at[order], return_index=True)
            for b, first, last in zip(inside.tolist(), starts, [*starts[1:], len(order)]):
                if b in wanted:
                    run = order[first:last]
                    cum = np.cumsum(own[run])
                    pick = run[np.searchsorted(cum, cum[-1] / 2)]
                    if cum[-1] > middle.get(b, (-1, b""))[0]:
                        middle[b] = (int(cum[-1]), bytes(keys[pick]).ljust(16, b"\0"))
        full = np.flatnonzero(rows)
        yield pa.RecordBatch.from_pydict({
            "b": pa.array(full, pa.int32()), "size": pa.array(size[full], pa.int64()),
            "rows": pa.array(rows[full], pa.int64()),
            "weight": pa.array([middle.get(b, (0, b""))[0] for b in full.tolist()], pa.int64()),
            "middle": pa.array([middle.get(b, (0, b""))[1] for b in full.tolist()], pa.binary())})
    return count


def _histogram(keys: DataFrame, probes: list[int], wanted: set[int]) -> dict[int, tuple[int, int, bytes]]:
    parts = keys.mapInArrow(_counter(probes, wanted), "b int, size long, rows long, weight long, middle binary")
    sums = parts.groupBy("b").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows"),
                                  F.max_by("middle", F.struct("weight", "middle")).alias("middle"))
    return {r["b"]: (r["size"], r["rows"], bytes(r["middle"] or b"")) for r in sums.collect()}


def splitters(keys: DataFrame, shards: int, parts: int, tolerance: float) -> list[tuple[int, int, int]]:
    """(key, bytes below, rows below) of the shards x parts - 1 inner boundaries.

    Boundaries between shards come within `tolerance` of a shard's bytes of the
    equal share, those inside a shard within a quarter of a part; where a single row
    is larger than that, to the nearer side of it.
    """
    known: dict[int, tuple[int, int]] = {0: (0, 0)}
    probes = [SPACE * k // FIRST_PROBES for k in range(1, FIRST_PROBES)]
    middles: dict[int, bytes] = {}
    total = 0
    for _ in range(MOST_ROUNDS):
        edges = [0, *probes, SPACE]
        found = _histogram(keys, probes, {b for b in range(len(edges) - 1)} if len(middles) == 0 else set(range(len(edges))))
        size = rows = 0
        for b, edge in enumerate(edges[:-1]):
            known[edge] = (size, rows)
            s, n, middle = found.get(b, (0, 0, b""))
            if middle:
                middles[edge] = middle
            size, rows = size + s, rows + n
        total = size
        known[SPACE] = (size, rows)
        order = sorted(known)
        below = [known[k][0] for k in order]
        chosen, fresh = [], set()
        for j in range(1, shards * parts):
            want = total * j / (shards * parts)
            slack = tolerance * total / shards if j % parts == 0 else 0.25 * total / (shards * parts)
            at = min(bisect_left(below, want), len(order) - 1)
            left, right = order[max(at - 1, 0)], order[at]
            near = min((left, right), key=lambda k: abs(known[k][0] - want))
            chosen.append(near)
            if abs(known[near][0] - want) <= slack or known[right][1] - known[left][1] <= 1 or right - left <= 1:
                continue
            fresh.update(left + (right - left) * k // FAN for k in range(1, FAN))
            if left in middles:
                mid = int.from_bytes(middles[left], "big")
                text = mid >> 64 << 64
                fresh.update(k for k in (mid, mid + 1, text, text + (1 << 64)) if left < k < right)
        fresh -= set(order)
        if not fresh:
            break
        probes = sorted({k for k in order if 0 < k < SPACE} & set(chosen) | fresh)
    return [(k, *known[k]) for k in chosen]


def _assigner(cuts: list[tuple[int, int, int]], shards: int, parts: int, schema: pa.Schema):
    keys = _as_bytes([c[0] for c in cuts])
    rows = np.array([0, *(c[2] for c in cuts)], "i8")
    base = rows - np.repeat(rows[::parts], parts)

    def assign(batches):
        for batch in batches:
            sub = np.searchsorted(keys, _flat(_column(batch, "k_hi"), _column(batch, "k_lo")), side="right")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sub.astype("i4")), pa.array((sub // parts).astype("i4")), pa.array(base[sub])],
                names=[*batch.schema.names, "sub", "shard", "base"])
    return assign


def shard_rows(rows: DataFrame, shards: int = 40, parts: int = 50, tolerance: float = 0.002) -> DataFrame:
    """rows with `shard` (sizes near equal) and `slot` (gapless from 0 in each shard, in key order).

    rows: doc_id, size (bytes, not null), text_hash (long; 0 for null); other columns
    pass through, those named k_hi, k_lo, sub, shard, base or slot are replaced.  Null
    ids are one more value of doc_id.  With fewer rows than shards some shards are
    empty; an empty table gives an empty result.
    """
    own = [c for c in rows.columns if c.lower() not in ("k_hi", "k_lo", "sub", "shard", "base", "slot")]
    salt = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 32)
    low = F.shiftleft(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.col("doc_id").isNull()), 32).bitwiseOR(salt)
    keyed = stage(rows.select(*own, F.coalesce("text_hash", F.lit(0)).alias("k_hi"), low.alias("k_lo")), "shard-keys")
    cuts = splitters(keyed.select("k_hi", "k_lo", "size"), shards, parts, tolerance)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in keyed.schema)}, sub int, shard int, base long"
    placed = keyed.mapInArrow(_assigner(cuts, shards, parts, None), schema)
    # unsigned order of the two halves
    flip = lambda c: F.col(c).bitwiseXOR(F.lit(-(1 << 63)))
    rank = F.row_number().over(Window.partitionBy("sub").orderBy(flip("k_hi"), flip("k_lo"), "doc_id"))
    return placed.select(*own, "shard", (F.col("base") + rank - 1).cast("long").alias("slot"))
