"""Two series of moments laid side by side: drift to the nearest, and pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Seconds from which on a boundary counts as moved, and within which two frames can be a pair.
MOVED_S, PAIR_S = 0.3, 5.0


def nearest(a: DataFrame, b: DataFrame, key: str, at: str) -> DataFrame:
    """``a`` with ``delta``: the distance to the nearest moment of ``b`` with the same key; null where there is none.

    Both series are put in one order, and the last moment of ``b`` before and the first
    after each row are carried along it, once in each direction: an as-of join
    without a range to search.
    """
    both = a.withColumn("__b", F.lit(None).cast("double")).unionByName(b.select(key, F.col(at), F.col(at).cast("double").alias("__b")), allowMissingColumns=True)
    # Of equal moments those of b come first in either direction, so that they are seen.
    forth = W.partitionBy(key).orderBy(F.asc(at), F.desc_nulls_last("__b")).rowsBetween(W.unboundedPreceding, 0)
    back = W.partitionBy(key).orderBy(F.desc(at), F.desc_nulls_last("__b")).rowsBetween(W.unboundedPreceding, 0)
    seen = both.withColumns({"__lo": F.last("__b", ignorenulls=True).over(forth), "__hi": F.last("__b", ignorenulls=True).over(back)})
    delta = F.least(F.col(at) - F.col("__lo"), F.col("__hi") - F.col(at))  # nulls are skipped
    return seen.where("__b IS NULL").withColumn("delta", delta).select(*a.columns, "delta")


def drift(a: DataFrame, b: DataFrame, key: str, at: str) -> DataFrame:
    """(key, count_a, count_b, mean_s, max_s, reverse_max_s, moved, worst_s) for each key of either series.

    ``worst_s`` is the earliest moment of ``a`` that is farthest off. Without moments on both
    sides there are counts and nulls.
    """
    forth = nearest(a.select(key, at), b.select(key, at), key, at).groupBy(key).agg(
        F.count("*").alias("count_a"),
        F.round(F.avg("delta"), 4).alias("mean_s"),
        F.round(F.max("delta"), 4).alias("max_s"),
        F.count_if(F.col("delta") > MOVED_S).alias("moved"),
        F.round(F.max_by(at, F.struct("delta", -F.col(at))), 3).alias("worst_s"),
    )
    back = nearest(b.select(key, at), a.select(key, at), key, at).groupBy(key).agg(F.count("*").alias("count_b"), F.round(F.max("delta"), 4).alias("reverse_max_s"))
    met = forth.join(back, key, "full")
    both = F.col("count_a").isNotNull() & F.col("count_b").isNotNull()
    only = lambda c: F.when(both, F.col(c)).alias(c)
    none = F.lit(0).cast("long")
    return met.select(
        key, F.coalesce("count_a", none).alias("count_a"), F.coalesce("count_b", none).alias("count_b"), only("mean_s"), only("max_s"), only("reverse_max_s"), only("moved"), only("worst_s")
    )


def _matched(ta: np.ndarray, tb: np.ndarray, within: float) -> list[int]:
    """For each a in order the nearest b that is still free, the earlier of two; -1 where none is near enough. Both are in order of time.

    Taken ones point on to the next free one, and back to the last, so that a look past many of them is a few steps.
    """
    n, times = len(tb), tb.tolist()
    first = np.searchsorted(tb, tb).tolist()  # of equal moments
    up, down = list(range(n + 1)), list(range(n + 1))  # ``down`` counts from one: 0 says that none is left

    def free(way: list[int], k: int) -> int:
        while way[k] != k:
            way[k] = way[way[k]]
            k = way[k]
        return k

    out = []
    for t, k in zip(ta.tolist(), np.searchsorted(tb, ta, side="right").tolist(), strict=True):
        lo, hi = free(down, k), free(up, k)
        before, after = t - times[lo - 1] if lo else np.inf, times[hi] - t if hi < n else np.inf
        if not min(before, after) <= within:
            out.append(-1)
            continue
        j = free(up, first[lo - 1]) if before <= after else hi
        up[j], down[j + 1] = j + 1, j
        out.append(j)
    return out


def _settled(rows: pa.Table, within: float, more: bool) -> tuple[pa.Table, pa.Table]:
    """(key, a, b, dt, ha, hb) of the a's that no later row can reach, and the rows that still matter: a's left open and the free b's near them.

    Rows lie in order of key and time; those of the last key may go on if there are ``more``.
    """
    key, t = rows.column("key"), rows.column("t").to_numpy()
    is_a = rows.column("is_a").to_numpy()
    new = np.r_[True, pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy()]
    with np.errstate(invalid="ignore"):
        cut = new | ~(np.diff(t, prepend=-np.inf) <= within)
    own = np.arange(len(t)) >= np.flatnonzero(new)[-1]  # the last key's
    waits = own & (t[-1] - t <= within) & more
    partner = np.full(len(t), -1)
    edges = np.flatnonzero(cut)
    some = np.add.reduceat(is_a, edges, dtype=np.int64)
    size = np.diff(np.r_[edges, len(t)])
    for e in np.flatnonzero((some > 0) & (some < size)):
        at = np.arange(edges[e], edges[e] + size[e])
        x, y = at[is_a[at] & ~waits[at]], at[~is_a[at]]
        met = np.array(_matched(t[x], t[y], within), np.int64)
        partner[x[met >= 0]] = y[met[met >= 0]]
    x = np.flatnonzero(is_a & ~waits)
    y = pa.array(partner[x], mask=partner[x] < 0)
    dt = pa.array(np.abs(t[partner[x]] - t[x]), mask=partner[x] < 0)
    of = lambda name, at: rows.column(name).take(at)
    made = pa.table([of("key", x), of("id", x), of("id", y), dt, of("h", x), of("h", y)], names=["key", "a", "b", "dt", "ha", "hb"])
    free = ~is_a
    free[partner[partner >= 0]] = False
    since = t[waits][0] if waits.any() else np.inf
    return made, rows.filter(pa.array((waits & is_a) | (free & own & (since - t <= within))))


def _paired(within: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, fresh, n = None, [], 0
        for batch in batches:
            fresh.append(batch)
            n += len(batch)
            # Rows that are kept are looked at again only with as many new ones.
            if n and (kept is None or n >= len(kept)):
                made, kept = _settled(pa.concat_tables([*([kept] if kept else []), pa.Table.from_batches(fresh)]).combine_chunks(), within, True)
                yield from made.to_batches()
                fresh, n = [], 0
        rest = [*([kept] if kept else []), *([pa.Table.from_batches(fresh)] if n else [])]
        if rest:
            yield from _settled(pa.concat_tables(rest).combine_chunks(), within, False)[0].to_batches()

    return paired


def pairs(a: DataFrame, b: DataFrame, key: str, at: str, frame: str, value: Column, within: float = PAIR_S) -> DataFrame:
    """(key, a, b, dt, bits): each frame of ``a`` with its frame of ``b``, and how many bits of their 64-bit hashes differ.

    Frames of ``a`` choose in order of time, each among what is left. A choice reaches no farther than
    ``within``, so rows go by in order of key and time, a batch of many keys at once, and a task holds no more than
    a batch and what lies within reach of its end. Frames of no key are left out, a frame without a time has no pair,
    and one of ``b`` without an id is none.
    """
    side = lambda rows, is_a: rows.select(F.col(key).alias("key"), F.col(at).cast("double").alias("t"), F.col(frame).cast("long").alias("id"), value.cast("long").alias("h"), F.lit(is_a).alias("is_a"))
    both = side(a, True).unionByName(side(b, False).where("t IS NOT NULL AND id IS NOT NULL")).where("key IS NOT NULL")
    dealt = both.repartition("key").sortWithinPartitions("key", "t", F.asc_nulls_last("id"))
    made = dealt.mapInArrow(_paired(within), f"key {dict(both.dtypes)['key']}, a long, b long, dt double, ha long, hb long")
    return made.select(F.col("key").alias(key), "a", "b", "dt", F.bit_count(F.col("ha").bitwiseXOR(F.col("hb"))).alias("bits"))
