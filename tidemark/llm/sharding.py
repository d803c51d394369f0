"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

How many rows of each partition go to each shard is drawn exactly (a multivariate hypergeometric row per
partition, so that rows and columns sum to the partitions' and the shards' sizes): first for groups of
partitions, on the driver, then for the partitions of each group, in tasks. Each partition is permuted locally,
its rows are dealt out in that order by its row of the matrix, exchanged, and permuted again, by random keys in
ranges of the whole order, so no task holds a shard.
"""

from __future__ import annotations

from decimal import Decimal, localcontext
from fractions import Fraction
from math import comb, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import FILE, INPUT, ROW

#: numpy draws up to this many items.
_NUMPY_MOST = 10**9
#: Bits of the fixed-point numbers in which probabilities are summed, and digits of the first one.
_BITS, _DIGITS = 256, 90
#: Partitions of a group.
GROUP = 1024


def _bernoulli(n: int) -> list[tuple[int, int]]:
    """The first n Bernoulli numbers of even index from 2 on, as fractions."""
    b = [Fraction(1)]
    for m in range(1, 2 * n + 1):
        b.append(-sum(comb(m + 1, k) * b[k] for k in range(m)) / (m + 1))
    return [(x.numerator, x.denominator) for x in b[2::2]]


_SERIES = _bernoulli(24)


def _log_factorial(n: int) -> Decimal:
    """The logarithm of n! to about _DIGITS digits, by Stirling's series from 1,000 on."""
    if n < 1000:
        return Decimal(factorial(n)).ln()
    x = Decimal(n + 1)
    out = (x - Decimal("0.5")) * x.ln() - x + (2 * _PI).ln() / 2
    for k, (a, b) in enumerate(_SERIES, 1):
        out += Decimal(a) / Decimal(b) / (2 * k * (2 * k - 1)) / x ** (2 * k - 1)
    return out


def _pi() -> Decimal:
    """Machin's formula."""
    with localcontext() as c:
        c.prec = _DIGITS + 10

        def arctan(inverse: int) -> Decimal:
            term = total = Decimal(1) / inverse
            n = 1
            while abs(term) > Decimal(10) ** -(_DIGITS + 9):
                term = -term / (inverse * inverse)
                n += 2
                total += term / n
            return total

        return 4 * (4 * arctan(5) - arctan(239))


_PI = _pi()


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n items drawn from good + bad are good.

    Where numpy can't draw, by inversion from the mode in fixed-point numbers of 256 bits, with the mode's
    probability to 70 digits or more: the draw's law differs from the exact one by less than 1e-60.
    """
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if good + bad < _NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, n))
    low, high = max(0, n - bad), min(n, good)
    mode = min(max((n + 1) * (good + 1) // (good + bad + 2), low), high)
    with localcontext() as c:
        c.prec = _DIGITS
        choose = lambda a, b: _log_factorial(a) - _log_factorial(b) - _log_factorial(a - b)
        p = int((choose(good, mode) + choose(bad, n - mode) - choose(good + bad, n)).exp() * (1 << _BITS))
    u, left, right, pl, pr = int.from_bytes(rng.bytes(_BITS // 8), "big") - p, mode, mode, p, p
    while u > 0 and (left > low or right < high):
        if right < high:
            pr = pr * ((good - right) * (n - right)) // ((right + 1) * (bad - n + right + 1))
            right += 1
            u -= pr
            if u <= 0:
                return right
        if left > low:
            pl = pl * (left * (bad - n + left)) // ((good - left + 1) * (n - left + 1))
            left -= 1
            u -= pl
            if u <= 0:
                return left
    return mode


def communication_matrix(rows: list[int], columns: list[int], seed: int | tuple[int, ...]) -> np.ndarray:
    """A random matrix of counts with these sums, as a uniform permutation of all items would give it."""
    rng = np.random.default_rng(seed)
    left = list(columns)
    out = np.zeros((len(rows), len(columns)), dtype=np.int64)
    for i, n in enumerate(rows):
        rest = sum(left)
        for j, c in enumerate(left):
            if n == 0:
                break
            rest -= c
            out[i, j] = k = hypergeometric(rng, c, rest, n)
            n -= k
            left[j] -= k
    return out


def balanced(total: int, parts: int) -> list[int]:
    """Sizes at most one apart that sum to total."""
    return [total // parts + (i < total % parts) for i in range(parts)]


def shuffle_into_shards(rows: DataFrame, n_shards: int = 40, seed: int = 11, group: int = GROUP) -> DataFrame:
    """rows with shard (0 to n_shards - 1, counts at most one apart) and slot (gapless from 0 in each shard).

    Every order of the rows over all shards and slots is equally likely under the seed, and the same rows in
    the same files give the same result, so a task that is run again deals as before. Nulls, long texts, repeated
    rows and columns of any name pass through (columns named shard or slot are replaced); an empty table gives no
    rows. The driver sees a row per group of partitions and a line of the matrix for each; the rest is drawn in
    tasks, a group each.
    """
    spark = rows.sparkSession
    keyed = common.located(rows).withColumn("__key", F.xxhash64(F.lit(seed), FILE, ROW)).sortWithinPartitions("__key", FILE, ROW)
    index = F.monotonically_increasing_id()
    local = keyed.withColumn("__part", F.shiftright(index, 33)).withColumn("__rank", index.bitwiseAND(F.lit((1 << 33) - 1)))
    local = common.written(local.drop("__key"), "shard-local")
    counts = local.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).withColumn("g", F.floor(F.col("__part") / group))
    counts = common.written(counts, "shard-counts")
    totals = sorted(map(tuple, counts.groupBy("g").agg(F.sum("n")).collect()))  # a row per group
    coarse = communication_matrix([n for _, n in totals], balanced(sum(n for _, n in totals), n_shards), seed)
    lines = {g: line.tolist() for (g, _), line in zip(totals, coarse, strict=True)}

    def drawn(key: tuple, table: pa.Table) -> pa.Table:
        g = key[0].as_py()
        parts = sorted(zip(table.column("__part").to_pylist(), table.column("n").to_pylist(), strict=True))
        matrix = communication_matrix([n for _, n in parts], lines[g], (seed, g))
        return pa.table({"__part": pa.array([p for p, _ in parts], pa.int64()), "__ends": pa.array(matrix.cumsum(axis=1).tolist(), pa.list_(pa.int64()))})

    ends = common.written(counts.groupBy("g").applyInArrow(drawn, "__part long, __ends array<long>"), "shard-matrix")
    dealt = local.join(ends, "__part").withColumn("__shard", F.size(F.filter("__ends", lambda e: e <= F.col("__rank")))).drop("__ends", "__part", "__rank")
    dealt = dealt.withColumn("__second", F.xxhash64(F.lit(seed), F.lit("second"), FILE, ROW))
    out = common.in_order(dealt, ["__shard"], ["__second", FILE, ROW], "shard-order")
    common.discard(spark, counts)
    kept = [F.col(INPUT).getField(c).alias(c) for c in rows.columns if c.lower() not in ("shard", "slot")]
    return out.select(*kept, F.col("__shard").cast("int").alias("shard"), F.col("__at").cast("long").alias("slot"))
