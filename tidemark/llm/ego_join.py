"""Near-duplicate embeddings by an epsilon grid order join.

Unit vectors of cosine c are sqrt(2 - 2c) apart. Vectors are projected on leading principal directions, sorted
by their cells in a grid of that width on these directions, and cut into blocks. The sorted sequence is joined
with itself by recursion over pairs of intervals: two intervals whose bounding boxes are further apart than
the width are skipped, large ones are halved, small ones become a tile that one task compares. A tile first
compares the projections, whose distance is a lower bound, and then takes the cosine in double precision.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

#: Leading principal directions that are kept; the first GRID of them make the order.
LEADING, GRID = 16, 6
#: Rows of a block and about those of a tile's side.
BLOCK_ROWS, TILE_ROWS = 2048, 8192
#: Blocks under a node of the tree of intervals, a power of two.
FAN = 16
#: Rows of the intervals at which the recursion within a tile ends.
LEAF_ROWS = 512
#: Numbers in the sample that the directions are taken from; they steer the order and never the result.
SAMPLE_NUMBERS = 1 << 18


def unit(values: list | None) -> np.ndarray | None:
    """A vector over its length in double precision, or None if it links with nothing."""
    if values is None or not len(values):
        return None
    x = np.array([np.nan if v is None else v for v in values], dtype=np.float64)
    if not np.isfinite(x).all():
        return None
    top = np.abs(x).max()
    if top == 0:
        return None
    x = x / top  # squares neither overflow nor vanish
    return x / math.sqrt(float(x @ x))


def units(x: np.ndarray) -> np.ndarray:
    """unit() of each row of an array of vectors that all have one."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def directions(sample: np.ndarray, leading: int = LEADING) -> np.ndarray:
    """Orthonormal columns: the leading principal directions of the sample."""
    _, vectors = np.linalg.eigh((sample - sample.mean(axis=0)).T @ (sample - sample.mean(axis=0)))
    return np.ascontiguousarray(vectors[:, ::-1][:, :leading])


def tiles(rows: list[int], low: np.ndarray, high: np.ndarray, width: float, most: int, begin: list[tuple[int, int, int, int]] | None = None) -> list[tuple[int, int, int, int]]:
    """(i, j, k, l): the sequences of blocks [i, j) and [k, l) that may hold pairs within width of each other.

    The recursion begins with all blocks against themselves, or with the given pairs of sequences.
    """
    ahead = np.concatenate(([0], np.cumsum(rows)))
    out: list[tuple[int, int, int, int]] = []
    boxes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def box(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        if (i, j) not in boxes:
            boxes[i, j] = low[i:j].min(axis=0), high[i:j].max(axis=0)
        return boxes[i, j]

    todo = list(begin) if begin is not None else [(0, len(rows), 0, len(rows))] if rows else []
    while todo:
        i, j, k, m = todo.pop()
        (la, ha), (lb, hb) = box(i, j), box(k, m)
        gap = np.maximum(0, np.maximum(la - hb, lb - ha))
        if gap @ gap > width * width + 1e-6:
            continue
        big_a, big_b = ahead[j] - ahead[i] > most and j - i > 1, ahead[m] - ahead[k] > most and m - k > 1
        if not big_a and not big_b:
            out.append((i, j, k, m))
            continue
        if (i, j) == (k, m):
            h = (i + j) // 2
            todo += [(i, h, i, h), (i, h, h, j), (h, j, h, j)]
        elif big_a and (not big_b or ahead[j] - ahead[i] >= ahead[m] - ahead[k]):
            h = (i + j) // 2
            todo += [(i, h, k, m), (h, j, k, m)]
        else:
            h = (k + m) // 2
            todo += [(i, j, k, h), (i, j, h, m)]
    return out


def intervals(p: np.ndarray, rows: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Sizes and bounding boxes of runs of rows."""
    starts = np.arange(0, len(p), rows)
    return np.diff(np.append(starts, len(p))).tolist(), np.minimum.reduceat(p, starts, axis=0), np.maximum.reduceat(p, starts, axis=0)


def close_pairs(a: np.ndarray, b: np.ndarray | None, low_a: np.ndarray, low_b: np.ndarray | None, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a and of b whose cosine is at least least (of a alone, each pair once, where b is None).

    low_a and low_b are the vectors' leading coordinates. The recursion goes on over runs of rows, as over blocks.
    """
    same = b is None
    p = low_a if same else np.concatenate((low_a, low_b))
    x = a if same else np.concatenate((a, b))
    sizes, low, high = intervals(low_a, LEAF_ROWS)
    first = len(sizes)
    if not same:
        more = intervals(low_b, LEAF_ROWS)
        sizes, low, high = sizes + more[0], np.concatenate((low, more[1])), np.concatenate((high, more[2]))
    ahead = np.concatenate(([0], np.cumsum(sizes)))
    width = math.sqrt(max(0.0, 2 - 2 * least))
    p32 = p.astype(np.float32)
    norm = (p32 * p32).sum(axis=1)
    most = np.float32(width * width + 1e-4)
    begin = [(0, first, 0, first)] if same else [(0, first, first, len(sizes))]
    for i0, j0, k0, m0 in tiles(sizes, low, high, width, LEAF_ROWS, begin):
        u, v = slice(ahead[i0], ahead[j0]), slice(ahead[k0], ahead[m0])
        i, j = np.nonzero(norm[u, None] + norm[None, v] - 2 * (p32[u] @ p32[v].T) <= most)
        if i0 == k0:
            once = i < j
            i, j = i[once], j[once]
        if len(i):
            near = np.einsum("ij,ij->i", x[u][i], x[v][j]) >= least
            yield i[near] + u.start, j[near] + v.start - (0 if same else len(a))


def _merged(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining the sets of i and j pairwise."""
    while True:
        x, y = label[i], label[j]
        if (x == y).all():
            return label
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def checked(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(good, offsets, values) of a column of lists: which are vectors that may link, and the flat numbers."""
    column = column.cast(pa.large_list(column.type.value_type))
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    flat = column.values
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64 if flat.type == pa.float64() else np.float32)  # nulls become NaN
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    some = np.concatenate(([0], np.cumsum(values != 0)))
    lo, hi = offsets[:-1], offsets[1:]
    good = (hi > lo) & (bad[hi] == bad[lo]) & (some[hi] > some[lo])
    if column.null_count:
        good &= column.is_valid().to_numpy(zero_copy_only=False)
    return good, offsets, values


def near_embeddings(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95) -> DataFrame:
    """One row per row of vectors: the id column, n_links, component_id, kept.

    All vectors of one length are compared with each other; vectors of different lengths don't link, nor do
    those that are null, empty, zero or hold a null or non-finite component: they have no links and are their
    own component. Equal vectors (rows with equal ids too) are compared once for all of them but count as links of
    each other. component_id is the least id that links reach, and the rows with that id are kept. Other columns,
    whatever their names, are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    kept = np.dtype(np.float32 if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else np.float64)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good, offsets, values = checked(b.column(1))
            values = (values + kept.type(0)).astype(kept)  # no negative zeros
            raw = [values[i:j].tobytes() if g else None for g, i, j in zip(good.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            nodes = [None if r is None else hashlib.sha256(r).digest()[:16] for r in raw]
            dims = pa.array(np.diff(offsets).astype(np.int32), mask=~good)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes, pa.binary()), dims, pa.array(raw, pa.binary())], names=["id", "node", "dims", "raw"])

    rows = vectors.selectExpr(f"`{id_col}` AS id", f"`{vector_col}` AS v").mapInArrow(keyed, f"id {kind}, node binary, dims int, raw binary")
    rows = common.written(rows, "ego-vectors")
    nodes = rows.filter("node IS NOT NULL").groupBy("node", "dims").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.first("raw").alias("raw"))
    nodes = common.written(nodes, "ego-nodes")
    found = None
    for dims, n in sorted(map(tuple, nodes.groupBy("dims").count().collect())):  # a row per vector length
        part = _joined(nodes.filter(F.col("dims") == dims), dims, n, least, kept)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "node binary, root binary, links long")
    found = common.written(found, "ego-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("node", "n", "first").join(components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))), "node", "left")
    named = common.written(named.withColumn("root", F.coalesce("root", "node")), "ego-named")
    least_id = common.written(named.groupBy("root").agg(F.min("first").alias("component")), "ego-least")
    named = named.join(least_id, "root").join(links, "node", "left").select("node", "component", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = rows.select("id", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _pairs_of_blocks(boxes: DataFrame, width: float, side: int) -> DataFrame:
    """a, b (a <= b): the runs of side blocks that may hold vectors within width of each other.

    boxes has block, low and high. The recursion over pairs of intervals runs level by level on a tree over the
    sequence of blocks, FAN to a node: the pairs of nodes of a level whose boxes are near each other give the pairs
    of their children to look at. Every level is a written table, the driver sees the number of levels.
    """
    spark = boxes.sparkSession
    level = boxes.select(F.floor(F.col("block") / side).alias("at"), "low", "high")
    tree = []
    dims = len(boxes.select("low").first()["low"])

    def merged(rows: DataFrame) -> DataFrame:
        ends = [f(F.get("low" if f is F.min else "high", F.lit(i))).alias(f"{'l' if f is F.min else 'h'}{i}") for f in (F.min, F.max) for i in range(dims)]
        out = rows.groupBy("at").agg(*ends)
        return out.select("at", F.array(*[f"l{i}" for i in range(dims)]).alias("low"), F.array(*[f"h{i}" for i in range(dims)]).alias("high"))

    level = common.written(merged(level), "ego-level")
    tree.append(level)
    while level.count() > 1:
        level = common.written(merged(level.withColumn("at", F.floor(F.col("at") / FAN))), "ego-level")
        tree.append(level)
    pairs = common.written(tree[-1].select(F.col("at").alias("a"), F.col("at").alias("b")), "ego-pairs")
    gap = F.aggregate(
        F.arrays_zip("la", "ha", "lb", "hb"), F.lit(0.0),
        lambda s, x: s + F.pow(F.greatest(F.lit(0.0), x["la"] - x["hb"], x["lb"] - x["ha"]), F.lit(2.0)),
    )
    for level in reversed(tree[:-1]):
        child = F.sequence(F.lit(0), F.lit(FAN - 1))
        pairs = pairs.select((F.col("a") * FAN).alias("a"), (F.col("b") * FAN).alias("b")).withColumn("i", F.explode(child)).withColumn("j", F.explode(child))
        pairs = pairs.select((F.col("a") + F.col("i")).alias("a"), (F.col("b") + F.col("j")).alias("b")).filter("a <= b")
        left = level.select(F.col("at").alias("a"), F.col("low").alias("la"), F.col("high").alias("ha"))
        right = level.select(F.col("at").alias("b"), F.col("low").alias("lb"), F.col("high").alias("hb"))
        pairs = common.written(pairs.join(left, "a").join(right, "b").filter(gap <= width * width + 1e-6).select("a", "b"), "ego-pairs")
    common.discard(spark, *tree)
    return pairs


def _joined(nodes: DataFrame, dims: int, n: int, least: float, kept: np.dtype) -> DataFrame:
    """node, root (connected with it by links), links (rows that it links with) from distinct vectors of one length."""
    spark = nodes.sparkSession
    sample = nodes.select("raw").orderBy(F.xxhash64("node")).limit(max(2, SAMPLE_NUMBERS // dims)).collect()
    axes = spark.sparkContext.broadcast(directions(units(np.array([np.frombuffer(r["raw"], dtype=kept) for r in sample])), min(LEADING, dims)))
    width = math.sqrt(max(0.0, 2 - 2 * least))
    grid = min(GRID, dims)
    cells = [f"c{i}" for i in range(grid)]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            x = units(np.frombuffer(b"".join(b.column(2).to_pylist()), dtype=kept).reshape(-1, dims))
            cell = np.floor(x @ axes.value[:, :grid] / width).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(cell[:, i]) for i in range(grid))], names=["node", "n", "raw", *cells])

    ordered = nodes.select("node", "n", "raw").mapInArrow(placed, "node binary, n long, raw binary, " + ", ".join(f"{c} int" for c in cells))
    placed_at = common.in_order(ordered, [], [*cells, "node"], "ego-order").withColumn("block", F.floor(F.col("__at") / BLOCK_ROWS))

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by("__at")
        raw = b"".join(table.column("raw").to_pylist())
        p = units(np.frombuffer(raw, dtype=kept).reshape(-1, dims)) @ axes.value
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int64()), "low": [p.min(axis=0).tolist()], "high": [p.max(axis=0).tolist()], "nodes": pa.array([b"".join(table.column("node").to_pylist())], pa.binary()), "counts": [table.column("n").to_pylist()], "raw": pa.array([raw], pa.binary())})

    blocks = placed_at.select("block", "__at", "node", "n", "raw").groupBy("block").applyInArrow(packed, "block long, low array<double>, high array<double>, nodes binary, counts array<long>, raw binary")
    blocks = common.written(blocks, "ego-blocks")
    side = max(1, TILE_ROWS // BLOCK_ROWS)
    tile = _pairs_of_blocks(blocks.select("block", "low", "high"), width, side)
    sides = tile.select("a", "b", F.lit(0).alias("side"), F.col("a").alias("run")).unionByName(tile.filter("a <> b").select("a", "b", F.lit(1).alias("side"), F.col("b").alias("run")))
    dealt = blocks.drop("low", "high").withColumn("run", F.floor(F.col("block") / side)).join(sides, "run")

    def compared(table: pa.Table) -> pa.Table:
        def side_of(s: int) -> tuple[list[bytes], np.ndarray, np.ndarray | None]:
            mine = [r for r in table.select(["side", "block", "nodes", "counts", "raw"]).to_pylist() if r["side"] == s]
            mine.sort(key=lambda r: r["block"])
            nodes_ = [r["nodes"][k : k + 16] for r in mine for k in range(0, len(r["nodes"]), 16)]
            return nodes_, np.array([c for r in mine for c in r["counts"]], dtype=np.int64), units(np.frombuffer(b"".join(r["raw"] for r in mine), dtype=kept).reshape(-1, dims)) if mine else None

        na, ca, a = side_of(0)
        nb, cb, b = side_of(1)
        names, counts = na + nb, np.concatenate((ca, cb))
        shift = 0 if b is None else len(a)
        label, links = np.arange(len(names)), np.zeros(len(names), dtype=np.int64)
        for i, j in close_pairs(a, b, a @ axes.value, None if b is None else b @ axes.value, least):
            j = j + shift
            np.add.at(links, i, counts[j])
            np.add.at(links, j, counts[i])
            label = _merged(label, i, j)
        at = np.flatnonzero(links)
        return pa.table({"node": pa.array([names[k] for k in at], pa.binary()), "root": pa.array([names[label[k]] for k in at], pa.binary()), "links": pa.array(links[at], pa.int64())})

    return dealt.groupBy("a", "b").applyInArrow(compared, "node binary, root binary, links long")
