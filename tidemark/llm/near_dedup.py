"""Near-duplicates by weighted-Jaccard signatures (BagMinHash), bands, and verified multiset overlap.

Each shingle's weight is its count. For every shingle, a Poisson process runs on each dyadic interval of
weights (0, 1], (1, 2], (2, 4], ... that its weight reaches; each point carries a time, a component of the
signature and, in the last interval, a weight below which it counts: a point's weight is drawn as a whole, which
has the same law as splitting the interval below it in halves. A component keeps its earliest point, so two bags
agree in a component with the probability of their weighted Jaccard similarity. Points later than the last
component's first are never made.

Texts that share a band are candidates. In each bucket, signatures tell which of its members may be similar; large
buckets are cut into smaller ones by further components first. What these pairs connect is a group, whose pairs
are verified by multiset overlap: each block of a group against itself and its first block, then only what is
not in the group's main class against the rest. Pairs that others already connect need no check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words
from .common import FILE, ROW
from .components import components
from .words import mix

_U = np.uint64
SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 32, 6
#: Times the standard error of the estimated similarity that a pair may lie below LEAST and still be verified.
MARGIN = 4.5
#: Members of a bucket that one task compares by signatures, and the further bands that cut larger buckets.
MEMBERS, CUTS, CUT_ROWS = 2048, 12, 2
#: About the bytes of text in a block of a group whose members are compared.
BLOCK_BYTES = 3 << 20
#: Bits of a shingle's hash within its text, beside the bits for the text's place in a piece.
_BITS = _U(44)


def bags(word: np.ndarray, text: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, text, count) of the distinct shingles of each text."""
    value, owner = words.shingles(word, text, k)
    joint = np.sort((owner.astype(_U) << _BITS) | (value >> (_U(64) - _BITS)))
    if not len(joint):
        return joint, joint.astype(np.int64), joint.astype(np.int64)
    at = np.flatnonzero(np.concatenate(([True], joint[1:] != joint[:-1])))
    count = np.diff(np.concatenate((at, [len(joint)])))
    return joint[at] & ((_U(1) << _BITS) - _U(1)), (joint[at] >> _BITS).astype(np.int64), count


def signatures(shingle: np.ndarray, text: np.ndarray, count: np.ndarray, n: int, size: int = BANDS * ROWS) -> np.ndarray:
    """An n x size array of the identities of each text's earliest points; all zero for a text without shingles."""
    value = np.zeros(n * size, dtype=_U)
    weight = np.bincount(text, weights=count, minlength=n)
    # one process per shingle and dyadic interval: (0, 1], then (1, 2], (2, 4], ... up to the count
    key, owner, rate, part = [mix(shingle)], [text], [np.ones(len(text))], [np.ones(len(text))]
    k, more = 0, np.flatnonzero(count > 1)
    while len(more):
        width = 1 << k
        key.append(mix(shingle[more] + _U(0x5851F42D4C957F2D * (k + 1) % (1 << 64))))
        owner.append(text[more])
        rate.append(np.full(len(more), float(width)))
        part.append(np.minimum(1.0, (count[more] - width) / width))
        k += 1
        more = more[count[more] > 2 * width]
    key, owner, rate, part = map(np.concatenate, (key, owner, rate, part))
    time = np.full(n * size, np.inf)
    limit = size * (np.log(size) + 3) / np.maximum(weight, 1e-9)
    todo = np.arange(len(key))
    while len(todo):
        own, ident, own_rate, own_part = owner[todo], key[todo], rate[todo], part[todo]
        now, most, step = np.zeros(len(todo)), limit[own], 0
        while len(own):
            step += 1
            ident = mix(ident + _U(0x9E3779B97F4A7C15))
            now = now - np.log(((ident >> _U(11)).astype(np.float64) + 0.5) / (1 << 53)) / own_rate
            on = now <= most
            own, ident, own_rate, own_part, now, most = own[on], ident[on], own_rate[on], own_part[on], now[on], most[on]
            draw = mix(ident ^ _U(0xA0761D6478BD642F))
            counts = ((draw >> _U(32)).astype(np.float64) + 0.5) / (1 << 32) < own_part
            place = own[counts] * size + ((draw[counts] & _U(0xFFFFFFFF)) % _U(size)).astype(np.int64)
            came, who = now[counts], ident[counts]
            np.minimum.at(time, place, came)
            won = time[place] == came
            value[place[won]] = who[won]
        short = np.isinf(time.reshape(n, size)).any(axis=1) & (weight > 0)
        if not short.any():
            break
        limit[short] *= 2  # a component is still open: the same points again, and later ones
        again = short[owner]
        time.reshape(n, size)[short] = np.inf
        todo = np.flatnonzero(again)
    return value.reshape(n, size)


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A hash for each band of each signature."""
    out = np.zeros((len(signature), bands), dtype=_U)
    cells = signature.reshape(len(signature), bands, rows)
    for i in range(rows):
        out = mix(out * _U(0xD1342543DE82EF95) + cells[:, :, i])
    return mix(out + np.arange(bands, dtype=_U))


def _copies(value: np.ndarray) -> np.ndarray:
    """Sorted hashes that tell the copies of a repeated shingle apart."""
    value = np.sort(value)
    if len(value) < 2:
        return value
    fresh = np.concatenate(([True], value[1:] != value[:-1]))
    at = np.flatnonzero(fresh)
    nth = np.arange(len(value)) - np.repeat(at, np.diff(np.concatenate((at, [len(value)]))))
    return np.sort(np.where(nth == 0, value, mix(value + nth.astype(_U) * _U(0xD6E8FEB86659FD93))))


def floor_of(least: float, margin: float | None) -> float:
    """The estimate below which a pair is passed over; none is where margin is None."""
    return -1.0 if margin is None else least - margin * np.sqrt(least * (1 - least) / (BANDS * ROWS))


def alike_classes(sign: np.ndarray, floor: float) -> np.ndarray:
    """For each row of 16-bit signatures, the first row that pairs with estimates of floor or more connect it with."""
    n = len(sign)
    label, left = np.arange(n), np.arange(n)
    while len(left):
        seed, left = left[0], left[1:]
        todo = [seed]
        while todo and len(left):
            near = (sign[left] == sign[todo.pop()]).mean(axis=1) >= floor
            label[left[near]] = seed
            todo += left[near].tolist()
            left = left[~near]
    return label


def links_within(texts: pa.Array, sign: np.ndarray, side: np.ndarray, label: np.ndarray, compare: str, least: float = LEAST, floor: float = -1.0) -> list[tuple[int, int]]:
    """Pairs of rows that, with the labels that are known, span the graph of all pairs whose overlap is at least least.

    Pairs whose signatures estimate less than floor are passed over, and so are those that others (or equal labels)
    already connect. side is 0 or 1; compare says which pairs count: "all", "not 0-0" or "0-1".
    """
    n = len(texts)
    bag: list[np.ndarray] = [np.zeros(0, dtype=_U)] * n
    for at, data, offsets in words.pieces(texts):
        word, text, _, _ = words.hash_words(data, offsets)
        rows = len(offsets) - 1
        value, owner = words.shingles(word, text, SHINGLE)
        ends = np.searchsorted(owner, np.arange(rows + 1))
        for i in range(rows):
            bag[at + i] = _copies(value[ends[i] : ends[i + 1]])
    size = np.array([len(b) for b in bag])
    label = np.unique(label, return_inverse=True)[1]
    ends = np.cumsum(size)
    number = np.unique(np.concatenate(bag), return_inverse=True)[1] if n else np.zeros(0, dtype=np.int64)
    mine = np.zeros(len(number), dtype=bool)  # the numbers that the row at hand has
    found: list[tuple[int, int]] = []
    place = np.arange(n)
    for i in np.argsort(size, kind="stable")[::-1].tolist():
        if not size[i]:
            continue
        may = (label != label[i]) & (size >= least * size[i]) & ((size < size[i]) | ((size == size[i]) & (place < i)))  # each pair once
        if compare == "0-1" or compare == "not 0-0" and side[i] == 0:
            may &= side != side[i]
        near = np.flatnonzero(may)
        if not len(near):
            continue
        alike = (sign[near] == sign[i]).mean(axis=1)
        order = np.argsort(-alike, kind="stable")
        near = near[order][alike[order] >= floor]
        own, step = number[ends[i] - size[i] : ends[i]], 1
        mine[own] = True
        while len(near):  # the likeliest first, then more and more at once
            many = max(1, int(np.searchsorted(np.cumsum(size[near[:step]]), 1 << 20)))
            some, near, step = near[:many], near[many:], min(512, 8 * step)
            begin = np.cumsum(size[some]) - size[some]
            at = np.arange(int(size[some].sum())) + np.repeat(ends[some] - size[some] - begin, size[some])
            both = np.add.reduceat(mine[number[at]].astype(np.int64), begin)
            for j in some[both >= least * (size[i] + size[some] - both)].tolist():
                if label[j] != label[i]:
                    found.append((i, j))
                    label[label == label[j]] = label[i]
            near = near[label[near] != label[i]]
        mine[own] = False
    return found


def _bucket_links(pairs: DataFrame, signs: DataFrame, floor: float, most: int, n_tasks: int) -> DataFrame:
    """Links (a, b) of nodes that connect what may be similar in the buckets of pairs (key, node).

    signs has node and sign; there are no more than most nodes.
    """

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for members in b.column(0):
                nodes = [m["node"].as_py() for m in members.values]
                label = alike_classes(np.frombuffer(b"".join(m["sign"].as_py() for m in members.values), dtype=np.uint16).reshape(len(nodes), -1), floor)
                at = np.flatnonzero(label != np.arange(len(nodes)))
                yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in at], pa.binary()), pa.array([nodes[i] for i in label[at]], pa.binary())], names=["a", "b"])

    sized = lambda p: p.groupBy("key").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")

    def star(p: DataFrame) -> DataFrame:
        return p.filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))

    held = common.written(pairs.join(sized(pairs), "key"), "near-buckets", BANDS * most, n_tasks)
    if floor < 0:
        return star(held)
    signs = common.maybe_in(signs, "node", held.select("node"))
    small, large = held.filter(F.col("n") <= MEMBERS).select("key", "node"), held.filter(F.col("n") > MEMBERS)
    out = None
    if not large.isEmpty():  # cut by further components, which similar texts share somewhere
        cut = F.transform(
            F.sequence(F.lit(0), F.lit(CUTS - 1)),
            lambda i: F.xxhash64("key", i, F.substring("sign", (F.pmod(F.xxhash64("key", i), F.lit(BANDS * ROWS // CUT_ROWS)) * (2 * CUT_ROWS) + 1).cast("int"), F.lit(2 * CUT_ROWS))),
        )
        cuts = large.select("key", "node").join(signs, "node").select("node", F.explode(F.array_distinct(cut)).alias("key"))
        cuts = common.written(cuts.join(sized(cuts), "key"), "near-cuts", most_tasks=n_tasks)
        small = small.unionByName(cuts.filter(F.col("n") <= MEMBERS).select("key", "node"))
        out = star(cuts.filter(F.col("n") > MEMBERS))
    members = small.join(signs, "node").groupBy("key").agg(F.collect_list(F.struct("node", "sign")).alias("members"))
    found = members.select("members").mapInArrow(linked, "a binary, b binary")
    return found if out is None else out.unionByName(found)


def _compared(dealt: DataFrame, compare: str, least: float, floor: float) -> DataFrame:
    """Links (a, b) within the rows of each (root, i, j) of dealt."""

    def run(table: pa.Table) -> pa.Table:
        text = table.column("__text").combine_chunks()
        text = text if isinstance(text, pa.Array) else pa.concat_arrays(text.chunks)
        nodes = table.column("node").to_pylist()
        sign = np.frombuffer(b"".join(table.column("sign").to_pylist()), dtype=np.uint16).reshape(len(nodes), -1)
        side = table.column("side").to_numpy()
        label = np.unique(np.array([x.hex() for x in table.column("label").to_pylist()]), return_inverse=True)[1]
        alone = compare != "0-1" and side.min() == side.max()
        found = links_within(text, sign, side, label, "all" if alone else compare, least, floor)
        return pa.table({"a": pa.array([nodes[i] for i, _ in found], pa.binary()), "b": pa.array([nodes[j] for _, j in found], pa.binary())})

    return dealt.groupBy("root", "i", "j").applyInArrow(run, "a binary, b binary")


def _verified(groups: DataFrame, once: DataFrame, rows: DataFrame, least: float, floor: float, most: int, n_tasks: int) -> DataFrame:
    """node and root of the classes that the verified pairs within the groups (node, root) make, of at most most nodes."""
    placed = once.select("node", "size", "sign").join(groups, "node")
    sizes = common.written(placed.groupBy("root").agg(F.ceil(F.sum(F.col("size") + 512) / F.lit(BLOCK_BYTES)).cast("int").alias("blocks")), "near-sizes", most, n_tasks)
    placed = placed.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    texts = common.maybe_in(rows.select("node", "__text"), "node", groups.select("node")).groupBy("node").agg(F.first("__text").alias("__text"))
    placed = common.written(placed.join(texts, "node"), "near-placed", most_tasks=n_tasks)

    # Each block against itself and the group's first block: a group of copies of one text is one class then.
    first = placed.withColumn("j", F.when(F.col("own") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own")))
    first = first.withColumn("j", F.explode("j")).select("root", F.lit(0).alias("i"), "j", (F.col("own") != 0).cast("int").alias("side"), "node", "sign", F.col("node").alias("label"), "__text")
    links = common.written(_compared(first.repartition("root", "i", "j"), "not 0-0", least, floor), "near-links", most_tasks=n_tasks)
    label = common.written(components(links, n_tasks), "near-label", most, n_tasks)
    wide = placed.filter("blocks > 1")
    if wide.isEmpty():
        return label

    # In groups of several blocks, what is not in the largest class meets the blocks that it has not met.
    wide = wide.join(label.select("node", F.col("root").alias("label")), "node", "left").withColumn("label", F.coalesce("label", "node"))
    wide = common.written(wide, "near-wide", most_tasks=n_tasks)
    main = wide.groupBy("root", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("root").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    wide = wide.join(main, "root")
    rest = wide.filter("label <> main")
    if rest.isEmpty():
        return label
    parts = rest.groupBy("root").agg(F.ceil(F.sum(F.col("size") + 512) / F.lit(BLOCK_BYTES)).cast("int").alias("parts"))
    rest = rest.join(parts, "root").withColumn("i", F.pmod(F.xxhash64(F.lit(1), "node"), F.col("parts")).cast("int"))
    rest = rest.withColumn("j", F.explode(F.sequence(F.lit(1), F.col("blocks") - 1)))
    every = wide.join(parts, "root").filter("own > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    columns = ["root", "i", "j", "side", "node", "sign", "label", "__text"]
    dealt = rest.withColumn("side", F.lit(0)).select(columns).unionByName(every.withColumn("side", F.lit(1)).withColumn("j", F.col("own")).select(columns))
    more = common.written(_compared(dealt.repartition("root", "i", "j"), "0-1", least, floor), "near-links", most_tasks=n_tasks)
    return label if more.isEmpty() else components(links.unionByName(more), n_tasks)


def _classes(rows: DataFrame, kind: str, least: float, margin: float | None, n_tasks: int) -> DataFrame:
    """__id, class_id, class_size, kept, FILE and ROW of rows with __id, __text, FILE and ROW."""
    floor = floor_of(least, margin)
    rows = rows.withColumn("node", F.substring(F.unhex(F.sha2(F.col("__text"), 256)), 1, 16))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, data, offsets in words.pieces(b.column(0)):
                word, text, _, _ = words.hash_words(data, offsets)
                n = len(offsets) - 1
                bag = bags(word, text)
                has = np.bincount(bag[1], minlength=n) > 0
                sign = signatures(*bag, n)
                keys, short = band_keys(sign).view(np.int64), (sign >> _U(48)).astype(np.uint16)
                keep = [keys[i].tolist() if has[i] else [] for i in range(n)]
                yield pa.RecordBatch.from_arrays([*(c.slice(at, n) for c in b.columns[1:]), pa.array(np.diff(offsets)), pa.array(keep, pa.list_(pa.int64())), pa.array([short[i].tobytes() if has[i] else b"" for i in range(n)], pa.binary())], names=["node", "__id", FILE, ROW, "size", "bands", "sign"])

    sketch = rows.select("__text", "node", "__id", FILE, ROW).mapInArrow(signed, f"node binary, __id {kind}, {FILE} string, {ROW} long, size long, bands array<long>, sign binary")
    sketch = common.written(sketch, "near-bands", most_tasks=n_tasks)
    # equal texts have equal bands; a text without shingles has none
    once = sketch.filter(F.size("bands") > 0).groupBy("node").agg(F.first("bands").alias("bands"), F.first("size").alias("size"), F.first("sign").alias("sign"))
    most = sketch.count()
    once = common.written(once, "near-once", most_tasks=n_tasks)
    groups = common.written(components(_bucket_links(once.select("node", F.explode("bands").alias("key")), once.select("node", "sign"), floor, most, n_tasks), n_tasks), "near-groups", most, n_tasks)
    classes = common.written(_verified(groups, once, rows, least, floor, most, n_tasks), "near-classes", most, n_tasks)
    named = sketch.select("node", "__id", FILE, ROW).join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = common.written(named, "near-named", most, n_tasks)
    common.discard(rows.sparkSession, sketch, once, groups, classes)
    best = named.groupBy("root").agg(F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", FILE, ROW)).alias("best"), F.count(F.lit(1)).alias("n"))
    best = common.written(best, "near-best", most, n_tasks)  # so that the join below can split a class with very many rows
    out = named.join(best, "root")
    kept = (F.col(FILE) == F.col(f"best.{FILE}")) & (F.col(ROW) == F.col(f"best.{ROW}"))
    return out.select("__id", F.col("best.__id").alias("class_id"), F.col("n").alias("class_size"), kept.alias("kept"), FILE, ROW)


def _picked(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return rows.select(common.of_input(id_col).alias("__id"), F.coalesce(common.of_input(text_col), F.lit("")).alias("__text"), FILE, ROW)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, margin: float | None = MARGIN) -> DataFrame:
    """One row per row of docs: the id column, class_id, class_size, kept.

    Documents are in one class when a chain of pairs connects them, each pair with equal texts or with a
    weighted Jaccard similarity of their bags of five-word shingles of at least least. Texts of less than five
    words have no shingles and link only with equal texts; a null text counts as empty. Long texts are taken whole.
    class_id is the least id of the class (null only if all are), and of the rows with that id the first by file and
    place is kept. A pair of similarity 0.8 is missed with a probability of 6e-5, more similar ones with less; of
    these, an estimate margin standard errors too low makes 4e-6, and margin None none. An empty table gives no
    rows; other columns, whatever their names, are ignored.
    """
    n = common.tasks(docs)
    out = _classes(_picked(common.located(docs), id_col, text_col), docs.schema[id_col].dataType.simpleString(), least, margin, n)
    return out.withColumnRenamed("__id", id_col).drop(FILE, ROW).coalesce(n)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class of near-duplicates; all columns, of any name, stay as they are.

    Nulls, empty and long texts, ties and repeated rows as in near_dedup; an empty table stays empty.
    """
    rows, n = common.located(docs), common.tasks(docs)
    dropped = _classes(_picked(rows, id_col, text_col), docs.schema[id_col].dataType.simpleString(), LEAST, MARGIN, n).filter("NOT kept").select(FILE, ROW)
    return common.input_rows(rows.join(dropped, [FILE, ROW], "left_anti")).coalesce(n)
