"""Removal of word sequences that occur earlier, found by FM-indexes over shards of repeated text.

Every window of 20 words holds an anchor, the run of ANCHOR words with the least hash, so equal windows have
equal anchors at equal places. Only windows whose anchor occurs more than once in the corpus can repeat. Their
contexts (the words of the windows that share an anchor occurrence) are dealt out by anchor into shards; each
shard builds a compressed FM-index of its contexts, in the order of documents and places, and streams the
contexts through it: the rows of a window's match begin with its earliest occurrence. A window is removed
unless it is that occurrence. Contexts of an anchor with very many occurrences are cut into single windows; equal
ones of these are combined before the exchange, so a passage that very many documents share comes down to one
context per window, and no shard gets more than its words and the contexts of one anchor that is not so frequent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words
from .common import FILE, ROW
from .fm_index import FmIndex
from .words import mix

_U = np.uint64
WINDOW, ANCHOR = 20, 8
#: Anchors with more occurrences than this are dealt out window by window.
HOT = 1000
#: About the words in one index.
SHARD_WORDS = 1 << 20
_PLACE_BITS = _U((1 << 28) - 1)


def _minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each width values in a row."""
    out, have = values, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def anchors(word: np.ndarray, text: np.ndarray, window: int = WINDOW, k: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, place, first, last) of each anchor: its hash, where it starts, and the first and last window that has it."""
    none = np.zeros(0, dtype=np.int64)
    if len(word) < window:
        return none.astype(_U), none, none, none
    n = len(word) - k + 1
    key = np.zeros(n, dtype=_U)
    for i in range(k):
        key = key * _U(0xD1342543DE82EF95) + word[i : i + n]
    key = mix(key)
    packed = (key & ~_PLACE_BITS) | np.arange(n, dtype=_U)
    place = (_minima(packed, window - k + 1) & _PLACE_BITS).astype(np.int64)
    start = np.flatnonzero(text[: len(text) - window + 1] == text[window - 1 :])
    if not len(start):
        return none.astype(_U), none, none, none
    place = place[start]
    fresh = np.concatenate(([True], place[1:] != place[:-1]))
    at = np.flatnonzero(fresh)
    last = start[np.append(at[1:], len(start)) - 1]
    return key[place[at]], place[at], start[at], last


def _ids(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _index_shard(bodies: list[bytes], doc: np.ndarray, tie: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """For each context, bits of the windows that occur nowhere earlier in the contexts.

    Of equal contexts only the earliest is indexed and streamed: all windows of the others occur in it.
    """
    first_of: dict[bytes, int] = {}
    for i in np.lexsort((at, tie, doc)).tolist():
        first_of.setdefault(bodies[i], i)
    order = np.array(list(first_of.values()), dtype=np.int64)
    queries = np.frombuffer(b"".join([bodies[i] for i in order.tolist()]), dtype=np.uint32).astype(np.int64) + 1
    lengths = np.array([len(bodies[i]) // 4 for i in order.tolist()], dtype=np.int64)
    ends = np.cumsum(lengths)
    joined = np.zeros(len(queries) + len(order), dtype=np.int64)  # a 0 after each context
    owner = np.repeat(np.arange(len(order)), lengths)
    moved = np.arange(len(queries)) + owner
    joined[moved] = queries
    index = FmIndex(joined, window)
    low, high = index.matching(queries, ends)
    found = low < high
    first = np.zeros(len(queries), dtype=bool)
    first[found] = index.order[low[found]] == moved[found]
    offset = np.arange(len(queries)) - np.repeat(ends - lengths, lengths)
    mask = np.zeros(len(order), dtype=np.int64)
    np.bitwise_or.at(mask, owner[first], np.int64(1) << offset[first])
    out = np.zeros(len(bodies), dtype=np.int64)
    out[order] = mask
    return out


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """The id column, n_words, n_removed, kept_sha256 for each row of docs, and with_text: kept_text and spans.

    Words are runs of other characters than space and U+0009 to U+000D, unchanged. A word goes if a window of 20
    words of its document covers it that also starts earlier: in a document of a smaller id or before in the
    same one. Windows are judged on the input. Ids are whole numbers; a null id comes before all others, and
    rows with the same id have a fixed order among them. Null texts have no words; texts of less than 20 words
    lose none. Long texts are hashed in pieces and taken whole. An empty table gives no rows; other columns, whatever their names, are ignored. spans are the
    first and last removed words (counted from 0) of each removed run.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = common.located(docs).select(common.of_input(id_col).alias("id"), F.coalesce(common.of_input(text_col), F.lit("")).alias("text"), FILE, ROW)
    doc = F.coalesce(F.col("id").cast("long"), F.lit(-(1 << 63)))
    unique = rows.groupBy(doc.alias("doc")).count().filter("count > 1").isEmpty()
    rows = rows.withColumn("doc", doc).withColumn("tie", F.lit(0).cast("long") if unique else F.xxhash64(FILE, ROW))
    width = window - ANCHOR + 1
    n_tasks = common.tasks(docs)

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc_, tie = _ids(b.column(1)), _ids(b.column(2))
            for row, data, offsets in words.pieces(b.column(0)):
                word, text, _, _ = words.hash_words(data, offsets)
                key, place, _, _ = anchors(word, text, window)
                owner = text[place] + row
                begin = np.searchsorted(text, text[place])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(doc_[owner]), pa.array(tie[owner]), pa.array((place - begin).astype(np.int32))], names=["key", "doc", "tie", "place"])

    found = common.written(rows.select("text", "doc", "tie").mapInArrow(anchored, "key long, doc long, tie long, place int"), "anchors", most_tasks=n_tasks)
    repeated = common.written(found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", (F.col("n") > HOT).alias("hot")), "repeated", most_tasks=n_tasks)
    cands = common.maybe_in(found, "key", repeated.select("key")).join(repeated, "key")
    cands = cands.groupBy("doc", "tie").agg(F.collect_list("place").alias("places"), F.collect_list(F.when(F.col("hot"), F.col("place"))).alias("hot"))
    cands = common.written(cands, "candidates", most_tasks=n_tasks)
    common.discard(spark, found, repeated)

    marked = common.maybe_marked(rows, F.xxhash64("doc", "tie"), cands.select(F.xxhash64("doc", "tie")), "__maybe")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc_, tie = _ids(b.column(1)), _ids(b.column(2))
            for row, data, offsets in words.pieces(b.column(0)):
                word, text, _, _ = words.hash_words(data, offsets)
                key, place, first, last = anchors(word, text, window)
                begins = np.searchsorted(text, np.arange(len(offsets)))
                chosen, hot = (_chosen(b.column(c), row, len(offsets) - 1, begins) for c in (3, 4))
                use, is_hot = np.isin(place, chosen), np.isin(place, hot)
                key, first, last, is_hot = key[use], first[use], last[use], is_hot[use]
                cold_rows = len(key)
                if is_hot.any():  # single windows, each with a key of its own
                    n = (last - first + 1)[is_hot]
                    starts = np.repeat(first[is_hot], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    own = np.zeros(len(starts), dtype=_U)
                    for i in range(window):
                        own = own * _U(0xD1342543DE82EF95) + word[starts + i]
                    key = np.concatenate((key[~is_hot], mix(own)))
                    cold_rows = int((~is_hot).sum())
                    first, last = np.concatenate((first[~is_hot], starts)), np.concatenate((last[~is_hot], starts))
                if not len(key):
                    continue
                length = last - first + window
                begin = np.cumsum(length) - length
                pick = np.repeat(first - begin, length) + np.arange(int(length.sum()))
                body = (word[pick] >> _U(32)).astype(np.uint32)
                # of equal contexts in this piece, the first stays
                same = np.bitwise_xor.reduceat(mix(body.astype(_U) + (np.arange(len(body)) - np.repeat(begin, length)).astype(_U) * _U(0x9E3779B97F4A7C15)), begin) ^ key
                order = np.lexsort((first, tie[text[first] + row], doc_[text[first] + row], same))
                keep = np.sort(order[np.concatenate(([True], same[order][1:] != same[order][:-1]))])
                edge = np.concatenate((begin, [len(body)]))
                raw = body.tobytes()
                parts = [raw[4 * edge[i] : 4 * edge[i + 1]] for i in keep.tolist()]
                owner = text[first[keep]] + row
                at = first[keep] - begins[text[first[keep]]]
                yield pa.RecordBatch.from_arrays([pa.array(key[keep].view(np.int64)), pa.array(doc_[owner]), pa.array(tie[owner]), pa.array(at.astype(np.int32)), pa.array(parts, pa.binary()), pa.array(keep >= cold_rows)], names=["key", "doc", "tie", "at", "body", "hot"])

    dealt = marked.filter("__maybe").select("text", "doc", "tie").join(cands, ["doc", "tie"]).select("text", "doc", "tie", "places", "hot")
    context_rows = common.written(dealt.mapInArrow(contexts, "key long, doc long, tie long, at int, body binary, hot boolean"), "contexts", most_tasks=n_tasks)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush(part: pa.Table) -> pa.RecordBatch:
            doc_, tie, at = (part.column(c).to_numpy() for c in ("doc", "tie", "at"))
            mask = _index_shard(part.column("body").to_pylist(), doc_, tie, at, window)
            some = mask != 0
            return pa.RecordBatch.from_arrays([pa.array(doc_[some]), pa.array(tie[some]), pa.array(at[some].astype(np.int32)), pa.array(mask[some])], names=["doc", "tie", "at", "mask"])

        for b in batches:
            if not len(b):
                continue
            held.append(b)
            size += b.column(4).nbytes // 4
            if size >= SHARD_WORDS:
                table = pa.Table.from_batches(held)
                keys = table.column("key").to_numpy()
                cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
                if cut:
                    yield flush(table.slice(0, cut))
                    held = table.slice(cut).combine_chunks().to_batches()
                    size = sum(x.column(4).nbytes for x in held) // 4
        if held:
            yield flush(pa.Table.from_batches(held))

    # Of a frequent anchor's equal windows the earliest stays; other anchors have HOT contexts at most.
    cold, hot = context_rows.filter("NOT hot"), context_rows.filter("hot")
    earliest = hot.groupBy("key", "body").agg(F.min(F.struct("doc", "tie", "at")).alias("first")).select("key", "first.*", "body")
    earliest = cold.select("key", "doc", "tie", "at", "body").unionByName(earliest)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = earliest.repartition(parts, "key").sortWithinPartitions("key")
    firsts = shards.mapInArrow(indexed, "doc long, tie long, at int, mask long")
    firsts = firsts.groupBy("doc", "tie").agg(F.collect_list("at").alias("at"), F.collect_list("mask").alias("mask"))
    firsts = common.written(cands.drop("hot").join(firsts, ["doc", "tie"], "left"), "firsts", most_tasks=n_tasks)
    common.discard(spark, cands, context_rows)

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            plain = b.num_columns == 2
            for row, data, offsets in words.pieces(b.column(1)):
                n_rows = len(offsets) - 1
                word, text, start, end = words.hash_words(data, offsets)
                begins = np.searchsorted(text, np.arange(n_rows + 1))
                gone = np.zeros(len(word), dtype=bool) if plain else _removed(b, row, word, text, begins, window)
                n_words, n_gone = np.diff(begins), np.array([int(gone[begins[i] : begins[i + 1]].sum()) for i in range(n_rows)], dtype=np.int64)
                sha, texts, spans = [], [], []
                for i in range(n_rows):
                    raw = data[offsets[i] : offsets[i + 1]].tobytes()
                    if n_gone[i]:
                        lo, keep = int(offsets[i]), np.flatnonzero(~gone[begins[i] : begins[i + 1]]) + begins[i]
                        raw = b" ".join([raw[s:e] for s, e in zip((start[keep] - lo).tolist(), (end[keep] - lo).tolist(), strict=True)])
                    else:
                        raw = b" ".join(raw.split())
                    sha.append(hashlib.sha256(raw).hexdigest())
                    if with_text:
                        texts.append(raw.decode())
                        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone[begins[i] : begins[i + 1]].view(np.int8), [0]))))
                        spans.append([[int(x), int(y) - 1] for x, y in edge.reshape(-1, 2)])
                columns = [b.column(0).slice(row, n_rows), pa.array(n_words.astype(np.int64)), pa.array(n_gone), pa.array(sha, pa.string())]
                names = ["id", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    columns += [pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int64())))]
                    names += ["kept_text", "spans"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string, spans array<array<long>>" * with_text
    again = common.maybe_marked(rows, F.xxhash64("doc", "tie"), firsts.select(F.xxhash64("doc", "tie")), "__maybe")
    easy = again.filter("NOT __maybe").select("id", "text").mapInArrow(finished, schema)
    hard = again.filter("__maybe").drop("__maybe", FILE, ROW).join(firsts, ["doc", "tie"], "left").select("id", "text", "places", "at", "mask").mapInArrow(finished, schema)
    return easy.unionByName(hard).withColumnRenamed("id", id_col).coalesce(n_tasks)


def _chosen(lists: pa.Array, row: int, n: int, begins: np.ndarray) -> np.ndarray:
    """Places in the piece of the places in the rows' lists."""
    part = lists.slice(row, n)
    counts = np.array([0 if x is None else x for x in pa.compute.list_value_length(part).to_pylist()], dtype=np.int64)
    flat = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat + np.repeat(begins[:-1], counts)


def _removed(b: pa.RecordBatch, row: int, word: np.ndarray, text: np.ndarray, begins: np.ndarray, window: int) -> np.ndarray:
    """Which words of the piece a window covers that also starts earlier."""
    n_rows = len(begins) - 1
    _, place, first, last = anchors(word, text, window)
    use = np.isin(place, _chosen(b.column(2), row, n_rows, begins))
    gone = np.zeros(len(word) + 1, dtype=np.int64)
    np.add.at(gone, first[use], 1)
    np.add.at(gone, last[use] + 1, -1)
    again = np.cumsum(gone[:-1]) > 0  # windows that share an anchor with others
    at = _chosen(b.column(3), row, n_rows, begins)
    mask = b.column(4).slice(row, n_rows).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    for i in range(window - ANCHOR + 1):
        hit = (mask >> i) & 1 == 1
        again[at[hit] + i] = False  # the earliest of its kind
    cover = np.zeros(len(word) + window, dtype=np.int64)
    starts = np.flatnonzero(again)
    cover[starts] += 1
    cover[starts + window] -= 1
    return np.cumsum(cover)[: len(word)] > 0
