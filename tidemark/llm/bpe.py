"""Byte-pair encoding and decoding with merges over contiguous arrays of ranks.

A short word is two parallel arrays: the ids of its parts and the ranks of its adjacent pairs. The arrays are
scanned for the least rank, the boundary there is deleted, and the ranks of its two neighbours are refreshed,
until no pair has a rank. Words of more than LONG parts take a heap over linked parts instead, which gives
the same merges without the quadratic scans.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .unicode_tables import LATE_MARKS, LETTERS, LOWER, NUMBERS, SPACES

NONE = 1 << 60
LONG = 512
#: Unicode white space. str.split() also splits at U+001C to U+001F, which are none.
_SPACE = re.compile(f"[{SPACES}]+")
_ODD = re.compile("[\x1c-\x1f]")
_LATE_MARK = re.compile(f"([{LATE_MARKS}])")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Memo(dict):
    """What a function made of short keys: the newest most ones, and those that were newest before them."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = got
        return got


def _known(split: str | None) -> bool:
    """Whether a pattern has no classes but letters, numbers and white space, each within brackets."""
    plain = re.sub(r"\\p\{[LN]\}|\\s", "", "".join(re.findall(r"\[[^\]]*\]", split or "")))
    return split is not None and "\\" not in plain + re.sub(r"\[[^\]]*\]", "", split)


def _normal(text: str) -> str:
    """NFC in which late marks neither move nor compose."""
    if text.isascii():
        return text
    return "".join([unicodedata.normalize("NFC", x) for x in _LATE_MARK.split(text)])


def _check(data: dict) -> None:
    """ValueError where a tokenizer's file asks for another normalisation, split or merging than is done here."""
    model, steps, cuts = data["model"], (data.get("normalizer") or {}).get("normalizers"), (data.get("pre_tokenizer") or {}).get("pretokenizers")
    fields = {
        "normalizer": [x["type"] for x in steps or []] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " ",
        "pre_tokenizer": [x["type"] for x in cuts or []] == ["Split", "ByteLevel"] and _known(cuts[0]["pattern"].get("Regex")) and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"] and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"],
        "model": model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")),
        "added_tokens": not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in data["added_tokens"]),
        "decoder": data.get("decoder") is None,
    }
    if wrong := [k for k, fine in fields.items() if not fine]:
        raise ValueError(f"a tokenizer of another kind: {', '.join(wrong)}")


class WordBpe:
    """A tokenizer of words from a tokenizers JSON: NFC, one space for white space, lower case, words that end in a mark."""

    def __init__(self, spec: str, cache_words: int = 120_000):
        data = json.loads(spec)
        _check(data)
        model = data["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.end = model["end_of_word_suffix"] or ""
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        split = data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = re.compile(split.replace(r"\p{L}", LETTERS).replace(r"\p{N}", NUMBERS).replace(r"\s", SPACES))
        self.letters = _byte_letters()
        top = max([*self.vocab.values(), *self.special.values()]) + 1
        self.table = [b""] * top
        for word, i in [*self.vocab.items(), *self.special.items()]:
            self.table[i] = word.encode()
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.marks = sorted({s[:2] for s in self.special})
        self.chunks = Memo(self.chunk, cache_words)
        self.words = Memo(self.word, cache_words)

    def merge(self, ids: list[int]) -> list[int]:
        """The parts of one word after all merges, the least rank first and the leftmost of equal ranks."""
        if len(ids) > LONG:
            return self._merge_long(ids)
        pairs = self.pairs
        none = (NONE, 0)
        ranks = [pairs.get(p, none)[0] for p in zip(ids, ids[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            ids[i] = pairs[ids[i], ids[i + 1]][1]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = pairs.get((ids[i - 1], ids[i]), none)[0]
            if i < len(ranks):
                ranks[i] = pairs.get((ids[i], ids[i + 1]), none)[0]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, pairs = len(ids), self.pairs
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(p[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (p := pairs.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = pairs[a, b][1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and (y := after[x]) >= 0 and (p := pairs.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (p[0], x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def word(self, word: str) -> bytes:
        """The ids of one word of the split, as little-endian 32-bit integers."""
        letters, vocab = self.letters, self.vocab
        parts = [letters[b] for b in word.encode()]
        parts[-1] += self.end
        return b"".join([i.to_bytes(4, "little") for i in self.merge([vocab[p] for p in parts if p in vocab])])

    def chunk(self, chunk: str) -> bytes:
        """The ids of a text without white space."""
        if chunk.isascii():
            norm = chunk.lower()
            if norm.isalpha():  # what the split would give
                return self.words[norm]
            if norm[:-1].isalpha() and not norm[-1].isdigit():
                return self.words[norm[:-1]] + self.words[norm[-1]]
        else:
            norm = _normal(chunk).translate(LOWER).replace("Σ", "σ").lower()  # a sigma at a word's end too
        return b"".join(map(self.words.__getitem__, self.split.findall(norm)))

    def _plain(self, text: str) -> bytes:
        chunks = [c for c in _SPACE.split(text) if c] if _ODD.search(text) else text.split()
        return b"".join(map(self.chunks.__getitem__, chunks))

    def encode(self, text: str) -> bytes:
        """The ids of a whole text; special tokens that stand in it are found first."""
        if not any(m in text for m in self.marks):
            return self._plain(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self._plain(text[at : m.start()]), self.special[m.group()].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> bytes:
        """The tokens of the ids with a space between, in UTF-8; special tokens stay."""
        return b" ".join([self.table[i] for i in memoryview(ids).cast("I")])


_LOADED: dict[int, WordBpe] = {}


def _tokenizer(spec) -> WordBpe:
    """One tokenizer with its cache per worker process and broadcast."""
    key = hash(spec.value)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordBpe(spec.value)
    return _LOADED[key]


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The id column, n_tokens, ids_sha256, decoded_sha256 for each row of docs, and with_ids: ids and decoded.

    A null text is empty and has no tokens. Rows that repeat are encoded each; an empty table gives no rows;
    other columns, whatever their names, are ignored. The driver reads the tokenizer's file and broadcasts it
    (a vocabulary of fixed size), so executors need no copy. Texts pass whole, in small batches. A tokenizer of
    another kind is an error.
    """
    import hashlib

    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(spec)
        for batch in batches:
            n, ids_sha, text_sha, ids_all, texts = [], [], [], [], []
            for text in batch.column(1):
                ids = t.encode(text.as_py() or "")
                decoded = t.decode(ids)
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    ids_all.append(list(memoryview(ids).cast("I")))
                    texts.append(decoded.decode())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(ids_all, pa.list_(pa.int64())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"id {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * with_ids
    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(run, schema).withColumnRenamed("id", id_col)
