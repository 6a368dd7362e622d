"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all benchmark items, texts scanned once.

Texts are normalised to lower-case (A-Z) words. A window is `n` consecutive words of an item, or all words of a shorter
one. The automaton reads words, not characters: each word of the benchmark has a number, any other word is 0, and the
patterns are the windows' numbers, each as two symbols (its high and its low part, so that no node has many children).
Matches are word numbers of the document and, for documents with hits, are mapped to character spans of the original text.

The items go to the executors as a broadcast; each task's worker builds the automaton, of at most WINDOWS windows (about
1,200 bytes each, measured). A larger benchmark is cut into shards by window count, and the documents are scanned once for
each. An item larger than a shard is one on its own.
"""

from __future__ import annotations

import itertools
import re
import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held, packed, slices

WINDOWS = 1 << 17
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
FIELDS = "n_words long, n_hit long, item_ids array<string>, spans array<struct<start:int,end:int>>"
MATCHES = pa.list_(pa.struct([("word", pa.int32()), ("n", pa.int32()), ("item", pa.string())]))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TABLE).split()


class Scanner:
    """The automaton of some items (id, text)."""

    def __init__(self, items: list[tuple[str | None, str]], n: int):
        self.number: dict[bytes, int] = {}
        found: dict[tuple[int, ...], list[str | None]] = {}
        for item, text in items:
            w = [self.number.setdefault(x, len(self.number) + 1) for x in words(text)]
            for window in {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else ():
                found.setdefault(window, []).append(item)
        self.low = max(1, len(self.number).bit_length() // 2)  # bits of a word number's low symbol
        self.least = min(map(len, found), default=0)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, ids in found.items():
            self.automaton.add_word(self.symbols(np.array(window)), (len(window), ids))
        if found:
            self.automaton.make_automaton()

    def symbols(self, numbers: np.ndarray) -> tuple[int, ...]:
        out = np.empty(2 * len(numbers), np.int64)
        out[0::2] = numbers >> self.low
        out[1::2] = (numbers & ((1 << self.low) - 1)) + (1 << 30)  # high and low parts are never the same symbol
        return tuple(out.tolist())

    def __call__(self, w: list[bytes]) -> list[tuple[int, int, str | None]]:
        """(first word, words, item) of every window found in a text's words. Windows have no other words than the
        benchmark's, so only runs of such words are read that are as long as the shortest window."""
        get = self.number.get
        numbers = np.fromiter([get(x, 0) for x in w], np.int64, len(w))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (numbers > 0).view(np.int8), [0]]))).reshape(-1, 2)
        out = []
        for a, b in edge[edge[:, 1] - edge[:, 0] >= self.least].tolist() if self.least else ():
            out += [(a + end // 2 - n + 1, n, item) for end, (n, ids) in self.automaton.iter(self.symbols(numbers[a:b])) for item in ids]
        return out


def scanner(key: tuple[str, int], items: list[tuple[str | None, str]], n: int) -> Scanner:
    """The scanner of a (job, shard); those of other jobs are dropped."""
    return held(f"decontamination {key[0]}", key[1], lambda: Scanner(items, n))


def summary(text: str | None, n_words: int, found: list[tuple[int, int, str | None]]) -> tuple:
    """(n_hit, item_ids, spans in characters of the original text)."""
    hit = np.zeros(n_words + 1, np.int32)
    for word, n, _ in found:
        hit[word] += 1
        hit[word + n] -= 1
    hit = np.cumsum(hit[:-1]) > 0
    raw, spans = text.encode(), []
    at = [m.span() for m in WORD.finditer(raw)]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    for first, stop in edge.reshape(-1, 2).tolist():
        a, b = at[first][0], at[stop - 1][1]
        start = len(raw[:a].decode())
        spans.append({"start": start, "end": start + len(raw[a:b].decode())})
    return int(hit.sum()), sorted({i for _, _, i in found if i is not None}), spans


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 10, shard: int = WINDOWS
) -> DataFrame:
    """docs with n_words, n_hit (words inside any occurrence of a window), item_ids (sorted as strings, of items with
    occurring windows) and spans (of hit words that follow each other, characters, end exclusive).

    Null and empty texts have no words. Items without words have no windows; an item whose id is null marks words but
    is not listed. Repeated rows are treated each; an empty benchmark hits nothing, an empty table stays empty. Very long texts
    are scanned whole, one at a time. Columns of docs with these four names are replaced, all others pass through.
    """
    spark, added = docs.sparkSession, [f.name for f in T.StructType.fromDDL(FIELDS).fields]
    rows, back = packed(docs, text, added)
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("string").alias("text"))
    blanks = F.regexp_count("text", F.lit(r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"))
    size = items.agg(F.sum(F.coalesce(blanks, F.lit(0)) + 1)).first()[0] or 0  # words, and so windows, at most
    shards = max(1, -(-size // shard))
    out, job = rows, uuid.uuid4().hex
    for k in range(shards):
        part = [(r.item, r.text) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == k).collect() if r.text]
        out = _pass(out, spark.sparkContext.broadcast(part), (job, k), n, k > 0, k == shards - 1)
    return out.select(*back(), *added)


def _pass(rows: DataFrame, sent, key: tuple[str, int], n: int, more: bool, last: bool) -> DataFrame:
    """One scan of row, text and, if `more`, the matches so far."""
    kept = rows.schema.fields[:2]
    added = T.StructType.fromDDL(FIELDS if last else "matches array<struct<word:int,n:int,item:string>>").fields
    names = [*(f.name for f in kept), *(f.name for f in added)]

    def run(batches):
        scan = scanner(key, sent.value, n)
        for b in slices(batches, 1, 1 << 22):
            texts = b.column(1).to_pylist()
            before = b.column(2).to_pylist() if more else itertools.repeat([])
            found, count = [], []
            for t, old in zip(texts, before):
                w = words(t)
                count.append(len(w))
                found.append([(x["word"], x["n"], x["item"]) for x in old] + scan(w))
            if last:
                got = [summary(t, c, f) if f else (0, [], []) for t, c, f in zip(texts, count, found)]
                spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                cols = [pa.array(count, pa.int64()), *(pa.array([g[i] for g in got], kind) for i, kind in enumerate((pa.int64(), pa.list_(pa.string()), spans)))]
            else:
                cols = [pa.array([[{"word": w, "n": k, "item": i} for w, k, i in f] for f in found], MATCHES)]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *cols], names)

    return rows.mapInArrow(run, T.StructType([*kept, *added]))


def digests(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
