"""Katz backoff language model over words, trained and evaluated in one exchange of counts.

Tokens are a text's words and one end; the history of a token is the word before it, or the text's start.

    P(w | h) = d(c) c(h, w) / (C(h) + 1)   if the pair was seen c > 0 times in training
               alpha(h) P(w)               otherwise; alpha is 1 for a history that was never seen
    P(w)     = d'(c) c(w) / (N + 1)        for a seen word, the rest of the mass for the one unknown word

d and d' are Good-Turing discounts of counts up to K. Every history keeps one pseudo-count for backoff, so that its mass
never vanishes; alpha(h) = (1 - sum of P(w | h) over seen w) / (1 - sum of P(w) over seen w) makes each distribution
sum to one exactly.

Texts are cut into blocks of about BLOCK tokens; a block's words and distinct pairs go, sorted and packed, to buckets by
hash, which hold the n-gram tables: each adds up the counts of its n-grams and answers every block in the order asked,
so that no key travels back. One block that has a seen pair is its owner and adds it to its history's sums; a second,
smaller exchange by history gives the backoff weights that the blocks ask for. Words are told apart by 64-bit hashes,
pairs by 56 bits of a mixed hash and their bucket, which has bits of another one. Clashes are not looked for: n words have
n**2 / 2**65 expected ones (0.03 at 10**9); a bucket of up to 2**21 pairs has 2**42 / 2**57 = 3 * 10**-5, so 10**12 pairs in
480,000 buckets have about 15, each of which adds one pair's count to another's.

A hot word spreads over all buckets (pairs are dealt by both words), and is one row of a block's word list.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, to_table
from .minhash import mix

BLOCK = 2 << 20  # tokens
BUCKET = 2 << 20  # tokens for each bucket
K = 5
START, END = (np.uint64(xxhash.xxh64_intdigest(x)) for x in (b" start", b" end"))
WORD, PAIR = 0, 1
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def pack(a: np.ndarray) -> bytes:
    """Byte planes of an array, compressed."""
    a = np.ascontiguousarray(a)
    return zstandard.compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes(), 1)


def unpack(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def small(a: np.ndarray) -> np.ndarray:
    """Counts in the fewest bytes."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def pack_counts(a: np.ndarray) -> bytes:
    a = small(a)
    return bytes([a.itemsize]) + pack(a)


def unpack_counts(data: bytes) -> np.ndarray:
    return unpack(data[1:], f"<u{data[0]}").astype(np.int64)


def batch(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, schema, strict=True)], [n for n, _ in schema])


I64, BIN = pa.int64(), pa.binary()
BLOCKS = [("block", I64), ("doc_id", pa.list_(I64)), ("held", pa.list_(pa.bool_())), ("sizes", BIN), ("words", BIN), ("tokens", BIN), ("n", I64), ("n_train", I64)]
ASKS = [("kind", I64), ("bucket", I64), ("block", I64), ("keys", BIN), ("counts", BIN), ("flags", BIN)]
ANSWERS = [("kind", I64), ("bucket", I64), ("block", I64), ("counts", BIN), ("flags", BIN), ("types", I64), ("total", I64), ("seen", pa.list_(I64))]
SUMS = [("kind", I64), ("bucket", I64), ("block", I64), *((c, BIN) for c in ("keys", "mass", "low", "total", "asks")), ("docs", BIN)]
WEIGHTS = [("bucket", I64), ("block", I64), ("alpha", BIN)]
DDL = {pa.int64(): "long", pa.binary(): "binary", pa.list_(I64): "array<long>", pa.list_(pa.bool_()): "array<boolean>"}


def ddl(schema: list[tuple[str, pa.DataType]]) -> str:
    return ", ".join(f"{n} {DDL[t]}" for n, t in schema)


def blocks(docs: DataFrame, doc_id: str, text: str, held_out: Column, size: int) -> DataFrame:
    """Texts as numbers of the block's own words, in the order of the words' hashes."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), held_out.alias("held"))

    def run(batches):
        number: dict[bytes, int] = {}
        ids, held, parts, sizes, made = [], [], [], [], 0

        def close():
            nonlocal number, ids, held, parts, sizes, made
            # END is number len(number)
            h = np.array([xxhash.xxh64_intdigest(w) for w in number] + [END, START], np.uint64)
            words, back = np.unique(h, return_inverse=True)
            seq = np.concatenate(parts)
            seq[seq < 0] = len(number)
            n, keep = len(seq), ~np.array(held)
            row = ((TaskContext.get().partitionId() << 32) + made, ids, held, pack_counts(np.array(sizes)), pack_sorted(words), pack(back[seq].astype(np.uint32)), n, int(keep.sum()))
            number, ids, held, parts, sizes, made = {}, [], [], [], [], made + 1
            return batch(BLOCKS, [row])

        total = 0
        for b in slices(batches, 1, 1 << 22):
            for d, t, is_held in zip(*(c.to_pylist() for c in b.columns), strict=True):
                w = (t or "").encode().lower().split()
                for x in w:
                    if x not in number:
                        number[x] = len(number)
                parts.append(np.fromiter(map(number.__getitem__, w), np.int64, len(w)))
                parts.append(np.array([-1]))
                ids.append(d)
                held.append(is_held)
                sizes.append(len(w) + 1)
                total += len(w) + 1
                if total >= size:
                    total = 0
                    yield close()
        if ids:
            yield close()

    return rows.mapInArrow(run, ddl(BLOCKS))


class Block:
    """A block's words, tokens and distinct pairs."""

    def __init__(self, row: dict):
        self.row = row
        self.words = unpack_sorted(row["words"])
        self.tokens = unpack(row["tokens"], np.uint32).astype(np.int64)
        self.sizes = unpack_counts(row["sizes"])
        self.first = np.cumsum(self.sizes) - self.sizes
        self.held = np.repeat(np.array(row["held"]), self.sizes)
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.first] = np.searchsorted(self.words, START)
        n = len(self.words)
        code, self.pair = np.unique(before * n + self.tokens, return_inverse=True)
        self.h, self.w = code // n, code % n

    def word_asks(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bucket of each word, training counts, whether it is a history in held-out texts); words are in order of hash."""
        counts = np.bincount(self.tokens, ~self.held, len(self.words)).astype(np.int64)
        asked = np.zeros(len(self.words), bool)
        asked[self.h[np.unique(self.pair[self.held])]] = True
        return (mix(self.words) % np.uint64(buckets)).astype(np.int64), counts, asked

    def pair_asks(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(order by bucket and key; bucket, key and training count of each pair, in that order)."""
        a, b = self.words[self.h], self.words[self.w]
        key = mix(a * np.uint64(0x9E3779B97F4A7C15) + b) >> np.uint64(8)
        bucket = (mix(a ^ mix(b + np.uint64(1))) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((key, bucket))
        counts = np.bincount(self.pair, ~self.held, len(self.h)).astype(np.int64)
        return order, bucket[order], key[order], counts[order]


def runs(buckets: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, start, stop) of a sorted array."""
    at = np.append(np.flatnonzero(np.diff(buckets, prepend=-1)), len(buckets)).tolist()
    return [(int(buckets[a]), a, b) for a, b in zip(at, at[1:], strict=False)]


def asks(table: DataFrame, buckets: int) -> DataFrame:
    def run(batches):
        for rows in batches:
            for row in rows.to_pylist():
                b = Block(row)
                bucket, counts, asked = b.word_asks(buckets)
                order = np.argsort(bucket, kind="stable")
                for k, i, j in runs(bucket[order]):
                    o = order[i:j]
                    yield batch(ASKS, [(WORD, k, row["block"], pack_sorted(b.words[o]), pack_counts(counts[o]), pack(np.packbits(asked[o])))])
                _, bucket, key, counts = b.pair_asks(buckets)
                for k, i, j in runs(bucket):
                    yield batch(ASKS, [(PAIR, k, row["block"], pack_sorted(key[i:j]), pack_counts(counts[i:j]), None)])

    return table.mapInArrow(run, ddl(ASKS))


def answer(group: pa.Table) -> pa.Table:
    """One bucket: training counts of its n-grams, in the order of each block's asks, and what discounting needs."""
    rows = sorted(group.to_pylist(), key=lambda r: r["block"])
    kind, bucket = rows[0]["kind"], rows[0]["bucket"]
    keys = [unpack_sorted(r["keys"]) for r in rows]
    n = np.array([len(k) for k in keys])
    _, first, back = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    total = np.bincount(back, np.concatenate([unpack_counts(r["counts"]) for r in rows])).astype(np.int64)
    if kind == WORD:  # a word is a history in some held-out text
        flag = np.concatenate([np.unpackbits(unpack(r["flags"], np.uint8))[:k] for r, k in zip(rows, n, strict=True)])
        flags = (np.bincount(back, flag) > 0)[back]
    else:  # the first block that has a pair owns it
        flags = np.zeros(len(back), bool)
        flags[first] = True
    counts, stop = total[back], np.cumsum(n)
    out = [(kind, bucket, r["block"], pack_counts(counts[b - k : b]), pack(np.packbits(flags[b - k : b])), 0, 0, None) for r, k, b in zip(rows, n.tolist(), stop.tolist(), strict=True)]
    seen = np.bincount(np.minimum(total, K + 2), minlength=K + 3)[1 : K + 2].tolist()
    out.append((kind, bucket, -1, None, None, int((total > 0).sum()), int(total.sum()), seen))
    return pa.Table.from_batches([batch(ANSWERS, out)])


def discounts(seen: list[int]) -> np.ndarray:
    """Katz's Good-Turing discounts of counts 0 to K from the numbers of n-grams seen 1 to K + 1 times; 1 for larger
    counts. K is lowered until all discounts lie in (0, 1]; if none is left, counts stay as they are."""
    out = np.ones(K + 1)
    for k in range(min(K, len(seen) - 1), 0, -1):
        n = [0, *seen]
        if not all(n[1 : k + 2]):
            continue
        common = (k + 1) * n[k + 1] / n[1]
        if common >= 1:
            continue
        d = [((r + 1) * n[r + 1] / (n[r] * r) - common) / (1 - common) for r in range(1, k + 1)]
        if all(0 < x <= 1 for x in d):
            out[1 : k + 1] = d
            break
    return out


class Statistics:
    """What the probabilities need from all training texts."""

    def __init__(self, words: tuple[int, int, list[int]], pairs: tuple[int, int, list[int]]):
        self.types, self.tokens, seen = words
        self.word_discount, self.pair_discount = discounts(seen), discounts(pairs[2])
        kept = sum((1 - self.word_discount[r]) * r * seen[r - 1] for r in range(1, K + 1)) if seen else 0
        self.unknown = (1 + kept) / (self.tokens + 1)

    def word(self, c: np.ndarray) -> np.ndarray:
        p = np.where(c > K, 1.0, self.word_discount[np.minimum(c, K)]) * c / (self.tokens + 1)
        return np.where(c > 0, p, self.unknown)

    def mass(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > K, 1.0, self.pair_discount[np.minimum(c, K)]) * c

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.tokens + 0.1 * (self.types + 1)))


def backoff(mass, low, total):
    """alpha of histories from the discounted mass and the lower-order probability of their seen words, and their count."""
    return (1 - mass / (total + 1)) / (1 - low)


def sums(statistics: Statistics, buckets: int, train_texts: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        b = Block(row)
        answers = {(r["kind"], r["bucket"]): r for r in right.to_pylist()}
        n = len(b.words)
        bucket = (mix(b.words) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        count, asked = np.zeros(n, np.int64), np.zeros(n, bool)
        for k, i, j in runs(bucket[order]):
            count[order[i:j]] = unpack_counts(answers[WORD, k]["counts"])
            asked[order[i:j]] = np.unpackbits(unpack(answers[WORD, k]["flags"], np.uint8))[: j - i]
        place, of, _, _ = b.pair_asks(buckets)
        pairs, own = np.zeros(len(b.h), np.int64), np.zeros(len(b.h), bool)
        for k, i, j in runs(of):
            pairs[place[i:j]] = unpack_counts(answers[PAIR, k]["counts"])
            own[place[i:j]] = np.unpackbits(unpack(answers[PAIR, k]["flags"], np.uint8))[: j - i]
        p1 = statistics.word(count)
        history = count.copy()
        history[np.searchsorted(b.words, START)] = train_texts
        seen = pairs > 0
        mass = statistics.mass(pairs)
        with np.errstate(divide="ignore"):
            logs = np.where(seen, np.log10(mass / (history[b.h] + 1)), np.log10(p1[b.w]))
        token = b.pair
        partial = np.add.reduceat(logs[token], b.first)
        base = np.add.reduceat(statistics.base(count)[b.tokens], b.first)
        known = np.add.reduceat((count[b.tokens] > 0).astype(np.int64), b.first)
        # histories of unseen pairs: their weights are asked for
        open_ = np.flatnonzero(~seen[token])
        wants = np.zeros(n, bool)
        wants[b.h[token[open_]]] = True
        text = np.repeat(np.arange(len(b.sizes)), b.sizes)[open_]
        o = seen & own
        parts = [np.bincount(b.h[o], v[o], n) for v in (mass, p1[b.w], pairs)]
        sends = (asked & (parts[2] > 0)) | wants
        out, turn = [], np.full(n, -1)
        for k, i, j in runs(bucket[order]):
            s = order[i:j][sends[order[i:j]]]
            if len(s):
                out.append((1, k, row["block"], pack_sorted(b.words[s]), pack(parts[0][s]), pack(parts[1][s]), pack_counts(parts[2][s].astype(np.int64)), pack(np.packbits(wants[s])), None))
        wanted = order[wants[order]]
        turn[wanted] = np.arange(len(wanted))  # answers come bucket by bucket, in order of hash
        result = {"partial": partial, "base": base, "known": known, "sizes": b.sizes, "text": text, "turn": turn[b.h[token[open_]]]}
        ids = pa.record_batch([pa.array(row["doc_id"], I64), pa.array(row["held"], pa.bool_())], ["d", "h"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, ids.schema) as w:
            w.write_batch(ids)
        blob = pack_dict({**{k: pack(np.asarray(v)) for k, v in result.items()}, "ids": sink.getvalue().to_pybytes()})
        out.append((0, -1, row["block"], None, None, None, None, None, blob))
        return pa.Table.from_batches([batch(SUMS, out)])

    return run


def pack_dict(parts: dict[str, bytes]) -> bytes:
    head = ";".join(f"{k}={len(v)}" for k, v in parts.items()).encode()
    return len(head).to_bytes(4, "little") + head + b"".join(parts.values())


def unpack_dict(data: bytes) -> dict[str, bytes]:
    n = int.from_bytes(data[:4], "little")
    out, at = {}, 4 + n
    for item in data[4:at].decode().split(";"):
        k, _, size = item.partition("=")
        out[k] = data[at : at + int(size)]
        at += int(size)
    return out


def weights(group: pa.Table) -> pa.Table:
    """One bucket of histories: the backoff weights that each block wants, in its order."""
    rows = group.to_pylist()
    keys = [unpack_sorted(r["keys"]) for r in rows]
    _, back = np.unique(np.concatenate(keys), return_inverse=True)
    mass, low = (np.bincount(back, np.concatenate([unpack(r[c], np.float64) for r in rows])) for c in ("mass", "low"))
    total = np.bincount(back, np.concatenate([unpack_counts(r["total"]) for r in rows]))
    alpha, out, at = backoff(mass, low, total)[back], [], 0
    for r, k in zip(rows, keys, strict=True):
        wants = np.unpackbits(unpack(r["asks"], np.uint8))[: len(k)].astype(bool)
        if wants.any():
            out.append((r["bucket"], r["block"], pack(alpha[at : at + len(k)][wants])))
        at += len(k)
    return pa.Table.from_batches([batch(WEIGHTS, out)])


def finish(tokens: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = unpack_dict(left["docs"][0].as_py())
        ids = pa.ipc.open_stream(parts.pop("ids")).read_all()
        partial, base = (unpack(parts[k], np.float64) for k in ("partial", "base"))
        known, sizes, text, turn = (unpack(parts[k], np.int64) for k in ("known", "sizes", "text", "turn"))
        alpha = [unpack(r["alpha"], np.float64) for r in sorted(right.to_pylist(), key=lambda r: r["bucket"])]
        score = partial + (np.bincount(text, np.log10(np.concatenate(alpha))[turn], len(partial)) if len(text) else 0)
        cols = [ids["d"], ids["h"], pa.array(sizes), pa.array(known), pa.array(np.full(len(sizes), tokens)), pa.array(base), pa.array(score)]
        return pa.Table.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score_texts(docs: DataFrame, held_out: Column, *, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probability) of every whole text.

    The model learns from the texts that aren't held out. Null and empty texts are the end alone. Repeated rows count and
    are scored each; without training texts every token is the unknown word, of probability one; an empty table gives no rows.
    """
    cut = to_table(blocks(docs, doc_id, text, held_out, block), "katz-blocks")
    size = cut.agg(F.sum("n").alias("n"), F.sum("n_train").alias("texts")).first()
    if not size.n:
        return docs.sparkSession.createDataFrame([], OUT)
    buckets = max(1, -(-size.n // bucket))
    tables = to_table(asks(cut, buckets).groupBy("kind", "bucket").applyInArrow(answer, ddl(ANSWERS)), "katz-ngrams")
    seen = [F.sum(F.col("seen")[i]).alias(f"s{i}") for i in range(K + 1)]
    found = {r.kind: (r.types, r.total, [r[f"s{i}"] for i in range(K + 1)]) for r in tables.where("block < 0").groupBy("kind").agg(F.sum("types").alias("types"), F.sum("total").alias("total"), *seen).collect()}
    statistics = Statistics(found[WORD], found[PAIR])
    answers = tables.where("block >= 0").groupBy("block")
    mid = to_table(cut.groupBy("block").cogroup(answers).applyInArrow(sums(statistics, buckets, size.texts), ddl(SUMS)), "katz-sums")
    alpha = mid.where("kind = 1").groupBy("bucket").applyInArrow(weights, ddl(WEIGHTS))
    return mid.where("kind = 0").groupBy("block").cogroup(alpha.groupBy("block")).applyInArrow(finish(statistics.tokens), OUT)
