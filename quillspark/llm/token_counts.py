"""Token counts by finite-state transducers compiled from a byte-level BPE tokenizer file.

Two deterministic transducers run one after the other over whole texts:

1. The splitter reads character classes and marks where pre-tokens start. It has twelve states. Texts are cut into
   chunks of CHUNK characters; each chunk yields its state map (end state for every start state), the maps compose by
   a parallel prefix scan (log2 of the number of chunks), and with the true start state of each chunk known, all
   chunks are run at once and emit their marks.
2. The BPE transducer reads the bytes of a pre-token. Each transition carries the change in the number of tokens:
   +1, 0 or less, as a byte may open a token, extend the last one or join several. The sum along the path is the
   token count. A state is a subset construction over the vocabulary trie: the open trie nodes, each with what the
   token before it forbids to follow and the token count there relative to now. Two tokens may stand side by side
   only if no merge crosses their border in its time, which makes the last token of every prefix unique. Transitions
   are compiled when first met and kept as one dense array; over MAX_STATES, the table is dropped after the slice.

Texts are processed in slices of about SLICE bytes, so memory follows the slice, the table and the longest text.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, slices

CHUNK = 256
STRIDE = 4  # characters that one step of a chunk's state map reads
SLICE = 1 << 20
MAX_STATES = 60_000  # a dense table of 65,536 rows then suffices between slices

# Character classes and states of the splitter.
OTHER, LETTER, NUMBER, SPACE, BLANK, APOSTROPHE, SUFFIX1, R, V, ELL, E, END = range(12)
START, LET, NUM, OTH, SP1, WS1, SPN, WSN, AP, APR, APV, APL = range(12)
BIAS = 128
HERE, BEFORE = 1, 2  # a token starts at this character, at the one before it


@lru_cache(maxsize=1)
def class_ranges() -> tuple[np.ndarray, np.ndarray]:
    """(first code point, class) of each run of code points of one class, as the tokenizers library has them.

    Which code points are letters, numbers or white space depends on the Unicode version built into the library, so its
    pre-tokenizer is asked. It parts a string of all code points where their class changes, and the first of each part tells
    the class: one that stays with a letter, a digit or a sign before it is of that kind, one that stays with none is white
    space. Done once, on the driver; the runs (a few thousand) go to the tasks.
    """
    from tokenizers.pre_tokenizers import ByteLevel

    split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    # ASCII blanks and apostrophes join what follows them; char_classes sets those that matter. Planes 4 to 13 are
    # unassigned, 15 and 16 private; surrogates are in no text.
    asked = [*range(1, 0x20), *range(0x21, 0x27), *range(0x28, 0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xF0000)]
    codes = np.array(asked, np.int64)
    first = codes[[x[1][0] for x in split("".join(map(chr, asked)))]]
    by = np.full(0x110000, OTHER, np.uint8)
    kind_of = np.full(len(first), BLANK, np.uint8)
    for before, kind in (("!", OTHER), ("1", NUMBER), ("a", LETTER)):
        starts = np.zeros(3 * len(first) + 1, bool)
        starts[[x[1][0] for x in split("".join(f"{before}{chr(c)}\n" for c in first))]] = True
        kind_of[~starts[1:-1:3]] = kind
    by[codes] = np.repeat(kind_of, np.diff(np.append(np.searchsorted(codes, first), len(codes))))
    by[[0, 0x20, 0x27]] = OTHER, BLANK, OTHER
    first = np.flatnonzero(np.append(True, by[1:] != by[:-1]))
    return first, by[first]


def char_classes(ranges: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Class of every code point."""
    first, kind = ranges
    by = np.repeat(kind, np.diff(np.append(first, 0x110000)))
    by[ord(" ")] = SPACE
    by[ord("'")] = APOSTROPHE
    for letters, cls in (("stmd", SUFFIX1), ("r", R), ("v", V), ("l", ELL), ("e", E)):
        for x in letters:
            by[ord(x)] = cls
    return by


@lru_cache(maxsize=1)
def splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, marks), each by class * 12 + state."""
    letters = (LETTER, SUFFIX1, R, V, ELL, E)
    fresh = {**dict.fromkeys(letters, LET), NUMBER: NUM, OTHER: OTH, APOSTROPHE: AP, SPACE: SP1, BLANK: WS1}
    to = np.zeros((12, 12), np.uint8)
    mark = np.zeros((12, 12), np.uint8)

    def put(state, cls, nxt, marks=0):
        to[cls, state], mark[cls, state] = nxt, marks

    for state in range(12):
        for cls, nxt in fresh.items():
            put(state, cls, nxt, HERE)
        put(state, END, START, HERE)
    for cls in letters:
        put(LET, cls, LET)
        put(SP1, cls, LET)
        put(SPN, cls, LET, BEFORE)
        put(WSN, cls, LET, HERE | BEFORE)
        for state in (APR, APV, APL):
            put(state, cls, LET, BEFORE)
    put(NUM, NUMBER, NUM)
    put(SP1, NUMBER, NUM)
    put(SPN, NUMBER, NUM, BEFORE)
    put(WSN, NUMBER, NUM, HERE | BEFORE)
    for cls in (OTHER, APOSTROPHE):
        put(OTH, cls, OTH)
        put(SP1, cls, OTH)
        put(SPN, cls, OTH, BEFORE)
        put(AP, cls, OTH)
    put(WSN, OTHER, OTH, HERE | BEFORE)
    put(WSN, APOSTROPHE, AP, HERE | BEFORE)
    for state in (SP1, WS1, SPN, WSN):
        put(state, SPACE, SPN)
        put(state, BLANK, WSN)
    put(AP, SUFFIX1, START)
    put(AP, R, APR)
    put(AP, V, APV)
    put(AP, ELL, APL)
    for state in (APR, APV, APL):
        for cls in (NUMBER, OTHER, APOSTROPHE, SPACE, BLANK, END):
            put(state, cls, to[cls, state], HERE | BEFORE)
    put(APR, E, START)
    put(APV, E, START)
    put(APL, ELL, START)
    return to.ravel(), mark.ravel()


def compose_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan of state maps [chunk, state] under composition, log2(chunks) vector steps."""
    out, reach = maps.copy(), 1
    while reach < len(out):
        out[reach:] = np.take_along_axis(out[reach:], out[:-reach], axis=1)
        reach *= 2
    return out


@lru_cache(maxsize=1)
def stride_maps() -> np.ndarray:
    """State maps of all strings of STRIDE classes, [string, state]."""
    one = splitter()[0].reshape(12, 12)
    out = one
    for _ in range(STRIDE - 1):
        out = one[np.arange(12)[None, :, None], out[:, None, :]].reshape(-1, 12)
    return np.ascontiguousarray(out)


def token_starts(codes: np.ndarray, ends: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Positions where pre-tokens start; the end characters of texts, at `ends`, count as starts too."""
    to, mark = splitter()
    n = len(codes)
    rows = -(-n // CHUNK)
    cls = np.full(rows * CHUNK, END, np.uint8)
    cls[:n] = classes[codes]
    cls[ends] = END
    offset = cls.reshape(rows, CHUNK).T.astype(np.intp)
    words = offset.reshape(-1, STRIDE, rows)
    words = ((words[:, 0] * 12 + words[:, 1]) * 12 + words[:, 2]) * 12 + words[:, 3]
    stride, state = stride_maps(), None
    for w in words:  # maps of all chunks from all states
        state = stride[w] if state is None else stride.ravel().take((w * 12)[:, None] + state)
    begin = np.zeros(rows, np.intp)
    begin[1:] = compose_scan(state)[:-1, START]
    offset *= 12
    marks = np.empty((CHUNK, rows), np.uint8)
    for j in range(CHUNK):
        at = offset[j]
        at += begin
        marks[j], begin = mark.take(at), to.take(at)
    flat = marks.T.ravel()[:n]
    starts = (flat & HERE).astype(bool)
    starts[:-1] |= (flat[1:] & BEFORE) > 0
    return np.flatnonzero(starts)


class BpeTransducer:
    """Byte transducer whose transitions carry changes of the token count, compiled as it is used."""

    def __init__(self, path: str, ids: bool = False, ranges: tuple[np.ndarray, np.ndarray] | None = None):
        self.with_ids = ids  # states then also tell the last token
        self.classes = char_classes(ranges or class_ranges())
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.specials = [t["content"] for t in model["added_tokens"]]
        self.special_ids = {t["content"]: t["id"] for t in model["added_tokens"]}
        model = model["model"]
        to_byte = {c: b for b, c in byte_letters().items()}
        names = {v: bytes(to_byte[c] for c in k) for k, v in model["vocab"].items() if all(c in to_byte for c in k)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        raw = lambda s: bytes(to_byte[c] for c in s)
        number = {v: k for k, v in names.items()}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token -> rank of its merge, left and right part
        self.after: dict[int, list[tuple[int, int]]] = {}  # left part -> right parts and ranks
        for rank, (a, b) in enumerate(merges):
            x, y = raw(a), raw(b)
            if x + y in number and x in number and y in number:
                self.parts.setdefault(number[x + y], (rank, number[x], number[y]))
                self.after.setdefault(number[x], []).append((number[y], rank))
        self.names = names
        self.size = np.zeros(max(names) + 1, np.int64)
        for t, x in names.items():
            self.size[t] = len(x)
        self.child: dict[int, int] = {}
        self.path, self.token, self.inner = [b""], [-1], [True]
        for t, s in names.items():
            if t not in self.parts and len(s) > 1:
                continue  # no merge makes it
            node = 0
            for b in s:
                self.inner[node] = True
                nxt = self.child.get(node << 8 | b)
                if nxt is None:
                    nxt = self.child[node << 8 | b] = len(self.token)
                    self.path.append(self.path[node] + bytes([b]))
                    self.token.append(-1)
                    self.inner.append(False)
                node = nxt
            self.token[node] = t
        self.reset()

    def reset(self) -> None:
        self.blocks: list[dict[int, int]] = [{}]  # right tokens that the last token would merge with -> rank
        self.block_ids: dict[frozenset, int] = {frozenset(): 0}
        self.last_block: dict[int, int] = {}
        self.by_byte: dict[int, dict[int, int]] = {}
        self.narrowed: dict[tuple[int, int], int] = {}
        self.states = [((0, 0, 0),)]
        self.last = np.zeros(1 << 11, np.int32)  # last token of the prefix that led to a state
        self.ids = {self.states[0]: 0}
        self.step = np.full(1 << 19, -1, np.int32)  # next state << 8 | change of the count + BIAS

    def intern(self, block: dict[int, int]) -> int:
        key = frozenset(block.items())
        known = self.block_ids.get(key)
        if known is None:
            known = self.block_ids[key] = len(self.blocks)
            self.blocks.append(block)
        return known

    def block_of(self, last: int) -> int:
        """What may not follow `last`: its right edge over time, and the merges across it that come before the edge changes."""
        known = self.last_block.get(last)
        if known is None:
            block: dict[int, int] = {}
            edge, until = last, 1 << 30
            while True:
                for right, rank in self.after.get(edge, ()):
                    if rank < until and rank < block.get(right, 1 << 30):
                        block[right] = rank
                if edge not in self.parts:
                    break
                until, _, edge = self.parts[edge]
            known = self.last_block[last] = self.intern(block)
        return known

    def fits(self, block: dict[int, int], t: int) -> bool:
        """Whether t stays whole after a token with this block: no part on its left edge merges leftwards in its time."""
        edge, until = t, 1 << 30
        while True:
            if block.get(edge, 1 << 31) <= until:
                return False
            if edge not in self.parts:
                return True
            until, edge, _ = self.parts[edge]

    def narrow(self, block: int, node: int) -> int:
        """The part of a block that can matter for tokens below a trie node."""
        path, names = self.path[node], self.names
        if len(path) == 1:
            parts = self.by_byte.get(block)
            if parts is None:
                split: dict[int, dict[int, int]] = {}
                for r, k in self.blocks[block].items():
                    split.setdefault(names[r][0], {})[r] = k
                parts = self.by_byte[block] = {b: self.intern(x) for b, x in split.items()}
            return parts.get(path[0], 0)
        known = self.narrowed.get((block, node))
        if known is None:
            kept = {r: k for r, k in self.blocks[block].items() if path.startswith(names[r]) or names[r].startswith(path)}
            known = self.narrowed[block, node] = self.intern(kept)
        return known

    def compile(self, key: int) -> None:
        """The transition for key = state << 8 | byte."""
        byte, found, change, opened = key & 255, -1, 0, []
        for node, block, ago in self.states[key >> 8]:
            child = self.child.get(node << 8 | byte)
            if child is None:
                continue
            t = self.token[child]
            if found < 0 <= t and self.fits(self.blocks[block], t):
                found, change = t, ago + 1
            if self.inner[child]:
                opened.append((child, self.narrow(block, child) if block else 0, ago))
        state = (*((n, p, a - change) for n, p, a in opened), (0, self.block_of(found), 0))
        name = (state, found) if self.with_ids else state
        nxt = self.ids.get(name)
        if nxt is None:
            nxt = self.ids[name] = len(self.states)
            self.states.append(state)
            if nxt == len(self.last):
                self.last = np.concatenate([self.last, self.last])
            self.last[nxt] = found
            if len(self.states) << 8 > len(self.step):
                self.step = np.concatenate([self.step, np.full(len(self.step), -1, np.int32)])
        self.step[key] = nxt << 8 | change + BIAS

    def count(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray, trace: np.ndarray | None = None) -> np.ndarray:
        """Tokens of each pre-token data[begin : begin + length]; all pre-tokens advance together.

        trace: gets, at each byte, the last token of the pre-token up to it (of a machine with ids).
        """
        order = np.argsort(-length, kind="stable")
        at, left = begin[order], length[order]
        alive = len(left) - np.searchsorted(left[::-1], np.arange(1, left[0] + 1 if len(left) else 1), "left")
        state, total = np.zeros(len(left), np.int32), np.zeros(len(left), np.int32)
        for n in alive.tolist():
            key = state[:n] | data.take(at[:n])
            value = self.step.take(key)
            if value.min() < 0:
                for k in np.unique(key[value < 0]).tolist():
                    self.compile(k)
                value = self.step.take(key)
            if trace is not None:
                trace[at[:n]] = self.last.take(value >> 8)
            at[:n] += 1
            total[:n] += value & 255
            np.bitwise_and(value, -256, out=state[:n])
        out = np.empty_like(total)
        out[order] = total - BIAS * left
        return out


    def emit(self, begin: np.ndarray, length: np.ndarray, count: np.ndarray, trace: np.ndarray) -> np.ndarray:
        """The tokens of all pre-tokens, from a trace: walk back from each end by the length of the last token."""
        order = np.argsort(-count, kind="stable")
        place = (np.cumsum(count) - 1)[order]
        at, left = (begin + length - 1)[order], count[order]
        alive = len(left) - np.searchsorted(left[::-1], np.arange(1, left[0] + 1 if len(left) else 1), "left")
        out = np.empty(int(count.sum()), np.int32)
        for n in alive.tolist():
            t = trace.take(at[:n])
            out[place[:n]] = t
            at[:n] -= self.size.take(t)
            place[:n] -= 1
        return out


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}


def machine(path: str, ids: bool = False, ranges: tuple[np.ndarray, np.ndarray] | None = None) -> BpeTransducer:
    return held("tokens", (path, ids), lambda: BpeTransducer(path, ids, ranges))


def pre_tokens(texts: list[str | None], m: BpeTransducer):
    """(bytes, starts, lengths, first pre-token of each piece and the end, owner of each piece) of texts cut at special tokens."""
    pieces, owner = [], []
    for i, text in enumerate(texts):
        parts = [text or ""]
        for s in m.specials:
            parts = [y for x in parts for y in x.split(s)] if s in parts[0] or len(parts) > 1 else parts
        pieces += parts
        owner += [i] * len(parts)
    joined = "\n".join(pieces) + "\n"
    ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    raw = np.frombuffer(joined.encode("utf-8"), np.uint8)
    starts = token_starts(codes, ends, m.classes)
    if len(raw) != len(codes):
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        starts, ends = lead[starts], lead[ends]
    length = np.diff(np.append(starts, len(raw)))
    real = np.ones(len(starts), bool)
    real[np.searchsorted(starts, ends)] = False
    starts, length = starts[real], length[real]
    return raw, starts, length, np.append(0, np.searchsorted(starts, ends)), np.array(owner)


def count_texts(texts: list[str | None], m: BpeTransducer) -> np.ndarray:
    """Token counts of texts (None: empty); a special token's string counts as one token, as the library does."""
    raw, starts, length, cuts, owner = pre_tokens(texts, m)
    total = np.append(0, np.cumsum(m.count(raw, starts, length), dtype=np.int64))
    if len(m.states) > MAX_STATES:
        m.reset()
    pieces = np.bincount(owner, minlength=len(texts))
    return pieces - 1 + np.bincount(owner, np.diff(total[cuts]), len(texts)).astype(np.int64)


def encode_texts(texts: list[str | None], m: BpeTransducer) -> list[np.ndarray]:
    """Token ids of texts (None: empty), with special tokens' strings as the library has them by default."""
    raw, starts, length, cuts, owner = pre_tokens(texts, m)
    trace = np.empty(len(raw), np.int32)
    n = m.count(raw, starts, length, trace)
    ids = m.emit(starts, length, n, trace)
    if len(m.states) > MAX_STATES:
        m.reset()
    bounds = np.append(0, np.cumsum(n, dtype=np.int64))[cuts]
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for i, text in enumerate(texts):
        a, b = first[i], first[i + 1]
        if b - a == 1:
            out.append(ids[bounds[a] : bounds[b]])
            continue
        parts, rest = [], text
        for k in range(a, b):
            parts.append(ids[bounds[k] : bounds[k + 1]])
            if k + 1 < b:
                at, s = min((rest.find(s), s) for s in m.specials if s in rest)
                rest = rest[at + len(s) :]
                parts.append(np.array([m.special_ids[s]], np.int32))
        out.append(np.concatenate(parts))
    return out


def count_tokens(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every whole text.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows are counted each, ids may be null, other columns are
    ignored whatever their names, an empty table gives an empty result. A very long text is one slice of its own. `path`: a byte-level BPE file of the tokenizers library.
    """
    ranges = class_ranges()

    def run(batches):
        m = machine(path, ranges=ranges)
        for b in slices(batches, 1, SLICE):
            texts = b.column(1).to_pylist()
            n = count_texts(texts, m)
            size = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
