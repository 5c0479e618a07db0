"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding by offsets."""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.common import documents, packed, runs, unused

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Pre-tokens that a worker remembers; beyond, it starts anew.
CACHE = 600_000
#: Longer pre-tokens merge through a heap.
LONG = 200
NONE = 1 << 30

# Code point classes of the pattern.
LETTER, NUMBER, OTHER, SPACE, BLANK = range(5)
# What a text's next code point is to the automaton.  The last blank before a non-blank stands apart from
# those before it; an apostrophe that a contraction's letters follow can open one of two or three code points.
SYM_LETTER, SYM_NUMBER, SYM_OTHER, SYM_TWO, SYM_THREE, SYM_LAST_SPACE, SYM_LAST_BLANK, SYM_BLANK = range(8)
# The token under way: none, letters, numbers, others, one or two letters of a contraction to come, a
# space that the next token may take in, blanks.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, ONE_MORE, TWO_MORE, PENDING, IN_BLANKS = range(8)


def step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a token starts with this code point."""
    if symbol == SYM_LETTER:
        if state == TWO_MORE:
            return ONE_MORE, False
        if state == ONE_MORE:
            return FRESH, False
        return IN_LETTERS, state not in (IN_LETTERS, PENDING)
    if symbol == SYM_NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, PENDING)
    if symbol in (SYM_OTHER, SYM_TWO, SYM_THREE):
        if state in (IN_OTHERS, PENDING):
            return IN_OTHERS, False
        return {SYM_OTHER: IN_OTHERS, SYM_TWO: ONE_MORE, SYM_THREE: TWO_MORE}[symbol], True
    if symbol == SYM_LAST_SPACE:
        return PENDING, True
    if symbol == SYM_LAST_BLANK:
        return FRESH, True
    return IN_BLANKS, state != IN_BLANKS


@lru_cache(None)
def classes() -> np.ndarray:
    """Class of each code point, from the Unicode database and its White_Space property."""
    table = np.full(0x110000, OTHER, np.uint8)
    kinds = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
    kinds = np.array(kinds)
    table[kinds == "L"] = LETTER
    table[kinds == "N"] = NUMBER
    table[[*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = BLANK
    table[0x20] = SPACE
    return table


@lru_cache(None)
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All functions from state to state that sequences of code points compute.

    Returns their values (function, state), their composition table (first, second), and the
    starts (state, symbol).  Functions 0-7 are those of the symbols, 8-15 those of the symbols
    at the start of a text, which forget the state.
    """
    made = [tuple(step(s, x)[0] for s in range(8)) for x in range(8)] + [(step(FRESH, x)[0],) * 8 for x in range(8)]
    base, known = list(made), {f: i for i, f in reversed(list(enumerate(made)))}
    for f in made:
        for g in base:
            h = tuple(g[s] for s in f)
            if h not in known:
                known[h] = len(made)
                made.append(h)
    values = np.array(made, np.uint8)
    compose = np.array([[known[tuple(g[s] for s in f)] for g in made] for f in made], np.uint16)
    starts = np.array([[step(s, x)[1] for x in range(8)] for s in range(8)], bool)
    return values, compose, starts


def scan(functions: np.ndarray, block: int = 128) -> np.ndarray:
    """Inclusive prefix compositions: blocks scan side by side, then the scan of their totals joins them."""
    _, compose, _ = monoid()
    if len(functions) <= block:
        out = functions.copy()
        for i in range(1, len(out)):
            out[i] = compose[out[i - 1], out[i]]
        return out
    n, size = len(functions), len(compose)
    flat, columns = compose.reshape(-1), -(-n // block)
    grid = np.zeros(columns * block, np.uint16)
    grid[:n] = functions
    grid = np.ascontiguousarray(grid.reshape(columns, block).T)
    for j in range(1, block):
        grid[j] = flat[grid[j - 1].astype(np.int32) * size + grid[j]]
    before = scan(grid[-1])[:-1]
    grid[:, 1:] = flat[before.astype(np.int32)[None, :] * size + grid[:, 1:]]
    return np.ascontiguousarray(grid.T).reshape(-1)[:n]


def boundaries(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places in ``points`` (code points of texts one after another) where a token starts; ``first``: where the texts do."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    values, _, starts = monoid()
    kind = classes()[points]
    opens = np.zeros(n + 1, bool)
    opens[first] = True
    opens[n] = True
    blank = kind >= SPACE
    after = np.zeros(n, bool)
    after[:-1] = ~blank[1:] & ~opens[1:n]
    symbol = np.array([SYM_LETTER, SYM_NUMBER, SYM_OTHER, SYM_BLANK, SYM_BLANK], np.uint8)[kind]
    symbol[blank & after] = np.where(kind[blank & after] == SPACE, SYM_LAST_SPACE, SYM_LAST_BLANK)
    marks = np.flatnonzero(points == 0x27)
    if len(marks):
        wide = np.concatenate([points, np.zeros(2, points.dtype)])
        one, two = wide[marks + 1], wide[marks + 2]
        inside = ~opens[marks + 1]
        symbol[marks[inside & np.isin(one, [ord(c) for c in "stmd"])]] = SYM_TWO
        pair = np.zeros(len(marks), bool)
        for a, b in ("re", "ve", "ll"):
            pair |= (one == ord(a)) & (two == ord(b))
        symbol[marks[inside & pair & ~opens[np.minimum(marks + 2, n)]]] = SYM_THREE
    prefix = scan(symbol.astype(np.uint16) + 8 * opens[:n])
    state = np.empty(n, np.uint8)
    state[0] = FRESH
    state[1:] = values[prefix[:-1], FRESH]
    return np.flatnonzero(opens[:n] | starts[state, symbol])


def looked_up(words: list[str], seen: dict, make) -> list:
    """What ``make`` makes of each pre-token's bytes, from memory where it can; long ones aren't remembered."""
    found = list(map(seen.get, words))
    if None in found:
        for i, known in enumerate(found):
            if known is None:
                known = seen.get(words[i])
                if known is None:
                    if len(seen) >= CACHE:
                        seen.clear()
                    known = make(words[i].encode())
                    if len(words[i]) <= LONG:
                        seen[words[i]] = known
                found[i] = known
    return found


class Tokenizer:
    """Ranks of one vocabulary, and the tokens of pre-tokens seen lately."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pieces: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.pieces[rank] = piece
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)
        self.names = [str(i) for i in range(len(self.pieces))]
        self.seen: dict[str, tuple[int, ...]] = {}

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """Merge the adjacent pair of lowest rank, the leftmost of equals, until none has a rank."""
        ranks = self.ranks
        if piece in ranks:
            return (ranks[piece],)
        if len(piece) > LONG:
            return self.merged_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(parts[i] + parts[i + 1], NONE) for i in range(len(parts) - 1)]
        while pairs and (low := min(pairs)) < NONE:
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], NONE)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], NONE)
        return tuple([ranks[p] for p in parts])

    def merged_long(self, piece: bytes) -> tuple[int, ...]:
        """The same by a heap of pairs over a linked list, for time n log n."""
        ranks, n = self.ranks, len(piece)
        end, back, gone = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n)
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2], NONE)) < NONE]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if gone[i] or j >= n or end[j] != stop or j == stop:
                continue
            gone[j] = 1
            end[i] = stop
            if stop < n:
                back[stop] = i
                if (r := ranks.get(piece[i : end[stop]], NONE)) < NONE:
                    heapq.heappush(heap, (r, i, end[stop]))
            h = back[i]
            if h >= 0 and (r := ranks.get(piece[h:stop], NONE)) < NONE:
                heapq.heappush(heap, (r, h, stop))
        return tuple([ranks[piece[i : end[i]]] for i in range(n) if not gone[i]])

    def words(self, texts: list[str]) -> tuple[list[str], list[int]]:
        """The pre-tokens of all texts, and how many come before each text and the end."""
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=at[1:])
        cuts = boundaries(points, at[:-1][np.diff(at) > 0])
        edges = [*cuts.tolist(), len(whole)]
        return [whole[a:b] for a, b in zip(edges, edges[1:])], np.searchsorted(cuts, at).tolist()

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        words, bounds = self.words(texts)
        found = looked_up(words, self.seen, self.merged)
        return [list(chain.from_iterable(found[a:b])) for a, b in zip(bounds, bounds[1:])]

    def ends(self, ids: list[int]) -> np.ndarray:
        """Where each token ends in its text's bytes."""
        return np.cumsum(self.lengths[ids]) if ids else np.zeros(0, np.int64)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


@lru_cache(4)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def encoded(text: Column, path: str = RANKS) -> Column:
    """struct(ids, ends): a text's token ids and the byte offset at which each ends; none for null and empty texts."""
    kind = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.LongType()))])

    @F.arrow_udf(kind)
    def encode(column: pa.Array) -> pa.Array:
        bpe = tokenizer(path)
        ids = [x for texts in runs(column) for x in bpe.encode(texts.to_pylist())]
        counts = np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(counts.sum()))
        ends = np.concatenate([bpe.ends(x) for x in ids] or [np.zeros(0, np.int64)])
        return pa.StructArray.from_arrays([packed(flat, counts, pa.int32()), packed(ends, counts, pa.int64())], ["ids", "ends"])

    return encode.asNondeterministic()(text.cast("string"))


def decoded(ids: Column, path: str = RANKS) -> Column:
    """The bytes that the ids stand for; null ids give none."""

    @F.arrow_udf(T.BinaryType())
    def decode(column: pa.Array) -> pa.Array:
        bpe = tokenizer(path)
        return pa.array([bpe.decode(x or []) for x in column.to_pylist()], pa.binary())

    return decode(ids)


def round_trip(text: Column, path: str = RANKS) -> Column:
    """struct(n_tokens, ids_sha256, decoded_sha256): digests of a text's ids and of what they decode to, computed where the ids are."""
    kind = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    @F.arrow_udf(kind)
    def digest(column: pa.Array) -> pa.Array:
        bpe, rows = tokenizer(path), []
        for texts in runs(column):
            for ids in bpe.encode(texts.to_pylist()):
                rows.append((len(ids), hashlib.sha256(" ".join(map(bpe.names.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))], [f.name for f in kind.fields])

    return digest.asNondeterministic()(text.cast("string"))


def tokenized(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """Each row's columns but for the text, with n_tokens, ids and ends instead.

    Whole texts are encoded, row by row, without a shuffle.  Null and empty texts have no tokens;
    repeated rows repeat.  A column of ``docs`` named n_tokens, ids or ends is replaced.
    """
    into = unused(docs, "tokens")
    rest = [c for c in docs.columns if c.lower() not in ("text", "n_tokens", "ids", "ends")]
    t = F.col(into)
    return docs.withColumn(into, encoded(F.col("text"), path)).select(*rest, F.size(t["ids"]).cast("long").alias("n_tokens"), t["ids"].alias("ids"), t["ends"].alias("ends"))


def op6_byte_bpe(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", round_trip(F.col("text")).alias("t")).select("doc_id", "t.*")


QUERIES = {"op6_byte_bpe": op6_byte_bpe}
