"""Byte-level BPE encoding and decoding.

Pre-tokenisation uses no regular expression.  Each code point gets a symbol
from a class table and its neighbours (letter, number, other, apostrophe that
opens a contraction, white space by its place in its run).  A symbol is a
transition function on eight states; functions compose associatively, so the
text is cut in columns whose functions are composed side by side, the column
functions are joined by a prefix scan, and a second pass marks the positions
where a token starts.  The slices between marks go through a cached pair
merge by rank.

Rows: null text counts as empty; an empty text has no tokens and decodes to
no bytes.  Repeated rows are encoded each on their own.  Only the named text
column is read, so further columns of any name pass through or are ignored.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import row_chunks, text_chunks, with_fields

# code point classes
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
# symbols
S_LETTER, S_NUMBER, S_OTHER, S_APOS1, S_APOS2, S_WS_RUN, S_WS_BLANK, S_WS_LONE, S_BREAK = range(9)
# states: nothing open; letters; numbers; others; white space; blank waiting for its word; one or two contraction letters to come
FREE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACE, BLANK, ONE_LEFT, TWO_LEFT = range(8)
N_STATES, N_SYMBOLS = 8, 9
COLUMN = 64
#: Pieces of up to so many bytes are merged over lists; the rank of a pair that has none.
SHORT, NO_RANK = 48, 1 << 40
#: Bytes of text that a task encodes at a time, and tokens that it decodes at a time.
CHUNK, TOKENS = 1 << 20, 1 << 18

#: White space of the split pattern; fixed values of the Unicode property.
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def code_point_classes() -> np.ndarray:
    """Class of every code point, by its general category."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), dtype=np.uint8, count=0x110000)
    table[WHITE_SPACE] = SPACE
    return table


@lru_cache(maxsize=1)
def transitions() -> tuple[np.ndarray, np.ndarray]:
    """Next state and start mark, both flat and indexed by ``symbol * N_STATES + state``."""
    nxt = np.zeros((N_SYMBOLS, N_STATES), dtype=np.uint8)
    mark = np.ones((N_SYMBOLS, N_STATES), dtype=bool)
    for symbol, run in ((S_LETTER, IN_LETTERS), (S_NUMBER, IN_NUMBERS), (S_OTHER, IN_OTHERS)):
        nxt[symbol] = run
        mark[symbol, [run, BLANK]] = False
    nxt[S_LETTER, TWO_LEFT], nxt[S_LETTER, ONE_LEFT] = ONE_LEFT, FREE
    mark[S_LETTER, [TWO_LEFT, ONE_LEFT]] = False
    for symbol, left in ((S_APOS1, ONE_LEFT), (S_APOS2, TWO_LEFT)):
        nxt[symbol] = left
        nxt[symbol, [IN_OTHERS, BLANK]] = IN_OTHERS
        mark[symbol, [IN_OTHERS, BLANK]] = False
    nxt[S_WS_RUN] = IN_SPACE
    mark[S_WS_RUN, IN_SPACE] = False
    nxt[S_WS_BLANK] = BLANK
    nxt[S_WS_LONE] = FREE
    nxt[S_BREAK] = FREE
    return nxt.ravel(), mark.ravel()


def symbols(points: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Symbol of each code point; ``breaks`` are the positions between texts."""
    kind = code_point_classes()[points]
    after = np.full(len(points) + 3, SPACE, dtype=np.uint8)
    after[: len(points)] = kind
    after[breaks] = SPACE
    lut = np.array([S_OTHER, S_LETTER, S_NUMBER, S_WS_RUN], dtype=np.uint8)
    out = lut[kind]
    spaces = np.flatnonzero(kind == SPACE)
    last = spaces[after[spaces + 1] != SPACE]
    out[last] = np.where(points[last] == 0x20, S_WS_BLANK, S_WS_LONE)
    quotes = np.flatnonzero(points == 0x27)
    if len(quotes):
        padded = np.append(points, np.zeros(2, dtype=points.dtype))
        padded[breaks] = 0
        one, two = padded[quotes + 1], padded[quotes + 2]
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        out[quotes[single]] = S_APOS1
        out[quotes[double]] = S_APOS2
    out[breaks] = S_BREAK
    return out


def token_starts(symbol: np.ndarray) -> np.ndarray:
    """Start mark of every position, by a prefix scan of transition functions."""
    nxt, mark = transitions()
    n = len(symbol)
    if not n:
        return np.zeros(0, dtype=bool)
    m = -(-n // COLUMN)
    grid = np.full(m * COLUMN, S_BREAK, dtype=np.uint8)
    grid[:n] = symbol
    grid = np.ascontiguousarray(grid.reshape(m, COLUMN).T) * np.uint8(N_STATES)
    # the function of each column: where each of the states ends up
    fun = np.repeat(np.arange(N_STATES, dtype=np.uint8)[:, None], m, axis=1)
    for row in grid:
        fun = nxt[row[None, :] + fun]
    # inclusive prefix composition over the columns, by doubling
    step = 1
    while step < m:
        joined = fun.copy()
        joined[:, step:] = np.take_along_axis(fun[:, step:], fun[:, :-step], axis=0)
        fun, step = joined, step * 2
    state = np.zeros(m, dtype=np.uint8)
    state[1:] = fun[FREE, :-1]
    marks = np.empty((COLUMN, m), dtype=bool)
    for j, row in enumerate(grid):
        at = row + state
        marks[j] = mark[at]
        state = nxt[at]
    return marks.T.reshape(-1)[:n]


def split_texts(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one string, the starts and ends of its pre-tokens, and the token count of each text."""
    whole = "\n".join(texts)
    points = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)
    breaks = ends[:-1] - 1
    symbol = symbols(points, breaks)
    starts = np.flatnonzero(token_starts(symbol))
    stops = np.append(starts[1:], len(points))
    keep = symbol[starts] != S_BREAK
    starts, stops = starts[keep], stops[keep]
    counts = np.diff(np.searchsorted(starts, np.append(0, ends)))
    return whole, starts, stops, counts


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}


def _merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merge over lists: cheaper than a heap for a few bytes."""
    rank = ranks.get
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [rank(piece[i : i + 2], NO_RANK) for i in range(len(piece) - 1)]
    while pairs:
        low = min(pairs)
        if low == NO_RANK:
            break
        i = pairs.index(low)
        joined = parts[i] + parts.pop(i + 1)
        parts[i] = joined
        del pairs[i]
        if i < len(pairs):
            pairs[i] = rank(joined + parts[i + 1], NO_RANK)
        if i:
            pairs[i - 1] = rank(parts[i - 1] + joined, NO_RANK)
    return [ranks[p] for p in parts]


def merge_pairs(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: join the neighbouring pair of lowest rank, leftmost first, until none is known."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n <= SHORT:
        return _merge_short(piece, ranks)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    stop = list(range(1, n + 1))  # end of the part that starts here; 0 when it was joined to its left
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i]
        if not stop[i] or j >= n or stop[j] != end:
            continue
        stop[i], stop[j] = end, 0
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(piece[i : stop[k]])) is not None:
                heapq.heappush(heap, (r, i, stop[k]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:end])) is not None:
            heapq.heappush(heap, (r, h, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : stop[i]]])
        i = stop[i]
    return out


class PieceCache(dict):
    """Ids of pieces seen before; long pieces are not held and it starts again when full."""

    def __init__(self, ranks: dict[bytes, int], limit: int = 200_000, longest: int = 64):
        super().__init__()
        self._ranks, self._limit, self._longest = ranks, limit, longest

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(merge_pairs(piece.encode(), self._ranks))
        if len(piece) <= self._longest:
            if len(self) >= self._limit:
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder over one rank table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.cache = PieceCache(ranks)
        self.bytes_of = {i: b for b, i in ranks.items()}

    @cached_property
    def digits(self) -> dict[int, str]:
        return {i: str(i) for i in self.bytes_of}

    def encode(self, texts: list[str]):
        """Yields (ids, piece starts in code points of that text) for each text."""
        whole, starts, stops, counts = split_texts(texts)
        base = np.cumsum([0, *(len(t) + 1 for t in texts)])
        at = 0
        a, b = starts.tolist(), stops.tolist()
        for k, n in enumerate(counts.tolist()):
            pieces = [whole[i:j] for i, j in zip(a[at : at + n], b[at : at + n], strict=True)]
            yield list(chain.from_iterable(map(self.cache.__getitem__, pieces))), starts[at : at + n] - base[k]
            at += n

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def offsets(self, ids) -> np.ndarray:
        """Byte offset at which each token starts in the decoded bytes."""
        sizes = np.fromiter((len(self.bytes_of[i]) for i in ids), dtype=np.int64, count=len(ids))
        return np.cumsum(sizes) - sizes


def _shared(spark: SparkSession, path: str):
    """The rank table, sent to every task."""
    return spark.sparkContext.broadcast(read_ranks(path))


def encode(docs: DataFrame, ranks_path: str, text: str = "text", places: bool = True) -> DataFrame:
    """``docs`` with ``ids`` and, with ``places``, the byte ``offsets`` of the tokens and ``piece_starts`` (code points).

    Null text has empty arrays.  ``docs`` must not have columns of these
    names.
    """
    import pyarrow as pa

    shared = _shared(docs.sparkSession, ranks_path)
    names = ["ids", "offsets", "piece_starts"] if places else ["ids"]

    def run(batches):
        codec = Codec(shared.value)  # goes with the task: workers live on in other stages
        for batch in text_chunks(batches, text, CHUNK):
            ids, offsets, starts = [], [], []
            for i, s in codec.encode([t or "" for t in batch.column(text).to_pylist()]):
                ids.append(i)
                if places:
                    offsets.append(codec.offsets(i))
                    starts.append(s)
            arrays = [pa.array(x, type=pa.list_(pa.int32())) for x in ((ids, offsets, starts) if places else (ids,))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, with_fields(docs, ", ".join(f"{n} array<int>" for n in names)))


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the bytes that the ids stand for (null ids: no bytes)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    shared = _shared(encoded.sparkSession, ranks_path)

    def run(batches):
        codec = Codec(shared.value)  # goes with the task: workers live on in other stages
        for batch in row_chunks(batches, lambda b: pc.list_value_length(b.column(ids)), TOKENS):
            out = pa.array([codec.decode(x or []) for x in batch.column(ids).to_pylist()], type=pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, with_fields(encoded, "decoded binary"))


def digests(docs: DataFrame, ranks_path: str) -> DataFrame:
    """Per document: token count, hash of the ids, and hash of the bytes decoded from the ids."""
    import hashlib

    import pyarrow as pa

    shared = _shared(docs.sparkSession, ranks_path)

    def run(batches):
        codec = Codec(shared.value)  # goes with the task: workers live on in other stages
        for batch in text_chunks(batches, "text", CHUNK):
            n, by_ids, by_bytes = [], [], []
            for ids, _ in codec.encode([t or "" for t in batch.column("text").to_pylist()]):
                n.append(len(ids))
                by_ids.append(hashlib.sha256(" ".join(map(codec.digits.__getitem__, ids)).encode()).hexdigest())
                by_bytes.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, type=pa.int64()), pa.array(by_ids), pa.array(by_bytes)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    picked = docs.select(F.col("doc_id"), F.col("text"))
    return picked.mapInArrow(run, with_fields(picked.select("doc_id"), "n_tokens bigint, ids_sha256 string, decoded_sha256 string"))
