"""Quality rules with a line sequence labeller.

Counting rules come first (too few words, too many repeated word windows).
The method then labels the lines of a text with a linear-chain conditional
random field: emission weights over line features, transition weights
between neighbouring lines, Viterbi decoding of the best sequence of content
and boilerplate.  A document is kept when content lines hold at least
``min_content`` of its words.

The field is trained here on the lines of a bounded sample of labelled
documents.  Lines take their document's quality; a line that repeats an
earlier line of its document counts as boilerplate.

Rows: null text counts as empty, has no words and fails the base rules.
Texts of only white space likewise.  Repeated rows get equal answers.  With
no labelled document the field keeps every line.  Only ``doc_id`` and
``text`` (and the labels' ``doc_id`` and ``quality``) are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import WordCodes, text_chunks, utf8, with_fields

#: Labelled documents of each quality that the field learns from, about; the bound of the sample.
SAMPLE_PER_CLASS = 400
MIN_WORDS, MAX_REPEAT_SHARE, MIN_CONTENT = 50, 50, 0.5
BOILERPLATE, CONTENT = 0, 1
N_FEATURES = 11

# byte classes for counting: word start is worked out from BLANK
LOWER, UPPER, DIGIT, SYMBOL, POINT, BLANK, INNER = range(7)


def _byte_classes() -> np.ndarray:
    table = np.full(256, POINT, dtype=np.uint8)
    table[0x80:0xC0] = INNER  # continuation bytes are no code points of their own
    table[0xC0:] = LOWER
    for kind, members in ((LOWER, b"abcdefghijklmnopqrstuvwxyz"), (UPPER, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (DIGIT, b"0123456789"), (SYMBOL, b"#*$%&|<>"), (BLANK, b" \t\n\x0b\x0c\r")):
        table[list(members)] = kind
    return table


BYTE_CLASS = _byte_classes()


@dataclass
class LineField:
    """Weights: features x labels, and label to label."""

    emit: np.ndarray
    step: np.ndarray


def _sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[ends] - total[starts]


@dataclass
class Lines:
    """Line and document counts of a chunk of texts."""

    n_words: np.ndarray  # by line
    doc_of: np.ndarray
    doc_start: np.ndarray  # first line of each document, and the end
    features: np.ndarray
    repeated: np.ndarray
    word_chars: np.ndarray  # by document
    n_symbols: np.ndarray


def lines_of(texts: list[bytes]) -> Lines:
    """Counts and features of every \\n-split line of the texts."""
    whole = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(whole, dtype=np.uint8)
    kind = BYTE_CLASS[raw]
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    text_ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1) - 1
    doc_of = np.searchsorted(text_ends, ends)
    doc_start = np.searchsorted(doc_of, np.arange(len(texts) + 1))
    blank = kind == BLANK
    first = ~blank
    first[1:] &= blank[:-1]
    by = {k: _sums(kind == k, starts, ends) for k in (LOWER, UPPER, DIGIT, SYMBOL, POINT)}
    n_words = _sums(first, starts, ends)
    chars = sum(by.values())
    safe = np.maximum(chars, 1)
    seen: set[bytes] = set()
    repeated = np.zeros(len(ends), dtype=bool)
    at = 0
    for text in texts:
        seen.clear()
        for line in text.split(b"\n"):
            if n_words[at]:
                if line in seen:
                    repeated[at] = True
                else:
                    seen.add(line)
            at += 1
    last = raw[np.maximum(ends - 1, 0)]
    letters = by[LOWER] + by[UPPER]
    features = np.stack(
        [
            np.ones(len(ends)),
            np.log1p(n_words) / 4,
            letters / safe,
            by[UPPER] / np.maximum(letters, 1),
            by[DIGIT] / safe,
            by[SYMBOL] / np.maximum(n_words, 1),
            by[POINT] / np.maximum(n_words, 1),
            np.minimum(chars / np.maximum(n_words, 1), 40) / 10,
            repeated,
            n_words == 0,
            np.isin(last, list(b".!?")) & (n_words > 0),
        ],
        axis=1,
    )
    spots = np.concatenate([[0], text_ends[:-1] + 1])
    return Lines(n_words, doc_of, doc_start, features, repeated, _sums(~blank & (kind != INNER), spots, text_ends), _sums(kind == SYMBOL, spots, text_ends))


def repeated_window_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and how many lie in a three-word window found twice or more in it."""
    codes = WordCodes()
    coded = [codes.encode(t.split()) for t in texts]
    n = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
    flat = np.concatenate(coded) if coded else np.zeros(0, dtype=np.int64)
    out = np.zeros(len(texts), dtype=np.int64)
    if len(flat) < 3:
        return n, out
    doc = np.repeat(np.arange(len(texts)), n)
    # number the pairs, then pairs with a third word, then those with their document: exact names, no hashes
    name, size = flat, len(codes)
    _, pair = np.unique(name[:-1] * size + name[1:], return_inverse=True)
    _, triple = np.unique(pair[:-1] * size + flat[2:], return_inverse=True)
    own = doc[:-2] == doc[2:]
    at = np.flatnonzero(own)
    key = doc[at] * (int(triple.max()) + 1) + triple[at]
    _, where, count = np.unique(key, return_inverse=True, return_counts=True)
    hit = at[count[where] > 1]
    covered = np.zeros(len(flat), dtype=bool)
    for k in range(3):
        covered[hit + k] = True
    return n, np.bincount(doc[covered], minlength=len(texts))


def decode(scores: np.ndarray, step: np.ndarray) -> list[int]:
    """Best label sequence of one document; ``scores`` has a row for each line and a column for each label."""
    (bb, bc), (cb, cc) = step.tolist()
    back, best_b, best_c = [], *scores[0].tolist()
    for b, c in scores[1:].tolist():
        from_b, from_c = best_b + bb >= best_c + cb, best_b + bc > best_c + cc
        back.append((BOILERPLATE if from_b else CONTENT, BOILERPLATE if from_c else CONTENT))
        best_b, best_c = b + (best_b + bb if from_b else best_c + cb), c + (best_b + bc if from_c else best_c + cc)
    label = BOILERPLATE if best_b > best_c else CONTENT
    out = [label]
    for pair in reversed(back):
        label = pair[label]
        out.append(label)
    return out[::-1]


def content_share(lines: Lines, field: LineField) -> np.ndarray:
    """Share of each document's words that stand in content lines (0 without words)."""
    scores = lines.features @ field.emit
    label = np.zeros(len(scores), dtype=np.int64)
    for a, b in zip(lines.doc_start[:-1], lines.doc_start[1:], strict=True):
        label[a:b] = decode(scores[a:b], field.step)
    n_docs = len(lines.doc_start) - 1
    total = np.bincount(lines.doc_of, weights=lines.n_words, minlength=n_docs)
    content = np.bincount(lines.doc_of, weights=lines.n_words * label, minlength=n_docs)
    return content / np.maximum(total, 1)


def train(sequences: list[tuple[np.ndarray, np.ndarray]], rounds: int = 150, rate: float = 0.2, ridge: float = 1e-3) -> LineField:
    """Weights that maximise the conditional likelihood of the label sequences (gradient ascent with momentum).

    A sequence is (features, labels); gradients come from the forward and
    backward recursions, run for all sequences of a position at once.
    """
    emit, step = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
    emit[0, CONTENT] = 1e-3
    if not sequences:
        return LineField(emit, step)
    sizes = np.array([len(y) for _, y in sequences])
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    x = np.zeros((len(sizes), sizes[0], N_FEATURES))
    y = np.zeros((len(sizes), sizes[0]), dtype=np.int64)
    for i, k in enumerate(order):
        x[i, : sizes[i]], y[i, : sizes[i]] = sequences[k]
    live = np.arange(sizes[0])[None, :] < sizes[:, None]
    gold = np.eye(2)[y] * live[..., None]
    gold_emit = np.einsum("nlf,nlk->fk", x, gold)
    gold_step = np.einsum("nla,nlb->ab", gold[:, :-1], gold[:, 1:])
    n, speed_e, speed_s = live.sum(), np.zeros_like(emit), np.zeros_like(step)

    def lse(a, axis):
        top = a.max(axis=axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))

    for _ in range(rounds):
        score = x @ emit
        ahead, behind = score.copy(), np.zeros_like(score)
        for t in range(1, sizes[0]):
            m = live[:, t].sum()
            ahead[:m, t] = score[:m, t] + lse(ahead[:m, t - 1, :, None] + step, 1)
        for t in range(sizes[0] - 2, -1, -1):
            m = live[:, t + 1].sum()
            behind[:m, t] = lse(step + (score[:m, t + 1] + behind[:m, t + 1])[:, None, :], 2)
        z = lse(ahead[np.arange(len(sizes)), sizes - 1], 1)
        mean = np.exp(ahead + behind - z[:, None, None]) * live[..., None]
        move = np.exp(np.minimum(ahead[:, :-1, :, None] + step + (score + behind)[:, 1:, None, :] - z[:, None, None, None], 0)) * live[:, 1:, None, None]
        grad_e = (gold_emit - np.einsum("nlf,nlk->fk", x, mean)) / n - ridge * emit
        grad_s = (gold_step - move.sum(axis=(0, 1))) / n - ridge * step
        speed_e, speed_s = 0.9 * speed_e + grad_e, 0.9 * speed_s + grad_s
        emit, step = emit + rate * speed_e, step + rate * speed_s
    return LineField(emit, step)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> LineField:
    """Train on about ``per_class`` labelled documents of each quality, drawn by a hash of their id.

    A document with several labels takes the lowest.
    """
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sizes = {r["quality"]: r["n"] for r in marked.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    picked = None
    for quality, n in sorted(sizes.items()):
        part = marked.where((F.col("quality") == quality) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(min(1.0, per_class / n) * (1 << 20))))
        picked = part if picked is None else picked.union(part)
    if picked is None:
        return train([])
    chosen = {r["doc_id"]: r["quality"] for r in picked.collect()}  # about per_class rows of each quality
    own = docs.select("doc_id", "text").where(F.col("doc_id").isin(list(chosen))) if len(chosen) <= 4 * per_class else docs.select("doc_id", "text").join(F.broadcast(picked.select("doc_id")), "doc_id", "left_semi")

    def features(batches):
        import pyarrow as pa

        for batch in text_chunks(batches, "text"):
            lines = lines_of(utf8(batch, "text"))
            if batch.num_rows:
                cut = lines.doc_start
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array([lines.features[a:b].astype(np.float32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], type=pa.binary()),
                        pa.array([lines.repeated[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], type=pa.binary()),
                    ],
                    names=["doc_id", "features", "repeated"],
                )

    rows = own.mapInArrow(features, with_fields(own.select("doc_id"), "features binary, repeated binary")).collect()
    sequences = []
    for doc_id, raw, twice in sorted(rows, key=lambda r: (r[0], r[1])):
        x = np.frombuffer(raw, dtype=np.float32).reshape(-1, N_FEATURES).astype(np.float64)
        good = np.full(len(x), CONTENT if chosen[doc_id] else BOILERPLATE)
        good[np.frombuffer(twice, dtype=bool)] = BOILERPLATE
        sequences.append((x, good))
    return train(sequences)


def judge(docs: DataFrame, field: LineField, min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT_SHARE, min_content: float = MIN_CONTENT) -> DataFrame:
    """One row per document: word counts, the base rules' verdict, the content share and the final verdict."""
    import pyarrow as pa

    held = docs.sparkSession.sparkContext.broadcast(field)  # a few dozen weights

    def run(batches):
        for batch in text_chunks(batches, "text"):
            texts = utf8(batch, "text")
            lines = lines_of(texts)
            n_words, n_repeat = repeated_window_words(texts)
            failed = (n_words < min_words) | (100 * n_repeat > max_repeat * n_words)
            share = content_share(lines, held.value)
            twice = np.bincount(lines.doc_of, weights=lines.repeated, minlength=len(texts)).astype(np.int64)
            cols = [n_words, lines.word_chars, lines.n_symbols, twice, n_repeat, failed, share, ~failed & (share >= min_content)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, cols)], names=["doc_id", *names])

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"]
    kinds = ["bigint"] * 5 + ["boolean", "double", "boolean"]
    picked = docs.select("doc_id", "text")
    return picked.mapInArrow(run, with_fields(picked.select("doc_id"), ", ".join(f"{a} {b}" for a, b in zip(names, kinds, strict=True))))
