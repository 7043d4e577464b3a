"""Language of a document as a mixture of languages.

A language is a table of byte-trigram log probabilities over a fixed number
of hash buckets, counted on a bounded, documented sample of labelled rows.
A document is a bag of words; each word has one likelihood for every
language, the product of its trigrams' probabilities.  Expectation
maximisation finds the document's language proportions, and languages are
taken out one by one as long as the penalised likelihood
(log likelihood less half the log of the word count for every free
proportion) grows.

Rows: null text, or text without a letter, is ``und`` with score 0.  With no
learned language every row is ``und``.  Repeated rows get equal answers and
a null id is kept.  Only ``doc_id``, ``text`` and, for learning, ``lang`` are
read; other columns stay out of it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import WordCodes, id_bucket, text_chunks, utf8, with_fields

BUCKETS = 1 << 16
UNKNOWN = "und"
#: Labelled documents read for each language, about; the bound of the training sample.
SAMPLE_PER_LANGUAGE = 1500
#: ASCII bytes that are no letters: they only part words.
_PARTS = bytes(c for c in range(128) if not chr(c).isalpha())
_TO_BLANK = bytes.maketrans(_PARTS, b" " * len(_PARTS))


@dataclass
class LanguageModel:
    """Names, and the log probability of every bucket (rows) in every language (columns)."""

    names: list[str]
    table: np.ndarray


def _words(text: bytes) -> list[bytes]:
    return text.lower().translate(_TO_BLANK).split()


def _trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each trigram of the words with a blank at both ends, and each word's first trigram."""
    raw = np.frombuffer(b"  " + b"  ".join(words) + b"  ", dtype=np.uint8).astype(np.uint32)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    first = np.cumsum(size + 2) - (size + 2)
    mixed = (raw[:-2] * np.uint32(0x9E3779B1)) ^ (raw[1:-1] * np.uint32(0x85EBCA6B)) ^ (raw[2:] * np.uint32(0xC2B2AE35))
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    return mixed >> np.uint32(16), first


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Learn from the rows of ``docs`` (text, lang); rows without text or lang teach nothing.

    Rows are taken by a hash of their id and text with the share that leaves
    about ``per_language`` of each language.
    """
    import pyarrow as pa

    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(sizes)
    if not names:
        return LanguageModel([], np.zeros((BUCKETS, 0), dtype=np.float32))
    share = F.create_map(*[x for k in names for x in (F.lit(k), F.lit(min(1.0, per_language / sizes[k])))])
    drawn = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for batch in text_chunks(batches, "text"):
            for lang, text in zip(batch.column("lang").to_pylist(), utf8(batch, "text"), strict=True):
                if words := _words(text):
                    own = held.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                    own += np.bincount(_valid(words), minlength=BUCKETS)
        for lang, own in held.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(own[at])], names=["lang", "bucket", "n"])

    counted = rows.where(drawn).mapInArrow(count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = np.full((BUCKETS, len(names)), 0.5)
    place = {k: i for i, k in enumerate(names)}
    for lang, bucket, n in counted.collect():  # at most BUCKETS rows a language
        table[bucket, place[lang]] += n
    return LanguageModel(names, np.log(table / table.sum(axis=0)).astype(np.float32))


def _valid(words: list[bytes]) -> np.ndarray:
    """Trigrams of the words without those that only hold the gap between two words."""
    bucket, first = _trigrams(words)
    keep = np.ones(len(bucket), dtype=bool)
    keep[first] = False  # two blanks and a letter: the gap's own
    return bucket[keep[: len(bucket)]]


def word_likelihoods(words: list[bytes], model: LanguageModel) -> np.ndarray:
    """Log likelihood of each word (rows) in each language (columns)."""
    bucket, first = _trigrams(words)
    each = model.table[bucket]
    each[first] = 0
    return np.add.reduceat(each, first, axis=0)


def mixtures(like: np.ndarray, counts: np.ndarray, starts: np.ndarray, rounds: int = 24) -> np.ndarray:
    """Proportions of the languages in each document.

    ``like`` has a row for each language and a column for each (document,
    word); documents begin at ``starts``.  Languages outside the chosen set
    have proportion 0.
    """
    n_lang, n_docs = like.shape[0], len(starts)
    sizes = np.diff(np.append(starts, like.shape[1]))
    words = np.add.reduceat(counts, starts)
    top = like.max(axis=0)
    chance = np.exp(like - top)

    def climb(share, steps):
        for _ in range(steps):
            part = np.repeat(share, sizes, axis=1) * chance
            part *= counts / np.maximum(part.sum(axis=0), 1e-30)
            share = np.add.reduceat(part, starts, axis=1) / words
        fit = np.log(np.maximum((np.repeat(share, sizes, axis=1) * chance).sum(axis=0), 1e-30))
        return share, np.add.reduceat(fit * counts, starts)

    share, fit = climb(np.full((n_lang, n_docs), 1.0 / n_lang, dtype=np.float32), rounds)
    penalty = 0.5 * np.log(words + 1.0)
    open_ = np.ones(n_docs, dtype=bool)
    for _ in range(n_lang - 1):
        live = share > 0
        least = np.where(live, share, 2.0).argmin(axis=0)
        fewer = share.copy()
        fewer[least, np.arange(n_docs)] = 0
        total = fewer.sum(axis=0)
        open_ &= (live.sum(axis=0) > 1) & (total > 0)
        if not open_.any():
            break
        fewer = np.where(open_, fewer / np.where(total > 0, total, 1), share)
        tried, tried_fit = climb(fewer.astype(np.float32), 4)
        open_ &= tried_fit + penalty >= fit
        share = np.where(open_, tried, share)
        fit = np.where(open_, tried_fit, fit)
    return share


def classify(texts: list[bytes], model: LanguageModel) -> tuple[list[str], np.ndarray]:
    """Main language and its proportion, for each text."""
    names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    known = [i for i, t in enumerate(texts) if any(map(str.isalpha, t.decode()))] if model.names else []
    if not known:
        return names, score
    codes = WordCodes()
    coded = [codes.encode(_words(texts[i])) for i in known]
    like = word_likelihoods(list(codes), model)
    sizes = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
    flat = np.repeat(np.arange(len(known), dtype=np.int64), sizes) * len(codes) + np.concatenate(coded)
    pair, counts = np.unique(flat, return_counts=True)
    starts = np.searchsorted(pair // len(codes), np.arange(len(known)))
    share = mixtures(np.ascontiguousarray(like[pair % len(codes)].T), counts.astype(np.float32), starts)
    for k, (i, best) in enumerate(zip(known, share.argmax(axis=0), strict=True)):
        names[i], score[i] = model.names[best], min(1.0, float(share[best, k]))
    return names, score


def annotate(docs: DataFrame, model: LanguageModel, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its proportion added under the given names."""
    import pyarrow as pa

    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows for each language

    def run(batches):
        for batch in text_chunks(batches, "text", 2 << 20):
            names, scores = classify(utf8(batch, "text"), held.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, type=pa.string()), pa.array(scores)], names=[*batch.schema.names, lang, score])

    return docs.mapInArrow(run, with_fields(docs, f"`{lang}` string, `{score}` double"))


def predictions(docs: DataFrame) -> DataFrame:
    """Learn from the rows whose id hash is not held out, then predict every row."""
    held_out = id_bucket("doc_id", 4) == 2
    model = fit(docs.where(~held_out))
    picked = docs.select("doc_id", "text", held_out.alias("held_out"))
    return annotate(picked, model).drop("text")
