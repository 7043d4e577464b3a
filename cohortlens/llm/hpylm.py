"""A hierarchical Pitman-Yor language model, trained and applied on Spark.

Restaurants: one for each previous word and one for the start of a text, all
children of one unigram restaurant, whose base is uniform over the vocabulary
and one unknown token.  Seating is sampled by Gibbs: a dish's customers in a
restaurant leave and are seated again, one after the other, by the Chinese
restaurant process given the parent's predictive probability; tables of the
context restaurants are the customers of the unigram restaurant.  Several
chains run side by side, and a text's score comes from their averaged
predictive probabilities.

Words are dealt to parts by hash; a part numbers its words by falling count,
so number and part name a word everywhere.  All restaurants' seats of one
word lie in its part, and the part keeps the tables of the word's own
restaurant.  Restaurants meet only through these totals: after each sweep a
part sends the tables it holds to the parts of their contexts, which add them
up and answer.  A dish of one customer has one table for good, so only
contexts with larger dishes are sent again.  Within a sweep totals and
parents are those of the sweep before.  Dishes with more than ``EXACT``
customers are seated in growing groups whose new tables are drawn together.

Documents are blocks of word codes.  A block sends each (word, context) it
holds once, with its training count, and receives the customers and tables of
each; so neither hot words nor hot contexts send more than their distinct
neighbours.

Tokens: runs without ASCII white space, A-Z in lower case, then one end of
text; the end also stands for the start as a context.  Rows: null, empty and
blank texts are the end token alone; repeated rows count each; a null id
hashes as the empty text.  Without training rows every token is unknown.
Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from cohortlens.llm import blocks
from cohortlens.llm.common import arrow_table, id_bucket, written

CHAINS, SWEEPS = 3, 3
#: Discount and strength of the context restaurants and of the unigram restaurant.
DISCOUNT, STRENGTH = (0.75, 0.75), (5.0, 50.0)
#: Customers of a dish that are seated one at a time; later ones in groups that grow by this share.
EXACT, GROWTH = 32, 0.05
END = b""


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0, byte plane by byte plane, compressed."""
    out = [np.int64(len(arrays)).tobytes()]
    for a in arrays:
        a = np.ascontiguousarray(a, dtype="<i8")
        wide = (int(a.max()).bit_length() + 7) // 8 if len(a) else 0
        out += [np.array([len(a), wide], dtype="<i8").tobytes(), a.view(np.uint8).reshape(-1, 8)[:, :wide].T.tobytes()]
    return zlib.compress(b"".join(out), 1)


def _unpack(raw: bytes) -> list[np.ndarray]:
    data = zlib.decompress(raw)
    out, at = [], 8
    for _ in range(int.from_bytes(data[:8], "little")):
        n, wide = np.frombuffer(data, dtype="<i8", count=2, offset=at).tolist()
        a = np.zeros((n, 8), dtype=np.uint8)
        a[:, :wide] = np.frombuffer(data, dtype=np.uint8, count=n * wide, offset=at + 16).reshape(wide, n).T
        out.append(a.view("<i8").reshape(n))
        at += 16 + n * wide
    return out


def _gaps(values: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Steps within rising runs; the first of a run is whole."""
    out, first = values.copy(), (np.cumsum(runs) - runs)[runs > 0]
    out[1:] -= values[:-1]
    out[first] = values[first]
    return out


def _whole(gaps: np.ndarray, runs: np.ndarray) -> np.ndarray:
    runs = runs[runs > 0]
    first, total = np.cumsum(runs) - runs, np.cumsum(gaps)
    return total - np.repeat(total[first] - gaps[first], runs)


def _hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


class Tokens:
    """Tokens of a block: word (its place in the block's words, sorted by hash) of each, ends included, and its distinct pairs."""

    def __init__(self, block: blocks.Block):
        words = [*block.words, END]
        hashes = _hashes(words)
        order = np.argsort(hashes, kind="stable")
        self.words, self.hashes = [words[i] for i in order], hashes[order]
        rank = np.empty(len(words), dtype=np.int64)
        rank[order] = np.arange(len(words))
        self.sizes = block.sizes + 1
        self.stops = np.cumsum(self.sizes)
        code = np.full(int(self.stops[-1]) if len(self.sizes) else 0, len(words) - 1, dtype=np.int64)
        inner = np.ones(len(code), dtype=bool)
        inner[self.stops - 1] = False
        code[inner] = block.codes
        self.word = rank[code]
        self.trained = np.repeat(np.array(block.flags, dtype=bool), self.sizes)

    def pairs(self):
        """Word and context of each distinct pair, training count of each, and the pair of each token."""
        before = np.concatenate([self.word[-1:], self.word[:-1]])  # every text ends with the end: it stands before the next
        pair, entry = np.unique(self.word * len(self.words) + before, return_inverse=True)
        return pair // len(self.words), pair % len(self.words), np.bincount(entry[self.trained], minlength=len(pair)), entry

    def edges(self, n_parts: int) -> np.ndarray:
        """Places in the words at which the parts begin, and the end."""
        return np.concatenate([[0], np.searchsorted(self.hashes, np.array([(k << 64) // n_parts for k in range(1, n_parts)], dtype=np.uint64)), [len(self.hashes)]]).astype(np.int64)


def _sent_order(number: np.ndarray, cut: np.ndarray, n_parts: int, word: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Pairs by part, number of the word in it, and context; ``number`` is that of each of the block's words in its part."""
    part = np.repeat(np.arange(n_parts), np.diff(cut))
    place = np.empty(len(number), dtype=np.int64)
    place[np.lexsort((number, part))] = np.arange(len(number))
    return np.lexsort(((number * n_parts + part)[context], place[word]))


def seat(rng: np.random.Generator, customers: np.ndarray, base: np.ndarray, step: np.ndarray, discount: float) -> np.ndarray:
    """Tables after seating each dish's customers.

    A new table for dish ``i`` with ``t`` tables weighs
    ``base[i] + t * step[i]``; the tables it has weigh its seated customers
    less ``discount`` for each table.
    """
    order = np.argsort(-customers, kind="stable")
    c, b, s = customers[order], base[order], step[order]
    t = np.minimum(c, 1).astype(np.float64)
    done = 1
    while (m := int(np.searchsorted(-c, -done, side="left"))) > 0:
        size = 1 if done < EXACT else max(1, int(done * GROWTH))
        fresh = b[:m] + t[:m] * s[:m]
        chance = fresh / (fresh + np.maximum(done - discount * t[:m], 1e-9))
        if size == 1:
            t[:m] += rng.random(m) < chance
        else:
            t[:m] += rng.binomial(np.minimum(size, c[:m] - done), np.clip(chance, 0.0, 1.0))
        done += size
    out = np.empty(len(t), dtype=np.int64)
    out[order] = np.minimum(t, c)
    return out


class Seats:
    """The seats of a part's words: entries (word, context, customers) by word and context."""

    def __init__(self, known, word, context, customers):
        self.known, self.word, self.context, self.customers = known, word, context, customers
        self.open = customers > 1
        self.single = np.bincount(word[~self.open], minlength=len(known))
        self.open_word = word[self.open]
        self.contexts, self.where = np.unique(context[self.open], return_inverse=True)

    @classmethod
    def gather(cls, known: np.ndarray, messages: list[bytes]):
        keys, counts = [], []
        for raw in messages:
            word, context, n = _sent(raw)
            keys.append((word[n > 0], context[n > 0]))
            counts.append(n[n > 0])
        word, context = (np.concatenate(x) for x in zip(*keys, strict=True))
        wide = int(context.max()) + 1 if len(context) else 1
        key, where = np.unique(word * wide + context, return_inverse=True)
        return cls(known, key // wide, key % wide, np.bincount(where, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64))

    @classmethod
    def read(cls, raw: bytes):
        known, runs, gaps, customers = _unpack(raw)
        return cls(known, np.repeat(np.arange(len(known)), runs), _whole(gaps, runs), customers)

    def write(self) -> bytes:
        runs = np.bincount(self.word, minlength=len(self.known))
        return _pack(self.known, runs, _gaps(self.context, runs), self.customers)

    def served(self, tables: np.ndarray) -> np.ndarray:
        """Tables by word; ``tables`` are those of the open entries."""
        return self.single + np.bincount(self.open_word, weights=tables, minlength=len(self.known)).astype(np.int64)

    def sweep(self, state: State, totals: np.ndarray, vocabulary: int, rng: np.random.Generator) -> None:
        """Seat anew, given the tables of each open context by chain."""
        uniform = 1.0 / (vocabulary + 1)
        for s in range(CHAINS):
            guests, root_tables, old = state.sums[s], state.sums[CHAINS + s], state.tables[s]
            # the dish's customers have left: its tables are gone from the restaurant and from the parent
            rest = self.served(old)[self.open_word] - old
            rest_tables = np.minimum(state.root[s][self.open_word], rest)
            parent = (rest - DISCOUNT[1] * rest_tables + (STRENGTH[1] + DISCOUNT[1] * root_tables) * uniform) / np.maximum(STRENGTH[1] + guests - old, 1.0)
            other = STRENGTH[0] + DISCOUNT[0] * np.maximum(totals[s][self.where] - old, 0)
            state.tables[s] = seat(rng, self.customers[self.open], other * parent, DISCOUNT[0] * parent, DISCOUNT[0])
            base = (STRENGTH[1] + DISCOUNT[1] * np.maximum(root_tables - state.root[s], 0)) * uniform
            state.root[s] = seat(rng, self.served(state.tables[s]), base, np.full(len(base), DISCOUNT[1] * uniform), DISCOUNT[1])


class State:
    """What changes in a part: by chain tables of the open entries, unigram tables by word, tables of the words' own restaurants; ``alone``: those of single customers.

    ``sums``: customers and tables of the unigram restaurant, by chain.
    """

    def __init__(self, tables, root, own, alone, known, sums):
        self.tables, self.root, self.own, self.alone, self.known, self.sums = tables, root, own, alone, known, sums

    @classmethod
    def read(cls, raw: bytes):
        a = _unpack(raw)
        return cls(a[:CHAINS], a[CHAINS : 2 * CHAINS], a[2 * CHAINS : 3 * CHAINS], *a[3 * CHAINS :])

    def write(self) -> bytes:
        return _pack(*self.tables, *self.root, *self.own, self.alone, self.known, self.sums)


def _sent(raw: bytes):
    """Word, context and training count of each pair that a block has sent."""
    asked, runs, gaps, count = _unpack(raw)
    return np.repeat(np.sort(asked), runs), _whole(gaps, runs), count


def _by_part(contexts: np.ndarray, n_parts: int):
    """Order of rising contexts by their parts, and where the parts begin."""
    order = np.argsort(contexts % n_parts, kind="stable")
    return order, np.searchsorted((contexts % n_parts)[order], np.arange(n_parts + 1))


def _reports(part: int, seats: Seats, state: State, n_parts: int, first: bool) -> list[tuple]:
    """The state, and for each part the tables held here of its words' restaurants."""
    sums = np.array([*(seats.served(t).sum() for t in state.tables), *(r.sum() for r in state.root)])
    order, cut = _by_part(seats.contexts, n_parts)
    number = seats.contexts[order] // n_parts
    tables = [np.bincount(seats.where, weights=t, minlength=len(order))[order].astype(np.int64) for t in state.tables]
    lone, alone = np.unique(seats.context[~seats.open], return_counts=True) if first else (np.zeros(0, dtype=np.int64),) * 2
    lone_order, lone_cut = _by_part(lone, n_parts)
    lone, alone = lone[lone_order] // n_parts, alone[lone_order]
    rows = [(part, -1, state.write())]
    for to in range(n_parts):
        a, b, c, d = *cut[to : to + 2], *lone_cut[to : to + 2]
        rows.append((to, part, _pack(sums, _gaps(number[a:b], np.array([b - a])), *(t[a:b] for t in tables), _gaps(lone[c:d], np.array([d - c])), alone[c:d])))
    return rows


ASKED = "part int, block bigint, words binary, data binary"
NUMBERED = "block bigint, part int, data binary, tokens bigint, kinds bigint"
PAIRS = "part int, block bigint, data binary"
SEATS = "part int, data binary"
MESSAGES = "part int, sender int, data binary"
BACK = "block bigint, part int, data binary"


def score(docs: DataFrame, trained, sweeps: int = SWEEPS, seed: int = 11) -> DataFrame:
    """Train on the rows for which ``trained`` holds and score every row.

    Per document: flag, tokens, known tokens, training tokens, the add-one
    unigram's and the model's log10 probability, and the model's perplexity.
    """
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = blocks.encode(docs, trained, True, "model_blocks")

    def ask(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                tokens = Tokens(blocks.unpack(row))
                cut, count = tokens.edges(n_parts), np.bincount(tokens.word[tokens.trained], minlength=len(tokens.words))
                rows = [(p, row.column("block")[0].as_py(), zlib.compress(b" ".join(tokens.words[a:b]), 1), _pack(count[a:b])) for p, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if a < b]
                yield from arrow_table(rows, ASKED).to_batches()

    def number(arrow):
        every, part, asked = {}, arrow.column("part")[0].as_py(), []
        for words, data in zip(arrow.column("words").to_pylist(), arrow.column("data").to_pylist(), strict=True):
            asked.append((np.array([every.setdefault(w, len(every)) for w in zlib.decompress(words).split(b" ")], dtype=np.int64), _unpack(data)[0]))
        known = np.zeros(len(every), dtype=np.int64)
        for place, n in asked:
            known[place] += n
        names = sorted(every, key=lambda w: (-known[every[w]], w))
        order = np.array([every[w] for w in names], dtype=np.int64)
        rank = np.empty(len(names), dtype=np.int64)
        rank[order] = np.arange(len(names))
        rows = [(block, part, _pack(rank[place]), 0, 0) for block, (place, _) in zip(arrow.column("block").to_pylist(), asked, strict=True)]
        return arrow_table([*rows, (-1, part, _pack(known[order]), int(known.sum()), int((known > 0).sum()))], NUMBERED)

    numbered = written(table.mapInArrow(ask, ASKED).groupBy("part").applyInArrow(number, NUMBERED), "word-numbers")
    total, vocabulary = numbered.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()

    def send(key, left, right):
        rows = []
        if left.num_rows:
            tokens = Tokens(blocks.unpack(left))
            cut = tokens.edges(n_parts)
            got = sorted(zip(right.column("part").to_pylist(), right.column("data").to_pylist(), strict=True))
            numbers = np.concatenate([_unpack(d)[0] for _, d in got])
            word, context, count, _ = tokens.pairs()
            order = _sent_order(numbers, cut, n_parts, word, context)
            word, count = word[order], count[order]
            context = (numbers * n_parts + np.repeat(np.arange(n_parts), np.diff(cut)))[context[order]]
            runs = np.bincount(word, minlength=len(numbers))
            spots = np.concatenate([[0], np.cumsum(runs)])[cut]
            for part, _ in got:
                a, b, c, d = *cut[part : part + 2], *spots[part : part + 2]
                own = runs[a:b][np.argsort(numbers[a:b])]
                rows.append((part, key[0].as_py(), _pack(numbers[a:b], own, _gaps(context[c:d], own), count[c:d])))
        return arrow_table(rows, PAIRS)

    pairs = blocks.bucketed(table.groupBy("block").cogroup(numbered.where("block >= 0").groupBy("block")).applyInArrow(send, PAIRS), "part", "model_pairs")

    def gather(key, sent, held):
        return arrow_table([(key[0].as_py(), Seats.gather(_unpack(held.column("data")[0].as_py())[0], sent.column("data").to_pylist()).write())] if sent.num_rows else [], SEATS)

    seats = blocks.bucketed(pairs.groupBy("part").cogroup(numbered.where("block < 0").groupBy("part")).applyInArrow(gather, SEATS), "part", "model_seats")

    def begin(batches):
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist(), strict=True):
                own = Seats.read(data)
                none = np.zeros(0, dtype=np.int64)
                tables = [np.ones(len(own.open_word), dtype=np.int64)] * CHAINS
                state = State(tables, [np.minimum(own.known, 1)] * CHAINS, [none] * CHAINS, np.zeros(len(own.known), dtype=np.int64), own.known, none)
                yield from arrow_table(_reports(part, own, state, n_parts, True), MESSAGES).to_batches()

    def add_up(arrow):
        at = dict(zip(arrow.column("sender").to_pylist(), arrow.column("data").to_pylist(), strict=True))
        if -1 not in at:
            return arrow_table([], MESSAGES)
        part, state, asked = arrow.column("part")[0].as_py(), State.read(at.pop(-1)), []
        state.sums, own = np.zeros(2 * CHAINS, dtype=np.int64), [np.zeros(len(state.known), dtype=np.int64) for _ in range(CHAINS)]
        for sender, raw in at.items():
            sums, gaps, *tables, lone, alone = _unpack(raw)
            numbers = np.cumsum(gaps)
            state.sums += sums
            for o, t in zip(own, tables, strict=True):
                o[numbers] += t
            state.alone[np.cumsum(lone)] += alone
            if len(numbers):
                asked.append((sender, numbers))
        state.own = [o + state.alone for o in own]
        return arrow_table([(part, -1, state.write()), *((sender, part, _pack(*(o[n] for o in state.own))) for sender, n in asked)], MESSAGES)

    messages = seats.mapInArrow(begin, MESSAGES).groupBy("part").applyInArrow(add_up, MESSAGES)

    def sweep(turn):
        def again(key, held, got):
            if not held.num_rows:
                return arrow_table([], MESSAGES)
            part, own = key[0].as_py(), Seats.read(held.column("data")[0].as_py())
            at = dict(zip(got.column("sender").to_pylist(), got.column("data").to_pylist(), strict=True))
            state, order = State.read(at.pop(-1)), _by_part(own.contexts, n_parts)[0]
            totals = np.zeros((CHAINS, len(order)), dtype=np.int64)
            if at:
                totals[:, order] = np.concatenate([np.stack(_unpack(at[sender])) for sender in sorted(at)], axis=1)
            own.sweep(state, totals, vocabulary, np.random.default_rng([seed, turn, part]))
            return arrow_table(_reports(part, own, state, n_parts, False), MESSAGES)

        return again

    for turn in range(sweeps):
        messages = seats.groupBy("part").cogroup(messages.groupBy("part")).applyInArrow(sweep(turn), MESSAGES).groupBy("part").applyInArrow(add_up, MESSAGES)

    def answer(key, asked, held):
        rows = []
        if asked.num_rows:
            state = State.read(held.column("data")[0].as_py())
            own = Seats.gather(state.known, asked.column("data").to_pylist())
            tables = np.full(len(own.word), CHAINS, dtype=np.int64)
            tables[own.open] = sum(state.tables)
            by_word = [state.known, *(own.served(t) for t in state.tables), *state.root, *state.own]
            wide = int(own.context.max()) + 1 if len(own.context) else 1
            seen = own.word * wide + own.context
            for block, raw in zip(asked.column("block").to_pylist(), asked.column("data").to_pylist(), strict=True):
                numbers = _unpack(raw)[0]
                word, context, _ = _sent(raw)
                customers, sat = np.zeros((2, len(word)), dtype=np.int64)
                if len(seen):
                    spot = np.minimum(np.searchsorted(seen, word * wide + context), len(seen) - 1)
                    hit = (own.word[spot] == word) & (own.context[spot] == context)
                    customers[hit], sat[hit] = own.customers[spot[hit]], tables[spot[hit]]
                rows.append((block, key[0].as_py(), _pack(numbers, state.sums, customers, sat, *(x[numbers] for x in by_word))))
        return arrow_table(rows, BACK)

    back = written(pairs.groupBy("part").cogroup(messages.where("sender < 0").groupBy("part")).applyInArrow(answer, BACK), "model-answers")
    id_type = table.schema["ids"].dataType.elementType
    schema = StructType([StructField("doc_id", id_type), *StructType.fromDDL("held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double").fields])
    arrow = to_arrow_schema(schema)

    def finish(key, left, right):
        rows = []
        if left.num_rows:
            block = blocks.unpack(left)
            tokens = Tokens(block)
            got = [_unpack(d) for _, d in sorted(zip(right.column("part").to_pylist(), right.column("data").to_pylist(), strict=True))]
            sums = got[0][1]
            numbers, customers, sat, known, *by_chain = (np.concatenate([x[i] for x in got]) for i in (0, *range(2, 5 + 3 * CHAINS)))
            served, root_tables, tables = (np.stack(by_chain[k * CHAINS : (k + 1) * CHAINS]) for k in range(3))
            guests, all_tables = sums[:CHAINS, None], sums[CHAINS:, None]
            root = (served - DISCOUNT[1] * root_tables + (STRENGTH[1] + DISCOUNT[1] * all_tables) / (vocabulary + 1)) / (STRENGTH[1] + guests)
            back_off = (STRENGTH[0] + DISCOUNT[0] * tables) / (STRENGTH[0] + known)
            word, context, _, entry = tokens.pairs()
            order = _sent_order(numbers, tokens.edges(n_parts), n_parts, word, context)
            word, context = word[order], context[order]
            chance = np.empty(len(order))
            chance[order] = (customers - DISCOUNT[0] * sat / CHAINS) / (STRENGTH[0] + known[context]) + sum(b[context] * r[word] for b, r in zip(back_off, root, strict=True)) / CHAINS
            c = known[tokens.word]
            first = tokens.stops - tokens.sizes
            n_known = np.add.reduceat((c > 0).astype(np.int64), first)
            base = np.add.reduceat(np.log10((c + 1) / (total + vocabulary + 1)), first)
            model_score = np.add.reduceat(np.log10(chance)[entry], first)
            for i, doc in enumerate(block.ids):
                n, s = int(tokens.sizes[i]), float(model_score[i])
                rows.append((doc, not block.flags[i], n, int(n_known[i]), int(total), float(base[i]), s, 10 ** min(300.0, -s / n)))
        return arrow_table(rows, arrow)

    return table.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(finish, schema)


def report(docs: DataFrame) -> DataFrame:
    """Scores of every document by the model of those whose id hash is not held out."""
    return score(docs, id_bucket("doc_id", 7) != 2)
