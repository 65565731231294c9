"""Language-model scoring with a log-frequency Bloom filter.

Counts of word pairs in the training rows are quantised on a logarithmic scale; a pair with level j
is put into the filter once for each level up to j. To read a count, the levels are probed one after
the other until one is missing. Probabilities use absolute discounting with a discount of one::

    P(w | h) = (q(h, w) - 1) / c(h) + rest(h) * (c(w) + 1) / (N + V + 1)

``q`` is the least count of the pair's level, so it never exceeds the count; ``rest(h)`` is what the
discounts and the quantisation of all pairs of ``h`` leave, so the probabilities of all words after
``h`` and of an unknown one come to 1. A pair seen once leaves all of its count to the rest, at every
size of the corpus: it counts in ``c(h)`` and ``rest(h)``, and needs no place in the filter. Word
counts and rests are exact: they come from a broadcast dictionary of the commonest words, at most
``DICTIONARY_WORDS``, and from joins for all others.

Counting is spread over parts of the hash space of the histories: every task sends each part its
distinct words and pairs with their counts, and each part makes its own slice of the filter. The
slices are broadcast in groups of at most ``FILTER_BYTES``; a worker holds one group at a time.
"""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mainstreet.llm import blocks
from mainstreet.plans.workspace import materialise

FILTER_BYTES = 64 << 20  # of slices that a worker holds at a time
DICTIONARY_WORDS = 2_000_000
PART_BYTES = 8 << 20  # of text, for each part of the hash space
MOST_PARTS = 4096  # a task sends at most one row to each, so rows grow with the text
FLUSH_BYTES = 8 << 20  # of text, between two lots of counts from a task

BLOCK = 1 << 20  # of text; longer blocks have fewer distinct words to look up
LOT = 4 << 20  # of text that is scored with one group of slices after the other

BITS = 14  # of the filter for every level but the first
PROBES = 6
FIRST_BITS = 30  # of the filter for the first level: one in a million pairs not stored is found
FIRST_PROBES = 20
BASE = 1.5  # of the scale of counts
LEAST = 2  # the discount takes all of a count of one

_START = np.uint64(0x0123456789ABCDEF)
_END = np.uint64(0xFEDCBA9876543210)


def tokens(offsets, data):
    """Hashes and rows of the tokens of every text in order: its words in lower-case ASCII, then one end."""
    n = len(offsets) - 1
    data = blocks.LOWER_ASCII[data]
    starts, ends, row = blocks.words(offsets, data)
    place = np.arange(len(row)) + row
    out = np.full(len(row) + n, _END, np.uint64)
    out[place] = blocks.span_hashes(data, starts, ends)
    rows = np.zeros(len(out), np.int64)
    rows[place] = row
    last = np.cumsum(np.bincount(row, minlength=n) + 1) - 1
    rows[last] = np.arange(n)
    return out, rows, last


def pair_hashes(words, last):
    """Hash of every token with the one before it; the first one of a text follows a start."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    before[first] = _START
    return blocks.mix(before * np.uint64(0x9E3779B97F4A7C15) + words), before


def _merged(keys, counts):
    """Distinct keys, sorted, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _part(keys, parts):
    return ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _planes(keys):
    """Sorted keys with equal bytes side by side, which the shuffle compresses better."""
    return np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(raw):
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def _count_rows(parts):
    """Lots of counts of a task: a row for every part that has some, with its distinct words and pairs."""

    def lot(gathered):
        import pyarrow as pa

        words = _merged(*(np.concatenate([g[0][i] for g in gathered]) for i in range(2)))
        pairs = [np.concatenate([g[1][i] for g in gathered]) for i in range(3)]
        gathered.clear()
        # pairs of one history side by side, in the order of the words' parts
        order = np.lexsort((pairs[0], pairs[2]))
        keys, counts, history = (v[order] for v in pairs)
        del pairs, order
        new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (history[1:] != history[:-1])])) if len(keys) else np.zeros(0, np.int64)
        keys, history, counts = keys[new], history[new], np.add.reduceat(counts, new) if len(new) else counts
        edges = np.arange(parts + 1, dtype=np.uint64)
        word_cut, pair_cut = np.searchsorted(_part(words[0], parts), edges), np.searchsorted(_part(history, parts), edges)
        some = np.flatnonzero((np.diff(word_cut) > 0) | (np.diff(pair_cut) > 0))

        def packed(values, cut):
            return pa.array([values[cut[p] : cut[p + 1]].tobytes() for p in some], pa.binary())

        def planes(values, cut):
            return pa.array([_planes(values[cut[p] : cut[p + 1]]) for p in some], pa.binary())

        # a history is told by its number among those of the row, so it costs little
        begins = np.concatenate([[True], history[1:] != history[:-1]]) if len(history) else np.zeros(0, bool)
        distinct = history[begins]
        sizes = np.diff(np.append(np.flatnonzero(begins), len(history))).astype(np.uint32)
        hist_cut = np.searchsorted(_part(distinct, parts), edges)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(some.astype(np.int32)), planes(words[0], word_cut), packed(words[1].astype(np.uint32), word_cut),
                planes(keys, pair_cut), packed(counts.astype(np.uint32), pair_cut), planes(distinct, hist_cut), packed(sizes, hist_cut),
            ],
            _LOT_COLUMNS,
        )

    def run(batches):
        gathered, size = [], 0
        for batch in batches:
            for _, offsets, data in blocks.text_blocks(batch.column(0), BLOCK):
                words, _, last = tokens(offsets, data)
                pairs, before = pair_hashes(words, last)
                keys, at, counts = np.unique(pairs, return_index=True, return_counts=True)
                word_keys, word_counts = np.unique(words, return_counts=True)
                gathered.append(((word_keys, word_counts.astype(np.int64)), (keys, counts.astype(np.int64), before[at])))
                size += len(data)
                if size >= FLUSH_BYTES:
                    yield lot(gathered)
                    gathered, size = [], 0
        if gathered:
            yield lot(gathered)

    return run


_LOT_COLUMNS = ["part", "words", "word_counts", "pairs", "pair_counts", "histories", "sizes"]


def _levels(counts):
    return 1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9).astype(np.int64)


def _least(levels):
    """The least count of a level."""
    return np.ceil(BASE ** (np.maximum(levels, 1) - 1.0) - 1e-9)


def _merge_part(table):
    """A part's words with their counts and rests, and its slice of the filter."""
    import pyarrow as pa

    def all_of(column, kind=None):
        found = [v.as_py() for v in table.column(column)]
        return np.concatenate([_unplanes(v) if kind is None else np.frombuffer(v, kind).astype(np.int64) for v in found])

    words, word_counts = _merged(all_of("words"), all_of("word_counts", np.uint32))
    keys, counts = all_of("pairs"), all_of("pair_counts", np.uint32)
    history = np.repeat(all_of("histories"), all_of("sizes", np.uint32))
    order = np.argsort(keys, kind="stable")
    keys, counts, history = keys[order], counts[order], history[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else order
    keys, history, counts = keys[first], history[first], np.add.reduceat(counts, first) if len(first) else counts

    # what the words after a history get, and what is left of its count
    kept = counts >= LEAST
    levels = _levels(counts[kept])
    told, number = np.unique(history, return_inverse=True)
    total = np.bincount(number, counts, len(told))
    given = np.bincount(number[kept], _least(levels) - 1, len(told))
    rest = 1 - given / np.maximum(total, 1)
    at = np.searchsorted(told, words)
    at[at == len(told)] = 0
    is_history = told[at] == words if len(told) else np.zeros(len(words), bool)
    rests = np.where(is_history, rest[at] if len(told) else 1.0, 1.0)
    start = np.flatnonzero(told == _START)

    bits = _filled(keys[kept], levels)
    common = [int((word_counts >= f).sum()) for f in 2 ** np.arange(48)]
    return pa.table({
        "part": table.column("part").slice(0, 1),
        "words": pa.array([words.tobytes()], pa.binary()),
        "word_counts": pa.array([word_counts.tobytes()], pa.binary()),
        "rests": pa.array([rests.tobytes()], pa.binary()),
        "bits": pa.array([bits.tobytes()], pa.binary()),
        "n_bits": pa.array([len(bits)]),
        "tokens": pa.array([int(word_counts.sum())]),
        "types": pa.array([len(words)]),
        "start_rest": pa.array([float(rest[start[0]]) if len(start) else None], pa.float64()),
        "common": pa.array([common], pa.list_(pa.int64())),
    })


def _probes(level):
    return FIRST_PROBES if level == 1 else PROBES


def _positions(keys, level, bits):
    """The bits of an entry within its slice of less than 2 ** 32 bits."""
    a = blocks.mix(keys + np.uint64(0x9E3779B97F4A7C15) * level.astype(np.uint64))
    b = (a << np.uint64(32)) | (a >> np.uint64(32)) | np.uint64(1)
    for i in range(_probes(int(level[0]))):
        yield (((a + np.uint64(i) * b) >> np.uint64(32)) * bits) >> np.uint64(32)


def _filled(keys, levels):
    """A slice of the filter. All its pairs have ``LEAST`` occurrences, so their second level goes without saying."""
    above = np.maximum(levels - 2, 0)
    size = min(2**32 - 8, max(4096, -(-(len(keys) * FIRST_BITS + int(above.sum()) * BITS) // 8) * 8))
    bits = np.zeros(size, bool)
    for level in [1, *range(3, int(levels.max(initial=0)) + 1)]:
        for at in _positions(keys[levels >= level], np.full(1, level), np.uint64(size)):
            bits[at.astype(np.int64)] = True
    return np.packbits(bits, bitorder="little")


@dataclass
class Filter:
    """The slices of all parts, one after the other."""

    raw: np.ndarray
    first: np.ndarray  # bit at which a part's slice begins
    size: np.ndarray

    part: np.ndarray = None  # for every part of the hash space, its number here or -1
    parts: int = 0

    def levels(self, keys, part, sure=1):
        """The levels of pairs: 0 if the first is missing, else the last one found; up to ``sure`` all have what they need."""
        found = np.zeros(len(keys), np.int64)
        at = np.arange(len(keys))
        level = 1
        while len(at):
            for position in _positions_of(keys, part, level, self.size):
                bit = self.first[part[at]] + position(at).astype(np.int64)
                at = at[(self.raw[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1]
            found[at] = max(level, sure)
            level = max(level, sure) + 1
        return found

    def counts(self, keys):
        """The least counts of the levels found."""
        found = self.levels(keys, np.zeros(len(keys), np.int64))
        return np.where(found > 0, _least(found), 0.0)


def _positions_of(keys, part, level, size):
    """As :func:`_positions`, for the entries that are still in question at each probe."""
    mixed = blocks.mix(keys + np.uint64(0x9E3779B97F4A7C15) * np.full(1, level, np.uint64))

    def probe(i):
        def position(at):
            a = mixed[at]
            b = (a << np.uint64(32)) | (a >> np.uint64(32)) | np.uint64(1)
            return (((a + np.uint64(i) * b) >> np.uint64(32)) * size[part[at]]) >> np.uint64(32)

        return position

    return [probe(i) for i in range(_probes(level))]


@dataclass
class Dictionary:
    """The commonest words in order of their hashes, with counts and rests, and the rest after the start."""

    words: np.ndarray
    counts: np.ndarray
    rests: np.ndarray
    start_rest: float
    tokens: int
    types: int

    def find(self, keys):
        """Place of each key, -1 for words that are not here."""
        if not len(self.words):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.words, keys), len(self.words) - 1)
        return np.where(self.words[at] == keys, at, -1)


@dataclass
class Model:
    """Broadcasts of the dictionary and of the groups of slices. ``often``: all words that occur as often are in the dictionary."""

    dictionary: object
    groups: list
    tokens: int
    types: int
    words: int
    often: int

    def free(self):
        for shared in (self.dictionary, *self.groups):
            shared.unpersist()


class Lot:
    """Texts with their tokens, scored with one group of slices after the other."""

    def __init__(self, offsets, data, dictionary, often):
        self.n, self.dictionary, self.often = len(offsets) - 1, dictionary, often
        words, self.rows, last = tokens(offsets, data)
        self.pairs, before = pair_hashes(words, last)
        self.words = words
        distinct, inverse = np.unique(words, return_inverse=True)
        place = dictionary.find(distinct)
        exact = np.where(place >= 0, dictionary.counts[place] if len(dictionary.counts) else 0, 0)
        rest = np.where(place >= 0, dictionary.rests[place] if len(dictionary.rests) else 1.0, 1.0)
        self.here = (place >= 0)[inverse]
        self.count = exact[inverse]
        first = np.concatenate([[0], last[:-1] + 1]) if self.n else last
        # the history of a token is the one before it
        self.before, self.total, self.rest, self.history_here = before, np.empty(len(words)), np.empty(len(words)), np.ones(len(words), bool)
        self.total[1:], self.rest[1:], self.history_here[1:] = self.count[:-1], rest[inverse[:-1]], self.here[:-1]
        ends = dictionary.find(np.array([_END]))[0]
        self.total[first], self.rest[first], self.history_here[first] = dictionary.counts[ends] if ends >= 0 else 0, dictionary.start_rest, True
        # words outside the dictionary are too rare to have pairs if none of them occurs LEAST times
        self.asked = self.rest < 1
        if often > LEAST:
            self.asked |= ~self.history_here
        self.level = np.zeros(len(words), np.int64)

    def look(self, group):
        part = group.part[_part(self.before, group.parts).astype(np.int64)]
        at = np.flatnonzero(self.asked & (part >= 0))
        self.level[at] = group.levels(self.pairs[at], part[at], LEAST)

    def add(self, values, mask=None):
        rows = self.rows if mask is None else self.rows[mask]
        return np.bincount(rows, values if mask is None else values[mask], self.n)

    def listed(self, mask, *keys):
        """Per text the distinct combinations of keys among the tokens of ``mask`` with their numbers, and the ends of the lists."""
        if not mask.any():
            return [np.zeros(0, np.uint64)] * len(keys), np.zeros(0, np.int64), np.zeros(self.n + 1, np.int64)
        columns = [self.rows[mask].astype(np.uint64), *[k[mask].astype(np.uint64) for k in keys]]
        order = np.lexsort(columns[::-1])
        columns = [v[order] for v in columns]
        new = np.flatnonzero(np.concatenate([[True], np.any([v[1:] != v[:-1] for v in columns], axis=0)]))
        cut = np.searchsorted(columns[0][new], np.arange(self.n + 1, dtype=np.uint64))
        return [v[new] for v in columns[1:]], np.diff(np.append(new, len(order))), cut

    def result(self):
        """Per text: tokens, known ones, sum of log10(c + 1), sum of the logs of what is settled here, and what is left to joins.

        Left are words outside the dictionary, whose base is added to the score as well; histories
        outside of it, whose rest is; and pairs that are in the filter with either outside.
        """
        base = np.log10(self.dictionary.tokens + self.dictionary.types + 1.0)
        found = self.level > 0
        if self.often <= LEAST:
            # words outside the dictionary occur less than LEAST times, so what the filter says of them is chance
            found &= self.here
        both = self.here & self.history_here
        pair = found & both
        plain = ~found  # log rest + log base
        score = np.zeros(len(self.words))
        own = (self.count + 1.0) / 10.0**base
        score[pair] = np.log10((_least(self.level[pair]) - 1) / self.total[pair] + self.rest[pair] * own[pair])
        score[plain & self.here] += np.log10(own[plain & self.here])
        score[plain & ~self.here] -= base
        score[plain & self.history_here] += np.log10(self.rest[plain & self.history_here])
        logs = np.log10(self.count + 1.0)
        columns = [np.bincount(self.rows, minlength=self.n), self.add(self.here * 1.0).astype(np.int64), self.add(logs), self.add(score)]
        outside = ~self.here
        lists = [
            self.listed(outside, self.words, plain * 1),
            self.listed(plain & ~self.history_here, self.before) if self.often > LEAST else self.listed(np.zeros(len(self.words), bool), self.before),
            self.listed(found & ~both, self.before, self.words, self.level),
        ]
        return columns, lists


def fit(docs, text_col="text"):
    """Count the words and pairs of the texts; returns the model and the stored counts, one row per part."""
    texts = docs.select(F.col(text_col).alias("t"))
    size = texts.agg(F.sum(F.octet_length("t") + 1)).first()[0] or 0
    parts = min(MOST_PARTS, max(4, -(-size // PART_BYTES)))
    lots = texts.mapInArrow(
        _count_rows(parts), "part int, words binary, word_counts binary, pairs binary, pair_counts binary, histories binary, sizes binary"
    )
    counted = materialise(lots.groupBy("part").applyInArrow(
        _merge_part,
        "part int, words binary, word_counts binary, rests binary, bits binary, n_bits bigint, tokens bigint, types bigint, "
        "start_rest double, common array<bigint>",
    ))
    sums = counted.agg(
        F.sum("tokens").alias("tokens"), F.sum("types").alias("types"), F.max("start_rest").alias("start_rest"),
        *[F.sum(F.col("common")[i]).alias(f"common{i}") for i in range(48)],
    ).first()
    often = 2 ** next((i for i in range(48) if (sums[f"common{i}"] or 0) <= DICTIONARY_WORDS), 47)
    share = docs.sparkSession.sparkContext.broadcast
    # the commonest words, DICTIONARY_WORDS at most
    common = counted.select("words", "word_counts", "rests").mapInArrow(_common_words(often), "k binary, c binary, r binary").toArrow()
    keys, counts, rests = (
        np.concatenate([np.frombuffer(v, kind) for v in common.column(i).to_pylist()] or [np.zeros(0, kind)])
        for i, kind in enumerate((np.uint64, np.int64, np.float32))
    )
    del common
    order = np.argsort(keys)
    counts = counts if counts.max(initial=0) >= 2**32 else counts.astype(np.uint32)
    start_rest = 1.0 if sums["start_rest"] is None else sums["start_rest"]
    total, types, words = sums["tokens"] or 0, sums["types"] or 0, len(keys)
    dictionary = share(Dictionary(keys[order], counts[order], rests[order], start_rest, total, types))
    del keys, counts, rests, order
    return Model(dictionary, list(_groups(counted, parts, share)), total, types, words, often), counted


def _groups(counted, parts, share):
    """Broadcasts of runs of slices with ``FILTER_BYTES`` at most; the driver holds one run at a time."""
    runs, size = [[]], 0
    # one row per part, MOST_PARTS at most
    for row in counted.select("part", "n_bits").orderBy("part").collect():
        if runs[-1] and size + row["n_bits"] > FILTER_BYTES:
            runs.append([])
            size = 0
        runs[-1].append((row["part"], row["n_bits"]))
        size += row["n_bits"]
    for run in runs:
        names = [p for p, _ in run]
        raw, begin = np.zeros(sum(n for _, n in run), np.uint8), dict(zip(names, np.cumsum([0, *[n for _, n in run]])))
        if run:
            for part, bits in zip(*counted.where(F.col("part").between(names[0], names[-1])).select("part", "bits").toArrow().columns):
                raw[begin[part.as_py()] :][: len(bits.as_buffer())] = np.frombuffer(bits.as_buffer(), np.uint8)
        number = np.full(parts, -1)
        number[names] = np.arange(len(names))
        sizes = np.array([n * 8 for _, n in run], np.uint64)
        yield share(Filter(raw, np.array([begin[p] * 8 for p in names], np.int64), sizes, number, parts))
        del raw


def _common_words(often):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for k, c, r in zip(*batch.columns):
                counts = np.frombuffer(c.as_buffer(), np.int64)
                kept = counts >= often
                out.append((
                    np.frombuffer(k.as_buffer(), np.uint64)[kept].tobytes(), counts[kept].tobytes(),
                    np.frombuffer(r.as_buffer(), np.float64)[kept].astype(np.float32).tobytes(),
                ))
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary()) for v in zip(*out)] if out else [pa.array([], pa.binary())] * 3, ["k", "c", "r"])

    return run


def _word_rows(batches):
    """All words, one row each."""
    import pyarrow as pa

    for batch in batches:
        for values in zip(*batch.columns):
            columns = [np.frombuffer(v.as_buffer(), kind) for v, kind in zip(values, (np.int64, np.int64, np.float64))]
            for low in range(0, len(columns[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[low : low + 100_000]) for c in columns], ["h", "c", "r"])


_LISTS = [("_words", ["w", "plain"]), ("_histories", ["h"]), ("_pairs", ["h", "w", "level"])]


def _scorer(model, width, names):
    """Scores the rows of a batch in lots of ``LOT`` bytes, so that every group of slices is loaded once for many texts."""
    dictionary, groups, often = model.dictionary, model.groups, model.often

    def scored(waiting):
        """``waiting``: slices of a batch with the offsets and bytes of their texts."""
        import pyarrow as pa

        lots = [Lot(offsets, data, dictionary.value, often) for _, offsets, data in waiting]
        for group in groups:
            for lot in lots:
                lot.look(group.value)
            if len(groups) > 1:
                group.__dict__.pop("_value", None)  # one group at a time
        for i, (rows, _, _) in enumerate(waiting):
            counts, lists = lots[i].result()
            lots[i] = None
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            columns = [*rows.columns[:width], *map(pa.array, counts, kinds)]
            for (_, fields), (keys, often_seen, cut) in zip(_LISTS, lists):
                values = [pa.array(k.view(np.int64)) for k in keys] + [pa.array(often_seen.astype(np.int64))]
                listed = pa.StructArray.from_arrays(values, [*fields, "n"])
                columns.append(pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), listed))
            yield pa.RecordBatch.from_arrays(columns, names)

    def run(batches):
        for batch in batches:
            waiting, size = [], 0
            for row, offsets, data in blocks.text_blocks(batch.column(width), BLOCK):
                waiting.append((batch.slice(row, len(offsets) - 1), offsets, data))
                size += len(data)
                if size >= LOT or len(groups) == 1:
                    yield from scored(waiting)
                    waiting, size = [], 0
            yield from scored(waiting)

    return run


def score(docs, model, counted, text_col="text"):
    """The documents without their texts, with n_tokens, n_known, train_tokens, base_score and score.

    Null and empty texts consist of their end only. With nothing learned, all probabilities are 1.
    Repeated rows and null ids are scored like any others. Columns with these names are replaced.
    """
    added = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    columns = [c for c in docs.columns if c not in (text_col, *added)]
    lists = [
        T.StructField(name, T.ArrayType(T.StructType([T.StructField(f, T.LongType()) for f in [*fields, "n"]]))) for name, fields in _LISTS
    ]
    schema = T.StructType([
        *[docs.schema[c] for c in columns], T.StructField("n_tokens", T.LongType()), T.StructField("_known", T.LongType()),
        T.StructField("_logs", T.DoubleType()), T.StructField("score", T.DoubleType()), *lists,
    ])
    scored = docs.select(*columns, F.col(text_col)).mapInArrow(_scorer(model, len(columns), schema.names), schema)
    size = float(model.tokens + model.types + 1)
    nothing = F.lit(0.0)
    if model.types > model.words:
        # words outside the dictionary: exact counts and rests by joins
        scored = materialise(scored.withColumn("_row", F.monotonically_increasing_id()))
        exact = counted.select("words", "word_counts", "rests").mapInArrow(_word_rows, "h bigint, c bigint, r double")
        if model.often > 1:
            exact = exact.where(F.col("c") < model.often)

        def rows(name):
            return scored.select("_row", F.explode(name).alias("x")).select("_row", "x.*")

        own = F.log10(F.col("c") + 1.0) * F.col("n")
        parts = [
            rows("_words").join(exact.withColumnRenamed("h", "w"), "w").select(
                "_row", F.col("n").alias("known"), own.alias("logs"), (own * F.col("plain")).alias("score")
            )
        ]
        if model.often > LEAST:
            every = counted.select("words", "word_counts", "rests").mapInArrow(_word_rows, "h bigint, c bigint, r double")
            rest = rows("_histories").join(exact, "h").select(
                "_row", F.lit(0).cast("long").alias("known"), nothing.alias("logs"), (F.log10("r") * F.col("n")).alias("score")
            )
            # a pair of which one word is outside the dictionary; the start has a rest, but no count as a word
            start = model.dictionary.value.start_rest
            texts = every.where(F.col("h") == int(_END.view(np.int64))).select(F.lit(int(_START.view(np.int64))).alias("h"), "c", F.lit(start).alias("r"))
            told = every.unionByName(texts)
            seen = every.select(F.col("h").alias("w"), F.col("c").alias("cw"))
            least = F.ceil(F.pow(F.lit(BASE), F.col("level") - 1) - 1e-9)
            chance = (least - 1) / F.col("c") + F.col("r") * (F.coalesce("cw", F.lit(0)) + 1) / size
            # a pair that the filter has by chance may have a history that was never seen
            chance = F.when(F.col("c").isNull(), (F.coalesce("cw", F.lit(0)) + 1) / size).otherwise(F.least(chance, F.lit(1.0)))
            pairs = rows("_pairs").join(told, "h", "left").join(seen, "w", "left").select(
                "_row", F.lit(0).cast("long").alias("known"), nothing.alias("logs"), (F.log10(chance) * F.col("n")).alias("score")
            )
            parts += [rest, pairs]
        more = parts[0]
        for part in parts[1:]:
            more = more.unionByName(part)
        more = more.groupBy("_row").agg(F.sum("known").alias("_more"), F.sum("logs").alias("_more_logs"), F.sum("score").alias("_more_score"))
        scored = scored.join(more, "_row", "left").drop("_row")
    else:
        scored = scored.withColumns({"_more": F.lit(0), "_more_logs": nothing, "_more_score": nothing})
    logs = F.col("_logs") + F.coalesce("_more_logs", nothing)
    return scored.select(
        *columns,
        "n_tokens",
        (F.col("_known") + F.coalesce("_more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.log10(F.lit(size))).alias("base_score"),
        (F.col("score") + F.coalesce("_more_score", nothing)).alias("score"),
    )
