"""Benchmark decontamination by the q-gram lemma and banded alignment.

Benchmark items are cut into overlapping windows, long ones that may have more edits and short
ones that find short passages. A window of m bytes that stands in a document
with at most k edits shares at least m - q + 1 - kq of its q-grams with it, and all of them lie
within a band of k + 1 diagonals. So the q-grams of a document that also occur in the benchmark
are counted per window and overlapping diagonal band, regions that reach the count are kept, and
an alignment within the band gives their edit distance.

The benchmark is taken in blocks of at most ``BLOCK_BYTES``; each block is an index that every
task gets, and the documents are read once per block.
"""

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from mainstreet.llm import blocks

Q = 10
WINDOW = 80
SHORT = 50  # of an item that is longer than that
STRIDE = 6  # so a passage of SHORT + STRIDE - 1 bytes holds a whole window
EDITS = 0.08  # of the window's bytes
SHORT_EDITS = 2
BLOCK_BYTES = 1 << 20

_BITS = 22
_PLAIN = blocks.LOWER_ASCII.copy()
_PLAIN[[9, 10, 11, 12, 13]] = 32
_FAR = 1 << 20
_LOT = 1 << 14  # windows that are aligned at a time


class Index:
    """The q-grams of one block of items, and their windows."""

    def __init__(self, items):
        """``items``: (id, text) pairs. Texts shorter than a q-gram have no windows."""
        texts = [_PLAIN[np.frombuffer(t.encode(), np.uint8)] for _, t in items]
        self.ids = [i for i, _ in items]
        ends = np.cumsum([0] + [len(t) for t in texts])
        self.bytes = np.concatenate([*texts, np.zeros(0, np.uint8)])
        first, last, owner, most = [], [], [], []
        for item, t in enumerate(texts):
            n, base = len(t), ends[item]
            if n < Q:
                continue
            for width, edits in ((WINDOW, _FAR), (SHORT, SHORT_EDITS))[: 1 + (n > SHORT)]:
                for at in sorted({*range(0, max(1, n - width + 1), STRIDE), max(0, n - width)}):
                    first.append(base + at)
                    last.append(base + min(n, at + width))
                    owner.append(item)
                    most.append(edits)
        self.first, self.last, self.owner = (np.array(v, np.int64) for v in (first, last, owner))
        length = self.last - self.first
        # at least one shared q-gram is asked for, so fewer edits are allowed in short windows
        self.edits = np.minimum((length * EDITS).astype(np.int64), np.maximum(0, (length - Q) // Q))
        self.edits = np.minimum(self.edits, np.array(most, np.int64))
        self.least = np.maximum(1, length - Q + 1 - self.edits * Q)
        self.step = max(1, int(self.edits.max())) if len(first) else 1
        self.windows = np.bincount(self.owner, minlength=len(items))
        # windows over each position, and grams with the positions where they occur
        grams = length - Q + 1
        window = np.repeat(np.arange(len(first), dtype=np.int32), grams)
        position = self.first[window] + np.arange(len(window)) - np.repeat(np.cumsum(grams) - grams, grams)
        self.window = window[np.argsort(position, kind="stable")]
        over = np.bincount(position, minlength=len(self.bytes))
        self.over = np.concatenate([[0], np.cumsum(over)])
        position = np.flatnonzero(over)
        hashes = blocks.gram_hashes(self.bytes, Q)[position] if len(position) else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.position = position[order]
        self.grams, self.start, self.count = np.unique(hashes[order], return_index=True, return_counts=True)
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[(self.grams >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def _shared(self, offsets, data):
        """Position in the block, row and position in the benchmark of every shared q-gram."""
        hashes = blocks.gram_hashes(data, Q)
        at = np.flatnonzero(self.maybe[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)])
        gram = np.minimum(np.searchsorted(self.grams, hashes[at]), len(self.grams) - 1)
        row = np.searchsorted(offsets, at, "right") - 1
        same = (self.grams[gram] == hashes[at]) & (at + Q <= offsets[row + 1])
        at, gram, row = at[same], gram[same], row[same]
        n = self.count[gram]
        each = np.repeat(np.arange(len(at)), n)
        entry = self.start[gram][each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
        return at[each], row[each], self.position[entry]

    def regions(self, offsets, data):
        """(row, window, band) of every band with enough shared q-grams."""
        at, row, position = self._shared(offsets, data)
        band = (at - position + len(self.bytes)) // self.step
        bands = (len(data) + len(self.bytes)) // self.step + 2
        # band b holds the diagonals of steps b and b + 1, so every diagonal is in two bands
        wide = len(self.bytes) + WINDOW
        both = np.concatenate([row * bands + band, row * bands + np.maximum(band - 1, 0)])
        keys = np.sort(both * wide + np.concatenate([position, position]))
        # a window with enough of them begins, at the latest, with one that the others follow closely
        fewest = int(self.least.min())
        close = keys[fewest - 1 :] - keys[: max(0, len(keys) - fewest + 1)] <= WINDOW - Q
        begins = np.unique(keys[: len(close)][close])
        position = begins % wide
        n = self.over[position + 1] - self.over[position]
        each = np.repeat(np.arange(len(begins)), n)
        window = self.window[self.over[position][each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)]
        rest, window = np.divmod(np.unique((begins // wide)[each] * len(self.first) + window), max(1, len(self.first)))
        n = np.searchsorted(keys, rest * wide + self.last[window] - Q, "right") - np.searchsorted(keys, rest * wide + self.first[window])
        good = n >= self.least[window]
        row, band = np.divmod(rest[good], bands)
        return row, window[good], band

    def align(self, offsets, data, row, window, band):
        """Edit distance of each window to the text within its band, and where it ends in the text.

        A window that has more edits than it may have is given up, with a distance that is far.
        """
        best, end = np.full(len(row), _FAR, np.int32), np.zeros(len(row), np.int64)
        for low in range(0, len(row), _LOT):
            which = np.arange(low, min(low + _LOT, len(row)))
            self._align(offsets, data, row, window, band, which, best, end)
        return best, np.clip(end, offsets[row], offsets[row + 1])

    def _align(self, offsets, data, row, window, band, which, best, end):
        row, window, band = row[which], window[which], band[which]
        k = self.step
        low = band * k - len(self.bytes) - k  # lowest diagonal of the band, with room for the edits
        width = 4 * k + 1
        column = np.arange(width)
        cost = np.zeros((len(row), width), np.int32)  # the text before the window is free
        length = self.last[window] - self.first[window]
        begin, stop = offsets[row], offsets[row + 1]
        for j in range(int(length.max())):
            if j % 8 == 0:  # the least cost never falls, so these stay too far
                go = (cost.min(1) <= self.edits[window]) & (length > j)
                which, window, low, cost = which[go], window[go], low[go], cost[go]
                length, begin, stop = length[go], begin[go], stop[go]
                if not len(which):
                    break
            at = (self.first[window] + j + low)[:, None] + column
            inside = (at >= begin[:, None]) & (at < stop[:, None])
            letter = data[np.where(inside, at, 0)]
            wanted = self.bytes[np.minimum(self.first[window] + j, len(self.bytes) - 1)]
            change = cost + np.where(inside & (letter == wanted[:, None]), 0, 1)
            skip = np.full_like(cost, _FAR)
            skip[:, :-1] = cost[:, 1:] + 1  # a byte of the window is missing in the text
            new = np.minimum(change, skip)
            # bytes of the text that are not in the window: one more for each step to the right
            new = np.minimum.accumulate(new - column, axis=1) + column
            live = j < length
            cost = np.where(live[:, None], new, cost).astype(np.int32)
            over = j + 1 == length
            if over.any():
                where = cost[over].argmin(1)
                best[which[over]] = cost[over][np.arange(len(where)), where]
                end[which[over]] = (self.last[window[over]] - 1 + low[over]) + where + 1

    def find(self, offsets, data):
        """Per text and item with a match: row, item, windows found, least distance, start and end in the text."""
        data = _PLAIN[data]
        if not len(self.grams) or not len(data):
            return [np.zeros(0, np.int64)] * 6
        row, window, band = self.regions(offsets, data)
        distance, end = self.align(offsets, data, row, window, band)
        good = distance <= self.edits[window]
        row, window, distance, end = row[good], window[good], distance[good], end[good]
        start = np.maximum(end - (self.last - self.first)[window], offsets[row])
        key = row * len(self.ids) + self.owner[window]
        keys, inverse = np.unique(key, return_inverse=True)
        out_start, out_end, least = np.full(len(keys), _FAR << 20), np.zeros(len(keys), np.int64), np.full(len(keys), _FAR)
        np.minimum.at(out_start, inverse, start)
        np.maximum.at(out_end, inverse, end)
        np.minimum.at(least, inverse, distance)
        pairs = np.unique(np.column_stack([inverse, window]), axis=0)[:, 0] if len(window) else inverse
        row = keys // max(1, len(self.ids))
        return [
            row, keys % max(1, len(self.ids)), np.bincount(pairs, minlength=len(keys)), least,
            out_start - offsets[row], out_end - offsets[row],
        ]


def indexes(benchmark, item_col="item_id", text_col="text"):
    """The indexes of all blocks of the benchmark, one after the other; null texts are left out."""
    items = benchmark.where(F.col(text_col).isNotNull()).select(F.col(item_col).alias("i"), F.col(text_col).alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-total // BLOCK_BYTES))
    for part in range(parts):
        chosen = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part)
        yield Index([(r["i"], r["t"]) for r in chosen.orderBy("i", "t").collect()])


def matches(docs, benchmark, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text"):
    """One row per document and item that it holds a window of.

    ``windows`` of the item's ``item_windows`` were found, the nearest with ``distance`` edits,
    between the bytes ``start`` and ``end`` of the text (give or take the edits). Case and kind of
    white space do not count. Null and empty texts and items under ten bytes match nothing; repeated
    rows are searched like any other; an empty table gives no rows.
    """
    kinds = {f.name: f.dataType for f in docs.schema.fields}, {f.name: f.dataType for f in benchmark.schema.fields}
    longs = ["windows", "item_windows", "distance", "start", "end"]
    schema = T.StructType([
        T.StructField("doc", kinds[0][id_col]), T.StructField("item", kinds[1][item_col]),
        *[T.StructField(n, T.LongType()) for n in longs],
    ])
    slim = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("_text"))
    found = None
    for index in indexes(benchmark, item_col, item_text_col):
        part = slim.mapInArrow(_matcher(index, to_arrow_type(kinds[1][item_col]), schema.names), schema)
        found = part if found is None else found.unionByName(part)
    return found.withColumnsRenamed({"doc": id_col, "item": item_col})


def _matcher(index, item_type, names):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for first, offsets, data in blocks.text_blocks(batch.column(1)):
                row, item, windows, distance, start, end = index.find(offsets, data)
                if len(row):
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(row + first)),
                            pa.array([index.ids[i] for i in item], item_type),
                            *[pa.array(v, pa.int64()) for v in (windows, index.windows[item], distance, start, end)],
                        ],
                        names,
                    )

    return run


def clean(docs, benchmark, text_col="text", item_col="item_id", item_text_col="text"):
    """The documents without a window of any item, with their columns; rows stay where they are."""

    def flag(index):
        def compute(offsets, data):
            hit = np.zeros(len(offsets) - 1, bool)
            hit[index.find(offsets, data)[0]] = True
            return [hit]

        return compute

    leak = blocks.free_name(docs, "_leak")
    field = [T.StructField(leak, T.BooleanType())]
    for index in indexes(benchmark, item_col, item_text_col):
        docs = blocks.append_columns(docs, text_col, field, flag(index)).where(~F.col(leak)).drop(leak)
    return docs
