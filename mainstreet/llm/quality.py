"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins. Boosting goes through the features in turn, over and
over; each time a tree with at most four leaves is fitted to one feature's bins and a small part
of it is added to that feature's lookup table. Then the strongest pairs get tables of their own
in the same way. A text is scored by adding up table entries.
"""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mainstreet.llm import blocks

FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "digits", "marks", "exclamations", "bars", "symbols",
    "not_ascii", "distinct_words", "top_word", "same_as_previous", "distinct_lines", "words_per_line", "stops",
    "distinct_pairs",
)

_CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digits": range(48, 58),
    "marks": [b for b in range(33, 127) if not chr(b).isalnum()],
    "exclamations": [33, 63],
    "bars": [124],
    "symbols": [35, 36, 37, 38, 42, 60, 61, 62, 64, 94, 95, 126],
    "not_ascii": range(128, 256),
    "stops": [44, 46, 59, 58],
    "lines": [10],
}


def _distinct(rows, values, n):
    """Per row: distinct values and how often the commonest occurs."""
    order = np.lexsort((values, rows))
    r, v = rows[order], values[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(r)))
    most = np.zeros(n)
    np.maximum.at(most, r[at], runs)
    return np.bincount(r[at], minlength=n), most


def features(offsets, data):
    """One row of FEATURES per text of a block; a text without words has zeros for all shares."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    row = np.repeat(np.arange(n), np.diff(offsets))
    count = {}
    for name, members in _CLASSES.items():
        table = np.zeros(256, bool)
        table[list(members)] = True
        count[name] = np.bincount(row[table[data]], minlength=n)
    starts, ends, owner = blocks.words(offsets, data)
    words = np.bincount(owner, minlength=n)
    hashes = blocks.span_hashes(data, starts, ends)
    letters = np.bincount(owner, weights=ends - starts, minlength=n)
    distinct, most = _distinct(owner, hashes, n)
    near = owner[1:] == owner[:-1]
    same = np.bincount(owner[1:][near & (hashes[1:] == hashes[:-1])], minlength=n)
    pairs = np.bincount(owner[1:][near], minlength=n)
    pair_hash = hashes[:-1] * np.uint64(3) + hashes[1:]
    distinct_pairs, _ = _distinct(owner[1:][near], pair_hash[near], n)
    # lines: cut at line feeds and at the ends of texts
    cuts = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10) + 1])) if len(data) else offsets[:1]
    line_row = np.searchsorted(offsets, cuts[:-1], "right") - 1
    lines = np.bincount(line_row, minlength=n)
    distinct_lines, _ = _distinct(line_row, blocks.span_hashes(data, cuts[:-1], cuts[1:]), n)

    def share(a, b):
        return np.divide(a, b, out=np.zeros(n), where=b > 0)

    cased = count["upper"] + count["lower"]
    return np.column_stack([
        np.log1p(size), np.log1p(words), share(letters, words), share(count["upper"], cased), share(count["digits"], size),
        share(count["marks"], size), share(count["exclamations"], words), share(count["bars"], words),
        share(count["symbols"], words), share(count["not_ascii"], size), share(distinct, words), share(most, words),
        share(same, pairs), share(distinct_lines, lines), share(words, lines), share(count["stops"], words),
        share(distinct_pairs, pairs),
    ])


@dataclass
class Additive:
    """Bin edges and lookup tables; ``pairs`` holds (feature, feature, table)."""

    intercept: float
    edges: list
    tables: list
    pairs: list

    def bins(self, x):
        return [np.searchsorted(e, x[:, i], "right") for i, e in enumerate(self.edges)]

    def margins(self, x):
        at = self.bins(x)
        out = np.full(len(x), self.intercept)
        for table, b in zip(self.tables, at):
            out += table[b]
        for i, j, table in self.pairs:
            out += table[at[i], at[j]]
        return out

    def scores(self, x):
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


_RIDGE = 2.0


def _gain(g, h):
    return g * g / (h + _RIDGE)


def _cut(g, h):
    """The best cut of a run of bins: (gain, bins on the left)."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gains = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    at = int(np.argmax(gains))
    return float(gains[at]), at + 1


def _tree(g, h):
    """Values per bin of a tree of depth two over one feature's bins."""
    out = np.zeros(len(g))
    gain, at = _cut(g, h)
    if gain <= 1e-9:
        return out
    for low, high in ((0, at), (at, len(g))):
        deeper, mid = _cut(g[low:high], h[low:high])
        runs = [(low, low + mid), (low + mid, high)] if deeper > 1e-9 else [(low, high)]
        for a, b in runs:
            out[a:b] = g[a:b].sum() / (h[a:b].sum() + _RIDGE)
    return out


def _pair_tree(g, h):
    """Values per cell of a tree that cuts one axis and then each side on the other; also its gain."""
    best = (0.0, None)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        cuts = range(1, a.shape[0]) if a.shape[0] <= 9 else np.unique(np.linspace(1, a.shape[0] - 1, 8).astype(int))
        for at in cuts:
            values, total = np.zeros(a.shape), 0.0
            for part in (slice(0, at), slice(at, None)):
                row_g, row_h = a[part].sum(0), b[part].sum(0)
                gain, mid = _cut(row_g, row_h)
                total += gain
                for side in (slice(0, mid), slice(mid, None)):
                    values[part, side] = row_g[side].sum() / (row_h[side].sum() + _RIDGE)
            if total > best[0]:
                best = (total, values.T if turned else values)
    return best


def fit_arrays(x, y, bins=32, rounds=80, rate=0.15, pairs=6, pair_rounds=20):
    """Fit the model to features and 0/1 labels. Without rows of both labels the score is constant."""
    n = len(y)
    mean = (y.sum() + 1) / (n + 2)
    model = Additive(float(np.log(mean / (1 - mean))), [np.zeros(0)] * x.shape[1], [np.zeros(1)] * x.shape[1], [])
    if n == 0 or y.min() == y.max():
        return model
    cuts = np.linspace(0, 1, bins + 1)[1:-1]
    model.edges = [np.unique(np.quantile(x[:, i], cuts)) for i in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    at, margin = model.bins(x), np.full(n, model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for table, b in zip(model.tables, at):
            g, h = slopes()
            step = rate * _tree(np.bincount(b, g, len(table)), np.bincount(b, h, len(table)))
            table += step
            margin += step[b]

    def cells(i, j, g, h):
        shape = (len(model.tables[i]), len(model.tables[j]))
        flat = at[i] * shape[1] + at[j]
        size = shape[0] * shape[1]
        return flat, np.bincount(flat, g, size).reshape(shape), np.bincount(flat, h, size).reshape(shape)

    g, h = slopes()
    ranked = []
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            _, cell_g, cell_h = cells(i, j, g, h)
            ranked.append((_pair_tree(cell_g, cell_h)[0], i, j))
    for _, i, j in sorted(ranked, reverse=True)[:pairs]:
        model.pairs.append((i, j, np.zeros((len(model.tables[i]), len(model.tables[j])))))
    for _ in range(pair_rounds):
        for i, j, table in model.pairs:
            g, h = slopes()
            flat, cell_g, cell_h = cells(i, j, g, h)
            gain, step = _pair_tree(cell_g, cell_h)
            if gain > 1e-9:
                table += rate * step
                margin += rate * step.ravel()[flat]
    return model


def fit(docs, labels, label_col="quality", train_rows=20_000, id_col="doc_id", text_col="text"):
    """Fit to at most ``train_rows`` labelled rows, chosen by the hash of the id.

    Their features are worked out by Spark over the whole texts; the driver gets one row of numbers
    for each. Rows without id or label are not used, and labels count as 1 if they are not 0.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    known = known.select(F.col(id_col).alias("_id"), (F.col(label_col) != 0).cast("int").alias("_label"))
    chosen = blocks.first_by_hash(known, F.col("_id"), train_rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    texts = texts.join(F.broadcast(chosen), "_id").select("_label", "_text")
    field = [T.StructField("_features", T.BinaryType())]
    rows = blocks.append_columns(texts, "_text", field, lambda o, d: [[r.tobytes() for r in features(o, d)]])
    rows = rows.select("_label", "_features").collect()  # at most train_rows, if ids are unique
    x = np.array([np.frombuffer(r["_features"]) for r in rows]).reshape(len(rows), len(FEATURES))
    return fit_arrays(x, np.array([r["_label"] for r in rows], float))


def score(docs, model, text_col="text", score_col="score"):
    """The documents with the probability of label 1. Null texts count as empty and are scored too."""
    field = [T.StructField(score_col, T.DoubleType())]
    return blocks.append_columns(docs, text_col, field, lambda o, d: [model.scores(features(o, d))])
