"""The language model's probabilities against exact counts."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from mainstreet.llm import queries, scoring


def words(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), "\0end"]


def least(count):
    """The least count of the level of a count on the scale of 1.5."""
    level = 1 + math.floor(math.log(count) / math.log(1.5) + 1e-9)
    return math.ceil(1.5 ** (level - 1) - 1e-9)


class Exact:
    """The same model from exact counts."""

    def __init__(self, texts):
        self.count, self.pairs, self.follow = Counter(), Counter(), defaultdict(Counter)
        for text in texts:
            ws = words(text)
            self.count.update(ws)
            for h, w in zip(["\0start", *ws], ws):
                self.follow[h][w] += 1
        self.size = sum(self.count.values()) + len(self.count) + 1

    def probability(self, h, w):
        base = (self.count[w] + 1) / self.size
        after = self.follow.get(h)
        if not after:
            return base
        total = sum(after.values())
        given = {x: least(n) - 1 for x, n in after.items()}
        return given.get(w, 0) / total + (1 - sum(given.values()) / total) * base

    def score(self, text):
        ws = words(text)
        return sum(math.log10(self.probability(h, w)) for h, w in zip(["\0start", *ws], ws))


def training(texts):
    return [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2]


@pytest.mark.parametrize("dictionary, group", [(2_000_000, 64 << 20), (2_000_000, 3000), (400, 64 << 20), (50, 3000), (0, 1000)])
def test_scores_equal_exact_ones(spark, sf, texts, monkeypatch, dictionary, group):
    """Also with several groups of slices, and with words outside the dictionary of every count."""
    monkeypatch.setattr(scoring, "DICTIONARY_WORDS", dictionary)
    monkeypatch.setattr(scoring, "FILTER_BYTES", group)
    monkeypatch.setattr(scoring, "LOT", 100_000)
    exact = Exact(training(texts))
    for _ in range(2 if dictionary > 400 else 1):  # twice in one session
        rows = queries.QUERIES["op9_lm_scoring"](spark, sf).collect()
        assert len(rows) == len(texts)
        # one level in about a thousand is read too high, which changes one token of a text
        ratios = np.array([r["score"] / exact.score(texts[r["doc_id"]]) for r in rows])
        assert np.abs(ratios - 1).max() < 0.02 and np.median(np.abs(ratios - 1)) < 1e-3


def test_probabilities_come_to_one(spark, texts):
    """After common, less common and rare histories, over all words and an unknown one; every text holds one pair of it."""
    train = training(texts)
    exact = Exact(train)
    model, counted = scoring.fit(spark.createDataFrame([(t,) for t in train], "text string"))
    assert (model.tokens, model.types) == (sum(exact.count.values()), len(exact.count))
    ordered = [w for w, _ in exact.count.most_common() if w != "\0end"]
    seen_twice = [w for w in ordered if max(exact.follow[w].values()) > 1]
    histories = [ordered[0], ordered[20], ordered[100], *seen_twice[-3:], ordered[-1], "never-seen-before"]
    vocabulary = [w for w in exact.count if w != "\0end"]
    for h in histories:
        # the log of the text "h w" less that of "h" leaves P(w | h) P(end | w) / P(end | h)
        asked = spark.createDataFrame([(i, f"{h} {w}") for i, w in enumerate([*vocabulary, "unknown-word"])], "i long, text string")
        got = {r["i"]: 10 ** r["score"] for r in scoring.score(asked, model, counted).collect()}
        first = exact.probability("\0start", h)
        total = exact.probability(h, "\0end")
        for i, w in enumerate([*vocabulary, "unknown-word"]):
            total += got[i] / first / exact.probability(w, "\0end")
        assert total == pytest.approx(1, abs=0.02), h


def test_counts_of_all_pairs_are_read(spark):
    """Pairs seen once change what a history leaves, at every size of the table."""
    few = ["a b", "a c", "a b", "a d"]
    for rows in (few, few + [f"x{i} y{i}" for i in range(3000)]):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
        model, counted = scoring.fit(df)
        exact = Exact(rows)
        got = {r["doc_id"]: r["score"] for r in scoring.score(df, model, counted).collect()}
        assert all(got[i] == pytest.approx(exact.score(t)) for i, t in enumerate(rows))


def test_rows_grow_with_the_text(spark, texts, monkeypatch):
    """Twice the text sends at most twice the rows, and holds as much in a group of slices."""
    monkeypatch.setattr(scoring, "FLUSH_BYTES", 20_000)
    monkeypatch.setattr(scoring, "BLOCK", 20_000)
    monkeypatch.setattr(scoring, "MOST_PARTS", 16)
    monkeypatch.setattr(scoring, "PART_BYTES", 10_000)
    sent = []
    for times in (1, 2, 4):
        rows = [(f"{t or ''} {k}",) for t in texts.values() for k in range(times)]
        df = spark.createDataFrame(rows, "t string").coalesce(1)
        lots = df.mapInArrow(scoring._count_rows(16), ", ".join(f"{c} {'int' if c == 'part' else 'binary'}" for c in scoring._LOT_COLUMNS))
        sent.append(lots.count())
    assert sent[1] <= 2.1 * sent[0] and sent[2] <= 2.1 * sent[1]


def test_filter_slices(spark):
    """No stored pair is lost, and few others are found."""
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 63, 30_000, dtype=np.uint64)
    counts = rng.zipf(1.8, 30_000).clip(2, 10**6)
    levels = scoring._levels(counts)
    bits = scoring._filled(keys, levels)
    table = scoring.Filter(bits, np.zeros(1, np.int64), np.array([len(bits) * 8], np.uint64))
    part = np.zeros(30_000, np.int64)
    read = table.levels(keys, part, scoring.LEAST)
    assert (read >= levels).all() and (read == levels).mean() > 0.98
    assert (table.levels(rng.integers(0, 1 << 63, 30_000, dtype=np.uint64), part, scoring.LEAST) > 0).sum() <= 3
