"""Repeated strings, language-model scores, sharding and mixing against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mainstreet.llm import mixing, queries, repeats, scoring, sharding
from mainstreet.llm.suffixes import suffix_arrays


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=40), min_size=1, max_size=6))
def test_suffix_arrays(strings):
    expected, base = [], 0
    for s in strings:
        expected += [base + i for i in sorted(range(len(s)), key=lambda i: s[i:])]
        base += len(s)
    flat = np.array([x for s in strings for x in s], np.int64)
    assert list(suffix_arrays(flat, [len(s) for s in strings])) == expected


def _repeats(rows, n=50):
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for p in range(len(b) - n + 1):
            first.setdefault(b[p : p + n], i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b) + 1)
        for p in range(len(b) - n + 1):
            if i is not None and first[b[p : p + n]] < i:
                gone[p : p + n] = b"\1" * n
        spans = sum(gone[k] > gone[k - 1] if k else gone[0] for k in range(len(b)))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), int(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def _digests(frame):
    return sorted((tuple(r) for r in repeats.digests(frame).collect()), key=repr)


def test_repeats_small_table(spark, sf, texts):
    got = sorted((tuple(r) for r in queries.QUERIES["op8_suffix_array"](spark, sf).collect()), key=repr)
    assert got == _repeats(list(texts.items()))


@pytest.mark.parametrize("most, hot", [(2, repeats.HOT), (16, repeats.HOT), (16, 8), (2, 2)])
def test_repeats_many_contexts_of_one_passage(spark, monkeypatch, most, hot):
    """Whether anchors with many contexts are divided where they are sorted, or before they are sent."""
    rng = random.Random(most)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    core = word(30)
    lefts, rights = [word(30) for _ in range(6)], [word(30) for _ in range(6)]
    rows = []
    for i in rng.sample(range(1000), 150):
        left, right = rng.choice(lefts)[rng.randrange(30) :], rng.choice(rights)[: rng.randrange(30)]
        rows.append((i, word(rng.randrange(3)) + left + core + right + rng.choice(["", "é", "€", core, "a" * 60])))
    monkeypatch.setattr(repeats, "MOST_PIECES", most)
    monkeypatch.setattr(repeats, "HOT", hot)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert _digests(frame) == _repeats(rows)
    keys = np.full(2, 7, np.uint64)
    assert repeats.least_ids(keys, np.zeros((2, repeats._PIECE), np.uint8), np.array([5, 4])).shape == (2, repeats.SIDE + 1)


def test_repeats_rows_follow_the_text():
    """What is sent depends on the anchors of the texts, however many parts there are."""
    text = "".join(random.Random(2).choice("abcdefgh ") for _ in range(3000))
    batch = pa.RecordBatch.from_pydict({"t": [text, text, text[:1000]]})
    keys = set(repeats.anchors(np.array([0, 3000]), np.frombuffer(text.encode(), np.uint8))[1].tolist())
    for parts in (4, 1000, 10**9):
        rows = [r for out in repeats._anchor_rows(parts)([batch]) for r in out.to_pylist()]
        assert len(rows) <= min(parts, len(keys))
        assert {k for r in rows for k in repeats._unplanes(r["keys"]).tolist()} == keys
        assert sum(len(r["level"]) for r in rows) == len(keys)


def test_repeats_parts_are_alike():
    """Anchors are least hashes, yet no part of the hash space gets more of them than others."""
    data = np.random.default_rng(5).integers(97, 123, 200_000).astype(np.uint8)
    keys = np.unique(repeats.anchors(np.array([0, len(data)]), data)[1])
    sizes = np.bincount(repeats._part(keys, 16).astype(int), minlength=16)
    assert sizes.max() < 1.3 * sizes.mean() and sizes.min() > 0.7 * sizes.mean()


def test_repeats_hot_anchor_is_spread():
    """Pieces of one anchor whose contexts differ fall into many groups; those that share a string share one."""
    rng = np.random.default_rng(6)
    pieces = rng.integers(97, 100, (4000, repeats._PIECE)).astype(np.uint8)
    pieces[:, :2] = repeats.SIDE
    number, keys, cut = repeats._divided(np.full(4000, 9, np.uint64), pieces)
    assert len(number) == 4000 * repeats.SIDE // repeats.STEP
    assert np.bincount(np.unique(keys, return_inverse=True)[1]).max() < 10
    string = np.arange(repeats.SIDE + 1)
    has = (string >= repeats.SIDE - cut[:, :1].astype(int)) & (string <= cut[:, 1:2])
    covered = np.zeros((4000, repeats.SIDE + 1), bool)
    np.logical_or.at(covered, number, has)
    assert covered.all()


def test_repeats_odd_rows(odd, nothing):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    short = [(i, t[:3000] if t else t) for i, t in rows]
    frame = odd.withColumn("text", F.substring("text", 1, 3000))
    assert _digests(frame) == _repeats(short)
    whole = {r["doc_id"]: r for r in repeats.digests(odd).collect()}
    assert whole[8]["n_removed"] == len("lorem ipsum dolor " * 12_000) and whole[8]["n_spans"] == 1
    assert repeats.digests(nothing).count() == 0
    left = {r["doc_id"]: r["text"] for r in repeats.without_repeats(odd).collect()}
    assert left[8] == "end" and left[3] is None and left[4] == "" and left[9] == "Größe ÉTÉ ñandú naïve"


def _tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), "\0"]


def _base(rows, train):
    count = Counter(t for _, text in train for t in _tokens(text))
    total, types = sum(count.values()), len(count)
    out = []
    for i, text in rows:
        ts = _tokens(text)
        out.append((i, len(ts), sum(count[t] > 0 for t in ts), total, sum(math.log10((count[t] + 1) / (total + types + 1)) for t in ts)))
    return out


def _same_scores(got, expected):
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=repr)
    for a, b in zip(got, sorted(expected, key=repr), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9)


@pytest.mark.parametrize("words", [2_000_000, 50])
def test_lm_base_scores(spark, sf, texts, monkeypatch, words):
    monkeypatch.setattr(scoring, "DICTIONARY_WORDS", words)
    got = queries.QUERIES["op9_lm_scoring"](spark, sf).collect()
    train = [(i, t) for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    _same_scores(got, _base(list(texts.items()), train))
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == set(texts) - {i for i, _ in train}
    assert all(r["score"] < 0 for r in got)
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # nearer to new texts


def test_lm_filter_counts():
    """Levels read back from the filter: never too low, and seldom too high."""
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    counts = rng.integers(2, 5000, 20_000)
    bits = np.zeros(int(scoring._levels(counts).sum()) * scoring.BITS // 8 * 8, bool)
    for level in range(1, int(scoring._levels(counts).max()) + 1):
        for at in scoring._positions(keys[scoring._levels(counts) >= level], np.full(1, level), np.uint64(len(bits))):
            bits[at.astype(np.int64)] = True
    table = scoring.Filter(np.packbits(bits, bitorder="little"), np.zeros(1, np.int64), np.array([len(bits)], np.uint64))
    read = table.counts(keys)
    assert (read >= counts / scoring.BASE).all() and (read <= counts * scoring.BASE).mean() > 0.97
    assert (table.counts(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)) > 0).mean() < 0.03


def test_lm_odd_rows(odd, nothing):
    model, counted = scoring.fit(odd)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    _same_scores(scoring.score(odd, model, counted).collect(), _base(rows, rows))
    model, counted = scoring.fit(nothing)
    got = scoring.score(odd, model, counted).collect()
    assert all(r["base_score"] == 0 and r["n_known"] == 0 for r in got) and len(got) == 13
    assert scoring.score(nothing, model, counted).count() == 0


def test_sharding_query(spark, sf, texts):
    got = queries.QUERIES["op10_sharding"](spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    size = Counter()
    for r in got:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        size[r["shard"]] += r["size"]
    assert set(size) == set(range(8))
    largest = max(r["size"] for r in got)
    assert max(size.values()) - min(size.values()) <= 2 * largest
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    where = {}
    for r in got:
        where.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert all(len(v) == 1 for v in where.values())  # equal texts lie together
    assert [tuple(r) for r in sorted(got)] == [tuple(r) for r in sorted(queries.QUERIES["op10_sharding"](spark, sf).collect())]


def test_sharding_divides_a_hot_text(spark, tmp_path):
    rows = [(i, "the same text" if i % 2 else f"text number {i} {'x' * (i % 50)}") for i in range(4000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    size = Counter()
    for r in sharding.place(frame).collect():
        size[r["shard"]] += r["size"]
    assert max(size.values()) < 1.05 * min(size.values())
    sharding.write_shards(frame, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == 4000 and back.select("shard").distinct().count() == 8


def test_sharding_odd_rows(odd, nothing):
    got = sharding.place(odd).collect()
    assert len(got) == 13
    assert sorted(r["size"] for r in got)[:4] == [1, 1, 1, 5]
    assert sharding.place(nothing).count() == 0


def _targets(size):
    """The reshares as they are stated, one after the other."""
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, full, rest = {}, set(), float(sum(size.values()))
    while True:
        free = [s for s in names if s not in full]
        for s in free:
            target[s] = rest * weight[s] / sum(weight[x] for x in free)
        over = [s for s in free if target[s] > 3 * size[s] + 1e-9]
        if not over:
            return target
        for s in over:
            target[s] = 3.0 * size[s]
            full.add(s)
            rest -= target[s]


def test_mixing_query(spark, sf, texts):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.QUERIES["op3_mixing"](spark, sf).collect()
    size = Counter()
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r["doc_id"]]["text"]))
        size[docs[r["doc_id"]]["source"]] += r["size"]
    target, taken = _targets(size), Counter()
    for r in got:
        source = docs[r["doc_id"]]["source"]
        assert r["source_size"] == size[source] and r["target"] == pytest.approx(target[source])
        assert r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"]) and len(r["shards"]) * r["size"] == r["taken"]
        taken[source] += r["taken"]
    for s in size:
        assert taken[s] == pytest.approx(target[s], rel=0.05)
    again = queries.QUERIES["op3_mixing"](spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_mixing_tree_quotas(spark):
    """Every block goes to one shard, and shards have equal numbers of blocks."""
    blocks = spark.createDataFrame([(0, 700), (1, 300), (2, 20), (3, 1), (4, 0)], "_ix int, _blocks long")
    for shards in (1, 3, 8):
        ends = {r["_ix"]: r["_ends"] for r in mixing.split_tree(blocks, shards).collect()}
        assert {i: e[-1] for i, e in ends.items()} == {0: 700, 1: 300, 2: 20, 3: 1, 4: 0}
        each = [sum(e[s] - (e[s - 1] if s else 0) for e in ends.values()) for s in range(shards)]
        assert max(each) - min(each) <= 1 and sum(each) == 1021


def test_hypergeometric_draws(spark):
    """Counts over many draws follow the hypergeometric law."""
    frame = spark.range(4000).select(
        mixing._hypergeometric(F.lit(50), F.lit(20).cast("long"), F.lit(10).cast("long"), (F.col("id") + 0.5) / 4000).alias("x")
    )
    got = {r["x"]: r["count"] / 4000 for r in frame.groupBy("x").count().collect()}
    for x in range(11):
        assert got.get(x, 0) == pytest.approx(math.comb(20, x) * math.comb(30, 10 - x) / math.comb(50, 10), abs=5e-4)


def test_mixing_odd_rows(odd, nothing):
    got = mixing.mix(odd).collect()
    assert len(got) == 13
    total = sum(r["size"] for r in got)
    assert sum(r["taken"] for r in got) <= 3 * total
    assert all(r["taken"] == 0 for r in got if not r["size"])
    rows = mixing.mixed_rows(odd.where("doc_id > 2"), 4)
    assert {"shard", "order"} <= set(rows.columns) and rows.count() > 0
    assert mixing.mix(nothing).count() == 0


def _read_line(sizes, target, most=3):
    """Uses of each document of a line, read use by use; then the use that comes nearest to the target."""
    used, gap = [0] * len(sizes), target
    for _ in range(most):
        for i, n in enumerate(sizes):
            if 0 < n <= gap:
                used[i] += 1
                gap -= n
    near = [(abs(n - gap), i) for i, n in enumerate(sizes) if n and used[i] < most and abs(n - gap) < gap]
    return sum(u * n for u, n in zip(used, sizes)) + (sizes[min(near)[1]] if near else 0)


@pytest.mark.parametrize("seed", range(2))
def test_mixing_reads_on_past_long_documents(spark, seed):
    rng = random.Random(seed)
    rows = [("a", rng.choice([3, 30, 31])) for _ in range(300)] + [("a", 20_000)] * 3 + [("a", 2_000)] * 4
    rows += [("b", rng.randrange(1, 600)) for _ in range(400)] + [("c", 9)]
    frame = spark.createDataFrame([(i + 10_000 * seed, s, "w " * n) for i, (s, n) in enumerate(rows)], "doc_id long, source string, text string")
    got = mixing.mix(frame, rows_per_part=50, weights=(1, 9, 1)).join(
        frame.select("doc_id", "source", F.xxhash64(F.lit(3), "doc_id").alias("o")), "doc_id"
    )
    got = got.withColumn("part", F.pmod(F.xxhash64("o"), F.lit(-(-len(rows) // 50)))).orderBy("part", "o").collect()
    for s in "abc":
        docs = [r for r in got if r["source"] == s]
        target, taken = docs[0]["target"], sum(r["taken"] for r in docs)
        assert taken == _read_line([r["size"] for r in docs], target) and taken >= 0.99 * target
        assert not [r for r in docs if len(r["draws"]) < 3 and r["size"] <= target - taken]
        assert all(sorted(d["pass"] for d in r["draws"]) == list(range(len(r["draws"]))) for r in docs)


def test_mixing_spreads_what_is_read_past_a_long_document(spark):
    rows = [("a", 20)] * 1500 + [("a", 200_000)] * 3 + [("b", 10_000)] * 40
    frame = spark.createDataFrame([(i, s, "w " * n) for i, (s, n) in enumerate(rows)], "doc_id long, source string, text string")
    got = mixing.mix(frame, shards=4, blocks_per_shard=4096, weights=(1, 30), rows_per_part=100).where("size = 20").collect()
    shard = Counter(d["shard"] for r in got for d in r["draws"])
    assert len(shard) == 4 and min(shard.values()) > 0.5 * max(shard.values())
