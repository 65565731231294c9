"""The pipeline, stage by stage, against plain Python over the same rows."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mainstreet.llm import blocks, decontamination, mixing, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def left(spark, tmp_path_factory):
    """What each stage returns, by name; ``documents`` is what the first one reads."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def _rows(df):
    return Counter(tuple(r) for r in df.collect())


def _texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns_and_last_result(spark, left):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert left[name].dtypes == left["documents"].dtypes
    assert _rows(corpus_pipeline.run(spark, SF)) == _rows(left["sharding"])


def test_quality_stage(spark, left):
    """Texts scored one by one are kept from 0.7 on; nothing else is lost or changed."""
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(blocks.remainder(F.col("doc_id"), 4) != 2)
    model = quality.fit(left["documents"], labels)
    expected = Counter()
    for row in left["documents"].collect():
        data = np.frombuffer((row["text"] or "").encode(), np.uint8)
        if model.scores(quality.features(np.array([0, len(data)]), data))[0] >= 0.7:
            expected[tuple(row)] += 1
    assert _rows(left["quality"]) == expected and 0 < sum(expected.values()) < left["documents"].count()


def test_dedup_stage(left):
    """All pairs are compared: five words to a shingle, similarity 0.8; the smallest id of a group stays."""
    sets = {}
    for i, t in _texts(left["quality"]).items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    expected = Counter({tuple(r): 1 for r in left["quality"].collect() if find(r["doc_id"]) == r["doc_id"]})
    assert _rows(left["minhash"]) == expected and sum(expected.values()) < len(sets)


def _plain(text):
    return re.sub(rb"[\t-\r]", b" ", (text or "").encode().lower())


def _within(window, text, most):
    """Whether some part of the text is at most ``most`` edits from the window."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(window, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row) <= most


def test_decontamination_stage(spark, left):
    """A window with k edits holds one of its k + 1 parts unchanged: these are looked for, then edits are counted."""
    items = spark.read.parquet(f"{SF}/benchmark.parquet").where("text IS NOT NULL").collect()
    index = decontamination.Index([(r["item_id"], r["text"]) for r in items])
    flat = index.bytes.tobytes()
    windows = {(flat[a:b], int(k)) for a, b, k in zip(index.first, index.last, index.edits)}
    parts = defaultdict(set)
    for w, k in windows:
        for p in range(k + 1):
            at = p * len(w) // (k + 1)
            parts[w[at : (p + 1) * len(w) // (k + 1)]].add((w, k, at))

    def leaks(text):
        for part, found in parts.items():
            at = text.find(part)
            while at >= 0:
                for w, k, before in found:
                    if _within(w, text[max(0, at - before - k) : at - before + len(w) + k], k):
                        return True
                at = text.find(part, at + 1)
        return False

    expected = Counter({tuple(r): 1 for r in left["minhash"].collect() if not leaks(_plain(r["text"]))})
    assert _rows(left["decontamination"]) == expected and sum(expected.values()) < left["minhash"].count()


def test_mixing_stage(left):
    """Every source is read in the order of its hashes; uses that fit are taken, then the one that fits best."""
    docs = left["decontamination"]
    order = F.xxhash64(F.lit(mixing._SEED), "doc_id")
    rows = docs.select("doc_id", "source", "text", order.alias("order")).collect()
    sources = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["order"], r["doc_id"])):
        sources[r["source"]].append((r["doc_id"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))))
    names = sorted(sources, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, n in sources[s]) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), float(sum(size.values()))
    while True:
        share = {s: rest * weight[s] / sum(weight[t] for t in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 3 * size[s]}
        if not full:
            target.update(share)
            break
        for s in full:
            target[s] = 3.0 * size[s]
            rest -= target[s]
        open_ -= full
        if not open_:
            break
    expected = Counter()
    for s in names:
        uses, gap = Counter(), target[s]
        for _ in range(3):
            for i, n in sources[s]:
                if 0 < n <= gap + 1e-9:
                    uses[i] += 1
                    gap -= n
        more = [(abs(n - gap), k, i) for k, (i, n) in enumerate(sources[s]) if n and uses[i] < 3 and abs(n - gap) < gap]
        if more:
            uses[min(more)[2]] += 1
        expected += uses
        taken = sum(uses[i] * n for i, n in sources[s])
        # what is missing is less than any document that may still be used
        assert abs(taken - target[s]) <= min([n for i, n in sources[s] if n and uses[i] < 3], default=0.001), s
    told = {r["doc_id"]: tuple(r) for r in docs.collect()}
    got = _rows(left["mixing"])
    assert set(got) <= set(told.values())
    empty = {r["doc_id"] for r in docs.collect() if not (r["text"] or "").split()}
    assert {i: got[told[i]] for i in told if got[told[i]] and i not in empty} == dict(expected)


def test_sharding_stage(left):
    """Every row once, slots without gaps, near-equal bytes, equal texts side by side."""
    sizes = lambda t: len((t or "").encode()) + 1
    rows = left["sharding"].collect()
    before = Counter((r["doc_id"], sizes(r["text"])) for r in left["mixing"].collect())
    assert Counter((r["doc_id"], r["size"]) for r in rows) == before
    total = Counter()
    for shard in range(8):
        own = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert own == list(range(len(own)))
        total[shard] = sum(r["size"] for r in rows if r["shard"] == shard)
    mean = sum(total.values()) / 8
    assert all(abs(n - mean) <= max(r["size"] for r in rows) + 0.02 * mean for n in total.values())


# names that stages and operators use themselves
CLASHING = ("_leak", "_best", "_quality", "_mix_id", "_mix_uses", "_mix_use", "_rows", "component_id", "count", "doc", "hash")


@pytest.fixture
def clashing(odd):
    return odd.withColumns({n: F.lit(f"own {n}") for n in CLASHING})


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_odd_rows(spark, clashing, name, stage):
    """Awkward rows and columns of any name go through every stage; an empty table stays one."""
    got = stage(spark, clashing, SF)
    if name == "sharding":
        assert got.count() == clashing.count() and stage(spark, clashing.limit(0), SF).count() == 0
        return
    assert got.columns == clashing.columns
    told, kept = _rows(clashing), _rows(got)
    assert set(kept) <= set(told) and stage(spark, clashing.limit(0), SF).count() == 0
    ids = sorted((r["doc_id"] for r in got.where("doc_id IS NOT NULL").collect()))
    if name == "minhash":  # one of the equal texts 1, 1 and 2; all rows without id
        assert ids == [1, 3, 4, 5, 6, 7, 8, 9, 10] and sum(kept.values()) == 11
    if name == "decontamination":  # nothing in them is from the benchmark
        assert kept == told
    if name == "mixing":  # rows that share an id are used alike; rows without id once
        assert kept[next(r for r in kept if r[0] is None and r[1])] == 1


def test_odd_rows_without_labels_or_benchmark(spark, odd, tmp_path):
    """Without labels nothing says that a document is bad or good; without items nothing is dropped."""
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    scores = {r["_s"] for r in quality.score(odd, quality.fit(odd, spark.read.parquet(f"{tmp_path}/labels.parquet")), score_col="_s").collect()}
    assert len(scores) == 1
    kept = corpus_pipeline.quality_stage(spark, odd, str(tmp_path)).count()
    assert kept == (odd.count() if scores.pop() >= 0.7 else 0)
    assert corpus_pipeline.decontamination_stage(spark, odd, str(tmp_path)).count() == odd.count()
