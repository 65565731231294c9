"""Near-duplicate operators and decontamination against brute force."""

import random
import re

import numpy as np
import pytest

from mainstreet.llm import components, decontamination, embeddings, minhash, queries


def _sets(texts, width):
    out = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    return out


def _groups(ids, linked):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def _similar(sets, percent):
    def linked(a, b):
        both = len(sets[a] & sets[b])
        return bool(sets[a]) and bool(sets[b]) and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both)

    return linked


def test_minhash_small_table(spark, sf, texts):
    sets = _sets(texts, 3)
    expected = _groups(list(sets), _similar(sets, 85))
    got = {r["doc_id"]: r for r in queries.QUERIES["op7_minhash"](spark, sf).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == expected
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_minhash_chains_and_dissimilar_groups(spark, monkeypatch):
    """Copies of copies, and many texts of one bucket that are not linked with its leaders."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = {}
    for i in range(40):  # each a little farther from the first
        texts[i] = " ".join(base)
        base[rng.randrange(200)] = f"x{i}"
    for i in range(100, 140):  # each with its own third replaced
        other = [f"w{k}" if k % 3 or rng.random() < 0.4 else f"y{i}{k}" for k in range(200)]
        texts[i] = " ".join(other)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sets = _sets(texts, 3)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame).collect()}
    assert got == _groups(list(sets), _similar(sets, 85))


def test_minhash_odd_rows(odd, nothing):
    got = minhash.near_duplicates(odd).orderBy("doc_id").collect()
    assert len(got) == 13
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["component_id"] for i in (1, 2, 3, 4, 5, 6, 7, 10)] == [1, 1, 3, 4, 5, 6, 7, 10]
    assert [by[i]["n_shingles"] for i in (1, 3, 4, 5, 10)] == [5, 0, 0, 0, 1]
    assert all(r["kept"] and r["component_id"] is None for r in got if r["doc_id"] is None)
    assert minhash.near_duplicates(nothing).count() == 0


def test_deduplicated(odd, nothing):
    left = minhash.deduplicated(odd)
    assert left.columns == odd.columns
    ids = sorted(r["doc_id"] for r in left.where("doc_id IS NOT NULL").collect())
    assert ids == [1, 3, 4, 5, 6, 7, 8, 9, 10]
    assert left.where("doc_id IS NULL").count() == 2
    assert minhash.deduplicated(nothing).count() == 0


def test_band_width_keeps_recall():
    for percent in (80, 85, 95):
        r = minhash.band_width(percent)
        assert 1 - (1 - (percent / 100) ** r) ** (2 * minhash.PERMUTATIONS // r) >= minhash.RECALL


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)]
    links += [(1000, i) for i in range(1001, 1100)] + [(5, 5)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {frozenset(p) for p in links}
    ids = sorted({i for p in links for i in p if p[0] != p[1]})
    assert got == _groups(ids, lambda a, b: frozenset((a, b)) in linked)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((15, 64))
    noisy = [c + rng.standard_normal(64) * s for c in centres for s in np.linspace(0.05, 0.6, 12)]
    alone = list(rng.standard_normal((400, 64)))
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate([*noisy, *alone, noisy[0], noisy[0], 2 * noisy[13]])]
    x = np.array([np.array(r[1], np.float32) for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    expected = _groups(range(len(rows)), lambda a, b: near[a, b])
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(_vectors(spark, rows)).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == expected
    assert {i: r["n_links"] for i, r in got.items()} == {i: int(near[i].sum()) - 1 for i in range(len(rows))}


def test_embeddings_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [0.0, 0.0], 0), (4, None, 0), (5, [nan, 1.0], 0),
        (6, [inf, 1.0], 0), (7, [None, 1.0], 0), (8, [], 0), (9, [1.0, 0.0, 0.0], 0), (10, [-0.0, 1.0], 0), (11, [0.0, 1.0], 0),
        (None, [1.0, 0.0], 0), (12, [1e30, 1e30], 0), (13, [1e-30, 1e-30], None),
    ]
    got = embeddings.near_duplicates(_vectors(spark, rows)).collect()
    by = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got}
    assert len(got) == len(rows)
    assert by[1] == (2, 1) and by[2] == (2, 1) and by[10] == (1, 10) and by[11] == (1, 10)
    assert by[12] == (1, 12) and by[13] == (1, 12)
    assert all(by[i] == (0, i) for i in (3, 4, 5, 6, 7, 8, 9))
    assert by[None] == (0, None)
    assert embeddings.near_duplicates(_vectors(spark, [])).count() == 0


def test_embeddings_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    expected = (x @ x.T >= 0.9).sum(1) - 1
    got = queries.QUERIES["op6_embeddings"](spark, sf).orderBy("vec_id").collect()
    assert [r["n_links"] for r in got] == list(expected)


def test_embeddings_with_sets_of_directions(spark):
    """With few directions to be had, sets of three of them make the cells."""
    rng = np.random.default_rng(12)
    noisy = [c + rng.standard_normal(64) * s for c in rng.standard_normal((30, 64)) for s in np.linspace(0.05, 0.6, 12)]
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate([*noisy, *rng.standard_normal((700, 64))])]
    assert embeddings.scheme(len(rows), most=256) == (256, 3)
    assert embeddings.scheme(20_000, most=4096) == (4096, 2)
    x = np.array([np.array(r[1], np.float32) for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = embeddings.near_duplicates(_vectors(spark, rows), most=256).orderBy("vec_id").collect()
    assert [r["n_links"] for r in got] == list((x @ x.T >= 0.9).sum(1) - 1)


@pytest.mark.parametrize("n_directions, together", [(2048, 1), (1024, 2)])
def test_embeddings_recall_and_windows(spark, n_directions, together):
    """Pairs at exactly the threshold are found, and windows keep few of the pairs that share a cell by chance."""
    half, least = embeddings.calibrated(0.9, 64, n_directions, together)
    fresh = embeddings.simulated(0.9, 64, n_directions, together, 4000, 99)
    assert np.mean([(d <= half).sum() >= least for d in fresh]) >= 0.997
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.standard_normal((1500, 64)))]
    number, x, y = embeddings._cells(embeddings._unit(np.array([r[1] for r in rows])), n_directions, together)
    flat = [(i, 64, int(c), float(p), float(q)) for i in range(1500) for c, p, q in zip(number[i], x[i], y[i])]
    cells = spark.createDataFrame(flat, "c long, dims int, cell long, x double, y double")
    got = sorted(map(tuple, embeddings.collisions(cells, half).collect()))
    by = {}
    for i, _, c, p, q in flat:
        by.setdefault(c, []).append((i, p, q))
    shared = [(a, b) for rows in by.values() for k, a in enumerate(rows) for b in rows[k + 1 :]]
    expected = sorted((a[0], b[0]) for a, b in shared if abs(a[1] - b[1]) <= half and abs(a[2] - b[2]) <= half)
    assert got == expected
    assert 0 < len(got) < 0.25 * len(shared)


def test_embeddings_scheme_keeps_work_per_vector():
    """Pairs that share a cell by chance, for each vector, do not grow with the number of vectors once sets are used."""
    for n in (10**6, 10**7, 10**8, 10**9):
        n_directions, together = embeddings.scheme(n)
        cells = embeddings.comb(embeddings.TOP, together)
        met = n * cells**2 * embeddings.factorial(together) / n_directions**together
        assert n_directions <= embeddings.MOST_DIRECTIONS and met <= cells


def _distance(a, b):
    """Edits from ``a`` to the nearest part of ``b``."""
    row = [0] * (len(b) + 1)
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def _windows(item, text):
    """Distance of each window of the item to the text, and the edits that it may have."""
    index = decontamination.Index([(0, item)])
    return [(_distance(item.encode()[a:b], text.encode()), k) for a, b, k in zip(index.first, index.last, index.edits)]


@pytest.mark.parametrize("edits", [0, 4, 8, 20])
def test_decontamination_edits(spark, edits):
    rng = random.Random(edits)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    item = " ".join(word() for _ in range(60))[:100]
    changed = list(item)
    for at in rng.sample(range(100), edits):
        changed[at] = rng.choice([changed[at] + "z", "", "z"])
    docs = [(1, " ".join(word() for _ in range(80)) + " " + "".join(changed) + " " + word()), (2, " ".join(word() for _ in range(200)))]
    found = decontamination.matches(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")
    ).collect()
    near = [d for d, most in _windows(item, docs[0][1]) if d <= most]
    expected = [(1, 7, len(near), min(near))] if near else []
    assert [(r["doc_id"], r["item_id"], r["windows"], r["distance"]) for r in found] == expected
    assert bool(near) == (edits < 20)


def test_decontamination_table(spark, sf, texts):
    found = queries.QUERIES["op2_decontamination"](spark, sf).collect()
    plain = lambda t: re.sub(r"\s", " ", t.lower())
    items = {r["item_id"]: plain(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    whole = {(d, i) for d, t in texts.items() for i, item in items.items() if item in plain(t or "")}
    pairs = {(r["doc_id"], r["item_id"]) for r in found}
    assert whole and whole <= pairs
    for d, i in pairs - whole:  # some window of the item must be near
        assert any(d <= most for d, most in _windows(items[i], plain(texts[d])))


def test_decontamination_windows_cover_passages():
    """Every passage of a window and a stride holds a window, and windows reach both ends of an item."""
    for n in (10, 79, 80, 81, 100, 333):
        index = decontamination.Index([(0, "x" * n)])
        assert index.first.min() == 0 and index.last.max() == n
        assert (np.diff(np.sort(index.first)) <= decontamination.STRIDE).all()


@pytest.mark.parametrize("length", [55, 60, 73, 80])
def test_decontamination_finds_short_passages_wherever_they_start(length):
    rng = random.Random(length)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    item = word(400)
    index = decontamination.Index([(0, item)])
    docs = [(word(90) + item[at : at + length] + word(90)).encode() for at in range(400 - length + 1)] + [word(300).encode()]
    found = index.find(np.cumsum([0] + [len(d) for d in docs]), np.frombuffer(b"".join(docs), np.uint8))
    assert list(found[0]) == list(range(len(docs) - 1))


def test_decontamination_odd_rows(spark, odd, nothing, monkeypatch):
    items = [(1, "one two three four five six seven"), (2, None), (3, ""), (4, "short"), (None, "two words and then some more of it"), (5, "ipsum dolor " * 20)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.matches(odd, benchmark).collect()}
    assert found == {(1, 1), (2, 1), (None, 1)}
    left = decontamination.clean(odd, benchmark)
    assert left.columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 3, 4, 5, 6, 7, 8, 9, 10]
    assert decontamination.matches(nothing, benchmark).count() == 0
    assert decontamination.clean(odd, benchmark.limit(0)).count() == 13
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 40)  # several blocks of items
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.matches(odd, benchmark).collect()} == found
