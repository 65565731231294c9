"""Classifiers: accuracy on rows that were not learned from, and awkward rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mainstreet.llm import language, quality, queries, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_held_out(spark, labels):
    got = queries.QUERIES["op5_quality"](spark, SF)
    assert got.count() == 1000 and got.where("score BETWEEN 0 AND 1").count() == 1000
    held = got.where("held_out").join(labels, "doc_id")
    right = held.where("predicted = quality").count()
    assert right >= 0.95 * held.count()


def test_language_held_out(spark, docs):
    got = queries.QUERIES["op4_language_id"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count()
    assert got.where("score BETWEEN 0 AND 1").count() == got.count()


def test_toxicity_held_out(spark, docs, labels):
    english = docs.where("lang = 'en'").select("doc_id")
    got = queries.QUERIES["op1_toxicity"](spark, SF).join(labels, "doc_id").join(english, "doc_id").where("held_out")
    assert got.where("predicted = toxic").count() >= 0.97 * got.count()


def test_quality_odd_rows(spark, odd, nothing, docs, labels):
    model = quality.fit(docs, labels)
    got = quality.score(odd, model)
    assert got.where("score BETWEEN 0 AND 1").count() == 13
    assert quality.score(nothing, model).count() == 0
    untrained = quality.fit(nothing, labels.limit(0))
    assert {r["score"] for r in quality.score(odd, untrained).collect()} == {0.5}
    some = spark.createDataFrame([(1, 1), (2, None), (None, 0), (1, 1)], "doc_id long, quality int")
    assert 0.5 < quality.score(odd, quality.fit(odd, some)).first()["score"] <= 1


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit_arrays(x, y, pairs=1)
    assert ((model.scores(x) > 0.5) == y).mean() > 0.95


def test_language_odd_rows(odd, nothing, docs):
    model = language.fit(docs)
    got = {r["doc_id"]: r for r in language.predict(odd, model).where("doc_id IS NOT NULL").collect()}
    assert [got[i]["lang_pred"] for i in (3, 4, 5, 6)] == ["und"] * 4
    assert all(got[i]["score"] == 0 and not got[i]["accepted"] for i in (3, 4, 5, 6))
    assert all(got[i]["lang_pred"] in {"en", "fr", "de", "es"} for i in (1, 7, 9, 10))
    assert language.predict(nothing, model).count() == 0
    empty = language.fit(nothing)
    assert {r["lang_pred"] for r in language.predict(odd, empty).collect()} == {"und"}


def test_gram_counts_stay_within_texts():
    data = np.frombuffer(b"abcdexyzzy", np.uint8)
    both = language.gram_counts(np.array([0, 5, 10]), data)
    one = language.gram_counts(np.array([0, 5]), data[:5])
    other = language.gram_counts(np.array([0, 5]), data[5:])
    assert (both == np.vstack([one, other])).all()
    assert one.sum() == 4 + 3 + 2


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def test_automaton_against_distances():
    rng = np.random.default_rng(6)
    terms = [toxicity.Term(t, False, e, 1.0) for t, e in (("idiot", 1), ("abcde", 0), ("disgusting", 2), ("ido", 1))]
    terms.append(toxicity.Term("stem", True, 0, 1.0))
    machine = toxicity.Automaton(terms)
    words = [t.text for t in terms] + ["stemming", "ste"]
    for t in list(words) * 60:
        letters = list(t)
        for _ in range(rng.integers(0, 4)):
            at = rng.integers(0, len(letters) + 1)
            letters[at : at + rng.integers(0, 2)] = [rng.choice(list("abcdeigostuz"))] * rng.integers(0, 2)
        if letters:
            words.append("".join(letters))
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    last = machine.read(data, ends - [len(w) for w in words], ends)
    for w, state in zip(words, last):
        near = [_distance(t.text, w) for t in terms if not t.stem and _distance(t.text, w) <= t.errors]
        near += [0] if w.startswith("stem") else []
        assert (machine.term[state] >= 0) == bool(near), w
        if near:
            assert machine.errors[state] == min(near), w


def _detector():
    terms = [toxicity.Term("idiot", False, 1, 4.0), toxicity.Term("moron", False, 0, 4.0)]
    detector = toxicity.Detector(terms)
    detector.fit(np.zeros((0, len(toxicity.FEATURES))), np.zeros(0))
    return detector


def test_windows_tell_quotation_from_abuse(spark):
    rows = [
        (1, "you are an idiot"), (2, "the word “idiot” is in the list of old insults"),
        (3, "she said that he wrote idiot on the wall"), (4, "nothing here"), (5, "you are an id1ott, truly"), (6, "Ídiot"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(frame, _detector()).collect()}
    assert got[1] > got[2] > got[4] and got[1] > got[3] > got[4] and got[5] > got[4] and got[6] > got[4]
    hits = {r["doc_id"]: r for r in toxicity.spans(frame, _detector()).collect()}
    assert set(hits) == {"1", "2", "3", "5", "6"}
    assert hits["2"]["quoted"] and not hits["1"]["quoted"] and hits["1"]["addressed"] and hits["3"]["reported"]
    assert hits["5"]["errors"] == 1 and hits["5"]["word"] == "idiott"


def test_toxicity_odd_rows(odd, nothing, labels):
    got = toxicity.score(odd, _detector())
    assert got.where("score BETWEEN 0 AND 1").count() == 13
    assert toxicity.score(nothing, _detector()).count() == 0
    untrained = toxicity.fit(nothing, labels.limit(0))
    assert untrained.terms == [] and toxicity.score(odd, untrained).count() == 13


def test_lexicon_counts_every_different_row(spark):
    """Rows that share words are counted each; copies, in whatever order of words, once."""
    common = "you are all such a lot of"
    toxic = [f"{common} {w} dolts name{chr(97 + i)}" for i, w in enumerate(["blorp"] * 6 + ["grumf"] * 9)]
    clean = [f"{common} kind people other{chr(97 + i)}" for i in range(20)]
    rows = [(i, t) for i, t in enumerate(toxic + clean)] + [(99, "dolts BLORP namea you are all such a lot of")]
    frame = spark.createDataFrame([(int(i < 15 or i == 99), t) for i, t in rows], "_label int, _text string")
    got = {r["word"]: (r["toxic"], r["clean"]) for r in toxicity._vocabulary(toxicity._word_rows(frame)).collect()}
    assert got["blorp"] == (6, 0) and got["grumf"] == (9, 0) and got["such"] == (15, 20)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 15 or i == 99)) for i, _ in rows], "doc_id long, toxic int")
    assert {"blorp", "grumf", "dolts"} <= {t.text for t in toxicity.fit(docs, labels).terms}


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = docs
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        left = stage(spark, left, SF)
        left.write.parquet(str(tmp_path / name))
        left = spark.read.parquet(str(tmp_path / name))
        if name != "sharding":
            assert left.columns == docs.columns
        counts.append(left.count())
    assert counts[0] > counts[1] > counts[2] > counts[3] > 0 and counts[4] == counts[5]
    low = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").select("doc_id")
    assert spark.read.parquet(str(tmp_path / "quality")).join(low, "doc_id").count() == 0
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", F.col("text").alias("item"))
    clean = spark.read.parquet(str(tmp_path / "decontamination"))
    assert clean.join(F.broadcast(bench), F.contains("text", "item")).count() == 0


def test_toxicity_in_every_language(spark):
    """Recall and false alarms among held-out rows, by language."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    known = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    held = queries.QUERIES["op1_toxicity"](spark, sf).where("held_out").join(known, "doc_id").join(docs, "doc_id")
    rows = held.groupBy("lang").agg(
        F.sum("toxic").alias("toxic"), F.sum(F.col("toxic") * F.col("predicted")).alias("found"),
        F.sum((1 - F.col("toxic")) * F.col("predicted")).alias("wrong"), F.count(F.lit(1)).alias("n"),
    ).collect()
    got = {r["lang"]: r for r in rows}
    print({k: r.asDict() for k, r in got.items()})
    assert set(got) == {"de", "en", "es", "fr"}
    assert all(r["found"] >= 0.7 * r["toxic"] for r in rows)
    assert sum(r["found"] for r in rows) >= 0.85 * sum(r["toxic"] for r in rows)
    assert sum(r["wrong"] for r in rows) <= 0.005 * sum(r["n"] for r in rows)


def test_toxicity_marks_are_letters():
    """Marks count as letters, and windows read words of reporting without them."""
    data = np.frombuffer("ÉCRIT réÈß « x » ×".encode(), np.uint8)
    offsets, out = toxicity.fold(np.array([0, len(data)]), data)
    assert out.tobytes() == "écrit réèß \" x \"  ".encode("latin-1") and list(offsets) == [0, len(out)]
    machine = toxicity.Automaton([toxicity.Term("réeux", False, 1, 1.0)])
    words = ["réeux", "reeux", "rêeux", "reeu"]
    flat = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    last = machine.read(flat, ends - [len(w) for w in words], ends)
    assert list(machine.term[last] >= 0) == [True, True, True, False] and list(machine.errors[last][:3]) == [0, 1, 1]
    data = np.frombuffer("blé日本".encode(), np.uint8)
    folded = toxicity.fold(np.array([0, len(data)]), data)
    told = np.frombuffer(folded[1].tobytes().decode("latin-1").encode(), np.uint8)
    assert toxicity._single_bytes(np.array([0, len(told)]), told)[1].tobytes() == folded[1].tobytes()
