"""Fill-in-the-middle against a plain version, and the round trip of every row."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from mainstreet.llm import infill


def plainly(doc_id, text, plain_percent=10, spm_percent=20, seed=1):
    """n, form, prefix_chars, middle_chars and output of one text, by the rule."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(k in text for k in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100 - plain_percent:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm_percent:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check(df, **options):
    made = infill.transform(df, **options).withColumn("back", infill.restored())
    rows = made.join(df.select(F.col("doc_id").alias("i"), F.col("text").alias("t")).distinct(), F.col("doc_id").eqNullSafe(F.col("i")))
    asked = {k: v for k, v in options.items() if k.endswith("percent") or k == "seed"}
    pairs = [(r, plainly(r["doc_id"], r["t"], **asked)) for r in rows.collect()]
    return pairs


def test_every_row_of_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    pairs = check(docs)
    assert len(pairs) == docs.count()
    for r, expected in pairs:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == expected
        assert r["back"] == (r["t"] or "")
    assert {r["form"] for r, _ in pairs} == {"plain", "psm", "spm"}


HARD = [
    "<P>", "a<S>b", "x<M", "<", "<<<", "<P", "P>", "<S", "S>x<", "M>", "a<b<S", "\x00\x00a\x00", "é", "日本 go 語", "áb", "🙂🙂 ok", "\n\r\t",
    "<P<S<M", "> <S <P <M >", "Zeile\r\nzwei", "aZ[`{@", "ÿþ" * 40, "word " * 3000,
]


@pytest.mark.parametrize("options", [{"plain_percent": 0}, {"plain_percent": 0, "spm_percent": 100}, {"plain_percent": 100}, {"seed": 9}])
def test_hard_texts(spark, options):
    rows = [(i * 100 + j, text) for i, text in enumerate(HARD) for j in range(8)]
    pairs = check(spark.createDataFrame(rows, "doc_id long, text string"), **options)
    assert len(pairs) == len(rows)
    for r, expected in pairs:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == expected
        assert r["back"] == r["t"]


def test_blocks_do_not_matter(spark, monkeypatch, texts):
    rows = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string").repartition(3)
    whole = {r["doc_id"]: r for r in infill.transform(rows).collect()}
    monkeypatch.setattr(infill, "BLOCK", 100)
    assert {r["doc_id"]: r for r in infill.transform(rows).collect()} == whole


def test_odd_rows(odd, nothing):
    made = infill.transform(odd)
    assert made.columns == [c for c in odd.columns if c != "text"] + ["n", "form", "prefix_chars", "middle_chars", "output"]
    rows = made.collect()
    assert len(rows) == odd.count() and all(r["score"] == "x" and r["_text"] == "x" for r in rows)
    assert [r["form"] for r in rows if r["n"] == 0] == ["plain"] * 3
    assert len({(r["form"], r["output"]) for r in rows if r["doc_id"] == 1}) == 1
    renamed = infill.transform(odd.withColumnRenamed("key", "output").withColumnRenamed("a", "form"))
    assert renamed.columns.count("output") == renamed.columns.count("form") == 1
    assert sorted(map(str, renamed.select("doc_id", "form", "output").collect())) == sorted(map(str, made.select("doc_id", "form", "output").collect()))
    assert infill.transform(nothing).count() == 0
