"""Language identification: averaged hashed subword embeddings and a linear softmax.

Byte 2-, 3- and 4-grams of the letters of a text are hashed into buckets; each bucket has an
embedding, a text is the average of its n-grams' embeddings, and a linear layer gives one score
per language. Both are trained together by stochastic gradient descent in numpy. A part of the
training rows is kept for calibration: a temperature for the probabilities, and the probability
below which an answer is marked as not accepted.
"""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mainstreet.llm import blocks
from mainstreet.operators.shuffles import first_rows

GRAMS = (2, 3, 4)
BUCKETS = 1 << 12
NO_LANGUAGE = "und"


def gram_counts(offsets, data):
    """Counts of hashed n-grams: one row per text, one column per bucket."""
    n = len(offsets) - 1
    plain = blocks.LETTERS[data].astype(np.uint32)
    row = np.repeat(np.arange(n, dtype=np.int64) * (BUCKETS + 1), np.diff(offsets))
    counts = np.zeros(n * (BUCKETS + 1), np.float32)
    gram = plain.copy()
    for size in range(2, max(GRAMS) + 1):
        gram = gram << np.uint32(8)
        gram[: len(gram) - size + 1] |= plain[size - 1 :]
        if size in GRAMS:
            bucket = ((gram + np.uint32(size)) * np.uint32(2654435769)) >> np.uint32(20)
            whole = (offsets[1:, None] - np.arange(1, size)).ravel()
            bucket = bucket.astype(np.int64)
            bucket[whole[whole >= 0]] = BUCKETS  # n-grams that would reach over the end of their text
            counts += np.bincount(row + bucket, minlength=len(counts))
    return counts.reshape(n, BUCKETS + 1)[:, :BUCKETS]


def _averaged(counts):
    return counts / np.maximum(counts.sum(1, keepdims=True), 1)


@dataclass
class Softmax:
    """``weights`` (bucket, language) is the product of embeddings and linear layer."""

    languages: list
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    accept: float

    def probabilities(self, counts):
        z = (_averaged(counts) @ self.weights + self.bias) / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def train(counts, answers, languages, width=16, epochs=30, rate=30.0, batch=32, precision=0.995, seed=5):
    """Fit to hashed counts and language numbers; every fifth row is kept for calibration."""
    rng = np.random.default_rng(seed)
    x, y = _averaged(counts), answers
    kept = np.arange(len(y)) % 5 == 4
    fit_at, held = np.flatnonzero(~kept), np.flatnonzero(kept)
    embed = rng.normal(0, 0.1, (x.shape[1], width)).astype(np.float32)
    out = np.zeros((width, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(fit_at)
        for low in range(0, len(order), batch):
            at = order[low : low + batch]
            hidden = x[at] @ embed
            z = hidden @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(at)), y[at]] -= 1
            p /= len(at)
            back = p @ out.T
            out -= np.float32(step / 10) * (hidden.T @ p)
            bias -= np.float32(step / 100) * p.sum(0)
            embed -= np.float32(step) * (x[at].T @ back)
    model = Softmax(list(languages), (embed @ out).astype(np.float32), bias, 1.0, 0.0)
    if len(held):
        losses = []
        for temperature in np.geomspace(0.2, 5, 25):
            model.temperature = float(temperature)
            p = model.probabilities(counts[held])
            losses.append((-np.log(np.maximum(p[np.arange(len(held)), y[held]], 1e-9)).mean(), temperature))
        model.temperature = float(min(losses)[1])
        p = model.probabilities(counts[held])
        order = np.argsort(-p.max(1), kind="stable")
        right = (p.argmax(1) == y[held])[order]
        good = np.flatnonzero(np.cumsum(right) / np.arange(1, len(right) + 1) >= precision)
        model.accept = float(p.max(1)[order][good[-1]]) if len(good) else 1.0
    return model


def fit(docs, lang_col="lang", per_language=800, id_col="doc_id", text_col="text"):
    """Fit to at most ``per_language`` texts of each language, chosen by the hash of the id.

    Rows without language or without letters are not used. The n-grams are counted by Spark over
    the whole texts; the driver gets the non-zero counts.
    """
    usable = docs.where(F.col(lang_col).isNotNull() & has_letter(F.col(text_col)) & F.col(id_col).isNotNull())
    ids = usable.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"))
    chosen = first_rows(ids, ["_lang"], [F.xxhash64(F.lit(13), "_id"), "_id"], per_language)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"))
    texts = texts.join(F.broadcast(chosen), ["_id", "_lang"])

    def packed(offsets, data):
        counts = gram_counts(offsets, data)
        used = [np.flatnonzero(r) for r in counts]
        return [
            [u.astype(np.uint16).tobytes() for u in used],
            [r[u].astype(np.float32).tobytes() for r, u in zip(counts, used)],
        ]

    fields = [T.StructField("_at", T.BinaryType()), T.StructField("_n", T.BinaryType())]
    rows = blocks.append_columns(texts, "_text", fields, packed)
    rows = sorted(rows.select("_id", "_lang", "_at", "_n").collect(), key=lambda r: (hash_order(r["_id"]), r["_lang"]))
    languages = sorted({r["_lang"] for r in rows})
    counts = np.zeros((len(rows), BUCKETS), np.float32)
    for i, r in enumerate(rows):
        counts[i, np.frombuffer(r["_at"], np.uint16)] = np.frombuffer(r["_n"], np.float32)
    answers = np.array([languages.index(r["_lang"]) for r in rows], int)
    return train(counts, answers, languages)


def hash_order(value):
    """An order of rows that does not follow their ids."""
    import zlib

    return zlib.crc32(str(value).encode()), str(value)


def has_letter(text):
    return F.coalesce(text.rlike("\\p{L}"), F.lit(False))


def predict(docs, model, text_col="text"):
    """The documents with ``lang_pred``, ``score`` (the probability of it) and ``accepted``.

    A text that is null or has no letter gets ``und``, score 0 and is not accepted; so does every
    text if there was nothing to learn from. Columns with these names are replaced.
    """
    best = blocks.free_name(docs, "_best")
    fields = [T.StructField(best, T.IntegerType()), T.StructField("score", T.DoubleType())]

    def compute(offsets, data):
        n = len(offsets) - 1
        if not model.languages:
            return [np.full(n, -1, np.int32), np.zeros(n)]
        p = model.probabilities(gram_counts(offsets, data))
        return [p.argmax(1).astype(np.int32), p.max(1).astype(float)]

    named = blocks.append_columns(docs, text_col, fields, compute)
    ok = has_letter(F.col(text_col)) & (F.col(best) >= 0)
    names = F.array(*[F.lit(v) for v in model.languages]) if model.languages else F.array().cast("array<string>")
    score = F.when(ok, F.col("score")).otherwise(0.0)
    named = named.withColumns({
        "lang_pred": F.when(ok, F.get(names, F.col(best))).otherwise(NO_LANGUAGE),
        "score": score,
        "accepted": ok & (score >= model.accept),
    })
    return named.drop(best)
