"""Toxicity: Levenshtein automata intersected with a lexicon trie, and scores of context windows.

The lexicon is learned: words and word beginnings that occur in toxic rows and hardly in others.
Its trie and the Levenshtein automata of its terms are walked together; the sets of (trie node,
errors) that can be reached become the states of one finite automaton, which reads all words of a
block of texts in step. How many errors a term allows is the largest number that brings in no
more than a few words of clean rows. A hit counts less or more by its window: quotation marks
around it and words of reporting against words of address. A logistic regression turns the hits
of a text into a score.
"""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mainstreet.llm import blocks
from mainstreet.plans.workspace import materialise

# Words of reporting and of address in the languages of the texts, without accents.
REPORTING = [
    "said", "says", "say", "wrote", "writes", "called", "calls", "quote", "quoted", "quotes",
    "term", "word", "means", "dit", "disent", "ecrit", "mot", "dijo", "dice", "escribio",
    "palabra", "sagte", "sagt", "schrieb", "wort", "nannte",
]
ADDRESS = [
    "you", "your", "youre", "yourself", "u", "du", "dich", "dir", "dein", "ihr",
    "tu", "te", "vous", "vos", "votre", "eres", "tus", "usted",
]

WINDOW = 6
FEW = 4  # rows at which the weight of a term is half of what its odds say
TIMES = 12  # toxic rows to a clean one from which a single clean row counts as chance
_LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"}

# Latin letters with marks, U+00C0 to U+00FF, without them
_LATIN = "aaaaaaaceeeeiiiidnooooo ouuuuypsaaaaaaaceeeeiiiidnooooo ouuuuypy"


def _tables():
    plain = np.arange(256, dtype=np.uint8)
    plain[65:91] += 32
    for a, b in _LEET.items():
        plain[ord(a)] = ord(b)
    # by the second byte of a Latin letter: its own number, in lower case; signs are spaces
    latin = np.full(256, 32, np.uint8)
    latin[0x80:0xC0] = np.arange(0xC0, 0x100)
    latin[0x80:0x9F] += 0x20
    latin[[0x97, 0xB7]] = 32
    unmarked = np.arange(256, dtype=np.uint8)
    unmarked[0xC0:] = np.frombuffer(_LATIN.encode(), np.uint8)
    word = np.zeros(256, bool)
    word[97:123] = word[128:] = True
    return plain, latin, unmarked, word


_PLAIN, _LATIN_TABLE, _UNMARKED, _IN_WORD = _tables()
_QUOTE = 34


def fold(offsets, data):
    """Lower case, one byte for a Latin letter with a mark, digits that stand for letters read as them, all quotation marks as one.

    Marks stay, because words that differ by them alone may be clean ones; a mark that is left out or
    put in is one error like any other letter. Digits without any letter beside them become letters
    too; the lexicon does not care.
    """
    out = _PLAIN[data]
    keep = np.ones(len(data), bool)
    if len(data) and data.max() >= 128:
        lead = np.flatnonzero(data[:-1] == 0xC3)
        out[lead + 1] = _LATIN_TABLE[data[lead + 1]]
        keep[lead] = False
        lead = np.flatnonzero(data[:-1] == 0xC2)
        second = data[lead + 1]
        out[lead + 1] = np.where((second == 0xAB) | (second == 0xBB), _QUOTE, 32)
        keep[lead] = False
        lead = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80))
        third = data[lead + 2]
        out[lead + 2] = np.where((third >= 0x9C) & (third <= 0x9F), _QUOTE, 32)
        keep[lead] = keep[lead + 1] = False
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=sums[1:])
    return sums[offsets], out[keep]


def folded_words(offsets, data):
    """Starts, ends and rows of the runs of letters of folded texts."""
    inside = _IN_WORD[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    some = offsets[:-1] < offsets[1:]
    begins[offsets[:-1][some]] = inside[offsets[:-1][some]]
    stops[offsets[1:][some] - 1] = inside[offsets[1:][some] - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(offsets, starts, "right") - 1


@dataclass(frozen=True)
class Term:
    text: str
    stem: bool  # a stem also stands for every longer word
    errors: int
    weight: float


class Automaton:
    """All words within each term's number of errors of it, as one table of transitions.

    State 0 is dead. ``term[s]`` is the nearest accepted term of state ``s`` or -1, ``errors[s]``
    its distance.
    """

    def __init__(self, terms):
        children, ends, budget = [{}], [-1], [0]
        for i, t in enumerate(terms):
            node = 0
            budget[0] = max(budget[0], t.errors)
            for c in t.text.encode("latin-1"):
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    ends.append(-1)
                    budget.append(0)
                node = children[node][c]
                budget[node] = max(budget[node], t.errors)
            ends[node] = i
        letters = sorted({c for node in children for c in node})
        self.classes = np.zeros(256, np.int64)
        self.classes[letters] = np.arange(1, len(letters) + 1)
        width = len(letters) + 1

        def closed(pairs):
            best, todo = {}, sorted(pairs, key=lambda p: p[1])
            while todo:
                node, e = todo.pop()
                if e > budget[node] or best.get(node, 9) <= e:
                    continue
                best[node] = e
                todo += [(child, e + 1) for child in children[node].values()]  # a letter left out
            return frozenset(best.items())

        def after(state, c):
            out = []
            for node, e in state:
                if ends[node] >= 0 and terms[ends[node]].stem and e <= terms[ends[node]].errors:
                    out.append((node, e))  # the rest of a stem's word is free
                out.append((node, e + 1))  # a letter too many
                for letter, child in children[node].items():
                    out.append((child, e + (letter != c)))
            return closed(out)

        start = closed([(0, 0)])
        numbers, order, table = {frozenset(): 0, start: 1}, [frozenset(), start], []
        for state in order:  # grows while it is gone through
            row = []
            for c in [None, *letters]:
                to = after(state, c)
                if to not in numbers:
                    numbers[to] = len(order)
                    order.append(to)
                row.append(numbers[to])
            table.append(row)
        self.table = np.array(table, np.int32).reshape(-1)
        self.width = width
        self.term = np.full(len(order), -1, np.int32)
        self.errors = np.zeros(len(order), np.int32)
        for s, state in enumerate(order):
            found = [(e, ends[n]) for n, e in state if ends[n] >= 0 and e <= terms[ends[n]].errors]
            if found:
                self.errors[s], self.term[s] = min(found)

    def read(self, data, starts, ends):
        """The state after each word; the words are read in step, and dead ones are dropped."""
        last = np.zeros(len(starts), np.int32)
        which = np.arange(len(starts))
        state, at, end = np.ones(len(starts), np.int64), starts, ends
        while len(which):
            state = self.table[state * self.width + self.classes[data[at]]].astype(np.int64)
            at = at + 1
            done = at >= end
            last[which[done]] = state[done]
            go = ~done & (state > 0)
            which, state, at, end = which[go], state[go], at[go], end[go]
        return last


def _word_sets(offsets, data):
    """Per text: one hash of the set of its words, and its distinct words as text."""
    offsets, data = fold(offsets, data)
    starts, ends, row = folded_words(offsets, data)
    hashes = blocks.span_hashes(data, starts, ends)
    raw = data.tobytes()
    cut = blocks.row_ranges(row, len(offsets) - 1)
    sets, words = [], []
    for a, b in zip(cut[:-1], cut[1:]):
        distinct, first = np.unique(hashes[a:b], return_index=True)
        sets.append(blocks.mix(distinct.sum(dtype=np.uint64, keepdims=True)).view(np.int64)[0])
        words.append(b" ".join(raw[starts[a + i] : ends[a + i]] for i in first).decode("latin-1"))
    return [np.array(sets, np.int64), words]


def _single_bytes(offsets, data):
    """Words of a vocabulary in the bytes that :func:`fold` makes: their code points are all below 256."""
    lead = (data == 0xC2) | (data == 0xC3)
    out = data.copy()
    out[1:][data[:-1] == 0xC3] += 0x40
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~lead, out=sums[1:])
    return sums[offsets], out[~lead]


def _word_rows(texts):
    """Label and distinct words of the texts; rows of a label with the very same set of words are one row."""
    fields = [T.StructField("_set", T.LongType()), T.StructField("_words", T.StringType())]
    rows = blocks.append_columns(texts, "_text", fields, _word_sets).drop("_text")
    return rows.dropDuplicates(["_label", "_set"])  # equal sets have equal words, so it does not matter which row stays


def _vocabulary(rows):
    """Words with the number of toxic and clean rows that have them."""
    words = rows.select("_label", F.explode(F.split("_words", " ")).alias("word")).where("word != ''")
    return words.groupBy("word").agg(F.sum("_label").alias("toxic"), F.sum(1 - F.col("_label")).alias("clean"))


def _candidates(vocabulary, support, purity, most):
    """Words and stems that stand in toxic rows: the share of ``purity``, or all but one row if the toxic ones are many times more."""
    toxic, clean = F.col("toxic"), F.col("clean")
    chance = (clean <= 1 + (1 - purity) * toxic) & (toxic >= TIMES * (clean + 0.5))
    pure = (toxic >= support) & ((clean <= (1 - purity) * toxic) | chance)
    whole = vocabulary.where(pure & (F.length("word") >= 4)).select("word", "toxic", F.lit(False).alias("stem"))
    cuts = F.explode(F.transform(F.array(*[F.lit(k) for k in (4, 5, 6)]), lambda k: F.when(
        F.length("word") > k, F.substring("word", F.lit(1), k)
    ))).alias("word")
    stems = vocabulary.select(cuts, "toxic", "clean").where("word IS NOT NULL").groupBy("word")
    stems = stems.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count(F.lit(1)).alias("_n"))
    stems = stems.where(pure & (F.col("_n") >= 4)).select("word", "toxic", F.lit(True).alias("stem"))
    found = whole.unionByName(stems).orderBy(F.col("toxic").desc(), "word", "stem").limit(most).collect()
    stems = []
    for r in sorted((r for r in found if r["stem"]), key=lambda r: len(r["word"])):
        if not any(r["word"].startswith(s) for s in stems):
            stems.append(r["word"])
    words = {r["word"] for r in found if not r["stem"]}
    return [(s, True) for s in stems] + [(w, False) for w in sorted(words) if not any(w.startswith(s) for s in stems)]


def _allowed(text, stem):
    return (0 if len(text) < 6 else 1) if stem else (0 if len(text) < 5 else 1 if len(text) < 8 else 2)


def lexicon(vocabulary, support, purity=0.98, most=300):
    """At most ``most`` terms with the errors each allows.

    A term keeps the largest number of errors whose words, over the whole vocabulary, stand in
    toxic rows at least nine times out of ten.
    """
    chosen = _candidates(vocabulary, support, purity, most)
    widest = [Term(t, stem, _allowed(t, stem), 1.0) for t, stem in chosen]
    if not widest:
        return []
    machine = Automaton(widest)
    fields = [T.StructField("_term", T.IntegerType()), T.StructField("_errors", T.IntegerType())]

    def match(offsets, data):
        offsets, data = _single_bytes(offsets, data)
        last = np.zeros(len(offsets) - 1, np.int32)
        some = np.flatnonzero(offsets[:-1] < offsets[1:])
        last[some] = machine.read(data, offsets[:-1][some], offsets[1:][some])
        return [machine.term[last], machine.errors[last]]

    seen = blocks.append_columns(vocabulary, "word", fields, match).where("_term >= 0")
    seen = seen.groupBy("_term", "_errors").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).collect()
    count = {(r["_term"], r["_errors"]): (r["t"], r["c"]) for r in seen}
    terms = []
    for i, term in enumerate(widest):
        errors, (t, c) = 0, count.get((i, 0), (0, 0))
        while errors < term.errors:
            more_t, more_c = count.get((i, errors + 1), (0, 0))
            if more_c > (t + more_t) / 9 - c or more_c > more_t:
                break
            errors, t, c = errors + 1, t + more_t, c + more_c
        # a term that few rows have may be there by chance, so it weighs less
        terms.append(Term(term.text, term.stem, errors, float(np.log((t + 0.5) / (c + 0.5)) * t / (t + FEW))))
    return terms


def _signature(words):
    joined = b" ".join(w.encode() for w in words)
    sizes = np.array([len(w) for w in words])
    starts = np.cumsum(np.concatenate([[0], sizes[:-1] + 1]))
    return blocks.span_hashes(np.frombuffer(joined, np.uint8), starts, starts + sizes)


FEATURES = ("plain", "spelled_otherwise", "quoted", "reported", "addressed", "share")


class Detector:
    """Hits of a lexicon in texts, weighed by their windows."""

    def __init__(self, terms):
        self.terms = terms
        self.machine = Automaton(terms) if terms else None
        self.weights = np.array([t.weight for t in terms])
        self.coefficients, self.intercept = np.zeros(len(FEATURES)), -3.0

    def hits(self, offsets, data):
        """Of folded texts: row, start, end, term, errors and (quoted, reported, addressed) of every hit."""
        starts, ends, row = folded_words(offsets, data)
        if not self.machine or not len(starts):
            return [np.zeros(0, np.int64)] * 5 + [np.zeros((0, 3), bool)]
        last = self.machine.read(data, starts, ends)
        found = np.flatnonzero(self.machine.term[last] >= 0)
        windows = np.zeros((len(found), 3), bool)
        if len(found):
            near = np.clip(found[:, None] + np.arange(-WINDOW, WINDOW + 1), 0, len(starts) - 1)
            own = row[near] == row[found][:, None]
            names = blocks.span_hashes(_UNMARKED[data], starts[near].ravel(), ends[near].ravel()).reshape(near.shape)
            windows[:, 1] = (np.isin(names, _signature(REPORTING)) & own).any(1)
            windows[:, 2] = (np.isin(names, _signature(ADDRESS)) & own).any(1)
            # quotation marks between the window's edges and the hit, on both sides
            marks = np.zeros(len(data) + 1, np.int64)
            np.cumsum(data == _QUOTE, out=marks[1:])
            low = np.maximum(starts[near[:, 0]], offsets[row[found]])
            high = np.minimum(ends[near[:, -1]], offsets[row[found] + 1])
            windows[:, 0] = (marks[starts[found]] > marks[low]) & (marks[high] > marks[ends[found]])
        return [row[found], starts[found], ends[found], self.machine.term[last[found]], self.machine.errors[last[found]], windows]

    def features(self, offsets, data):
        offsets, data = fold(offsets, data)
        n = len(offsets) - 1
        row, _, _, term, errors, windows = self.hits(offsets, data)
        weight = self.weights[term] if len(term) else np.zeros(0)
        quoted, reported, addressed = windows.T if len(term) else np.zeros((3, 0), bool)
        apart = quoted | reported
        total = lambda chosen: np.log1p(np.bincount(row[chosen], weight[chosen], n))
        size = np.maximum(1, np.diff(offsets) / 6)
        return np.column_stack([
            total(~apart & (errors == 0)), total(~apart & (errors > 0)), total(quoted), total(reported & ~quoted),
            total(addressed & ~apart), np.bincount(row, minlength=n) / size,
        ])

    def scores(self, offsets, data):
        z = self.features(offsets, data) @ self.coefficients + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit(self, x, y, ridge=1e-3, steps=50):
        """Logistic regression by Newton's method; quotation starts out as counting half."""
        before = np.array([3.0, 2.0, 1.0, 1.0, 1.0, 0.0, -3.0])
        at, wide = before.copy(), np.column_stack([x, np.ones(len(x))])
        pull = np.full(len(at), ridge * max(1, len(y)))
        if len(y) and y.min() < y.max():
            for _ in range(steps):
                p = 1 / (1 + np.exp(-np.clip(wide @ at, -30, 30)))
                slope = wide.T @ (p - y) + pull * (at - before)
                bend = (wide * (p * (1 - p))[:, None]).T @ wide + np.diag(pull)
                move = np.linalg.solve(bend, slope)
                at = at - move * min(1.0, 2.0 / (np.abs(move).max() + 1e-12))
        self.coefficients, self.intercept = at[:-1], float(at[-1])


def fit(docs, labels, label_col="toxic", train_rows=20_000, id_col="doc_id", text_col="text"):
    """Learn lexicon and weights from at most ``train_rows`` labelled rows, chosen by the hash of the id.

    Spark counts the words of these rows and finds their hits; the driver gets the lexicon (at most
    300 terms) and six numbers per row. Rows without id or label are not used.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    known = known.select(F.col(id_col).alias("_id"), (F.col(label_col) != 0).cast("int").alias("_label"))
    chosen = blocks.first_by_hash(known, F.col("_id"), train_rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    texts = materialise(texts.join(F.broadcast(chosen), "_id").select("_label", "_text"))
    words = materialise(_word_rows(texts))
    vocabulary = materialise(_vocabulary(words))
    toxic = words.agg(F.sum("_label")).first()[0] or 0
    detector = Detector(lexicon(vocabulary, support=max(4, toxic // 100)))
    field = [T.StructField("_features", T.BinaryType())]
    rows = blocks.append_columns(texts, "_text", field, lambda o, d: [[r.tobytes() for r in detector.features(o, d)]])
    rows = rows.select("_label", "_features").collect()
    x = np.array([np.frombuffer(r["_features"]) for r in rows]).reshape(len(rows), len(FEATURES))
    detector.fit(x, np.array([r["_label"] for r in rows], float))
    return detector


def score(docs, detector, text_col="text", score_col="score"):
    """The documents with the probability of being toxic. Null and empty texts have no hits and get the lowest score."""
    field = [T.StructField(score_col, T.DoubleType())]
    return blocks.append_columns(docs, text_col, field, lambda o, d: [detector.scores(o, d)])


def spans(docs, detector, id_col="doc_id", text_col="text"):
    """One row per hit: id, the word as folded, the term, its errors and whether it is quoted, reported or addressed."""
    schema = "_id string, word string, term string, errors int, quoted boolean, reported boolean, addressed boolean"

    def run(batches):
        import pyarrow as pa

        names = [p.split()[0] for p in schema.split(", ")]
        for batch in batches:
            for first, offsets, data in blocks.text_blocks(batch.column(1)):
                offsets, data = fold(offsets, data)
                row, start, end, term, errors, windows = detector.hits(offsets, data)
                raw = data.tobytes()
                yield pa.RecordBatch.from_pydict(dict(zip(names, [
                    pa.array([batch.column(0)[first + int(r)].as_py() for r in row], pa.string()),
                    pa.array([raw[a:b].decode("latin-1") for a, b in zip(start, end)], pa.string()),
                    pa.array([detector.terms[t].text for t in term], pa.string()),
                    pa.array(errors, pa.int32()),
                    *[pa.array(w, pa.bool_()) for w in (windows.T if len(row) else np.zeros((3, 0), bool))],
                ])))

    found = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, schema)
    return found.withColumnRenamed("_id", id_col)
