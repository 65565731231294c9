"""Fill-in-the-middle: texts are cut into prefix, middle and suffix, and the middle is moved to the end.

Units are runs of ASCII letters and single other code points. The two places of the cuts and the
form come from a hash of seed and id, so reruns and other partitions give the same rows. A text of
form ``psm`` becomes ``<P>prefix<S>suffix<M>middle``, one of form ``spm``
``<S>suffix<P>prefix<M>middle``; a ``plain`` one stays as it is. A text that holds a mark itself
is always plain, so every output can be put together again from output and form alone.

The cutting is a pipeline of ``pyarrow.compute`` calls per block of a batch: split the units into
list arrays, flatten them with the row each came from, number them within their row, filter them
by role, rebuild lists and join them. Rows are not moved to other tasks.
"""

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mainstreet.llm import blocks

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

BLOCK = 2 << 20  # bytes of text that are cut at a time; a longer text is a block of its own

# a run of letters, or any other byte with the continuation bytes after it, which is one code point
_UNIT = rb"([A-Za-z]+|[^A-Za-z][\x80-\xBF]*)"
_CUT = b"\xff"  # not a byte of UTF-8

_FIELDS = [
    T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
    T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType()),
]


def draws(id_col, seed=1):
    """Four unsigned 32-bit numbers from the hash of seed and id; a null id counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)])


def _modulo(pc, a, b):
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def _lists(pa, pc, values, lengths):
    """Lists of the given lengths over consecutive values."""
    ends = pc.cumulative_sum(lengths)
    return pa.LargeListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int64()), ends]), values)


def _cut(texts, h, plain_percent, spm_percent):
    """The columns ``_FIELDS`` of a block of texts; ``h`` are the four draws, one array each."""
    import pyarrow as pa
    import pyarrow.compute as pc

    empty = pa.scalar(b"", pa.large_binary())
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    units = pc.split_pattern(pc.replace_substring_regex(texts, pattern=_UNIT, replacement=rb"\1" + _CUT), pattern=_CUT)
    # every unit is followed by a cut, so that an empty piece stands at the end of each row
    places = pc.list_value_length(units).cast(pa.int64())
    n = pc.subtract(places, 1)
    one, two = _modulo(pc, h[0], places), _modulo(pc, h[1], places)
    low, high = pc.min_element_wise(one, two), pc.max_element_wise(one, two)

    flat, parent = pc.list_flatten(units), pc.list_parent_indices(units)
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), pc.take(units.offsets.cast(pa.int64()), parent))
    after_low = pc.greater_equal(ordinal, pc.take(low, parent))
    after_high = pc.greater_equal(ordinal, pc.take(high, parent))
    roles = [
        (pc.invert(after_low), low),
        (pc.and_not(after_low, after_high), pc.subtract(high, low)),
        (after_high, pc.subtract(places, high)),
    ]
    prefix, middle, suffix = (pc.binary_join(_lists(pa, pc, flat.filter(role), size), empty) for role, size in roles)

    held = pc.or_(*[pc.match_substring(texts, m) for m in (PREFIX, SUFFIX)])
    held = pc.or_(pc.or_(held, pc.match_substring(texts, MIDDLE)), pc.equal(n, 0))
    hundred = pa.scalar(100, pa.int64())
    plain = pc.or_(held, pc.greater_equal(_modulo(pc, h[2], hundred), 100 - plain_percent))
    spm = pc.less(_modulo(pc, h[3], hundred), spm_percent)
    p, s, m = (pa.scalar(v.encode(), pa.large_binary()) for v in (PREFIX, SUFFIX, MIDDLE))
    output = pc.if_else(
        plain, texts,
        pc.if_else(
            spm,
            pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, empty),
            pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, empty),
        ),
    )
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    none = pa.scalar(None, pa.int64())
    chars = [
        pc.if_else(plain, none, pc.utf8_length(v.cast(pa.large_string())).cast(pa.int64())) for v in (prefix, middle)
    ]
    return [n, form, *chars, output.cast(pa.string())]


def _run(width, names, plain_percent, spm_percent):
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            texts, drawn = batch.column(width), batch.column(width + 1)
            h = [pc.list_element(drawn, i) for i in range(4)]
            parts = []
            for row, offsets, _ in blocks.text_blocks(texts, BLOCK):
                rows = len(offsets) - 1
                parts.append(_cut(texts.slice(row, rows), [v.slice(row, rows) for v in h], plain_percent, spm_percent))
            if parts:
                more = [pa.concat_arrays([p[i] for p in parts]) for i in range(len(_FIELDS))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], *more], names)

    return run


def transform(docs, text_col="text", id_col="doc_id", seed=1, plain_percent=10, spm_percent=20):
    """The rows of ``docs`` without their texts, with n, form, prefix_chars, middle_chars and output.

    ``n`` counts the units; prefix_chars and middle_chars count code points and are null for plain
    rows. A null text counts as empty, and empty texts are plain. Repeated rows get the same result,
    rows without id draw as if their id were the empty text, and an empty table gives no rows.
    Whole texts are cut however long they are. Other columns stay; those named like the new ones are
    replaced.
    """
    columns = [c for c in docs.columns if c not in (text_col, *[f.name for f in _FIELDS])]
    schema = T.StructType([*[docs.schema[c] for c in columns], *_FIELDS])
    # the last two columns are taken by position, so their names may be anything
    ready = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(text_col), draws(F.col(id_col), seed))
    return ready.mapInArrow(_run(len(columns), schema.names, plain_percent, spm_percent), schema)


def restored(output="output", form="form"):
    """The text of an output. No mark overlaps itself, so the first one found is the one that was put in."""
    output, form = F.col(output), F.col(form)
    last = {"psm": SUFFIX, "spm": PREFIX}  # the mark of the second piece

    def piece(kind, i):
        inner = F.substr(output, F.lit(len(PREFIX) + 1))
        first = F.split_part(inner, F.lit(last[kind]), F.lit(1))
        rest = F.split_part(inner, F.lit(last[kind]), F.lit(2))
        return [first, F.split_part(rest, F.lit(MIDDLE), F.lit(1)), F.split_part(rest, F.lit(MIDDLE), F.lit(2))][i]

    return (
        F.when(form == "psm", F.concat(piece("psm", 0), piece("psm", 2), piece("psm", 1)))
        .when(form == "spm", F.concat(piece("spm", 1), piece("spm", 2), piece("spm", 0)))
        .otherwise(output)
    )
