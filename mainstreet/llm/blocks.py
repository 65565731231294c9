"""Texts of Arrow batches as byte arrays, and hashing that works on whole blocks of them.

Spark bounds an Arrow batch by rows and bytes; the operators go through it in blocks of about a
quarter of a megabyte, so that temporary arrays stay small. A longer text is a block of its own.
"""

import numpy as np

BLOCK_BYTES = 1 << 18

_MULTIPLIER = 0x9E3779B97F4A7C15
_WORD = 1 << 64

# Bytes that separate words: space and the controls from tab to carriage return.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True

LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[65:91] += 32

# lower-cased ASCII letters and all bytes of longer code points; anything else is a space
LETTERS = np.full(256, 32, np.uint8)
LETTERS[65:91] = LETTERS[97:123] = np.arange(97, 123, dtype=np.uint8)
LETTERS[128:] = np.arange(128, 256, dtype=np.uint8)


def string_buffers(column):
    """Offsets (int64, one more than rows) and bytes of an Arrow string or binary array; null is empty."""
    wide = str(column.type).startswith("large")
    offsets = np.zeros(1, np.int64)
    if len(column):
        raw = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
        offsets = raw[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2] if len(column) else None
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def text_blocks(column, limit=BLOCK_BYTES):
    """Yield (first row, offsets from 0, bytes) of runs of rows with at most ``limit`` bytes, or one row."""
    offsets, data = string_buffers(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, rows)
        yield row, offsets[row : end + 1] - offsets[row], data[offsets[row] : offsets[end]]
        row = end


def mix(x):
    """Finalise 64-bit values so that all bits depend on all bits; wraps on purpose."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind, n):
    if len(_powers[kind]) < n:
        base = _MULTIPLIER if kind == "up" else pow(_MULTIPLIER, -1, _WORD)
        steps = np.full(max(n, 2 * BLOCK_BYTES), base, np.uint64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps, dtype=np.uint64)
    return _powers[kind][:n]


def span_hashes(data, starts, ends):
    """64-bit hashes of the byte spans [start, end); equal bytes have equal hashes wherever they stand."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", n), out=sums[1:])
    raw = (sums[ends] - sums[starts]) * _power("down", n + 1)[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def gram_hashes(data, length):
    """Hash of the ``length`` bytes from every position on; the last ``length - 1`` ones are not whole."""
    n = len(data)
    whole, done = np.zeros(n, np.uint64), 0
    part, width, left = data.astype(np.uint64) + np.uint64(1), 1, length
    while left:
        if left & 1:
            whole *= np.uint64(pow(_MULTIPLIER, width, _WORD))
            whole[: max(0, n - done)] += part[done:]
            done += width
        left >>= 1
        if left:
            longer = part * np.uint64(pow(_MULTIPLIER, width, _WORD))
            longer[: max(0, n - width)] += part[width:]
            part, width = longer, 2 * width
    return mix(whole)


def words(offsets, data):
    """Start, end and row of every word: a run of bytes other than space and tab to carriage return."""
    space = IS_SPACE[data]
    inside = ~space
    begins = inside.copy()
    begins[1:] &= space[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[firsts] = inside[firsts]
    stops = inside.copy()
    stops[:-1] &= space[1:]
    lasts = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    stops[lasts] = inside[lasts]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def row_ranges(rows, n):
    """Start and end of each row's run in the sorted array ``rows``."""
    return np.searchsorted(rows, np.arange(n + 1))


def free_name(df, name):
    """The name, with as many underscores behind it as it takes to differ from all columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def append_columns(df, text_col, fields, compute):
    """The rows of ``df`` with further columns from their texts; ``compute(offsets, data)`` gives one array per field.

    Rows are neither moved nor copied to another task. Columns of the same names are replaced.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    df = df.drop(*[f.name for f in fields])
    schema = T.StructType([*df.schema.fields, *fields])
    at = df.columns.index(text_col)
    names = schema.names
    kinds = {"long": pa.int64(), "double": pa.float64(), "integer": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    kinds = [kinds[f.dataType.typeName()] for f in fields]

    def run(batches):
        for batch in batches:
            found = [compute(offsets, data) for _, offsets, data in text_blocks(batch.column(at))]
            more = []
            for i, kind in enumerate(kinds):
                values = [v for part in found for v in part[i]] if kind == pa.string() or kind == pa.binary() else (
                    np.concatenate([part[i] for part in found]) if found else np.zeros(0)
                )
                more.append(pa.array(values, kind))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names)

    return df.mapInArrow(run, schema)


def remainder(column, modulus):
    """crc32 of the value as text, modulo ``modulus``; a null counts as the empty text."""
    from pyspark.sql import functions as F

    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def first_by_hash(df, key, n):
    """``n`` rows chosen by the hash of the key: the same on every run, whatever the partitions."""
    from pyspark.sql import functions as F

    return df.orderBy(F.xxhash64(F.lit(11), key), key).limit(n)
