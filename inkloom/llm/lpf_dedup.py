"""Removal of repeated byte strings by longest-previous-factor arrays over shared suffixes.

A string of WINDOW bytes is repeated if it starts at two places of the corpus.
Suffixes that can share one are brought together first: each window is labelled
with the least hash of its GRAM-byte strings, and equal windows have equal
labels. Runs of windows with one label and place are rows; rows whose label is
unique in the corpus can hold no repeat and end there. Rows equal as a whole
are settled by counting. The others send their bytes to the task of their
label, where suffix order (prefix doubling on numpy ranks) gives longest factors:
of the suffixes that stand earlier in the text, those at the previous and next
smaller positions in suffix order have most in common with a suffix, and the
longer of the two common prefixes is its longest previous factor; the longest
next factor is the same seen from the end. A window is repeated if one of them
reaches WINDOW (longer ones are not told apart). Labels with very many
different rows (a passage in a third of all documents) are settled by counting
128-bit digests of their windows instead, which finds the same windows and
spreads over all tasks.

Every occurrence of a repeated string is removed, or, with keep_first, every one
but the first in the order of ids and places: there a window goes if its longest
previous factor reaches WINDOW. Rows with the same id and text are one place,
and are told apart from others by id and 64 bits (without an id: 126 bits) of
their text. Runs are equal if 128 bits of two unlike hashes are.

Defined cases: a null text is empty; texts shorter than WINDOW stay; overlapping
repeats within one document count; repeated rows are copies of each other; null
ids are kept, and come first, in the order of a hash; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, text_or_empty
from .encoding import small_batches

WINDOW = 200
GRAM = 100
#: Different rows of a label that one task settles; beyond that their windows are counted.
LABEL_ROWS = 512
_CHUNK = 1 << 20  # windows of a text that are hashed at once
_PACKED = 7  # bytes of the first ranks: 257^7 fits into 63 bits
_BATCH = 1 << 20  # bytes whose suffixes are ordered at once

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_SEED = 0x5851F42D4C957F2D
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd base modulo 2^64 and their inverses, kept for longer texts."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        pair = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            pair.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[:] = pair
    return _POWERS


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _sums(data: np.ndarray) -> np.ndarray:
    powers, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers[: len(data)], out=out[1:])
    return out


def _spans(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[begin:end], alike wherever the bytes stand."""
    _, inverse = _powers(len(sums))
    return _mixed((sums[end] - sums[begin]) * inverse[begin])


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values, from running minima of blocks."""
    n = len(h) - width + 1
    blocks = np.concatenate([h, np.full(-len(h) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def labelled_runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(label, digest of the run's bytes, first window, windows) of the runs of one text.

    A run ends where the label changes or where its leftmost least string falls
    out of the window, so that the windows of a run are all different.
    """
    import xxhash

    digest, parts = xxhash.xxh3_64_intdigest, []
    for at in range(0, len(data) - WINDOW + 1, _CHUNK):
        piece = data[at : at + _CHUNK + WINDOW - 1]
        sums = _sums(piece)
        places = np.arange(len(piece) - GRAM + 1)
        h = _spans(sums, places, places + GRAM)
        least = window_minima(h, WINDOW - GRAM + 1)
        begin = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (h[: len(least) - 1] == least[:-1])]))
        count = np.diff(np.append(begin, len(least)))
        view = piece.tobytes()
        whole = np.array([digest(view[i:j], _SEED) for i, j in zip(begin.tolist(), (begin + count - 1 + WINDOW).tolist())], np.uint64)
        parts.append((least[begin], whole, begin + at, count))
    return tuple(np.concatenate(p) for p in zip(*parts)) if parts else tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key of the row (k, th), equal for copies alone; neither part is ever null."""
    text, missing = text_or_empty(), F.col("doc_id").isNull()
    # without an id, 62 bits of the text stand for one below all others
    stand_in = F.lit(-(1 << 63)) + F.xxhash64(F.lit("id"), text).bitwiseAND(F.lit((1 << 62) - 1))
    return docs.select("doc_id", text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), stand_in).alias("k"), F.xxhash64(text, missing).alias("th"))


RUNS = "label long, whole long, k long, th long, start int, windows int"


def runs(rows: DataFrame) -> DataFrame:
    def scan(batches):
        for batch in batches:
            for part, texts in small_batches(batch):
                found = [labelled_runs(np.frombuffer(t.encode(), np.uint8)) for t in texts]
                sizes = [len(f[0]) for f in found]
                label, whole, start, windows = (np.concatenate([f[i] for f in found]) for i in range(4))
                k, th = (np.repeat(part.column(c).to_numpy(zero_copy_only=False), sizes) for c in ("k", "th"))
                columns = [label.view(np.int64), whole.view(np.int64), k, th, start.astype(np.int32), windows.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["label", "whole", "k", "th", "start", "windows"])

    return rows.select("text", "k", "th").mapInArrow(scan, RUNS)


def suffix_ranks(text: np.ndarray, depth: int = WINDOW) -> list[tuple[int, np.ndarray]]:
    """(width, ranks of the suffixes of text by their first width bytes, equal ones alike), widths doubling up to depth.

    A suffix that ends before a width ranks below its extensions.
    """
    n = len(text)
    width = min(_PACKED, depth)
    padded = np.concatenate([text.astype(np.int64) + 1, np.zeros(width, np.int64)])
    key = np.zeros(n, np.int64)
    for i in range(width):
        key = key * 257 + padded[i : i + n]
    out = []
    while True:
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])[:n] + 1
        out.append((width, rank.astype(np.int32)))
        if width >= depth:
            return out
        step = min(width, depth - width)
        tail = np.zeros(n, np.int64)
        tail[: max(0, n - step)] = rank[step:]
        key = rank * (n + 2) + tail
        width += step


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the last earlier one with a smaller value, or -1.

    All places jump at once: what lies between a place and where it points is
    larger than it, and stays so if it takes over where that one points.
    """
    to = np.arange(len(values)) - 1
    open_ = np.flatnonzero(to >= 0)
    while True:
        open_ = open_[values[to[open_]] >= values[open_]]
        if not len(open_):
            return to
        to[open_] = to[to[open_]]
        open_ = open_[to[open_] >= 0]


def common_prefix(ranks: list[tuple[int, np.ndarray]], one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Bytes that the suffixes at two places have in common, up to the last width: where it is less, from the ranks of shorter
    widths it is a multiple of the first, rounded down."""
    depth, last = ranks[-1]
    out = np.where(last[one] == last[other], depth, 0)
    short = np.flatnonzero(out == 0)
    for width, rank in ranks[-2::-1]:
        a, b = one[short] + out[short], other[short] + out[short]
        inside = np.maximum(a, b) < len(rank)
        same = np.zeros(len(short), bool)
        same[inside] = rank[a[inside]] == rank[b[inside]]
        out[short[same]] += width
    return out


def longest_factors(text: np.ndarray, starts: np.ndarray, depth: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(previous, next): the longest previous (next) factor of the suffix at each start, among the suffixes at starts.

    Lengths are cut at depth, and below it rounded down by common_prefix().
    starts are in order.
    """
    ranks = suffix_ranks(text, depth)
    order = np.argsort(ranks[-1][1][starts], kind="stable")  # of equal suffixes the earlier place comes first
    place = starts[order]
    out = []
    for sign in (1, -1):
        length = np.zeros(len(starts), np.int64)
        for flip in (False, True):  # the previous, and the next smaller (larger) place in suffix order
            values = (sign * place)[::-1] if flip else sign * place
            to = previous_smaller(values)
            some = np.flatnonzero(to >= 0)
            mine, its = (values[some] * sign), (values[to[some]] * sign)
            common = common_prefix(ranks, mine, its)
            at = order[::-1][some] if flip else order[some]
            length[at] = np.maximum(length[at], common)
        out.append(length)
    return out[0], out[1]


CONTEXTS = "label long, k long, th long, start int, copies long, many boolean, bytes binary"
SPANS = "k long, th long, begin int, end int"


def _contexts(batches):
    """Each listed run's label, place and bytes."""
    for batch in batches:
        rows = []
        columns = [batch.column(c).to_pylist() for c in ("text", "k", "th", "wanted")]
        for text, k, th, wanted in zip(*columns):
            data = text.encode()
            for w in wanted or ():
                rows.append((w["label"], k, th, w["start"], w["copies"], w["many"], data[w["start"] : w["start"] + w["windows"] - 1 + WINDOW]))
                if len(rows) >= 20_000:
                    yield _batch(rows)
                    rows = []
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()]
    columns = list(zip(*rows)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [c.split()[0] for c in CONTEXTS.split(", ")])


def _spans_of(k: np.ndarray, th: np.ndarray, at: np.ndarray, hit: np.ndarray, owner: np.ndarray) -> pa.RecordBatch:
    """Runs of hit windows, as byte spans of their documents."""
    i = np.flatnonzero(hit)
    first = np.concatenate([[True], (np.diff(i) != 1) | (np.diff(owner[i]) != 0)]) if len(i) else np.empty(0, bool)
    last = np.append(np.flatnonzero(first)[1:] - 1, len(i) - 1) if len(i) else np.empty(0, int)
    begin, end = at[i[first]], at[i[last]] + WINDOW
    who = owner[i[first]]
    return pa.RecordBatch.from_arrays([pa.array(k[who], pa.int64()), pa.array(th[who], pa.int64()), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))], ["k", "th", "begin", "end"])


def _settle(rows: list[tuple], keep_first: bool) -> pa.RecordBatch:
    """Repeated windows among whole labels; (label, k, th, start, copies, bytes) in this order.

    Without keep_first only rows without copies are asked for: the others are
    settled. With it, each row is asked for windows that stand earlier.
    """
    label, k, th, start, copies = (np.array([r[i] for r in rows], np.int64) for i in range(5))
    sizes = np.array([len(r[5]) for r in rows], np.int64)
    windows = sizes - WINDOW + 1
    text = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
    base = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(rows)), windows)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    # equal windows have equal labels, so that the labels may be ordered together
    previous, following = longest_factors(text, base[owner] + inner)
    hit = previous >= WINDOW if keep_first else (np.maximum(previous, following) >= WINDOW) & (copies[owner] == 1)
    return _spans_of(k, th, start[owner] + inner, hit, owner)


def _settle_all(keep_first: bool):
    def settle(batches):
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("label", "k", "th", "start", "copies", "bytes"))):
                if size >= _BATCH and row[0] != held[-1][0]:
                    yield _settle(held, keep_first)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield _settle(held, keep_first)

    return settle


def _count_windows(batches):
    """A 128-bit digest and the place of each window of the rows with very common labels."""
    import xxhash

    digest = xxhash.xxh3_128_digest
    for batch in batches:
        for k, th, start, copies, data in zip(*(batch.column(c).to_pylist() for c in ("k", "th", "start", "copies", "bytes"))):
            for at in range(0, len(data) - WINDOW + 1, _CHUNK):
                n = min(_CHUNK, len(data) - WINDOW + 1 - at)
                both = np.frombuffer(b"".join(digest(data[i : i + WINDOW], _SEED) for i in range(at, at + n)), "<i8").reshape(n, 2)
                columns = [np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1]), np.full(n, k), np.full(n, th), np.arange(start + at, start + at + n, dtype=np.int32), np.full(n, copies)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["one", "two", "k", "th", "begin", "copies"])


def repeated_spans(rows: DataFrame, keep_first: bool = False) -> DataFrame:
    """k, th, begin, end: byte spans of keyed rows whose windows all occur elsewhere too, or earlier with keep_first."""
    found = materialize(runs(rows), "runs")
    # stored by itself, so that the join below has plain shuffles on both sides, which Spark can split at a hot label
    shared = materialize(found.groupBy("label").agg(F.count("*").alias("n")).where("n > 1").select("label"), "labels")
    again = materialize(found.join(shared, "label"), "shared")
    discard(found, shared)
    place = F.min(F.struct("k", "th", "start", "windows")).alias("place")
    kinds = materialize(again.groupBy("label", "whole").agg(F.count("*").alias("copies"), place), "kinds")
    equal = again.join(kinds.where("copies > 1").select("label", "whole", "place"), ["label", "whole"])
    if keep_first:
        equal = equal.where("not (k = place.k and th = place.th and start = place.start)")
    equal = equal.select("k", "th", F.col("start").alias("begin"), (F.col("start") + F.col("windows") - 1 + WINDOW).alias("end"))
    least = "n > 1" if keep_first else "n > 1 and single > 0"
    unsettled = kinds.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("copies") == 1).alias("single")).where(least)
    wanted = kinds.join(unsettled.select("label", (F.col("n") > LABEL_ROWS).alias("many")), "label")
    entry = F.struct("label", F.col("place.start").alias("start"), F.col("place.windows").alias("windows"), "copies", "many")
    # a document lists its own runs: no more than it has bytes
    lists = wanted.select(F.col("place.k").alias("k"), F.col("place.th").alias("th"), entry.alias("entry")).groupBy("k", "th").agg(F.collect_list("entry").alias("wanted"))
    contexts = materialize(rows.join(lists, ["k", "th"], "left").where("wanted is not null").mapInArrow(_contexts, CONTEXTS), "contexts")
    few = contexts.where("not many").repartition("label").sortWithinPartitions("label", "k", "th", "start").mapInArrow(_settle_all(keep_first), SPANS)
    windows = contexts.where("many").mapInArrow(_count_windows, "one long, two long, k long, th long, begin int, copies long")
    spot = F.struct("k", "th", "begin")
    common = windows.groupBy("one", "two").agg(F.count("*").alias("n"), F.min(spot).alias("first")).where("n > 1").select("one", "two", "first")
    many = windows.join(common, ["one", "two"]).where(spot != F.col("first") if keep_first else F.col("copies") == 1)
    return equal.unionByName(few).unionByName(many.select("k", "th", "begin", (F.col("begin") + WINDOW).alias("end")))


def _removed(batches):
    for batch in batches:
        out = []
        for doc, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans"))):
            data = np.frombuffer(text.encode(), np.uint8)
            edge = np.zeros(len(data) + 1, np.int64)
            for s in spans or ():
                edge[s["begin"]] += 1
                edge[s["end"]] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            kept = data[~gone].tobytes()
            out.append((doc, len(data), int(gone.sum()), int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1)), hashlib.sha256(kept).hexdigest(), kept))
        columns = list(zip(*out)) or [()] * 6
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, keep_first: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes of each document."""
    rows = keyed(docs)
    spans = repeated_spans(rows, keep_first).groupBy("k", "th").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    joined = rows.join(spans, ["k", "th"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op9_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")


#: Over hexadecimal digits, two for each byte, because SQL strings count characters.
OP9_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, i, md5(substr(h, 2 * i + 1, 400)) AS x FROM (SELECT r, h, unnest(range(greatest(length(h) // 2 - 199, 0))) AS i FROM d)),
c AS (SELECT r, i FROM w WHERE x IN (SELECT x FROM w GROUP BY x HAVING count(*) > 1)),
g AS (SELECT r, i, sum(CASE WHEN i - before <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS run FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM c)),
s AS (SELECT r, min(i) AS b, max(i) + 200 AS e FROM g GROUP BY r, run),
k AS (SELECT s.r, b, e, substr(h, 2 * lag(e, 1, 0) OVER o + 1, 2 * (b - lag(e, 1, 0) OVER o)) AS piece FROM s JOIN d USING (r) WINDOW o AS (PARTITION BY s.r ORDER BY b)),
a AS (SELECT r, sum(e - b)::BIGINT AS n_removed, count(*) AS n_spans, max(e) AS last, string_agg(piece, '' ORDER BY b) AS head FROM k GROUP BY r)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN a USING (r)
"""
