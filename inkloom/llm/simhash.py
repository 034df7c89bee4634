"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are made distinct first, so that a group of copies is one row. A
tile holds the fingerprints with the same population counts in their upper and
lower halves; tiles are cut into blocks of about BLOCK rows by hash. Two
fingerprints within RADIUS bits have half counts that differ by RADIUS in sum
at most, so that all other pairs of tiles are skipped. The remaining pairs of
blocks are compared by numpy exclusive-or and bit counts, and each gives only
a spanning forest of its links, never the pairs.

The number of blocks, and so of a row's copies, stays about the same until a
block reaches MOST_BLOCK rows (8 MB).

near_duplicates() links by the fingerprints alone (the query's contract), or, where
a similarity is asked for, by the Jaccard similarity of the sets of five-word
shingles. Texts with equal sets are one row then, and every link is decided on
the sets. Candidates come from two searches. The first is by fingerprints in a
wider radius, compared in the same way; it only spares work, since it ties up
large groups in few links. The second is complete: with all sets in one order,
two sets that are similar enough share a shingle among the first few of both
(prefix filter). In both, a bit map of each set, whose bits are the parities of
its hashes, bounds from below how many members two sets do not share, so that
only pairs that may be similar are held against their texts. The second search
takes a spanning forest of its candidates first, and all that are left apart then;
its rows carry bit maps of SHORT_BITS at most, since a set has a row for each of
its first shingles, and the whole maps judge the distinct pairs that come out.
Shingles that the same sets have are one group there, named by the first of them,
and a pair is passed by where too little is left of either set after the shingle
that it meets at. Where candidates are many more than sets, each set is held
against one other first, and only pairs that are still apart are read after that.

Defined cases: a null or blank text has fingerprint zero, linked like any other;
texts of one or two words have one shingle; repeated rows and ids are kept, each
with its component; a null doc_id does not become a component's id unless all
its members have none; an empty table gives no rows; other columns are ignored.
Sets are named by 64-bit digests, and documents that are read again by 96 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, connected_components, discard, materialize, text_or_empty
from .encoding import small_batches

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Fingerprints of a block, at least and at most; a pair of blocks is one task's unit of work.
BLOCK = 8192
MOST_BLOCK = 1 << 20
_BLOCKS = 64  # blocks of all fingerprints between these bounds
#: Of a class that a row may be tied to, so many members that may be similar are looked at, and the closest is the candidate.
#: What the first search leaves apart for it, the second finds.
LOOKED_AT = 16
_STEP, _WIDTH = 256, 1 << 16  # rows and columns of blocks that are compared at once
#: For verified links: the radius of the first search, at which few unrelated texts are candidates. Pairs beyond it are
#: found by the second.
WIDE_RADIUS = 11
SET_SHINGLE = 5
#: Bits of a set's bit map at most where it is shipped with each of the set's shingles.
SHORT_BITS = 512
#: Sets of a block of those that share a shingle.
TOKEN_BLOCK = 2048
#: About so many documents are read to see which shingles are common, and so many shingles are listed at most. The list
#: only puts common shingles last in the order of the sets; which links are found does not depend on it.
COMMON_DOCS = 20_000
COMMON_SHINGLES = 200_000
#: Candidates for each set beyond which most are expected to be tied up by a few of them.
MANY_PAIRS = 3


def words_of(text: str | None) -> list[bytes]:
    # bytes.lower() changes A-Z alone, and bytes.split() cuts at the six ASCII white-space characters
    return (text or "").encode().lower().split()


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of each run of width words, repeats included; of all words if there are fewer."""
    import xxhash

    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], "<u8")
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    begins = (ends - sizes)[: 1 - width].tolist()
    hash_of = xxhash.xxh64_intdigest
    return np.array([hash_of(joined[a:b], SEED) for a, b in zip(begins, ends[width - 1 :].tolist())], "<u8")


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Majority of the bits of the shingles' XXH64, as a signed 64-bit integer."""
    words = words_of(text)
    if not words:
        return 0
    bits = np.unpackbits(shingle_hashes(words, width).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(bits), 255):  # sums of up to 255 bits stay within a byte
        counts += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(counts * 2 > len(bits), bitorder="little").view("<i8")[0])


def parities(hashes: np.ndarray, most: int | None = None) -> bytes:
    """A bit map of about a bit for each member, of most bits at most: bit i is the parity of the number of hashes that are i modulo its size."""
    size = max(64, 1 << (len(hashes) - 1).bit_length()) if len(hashes) else 64
    size = min(size, most or size)
    counts = np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(bits: bytes, size: int) -> int:
    """A bit map as a number, halved until it has size bytes: what stands in two halves adds up modulo 2."""
    x, n = int.from_bytes(bits, "little"), len(bits)
    while n > size:
        n //= 2
        x = (x ^ x >> 8 * n) & ((1 << 8 * n) - 1)
    return x


def spare(one: bytes, n: int, other: bytes, m: int, similarity: float) -> float:
    """How many members more than similar sets need may be shared by sets of n and m members with these bit maps: each differing bit is a member of one alone."""
    size = min(len(one), len(other))
    apart = (folded(one, size) ^ folded(other, size)).bit_count()
    return n + m - apart - 2 * (n + m) * (similarity / (1 + similarity))


def may_be_similar(one: bytes, n: int, other: bytes, m: int, similarity: float) -> bool:
    """False only if sets of n and m members with these bit maps are less similar."""
    return spare(one, n, other, m, similarity) >= -1e-6


def shingle_set(text: str | None, width: int = SET_SHINGLE) -> np.ndarray:
    """The distinct shingle hashes in order; none for a text without words."""
    words = words_of(text)
    return np.unique(shingle_hashes(words, width)) if words else np.zeros(0, "<u8")


def rarest_first(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """hashes, those in common (sorted) last, by count."""
    if not len(common) or not len(hashes):
        return hashes
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    return hashes[np.argsort(np.where(common[at] == hashes, counts[at], 0), kind="stable")]


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, fp of each document."""

    def hashed(batches):
        for batch in batches:
            for part, texts in small_batches(batch, most_bytes=8_000_000):
                columns = [part.column("doc_id"), pa.array([fingerprint(t, width) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(hashed, "doc_id long, fp long")


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes (sorted) that several of a sample of documents have, and how many."""

    def hashed(batches):
        for batch in batches:
            for _, texts in small_batches(batch):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingle_set(t) for t in texts]).view(np.int64))], ["token"])

    every = max(1, docs.count() // COMMON_DOCS)
    tokens = docs.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select(text_or_empty().alias("text")).mapInArrow(hashed, "token long")
    most = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "token").limit(COMMON_SHINGLES).toArrow()
    common, counts = most.column("token").to_numpy().view(np.uint64), most.column("n").to_numpy()
    order = np.argsort(common)
    return common[order], counts[order]


def named(docs: DataFrame, *columns: str) -> DataFrame:
    """columns, text, and what names a document (doc_id, text) when it is read again: row (64 bits) and mark (32 more)."""
    return docs.select(*columns, text_or_empty().alias("text"), *names_of("doc_id", "text"))


def names_of(doc_id: str, text: str) -> list:
    parts = [F.coalesce(F.col(text), F.lit("")), F.col(doc_id), F.col(doc_id).isNull()]
    return [F.xxhash64(*parts).alias("row"), F.hash(*reversed(parts)).alias("mark")]


def signatures(docs: DataFrame, similarity: float, width: int = SHINGLE) -> DataFrame:
    """row, mark, doc_id, fp, and of the five-word shingles: a hash of the set (key), its bit map whole and short, its size n and the first of it that sharing() needs."""
    listed = docs.sparkSession.sparkContext.broadcast(common_shingles(docs))

    def hashed(batches):
        common, counts = listed.value
        for batch in batches:
            for part, texts in small_batches(batch):
                sets = [shingle_set(t) for t in texts]
                sizes = np.array([len(h) for h in sets], np.int32)
                some = np.where(sizes > 0, sizes - np.ceil(sizes * similarity - 1e-9).astype(np.int32) + 1, 0)
                first = np.concatenate([rarest_first(h, common, counts)[:k] for h, k in zip(sets, some.tolist())]).view(np.int64)
                ends = np.concatenate([[0], np.cumsum(some)]).astype(np.int32)
                columns = [*(part.column(c) for c in ("row", "mark", "doc_id")), pa.array([fingerprint(t, width) for t in texts], pa.int64()), _keys(sets), pa.array([parities(h) for h in sets], pa.binary()), pa.array([parities(h, SHORT_BITS) for h in sets], pa.binary()), pa.array(sizes), pa.ListArray.from_arrays(ends, pa.array(first))]
                yield pa.RecordBatch.from_arrays(columns, ["row", "mark", "doc_id", "fp", "key", "bits", "short", "n", "first"])

    schema = "row long, mark int, doc_id long, fp long, key long, bits binary, short binary, n int, first array<long>"
    return named(docs, "doc_id").select("row", "mark", "doc_id", "text").mapInArrow(hashed, schema)


def _keys(sets: list[np.ndarray]) -> pa.Array:
    import xxhash

    return pa.array(np.array([xxhash.xxh3_64_intdigest(h.tobytes(), SEED) for h in sets], np.uint64).view(np.int64))


def _sets(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """key, grams (the whole set) of the documents that rows (row, mark) names, each key once."""

    def hashed(batches):
        for batch in batches:
            for _, texts in small_batches(batch):
                sets = [shingle_set(t) for t in texts]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([_keys(sets), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))], ["key", "grams"])

    texts = narrowed(named(docs), rows.select("row", "mark"), ["row", "mark"]).select("text")
    return texts.mapInArrow(hashed, "key long, grams array<long>").dropDuplicates(["key"])


def narrowed(left: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """left join small, a stored table where on is unique; broadcast up to a bound."""
    return left.join(F.broadcast(small) if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else small, on, how)


class Forest:
    """Classes of rows, merged as links come in; each row points towards its class's root."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, rows: np.ndarray) -> np.ndarray:
        out = self.parent[rows]
        while True:
            above = self.parent[out]
            if np.array_equal(above, out):
                return out
            out = self.parent[above]

    def settle(self) -> np.ndarray:
        """Point each row at its root."""
        self.parent = self.roots(np.arange(len(self.parent)))
        return self.parent

    def merge(self, row: int, others: np.ndarray) -> None:
        roots = np.unique(self.roots(np.append(others, row)))
        self.parent[roots[1:]] = roots[0]


def linked(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two blocks, or within one where right is None."""
    points = left if right is None else np.concatenate([left, right])
    columns, shift = (left, 0) if right is None else (right, len(left))
    forest = Forest(len(points))
    for at in range(0, len(left), _STEP):
        some = left[at : at + _STEP]
        for begin in range(0, len(columns), _WIDTH):
            near = np.bitwise_count(some[:, None] ^ columns[None, begin : begin + _WIDTH]) <= radius
            for i in np.flatnonzero(near.any(axis=1)):
                forest.merge(at + int(i), np.flatnonzero(near[i]) + begin + shift)
        forest.settle()
    label = forest.settle()
    moved = np.flatnonzero(label != np.arange(len(points)))
    return points[moved], points[label[moved]]


def _closest(row: int, others: list[int], classes: list[int], sizes: np.ndarray, bits: list[bytes], similarity: float) -> list[int]:
    """The closest to row of the first LOOKED_AT of each class of others that may be similar."""
    best: dict[int, tuple[float, int]] = {}
    looked: dict[int, int] = {}
    for j, c in zip(others, classes):
        if looked.get(c, 0) < LOOKED_AT and (more := spare(bits[row], int(sizes[row]), bits[j], int(sizes[j]), similarity)) >= -1e-6:
            looked[c] = looked.get(c, 0) + 1
            best[c] = max(best.get(c, (more, j)), (more, j), key=lambda x: x[0])
    return [j for _, j in best.values()]


def alike(fps: np.ndarray, sizes: np.ndarray, bits: list[bytes], split: int | None, radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (row numbers) between rows that are within radius and whose sets may be similar, unless earlier ones tie both ends.

    fps[:split] and fps[split:] are the blocks. Unlike those of linked(), the links are pairs that were compared. A row has one
    link to each class of others, so that two blocks of a group of n near copies give n links, not a quarter of n squared.
    """
    forest, us, vs = Forest(len(fps)), [], []
    ends, shift = (len(fps), 0) if split is None else (split, split)
    columns = fps[shift:]
    for at in range(0, ends, _STEP):
        some = fps[at : min(at + _STEP, ends)]
        for begin in range(0, len(columns), _WIDTH):
            near = np.bitwise_count(some[:, None] ^ columns[None, begin : begin + _WIDTH]) <= radius
            for i in np.flatnonzero(near.any(axis=1)):
                row = at + int(i)
                others = np.flatnonzero(near[i]) + begin + shift
                others = others[forest.roots(others) != forest.roots(np.array([row]))[0]]
                n = sizes[row]
                others = others[np.minimum(sizes[others], n) >= similarity * np.maximum(sizes[others], n) - 1e-6]
                good = _closest(row, others.tolist(), forest.roots(others).tolist(), sizes, bits, similarity)
                if good:
                    forest.merge(row, np.array(good))
                    us += [row] * len(good)
                    vs += good
        forest.settle()
    return np.array(us, np.int64), np.array(vs, np.int64)


def _block_pairs(distinct: DataFrame, radius: int, block: int | None) -> DataFrame | None:
    """Rows of distinct with one, two (block codes of a pair to compare) and side (0, 1, or 2 within a block)."""
    spark = distinct.sparkSession
    block = block or min(MOST_BLOCK, max(BLOCK, distinct.count() // _BLOCKS))
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    # wide radii leave few tiles of half counts apart: there tiles are whole counts
    halves = radius < 6
    upper = F.bit_count(F.shiftrightunsigned("fp", 32))
    tiled = distinct.withColumns({"a": upper if halves else F.bit_count("fp"), "b": F.bit_count(low) if halves else F.lit(0)})
    # 33 x 33 tiles at most, whatever the input
    tiles = [(r.a, r.b, -(-r.n // block)) for r in tiled.groupBy("a", "b").agg(F.count("*").alias("n")).collect()]
    if not tiles:
        return None
    pairs = [(a, b, n, [(c, d, m) for c, d, m in tiles if abs(a - c) + abs(b - d) <= radius]) for a, b, n in tiles]
    table = spark.createDataFrame(pairs, "a int, b int, blocks int, near array<struct<c:int,d:int,blocks:int>>")
    mine = F.pmod(F.xxhash64("key" if "key" in distinct.columns else "fp"), F.col("blocks")).cast("int")
    code = lambda a, b, n: (F.col(a) * 128 + F.col(b)).cast("long") * (1 << 20) + n
    names = distinct.columns
    rows = tiled.join(F.broadcast(table), ["a", "b"]).select(F.struct(*names).alias("_row"), code("a", "b", mine).alias("me"), F.explode("near").alias("to"))
    rows = rows.select("_row", "me", "to", F.explode(F.sequence(F.lit(0), F.col("to.blocks") - 1)).alias("block"))
    rows = rows.select("_row.*", "me", code("to.c", "to.d", F.col("block")).alias("it"))
    side = F.when(F.col("me") == F.col("it"), 2).when(F.col("me") < F.col("it"), 0).otherwise(1)
    return rows.select(*names, F.least("me", "it").alias("one"), F.greatest("me", "it").alias("two"), side.alias("side"))


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    side = table.column("side").to_numpy()
    return side, table.column("fp").to_numpy().view(np.uint64), bool((side == 2).any())


def links(distinct: DataFrame, radius: int = RADIUS, block: int | None = None) -> DataFrame:
    """Edges (u, v) that connect the distinct fingerprints (a stored table, column fp) within radius."""
    pairs = _block_pairs(distinct.select("fp"), radius, block)
    if pairs is None:
        return distinct.sparkSession.createDataFrame([], "u long, v long")

    def compare(table: pa.Table) -> pa.Table:
        side, fps, inner = _sides(table)
        u, v = linked(fps, None, radius) if inner else linked(fps[side == 0], fps[side == 1], radius)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    return pairs.groupBy("one", "two").applyInArrow(compare, "u long, v long")


def with_neighbours(distinct: DataFrame, radius: int, block: int | None = None) -> DataFrame:
    """The fingerprints (a stored table) that have another one within radius."""
    pairs = _block_pairs(distinct.select("fp"), radius, block)
    if pairs is None:
        return distinct.select("fp")

    def flag(table: pa.Table) -> pa.Table:
        side, fps, inner = _sides(table)
        left, right = (fps, fps) if inner else (fps[side == 0], fps[side == 1])
        some_left, some_right = np.zeros(len(left), bool), np.zeros(len(right), bool)
        for at in range(0, len(left), _STEP):
            for begin in range(0, len(right), _WIDTH):
                near = np.bitwise_count(left[at : at + _STEP, None] ^ right[None, begin : begin + _WIDTH]) <= radius
                if inner:
                    same = np.arange(max(at, begin), min(at + len(near), begin + near.shape[1]))
                    near[same - at, same - begin] = False
                some_left[at : at + _STEP] |= near.any(axis=1)
                some_right[begin : begin + _WIDTH] |= near.any(axis=0)
        return pa.table({"fp": np.concatenate([left[some_left], right[some_right]]).view(np.int64)})

    return pairs.groupBy("one", "two").applyInArrow(flag, "fp long").distinct()


def likely_links(signed: DataFrame, distinct: DataFrame, similarity: float, radius: int = WIDE_RADIUS, block: int | None = None) -> DataFrame:
    """Pairs (u, v) of keys of distinct (a stored table) whose fingerprints are within radius and whose sets may have the similarity."""
    by_fp = materialize(distinct.groupBy("fp").agg((F.count("*") > 1).alias("several")), "by_fp")
    flagged = materialize(with_neighbours(by_fp, radius, block).union(by_fp.where("several").select("fp")).distinct(), "neighbours")
    near = materialize(narrowed(distinct, flagged, ["fp"]).select("fp", "key", "n", "bits"), "near")
    pairs = _block_pairs(near, radius, block)
    if pairs is None:
        return distinct.sparkSession.createDataFrame([], "u long, v long")

    def compare(table: pa.Table) -> pa.Table:
        side, fps, inner = _sides(table)
        order = np.argsort(side, kind="stable")
        bits, keys = table.column("bits").to_pylist(), table.column("key").to_numpy()[order]
        u, v = alike(fps[order], table.column("n").to_numpy()[order], [bits[i] for i in order], None if inner else int((side == 0).sum()), radius, similarity)
        return pa.table({"u": keys[u], "v": keys[v]})

    found = pairs.groupBy("one", "two").applyInArrow(compare, "u long, v long")
    found = materialize(found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "likely")
    discard(by_fp, flagged, near)
    return found


def shared(signed: DataFrame) -> DataFrame:
    """(token, key, at: its place in the set) of the shingles among the first of several sets: two sets of n and m members with the similarity s have
    ceil(s * n) in common at least, so that one of the first n - ceil(s * n) + 1 of either is shared.

    Of shingles that the very same sets have among their first, the one that comes first in the order stands for all.
    """
    heads = signed.select("key", F.posexplode("first").alias("at", "token"))
    several = materialize(heads.groupBy("token").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select("token"), "several")
    every = materialize(heads.join(several, "token").distinct(), "every")
    groups = every.groupBy("token").agg(F.min("at").alias("at"), F.count("*").alias("sets"), *(F.bit_xor(F.xxhash64("key", F.lit(i))).alias(f"names_{i}") for i in (0, 1)))
    leading = groups.groupBy("sets", "names_0", "names_1").agg(F.min(F.struct("at", "token")).alias("first")).select("first.token")
    out = materialize(every.join(leading, "token"), "shared")
    discard(several, every)
    return out


def _meetings(similarity: float, sparing: bool):
    """Pairs of sets of different classes that may be similar, of rows in the order of their token, pair of blocks and key."""

    def group(rows: list[tuple]) -> set[tuple[int, int]]:
        key, label, n, side, at = (np.array([r[i] for r in rows]) for i in (3, 4, 5, 7, 8))
        after = n - at - 1
        bits = [r[6] for r in rows]
        names, label = np.unique(label, return_inverse=True)
        forest, out = Forest(len(names)), set()
        both = set(side.tolist()) == {0, 1}
        left = np.flatnonzero(side == 0) if both else np.arange(len(rows))
        right = np.flatnonzero(side == 1) if both else np.arange(len(rows))
        for begin in range(0, len(left), _STEP):
            i = left[begin : begin + _STEP]
            fit = (label[i][:, None] != label[right][None, :]) & (np.minimum(n[i][:, None], n[right][None, :]) >= similarity * np.maximum(n[i][:, None], n[right][None, :]) - 1e-6)
            # at the first shingle that two sets share, no more can be shared than what comes after it
            fit &= 1 + np.minimum(after[i][:, None], after[right][None, :]) >= (n[i][:, None] + n[right][None, :]) * (similarity / (1 + similarity)) - 1e-6
            if not both:
                fit &= key[i][:, None] < key[right][None, :]
            for a, b in zip(*(x.tolist() for x in np.nonzero(fit))):
                a, b = int(i[a]), int(right[b])
                if sparing and len(set(forest.roots(label[[a, b]]).tolist())) == 1:
                    continue
                if may_be_similar(bits[a], int(n[a]), bits[b], int(n[b]), similarity):
                    out.add((min(int(key[a]), int(key[b])), max(int(key[a]), int(key[b]))))
                    if sparing:
                        forest.merge(int(label[a]), label[[b]])
        return out

    def meet(batches):
        held: list[tuple] = []
        for batch in batches:
            found: set[tuple[int, int]] = set()
            for row in zip(*(batch.column(c).to_pylist() for c in ("token", "one", "two", "key", "class", "n", "short", "side", "at"))):
                if held and row[:3] != held[0][:3]:
                    found |= group(held)
                    held = []
                held.append(row)
            yield _pairs(found)
        if held:
            yield _pairs(group(held))

    return meet


def _pairs(found: set[tuple[int, int]]) -> pa.RecordBatch:
    u, v = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def sharing(tokens: DataFrame, distinct: DataFrame, classes: DataFrame, similarity: float, sparing: bool, block: int = TOKEN_BLOCK) -> DataFrame:
    """Pairs (u, v) of keys in different classes (id, component) that may have the similarity, by what shared() gave.

    None that has it is left out, or, with sparing, only those that others tie
    up. Tokens of very many sets are cut into blocks, which meet in pairs.
    """
    of_key = distinct.select("key", "n", "short").join(classes.withColumnRenamed("id", "key"), "key", "left").withColumn("class", F.coalesce("component", "key")).drop("component")
    rows = materialize(tokens.join(of_key, "key"), "rows")
    across = rows.groupBy("token").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("sets")).where("low < high")
    across = materialize(across.select("token", F.ceil(F.col("sets") / block).cast("int").alias("blocks")), "across")
    live = rows.join(across, "token").withColumn("mine", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
    live = live.withColumn("it", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("mine") <= F.col("it"), 0).otherwise(1)
    live = live.select("token", F.least("mine", "it").alias("one"), F.greatest("mine", "it").alias("two"), "key", "class", "n", "short", side.alias("side"), "at")
    # in the order of keys, so that groups of the same sets give the same forest
    met = live.repartition("token", "one", "two").sortWithinPartitions("token", "one", "two", "key").mapInArrow(_meetings(similarity, sparing), "u long, v long")
    met = materialize(met.distinct(), "met")
    found = materialize(_still_similar(met, distinct, similarity), "sharing")
    discard(rows, across, met)
    return found


def _still_similar(pairs: DataFrame, distinct: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v; each once) that may be similar by the whole bit maps."""

    def judge(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("u", "v", "bits_u", "n_u", "bits_v", "n_v")]
            yield _pairs({(u, v) for u, v, *maps in zip(*columns) if may_be_similar(*maps, similarity)})

    of = lambda k: distinct.select(F.col("key").alias(k), F.col("bits").alias(f"bits_{k}"), F.col("n").alias(f"n_{k}"))
    return pairs.join(of("u"), "u").join(of("v"), "v").mapInArrow(judge, "u long, v long")


def exactly(pairs: DataFrame, docs: DataFrame, distinct: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v; a stored table) of keys whose sets have the similarity."""
    keys = pairs.select(F.col("u").alias("key")).union(pairs.select(F.col("v").alias("key"))).distinct()
    rows = materialize(distinct.select("row", "mark", "key").join(keys, "key").select("row", "mark"), "rows")
    sets = materialize(_sets(docs, rows), "sets")
    one, two = (sets.select(F.col("key").alias(k), F.col("grams").alias(f"grams_{k}")) for k in "uv")
    found = pairs.join(one, "u").join(two, "v").withColumn("both", F.size(F.array_intersect("grams_u", "grams_v")))
    found = materialize(found.where(F.col("both") / (F.size("grams_u") + F.size("grams_v") - F.col("both")) >= similarity).select("u", "v"), "links")
    discard(rows, sets)
    return found


def joined(classes: DataFrame | None, pairs: DataFrame, docs: DataFrame, distinct: DataFrame, similarity: float) -> DataFrame:
    """classes (id, component) merged by those of the pairs (u < v, each once; a stored table) whose sets have the similarity."""
    merged = lambda links: connected_components(links if classes is None else classes.select(F.col("id").alias("u"), F.col("component").alias("v")).union(links))
    few = materialize(pairs.groupBy("v").agg(F.min("u").alias("u")).select("u", "v"), "few")
    if pairs.count() > MANY_PAIRS * few.count():
        classes = merged(exactly(few, docs, distinct, similarity))
        of = lambda k: classes.select(F.col("id").alias(k), F.col("component").alias(f"class_{k}"))
        rest = pairs.join(few, ["u", "v"], "left_anti").join(of("u"), "u", "left").join(of("v"), "v", "left")
        rest = materialize(rest.where(F.coalesce("class_u", "u") != F.coalesce("class_v", "v")).select("u", "v"), "rest")
        discard(pairs)
        pairs = rest
    links = exactly(pairs, docs, distinct, similarity)
    discard(pairs, few)
    return merged(links)


def similar_sets(docs: DataFrame, similarity: float, width: int = SHINGLE, radius: int = WIDE_RADIUS, block: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, sets, classes of sets) by all links of at least the similarity: tables of signatures(), of a row for each key, and (id, component)."""
    signed = materialize(signatures(docs, similarity, width), "signatures")
    first = F.min(F.struct("doc_id", "row", "mark", "fp", "n", "bits", "short")).alias("_")
    distinct = materialize(signed.groupBy("key").agg(first, F.min("doc_id").alias("doc_id")).select("key", "doc_id", "_.row", "_.mark", "_.fp", "_.n", "_.bits", "_.short"), "distinct")
    classes = joined(None, likely_links(signed, distinct, similarity, radius, block), docs, distinct, similarity)
    tokens = shared(signed)
    for sparing in (True, False):
        candidates = sharing(tokens, distinct, classes, similarity, sparing)
        if candidates.isEmpty():
            break
        classes = joined(classes, candidates, docs, distinct, similarity)
    discard(tokens)
    return signed, distinct, classes


def survivors(docs: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(names (row, mark) of the documents that are not the first of their class, names that several rows have and that are).

    The first of a class has the least doc_id, and of equal ones the least name;
    documents without an id come after all others. Rows with one name are equal
    in id and text.
    """
    signed, distinct, classes = similar_sets(docs, similarity)
    root = distinct.select("key").join(classes.withColumnRenamed("id", "key"), "key", "left").select("key", F.coalesce("component", "key").alias("root"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "mark")
    placed = signed.groupBy("row", "mark").agg(F.first("key").alias("key"), F.first("doc_id").alias("doc_id"), F.count("*").alias("copies")).join(root, "key").select("root", place.alias("place"), "copies")
    first = placed.groupBy("root").agg(F.min("place").alias("first"))
    judged = materialize(placed.join(first, "root").select("place.row", "place.mark", "copies", F.col("place").eqNullSafe(F.col("first")).alias("leads")), "judged")
    out = materialize(judged.where("not leads").select("row", "mark"), "removed"), materialize(judged.where("leads and copies > 1").select("row", "mark"), "repeated")
    discard(signed, distinct, judged)
    return out


def _classes(marked: DataFrame, distinct: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """doc_id, fp and the least doc_id of its class for each row of marked; key names the column of distinct that roots have as id."""
    rooted = distinct.select(key, "doc_id").join(roots.withColumnRenamed("id", key), key, "left").select(key, "doc_id", F.coalesce("component", key).alias("root"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classes = materialize(rooted.join(least, "root").select(key, "component_id"), "classes")
    return marked.select("doc_id", "fp", *({key} - {"fp"})).join(classes, key).select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS, block: int | None = None, similarity: float | None = None) -> DataFrame:
    """doc_id, fingerprint, component_id of each document; with a similarity, links are verified."""
    if similarity is not None:
        signed, distinct, roots = similar_sets(docs, similarity, width, max(radius, WIDE_RADIUS), block)
        found = _classes(signed, distinct, roots, "key")
    else:
        marked = materialize(fingerprints(docs, width), "fingerprints")
        distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "distinct")
        found = _classes(marked, distinct, connected_components(materialize(links(distinct, radius, block), "links")), "fp")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
