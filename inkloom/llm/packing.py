"""Best-fit packing of documents into sequences, with certified bin counts.

Each document is encoded whole and ended; only documents longer than a sequence
are cut, the first piece taking the remainder. Full pieces fill a sequence by
themselves. The others are dealt by hash to groups of about GROUP_PIECES and
packed best-fit decreasing. Dual feasible functions give a lower bound of each
group's bins: a group that meets its bound is certified and final, and so is a
full bin. Groups with a gap exchange documents: the pieces in their unfilled bins
are dealt to new groups, which are repacked best-fit decreasing, or, where that
still misses the bound, by filling bins exactly; a new packing is kept only if
it has fewer bins. Each round deals what is left to a fraction of the groups, so
that gaps meet.

Defined cases: a null text is empty and gives a piece of the end id alone;
repeated rows are packed one by one; a null doc_id stays null; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, text_or_empty
from .encoding import default_tokenizer, encoder, small_batches

CAPACITY = 1024
#: Pieces of a group, on average: one task's work, whatever the size of the input.
GROUP_PIECES = 2_000
#: Rounds of exchange; from one to the next a group's pieces may grow so many times, up to MOST_PIECES.
ROUNDS = 4
GROWTH = 3
MOST_PIECES = 50_000
_TRIED = 12  # sizes that exact filling tries as the first of three
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int = CAPACITY) -> np.ndarray:
    """Bounds of the pieces of n ids: full pieces from the end, the remainder first."""
    return np.concatenate([[0], np.arange(n % capacity or capacity, n + 1, capacity)]) if n else np.zeros(1, np.int64)


def document_pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, and the ids if asked for."""
    tokenizer = tokenizer or default_tokenizer()

    def pieces(batches):
        for batch in batches:
            for part, texts in small_batches(batch):
                rows = []
                sizes, ids = encoder(tokenizer, end_id).encode(texts)
                ends = np.cumsum(sizes)
                for doc, begin, end in zip(part.column("doc_id").to_pylist(), (ends - sizes).tolist(), ends.tolist()):
                    tokens = ids[begin:end].astype("<u4")
                    bounds = cut(len(tokens), capacity).tolist()
                    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                        rows.append((doc, i, a, b - a, zlib.crc32(tokens[a:b]), tokens[a:b].astype(np.int32) if with_ids else None))
                columns = list(zip(*rows))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                arrays = [pa.array(c, t) for c, t in zip(columns, types)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays(arrays[: 5 + with_ids], names[: 5 + with_ids])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(pieces, PIECES + (", ids array<int>" if with_ids else ""))


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece. Open bins are kept by free space, and a bit mask finds the tightest that fits."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = opened = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, opened
            opened += 1
        bins[i], offsets[i] = b, capacity - room
        left = room - size
        if left:
            free[left].append(b)
            mask |= 1 << left
    return bins, offsets


def exact_fill(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece: each bin begins with the largest piece left and is filled up exactly where one,
    two or three others can; else the largest that fits is added.

    Sizes left are a bit mask, and a mirrored one, so that two sizes with a given sum are found by a shift and an and.
    """
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    left: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in np.argsort(lengths, kind="stable").tolist():
        left[int(lengths[i])].append(i)
    sizes = sum(1 << s for s in range(1, capacity + 1) if left[s])
    mirrored = sum(1 << (capacity - s) for s in range(1, capacity + 1) if left[s])

    def enough(chosen: list[int]) -> bool:
        return all(len(left[s]) >= chosen.count(s) for s in set(chosen))

    def completed(room: int, before: list[int]) -> list[int]:
        """before and two sizes that fill the room, the larger one as large as can be; or nothing."""
        both = sizes & mirrored >> (capacity - room) & ((1 << max(room, 1)) - 2)
        while both:
            a = both.bit_length() - 1
            chosen = [*before, a, room - a]
            if enough(chosen):
                return chosen
            both ^= 1 << a
        return []

    opened = 0
    while sizes:
        room, chosen = capacity, [sizes.bit_length() - 1]
        while chosen:
            for s in chosen:
                i = left[s].pop()
                bins[i], offsets[i] = opened, capacity - room
                room -= s
                if not left[s]:
                    sizes ^= 1 << s
                    mirrored ^= 1 << (capacity - s)
            fits = sizes & ((1 << (room + 1)) - 1)
            chosen = []
            if fits:
                largest = fits.bit_length() - 1
                chosen = [room] if largest == room else completed(room, [])
                tried = 0
                while not chosen and fits.bit_length() > 1 and tried < _TRIED:
                    b = fits.bit_length() - 1
                    chosen = completed(room - b, [b])
                    fits ^= 1 << b
                    tried += 1
                chosen = chosen or [largest]
        opened += 1
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Least number of bins by dual feasible functions: the identity, the threshold
    family (small items dropped, large ones counted whole) and the rounding family."""
    if not len(lengths):
        return 0
    sizes, counts = np.unique(lengths, return_counts=True)
    best = math.ceil(int((sizes * counts).sum()) / capacity)
    for t in range(1, capacity // 2 + 1):
        image = np.where(sizes > capacity - t, capacity, np.where(sizes >= t, sizes, 0))
        best = max(best, math.ceil(int((image * counts).sum()) / capacity))
    for k in range(1, 64):
        # u_k: a size that is a multiple of 1/(k+1) keeps its share, others round down to a multiple of 1/k
        scaled = sizes * (k + 1)
        image = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)
        best = max(best, math.ceil(int((image * counts).sum()) / (capacity * k)))
    return best


STATE = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long, grp long, bin long, offset long, gap int"


def _pack_group(exact: bool):
    """Packs a group anew and keeps its old bins unless there are fewer now; exact: fill bins exactly if best fit misses the bound.

    gap is 0 where nothing is left to gain: the group meets its bound, or the
    piece's bin is full.
    """

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "uid", "doc_id", "piece", "ids_crc32"], ascending=False, kind="stable")
        lengths = pdf["length"].to_numpy()
        bins, offsets = best_fit_decreasing(lengths)
        least = lower_bound(lengths)
        if exact and bins.max() + 1 > least:
            other = exact_fill(lengths)
            if other[0].max() < bins.max():
                bins, offsets = other
        before = pdf[["old_grp", "bin"]].drop_duplicates() if (pdf["bin"] >= 0).all() else None
        count = int(bins.max()) + 1
        if before is not None and len(before) <= count:
            # the old bins stay, under numbers of this group
            bins = pd.factorize(pd.MultiIndex.from_frame(pdf[["old_grp", "bin"]]))[0].astype(np.int64)
            offsets, count = pdf["offset"].to_numpy(), len(before)
        fill = np.bincount(bins, weights=lengths, minlength=count)
        gap = np.where((count <= least) | (fill[bins] >= CAPACITY), 0, 1)
        return pdf.assign(bin=bins, offset=offsets, gap=gap)[[c.split()[0] for c in STATE.split(", ")]]

    return packed


def pack(pieces: DataFrame, group_pieces: int = GROUP_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """pieces (a stored table) with sequence_id and offset."""
    full = F.col("length") >= CAPACITY
    total = pieces.where(~full).count()
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    uid = F.xxhash64(*columns)  # deals pieces out and breaks ties; repeated rows share it
    open_ = pieces.where(~full).select(uid.alias("uid"), *columns, F.lit(0).cast("long").alias("old_grp"), F.lit(-1).cast("long").alias("bin"), F.lit(-1).cast("long").alias("offset"))
    done = []
    for r in range(rounds + 1):
        groups = max(1, round(total / min(max(MOST_PIECES, group_pieces), group_pieces * GROWTH**r)))
        # whole bins move from the second round on; each round numbers its groups apart
        deal = F.xxhash64("uid", F.monotonically_increasing_id()) if r == 0 else F.xxhash64("old_grp", "bin", F.lit(r))
        state = materialize(open_.withColumn("grp", F.pmod(deal, F.lit(groups)) + F.lit(r << 40)).groupBy("grp").applyInPandas(_pack_group(r > 0), STATE), "packing")
        left = 0 if r == rounds or (r and groups == 1) else state.where("gap = 1").count()
        if not left:
            done.append(state)
            break
        done.append(state.where("gap = 0"))
        total = left
        open_ = state.where("gap = 1").select("uid", *columns, F.col("grp").alias("old_grp"), "bin", "offset")
    out = pieces.where(full).select(*columns, (-F.monotonically_increasing_id() - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    for state in done:
        # a group has far fewer than 2^20 bins, and a round far fewer than 2^40 groups
        out = out.union(state.select(*columns, (F.col("grp") * (1 << 20) + F.col("bin")).alias("sequence_id"), "offset"))
    return out


def pack_documents(docs: DataFrame, tokenizer: str | None = None, group_pieces: int = GROUP_PIECES) -> DataFrame:
    return pack(materialize(document_pieces(docs, tokenizer), "pieces"), group_pieces)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
