"""Near duplicates at a similarity, against brute force over the five-word sets."""

import random

import brute
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from inkloom.llm import common, simhash

DOCS = "doc_id long, text string"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def classes(texts, similarity=0.8):
    sets = [shingles(t) for t in texts]
    alike = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])]
    return brute.components(len(sets), alike)


def found(spark, texts):
    out = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), DOCS), similarity=0.8)
    return [r.component_id for r in out.orderBy("doc_id").collect()]


def words(n, seed):
    rng = random.Random(seed)
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def bits(one, two):
    return ((simhash.fingerprint(one) ^ simhash.fingerprint(two)) & (2**64 - 1)).bit_count()


def test_links_beyond_the_radius(spark):
    texts = []
    for seed in range(40):  # a text and one that contains and extends it, at 0.8 exactly and at 0.85
        for more in (20, 14):
            w = words(84 + more, seed * 100 + more)
            texts += [" ".join(w[:84]), " ".join(w)]
    far = [bits(a, b) > simhash.WIDE_RADIUS for a, b in zip(texts[::2], texts[1::2])]
    line = " ".join(words(8, 5000))
    for seed in range(5):  # almost the same set, a line repeated more often
        body = " ".join(words(120, 6000 + seed))
        texts += [f"{body} {line}", f"{body} {line} " + " ".join([line] * 60)]
        far.append(bits(texts[-1], texts[-2]) > simhash.WIDE_RADIUS)
    assert sum(far) > 5 and any(far[-5:])
    want = classes(texts)
    assert want == [i - i % 2 for i in range(len(texts))]
    assert found(spark, texts) == want


def test_the_sets_decide(spark):
    texts = []
    for seed in range(60):  # at 0.80, 0.79 and 0.78 exactly
        w = words(104, 9000 + seed)
        texts += [" ".join(w[: 4 + 80 - seed % 3]), " ".join(w)]
    want = classes(texts)
    assert [a == b for a, b in zip(want[::2], want[1::2])] == [seed % 3 == 0 for seed in range(60)]
    assert found(spark, texts) == want


def test_equal_fingerprints_are_not_equal_texts(spark):
    line = " ".join([" ".join(words(9, 1))] * 80)
    texts = [f"{line} " + " ".join(words(40, 20 + seed)) for seed in range(6)] + [None, " \n", f"{line} {line}", line]
    assert len({simhash.fingerprint(t) for t in texts[:6]}) == 1
    want = classes(texts)
    assert len(set(want)) == 8
    assert found(spark, texts) == want


def test_mixed_edits_against_brute_force(spark):
    rng = random.Random(3)
    pool, texts = words(300, 4), []
    for _ in range(60):
        base = [rng.choice(pool) for _ in range(rng.randrange(3, 150))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(6)):
            copy = base[: rng.randrange(len(base) * 7 // 10, len(base)) + 1]
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = rng.choice(pool)
            texts.append(" ".join(copy + ["the same closing line everywhere"] * rng.randrange(3)))
    rng.shuffle(texts)
    want = classes(texts)
    assert len(set(want)) < len(texts) - 10
    assert found(spark, texts) == want
    # columns as for the other mode
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    assert simhash.near_duplicates(docs, similarity=0.8).schema == simhash.near_duplicates(docs).schema
    assert simhash.near_duplicates(docs.where(F.lit(False)), similarity=0.8).count() == 0


def test_short_bit_maps_are_folded_whole_ones_and_lose_no_similar_pair():
    rng = np.random.default_rng(5)
    for n in (0, 1, 5, 64, 65, 511, 512, 513, 3000, 20000):
        both = rng.integers(0, 2**64, n, np.uint64)
        whole, short = simhash.parities(both), simhash.parities(both, simhash.SHORT_BITS)
        assert len(short) == min(len(whole), simhash.SHORT_BITS // 8)
        assert simhash.folded(whole, len(short)) == int.from_bytes(short, "little")
        # n in common and n // 4 of one alone: 0.8 or a little more
        more = np.concatenate([both, rng.integers(0, 2**64, n // 4, np.uint64)])
        longer = simhash.parities(more, simhash.SHORT_BITS)
        assert simhash.may_be_similar(short, n, longer, len(more), 0.8)
        assert simhash.may_be_similar(whole, n, simhash.parities(more), len(more), 0.8)
        # long sets cannot be told apart by short maps, but by whole ones
        other = rng.integers(0, 2**64, n, np.uint64)
        if n >= 64:
            assert not simhash.may_be_similar(whole, n, simhash.parities(other), n, 0.8)
        if n >= 3000:
            assert simhash.may_be_similar(short, n, simhash.parities(other, simhash.SHORT_BITS), n, 0.8)


def test_shingles_of_the_same_sets_are_one_group_and_pairs_that_share_too_late_do_not_meet(spark):
    w, x = words(104, 700), words(104, 701)
    # two that are similar, one that shares 12 of its 100 shingles with a fourth
    docs = spark.createDataFrame(list(enumerate([" ".join(w[:94]), " ".join(w), " ".join(x), " ".join(x[:16] + words(88, 702))])), DOCS)
    signed = common.materialize(simhash.signatures(docs, 0.8), "signatures")
    tokens = simhash.shared(signed)
    key = {r.doc_id: r.key for r in signed.collect()}
    groups = {}
    for r in tokens.collect():
        groups.setdefault(r.token, []).append(r.key)
    sets = sorted(sorted(g) for g in groups.values())
    assert sets.count(sorted([key[0], key[1]])) == 1 and len(sets) == len({tuple(s) for s in sets})
    # two sets of 100 can share no more than what comes after their first shared shingle: 89 are needed
    row = lambda k, at: (1, 0, 0, k, k, 100, simhash.parities(np.zeros(0, np.uint64)), 0, at)
    names = ["token", "one", "two", "key", "class", "n", "short", "side", "at"]
    for at, met in ((11, 1), (12, 0)):
        batch = pa.RecordBatch.from_pydict(dict(zip(names, zip(row(1, 0), row(2, at)))))
        assert sum(b.num_rows for b in simhash._meetings(0.8, False)(iter([batch]))) == met


def test_members_of_a_group_are_read_in_few_pairs(spark, monkeypatch):
    base, texts = words(150, 800), []
    for i in range(30):  # each pair of them is similar
        texts.append(" ".join([*base[:-1], f"end{i}"]))
    w = words(104, 801)
    texts += [" ".join(w), " ".join(w[:70])]  # a candidate that is not
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    signed = common.materialize(simhash.signatures(docs, 0.8), "signatures")
    keys = [r.key for r in signed.orderBy("doc_id").collect()]
    pairs = [tuple(sorted((a, b))) for i, a in enumerate(keys[:30]) for b in keys[:i]] + [tuple(sorted(keys[30:]))]
    read, exactly = [], simhash.exactly
    monkeypatch.setattr(simhash, "exactly", lambda p, *more: read.append(p.count()) or exactly(p, *more))
    classes = simhash.joined(None, common.materialize(spark.createDataFrame(pairs, "u long, v long"), "pairs"), docs, signed, 0.8)
    assert {r.id: r.component for r in classes.collect()} == dict.fromkeys(keys[:30], min(keys[:30]))
    assert len(pairs) == 436 and sum(read) <= 31


def test_near_copies_in_two_blocks_are_tied_by_as_many_links_as_rows():
    rng, base = np.random.default_rng(7), np.random.default_rng(6).integers(0, 2**64, 300, np.uint64)
    sets = [np.unique(np.append(base, rng.integers(0, 2**64, 3, np.uint64))) for _ in range(120)]
    fps, sizes = np.full(120, 5, np.uint64), np.array([len(s) for s in sets])
    bits = [simhash.parities(s) for s in sets]
    for split in (60, None):
        u, v = simhash.alike(fps, sizes, bits, split, simhash.WIDE_RADIUS, 0.8)
        # one tree; all pairs of the two blocks were 3,600 links
        assert len(u) == 119 and len(set(brute.components(120, list(zip(u.tolist(), v.tolist()))))) == 1
        assert split is None or all((a < split) != (b < split) for a, b in zip(u.tolist(), v.tolist()))
