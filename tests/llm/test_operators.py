"""Each operator on small tables: contract against brute force, and the defined edge cases."""

import hashlib
import math
import os
import struct
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from fixtures import DOCUMENTS, LONG, empty, odd_documents
from tokenizers import Tokenizer

from inkloom.llm import common, encoding, langid, lpf_dedup, media, mixing, multi_index, packing, simhash, token_store, toxicity

SF = "/root/testdata/sf0.001"
def written(rows, path, name="documents"):
    rows.write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(encoding.default_tokenizer())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def little(ids):
    return np.array(ids, "<u4").tobytes()


def test_encoder_equals_the_library(tokenizer):
    texts = ["", " ", "  a  b \n\n c", "it's don't 12³ ¼x <|endoftext|> hi", "日本語 テスト x", "\x1c a\x85b", "a'S ÀÉ — …", "   ", LONG, "I'll 've don 't", "x" * 5000]
    sizes, ids = encoding.encoder(encoding.default_tokenizer(), 7).encode(texts)
    assert [p.tolist() for p in np.split(ids, np.cumsum(sizes)[:-1])] == [[*ids_of(tokenizer, t), 7] for t in texts]


def test_encoder_keeps_what_it_learned_of_half_a_million_words(tokenizer):
    fresh = encoding.Encoder(encoding.default_tokenizer(), 0)
    words = [f" {i:x}" for i in range(500_000)]
    fresh.words.numbers(words)
    assert fresh.words.unknown() == words
    fresh.words.learn(np.ones(len(words), np.int64), np.zeros(len(words), np.int32))
    fresh.encode(["a b"])
    assert len(fresh.words.place) > len(words)


def test_op1_round_trip(spark, tmp_path, tokenizer):
    docs = odd_documents(spark)
    got = [tuple(r) for r in token_store.op1_token_orc(spark, written(docs, tmp_path)).collect()]
    start, want = 0, []
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")):
        ids = [*ids_of(tokenizer, r.text), 0]
        want.append((r.doc_id, start, len(ids), zlib.crc32(little(ids))))
        start += len(ids)
    assert sorted(got, key=lambda r: (r[1], r[2])) == want


def test_op1_files_have_blooms_and_prune(spark, tmp_path, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    token_store.write_token_shards(docs, f"file://{tmp_path}/t")
    found = token_store.read_token_shards(spark, f"file://{tmp_path}/t", [3, 150])
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().toString()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: r.tokens for r in found.collect()} == {i: [*ids_of(tokenizer, text[i]), 0] for i in (3, 150)}
    raw = b"".join(p.read_bytes() for p in (tmp_path / "t").glob("*.orc"))
    assert raw.count(b"ORC") and len(raw) < 2 * sum(len(t) for t in text.values())
    assert token_store.token_digests(token_store.read_token_shards(spark, f"file://{tmp_path}/t")).count() == docs.count()


def plain_mix(rows):
    """Targets by repeated capping."""
    size = Counter()
    for r in rows:
        size[r.source] += len([w for w in (r.text or "").replace("\x0b", " ").replace("\x0c", " ").split() if w])
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(size.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * size[s]]
        if not over:
            return size, target | share
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
            open_.discard(s)
    return size, target


@pytest.mark.parametrize("which", ["odd", "sf"])
def test_op2_budgets(spark, tmp_path, which):
    docs = odd_documents(spark) if which == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    d = written(docs, tmp_path)
    rows = docs.collect()
    size, target = plain_mix(rows)
    got = mixing.op2_source_mixing(spark, d).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r["size"], r.taken) for r in got) == Counter((r.doc_id, r["size"], r.taken) for r in mixing.op2_source_mixing(spark, d).collect())
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    by_target = Counter()
    for r in got:
        by_target[round(r.target, 6), r.source_size] += r.taken
    want = Counter()
    for s in size:
        want[round(target[s], 6), size[s]] += round(target[s])
    assert {k for k in by_target} == {k for k in want}
    assert all(abs(by_target[k] - want[k]) <= len(size) for k in want)


def test_op2_documents_of_the_mix(spark):
    docs = odd_documents(spark)
    taken = mixing.mixture(docs).agg(F.sum("taken")).first()[0]
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.agg(F.sum(mixing.words())).first()[0] == taken
    assert mixing.mixed_documents(empty(spark)).count() == 0 and mixing.mixture(empty(spark)).count() == 0


def test_op4_pieces_and_sequences(spark, tmp_path, tokenizer):
    docs = odd_documents(spark).unionByName(spark.read.parquet(f"{SF}/documents.parquet"), allowMissingColumns=True)
    got = packing.op4_best_fit_packing(spark, written(docs, tmp_path)).collect()
    want = Counter()
    total = 0
    for r in docs.collect():
        ids = [*ids_of(tokenizer, r.text), 2]
        total += len(ids)
        head = len(ids) % 1024 or 1024
        bounds = [0, *range(head, len(ids) + 1, 1024)]
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            want[r.doc_id, i, a, b - a, zlib.crc32(little(ids[a:b]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(places) <= math.ceil(total / 1024) + 2


def test_op4_exchange_runs_on_small_tables_and_closes_the_gap(spark):
    pieces = common.materialize(packing.document_pieces(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")), "t")
    lengths = np.array([r.length for r in pieces.where("length < 1024").collect()])
    count = lambda **o: packing.pack(pieces.where("length < 1024"), **o).select("sequence_id").distinct().count()
    least, one, more = packing.lower_bound(lengths), count(group_pieces=200, rounds=0), count(group_pieces=200)
    assert least <= more < one and more <= least + 3


def test_op4_exchange_lowers_the_count_and_bounds_hold(spark):
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 1024, 4000)
    pieces = common.materialize(spark.createDataFrame([(i, 0, 0, int(n), 0) for i, n in enumerate(lengths)], packing.PIECES), "t")
    one = packing.pack(pieces, group_pieces=200, rounds=0).select("sequence_id").distinct().count()
    more = packing.pack(pieces, group_pieces=200).select("sequence_id").distinct().count()
    assert packing.lower_bound(lengths) <= more < one
    for n in (1, 5, 40):
        some = rng.integers(1, 1025, n)
        for pack in (packing.best_fit_decreasing, packing.exact_fill):
            bins, offsets = pack(some)
            assert packing.lower_bound(some) <= bins.max() + 1
            for b in range(bins.max() + 1):
                mine = np.argsort(offsets[bins == b])
                ends = np.cumsum(some[bins == b][mine])
                assert ends[-1] <= 1024 and offsets[bins == b][mine].tolist() == [0, *ends[:-1].tolist()]
    assert packing.lower_bound(np.array([600] * 5)) == 5
    assert packing.pack_documents(empty(spark)).count() == 0


def test_op5_media(spark, tmp_path):
    docs = odd_documents(spark)
    got = media.op5_iso_media(spark, written(docs, tmp_path)).collect()
    want, stored = Counter(), {}
    for r in docs.collect():
        data = (r.text or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        whole = media.write_media(payload)
        want[r.doc_id, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(whole), hashlib.sha256(whole).hexdigest()] += 1
        stored[hashlib.sha256(whole).hexdigest()] = len(payload) // 64
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in got) == want
    features = {}
    for r in got:
        frames, keys = stored[r.media_sha256], -(-stored[r.media_sha256] // 32)
        assert r.feature.startswith(f"raw:vide:64x1:{frames}/25:{frames}:{keys}:") and (r.codec, r.n_keyframes) == ("raw ", keys)
        assert features.setdefault(r.payload_sha256, r.feature) == r.feature


def track(*, mdhd, sizes, chunks, runs, keys=None, handler=b"vide", wide=False):
    """A track box from plain lists; sizes one by one, chunk offsets in 32 or 64 bits."""
    offsets = media.full_box(b"co64", struct.pack(">I", len(chunks)), *(struct.pack(">Q", c) for c in chunks)) if wide else media.full_box(b"stco", struct.pack(">I", len(chunks)), *(struct.pack(">I", c) for c in chunks))
    parts = [
        media.full_box(b"stsd", struct.pack(">I", 1), media.box(b"abcd", bytes(24), struct.pack(">HH", 64, 1), bytes(20))),
        media.full_box(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r, 1) for r in runs)),
        media.full_box(b"stsz", struct.pack(">II", 0, len(sizes)), *(struct.pack(">I", n) for n in sizes)),
        offsets,
    ]
    if keys is not None:
        parts.append(media.full_box(b"stss", struct.pack(">I", len(keys)), *(struct.pack(">I", k) for k in keys)))
    return media.box(b"trak", media.box(b"mdia", mdhd, media.full_box(b"hdlr", bytes(4), handler, bytes(12)), media.box(b"minf", media.box(b"stbl", *parts))))


def test_op5_other_layouts():
    samples = [b"a" * 5, b"b" * 70, b"c", b"dd" * 40, b"e" * 9]
    body = b"..".join([b"".join(samples[:2]), b"".join(samples[2:4]), samples[4]])
    long_header = media.full_box(b"mdhd", b"", struct.pack(">QQIQHH", 0, 0, 600, 1 << 33, 0, 0))
    long_header = long_header[:8] + b"\x01" + long_header[9:]  # version 1
    short_header = media.full_box(b"mdhd", struct.pack(">IIIIHH", 0, 0, 25, 4, 0, 0))
    for wide in (False, True):
        head = struct.pack(">I4sQ", 1, b"mdat", 16 + len(body)) if wide else struct.pack(">I4s", 8 + len(body), b"mdat")
        before = media.box(b"free", b"12") + head
        at = [len(before), len(before) + 77, len(before) + 77 + 83]
        tracks = [track(mdhd=long_header, sizes=list(map(len, samples)), chunks=at, runs=[(1, 2), (3, 1)], keys=[1, 4], wide=wide), track(mdhd=short_header, sizes=[1], chunks=[0], runs=[(1, 1)], handler=b"soun")]
        moov = media.box(b"moov", *tracks)
        data = before + body + (struct.pack(">I4s", 0, b"moov") + moov[8:] if wide else moov)  # the last box open-ended
        m = media.read_media(data)
        assert [data[a : a + n] for a, n in zip(m.offsets.tolist(), m.sizes.tolist())] == samples
        assert (m.codec, m.handler, m.timescale, m.duration, m.width) == ("abcd", "vide", 600, 1 << 33, 64)
        assert [data[a : a + n] for a, n in m.keyframe_ranges()] == [samples[0], samples[3]]
        assert media.describe_file(data)[-1] is None


def test_op5_malformed_files_are_reported():
    payload, _ = media.payload_of("some text " * 30)
    good = media.write_media(payload)
    nested = b""
    for _ in range(3000):
        nested = media.box(b"moov", nested)
    bad = [nested, media.box(b"moov", track(mdhd=media.box(b"mdhd"), sizes=[1], chunks=[0], runs=[(1, 1)])), media.box(b"moov", media.box(b"trak", media.box(b"mdia", media.box(b"mdhd"))))]
    for data in bad:
        assert media.describe_file(data)[5] == "invalid" and media.describe_file(data)[-1]
    rng = np.random.default_rng(4)
    for _ in range(5000):  # whatever the bytes are, there is a description
        data = bytearray(good[: int(rng.integers(0, len(good)))] if rng.random() < 0.3 else good)
        for _ in range(int(rng.integers(1, 6))):
            if data:
                data[int(rng.integers(0, min(len(data), 700)))] = int(rng.integers(0, 256))
        assert len(media.describe_file(bytes(data))) == 10


def test_op5_walker_reads_other_layouts():
    payload, _ = media.payload_of("x" * 100_000)
    data = media.write_media(payload)
    m = media.read_media(data)
    assert b"".join(data[a:b] for a, b in m.runs()) == payload
    assert m.duration == len(payload) // 64 and m.timescale == 25 and m.width == 64
    assert [s for _, s in m.keyframe_ranges()] == [64] * -(-(len(payload) // 64) // 32)
    # a 64-bit box size and an unknown box do not disturb the walk
    mdat = data.index(b"mdat")
    wide = media.box(b"free", b"12") + data[: mdat - 4]
    assert media.describe_file(wide)[-1]  # offsets point past the end
    for bad in (b"", b"abc", b"\0\0\0\x08moov", data[:60], data[: mdat - 40]):
        assert media.describe_file(bad)[5] == "invalid" and media.describe_file(bad)[-1]


def test_op6_languages(spark, tmp_path):
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("doc_id", F.col("doc_id") + 100)
    docs = odd_documents(spark).unionByName(base, allowMissingColumns=True)
    got = langid.op6_language_bitmasks(spark, written(docs, tmp_path)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    truth = {r.doc_id: r.lang for r in base.collect()}
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in got if r.doc_id is not None)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]) > 0.97
    assert {r.lang_pred for r in got if r.doc_id in (1, 2)} == {"und"}
    nothing = langid.identified(docs, langid.fit(empty(spark)), ["doc_id"]).select("lang_pred").distinct().collect()
    assert [r.lang_pred for r in nothing] == ["und"]
    assert langid.identified(empty(spark), langid.fit(docs), ["doc_id"]).count() == 0


def test_op6_more_languages_than_a_mask_has_bits():
    names = [f"l{i:03d}" for i in range(70)]
    rng = np.random.default_rng(0)
    words = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrst"), 5)) for _ in range(40)) for _ in names]
    parts = [langid.grams([w])[0] for w in words]
    model = langid.Filter.build(names, np.repeat(np.arange(70), [len(p) for p in parts]), np.concatenate(parts))
    assert model.predict(words)[0] == names
    assert (model.chance < 0.01).all()


def planted_vectors(spark, dim=16):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((150, dim))
    near = np.concatenate([base[:20] + 0.05 * rng.standard_normal((20, dim)), base[0] + 0.08 * rng.standard_normal((60, dim)), base[1:2].repeat(5, 0) * 3])
    rows = [(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(np.concatenate([base, near]))]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * dim, 0), (n + 2, [float("nan")] * dim, 0), (n + 3, [1.0, None] + [0.0] * (dim - 2), 0), (n + 4, [], 0), (n + 5, [1.0, 2.0], 0), (n + 6, [float("inf")] + [1.0] * (dim - 1), 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), rows


def test_op7_links(spark, tmp_path):
    frame, rows = planted_vectors(spark)
    got = {r.vec_id: r for r in multi_index.op7_inverted_multi_index(spark, written(frame, tmp_path, "embeddings")).collect()}
    good = [(i, np.array(v, float)) for i, v, _ in rows if v and len(v) == 16 and None not in v and np.isfinite(v).all() and np.any(v)]
    x = np.stack([v / np.linalg.norm(v) for _, v in good])
    link = (x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    roots = brute.components(len(x), np.argwhere(link))
    assert sum(got[i].n_links for i, _ in good) == link.sum()
    assert [got[i].component_id for i, _ in good] == [good[r][0] for r in roots]
    for i, v, _ in rows[-7:]:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert multi_index.near_vectors(frame.limit(0)).count() == 0


def test_op7_traversal_is_the_multi_sequence_order():
    rng = np.random.default_rng(4)
    sample = multi_index.unit(rng.standard_normal((400, 12)))
    grid = multi_index.Grid(sample, 9, 0.95)
    one, two = grid.distances(sample[:50])
    sums = (one[:, :, None] + two[:, None, :]).reshape(50, -1)
    for visits in (1, 7, 81, 200):
        cells = grid.traverse(sample[:50], visits)
        for row, cost in zip(cells, sums):
            known = row[row >= 0]
            assert len(known) == min(visits, 81) == len(set(known.tolist()))
            np.testing.assert_allclose(cost[known], np.sort(cost)[: len(known)])


def test_op7_recall_where_visits_are_few(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((6000, 16))
    near = base[rng.integers(0, 6000, 3000)] + 0.06 * rng.standard_normal((3000, 16))
    vectors = np.concatenate([base, near]).astype(np.float32)
    x = multi_index.unit(vectors)
    link = x @ x.T >= 0.95
    np.fill_diagonal(link, False)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "gid long, embedding array<float>").withColumn("weight", F.lit(1).cast("long"))
    indexed = common.materialize(multi_index.index(common.materialize(frame, "v")), "i")
    visits = indexed.agg(F.avg(F.size("visits"))).first()[0]
    assert visits < 0.5 * multi_index.codewords_for(9000) ** 2
    found = multi_index.met(indexed).where("gid is not null").agg(F.sum("n")).first()[0]
    assert 0.9 * link.sum() <= found <= link.sum() and link.sum() > 3000


def test_op7_small_blocks_give_equal_counts(spark):
    frame, _ = planted_vectors(spark)
    distinct = multi_index._clean(frame).where(F.size("embedding") == 16).select(F.col("vec_id").alias("gid"), F.lit(1).cast("long").alias("weight"), "embedding")
    indexed = common.materialize(multi_index.index(common.materialize(distinct, "v")), "i")
    counts = [{r.gid: r.n for r in multi_index.met(indexed, block=b).where("gid is not null").groupBy("gid").agg(F.sum("n").alias("n")).collect()} for b in (7, 2048)]
    assert counts[0] == counts[1] and counts[0]


def test_op8_toxicity(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").where("doc_id < 6000")
    odd = odd_documents(spark).select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").unionByName(spark.createDataFrame([(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int"))
    d = written(docs.unionByName(odd), tmp_path)
    written(labels, tmp_path, "labels")
    got = {r.doc_id: r for r in toxicity.op8_toxicity_cnn(spark, d).collect()}
    truth = {r.doc_id: r.toxic for r in labels.where("doc_id < 6000 and toxic is not null").collect()}
    held = [(truth[i], got[i].predicted) for i in truth if got[i].held_out]
    recall = np.mean([p for y, p in held if y == 1])
    precise = np.mean([y for y, p in held if p == 1])
    assert recall > 0.7 and precise > 0.7
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    assert toxicity.scored(docs.limit(3), None).agg(F.max("score")).first()[0] == 0


def plain_score(model, text):
    """The network's output for a text, word by word."""
    words = [w.strip(toxicity._STRIP) or w for w in (text or "").lower().split()]
    x = []
    for w in words:
        one, two = zlib.crc32(w.encode()), zlib.crc32(w.encode(), 0x5BD1E995)
        two = (two * 0x9E3779B1 ^ one * 0x85EBCA77) >> 11
        x.append([float(model.embedding[one % toxicity.BUCKETS][d]) + float(model.embedding[two % toxicity.BUCKETS][d]) for d in range(toxicity.DIM)])
    x += [[0.0] * toxicity.DIM] * 3
    total, k = model.bias, 0
    for f, b in zip(model.filters, model.offsets):
        for n in range(toxicity.FILTERS):
            best = max(float(b[n]) + sum(x[i + j][d] * float(f[j, d, n]) for j in range(len(f)) for d in range(toxicity.DIM)) for i in range(len(words) + 1))
            total += max(best, 0.0) * float(model.weight[k])
            k += 1
    return 1 / (1 + math.exp(-total))


def test_op8_forward_pass_against_plain_loops(monkeypatch):
    rng = np.random.default_rng(3)
    model = toxicity.Classifier.initial(rng.uniform(0, 4, toxicity.BUCKETS).astype(np.float32))
    model.filters = [rng.normal(0, 0.5, f.shape).astype(np.float32) for f in model.filters]
    texts = ["You, bad thing!", "", "one", None, "Two words", "the quick brown fox jumps over " * 4, "one", "ÉTÉ — x"]
    words = toxicity.Words()
    numbers, begins = words.numbers([t or "" for t in texts])
    want = [plain_score(model, t) for t in texts]
    for places in (1 << 20, 2, 5):  # whole, and in parts
        monkeypatch.setattr(toxicity, "_PLACES", places)
        np.testing.assert_allclose(model.probability(words.buckets[numbers], begins), want, rtol=1e-4)


def test_op6_filter_against_plain_sets(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").collect()

    def grams(text):
        plain = "   " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + "   "
        return [g for g in (plain[i : i + 4] for i in range(len(plain) - 3)) if any(c.isalpha() for c in g)]

    counts = {}
    for r in rows:
        if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            counts.setdefault(r.lang, Counter()).update(grams(r.text))
    known = {lang: {g for g, n in c.items() if n >= max(2, 1e-5 * sum(c.values()))} for lang, c in counts.items()}
    docs = spark.createDataFrame(rows)
    got = {r.doc_id: r for r in langid.identified(docs, langid.fit(docs), ["doc_id"]).collect()}
    decided = 0
    for r in rows:
        mine = grams(r.text)
        if not mine:
            assert got[r.doc_id].lang_pred == "und"
            continue
        share = {lang: sum(g in s for g in mine) / len(mine) for lang, s in known.items()}
        best, second = sorted(share.values(), reverse=True)[:2]
        assert abs(got[r.doc_id].known - best) < 0.02
        if best - second > 0.02:  # what the filter's false positives cannot turn
            assert share[got[r.doc_id].lang_pred] == best
            decided += 1
    assert decided > 0.95 * len(rows)


def test_op9_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(5)
    text = lambda n: "".join(rng.choice(list("ab é,\n"), n))
    passage, other = text(260), text(420)
    rows = [(i, text(150) + passage + text(100)) for i in range(6)]
    rows += [(10, passage[:199]), (11, passage[:200]), (12, None), (13, ""), (14, other + other[:210]), (15, "abc" * 120), (16, "z" * 700), (17, other[5:]), (18, text(300)), (18, text(300)), (19, rows[0][1]), (None, passage + "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("k", "th", "label", "start")})
    got = sorted((tuple(r) for r in lpf_dedup.op9_repeated_strings(spark, written(docs, tmp_path)).collect()), key=str)
    assert got == sorted(brute.repeated(rows), key=str)
    assert lpf_dedup.remove_repeats(empty(spark)).count() == 0


@pytest.mark.parametrize("rows", [512, 1])
@pytest.mark.parametrize("keep_first", [False, True])
def test_op9_modes_and_common_labels(spark, monkeypatch, rows, keep_first):
    monkeypatch.setattr(lpf_dedup, "LABEL_ROWS", rows)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = sorted(tuple(r)[:5] for r in lpf_dedup.remove_repeats(docs, keep_first).collect())
    assert got == sorted(brute.repeated([(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()], keep_first=keep_first))


def test_op9_longest_factors():
    rng = np.random.default_rng(1)
    for text in (b"abcabxabcab", b"a" * 40, bytes(rng.integers(97, 99, 300, dtype=np.uint8)), b"abracadabra" * 9, b"x"):
        for starts in (np.arange(len(text)), np.arange(0, len(text), 3)):
            previous, following = lpf_dedup.longest_factors(np.frombuffer(text, np.uint8), starts, 28)
            common = lambda i, j: len(os.path.commonprefix([text[i : i + 28], text[j : j + 28]]))
            for at, (i, p, n) in enumerate(zip(starts, previous, following)):
                for got, others in ((p, starts[:at]), (n, starts[at + 1 :])):
                    want = max((common(i, j) for j in others), default=0)
                    # below the depth lengths are whole sevens
                    assert got == want - want % 7, (text, i)


def test_op9_previous_smaller():
    rng = np.random.default_rng(2)
    for values in (rng.permutation(200), np.arange(50), np.arange(50)[::-1], np.array([], np.int64)):
        want = [max((j for j in range(i) if values[j] < values[i]), default=-1) for i in range(len(values))]
        assert lpf_dedup.previous_smaller(values).tolist() == want


def test_op9_rows_without_an_id(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(6)
    text = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    passage = text(400)
    rows = [(None if i % 3 else -1, text(int(rng.integers(0, 300))) + (passage if i % 2 else "")) for i in range(60)]
    rows += [(None, rows[1][1]), (-1, rows[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keys = lpf_dedup.keyed(docs).select("k", "th").distinct().count()
    assert keys == len(set(rows))
    got = sorted((tuple(r) for r in lpf_dedup.op9_repeated_strings(spark, written(docs, tmp_path)).collect()), key=str)
    assert got == sorted(brute.repeated(rows), key=str)


def test_op10_against_brute_force(spark, tmp_path):
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in base] + [(1000, None), (1001, ""), (1002, "one"), (1003, "ONE"), (1004, "one two"), (1005, "Ünder ÜBER x y"), (1006, base[0].text), (1006, base[0].text), (1007, base[0].text + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("x"))
    got = sorted((tuple(r) for r in simhash.op10_simhash_tiles(spark, written(docs, tmp_path)).collect()))
    assert got == sorted(brute.simhash_components(rows))
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_op10_small_blocks_give_equal_components(spark):
    rng = np.random.default_rng(8)
    fps = rng.integers(0, 1 << 63, 300, dtype=np.int64)
    for i in range(150, 300):
        fps[i] = fps[i - 150] ^ np.int64(1 << int(rng.integers(0, 60))) ^ np.int64(1 << int(rng.integers(0, 60)))
    distinct = common.materialize(spark.createDataFrame([(int(f),) for f in set(fps.tolist())], "fp long"), "d")
    found = [sorted(map(tuple, common.connected_components(simhash.links(distinct, block=b)).collect())) for b in (5, 8192)]
    assert found[0] == found[1] and len(found[0]) > 250


def test_connected_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 160)]
    edges = spark.createDataFrame([*path, *star, (5, 5), (1, 0)], "u long, v long")
    got = dict(map(tuple, common.connected_components(edges).collect()))
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)}
    assert common.connected_components(edges.limit(0)).count() == 0


def test_checked_join_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 2)
    left = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    small = spark.range(3).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    got = common.checked_join(left, small, ["k"])
    assert got.count() == 100 and got.where("v <> k * 10").count() == 0
