from collections import Counter

import brute
import corpus_pipeline
from fixtures import empty, odd_documents
from pyspark.sql import functions as F

from inkloom.llm import common, mixing

SF = "/root/testdata/sf0.001"


def staged(spark, docs, sf_dir):
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(common.materialize(stage(spark, out[-1], sf_dir), name))
    return out


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_stages_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs, known, distinct, clean, mixed, packed = staged(spark, docs, SF)
    assert all(s.columns == docs.columns for s in (known, distinct, clean, mixed))
    # nothing with letters in a known language is rejected
    assert known.count() == docs.where(F.col("text").rlike(r"\p{L}")).count()
    rows = sorted((r.doc_id, r.text) for r in known.collect())
    sets = [shingles(t) for _, t in rows]
    alike = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    roots = brute.components(len(rows), alike)
    kept = {r.doc_id for r in distinct.collect()}
    assert len({roots[i] for i, (d, _) in enumerate(rows) if d in kept}) == len(kept) >= len(set(roots)) - 2
    text = {r.doc_id: r.text for r in distinct.collect()}
    after = {r.doc_id: r for r in clean.collect()}
    assert set(after) == set(text)
    assert not any("@mail" in r.text for r in after.values()) and any("<email>" in r.text for r in after.values())
    assert all(r.n_chars == len(r.text) for r in after.values())
    assert mixed.agg(F.sum(mixing.words())).first()[0] == mixing.mixture(clean).agg(F.sum("taken")).first()[0]
    sizes = Counter()
    for r in packed.collect():
        sizes[r.sequence_id] += r.length
    assert max(sizes.values()) <= 1024 and sum(sizes.values()) / 1024 > len(sizes) - 3
    pieces = Counter(r.doc_id for r in packed.where("piece = 0").collect())
    assert pieces == Counter(r.doc_id for r in mixed.collect())


def test_odd_documents_pass_all_stages(spark):
    docs, known, distinct, clean, mixed, packed = staged(spark, odd_documents(spark).unionByName(spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 100), allowMissingColumns=True), SF)
    assert all(s.columns == docs.columns for s in (known, distinct, clean, mixed))
    assert known.where("doc_id in (1, 2)").count() == 0
    ids = [r.doc_id for r in distinct.where("doc_id is null or doc_id < 100").collect()]
    assert ids.count(7) <= 1 and None in ids
    assert packed.count() > 0


def test_empty_documents(spark):
    assert [s.count() for s in staged(spark, empty(spark), SF)] == [0] * 6


def test_the_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() == staged(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)[-1].count()


def test_repeated_ids_of_different_texts(spark):
    text = lambda seed: " ".join(f"w{(seed * 7919 + i * i) % 1009}" for i in range(60))
    a, b, c = text(1), text(2), text(3)
    rows = [(5, a), (5, b), (3, b), (7, c), (7, c), (None, c), (None, a + " x"), (9, None), (9, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumn("row", F.lit(1))
    kept = corpus_pipeline.deduplicate(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted([(5, a), (3, b), (7, c), (9, "")])
    # later stages keep repeated ids of different texts apart
    for stage in (corpus_pipeline.redact, corpus_pipeline.mix):
        assert {r.text for r in stage(spark, docs.where("text is not null"), SF).collect()} <= {t for _, t in rows} | {r.text for r in docs.collect()} | {None}
    packed = corpus_pipeline.pack(spark, docs, SF).where("piece = 0")
    assert Counter(r.doc_id for r in packed.collect()) == Counter(i for i, _ in rows)
