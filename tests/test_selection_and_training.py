"""Order statistics, the selection report, model inputs and training, exports, limits and tolerant ingestion."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkloom.operators import curate, history, quantiles, scoring, selection
from inkloom.sources import readers, writers
from inkloom.streaming.ingest import ingest, ingested


def plain(values, shares):
    return [float(np.quantile(values, s)) for s in shares]


@pytest.mark.parametrize("values", [[5.0], [1.0, 2.0, 10.0], [3.0] * 700, np.random.default_rng(1).normal(size=3000).tolist(), [float(i % 7) for i in range(2000)], [-0.0, 0.0, 1e300, -1e300]])
def test_quantiles_are_exact(spark, values):
    shares = [0, 0.05, 0.25, 0.5, 0.9, 0.99, 1]
    rows = spark.createDataFrame([(x,) for x in values] + [(None,)], "x double")
    assert quantiles.quantiles(rows, F.col("x"), shares).first().q == pytest.approx(plain(values, shares), rel=1e-12)


def test_quantiles_by_group(spark):
    rng = np.random.default_rng(2)
    data = {"a": rng.integers(0, 50, 900).astype(float), None: rng.normal(size=40), "hot": np.full(1500, 2.5)}
    rows = spark.createDataFrame([(k, float(x)) for k, xs in data.items() for x in xs] + [("none", None)], "k string, x double")
    got = {r.k: r.q for r in quantiles.quantiles(rows, F.col("x"), [0.1, 0.5], ("k",)).collect()}
    assert {k: pytest.approx(plain(x, [0.1, 0.5])) for k, x in data.items()} == got
    assert quantiles.quantiles(rows.where("x is null"), F.col("x"), [0.5]).first().q is None
    stats = {r.k: r for r in curate.described(rows, "x", "k").collect()}
    assert stats["none"].n == 0 and stats["none"].p95 is None and stats["hot"].p95 == 2.5


def test_split_by_hash_thresholds_has_the_quotas(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") < 900, "hot").when(F.col("id") < 999, "b").otherwise("single").alias("s"))
    split = curate.stratified_split(rows, F.col("id"), F.col("s"))
    counts = {(r.s, r.split): r["count"] for r in split.groupBy("s", "split").count().collect()}
    assert counts["single", "train"] == 1 and sum(n for (_, p), n in counts.items() if p == "val") in (99, 100, 101)
    assert counts["hot", "train"] in (719, 720, 721) and sum(counts.values()) == 1000


def test_selection_report(spark):
    rows = spark.createDataFrame([(str(i), float(i % 5), i % 3) for i in range(20)], "page_id string, quality_score double, citation_count long")
    texts = spark.createDataFrame([("4", 1, "x")], "page_id string, ordinal long, raw_text string")
    one = selection.with_raw_text(selection.by_quality_then_citations(rows, 6), texts)
    two = selection.with_raw_text(selection.by_weighted_z(rows, 6), texts)
    stats = selection.selection_report(rows, one, two, 6).first().asDict()
    pool = [r for r in rows.collect() if r.quality_score >= 3]
    cutoff = min(r.citation_count for r in one.collect())
    assert stats["m1_quality_pool_size"] == len(pool) == 8
    assert stats["m1_citation_ties_at_cutoff_in_pool"] == sum(r.citation_count == cutoff for r in pool)
    text = selection.selection_report_text(stats, input_csv="in.csv").split("\n")
    assert text[:3] == ["Top-k article selection comparison", "input_csv: in.csv", "total_rows: 20"]
    assert "quality_pool_size: 8" in text and "quality_cutoff: 3.0000000000" in text and len(text) == 3 + 2 + 11 + 2 + 17 + 2 + 2 + 1


def test_profiles(spark):
    rows = spark.createDataFrame([(1, float("inf"), 3), (1, 2.0, 4), (0, float("nan"), 5), (0, None, 6), (0, -1.0, 7), (0, 8.0, 8)], "label int, perplexity_score double, n_words int")
    counts = curate.invalid_counts(rows, "before").first()
    assert (counts.rows_loaded, counts.missing, counts.nan, counts.inf, counts.non_positive, counts.valid) == (6, 1, 1, 1, 1, 2)
    profile = {r.metric: r for r in curate.profiled(rows, "before").collect()}
    assert profile["perplexity"].n == 2 and profile["perplexity"].p50 == 5 and profile["word_length"].p99 == pytest.approx(7.95)
    assert {(r.metric, r.label): r.cutoff for r in curate.class_cutoffs(rows, "b").collect()}["perplexity", 1] == 2


def test_model_tokens(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    library = Tokenizer(models.WordLevel({"[UNK]": 0, "a": 1, "b": 2}, unk_token="[UNK]"))
    library.pre_tokenizer = pre_tokenizers.Whitespace()
    text = library.to_str()

    def factory():
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_str(text)
        return lambda texts: [e.ids for e in loaded.encode_batch(texts)]

    rows = spark.createDataFrame([("a b c",), (None,), ("a " * 300,)], "text string")
    got = [(r.input_ids, r.attention_mask) for r in scoring.with_token_ids(rows, factory, most=4, last=9).collect()]
    assert got == [([1, 2, 0], [1] * 3), ([], []), ([1, 1, 1, 9], [1] * 4)]


def test_train_and_predict(spark):
    rows = spark.createDataFrame([("good " + "x" * i, 1) for i in range(9)] + [("bad", 0)] * 9, "text string, label int")

    def trainer(batches):
        words: dict[str, int] = {}
        for _ in range(2):  # two epochs
            for texts, labels in batches():
                for t, y in zip(texts, labels):
                    words[t.split()[0]] = y
        return lambda texts: [[1.0 - words.get(t.split()[0], 0), float(words.get(t.split()[0], 0))] for t in texts]

    model = scoring.fine_tuned(rows, trainer, batch=4)
    assert model(["good x"]) == [[0.0, 1.0]]
    got = scoring.with_predictions(rows, model).select("label", F.element_at("logits", 2).alias("p")).collect()
    assert all(r.label == r.p for r in got)


def test_benchmark_exports(spark, tmp_path):
    results = spark.createDataFrame([("org/m 1", 0.5, float("nan")), ("two", 0.7, 1.0)], "model_name string, macro_f1 double, rate double")
    writers.write_benchmark(results, results, {"seed": 42, "path": tmp_path}, str(tmp_path / "o"))
    assert {p.name for p in (tmp_path / "o/model_summaries").glob("model_file=*")} == {"model_file=org_m_1", "model_file=two"}
    first = json.loads(next((tmp_path / "o/model_summaries/model_file=org_m_1").glob("*.json")).read_text())
    assert first == {"model_name": "org/m 1", "macro_f1": 0.5}
    assert json.loads(next((tmp_path / "o/run_config").glob("*.txt")).read_text())["seed"] == 42
    assert next((tmp_path / "o/benchmark_predictions").glob("*.csv")).read_text().startswith("model_name,macro_f1")


def test_limits(spark, tmp_path):
    rows = spark.createDataFrame([(i // 2, i) for i in range(10)], "page_id long, revision_id long")
    pages = lambda *a: sorted({r.page_id for r in history.of_first_pages(rows, *a).collect()})
    assert pages(2) == [0, 1] and pages(None) == pages(0) == list(range(5)) and pages(0, "one") == [0] and pages(3, "one") == [0, 1, 2]
    with pytest.raises(ValueError):
        pages(1, "x")
    for n in "abc":
        (tmp_path / f"{n}.bz2").write_bytes(b"")
    assert [p[-5:] for p in readers.listed(spark, str(tmp_path), most=2)] == ["a.bz2", "b.bz2"] and len(readers.listed(spark, str(tmp_path), most=0)) == 3


def test_one_bad_file_costs_only_itself(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for n, line in (("a", '{"text": "a", "label": 1}'), ("b", "no json"), ("c", '{"text": "c", "label": 0}')):
        (source / f"{n}.json").write_text(line + "\n")
    run = lambda name, **o: ingest(spark, str(source), "text STRING, label INT", str(tmp_path / f"{name}out"), str(tmp_path / f"{name}check"), log=str(tmp_path / f"{name}log"), mode="FAILFAST", **o)
    assert run("t", tolerant=True) == 1 and run("t", tolerant=True) == 0
    assert sorted(r.text for r in ingested(spark, str(tmp_path / "tout")).collect()) == ["a", "c"]
    log = {r.source_file: r for r in spark.read.parquet(str(tmp_path / "tlog")).collect()}
    assert [log[f"{n}.json"].status for n in "abc"] == ["done", "failed", "done"] and log["b.json"].error and log["a.json"].rows == 1
    with pytest.raises(Exception, match="(?i)malformed|failfast|failed"):
        run("s")


def test_citation_recount(spark):
    rows = spark.createDataFrame([(1, "<ref>a</ref>"), (None, ""), (1, '<ref name="x">a</ref><ref name="x"/>')], "citation_count int, raw_text string")
    assert history.citation_recount(rows).first().asDict() == {"revisions": 3, "stored": 2, "recounted": 3, "mismatches": 1}
