import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkloom.operators import curate, evaluate, history, probreview, scoring, selection, sentences
from inkloom.plans import pipelines


def revisions(spark, rows):
    return spark.createDataFrame([(1, i, 100 + i, f"t{i:03d}", u, b) for i, (u, b) in enumerate(rows)], "page_id int, ordinal int, revision_id int, timestamp string, username string, is_bot boolean")


@pytest.mark.parametrize(
    "rows,kept",
    [
        ([("a", False), ("a", False), ("b", False), (None, False), (None, None), ("a", False)], [101, 102, 104, 105]),
        ([("a", False), ("x", True), ("a", False)], [102]),
        ([("x", True)], []),
    ],
)
def test_run_collapse(spark, rows, kept):
    out = history.collapse_runs(revisions(spark, rows)).orderBy("ordinal").collect()
    assert [r.revision_id for r in out] == kept
    names = [r.username for r in out]
    assert all(a != b for a, b in zip(names, names[1:]))


def test_latest_breaks_ties_by_id_or_by_order(spark):
    rows = spark.createDataFrame([(1, 0, 2, "t", "x"), (1, 1, 1, "t", "y")], "page_id int, ordinal int, revision_id int, timestamp string, username string")
    assert history.latest_by_id(rows, "revision_id").first().revision_id == 2
    nested = history.nested_pages(rows)
    assert history.latest_in_order(nested).first().latest.revision_id == 1


def test_contributors(spark):
    rows = spark.createDataFrame([(1, ("a", 5, None)), (2, (None, None, "1.2.3.4")), (3, (None, None, None)), (4, None)], "id int, contributor struct<username:string,id:long,ip:string>")
    got = {r.id: (r.user_id, r.username, r.is_anonymous) for r in history.with_contributor(rows).collect()}
    assert got == {1: (5, "a", False), 2: (None, "1.2.3.4", True), 3: (None, None, True), 4: (None, None, False)}


def test_bots_by_list_and_marks(spark):
    bots = spark.createDataFrame([("Exact ",)], "value string")
    rows = spark.createDataFrame([("Exact", None), ("exact", None), ("MyBOT", None), ("x", "via Script"), (None, None)], "username string, comment string")
    got = {(r.username, r.comment): r.is_bot for r in history.with_bots(rows, bots).collect()}
    assert got == {("Exact", None): True, ("exact", None): False, ("MyBOT", None): True, ("x", "via Script"): True, (None, None): False}


def plain_page_score(revisions, scheme="S2", alpha=7.0, max_iter=100, tol=1e-6):
    """A restatement token by token, with dictionaries and dense matrices."""
    config = probreview.Config(scheme, alpha, max_iter, tol)
    tokens, state = [], []
    for user, current in revisions:
        ops = SequenceMatcher(a=tokens, b=current, autojunk=False).get_opcodes()
        places = [j for t, _, _, j1, j2 in ops if t != "equal" for j in (range(j1, j2) if j2 > j1 else [j1])]
        after = []
        for t, i1, i2, j1, j2 in ops:
            if t == "equal":
                for k in range(i2 - i1):
                    author, seen = state[i1 + k]
                    if places:
                        d = min(abs(j1 + k - p) for p in places)
                        p = float(probreview.decayed(np.array([float(d)]), config)[0])
                        seen = {**seen, user: 1 - (1 - seen.get(user, 0)) * (1 - p)}
                    after.append((author, seen))
            else:
                after += [(user, {}) for _ in range(j1, j2)]
        tokens, state = current, after
    if not state:
        return None
    users = sorted({a for a, _ in state} | {u for _, s in state for u in s})
    f = np.zeros((len(state), len(users)))
    for i, (a, seen) in enumerate(state):
        f[i, users.index(a)] += 1
        for u, p in seen.items():
            f[i, users.index(u)] += p
    a, q = np.ones(len(users)) / len(users), np.ones(len(state)) / len(state)
    steps = 0
    for steps in range(1, max_iter + 1):
        q2 = f @ a
        q2 /= q2.sum()
        a2 = f.T @ q2
        a2 /= a2.sum()
        close = abs(q2 - q).sum() < tol and abs(a2 - a).sum() < tol
        q, a = q2, a2
        if close:
            break
    return len(state), len(users), steps, float((f @ a).sum()), dict(zip(users, a))


@pytest.mark.parametrize("scheme", ["S1", "S2", "S3"])
def test_page_scores_agree_with_a_plain_restatement(scheme):
    rng = random.Random(scheme)
    for _ in range(25):
        words, pages = [], []
        for _ in range(rng.randrange(1, 7)):
            words = [w for w in words if rng.random() > 0.15]
            for _ in range(rng.randrange(4)):
                words.insert(rng.randrange(len(words) + 1), rng.choice("abcdefgh"))
            pages.append((rng.choice("uvw"), list(words)))
        config = probreview.Config(scheme)
        got, want = probreview.score_page(pages, config), plain_page_score(pages, scheme)
        if want is None:
            assert got is None
            continue
        assert (got[0], got[1], got[2]) == want[:3]
        assert got[4] == pytest.approx(want[3], abs=1e-9)
        assert got[5] == pytest.approx(want[4], abs=1e-9)
        assert sum(got[5].values()) == pytest.approx(1)


def test_one_author_page():
    assert probreview.score_page([("u", list("abcde"))])[4] == pytest.approx(5)
    assert probreview.score_page([]) is None
    assert probreview.score_page([("u", ["a"]), ("v", [])]) is None


def articles(spark, rows):
    return spark.createDataFrame(rows, "page_id string, quality_score double, citation_count int")


def test_ties_enlarge_the_pool(spark):
    rows = articles(spark, [("10", 5.0, 1), ("9", 5.0, 1), ("a", 5.0, 9), ("1", 6.0, 0), ("2", 1.0, 99)])
    assert [r.page_id for r in selection.by_quality_then_citations(rows, 2).orderBy("rank").collect()] == ["a", "9"]
    assert [r.page_id for r in selection.by_quality_then_citations(rows, 99).orderBy("rank").collect()] == ["2", "a", "9", "10", "1"]


def test_constant_citations_give_equal_selections(spark):
    rows = articles(spark, [(str(i), float(i % 17), 0) for i in range(60)])
    out = selection.overlap(selection.by_quality_then_citations(rows, 20), selection.by_weighted_z(rows, 20), 20).first()
    assert out.overlap == 20 and out.overlap_ratio == 1


def test_cutoff_counts_surround_the_rank(spark):
    rows = articles(spark, [(str(i), float(i // 7), 0) for i in range(100)])
    r = selection.cutoff_diagnostics(rows, 0.1).first()
    assert r.above < r.top_n <= r.at_or_above


def test_raw_text_is_the_first(spark):
    texts = spark.createDataFrame([("1", 5, "late"), ("1", 2, "first"), ("7", 0, "other")], "page_id string, ordinal int, raw_text string")
    chosen = spark.createDataFrame([("1",), ("2",)], "page_id string")
    assert {r.page_id: r.raw_text for r in selection.with_raw_text(chosen, texts).collect()} == {"1": "first", "2": ""}


@pytest.mark.parametrize("flags,labels", [("FFTFT", "001-1"), ("FF", "00"), ("TF", "1-"), ("FT", "01")])
def test_prefix_labels(spark, flags, labels):
    rows = spark.createDataFrame([("p", 0, i, f"s{i}", f == "T") for i, f in enumerate(flags)], "page_id string, paragraph_id int, index int, text string, has_citation boolean")
    got = {r['index']: r.label for r in sentences.prefix_labels(rows).collect()}
    assert "".join(str(got.get(i, "-")) for i in range(len(flags))) == labels
    nested = sentences.nested_sentences(rows.groupBy("page_id", "paragraph_id").agg(F.array_sort(F.collect_list(F.struct("index", "text", "has_citation"))).alias("sentences")))
    flat = sorted((r.text, r.label) for r in sentences.nested_prefix_labels(nested).collect())
    assert flat == sorted((f"s{i}", v) for i, v in got.items())


def test_paragraphs_and_sentences_of_a_page(spark):
    long = "This is a sentence that is quite long indeed. "
    raw = f"{{{{box|{{{{x}}}}}}}}intro {long.strip()}<ref>a</ref> Another one follows here without source.\n\n== Head ==\n* list item that is very long and would be a paragraph otherwise\n\n{long}It has '''bold''' and [[link|text]]. [3]\n\nshort\n\n[[Thể loại:Khoa học]] {long}"
    pages = spark.createDataFrame([("1", raw), ("2", "  "), ("3", None)], "page_id string, raw_text string")
    found = sentences.page_paragraphs(pages).orderBy("paragraph_id").collect()
    assert [(r.paragraph_id, r.header) for r in found] == [(0, None), (1, "Head")]
    assert found[1].text_raw.endswith("It has bold and text. [3]")
    flags = {(r.paragraph_id, s['index']): s.has_citation for r in sentences.page_sentences(sentences.page_paragraphs(pages)).collect() for s in r.sentences}
    assert flags[0, 0] and not flags[0, 1] and not flags[1, 0] and flags[1, 1]


def test_first_of_pairs_keeps_null_labels_and_drops_null_texts(spark):
    rows = spark.createDataFrame([("a", 1, 3), ("a", 1, 1), ("a", 0, 2), ("a", None, 4), ("a", None, 5), (None, 1, 6)], "text string, label int, ordinal int")
    assert sorted(r.ordinal for r in curate.first_of_pairs(rows).collect()) == [1, 2, 4, 5]


def test_filters_add_up(spark):
    rng = random.Random(1)
    rows = [("w " * rng.randrange(1, 60), rng.choice([1.0, 5.0, 20.0, 1e6, float("inf"), float("nan"), -1.0, None, rng.random() * 50])) for _ in range(500)]
    frame = spark.createDataFrame(rows, "text string, perplexity_score double")
    kept, lengths = curate.by_length_percentiles(frame)
    r = lengths.first()
    assert r.kept + r.too_short + r.too_long == 500 and r.kept == kept.count()
    final, report = curate.by_perplexity_cutoff(kept)
    p = report.first()
    assert p.kept + p.removed_above + p.removed_invalid == r.kept and p.kept == final.count()
    assert p.cutoff == min(p.p90, p.upper_fence)


def test_split_is_a_partition_near_its_shares(spark):
    rows = spark.range(1003).select("id", (F.col("id") % 2).alias("label"), (F.col("id") % 7).alias("len_bin"), (F.col("id") % 5).alias("ppl_bin"))
    sizes = {r.split: r["count"] for r in curate.stratified_split(rows, F.col("id"), curate.stratum()).groupBy("split").count().collect()}
    assert sum(sizes.values()) == 1003
    assert abs(sizes["train"] - 802.4) <= 1 and abs(sizes["val"] - 100.3) <= 1 and abs(sizes["test"] - 100.3) <= 1.5


def test_macro_f1_takes_present_classes_alone(spark):
    rows = spark.createDataFrame([(1, 1), (1, 1)], "label int, pred_label int")
    r = evaluate.metrics_of(rows).first()
    assert r.macro_f1 == 1 and r.f1_neg == 0 and r.support_neg == 0
    mixed = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 1), (0, 0)], "label int, pred_label int")
    m = evaluate.metrics_of(mixed).first()
    assert m.accuracy == pytest.approx(0.6) and m.precision == 0.5 and m.macro_f1 == pytest.approx((0.5 + 2 / 3) / 2)


def test_no_valid_prediction_gives_nulls(spark):
    rows = spark.createDataFrame([(1, None), (0, 7)], "label int, pred_label int")
    r = evaluate.metrics_with_coverage(rows).first()
    assert r.valid_coverage == 0 and r.accuracy is None and r.f1 is None


def test_empty_bins_survive(spark):
    rows = spark.createDataFrame([(0, 0, float(i)) for i in range(10)], "label int, pred_label int, v double")
    edges = spark.createDataFrame([(float(i),) for i in range(0, 41, 10)], "v double")
    out = evaluate.metrics_by_bin(rows, "v", 4, edges).orderBy("bin").collect()
    assert [r.support_total for r in out] == [10, 0, 0, 0] and out[1].accuracy is None


def test_scores_survive_memory_errors_and_bad_numbers(spark):
    def factory():
        def score(texts):
            if len(texts) > 2:
                raise MemoryError
            return [float("nan") if not t else float(len(t)) for t in texts]

        return score

    rows = spark.createDataFrame([("abc",), ("",), (None,), ("a",)], "text string")
    got = [r.perplexity_score for r in scoring.with_scores(rows, factory).collect()]
    assert got == [3.0, float("inf"), float("inf"), 1.0]


def test_failed_batches_become_error_rows(spark):
    def factory():
        def ask(prompts):
            if any("bad" in p for p in prompts):
                raise RuntimeError("down")
            return [{"text": p.upper(), "prompt_tokens": 1, "completion_tokens": 2} for p in prompts]

        return ask

    rows = spark.createDataFrame([("a",), ("bad",)], "prompt string").coalesce(1)
    got = {r.prompt: (r.raw_response, r.error) for r in scoring.with_answers(rows, factory, batch=1, retries=2, wait_s=0.01).collect()}
    assert got == {"a": ("A", None), "bad": (None, "down")}


def test_pipeline_from_texts_to_split(spark):
    body = "Alpha beta gamma delta epsilon zeta eta theta. Iota kappa lambda mu nu xi omicron.<ref>x</ref> Pi rho sigma tau upsilon phi chi psi."
    pages = spark.createDataFrame([(str(i), body.replace("Alpha", f"Alpha{i}")) for i in range(30)], "page_id string, raw_text string")
    examples = pipelines.labelled_sentences(pages).withColumn("key", F.monotonically_increasing_id())
    assert examples.count() == 31 and {r.label for r in examples.collect()} == {0, 1}
    final, _, _ = pipelines.filtered_examples(scoring.unigram_perplexity(examples, "key"))
    assert pipelines.split_examples(final, 3).count() == final.count()
