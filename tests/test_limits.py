"""Operators against their limits of memory and shuffle: what a worker holds at once, and what a plan sends."""

import math
import random
import re
import tracemalloc
import unicodedata
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkloom.functions import arrow_text
from inkloom.functions import text as T
from inkloom.operators import probreview, scoring, sentences

TEXTS = ["", None, "x", "{{a}}é[[File:b]] ﬁ" * 9, "a<b>c</b>" * 400, "==\xa0H = ==\n", "===a===b==", "x\n== H ==y<!-- z -->", None, "Ω" * 5000]


def in_parts(function, values, batches=2):
    """The parts that a text function gives for batches of values; each batch is asked for when the one before is done."""
    asked = []

    def feed():
        for i in range(batches):
            asked.append(i)
            yield pa.array(values, pa.string())

    parts = []
    for part in function.func(feed()):
        parts.append(part)
        assert len(asked) == 1 or sum(map(len, parts)) > len(values)
    return parts


def evaluated(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")


@pytest.mark.parametrize("name,plain", [("strip_markup", arrow_text.stripped_markup), ("normalized_text", arrow_text.plain_text), ("without_templates", lambda t: arrow_text.outside(t, "{{", "}}")), ("nfc", lambda t: unicodedata.normalize("NFC", t)), ("nfkc", lambda t: unicodedata.normalize("NFKC", t))])
def test_texts_are_worked_off_in_parts(name, plain):
    values = [None if t is None else t * 40 for t in TEXTS] * 3
    parts = in_parts(getattr(arrow_text, name), values)
    assert pa.chunked_array(parts).to_pylist() == [None if t is None else plain(t) for t in values] * 2
    longest = max(len(t.encode()) for t in values if t)
    assert len(parts) > 2 and max(p.nbytes for p in parts) <= arrow_text.PART_BYTES + longest + 8 * len(values)


@pytest.mark.parametrize("values", [[], [None], [None, None], [""], ["ab", None, "cdefgh", "", "i"]])
def test_parts_are_all_values(values):
    array = pa.array([None, *values], pa.string())[1:]
    for most in (1, 2, 3, 100):
        parts = list(arrow_text.parts_of(array, most))
        assert [x for p in parts for x in p.to_pylist()] == values
        assert all(len(p) for p in parts) or not values


def test_page_text_is_its_steps_in_one_evaluation(spark):
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(TEXTS)], "page_id string, raw_text string")
    steps = arrow_text.without_files(T.break_sections(arrow_text.strip_markup("raw_text")))
    for r in rows.select(steps.alias("a"), arrow_text.stripped_page("raw_text").alias("b")).collect():
        assert r.a == r.b
    assert evaluated(sentences.page_paragraphs(rows)) == 1


def random_tokens(seed):
    chance = random.Random(seed)
    return lambda n: [chance.choice("abcdefghij") for _ in range(n)]


def test_pages_are_scored_without_a_batch_in_python(spark):
    token = random_tokens(3)
    pages = [("p", "t", 4, ["u", "v", "u"], [token(50), token(60), token(55)]), ("none", "", 0, [], []), ("end", "", 0, ["u", "v"], [token(5), []]), ("q", "", 1, ["w"], [token(7)]), (None, "", 2, ["x", "y"], [[], token(9)])]
    frame = spark.createDataFrame(pages, "page_id string, title string, citation_count long, names array<string>, tokens array<array<string>>").coalesce(1)
    want = {p: probreview.score_page(list(zip(u, t))) for p, _, _, u, t in pages}
    got = probreview.score_pages(frame).collect()
    assert {r.page_id for r in got} == {"p", "q", None} == {p for p, w in want.items() if w}
    for r in got:
        assert (r.n_tokens, r.n_users, r.iterations, r.converged, r.quality_score) == (*want[r.page_id][:4], round(want[r.page_id][4], 8))
        assert r.user_scores == want[r.page_id][5]
    assert {r.page_id: (r.title, r.citation_count) for r in got}["p"] == ("t", 4)


def test_a_batch_of_pages_takes_the_memory_of_a_revision():
    token = random_tokens(5)
    revision = [f"{t}{i}" for i, t in enumerate(token(300))]
    fields = {"page_id": [str(i) for i in range(400)], "title": [""] * 400, "citation_count": [0] * 400, "names": [["u"] * 10] * 400, "tokens": [[revision] * 10] * 400}
    batch = pa.RecordBatch.from_pydict(fields)
    tracemalloc.start()
    assert sum(1 for _ in probreview.page_scores(batch, probreview.Config())) == 400
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2_000_000  # its 1,200,000 tokens are over 60 MB of Python strings


def plain_perplexities(rows, counts):
    total, types = sum(counts.values()), len(counts)
    out = {}
    for key, text in rows:
        losses = [-math.log((counts.get(w, 0) + 1) / (total + types + 1)) for w in re.findall(r"\w+", (text or "").lower())]
        out[key] = math.exp(math.fsum(losses) / len(losses)) if losses else math.inf
    return out


@pytest.mark.parametrize("share", [1e-6, 0.02, 0.2, 1.1])
@pytest.mark.parametrize("given", [False, True])
def test_perplexity_is_the_same_whichever_words_are_frequent(spark, monkeypatch, share, given):
    monkeypatch.setattr(scoring, "FREQUENT", share)
    chance = random.Random(7)
    rows = [(i, " ".join(chance.choice(["the", "a", "The", f"w{chance.randrange(40)}"]) for _ in range(chance.randrange(1, 90)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " .,"), (103, "once"), (104, "once again once")]
    frame = spark.createDataFrame(rows, "key long, text string").repartition(5)
    counts = Counter(w for _, t in rows for w in re.findall(r"\w+", (t or "").lower()))
    if given:
        counts = {w: n for w, n in counts.items() if w not in ("a", "once")}
    table = spark.createDataFrame(list(counts.items()), "token string, n long") if given else None
    got = {r.key: r.perplexity_score for r in scoring.unigram_perplexity(frame, "key", table).collect()}
    assert got == pytest.approx(plain_perplexities(rows, counts), rel=1e-12)


def most_sent(plan):
    """Most rows that a shuffle of an executed plan wrote."""
    found, left = [], [plan]
    while left:
        node = left.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            left.append(node.plan())
        if name == "ShuffleExchangeExec":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        left += [children.apply(i) for i in range(children.size())]
    return max(found, default=0)


def test_perplexity_sends_no_row_for_each_frequent_word(spark):
    """400 texts of the same 300 words: a row a text is sent, not one a word of a text."""
    rows = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(300))) for i in range(400)], "id long, text string")
    frame = scoring.unigram_perplexity(rows, "id").select("id", "perplexity_score")
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    assert 0 < most_sent(plan) <= 4 * 400
