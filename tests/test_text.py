import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkloom.functions import arrow_text, numeric
from inkloom.functions import text as T
from inkloom.operators.quantiles import quantile_edges


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "function,value,expected",
    [
        (T.remove_templates, "a{{b{{c}}d}}e{{{f}}}g}}", "ae}g}}"),
        (T.remove_templates, "x{{y", "x"),
        (T.remove_tables, "a{|b{|c|}d|}e", "ae"),
        (T.remove_tags_except_ref, 'a<I x="1">q</i>b<ref>k</ref><br/>', "ab<ref>k</ref>"),
        (T.remove_tags_except_ref, "a<references/>b<br>", "ab<br>"),
        (T.without_refs, 'A.<ref name="x"/> B.<ref>c</ref> D.', "A. D."),
        (T.citation_count, '<ref name="a/b">x</ref><ref name="c">y</ref>', 1),
        (T.citation_count, "<ref name=a>x</ref><ref name=a/><ref>z</ref>", 2),
        (T.citation_count, None, 0),
        (T.reference_tag_count, "<ref name=a>x</ref><REF/><refs>", 2),
        (T.remove_comments, "a<!-- b\nc -->d<!-- e", "ad<!-- e"),
        (T.link_text, "[[a|b| c ]] [[d]] [x]", "c d [x]"),
        (T.heading, " === A b === rest", "A b"),
        (T.heading, "== A ===", "A"),
        (T.heading, "none", None),
        (T.after_heading, "== A == rest ", "rest"),
        (T.parsed_label, "Nhãn: 1.", 1),
        (T.parsed_label, "y kien", 0),
        (T.parsed_label, "a factual claim", 1),
        (T.parsed_label, "?", None),
        (T.parsed_label, "it is 10", None),
        (T.parsed_label, None, None),
        (T.normalized_label, " Yes ", "1"),
        (T.normalized_label, "2.0", "2"),
        (T.normalized_label, "Odd", "odd"),
        (lambda c: T.safe_model_name(c, "prompting"), "..a/b c..", "a_b_c"),
        (lambda c: T.safe_model_name(c, "prompting"), "", "model"),
        (lambda c: T.truncated(c, 8), "abcd efgh", "abcd..."),
        (lambda c: T.truncated(c, 9), "abcd efgh", "abcd efgh"),
        (arrow_text.without_files, "a[[File:x|[[y]] z]]b[[c]]", "ab[[c]]"),
        (arrow_text.without_files, "a[[File:x", "a"),
        (arrow_text.nfc, "e" + chr(769), chr(233)),
        (arrow_text.normalized_text, "'''A''' [[b|c]]{{d}} <ref>e</ref>[http://x.y f]\n== G ==", "A c f G"),
    ],
)
def test_values(spark, function, value, expected):
    assert one(spark, function, value) == expected


def test_ref_positions(spark):
    assert one(spark, T.ref_positions, "A<ref>x</ref>bc<ref>y</ref>") == [1, 3]
    assert one(spark, T.ref_positions, "none") == []


def test_words_of_any_script(spark):
    assert one(spark, T.word_tokens, "Tiếng Việt_1 x-y") == ["tiếng", "việt_1", "x", "y"]
    assert one(spark, T.word_count, " a b\tc ") == 3


def test_numeric_citations(spark):
    rows = spark.createDataFrame([("A", ". [1][2] B"), ("A [3]", ""), ("A", " B [1]"), ("A", "[1]")], "s string, r string")
    got = [r.y for r in rows.select(T.has_numeric_citation(F.col("s"), F.col("r")).alias("y")).collect()]
    assert got == [True, True, False, True]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="ab{}|[]", max_size=30), min_size=1, max_size=20))
def test_bracket_removal_agrees_with_a_character_loop(spark, texts):
    def loop(text, a, b):
        out, depth, i = [], 0, 0
        while i < len(text):
            if text.startswith(a, i):
                depth, i = depth + 1, i + 2
            elif depth and text.startswith(b, i):
                depth, i = depth - 1, i + 2
            else:
                out += [] if depth else [text[i]]
                i += 1
        return "".join(out)

    rows = spark.createDataFrame([(t,) for t in texts], "x string").select("x", T.remove_templates("x").alias("a"), T.remove_tables("x").alias("b")).collect()
    for r in rows:
        assert r.a == loop(r.x, "{{", "}}") == arrow_text.outside(r.x, "{{", "}}")
        assert r.b == loop(r.x, "{|", "|}") == arrow_text.outside(r.x, "{|", "|}")


def test_model_text_keeps_letters_numbers_and_basic_punctuation(spark):
    assert one(spark, lambda c: T.model_text(arrow_text.nfkc(c)), "ａ% (b)​ć $5") == "a (b) ć 5"


def test_whitespace_class_is_the_unicode_one(spark):
    every = [chr(c) for c in range(0x3001) if re.fullmatch(r"\s", chr(c))]
    assert one(spark, T.collapse_whitespace, "a" + "".join(every) + "b" + every[-1]) == "a b"


@pytest.mark.parametrize("scheme,expected", [("S1", 2.718281828459045 ** (-10 / 7)), ("S2", 0.25), ("S3", 1 / (1 + (10 / 7) ** 2))])
def test_decay(spark, scheme, expected):
    assert one(spark, lambda c: numeric.decay(c, scheme), 10, "int") == pytest.approx(expected)


def test_decay_rejects_unknown_schemes(spark):
    with pytest.raises(ValueError):
        numeric.decay(F.lit(1), "S9")


def test_quantile_edges_and_bins(spark):
    rows = spark.createDataFrame([(float(x),) for x in (1, 2, 10)] + [(float("nan"),), (float("inf"),), (None,)], "x double")
    edges = lambda frame, bins: quantile_edges(frame, "x", bins).first().edges
    assert edges(rows, 2) == [1, 2, 10]
    bins = rows.select("x", numeric.digitize(F.col("x"), F.array(*map(F.lit, edges(rows, 2)))).alias("b")).collect()
    assert [r.b for r in bins] == [0, 1, 1, None, None, None]
    assert edges(rows.where("x = 2"), 5) == [1, 3]
    assert edges(rows.where("x is null"), 5) == [0, 1]
    assert one(spark, lambda c: numeric.noisy_or(c), [0.5, 0.5], "array<double>") == 0.75


def test_shots():
    assert T.shots("shot_3") == 3
    with pytest.raises(ValueError):
        T.shots("zero")


def test_first_present_key(spark):
    got = one(spark, lambda c: T.first_present(c, ["text", "sentence"]), '{"sentence": "b", "text": null}')
    assert got is None
    assert one(spark, lambda c: T.first_present(c, ["text", "sentence"]), '{"sentence": "b"}') == "b"
