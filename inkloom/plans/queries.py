"""The query catalogue: each operator over the test tables, with SQL that gives the same rows.

Stand-ins: events are revisions (page: user_id, order: ts and event_id, user:
event_type, bots: type "error"), orders by customer are articles, documents
with labels are examples, conversations are paragraphs. No table has wiki
markup, so that markup is put around columns on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrow_text, numeric, text as T
from ..operators import curate, evaluate, history, probreview, scoring, selection, sentences
from ..operators.scalars import with_scalars

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- histories ---------------------------------------------------------------


def _revisions(spark: SparkSession, d: str) -> DataFrame:
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return table(spark, d, "events").select(
        F.col("user_id").alias("page_id"),
        F.struct("ts", "event_id").alias("ordinal"),
        F.col("event_id").alias("revision_id"),
        stamp.alias("timestamp"),
        F.col("event_type").alias("username"),
        (F.col("event_type") == "error").alias("is_bot"),
        F.floor(F.col("value")).cast("long").alias("citation_count"),
    )


@query(
    "hist_parent_revision",
    """SELECT user_id AS page_id, event_id AS revision_id, coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id), -1) AS parent_revision_id
    FROM events WHERE event_type <> 'error'""",
)
def hist_parent_revision(spark, d):
    rows = history.with_parent(history.without_bots(_revisions(spark, d)))
    return rows.select("page_id", "revision_id", F.coalesce("parent_revision_id", F.lit(-1)).alias("parent_revision_id"))


_COLLAPSED = """SELECT user_id AS page_id, event_id AS revision_id, event_type AS username FROM (
      SELECT *, lead(event_type) OVER w AS following, lead(1) OVER w AS more FROM events WHERE event_type <> 'error'
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    WHERE more IS NULL OR event_type IS DISTINCT FROM following"""


@query("hist_run_collapse", _COLLAPSED)
def hist_run_collapse(spark, d):
    return history.collapse_runs(_revisions(spark, d)).select("page_id", "revision_id", "username")


@query(
    "hist_page_nested",
    f"""SELECT page_id, count(*) AS revisions, string_agg(CAST(revision_id AS VARCHAR), ',' ORDER BY ts, revision_id) AS revision_ids,
      arg_max(revision_id, struct_pack(a := ts, b := revision_id)) AS latest
    FROM ({_COLLAPSED}) JOIN (SELECT event_id AS revision_id, ts FROM events) USING (revision_id) GROUP BY page_id""",
)
def hist_page_nested(spark, d):
    pages = history.nested_pages(history.collapse_runs(_revisions(spark, d)))
    ids = F.array_join(F.transform("revisions", lambda r: r["revision_id"].cast("string")), ",")
    return pages.select("page_id", F.size("revisions").cast("long").alias("revisions"), ids.alias("revision_ids"), F.try_element_at("revisions", F.lit(-1))["revision_id"].alias("latest"))


@query(
    "hist_latest_revision",
    """SELECT page_id, revision_id, username FROM (
      SELECT user_id AS page_id, event_id AS revision_id, event_type AS username, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
    WHERE n = 1""",
)
def hist_latest_revision(spark, d):
    return history.latest_by_id(_revisions(spark, d), "revision_id", "username")


@query("hist_first_pages", "SELECT user_id AS page_id, event_id AS revision_id FROM events WHERE user_id IN (SELECT DISTINCT user_id FROM events ORDER BY user_id LIMIT 20)")
def hist_first_pages(spark, d):
    rows = _revisions(spark, d)
    return history.of_first_pages(rows, 20).select("page_id", "revision_id")


@query("hist_bot_counts", "SELECT user_id AS page_id, count(*) AS revisions, count(*) FILTER (event_type = 'error') AS bot_revisions FROM events GROUP BY user_id")
def hist_bot_counts(spark, d):
    return history.bot_counts(_revisions(spark, d))


@query(
    "hist_bot_detection",
    """SELECT event_id, coalesce(event_type IN ('click', 'Search'), false) OR regexp_matches(lower(event_type || ' ' || coalesce(props, '')), 'bot|auto|script|crawler|spider') AS is_bot FROM events""",
)
def hist_bot_detection(spark, d):
    bots = spark.createDataFrame([(" click ",), ("Search",), ("",)], "value string")
    rows = table(spark, d, "events").select("event_id", F.col("event_type").alias("username"), F.col("props").alias("comment"))
    return history.with_bots(rows, bots).select("event_id", "is_bot")


@query(
    "hist_safe_username",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN 'user_id:' || CAST(user_id AS VARCHAR) ELSE '<unknown>' END AS username FROM events""",
)
def hist_safe_username(spark, d):
    third = F.col("event_id") % 3
    name = F.when(third == 0, F.col("event_type")).when(third == 1, "")
    return table(spark, d, "events").select("event_id", history.safe_username(name, F.when(third == 1, F.col("user_id"))).alias("username"))


_CITES = """SELECT user_id AS page_id, count(*) AS revision_count, sum(floor(value))::BIGINT AS total_citations, max(floor(value))::BIGINT AS max_citations,
      round(sum(floor(value)) / count(*), 6) AS avg_citations, count(*) FILTER (value IS NULL) AS missing_counts FROM events GROUP BY user_id"""


@query("cite_page_stats", _CITES)
def cite_page_stats(spark, d):
    return history.citation_stats(_revisions(spark, d))


@query(
    "cite_summary",
    f"""SELECT count(*) AS pages, sum(revision_count)::BIGINT AS revisions, sum(total_citations)::BIGINT AS total_citations, round(sum(total_citations) / count(*), 6) AS avg_per_page,
      round(sum(total_citations) / sum(revision_count), 6) AS avg_per_revision, count(*) FILTER (total_citations = 0) AS zero_citation_pages, sum(missing_counts)::BIGINT AS missing_counts FROM ({_CITES})""",
)
def cite_summary(spark, d):
    return history.citation_summary(history.citation_stats(_revisions(spark, d)))


@query(
    "cite_recount",
    """WITH t AS (SELECT doc_id, doc_id % 3 + 1 AS named, doc_id % 4 AS plain FROM documents)
    SELECT count(*) AS revisions, sum(named + plain)::BIGINT AS stored, sum(named * 2 + plain)::BIGINT AS recounted, count(*) AS mismatches FROM t""",
)
def cite_recount(spark, d):
    named = F.transform(F.sequence(F.lit(1), F.col("doc_id") % 3 + 1), lambda i: F.concat(F.lit('<ref name="n'), i, F.lit('">x</ref> <ref name="n'), i, F.lit('">y</ref> ')))
    raw = F.concat(F.array_join(named, ""), F.col("text"), F.repeat(F.lit("<REF>z</REF> "), (F.col("doc_id") % 4).cast("int")))
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), T.citation_count(raw).alias("citation_count"), raw.alias("raw_text"))
    return history.citation_recount(rows)


@query("cite_topk", f"SELECT page_id, total_citations, row_number() OVER (ORDER BY total_citations DESC, page_id DESC)::INTEGER AS rank FROM ({_CITES}) QUALIFY rank <= 10")
def cite_topk(spark, d):
    return history.top_pages(history.citation_stats(_revisions(spark, d)), 10).select("page_id", "total_citations", "rank")


@query(
    "cite_count",
    """WITH t AS (SELECT doc_id, doc_id % 3 + 1 AS named, doc_id % 4 AS plain FROM documents)
    SELECT doc_id, named + plain + 1 AS citations, named * 2 + plain + 1 AS tags FROM t""",
)
def cite_count(spark, d):
    named = F.transform(F.sequence(F.lit(1), F.col("doc_id") % 3 + 1), lambda i: F.concat(F.lit('<ref name="n'), i, F.lit('">x</ref> <ref name="n'), i, F.lit('">y</ref> ')))
    plain = F.repeat(F.lit("<REF>z</REF> "), (F.col("doc_id") % 4).cast("int"))
    raw = F.concat(F.array_join(named, ""), F.col("text"), plain, F.lit('<ref group="g"/>'))
    return table(spark, d, "documents").select("doc_id", T.citation_count(raw).alias("citations"), T.reference_tag_count(raw).alias("tags"))


# --- scores ------------------------------------------------------------------


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents of one source and language and hundred of ids as the revisions of a page."""
    page = F.concat_ws("-", "source", "lang", F.floor(F.col("doc_id") / 100).cast("string"))
    rows = table(spark, d, "documents").select(page.alias("page_id"), F.col("doc_id").alias("ordinal"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("timestamp"), F.concat(F.lit("u"), F.col("doc_id") % 7).alias("username"), F.col("doc_id").alias("user_id"), F.col("text").alias("clean_text"), F.lit(1).alias("citation_count"))
    return history.nested_pages(rows).withColumn("title", F.col("page_id"))


@query("probreview_articles")
def probreview_articles(spark, d):
    return probreview.article_scores(probreview.score_pages(probreview.prepared(_pages(spark, d))))


@query("probreview_authors")
def probreview_authors(spark, d):
    return probreview.author_scores(probreview.score_pages(probreview.prepared(_pages(spark, d))))


@query(
    "review_decay",
    """SELECT l_orderkey, l_linenumber, round(exp(-l_quantity / 7), 10) AS s1, round(1 / (greatest(l_quantity - 7, 0) + 1), 10) AS s2, round(1 / (1 + (l_quantity / 7) ** 2), 10) AS s3,
      round(1 - (1 - l_discount) * (1 - l_tax), 10) AS either FROM lineitem""",
)
def review_decay(spark, d):
    q = F.col("l_quantity")
    decays = [F.round(numeric.decay(q, s), 10).alias(s.lower()) for s in ("S1", "S2", "S3")]
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *decays, F.round(numeric.noisy_or(F.array("l_discount", "l_tax")), 10).alias("either"))


# --- selection ---------------------------------------------------------------

_ARTICLES = "SELECT CAST(o_custkey AS VARCHAR) AS page_id, round(sum(o_totalprice), 2) AS quality_score, count(*) AS citation_count FROM orders GROUP BY o_custkey"
_NUMERIC = "CAST(page_id AS BIGINT)"


def _articles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("quality_score"), F.count("*").alias("citation_count")).select(F.col("o_custkey").cast("string").alias("page_id"), "quality_score", "citation_count")


K = 50
_METHOD1 = f"""SELECT * FROM (
      SELECT page_id, quality_score, citation_count, row_number() OVER (ORDER BY citation_count DESC, quality_score DESC, {_NUMERIC})::INTEGER AS rank FROM (
        SELECT *, rank() OVER (ORDER BY quality_score DESC) AS place FROM ({_ARTICLES})) WHERE place <= {K})
    WHERE rank <= {K}"""
_METHOD2 = f"""SELECT page_id, quality_score, citation_count, final_score, row_number() OVER (ORDER BY final_score DESC, quality_score DESC, citation_count DESC, {_NUMERIC})::INTEGER AS rank FROM (
      SELECT a.*, round(0.7 * (quality_score - mq) / sq + 0.3 * (citation_count - mc) / sc, 10) AS final_score FROM ({_ARTICLES}) a,
        (SELECT avg(quality_score) AS mq, stddev_pop(quality_score) AS sq, avg(citation_count) AS mc, stddev_pop(citation_count) AS sc FROM ({_ARTICLES})))
    QUALIFY rank <= {K}"""


@query("select_method1", _METHOD1)
def select_method1(spark, d):
    return selection.by_quality_then_citations(_articles(spark, d), K).select("page_id", "quality_score", "citation_count", "rank")


@query("select_method2", f"SELECT page_id, quality_score, citation_count, round(final_score, 8) AS final_score, rank FROM ({_METHOD2})")
def select_method2(spark, d):
    return selection.by_weighted_z(_articles(spark, d), K).select("page_id", "quality_score", "citation_count", F.round("final_score", 8).alias("final_score"), "rank")


@query("select_overlap", f"SELECT count(*) AS overlap, round(count(*) / {K}.0, 10)::DOUBLE AS overlap_ratio FROM (SELECT page_id FROM ({_METHOD1}) INTERSECT SELECT page_id FROM ({_METHOD2}))")
def select_overlap(spark, d):
    rows = _articles(spark, d)
    return selection.overlap(selection.by_quality_then_citations(rows, K), selection.by_weighted_z(rows, K), K)


@query(
    "select_stats",
    f"""SELECT count(*) AS n, min(quality_score) AS quality_score_min, round(quantile_cont(quality_score, 0.5), 6) AS quality_score_median, round(avg(quality_score), 6) AS quality_score_mean, max(quality_score) AS quality_score_max,
      min(citation_count) AS citation_count_min, quantile_cont(citation_count, 0.5)::DOUBLE AS citation_count_median, round(avg(citation_count), 6) AS citation_count_mean, max(citation_count) AS citation_count_max FROM ({_METHOD1})""",
)
def select_stats(spark, d):
    out = selection.summary(select_method1(spark, d), "quality_score", "citation_count")
    return out.withColumns({c: F.round(c, 6) for c in ("quality_score_median", "quality_score_mean", "citation_count_mean")})


_POOL = f"SELECT * FROM (SELECT *, rank() OVER (ORDER BY quality_score DESC) AS place FROM ({_ARTICLES})) WHERE place <= {K}"


@query("select_ties", f"SELECT cutoff, count(*) AS ties FROM ({_POOL}), (SELECT min(citation_count) AS cutoff FROM ({_METHOD1})) WHERE citation_count = cutoff GROUP BY cutoff")
def select_ties(spark, d):
    return selection.ties_at_cutoff(selection.quality_pool(_articles(spark, d), K), select_method1(spark, d), "citation_count")


_FINAL = f"SELECT a.*, round(0.7 * (quality_score - mq) / sq + 0.3 * (citation_count - mc) / sc, 10) AS final_score FROM ({_ARTICLES}) a, (SELECT avg(quality_score) AS mq, stddev_pop(quality_score) AS sq, avg(citation_count) AS mc, stddev_pop(citation_count) AS sc FROM ({_ARTICLES}))"
_FOUND = "(SELECT count(*) FROM ({m}) WHERE CAST(page_id AS BIGINT) < 40)"


@query(
    "selection_report",
    f"""WITH a AS ({_ARTICLES}), p AS ({_POOL}), m1 AS ({_METHOD1}), m2 AS ({_METHOD2}), f AS ({_FINAL})
    SELECT (SELECT count(*) FROM a) AS total_rows, {K} AS top_k, (SELECT min(quality_score) FROM p) AS m1_quality_cutoff, (SELECT count(*) FROM p) AS m1_quality_pool_size, (SELECT min(citation_count) FROM m1) AS m1_citation_cutoff_in_selected,
      (SELECT count(*) FROM p WHERE citation_count = (SELECT min(citation_count) FROM m1)) AS m1_citation_ties_at_cutoff_in_pool,
      (SELECT count(*) FROM m1 JOIN m2 USING (page_id)) AS intersection_count, round((SELECT count(*) FROM m1 JOIN m2 USING (page_id)) / {K}.0, 6)::DOUBLE AS intersection_ratio_vs_topk,
      0.7::DOUBLE AS m2_weight_quality_normalized, 0.3::DOUBLE AS m2_weight_citation_normalized, (SELECT round(avg(quality_score), 6) FROM a) AS m2_quality_mean_all, (SELECT round(stddev_pop(quality_score), 6) FROM a) AS m2_quality_std_all,
      (SELECT round(avg(citation_count), 6) FROM a) AS m2_citation_mean_all, (SELECT round(stddev_pop(citation_count), 6) FROM a) AS m2_citation_std_all,
      (SELECT round(min(final_score), 6) FROM m2) AS m2_final_score_cutoff, (SELECT count(*) FROM f WHERE final_score = (SELECT min(final_score) FROM m2)) AS m2_final_score_ties_at_cutoff,
      (SELECT round(avg(quality_score), 6) FROM m1) AS m1_selected_quality_mean, (SELECT round(quantile_cont(quality_score, 0.5), 6) FROM m1) AS m1_selected_quality_median,
      (SELECT round(avg(citation_count), 6) FROM m1) AS m1_selected_citation_mean, (SELECT quantile_cont(citation_count, 0.5)::DOUBLE FROM m1) AS m1_selected_citation_median,
      (SELECT round(avg(quality_score), 6) FROM m2) AS m2_selected_quality_mean, (SELECT round(quantile_cont(quality_score, 0.5), 6) FROM m2) AS m2_selected_quality_median,
      (SELECT round(avg(citation_count), 6) FROM m2) AS m2_selected_citation_mean, (SELECT quantile_cont(citation_count, 0.5)::DOUBLE FROM m2) AS m2_selected_citation_median,
      (SELECT round(avg(final_score), 6) FROM m2) AS m2_selected_final_mean, (SELECT round(quantile_cont(final_score, 0.5), 6) FROM m2) AS m2_selected_final_median,
      {_FOUND.format(m=_METHOD1)} AS m1_raw_text_found_count, round({_FOUND.format(m=_METHOD1)} / {K}.0, 6)::DOUBLE AS m1_raw_text_found_ratio,
      {_FOUND.format(m=_METHOD2)} AS m2_raw_text_found_count, round({_FOUND.format(m=_METHOD2)} / {K}.0, 6)::DOUBLE AS m2_raw_text_found_ratio""",
)
def selection_report(spark, d):
    rows = _articles(spark, d)
    texts = table(spark, d, "documents").select((F.col("doc_id") % 40).cast("string").alias("page_id"), F.col("doc_id").alias("ordinal"), F.col("text").alias("raw_text"))
    one = selection.with_raw_text(selection.by_quality_then_citations(rows, K), texts)
    two = selection.with_raw_text(selection.by_weighted_z(rows, K), texts)
    out = selection.selection_report(rows, one, two, K)
    return out.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


@query(
    "score_cutoff_diag",
    f"""WITH a AS ({_ARTICLES}), t AS (SELECT *, row_number() OVER (ORDER BY quality_score DESC) AS r, round(count(*) OVER () * 0.1)::BIGINT AS top_n FROM a),
      c AS (SELECT quality_score AS cutoff, top_n FROM t WHERE r = top_n)
    SELECT count(*) AS n, min(quality_score) AS min, round(quantile_cont(quality_score, 0.25), 6) AS q1, round(quantile_cont(quality_score, 0.5), 6) AS median, round(avg(quality_score), 6) AS mean,
      round(quantile_cont(quality_score, 0.75), 6) AS q3, max(quality_score) AS max, any_value(top_n) AS top_n, any_value(cutoff) AS cutoff,
      count(*) FILTER (quality_score > cutoff) AS above, count(*) FILTER (quality_score >= cutoff) AS at_or_above FROM a, c""",
)
def score_cutoff_diag(spark, d):
    out = selection.cutoff_diagnostics(_articles(spark, d), 0.1)
    return out.withColumns({c: F.round(c, 6) for c in ("q1", "median", "mean", "q3")})


@query(
    "raw_text_lookup",
    f"""WITH t AS (SELECT CAST(doc_id % 40 AS VARCHAR) AS page_id, arg_min(text, doc_id) AS raw_text FROM documents GROUP BY 1)
    SELECT page_id, rank, coalesce(raw_text, '') AS raw_text FROM ({_METHOD1}) LEFT JOIN t USING (page_id)""",
)
def raw_text_lookup(spark, d):
    texts = table(spark, d, "documents").select((F.col("doc_id") % 40).cast("string").alias("page_id"), F.col("doc_id").alias("ordinal"), F.col("text").alias("raw_text"))
    return selection.with_raw_text(select_method1(spark, d), texts).select("page_id", "rank", "raw_text")


@query("needed_ids", f"SELECT page_id FROM ({_METHOD1}) UNION SELECT page_id FROM ({_METHOD2})")
def needed_ids(spark, d):
    rows = _articles(spark, d)
    return selection.needed_ids(selection.by_quality_then_citations(rows, K), selection.by_weighted_z(rows, K))


# --- labels, duplicates, filters ---------------------------------------------


@query(
    "label_prefix",
    """SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS label, text FROM (
      SELECT conv_id, turn, role, trim(text) AS text, min(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS first FROM conversations WHERE trim(text) <> '')
    WHERE role = 'assistant' OR first IS NULL OR turn < first""",
)
def label_prefix(spark, d):
    rows = table(spark, d, "conversations").withColumn("has_citation", F.col("role") == "assistant")
    return sentences.prefix_labels(rows, "conv_id", order="turn").select("conv_id", "turn", "label", "text")


_EXAMPLES = "SELECT doc_id, text, n_chars, quality AS label, toxic AS pred_label FROM documents JOIN labels USING (doc_id)"


def _examples(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return joined.select("doc_id", "text", "n_chars", F.col("quality").alias("label"), F.col("toxic").alias("pred_label"))


@query("dedup_text_label", f"SELECT text, label, min(doc_id) AS ordinal FROM ({_EXAMPLES}) GROUP BY text, label")
def dedup_text_label(spark, d):
    return curate.first_of_pairs(_examples(spark, d).select("text", "label", F.col("doc_id").alias("ordinal")))


_SPACE = r"[\s\x0B]+"
_WORDS = f"len(list_filter(regexp_split_to_array(text, '{_SPACE}'), lambda w: w <> ''))"


@query(
    "filter_length_pct",
    f"""WITH w AS (SELECT doc_id, {_WORDS} AS n_words FROM documents), c AS (SELECT quantile_cont(n_words, 0.05) AS lo, quantile_cont(n_words, 0.95) AS hi FROM w)
    SELECT doc_id, n_words::INTEGER AS n_words FROM w, c WHERE n_words BETWEEN lo AND hi""",
)
def filter_length_pct(spark, d):
    kept, _ = curate.by_length_percentiles(table(spark, d, "documents"))
    return kept.select("doc_id", "n_words")


@query(
    "filter_length_report",
    f"""WITH w AS (SELECT {_WORDS} AS n FROM documents), c AS (SELECT quantile_cont(n, 0.05) AS lo, quantile_cont(n, 0.95) AS hi FROM w)
    SELECT round(any_value(lo), 6) AS lower, round(any_value(hi), 6) AS upper, count(*) FILTER (n < lo) AS too_short, count(*) FILTER (n > hi) AS too_long, count(*) FILTER (n BETWEEN lo AND hi) AS kept FROM w, c""",
)
def filter_length_report(spark, d):
    _, report = curate.by_length_percentiles(table(spark, d, "documents"))
    return report.withColumns({c: F.round(c, 6) for c in ("lower", "upper")})


_PPL = "SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'inf'::DOUBLE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 17 = 0 THEN -1 ELSE n_chars / 10.0 END::DOUBLE AS ppl FROM documents"
_VALID = "isfinite(ppl) AND ppl > 0"
_FENCE = f"SELECT quantile_cont(ppl, 0.9) AS p90, quantile_cont(ppl, 0.75) + 1.5 * (quantile_cont(ppl, 0.75) - quantile_cont(ppl, 0.25)) AS fence FROM ({_PPL}) WHERE {_VALID}"


def _with_perplexity(spark: SparkSession, d: str) -> DataFrame:
    doc = F.col("doc_id")
    ppl = F.when(doc % 11 == 0, float("inf")).when(doc % 13 == 0, None).when(doc % 17 == 0, -1.0).otherwise(F.col("n_chars") / 10)
    return table(spark, d, "documents").select("doc_id", ppl.cast("double").alias("perplexity_score"))


@query("filter_ppl_cutoff", f"SELECT doc_id, ppl AS perplexity_score FROM ({_PPL}), ({_FENCE}) WHERE {_VALID} AND ppl <= least(p90, fence)")
def filter_ppl_cutoff(spark, d):
    return curate.by_perplexity_cutoff(_with_perplexity(spark, d))[0]


@query(
    "filter_ppl_report",
    f"""SELECT round(any_value(fence), 6) AS upper_fence, round(any_value(p90), 6) AS p90, round(any_value(least(p90, fence)), 6) AS cutoff, count(*) FILTER ({_VALID} AND ppl <= least(p90, fence)) AS kept,
      count(*) FILTER ({_VALID} AND ppl > least(p90, fence)) AS removed_above, count(*) FILTER (NOT coalesce({_VALID}, false)) AS removed_invalid FROM ({_PPL}), ({_FENCE})""",
)
def filter_ppl_report(spark, d):
    _, report = curate.by_perplexity_cutoff(_with_perplexity(spark, d))
    return report.withColumns({c: F.round(c, 6) for c in ("upper_fence", "p90", "cutoff")})


# --- profiles ----------------------------------------------------------------


@query("eda_label_dist", f"SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 10) AS share FROM ({_EXAMPLES}) GROUP BY label")
def eda_label_dist(spark, d):
    return curate.label_distribution(_examples(spark, d))


@query("eda_class_ratio", f"SELECT count(*) FILTER (label = 1) AS class1, count(*) FILTER (label = 0) AS class0, round(count(*) FILTER (label = 1) / greatest(count(*) FILTER (label = 0), 1), 10) AS class1_to_class0 FROM ({_EXAMPLES})")
def eda_class_ratio(spark, d):
    return curate.class_ratio(_examples(spark, d))


_DESCRIBE = ", ".join(
    ["count({c}) AS n", "min({c})::DOUBLE AS min", *(f"round(quantile_cont({{c}}, {q}), 6)::DOUBLE AS {n}" for q, n in ((0.25, "p25"), (0.5, "median"), (0.75, "p75"), (0.95, "p95"))), "round(avg({c}), 6) AS mean", "max({c})::DOUBLE AS max", "round(stddev_pop({c}), 6) AS std"]
)


@query("eda_describe", f"SELECT {_DESCRIBE.format(c='n_chars')} FROM ({_EXAMPLES})")
def eda_describe(spark, d):
    return curate.described(_examples(spark, d), "n_chars")


@query("eda_describe_by_label", f"SELECT label, {_DESCRIBE.format(c='n_chars')} FROM ({_EXAMPLES}) GROUP BY label")
def eda_describe_by_label(spark, d):
    return curate.described(_examples(spark, d), "n_chars", "label")


@query("price_describe", f"SELECT l_returnflag, {_DESCRIBE.format(c='l_extendedprice')} FROM lineitem GROUP BY l_returnflag")
def price_describe(spark, d):
    return curate.described(table(spark, d, "lineitem"), "l_extendedprice", "l_returnflag")


_SCORED = f"SELECT doc_id, label, ppl, {_WORDS} AS n_words FROM ({_EXAMPLES}) JOIN ({_PPL}) USING (doc_id)"
_FILTERED = f"SELECT s.* FROM ({_SCORED}) s, (SELECT quantile_cont(ppl, 0.9) AS p90, quantile_cont(ppl, 0.75) + 1.5 * (quantile_cont(ppl, 0.75) - quantile_cont(ppl, 0.25)) AS fence FROM ({_SCORED}) WHERE {_VALID}) WHERE {_VALID} AND ppl <= least(p90, fence)"
_BOTH = (("before_filtering", _SCORED), ("after_filtering", _FILTERED))


def _scored(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    rows = _examples(spark, d).select("doc_id", "label", T.word_count("text").alias("n_words")).join(_with_perplexity(spark, d), "doc_id")
    return {"before_filtering": rows, "after_filtering": curate.by_perplexity_cutoff(rows)[0]}


def _profile_sql(name: str, source: str, metric: str, column: str, where: str = "true") -> str:
    shares = ", ".join(f"round(quantile_cont({column}, {q}), 6)::DOUBLE AS {n}" for n, q in curate.PROFILE.items())
    return f"SELECT '{name}' AS dataset, '{metric}' AS metric, count(*) AS n, min({column})::DOUBLE AS min, {shares}, round(avg({column}), 6) AS mean, max({column})::DOUBLE AS max, round(stddev_pop({column}), 6) AS std FROM ({source}) WHERE {where}"


@query("eda_before_after", " UNION ALL ".join(q for n, s in _BOTH for q in (_profile_sql(n, s, "perplexity", "ppl", _VALID), _profile_sql(n, s, "word_length", "n_words"))))
def eda_before_after(spark, d):
    return evaluate.union_all([curate.profiled(rows, name) for name, rows in _scored(spark, d).items()])


@query(
    "eda_invalid_perplexity",
    " UNION ALL ".join(
        f"SELECT '{n}' AS dataset, count(*) AS rows_loaded, count(*) FILTER (ppl IS NULL) AS missing, count(*) FILTER (isnan(ppl)) AS nan, count(*) FILTER (isinf(ppl)) AS inf, count(*) FILTER (isfinite(ppl) AND ppl <= 0) AS non_positive, count(*) FILTER ({_VALID}) AS valid FROM ({s})"
        for n, s in _BOTH
    ),
)
def eda_invalid_perplexity(spark, d):
    return evaluate.union_all([curate.invalid_counts(rows, name) for name, rows in _scored(spark, d).items()])


@query(
    "eda_class_cutoffs",
    " UNION ALL ".join(
        f"SELECT '{n}' AS dataset, '{m}' AS metric, label, round(quantile_cont({c}, {q}), 6)::DOUBLE AS cutoff FROM ({s}) WHERE {w} GROUP BY label"
        for n, s in _BOTH
        for m, c, q, w in (("perplexity", "ppl", 0.95, _VALID), ("word_length", "n_words", 0.99, "true"))
    ),
)
def eda_class_cutoffs(spark, d):
    return evaluate.union_all([curate.class_cutoffs(rows, name) for name, rows in _scored(spark, d).items()])


_TIDY = f"trim(regexp_replace(text, '{_SPACE}', ' ', 'g'))"


@query(
    "eda_quality_flags",
    f"""WITH t AS (SELECT {_TIDY} AS x, label FROM (SELECT html AS text, CAST(page_id % 2 AS INTEGER) AS label FROM pages UNION ALL SELECT text, label FROM ({_EXAMPLES}))), v AS (SELECT * FROM t WHERE x <> '')
    SELECT count(*) AS n_records, count(*) - count(DISTINCT x) AS n_duplicate_text, count(*) - count(DISTINCT (x, label)) AS n_duplicate_text_label, count(*) FILTER (length(x) < 10) AS n_short_text,
      count(*) FILTER (length(x) > 500) AS n_long_text, count(*) FILTER (regexp_matches(x, '<[^>]+>')) AS n_has_markup,
      round((count(*) - count(DISTINCT x)) / greatest(count(*), 1), 10) AS pct_duplicate_text, round(count(*) FILTER (regexp_matches(x, '<[^>]+>')) / greatest(count(*), 1), 10) AS pct_has_markup FROM v""",
)
def eda_quality_flags(spark, d):
    pages = table(spark, d, "pages").select(F.col("html").alias("text"), (F.col("page_id") % 2).cast("int").alias("label"))
    return curate.quality_flags(pages.unionByName(_examples(spark, d).select("text", "label")))


_BUCKET = "CASE " + " ".join(f"WHEN n {'>' if a else '>='} {a} AND n <= {b} THEN {i}" for i, (a, b) in enumerate(zip(curate.LENGTH_BOUNDS, curate.LENGTH_BOUNDS[1:]))) + " END"


@query(
    "eda_length_buckets",
    f"""WITH t AS (SELECT n_chars AS n, label FROM ({_EXAMPLES})), c AS (SELECT {_BUCKET} AS bucket, count(*) FILTER (label = 0) AS c0, count(*) FILTER (label = 1) AS c1 FROM t GROUP BY 1)
    SELECT b::INTEGER AS bucket, coalesce(c0, 0) AS class0, coalesce(c1, 0) AS class1, round(100 * c0 / nullif(c0 + c1, 0), 2) AS pct0, round(100 * c1 / nullif(c0 + c1, 0), 2) AS pct1
    FROM range(7) r(b) LEFT JOIN c ON b = bucket""",
)
def eda_length_buckets(spark, d):
    return curate.length_buckets(_examples(spark, d), length="n_chars")


@query(
    "eda_extremes",
    """(SELECT doc_id, n_chars, 'smallest' AS side FROM documents ORDER BY n_chars, doc_id LIMIT 10) UNION ALL (SELECT doc_id, n_chars, 'largest' AS side FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10)""",
)
def eda_extremes(spark, d):
    return curate.extremes(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id")


_LABEL_TEXTS = "(VALUES (0, ' Yes '), (1, 'NEG'), (2, '1.0'), (3, 'maybe'), (4, 'TRUE'), (5, '0'), (6, NULL)) AS v(i, x)"


@query(
    "eda_normalized_labels",
    f"""SELECT doc_id, CASE WHEN lower(trim(x)) IN ('0', 'false', 'neg', 'negative', 'no') THEN '0' WHEN lower(trim(x)) IN ('1', 'true', 'pos', 'positive', 'yes') THEN '1' WHEN x = '1.0' THEN '1' ELSE lower(trim(x)) END AS label
    FROM documents JOIN {_LABEL_TEXTS} ON i = doc_id % 7""",
)
def eda_normalized_labels(spark, d):
    values = F.array(*(F.lit(x) for x in (" Yes ", "NEG", "1.0", "maybe", "TRUE", "0")), F.lit(None).cast("string"))
    return table(spark, d, "documents").select("doc_id", T.normalized_label(F.get(values, (F.col("doc_id") % 7).cast("int"))).alias("label"))


@query("first_present_key", "SELECT event_id, json_extract_string(props, '$.k') AS value FROM events")
def first_present_key(spark, d):
    return table(spark, d, "events").select("event_id", T.first_present("props", ["text", "k", "label"]).alias("value"))


# --- bins, splits, metrics ---------------------------------------------------

_EDGES = "SELECT list_sort(list_distinct(quantile_cont(n_chars, [i / 10.0 for i in range(11)])))::DOUBLE[] AS e FROM ({src})"
_EDGES10 = ", ".join(f"{i / 10}" for i in range(11))


def _edges(source: str, column: str = "n_chars", cuts: str = _EDGES10) -> str:
    return f"SELECT list_sort(list_distinct(quantile_cont({column}::DOUBLE, [{cuts}]))) AS e FROM ({source})"


_BIN = "len(list_filter(e[2:len(e) - 1], lambda x: x <= n_chars))"


@query("bins_quantile", f"SELECT doc_id, {_BIN}::INTEGER AS bin FROM documents, ({_edges('SELECT * FROM documents')})")
def bins_quantile(spark, d):
    return curate.with_bins(table(spark, d, "documents"), "n_chars", 10, "bin").select("doc_id", "bin")


_CONFUSION = "count(*) FILTER (label = 1 AND pred_label = 1) AS tp, count(*) FILTER (label = 0 AND pred_label = 1) AS fp, count(*) FILTER (label = 1 AND pred_label = 0) AS fn, count(*) FILTER (label = 0 AND pred_label = 0) AS tn"


def _metrics_sql(source: str, by: str = "") -> str:
    """METRICS from the confusion counts, rounded to 8 places."""
    keys = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    known = "nullif(tp + fp + fn + tn, 0)"
    f1 = {"pos": "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)", "neg": "coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)"}
    rates = {
        "accuracy": f"(tp + tn) / {known}",
        "macro_f1": f"({f1['pos']} + {f1['neg']}) / nullif((tp + fp + fn > 0)::INTEGER + (tn + fp + fn > 0)::INTEGER, 0)",
        "weighted_f1": f"({f1['pos']} * (tp + fn) + {f1['neg']} * (tn + fp)) / {known}",
    }
    for name, (hit, said, true) in {"pos": ("tp", "tp + fp", "tp + fn"), "neg": ("tn", "tn + fn", "tn + fp")}.items():
        rates |= {f"precision_{name}": f"coalesce({hit} / nullif({said}, 0), 0)", f"recall_{name}": f"coalesce({hit} / nullif({true}, 0), 0)", f"f1_{name}": f1[name]}
    rates |= {"precision": rates["precision_pos"], "recall": rates["recall_pos"], "f1": f1["pos"]}
    columns = [f"round(CASE WHEN tp + fp + fn + tn > 0 THEN {e} END, 8)::DOUBLE AS {n}" for n, e in rates.items()]
    return f"SELECT {keys}{', '.join(columns)}, tp + fn AS support_pos, tn + fp AS support_neg FROM (SELECT {keys}{_CONFUSION} FROM ({source}){group})"


@query("metrics_overall", _metrics_sql(_EXAMPLES))
def metrics_overall(spark, d):
    return evaluate.rounded(evaluate.metrics_of(_examples(spark, d)))


_PARTLY = f"SELECT doc_id, n_chars, label, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE pred_label END AS pred_label FROM ({_EXAMPLES})"


def _partly(spark: SparkSession, d: str) -> DataFrame:
    return _examples(spark, d).withColumn("pred_label", F.when(F.col("doc_id") % 5 != 0, F.col("pred_label")))


@query("metrics_coverage", f"SELECT m.*, round((SELECT count(pred_label) / count(*) FROM ({_PARTLY})), 10) AS valid_coverage FROM ({_metrics_sql(_PARTLY)}) m")
def metrics_coverage(spark, d):
    out = evaluate.metrics_with_coverage(_partly(spark, d))
    return with_scalars(evaluate.rounded(out.drop("valid_coverage")), out.select("valid_coverage"))


_BINNED = f"SELECT *, {_BIN}::INTEGER AS bin FROM ({_PARTLY}), ({_edges(_PARTLY)})"


@query(
    "bins_metrics",
    f"""WITH b AS ({_BINNED}), e AS ({_edges(_PARTLY)}), s AS (SELECT unnest(range(len(e) - 1))::INTEGER AS bin, e FROM e),
      c AS (SELECT bin, count(*) AS support_total, round(count(pred_label) / count(*), 10) AS valid_coverage FROM b GROUP BY bin)
    SELECT s.bin, round(e[s.bin + 1], 6) AS edge_low, round(e[s.bin + 2], 6) AS edge_high, coalesce(support_total, 0) AS support_total, valid_coverage, m.* EXCLUDE (bin, support_pos, support_neg),
      coalesce(support_pos, 0) AS support_pos, coalesce(support_neg, 0) AS support_neg
    FROM s LEFT JOIN c USING (bin) LEFT JOIN ({_metrics_sql('SELECT * FROM b', 'bin')}) m USING (bin)""",
)
def bins_metrics(spark, d):
    out = evaluate.metrics_by_bin(_partly(spark, d), "n_chars", 10)
    places = {c: 6 if c.startswith("edge") else 10 if c == "valid_coverage" else 8 for c, t in out.dtypes if t == "double"}
    return out.select(*(F.round(c, places[c]).alias(c) if c in places else F.col(c) for c in out.columns))


@query(
    "runtime_summary",
    """SELECT count(*) AS num_samples, 60.0::DOUBLE AS elapsed_s, round(avg(value), 10) AS avg_latency_s, round(count(*) / 60.0, 10)::DOUBLE AS samples_per_second, round((sum(event_id % 100) + sum(event_id % 7)) / 60.0, 10)::DOUBLE AS tokens_per_second,
      sum(event_id % 100)::BIGINT AS prompt_tokens, sum(event_id % 7)::BIGINT AS completion_tokens, round(count(*) FILTER (event_id % 4 = 0) / count(*), 10) AS parse_fail_rate, round(count(*) FILTER (event_type = 'error') / count(*), 10) AS error_rate FROM events""",
)
def runtime_summary(spark, d):
    e = F.col("event_id")
    rows = table(spark, d, "events").select(F.col("value").alias("latency_s"), (e % 100).alias("prompt_tokens"), (e % 7).alias("completion_tokens"), F.when(e % 4 != 0, (e % 2).cast("int")).alias("pred_label"), F.when(F.col("event_type") == "error", "x").alias("error"))
    return evaluate.runtime_summary(rows, 60.0).withColumn("avg_latency_s", F.round("avg_latency_s", 10))


@query("run_status", "SELECT event_type AS status, count(*) AS files, sum(user_id)::BIGINT AS pages, sum(event_id)::BIGINT AS revisions FROM events GROUP BY event_type")
def run_status(spark, d):
    return evaluate.run_status(table(spark, d, "events").select(F.col("event_type").alias("status"), F.col("user_id").alias("page_count"), F.col("event_id").alias("revision_count")))


@query(
    "logits_class",
    """SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INTEGER AS argmax, (embedding[1] > 0)::INTEGER AS binary FROM embeddings""",
)
def logits_class(spark, d):
    return table(spark, d, "embeddings").select("vec_id", numeric.predicted_class(F.col("embedding")).alias("argmax"), numeric.predicted_class(F.slice("embedding", 1, 1)).alias("binary"))


_BINS5 = ", ".join(f"{i / 5}" for i in range(6))
_STRATA = f"""SELECT doc_id, label, {_BIN}::INTEGER AS len_bin, len(list_filter(p[2:len(p) - 1], lambda x: x <= v))::INTEGER AS ppl_bin FROM (SELECT doc_id, label, n_chars, (doc_id * 37 % 101)::DOUBLE AS v FROM ({_EXAMPLES})),
      ({_edges(_EXAMPLES, cuts=_BINS5)}), (SELECT list_sort(list_distinct(quantile_cont((doc_id * 37 % 101)::DOUBLE, [{_BINS5}]))) AS p FROM ({_EXAMPLES}))"""
_SPLIT = f"""WITH s AS (SELECT *, label || '__len' || len_bin || '__ppl' || ppl_bin AS stratum FROM ({_STRATA})), n AS (SELECT stratum, count(*) AS n FROM s GROUP BY stratum),
      u AS (SELECT *, sum(CASE WHEN n < 2 THEN 0 ELSE n END) OVER (ORDER BY stratum) AS upto FROM n),
      q AS (SELECT stratum, n, CASE WHEN n < 2 THEN n ELSE floor(upto * 0.8 + 0.5) - floor((upto - n) * 0.8 + 0.5) END AS tr, CASE WHEN n < 2 THEN 0 ELSE floor(upto * 0.1 + 0.5) - floor((upto - n) * 0.1 + 0.5) END AS va FROM u),
      r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || doc_id)) AS place FROM s)
    SELECT doc_id, label, len_bin, ppl_bin, stratum, CASE WHEN place <= tr THEN 'train' WHEN place <= tr + va THEN 'val' ELSE 'test' END AS split FROM r JOIN q USING (stratum)"""


@query("split_stratified", _SPLIT)
def split_stratified(spark, d):
    rows = _examples(spark, d).withColumn("v", (F.col("doc_id") * 37 % 101).cast("double"))
    binned = curate.with_bins(curate.with_bins(rows, "n_chars", 5, "len_bin"), "v", 5, "ppl_bin")
    return curate.stratified_split(binned, F.col("doc_id"), curate.stratum()).select("doc_id", "label", "len_bin", "ppl_bin", "stratum", "split")


@query(
    "split_report",
    f"""WITH x AS ({_SPLIT}), a AS (SELECT * FROM x UNION ALL SELECT * REPLACE ('overall' AS split) FROM x)
    SELECT split, k AS key, count(*) AS n FROM (SELECT split, unnest(['label=' || label, 'len=' || len_bin, 'ppl=' || ppl_bin, 'stratum=' || stratum]) AS k FROM a) GROUP BY split, k""",
)
def split_report(spark, d):
    return curate.split_report(split_stratified(spark, d))


@query("seeded_sample", "SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 25")
def seeded_sample(spark, d):
    return curate.seeded_sample(table(spark, d, "documents").select("doc_id"), 25, "doc_id")


@query("union_frames", "SELECT doc_id, quality, -1 AS toxic FROM labels UNION ALL SELECT doc_id, -1, toxic FROM labels")
def union_frames(spark, d):
    labels = table(spark, d, "labels")
    return evaluate.union_all([labels.select("doc_id", "quality"), labels.select("doc_id", "toxic")]).fillna(-1)


@query("benchmark_order", "SELECT lang, count(*) AS n, round(avg(n_chars), 6) AS macro_f1 FROM documents GROUP BY lang")
def benchmark_order(spark, d):
    runs = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("macro_f1"))
    return evaluate.benchmark_order(runs, "macro_f1", "n")


# --- texts -------------------------------------------------------------------


@query("txt_tokens", f"SELECT doc_id, array_to_string(regexp_extract_all(lower({_TIDY}), '[\\p{{L}}\\p{{N}}_]+'), ' ') AS tokens FROM documents")
def txt_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.word_tokens("text"), " ").alias("tokens"))


@query("txt_whitespace", f"SELECT doc_id, {_TIDY} AS text FROM documents")
def txt_whitespace(spark, d):
    return table(spark, d, "documents").select("doc_id", T.collapse_whitespace("text").alias("text"))


@query("txt_word_count", f"SELECT doc_id, {_WORDS}::INTEGER AS words, length(text) AS chars FROM documents")
def txt_word_count(spark, d):
    return table(spark, d, "documents").select("doc_id", T.word_count("text").alias("words"), F.char_length("text").cast("long").alias("chars"))


@query("txt_nfc", "SELECT doc_id, nfc_normalize(text || 'e' || chr(769)) AS text FROM documents")
def txt_nfc(spark, d):
    return table(spark, d, "documents").select("doc_id", arrow_text.nfc(F.concat("text", F.lit("e" + chr(769)))).alias("text"))


@query("txt_model_input", r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text || '% + $5', '[\s\x0B]', ' ', 'g'), '[^\p{L}\p{N} .,;:!?"''()\[\]{}\-_/\\]', '', 'g'), ' +', ' ', 'g')) AS text FROM documents""")
def txt_model_input(spark, d):
    return table(spark, d, "documents").select("doc_id", T.model_text(arrow_text.nfkc(F.concat("text", F.lit("% + $5")))).alias("text"))


@query("txt_invisible", "SELECT doc_id, text FROM documents")
def txt_invisible(spark, d):
    return table(spark, d, "documents").select("doc_id", T.remove_invisible(F.concat(F.lit(T.INVISIBLE), "text", F.lit(T.INVISIBLE))).alias("text"))


@query("txt_html_comments", r"SELECT page_id, regexp_replace('<!-- a ' || chr(10) || ' b -->' || html || '<!-- open', '<!--.*?-->', '', 'gs') AS html FROM pages")
def txt_html_comments(spark, d):
    return table(spark, d, "pages").select("page_id", T.remove_comments(F.concat(F.lit("<!-- a \n b -->"), "html", F.lit("<!-- open"))).alias("html"))


@query("txt_strip_tags", "SELECT doc_id, text || '<ref>k</ref>' || '<br>' AS text FROM documents")
def txt_strip_tags(spark, d):
    return table(spark, d, "documents").select("doc_id", T.remove_tags_except_ref(F.concat(F.lit('<div class="a">gone</DIV>'), "text", F.lit("<references/><ref>k</ref><br>"))).alias("text"))


@query("txt_templates", "SELECT doc_id, text || '}}tail' AS text FROM documents")
def txt_templates(spark, d):
    return table(spark, d, "documents").select("doc_id", arrow_text.without_templates(F.concat(F.lit("{{a{{b}}c}}"), "text", F.lit("}}tail{{open"))).alias("text"))


@query("txt_tables", "SELECT doc_id, text || 'x' AS text FROM documents")
def txt_tables(spark, d):
    return table(spark, d, "documents").select("doc_id", arrow_text.without_tables(F.concat(F.lit("{|a{|b|}c|}"), "text", F.lit("{|r|}x"))).alias("text"))


@query("txt_files", "SELECT doc_id, 'a [[b]] ' || text AS text FROM documents")
def txt_files(spark, d):
    return table(spark, d, "documents").select("doc_id", arrow_text.without_files(F.concat(F.lit("[[File:x.png|a [[link]] b]]a [[b]] "), "text", F.lit("[[File:open"))).alias("text"))


@query("txt_ref_strip", "SELECT doc_id, 'A.' || text || ' D.' AS text, '2,' || (2 + length(text)) AS places FROM documents")
def txt_ref_strip(spark, d):
    raw = F.concat(F.lit('A.<ref name="x">k</ref>'), "text", F.lit("<ref>q</ref> D."))
    return table(spark, d, "documents").select("doc_id", T.without_refs(raw).alias("text"), F.array_join(T.ref_positions(raw).cast("array<string>"), ",").alias("places"))


@query("txt_links", "SELECT doc_id, 'see name and page' || text AS text FROM documents")
def txt_links(spark, d):
    return table(spark, d, "documents").select("doc_id", T.link_text(T.remove_emphasis(F.concat(F.lit("'''see''' [[a|b| name ]] ''and'' [[page]]"), "text"))).alias("text"))


@query("txt_sections", r"SELECT doc_id, 'Head ' || doc_id AS heading, regexp_replace(text, '^[\s\x0B]+|[\s\x0B]+$', '', 'g') AS rest FROM documents")
def txt_sections(spark, d):
    block = F.concat(F.lit("== Head "), F.col("doc_id"), F.lit(" ==\n"), "text")
    return table(spark, d, "documents").select("doc_id", T.heading(block).alias("heading"), T.after_heading(block).alias("rest"))


@query(
    "txt_paragraphs",
    r"""SELECT doc_id, 0 AS paragraph_id, 'H' AS header, p AS text_raw FROM (SELECT doc_id, trim(regexp_replace(nfc_normalize(text), '[ \t]+', ' ', 'g'), chr(10) || ' ') AS p FROM documents)
    WHERE length(p) >= 50 AND NOT regexp_matches(p, '^[*#|<]')""",
)
def txt_paragraphs(spark, d):
    pages = table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.concat(F.lit("{{box}}\n== H ==\n"), "text", F.lit("\n\n* item\n\nshort")).alias("raw_text"))
    return sentences.page_paragraphs(pages).select(F.col("page_id").alias("doc_id"), "paragraph_id", "header", "text_raw")


_INLINE = r"regexp_replace(regexp_replace(replace(text, chr(160), ' '), '[ \t\r\f\x0B]+', ' ', 'g'), '^[\s\x0B]+|[\s\x0B]+$', '', 'g')"


@query(
    "sent_split",
    rf"""WITH t AS (SELECT doc_id, regexp_replace({_INLINE}, '([.!?…]["''”’)\]]*)[\s\x0B]+(["''“‘(\[]?[\p{{Lu}}\p{{N}}])', '\1' || chr(10) || '\2', 'g') AS ended FROM documents),
      s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(ended, '\n+'), lambda x: regexp_replace(x, '^[\s\x0B]+|[\s\x0B]+$', '', 'g')), lambda x: x <> '') AS l FROM t)
    SELECT doc_id, (i - 1)::INTEGER AS index, l[i] AS sentence FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM s)""",
)
def sent_split(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(sentences.split_sentences(T.tidy_inline("text"))).alias("index", "sentence"))
    return rows


@query(
    "sent_citation_attr",
    """SELECT doc_id, 0 AS index, text, doc_id % 2 = 1 AS has_citation FROM documents UNION ALL
    SELECT doc_id, 1, 'Last of ' || doc_id || '.', doc_id % 3 = 0 FROM documents""",
)
def sent_citation_attr(spark, d):
    doc = F.col("doc_id")
    last = F.concat(F.lit("Last of "), doc, F.lit("."))
    raw = F.concat("text", F.when(doc % 2 == 1, "<ref>r</ref>").otherwise(""), F.lit(" "), last, F.when(doc % 3 == 0, " [12]").otherwise(""))
    rows = table(spark, d, "documents").select("doc_id", sentences.attributed(raw, F.array("text", last)).alias("s"))
    return rows.select("doc_id", F.inline("s"))


@query("ngram_ppl", f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower({_TIDY}), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM documents), c AS (SELECT w, count(*) AS n FROM t GROUP BY w),
      z AS (SELECT sum(n) AS total, count(*) AS types FROM c)
    SELECT doc_id, coalesce(round(p, 4), -1) AS perplexity_score FROM documents LEFT JOIN (SELECT doc_id, exp(avg(-ln((n + 1) / (total + types + 1)))) AS p FROM t JOIN c USING (w), z GROUP BY doc_id) USING (doc_id)""")
def ngram_ppl(spark, d):
    out = scoring.unigram_perplexity(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    score = F.col("perplexity_score")
    return out.select("doc_id", F.when(numeric.finite(score), F.round(score, 4)).otherwise(-1.0).alias("perplexity_score"))


# --- prompts -----------------------------------------------------------------

TEMPLATE = {"task": "Decide whether a sentence states a fact that can be checked.", "instruction": "Use the examples.", "rule": "Answer 0 or 1.", "input": "Sentence", "label": "Label"}
_SHORT = "CASE WHEN length(text) <= {n} THEN text ELSE rtrim(left(text, {n} - 3), ' ' || chr(10) || chr(13) || chr(9)) || '...' END"
_BLOCK = f"""SELECT 'Examples' || chr(10) || string_agg('[' || r || '] text: ' || x || chr(10) || '[' || r || '] label: ' || y, chr(10) ORDER BY r) AS b FROM (
      SELECT row_number() OVER (ORDER BY item_id) AS r, {_SHORT.format(n=240)} AS x, item_id % 2 AS y FROM benchmark QUALIFY r <= 4)"""


@query(
    "prompt_build",
    f"""SELECT doc_id, '{TEMPLATE['task']}' || chr(10) || '{TEMPLATE['instruction']}' || chr(10) || '{TEMPLATE['rule']}' || chr(10) || chr(10) || b || chr(10) || chr(10) || 'Sentence: ' || {_SHORT.format(n=1400)} || chr(10) || 'Label: ' AS prompt
    FROM documents, ({_BLOCK})""",
)
def prompt_build(spark, d):
    pool = table(spark, d, "benchmark").select(F.col("item_id").alias("ordinal"), "text", (F.col("item_id") % 2).alias("label"))
    examples = evaluate.example_block(evaluate.exemplars(pool, evaluate_shots("shot_4"), 240), "Examples")
    return evaluate.with_prompt(table(spark, d, "documents").select("doc_id", "text"), TEMPLATE, examples, 1400).select("doc_id", "prompt")


def evaluate_shots(mode: str) -> int:
    return T.shots(mode)


@query("chat_fallback", "SELECT conv_id, string_agg(upper(role) || ': ' || text, chr(10) || chr(10) ORDER BY turn) || chr(10) || chr(10) || 'ASSISTANT:' AS prompt FROM conversations GROUP BY conv_id")
def chat_fallback(spark, d):
    listed = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return listed.select("conv_id", evaluate.chat_text(F.col("m")).alias("prompt"))


_ANSWERS = ("Label: 1.", "y kien", "a factual claim", "?", "it is 10", "not check-worthy", "0")


@query("parse_label", "SELECT doc_id, CASE WHEN doc_id % 7 IN (0, 2) THEN 1 WHEN doc_id % 7 IN (1, 5, 6) THEN 0 ELSE -1 END AS label FROM documents")
def parse_label(spark, d):
    answers = F.array(*map(F.lit, _ANSWERS))
    return table(spark, d, "documents").select("doc_id", F.coalesce(T.parsed_label(F.get(answers, (F.col("doc_id") % 7).cast("int"))), F.lit(-1)).alias("label"))


@query("model_names", "SELECT p_partkey, lower(replace(replace(p_type || '/' || p_name, '/', '_'), ' ', '_')) AS training, coalesce(nullif(trim(regexp_replace(p_type || '/' || p_name, '[^A-Za-z0-9._-]+', '_', 'g'), '._'), ''), 'model') AS prompting FROM part")
def model_names(spark, d):
    name = F.concat("p_type", F.lit("/"), "p_name")
    return table(spark, d, "part").select("p_partkey", T.safe_model_name(name).alias("training"), T.safe_model_name(name, "prompting").alias("prompting"))


# --- flagship ----------------------------------------------------------------

_HISTORY_ARTICLES = f"SELECT CAST(page_id AS VARCHAR) AS page_id, round(sum(value), 4) AS quality_score, count(*) AS citation_count FROM ({_COLLAPSED}) JOIN (SELECT event_id AS revision_id, value FROM events) USING (revision_id) GROUP BY page_id"


@query("history_selection", f"SELECT page_id, quality_score, citation_count, round(final_score, 8) AS final_score, rank FROM ({_METHOD2.replace(_ARTICLES, _HISTORY_ARTICLES)})")
def history_selection(spark, d):
    """Collapsed revision histories to page scores to the best pages by weighted z-scores."""
    values = table(spark, d, "events").select(F.col("user_id").alias("page_id"), F.struct("ts", "event_id").alias("ordinal"), F.col("event_type").alias("username"), (F.col("event_type") == "error").alias("is_bot"), "value")
    pages = history.collapse_runs(values).groupBy("page_id").agg(F.round(F.sum("value"), 4).alias("quality_score"), F.count("*").alias("citation_count"))
    return selection.by_weighted_z(pages.withColumn("page_id", F.col("page_id").cast("string")), K).select("page_id", "quality_score", "citation_count", F.round("final_score", 8).alias("final_score"), "rank")
