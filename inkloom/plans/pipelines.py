"""The engine's pipelines, from dumps to evaluated examples, as compositions of operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import curate, history, probreview, selection, sentences


def revisions_from_dump(pages: DataFrame, bots: DataFrame) -> DataFrame:
    """Dump pages to cleaned revisions with contributors, bot flags, lengths, citations and parents."""
    rows = history.with_bots(history.with_contributor(history.revisions_of_pages(pages)), bots)
    return history.with_parent(history.clean_revisions(rows)).drop("comment")


def page_histories(revisions: DataFrame) -> DataFrame:
    """Revisions to nested pages without bots and with runs of one user collapsed."""
    kept = history.collapse_runs(revisions).withColumnRenamed("page_title", "title")
    return history.nested_pages(kept, "page_id", "title")


def scores(pages: DataFrame, config: probreview.Config = probreview.Config()) -> tuple[DataFrame, DataFrame]:
    """(article scores, author scores) of nested pages."""
    scored = probreview.score_pages(probreview.prepared(pages), config)
    return probreview.article_scores(scored), probreview.author_scores(scored)


@dataclass
class Selection:
    by_citations: DataFrame
    by_weight: DataFrame
    overlap: DataFrame


def select_articles(articles: DataFrame, texts: DataFrame, k: int, w_quality: float = 0.7, w_citation: float = 0.3) -> Selection:
    """Both selections with their raw texts, and how far they agree."""
    one = selection.by_quality_then_citations(articles, k)
    two = selection.by_weighted_z(articles, k, w_quality, w_citation)
    return Selection(selection.with_raw_text(one, texts), selection.with_raw_text(two, texts), selection.overlap(one, two, k))


def labelled_sentences(pages: DataFrame, splitter=sentences.split_sentences) -> DataFrame:
    """Raw page texts to distinct labelled sentences."""
    nested = sentences.nested_sentences(sentences.page_sentences(sentences.page_paragraphs(pages), splitter))
    labelled = sentences.prefix_labels(sentences.flat_sentences(nested))
    ordered = labelled.withColumn("ordinal", F.struct("page_id", "paragraph_id", "index"))
    return curate.first_of_pairs(ordered.select("text", "label", "ordinal")).drop("ordinal")


def filtered_examples(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(examples within the length percentiles and the perplexity cutoff, length report, perplexity report)."""
    kept, lengths = curate.by_length_percentiles(rows)
    final, perplexities = curate.by_perplexity_cutoff(kept)
    return final, lengths, perplexities


def split_examples(rows: DataFrame, bins: int = 10, seed: int = 42) -> DataFrame:
    """Examples with length and perplexity bins and a stratified split."""
    binned = curate.with_bins(curate.with_bins(rows, "n_words", bins, "len_bin"), "perplexity_score", bins, "ppl_bin")
    return curate.stratified_split(binned, F.col("text"), curate.stratum(), seed=seed)


def run(spark: SparkSession, dump: str, bots: DataFrame, k: int) -> DataFrame:
    """From a dump to filtered, split examples of the k best articles, with the default perplexity model."""
    from ..operators.scoring import unigram_perplexity
    from ..sources.readers import read_dump

    revisions = revisions_from_dump(read_dump(spark, dump), bots)
    articles, _ = scores(page_histories(revisions))
    texts = history.latest_by_id(revisions, "raw_text", "ordinal").withColumn("page_id", F.col("page_id").cast("string"))
    chosen = select_articles(articles, texts, k).by_weight.select("page_id", "raw_text")
    # texts and labels are unique together, so that a digest of them stays the same however often the plan is run
    examples = labelled_sentences(chosen).withColumn("key", F.sha2(F.concat_ws(":", F.col("label").cast("string"), "text"), 256))
    final, _, _ = filtered_examples(unigram_perplexity(examples, "key"))
    return split_examples(final)
