"""Model scoring with pluggable models.

A model is a factory that a worker calls once; batches of texts go to it through
Arrow. The default perplexity model is a smoothed unigram model whose counts are
a DataFrame aggregate, scored by joins, without Python.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_tokens
from .scalars import with_scalars


def unigram_counts(rows: DataFrame, text: str = "text") -> DataFrame:
    return rows.select(F.explode(word_tokens(text)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


#: A word with at least this share of all tokens is looked up without a shuffle; there are no more such words than its inverse.
FREQUENT = 1e-6
#: Rows without a word of their own in the join of the other words are dealt to so many keys, which no word equals.
DEALT = 4096


def unigram_perplexity(rows: DataFrame, key: str, counts: DataFrame | None = None, text: str = "text") -> DataFrame:
    """rows with perplexity_score: exp of the mean negative log of add-one probabilities; infinite without tokens.

    Frequent words are broadcast, so that they are summed up by text where they
    are read and a text sends one row for all of them. Other words are a row per
    text and word in the join, which adaptive execution splits where it is hot.
    """
    counts = counts if counts is not None else unigram_counts(rows, text)
    totals = counts.agg(F.sum("n").alias("total"), F.count("*").alias("types"))
    frequent = F.col("n") >= F.col("total") * FREQUENT
    rates = with_scalars(counts, totals).select("token", frequent.alias("frequent"), (-F.ln((F.col("n") + 1) / (F.col("total") + F.col("types") + 1))).alias("loss"))
    unseen = totals.select((-F.ln(1 / (F.col("total") + F.col("types") + 1))).alias("unseen"))
    hot, rare = rates.where("frequent").drop("frequent"), rates.where("not frequent").select(F.col("token").alias("_word"), F.col("loss").alias("_rare"))
    read = rows.select(key, F.explode(word_tokens(text)).alias("token")).join(F.broadcast(hot), "token", "left")
    dealt = F.concat(F.lit(" "), F.pmod(F.xxhash64(key), F.lit(DEALT)).cast("string"))
    word = F.when(F.col("loss").isNotNull(), dealt).otherwise(F.col("token")).alias("_word")
    used = read.groupBy(key, word).agg(F.sum("loss").alias("loss"), F.count("*").alias("k"))
    each = F.coalesce("loss", F.coalesce("_rare", "unseen") * F.col("k"))
    losses = with_scalars(used.join(rare, "_word", "left"), unseen).groupBy(key).agg((F.sum(each) / F.sum("k")).alias("_loss"))
    return rows.join(losses, key, "left").withColumn("perplexity_score", F.coalesce(F.exp("_loss"), F.lit(float("inf")))).drop("_loss")


Scorer = Callable[[list[str]], list[float]]


def with_scores(rows: DataFrame, factory: Callable[[], Scorer], text: str = "text", name: str = "perplexity_score", batch: int = 16) -> DataFrame:
    """rows with a score of each text by a model that each worker loads once.

    A MemoryError halves the batch, which stays halved; scores that are no
    number are infinite.
    """

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score, size = factory(), batch
        for part in parts:
            texts, out = part.fillna("").tolist(), []
            while len(out) < len(texts):
                try:
                    out += score(texts[len(out) : len(out) + size])
                except MemoryError:
                    if size == 1:
                        raise
                    size //= 2
            yield pd.Series([math.inf if x is None or not math.isfinite(x) else float(x) for x in out])

    return rows.withColumn(name, scored(text))


ANSWERS = "raw_response string, latency_s double, prompt_tokens long, completion_tokens long, error string"


def with_answers(rows: DataFrame, factory: Callable[[], Callable[[list[str]], list[dict]]], prompt: str = "prompt", batch: int = 64, retries: int = 3, wait_s: float = 0.5) -> DataFrame:
    """rows with a model's answers: batches are retried with growing waits, and a batch that fails in the end gives error rows.

    Answers stay beside their prompts within the batch, so that nothing is joined.
    """

    @F.pandas_udf(ANSWERS)
    def answered(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ask = factory()
        for part in parts:
            out: list[dict] = []
            for at in range(0, len(part), batch):
                prompts, begin = part[at : at + batch].tolist(), time.time()
                for attempt in range(retries):
                    try:
                        replies = ask(prompts)
                        break
                    except Exception as e:
                        if attempt + 1 == retries:
                            replies = [{"error": str(e)} for _ in prompts]
                        else:
                            time.sleep(wait_s * 2**attempt)
                each = (time.time() - begin) / max(1, len(prompts))
                out += [{"raw_response": r.get("text"), "latency_s": each, "prompt_tokens": r.get("prompt_tokens", 0), "completion_tokens": r.get("completion_tokens", 0), "error": r.get("error")} for r in replies]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ANSWERS.split(", ")])

    return rows.withColumn("_answer", answered(prompt)).select(*rows.columns, "_answer.*")


Tokenizer = Callable[[list[str]], list[list[int]]]


def library_tokenizer(path: str) -> Callable[[], Tokenizer]:
    """A factory of the tokenizer in a vocabulary file, special tokens included."""

    def load() -> Tokenizer:
        from tokenizers import Tokenizer as Library

        tokenizer = Library.from_file(path)
        return lambda texts: [e.ids for e in tokenizer.encode_batch(texts)]

    return load


def with_token_ids(rows: DataFrame, factory: Callable[[], Tokenizer], text: str = "text", most: int = 256, last: int | None = None) -> DataFrame:
    """rows with input_ids and attention_mask: a model's tokens, cut at most ids.

    last is an id that ends each text, also where it is cut. Texts are not
    padded: that is done by batch where they are used.
    """

    @F.pandas_udf("array<int>")
    def encoded(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = factory()
        for part in parts:
            ids = [list(i) for i in encode(part.fillna("").tolist())]
            yield pd.Series([i[:most] if last is None or len(i) <= most else [*i[: most - 1], last] for i in ids])

    ids = rows.withColumn("input_ids", encoded(text))
    return ids.withColumn("attention_mask", F.transform("input_ids", lambda _: F.lit(1)))


def fine_tuned(train: DataFrame, trainer: Callable, columns: tuple[str, ...] = ("text", "label"), batch: int = 1024):
    """What trainer returns for an iterator factory over batches of the columns (lists, in their order).

    Batches come to the driver one partition at a time, as training on a single
    machine takes them; an epoch is one call of the factory. The model is then
    used by with_predictions() on all workers.
    """

    def batches():
        held: list[list] = [[] for _ in columns]
        for row in train.select(*columns).toLocalIterator(prefetchPartitions=False):
            for values, value in zip(held, row):
                values.append(value)
            if len(held[0]) == batch:
                yield tuple(held)
                held = [[] for _ in columns]
        if held[0]:
            yield tuple(held)

    return trainer(batches)


def with_predictions(rows: DataFrame, model: Callable[[list[str]], list[list[float]]], text: str = "text", name: str = "logits") -> DataFrame:
    """rows with a model's logits of each text; the model goes to the workers with the plan."""

    @F.pandas_udf("array<double>")
    def predicted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([[float(x) for x in logits] for logits in model(part.fillna("").tolist())])

    return rows.withColumn(name, predicted(text))
