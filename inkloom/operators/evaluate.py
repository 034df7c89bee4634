"""Evaluation of binary classifiers over stored predictions, and prompts for them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import digitize, ratio
from ..functions.text import truncated
from .quantiles import quantile_edges
from .scalars import with_scalars

METRICS = ("accuracy", "macro_f1", "weighted_f1", "precision", "recall", "f1", "precision_neg", "recall_neg", "f1_neg", "support_neg", "precision_pos", "recall_pos", "f1_pos", "support_pos")


def _rate(a: Column, b: Column) -> Column:
    return F.coalesce(ratio(a, b), F.lit(0.0))


def metrics_of(rows: DataFrame, *by: str, label: str = "label", prediction: str = "pred_label") -> DataFrame:
    """All METRICS from one pass over the confusion counts, for each group.

    Undefined rates are 0. The macro and weighted means take the classes that
    occur among labels or predictions alone. Groups without rows give nulls.
    """
    y, p = F.col(label), F.col(prediction)
    cells = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
    counts = [F.count_if((y == a) & (p == b)).alias(n) for n, (a, b) in cells.items()]
    table = rows.groupBy(*by).agg(*counts) if by else rows.agg(*counts)
    tn, fp, fn, tp = (F.col(n) for n in cells)
    n = tn + fp + fn + tp
    out = {
        "precision_pos": _rate(tp, tp + fp),
        "recall_pos": _rate(tp, tp + fn),
        "f1_pos": _rate(2 * tp, 2 * tp + fp + fn),
        "support_pos": tp + fn,
        "precision_neg": _rate(tn, tn + fn),
        "recall_neg": _rate(tn, tn + fp),
        "f1_neg": _rate(2 * tn, 2 * tn + fp + fn),
        "support_neg": tn + fp,
        "accuracy": ratio(tp + tn, n),
    }
    table = table.withColumns(out)
    has_pos, has_neg = (tp + fp + fn > 0).cast("int"), (tn + fp + fn > 0).cast("int")
    means = {
        "macro_f1": ratio(F.col("f1_pos") * has_pos + F.col("f1_neg") * has_neg, has_pos + has_neg),
        "weighted_f1": ratio(F.col("f1_pos") * F.col("support_pos") + F.col("f1_neg") * F.col("support_neg"), n),
        "precision": F.col("precision_pos"),
        "recall": F.col("recall_pos"),
        "f1": F.col("f1_pos"),
    }
    named = table.withColumns(means)
    empty = {m: F.when(n > 0, F.col(m)).otherwise(None) for m in METRICS if not m.startswith("support")}
    return named.withColumns(empty).select(*by, *METRICS)


def rounded(metrics: DataFrame, places: int = 8) -> DataFrame:
    return metrics.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in metrics.dtypes))


def metrics_with_coverage(rows: DataFrame, *by: str) -> DataFrame:
    """METRICS of the rows with a valid prediction, and the share of these; all null if there are none."""
    valid = F.coalesce(F.col("pred_label").isin(0, 1), F.lit(False))
    coverage = F.round(_rate(F.count_if(valid), F.count("*")), 10).alias("valid_coverage")
    marked = rows.withColumn("pred_label", F.when(valid, F.col("pred_label")))
    if by:
        return metrics_of(marked, *by).join(rows.groupBy(*by).agg(coverage), list(by))
    return with_scalars(metrics_of(marked), rows.agg(coverage))


def metrics_by_bin(rows: DataFrame, column: str, bins: int, edges_from: DataFrame | None = None) -> DataFrame:
    """metrics_with_coverage of each quantile bin with its edges and support; empty bins have null metrics.

    edges_from gives the frame whose quantiles bound the bins: train edges for
    all splits, or each frame's own.
    """
    edges = quantile_edges(edges_from if edges_from is not None else rows, column, bins)
    bounds = edges.select(F.posexplode(F.slice("edges", F.lit(1), F.size("edges") - 1)).alias("bin", "edge_low"), "edges").select("bin", "edge_low", F.get("edges", F.col("bin") + 1).alias("edge_high"))
    binned = with_scalars(rows, edges).withColumn("bin", digitize(F.col(column).cast("double"), F.col("edges"))).drop("edges").where("bin is not null")
    support = binned.groupBy("bin").agg(F.count("*").alias("support_total"))
    found = metrics_with_coverage(binned, "bin").join(support, "bin")
    return bounds.join(found, "bin", "left").fillna(0, ["support_total", "support_neg", "support_pos"])  # a row for each bin


def runtime_summary(rows: DataFrame, elapsed_s: float) -> DataFrame:
    """Latency, throughput, token and error figures of a run."""
    tokens = F.coalesce(F.sum("prompt_tokens"), F.lit(0)) + F.coalesce(F.sum("completion_tokens"), F.lit(0))
    n = F.count("*")
    per_second = lambda x: F.round(x / F.lit(float(elapsed_s)), 10) if elapsed_s > 0 else F.lit(0.0)
    return rows.agg(
        n.alias("num_samples"),
        F.lit(float(elapsed_s)).alias("elapsed_s"),
        F.round(F.coalesce(F.avg("latency_s"), F.lit(0.0)), 10).alias("avg_latency_s"),
        per_second(n).alias("samples_per_second"),
        per_second(tokens).alias("tokens_per_second"),
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"),
        F.round(_rate(F.count_if(~F.coalesce(F.col("pred_label").isin(0, 1), F.lit(False))), n), 10).alias("parse_fail_rate"),
        F.round(_rate(F.count_if(F.col("error").isNotNull()), n), 10).alias("error_rate"),
    )


def benchmark_order(results: DataFrame, *columns: str) -> DataFrame:
    """Runs, best first by the columns."""
    return results.orderBy(*(F.desc_nulls_last(c) for c in columns or ("macro_f1", "accuracy", "samples_per_second")))


def run_status(log: DataFrame) -> DataFrame:
    """Files, pages and revisions by status of a run log (status, page_count, revision_count)."""
    return log.groupBy("status").agg(F.count("*").alias("files"), F.coalesce(F.sum("page_count"), F.lit(0)).alias("pages"), F.coalesce(F.sum("revision_count"), F.lit(0)).alias("revisions"))


def exemplars(pool: DataFrame, k: int, most: int = 240) -> DataFrame:
    """The first k valid examples (ordinal, text, label) after truncation."""
    short = truncated(F.col("text"), most)
    return pool.withColumn("text", short).where("text <> '' and label in (0, 1)").orderBy("ordinal").limit(k)


def example_block(chosen: DataFrame, title: str) -> DataFrame:
    """One row: the examples as numbered lines under a title, or an empty text without any."""
    listed = chosen.agg(F.array_sort(F.collect_list(F.struct("ordinal", "text", "label"))).alias("e"))
    lines = F.transform("e", lambda x, i: F.concat_ws("\n", F.concat(F.lit("["), i + 1, F.lit("] text: "), x["text"]), F.concat(F.lit("["), i + 1, F.lit("] label: "), x["label"].cast("string"))))
    return listed.select(F.when(F.size("e") > 0, F.concat_ws("\n", F.lit(title), F.array_join(lines, "\n"))).otherwise("").alias("block"))


def with_prompt(rows: DataFrame, template: dict[str, str], examples: DataFrame, most: int = 2000) -> DataFrame:
    """rows with `prompt`: task, instruction, output rule, examples and input, in a fixed order.

    template has task, instruction, rule, input and label; examples is example_block's single row.
    """
    head = "\n".join(template[k] for k in ("task", "instruction", "rule"))
    blocks = F.when(F.col("block") == "", F.lit(head)).otherwise(F.concat_ws("\n", F.lit(head), F.lit(""), F.col("block")))
    prompt = F.concat_ws("\n", blocks, F.lit(""), F.concat(F.lit(template["input"] + ": "), truncated(F.col("text"), most)), F.lit(template["label"] + ": "))
    return with_scalars(rows, examples).withColumn("prompt", prompt).drop("block")


def chat_text(messages: Column) -> Column:
    """Messages (role, content) as text where a model has no chat template."""
    turns = F.transform(messages, lambda m: F.concat(F.upper(m["role"]), F.lit(": "), m["content"]))
    return F.concat(F.array_join(turns, "\n\n"), F.lit("\n\nASSISTANT:"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Splits, predictions or shards together; columns that some lack are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
