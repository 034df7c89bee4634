"""Article and author scores from token lineage and review graphs.

A page is a row with all its revisions, so that pages are scored where they lie:
no shuffle, and of a batch of pages one revision's tokens are read at a time. Authors are then aggregated with
partial sums before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_tokens
from .history import safe_username


@dataclass(frozen=True)
class Config:
    # The defaults of the method.
    scheme: str = "S2"
    alpha: float = 7.0
    max_iter: int = 100
    tol: float = 1e-6

    def __post_init__(self):
        if self.scheme not in ("S1", "S2", "S3"):
            raise ValueError(f"unknown decay scheme {self.scheme}")


def decayed(distance: np.ndarray, config: Config) -> np.ndarray:
    alpha = max(config.alpha, 1e-12)
    if config.scheme == "S1":
        return np.exp(-distance / alpha)
    if config.scheme == "S2":
        return 1 / (np.maximum(distance - config.alpha, 0) + 1)
    return 1 / (1 + (distance / alpha) ** 2)


def nearest(places: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Distance of each place to the nearest of the sorted anchors."""
    right = np.searchsorted(anchors, places).clip(0, len(anchors) - 1)
    left = (right - 1).clip(0)
    return np.minimum(np.abs(anchors[right] - places), np.abs(places - anchors[left]))


@dataclass
class Lineage:
    """The final tokens' authors and their reviewers' probabilities."""

    author: np.ndarray  # user number of each final token
    review: dict[int, np.ndarray]  # by user number: probability for each final token
    users: list[str]


def lineage(revisions: Iterable[tuple[str, list[str]]], config: Config) -> Lineage:
    """Follow tokens over (user, tokens) revisions in order.

    State is kept for the current revision's tokens alone, as arrays: what is
    deleted is gone, what is new starts with its author and no reviewers.
    """
    numbers: dict[str, int] = {}
    tokens: list[str] = []
    author = np.empty(0, np.int64)
    missed: dict[int, np.ndarray] = {}  # by user: probability that no review of theirs touched the token
    for user, current in revisions:
        me = numbers.setdefault(user, len(numbers))
        codes = SequenceMatcher(a=tokens, b=current, autojunk=False).get_opcodes()
        source = np.full(len(current), -1, np.int64)
        edits = []
        for tag, i1, i2, j1, j2 in codes:
            if tag == "equal":
                source[j1:j2] = np.arange(i1, i2)
            else:
                edits.append(np.arange(j1, max(j2, j1 + 1)))
        old = source >= 0
        author = np.where(old, author[source] if len(author) else me, me)
        for u, m in list(missed.items()):
            carried = np.ones(len(current))
            carried[old] = m[source[old]]
            missed[u] = carried
        if edits and old.any():
            p = decayed(nearest(np.flatnonzero(old), np.concatenate(edits)).astype(np.float64), config)
            mine = missed.setdefault(me, np.ones(len(current)))
            mine[old] *= 1 - p
        tokens = current
    names = sorted(numbers, key=numbers.get)
    return Lineage(author, {u: 1 - m for u, m in missed.items()}, names)


def solved(found: Lineage, config: Config) -> tuple[float, dict[str, float], int, bool]:
    """(quality, user scores, iterations, converged) of the coupled iteration on the token-user graph."""
    n = len(found.author)
    rows, columns, weights = [np.arange(n)], [found.author], [np.ones(n)]
    for user, p in found.review.items():
        some = np.flatnonzero(p > 0)
        rows.append(some)
        columns.append(np.full(len(some), user))
        weights.append(p[some])
    row, column, weight = map(np.concatenate, (rows, columns, weights))
    taking_part = sorted(np.unique(column).tolist(), key=lambda u: found.users[u])
    place = {u: i for i, u in enumerate(taking_part)}
    column = np.fromiter((place[u] for u in column.tolist()), np.int64, len(column))
    users = len(taking_part)
    unit = lambda x: x / s if (s := np.abs(x).sum()) > 0 else x
    quality_of = lambda a: np.bincount(row, weight * a[column], n)
    a, q = unit(np.ones(users)), unit(np.ones(n))
    converged, steps = False, 0
    for steps in range(1, config.max_iter + 1):
        q_next = unit(quality_of(a))
        a_next = unit(np.bincount(column, weight * q_next[row], users))
        close = np.abs(q_next - q).sum() < config.tol and np.abs(a_next - a).sum() < config.tol
        q, a = q_next, a_next
        if close:
            converged = True
            break
    return float(quality_of(a).sum()), {found.users[u]: float(a[place[u]]) for u in taking_part}, steps, converged


def score_page(revisions: list[tuple[str, list[str]]], config: Config = Config()) -> tuple | None:
    """(n_tokens, n_users, iterations, converged, quality, user_scores), or None for a page without revisions or final tokens."""
    if not revisions or not revisions[-1][1]:
        return None
    return _scored(revisions, config)


def _scored(revisions: Iterable[tuple[str, list[str]]], config: Config) -> tuple:
    found = lineage(revisions, config)
    quality, users, steps, converged = solved(found, config)
    return len(found.author), len(users), steps, converged, quality, users


SCORES = "page_id string, title string, quality_score double, n_tokens long, n_users long, iterations long, converged boolean, citation_count long, user_scores map<string,double>"


def prepared(pages: DataFrame, text: str = "clean_text") -> DataFrame:
    """Nested pages with only what scoring needs: names and tokens, by timestamp, and the last citation count."""
    last = F.try_element_at("revisions", F.lit(-1))["citation_count"]
    return pages.select(
        F.col("page_id").cast("string"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce(last.cast("string").try_cast("long"), F.lit(0)).alias("citation_count"),
        F.transform("revisions", lambda r: safe_username(r["username"], r["user_id"])).alias("names"),
        F.transform("revisions", lambda r: F.coalesce(word_tokens(r[text]), F.array().cast("array<string>"))).alias("tokens"),
    )


# Fixed value: user scores in a batch of results, beyond which the next page begins another.
BATCH_USERS = 10_000
_RESULT = pa.schema({c: {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "boolean": pa.bool_()}.get(t, pa.map_(pa.string(), pa.float64())) for c, t in map(str.split, SCORES.split(", "))})


def page_scores(batch: pa.RecordBatch, config: Config) -> Iterator[tuple]:
    """Rows of SCORES of the pages of a batch, which stays in Arrow: tokens are Python strings for one revision at a time."""
    for row in range(batch.num_rows):
        page, title, citations, names, tokens = (batch.column(c)[row] for c in ("page_id", "title", "citation_count", "names", "tokens"))
        if names.values is None or not len(names) or not len(tokens.values[-1].values):
            continue
        n_tokens, n_users, steps, converged, quality, users = _scored(((u.as_py(), t.values.to_pylist()) for u, t in zip(names.values, tokens.values)), config)
        yield page.as_py(), title.as_py(), round(quality, 8), n_tokens, n_users, steps, converged, citations.as_py(), list(users.items())


def score_pages(pages: DataFrame, config: Config = Config()) -> DataFrame:
    """Scores of prepared pages; those without revisions or final tokens give no row."""

    def result(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), _RESULT)], schema=_RESULT)

    def score(batches):
        for batch in batches:
            rows, users = [], 0
            for row in page_scores(batch, config):
                rows.append(row)
                users += row[4]
                if users > BATCH_USERS:
                    yield result(rows)
                    rows, users = [], 0
            if rows:
                yield result(rows)

    columns = pages.select("page_id", "title", "citation_count", "names", "tokens")
    return columns.mapInArrow(score, SCORES)


def article_scores(scores: DataFrame) -> DataFrame:
    """Articles by quality, best first."""
    return scores.drop("user_scores").orderBy(F.desc("quality_score"), "page_id")


def author_scores(scores: DataFrame) -> DataFrame:
    """Mean page score of each author, best first."""
    shares = scores.select(F.explode("user_scores").alias("username", "score"))
    mean = shares.groupBy("username").agg(F.round(F.sum("score") / F.count("*"), 8).alias("score"), F.count("*").alias("pages"))
    return mean.orderBy(F.desc("score"), "username")
