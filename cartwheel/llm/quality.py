"""Document quality with hierarchical empirical Bayes.

A logistic classifier over counts of characters, words and lines gives each
document its own evidence ``p``. Host and path carry evidence too: grouped sums of
``p`` give the share of good documents of the corpus, of each host and of each
path (host and language). A host's posterior share is shrunk toward the corpus,
a path's toward its host,

    share = (sum + strength * share above) / (rows + strength),

with strengths estimated from how much shares differ beyond sampling noise, so
that a site of a few pages says little. Each row counts for its site without
itself. The document's posterior log odds are its own plus the difference that
the site makes, and rows under ``reject`` are rejected.

The classifier is fitted on at most ``train_rows`` labelled rows, those with the
smallest hash of their id; everything else covers all rows. Without labels of
both kinds the evidence is 0.5 for all and nothing is rejected.

Host and path are columns that the caller names; ``documents`` has no url, so by
default the source stands in for the host and the language for the path. Null texts
count as empty, null host and path are values of their own; rows are judged one by
one, so repeated rows get equal verdicts and a null or repeated id changes nothing.
Other columns, whatever their names, are neither read nor lost; an empty table gives
no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwheel.llm.rows import row_digest, texts, without
from cartwheel.session import written

TRAIN_ROWS = 20_000
REJECT = 0.3
STEPS = 40
CLIP = 20.0
_EPS = 1e-6


def features(text: str) -> list[float]:
    """Shares of kinds of characters, and how often words and lines repeat."""
    raw = np.frombuffer(text.encode(), np.uint8)
    n = max(len(raw), 1)
    seen = np.bincount(raw, minlength=256)
    upper, lower, digit = seen[65:91].sum(), seen[97:123].sum(), seen[48:58].sum()
    stops, high = seen[44] + seen[46], seen[128:].sum()
    other = len(raw) - upper - lower - digit - seen[32] - seen[10] - high - stops
    words = text.split()
    m = max(len(words), 1)
    counts = Counter(words)
    lines = text.split("\n")
    return [
        float(np.log1p(len(text))),
        upper / n,
        digit / n,
        seen[32] / n,
        other / n,
        seen[10] / n,
        high / n,
        stops / n,
        seen[33] / n,
        seen[124] / n,
        float(np.log1p(len(words))),
        len(text) / m / 10,
        len(counts) / m,
        max(counts.values(), default=0) / m,
        len(set(lines)) / len(lines),
    ]


@dataclass(frozen=True)
class Model:
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.center) / self.scale, -CLIP, CLIP)
        return np.concatenate([z, z * z, np.ones((len(z), 1))], axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.inputs(x) @ self.weights, -30, 30)))


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Model:
    """Logistic regression on features and their squares.

    Newton steps, each halved until the penalised loss falls: the loss is convex,
    so that leads to its minimum also where the labels can be told apart exactly.
    """
    start = Model(x.mean(axis=0), x.std(axis=0) + 1e-9, np.zeros(2 * x.shape[1] + 1))
    z, w = start.inputs(x), start.weights

    def loss(v: np.ndarray) -> float:
        odds = z @ v
        return float(np.sum(np.logaddexp(0.0, odds) - y * odds) + ridge / 2 * v @ v)

    now = loss(w)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) + ridge * w
        bend = (z.T * (p * (1 - p))) @ z + ridge * np.eye(len(w))
        move, size = np.linalg.solve(bend, slope), 1.0
        while (then := loss(w - size * move)) > now and size > 1e-6:
            size /= 2
        if then >= now - 1e-9 * abs(now):
            break
        w, now = w - size * move, then
    return Model(start.center, start.scale, w)


def measured(docs: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """doc_id, host, path, row digest and features of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(text) for _, text in texts(batch)]
            columns = [batch.column(0), *batch.columns[2:], pa.array(found, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "host", "path", "row_digest", "features"])

    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.col(f"`{host}`").cast("string").alias("host"),
        F.col(f"`{path}`").cast("string").alias("path"),
        row_digest(F.col("doc_id").cast("long"), F.col(f"`{host}`"), F.col(f"`{path}`")).alias("row_digest"),
    )
    return slim.mapInArrow(run, "doc_id long, host string, path string, row_digest binary, features array<double>")


def trained(rows: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model | None:
    """The classifier of at most ``train_rows`` labelled rows, None without both kinds of labels."""
    known = labels.where("quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.col("quality").cast("int")).alias("quality")
    )
    sample = rows.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows).select("features", "quality")
    found = sample.toArrow()
    y = found.column("quality").to_numpy().astype(float)
    if len(np.unique(y)) < 2:
        return None
    x = np.stack(found.column("features").combine_chunks().flatten().to_numpy().reshape(len(y), -1))
    return fitted(x, y)


def evidence(rows: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, host, path, row digest and the probability ``p`` that a document is good, by itself."""
    known = ["doc_id", "host", "path", "row_digest"]
    if model is None:
        return rows.select(*known, F.lit(0.5).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            p = model.probability(x) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(p)], [*known, "p"])

    made = "doc_id long, host string, path string, row_digest binary, p double"
    return rows.select(*known, "features").mapInArrow(run, made)


def _strength(groups: DataFrame, share: str, above: str) -> Column:
    """Prior rows that explain how little the groups' shares differ, from the moments.

    Between groups the variance is what exceeds the sampling variance; the
    strength is the one of a Beta prior with that variance.
    """
    mean = F.sum(F.col("rows") * F.col(above)) / F.sum("rows")
    weight = F.sum("rows")
    seen = F.sum(F.col("rows") * F.pow(F.col(share) - F.col(above), 2)) / weight
    noise = F.sum(F.col("sum_pq")) / weight / F.greatest(weight / F.count("*"), F.lit(1.0))
    between = F.greatest(seen - noise, F.lit(_EPS))
    return groups.agg(F.greatest(mean * (1 - mean) / between - 1, F.lit(1.0)).alias("strength")).select("strength").first()[0]


def sites(scored: DataFrame) -> tuple[DataFrame, float, float]:
    """Sums per host and path with the host's posterior share; the corpus' share and the paths' strength."""
    p = F.col("p")
    per_path = written(
        scored.groupBy("host", "path").agg(
            F.count("*").alias("rows"), F.sum("p").alias("sum_p"), F.sum(p * (1 - p)).alias("sum_pq")
        ),
        "paths",
    )
    total = per_path.agg(F.sum("sum_p").alias("s"), F.sum("rows").alias("n")).first()
    share = min(max((total.s or 0.0) / max(total.n or 0, 1), _EPS), 1 - _EPS)
    per_host = per_path.groupBy("host").agg(
        F.sum("rows").alias("rows"), F.sum("sum_p").alias("sum_p"), F.sum("sum_pq").alias("sum_pq")
    )
    per_host = per_host.select("*", (F.col("sum_p") / F.col("rows")).alias("own"), F.lit(share).alias("above"))
    strength = _strength(per_host, "own", "above") or 1.0
    host_share = (F.col("sum_p") + strength * share) / (F.col("rows") + strength)
    hosts = per_host.select(F.col("host").alias("of_host"), host_share.alias("host_share"))
    paths = per_path.join(hosts, F.col("host").eqNullSafe(F.col("of_host"))).drop("of_host")
    inner = paths.select("*", (F.col("sum_p") / F.col("rows")).alias("own"))
    return paths, share, _strength(inner, "own", "host_share") or 1.0


def _logit(x: Column) -> Column:
    x = F.least(F.greatest(x, F.lit(_EPS)), F.lit(1 - _EPS))
    return F.log(x / (1 - x))


def judged(
    docs: DataFrame,
    labels: DataFrame,
    train_rows: int = TRAIN_ROWS,
    reject: float = REJECT,
    host: str = "source",
    path: str = "lang",
) -> DataFrame:
    """doc_id, host, path, p, site_share, posterior, kept and digest of every row.

    ``host`` and ``path`` name the columns of the two levels.
    """
    rows = written(measured(docs, host, path), "quality-features")
    scored = written(evidence(rows, trained(rows, labels, train_rows)), "quality-evidence")
    paths, share, strength = sites(scored)
    known = paths.select(
        F.col("host").alias("of_host"), F.col("path").alias("of_path"), F.col("rows").alias("n"), "sum_p", "host_share"
    )
    at = F.col("host").eqNullSafe(F.col("of_host")) & F.col("path").eqNullSafe(F.col("of_path"))
    # Without the row itself, else a page alone on its path would count twice.
    site = (F.col("sum_p") - F.col("p") + strength * F.col("host_share")) / (F.col("n") - 1 + strength)
    posterior = 1 / (1 + F.exp(-(_logit(F.col("p")) + _logit(F.col("site_share")) - _logit(F.lit(share)))))
    return (
        scored.join(known, at)
        .withColumn("site_share", site)
        .withColumn("posterior", posterior)
        .withColumn("kept", F.col("posterior") >= reject)
        .select("doc_id", "host", "path", "p", "site_share", "posterior", "kept", "row_digest")
    )


def accepted(
    docs: DataFrame,
    labels: DataFrame,
    train_rows: int = TRAIN_ROWS,
    reject: float = REJECT,
    host: str = "source",
    path: str = "lang",
) -> DataFrame:
    """The documents that are not rejected, with all their columns.

    Rows are told apart by id, text, host and path: nothing else goes into a
    verdict, so null and repeated ids are judged row by row.
    """
    digest = row_digest(F.col("doc_id").cast("long"), F.col(f"`{host}`"), F.col(f"`{path}`"))
    return without(docs, judged(docs, labels, train_rows, reject, host, path), digest)
