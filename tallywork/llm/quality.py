"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of the whole text are standardised, clipped and mapped by random cosine features, which approximate a Gaussian
kernel. Ridge weights solve the normal equations, whose sums are taken over each partition and then over the partitions.
Raw scores of labelled rows held apart from the fit are counted in `BINS` bins, and pooling adjacent violators over the
bins gives the calibrated score.

Labels enter the fit alone. A null text counts as empty and is scored like any other; a null label is no label; rows that
share a doc_id share its labels, each label row counting once. Without any label all scores are 0.5. An empty table gives no
rows; keep_good() keeps further columns, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_bucket, materialize, read_table, run_dir

#: Random features; bins of the calibration; partitions that sum the normal equations.
FEATURES, BINS, SUMMERS = 256, 1024, 32
#: Byte classes whose shares of a text are statistics.
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b"\t\r", b"!?", b"|", b"#$%&*@", b".", b",;:", b"'\"", b"()[]{}", b"<>/\\", b"-_=+~^`", bytes(range(128, 256)))
NAMES = (*(f"class_{i}" for i in range(len(CLASSES))), "log_words", "log_chars", "word_mean", "word_std", "word_max", "distinct_words", "distinct_pairs", "distinct_lines", "words_a_line", "top_byte", "entropy", "capital_words", "edge_marks")


def _class_table() -> np.ndarray:
    t = np.zeros((256, len(CLASSES)))
    for i, chars in enumerate(CLASSES):
        t[list(chars), i] = 1
    return t


TABLE = _class_table()
LETTER = np.zeros(256, bool)
LETTER[[*CLASSES[0], *CLASSES[1], *CLASSES[2], *CLASSES[15]]] = True


def statistics(text: str | None) -> np.ndarray:
    """The statistics of NAMES for one whole text."""
    b = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    share = counts / max(1, len(b))
    words, lines = b.split(), [x for x in b.split(b"\n") if x]
    n = len(words)
    sizes = np.fromiter(map(len, words), np.int64, n) if n else np.zeros(1)
    some = share[share > 0]
    capitals = sum(map(bytes.isupper, words)) / max(1, n)
    if n:
        # Words that end in a mark that isn't a letter or digit.
        edges = 1 - LETTER[np.frombuffer(b"".join([w[-1:] for w in words]), np.uint8)].mean()
    else:
        edges = 0.0
    return np.array([
        *(share @ TABLE), np.log1p(n), np.log1p(len(b)), sizes.mean(), sizes.std(), np.log1p(sizes.max()),
        len(set(words)) / max(1, n), len(set(zip(words, words[1:], strict=False))) / max(1, n - 1), len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))),
        share.max(), float(-(some * np.log(some)).sum()), capitals, edges,
    ])


def statistics_column(text: str):
    @F.pandas_udf("array<double>")
    def stats(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts])

    return stats(F.coalesce(text, F.lit("")))


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and stats (array of double) of every document."""
    return docs.select("doc_id", statistics_column("text").alias("stats"))


class Model:
    """A fitted classifier: numbers only, so that tasks get it with their code."""

    def __init__(self, mean, scale, seed: int, weights=None, grid=None, levels=None):
        self.mean, self.scale, self.weights, self.grid, self.levels = mean, scale, weights, grid, levels
        rng = np.random.default_rng(seed)
        d = len(mean)
        self.w = rng.standard_normal((d, FEATURES)) * (1 / np.sqrt(d))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -4, 4)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b), np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), 0.5)
        r = self.raw(stats)
        # The calibration is a step function; a slight slope keeps the order of scores inside a step.
        s = np.interp(r, self.grid, self.levels) if self.grid is not None else r
        return np.clip(0.999 * s + 0.001 / (1 + np.exp(-np.clip(4 * r - 2, -30, 30))), 0.0, 1.0)


def stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, len(NAMES)))


def pool_violators(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The non-decreasing fit to y with weights w that is nearest in squares."""
    blocks: list[list[float]] = []
    for v, n in zip(y, w, strict=True):
        blocks.append([float(v), float(n), 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, n2, k2 = blocks.pop()
            v1, n1, k1 = blocks.pop()
            blocks.append([(v1 * n1 + v2 * n2) / (n1 + n2), n1 + n2, k1 + k2])
    return np.concatenate([np.full(k, v) for v, _, k in blocks]) if blocks else np.zeros(0)


def fit(labelled: DataFrame, ridge: float = 1e-3, seed: int = 11) -> Model:
    """Fit to rows (stats, label, fold); fold 0 calibrates, the others give the normal equations (all, if either is empty)."""
    d = len(NAMES)
    moments = labelled.agg(F.count("label").alias("n"), *(f(F.col("stats")[i]).alias(f"{k}{i}") for i in range(d) for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    if not moments["n"]:
        return Model(np.zeros(d), np.ones(d), seed)
    mean, scale = np.array([moments[f"m{i}"] for i in range(d)]), np.array([max(moments[f"s{i}"], 1e-6) for i in range(d)])
    model = Model(mean, scale, seed)
    apart = labelled.filter("fold != 0").limit(1).count() and labelled.filter("fold = 0").limit(1).count()

    def sums(batches):
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for pdf in batches:
            x = model.features(stacked(pdf["stats"]))
            total[:, :-1] += x.T @ x
            total[:, -1] += x.T @ pdf["label"].to_numpy(float)
        yield pd.DataFrame({"total": [total.tobytes()]})

    rows = labelled.filter("fold != 0") if apart else labelled
    total = sum(np.frombuffer(r["total"]).reshape(FEATURES + 1, FEATURES + 2) for r in rows.coalesce(SUMMERS).mapInPandas(sums, "total binary").collect())
    left = total[:, :-1].copy()
    n = left[-1, -1]
    left[np.diag_indices(FEATURES)] += ridge * n / FEATURES + 1e-6
    model.weights = np.linalg.solve(left + 1e-9 * np.eye(FEATURES + 1), total[:, -1])

    @F.pandas_udf("int")
    def bin_of(stats: pd.Series) -> pd.Series:
        return pd.Series(np.clip(np.floor((model.raw(stacked(stats)) + 0.5) / 2 * BINS), 0, BINS - 1).astype(np.int32))

    held = labelled.filter("fold = 0") if apart else labelled
    counted = held.select(bin_of("stats").alias("bin"), "label").groupBy("bin").agg(F.avg("label").alias("y"), F.count("*").alias("n")).orderBy("bin").toPandas()
    if len(counted) > 1:
        model.grid = (counted["bin"].to_numpy() + 0.5) / BINS * 2 - 0.5
        model.levels = pool_violators(counted["y"].to_numpy(float), counted["n"].to_numpy(float))
    return model


def labelled_rows(stats: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """stats, label and fold of the rows with a label."""
    known = labels.select(F.col("doc_id").alias("__id"), F.col(column).cast("double").alias("label")).filter("label is not null")
    fold = F.pmod(F.floor(id_bucket("doc_id", 1 << 30) / 3), F.lit(5)).cast("int")
    return stats.join(known, F.col("doc_id") == F.col("__id")).select("doc_id", "stats", "label", fold.alias("fold"))


def train(docs: DataFrame, labels: DataFrame, held_out=None, column: str = "quality") -> tuple[Model, DataFrame]:
    """The model, and the statistics of all docs. held_out: a Column over doc_id; labels where it is true are not read."""
    stats = materialize(with_statistics(docs), f"{run_dir(docs.sparkSession, 'quality')}/stats")
    return fit_labelled(stats, labels, held_out, column), stats


def fit_labelled(stats: DataFrame, labels: DataFrame, held_out=None, column: str = "quality") -> Model:
    rows = labelled_rows(stats, labels, column)
    if held_out is not None:
        rows = rows.filter(~held_out)
    return fit(materialize(rows, f"{run_dir(stats.sparkSession, 'quality')}/labelled"))


def score_column(model: Model, stats):
    @F.pandas_udf("double")
    def score(s: pd.Series) -> pd.Series:
        return pd.Series(model.score(stacked(s)))

    return score(stats)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without those that score below threshold; fitted on all labels. Statistics are worked out once and written with the rows."""
    rows = materialize(docs.withColumn("__stats", statistics_column("text")), f"{run_dir(docs.sparkSession, 'quality')}/rows")
    model = fit_labelled(rows.select("doc_id", F.col("__stats").alias("stats")), labels)
    return rows.filter(score_column(model, F.col("__stats")) >= threshold).select(*docs.columns)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = id_bucket("doc_id", 3) == 1
    model, stats = train(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), held)
    score = score_column(model, F.col("stats"))
    out = stats.select("doc_id", held.alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
