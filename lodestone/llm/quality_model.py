"""Quality classifier: random Fourier features, ridge by summed normal equations, isotonic calibration."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import durable
from .quality_rules import ratios, text_statistics

#: Number of cosine features, width of the Gaussian kernel in standard deviations, ridge penalty, seed.
WAVES, WIDTH, PENALTY, SEED = 192, 2.5, 1.0, 7
#: Raw scores are counted in at most so many bins for the calibration.
BINS = 256


def statistics_vector(stats) -> dict:
    """Document statistics on scales where equal steps matter alike; from the text alone, zero for empty texts."""
    f = ratios(stats)
    log = {"n_words", "line_words", "symbols", "marks"}
    return {k: F.log1p(c * (100 if k in ("symbols", "marks") else 1)) if k in log else c for k, c in f.items()}


class Waves:
    """z(x) = sqrt(2 / D) cos(Wx + b) and a constant; inner products approximate a Gaussian kernel (fixed seed)."""

    def __init__(self, mean: list[float], scale: list[float]):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = np.array(mean), np.array(scale)
        self.w = rng.normal(0.0, 1.0 / WIDTH, (len(mean), WAVES))
        self.b = rng.uniform(0.0, 2 * np.pi, WAVES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -6.0, 6.0)
        z = np.sqrt(2.0 / WAVES) * np.cos(x @ self.w + self.b)
        return np.hstack([z, np.ones((len(x), 1))])


def _matrix(batch, names) -> np.ndarray:
    return np.stack([batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names], axis=1)


def pool_adjacent(x: list[float], y: list[float], n: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing fit to the means ``y`` with weights ``n`` at ascending ``x``: knots and values."""
    blocks: list[list[float]] = []  # sum of y, weight, sum of x
    for a, b, w in zip(x, y, n):
        blocks.append([b * w, w, a * w])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


class Model:
    """Weights of the ridge and the calibration curve; a fixed size."""

    def __init__(self, names, waves, weights, knots, values):
        self.names, self.waves, self.weights, self.knots, self.values = names, waves, weights, knots, values

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.waves(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        step = np.interp(raw, self.knots, self.values) if len(self.knots) else np.clip(raw, 0, 1)
        return np.clip(0.99 * step + 0.01 * np.clip(raw, 0, 1), 0.0, 1.0)  # the small part orders what the steps tie


def fit_quality(rows: DataFrame, labelled: DataFrame, names: list[str]) -> Model:
    """Fits on ``labelled``: the statistics, ``good`` (0 to 1) and ``part`` (calibrate or not). A repeated row counts again.

    Means and deviations come from all ``rows``. Each partition of the labelled rows adds up Z'Z and Z'y, and the sums
    meet in a grouped sum by matrix row; the driver gets one matrix of fixed size. The calibration counts raw scores of
    labelled rows that the ridge hasn't seen in quantile bins and pools adjacent violators. Without labels every score
    is 0.5.
    """
    moments = rows.agg(*[F.avg(n).alias(f"m_{n}") for n in names], *[F.stddev_pop(n).alias(f"s_{n}") for n in names]).first()
    waves = Waves([moments[f"m_{n}"] or 0.0 for n in names], [moments[f"s_{n}"] or 1.0 for n in names])
    size = WAVES + 1

    def summed(batches):
        a, b = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            z, y = waves(_matrix(batch, names)), batch.column(batch.schema.get_field_index("good")).to_numpy().astype(float)
            a += z.T @ z
            b += z.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(np.hstack([a, b[:, None]]).tolist(), pa.list_(pa.float64()))], ["i", "row"])

    parts = labelled.where(~F.col("part")).select(*names, "good").mapInArrow(summed, "i int, row array<double>")
    width = size + 1
    total = parts.groupBy("i").agg(F.array(*[F.sum(F.get("row", F.lit(j))) for j in range(width)]).alias("row")).orderBy("i").collect()
    if not total or not any(map(any, (r.row for r in total))):
        return Model(names, waves, np.r_[np.zeros(WAVES), 0.5], np.zeros(0), np.zeros(0))
    whole = np.array([r.row for r in total])
    ridge = PENALTY * np.eye(size)
    ridge[-1, -1] = 1e-6
    model = Model(names, waves, np.linalg.solve(whole[:, :size] + ridge, whole[:, size]), np.zeros(0), np.zeros(0))
    at = [*names, "good"]

    def scored(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(_matrix(batch, names))), batch.column(batch.schema.get_field_index("good")).cast(pa.float64())], ["raw", "good"])

    held = labelled.where("part").select(*at).mapInArrow(scored, "raw double, good double")
    cuts = sorted(set(held.agg(F.percentile_approx("raw", [k / BINS for k in range(1, BINS)], 5000)).first()[0] or []))
    if cuts:
        def binned(batches):
            for batch in batches:
                k = np.searchsorted(cuts, batch.column(0).to_numpy(), side="right")
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), batch.column(0), batch.column(1)], ["k", "raw", "good"])

        bins = held.mapInArrow(binned, "k long, raw double, good double").groupBy("k").agg(F.avg("raw").alias("x"), F.avg("good").alias("y"), F.count("*").alias("n")).orderBy("k").collect()
        model.knots, model.values = pool_adjacent([r.x for r in bins], [r.y for r in bins], [float(r.n) for r in bins])
    return model


def score_quality(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", folds: int = 5, held_fold: int = 0) -> DataFrame:
    """(key, held_out, score) for every row of ``docs``; score near 1: the text is likely of good quality.

    Labels (key, quality) of rows whose crc32(key as text) mod ``folds`` is ``held_fold`` aren't learned from; the next
    fold below (mod ``folds``) calibrates and the others fit the ridge. Only the text enters a score. Null and empty
    texts are scored by their (zero) statistics. Rows with a null key are scored and count as not held out.
    """
    v = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    stats = text_statistics(v)
    f = statistics_vector(F.col(stats.columns[-1]))
    names = list(f)
    rows = durable(stats.select("key", *[c.cast("double").alias(n) for n, c in f.items()]), "statistics")
    fold = F.crc32(F.col("key").cast("string").cast("binary")) % folds
    marks = labels.where(F.col("quality").isNotNull()).groupBy(F.col(key).alias("mark")).agg(F.avg("quality").alias("good"))
    known = rows.join(marks.where((F.crc32(F.col("mark").cast("string").cast("binary")) % folds) != held_fold), F.col("key") == F.col("mark"), "inner")
    known = known.select(*names, "good", (fold == (held_fold - 1) % folds).alias("part"))
    model = fit_quality(rows, durable(known, "known"), names)

    def scored(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.score(_matrix(batch, names)))], ["key", "held_out", "score"])

    kind = docs.schema[key].dataType.simpleString()
    held = F.coalesce(fold == held_fold, F.lit(False)).alias("held_out")
    return rows.select("key", held, *names).mapInArrow(scored, f"key {kind}, held_out boolean, score double").withColumnRenamed("key", key)


def op10_quality_model(spark, sf_dir: str) -> DataFrame:
    """The operator over all documents with all quality labels outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
