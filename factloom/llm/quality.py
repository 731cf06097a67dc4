"""Quality classifier: random Fourier features over document statistics.

The statistics of a text (shares of byte classes, word lengths, repetition)
are standardised and mapped through ``features`` random Fourier features that
approximate a Gaussian kernel.  Ridge scores come from normal equations that
each partition sums on its own; isotonic regression on a part of the sample
kept from the ridge fit turns them into probabilities.

Empty and null texts have all-zero statistics and are scored like any other.
Without labels of both classes every score is the mean label, or 0.5 without
labels.  Scores depend on the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import SLICE, _words, long_text_words, mix, text_bytes
from .storage import discard, materialize
from .supervised import SAMPLE_ROWS, fold, labelled, with_scores

_CLASS = np.full(256, 8, np.uint8)  # other ASCII punctuation
for _k, _chars in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:", b"!?", b"#*$%&|<>"]):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 9
CLASSES = 10
STATISTICS = CLASSES + 9


def _row(hist: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(STATISTICS)
    n, total = len(hashes), hist.sum()
    if total:
        out[:CLASSES] = np.sqrt(hist / total)
    if n:
        _, counts = np.unique(hashes, return_counts=True)
        out[CLASSES] = np.log1p(n)
        out[CLASSES + 1] = np.log1p(lengths.mean())
        out[CLASSES + 2] = np.log1p(lengths.std())
        out[CLASSES + 3] = np.log1p(lengths.max())
        out[CLASSES + 4] = np.log1p(len(counts)) / np.log1p(n)
        out[CLASSES + 5] = np.sqrt(counts.max() / n)
        out[CLASSES + 6] = np.sqrt((hashes[1:] == hashes[:-1]).mean()) if n > 1 else 0
        if n > 3:
            roll = mix(hashes[:-3] + mix(hashes[1:-2] + mix(hashes[2:-1] + mix(hashes[3:]))))
            out[CLASSES + 7] = np.sqrt(1 - len(np.unique(roll)) / len(roll))
        out[CLASSES + 8] = np.sqrt((lengths == 1).mean())
    return out


def statistics(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """For slices of a text column: (first row, statistics of each row)."""
    data, offsets = text_bytes(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + SLICE, "right")) - 1
        if end > row:
            part, cuts = data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
            starts, lengths, hashes = _words(part, cuts[:-1], True)
            own = np.repeat(np.arange(end - row) * CLASSES, np.diff(cuts))
            hist = np.bincount(own + _CLASS[part], minlength=(end - row) * CLASSES).reshape(-1, CLASSES)
            edge = np.searchsorted(starts, cuts)
            yield row, np.stack([_row(hist[i], lengths[a:z], hashes[a:z]) for i, (a, z) in enumerate(zip(edge, edge[1:]))])
            row = end
        else:
            text = data[offsets[row] : offsets[row + 1]]
            found = list(long_text_words(text))
            hist = sum(np.bincount(_CLASS[text[a : a + SLICE]], minlength=CLASSES) for a in range(0, len(text), SLICE))
            lengths, hashes = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, t) for k, t in ((1, np.int64), (2, np.uint64)))
            yield row, _row(hist, lengths, hashes)[None]
            row += 1


class QualityModel:
    """Standardisation, random Fourier map, ridge weights and isotonic knots; a few hundred numbers."""

    def __init__(self, features: int = 256, seed: int = 7, width: float = 1.0):
        draw = np.random.default_rng(seed)
        self.w = draw.normal(size=(STATISTICS, features)) / (width * np.sqrt(STATISTICS))
        self.b = draw.uniform(0, 2 * np.pi, features)
        self.mean, self.sd = np.zeros(STATISTICS), np.ones(STATISTICS)
        self.beta = np.zeros(features + 1)
        self.x, self.y = np.zeros(1), np.full(1, 0.5)

    def map(self, s: np.ndarray) -> np.ndarray:
        z = np.clip((s - self.mean) / self.sd, -6, 6)
        return np.hstack([np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b)), np.ones((len(z), 1))])

    def score(self, s: np.ndarray) -> np.ndarray:
        return np.interp(self.map(s) @ self.beta, self.x, self.y)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (mean x, mean y) of the pooled blocks of a non-decreasing fit."""
    order = np.lexsort((y, x))
    blocks: list[list[float]] = []
    for a, v in zip(x[order].tolist(), y[order].tolist()):
        blocks.append([a, v, 1.0])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            a1, v1, n1 = blocks.pop()
            a0, v0, n0 = blocks.pop()
            n = n0 + n1
            blocks.append([(a0 * n0 + a1 * n1) / n, (v0 * n0 + v1 * n1) / n, n])
    return np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks])


def fit_quality(docs: DataFrame, labels: DataFrame, allowed, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", features: int = 256, ridge: float = 1e-3, sample_rows: int = SAMPLE_ROWS, sum_partitions: int = 16) -> QualityModel:
    """Fit on at most ``sample_rows`` labelled rows; ``allowed`` limits whose labels are learned from."""

    def measure(batches):
        for batch in batches:
            for row, s in statistics(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(s)), pa.array(list(s), pa.list_(pa.float64())), batch.column(2).slice(row, len(s))], ["id", "s", "y"])

    rows = materialize(labelled(docs, labels, label_col, id_col, text_col, allowed, sample_rows).mapInArrow(measure, "id long, s array<double>, y int"), "quality")
    model = QualityModel(features)
    seen = rows.agg(F.count("*").alias("n"), F.avg("y").alias("p"), F.min("y").alias("lo"), F.max("y").alias("hi"), *[F.avg(F.col("s")[k]).alias(f"m{k}") for k in range(STATISTICS)], *[F.stddev_pop(F.col("s")[k]).alias(f"d{k}") for k in range(STATISTICS)]).first()
    if not seen["n"] or seen["lo"] == seen["hi"]:
        if seen["n"]:
            model.y = np.full(1, float(seen["p"]))
        discard(rows)
        return model
    model.mean = np.array([seen[f"m{k}"] for k in range(STATISTICS)])
    model.sd = np.maximum(np.array([seen[f"d{k}"] for k in range(STATISTICS)]), 1e-3)
    weight = {0: 0.5 / (1 - seen["p"]), 1: 0.5 / seen["p"]}

    def sums(batches):
        a, c = np.zeros((features + 1, features + 1)), np.zeros(features + 1)
        for batch in batches:
            if batch.num_rows:
                z = model.map(np.array(batch.column(0).to_pylist()))
                y = batch.column(1).to_numpy()
                v = np.where(y > 0, weight[1], weight[0])
                a += (z * v[:, None]).T @ z
                c += z.T @ (v * y)
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()), pa.array([c.tobytes()], pa.binary())], ["a", "c"])

    held = F.pmod(F.xxhash64("id"), F.lit(4)) == 0
    parts = rows.where(~held).select("s", "y").coalesce(sum_partitions).mapInArrow(sums, "a binary, c binary").collect()  # at most sum_partitions rows
    a = sum(np.frombuffer(r["a"]) for r in parts).reshape(features + 1, -1)
    model.beta = np.linalg.solve(a + ridge * max(np.trace(a), 1e-9) / (features + 1) * np.eye(features + 1), sum(np.frombuffer(r["c"]) for r in parts))
    kept = rows.where(held).select("s", "y").collect()  # bounded by sample_rows
    if len({r["y"] for r in kept}) < 2:
        kept = rows.select("s", "y").collect()
    model.x, model.y = isotonic(model.map(np.array([r["s"] for r in kept])) @ model.beta, np.array([float(r["y"]) for r in kept]))
    discard(rows)
    return model


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", least: float = 0.3, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with the score (0 to 1) and the prediction (1 if score >= ``least``)."""
    return with_scores(docs, text_col, lambda column: ((row, model.score(s)) for row, s in statistics(column)), least, names)


def op3_rff_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_quality(docs, labels, fold("id", 5) != 0)
    return score_quality(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
