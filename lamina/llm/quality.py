"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into bins; boosting cycles over the features and adds to
each one's lookup table a shallow tree (two cuts) fitted to the residuals of its
bins, then does the same over the most promising pairs with one cut on each
side.  Scoring adds up table entries by bin, for whole Arrow batches at once.

Features are numbers of the whole text, computed once by Spark and stored; the
model is fitted to a bounded sample of labelled rows (``max_rows``, least hashes
first) and has a fixed size.  Labels, language, source and id are no features.

Defined results: a null text is empty; an empty text has a score like any other;
labels other than 0 and 1, and null ids, are not learned from; with no labelled
row every score is 0.5; repeated rows give repeated scores; texts of any length are
read whole; an empty table gives no row; other columns, whatever their names, are not
read, or kept as they are where documents are filtered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slim, stored, whole_text

FEATURES = (
    "log_bytes", "log_words", "word_length", "letters", "upper", "digits", "marks", "symbols", "exclaims", "bars",
    "spaces", "lines", "line_length", "distinct_words", "top_word", "same_as_next", "distinct_lines", "one_letter", "longest_word", "stops", "other_bytes", "capital_words",
)

_UPPER, _LOWER, _DIGIT, _SPACE = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#$%&*+<=>@[\\]^_`{|}~")] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!\"'(),-./:;?")] = True


def features(text: str) -> list[float]:
    """The numbers of one text, each defined for the empty text too."""
    raw = text.encode()
    n = max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digit, space = (int(counts[m].sum()) for m in (_UPPER, _LOWER, _DIGIT, _SPACE))
    words = raw.split()
    w = max(1, len(words))
    seen: dict[bytes, int] = {}
    for x in words:
        seen[x] = seen.get(x, 0) + 1
    lines = raw.split(b"\n")
    full = upper + lower + int(counts[128:].sum())
    return [
        float(np.log1p(len(raw))), float(np.log1p(len(words))), (len(raw) - space) / w, full / n, upper / max(1, upper + lower), digit / n,
        int(counts[_MARK].sum()) / n, int(counts[_SYMBOL].sum()) / n, int(counts[33]) / w, int(counts[124]) / w, space / n,
        len(lines) / w, float(np.log1p(len(raw) / len(lines))), len(seen) / w, max(seen.values(), default=0) / w, sum(map(bytes.__eq__, words, words[1:])) / w,
        len(set(lines)) / len(lines), sum(c for x, c in seen.items() if len(x) == 1) / w, float(np.log1p(max(map(len, seen), default=0))), int(counts[46]) / w,
        int(counts[128:].sum()) / n, sum(c for x, c in seen.items() if x[:1].isupper()) / w,
    ]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class AdditiveModel:
    """Bin edges and lookup tables; the score is the sum of table entries."""

    bins: int = 32
    rounds: int = 150
    pair_rounds: int = 60
    pairs: int = 6
    rate: float = 0.15
    hold: float = 20.0  # weight of an empty bin's pull to nought
    bias: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    crossed: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def _tree(self, grad: np.ndarray, mass: np.ndarray) -> np.ndarray:
        """Steps of a three-leaf tree over ordered bins, best cuts first."""
        cuts: list[int] = []
        g, m = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(mass)])
        for _ in range(2):
            ends, best = [0, *sorted(cuts), len(grad)], (1e-9, None)
            for a, b in zip(ends, ends[1:], strict=False):
                at = np.arange(a + 1, b)
                if len(at):
                    left, right = (g[at] - g[a]) ** 2 / (m[at] - m[a] + self.hold), (g[b] - g[at]) ** 2 / (m[b] - m[at] + self.hold)
                    gain = left + right - (g[b] - g[a]) ** 2 / (m[b] - m[a] + self.hold)
                    i = int(gain.argmax())
                    best = max(best, (float(gain[i]), int(at[i])), key=lambda t: t[0])
            if best[1] is None:
                break
            cuts.append(best[1])
        ends = [0, *sorted(cuts), len(grad)]
        return np.concatenate([np.full(b - a, (g[b] - g[a]) / (m[b] - m[a] + self.hold)) for a, b in zip(ends, ends[1:], strict=False)])

    def _quadrants(self, grad: np.ndarray, mass: np.ndarray) -> tuple[float, np.ndarray]:
        """The best single cut on each side of a pair, and its four steps."""
        g, m = (np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for x in (grad, mass))
        gain, cells = np.zeros((self.bins - 1, self.bins - 1)), []
        for rows, cols in ((0, 0), (0, 1), (1, 0), (1, 1)):
            part = []
            for x in (g, m):
                inner = x[1:-1, 1:-1]
                r = x[-1:, 1:-1] - inner if rows else inner
                if cols:
                    r = (x[-1, -1] - x[1:-1, -1:] - x[-1:, 1:-1] + inner) if rows else x[1:-1, -1:] - inner
                part.append(r)
            gain += part[0] ** 2 / (part[1] + self.hold)
            cells.append(part[0] / (part[1] + self.hold))
        i, j = np.unravel_index(int(gain.argmax()), gain.shape)
        table = np.empty_like(grad)
        table[: i + 1, : j + 1], table[: i + 1, j + 1 :], table[i + 1 :, : j + 1], table[i + 1 :, j + 1 :] = (c[i, j] for c in cells)
        return float(gain[i, j]), table

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        share = (y.sum() + 1) / (len(y) + 2)
        self.bias = float(np.log(share / (1 - share)))
        quantiles = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, j], quantiles)) for j in range(x.shape[1])]
        b = self.binned(x)
        self.tables = [np.zeros(self.bins) for _ in self.edges]
        z = np.full(len(y), self.bias)
        for _ in range(self.rounds):
            for j, table in enumerate(self.tables):
                p = _sigmoid(z)
                grad = np.bincount(b[:, j], y - p, self.bins)
                step = self.rate * self._tree(grad, np.bincount(b[:, j], p * (1 - p), self.bins) * 1.0)
                table += step
                z += step[b[:, j]]
        p, gains = _sigmoid(z), []
        for i in range(len(self.tables)):
            for j in range(i):
                cell = b[:, i] * self.bins + b[:, j]
                shape = (self.bins, self.bins)
                gain, _ = self._quadrants(np.bincount(cell, y - p, self.bins**2).reshape(shape), np.bincount(cell, p * (1 - p), self.bins**2).reshape(shape))
                gains.append((gain, i, j))
        self.crossed = [(i, j, np.zeros((self.bins, self.bins))) for _, i, j in sorted(gains, reverse=True)[: self.pairs]]
        for _ in range(self.pair_rounds):
            for i, j, table in self.crossed:
                p, cell = _sigmoid(z), b[:, i] * self.bins + b[:, j]
                _, step = self._quadrants(np.bincount(cell, y - p, self.bins**2).reshape(table.shape), np.bincount(cell, p * (1 - p), self.bins**2).reshape(table.shape))
                table += self.rate * step
                z += self.rate * step[b[:, i], b[:, j]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        if self.edges:
            b = self.binned(x)
            for j, table in enumerate(self.tables):
                z += table[b[:, j]]
            for i, j, table in self.crossed:
                z += table[b[:, i], b[:, j]]
        return _sigmoid(z)


def text_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): the features of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slim(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(t.as_py() or "") for t in batch.column(1)], pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(run, "doc_id bigint, x array<double>")


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 5."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5


def label_sample(labels: DataFrame, label_col: str = "quality", max_rows: int = 20_000) -> DataFrame:
    """(doc_id, y) of labelled rows outside fold 0: the ``max_rows`` of least hash."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1) & (fold() != 0))
    return known.select("doc_id", F.col(label_col).cast("double").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_rows)


def fit_quality(table: DataFrame, sample: DataFrame) -> AdditiveModel:
    """Fit to a bounded sample of labels; ``table`` has doc_id and x.

    Of rows that repeat a doc_id one counts, that of the least hash, so no more
    rows are collected than the sample has.
    """
    known = table.join(F.broadcast(sample.select("doc_id").distinct()), "doc_id", "left_semi")
    one = known.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("x").alias("h"), "x"))["x"].alias("x"))
    rows = sorted((r["doc_id"], r["y"], r["x"]) for r in one.join(F.broadcast(sample), "doc_id").select("doc_id", "y", "x").collect())
    if not rows:
        return AdditiveModel()
    return AdditiveModel().fit(np.array([x for _, _, x in rows]), np.array([y for _, y, _ in rows]))


def _scored(table: DataFrame, model: AdditiveModel, threshold: float, schema: str, give) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                score = model.score(x)
                yield give(batch, score, (score >= threshold).astype(np.int32))

    return table.mapInArrow(run, schema)


def score_quality(table: DataFrame, model: AdditiveModel, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for a table of features."""

    def give(batch, score, predicted):
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array(predicted)], ["doc_id", "score", "predicted"])

    out = _scored(table, model, threshold, "doc_id bigint, score double, predicted int", give)
    return out.select("doc_id", (fold() == 0).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 20_000) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``.

    The model is fitted to the sampled labels' texts; then each text is scored
    in place.  The sample's bound is what lets it be broadcast.
    """
    sample = stored(label_sample(labels, max_rows=max_rows), "labels")
    known = docs.join(F.broadcast(sample.select("doc_id").distinct()), "doc_id", "left_semi")
    model = fit_quality(text_features(known), sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slim(batches):
            if batch.num_rows:
                score = model.score(np.array([features(t.as_py() or "") for t in batch.column("text")]))
                yield batch.filter(pa.array(score >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = stored(text_features(spark.read.parquet(f"{sf_dir}/documents.parquet")), "features")
    return score_quality(table, fit_quality(table, label_sample(spark.read.parquet(f"{sf_dir}/labels.parquet"))))
