"""Quality classifier: regularised quadratic discriminant analysis over transformed statistics of a text.

One scan turns every whole text into twelve numbers (``STATISTICS``), each transformed so that its spread depends little
on the text's length: counts by logarithm, shares by the arcsine of the square root after ``few`` has been added to their
denominator, so that a short text has no extreme shares.  The class means and covariances are sums over all labelled rows
of the learning part, one aggregation in which two rows reach the driver.  A class covariance is shrunk towards the pooled
one, the more the fewer rows the class has, and then towards the identity; its Cholesky factor is inverted once and goes with the tasks.
The score is the logistic of the difference of the two log densities (half squared Mahalanobis distances, log determinants and log priors),
divided by ``temper``, since twelve statistics that are neither independent nor normal overstate their case.

Learning uses labels whose crc32 of the id as text, modulo ``folds``, is not ``held_out``.  Labels, language, source and
id are never inputs of a score.

Edge cases: null and empty texts have the statistics of no words and get a score like others; labels without a
document, with a null id or with a value other than 0 and 1 are not used; rows that share an id are each joined with
each label of the id; rows with a null id count as not held out and are scored; without labelled rows of one class the
score is the prior of the labelled rows, without any it is one half; an empty table gives an empty result; only the named columns are read.
Memory is proportional to an Arrow batch and its longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonarium.llm import textbatch as tb
from zonarium.sources.scratch import materialised

#: What the numbers of a text are, in order.
STATISTICS = (
    "words", "word_length", "word_length_spread", "symbols", "stops", "exclamations", "digits", "capitals",
    "words_twice_running", "words_in_repeated_triples", "distinct_words", "words_per_line",
)


def _those(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in chars]] = True
    return out


_SYMBOL = _those("#$%&*|<>=~^_+@\\{}[]")
_STOP = _those(".,;:'\"()-")
_CALL = _those("!?")
_DIGIT = _those("0123456789")
_UPPER = _those("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWER = _those("abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Discriminant:
    """Parameters; ``few`` evens out shares of short texts, ``kin`` and ``ridge`` shrink covariances."""

    folds: int = 3
    held_out: int = 1
    few: float = 20.0
    kin: float = 12.0
    ridge: float = 0.05
    temper: float = 12.0


def _repeated(key: np.ndarray) -> np.ndarray:
    """Which values occurred at a smaller index."""
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    out = np.zeros(len(key), dtype=bool)
    out[order[1:][ranked[1:] == ranked[:-1]]] = True
    return out


def statistics(off: np.ndarray, raw: np.ndarray, few: float) -> np.ndarray:
    """The transformed statistics of the texts in one slice, a row each."""
    words = tb.Words(off, raw)
    inside = ((raw & 0xC0) != 0x80) & words.inside
    upto = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(inside, out=upto[1:])
    length = upto[words.end] - upto[words.start]
    # letters of Latin-1 beyond ASCII: 0xC3 and a byte that tells capitals (to 0x9E) from others
    latin = np.zeros(len(raw), dtype=bool)
    latin[1:] = raw[:-1] == 0xC3
    per_byte = lambda mask: tb.per_text(mask, off).astype(float)
    per_word = lambda values: tb.per_text(values, words.begin).astype(float)

    n, chars = words.count.astype(float), per_byte(inside)
    upper, lower = per_byte(_UPPER[raw] | (latin & (raw <= 0x9E))), per_byte(_LOWER[raw] | (latin & (raw > 0x9E)))
    hashed = words.hashes()
    salt = tb.mix64(np.arange(len(off) - 1, dtype=np.uint64) + np.uint64(1))
    again = np.zeros(len(hashed), dtype=bool)
    again[1:] = (hashed[1:] == hashed[:-1]) & (words.text[1:] == words.text[:-1])
    triples, at = words.windows(hashed, 3)
    in_triples = tb.covered(len(hashed), at[_repeated(triples ^ salt[words.text[at]])], 3)
    distinct = per_word(~_repeated(hashed ^ salt[words.text]))
    spread = per_word(length * length) / np.maximum(n, 1) - (per_word(length) / np.maximum(n, 1)) ** 2

    share = lambda part, whole: np.arcsin(np.sqrt(np.clip(part / (whole + few), 0, 1)))
    columns = [
        np.log1p(n), np.log((few + chars) / (few / 5 + n)), np.log1p(np.maximum(spread, 0)),
        share(per_byte(_SYMBOL[raw]), chars), share(per_byte(_STOP[raw]), chars), share(per_byte(_CALL[raw]), chars), share(per_byte(_DIGIT[raw]), chars),
        share(upper, upper + lower), share(per_word(again), n), share(per_word(in_triples), n),
        np.log((few / 2 + distinct) / (few / 2 + n)), np.log((1 + n) / (1 + per_byte(raw == 10))),
    ]
    return np.stack(columns, axis=1)


def with_statistics(docs: DataFrame, few: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``x``, the statistics of the text; a pure map."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, raw = tb.utf8(batch.column(1))
            for i, j in tb.slices(off):
                x = statistics(off[i : j + 1] - off[i], raw[off[i] : off[j]], few)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), rows], ["doc_id", "x"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan, "doc_id long, x array<double>")


@dataclass(frozen=True)
class Model:
    """For each class its mean, the inverse of its covariance's Cholesky factor, and its log prior less the log determinant's half; no classes: a constant."""

    centre: np.ndarray
    scale: np.ndarray
    classes: list[tuple[np.ndarray, np.ndarray, float]]
    constant: float
    temper: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Log odds of label 1."""
        if not self.classes:
            return np.full(len(x), self.constant)
        z = (x - self.centre) / self.scale
        low, high = (offset - 0.5 * (((z - mean) @ inverse.T) ** 2).sum(axis=1) for mean, inverse, offset in self.classes)
        return (high - low) / self.temper


def model_from(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], how: Discriminant) -> Model:
    """The model from each class's rows, sum and sum of outer products."""
    width = len(STATISTICS)
    rows = [sums[k][0] if k in sums else 0.0 for k in (0, 1)]
    total = sum(rows)
    constant = float(np.log((rows[1] + 1) / (rows[0] + 1)))
    if not all(rows):
        return Model(np.zeros(width), np.ones(width), [], constant, how.temper)
    centre = sum(s for _, s, _ in sums.values()) / total
    second = sum(q for *_, q in sums.values()) / total - np.outer(centre, centre)
    scale = np.sqrt(np.maximum(np.diag(second), 0)) + 1e-6
    means, covariances = [], []
    for k in (0, 1):
        n, s, q = sums[k]
        mean = s / n
        means.append((mean - centre) / scale)
        covariances.append((q / n - np.outer(mean, mean)) / np.outer(scale, scale))
    pooled = sum(n / total * c for n, c in zip(rows, covariances, strict=True))
    classes = []
    for n, mean, own in zip(rows, means, covariances, strict=True):
        kin = how.kin / (n + how.kin)
        shrunk = (1 - how.ridge) * ((1 - kin) * own + kin * pooled) + how.ridge * np.eye(width)
        factor = np.linalg.cholesky(shrunk)
        offset = float(np.log(n / total) - np.log(np.diag(factor)).sum())
        classes.append((mean, np.linalg.inv(factor), offset))
    return Model(centre, scale, classes, constant, how.temper)


def is_held_out(doc_id: Column, how: Discriminant) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % how.folds == how.held_out, F.lit(False))


def fit(measured: DataFrame, labels: DataFrame, how: Discriminant) -> Model:
    """Learns from all labelled rows that are not held out; the sums are combined before the shuffle."""
    label = F.when(F.col("quality").isin(0, 1), F.col("quality").cast("int"))
    learn = labels.select(F.col("doc_id").cast("long").alias("doc_id"), label.alias("label")).where(F.col("label").isNotNull() & ~is_held_out(F.col("doc_id"), how))
    width = range(len(STATISTICS))
    x = F.col("x")
    sums = (
        measured.join(learn, "doc_id")
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("n"), *(F.sum(x[i]).alias(f"s{i}") for i in width), *(F.sum(x[i] * x[j]).alias(f"q{i}_{j}") for i in width for j in range(i + 1)))
        .collect()
    )
    found = {}
    for r in sums:
        q = np.array([[r[f"q{max(i, j)}_{min(i, j)}"] for j in width] for i in width])
        found[r["label"]] = (float(r["n"]), np.array([r[f"s{i}"] for i in width]), q)
    return model_from(found, how)


def quality_scores(docs: DataFrame, labels: DataFrame, how: Discriminant | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``score`` (0 to 1, higher: label 1 likelier), ``predicted``."""
    how = how or Discriminant()
    measured = materialised(with_statistics(docs, how.few, id_col, text_col), "quality-statistics")
    model = fit(measured, labels, how)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            odds = np.clip(model.log_odds(x), -500, 500)
            value = 1 / (1 + np.exp(-odds))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value), pa.array((value >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = measured.mapInArrow(score, "doc_id long, score double, predicted int")
    return scored.select("doc_id", is_held_out(F.col("doc_id"), how).alias("held_out"), "score", "predicted")
