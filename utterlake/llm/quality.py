"""Quality classifier: ordinal cumulative-link regression on graded texts.

A text is a sparse vector of hashed words (letters in lower case, log counts),
shares of single bytes of the raw text, and its repetition. Words in fewer than
`least_rows` training texts keep weight 0; the lasso takes out the others that
tell nothing. One weight vector is shared by
all grades;
ordered thresholds cut the score: P(grade <= k) = sigmoid(threshold_k - w.x).
The result is the expected grade and tail probabilities for selection.
Both tails follow one score, so toxicity is also judged by a regression of its
own (grade 0 against the rest); the most of it that a selected text may have
is set on held-out training rows.

The fit takes a hash sample of about `train_rows` labelled rows (a documented
bound), by key and text, so that rows which share a key part ways; every text
is scored whole.

Defined cases: null and empty texts have no features and get the prior of
the thresholds; with fewer than two grades to learn from, the expected grade
is null and nothing is selected; equal texts score equally; repeated rows
repeat; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jaccard_join import hint_for, word_hashes
from .ngrams import FOLD, string_buffers
from .scratch import drop, keep

BITS = 20
OUT = ("expected_grade", "tail", "selected")


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    toxic: Model | None = None
    most_toxic: float = 1.0


def features(column: pa.Array):
    """(row, slots, values) of every row."""
    data, at = string_buffers(column)
    for row, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        raw = data[a:b]
        _, h = word_hashes(FOLD[raw])
        slot, n = np.unique(h >> np.uint64(64 - BITS), return_counts=True)
        value = np.log1p(n)
        byte, m = np.unique(raw, return_counts=True)
        share = np.sqrt(m / max(len(raw), 1))
        kinds = len(slot) / max(len(h), 1)  # repetition: distinct words over words
        more = 4 * np.array([kinds, 1 - kinds])
        slots = np.concatenate([slot.astype(np.int64), (1 << BITS) + byte.astype(np.int64), (1 << BITS) + 256 + np.arange(2)])
        yield row, slots, np.concatenate([value, 4 * share, more])


WIDTH = (1 << BITS) + 258


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def descend(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, grades: int, rounds: int, rate: float, lasso: float, least_rows: int = 5) -> Model:
    """Full-batch Adagrad on the cumulative-link likelihood, grades weighted to equal sums."""
    which = np.repeat(np.arange(len(rows)), [len(s) for s, _ in rows])
    slots, values = np.concatenate([s for s, _ in rows]), np.concatenate([v for _, v in rows])
    common = np.bincount(slots, minlength=WIDTH) >= least_rows
    seen = common[slots]
    which, slots, values = which[seen], slots[seen], values[seen]
    weight = 1.0 / np.bincount(y, minlength=grades)[y]
    weight /= weight.sum()
    w, sq = np.zeros(WIDTH), np.full(WIDTH, 1e-8)
    theta = np.linspace(-1, 1, grades - 1) if grades > 2 else np.zeros(1)
    tsq = np.full(grades - 1, 1e-8)
    for _ in range(rounds):
        score = np.bincount(which, values * w[slots], minlength=len(rows))
        cut = np.concatenate([[-np.inf], theta, [np.inf]])
        hi, lo = sigmoid(cut[y + 1] - score), sigmoid(cut[y] - score)
        hi, lo = np.where(y == grades - 1, 1.0, hi), np.where(y == 0, 0.0, lo)
        p = np.maximum(hi - lo, 1e-9)
        dh, dl = hi * (1 - hi) / p, lo * (1 - lo) / p
        g = np.bincount(slots, values * (weight * (dh - dl))[which], minlength=WIDTH)
        sq += g * g
        pace = rate / np.sqrt(sq)
        w -= pace * g
        w = np.sign(w) * np.maximum(np.abs(w) - pace * lasso, 0)  # words that tell nothing go to 0
        t = np.array([-(weight * dh)[y == k].sum() + (weight * dl)[y == k + 1].sum() for k in range(grades - 1)])
        tsq += t * t
        theta = np.maximum.accumulate(theta - rate * t / np.sqrt(tsq))
    return Model(w.astype(np.float32), theta)


def scores(rows: list[tuple[np.ndarray, np.ndarray]], model: Model) -> np.ndarray:
    return np.array([(model.weights[slots] * values).sum() for slots, values in rows])


def guard(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, top: int, cost: float, **options) -> tuple[Model, float] | None:
    """A regression of grade 0 against the rest with weights of its own, and the probability of grade 0 that only a share `cost` of the best grade's held-out rows (every fourth) exceeds."""
    apart = np.arange(len(rows)) % 4 == 0
    at = np.flatnonzero(~apart)
    best = np.flatnonzero(apart & (y == top))
    if not len(best) or len(np.unique(y[at] > 0)) < 2:
        return None
    model = descend([rows[i] for i in at], (y[at] > 0).astype(np.int64), 2, **options)
    p = sigmoid(model.thresholds[0] - scores([rows[i] for i in best], model))
    return model, float(np.quantile(p, 1 - cost))


def bounded(graded: DataFrame, n: int, train_rows: int, seed: int) -> DataFrame:
    """About train_rows of the n rows, by hash of key and text."""
    share = int(min(1.0, train_rows / n) * (1 << 62))
    return graded.where(F.pmod(F.xxhash64(F.lit(seed), "key", "text"), F.lit(1 << 62)) < share)


def fit(graded: DataFrame, train_rows: int = 8_000, seed: int = 3, rounds: int = 300, rate: float = 0.1, lasso: float = 1e-3, cost: float = 0.02) -> Model | None:
    """graded: key, text, grade (0, 1, 2 ...)."""
    graded = graded.where(F.col("grade").isNotNull())
    n, top = graded.agg(F.count(F.lit(1)), F.max("grade")).first()
    if not n or not top:
        return None
    sample = bounded(graded, n, train_rows, seed)

    def train(group: pa.Table) -> pa.Table:
        group = group.sort_by([("key", "ascending"), ("grade", "ascending")])
        rows = [(s, v) for _, s, v in features(group["text"])]
        y = group["grade"].to_numpy().astype(np.int64)
        present = np.unique(y)
        if len(present) < 2:
            return pa.table({"model": pa.array([], pa.binary())})
        model = descend(rows, y, int(top) + 1, rounds, rate, lasso)
        if top > 1 and (found := guard(rows, y, int(top), cost, rounds=rounds, rate=rate, lasso=lasso)):
            model = replace(model, toxic=found[0], most_toxic=found[1])
        return pa.table({"model": [pickle.dumps(model)]})

    row = sample.select("key", "text", "grade").groupBy(F.lit(1).alias("all")).applyInArrow(train, "model binary").first()
    return pickle.loads(row["model"]) if row else None


def score(docs: DataFrame, model: Model | None, text: str = "text", at_least: int = 2, least: float = 0.2) -> DataFrame:
    """docs with expected_grade, tail (probability of `at_least` or better) and selected (tail >= least, and grade 0 no likelier than the model allows)."""
    if clash := set(OUT) & set(docs.columns):
        raise ValueError(f"columns already present: {sorted(clash)}")
    if model is None:
        return docs.withColumns({"expected_grade": F.lit(None).cast("double"), "tail": F.lit(None).cast("double"), "selected": F.lit(False)})
    at, cols = docs.columns.index(text), docs.columns

    def rate(batches):
        for batch in batches:
            z, bad = np.zeros(len(batch)), np.zeros(len(batch))
            for row, slots, values in features(batch.column(at)):
                z[row] = (model.weights[slots] * values).sum()
                if model.toxic is not None:
                    bad[row] = sigmoid(model.toxic.thresholds[0] - (model.toxic.weights[slots] * values).sum())
            above = 1 - sigmoid(model.thresholds[None] - z[:, None])  # P(grade > k)
            tail = above[:, min(at_least, above.shape[1]) - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(above.sum(axis=1)), pa.array(tail), pa.array((tail >= least) & (bad <= model.most_toxic))], [*cols, *OUT])

    schema = docs.withColumns({"expected_grade": F.lit(0.0), "tail": F.lit(0.0), "selected": F.lit(True)}).schema
    return docs.mapInArrow(rate, schema)


def grade(quality: Column, toxic: Column) -> Column:
    """0 toxic, 1 of low quality, 2 good."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when(quality == 1, 2)


def op2_quality(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    chosen = labels.select(F.col("doc_id").alias("key"), grade(F.col("quality"), F.col("toxic")).alias("grade"))
    n = chosen.count()
    # about twice the bound of fit() by key, before texts are fetched; fit() holds it by row, whatever an id's number of rows
    share = int(min(1.0, 16_000 / max(n, 1)) * (1 << 62))
    chosen = keep(chosen.where(F.pmod(F.xxhash64(F.lit(4), "key"), F.lit(1 << 62)) < share), "labels")
    graded = keep(docs.join(hint_for(chosen)(chosen), docs["doc_id"] == chosen["key"]).select("key", "text", "grade"), "graded")
    drop(chosen)
    model = fit(graded)
    drop(graded)
    return score(docs, model).select("doc_id", "expected_grade", "tail", "selected")
