"""Language identification by nearest centroids of TF-IDF n-gram vectors.

Hashed byte n-grams (one to four bytes, letters in lower case) become
log-scaled counts times inverse document frequency, with unit length. Each
language has several centroids, found by spherical k-means; a text takes the
language of the centroid with the largest cosine. It is rejected when that
cosine lies under the language's radius for texts with as many different
n-grams, or when it has no letter. The radius is a share of a low quantile of the cosines
of the language's own training texts and their beginnings: cosines grow with
the number of different n-grams, whatever the text, so each range of that
number has its own radius, which no single outlier rules. Ranges seen too
rarely take the radius of the next lower range, the lowest 0.

Document frequencies cover every training document. Centroids are fitted on a
hash sample of about `per_language` training texts of each of the `languages`
most frequent labels (ties by name): the bound of what one task or the driver
ever holds, however dirty the labels are.

Defined cases: null, empty and letterless texts are `und`, score 0, rejected;
with no labelled text to learn from, every text is; of equal cosines the
first language in alphabetical order wins; repeated rows repeat; an empty
table gives an empty table; other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ngrams import counts

BITS = 12
OUT = ("lang_pred", "score", "rejected")
BEGINNINGS = (12, 40, 120, 400)
STEPS = 2 * BITS + 1


@dataclass(frozen=True)
class Model:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    radius: np.ndarray


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(3)) == 1, F.lit(False))


def vectors(column: pa.Array, idf: np.ndarray):
    """(first row, unit vectors) of consecutive rows."""
    for first, tf in counts(column, BITS):
        v = np.log1p(tf) * idf
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        yield first, np.divide(v, norm, out=v, where=norm > 0)


def breadth(vecs: np.ndarray) -> np.ndarray:
    """Range of the number of different n-grams: two to each doubling."""
    return (2 * np.log2(np.maximum(np.count_nonzero(vecs, axis=1), 1))).astype(np.int64)


def radii(best: np.ndarray, wide: np.ndarray, quantile: float, least: int) -> np.ndarray:
    """The low quantile of the cosines of each range; one with fewer than `least` takes that of the range before."""
    out, r = np.zeros(STEPS), 0.0
    for i in range(STEPS):
        here = best[wide == i]
        if len(here) >= least:
            r = max(r, float(np.quantile(here, quantile)))
        out[i] = r
    return out


def cluster(vecs: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Spherical k-means from farthest-first starts."""
    rng = np.random.default_rng(seed)
    centre = [vecs[rng.integers(len(vecs))]]
    while len(centre) < min(k, len(vecs)):
        centre.append(vecs[np.argmin(np.max(vecs @ np.array(centre).T, axis=1))])
    c = np.array(centre)
    for _ in range(rounds):
        own = np.argmax(vecs @ c.T, axis=1)
        for j in range(len(c)):
            if (own == j).any():
                mean = vecs[own == j].mean(axis=0)
                c[j] = mean / max(np.linalg.norm(mean), 1e-12)
    return c


def fit(train: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 600, clusters: int = 4, quantile: float = 0.01, least: int = 50, share: float = 0.7, seed: int = 5, languages: int = 1000) -> Model | None:
    """A model from labelled texts; None without any."""
    train = train.where(F.col(lang).isNotNull() & F.col(text).rlike("\\p{L}"))
    frequent = train.groupBy(lang).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), lang).limit(languages)
    sizes = {r[lang]: r["n"] for r in frequent.collect()}
    if not sizes:
        return None

    def frequencies(batches):
        df, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for _, tf in counts(batch.column(0), BITS):
                df += (tf > 0).sum(axis=0)
                n += len(tf)
        yield pa.RecordBatch.from_pydict({"slot": np.arange(-1, 1 << BITS, dtype=np.int32), "n": np.concatenate([[n], df])})

    df = train.select(text).mapInArrow(frequencies, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    found = {r["slot"]: r["n"] for r in df.collect()}
    per_slot = np.array([found.get(i, 0) for i in range(1 << BITS)])
    idf = (np.log((1 + found[-1]) / (1 + per_slot)) + 1).astype(np.float32)

    keepers = F.create_map(*[x for name, n in sizes.items() for x in (F.lit(name), F.lit(min(1.0, per_language / n)))])
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 62)) / float(1 << 62)
    sample = train.where(u < keepers[F.col(lang)]).select(F.col(lang).alias("lang"), F.col(key).alias("key"), F.col(text).alias("text"))

    def embed(batches):
        for batch in batches:
            for name, of, texts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                parts = [texts, *[texts[:n] for n in BEGINNINGS if n < len(texts)]]
                vecs = np.concatenate([v for _, v in vectors(pa.array(parts, pa.string()), idf)])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(vecs)), pa.array([of] * len(vecs), pa.int64()), pa.array(range(len(vecs)), pa.int32()), pa.array([x.tobytes() for x in vecs])], ["lang", "key", "part", "vec"])

    def centroids(group: pa.Table) -> pa.Table:
        group = group.sort_by([("key", "ascending"), ("part", "ascending")])
        vecs = np.frombuffer(b"".join(group["vec"].to_pylist()), np.float32).reshape(len(group), -1)
        c = cluster(vecs[group["part"].to_numpy() == 0], clusters, 8, seed)
        r = share * radii((vecs @ c.T).max(axis=1), breadth(vecs), quantile, least)
        return pa.table({"lang": [group["lang"][0].as_py()] * len(c), "no": np.arange(len(c)), "vec": [x.astype(np.float32).tobytes() for x in c], "radius": [r.tolist()] * len(c)})

    shaped = sample.mapInArrow(embed, "lang string, key long, part int, vec binary")
    rows = sorted(shaped.groupBy("lang").applyInArrow(centroids, "lang string, no long, vec binary, radius array<double>").collect(), key=lambda r: (r["lang"], r["no"]))
    if not rows:
        return None
    return Model([r["lang"] for r in rows], idf, np.array([np.frombuffer(r["vec"], np.float32) for r in rows]), np.array([r["radius"] for r in rows]))


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (the cosine) and rejected. Only the text decides."""
    if clash := {*OUT, "_letter"} & set(docs.columns):
        raise ValueError(f"columns already present: {sorted(clash)}")
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "rejected": F.lit(True)})
    marked = docs.withColumn("_letter", F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False)))
    at, cols = marked.columns.index(text), docs.columns
    names = np.array(model.langs, dtype=object)

    def label(batches):
        for batch in batches:
            letter = batch.column(len(cols)).to_numpy(zero_copy_only=False)
            best, score, radius = np.zeros(len(batch), np.int64), np.zeros(len(batch)), np.zeros(len(batch))
            for first, v in vectors(batch.column(at), model.idf):
                sims = v @ model.centroids.T
                own = np.argmax(sims, axis=1)
                best[first : first + len(v)] = own
                score[first : first + len(v)] = sims.max(axis=1)
                radius[first : first + len(v)] = model.radius[own, breadth(v)]
            lang = np.where(letter, names[best], "und")
            score = np.where(letter, np.clip(score, 0, 1), 0.0)
            rejected = ~letter | (score < radius)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(cols)], pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], [*cols, *OUT])

    schema = marked.drop("_letter").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "rejected": F.lit(True)}).schema
    return marked.mapInArrow(label, schema)


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """Learns from the labelled two thirds of docs and labels every row, with held_out."""
    model = fit(docs.where(~held_out(F.col(key))), text, lang, key)
    return predict(docs, model, text).withColumn("held_out", held_out(F.col(key)))


def op1_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
