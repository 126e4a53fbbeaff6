"""Approximate nearest neighbours: inverted file, product-quantised residuals, exact reranking.

Equal vectors are one class, which is indexed, asked and measured once
whatever its number of rows: of its rows only the k + 1 of smallest vec_id can
be among anyone's k nearest, and a query row leaves itself out at the end. So
a vector that a third of all rows hold is one entry. Classes are known by 128
bits of hash of the vector.

Coarse centroids and residual codebooks are fitted on a hash sample of about
`train_rows` vectors (a documented bound); every class is then indexed by its
list and residual codes. There are about half the root of n lists, at most
4,096; a list of more than `part_rows` classes is divided by second-level
centroids, fitted on a hash sample of at most `list_sample` of its classes for
each of them, so that cells stay of one size while their number grows with n.
A query probes the nearest cells, each returns its best `each` classes by
asymmetric distance tables, and the best `rerank` of all are measured exactly
on the original vectors. How wide that has to be depends on the rows (vectors
without clusters have neighbours in many cells), so it is measured: up to
`tried` of the asked classes are compared with every class, and the three
numbers are raised from their least values until they keep all but `miss` of
the true neighbours. Queries of a cell are dealt in chunks of `chunk` to as
many copies of the cell's codes.

Defined cases: vectors that are null, zero, of another size than the most
frequent one, or hold null or non-finite components take no part, as query or
candidate; rows without an id are candidates like others; ties go to the
smaller vec_id, none at all last; rows that repeat a vec_id are candidates and
queries each; fewer candidates than k give them all; an empty table gives no
rows; other columns are left out, so their names never clash.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import drop, keep


@dataclass(frozen=True)
class Model:
    coarse: np.ndarray  # lists x dims
    books: np.ndarray  # parts x codes x dims of a part

    @property
    def parts(self) -> int:
        return len(self.books)


@dataclass(frozen=True)
class Cells:
    centres: np.ndarray  # cells x dims: second-level centroids, or the list's own where it isn't divided
    first: np.ndarray  # of each list its first cell, and the number of cells at the end
    sizes: np.ndarray  # classes of each cell

    @property
    def lists(self) -> np.ndarray:
        """The list of each cell."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def nearest(self, v: np.ndarray) -> np.ndarray:
        """The cells that hold classes, nearest first."""
        held = np.flatnonzero(self.sizes > 0)
        return held[np.argsort(((self.centres[held] - v) ** 2).sum(1), kind="stable")]


@dataclass(frozen=True)
class Width:
    cells: int  # nearest cells that a query looks into
    each: int  # classes that a cell returns
    rerank: int  # classes that are measured exactly


def usable(v: Column) -> Column:
    d = lambda x: x.cast("double")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(d(x)) & (F.abs(d(x)) < float("inf")))
    return F.coalesce(v.isNotNull() & sound & F.exists(v, lambda x: d(x) != 0), F.lit(False))


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, c)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        n = np.bincount(own, minlength=len(c))[:, None]
        c = np.where(n > 0, total / np.maximum(n, 1), c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    x, c = x - c.mean(0), c - c.mean(0)  # far from the origin the products below would cancel
    return np.concatenate([np.argmin((c * c).sum(1) - 2 * x[i : i + 4096] @ c.T, axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def fit(vectors: DataFrame, n: int, lists: int, parts: int, codes: int, train_rows: int, seed: int) -> Model:
    """vectors: row, v; n their number."""
    share = int(min(1.0, train_rows / max(n, 1)) * (1 << 62))
    sample = vectors.where(F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(1 << 62)) <= share)

    def train(group: pa.Table) -> pa.Table:
        rng = np.random.default_rng(seed)
        x = matrix(group.sort_by("row")["v"])
        coarse = kmeans(x, lists, 8, rng)
        rest = x - coarse[nearest(x, coarse)]
        books = [kmeans(p, codes, 6, rng) for p in np.split(rest, parts, axis=1)]
        most = max(len(b) for b in books)
        books = np.stack([np.pad(b, ((0, most - len(b)), (0, 0)), mode="edge") for b in books])
        return pa.table({"model": [pickle.dumps((coarse, books))]})

    row = sample.groupBy(F.lit(1).alias("all")).applyInArrow(train, "model binary").first()
    return Model(*pickle.loads(row["model"]))


def probes_of(lists: int, breadth: float) -> int:
    """How many of the lists a query probes at least: 16, then breadth times the root of their number."""
    return min(lists, max(16, int(np.ceil(breadth * np.sqrt(lists)))))


def classes_of(vectors: DataFrame, k: int) -> DataFrame:
    """cls, k1, k2, v, members: equal vectors, and of their rows (vec_id, row) the k + 1 first. Windows of that size are cut before the shuffle."""
    same = Window.partitionBy("k1", "k2").orderBy(F.col("vec_id").asc_nulls_last(), "row")
    some = vectors.select("k1", "k2", "row", "vec_id", "v").withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1)
    met = some.groupBy("k1", "k2").agg(F.min_by("row", "r").alias("cls"), F.min_by("v", "r").alias("v"), F.array_sort(F.collect_list(F.struct("r", "vec_id", "row"))).alias("members"))
    return met.select("cls", "k1", "k2", "v", F.transform("members", lambda m: F.struct(m["vec_id"].alias("vec_id"), m["row"].alias("row"))).alias("members"))


def divide(listed: DataFrame, model: Model, per_list: np.ndarray, part_rows: int, list_sample: int, seed: int) -> list[np.ndarray]:
    """Of each list the second-level centroids, its own centroid where it is small. listed: cls, v, list."""
    wanted = np.maximum(1, -(-per_list // part_rows))
    centres = [model.coarse[i : i + 1] for i in range(len(wanted))]
    large = np.flatnonzero(wanted > 1)
    if not len(large):
        return centres
    share = {int(i): int(min(1.0, list_sample * wanted[i] / per_list[i]) * (1 << 62)) for i in large}
    bound = F.create_map(*[x for i, s in share.items() for x in (F.lit(i), F.lit(s))])
    sample = listed.where(F.col("list").isin(*share) & (F.pmod(F.xxhash64(F.lit(seed + 1), "cls"), F.lit(1 << 62)) <= F.try_element_at(bound, F.col("list"))))

    def train(group: pa.Table) -> pa.Table:
        i = group["list"][0].as_py()
        c = kmeans(matrix(group.sort_by("cls")["v"]), int(wanted[i]), 6, np.random.default_rng([seed, i]))
        return pa.table({"list": pa.array([i], pa.int32()), "c": pa.array([c.tobytes()], pa.binary())})

    for r in sample.select("cls", "v", "list").groupBy("list").applyInArrow(train, "list int, c binary").toLocalIterator():  # n / part_rows centroids in all
        centres[r["list"]] = np.frombuffer(r["c"]).reshape(-1, model.coarse.shape[1])
    return centres


def encode(classes: DataFrame, model: Model, centres: list[np.ndarray]) -> DataFrame:
    """cls, cell, residual code and vector of each class."""
    first = np.concatenate([[0], np.cumsum([len(c) for c in centres])])

    def code(batches):
        for batch in batches:
            x = matrix(batch.column(1))
            own = nearest(x, model.coarse) if len(x) else np.zeros(0, np.int64)
            cell = first[own]
            for i in set(own[[len(centres[j]) > 1 for j in own.tolist()]].tolist()) if len(x) else ():
                mine = np.flatnonzero(own == i)
                cell[mine] += nearest(x[mine], centres[i])
            rest = x - model.coarse[own] if len(x) else x
            codes = np.stack([nearest(p, b) for p, b in zip(np.split(rest, model.parts, axis=1), model.books, strict=True)], axis=1).astype(np.uint8) if len(x) else np.zeros((0, model.parts), np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(1)], ["cls", "cell", "code", "v"])

    return classes.select("cls", "v").mapInArrow(code, f"cls long, cell int, code binary, v {classes.schema['v'].dataType.simpleString()}")


def counted(df: DataFrame, by: str, many: int) -> np.ndarray:
    """Rows of each number below `many`: one number a cell or list on the driver."""
    out = np.zeros(many, np.int64)
    for r in df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).collect():
        out[r[by]] = r["n"]
    return out


def probed(asked: DataFrame, cells: Cells, width: Width) -> DataFrame:
    """cell, query, v: the cells that each asked class looks into, more where they hold few classes. asked: cls, v."""

    def probe(batches):
        for batch in batches:
            rows = {"cell": [], "query": [], "v": []}
            for q, v in zip(batch.column(0).to_pylist(), matrix(batch.column(1)), strict=True):
                order = cells.nearest(v)
                enough = int(np.searchsorted(np.cumsum(cells.sizes[order]), width.rerank + 1)) + 1
                for c in order[: max(width.cells, enough)].tolist():
                    for name, value in zip(rows, (c, q, v.tobytes()), strict=True):
                        rows[name].append(value)
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("cell", pa.int32()), ("query", pa.int64()), ("v", pa.binary())]))

    return asked.select("cls", "v").mapInArrow(probe, "cell int, query long, v binary")


def widened(index: DataFrame, asked: DataFrame, model: Model, cells: Cells, k: int, least: Width, tried: int, miss: float, seed: int) -> Width:
    """The width that keeps all but a share of `miss` of the k nearest classes of `tried` asked ones, which are compared with every class: half of it may be lost to cells, a quarter each to `each` and `rerank`. Two passes over the index; `tried` vectors and their neighbours are on the driver."""
    sample = asked.select("cls", "v").orderBy(F.xxhash64(F.lit(seed + 2), "cls"), "cls").limit(tried).collect()
    if not sample:
        return least
    ids, qs = [r["cls"] for r in sample], np.array([r["v"] for r in sample], np.float64)
    place = np.full((len(qs), len(cells.sizes)), len(cells.sizes))
    for i, v in enumerate(qs):
        order = cells.nearest(v)
        place[i, order] = np.arange(len(order))
    centres = model.coarse[cells.lists]

    def read(batch) -> tuple:
        cls, cell = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        code = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(cls), model.parts)
        coded = centres[cell] + np.concatenate([b[code[:, i]] for i, b in enumerate(model.books)], axis=1)
        return cls, cell, coded

    def first(batches):
        for batch in batches:
            if not len(batch):
                continue
            (cls, cell, coded), x = read(batch), matrix(batch.column(3))
            out = []
            for i, v in enumerate(qs):
                d = ((x - v) ** 2).sum(1)
                some = np.flatnonzero(cls != ids[i])
                some = some[np.argsort(d[some], kind="stable")[:k]]
                out.append((np.full(len(some), i, np.int32), cls[some], cell[some], d[some], ((coded[some] - v) ** 2).sum(1)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["i", "cls", "cell", "d", "near"])

    rows = index.select("cls", "cell", "code", "v")
    met = rows.mapInArrow(first, "i int, cls long, cell int, d double, near double").withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy("d", "cls"))).where(F.col("r") <= k)
    true = met.select("i", "cell", "near").collect()  # tried times k
    if not true:
        return least
    upto = lambda values, lost: int(np.quantile(values, 1 - lost, method="higher")) + 1
    probes = max(least.cells, upto([place[r["i"], r["cell"]] for r in true], miss / 2))
    kept = [r for r in true if place[r["i"], r["cell"]] < probes]
    of = [[(j, r["cell"], r["near"]) for j, r in enumerate(kept) if r["i"] == i] for i in range(len(qs))]

    def before(batches):
        n = np.zeros((len(kept), 2), np.int64)
        for batch in batches:
            if not len(batch):
                continue
            _, cell, coded = read(batch)
            for i, v in enumerate(qs):
                inside = np.flatnonzero(place[i, cell] < probes)
                near, at = ((coded[inside] - v) ** 2).sum(1), cell[inside]
                for j, c, mine in of[i]:
                    closer = near < mine
                    n[j] += closer.sum(), (closer & (at == c)).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n[:, 0]), pa.array(n[:, 1])], ["j", "all", "own"])

    ranks = rows.drop("v").mapInArrow(before, "j long, all long, own long").groupBy("j").agg(F.sum("all").alias("all"), F.sum("own").alias("own")).collect()
    return Width(probes, max(least.each, upto([r["own"] for r in ranks], miss / 4)), max(least.rerank, upto([r["all"] for r in ranks], miss / 4)))


def scanned(index: DataFrame, wanted: DataFrame, model: Model, cells: Cells, each: int, chunk: int) -> DataFrame:
    """query, cls, near: of each cell that a query looks into the best `each` classes by asymmetric distance."""
    of = cells.lists

    def scan(codes: pa.Table, queries: pa.Table) -> pa.Table:
        found = {"query": [], "cls": [], "near": []}
        if len(codes) and len(queries):
            ids = codes["cls"].to_numpy()
            c = np.frombuffer(b"".join(codes["code"].to_pylist()), np.uint8).reshape(len(ids), model.parts)
            centre = model.coarse[of[codes["cell"][0].as_py()]]
            for q, v in zip(queries["query"].to_pylist(), queries["v"].to_pylist(), strict=True):
                rest = (np.frombuffer(v) - centre).reshape(model.parts, 1, -1)
                tables = ((model.books - rest) ** 2).sum(2)
                near = tables[np.arange(model.parts), c].sum(1)
                some = np.arange(len(ids))
                if len(some) > each:
                    some = some[near <= np.partition(near, each - 1)[each - 1]]
                some = some[np.lexsort((ids[some], near[some]))][:each]
                for name, value in zip(found, (np.full(len(some), q, np.int64), ids[some], near[some]), strict=True):
                    found[name].append(value)
        empty = {name: np.zeros(0, np.float64 if name == "near" else np.int64) for name in found}
        return pa.table({name: np.concatenate(v) if v else empty[name] for name, v in found.items()})

    chunks = np.maximum(1, -(-counted(wanted, "cell", len(of)) // chunk))
    many = {int(i): int(chunks[i]) for i in np.flatnonzero(chunks > 1)}
    copies = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in many.items() for x in kv]), F.col("cell")), F.lit(1)) if many else F.lit(1)
    left = index.drop("v").withColumn("chunk", F.explode(F.sequence(F.lit(0), copies - 1)))
    right = wanted.withColumn("chunk", F.pmod(F.xxhash64("query"), copies.cast("long")).cast("int"))
    return left.groupBy("cell", "chunk").cogroup(right.groupBy("cell", "chunk")).applyInArrow(scan, "query long, cls long, near double")


def search(
    table: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", rerank: int = 100, breadth: float = 2.5,
    part_rows: int = 20_000, train_rows: int = 20_000, list_sample: int = 64, chunk: int = 4096, tried: int = 128, miss: float = 0.04, seed: int = 9,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query row."""
    out = "query_id long, rank int, vec_id long, score double"
    spark = table.sparkSession
    sound = table.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where(usable(F.col("v")))
    sizes = sound.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], out)
    dims = sizes["d"]
    whole = F.transform("v", lambda x: x.cast("double") + F.lit(0.0))  # one zero
    vectors = keep(sound.where(F.size("v") == dims).withColumns({"row": F.monotonically_increasing_id(), "k1": F.xxhash64(whole), "k2": F.xxhash64(F.lit(seed), whole)}), "vectors")
    classes = keep(classes_of(vectors, k), "classes")
    n = classes.count()
    parts = next(p for p in (32, 16, 8, 4, 2, 1) if dims % p == 0)
    lists = int(np.clip(np.sqrt(n) / 2, 1, 4096))
    model = fit(classes.select(F.col("cls").alias("row"), "v"), n, lists, parts, 256, train_rows, seed)
    whole_lists = [model.coarse[i : i + 1] for i in range(len(model.coarse))]
    index = keep(encode(classes, model, whole_lists), "index")
    per_list = counted(index, "cell", len(whole_lists))
    centres = whole_lists
    if per_list.max() > part_rows:
        centres, coarse_index = divide(index.select("cls", "v", F.col("cell").alias("list")), model, per_list, part_rows, list_sample, seed), index
        index = keep(encode(classes, model, centres), "cells")
        drop(coarse_index)
    first = np.concatenate([[0], np.cumsum([len(c) for c in centres])])
    cells = Cells(np.concatenate(centres), first, counted(index, "cell", int(first[-1])))
    queries = vectors.where("q").select("row", F.col("vec_id").alias("query_id"), "k1", "k2")
    asked = classes.join(queries.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").select("cls", "k1", "k2", "v")
    probes = probes_of(len(model.coarse), breadth) * (1 if len(centres) == len(cells.sizes) else 2.5)
    width = widened(index, asked, model, cells, k, Width(int(probes), max(2 * k, -(-rerank // 5)), rerank), tried, miss, seed)
    wanted = keep(probed(asked, cells, width), "probes")
    near = scanned(index, wanted, model, cells, width.each, chunk)
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("near", "cls"))).where(F.col("r") <= width.rerank)
    square = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    mine = asked.select(F.col("cls").alias("query"), "k1", "k2", F.col("v").alias("qv"))
    exact = best.select("query", "cls").join(mine, "query").join(classes.select("cls", "v", "members"), "cls").select("k1", "k2", F.sqrt(square(F.col("qv"), F.col("v"))).alias("score"), F.explode("members").alias("m"))
    rank = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("score", F.col("m.vec_id").asc_nulls_last(), "m.row"))
    first_rows = exact.withColumn("r", rank).where(F.col("r") <= k + 1).groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("r", "score", "m"))).alias("near"))
    # every query row of a class takes the class's list without itself
    found = queries.join(first_rows, ["k1", "k2"]).select("query_id", F.slice(F.filter("near", lambda x: x["m"]["row"] != F.col("row")), 1, k).alias("near"))
    return found.select("query_id", F.posexplode("near").alias("i", "x")).select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("x.m.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op8_ann(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(table, F.col("vec_id") % 100 == 0)
