"""Best-fit packing of token pieces into sequences of a fixed capacity, bulk-synchronously.

Pieces and gaps are compared by size only, so rounds run over classes: a row
stands for all unplaced pieces of one length, or for consecutive sequences
with the same gap. The size axis is cut into ranges. In each round every
range is sorted and swept by itself: a gap takes the largest piece that fits,
that is, each piece goes to its successor among the gaps; where several
lengths want one gap, the longer ranks first. Gaps shrink and move to the
range of their new size, pieces to the lowest range with a gap for them, and
the round repeats; pieces larger than every gap open new sequences. The class tables are bounded by capacity times rounds,
whatever the corpus. Pieces are told apart only at the end, by their rank
within their length, counted in each task and offset by the other tasks'
counts; no length, however frequent, is gathered anywhere.

Defined cases: a null or empty text is its end token alone; only texts longer
than the capacity are cut; pieces of full length have a sequence of their
own; repeated rows are packed each; an empty table gives no rows; other
columns are left out, so their names never clash.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encoder, vocabulary
from .scratch import keep

PIECE, GAP, PLACED = 0, 1, 2
STATE = "kind int, zone int, size int, n long, first long, bin long, per int, off int"
STATE_ARROW = pa.schema([("kind", pa.int32()), ("zone", pa.int32()), ("size", pa.int32()), ("n", pa.int64()), ("first", pa.int64()), ("bin", pa.int64()), ("per", pa.int32()), ("off", pa.int32())])
PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("local", pa.int64())])
PIECES_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long"


def slices(texts: pa.Array, most: int = 2 << 20) -> list[pa.Array]:
    """Consecutive texts of about `most` bytes, one at least."""
    size = pc.binary_length(texts).fill_null(0).to_numpy().astype(np.int64)
    edge = np.flatnonzero(np.diff((np.cumsum(size) - size) // most, prepend=-1)).tolist()
    return [texts.slice(a, z - a) for a, z in zip(edge, [*edge[1:], len(texts)], strict=False)]


def cut_pieces(docs: DataFrame, capacity: int, end_id: int, path: str) -> DataFrame:
    """docs: doc_id, text. One row a piece; local: its number among the task's pieces of the same length."""

    def cut(batches):
        known, seen, part = encoder(path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            docs_ = iter(batch.column(0).to_pylist())
            for texts in slices(batch.column(1)):
                out = {k: [] for k in PIECES.names}
                for ids, doc in zip(known.ids(texts), docs_, strict=False):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for no, start in enumerate(range(0, len(ids), capacity)):
                        p = ids[start : start + capacity]
                        for k, v in zip(PIECES.names, (doc, no, start, len(p), zlib.crc32(p.tobytes()), part, int(seen[len(p)])), strict=True):
                            out[k].append(v)
                        seen[len(p)] += 1
                yield pa.RecordBatch.from_pydict(out, schema=PIECES)
        pa.default_memory_pool().release_unused()  # the Python worker waits for its next task beside the others

    return docs.mapInArrow(cut, PIECES_SQL)


def sweep(pieces: list[list[int]], gaps: list[list[int]], capacity: int, least: int) -> tuple[list, list, list]:
    """One range, again and again until nothing fits; gaps of at most `least` are another range's. pieces [size, n, first rank], gaps [size, n, first sequence]. Returns pieces and gaps left, and placements (size, first rank, n, first sequence, per sequence, offset)."""
    placed, gone = [], []
    while pieces and gaps:
        pieces.sort()
        gaps.sort()
        stack, rest, i, moved = [], [], 0, False
        for g, n, first in gaps:
            while i < len(pieces) and pieces[i][0] <= g:
                stack.append(pieces[i])
                i += 1
            while n and stack:
                size, count, rank = stack[-1]
                per = max(1, min(g // size, count // n)) if count >= n else 1
                bins = n if count >= n else count
                placed.append((size, rank, bins * per, first, per, capacity - g))
                moved = True
                if g > per * size:
                    (rest if g - per * size > least else gone).append([g - per * size, bins, first])
                if count == bins * per:
                    stack.pop()
                else:
                    stack[-1] = [size, count - bins * per, rank + bins * per]
                n, first = n - bins, first + bins
            if n:
                rest.append([g, n, first])
        pieces, gaps = stack + pieces[i:], rest
        if not moved:
            break
    return pieces, gaps + gone, placed


def round_of(number: int, zones: int, width: int, capacity: int):
    """The work of one range in one round."""

    def one(group: pa.Table) -> pa.Table:
        z = group["zone"][0].as_py()
        rows = list(zip(*[group[k].to_pylist() for k in ("kind", "size", "n", "first", "bin")], strict=True))
        pieces = [[size, n, first] for kind, size, n, first, _ in rows if kind == PIECE]
        out = []
        if z >= zones:  # nothing open is large enough: new sequences
            need = -(-sum(size * n for size, n, _ in pieces) // capacity)
            out = [(PIECE, 0, size, n, first, 0, 0, 0) for size, n, first in pieces]
            out.append((GAP, zones - 1, capacity, need, 0, number << 40, 0, 0))
        else:
            gaps = [[size, n, bin_] for kind, size, n, _, bin_ in rows if kind == GAP]
            pieces, gaps, placed = sweep(pieces, gaps, capacity, z * width)
            out = [(PIECE, 0, size, n, first, 0, 0, 0) for size, n, first in pieces]
            out += [(GAP, (g - 1) // width, g, n, 0, first, 0, 0) for g, n, first in gaps]
            out += [(PLACED, -1, size, n, rank, bin_, per, off) for size, rank, n, bin_, per, off in placed]
        return pa.table({f.name: pa.array([r[i] for r in out], f.type) for i, f in enumerate(STATE_ARROW)})

    return one


def pack_lengths(spark: SparkSession, lengths: DataFrame, capacity: int, zones: int = 4) -> DataFrame:
    """lengths: length, n. Placements (length, first, n, bin, per, off) of all pieces shorter than the capacity."""
    width = -(-capacity // zones)
    total = lengths.agg(F.sum(F.col("length") * F.col("n"))).first()[0] or 0
    zone = lambda size: ((size - 1) / width).cast("int")
    nil = F.lit(0)
    state = lengths.select(F.lit(PIECE).alias("kind"), zone(F.col("length")).alias("zone"), F.col("length").cast("int").alias("size"), F.col("n").cast("long").alias("n"), nil.cast("long").alias("first"), nil.cast("long").alias("bin"), nil.alias("per"), nil.alias("off"))
    opened = [(GAP, zones - 1, capacity, -(-total // capacity), 0, 0, 0, 0)] if total else []
    state = state.unionByName(spark.createDataFrame(opened, STATE))
    rounds: list[DataFrame] = []
    while True:
        size, is_gap = F.col("size"), F.col("kind") == GAP
        most = {r["zone"]: r["most"] for r in state.where(is_gap).groupBy("zone").agg(F.max("size").alias("most")).collect()}
        home = F.lit(zones)
        for z in sorted(most, reverse=True):
            home = F.when(size <= most[z], F.lit(z)).otherwise(home)
        state = state.withColumn("zone", F.when(is_gap, F.col("zone")).otherwise(home))
        state = keep(state.groupBy("zone").applyInArrow(round_of(len(rounds) + 1, zones, width, capacity), STATE), "round")
        rounds.append(state.where(F.col("kind") == PLACED))
        state = state.where(F.col("kind") != PLACED)
        if state.where(F.col("kind") == PIECE).isEmpty():
            break
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out.select(F.col("size").cast("long").alias("length"), "first", "n", "bin", "per", "off")


def placed_pieces(ranked: DataFrame, placements: DataFrame, block: int = 1 << 12) -> DataFrame:
    """Each piece with the placement that starts last at or before its rank, if any. A length is dealt by blocks of ranks, placements are cut at them: a frequent length is many groups, and each is met in one pass."""
    last = F.col("first") + F.col("n") - 1
    cut = placements.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor(last / block))))
    none = F.lit(None)
    cut = cut.select("length", "block", F.greatest("first", F.col("block") * block).alias("rank"), F.lit(0).alias("turn"), F.struct("first", "bin", "per", "off").alias("p"))
    own = [c for c in ranked.columns if c not in ("length", "rank")]
    asked = ranked.select("length", F.floor(F.col("rank") / block).alias("block"), "rank", F.lit(1).alias("turn"), none.cast(cut.schema["p"].dataType).alias("p"), F.struct(*own).alias("own"))
    both = cut.withColumn("own", none.cast(asked.schema["own"].dataType)).unionByName(asked)
    so_far = Window.partitionBy("length", "block").orderBy("rank", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("p", F.last("p", ignorenulls=True).over(so_far)).where("turn = 1").select("length", "rank", "own.*", "p.*")


def pack(docs: DataFrame, capacity: int = 4096, end_id: int = 1, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = keep(cut_pieces(docs, capacity, end_id, path or vocabulary()), "pieces")
    per_part = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    lengths = keep(per_part.groupBy("length").agg(F.sum("n").alias("n")), "lengths")
    placements = keep(pack_lengths(spark, lengths.where(F.col("length") < capacity), capacity), "placements")
    # rank within a length: the task's own count after those of earlier tasks; a row for each task and length
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = per_part.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("local")).drop("part", "local", "before")
    packed = placed_pieces(ranked, placements)
    inside = F.col("rank") - F.col("first")
    whole = F.col("length") == capacity
    return packed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.when(whole, -1 - F.col("rank")).otherwise(F.col("bin") + F.floor(inside / F.col("per"))).cast("long").alias("sequence_id"),
        F.when(whole, F.lit(0)).otherwise(F.col("off") + F.pmod(inside, F.col("per").cast("long")) * F.col("length")).cast("long").alias("offset"),
    )


def op4_packing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs)
