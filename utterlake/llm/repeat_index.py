"""Long repeats across a corpus by run-length compressed Burrows-Wheeler indexes.

A 200-byte window that starts at two or more places is removed wherever it
lies. The corpus cannot sit in one index, so its windows are first dealt by
content: each window belongs to the leftmost smallest hash of the byte k-grams
inside it (its anchor), and equal windows have equal anchors. Consecutive
windows of one anchor form a segment (the bytes they cover). Only segments
whose anchor occurs twice or more can hold repeats.

Identical segments collapse to one row with a count before anything is
gathered. Anchors with several different segments go, many anchors to a
bucket, into one index per bucket:

1. the bucket's text is sorted by suffix, transformed, and kept as runs;
2. the suffix-array neighbours are sampled at run ends only;
3. matching statistics stream over the text from these samples: between two
   samples the match with the neighbour shrinks by one byte a position;
4. windows whose longest match elsewhere reaches the length are marked.

Where more than `hot_anchor` different segments share an anchor (a frequent
line in many surroundings), they are cut again by longer k-grams, which hold
more of the surroundings, and at last by whole windows: equal windows stay
together at every step, and no index ever holds more than a bounded share.

Defined cases: a null text is empty; texts shorter than the window keep all
bytes; equal rows (even of one doc_id) are repeats of each other; an empty
table gives no rows; a null doc_id is kept as its own row; other columns pass
through; a clash with an output name raises.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ngrams import string_buffers
from .scratch import drop, keep

LENGTH = 200
#: Lengths of the k-grams that deal the windows: the next one where too many segments share one, the whole window at last.
GRAMS = (64, 128, 200)
MIX = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)
ODD = 0xD6E8FEB86659FD93
OWN = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "spans")


def gram_hashes(a: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all k-byte strings of a, put together from those of the powers of two in k."""
    h, m, s = MIX[a], ODD, 1
    out, done = None, 0
    while True:
        if k & s:
            out = h[: len(a) - s + 1] if out is None else h[: len(out) - s] * np.uint64(pow(ODD, done, 1 << 64)) + out[s:]
            done += s
        if done == k:
            break
        h = h[:-s] * np.uint64(m) + h[s:]
        m, s = m * m & 0xFFFFFFFFFFFFFFFF, s * 2
    out = out ^ (out >> np.uint64(29))
    out *= np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(32))


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    s = 1
    while s * 2 <= w:
        h, s = np.minimum(h[:-s], h[s:]), s * 2
    return np.minimum(h[: -(w - s)], h[w - s :]) if w > s else h


def segments(a: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window and number of windows of each segment of one text."""
    h = gram_hashes(a, k)
    low = sliding_min(h, length - k + 1)
    # a smaller hash enters, or the anchor was the window's first k-gram and leaves
    first = np.flatnonzero(np.concatenate(([True], (low[1:] != low[:-1]) | (h[: len(low) - 1] == low[:-1]))))
    return low[first], first, np.diff(np.append(first, len(low)))


def suffix_order(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; the separators at `ends` differ from each other, in order of place."""
    n = len(text)
    place = np.arange(n, dtype=np.int32)
    to_end = np.repeat(ends, np.diff(ends, prepend=-1)).astype(np.int32) - place
    # the first seven characters at once; nothing is read beyond a separator
    pad = np.zeros(n + 8, np.uint16)
    pad[:n] = text
    pad[:n] += 1
    key = np.zeros(n, np.uint64)
    for i in range(7):
        key <<= np.uint64(9)
        key |= np.where(to_end > i, pad[i : i + n], 0).astype(np.uint64)
    order = np.argsort(key, kind="stable").astype(np.int32)
    key = key[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    del key, pad
    rank, step = np.empty(n, np.int32), 7
    while True:
        head = np.maximum.accumulate(np.where(new, place, 0))
        rank[order] = head
        lone = new & np.append(new[1:], True)
        if lone.all():
            return order
        # only suffixes that still share their rank are sorted again
        where = np.flatnonzero(~lone)
        pos, head = order[where], head[where]
        over = to_end[pos] < step  # the separator lies within what is equal: its place decides
        after = np.where(over, pos, rank[np.minimum(pos + step, n - 1)])
        sub = np.argsort(head.astype(np.int64) << 32 | after, kind="stable")
        order[where] = pos[sub]
        g, x = head[sub], after[sub]
        new[where] = np.concatenate(([True], (g[1:] != g[:-1]) | (x[1:] != x[:-1])))
        step *= 2


def run_index(text: np.ndarray, ends: np.ndarray) -> tuple:
    """Runs of the transform with samples: text places of run starts and their predecessors, of run ends and their successors; the first and the last suffix."""
    sa = suffix_order(text, ends)
    prev = sa - 1
    bwt = np.where(prev >= 0, text[prev], 255).astype(np.int64)
    sep = np.flatnonzero(bwt == 255)
    bwt[sep] = 256 + np.arange(len(sep))  # every separator is its own character
    start = np.flatnonzero(bwt[1:] != bwt[:-1]) + 1
    return sa[start], sa[start - 1], sa[start - 1], sa[start], sa[0], sa[-1]


def common_prefix(text: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b within their segments, up to most."""
    room = np.minimum(ends[np.searchsorted(ends, a)] - a, ends[np.searchsorted(ends, b)] - b)
    room = np.minimum(room, most)
    out = np.zeros(len(a), np.int64)
    live = np.flatnonzero(room > 0)
    wide = np.concatenate([text, np.zeros(16, np.uint8)])
    words = np.lib.stride_tricks.as_strided(wide, (len(text) + 8, 8), (1, 1))
    while len(live):
        x, y = words[a[live] + out[live]], words[b[live] + out[live]]
        same = x == y
        step = np.where(same.all(axis=1), 8, np.argmin(same, axis=1))
        out[live] += step
        live = live[(step == 8) & (out[live] < room[live])]
    return np.minimum(out, room)


def matching_statistics(text: np.ndarray, ends: np.ndarray, most: int) -> np.ndarray:
    """For each place the longest match that also starts elsewhere in the text, up to most, streamed from the run samples."""
    at_start, before, at_end, after, first, last = run_index(text, ends)
    best = np.zeros(len(text), np.int64)
    place = np.arange(len(text))
    for here, there, lone in ((at_start, before, first), (at_end, after, last)):
        # a full common prefix is needed, not one cut at `most`: it is what shrinks along the text
        lcp = np.append(common_prefix(text, ends, here, there, 1 << 30), 0)
        here = np.append(here, lone)
        o = np.argsort(here, kind="stable")
        here, lcp = here[o], lcp[o]
        i = np.searchsorted(here, place, side="right") - 1
        best = np.maximum(best, np.where(i >= 0, lcp[i] - (place - here[i]), 0))
    return np.minimum(best, most)


def mark(texts: list[bytes], many: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """Ranges [from, to) of windows of each distinct segment that occur elsewhere; many: the segment itself occurs again."""
    joined = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    hit = matching_statistics(joined, ends, length) >= length
    out, start = [], 0
    for t, again, end in zip(texts, many, ends.tolist(), strict=True):
        windows = len(t) - length + 1
        if again:
            out.append([(0, windows)])
        else:
            flag = np.diff(np.concatenate(([0], hit[start : start + windows].astype(np.int8), [0])))
            out.append(list(zip(np.flatnonzero(flag == 1).tolist(), np.flatnonzero(flag == -1).tolist(), strict=True)))
        start = end + 1
    return out


CUTS = pa.schema([("row", pa.int64()), ("tag", pa.int64()), ("anchor", pa.int64()), ("seg", pa.int64()), ("lo", pa.int32()), ("n", pa.int32()), ("times", pa.int64())])
CUTS_SQL = "row long, tag long, anchor long, seg long, lo int, n int, times long"
BODIES = pa.schema([("anchor", pa.int64()), ("seg", pa.int64()), ("times", pa.int64()), ("kinds", pa.int64()), ("body", pa.binary())])
BODIES_SQL = "anchor long, seg long, times long, kinds long, body binary"


def cut_segments(docs: DataFrame, length: int, gram: int, most: int = 100_000) -> DataFrame:
    """docs: row, tag, text, times. The segments of every text, in batches of about `most`."""

    def cut(batches):
        out, size = {k: [] for k in CUTS.names}, 0
        for batch in batches:
            data, at = string_buffers(batch.column(2))
            for row, tag, times, a, b in zip(*[batch.column(i).to_pylist() for i in (0, 1, 3)], at[:-1].tolist(), at[1:].tolist(), strict=True):
                if b - a < length:
                    continue
                anchor, lo, n = segments(data[a:b], length, gram)
                raw = data[a:b].tobytes()
                seg = [xxhash.xxh3_64_intdigest(raw[i : i + m + length - 1]) for i, m in zip(lo.tolist(), n.tolist(), strict=True)]
                same = [np.full(len(lo), v, np.int64) for v in (row, tag, times)]
                for k, v in zip(CUTS.names, (same[0], same[1], anchor.view(np.int64), np.array(seg, np.uint64).view(np.int64), lo.astype(np.int32), n.astype(np.int32), same[2]), strict=True):
                    out[k].append(v)
                size += len(lo)
                if size >= most:
                    yield pa.RecordBatch.from_pydict({k: np.concatenate(v) for k, v in out.items()}, schema=CUTS)
                    out, size = {k: [] for k in CUTS.names}, 0
        if size:
            yield pa.RecordBatch.from_pydict({k: np.concatenate(v) for k, v in out.items()}, schema=CUTS)

    return docs.select("row", "tag", "text", "times").mapInArrow(cut, CUTS_SQL)


def fetch_bodies(texts: DataFrame, length: int, most: int = 2 << 20) -> DataFrame:
    """texts: text, w (segments wanted of it). The bytes of each segment, in batches of about `most` bytes."""

    def fetch(batches):
        out, size = {k: [] for k in BODIES.names}, 0
        for batch in batches:
            for text, w in zip(batch.column(0), batch.column(1), strict=True):
                raw = text.as_py()
                raw = raw.encode() if isinstance(raw, str) else raw
                for x in w.as_py():
                    body = raw[x["lo"] : x["lo"] + x["n"] + length - 1]
                    for k in BODIES.names[:4]:
                        out[k].append(x[k])
                    out["body"].append(body)
                    size += len(body) + 32
                if size >= most:
                    yield pa.RecordBatch.from_pydict(out, schema=BODIES)
                    out, size = {k: [] for k in BODIES.names}, 0
        yield pa.RecordBatch.from_pydict(out, schema=BODIES)

    return texts.mapInArrow(fetch, BODIES_SQL)


def repeated_ranges(docs: DataFrame, length: int = LENGTH, grams: tuple[int, ...] = GRAMS, bucket_bytes: int = 1 << 19, hot_anchor: int = 2000) -> DataFrame:
    """docs: row long, tag long, text, times (how often the text occurs); row and tag name a text, equal rows share both. Returns row, tag, lo, hi: byte ranges, one row each, that repeated windows cover."""
    every = keep(cut_segments(docs, length, grams[0]), "segments")
    # counts are summed before the shuffle; then only what has an anchor in common goes on
    busy = keep(every.groupBy("anchor").agg(F.sum("times").alias("total")).where("total > 1").select("anchor"), "busy")
    cuts = keep(every.join(busy, "anchor", "left_semi"), "repeated")
    drop(every)
    drop(busy)
    seg = keep(cuts.groupBy("anchor", "seg").agg(F.sum("times").alias("times"), F.min(F.struct("row", "tag", "lo", "n")).alias("at")), "distinct")
    kinds = keep(seg.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "kinds")
    whole = seg.where("times > 1").select("anchor", "seg", F.lit(0).alias("first"), F.col("at.n").alias("past"))
    mixed = seg.join(kinds, "anchor").select("at.row", "at.tag", "anchor", "seg", "times", "kinds", "at.lo", "at.n")

    # the bytes of one copy of each segment that has to be compared; equal rows are one before they meet what is wanted of them
    wanted = mixed.groupBy("row", "tag").agg(F.collect_list(F.struct("anchor", "seg", "times", "kinds", "lo", "n")).alias("w"))
    unique = docs.groupBy("row", "tag").agg(F.first("text").alias("text"))
    bodies = keep(fetch_bodies(unique.join(wanted, ["row", "tag"]).select("text", "w"), length), "bodies")
    drop(kinds)
    few = bodies.where(F.col("kinds") <= hot_anchor) if len(grams) > 1 else bodies
    size = few.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))

    def index(group: pa.Table) -> pa.Table:
        group = group.sort_by([("anchor", "ascending"), ("seg", "ascending")])
        texts, many = group["body"].to_pylist(), group["times"].to_numpy() > 1
        rows = [(i, a, b) for i, (ranges, again) in enumerate(zip(mark(texts, many, length), many, strict=True)) if not again for a, b in ranges]
        pick = pa.array([r[0] for r in rows], pa.int64())
        return pa.table({"anchor": group["anchor"].take(pick), "seg": group["seg"].take(pick), "first": pa.array([r[1] for r in rows], pa.int32()), "past": pa.array([r[2] for r in rows], pa.int32())})

    marked = few.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets))).groupBy("bucket").applyInArrow(index, "anchor long, seg long, first int, past int")
    found = whole.unionByName(marked)
    if len(grams) > 1:
        again = bodies.where(F.col("kinds") > hot_anchor).select(F.col("anchor").alias("row"), F.col("seg").alias("tag"), F.col("body").alias("text"), "times")
        if not again.isEmpty():
            deeper = repeated_ranges(again, length, grams[1:], bucket_bytes, hot_anchor)
            found = found.unionByName(deeper.select(F.col("row").alias("anchor"), F.col("tag").alias("seg"), F.col("lo").alias("first"), (F.col("hi") - length + 1).cast("int").alias("past")))
    ranges = keep(cuts.join(found, ["anchor", "seg"]).select("row", "tag", (F.col("lo") + F.col("first")).alias("lo"), (F.col("lo") + F.col("past") + length - 1).alias("hi")), "ranges")
    for table in (cuts, seg, bodies):
        drop(table)
    return ranges


def merge(lo: list[int], hi: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of ranges that overlap or touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(lo, hi, strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def row_tag(key: Column, text: Column) -> dict[str, Column]:
    """row and tag: two 64-bit hashes with different seeds of id, its null flag and text."""
    return {name: F.xxhash64(F.lit(seed), key.isNull(), key, text.isNull(), text) for name, seed in (("row", 41), ("tag", 42))}


def remove_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept_sha256, spans and kept_text (remaining bytes; what a cut leaves of a broken character is dropped from it)."""
    if clash := {*OWN, "row", "tag", "ranges"} & set(docs.columns):
        raise ValueError(f"columns already present: {sorted(clash)}")
    # a row is known by 128 bits of its id, null or not, and its text; equal rows share them and so their ranges
    numbered = docs.withColumns(row_tag(F.col(key), F.col(text)))
    body = numbered.select("row", "tag", F.coalesce(F.col(text), F.lit("")).alias("text"), F.lit(1).cast("long").alias("times"))
    ranges = repeated_ranges(body, length, **options)
    per_row = keep(ranges.groupBy("row", "tag").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges")), "cover")
    joined = numbered.join(per_row, ["row", "tag"], "left")
    at = docs.columns.index(text)
    cols = docs.columns
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))]

    def some(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = {k: [] for k in OWN}
        for t, r in zip(batch.column(at), batch.column(len(cols)), strict=True):
            raw = (t.as_py() or "").encode()
            runs = merge([x["lo"] for x in r.as_py()], [x["hi"] for x in r.as_py()]) if r.is_valid else []
            kept, pos = [], 0
            for a, b in runs:
                kept.append(raw[pos:a])
                pos = b
            kept = b"".join([*kept, raw[pos:]])
            out["n_bytes"].append(len(raw))
            out["n_removed"].append(len(raw) - len(kept))
            out["n_spans"].append(len(runs))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept_text"].append(kept.decode("utf-8", "ignore"))
            out["spans"].append([{"lo": a, "hi": b} for a, b in runs])
        return pa.RecordBatch.from_arrays([*batch.columns[: len(cols)], *[pa.array(out[k], kind) for k, kind in zip(OWN, types, strict=True)]], [*cols, *OWN])

    def apply(batches):
        for batch in batches:
            for i in range(0, len(batch), 1000):
                yield some(batch.slice(i, 1000))

    ordered = joined.select(*cols, "ranges")
    schema = docs.selectExpr(*[f"`{c}`" for c in cols], "0L n_bytes", "0L n_removed", "0L n_spans", "'' kept_sha256", "'' kept_text", "cast(array() as array<struct<lo:bigint,hi:bigint>>) spans").schema
    return ordered.mapInArrow(apply, schema)


def op5_suffix_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
