"""N-gram Jaccard join: documents whose sets of five-word shingles have similarity 0.75 or more.

Documents with equal sets are one class. Sets travel as packed postings,
dealt by shingle: where a shingle's postings meet, its exact document
frequency is known and shingles of a single class are dropped, since they can
be in no intersection. Dealt back by class, the rarest-first order is then
exact: unshared shingles first, shared ones by frequency. A class goes on
only if enough of it is shared (length and prefix filter), with the shared
shingles of its prefix and their positions.

Classes meet on prefix shingles. Pairs pass the length and positional filters,
then a suffix filter (shingle counts in hash ranges bound the overlap) before
the one exact intersection. Pairs inside a
component say nothing new, so stars come first: each class meets the hub of
its prefix shingles; components form; then the hub of the other components;
components form again; and only then do
all remaining pairs between different components meet, the smaller class
asking only the bands of sizes that its own size and position allow. No link
between different components is lost.

Defined cases: null, empty and blank texts have the empty set and are linked
with nothing; texts of fewer than five words have one shingle; repeated rows
are linked; a null doc_id never names a component; an empty table gives no
rows; other columns are left out, so their names never clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ngrams import string_buffers
from .repeat_index import row_tag
from .scratch import drop, keep

WORDS = 5
MIX = np.random.default_rng(31).integers(0, 1 << 64, 256, dtype=np.uint64)
TURN = np.random.default_rng(32).integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = 0xD6E8FEB86659FD93
RANGES = 64
HUBS = 2
CHUNK = 1 << 20
#: Rows of a written table that may be broadcast; a larger one is joined by a shuffle.
SMALL = 250_000


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of UTF-8 bytes, ASCII capitals read as small letters."""
    low = np.where((text >= 65) & (text <= 90), text + np.uint8(32), text)
    gap = (low == 32) | ((low >= 9) & (low <= 13))
    word = ~gap
    start = np.flatnonzero(word & np.concatenate(([True], gap[:-1]))) if len(text) else np.zeros(0, np.int64)
    if not len(start):
        return start, np.zeros(0, np.uint64)
    place = np.arange(len(text)) - np.repeat(start, np.diff(np.append(start, len(text)))) if start[0] == 0 else None
    if place is None:
        place = np.concatenate([np.zeros(start[0], np.int64), np.arange(start[0], len(text)) - np.repeat(start, np.diff(np.append(start, len(text))))])
    power = np.full(int(place.max()) + 1, STEP, np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    value = MIX[low] * power[place]
    value[gap] = 0
    return start, mixed(np.add.reduceat(value, start))


def shingle_sets(column: pa.Array):
    """(row, sorted distinct shingle hashes) of every row of a string column."""
    data, at = string_buffers(column)
    row, last = 0, len(at) - 1
    while row < last:
        end = int(np.searchsorted(at, at[row] + CHUNK, side="right")) - 1
        end = min(max(end, row + 1), last)
        # a space after each text keeps its words apart from the next one's
        lens = np.diff(at[row : end + 1])
        buf = np.full(int(lens.sum()) + len(lens), 32, np.uint8)
        shift = np.arange(len(lens))
        buf[np.arange(int(lens.sum())) + np.repeat(shift, lens)] = data[at[row] : at[end]]
        first = at[row : end + 1] - at[row] + np.arange(len(lens) + 1)
        start, h = word_hashes(buf)
        cut = np.searchsorted(start, first)
        grams = np.zeros(0, np.uint64)
        if len(h) >= WORDS:
            m = len(h) - WORDS + 1
            grams = h[:m] * TURN[0]
            for k in range(1, WORDS):
                grams = grams + h[k : k + m] * TURN[k]
            grams = mixed(grams)
        for i in range(len(lens)):
            a, b = int(cut[i]), int(cut[i + 1])
            if b - a >= WORDS:
                yield row + i, np.unique(grams[a : b - WORDS + 1])
            elif b > a:
                yield row + i, mixed((h[a:b] * TURN[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
            else:
                yield row + i, np.zeros(0, np.uint64)
        row = end


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two order-free 64-bit values of a set, as signed numbers; the first names its class."""
    a = mixed(s).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s))
    b = mixed(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64, keepdims=True)
    return int(mixed(a).view(np.int64)[0]), int(b.view(np.int64)[0])


def pack(a: np.ndarray) -> bytes:
    """An integer array byte by byte, compressed."""
    raw = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b""
    return len(a).to_bytes(4, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpack(b: bytes, dtype) -> np.ndarray:
    n, size = int.from_bytes(b[:4], "little"), np.dtype(dtype).itemsize
    if not n:
        return np.zeros(0, dtype)
    raw = pa.decompress(b[4:], decompressed_size=n * size, codec="zstd", asbytes=True)
    return np.frombuffer(raw, np.uint8).reshape(size, n).T.copy().view(dtype).ravel()


def delta(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=np.zeros(1, a.dtype)))


def undelta(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, np.uint64), dtype=np.uint64)


def range_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def range_edges(token: np.ndarray, n: int):
    """(from, to, range) of the ranges of n that sorted hashes fall into."""
    top = (token >> np.uint64(32)).astype(np.uint32)
    a = 0
    while a < len(top):
        bucket = int(range_of(token[a : a + 1], n)[0])
        least = -(-(bucket + 1 << 32) // n)  # the smallest upper half that belongs to the next range
        b = int(np.searchsorted(top, least)) if least < 1 << 32 else len(top)
        yield a, b, bucket
        a = b


POSTINGS = pa.schema([("bucket", pa.int64()), ("tokens", pa.binary()), ("owner", pa.binary()), ("cls", pa.binary()), ("n", pa.binary())])
POSTINGS_SQL = "bucket long, tokens binary, owner binary, cls binary, n binary"
SHARED = pa.schema([("bucket", pa.int64()), ("cls", pa.binary()), ("n", pa.binary()), ("many", pa.binary()), ("tokens", pa.binary()), ("df", pa.binary())])
SHARED_SQL = "bucket long, cls binary, n binary, many binary, tokens binary, df binary"
CLASSES = pa.schema([("cls", pa.int64()), ("n", pa.int32()), ("tokens", pa.binary()), ("prefix", pa.list_(pa.int64())), ("pos", pa.int32()), ("hub", pa.float64()), ("hist", pa.list_(pa.int32()))])
CLASSES_SQL = "cls long, n int, tokens binary, prefix array<long>, pos int, hub double, hist array<int>"


def postings(docs: DataFrame, buckets: int, most: int = 2_000_000) -> DataFrame:
    """docs: text. Packed (shingle, class) lists, dealt by ranges of the shingle hash."""

    def flush(sets: list[np.ndarray], cls: list[int]):
        n = np.array([len(s) for s in sets], np.int32)
        token = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), n)
        names = np.array(cls, np.int64)
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        del order
        # hashes are sorted, so each range's end is found by search
        for a, b, bucket in range_edges(token, buckets):
            here, local = np.unique(owner[a:b], return_inverse=True)
            yield pa.RecordBatch.from_pydict(
                {"bucket": [bucket], "tokens": [delta(token[a:b])], "owner": [pack(local.astype(np.int32))], "cls": [pack(names[here])], "n": [pack(n[here])]}, schema=POSTINGS
            )

    def cut(batches):
        sets, cls, seen, total = [], [], set(), 0
        for batch in batches:
            for _, s in shingle_sets(batch.column(0)):
                if not len(s):
                    continue
                name, _ = fingerprint(s)
                if name in seen:
                    continue
                seen.add(name)
                sets.append(s)
                cls.append(name)
                total += len(s)
                if total >= most:
                    yield from flush(sets, cls)
                    sets, cls, seen, total = [], [], set(), 0
        if sets:
            yield from flush(sets, cls)

    return docs.mapInArrow(cut, POSTINGS_SQL)


def meet(buckets: int):
    """Postings of one range of shingles: those of two or more classes, dealt by class, with frequencies."""

    def one(group: pa.Table) -> pa.Table:
        names = [unpack(c, np.int64) for c in group["cls"].to_pylist()]
        cls, at = np.unique(np.concatenate(names), return_inverse=True)  # a number for each class of the range
        n = np.zeros(len(cls), np.int32)
        n[at] = np.concatenate([unpack(k, np.int32) for k in group["n"].to_pylist()])
        start = np.cumsum([0, *map(len, names)])
        owner = np.concatenate([at[a:b].astype(np.int32)[unpack(o, np.int32)] for a, b, o in zip(start[:-1], start[1:], group["owner"].to_pylist(), strict=True)])
        token = np.concatenate([undelta(t) for t in group["tokens"].to_pylist()])
        order = np.argsort(token, kind="stable").astype(np.int32)
        token, owner = token[order], owner[order]
        same = token[1:] == token[:-1]
        twice = np.concatenate(([False], same)) | np.concatenate((same, [False]))  # most shingles occur once
        token, owner = token[twice], owner[twice]
        del order, same, twice
        order = np.lexsort((owner, token))
        token, owner = token[order], owner[order]
        fresh = np.concatenate(([True], (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])))[: len(token)]
        token, owner = token[fresh], owner[fresh]
        head = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))[: len(token)])
        many = np.diff(np.append(head, len(token)))
        df = np.repeat(many, many)
        keep_ = df > 1
        token, df = token[keep_], df[keep_]
        cls, n = cls[owner[keep_]], n[owner[keep_]]
        to = range_of(cls.view(np.uint64), buckets)
        order = np.lexsort((cls, to))
        token, cls, n, df, to = token[order], cls[order], n[order], df[order], to[order]
        rows = {k: [] for k in SHARED.names}
        edge = np.flatnonzero(np.diff(to, prepend=np.uint64(1 << 63))) if len(to) else np.zeros(0, np.int64)
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(to)][: len(edge)], strict=True):
            first = np.flatnonzero(np.concatenate(([True], cls[a + 1 : b] != cls[a : b - 1]))) + a
            many = np.diff(np.append(first, b)).astype(np.int32)
            for k, v in zip(SHARED.names, (int(to[a]), pack(cls[first]), pack(n[first]), pack(many), pack(token[a:b]), pack(np.minimum(df[a:b], 1 << 30).astype(np.int32))), strict=True):
                rows[k].append(v)
        return pa.table(rows, schema=SHARED)

    return one


def prefixes(group: pa.Table) -> pa.Table:
    """Classes of one range that share enough: their shared shingles, and the shared part of the rarest-first prefix."""
    cls, n, token, df = [], [], [], []
    for c, k, m, t, d in zip(*[group[x].to_pylist() for x in ("cls", "n", "many", "tokens", "df")], strict=True):
        many = unpack(m, np.int32)
        cls.append(np.repeat(unpack(c, np.int64), many))
        n.append(np.repeat(unpack(k, np.int32), many))
        token.append(unpack(t, np.uint64))
        df.append(unpack(d, np.int32))
    cls, n, token, df = np.concatenate(cls), np.concatenate(n), np.concatenate(token), np.concatenate(df)
    order = np.lexsort((token, df, cls))
    cls, n, token, df = cls[order], n[order], token[order], df[order]
    head = np.flatnonzero(np.concatenate(([True], cls[1:] != cls[:-1])))
    rows = {k: [] for k in CLASSES.names}
    for a, b in zip(head.tolist(), [*head[1:].tolist(), len(cls)], strict=True):
        size, shared = int(n[a]), b - a
        need = -(-3 * size // 4)
        if shared < need:
            continue
        lone = size - shared
        prefix = token[a : a + size - need + 1 - lone]
        for k, v in zip(CLASSES.names, (int(cls[a]), size, np.sort(token[a:b]).tobytes(), prefix.view(np.int64).tolist(), lone, float(df[a:b].sum() / size), np.bincount(range_of(token[a:b], RANGES).astype(np.int64), minlength=RANGES).tolist()), strict=True):
            rows[k].append(v)
    return pa.table(rows, schema=CLASSES)


def verified(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """pairs: x, y, nx, ny. Those with 7 * intersection >= 3 * (nx + ny)."""
    sets = classes.select("cls", "tokens")
    hubs = sets.join(pairs.select(F.col("y").alias("cls")), "cls", "left_semi")
    both = pairs.join(sets.toDF("x", "tx"), "x").join(hubs.toDF("y", "ty"), "y").select("x", "y", "nx", "ny", "tx", "ty")

    def test(batches):
        for batch in batches:
            ok = []
            for nx, ny, tx, ty in zip(*[batch.column(i).to_pylist() for i in (2, 3, 4, 5)], strict=True):
                a, b = np.frombuffer(tx, np.uint64), np.frombuffer(ty, np.uint64)
                need = -(-3 * (nx + ny) // 7)
                merged = np.concatenate([a, b])
                merged.sort()
                ok.append(int((merged[1:] == merged[:-1]).sum()) >= need)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok)], ["x", "y", "ok"])

    return both.mapInArrow(test, "x long, y long, ok boolean").where("ok").select("x", "y")


def components(edges: DataFrame) -> DataFrame:
    """cls, label: the smallest class of each component of two classes and more, by minimum labels and pointer jumps."""
    both = edges.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(edges.select(F.col("y").alias("a"), F.col("x").alias("b"))).distinct()
    both = keep(both, "edges")
    # every class starts from the least of itself and its neighbours
    labels = keep(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("cls"), F.least("a", "low").alias("label")), "labels")
    hint = hint_for(labels)
    while True:
        low = both.join(hint(labels), both["b"] == labels["cls"]).groupBy("a").agg(F.min("label").alias("low"))
        step = labels.join(low, labels["cls"] == low["a"]).select("cls", F.least("label", "low").alias("label"), F.col("label").alias("was"))
        jump = hint(labels.toDF("mid", "far"))
        step = step.join(jump, step["label"] == jump["mid"]).select("cls", F.least("label", "far").alias("label"), (F.least("label", "far") != F.col("was")).alias("moved"))
        done = keep(step, "labels")
        still = done.where("moved").isEmpty()
        drop(labels)
        kept_at = done._kept_at
        labels = done.select("cls", "label")
        labels._kept_at = kept_at
        if still:
            drop(both)
            return labels


BEST = ("hub", "cls", "label", "n", "pos")


def hint_for(kept: DataFrame):
    """What to do with a written table of these rows before a join: broadcast it if they are few, nothing else."""
    return F.broadcast if kept.limit(SMALL + 1).count() <= SMALL else lambda df: df


def small(kept: DataFrame) -> DataFrame:
    return hint_for(kept)(kept)


def near(pairs: DataFrame) -> DataFrame:
    """pairs: cls, n, pos and c2, n2, p2 of two classes on a common prefix shingle. After the length and positional filters: x < y, their sizes and how many shingles met."""
    long_enough = (F.col("n") * 4 >= F.col("n2") * 3) & (F.col("n2") * 4 >= F.col("n") * 3)
    need = F.ceil((F.col("n") + F.col("n2")) * 3 / 7.0)
    # the first common shingle of a similar pair leaves enough behind it on both sides
    early = (F.col("pos") <= F.col("n") - need) & (F.col("p2") <= F.col("n2") - need)
    flip = lambda a, b: F.when(F.col("cls") < F.col("c2"), F.col(a)).otherwise(F.col(b))
    pairs = pairs.where((F.col("cls") != F.col("c2")) & long_enough & early)
    pairs = pairs.select(flip("cls", "c2").alias("x"), flip("c2", "cls").alias("y"), flip("n", "n2").alias("nx"), flip("n2", "n").alias("ny"))
    return pairs.groupBy("x", "y", "nx", "ny").agg(F.count(F.lit(1)).alias("c"))


def asked(pairs: DataFrame) -> DataFrame:
    """Each class asks the few hubs it meets most often."""
    turn = Window.partitionBy("who").orderBy(F.desc("c"), "x", "y")
    each = pairs.withColumn("who", F.explode(F.array("x", "y"))).withColumn("r", F.row_number().over(turn))
    return each.where(F.col("r") <= HUBS).select("x", "y", "nx", "ny").distinct()


def stars(grams: DataFrame) -> DataFrame:
    """Each class of a shared prefix shingle with the shingle's hub: the class whose shingles are shared most, the original among its altered copies."""
    best = F.max(F.struct("hub", "cls", "n", "pos")).alias("o")
    star = grams.groupBy("token").agg(best, F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi").select("token", F.col("o.cls").alias("c2"), F.col("o.n").alias("n2"), F.col("o.pos").alias("p2"))
    star = keep(star, "stars")  # written first, so that a join on a frequent shingle can be split
    met = keep(grams.join(star, "token"), "met")
    drop(star)
    return met


def prefix_grams(classes: DataFrame, *more: str) -> DataFrame:
    """The shared prefix shingles of classes, with their positions."""
    return classes.select("cls", "n", "hub", *more, "pos", F.posexplode("prefix").alias("i", "token")).select("cls", "n", "hub", *more, (F.col("pos") + F.col("i")).cast("int").alias("pos"), "token")


def apart(grams: DataFrame) -> DataFrame:
    """Rows of prefix shingles (token, label and more) that classes of different components share."""
    met = grams.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token")
    met = keep(met, "mixed")
    out = keep(grams.join(small(met), "token"), "apart")
    drop(met)
    return out


def second_stars(here: DataFrame) -> DataFrame:
    """Classes with the best hub outside the component of the shingle's first hub."""
    first = here.groupBy("token").agg(F.max(F.struct("hub", "label")).alias("h")).select("token", F.col("h.label").alias("first"))
    best = F.max(F.struct(*BEST)).alias("o")
    other = here.join(first, "token").where("label <> first").groupBy("token").agg(best)
    other = other.select("token", F.col("o.cls").alias("c2"), F.col("o.label").alias("l2"), F.col("o.n").alias("n2"), F.col("o.pos").alias("p2"))
    return here.join(other, "token").where("label <> l2")


def band(n: Column) -> Column:
    return F.floor(F.log(n) / float(np.log(1.05))).cast("int")


def across(here: DataFrame) -> DataFrame:
    """Classes of different components on common prefix shingles. The smaller class meets only the size bands that its own size and position allow, so classes that are too far apart by position never meet, however many share the shingle."""
    most = F.least(F.floor(F.col("n") * 4 / 3.0), F.floor((F.col("n") - F.col("pos")) * 7 / 3.0) - F.col("n"))
    small = here.withColumn("most", most).where("most >= n").withColumn("band", F.explode(F.sequence(band(F.col("n")), band(F.col("most")))))
    large = here.select("token", band(F.col("n")).alias("band"), F.col("cls").alias("c2"), F.col("label").alias("l2"), F.col("n").alias("n2"), F.col("pos").alias("p2"))
    ordered = (F.col("n") < F.col("n2")) | ((F.col("n") == F.col("n2")) & (F.col("cls") < F.col("c2")))
    return small.join(large, ["token", "band"]).where((F.col("label") != F.col("l2")) & ordered)


def plausible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Suffix filter: the shingle counts of both sides in hash ranges bound the intersection."""
    h = classes.select("cls", "hist")
    both = pairs.join(h.toDF("x", "hx"), "x").join(h.toDF("y", "hy"), "y")
    most = F.aggregate(F.zip_with("hx", "hy", lambda a, b: F.least(a, b)), F.lit(0), lambda s, x: s + x)
    return both.where(most * 7 >= (F.col("nx") + F.col("ny")) * 3).drop("hx", "hy")


def similar_classes(docs: DataFrame, bucket_bytes: int = 12 << 20) -> DataFrame:
    """docs: text. cls, label of every class that is linked with another class."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    shared = postings(docs.select("text"), buckets).groupBy("bucket").applyInArrow(meet(buckets), SHARED_SQL)
    classes = keep(shared.groupBy("bucket").applyInArrow(prefixes, CLASSES_SQL), "classes", "none")
    links, tested, labels, here = None, None, None, stars(prefix_grams(classes))
    for stage in ("hub", "second", "all"):
        if stage == "hub":
            found = asked(near(here))
        else:
            # what one component shares alone stays so: later rounds see the rows of earlier ones, with new labels
            rows = prefix_grams(classes.select("cls", "n", "hub", "pos", "prefix")) if stage == "second" else here.drop("label")
            rows = rows.join(small(labels), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
            now = apart(rows)
            drop(here)
            here = now
            found = near(second_stars(here) if stage == "second" else across(here)).join(tested, ["x", "y"], "left_anti")
            found = asked(found) if stage == "second" else found.select("x", "y", "nx", "ny")
        found = keep(found, "found")
        pairs = keep(plausible(small(found), classes), "pairs")
        drop(found)
        found = pairs
        now = found.select("x", "y")
        tested = now if tested is None else tested.unionByName(now)
        good = keep(verified(small(found), classes), "links")
        links = good if links is None else links.unionByName(good)
        if labels is None or not good.isEmpty():
            labels = components(links)
    drop(classes)
    drop(here)
    return labels


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row a document: doc_id, n_shingles, class_id (equal sets), component_id (smallest doc_id reachable by links)."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def measure(batches):
        for batch in batches:
            n, a, b = [], [], []
            for _, s in shingle_sets(batch.column(1)):
                x, y = fingerprint(s)
                n.append(len(s))
                a.append(x)
                b.append(y)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["doc_id", "n_shingles", "cls", "check"])

    sets = keep(docs.mapInArrow(measure, "doc_id long, n_shingles long, cls long, check long"), "sets")
    labels = similar_classes(docs, **options)
    full = F.col("n_shingles") > 0
    named = sets.where(full).groupBy("cls", "check").agg(F.min("doc_id").alias("class_id"))
    tagged = keep(named.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls")), "tagged")
    lowest = tagged.groupBy("label").agg(F.min("class_id").alias("component_id"))
    found = tagged.join(lowest, "label").select("cls", "check", "class_id", "component_id")
    linked = sets.where(full).join(found, ["cls", "check"]).select("doc_id", "n_shingles", "component_id", "class_id")
    alone = sets.where(~full).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"))
    return linked.unionByName(alone)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: that of the smallest id, nulls last, then of the smallest hash of id and text; of equal rows one. Rows with the empty set stay."""
    if clash := {"row", "tag", "full", "turn"} & set(docs.columns):
        raise ValueError(f"columns already present: {sorted(clash)}")
    named = docs.withColumns(row_tag(F.col(key), F.col(text)))

    def measure(batches):
        for batch in batches:
            n, a, b = [], [], []
            for _, s in shingle_sets(batch.column(3)):
                x, y = fingerprint(s)
                n.append(len(s))
                a.append(x)
                b.append(y)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["row", "tag", "doc_id", "n_shingles", "cls", "check"])

    short = named.select("row", "tag", F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sets = keep(short.mapInArrow(measure, "row long, tag long, doc_id long, n_shingles long, cls long, check long"), "sets")
    labels = similar_classes(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")))
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row", "tag")
    full = F.col("n_shingles") > 0
    first = sets.where(full).groupBy("cls", "check").agg(F.min(order).alias("at"))
    first = first.join(labels, "cls", "left").groupBy(F.coalesce("label", "cls")).agg(F.min("at").alias("at"))
    stay = first.select("at.row", "at.tag", F.lit(True).alias("full"))
    stay = stay.unionByName(sets.where(~full).select("row", "tag", F.lit(False).alias("full")).distinct())
    met = named.join(stay, ["row", "tag"])
    # equal rows are one before the shuffle, however many they are; rows with the empty set are told apart
    own = F.when(~F.col("full"), F.monotonically_increasing_id())
    one = met.groupBy("row", "tag", own.alias("turn")).agg(F.first(F.struct(*docs.columns)).alias("full"))
    return one.select(*[F.col("full")[c].alias(c) for c in docs.columns])


def op3_jaccard_join(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_join(docs).select("doc_id", "n_shingles", "component_id", "class_id")
