"""The corpus operators against brute force, exact round trips and held-out labels, with awkward rows."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from utterlake.llm import ann, bpe, jaccard_join, language_id, packing, pii, quality, quality_rules, repeat_index, sharding

SPACE = re.compile("[^\x20\x09-\x0d]+")
ODD = [
    (9001, None), (9002, ""), (9003, "   \n\t "), (9004, "one"), (9005, "a b c d e f " * 400), (9006, "é" * 300), (9006, "é" * 300), (None, "no id here, five words"),
    (9007, "x" * 40_000), (9008, "1 " * 5_000 + "9" * 5_000), (9009, "<|endoftext|> İstanbul 日本語 don't J̌"), (9010, "A b c  D e"), (9011, "a b C d e f g h"), (9012, "A B c d e f g h"),
]


@pytest.fixture(scope="module")
def docs(spark, sf):
    real = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(120)
    return real.unionByName(spark.createDataFrame(ODD, "doc_id long, text string")).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def test_language_id(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(9001, None, "en"), (9002, "", None), (9003, "12 !!", "fr")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(d.unionByName(odd)).collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id < 9000]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (9001, 9002, 9003))
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 for i, r in got.items())


def test_language_id_without_rows_or_labels(empty, docs):
    assert language_id.identify(empty).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_id_learns_the_most_frequent_labels(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    dirty = d.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("dirt"), "doc_id")).otherwise(F.col("lang")))
    names = [r.lang for r in dirty.where("lang IS NOT NULL AND text RLIKE '\\\\p{L}'").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(3).collect()]
    model = language_id.fit(dirty, languages=3)
    assert sorted({r.lang_pred for r in language_id.predict(d, model).collect()} - {"und"}) == sorted(names)


def test_quality_grades(spark, sf):
    sf = "/root/testdata/sf0.1"  # enough labels to learn from
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    g = labels.select("doc_id", quality.grade(F.col("quality"), F.col("toxic")).alias("grade"))
    train = d.join(g, "doc_id").where("doc_id % 4 > 0").select(F.col("doc_id").alias("key"), "text", "grade")
    model = quality.fit(train)
    assert list(model.thresholds) == sorted(model.thresholds)
    out = quality.score(d.join(g, "doc_id").where("doc_id % 4 = 0"), model).groupBy("grade").agg(F.avg("expected_grade").alias("e"), F.avg(F.col("selected").cast("int")).alias("s")).collect()
    by = {r.grade: r for r in out}
    assert by[2].e > by[1].e + 0.3 and by[1].e > by[0].e + 0.1 and by[2].s >= 0.93 and by[0].s <= 0.45
    assert quality.fit(train.where("grade = 9")) is None


def shingles(t):
    w = SPACE.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_jaccard_join_equals_brute_force(spark, docs, rows):
    rng = random.Random(1)
    base = [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randint(0, 99)) for _ in range(120)]
    family = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"new{rng.randint(0, 10**6)}"
        family.append((20_000 + i, " ".join(w)))
    all_rows = rows + family
    d = docs.unionByName(spark.createDataFrame(family, "doc_id long, text string"))
    sets = [shingles(t) for _, t in all_rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(all_rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    want = sorted(((k, len(sets[i]), least.get(find(i))) for i, (k, _) in enumerate(all_rows)), key=repr)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(d).collect()), key=repr)
    assert got == want


def test_suffix_order_and_statistics():
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(6, 60))) for _ in range(40)] + [b"a" * 50, b"ab" * 30, b"ab" * 30]
    text = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    order = repeat_index.suffix_order(text, ends)
    segment = lambda i: (text[i : ends[np.searchsorted(ends, i)]].tobytes(), i)
    assert [segment(i) for i in order] == sorted(segment(i) for i in range(len(text)))
    n = collections.Counter(t[i : i + 6] for t in texts for i in range(len(t) - 5))
    for t, ranges in zip(texts, repeat_index.mark(texts, np.zeros(len(texts), bool), 6), strict=True):
        assert [any(a <= i < b for a, b in ranges) for i in range(len(t) - 5)] == [n[t[i : i + 6]] > 1 for i in range(len(t) - 5)]


@pytest.mark.parametrize("hot", [2000, 1])
def test_repeats_equal_brute_force(docs, rows, hot):
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeat_index.remove_repeats(docs, hot_anchor=hot).collect()), key=repr)
    n = collections.Counter()
    raw = [(k, (t or "").encode()) for k, t in rows]
    for _, b in raw:
        for i in range(len(b) - 199):
            n[b[i : i + 200]] += 1
    want = []
    for k, b in raw:
        runs = []
        for i in range(len(b) - 199):
            if n[b[i : i + 200]] > 1:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + 200
                else:
                    runs.append([i, i + 200])
        kept, at = b"", 0
        for a, z in runs:
            kept, at = kept + b[at:a], z
        kept += b[at:]
        want.append((k, len(b), len(b) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want, key=repr)


def luhn(d):
    v = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return sum(x - 9 * (x > 9) for x in v) % 10 == 0


def test_pii_equals_brute_force(spark):
    t = "a@b.c_d@e.f mail x.y@host.example.org, 1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.255 4539 1488 0343 6467 4539148803436466 +1 (743) 555-3824+44 20 7946 0958 DE89 3704 0044 0532 0130 00 ssn 123-45-6789 é token = \"0123456789abcdef\""
    d = spark.createDataFrame([(1, t), (2, None), (3, ""), (4, "1 " * 20_000 + "9" * 20_000 + ".@" * 500)], "doc_id long, text string")
    for r in pii.find_pii(d).collect():
        s = r.text or ""
        email = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", s)]
        ip = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", s) if max(map(int, m.group().split("."))) <= 255]
        card = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", s) if 13 <= len(d_ := re.sub("[^0-9]", "", m.group())) <= 19 and luhn(d_)]
        phone = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", s) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
        for kind, want in (("email", email), ("ip", ip), ("card", card), ("phone", phone)):
            assert [(x.start, x.end) for x in r[f"pii_{kind}"]] == want
        if r.doc_id == 1:
            assert [len(r[f"pii_{k}"]) for k in ("iban", "ssn", "secret")] == [1, 1, 1]
    masked = pii.mask_pii(d).where("doc_id = 1").first().text
    assert "[IBAN]" in masked and "3824" not in masked and "é" in masked


def test_quality_rules_base(spark):
    text = "a b c " * 40 + "\nsame line\nsame line\n#$ x"
    r = quality_rules.quality_rules(spark.createDataFrame([(1, text), (2, None), (3, "a b")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert (r[0].n_words, r[0].n_symbols, r[0].n_dup_lines, r[0].n_repeat_words) == (126, 2, 1, 120)
    assert r[0].base_failed and not r[0].kept and r[1].n_words == 0 and r[1].base_failed and r[2].base_failed


def test_bpe_round_trip(docs, rows):
    t = bpe.tokenizer(bpe.vocabulary())
    want = sorted(((k, np.array(i := t.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes(), t.decode(i, skip_special_tokens=False)) for k, x in rows), key=repr)
    got = sorted(((r.doc_id, bytes(r.ids), r.decoded) for r in bpe.encode(docs).collect()), key=repr)
    assert got == want


def test_packing(docs, rows):
    t = bpe.tokenizer(bpe.vocabulary())
    want = []
    for k, x in rows:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(k, i, s, len(ids[s : s + 256]), zlib.crc32(ids[s : s + 256].tobytes())) for i, s in enumerate(range(0, len(ids), 256))]
    got = packing.pack(docs, capacity=256).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end += n
        assert end <= 256
    assert len(by) <= 1.03 * -(-sum(r.length for r in got) // 256)


def test_sharding(docs, rows):
    got = sharding.external_shuffle(docs, bucket_bytes=20_000).collect()
    assert sorted((repr(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((repr(k), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t in rows)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 24) and 0 <= r.shard < 24
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_ann(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 16))
    x = [(i, (centres[i % 8] + 0.3 * rng.normal(size=16)).tolist()) for i in range(1500)]
    x += [(2000 + i, x[100][1]) for i in range(30)]
    odd = [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] * 16), (5300, [1.0] * 3), (5400, [None] * 16)]
    df = spark.createDataFrame(x + odd, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    m, ids, hits = np.array([v for _, v in x]), np.array([i for i, _ in x]), 0
    queries = [i for i in ids if i % 100 == 0]
    assert set(got) == set(queries)
    for q in queries:
        d = np.sqrt(((m - m[ids == q][0]) ** 2).sum(1))
        o = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        hits += len({int(ids[i]) for i in o} & {i for i, _ in got[q]})
        assert len(got[q]) == 10 and all(abs(s - d[ids == i][0]) < 1e-9 for i, s in got[q])
    assert hits >= 0.9 * 10 * len(queries)


def test_empty_tables(empty, spark):
    d = empty.select("doc_id", "text")
    for f in (jaccard_join.jaccard_join, repeat_index.remove_repeats, packing.pack, sharding.external_shuffle, bpe.encode, pii.find_pii, quality_rules.quality_rules):
        assert f(d).count() == 0
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_clashing_columns(docs):
    for f, column in ((repeat_index.remove_repeats, "n_bytes"), (sharding.external_shuffle, "slot"), (pii.find_pii, "pii_ip"), (quality_rules.measure, "n_words")):
        with pytest.raises(ValueError):
            f(docs.withColumn(column, F.lit(1)))
    extra = docs.withColumns({"cls": F.lit(1), "n": F.lit("x"), "token": F.lit(2)})
    assert jaccard_join.jaccard_join(extra).count() == docs.count()
    assert "cls" in repeat_index.remove_repeats(extra).columns
