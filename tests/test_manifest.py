"""SC1: quoted line breaks across blocks of a file, literal cells, errors."""

from __future__ import annotations

import csv
import os
import random
import tempfile

import duckdb
import pytest

from utterlake import plans
from utterlake.sources import manifest
from utterlake.sources.manifest import BadTable

SCHEMA = "path string, n int, ok boolean, said string"


def written(rows, head=("path", "n", "ok", "said"), end="\n", files=1):
    where = tempfile.mkdtemp(prefix="spark-csv-", dir="/tmp")
    for i in range(files):
        with open(os.path.join(where, f"part-{i}.csv"), "w", newline="", encoding="utf-8") as f:
            w = csv.writer(f, lineterminator=end)
            w.writerow(head)
            w.writerows(rows[i::files])
    return where


def read(spark, where):
    return sorted((tuple(r) for r in manifest.read_manifest(spark, where, SCHEMA).collect()), key=repr)


def typed(rows):
    return sorted(((p or None, int(n) if n else None, None if not k else k == "True", s or None) for p, n, k, s in rows), key=repr)


@pytest.mark.parametrize("end, files", [("\n", 1), ("\r\n", 1), ("\n", 3)])
def test_quoted_breaks_in_many_blocks(spark, end, files):
    """Blocks of 4 KB: most begin within a quoted cell, and some cells are longer than a block."""
    rng = random.Random(files)
    parts = ["a", "b,c", '"', '""', "\n", "\n\n", "é", "x y", ",", "\\", "'"]
    rows = [(f"clips/{i}.wav", rng.choice(["", str(i)]), rng.choice(["True", "False", ""]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))) for i in range(1500)]
    rows += [(f"long/{i}.wav", "1", "True", 'line, "quoted"\n' * 900) for i in range(3)]
    rng.shuffle(rows)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        where = written(rows, end=end, files=files)
        assert spark.read.text(where).rdd.getNumPartitions() > 20
        assert read(spark, where) == typed(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was[0])
        spark.conf.set("spark.sql.files.openCostInBytes", was[1])


def test_errors(spark):
    with pytest.raises(BadTable, match="no rows"):
        read(spark, written([]))
    empty = tempfile.mkdtemp(prefix="spark-csv-", dir="/tmp")
    open(os.path.join(empty, "part-0.csv"), "w").close()
    with pytest.raises(BadTable, match="empty"):
        read(spark, empty)
    for head in (("path", "n", "ok"), ("path", "n", "ok", "text"), ("path", "n", "ok", "said", "more")):
        with pytest.raises(BadTable, match="other columns"):
            read(spark, written([("a", "1", "True", "b")], head=head))


ODD = ["", " ", "a ", " a", "\ta", "a\n", "\na", "a\r", "a\r\r", "\r\n", "\n", "\r", '"', '""', ' "a" ', "a\\", '\\"', "a,b ", "a\u0001b", "\u0001", "a\u0000", "\u0000a", "#a", " a", "﻿a", "null", " \n, \"\n ", "a,\u0000b", "\u0000\"\u0000\n", "\u0002b,\u0002", "\u0002a\u0000", None]


def test_written_cells_come_back(spark):
    """Blanks and line breaks at the ends of cells, empty strings and nulls, in the first, a middle and the last column."""
    rows = [(i, a, ODD[(i * 5 + 1) % len(ODD)], i % 2 == 0 if i % 3 else None, ODD[(i * 11 + 3) % len(ODD)]) for i, a in enumerate(ODD)]
    df = spark.createDataFrame(rows, "n int, a string, b string, ok boolean, c string").repartition(3)
    where = tempfile.mkdtemp(prefix="spark-csv-", dir="/tmp") + "/out"
    manifest.write_manifest(df, where, ["a", "n", "b", "ok", "c"], ["n"])
    got = manifest.read_manifest(spark, where, "a string, n int, b string, ok boolean, c string").select("n", "a", "b", "ok", "c").collect()
    assert sorted(map(tuple, got)) == rows


def test_scan_query_equals_sql_on_odd_texts(spark):
    where = tempfile.mkdtemp(prefix="spark-docs-", dir="/tmp")
    rows = [(i, t, "en", f"src{i % 3}", i) for i, t in enumerate(ODD)]
    rows += [(100, "no source", "fr", None, 7), (None, "no id", "en", "src", None), (-5, "less than 0", None, " ", -3), (None, "nothing", None, None, 0), (2**40, "empty source", "en", "", 2**31)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(1).write.parquet(f"{where}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{where}/documents.parquet/*.parquet'")
    want = con.execute(plans.oracles()["sc1_manifest_scan"]).fetchall()
    assert sorted(map(tuple, plans.queries()["sc1_manifest_scan"](spark, where).collect()), key=repr) == sorted(want, key=repr)


def test_header_with_a_line_break(spark):
    rows = [("x", "1", "True", "two\nlines"), ("y", "2", "", "z")]
    schema = "path string, `n\nn` int, ok boolean, said string"
    got = manifest.read_manifest(spark, written(rows, head=("path", "n\nn", "ok", "said")), schema).collect()
    assert sorted(map(tuple, got)) == [("x", 1, True, "two\nlines"), ("y", 2, None, "z")]
    for head in (("path", "n", "ok", "said"), ("path", "n\nn", "ok", "said\n"), ("path", "n\nn\n", "ok", "said")):
        with pytest.raises(BadTable, match="other columns"):
            manifest.read_manifest(spark, written(rows, head=head), schema)
