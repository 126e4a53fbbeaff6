"""Fill-in-the-middle against a plain loop over the token pattern, exact round trips and odd rows."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from utterlake.llm.fill_middle import MARKS, TEXT, cut, fill_in_middle, op13_fill_middle, read_out, restore, token_ends, unarrange

TOKEN = re.compile("[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+")
SCHEMA = "doc_id long, text string"


def plain(doc_id, text):
    """What the contract says, over code points."""
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_whole_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = op13_fill_middle(spark, sf).collect()
    assert len(got) == len(texts) and {r.form for r in got} == {"plain", "spm", "psm"}
    for r in got:
        *head, out = plain(r.doc_id, texts[r.doc_id])
        assert [r.n, r.form, r.prefix_chars, r.middle_chars] == head
        assert (r.output_sha256, r.restored_sha256) == (sha(out), sha(texts[r.doc_id] or ""))


def test_random_texts(spark):
    rng = random.Random(8)
    parts = [" ", "\t", "\x0b", "\n\n", "a", "bc", "é", "😀", "\x00", "\x1c", " ", " ", "<", "<P", "S>", "<S", "P>", "M", ">", "<M", "<P>"]
    rows = [(i, "".join(rng.choice(parts[:-1] if i % 9 else parts) for _ in range(rng.randint(0, 14)))) for i in range(3000)]
    got = {r.doc_id: r for r in restore(fill_in_middle(spark.createDataFrame(rows, SCHEMA))).collect()}
    for i, text in rows:
        n, form, pre, mid, out = plain(i, text)
        r = got[i]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.output_sha256, r.restored, r.restored_sha256) == (n, form, pre, mid, out, sha(out), text, sha(text))
        spelled = b"".join((text.encode(), MARKS)[p.buffer][p.start : p.start + p.length] for p in r.pieces)
        assert spelled.decode() == out
    assert sum(r.form != "plain" for r in got.values()) > 1000


def test_odd_rows(spark):
    long = "wörd \n" * 500_000
    rows = [(None, "some few words here"), (None, None), (1, None), (2, ""), (3, "   "), (5, "x"), (5, "x"), (5, "y z"), (-4, "neg id of it"), (6, "has <M> inside"), *[(i, long) for i in (10, 11, 12)]]
    got = restore(fill_in_middle(spark.createDataFrame(rows, SCHEMA))).collect()
    assert sorted((r.doc_id or 0, r.n, r.form, r.prefix_chars or 0, r.middle_chars or 0, r.output) for r in got) == sorted((i or 0, n, f, p or 0, m or 0, o) for i, t in rows for n, f, p, m, o in [plain(i, t)])
    assert all(r.restored == (r.text or "") for r in got)
    assert restore(fill_in_middle(spark.createDataFrame([], SCHEMA))).count() == 0
    other = spark.createDataFrame([(1, "a b", None, [1])], SCHEMA + ", start long, work array<int>")
    assert fill_in_middle(other).first()[:4] == (1, "a b", None, [1])
    with pytest.raises(ValueError):
        fill_in_middle(spark.createDataFrame([(1, "a", 2)], SCHEMA + ", n long"))


def test_pieces():
    assert token_ends(b"").tolist() == [] and token_ends(b" a  b ").tolist() == [2, 5, 6] and token_ends(b" \n").tolist() == [2]
    before, after = cut([(0, 2, 3), (1, 0, 4)], 4)
    assert before == [(0, 2, 3), (1, 0, 1)] and after == [(1, 1, 3)]
    assert cut([(0, 0, 3)], 0) == ([], [(0, 0, 3)]) and cut([(0, 0, 3)], 3) == ([(0, 0, 3)], [])
    out = b"<S>suf<P>pre<M>mid"
    assert read_out((out, MARKS), unarrange(out, "spm"))[0] == b"premidsuf" and unarrange(b"", "plain") == [(TEXT, 0, 0)]
