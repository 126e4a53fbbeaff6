"""Fill-in-the-middle transformation over piece tables.

A document is a list of descriptors (buffer, start, length) over two buffers
that never change: its own bytes and the sentinels. A cut splits the
descriptor that spans it, an arrangement permutes the parts and puts sentinel
descriptors between them, and text is touched only where descriptors are read
out: into the output, and into a hash that streams over them. To restore, the
output becomes the buffer, its sentinels give the parts, and the inverse
permutation puts them back. A document is worked on by itself, so copies and
hot sources cost nothing extra, and nothing is shuffled.

Tokens are `[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+`. White space of
that kind is single bytes in UTF-8, so cuts fall between code points.

Defined cases: a null text counts as empty; an empty text and one that holds a
sentinel are plain: output and text are the same, prefix_chars and
middle_chars null; a null id draws as the empty string; rows of one id draw
alike; repeated rows all stay; very long texts are worked on whole; an empty
table gives no rows; other columns travel along, and a clash with an output
name raises.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

TEXT, SENTINELS = 0, 1
#: Prefix, suffix and middle sentinels, side by side in their buffer.
MARKS = b"<P><S><M>"
MARK = {"prefix": (SENTINELS, 0, 3), "suffix": (SENTINELS, 3, 3), "middle": (SENTINELS, 6, 3)}
#: Order of the parts in the output, by form.
ORDER = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
#: Order of the parts in a text.
NATURAL = ("prefix", "middle", "suffix")
OWN = ("n", "form", "prefix_chars", "middle_chars", "pieces", "output", "output_sha256")
#: Bytes of one output batch.
FLUSH = 4 << 20

Piece = tuple[int, int, int]


def token_ends(text: bytes) -> np.ndarray:
    """Where each token ends."""
    b = np.frombuffer(text, np.uint8)
    space = (b == 0x20) | ((b >= 0x09) & (b <= 0x0D))
    ends = np.flatnonzero(~space & np.append(space[1:], True)) + 1
    return np.append(ends, len(b)) if len(b) and space[-1] else ends


def cut(pieces: list[Piece], at: int) -> tuple[list[Piece], list[Piece]]:
    """The descriptors before and after byte `at` of what they spell; the one that spans it is split."""
    before, after, seen = [], [], 0
    for buffer, start, length in pieces:
        left = min(max(at - seen, 0), length)
        if left:
            before.append((buffer, start, left))
        if length - left:
            after.append((buffer, start + left, length - left))
        seen += length
    return before, after


def arrange(parts: dict[str, list[Piece]], form: str) -> list[Piece]:
    return [piece for name in ORDER[form] for piece in (MARK[name], *parts[name])]


def unarrange(output: bytes, form: str) -> list[Piece]:
    """Descriptors over the output that spell the text. Sentinels are found from left to right; parts hold none."""
    if form == "plain":
        return [(TEXT, 0, len(output))]
    order = ORDER[form]
    at = [output.index(MARKS[MARK[name][1] :][:3]) for name in order]
    ends = [*at[1:], len(output)]
    parts = {name: (TEXT, a + 3, z - a - 3) for name, a, z in zip(order, at, ends, strict=True)}
    return [parts[name] for name in NATURAL]


def read_out(buffers: tuple[bytes, bytes], pieces: list[Piece]) -> tuple[bytes, str]:
    """What the descriptors spell, and its SHA-256, streamed over them."""
    digest, views, out = hashlib.sha256(), [memoryview(b) for b in buffers], []
    for buffer, start, length in pieces:
        part = views[buffer][start : start + length]
        digest.update(part)
        out.append(part)
    return b"".join(out), digest.hexdigest()


def draws(key, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def code_points(text: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def transform(text: bytes, key, seed: int, fim_percent: int, spm_percent: int) -> tuple[int, str, int | None, int | None, list[Piece]]:
    """Number of tokens, form, code points of prefix and middle, descriptors of the output."""
    ends, (h1, h2, h3, h4) = token_ends(text), draws(key, seed)
    n = len(ends)
    whole = [(TEXT, 0, len(text))] if text else []
    if not text or any(MARKS[i : i + 3] in text for i in (0, 3, 6)) or h3 % 100 >= fim_percent:
        return n, "plain", None, None, whole
    first, second = (int(ends[k - 1]) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, rest = cut(whole, first)
    middle, suffix = cut(rest, second - first)
    form = "spm" if h4 % 100 < spm_percent else "psm"
    pieces = arrange({"prefix": prefix, "middle": middle, "suffix": suffix}, form)
    return n, form, code_points(text[:first]), code_points(text[first:second]), pieces


def batches_of(rows, schema: pa.Schema, weight):
    """Record batches of about FLUSH bytes by weight(row)."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if size > FLUSH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def extended(df: DataFrame, more: str, work) -> DataFrame:
    """df and the columns of the DDL string `more`; work(row as a dict) gives their values, the output text first of all for its size."""
    extra = _parse_datatype_string(more)
    if clash := {f.name for f in extra} & set(df.columns):
        raise ValueError(f"columns already present: {sorted(clash)}")
    schema = StructType([*df.schema, *extra])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for one in (batch.slice(i, 64) for i in range(0, len(batch), 64)):
                rows = ((*values, *work(dict(zip(one.schema.names, values, strict=True)))) for values in zip(*[c.to_pylist() for c in one.columns], strict=True))
                yield from batches_of(rows, arrow, lambda r: sum(len(x) for x in r if isinstance(x, str)))

    return df.mapInArrow(run, schema)


def fill_in_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 42, fim_percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """docs with n (tokens), form, prefix_chars, middle_chars, pieces (the descriptors), output and output_sha256."""
    more = "n long, form string, prefix_chars long, middle_chars long, pieces array<struct<buffer:int,start:long,length:long>>, output string, output_sha256 string"

    def work(row):
        body = (row[text] or "").encode()
        n, form, prefix, middle, pieces = transform(body, row[key], seed, fim_percent, spm_percent)
        output, digest = read_out((body, MARKS), pieces)
        return n, form, prefix, middle, [{"buffer": b, "start": s, "length": z} for b, s, z in pieces], output.decode(), digest

    return extended(docs, more, work)


def restore(filled: DataFrame) -> DataFrame:
    """filled with restored and restored_sha256: the text, rebuilt from output and form alone."""

    def work(row):
        output = row["output"].encode()
        text, digest = read_out((output, MARKS), unarrange(output, row["form"]))
        return text.decode(), digest

    return extended(filled, "restored string, restored_sha256 string", work)


def op13_fill_middle(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    filled = fill_in_middle(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256")
    return restore(filled).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


_W = "[\\x20\\x09-\\x0D]"
OP13_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '{_W}*[^\\x20\\x09-\\x0D]+|{_W}+') AS w
  FROM documents
), h AS (
  SELECT doc_id, t, w, len(w) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM d
), f AS (
  SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                 WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
         least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b
  FROM h
), p AS (
  SELECT doc_id, t, n, form, coalesce(array_to_string(w[1:a], ''), '') AS pre, coalesce(array_to_string(w[a + 1:b], ''), '') AS mid,
         coalesce(array_to_string(w[b + 1:], ''), '') AS suf
  FROM f
)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
