"""BPE encoding and decoding through a table of distinct words.

Texts are split into words as the tokenizer itself splits them. A block of
documents becomes a list of its distinct words plus one array of word numbers
a document; the lists are dealt by word, so that each distinct word of the
corpus meets the tokenizer once; the ids go back to the blocks and are joined
to the documents by word number. Decoding joins each id to its piece.

Splitting, positions and pieces stay within a block instead of being rows of
Spark joins: Java's regular expressions don't have the tokenizer's normaliser
and word classes, and a row for each word and position (about 200 million a
GB of text) would shuffle several times the input. A block's documents carry
their words' numbers in order, which is the position, and meet the ids of the
block's words by number; ids meet their pieces by id.

Blocks are bounded in words, and word lists are dealt in buckets of about
`bucket_bytes` of text, so no task holds more as the input grows; a very
frequent word is one entry a block.

Defined cases: a null or empty text has no ids and decodes to the empty
string; special-token strings inside a text become their ids, as in the
library; repeated rows repeat; an empty table gives no rows; other columns
are left out, so their names never clash.
"""

from __future__ import annotations

import functools
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import keep

#: Texts of these characters only are split here; all others by the library.
SIMPLE = re.compile("[\t\n\r\x20-\x7eÀ-ÖØ-öø-įı-ſ–—‘-„…€]*")
LETTERS = "a-zß-öø-ſ"
WORDS = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{LETTERS}]+|[0-9]|[^\\s0-9{LETTERS}]+")
SPECIAL = re.compile(r"(<\|startoftext\|>|<\|endoftext\|>)")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@functools.cache
def word_tokenizer(path: str):
    """The same model for single words that are normalised already."""
    from tokenizers import Tokenizer, normalizers

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    t.normalizer = normalizers.Sequence([])
    return t


def split(text: str, path: str) -> list[str]:
    """Words in order, special-token strings as they are."""
    if SIMPLE.fullmatch(text) and "<|" not in text:
        return WORDS.findall(text.lower())
    t, out = tokenizer(path), []
    for part in SPECIAL.split(text):
        if SPECIAL.fullmatch(part):
            out.append(part)
        else:
            plain = t.normalizer.normalize_str(part)
            out += [plain[a:b] for _, (a, b) in t.pre_tokenizer.pre_tokenize_str(plain)]
    return out


@functools.cache
def word_ends(path: str) -> np.ndarray:
    """Of each id, whether it can only be a word's last."""
    t = word_tokenizer(path)
    mark = getattr(t.model, "end_of_word_suffix", None)
    return np.array([bool(mark) and (t.id_to_token(i) or "").endswith(mark) for i in range(t.get_vocab_size())], bool)


def encode_words(words: list[str], path: str, together: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Number of ids of each word, and all ids. A call for some words as one text costs less than half of a call for each; they part again at the ids that end a word."""
    # a Spark task has one core: the library's own threads would only spin
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t, ends = word_tokenizer(path), word_ends(path)
    encoded = lambda texts: [np.array(e.ids, "<u4") for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    counts, flats = [np.zeros(0, np.int64)], [np.zeros(0, "<u4")]
    for lo in range(0, len(words), 200 * together):
        groups = [words[i : i + together] for i in range(lo, min(lo + 200 * together, len(words)), together)]
        for group, ids in zip(groups, encoded([" ".join(g) for g in groups]), strict=True):
            count = np.diff(np.flatnonzero(ends[ids]), prepend=-1)
            if len(count) != len(group):  # special tokens and the empty word have no such id
                each = encoded(group)
                count, ids = np.array(list(map(len, each))), np.concatenate(each)
            counts.append(count)
            flats.append(ids)
    return np.concatenate(counts), np.concatenate(flats)


def gathered(count: np.ndarray, flat: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """count: how many ids of flat, in order, each number has. The counts of codes, and their ids."""
    n, start = count[codes], np.cumsum(count) - count
    return n, flat[np.repeat(start[codes] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def by_list(lists: pa.Array, n: np.ndarray) -> np.ndarray:
    """Sums of n over the items of each list."""
    return np.diff(np.append(0, np.cumsum(n))[lists.offsets.to_numpy()])


class Encoder:
    """Ids of whole texts. Words are known from call to call; where that makes more than `most`, those of the last call stay."""

    def __init__(self, path: str, most: int = 400_000):
        self.path, self.most = path, most
        self.known, self.count, self.flat = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The numbers of different words among the known ones; new ones become known."""
        at = pc.index_in(words, value_set=self.known)
        new = at.is_null()
        fresh, place = words.filter(new), at.fill_null(0).to_numpy().astype(np.int64)
        place[new.to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(len(fresh))
        count, flat = encode_words(fresh.to_pylist(), self.path)
        self.known, self.count, self.flat = pa.concat_arrays([self.known, fresh]), np.append(self.count, count), np.append(self.flat, flat)
        if len(self.known) > self.most:
            self.known, (self.count, self.flat) = words, gathered(self.count, self.flat, place)
            place = np.arange(len(words))
        return place

    def of_words(self, lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each list of words, and all ids."""
        coded = lists.flatten().dictionary_encode()
        codes = self.numbers(coded.dictionary)[coded.indices.to_numpy()]
        n, flat = gathered(self.count, self.flat, codes)
        return by_list(lists, n), flat

    def of_simple(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts of SIMPLE characters: distinct stretches between spaces are split into words."""
        stretches = pc.ascii_split_whitespace(pc.utf8_lower(texts))
        coded = stretches.flatten().dictionary_encode()
        spaced = pc.replace_substring_regex(coded.dictionary, f"({WORDS.pattern})", r"\1 ")
        n, flat = gathered(*self.of_words(pc.ascii_split_whitespace(pc.ascii_rtrim_whitespace(spaced))), coded.indices.to_numpy())
        return by_list(stretches, n), flat

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        texts = texts.cast(pa.string()).fill_null("")
        simple = pc.and_not(pc.match_substring_regex(texts, f"\\A{SIMPLE.pattern}\\z"), pc.match_substring(texts, "<|"))
        others = pa.array([split(t, self.path) for t in texts.filter(pc.invert(simple)).to_pylist()], pa.list_(pa.string()))
        parts = [iter(np.split(flat, np.cumsum(n)[:-1])) for n, flat in (self.of_words(others), self.of_simple(texts.filter(simple)))]
        return [next(parts[s]) for s in simple.to_pylist()]


@functools.cache
def encoder(path: str) -> Encoder:
    """The encoder of a Python worker: words met in one task are known in the worker's next."""
    return Encoder(path)


BLOCK = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("docs", pa.list_(pa.int64())), ("body", pa.binary()), ("numbers", pa.binary())])
BLOCK_SQL = "block long, bucket int, docs array<long>, body binary, numbers binary"
TABLE = pa.schema([("block", pa.int64()), ("numbers", pa.binary()), ("lens", pa.binary()), ("ids", pa.binary())])
TABLE_SQL = "block long, numbers binary, lens binary, ids binary"
DONE = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])


def zipped(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unzipped(b: bytes) -> bytes:
    size = int.from_bytes(b[:8], "little")
    return pa.decompress(b[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def packed(a: np.ndarray) -> bytes:
    """32-bit numbers byte by byte, so that high bytes pack well."""
    return zipped(np.ascontiguousarray(a, np.int32).view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(unzipped(b), np.uint8).reshape(4, -1).T.copy().view(np.int32).ravel()


def blocks(docs: DataFrame, path: str, buckets: int, most_words: int = 4_000_000, most_distinct: int = 400_000) -> DataFrame:
    """docs: doc_id, text. Word-list rows (bucket set; body: words, numbers: theirs) and document rows (bucket null; body: word numbers of some documents, numbers: how many each has) of each block."""

    def flush(no: int, known: dict[str, int], ids: list, codes: list):
        block = (TaskContext.get().partitionId() << 24) + no
        words = list(known)
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        times = np.zeros(len(words), np.int64)
        for c in codes:
            np.add.at(times, c, 1)
        number = np.empty(len(words), np.int32)
        number[np.argsort(-times, kind="stable")] = np.arange(len(words), dtype=np.int32)  # frequent words have small numbers
        bucket = np.array([zlib.crc32(w) % buckets for w in raw], np.int32)
        order = np.lexsort((number, bucket))
        edge = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        past = np.append(edge[1:], len(words))[: len(edge)]
        rows = {k: [] for k in BLOCK.names}
        for a, b in zip(edge.tolist(), past.tolist(), strict=True):
            here = order[a:b]
            for k, v in zip(BLOCK.names, (block, int(bucket[here[0]]), None, zipped(b"\n".join(raw[i] for i in here.tolist())), packed(np.diff(number[here], prepend=0))), strict=True):
                rows[k].append(v)
        yield pa.RecordBatch.from_pydict(rows, schema=BLOCK)
        # some documents a row: one code table serves them all when they are packed
        at = range(0, len(ids), 64)
        bodies = [packed(number[np.concatenate(codes[i : i + 64])]) for i in at]
        lens = [packed(np.array([len(c) for c in codes[i : i + 64]])) for i in at]
        n = len(bodies)
        yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.nulls(n, pa.int32()), pa.array([ids[i : i + 64] for i in at], pa.list_(pa.int64())), pa.array(bodies, pa.binary()), pa.array(lens, pa.binary())], schema=BLOCK)

    def cut(batches):
        no, known, ids, codes, total = 0, {}, [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = split(text or "", path)
                for w in set(words).difference(known):  # a set less a dictionary view would walk the whole dictionary
                    known[w] = len(known)
                codes.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
                ids.append(doc)
                total += len(words)
                if total >= most_words or len(known) >= most_distinct:
                    yield from flush(no, known, ids, codes)
                    no, known, ids, codes, total = no + 1, {}, [], [], 0
        if ids:
            yield from flush(no, known, ids, codes)

    return docs.mapInArrow(cut, BLOCK_SQL)


def encode(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", bucket_bytes: int = 48 << 20) -> DataFrame:
    """Key, ids (little-endian unsigned 32-bit, as bytes) and decoded text of every row."""
    path = path or vocabulary()
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    kept = keep(blocks(docs, path, max(1, -(-total // bucket_bytes))), "blocks", "none")

    def once(batches):
        """Rows in order of bucket: a bucket's distinct words are encoded as they first come."""
        bucket, table = None, {}
        for batch in batches:
            out = {k: [] for k in TABLE.names}
            for block, b, body, numbers in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if b != bucket:
                    bucket, table = b, {}
                words = unzipped(body).decode("utf-8", "surrogatepass").split("\n")
                fresh = [w for w in words if w not in table]
                count, flat = encode_words(fresh, path)
                raw, past = flat.tobytes(), (4 * np.cumsum(count)).tolist()
                table.update((w, raw[a:z]) for w, a, z in zip(fresh, [0, *past], past, strict=False))
                found = [table[w] for w in words]
                lens = np.fromiter(map(len, found), np.int32, len(found)) // 4
                for k, v in zip(TABLE.names, (block, numbers, packed(lens), packed(np.frombuffer(b"".join(found), np.int32))), strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=TABLE)

    lists = kept.where("bucket is not null").select("block", "bucket", "body", "numbers")
    table = lists.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(once, TABLE_SQL)
    none = F.lit(None)
    both = table.select("block", F.lit(0).alias("kind"), none.cast("array<long>").alias("docs"), "numbers", "lens", F.col("ids").alias("body")).unionByName(
        kept.where("bucket is null").select("block", F.lit(1).alias("kind"), "docs", "numbers", none.cast("binary").alias("lens"), "body")
    )

    def back(batches):
        """Rows in order of block, its word ids before its documents, which stream."""
        pieces, block, parts, ready = piece_bytes(path), None, [], None
        for batch in batches:
            out, size = {k: [] for k in DONE.names}, 0
            for b, kind, docs_, numbers, lens, body in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if b != block:
                    block, parts, ready = b, [], None
                if kind == 0:
                    parts.append((numbers, lens, body))
                    continue
                if ready is None:
                    ready = word_table(parts, pieces)
                    parts = []
                count, start, flat, decoded = ready
                every, end = unpacked(body), np.cumsum(unpacked(numbers))
                for doc, a, z in zip(docs_, [0, *end[:-1].tolist()], end.tolist(), strict=True):
                    codes = every[a:z]
                    n = count[codes]
                    place = np.repeat(start[codes] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    ids = flat[place].tobytes()
                    said = b" ".join([decoded[c] for c in codes[n > 0].tolist()]).decode()
                    for k, v in zip(DONE.names, (doc, ids, said), strict=True):
                        out[k].append(v)
                    size += len(ids) + len(said)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pydict(out, schema=DONE)
                        out, size = {k: [] for k in DONE.names}, 0
            yield pa.RecordBatch.from_pydict(out, schema=DONE)

    return both.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(back, "doc_id long, ids binary, decoded string")


def word_table(parts: list[tuple[bytes, bytes, bytes]], pieces: list[bytes]) -> tuple:
    """Number of ids, start and decoded form of each word number of a block, and all ids."""
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32), []
    numbers = np.concatenate([np.cumsum(unpacked(n)) for n, _, _ in parts])
    lens = np.concatenate([unpacked(x) for _, x, _ in parts])
    flat = np.concatenate([unpacked(x) for _, _, x in parts])
    count, start = np.zeros(len(numbers), np.int32), np.zeros(len(numbers), np.int64)
    at = np.cumsum(lens) - lens
    count[numbers], start[numbers] = lens, at
    joined = list(map(pieces.__getitem__, flat.tolist()))  # the id-to-piece join
    decoded = [b" ".join(joined[a : a + n]) for a, n in zip(start.tolist(), count.tolist(), strict=True)]
    return count, start, flat, decoded


@functools.cache
def piece_bytes(path: str) -> list[bytes]:
    """The id-to-piece table."""
    t = tokenizer(path)
    return [(t.id_to_token(i) or "").encode() for i in range(t.get_vocab_size())]


def op10_bpe(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = encode(docs)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
