"""A distinct-word table: values of words are worked out once for each distinct word and come back by position.

``split`` cuts the documents into blocks. A block keeps, for each of its documents, the positions of its words in
the block's own word list; the list itself goes out in parts, one for each bucket (a hash of the word). All blocks'
parts of one bucket meet in one task, where each distinct word is handled once (``values``), and the answers go back
to the blocks in the order of their lists (``assemble``). What is shuffled is one entry for each word and block, not
one for each occurrence; a very frequent word is one entry in each block.

A block's name is a hash of all it holds. ``kept`` writes the blocks to the shared checkpoint folder once; without it
they are worked out twice: each partition's rows are put in one order first, so that blocks are the same whatever order
they arrive in, and an answer is only ever taken for a block of the same content. The number of buckets follows from the
size of the texts, so that what one task holds of the word lists does not grow with the input.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import partitions, settle, slices, trim, trimmed

#: Bytes of text in a block, unless a single text is longer.
BLOCK_TEXT = 8 << 20
#: Bytes of text whose words share a bucket, on average.
BUCKET_TEXT = 64 << 20

_pack = zstandard.ZstdCompressor(level=3)
_unpack = zstandard.ZstdDecompressor()


def pack_bytes(raw: bytes) -> bytes:
    return _pack.compress(raw)


def unpack_bytes(packed: bytes) -> bytes:
    return _unpack.decompress(packed)


def pack_numbers(x: np.ndarray) -> bytes:
    """Byte by byte of the numbers, first all lowest bytes, which packs better than number by number."""
    x = np.ascontiguousarray(x)
    return pack_bytes(x.dtype.str.encode().ljust(4) + x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def unpack_numbers(packed: bytes) -> np.ndarray:
    raw = unpack_bytes(packed)
    dtype = np.dtype(raw[:4].decode().strip())
    return np.frombuffer(np.frombuffer(raw, np.uint8, offset=4).reshape(dtype.itemsize, -1).T.tobytes(), dtype)


def pack_words(words: list[bytes]) -> tuple[bytes, bytes]:
    return pack_bytes(b"".join(words)), pack_numbers(np.fromiter(map(len, words), np.uint32, len(words)))


def unpack_words(words: bytes, sizes: bytes) -> list[bytes]:
    raw, ends = unpack_bytes(words), np.cumsum(unpack_numbers(sizes)).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


SCHEMA = "block long, bucket int, keys array<{kind}>, places binary, ends binary, words binary, sizes binary, counts binary"
_BINARY = ("places", "ends", "words", "sizes", "counts")


def split(docs: DataFrame, words_of: Callable[[str], Iterable], key: str = "doc_id", text: str = "text", counted: str | None = None, kept: bool = True, block_text: int = BLOCK_TEXT) -> DataFrame:
    """Blocks of ``docs``: rows with bucket -1 hold documents, the others a block's words of one bucket.

    ``words_of`` gives a text's words, as str or bytes. ``counts`` holds how often a word stands in the block's
    documents where column ``counted`` is true. Null texts have no words.
    """
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(2 * partitions(docs.sparkSession), -(-size // BUCKET_TEXT))

    @trimmed
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text", block_text):
                own: dict = defaultdict(count().__next__)
                found = [np.fromiter(map(own.__getitem__, words_of(t)), np.uint32) for t in part.column(1).to_pylist()]
                words = [w if isinstance(w, bytes) else w.encode("utf-8", "surrogatepass") for w in own]
                bucket = np.fromiter((zlib.crc32(w) for w in words), np.uint32, len(words)) % np.uint32(buckets)
                flat = np.concatenate(found) if found else np.zeros(0, np.uint32)
                times = np.zeros(len(words), np.int64)
                if counted and len(words):
                    mine = np.repeat(np.asarray(part.column(2)), [len(x) for x in found])
                    times = np.bincount(flat[mine], minlength=len(words))
                # common words get small numbers, which pack better; ``order`` leads from them to the list of words
                usual = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
                number = np.empty(len(words), np.uint32)
                number[usual] = np.arange(len(words), dtype=np.uint32)
                held = part.column(0).to_pylist(), pack_numbers(number[flat] if len(flat) else flat), pack_numbers(np.cumsum([len(x) for x in found]).astype(np.int64)), pack_numbers(bucket[usual].astype(np.uint32))
                name = hashlib.blake2b(repr(held).encode(), digest_size=8)
                name.update(b"\n".join(words))
                block = int.from_bytes(name.digest(), "big", signed=True)
                rows = [{"block": block, "bucket": -1, "keys": held[0], "places": held[1], "ends": held[2], "words": held[3]}]
                order = usual[np.argsort(bucket[usual], kind="stable")]
                edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(edges)):
                    at = order[edges[b] : edges[b + 1]]
                    text_, sizes = pack_words([words[i] for i in at])
                    rows.append({"block": block, "bucket": int(b), "words": text_, "sizes": sizes, "counts": pack_numbers(times[at])})
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([pa.field("block", pa.int64()), pa.field("bucket", pa.int32()), pa.field("keys", pa.list_(part.schema.field(0).type)), *(pa.field(n, pa.binary()) for n in _BINARY)]))

    lean = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"), *([F.col(counted).alias("_counted")] if counted else []))
    if not kept:
        lean = lean.sortWithinPartitions(F.xxhash64("_key", "_text"), "_key", "_text")
    cut = lean.mapInArrow(blocks, SCHEMA.format(kind=lean.schema["_key"].dataType.simpleString()))
    return settle(cut) if kept else cut


def by_bucket(blocks: DataFrame, function: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """Runs ``function`` over all blocks' words of a bucket together."""
    return blocks.where("bucket >= 0").select("block", "bucket", "words", "sizes", "counts").groupBy("bucket").applyInArrow(function, schema)


def assemble(blocks: DataFrame, answers: DataFrame, function: Callable[[list, np.ndarray, np.ndarray, list[dict]], pa.Table], schema: str) -> DataFrame:
    """For each block, ``function(keys, places, ends, answers)`` with the answers in the order of the block's word list.

    ``answers`` has block and bucket and further binary columns.
    """
    more = [c for c in answers.columns if c not in ("block", "bucket")]
    held = blocks.where("bucket < 0").select("block", "bucket", "keys", "places", "ends", "words")

    def join(group: pa.Table) -> pa.Table:
        at = group["bucket"].to_numpy()
        found = {r["bucket"]: r for r in group.select(["bucket", *more]).filter(pa.array(at >= 0)).to_pylist()}  # blocks that are alike got the same answers
        own = group.select(["keys", "places", "ends", "words"]).filter(pa.array(at < 0)).to_pylist()
        bucket = unpack_numbers(own[0]["words"])
        if sorted(found) != np.unique(bucket).tolist():
            raise RuntimeError("answers are missing for a block: its documents were read differently the second time")
        rank = np.empty(len(bucket), np.int64)
        rank[np.argsort(bucket, kind="stable")] = np.arange(len(bucket))
        answers = [found[b] for b in sorted(found)]
        trim()
        return pa.concat_tables([function(r["keys"], rank[unpack_numbers(r["places"])], unpack_numbers(r["ends"]), answers) for r in own])

    return held.unionByName(answers.select("block", "bucket", *more), allowMissingColumns=True).groupBy("block").applyInArrow(join, schema)
