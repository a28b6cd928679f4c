"""Operator 5, BPE encoding and decoding through a distinct-word table.

Texts are split into the words of the vocabulary's own pattern; each distinct word is encoded once in each bucket
(see ``wordtable``), the ids come back by position, and decoding joins every id with the table from id to piece. That
table has the size of the vocabulary, so it is broadcast, and the join is a lookup of all of a text's ids at once.

Cases: a null or empty text has no ids and decodes to the empty text; the vocabulary's special tokens are recognised
in texts, as its library does; texts of any length are encoded whole; null ids and repeated rows pass through row by
row; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import table, trim, trimmed
from gridloom.llm.wordtable import assemble, by_bucket, pack_numbers, split, unpack_numbers, unpack_words

_loaded: dict = {}
#: Words of a document that are put together at once.
STEP = 1 << 18
#: Words that are encoded at once: each answer is some kilobytes until its ids are taken.
AT_ONCE = 1000
#: Bytes of text in a block, unless a single text is longer: less than other users of the table take, since a worker holds the vocabulary too.
BLOCK_TEXT = 2 << 20
#: Characters of the Latin blocks, for which the pattern's classes are spelt out.
LATIN = [chr(c) for c in range(0x250)]


def vocabulary(path: str):
    """The tokenizer of a vocabulary file, once in each process."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def byte_pieces(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all pieces one after another, and where each id's begin (one end more)."""
    if ("pieces", path) not in _loaded:
        tokenizer = vocabulary(path)
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # the byte-level alphabet of such vocabularies
        shifted = [b for b in range(256) if b not in plain]
        letter = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}
        special = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
        parts = [b""] * (1 + max(tokenizer.get_vocab().values()))
        for piece, i in tokenizer.get_vocab().items():
            parts[i] = special[i].encode() if i in special else bytes(letter[c] for c in piece)
        ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        _loaded["pieces", path] = np.frombuffer(b"".join(parts), np.uint8), ends
    return _loaded["pieces", path]


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[start : start + size] of every pair, one after another."""
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """Cuts a text by the pattern. Texts of Latin letters take the standard library's faster engine, its classes spelt out."""
    full, wide = regex.compile(pattern), re.compile(f"[^\0-{LATIN[-1]}]")
    body = {c: "".join(re.escape(x) for x in LATIN if regex.match(c, x)) for c in (r"\p{L}", r"\p{N}", r"\s")}

    def spelt(m: re.Match) -> str:
        part = m.group()
        if part[0] == "[":
            for c, chars in body.items():
                part = part.replace(c, chars)
            return part
        return f"[^{body[chr(92) + 's']}]" if part == r"\S" else f"[{body[part]}]"

    narrow = re.compile(re.sub(r"\[[^\]]*\]|\\p\{[LN]\}|\\[sS]", spelt, pattern))
    return lambda text: (full if wide.search(text) else narrow).findall(text)


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) of every row; ``pattern`` is the vocabulary's split pattern."""
    return _encoded(docs, path, pattern, key, text, lambda keys, ids: pa.table({"_key": keys, "ids": ids.cast(pa.list_(pa.int32()))}), "ids array<int>")


def _encoded(docs: DataFrame, path: str, pattern: str, key: str, text: str, finish: Callable[[pa.Array, pa.Array], pa.Table], more: str) -> DataFrame:
    """What ``finish(keys, ids)`` makes of the rows of each block: its column ``_key``, renamed to the key, and those in ``more``."""
    special = "|".join(regex.escape(t.content) for t in vocabulary(path).get_added_tokens_decoder().values() if t.special)
    special_at = regex.compile(special) if special else None
    cut = splitter(pattern)

    def words_of(text: str) -> list[str]:
        if special_at is None or not special_at.search(text):
            return cut(text)
        out, at = [], 0
        for m in special_at.finditer(text):  # what stands before a special token is split on its own
            out += cut(text[at : m.start()]) + [m.group()]
            at = m.end()
        return out + cut(text[at:])

    def encode_bucket(group: pa.Table) -> pa.Table:
        trim()
        tokenizer, ids_of = vocabulary(path), {}
        for w, s in zip(group["words"], group["sizes"], strict=True):
            fresh = [x for x in unpack_words(w.as_py(), s.as_py()) if x not in ids_of]
            for i in range(0, len(fresh), AT_ONCE):
                part = fresh[i : i + AT_ONCE]
                for x, e in zip(part, tokenizer.encode_batch([x.decode("utf-8", "surrogatepass") for x in part], add_special_tokens=False), strict=True):
                    ids_of[x] = np.array(e.ids, np.uint32).tobytes()  # a tenth of a list of ids
        rows = []
        for block, bucket, w, s in zip(group["block"].to_pylist(), group["bucket"].to_pylist(), group["words"], group["sizes"], strict=True):
            ids = [ids_of[x] for x in unpack_words(w.as_py(), s.as_py())]
            rows.append({"block": block, "bucket": bucket, "ids": pack_numbers(np.frombuffer(b"".join(ids), np.uint32)), "n_ids": pack_numbers(np.fromiter(map(len, ids), np.uint32, len(ids)) // 4)})
        return pa.Table.from_pylist(rows, schema=pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("ids", pa.binary()), ("n_ids", pa.binary())]))

    def put_together(keys: list, places: np.ndarray, ends: np.ndarray, answers: list[dict]) -> pa.Table:
        empty = [np.zeros(0, np.uint32)]
        ids = np.concatenate([unpack_numbers(a["ids"]) for a in answers] or empty).astype(np.int32)
        sizes = np.concatenate([unpack_numbers(a["n_ids"]) for a in answers] or empty).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        parts = [gather(ids, starts[p], sizes[p]) for p in (places[i : i + STEP] for i in range(0, len(places), STEP))]
        totals = np.concatenate([[0], np.cumsum(sizes[places])]).astype(np.int64)
        offsets = totals[np.concatenate([[0], ends])]
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        return finish(pa.array(keys, key_type), pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(flat)))

    from pyspark.sql.pandas.types import to_arrow_type

    key_type = to_arrow_type(docs.schema[key].dataType)
    kind = docs.schema[key].dataType.simpleString()
    blocks = split(docs, words_of, key, text, kept=False, block_text=BLOCK_TEXT)
    answers = by_bucket(blocks, encode_bucket, "block long, bucket int, ids binary, n_ids binary")
    return assemble(blocks, answers, put_together, f"_key {kind}, {more}").withColumnRenamed("_key", key)


def decoded_texts(ids: pa.Array, table_: tuple[np.ndarray, np.ndarray]) -> Iterator[str]:
    """The text of each row's ids, joined with the table of pieces; bytes that are no UTF-8 become U+FFFD."""
    pieces, bounds = table_
    flat, offsets = np.asarray(ids.values), np.asarray(ids.offsets)
    for a, b in zip(offsets, offsets[1:], strict=False):
        parts = []
        for i in range(a, b, STEP):
            own = flat[i : min(b, i + STEP)]
            parts.append(gather(pieces, bounds[own], bounds[own + 1] - bounds[own]).tobytes())
        yield b"".join(parts).decode("utf-8", "replace")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds the text that ``ids`` stand for, as column ``decoded``."""
    shared = encoded.sparkSession.sparkContext.broadcast(byte_pieces(path))

    @trimmed
    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded_texts(ids, shared.value), pa.string())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(texts, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))


def digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): of the ids, and of the text that they decode to, block by block."""
    shared = docs.sparkSession.sparkContext.broadcast(byte_pieces(path))

    def hashed(keys: pa.Array, ids: pa.Array) -> pa.Table:
        flat, offsets = np.asarray(ids.values).view("<u4"), np.asarray(ids.offsets)
        one = [hashlib.sha256(flat[a:b]).hexdigest() for a, b in zip(offsets, offsets[1:], strict=False)]
        two = [hashlib.sha256(t.encode()).hexdigest() for t in decoded_texts(ids, shared.value)]
        return pa.table({"_key": keys, "n_tokens": pa.array(np.diff(offsets).astype(np.int64)), "ids_sha256": pa.array(one, pa.string()), "decoded_sha256": pa.array(two, pa.string())})

    return _encoded(docs, path, pattern, key, text, hashed, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def byte_bpe_50k() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def round_trip(docs: DataFrame) -> DataFrame:
    """Encodes and decodes every row's text: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path, pattern = byte_bpe_50k()
    return digests(docs, path, pattern)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


QUERIES = {"op5_bpe": op5_bpe}
SQL: dict[str, str] = {}
