"""Operator 10, substring dedup by sliding sentence spans.

Sentences end at ``.``, ``!`` or ``?`` before white space and at line ends; one of over 13 words is cut after
the word of the least hash (the last of equal ones) in each run of 7 words, so its pieces have 7 words at most and
depend on the words near the cut, not on where the sentence begins. From every sentence runs a span of two or more
consecutive sentences, up to the first that brings it to 25 words. So every repeated passage of over 50 words holds a
whole span wherever it begins: the cuts are alike from its 13th word to the 13th from its end at the latest, which
leaves 25. Phrases of under 25 words never match: short sentences are common property. Spans are hashed over their
words, joined over all documents, and the sentences that lie in any span but its first occurrence (smallest id, then
first in the text) are removed.

Hashes alone are counted first, with partial sums before the shuffle; then only spans whose hash may be a repeated one
(a bitmap of fixed size tells; where it is full more spans are shuffled, none is lost) are brought together with their
places, by a join that is dealt over all tasks where one span is very frequent.

Cases: a null text has no sentences and stays null; an empty or short text has no span and stays as it is; equal
texts lose all sentences but the first one's; a span repeated inside one text counts too; rows with the same id are
told apart by a hash of their text, and rows that are alike in id and text count as one; a null id comes before all
others; texts of any length are read whole; an empty table gives an empty result; other columns are not read, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import as_bytes, run_hashes, settle, sieve, sifted, slices, span_hashes, spread_join, store, table, trimmed, word_spans

#: Words that a span reaches at least.
SPAN_WORDS = 25
SPAN_SENTENCES = 2
#: Words of the longest sentence that is not cut, and of the runs that have a cut each. A passage of 2 * WHOLE_WORDS + SPAN_WORDS words holds a span if WHOLE_WORDS is 2 * CUT_WORDS - 1 or more.
WHOLE_WORDS = 13
CUT_WORDS = 7
#: Bytes of text that are cut into sentences at once, unless a single text is longer; a worker's arrays take some 80 times as much (20 MB measured).
SLICE_BYTES = 1 << 18


def sentences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all sentences that have a word: text, first and last byte in the joined texts, and words before and up to it; then the words' hashes."""
    data, ends = as_bytes(texts)
    starts, stops = word_spans(data, ends)
    n = len(starts)
    owner = np.searchsorted(ends, starts, side="right") - 1
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(1, np.int64), np.zeros(0, np.uint64)
    lines = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 0x0A, out=lines[1:])
    first = np.ones(n, bool)
    first[1:] = np.isin(data[stops[:-1] - 1], np.frombuffer(b".!?", np.uint8)) | (lines[starts[1:]] > lines[stops[:-1]]) | (owner[1:] != owner[:-1])
    words = span_hashes(data, starts, stops)
    begin = np.flatnonzero(first)
    sizes = np.diff(np.append(begin, n))
    left = np.repeat(begin + sizes, sizes) - np.arange(n)  # words from here to the sentence's end
    run = np.flatnonzero((np.repeat(sizes, sizes) > WHOLE_WORDS) & (left >= CUT_WORDS))
    least, at = words[run], run.copy()
    for k in range(1, CUT_WORDS):
        lower = words[run + k] <= least
        least[lower], at[lower] = words[run + k][lower], run[lower] + k
    first[at[at + 1 < n] + 1] = True
    begin = np.flatnonzero(first)
    bounds = np.append(begin, n)
    return owner[begin], starts[begin], stops[bounds[1:] - 1], bounds, words


def spans(owner: np.ndarray, bounds: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last sentence of each span, and its hash, which is over its words; white space doesn't count."""
    n = len(owner)
    first = np.arange(n)
    last = np.maximum(np.searchsorted(bounds[1:], bounds[:-1] + SPAN_WORDS), first + SPAN_SENTENCES - 1)
    inside = last < n
    inside[inside] &= owner[last[inside]] == owner[first[inside]]
    first, last = first[inside], last[inside]
    return first, last, run_hashes(words, bounds[first], bounds[last + 1]).view(np.int64)


@trimmed
def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, how often it occurs) of the spans of each slice."""
    for batch in batches:
        for part in slices(batch, "_text", SLICE_BYTES):
            owner, _, _, bounds, words = sentences(part.column(0))
            values, times = np.unique(spans(owner, bounds, words)[2], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(times.astype(np.int64))], ["span", "n"])


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_key, _hash, first, last, first_key): each span that occurs earlier, and the key of the first occurrence."""
    lean = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.xxhash64(F.col(text)).alias("_hash"), F.col(text).alias("_text"))
    kind = lean.schema["_key"].dataType.simpleString()
    counts = lean.select("_text").mapInArrow(_counts, "span long, n long").groupBy("span").agg(F.sum("n").alias("n"))
    repeated = sieve(counts.where("n > 1"), "span")

    @trimmed
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(document, hash of each span that may be repeated, its first and last sentence)."""
        for batch in batches:
            for part in slices(batch, "_text", SLICE_BYTES):
                owner, _, _, bounds, words = sentences(part.column(2))
                first, last, hashes = spans(owner, bounds, words)
                keep = sifted(repeated.value, hashes)
                first, last, hashes = first[keep], last[keep], hashes[keep]
                head = np.searchsorted(owner, owner[first])  # a text's first sentence
                at = pa.array(owner[first])
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(hashes), pa.array((first - head).astype(np.int32)), pa.array((last - head).astype(np.int32))], ["_key", "_hash", "span", "first", "last"])

    found = store(lean.mapInArrow(places, f"_key {kind}, _hash long, span long, first int, last int"))
    where = F.struct("_key", "_hash", "first")
    seen = settle(found.groupBy("span").agg(F.min(where).alias("least"), F.max(where).alias("most")).where("least != most").select("span", "least"))
    again = spread_join(found, seen, "span").where(where != F.col("least"))
    return again.select("_key", "_hash", "first", "last", F.col("least._key").alias("first_key"))


@trimmed
def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the sentences in ``runs``."""
    for whole in batches:
        for batch in slices(whole, "_text", SLICE_BYTES):
            names = batch.schema.names
            column = batch.column(names.index("_text"))
            data, ends = as_bytes(column)
            raw = data.tobytes()
            owner, starts, stops, _, _ = sentences(column)
            head = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            texts, gone, passages = [], [], []
            for i, (text, runs) in enumerate(zip(column, batch.column(names.index("runs")).to_pylist(), strict=True)):
                drop = np.zeros(head[i + 1] - head[i] + 1, np.int64)
                for r in runs or []:
                    drop[r["first"]] += 1
                    drop[r["last"] + 1] -= 1
                drop = np.flatnonzero(np.cumsum(drop[:-1]) > 0)
                places: list[list[int]] = []
                for k in drop:
                    if places and k == places[-1][2] + 1:
                        places[-1][1:] = [int(stops[head[i] + k]), k]
                    else:
                        places.append([int(starts[head[i] + k]), int(stops[head[i] + k]), k])
                cuts = [int(ends[i]), *(x for p in places for x in p[:2]), int(ends[i + 1])]
                texts.append(b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)).decode() if text.is_valid else None)
                gone.append(len(drop))
                passages.append([raw[p[0] : p[1]].decode() for p in places])
            keep = [i for i, n in enumerate(names) if n not in ("_text", "runs")]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(texts, pa.string()), pa.array(np.diff(head)), pa.array(gone, pa.int64()), pa.array(passages, pa.list_(pa.string()))], [*(names[i] for i in keep), "clean_text", "n_sentences", "n_removed", "removed"])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", every_row: bool = True) -> DataFrame:
    """(key, clean_text, n_sentences, n_removed, removed, first_ids) of every row, or only of the rows that lose a sentence.

    ``removed`` are the passages taken out, ``first_ids`` the keys of the texts that hold their first occurrences.
    """
    again = repeated_spans(docs, key, text)
    runs = again.groupBy("_key", "_hash").agg(F.collect_set(F.struct("first", "last")).alias("runs"), F.sort_array(F.collect_set("first_key")).alias("first_ids"))
    runs = store(runs.select(F.col("_key").alias("_key2"), F.col("_hash").alias("_hash2"), "runs", "first_ids"))
    # only texts that may have a run are shuffled
    lean = docs.select(F.col(key).alias("_key"), F.xxhash64(F.col(text)).alias("_hash"), F.col(text).alias("_text"))
    asked = sieve(runs.select(F.xxhash64("_key2", "_hash2").alias("_id")), "_id")
    kind = lean.schema["_key"].dataType.simpleString()
    marked = lean.select("_key", "_hash", "_text", F.xxhash64("_key", "_hash").alias("_id"))

    def asked_for(batch: pa.RecordBatch, wanted: bool) -> pa.RecordBatch:
        return batch.select([0, 1, 2]).filter(pa.array(sifted(asked.value, np.asarray(batch.column(3))) == wanted))

    @trimmed
    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield asked_for(batch, True)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows without a run, sifted and cut by one worker."""
        for batch in batches:
            rest = asked_for(batch, False)
            keys, none = rest.column(0), pa.nulls(rest.num_rows)
            yield from _cut([pa.RecordBatch.from_arrays([keys, rest.column(2), none, none.cast(pa.list_(keys.type))], ["_key", "_text", "runs", "first_ids"])])

    may = marked.mapInArrow(some, lean.schema)
    joined = may.join(runs.hint("merge"), may["_key"].eqNullSafe(runs["_key2"]) & (F.col("_hash") == F.col("_hash2")), "left" if every_row else "inner").select("_key", "_text", "runs", "first_ids")
    schema = f"_key {kind}, first_ids array<{kind}>, clean_text string, n_sentences long, n_removed long, removed array<string>"
    out = joined.mapInArrow(_cut, schema)
    if every_row:
        out = out.unionAll(marked.mapInArrow(others, schema))
    return out.withColumnRenamed("_key", key)


def op10_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: what it loses, the rest of its text, and whose passages they were."""
    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op10_sentence_spans": op10_sentence_spans}
SQL: dict[str, str] = {}
