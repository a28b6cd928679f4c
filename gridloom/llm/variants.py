"""Operator 12, grouping spelling variants by neighbourhoods that Bloom filters guide.

The vocabulary is counted by Spark with partial sums: runs of letters, lower-cased from A to Z only, of at least 7 code
points, seen twice or more. Two words are near if one inserted, deleted or replaced code point makes one of the other.
Every word generates its edits: each deletion, and each replacement by a greater letter, so that of two near words
exactly one generates the other, once. An edit exists as a hash only, made from the word's in constant time. It is
looked up in the blocked Bloom filter of the words of its length (blocks of 512 bits, eight of them set for a word);
only an edit that passes is spelled out and shuffled to an exact join with the vocabulary, which removes what passed
wrongly. The filters of one pass hold at most PASS_WORDS words and have a fixed size; a larger vocabulary takes several
passes, each with the words of some lengths, a frequent length being split by hash. Filters grow no fuller with the
data, so the share of wrong passes stays the same.

A word's form is its most frequent near word (ties: the first in code-point order) if it is ten times as frequent. Forms
of forms are followed by pointer doubling; frequency grows tenfold with each step, which bounds the rounds.

Cases: a null text has no words; empty texts neither; runs of any length are words, and an edit costs no more in a long
one; rows with one id and text count each as often as they occur; a null id is read as an empty one; an empty table
gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import mix, settle, store, table, trimmed
from gridloom.llm.merkle import CRC_TABLE, crc32_sql

LEAST_LENGTH = 7
LEAST_COUNT = 2
#: How many times as frequent a word's form is.
TIMES = 10
#: Letters of words, after lower-casing A to Z.
ALPHABET = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)], np.uint64)
#: Words in the filters of one pass, and 512-bit blocks for them: 16 MB.
PASS_WORDS = 1 << 22
BLOCKS = 1 << 18
LANES = 8
#: Lengths from here on share a filter, so that there are few filters whatever the lengths.
LONG = 64
#: Words whose edits one task generates.
TASK_WORDS = 1 << 15
#: Letters of the words that are edited together; an array over their edits takes some 100 times as many bytes.
LETTERS = 1 << 16

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", dropped: int = 0) -> DataFrame:
    """(word, n) of all words; with ``dropped``, one run in so many loses a letter first, chosen by a checksum of id and run."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    found = F.regexp_extract_all(F.col(text), F.lit(f"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_id"), F.explode(found).alias("_run"))
    runs = runs.select("_id", F.translate("_run", upper, lower).alias("word"))
    if dropped:
        crc = F.crc32(F.concat("_id", F.lit(":"), "word").cast("binary"))
        at = (crc % F.length("word")).cast("int")
        less = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
        runs = runs.select(F.when(crc % dropped == 0, less).otherwise(F.col("word")).alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return runs.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, and the words' bounds in them."""
    points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(w) for w in words.to_pylist()), np.int64, len(words))
    return points, np.concatenate([[0], np.cumsum(sizes)])


def _sums(points: np.ndarray, bounds: np.ndarray, power: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each letter times the base to the power of its place in its word, and the running sums of that over all words."""
    place = np.arange(len(points)) - np.repeat(bounds[:-1], np.diff(bounds))
    terms = (points + np.uint64(1)) * power[place]
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(terms, out=sums[1:])
    return place, sums


def _hash(sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return mix(sums + mix(sizes.astype(np.uint64)))


def word_hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and length of each word."""
    points, bounds = _letters(words)
    sizes = np.diff(bounds)
    _, sums = _sums(points, bounds, _powers(int(sizes.max(initial=0)) + 1))
    return _hash(sums[bounds[1:]] - sums[bounds[:-1]], sizes), sizes


def edits(points: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes of the words' edits: (hash, length, word, place, letter or 0 for a deletion)."""
    sizes = np.diff(bounds)
    power = _powers(int(sizes.max(initial=0)) + 1)
    place, sums = _sums(points, bounds, power)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    whole = (sums[bounds[1:]] - sums[bounds[:-1]])[owner]
    size = sizes[owner]
    # of equal letters in a row only the first is deleted: the results would be alike
    first = np.ones(len(points), bool)
    first[1:] = (points[1:] != points[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    head = sums[at] - sums[bounds[owner[at]]]
    tail = (sums[bounds[owner[at] + 1]] - sums[at + 1]) * _INVERSE
    yield _hash(head + tail, size[at] - 1), size[at] - 1, owner[at], place[at], np.zeros(len(at), np.uint64)
    for letter in ALPHABET:
        at = np.flatnonzero(points < letter)
        if len(at):
            yield _hash(whole[at] + (letter - points[at]) * power[place[at]], size[at]), size[at], owner[at], place[at], np.full(len(at), letter)


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class Pass:
    """Which filters are held: for each length up to LONG, first block, blocks, first part, parts held, and parts of this length."""

    def __init__(self, plan: dict[int, tuple[int, int, int, int, int]]):
        self.plan = np.zeros((LONG + 1, 5), np.int64)
        self.plan[:, 4] = 1
        for length, row in plan.items():
            self.plan[length] = row

    def blocks(self, hashes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the words belong to this pass, and the block of each of these."""
        first, blocks, start, held, parts = self.plan[np.minimum(lengths, LONG)].T
        part = ((hashes >> np.uint64(48)) % parts.astype(np.uint64)).astype(np.int64) - start
        here = np.flatnonzero((part >= 0) & (part < held) & (blocks > 0))
        return here, first[here] + ((hashes[here] & np.uint64(0xFFFFFFFF)).astype(np.int64) * blocks[here] >> 32)


def passes(counts: dict[int, int]) -> list[Pass]:
    """Shares the lengths (length up to LONG: words) out over passes of PASS_WORDS words at most."""
    plans: list[dict[int, tuple[int, int, int, int, int]]] = [{}]
    room, used = PASS_WORDS, 0
    for length, n in sorted(counts.items()):
        parts = max(1, math.ceil(n / (PASS_WORDS / 2)))
        each = math.ceil(n / parts)
        for part in range(parts):
            if each > room:
                plans.append({})
                room, used = PASS_WORDS, 0
            blocks = max(1, each * BLOCKS // PASS_WORDS)
            held = plans[-1].get(length)
            plans[-1][length] = (held[0], held[1] + blocks, held[2], held[3] + 1, parts) if held else (used, blocks, part, 1, parts)
            room, used = room - each, used + blocks
    return [Pass(p) for p in plans if p]


def _lanes(hashes: np.ndarray) -> np.ndarray:
    """For each word the bit that it sets in each of its block's eight words of 64 bits."""
    return mix(hashes)[:, None] >> (np.arange(LANES, dtype=np.uint64) * np.uint64(6)) & np.uint64(63)


def filters(words: DataFrame, held: Pass):
    """The broadcast filters of a pass, of BLOCKS blocks and some for rounding; ``words``: (word)."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, sizes = word_hashes(batch.column(0))
            here, block = held.blocks(hashes, sizes)
            lane = _lanes(hashes[here])
            at = (block[:, None] * LANES + np.arange(LANES)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array((np.uint64(1) << lane.ravel()).view(np.int64))], ["at", "bits"])

    found = words.mapInArrow(bits, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()  # a row for each 64 bits at most
    out = np.zeros(int((held.plan[:, 0] + held.plan[:, 1]).max()) * LANES, np.uint64)
    out[np.asarray(found["at"])] = np.asarray(found["bits"]).view(np.uint64)
    return words.sparkSession.sparkContext.broadcast(out)


def _runs(words: pa.Array) -> Iterator[pa.Array]:
    """Runs of words with about LETTERS letters."""
    total = np.cumsum(np.fromiter((len(w) for w in words.to_pylist()), np.int64, len(words)))
    cuts = np.flatnonzero(np.diff(total // LETTERS, prepend=0)) + 1
    begin = 0
    for end in [*cuts, len(words)]:
        if end > begin:
            yield words.slice(begin, end - begin)
        begin = end


def candidates(words: DataFrame, held: Pass) -> DataFrame:
    """(word, n, other): the edits of each word that a filter of this pass lets through; ``words``: (word, n)."""
    bits = filters(words.select("word"), held)

    @trimmed
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = bits.value
        for batch in batches:
            at = 0
            for part in _runs(batch.column(0)):
                text = part.to_pylist()
                points, bounds = _letters(part)
                rows: list[tuple[int, str]] = []
                for hashes, sizes, owner, place, letter in edits(points, bounds):
                    left, block = held.blocks(hashes, sizes)
                    scattered = mix(hashes[left])
                    for lane in range(LANES):  # few are left after the first lanes
                        bit = scattered >> np.uint64(6 * lane) & np.uint64(63)
                        passed = np.flatnonzero(table_[block * LANES + lane] >> bit & np.uint64(1))
                        left, block, scattered = left[passed], block[passed], scattered[passed]
                    for i in left:
                        w, p = text[owner[i]], int(place[i])
                        rows.append((int(owner[i]), w[:p] + (chr(int(letter[i])) if letter[i] else "") + w[p + 1 :]))
                own = pa.array([at + i for i, _ in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array([w for _, w in rows], pa.string())], ["word", "n", "other"])
                at += len(part)

    return words.mapInArrow(probe, "word string, n long, other string")


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n) of all near words, each pair once; ``words``: (word, n), read several times."""
    length = F.least(F.length("word"), F.lit(LONG))
    counts = {r[0]: r[1] for r in words.groupBy(length.alias("length")).count().collect()}  # LONG rows at most
    known = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    dealt = words.repartition(max(1, math.ceil(sum(counts.values()) / TASK_WORDS)))
    out = None
    for held in passes(counts):
        found = candidates(dealt, held).join(known, "other").select("word", "n", "other", "other_n")
        out = found if out is None else out.unionAll(found)
    return out if out is not None else words.join(known, F.lit(False))


def _last(forms: DataFrame, most: int) -> DataFrame:
    """(word, root): forms (word, form) followed to the end; no word is seen more than ``most`` times."""
    steps = max(1, math.floor(math.log(max(most, 1), TIMES)))  # each step is TIMES as frequent
    links = settle(forms.select("word", F.col("form").alias("root")))
    for _ in range(math.ceil(math.log2(steps))):
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("far"))
        links = settle(links.join(ahead, "root", "left").select("word", F.coalesce("far", "root").alias("root")))
    return links


def group(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word; ``words``: (word, n)."""
    words = store(words)
    pairs = store(near_pairs(words))
    both = pairs.unionAll(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best: Column = F.min(F.struct((-F.col("other_n")).alias("back"), "other"))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    often = (-F.col("best.back")) >= TIMES * F.col("n")
    rows = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(often, F.col("best.other")).alias("form"), F.when(often, -F.col("best.back")).alias("form_n"))
    rows = store(rows)
    roots = _last(rows.where("form IS NOT NULL"), rows.agg(F.max("n")).first()[0] or 1)
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(vocabulary(table(spark, sf_dir, "documents"), dropped=31))


SQL = {
    "op12_variants": f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')) AS r FROM documents)),
each AS (SELECT id, w, count(*) AS n FROM runs GROUP BY id, w),
sums AS (SELECT w, n, {crc32_sql("concat(id, ':', w)")} AS h FROM each, crc_table),
changed AS (SELECT CASE WHEN h % 31 = 0 THEN concat(substr(w, 1, CAST(h % length(w) AS INT)), substr(w, CAST(h % length(w) AS INT) + 2)) ELSE w END AS word, n FROM sums),
vocab AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM changed WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cuts AS (SELECT DISTINCT word, n, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab)),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, v.word, v.n FROM cuts a JOIN vocab v ON a.rest = v.word
  UNION SELECT v.word, v.n, a.word, a.n FROM cuts a JOIN vocab v ON a.rest = v.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
forms AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * v.n THEN other END AS form, CASE WHEN other_n >= 10 * v.n THEN other_n END AS form_n FROM vocab v LEFT JOIN best b ON v.word = b.word),
ways AS (SELECT word, form AS root, 1 AS steps FROM forms WHERE form IS NOT NULL UNION ALL SELECT w.word, f.form, w.steps + 1 FROM ways w JOIN forms f ON f.word = w.root WHERE f.form IS NOT NULL),
lasts AS (SELECT word, arg_max(root, steps) AS root FROM ways GROUP BY word)
SELECT f.word, f.form, coalesce(l.root, f.word) AS root, f.n, f.n_near, f.form_n FROM forms f LEFT JOIN lasts l ON f.word = l.word"""
}
QUERIES = {"op12_variants": op12_variants}
