"""Operator 7, quality rules by repetition coverage.

A text is a list of words ``[^\\x20\\x09-\\x0D]+`` and of lines (split at ``\\n``). For each n-gram length the
share of word characters that lie inside n-grams found twice or more is measured, and the share of line
characters in lines equal to an earlier line. Rolling hashes of the words, combined over each window in numpy,
stand for the n-grams.

Cases: a null text counts as empty; an empty text has no words and fails the base rule; a text of any length is
measured whole; repeated rows are judged one by one, each alike; null ids pass through; an empty table gives an
empty result; other columns of the input are carried along or dropped, never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import as_bytes, mix, slices, span_hashes, table, trimmed, word_spans

#: n-gram length: per cent of word characters that duplicated n-grams may hold.
GRAM_LIMITS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
#: Per cent of line characters that lines equal to an earlier one may hold.
LINE_LIMIT = 20
SYMBOLS = b"#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_chars", "dup_line_chars", *(f"dup_chars_{n}" for n in GRAM_LIMITS))


def _twice(hashes: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Which of the windows occur twice or more in their own text."""
    if not len(hashes):
        return np.zeros(0, bool)
    keys = mix(hashes ^ mix(texts.astype(np.uint64) + np.uint64(0x51ED)))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _covered(hashes: np.ndarray, texts: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in an n-word window that their text holds twice or more."""
    k = len(hashes) - n + 1
    out = np.zeros(len(hashes), bool)
    if k <= 0:
        return out
    inside = texts[:k] == texts[n - 1 :]
    windows = np.zeros(k, np.uint64)
    for i in range(n):
        windows = windows * np.uint64(0x100000001B3) + hashes[i : i + k]
    at = np.flatnonzero(inside)
    hit = at[_twice(mix(windows[at]), texts[at])]
    steps = np.zeros(len(hashes) + 1, np.int32)
    np.add.at(steps, hit, 1)
    np.add.at(steps, hit + n, -1)
    return np.cumsum(steps[:-1]) > 0


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The measures of each text; all are counts, so that no rounding enters a verdict."""
    data, ends = as_bytes(texts)
    rows = len(ends) - 1
    total = lambda index, weight: np.bincount(index, weight, minlength=rows).astype(np.int64)
    starts, stops = word_spans(data, ends)
    owner = np.searchsorted(ends, starts, side="right") - 1
    hashes = span_hashes(data, starts, stops)
    points = np.zeros(len(data) + 1, np.int64)  # code points before a byte
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    chars = points[stops] - points[starts]
    out = {"n_words": np.bincount(owner, minlength=rows).astype(np.int64), "word_chars": total(owner, chars)}
    marks = np.flatnonzero(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)))
    out["n_symbols"] = np.bincount(np.searchsorted(ends, marks, side="right") - 1, minlength=rows).astype(np.int64)
    out["n_repeat_words"] = total(owner, _covered(hashes, owner, 3))
    for n in GRAM_LIMITS:
        out[f"dup_chars_{n}"] = total(owner, np.where(_covered(hashes, owner, n), chars, 0))

    cuts = np.flatnonzero(data == 0x0A)
    line_starts = np.sort(np.concatenate([ends[:-1], cuts + 1]), kind="stable")
    line_owner = np.sort(np.concatenate([np.arange(rows), np.searchsorted(ends, cuts, side="right") - 1]), kind="stable")
    line_ends = np.sort(np.concatenate([ends[1:], cuts]), kind="stable")
    words_before = np.searchsorted(starts, [line_starts, line_ends])
    full = words_before[1] > words_before[0]
    line_starts, line_ends, line_owner = line_starts[full], line_ends[full], line_owner[full]
    keys = mix(span_hashes(data, line_starts, line_ends) ^ mix(line_owner.astype(np.uint64)))
    again = np.ones(len(keys), bool)
    again[np.unique(keys, return_index=True)[1]] = False
    sizes = points[line_ends] - points[line_starts]
    out["n_dup_lines"] = total(line_owner, again)
    out["line_chars"] = total(line_owner, sizes)
    out["dup_line_chars"] = total(line_owner, np.where(again, sizes, 0))
    return out


@trimmed
def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "_text"):
            found = measure(part.column(part.schema.get_field_index("_text")))
            kept = [(name, part.column(i)) for i, name in enumerate(part.schema.names) if name != "_text"]
            yield pa.RecordBatch.from_arrays([c for _, c in kept] + [pa.array(found[m]) for m in MEASURES], [n for n, _ in kept] + [f"_{m}" for m in MEASURES])


def measures(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """The columns ``carry`` of every row and its measures, each named with a leading underscore; no shuffle."""
    fields = [T.StructField(f"_c{i}", docs.schema[c].dataType) for i, c in enumerate(carry)]
    schema = T.StructType(fields + [T.StructField(f"_{m}", T.LongType()) for m in MEASURES])
    lean = docs.select(*(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return lean.mapInArrow(_measured, schema)


def verdict() -> tuple[F.Column, F.Column]:
    """(base_failed, kept) over the columns that ``measures`` gives."""
    base = (F.col("_n_words") < 50) | (100 * F.col("_n_repeat_words") > 50 * F.col("_n_words"))
    over = 100 * F.col("_dup_line_chars") > LINE_LIMIT * F.col("_line_chars")
    for n, limit in GRAM_LIMITS.items():
        over = over | (100 * F.col(f"_dup_chars_{n}") > limit * F.col("_word_chars"))
    return base, ~base & ~over


def filter_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text passes the base rule and every limit."""
    names = docs.columns
    at = names.index(text)
    plain = docs.select(*(F.col(f"`{c}`").alias(f"_f{i}") for i, c in enumerate(names)))

    @trimmed
    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, f"_f{at}"):
                found = measure(part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(found[m]) for m in MEASURES)], [*part.schema.names, *(f"_{m}" for m in MEASURES)])

    schema = T.StructType([*plain.schema.fields, *(T.StructField(f"_{m}", T.LongType()) for m in MEASURES)])
    kept = plain.mapInArrow(judged, schema).where(verdict()[1])
    return kept.select(*(F.col(f"_f{i}").alias(c) for i, c in enumerate(names)))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, kept = verdict()
    found = measures(table(spark, sf_dir, "documents"), ["doc_id"])
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    more = [m for m in MEASURES if m not in shown]
    return found.select(F.col("_c0").alias("doc_id"), *(F.col(f"_{m}").alias(m) for m in shown), base.alias("base_failed"), kept.alias("kept"), *(F.col(f"_{m}").alias(m) for m in more))


QUERIES = {"op7_quality_rules": op7_quality_rules}

_GRAM_SQL = ", ".join(
    f"""g{n} AS (SELECT rid, sum(n_chars) AS dup_chars_{n}, count(*) AS hit_{n} FROM (
      SELECT DISTINCT w.rid, w.pos, length(w.word) AS n_chars FROM w JOIN (
        SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, gram) AS k FROM (
          SELECT rid, pos, {' || chr(32) || '.join(f'lead(word, {i}) OVER (PARTITION BY rid ORDER BY pos)' if i else 'word' for i in range(n))} AS gram FROM w) WHERE gram IS NOT NULL) WHERE k > 1) s
      ON w.rid = s.rid AND w.pos BETWEEN s.pos AND s.pos + {n - 1}) GROUP BY rid)"""
    for n in (3, *GRAM_LIMITS)
)
SQL = {
    "op7_quality_rules": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, word, row_number() OVER (PARTITION BY rid ORDER BY i) AS pos FROM (
  SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT rid, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d))),
n AS (SELECT rid, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY rid),
l AS (SELECT rid, count(*) FILTER (k > 1) AS n_dup_lines, sum(length(line)) AS line_chars, coalesce(sum(length(line)) FILTER (k > 1), 0) AS dup_line_chars FROM (
  SELECT rid, line, row_number() OVER (PARTITION BY rid, line) AS k FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')) GROUP BY rid),
{_GRAM_SQL},
m AS (SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(hit_3, 0)::BIGINT AS n_repeat_words, coalesce(line_chars, 0)::BIGINT AS line_chars, coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars,
  {', '.join(f'coalesce(dup_chars_{n}, 0)::BIGINT AS dup_chars_{n}' for n in GRAM_LIMITS)}
  FROM d LEFT JOIN n USING (rid) LEFT JOIN l USING (rid) {' '.join(f'LEFT JOIN g{n} USING (rid)' for n in (3, *GRAM_LIMITS))}),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND 100 * dup_line_chars <= {LINE_LIMIT} * line_chars {' '.join(f'AND 100 * dup_chars_{n} <= {k} * word_chars' for n, k in GRAM_LIMITS.items())} AS kept FROM b"""
}
