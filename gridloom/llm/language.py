"""Operator 4, language identification by multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, every run of characters that are no letters becomes one space, and all n-grams of one to
three characters are hashed into buckets. Training counts (language, bucket) over all labelled documents of the
training folds are summed in Spark; the smoothed log-probability matrix goes to the tasks as broadcasts of bounded size,
one for each 256 languages, and a text's scores are the products of its sparse bucket counts and these. With more than
256 languages one pass follows another in the same tasks, each carrying the best score and the sum so far.

Cases: a null text, or one without a letter, gets ``und`` and score 0; a null language is not learned from; a null
id falls in fold 0; texts of any length are used whole; ties go to the language that sorts first; repeated rows are
scored one by one; with nothing to learn from every text gets ``und``; an empty table gives an empty result; other
columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import fold, settle, slices, table

GRAMS = (1, 2, 3)
BUCKETS = 1 << 15
#: Languages of one block: its broadcast matrix has a row for each bucket and a column for each of them, 32 MB at most.
BLOCK_LANGUAGES = 256
#: Languages that a task counts at a time, 256 KB each.
COUNTED = 128
SMOOTHING = 0.1
#: The language of a text without a letter.
UNKNOWN = "und"
SLICE = 4 << 20

_letters: list[np.ndarray] = []


def _is_letter(codes: np.ndarray) -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0][codes]


def gram_counts(texts: list[str | None], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    """For each text its buckets and their counts; None if the text has no letter."""
    lowered = [(t or "").lower() for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.concatenate([[0], np.cumsum([len(t) for t in lowered])]).astype(np.int64)
    letter = _is_letter(codes)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    kept = np.concatenate([[0], np.cumsum(keep)])[ends]
    lettered = np.concatenate([[0], np.cumsum(letter)])[ends]
    c = np.where(letter, codes, np.uint32(32))[keep].astype(np.uint32)
    hashed, state = [], np.zeros(len(c), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        state = state[: len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1 :] * np.uint32(0x9E3779B1) + np.uint32(n)
        if n in GRAMS:
            h = state ^ (state >> np.uint32(15))
            h = h * np.uint32(0x85EBCA6B)
            hashed.append((n, ((h ^ (h >> np.uint32(13))) % np.uint32(buckets)).astype(np.int32)))
    for i in range(len(texts)):
        if lettered[i] == lettered[i + 1]:
            yield None
            continue
        a, b = kept[i], kept[i + 1]
        found = np.bincount(np.concatenate([h[a : max(a, b - n + 1)] for n, h in hashed]), minlength=buckets)
        at = np.flatnonzero(found)
        yield at, found[at]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}

    def counted() -> Iterator[pa.RecordBatch]:
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])], ["lang", "bucket", "n"])
        sums.clear()

    for batch in batches:
        for part in slices(batch, "text", SLICE):
            for lang, found in zip(part.column(0).to_pylist(), gram_counts(part.column(1).to_pylist(), BUCKETS), strict=True):
                if found is not None:
                    if lang not in sums and len(sums) == COUNTED:
                        yield from counted()
                    own = sums.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                    own[found[0]] += found[1]
                    own[BUCKETS] += 1
    yield from counted()


def train(labelled: DataFrame) -> list[tuple[list[str], np.ndarray]]:
    """Blocks of languages in order, each with its matrix of log-probabilities, (buckets + 1) x languages; its last row is the prior.

    ``labelled`` has columns lang and text.
    """
    partial = labelled.where("lang IS NOT NULL").select("lang", "text").mapInArrow(_count, "lang string, bucket int, n long")
    summed = settle(partial.groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    texts = {r[0]: r[1] for r in summed.where(F.col("bucket") == BUCKETS).select("lang", "n").orderBy("lang").collect()}  # a row for each language
    names, every = list(texts), sum(texts.values())
    blocks = []
    for begin in range(0, len(names), BLOCK_LANGUAGES):
        langs = names[begin : begin + BLOCK_LANGUAGES]
        counts, index = np.zeros((BUCKETS + 1, len(langs))), {x: i for i, x in enumerate(langs)}
        cells = summed.where(F.col("lang").between(langs[0], langs[-1])).toArrow()  # (BUCKETS + 1) * BLOCK_LANGUAGES rows at most
        counts[np.asarray(cells["bucket"]), np.array([index[x] for x in cells["lang"].to_pylist()], np.int64)] = np.asarray(cells["n"])
        matrix = np.empty(counts.shape, np.float32)
        matrix[:-1] = np.log(counts[:-1] + SMOOTHING) - np.log(counts[:-1].sum(0) + SMOOTHING * BUCKETS)
        matrix[-1] = np.log(counts[-1]) - np.log(every)
        blocks.append((langs, matrix))
    return blocks


def _scored(shared, last: bool):
    """A pass over the documents with one block of languages: the likeliest so far, its log-probability, and the sum of all against it."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, matrix = shared.value if shared is not None else ([], np.zeros((BUCKETS + 1, 0), np.float32))
        for batch in batches:
            for part in slices(batch, "_text", SLICE):
                names, tops, sums = [], [], []
                so_far = zip(*(part.column(i).to_pylist() for i in (2, 3, 4)), strict=True)
                for found, (name, top, total) in zip(gram_counts(part.column(1).to_pylist(), len(matrix) - 1), so_far, strict=True):
                    if found is not None and langs:
                        log_p = matrix[-1].astype(np.float64) + found[1].astype(np.float64) @ matrix[found[0]].astype(np.float64)
                        i = int(np.argmax(log_p))
                        highest = max(top, float(log_p[i]))
                        total = total * np.exp(top - highest) + float(np.exp(log_p - highest).sum())
                        name, top = (langs[i], highest) if log_p[i] > top else (name, top)
                    names.append(name)
                    tops.append(top)
                    sums.append(total)
                names = pa.array(names, pa.string())
                if last:
                    sure = [1 / total if total else 0.0 for total in sums]
                    yield pa.RecordBatch.from_arrays([part.column(0), names, pa.array(sure, pa.float64())], ["_key", "lang_pred", "score"])
                else:
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), names, pa.array(tops, pa.float64()), pa.array(sums, pa.float64())], part.schema.names)

    return score


def identify(docs: DataFrame, model: list[tuple[list[str], np.ndarray]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) for each row: the likeliest language and its posterior probability."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.lit(UNKNOWN).alias("_lang"), F.lit(float("-inf")).alias("_top"), F.lit(0.0).alias("_sum"))
    kind = rows.schema["_key"].dataType.simpleString()
    for at, block in enumerate(model or [None]):
        last = at + 1 >= len(model)
        shared = context.broadcast(block) if block is not None else None
        rows = rows.mapInArrow(_scored(shared, last), f"_key {kind}, lang_pred string, score double" if last else f"_key {kind}, _text string, _lang string, _top double, _sum double")
    return rows.withColumnRenamed("_key", key)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where((fold("doc_id", 4) != 2) & F.col("lang").isNotNull()))
    return identify(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_language_id": op4_language_id}
SQL: dict[str, str] = {}
