"""Operator 2, LM scoring by the likelihood of subword lattices.

The pieces are those of an existing subword vocabulary. Its file ranks them but holds no probabilities, so each
piece's probability is its share of all pieces in the training documents (a word's pieces as the vocabulary's own
library cuts it, smoothed, with the end of a text as one more piece). A word is then the sum, over all ways to cut it
into pieces, of the product of their probabilities: a forward recursion in log space over the word's lattice. A
text's probability is the product over its words and its end.

Words, their training counts and their lattice probabilities live in the distinct-word table (``wordtable``): what
is gathered grows with the corpus, is summed for each bucket of words, and never meets in one place.

Cases: a null text counts as empty; an empty text has one token, its end; a null id falls in fold 0 and trains
nothing; texts and words of any length are scored whole; repeated rows each count and are scored each; with an empty
training part all counts are 0 and probabilities come from the smoothing; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import fold, settle, table
from gridloom.llm.wordtable import assemble, by_bucket, pack_numbers, pack_words, split, unpack_numbers, unpack_words

#: Added to every count, of tokens and of pieces.
SMOOTHING = 0.1
#: Words whose lattices are worked out together.
CHUNK = 1 << 13
#: What a vocabulary's pieces put before a word's first letter.
WORD_MARK = "▁".encode()

_loaded: dict = {}


def _processor(path: str):
    if ("sp", path) not in _loaded:
        import sentencepiece

        _loaded["sp", path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _loaded["sp", path]


class Trie:
    """The pieces as byte strings: ``step[node, byte]`` leads on or to node 0; ``ends[node]`` lists ids that end there."""

    def __init__(self, path: str):
        sp = _processor(path)
        nodes: list[dict[int, int]] = [{}, {}]  # 0: nowhere, 1: the root
        self.at = np.zeros(sp.get_piece_size(), np.int64)
        self.longest = 1
        for i in range(sp.get_piece_size()):
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                continue
            piece = bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).encode()
            node = 1
            for b in piece:
                if b not in nodes[node]:
                    nodes[node][b] = len(nodes)
                    nodes.append({})
                node = nodes[node][b]
            self.at[i] = node
            self.longest = max(self.longest, len(piece))
        used = sorted({b for n in nodes for b in n})
        self.column = np.zeros(256, np.int64)
        self.column[used] = np.arange(len(used))
        self.step = np.zeros((len(nodes), len(used)), np.int32)
        for i, n in enumerate(nodes):
            for b, to in n.items():
                self.step[i, self.column[b]] = to


def trie(path: str) -> Trie:
    if ("trie", path) not in _loaded:
        _loaded["trie", path] = Trie(path)
    return _loaded["trie", path]


def node_scores(own: Trie, log_p: np.ndarray) -> np.ndarray:
    """Log-probability of the pieces that end at each node; a byte piece and a letter piece may end at the same one."""
    held = own.at > 0
    out = np.full(len(own.step), -np.inf)
    np.logaddexp.at(out, own.at[held], log_p[held])
    return out


def marginal(words: list[bytes], own: Trie, scores: np.ndarray) -> np.ndarray:
    """Natural log of each word's probability, over all its segmentations."""
    out = np.empty(len(words))
    order = sorted(range(len(words)), key=lambda i: -len(words[i]))
    for i in range(0, len(order), CHUNK):
        part = order[i : i + CHUNK]
        out[part] = _forward([WORD_MARK + words[k] for k in part], own, scores)
    return out


def _forward(words: list[bytes], own: Trie, scores: np.ndarray) -> np.ndarray:
    """``words`` from the longest to the shortest."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    data = own.column[np.frombuffer(b"".join(words), np.uint8)]
    base = np.cumsum(sizes) - sizes
    stop = np.repeat(base + sizes, sizes)
    # edge[l - 1, start]: score of the pieces of l bytes from start
    longest = int(min(own.longest, sizes[0]))
    edge = np.full((longest, len(data)), -np.inf)
    alive, node = np.arange(len(data)), np.ones(len(data), np.int32)
    for n in range(1, longest + 1):
        inside = alive + n - 1 < stop[alive]
        alive, node = alive[inside], node[inside]
        node = own.step[node, data[alive + n - 1]]
        on = node > 0
        alive, node = alive[on], node[on]
        if not len(alive):
            edge = edge[: n - 1]
            break
        edge[n - 1, alive] = scores[node]
    reach = len(edge)
    # alpha[base + words before + j]: log-probability of the first j bytes
    first = base + np.arange(len(words))
    alpha = np.full(len(data) + len(words), -np.inf)
    alpha[first] = 0.0
    many = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")  # words with at least j bytes
    for j in range(1, int(sizes[0]) + 1):
        k = many[j - 1]
        steps = np.arange(1, min(j, reach) + 1)
        back = first[:k, None] + (j - steps)
        terms = alpha[back] + edge[steps - 1, base[:k, None] + (j - steps)]
        top = terms.max(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            alpha[first[:k] + j] = np.where(np.isneginf(top), -np.inf, top + np.log(np.exp(terms - top[:, None]).sum(1)))
    return alpha[first + sizes]


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z only, and white space 0x20, 0x09-0x0D


def _distinct(group: pa.Table) -> pa.Table:
    """One row for each bucket and block; the first also holds the bucket's distinct words and their counts."""
    index: dict[bytes, int] = {}
    counts: list[np.ndarray] = []
    places: list[np.ndarray] = []
    for words, sizes, c in zip(group["words"], group["sizes"], group["counts"], strict=True):
        found = [index.setdefault(w, len(index)) for w in unpack_words(words.as_py(), sizes.as_py())]
        places.append(np.array(found, np.uint32))
        counts.append(unpack_numbers(c.as_py()))
    total = np.bincount(np.concatenate(places), np.concatenate(counts).astype(np.float64), minlength=len(index)).astype(np.int64)
    text, sizes = pack_words(list(index))
    return pa.table(
        {
            "bucket": pa.array([group["bucket"][0].as_py()], pa.int32()),
            "blocks": pa.array([group["block"].to_pylist()], pa.list_(pa.int64())),
            "places": pa.array([[pack_numbers(p) for p in places]], pa.list_(pa.binary())),
            "words": pa.array([text], pa.binary()),
            "sizes": pa.array([sizes], pa.binary()),
            "counts": pa.array([pack_numbers(total)], pa.binary()),
            "n": pa.array([int(total.sum())], pa.int64()),
            "v": pa.array([int((total > 0).sum())], pa.int64()),
        }
    )


def _piece_counts(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, found = _processor(path), Counter()
        sums = np.zeros(sp.get_piece_size())
        for batch in batches:
            for words, sizes, counts in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                times, words = unpack_numbers(counts.as_py()), unpack_words(words.as_py(), sizes.as_py())
                known = np.flatnonzero(times > 0)
                for i in range(0, len(known), 50_000):
                    at = known[i : i + 50_000]
                    ids = sp.encode([words[k].decode("utf-8", "surrogatepass") for k in at], num_threads=1)
                    flat = np.fromiter((x for p in ids for x in p), np.int64)
                    if len(flat):
                        sums += np.bincount(flat, np.repeat(times[at], [len(p) for p in ids]).astype(np.float64), minlength=len(sums))
        at = np.flatnonzero(sums)
        found.clear()
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at].astype(np.int64))], ["piece", "n"])

    return count


def score_texts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", learn: str = "_learn") -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of every row; rows where ``learn`` is true are learned from."""
    spark = docs.sparkSession
    blocks = split(docs, words_of, key, text, counted=learn)
    buckets = settle(by_bucket(blocks, _distinct, "bucket int, blocks array<long>, places array<binary>, words binary, sizes binary, counts binary, n long, v long"))
    sums = buckets.agg(F.sum("n"), F.sum("v")).first()
    ends = docs.where(F.col(learn)).count()
    total = (sums[0] or 0) + ends
    seen = (sums[1] or 0) + (ends > 0)
    pieces = buckets.select("words", "sizes", "counts").mapInArrow(_piece_counts(path), "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()  # a row for each piece at most
    n_piece = np.zeros(_processor(path).get_piece_size())
    for piece, n in pieces:
        n_piece[piece] = n
    whole = np.log(n_piece.sum() + ends + SMOOTHING * (len(n_piece) + 1))
    log_p, log_end = np.log(n_piece + SMOOTHING) - whole, float(np.log(ends + SMOOTHING) - whole)
    shared = spark.sparkContext.broadcast(log_p)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = trie(path)
        scores = node_scores(own, shared.value)
        for batch in batches:
            for row in batch.to_pylist():
                counts = unpack_numbers(row["counts"])
                found = marginal(unpack_words(row["words"], row["sizes"]), own, scores)
                for i in range(0, len(row["blocks"]), 16):
                    at = [unpack_numbers(p) for p in row["places"][i : i + 16]]
                    yield pa.RecordBatch.from_pydict({"block": pa.array(row["blocks"][i : i + 16], pa.int64()), "bucket": pa.array([row["bucket"]] * len(at), pa.int32()), "times": pa.array([pack_numbers(counts[p]) for p in at], pa.binary()), "log_p": pa.array([pack_numbers(found[p]) for p in at], pa.binary())})

    answers = buckets.select("bucket", "blocks", "places", "words", "sizes", "counts").mapInArrow(answer, "block long, bucket int, times binary, log_p binary")
    log_z = float(np.log10(total + SMOOTHING * (seen + 1)))
    end_base = float(np.log10(ends + SMOOTHING) - log_z)

    def put_together(keys: list, places: np.ndarray, ends_at: np.ndarray, found: list[dict]) -> pa.Table:
        times = np.concatenate([unpack_numbers(a["times"]) for a in found]) if found else np.zeros(0, np.int64)
        log_w = np.concatenate([unpack_numbers(a["log_p"]) for a in found]) if found else np.zeros(0)
        base = np.log10(times + SMOOTHING) - log_z
        bounds = np.concatenate([[0], ends_at])
        rows: dict[str, list] = {"n_tokens": [], "n_known": [], "base_score": [], "score": []}
        for a, b in zip(bounds, bounds[1:], strict=False):
            p = places[a:b]
            rows["n_tokens"].append(int(b - a) + 1)
            rows["n_known"].append(int((times[p] > 0).sum()) + int(ends > 0))
            rows["base_score"].append(float(base[p].sum()) + end_base)
            rows["score"].append((float(log_w[p].sum()) + log_end) / float(np.log(10)))
        return pa.table({"_key": pa.array(keys, key_type), "n_tokens": pa.array(rows["n_tokens"], pa.int64()), "n_known": pa.array(rows["n_known"], pa.int64()), "train_tokens": pa.array([total] * len(keys), pa.int64()), "base_score": pa.array(rows["base_score"], pa.float64()), "score": pa.array(rows["score"], pa.float64())})

    from pyspark.sql.pandas.types import to_arrow_type

    kind, key_type = docs.schema[key].dataType.simpleString(), to_arrow_type(docs.schema[key].dataType)
    return assemble(blocks, answers, put_together, f"_key {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("_key", key)


def op2_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", 10) != 0).alias("_learn"))
    scored = score_texts(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return scored.select("doc_id", (fold("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op2_lattice_likelihood": op2_lattice_likelihood}
SQL: dict[str, str] = {}
