"""Operator 3, benchmark decontamination by pigeonhole edit matching.

A test item of m characters (lower case, white space collapsed) may differ from a document's passage by k edits,
k = 8 per cent of m. Cut into k + 1 pieces, at least one piece of every such passage is exact, so all pieces of all
items are searched at once (Aho-Corasick), and each hit's surroundings are verified with Myers' bit-parallel
edit distance. Verification climbs from the piece: a run of j neighbouring pieces may hold j - 1 edits, and if a run
is within its budget, so is one of its halves; a chance hit ends at the first run of two. Starts that lie close together,
as those of an item that repeats itself, are verified as one stretch, and of passages that overlap the nearest counts;
an item's distance is that of its nearest passage, the first of equally near ones.

The items are taken in blocks of about 4 MB; each block is one pass over the documents, so that what the driver and
the tasks hold never grows with the benchmark.

Cases: a null or blank item matches nothing; an item of under 13 characters must match exactly; repeated items are
reported each; a null or empty text has no match; ids may be null; texts of any length are searched whole; repeated
rows are reported one by one; an empty benchmark or an empty table gives an empty result (and removes nothing);
other columns are not read, whatever their names, and ``remove_leaking`` gives them back as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from gridloom.llm.common import settle, slices, table, trimmed

#: Edits allowed per character of the item.
ERROR_RATE = 0.08
#: Bytes of item text that one pass takes, on average.
ITEM_BLOCK_BYTES = 4 << 20


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(item: str) -> int:
    return int(len(item) * ERROR_RATE)


def pieces(item: str) -> list[tuple[int, str]]:
    """Offset and text of the budget + 1 pieces."""
    n = budget(item) + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def pattern_bits(item: str) -> dict[str, int]:
    bits: dict[str, int] = {}
    for i, c in enumerate(item):
        bits[c] = bits.get(c, 0) | 1 << i
    return bits


def nearest_end(item: str, bits: dict[str, int], text: str) -> tuple[int, int]:
    """(distance, end) of the part of ``text`` nearest to ``item``: Myers' search with one integer for each column."""
    m = len(item)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = mask, 0, m
    best, at = m, 0
    for j, c in enumerate(text, 1):
        eq = bits.get(c, 0)
        down = eq | minus
        across = ((eq & plus) + plus ^ plus) | eq
        up = minus | ~(across | plus) & mask
        left = plus & across
        if up & top:
            score += 1
        elif left & top:
            score -= 1
        up = up << 1
        left = left << 1
        plus = (left | ~(down | up)) & mask
        minus = up & down & mask
        if score < best:
            best, at = score, j
    return best, at


class Matcher:
    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(key, t, budget(t), pattern_bits(t)) for key, t in ((k, normal(x)) for k, x in items) if t]
        self.cuts = [[a for a, _ in pieces(t)] + [len(t)] for _, t, _, _ in self.items]
        self.runs: dict[tuple[int, int, int], tuple[str, dict[str, int]]] = {}
        owners: dict[str, list[tuple[int, int]]] = {}
        for i, (_, t, _, _) in enumerate(self.items):
            for p, (_, piece) in enumerate(pieces(t)):
                owners.setdefault(piece, []).append((i, p))
        self.search = ahocorasick.Automaton()
        for piece, where in owners.items():
            self.search.add_word(piece, (len(piece), where))
        if owners:
            self.search.make_automaton()

    def _likely(self, i: int, p: int, at: int, text: str) -> bool:
        """Whether each run of 2, 4, 8... pieces around piece ``p``, up to half the item, is within its budget."""
        cuts, size = self.cuts[i], 2
        n = len(cuts) - 1
        while size < n:
            a = p // size * size
            b = min(n, a + size)
            if b - a > 1:
                if (i, a, b) not in self.runs:
                    part = self.items[i][1][cuts[a] : cuts[b]]
                    self.runs[i, a, b] = part, pattern_bits(part)
                part, bits = self.runs[i, a, b]
                k = b - a - 1
                low = at - cuts[p] + cuts[a]
                if nearest_end(part, bits, text[max(0, low - k) : max(0, low + len(part) + k)])[0] > k:
                    return False
            size *= 2
        return True

    def hits(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(item, distance, start, end, passages) in the normal text, for each item within its budget."""
        if not self.items or not text:
            return []
        starts: dict[int, set[int]] = {}
        for end, (size, where) in self.search.iter(text):
            for i, p in where:
                at = end + 1 - size
                start = at - self.cuts[i][p]
                if start not in starts.get(i, ()) and (start >= 0 and text.startswith(self.items[i][1], start) or self._likely(i, p, at, text)):
                    starts.setdefault(i, set()).add(start)
        out = []
        for i, found in starts.items():
            passages: list[tuple[int, int, int]] = []
            for hit in self._verified(i, sorted(found), text):
                if passages and hit[1] < passages[-1][2] - self.items[i][2]:  # the same passage: its nearest part counts
                    passages[-1] = min(passages[-1], hit)
                else:
                    passages.append(hit)
            if passages:
                out.append((i, *min(passages), len(passages)))
        return out

    def _verified(self, i: int, starts: list[int], text: str) -> Iterator[tuple[int, int, int]]:
        """(distance, start, end) of the nearest part around each run of starts that lie within the budget of each other."""
        _, item, k, bits = self.items[i]
        m, begin = len(item), 0
        for end in range(1, len(starts) + 1):
            if end < len(starts) and starts[end] - starts[end - 1] <= k:
                continue
            run, begin = starts[begin:end], end
            exact = next((at for at in run if at >= 0 and text.startswith(item, at)), None)
            if exact is not None:
                yield 0, exact, exact + m
            elif k:
                low = max(0, run[0] - k)
                near, stop = nearest_end(item, bits, text[low : max(0, run[-1] + m + k)])
                if near <= k:
                    _, size = nearest_end(item[::-1], pattern_bits(item[::-1]), text[low : low + stop][::-1])
                    yield near, low + stop - size, low + stop


def raw_place(text: str, start: int, end: int) -> tuple[int, int]:
    """Where characters start to end of the normal text lie in the text itself."""
    place, gap, raw = [], False, 0
    for raw, c in enumerate(text):
        if c.isspace():
            gap = True
            continue
        if gap and place:
            place.append(raw - 1)
        gap = False
        place.extend([raw] * len(c.lower()))
        if len(place) > end:
            break
    return place[start], place[end - 1] + 1


def item_blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks; the number of blocks follows the size of the benchmark."""
    lean = benchmark.select(F.col(item).alias("item"), F.col(text).alias("text")).where("text is not null")
    total = lean.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // ITEM_BLOCK_BYTES)
    for b in range(n):
        yield [(r[0], r[1]) for r in lean.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b).collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and item found in it: key, item, distance, budget, n_passages, and where the nearest passage begins and ends in the text."""
    lean = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    out = "_key {}, _item {}, distance int, budget int, n_passages int, start long, end long".format(lean.schema["_key"].dataType.simpleString(), benchmark.schema[item].dataType.simpleString())
    item_type = to_arrow_type(benchmark.schema[item].dataType)
    found = None
    for block in item_blocks(benchmark, item, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        @trimmed
        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value)
            for batch in batches:
                rows: list[tuple] = []
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for i, near, start, end, n in matcher.hits(normal(t)):
                        rows.append((k, matcher.items[i][0], near, matcher.items[i][2], n, *raw_place(t, start, end)))
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(NAMES, r, strict=True)) for r in rows], schema=pa.schema([pa.field("_key", batch.schema.field(0).type), pa.field("_item", item_type), *_REST]))

        part = lean.mapInArrow(search, out)
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], T._parse_datatype_string(out))
    return found.withColumnsRenamed({"_key": key, "_item": "item_id"})


NAMES = ("_key", "_item", "distance", "budget", "n_passages", "start", "end")
_REST = [pa.field(n, pa.int32()) for n in NAMES[2:5]] + [pa.field(n, pa.int64()) for n in NAMES[5:]]


def remove_leaking(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, as they are, that hold none of the items."""
    names = docs.columns
    at = names.index(text)
    for i, block in enumerate(item_blocks(benchmark, item, item_text)):
        if i:  # what the passes before left is written, so that a task runs one pass
            docs = settle(docs)
        shared = docs.sparkSession.sparkContext.broadcast(block)

        @trimmed
        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value)
            for batch in batches:
                for part in slices(batch, f"_f{at}"):
                    yield part.filter(pa.array([not matcher.hits(normal(t)) for t in part.column(at).to_pylist()], pa.bool_()))

        plain = docs.select(*(F.col(f"`{c}`").alias(f"_f{i}") for i, c in enumerate(names)))
        docs = plain.mapInArrow(clean, plain.schema).select(*(F.col(f"_f{i}").alias(c) for i, c in enumerate(names)))
    return docs


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op3_decontaminate": op3_decontaminate}
SQL: dict[str, str] = {}
