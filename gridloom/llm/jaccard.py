"""Operator 9, n-gram Jaccard join by MinHash banding.

A text's n-grams are its runs of five words (``[^\\x20\\x09-\\x0D]+``); a text of one to four words has one n-gram,
all its words. Texts with the same n-gram set are copies and are joined once, as one class. Each class has a MinHash
signature of bands; classes that share a band's hash are candidates. The numbers of bands and rows follow from the
target recall at the similarity asked for.

Candidates are brought together by component: the band hashes' links (each to its bucket's smallest member, never
all pairs) are contracted to components, a component's texts go out in blocks of bounded size, and each pair of
blocks that share a band's hash is one task, which compares the signatures of its texts and verifies every candidate
pair on the full n-gram sets. So each text of a small component is sent once, no pair is ever a row, and a component of
any size is whole. Verified links are counted for each class and contracted to classes of linked documents.

Cases: a null or empty text, or one without a word, has no n-grams and is linked to nothing, not even to its like;
repeated rows and equal texts are copies; null ids are carried (a class whose smallest id is asked for ignores
them); texts of any length are compared whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import as_bytes, mix, partitions, settle, slices, span_hashes, spread_join, table, trim, trimmed, word_spans
from gridloom.operators.components import hubs_of, join_beside, joined

WORDS = 5
#: Similarity of 0.8 or more, as a fraction, so that no rounding decides.
ALIKE = (4, 5)
TARGET_RECALL = 0.9999
MAX_HASHES = 128
#: Texts and bytes of one block of a component.
BLOCK_TEXTS = 256
BLOCK_BYTES = 4 << 20
#: Bytes of the texts that one task verifies, on average.
BUNDLE_BYTES = 8 << 20


def banding(similarity: float, recall: float, most: int) -> tuple[int, int]:
    """(bands, rows): the most rows in a band with which ``most`` hashes find a pair of this similarity with probability ``recall``."""
    for rows in range(most, 0, -1):
        hit = similarity**rows
        bands = math.ceil(math.log(1 - recall) / math.log(1 - hit)) if hit < 1 else 1
        if bands * rows <= most:
            return bands, rows
    raise ValueError(f"{most} hashes can't reach recall {recall} at similarity {similarity}")


BANDS, ROWS = banding(ALIKE[0] / ALIKE[1], TARGET_RECALL, MAX_HASHES)
_rng = np.random.default_rng(9)
_FACTORS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def gram_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct n-gram hashes, sorted within each text, and where each text's begin (one end more)."""
    data, ends = as_bytes(texts)
    rows = len(ends) - 1
    starts, stops = word_spans(data, ends)
    owner = np.searchsorted(ends, starts, side="right") - 1
    words = span_hashes(data, starts, stops)
    counts = np.bincount(owner, minlength=rows)
    n = len(words)
    whole = np.zeros(max(0, n - WORDS + 1), np.uint64)
    for i in range(WORDS):
        whole = whole * np.uint64(0x100000001B3) + words[i : i + len(whole)]
    at = np.flatnonzero(owner[: len(whole)] == owner[WORDS - 1 :]) if len(whole) else np.zeros(0, np.int64)
    grams, of = [mix(whole[at])], [owner[at]]
    firsts = np.cumsum(counts) - counts
    for size in range(1, WORDS):  # texts too short for a run
        short = np.flatnonzero(counts == size)
        h = np.full(len(short), size, np.uint64)
        for i in range(size):
            h = h * np.uint64(0x100000001B3) + words[firsts[short] + i]
        grams.append(mix(h))
        of.append(short)
    grams, of = np.concatenate(grams), np.concatenate(of)
    order = np.lexsort((grams, of))
    grams, of = grams[order], of[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])
    grams, of = grams[fresh], of[fresh]
    return grams, np.searchsorted(of, np.arange(rows + 1))


def signatures(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Band hashes, one row for each text that has n-grams."""
    full = np.flatnonzero(np.diff(bounds))
    out = np.empty((len(full), BANDS), np.uint64)
    if len(full):
        starts = bounds[:-1][full]
        for b in range(BANDS):
            band = np.full(len(full), b + 1, np.uint64)
            for k in range(b * ROWS, b * ROWS + ROWS):
                band = mix(band + np.minimum.reduceat(grams * _FACTORS[k] + _SHIFTS[k], starts))
            out[:, b] = band
    return out


def set_keys(grams: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """16 bytes that stand for each text's n-gram set; None without n-grams."""
    full = np.flatnonzero(np.diff(bounds))
    out: list[bytes | None] = [None] * (len(bounds) - 1)
    if len(full):
        starts = bounds[:-1][full]
        one, two = np.add.reduceat(mix(grams + np.uint64(1)), starts), np.add.reduceat(mix(grams * np.uint64(3)), starts)
        for i, a, b in zip(full, mix(one), mix(two), strict=True):
            out[i] = int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big")
    return out


@trimmed
def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "_text"):
            grams, bounds = gram_sets(part.column(0))
            keys, bands = set_keys(grams, bounds), np.zeros((part.num_rows, BANDS), np.uint64)
            bands[np.diff(bounds) > 0] = signatures(grams, bounds)
            offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(keys, pa.binary()), pa.array(np.diff(bounds).astype(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(bands.ravel().view(np.int64)))], [*part.schema.names[1:], "gid", "n_grams", "bands"])


def _links(sets: list[np.ndarray], bands: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (one of ``left``, one of ``right``, the first smaller where both lists hold it) that are alike."""
    near = np.zeros((len(left), len(right)), bool)
    for b in range(bands.shape[1]):
        near |= bands[left, b][:, None] == bands[right, b][None, :]
    if left is right:
        near = np.triu(near, 1)
    a, b = np.nonzero(near)
    if not len(a):
        return a, b
    sizes = np.array([len(s) for s in sets])
    if len(a) <= 2 * (len(left) + len(right)):
        common = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left[a], right[b], strict=True)])
    else:
        codes = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int64)
        owner = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(codes, kind="stable")
        codes, owner = codes[order], owner[order]
        common, step = np.zeros((len(left), len(right)), np.float32), 4096
        for low in range(0, int(codes[-1]) + 1, step):
            s, e = np.searchsorted(codes, [low, low + step])
            held = np.zeros((len(sets), step), np.float32)
            held[owner[s:e], codes[s:e] - low] = 1
            common += held[left] @ held[right].T
        common = common[a, b].astype(np.int64)
    union = sizes[left[a]] + sizes[right[b]] - common
    alike = ALIKE[1] * common >= ALIKE[0] * union
    return left[a[alike]], right[b[alike]]


def _verify(group: pa.Table) -> pa.Table:
    """Of each pair of blocks in the group: links for each class, and a spanning forest of the links."""
    rows = group.select(["comp", "low", "high", "block", "gid"]).to_pylist()
    tasks: dict[tuple, dict[bytes, int]] = {}
    for i, r in enumerate(rows):
        tasks.setdefault((r["comp"], r["low"], r["high"]), {}).setdefault(r["gid"], i)
    texts = group["text"].combine_chunks()
    out_gid: list[bytes] = []
    out_links: list[int] = []
    out_other: list[bytes] = []
    for (_, low, high), members in tasks.items():
        index = list(members.values())
        grams, bounds = gram_sets(texts.take(pa.array(index)))
        sets = [grams[s:e] for s, e in zip(bounds, bounds[1:], strict=False)]
        bands = signatures(grams, bounds)
        if low == high:
            left = right = np.arange(len(index))
        else:
            block = np.array([rows[i]["block"] for i in index])
            left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        a, b = _links(sets, bands, left, right)
        links = np.bincount(np.concatenate([a, b]), minlength=len(index))
        root = np.arange(len(index))

        def find(x: int, root: np.ndarray = root) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
        gids = list(members)
        for i in np.flatnonzero(links).tolist():
            out_gid.append(gids[i])
            out_links.append(int(links[i]))
            out_other.append(gids[find(i)])
    trim()
    return pa.table({"gid": pa.array(out_gid, pa.binary()), "links": pa.array(out_links, pa.int64()), "other": pa.array(out_other, pa.binary())})


def _block_pairs(large: DataFrame) -> DataFrame:
    """The texts of each pair of blocks that share a band's hash: bundle, comp, low, high, block, gid, text.

    ``large``: gid, comp, blocks (how many the component needs), text, bands. Texts of the same first band share a
    cell, which is cut into blocks of bounded size; so most pairs that are alike lie in one block, and blocks of a
    component that have nothing in common never meet.
    """
    cell = F.struct("comp", F.pmod(F.col("bands")[0], F.col("blocks")).alias("cell"))
    large = settle(large.select("gid", "comp", "text", "bands", cell.alias("cell")))
    sizes = large.groupBy("cell").agg(F.ceil(F.greatest(F.count("*") / BLOCK_TEXTS, F.sum(F.octet_length("text")) / BLOCK_BYTES)).alias("parts"))
    block = F.col("cell.cell") * (1 << 30) + F.pmod(F.xxhash64("gid"), F.col("parts"))
    placed = settle(large.join(sizes, "cell").select("gid", "comp", "text", "bands", block.alias("block")))
    held = settle(placed.select("comp", "block", F.posexplode("bands").alias("band", "hash")).distinct())
    both = held.withColumnRenamed("block", "low").join(held.withColumnRenamed("block", "high"), ["comp", "band", "hash"]).where("low <= high").select("comp", "low", "high").distinct()
    asked = both.select("comp", "low", "high", F.explode(F.array_distinct(F.array("low", "high"))).alias("block"))
    return asked.join(placed, ["comp", "block"]).select(F.xxhash64("comp", "low", "high").alias("bundle"), "comp", "low", "high", "block", "gid", "text")


def join_similar(docs: DataFrame, key: str = "doc_id", text: str = "text", extra: dict[str, F.Column] | None = None) -> DataFrame:
    """One row for each row of ``docs``: key, gid (its n-gram set), class_gid (its class of linked sets), n_copies, n_links, n_grams.

    ``n_links`` counts the other n-gram sets that are alike, ``n_copies`` the rows with the same one. ``extra`` adds
    columns of ``docs``, by name. gid and class_gid are null for a row without n-grams.
    """
    spark = docs.sparkSession
    base = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_text"), F.col(key).alias("_key"), F.xxhash64(F.col(text)).alias("_hash"), *((c.alias(n)) for n, c in (extra or {}).items()))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[1:])
    signed = settle(base.mapInArrow(_signed, f"{kinds}, gid binary, n_grams long, bands array<long>"))
    sets = settle(signed.where("gid is not null").groupBy("gid").agg(F.count("*").alias("n_copies"), F.min(F.struct("_key", "_hash")).alias("first"), F.first("bands").alias("bands")))

    entries = sets.select("gid", F.posexplode("bands").alias("band", "hash"))
    buckets = entries.groupBy("band", "hash").agg(F.count("*").alias("n"), F.min("gid").alias("least")).where("n > 1").drop("n")
    near = entries.join(buckets, ["band", "hash"]).where("gid != least").select(F.col("gid").alias("src"), F.col("least").alias("dst")).distinct()
    candidates = joined(near, scattered=True).withColumnRenamed("node", "gid")

    firsts = candidates.join(sets.select("gid", "first"), "gid").select("gid", "component", F.col("first._key").alias("_key"), F.col("first._hash").alias("_hash"))
    held = docs.select(F.col(key).alias("_key"), F.xxhash64(F.col(text)).alias("_hash"), F.col(text).alias("text")).where("text is not null")
    texts = settle(held.join(firsts, held["_key"].eqNullSafe(firsts["_key"]) & (held["_hash"] == firsts["_hash"])).select("gid", F.col("component").alias("comp"), "text"))
    sizes = texts.groupBy("comp").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"))
    sizes = sizes.select("comp", F.ceil(F.greatest(F.col("n") / BLOCK_TEXTS, F.col("size") / BLOCK_BYTES)).cast("int").alias("blocks"))
    sized = texts.join(sizes, "comp")
    bundles = max(8 * partitions(spark), math.ceil((texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / BUNDLE_BYTES))
    whole = F.pmod(F.xxhash64("comp"), F.lit(bundles))
    small = sized.where("blocks = 1").select(whole.alias("bundle"), "comp", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"), F.lit(0).cast("long").alias("block"), "gid", "text")
    tasks = small.unionAll(_block_pairs(sized.where("blocks > 1").join(sets.select("gid", "bands"), "gid")))
    found = settle(tasks.groupBy("bundle").applyInArrow(_verify, "gid binary, links long, other binary"))

    links = found.groupBy("gid").agg(F.sum("links").alias("n_links"))
    classes = joined(found.select(F.col("gid").alias("src"), F.col("other").alias("dst")), scattered=True).withColumnRenamed("node", "gid")
    known = sets.select("gid", "n_copies").join(links, "gid", "left").join(classes, "gid", "left")
    known = known.select("gid", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "gid").alias("class_gid"))
    rows = signed.drop("bands")
    often = hubs_of(sets.select("gid", F.col("n_copies").alias("n")), "gid", rows.count())  # sets that many rows have
    out = join_beside(rows.where("gid is not null"), known, "gid", often, "left").unionByName(rows.where("gid is null"), allowMissingColumns=True)
    return out.withColumnRenamed("_key", key).drop("_hash")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id, n_links, n_copies, n_grams) of every row; class_id is the smallest key of the class."""
    found = settle(join_similar(docs, key, text))
    least = found.where("class_gid is not null").groupBy("class_gid").agg(F.min(key).alias("class_id"))
    named = spread_join(found, least, "class_gid", "left")
    return named.select(key, F.when(F.col("class_gid").isNull(), F.col(key)).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"), "n_grams")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, as they are, without all but one row of each class: the one with the smallest key.

    Rows without n-grams all stay. Of rows that are alike in every column one stays.
    """
    names = docs.columns
    row = F.xxhash64(*(F.col(f"`{c}`") for c in names))
    found = join_similar(docs, key, text, extra={"_row": row}).withColumn("_key", F.col(key))
    order = F.struct(F.col("_key").isNull().alias("last"), F.col("_key"), F.col("_row"))
    chosen = found.where("class_gid is not null").groupBy("class_gid").agg(F.min(order).alias("x")).select("x._key", "x._row")
    tagged = docs.select(F.struct(*(F.col(f"`{c}`").alias(f"f{i}") for i, c in enumerate(names))).alias("_doc"), F.col(key).alias("_id"), row.alias("_row"), F.regexp_like(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]")).alias("_worded"))
    unique = tagged.join(chosen.withColumnRenamed("_row", "_row2"), tagged["_id"].eqNullSafe(chosen["_key"]) & (F.col("_row") == F.col("_row2"))).where("_worded").dropDuplicates(["_id", "_row"])
    kept = unique.select("_doc").unionAll(tagged.where("not _worded").select("_doc"))
    return kept.select(*(F.col(f"_doc.f{i}").alias(c) for i, c in enumerate(names)))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


QUERIES = {"op9_ngram_jaccard": op9_ngram_jaccard}
SQL = {
    "op9_ngram_jaccard": r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT rid, gram FROM (SELECT rid, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS gram FROM d)),
s AS (SELECT rid, md5(string_agg(gram, chr(10) ORDER BY gram)) AS gid, count(*) AS n FROM g GROUP BY rid),
c AS (SELECT gid, count(*) AS n_copies, min(rid) AS rid, min(n) AS n FROM s GROUP BY gid),
h AS (SELECT c.gid, c.n, g.gram FROM c JOIN g USING (rid)),
p AS (SELECT a.gid AS x, b.gid AS y FROM h a JOIN h b ON a.gram = b.gram AND a.gid <> b.gid GROUP BY a.gid, b.gid, a.n, b.n HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*))),
r(x, y) AS (SELECT gid, gid FROM c UNION SELECT r.x, p.y FROM r JOIN p ON p.x = r.y),
k AS (SELECT x AS gid, min(y) AS class_gid FROM r GROUP BY x),
l AS (SELECT x AS gid, count(*) AS n_links FROM p GROUP BY x),
m AS (SELECT k.class_gid, min(d.doc_id) AS class_id FROM k JOIN s USING (gid) JOIN d USING (rid) GROUP BY k.class_gid)
SELECT d.doc_id, CASE WHEN s.gid IS NULL THEN d.doc_id ELSE m.class_id END AS class_id, coalesce(l.n_links, 0)::BIGINT AS n_links, coalesce(c.n_copies, 1)::BIGINT AS n_copies, coalesce(s.n, 0)::BIGINT AS n_grams
FROM d LEFT JOIN s USING (rid) LEFT JOIN c USING (gid) LEFT JOIN k USING (gid) LEFT JOIN m USING (class_gid) LEFT JOIN l USING (gid)"""
}
