"""Operators 11 to 13 against brute force on small fixtures, and on the cases their docstrings define."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import merkle, vantage, variants

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Further columns whose names the operators use themselves.
CLASH = "tree string, rank int, n int, leaf string, block long, word string, form string, key string, h string, other string"
ODD = [
    (None, "no id", None, None, None), (None, "no id", None, None, None), (900, None, None, None, None), (901, "", "en", "s", 0), (902, "é́ 𝒳\n", "", None, 3), (903, "same", "en", "s", 4), (903, "same", "en", "s", 4),
    (903, "other", "en", "s", 5), (904, "only one", "zz", "", (1 << 63) - 1), (905, "word " * 20000, "ü", "s", 100000), (7, "a", "Z", None, None),
]


def wide(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, *["x"], 3, *["x"] * 5) for r in rows], f"{DOCS}, {CLASH}")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree_of(hashes):
    """The root, and of each leaf the steps: the sibling and whether it stands left, or None."""
    paths, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for i, o in enumerate(at):
            paths[i].append((hashes[o ^ 1], o % 2 == 1) if o ^ 1 < len(hashes) else None)
            at[i] = o // 2
        hashes = [sha("".join(hashes[j : j + 2])) for j in range(0, len(hashes), 2)]
    return hashes[0], paths


def manifest_of(rows, struck):
    trees = defaultdict(list)
    for i, text, lang, source, n in rows:
        own = sha("".join(map(field, (i, source, lang, n, text))))
        changed = sha("".join(map(field, (i, source, lang, n + 1, text)))) if n is not None and struck(i) else own
        trees[lang].append((i is not None, i or 0, own, changed))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    held = {x: (sorted(trees[x]), *tree_of([r[2] for r in sorted(trees[x])])) for x in names}
    root, high = tree_of([held[x][1] for x in names])
    out = []
    for name, above in zip(names, high, strict=True):
        for (known, i, own, at), path in zip(held[name][0], held[name][2], strict=True):
            for step in path + above:
                at = sha(at) if step is None else sha(step[0] + at if step[1] else at + step[0])
            out.append((i if known else None, own, held[name][1], root, sha("".join(s[0] for s in path + above if s)), at, at == root))
    return out


def test_manifest(spark):
    rng = random.Random(3)
    rows = [(i, f"text {rng.random()}", rng.choice([None, "en", "en", "en", "de", "ﬁ", "𝒳"]), rng.choice([None, "s"]), rng.choice([None, 5, 9])) for i in range(700)] + ODD
    struck = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 0
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = F.col("n_chars").cast("decimal(20,0)")
    got = merkle.manifest(wide(spark, rows).repartition(5), altered={"n_chars": F.when(crc, (more + 1).cast("decimal(20,0)")).otherwise(more)})
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=key) == sorted(manifest_of(rows, struck), key=key)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 17, 30])
def test_manifest_rounds(spark, monkeypatch, n):
    """Trees of several rounds, with blocks of four leaves."""
    monkeypatch.setattr(merkle, "BITS", 2)
    rows = [(i, f"t{i}", "en" if i % 3 else None, "s", i) for i in range(n)]
    got = merkle.manifest(spark.createDataFrame(rows, DOCS)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, got)) == sorted(manifest_of(rows, lambda i: False))


def test_manifest_of_nothing(spark):
    assert merkle.manifest(wide(spark, [])).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_op11(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = sorted(map(tuple, merkle.op11_merkle(spark, SF).collect()))
    assert got == sorted(manifest_of(rows, lambda i: zlib.crc32(str(i).encode()) % 7 == 0))


def counts_of(rows, dropped):
    words = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if dropped and h % dropped == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    same = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[same + 1 :] == b[same + 1 :] if len(a) == len(b) else a[same:] == b[same + 1 :]


def groups_of(words):
    near = defaultdict(list)
    by = defaultdict(list)
    for w in words:
        by[len(w)].append(w)
    for w in words:
        near[w] = [v for size in (len(w) - 1, len(w), len(w) + 1) for v in by[size] if one_edit(w, v)]
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def speech(rng, n):
    """Words of which some are frequent, and slips in them, and slips in these."""
    letters = "abcdeéßÀ÷z"
    base = ["".join(rng.choice(letters) for _ in range(rng.choice([7, 8, 9, 12, 70]))) for _ in range(25)]
    words = []
    for _ in range(n):
        w = rng.choice(base[: rng.choice([1, 2, 25])])
        for _ in range(rng.choice([0] * 30 + [1, 1, 2])):
            p = rng.randrange(len(w))
            w = rng.choice([w[:p] + w[p + 1 :], w[:p] + rng.choice("ab") + w[p:], w[:p] + rng.choice("ab") + w[p + 1 :]])
        words.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
    return words


@pytest.mark.parametrize("few", [None, 16])
def test_variants(spark, monkeypatch, few):
    """With few words a pass there are several passes and lengths in several parts."""
    if few:
        monkeypatch.setattr(variants, "PASS_WORDS", few)
        monkeypatch.setattr(variants, "BLOCKS", max(1, few // 16))
    rng = random.Random(11)
    words = speech(rng, 6000)
    rows = [(i, " ".join(words[i * 10 : i * 10 + 10]) + rng.choice([".", "_x", "9", "ñandu,"])) for i in range(600)]
    rows += [(None, "alphabet alphabet"), (None, "alphabet"), (5, None), (6, ""), (7, "a" * 5000 + " " + "a" * 5001 + " " + "a" * 5001), (7, "a" * 5000), (8, "aaaaaaab aaaaaaab aaaaaaa aaaaaaa baaaaaaa baaaaaaa")]
    docs = wide(spark, [(i, t, "en", "s", 1) for i, t in rows]).repartition(4)
    for dropped in (0, 31):
        got = variants.group(variants.vocabulary(docs, dropped=dropped)).select("word", "form", "root", "n", "n_near", "form_n").collect()
        assert {tuple(r) for r in got} == groups_of(counts_of(rows, dropped)) and len({r[0] for r in got}) == len(got)


def test_variants_chain(spark):
    """A root is found over several forms."""
    chain = {"abcdefg" + "h" * i: 2 * 10**i for i in range(6)}
    words = spark.createDataFrame(list(chain.items()), "word string, n long")
    got = {r["word"]: r["root"] for r in variants.group(words).collect()}
    assert set(got.values()) == {"abcdefghhhhh"} and len(got) == 6
    assert variants.group(words.limit(0)).count() == 0


def test_filters_let_no_word_fall(spark):
    words = [f"wordnumber{i:06d}" for i in range(5000)] + [f"{'long' * 30}{i}" for i in range(50)]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    import pyarrow as pa

    (held,) = variants.passes({16: 5000, 64: 50})
    bits = variants.filters(df, held).value
    hashes, sizes = variants.word_hashes(pa.array(words))
    here, block = held.blocks(hashes, sizes)
    lanes = variants._lanes(hashes)
    assert len(here) == len(words) and all(bits[b * 8 + k] >> lanes[i, k] & np.uint64(1) for i, b in zip(here, block, strict=True) for k in range(8))
    others = pa.array([f"otherword{i:07d}" for i in range(5000)])
    hashes, sizes = variants.word_hashes(others)
    here, block = held.blocks(hashes, sizes)
    lanes = variants._lanes(hashes)
    wrong = sum(all(bits[b * 8 + k] >> lanes[i, k] & np.uint64(1) for k in range(8)) for i, b in zip(here, block, strict=True))
    assert wrong <= 5


def neighbours_of(vectors, asked, k):
    out = {}
    for i, q in asked:
        found = {}
        for j, v in vectors:
            if j != i:
                found[j, tuple(v)] = sum(a * b for a, b in zip(q, v, strict=False))
        out[i] = sorted(((-s, j) for (j, _), s in found.items()))[:k]
    return out


@pytest.fixture
def small_shards(monkeypatch):
    for name, n in (("SHARD_ROWS", 64), ("MOST_ROWS", 96), ("LEAF", 8), ("BLOCK_QUERIES", 16)):
        monkeypatch.setattr(vantage, name, n)


def clustered(rng, n, width=6, centres=9):
    middle = rng.normal(size=(centres, width)) * 4
    return [(i, [float(x) for x in middle[rng.integers(centres)] + rng.normal(size=width) * 0.3]) for i in range(n)]


def test_neighbours_exact(spark, small_shards):
    """A factor of one is exact: ties, copies, a vector of a third of all rows, short, odd and unusable vectors."""
    rng = np.random.default_rng(5)
    rows = clustered(rng, 260) + [(1000 + i, [1.0, 2.0, 3.0, 0.0, 0.0, 1.0]) for i in range(130)] + [(2000 + i, [float(x) for x in rng.integers(-2, 3, 6)]) for i in range(100)]
    good = [r for r in rows if any(r[1])] + [(3000, [2.0, 1.0]), (3020, [300.0, 1.0, -1.0, 0.0, 0.0, 0.0])]
    bad = [(4000, None), (4020, [0.0] * 6), (4040, [1.0, None]), (4060, [float("nan")] * 6), (4080, [float("inf"), 1.0]), (4100, []), (None, [1.0] * 6), (1000, [1.0, 2.0, 3.0, 0.0, 0.0, 1.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in good + bad], "vec_id long, embedding array<double>, shard int, least string").repartition(5)
    asked = df.where("vec_id % 20 = 0")
    got = defaultdict(list)
    for r in vantage.nearest(df, asked, 20, factor=1.0).collect():
        got[r["query_id"]].append((r["rank"], r["score"], r["vec_id"]))
    want = neighbours_of(good, [r for r in good if r[0] % 20 == 0], 20)
    assert set(got) == set(want)
    for i, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert [j for _, _, j in found] == [j for _, j in want[i]]
        assert np.allclose([s for _, s, _ in found], [-s for s, _ in want[i]], rtol=1e-12, atol=1e-12)


def test_neighbours_recall(spark, small_shards):
    rng = np.random.default_rng(6)
    for rows in (clustered(rng, 900), [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(900, 24)))]):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        found = {(r["query_id"], r["vec_id"]) for r in vantage.nearest(df, df.where("vec_id % 20 = 0"), 20).collect()}
        want = {(i, j) for i, near in neighbours_of(rows, rows[::20], 20).items() for _, j in near}
        assert len(found & want) >= 0.9 * len(want)


def test_neighbours_rule_out_shards():
    """Where vectors lie in groups, a query's bounds rule out most leaves, and rightly so."""
    rng = np.random.default_rng(7)
    rows = np.array([v for _, v in clustered(rng, 4000, centres=20)])
    longest = np.sqrt((rows * rows).sum(axis=1).max())
    tree = vantage.grow(vantage._lifted(rows, longest), 64)
    unit, norms = vantage._asking(rows[:50])
    angles = np.arccos(np.clip(unit @ vantage._lifted(rows, longest).T, -1, 1))
    bounds = tree.bounds(unit)
    for at, leaf in enumerate(tree.leaves):
        assert (bounds[:, at] <= angles[:, leaf].min(axis=1)).all()
    kth = np.sort(angles, axis=1)[:, 20]
    assert (bounds <= kth[:, None]).mean() < 0.5


def test_few_neighbours(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, vantage.nearest(df, df.where("vec_id % 20 = 0"), 20).collect()))
    assert got == [(0, 1, 3, 1.0), (0, 2, 20, 0.0), (20, 1, 3, 1.0), (20, 2, 0, 0.0)]
    assert vantage.nearest(df.limit(0), df, 20).count() == 0
    one = df.where("vec_id = 0")
    assert vantage.nearest(one, one, 20).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_op13_recall(spark):
    sf = SF.replace("0.001", "0.1")
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    ids, matrix = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    got = defaultdict(set)
    for r in vantage.op13_vantage(spark, sf).collect():
        got[r["query_id"]].add(r["vec_id"])
        assert abs(r["score"] - matrix[np.flatnonzero(ids == r["query_id"])[0]] @ matrix[np.flatnonzero(ids == r["vec_id"])[0]]) < 1e-12
    hits = 0
    for at in np.flatnonzero(ids % 20 == 0):
        score = matrix @ matrix[at]
        score[at] = -np.inf
        hits += len(got[ids[at]] & set(ids[np.lexsort((ids, -score))[:20]]))
    assert len(got) == (ids % 20 == 0).sum() and hits >= 0.95 * 20 * len(got)
