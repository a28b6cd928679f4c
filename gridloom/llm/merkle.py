"""Operator 11, a Merkle manifest of a dataset by rolling up nested structs.

Every row is a leaf: the SHA-256 of its fields, each written as its length in bytes, ``:`` and its value, or ``-`` if
null. The leaves of a tree (one for each language) ascend by key; two consecutive nodes become their hash until one is
left, the tree's root, and the roots of all trees, in their order, are the leaves of one tree above.

A leaf's rank in its tree is found by ranges of rows whose sizes are added up. The rank's lowest 8 binary digits are
columns; the higher ones name the block of at most 256 leaves. The rows are dealt by block once, and then one digit
after another is grouped away, each time nesting two children in a parent struct with their hash, so all eight
groupings of a block stay in its task. Blocks' hashes are the nodes of the next round, with as many rounds as the
largest tree has digits by eight. On the way back every block gets the path above it, ``transform`` goes down through
the nested structs with each child's path, and ``explode`` emits the leaves. No leaf is joined with anything: what a
block learns from above comes by a join of blocks with blocks, a 256th of the rows, since nesting the whole tree in
one struct instead would put all of it in one task.

Cases: a null key comes first, a null tree is the first tree; nulls of other fields are ``-``; empty and long texts are
hashed whole; rows with one key are ordered by their leaf, and rows alike in all fields are leaves of their own, next
to each other; a tree of one leaf has that leaf as its root; an empty table gives an empty result; other columns are not
read, whatever their names. A row without a key is never tampered with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import settle, table

#: Binary digits that one round groups away: a block has 2 ** BITS leaves at most.
BITS = 8


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _count(level: int) -> Column:
    """Nodes of the tree that are left after ``level`` groupings."""
    return F.expr(f"(n + {(1 << level) - 1}L) div {1 << level}L")


def ranked(leaves: DataFrame, *order: str) -> DataFrame:
    """``leaves`` with ``rank`` in the tree, from 0, and ``n``, the leaves of the tree."""
    dealt = leaves.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    dealt = settle(dealt.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    runs = dealt.groupBy("_part", "tree").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))  # a row for each partition and each tree in it
    tree = Window.partitionBy("tree")
    before = F.sum("_rows").over(tree.orderBy("_part")) - F.col("_rows")
    runs = runs.select("_part", "tree", "_first", before.alias("_before"), F.sum("_rows").over(tree).alias("n"))
    rows = dealt.join(runs, ["_part", "tree"])
    return rows.withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before")).drop("_part", "_at", "_first", "_before", "_rows")


def _blocks(nodes: DataFrame, base: int) -> DataFrame:
    """(tree, block, n, node): the nodes (tree, rank, n, leaf: a struct with ``h``) of a block, nested two by two; ``base`` groupings lie below them."""
    digits = [F.shiftright("rank", b).bitwiseAND(F.lit(1)).cast("tinyint").alias(f"d{b}") for b in range(BITS)]
    rows = nodes.select("tree", F.shiftright("rank", BITS).alias("block"), "n", *digits, F.col("leaf").alias("node")).repartition("tree", "block")
    for b in range(BITS):
        kids = F.sort_array(F.collect_list(F.struct(F.col(f"d{b}").alias("d"), "node")))
        rows = rows.groupBy("tree", "block", "n", *(f"d{i}" for i in range(b + 1, BITS))).agg(kids.alias("kids"))
        both = F.array_join(F.transform("kids", lambda k: k["node"]["h"]), "")
        up = F.when(_count(base + b) > 1, digest(both)).otherwise(F.element_at("kids", 1)["node"]["h"])
        rows = rows.withColumn("node", F.struct(up.alias("h"), "kids")).drop("kids")
    return rows


def _children(level: int):
    """A function from a node with the path above it, (node, steps), to its children with theirs; ``level`` groupings lie below these."""

    def children(p: Column) -> Column:
        kids = p["node"]["kids"]

        def step(k: Column) -> Column:
            left = F.when(k["d"] == 1, F.element_at(kids, 1)["node"]["h"]).otherwise("")
            right = F.when((k["d"] == 0) & (F.size(kids) == 2), F.element_at(kids, -1)["node"]["h"]).otherwise("")
            longer = F.concat(F.array(F.struct(left.alias("l"), right.alias("r"))), p["steps"])
            return F.struct(k["node"].alias("node"), F.when(_count(level) > 1, longer).otherwise(p["steps"]).alias("steps"))

        return F.transform(kids, step)

    return children


def _paths(base: int) -> Column:
    """All leaves of a block (node, n, steps: the path above it) as (node, steps)."""
    paths = F.array(F.struct("node", "steps"))
    for b in reversed(range(BITS)):
        paths = F.flatten(F.transform(paths, _children(base + b)))
    return paths


class Rollup:
    """The trees over ``leaves`` (tree, rank, n, leaf: a struct with ``h``), the largest of which has ``most`` leaves."""

    def __init__(self, leaves: DataFrame, most: int):
        self.rounds, nodes = [], leaves
        while True:
            self.rounds.append(settle(_blocks(nodes, BITS * len(self.rounds))))
            if most <= 1 << BITS * len(self.rounds):
                break
            nodes = self.rounds[-1].select("tree", F.col("block").alias("rank"), "n", F.struct("node.h", "block").alias("leaf"))

    def roots(self) -> DataFrame:
        """(tree, root)"""
        return self.rounds[-1].select("tree", F.col("node.h").alias("root"))

    def leaves(self, above: DataFrame) -> DataFrame:
        """(tree, node: the leaf's struct, steps: the siblings from leaf to top, and the columns of ``above``).

        ``above``: (tree, steps, any facts), a row for each tree: the siblings above its root. A step holds what is to
        the left and to the right of the node on the path; both are empty where it has no sibling.
        """
        facts = [c for c in above.columns if c not in ("tree", "steps")]
        at = above.withColumn("block", F.lit(0).cast("long"))
        for level in reversed(range(len(self.rounds))):
            held = self.rounds[level].join(at, ["tree", "block"])
            found = held.select("tree", *facts, F.explode(_paths(BITS * level)).alias("_at")).select("tree", *facts, "_at.node", "_at.steps")
            at = found.select("tree", *facts, "steps", F.col("node.block").alias("block")) if level else found
        return at


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(steps, leaf, lambda h, s: digest(s["l"], h, s["r"]))


def manifest(docs: DataFrame, key: str = "doc_id", tree: str = "lang", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), altered: dict[str, Column] | None = None) -> DataFrame:
    """(key, leaf, subroot, root, steps, proof_sha256, folded_root, verified) of every row.

    ``altered``: what a field of a row holds when its proof is checked; without it the row's own fields are checked.
    """
    own = digest(*(_field(F.col(c)) for c in fields))
    other = digest(*(_field(altered.get(c, F.col(c)) if altered else F.col(c)) for c in fields))
    name = F.coalesce(F.concat(F.lit("+"), F.col(tree).cast("string")), F.lit(""))  # in the order of the trees, null first
    hashed = settle(docs.select(name.alias("tree"), F.col(key).alias("key"), own.alias("h"), (other if altered else F.lit(None).cast("string")).alias("other")))
    hashed = hashed.withColumn("other", F.when(F.col("other") != F.col("h"), F.col("other")))
    leaves = settle(ranked(hashed, "key", "h").select("tree", "rank", "n", F.struct("h", "key", "other").alias("leaf")))
    trees = Rollup(leaves, leaves.agg(F.max("n")).first()[0] or 1)
    tops = settle(ranked(trees.roots().select(F.lit("").alias("tree"), F.col("tree").alias("name"), "root"), "name").select("tree", "rank", "n", F.struct(F.col("root").alias("h"), "name").alias("leaf")))
    crown = Rollup(tops, tops.agg(F.max("n")).first()[0] or 1)
    start = crown.roots().select("tree", "root", F.from_json(F.lit("[]"), "array<struct<l: string, r: string>>").alias("steps"))
    above = crown.leaves(start).select(F.col("node.name").alias("tree"), F.col("node.h").alias("subroot"), "root", "steps")
    out = trees.leaves(above).select("node.*", "subroot", "root", "steps")
    proof = F.sha2(F.array_join(F.transform("steps", lambda s: F.concat(s["l"], s["r"])), "").cast("binary"), 256)
    out = out.select(F.col("key").alias(key), F.col("h").alias("leaf"), "subroot", "root", "steps", proof.alias("proof_sha256"), folded(F.coalesce("other", "h"), F.col("steps")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = F.col("n_chars").cast("decimal(20,0)")
    found = manifest(table(spark, sf_dir, "documents"), altered={"n_chars": F.when(struck, (more + 1).cast("decimal(20,0)")).otherwise(more)})
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


#: Tables for CRC-32 in SQL: the 256 values come from the polynomial.
CRC_TABLE = """crc_table AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, range(0, 8)), lambda c, step: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM (SELECT unnest(range(0, 256)) AS i)))"""


def crc32_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, beside the table ``crc_table``."""
    digits = f"hex(encode({text}))"
    values = f"list_transform(range(0, length({digits}) // 2), lambda i: CAST(concat('0x', substr({digits}, 2 * i + 1, 2)) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {values}), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295)"


def _leaf_sql(n_chars: str) -> str:
    fields = (f"CAST({c} AS VARCHAR)" for c in ("doc_id", "source", "lang", n_chars, "text"))
    return "sha256(concat(" + ", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(CAST(octet_length(encode({c})) AS VARCHAR), ':', {c}) END" for c in fields) + "))"


def _tree_sql(name: str, leaves: str) -> str:
    """``name``: all nodes (tree, lvl, r, n, h) over ``leaves`` (tree, r, n, h)."""
    return f"""{name} AS (SELECT tree, 0 AS lvl, r, n, h FROM {leaves} UNION ALL
  SELECT tree, lvl + 1, r // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY r)) FROM {name} WHERE n > 1 GROUP BY tree, lvl, r // 2, n)"""


def _path_sql(name: str, start: str, nodes: str) -> str:
    """``name``: from ``start`` (id, tree, r, n, sibs, h) up through ``nodes``; complete where n = 1."""
    return f"""{name} AS (SELECT id, tree, 0 AS lvl, r, n, sibs, h FROM {start} UNION ALL
  SELECT p.id, p.tree, p.lvl + 1, p.r // 2, (p.n + 1) // 2, concat(p.sibs, coalesce(s.h, '')), sha256(CASE WHEN p.r % 2 = 1 THEN concat(s.h, p.h) ELSE concat(p.h, coalesce(s.h, '')) END)
  FROM {name} p LEFT JOIN {nodes} s ON s.tree = p.tree AND s.lvl = p.lvl AND s.r = xor(p.r, 1) WHERE p.n > 1)"""


SQL = {
    "op11_merkle": f"""
WITH RECURSIVE {CRC_TABLE},
hashed AS (SELECT doc_id, coalesce(concat('+', lang), '') AS tree, {_leaf_sql('n_chars')} AS h, CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN {_leaf_sql('(n_chars + 1)')} END AS other FROM documents, crc_table),
leaves AS (SELECT *, row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, h) AS id, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS r, count(*) OVER (PARTITION BY tree) AS n FROM hashed),
{_tree_sql('nodes', 'leaves')},
tops AS (SELECT '' AS tree, tree AS id, h, '' AS sibs, row_number() OVER (ORDER BY tree) - 1 AS r, count(*) OVER () AS n FROM nodes WHERE n = 1),
{_tree_sql('crown', 'tops')},
starts AS (SELECT id, tree, r, n, '' AS sibs, coalesce(other, h) AS h FROM leaves),
{_path_sql('paths', 'starts', 'nodes')},
highs AS (SELECT p.id, '' AS tree, t.r, t.n, p.sibs, p.h FROM paths p JOIN tops t ON t.id = p.tree WHERE p.n = 1),
{_path_sql('ways', 'highs', 'crown')}
SELECT l.doc_id, l.h AS leaf, t.h AS subroot, c.h AS root, sha256(w.sibs) AS proof_sha256, w.h AS folded_root, w.h = c.h AS verified
FROM ways w JOIN leaves l ON l.id = w.id JOIN tops t ON t.id = l.tree JOIN crown c ON c.n = 1 WHERE w.n = 1"""
}
QUERIES = {"op11_merkle": op11_merkle}
