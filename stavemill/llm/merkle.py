"""Merkle manifest of a dataset, with Octopus multiproofs.

Every row is a leaf. Rows of one language form a binary tree in the order of their ids; the roots of these
trees, in the order of the languages, form the tree whose root stands for the dataset.

* **Positions.** Leaves are sorted by range partitioning, so that a hot language is many partitions; a row's
  number within its partition plus the counts of earlier partitions is its position. No window over a language.
* **Trees.** Leaves are grouped by ``2^HEIGHT`` consecutive positions. A group is a whole subtree: its task
  hashes all its levels and emits the nodes. The next round does the same with the groups' roots: two rounds
  up to 16 million leaves of a tree, three up to 68 billion.
* **Multiproofs.** A group of requested leaves first names the coordinates (level, position) that its leaves
  need and cannot derive from each other: the Octopus rule, level by level, drops a sibling that is itself
  requested or above requested leaves, and one that two leaves share is named once. These coordinates are
  joined with the node table: below level ``2 * HEIGHT`` a node is asked for by at most ``2^HEIGHT`` groups;
  above it there are few nodes and they are broadcast if a count shows it. The task that holds the leaves then
  derives the interiors they share and expands each leaf's own proof.

Defined cases: null ids come first, equal ids are ordered by their leaves; repeated rows are leaves each; a
null language is a tree of its own, before all others, and different from an empty one; a table of one row has
its leaf as root and an empty proof; an empty table gives an empty result; very long texts are hashed where
they are read and not shuffled; columns that are not hashed are ignored.
"""

from __future__ import annotations

from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import register, small, staged, table

#: Levels that one task hashes: groups of 4,096 nodes.
HEIGHT = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODES = "tree string, n long, level int, pos long, hash string, top boolean"
TOP = "all"  # name of the tree over the trees; other names are empty or start with "="


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def height_of(n: int) -> int:
    return (n - 1).bit_length()


def encoded(value: Column) -> Column:
    """A value with its length in bytes; null is a dash."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


# -- positions and trees -------------------------------------------------------------------------

def positioned(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``pos``, their number within their ``tree`` by ``order``, and ``n``, the tree's size."""
    placed = staged(rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
                    .withColumn("at", F.monotonically_increasing_id()), "ordered")
    placed = placed.withColumn("part", F.shiftright("at", 33))  # the upper bits of ``at`` are the partition
    tree = Window.partitionBy("tree")
    before = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = placed.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows")).select(
        "tree", "part", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("rows").over(tree).alias("n"))  # one row for each partition of a tree
    return (placed.join(small(staged(runs, "runs")), ["tree", "part"])
            .withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift"))


def _subtree(base: int, step: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        tree, n, first = group["tree"].iloc[0], int(group["n"].iloc[0]), int(group["pos"].iloc[0])
        height, out, hashes = height_of(n), [], list(group["hash"])
        for level in range(base + 1, min(base + step, height) + 1):
            hashes = [digest(*hashes[i:i + 2]) for i in range(0, len(hashes), 2)]
            first >>= 1
            out += [(tree, n, level, first + i, h, level == height) for i, h in enumerate(hashes)]
        return pd.DataFrame(out, columns=["tree", "n", "level", "pos", "hash", "top"])
    return run


class Trees(NamedTuple):
    """Leaves ``(tree, n, pos, hash, ...)``, inner nodes by rounds, ``roots(tree, hash)``, the greatest height,
    the levels of a round."""
    leaves: DataFrame
    rounds: list[DataFrame]
    roots: DataFrame
    height: int
    step: int


def grown(leaves: DataFrame, step: int = HEIGHT) -> Trees:
    """Hashes the trees over positioned ``leaves``."""
    height = height_of(leaves.agg(F.max("n")).first()[0] or 1)
    current, rounds = leaves.select("tree", "n", "pos", "hash"), []
    for base in range(0, height, step):
        group = F.shiftright("pos", step).alias("group")
        nodes = staged(current.groupBy("tree", group).applyInPandas(_subtree(base, step), NODES), "nodes")
        rounds.append(nodes)
        current = nodes.where((F.col("level") == base + step) & ~F.col("top")).select("tree", "n", "pos", "hash")
    roots = leaves.where("n = 1").select("tree", "hash")
    for nodes in rounds:
        roots = roots.unionByName(nodes.where("top").select("tree", "hash"))
    return Trees(leaves, rounds, roots, height, step)


class Manifest(NamedTuple):
    """Trees of the leaves, the tree over their roots, and the root of all (none for no rows)."""
    trees: Trees
    top: Trees
    root: str | None


def manifest(leaves: DataFrame, *order: str, step: int = HEIGHT) -> Manifest:
    """Over ``leaves(tree, hash, ...)``; trees are ordered by name, leaves of a tree by ``order``."""
    trees = grown(positioned(leaves, *order), step)
    roots = trees.roots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("name"), "hash")
    top = grown(positioned(staged(roots, "subroots"), "name"), step)
    root = top.roots.select("hash").first()
    return Manifest(trees, top, root and root["hash"])


# -- multiproofs ---------------------------------------------------------------------------------

def missing(positions: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Octopus: the fewest nodes (level, position) of a tree of ``n`` leaves that give its root together
    with the leaves at ``positions``."""
    out, here, width = [], np.unique(positions), n
    for level in range(height_of(n)):
        need = np.setdiff1d(here ^ 1, here)
        out += [(level, int(p)) for p in need[need < width]]
        here, width = np.unique(here >> 1), (width + 1) >> 1
    return out


def _named(group: pd.DataFrame) -> pd.DataFrame:
    need = missing(group["pos"].to_numpy(), int(group["n"].iloc[0]))
    out = pd.DataFrame(need, columns=["level", "pos"])
    return out.assign(tree=group["tree"].iloc[0], group=group["group"].iloc[0])


def fetched(trees: Trees, wanted: DataFrame) -> DataFrame:
    """``(tree, group, level, pos, hash)``: the nodes that each group of ``wanted(tree, n, pos, group)`` lacks."""
    need = staged(wanted.select("tree", "n", "pos", "group").groupBy("tree", "group").applyInPandas(
        _named, "tree string, group long, level int, pos long"), "coordinates")
    rows = "tree", "level", "pos", "hash"
    nodes = trees.leaves.withColumn("level", F.lit(0)).select(*rows)
    for inner in trees.rounds:
        nodes = nodes.unionByName(inner.select(*rows))
    out = None
    for low, high in ((0, trees.step), (trees.step, 2 * trees.step), (2 * trees.step, 64)):
        within = F.col("level").between(low, high - 1)
        asked = need.where(within)
        if low > trees.height or asked.isEmpty():
            continue
        there = nodes.where(within)
        found = asked.join(there if low == 0 else small(there), ["tree", "level", "pos"])
        out = found if out is None else out.unionByName(found)
    return need.withColumn("hash", F.lit("")) if out is None else out


def tops(m: Manifest) -> DataFrame:
    """``(tree, subroot, top_pos, above)``: for each tree the path from its root to the root of all, as
    siblings (level, hash)."""
    names = m.top.leaves.select(F.col("name").alias("tree"), "pos", "hash")
    path = F.transform(F.sequence(F.lit(0), F.lit(max(m.top.height - 1, 0))), lambda k: F.struct(
        k.alias("level"), F.call_function("shiftright", F.col("pos"), k).bitwiseXOR(F.lit(1)).alias("at")))
    nodes = m.top.leaves.select(F.lit(0).alias("level"), F.col("pos").alias("at"), F.col("hash").alias("sibling"))
    for inner in m.top.rounds:
        nodes = nodes.unionByName(inner.select("level", F.col("pos").alias("at"), F.col("hash").alias("sibling")))
    steps = names.select("tree", F.inline(path)).join(small(nodes), ["level", "at"])
    above = steps.groupBy("tree").agg(F.sort_array(F.collect_list(F.struct("level", "sibling"))).alias("above"))
    return staged(names.join(above, "tree", "left").select(
        "tree", F.col("hash").alias("subroot"), F.col("pos").alias("top_pos"), "above"), "tops")


def _fold(value: str, pos: int, levels: range, siblings: dict[int, str]) -> str:
    for level in levels:
        other = siblings.get(level, "")
        value = digest(other, value) if (pos >> level) & 1 and other else digest(value, other)
    return value


PROOFS = "subroot string, proof_sha256 string, folded_root string, proof array<string>"


def _expanded(kept: list[str], step: int, top_height: int, proofs: bool):
    def run(leaves: pd.DataFrame, nodes: pd.DataFrame, head: pd.DataFrame) -> pd.DataFrame:
        n = int(leaves["n"].iloc[0])
        height, cut = height_of(n), min(step, height_of(n))
        known: list[dict[int, str]] = [{} for _ in range(height + 1)]
        for level, pos, value in zip(nodes["level"], nodes["pos"], nodes["hash"]):
            known[level][pos] = value
        positions = leaves["pos"].to_numpy()
        known[0].update(zip(positions, leaves["hash"]))
        width = n
        for level in range(height):  # shared interiors, each once
            here, above = known[level], known[level + 1]
            for p in {p >> 1 for p in here}:
                left, right = here.get(2 * p), here.get(2 * p + 1, "")
                if p not in above and left and (right or 2 * p + 1 >= width):
                    above[p] = digest(left, right)
            width = (width + 1) >> 1
        top_pos = int(head["top_pos"].iloc[0])
        tops = {x["level"]: x["sibling"] for x in head["above"].iloc[0]} if head["above"].iloc[0] is not None else {}
        first = int(positions[0])
        upper = {k: known[k][(first >> k) ^ 1] for k in range(cut, height) if (first >> k) ^ 1 in known[k]}
        tail = [*upper.values(), *[tops[k] for k in sorted(tops)]]
        root_of_all = lambda value: _fold(value, top_pos, range(top_height), tops)
        shared, out = root_of_all(known[height][0]), []
        for pos, claimed in zip(positions, leaves["claimed"]):
            own = {k: known[k][(pos >> k) ^ 1] for k in range(cut) if (pos >> k) ^ 1 in known[k]}
            proof = [*own.values(), *tail]
            folded = shared if claimed is None else root_of_all(_fold(
                claimed, int(pos), range(height), own | upper))
            out.append((known[height][0], digest(*proof), folded, proof if proofs else None))
        found = pd.DataFrame(out, columns=["subroot", "proof_sha256", "folded_root", "proof"], index=leaves.index)
        return pd.concat([leaves[kept], found], axis=1)
    return run


def proven(m: Manifest, wanted: DataFrame, proofs: bool = False) -> DataFrame:
    """``wanted``, rows of the manifest's leaves with a column ``claimed``, with ``subroot``, ``proof_sha256``
    (hash of the siblings on the way to the root of all), ``folded_root`` (what ``claimed``, or the leaf itself
    where that is null, gives with these siblings) and on demand the siblings as ``proof``."""
    wanted = wanted.withColumn("group", F.shiftright("pos", m.trees.step))
    nodes = fetched(m.trees, wanted).groupBy("tree", "group").agg(
        F.collect_list(F.struct("level", "pos", "hash")).alias("nodes"))
    heads = wanted.select("tree", "group").distinct().join(nodes, ["tree", "group"], "left").join(
        small(tops(m)), "tree").withColumnsRenamed({"tree": "of", "group": "part"})
    kept = [c for c in wanted.columns if c not in ("n", "pos", "group", "claimed", "tree")]
    expand, types = _expanded(kept, m.trees.step, m.top.height, proofs), dict(wanted.dtypes)

    def run(leaves: pd.DataFrame, head: pd.DataFrame) -> pd.DataFrame:
        rows = head["nodes"].iloc[0]
        nodes = pd.DataFrame([(x["level"], x["pos"], x["hash"]) for x in rows] if rows is not None else [],
                             columns=["level", "pos", "hash"])
        return expand(leaves, nodes, head)

    schema = ", ".join([f"`{c}` {types[c]}" for c in kept] + [PROOFS])
    return wanted.groupBy("tree", "group").cogroup(heads.groupBy("of", "part")).applyInPandas(run, schema)


# -- the query -----------------------------------------------------------------------------------

def tree_name(lang: Column) -> Column:
    """Names sort like languages, null first."""
    return F.coalesce(F.concat(F.lit("="), lang), F.lit(""))


def document_leaves(docs: DataFrame) -> DataFrame:
    """Leaves of documents; ``claimed`` is the leaf of a tampered row, null where nothing was changed."""
    columns = {c: F.col(c) for c in FIELDS}
    changed = columns | {"n_chars": F.col("n_chars") + 1}
    tampered = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    return staged(docs.select(
        tree_name(F.col("lang")).alias("tree"), "doc_id", leaf_of(*columns.values()).alias("hash"),
        F.when(tampered, leaf_of(*changed.values())).alias("claimed"),
        F.monotonically_increasing_id().alias("uid")), "leaves")


_CRC = """list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
  lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)"""


def _leaf_sql(n_chars: str) -> str:
    parts = " || ".join(
        f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"
        for c in (n_chars if f == "n_chars" else f for f in FIELDS))
    return f"sha256({parts})"


def _tree_sql(name: str, leaves: str) -> str:
    """Nodes ``(tree, level, pos, n, hash)`` over ``leaves(tree, pos, n, hash)``; ``n`` counts a level."""
    return f"""{name} AS (
  SELECT tree, 0 AS level, pos, n, hash FROM {leaves}
  UNION ALL
  SELECT tree, level + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(hash, '' ORDER BY pos))
  FROM {name} WHERE n > 1 GROUP BY tree, level, pos // 2)"""


OP11_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT *, coalesce('=' || lang, '') AS tree, {_leaf_sql("n_chars")} AS leaf,
         CASE WHEN xor({_CRC}, 4294967295) % 7 = 0 THEN {_leaf_sql("(n_chars + 1)")} END AS changed
  FROM documents),
leaves AS (
  SELECT *, leaf AS hash, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY tree) AS n FROM docs),
{_tree_sql("nodes", "leaves")},
subroots AS (
  SELECT 'all' AS tree, tree AS name, hash, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n
  FROM nodes WHERE n = 1),
{_tree_sql("tops", "subroots")},
path AS (
  SELECT doc_id, l.tree, l.pos AS leaf_pos, l.leaf, l.changed, s.hash AS subroot, x.level, x.node_pos, o.hash
  FROM leaves l JOIN subroots s ON s.name = l.tree,
  LATERAL (SELECT k.level, l.pos >> k.level AS node_pos
           FROM (SELECT DISTINCT level FROM nodes WHERE tree = l.tree AND n > 1) k) x
  LEFT JOIN nodes o ON o.tree = l.tree AND o.level = x.level AND o.pos = xor(x.node_pos, 1)
  UNION ALL
  SELECT doc_id, l.tree, l.pos, l.leaf, l.changed, s.hash, 1000 + x.level, x.node_pos, o.hash
  FROM leaves l JOIN subroots s ON s.name = l.tree,
  LATERAL (SELECT k.level, s.pos >> k.level AS node_pos
           FROM (SELECT DISTINCT level FROM tops WHERE n > 1) k) x
  LEFT JOIN tops o ON o.level = x.level AND o.pos = xor(x.node_pos, 1)),
proofs AS (
  SELECT tree, leaf_pos, sha256(coalesce(string_agg(hash, '' ORDER BY level), '')) AS proof_sha256,
         list_reduce(list_prepend({{'side': 0, 'h': coalesce(any_value(changed), any_value(leaf))}},
           list({{'side': node_pos % 2, 'h': coalesce(hash, '')}} ORDER BY level)),
           lambda a, b: {{'side': 0, 'h': CASE WHEN b.side = 1 THEN sha256(b.h || a.h)
                                             ELSE sha256(a.h || b.h) END}}).h AS folded_root
  FROM path GROUP BY tree, leaf_pos)
SELECT doc_id, leaf, s.hash AS subroot, r.hash AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256,
       coalesce(folded_root, changed, leaf) AS folded_root,
       coalesce(folded_root, changed, leaf) = r.hash AS verified
FROM leaves l JOIN subroots s ON s.name = l.tree CROSS JOIN (SELECT hash FROM tops WHERE n = 1) r
LEFT JOIN proofs p ON p.tree = l.tree AND p.leaf_pos = l.pos
"""


@register("op11_merkle_manifest", OP11_SQL)
def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    m = manifest(document_leaves(table(spark, sf_dir, "documents")), "doc_id", "hash", "uid")
    root = F.lit(m.root)
    return proven(m, m.trees.leaves).select(
        "doc_id", F.col("hash").alias("leaf"), "subroot", root.alias("root"), "proof_sha256", "folded_root",
        (F.col("folded_root") == root).alias("verified"))
