"""Merkle manifest of a dataset: nodes as parent-linked rows, proofs by a recursive query that climbs from each leaf.

A row's leaf is the hash of its fields.  In each group (a language) the leaves lie in the order of their key; every
``FANOUT`` consecutive nodes become one until one is left, the group's subroot, and the subroots in the order of the
groups likewise become the root.  A node's hash is the SHA-256 of its children's hex digests, one after another.

The levels are built from the leaves up, one grouping each, and stored as rows that name their parent.  A recursive
query then takes every leaf from parent to parent: each step appends the hashes of the siblings passed and folds a
digest (the one that is offered for the leaf) with them.  A leaf verifies where the folded digest is the root.  The leaves of
one parent share their way, so a row of the climb carries a run of at most ``FANOUT`` leaves and one list of siblings.

No key of the climb is hot: a node above more than ``BLOCK`` leaves is stored once for each block of so many
leaves below it, and a climber looks for the copy of its own block.  Leaves are numbered by range partition, not by a
window over a group.  The tables are stored, so what is built stays when executors are lost.

Nulls: a null field is hashed as ``-``; a null group is a group of its own, the first; null keys come
first within a group.  Ties of the key are ordered by leaf, and rows equal throughout are interchangeable.  A
group of one row has the leaf as its subroot, and a single group's subroot is the root.  An empty table has no rows and no
root.  Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from evidary.llm.common import durable, stored
from evidary.operators.common import numbered

FANOUT = 8
#: Leaves that climb by one copy of the nodes above them.
BLOCK = FANOUT**4
#: Heights of the nodes above the subroots start here.
UPPER = 100
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def leaf(values: list[Column]) -> Column:
    """The digest of a row: each value as its UTF-8 length, a colon and itself, or ``-`` where it is null."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z in lower case and all else as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def numbered_leaves(rows: DataFrame, key: str, group: str) -> tuple[DataFrame, DataFrame]:
    """(leaves, groups) of ``rows`` (``key``, ``group``, leaf, offered).

    ``leaves`` adds no (unique), tree (the group's number in order), at (0-based place in the group) and n (the group's
    rows); ``groups`` has (tree, n).
    """
    hashed = durable(rows.withColumn("_salt", F.monotonically_increasing_id()))
    order = [F.col(group).asc_nulls_first(), F.col(key).asc_nulls_first(), "leaf", "_salt"]
    lined = durable(hashed.orderBy(*order).drop("_salt")).withColumn("no", F.monotonically_increasing_id())
    placed = lined.withColumn("_part", F.shiftright("no", 33)).withColumn("_place", F.col("no").bitwiseAND(F.lit((1 << 33) - 1)))
    # A row for each partition and each group in it; a partition's rows of a group are consecutive.
    runs = durable(placed.groupBy("_part", group).agg(F.count("*").alias("_n"), F.min("_place").alias("_first")))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    groups = runs.groupBy(group).agg(F.sum("_n").alias("n"))
    groups = durable(numbered(groups, [F.col(group).asc_nulls_first()], "tree").withColumnRenamed(group, "_group"))
    starts = starts.join(groups, F.col(group).eqNullSafe(F.col("_group"))).select("_part", "_group", "_first", "_start", "tree", "n")
    same = (placed["_part"] == starts["_part"]) & placed[group].eqNullSafe(starts["_group"])
    at = (F.col("_start") + F.col("_place") - F.col("_first")).alias("at")
    leaves = placed.join(starts, same).select(*rows.columns, "no", "tree", at, "n")
    return stored(leaves, "manifest-leaves"), groups.select("tree", "n")


def levels(nodes: DataFrame, most: int, name: str) -> list[DataFrame]:
    """The levels above ``nodes`` (tree, at, n, hash), each stored: (tree, at, n, size, children, hash).

    ``n`` is the number of nodes a tree has at the bottom, ``size`` that of its level; ``most`` is the largest ``n``.
    """
    made, below = [], nodes.withColumn("size", F.col("n"))
    while most > 1:
        most = -(-most // FANOUT)
        run = F.sort_array(F.collect_list(F.struct("at", "hash")))
        grouped = below.where("size > 1").groupBy("tree", F.floor(F.col("at") / FANOUT).cast("long").alias("at"), "n", "size").agg(run.alias("run"))
        children = F.array_join(F.transform("run", lambda c: c["hash"]), "").alias("children")
        level = grouped.select("tree", "at", "n", F.ceil(F.col("size") / FANOUT).cast("long").alias("size"), children)
        made.append(stored(level.withColumn("hash", F.sha2("children", 256)), f"manifest-{name}{len(made) + 1}"))
        below = made[-1]
    return made


def _key(tree, block, height, at) -> Column:
    return F.struct(tree.alias("tree"), block.alias("block"), height.cast("int").alias("height"), at.cast("long").alias("at"))


def _up(tree: Column, block: Column, height: Column, at: Column, size: Column, groups: int) -> tuple[Column, Column]:
    """The parent of a node of a group's tree and the node's place below it; null above the root."""
    inner, below_root = size > 1, F.lit(groups > 1)
    parent = F.when(inner, _key(tree, block, height + 1, F.floor(at / FANOUT)))
    parent = parent.when(below_root, _key(tree, block, F.lit(UPPER + 1), F.floor(tree / FANOUT)))
    return parent.alias("parent"), F.when(inner, at % FANOUT).otherwise(tree % FANOUT).cast("int").alias("place")


def node_rows(lower: list[DataFrame], upper: list[DataFrame], groups: DataFrame, count: int) -> DataFrame:
    """(node, parent, place, children) of all inner nodes, those over several blocks once for each."""
    found = []
    tree, at, size, block = F.col("tree"), F.col("at"), F.col("size"), F.col("block")
    for h, level in enumerate(lower, 1):
        first = F.floor(at * FANOUT**h / BLOCK)
        last = F.floor((F.least((at + 1) * FANOUT**h, F.col("n")) - 1) / BLOCK)
        spread = level.withColumn("block", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
        found.append(spread.select(_key(tree, block, F.lit(h), at).alias("node"), *_up(tree, block, F.lit(h), at, size, count), "children"))
    blocks = groups.select("tree", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK).cast("long"))).alias("block"))
    for h, level in enumerate(upper, 1):
        above = level.select("at", "size", "children")
        under = blocks.join(above, F.floor(tree / FANOUT**h).cast("long") == at)
        parent = F.when(size > 1, _key(tree, block, F.lit(UPPER + h + 1), F.floor(at / FANOUT))).alias("parent")
        found.append(under.select(_key(tree, block, F.lit(UPPER + h), at).alias("node"), parent, (at % FANOUT).cast("int").alias("place"), "children"))
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return stored(rows, "manifest-nodes")


#: From parent to parent.  A row is a run of leaves, which have all nodes above them in common: each leaf's digest is
#: folded on its own, and the siblings passed are appended once.  ``children`` has 64 hex digits for each child.
CLIMB = """
WITH RECURSIVE climb(run, parent, place, folded, siblings) AS (
  SELECT run, parent, place, transform(leaves, (x, i) -> unhex(CASE WHEN n = 1 THEN x.offered
      ELSE sha2(array_join(transform(leaves, (y, j) -> CASE WHEN i = j THEN x.offered ELSE y.leaf END), ''), 256) END)), CAST('' AS BINARY)
  FROM {runs}
  UNION ALL
  SELECT c.run, n.parent, n.place,
    transform(c.folded, f -> unhex(sha2(concat(left(n.children, 64 * c.place), lower(hex(f)), substr(n.children, 64 * c.place + 65)), 256))),
    concat(c.siblings, unhex(concat(left(n.children, 64 * c.place), substr(n.children, 64 * c.place + 65))))
  FROM climb c JOIN {nodes} n ON n.node = c.parent
)
SELECT run, folded, siblings FROM climb WHERE parent IS NULL
"""


def climb(spark: SparkSession, runs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(run, folded, siblings) of ``runs`` (run, parent, place, n, leaves) at the root, stored."""
    before = spark.conf.get(_ROW_LIMIT)
    spark.conf.set(_ROW_LIMIT, "-1")  # the levels end the recursion, not a number of rows
    try:
        return stored(spark.sql(CLIMB, runs=runs, nodes=nodes), "manifest-climb")
    finally:
        spark.conf.set(_ROW_LIMIT, before)


def verify(rows: DataFrame, key: str, group: str) -> DataFrame:
    """Proof and verdict for each of ``rows`` (``key``, ``group``, leaf, offered).

    Returns (``key``, ``group``, leaf, subroot, root, proof_sha256, folded_root, verified): the trees are of the ``leaf`` digests, and
    ``offered`` is what is folded with each leaf's siblings.
    """
    spark = rows.sparkSession
    leaves, groups = numbered_leaves(rows, key, group)
    bounds = groups.agg(F.count("*").alias("trees"), F.max("n").alias("most")).first()
    trees, most = int(bounds["trees"]), int(bounds["most"] or 0)
    bottom = leaves.select("tree", "at", "n", F.col("leaf").alias("hash"))
    lower = levels(bottom, most, "level")
    tops = bottom.where("n = 1").select("tree", "hash")
    for level in lower:
        tops = tops.unionByName(level.where("size = 1").select("tree", "hash"))
    tops = durable(tops)
    upper = levels(tops.select(F.lit(0).alias("tree"), F.col("tree").alias("at"), F.lit(trees).cast("long").alias("n"), "hash"), trees, "upper")
    root = (upper[-1] if upper else tops).select(F.col("hash").alias("root"))
    tree, at = F.col("tree"), F.col("at")
    # The leaves of one parent climb together: ``at`` counts runs from here on.
    member = F.struct("at", F.col(key).alias("key"), F.col(group).alias("group"), "leaf", "offered")
    runs = leaves.groupBy("tree", F.floor(at / FANOUT).cast("long").alias("at"), "n").agg(F.sort_array(F.collect_list(member)).alias("leaves"))
    size, block = F.ceil(F.col("n") / FANOUT).cast("long"), F.floor(at * FANOUT / BLOCK).cast("long")
    runs = runs.select(F.struct("tree", "at").alias("run"), block.alias("block"), *_up(tree, block, F.lit(1), at, size, trees), "n", "leaves")
    runs = stored(runs, "manifest-runs")
    nodes = node_rows(lower, upper, groups, trees) if lower or upper else runs.select(F.col("parent").alias("node"), "parent", "place", F.lit("").alias("children")).limit(0)
    climbed = climb(spark, runs.select("run", "parent", "place", "n", "leaves"), nodes)
    # Subroots by tree and block: no more than a block's runs meet at a key.
    every = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK).cast("long"))
    named = groups.join(tops.withColumnRenamed("hash", "subroot"), "tree").select("tree", F.explode(every).alias("block"), "subroot")
    whole = runs.withColumn("tree", F.col("run.tree")).join(named, ["tree", "block"]).join(climbed, "run").crossJoin(F.broadcast(root))
    each = whole.select("leaves", "folded", "siblings", "subroot", "root", F.posexplode("leaves").alias("i", "own"))
    beside = F.array_join(F.transform(F.filter("leaves", lambda x: x["at"] != F.col("own.at")), lambda x: x["leaf"]), "")
    proof = F.sha2(F.concat(beside, F.lower(F.hex("siblings"))), 256).alias("proof_sha256")
    folded = F.lower(F.hex(F.col("folded")[F.col("i")])).alias("folded_root")
    found = each.select(F.col("own.key").alias(key), F.col("own.group").alias(group), "own.leaf", "subroot", "root", proof, folded)
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def audit(docs: DataFrame) -> DataFrame:
    """Proofs of all ``docs`` (doc_id, source, lang, n_chars, text), where every third by checksum offers a text in lower case."""
    own = [F.col(c) for c in FIELDS]
    struck = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    other = leaf([*own[:-1], ascii_lower(own[-1])])
    rows = docs.select("doc_id", "lang", leaf(own).alias("leaf"), F.when(struck, other).alias("offered"))
    rows = rows.withColumn("offered", F.coalesce("offered", "leaf"))
    return verify(rows, "doc_id", "lang").drop("lang")


#: The same by windows: levels and the way up as two recursions, the checksum by its polynomial.
SQL = """
WITH RECURSIVE poly AS (
  SELECT list(t ORDER BY i) AS tab FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384)) AS t FROM range(256) r(i))
), rows_ AS (
  SELECT doc_id, lang,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS low,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS crc
  FROM documents, poly
), leaves AS (
  SELECT doc_id, lang, leaf, CASE WHEN crc % 3 = 0 THEN sha256(head || low) ELSE leaf END AS offered,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree
  FROM (SELECT *, sha256(head || tail) AS leaf FROM rows_)
), lower_ AS (
  SELECT tree, 0 AS height, pos, n AS size, leaf AS hash FROM leaves
  UNION ALL
  SELECT tree, height + 1, pos // 8, (size + 7) // 8, sha256(string_agg(hash, '' ORDER BY pos)) FROM lower_ WHERE size > 1 GROUP BY tree, height, pos // 8, size
), tops AS (
  SELECT tree, hash, height AS top FROM lower_ WHERE size = 1
), upper_ AS (
  SELECT 0 AS height, tree AS pos, (SELECT count(*) FROM tops) AS size, hash FROM tops
  UNION ALL
  SELECT height + 1, pos // 8, (size + 7) // 8, sha256(string_agg(hash, '' ORDER BY pos)) FROM upper_ WHERE size > 1 GROUP BY height, pos // 8, size
), nodes AS (
  SELECT l.tree, l.height, l.pos, l.size, l.hash FROM lower_ l WHERE l.size > 1
  UNION ALL
  SELECT NULL, 1000 + height, pos, size, hash FROM upper_ WHERE size > 1
), passed AS (
  SELECT tree, height, pos // 8 AS run, list({'pos': pos, 'hash': hash} ORDER BY pos) AS run_nodes FROM nodes GROUP BY tree, height, pos // 8
), way AS (
  SELECT doc_id, leaf, l.tree, CASE WHEN n > 1 THEN 0 ELSE 1000 END AS height, CASE WHEN n > 1 THEN pos ELSE l.tree END AS pos, top, offered AS folded, '' AS proof, row_number() OVER () AS no
  FROM leaves l JOIN tops t ON l.tree = t.tree
  UNION ALL
  SELECT w.doc_id, w.leaf, w.tree, CASE WHEN w.height + 1 = w.top THEN 1000 ELSE w.height + 1 END, CASE WHEN w.height + 1 = w.top THEN w.tree ELSE w.pos // 8 END, w.top,
    sha256(list_reduce(list_concat([''], list_transform(run_nodes, lambda x: CASE WHEN x.pos = w.pos THEN w.folded ELSE x.hash END)), lambda a, b: a || b)),
    w.proof || list_reduce(list_concat([''], list_transform(list_filter(run_nodes, lambda x: x.pos <> w.pos), lambda x: x.hash)), lambda a, b: a || b), w.no
  FROM way w JOIN passed p ON p.height = w.height AND p.run = w.pos // 8 AND (w.height >= 1000 OR p.tree = w.tree)
)
SELECT w.doc_id, w.leaf, t.hash AS subroot, r.hash AS root, sha256(w.proof) AS proof_sha256, w.folded AS folded_root, w.folded = r.hash AS verified
FROM (SELECT doc_id, leaf, tree, max_by(folded, length(proof) * 2000 + height) AS folded, max_by(proof, length(proof) * 2000 + height) AS proof, no FROM way GROUP BY doc_id, leaf, tree, no) w
JOIN tops t ON t.tree = w.tree, (SELECT hash FROM upper_ WHERE size = 1) r
"""
