"""Merkle manifest of a table, in DataFrame functions only.

Rows are leaves, in trees by source whose nodes have sixteen children.  Each aligned
block of 4,096 leaves is one row that keeps every level as one concatenated hex string:
parents are hashes of its fixed-width substrings, and the substrings on both sides of a
node are its siblings.  The roots of the blocks are the leaves of the next round until
one block holds a tree; the roots of the trees are the leaves of the tree of sources.
Paths come down the same way, each joined to one block by its place, so no key of any
join or group holds more than a block.  Places are row numbers of a range partitioning,
made gapless by the counts of its partitions.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

#: Children of a node, levels of a block, hex digits of a digest.
FAN, LEVELS, HEX = 16, 3, 64
BLOCK = FAN**LEVELS
#: Rows of a task that orders leaves.
ROWS = 50_000
PATH = "array<struct<left:binary,right:binary>>"


def field(name: str, column: Column | None = None) -> Column:
    """UTF-8 byte count, a colon and the value; `-` for null."""
    value = (F.col(name) if column is None else column).cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame, tamper: Column | None = None) -> DataFrame:
    """doc_id, source, leaf, and tampered: the leaf of the changed text where ``tamper`` holds, else null."""
    ahead = [field(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(tamper, hashed(*ahead, field("text", changed))) if tamper is not None else F.lit(None).cast("string")
    return docs.select("doc_id", "source", hashed(*ahead, field("text")).alias("leaf"), tampered.alias("tampered"))


def numbered(rows: DataFrame, tree: list[str], order: list[str], n_rows: int) -> DataFrame:
    """``rows`` with at (gapless from 0 in each tree, by ``order``) and n (rows of the tree), written once.

    Ranges are cut between any two rows, equal ones too, so no tree and no id is one
    task's.  Partitions then hold consecutive rows, and their counts give the places.
    """
    spread = F.xxhash64(F.monotonically_increasing_id())
    ranged = rows.withColumn("_spread", spread).repartitionByRange(max(1, -(-n_rows // ROWS)), *tree, *order, "_spread").sortWithinPartitions(*tree, *order, "_spread")
    placed = cut(ranged.drop("_spread").select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")))
    runs = placed.groupBy(*tree, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_count"))  # one row for each tree and partition
    whole = Window.partitionBy(*tree)
    before = F.coalesce(F.sum("_count").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(*[F.col(t).alias(f"_{t}") for t in tree], F.col("_part").alias("_of"), (before - F.col("_first")).alias("_shift"), F.sum("_count").over(whole).alias("n"))
    return placed.join(runs, matches(tree) & (F.col("_part") == F.col("_of"))).withColumn("at", F.col("_row") + F.col("_shift")).drop("_part", "_row", "_of", "_shift", *[f"_{t}" for t in tree])


def nodes(level: Column) -> Column:
    return (F.length(level) / HEX).cast("int")


def above(level: Column, alone: Column) -> Column:
    """The level above: hashes of runs of sixteen digests; a single node stays if no other of its tree has its height."""
    runs = F.sequence(F.lit(0), F.ceil(nodes(level) / FAN).cast("int") - 1)
    parents = F.array_join(F.transform(runs, lambda k: F.sha2(F.substring(level, k * (FAN * HEX) + 1, F.lit(FAN * HEX)), 256)), "").cast("binary")
    return F.when(alone & (nodes(level) == 1), level).otherwise(parents)


def blocks(placed: DataFrame, tree: list[str]) -> DataFrame:
    """One row for each block: its tree, block, alone, members (by place, with what they carry), and its levels l0, l1, ..., of which the last is its root.

    ``placed``: the tree's columns, at, n, node, carried.
    """
    block = F.floor(F.col("at") / BLOCK)
    grouped = placed.groupBy(*tree, block.alias("block"), (F.col("n") <= BLOCK).alias("alone")).agg(F.sort_array(F.collect_list(F.struct("at", "node", "carried"))).alias("members"))
    out = grouped.withColumn("l0", F.array_join(F.col("members.node"), "").cast("binary")).withColumn("members", F.col("members.carried"))
    for k in range(LEVELS):
        out = out.withColumn(f"l{k + 1}", above(F.col(f"l{k}"), F.col("alone")))
    return out


def flanks(run: Column) -> Column:
    """The siblings left and right of a run's ancestors in its block, from the level above the leaves."""
    steps = []
    for k in range(1, LEVELS):
        level = F.col(f"l{k}")
        at = F.floor(run / FAN ** (k - 1)).cast("int")
        first = F.floor(run / FAN**k).cast("int") * FAN
        left = F.substring(level, first * HEX + 1, (at - first) * HEX)
        right = F.substring(level, (at + 1) * HEX + 1, (first + FAN - at - 1) * HEX)
        topped = F.col("alone") & (nodes(level) == 1)  # the tree ends below
        steps.append(F.when(~topped, F.struct(left.alias("left"), right.alias("right"))))
    return F.filter(F.array(*steps), lambda x: x.isNotNull()) if steps else F.array().cast(PATH)


def matches(tree: list[str]) -> Column:
    """The tree's columns equal those of the same names after an underscore."""
    return functools.reduce(Column.__and__, [F.col(t).eqNullSafe(F.col(f"_{t}")) for t in tree])


def other(rows: DataFrame, tree: list[str], *columns: str) -> DataFrame:
    """The tree's columns and ``columns`` with an underscore before their names."""
    return rows.select(*[F.col(c).alias(f"_{c}") for c in (*tree, *columns)])


def members(stack: DataFrame, paths: DataFrame, tree: list[str]) -> DataFrame:
    """Every member of the blocks: carried, at, node, top and path, whose siblings in the block come before ``paths`` of the block."""
    met = stack.join(other(paths, tree, "block", "top", "path"), matches([*tree, "block"]))
    run = lambda k: F.struct(k.alias("run"), F.substring("l0", k * (FAN * HEX) + 1, F.lit(FAN * HEX)).alias("nodes"), F.slice("members", k * FAN + 1, FAN).alias("carried"), flanks(k).alias("flanks"))
    runs = F.transform(F.sequence(F.lit(0), F.ceil(nodes(F.col("l0")) / FAN).cast("int") - 1), run)
    single = F.col("alone") & (nodes(F.col("l0")) == 1)
    met = met.select(*tree, "block", single.alias("single"), "_top", "_path", F.explode(runs).alias("r"))  # a run's row has its own digests only, not the block's
    met = met.select(*tree, "block", "single", "_top", "_path", F.col("r.run").alias("run"), F.col("r.nodes").alias("nodes"), F.col("r.flanks").alias("flanks"), F.posexplode("r.carried").alias("place", "carried"))
    left, right = F.substring("nodes", F.lit(1), F.col("place") * HEX), F.substring("nodes", (F.col("place") + 1) * HEX + 1, F.lit(FAN * HEX))
    own = F.when(F.col("single"), F.array().cast(PATH)).otherwise(F.array(F.struct(left.alias("left"), right.alias("right"))))
    node = F.substring("nodes", F.col("place") * HEX + 1, F.lit(HEX)).cast("string")
    return met.select(*tree, "carried", (F.col("block") * BLOCK + F.col("run") * FAN + F.col("place")).alias("at"), node.alias("node"), F.col("_top").alias("top"), F.concat(own, "flanks", "_path").alias("path"))


def climb(placed: DataFrame, tree: list[str], most: int) -> tuple[list[DataFrame], DataFrame]:
    """Stacks of blocks from the leaves upwards, and the root of every tree; ``most``: nodes of the largest tree."""
    stacks, roots = [], None
    while True:
        stack = cut(blocks(placed, tree))
        stacks.append(stack)
        done = stack.where("alone").select(*tree, F.col(f"l{LEVELS}").cast("string").alias("root"))
        roots = done if roots is None else roots.unionByName(done)
        most = -(-most // BLOCK)
        if most <= 1:
            return stacks, roots
        parts = stack.where("not alone").select(*tree, F.col("block").alias("at"), F.col(f"l{LEVELS}").cast("string").alias("node"), F.lit(None).cast("int").alias("carried"))
        sizes = parts.groupBy(*tree).agg(F.count("*").alias("n"))
        placed = parts.join(other(sizes, tree, "n").withColumnRenamed("_n", "n"), matches(tree)).drop(*[f"_{t}" for t in tree])


def descend(stacks: list[DataFrame], tops: DataFrame, tree: list[str]) -> DataFrame:
    """Members of the lowest stack with their whole paths; ``tops``: top and the path above the root of every tree."""
    below = None
    for stack in reversed(stacks):
        paths = tops.select(*tree, F.lit(0).cast("long").alias("block"), "top", "path")
        if below is not None:  # the blocks of a tree that has several are members of the stack above
            paths = paths.join(other(stack.where("alone"), tree), matches(tree), "left_semi").unionByName(below.select(*tree, F.col("at").alias("block"), "top", "path"))
        below = members(stack, paths, tree)
    return below


def manifest(docs: DataFrame, tamper: Column | None = None) -> DataFrame:
    """doc_id, source, leaf, tampered, subroot, root, path of every row.

    ``path``: the siblings left and right of each ancestor, from the leaf to the root, so
    that each row can be checked by itself (``folded``, ``proof``).  Leaves of a source
    ascend by doc_id, null ids first, rows of one id by their leaf; repeated rows are
    leaves each.  Rows of a null source form one tree, the first.  Null and empty texts
    differ (`-` and `0:`).  An empty table gives no rows.  Columns besides doc_id,
    source, lang, n_chars, text are ignored.
    """
    rows = cut(leaves(docs, tamper))
    largest = rows.groupBy("source").count().agg(F.sum("count").alias("rows"), F.count("*").alias("trees"), F.max("count").alias("most")).first()
    if not largest.rows:
        return rows.select("doc_id", "source", "leaf", "tampered", F.lit("").alias("subroot"), F.lit("").alias("root"), F.array().cast(PATH).alias("path"))
    placed = numbered(rows, ["source"], ["doc_id", "leaf"], largest.rows)
    placed = placed.select("source", "at", "n", F.col("leaf").alias("node"), F.struct("doc_id", "tampered").alias("carried"))
    stacks, roots = climb(placed, ["source"], largest.most)
    upper = numbered(cut(roots.withColumn("forest", F.lit(0))), ["forest"], ["source"], largest.trees)
    upper = upper.select("forest", "at", "n", F.col("root").alias("node"), F.struct("source").alias("carried"))
    upper_stacks, root = climb(upper, ["forest"], largest.trees)
    top = root.first().root  # one digest
    tops = descend(upper_stacks, root.select("forest", F.lit(None).cast("string").alias("top"), F.array().cast(PATH).alias("path")), ["forest"])
    tops = cut(tops.select("carried.source", F.col("node").alias("top"), "path"))
    out = descend(stacks, tops, ["source"])
    return out.select("carried.doc_id", "source", F.col("node").alias("leaf"), "carried.tampered", F.col("top").alias("subroot"), F.lit(top).alias("root"), "path")


def proof() -> Column:
    """The hash of all siblings of ``path``."""
    return F.sha2(F.aggregate("path", F.lit("").cast("binary"), lambda all_, x: F.concat(all_, x["left"], x["right"])), 256)


def folded(leaf: Column) -> Column:
    """The root that a leaf and the siblings of ``path`` come to."""
    return F.aggregate("path", leaf, lambda node, x: F.sha2(F.concat(x["left"], node.cast("binary"), x["right"]), 256))


def verify(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; rows whose crc32(doc_id) 5 divides are checked with a tampered text."""
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    out = manifest(docs, chosen).withColumn("folded_root", folded(F.coalesce("tampered", "leaf")))
    return out.select("doc_id", "leaf", "subroot", "root", proof().alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql(levels: int = 5) -> str:
    """DuckDB SQL of ``verify`` with the trees written out level by level, for up to 16 ** ``levels`` nodes of a tree."""
    value = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    ahead = " || ".join(map(value, ("doc_id", "source", "lang", "n_chars")))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    step = "xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)"
    crc = f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: {step})))"
    out = [f"d AS (SELECT doc_id, source, sha256({ahead} || {value('text')}) AS leaf, CASE WHEN {crc} % 5 = 0 THEN sha256({ahead} || {value(lower)}) END AS tampered FROM documents)"]
    out.append("t0 AS (SELECT source AS k, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h, count(*) OVER (PARTITION BY source) AS n, doc_id, tampered FROM d)")
    for name in ("t", "u"):
        for j in range(levels):
            out.append(f"{name}{j + 1} AS (SELECT k, i // 16 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h, count(*) OVER (PARTITION BY k) AS n FROM {name}{j} WHERE n > 1 GROUP BY k, i // 16)")
            beside = "coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i {} a.i), '')"
            out.append(f"{name}s{j} AS (SELECT a.k, a.i, {beside.format('<')} AS l, {beside.format('>')} AS r FROM {name}{j} a JOIN {name}{j} b ON a.k IS NOT DISTINCT FROM b.k AND a.i // 16 = b.i // 16 WHERE a.n > 1 GROUP BY a.k, a.i)")
        out.append(f"{name}r AS ({' UNION ALL '.join(f'SELECT k, h FROM {name}{j} WHERE n = 1' for j in range(levels + 1))})")
        if name == "t":
            out.append("u0 AS (SELECT 0 AS k, row_number() OVER (ORDER BY k NULLS FIRST) - 1 AS i, h, count(*) OVER () AS n, k AS source FROM tr)")
    pairs = [f"{name}s{j}" for name in ("t", "u") for j in range(levels)]
    joins = [f"LEFT JOIN {name}s{j} ON {name}s{j}.k IS NOT DISTINCT FROM {name}0.k AND {name}s{j}.i = {name}0.i // {16**j}" for name in ("t", "u") for j in range(levels)]
    out.append(f"f0 AS (SELECT t0.doc_id, t0.h AS leaf, u0.h AS subroot, ur.h AS root, [{', '.join(f'{p}.l, {p}.r' for p in pairs)}] AS p, coalesce(t0.tampered, t0.h) AS f FROM t0 JOIN u0 ON u0.source IS NOT DISTINCT FROM t0.k CROSS JOIN ur {' '.join(joins)})")
    for j in range(len(pairs)):
        out.append(f"f{j + 1} AS (SELECT * REPLACE (CASE WHEN p[{2 * j + 1}] IS NULL THEN f ELSE sha256(p[{2 * j + 1}] || f || p[{2 * j + 2}]) END AS f) FROM f{j})")
    return f"WITH {', '.join(out)} SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_filter(p, lambda x: x IS NOT NULL), '')) AS proof_sha256, f AS folded_root, f = root AS verified FROM f{len(pairs)}"


SQL = _sql()
