"""The prefix trie of conversations, built level by level.

A node is a sequence of first turns (role and text); it is told by its depth and its least member. Depth after depth, the
conversations that are still live are grouped by their node and their next turn; a group is a node below, named by its least
conversation. A conversation that is alone in its node is not live any more: the rest of it is a chain whose nodes follow from
its rows without another round. Conversations with the same turns throughout are one sequence with a weight, so that copies,
however long and many, cost no rounds either. Going back up, each level joins its children's sums of leaves and savings.

Turns travel as 128-bit digests with their lengths, in ranges of conversation and turn, so that one long conversation lies over
many tasks; groups are summed before they are shuffled, and what joins a common turn's group is split by adaptive execution.
There are as many rounds as turns that two different sequences share at most.

Turns go by turn (nulls first), then role, then text; null roles and texts are empty. Repeated rows are turns of their own.
Rows without a conv_id belong to no conversation and are left out. Other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.llm.common import map_lists, read, written
from assayer.llm.ordered import chained_sha256, chunked, in_ranges
from assayer.llm.repair import CRC32

#: A conversation begins with up to SHARED - 1 turns of the conversation whose id is the next lower multiple of FAMILY.
FAMILY, SHARED = 100, 6
#: Turns of a chain that one window partition sums.
BUCKET = 1000
NOTHING = hashlib.sha256(b"").hexdigest()
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def positions(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), digest of role and text, chars (code points of the text) of turns (conv_id, turn, role, text)."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        now, at = None, 0
        for rows in batches:
            places = []
            for conv in rows["conv_id"]:
                at = at + 1 if conv == now else 0
                now = conv
                places.append(at)
            yield {
                "conv_id": rows["conv_id"], "part": rows["part"], "at": places, "chars": [*map(len, rows["text"])],
                "digest": [hashlib.blake2b(f"{len(r)}:{r}{t}".encode(), digest_size=16).digest() for r, t in zip(rows["role"], rows["text"], strict=True)],
            }

    rows = turns.select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("conv_id IS NOT NULL")
    placed = written(map_lists(in_ranges(rows, ["conv_id", "turn", "role", "text"]), run, "conv_id long, part int, at long, chars long, digest binary"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shares = placed.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    later = shares.withColumn("before", F.sum("n").over(before)).where("before > 0").drop("n")  # a row for each range at most
    return placed.join(F.broadcast(later), ["conv_id", "part"], "left").select("conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"), "digest", "chars")


def with_family_starts(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of turns (conv_id, pos, digest, chars), the turns of the rebuilt conversations, and conv_id, size of each of these."""
    own = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(SHARED))
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    first = sizes.select(F.col("conv_id").alias("family"), F.col("own").alias("had"))
    family = sizes.withColumns({"family": F.col("conv_id") - F.col("conv_id") % FAMILY, "shared": own}).join(first, "family", "left")
    convs = written(family.select("conv_id", "own", "family", "shared", F.least("shared", F.coalesce("had", F.lit(0))).alias("got")))
    heads = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < SHARED - 1)).withColumnRenamed("conv_id", "family")
    taken = convs.join(heads, "family").where("pos < got").select("conv_id", "pos", "digest", "chars")
    rest = turns.where(F.col("pos") >= own).join(convs, "conv_id").select("conv_id", (F.col("pos") - F.col("shared") + F.col("got")).alias("pos"), "digest", "chars")
    size = F.col("got") + F.greatest(F.col("own") - F.col("shared"), F.lit(0))
    return taken.unionByName(rest), convs.select("conv_id", size.cast("long").alias("size"))


def sequences(turns: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rep (the least), weight and size of each sequence of turns; and rep, ends_sha256 over the conversations that have it."""
    mark = [F.bit_xor(F.xxhash64(F.lit(seed), "pos", "digest")).alias(f"mark{seed}") for seed in (1, 2)]
    marked = written(sizes.join(turns.groupBy("conv_id").agg(*mark), "conv_id", "left").fillna(0, ["mark1", "mark2"]))
    same = ["size", "mark1", "mark2"]
    items = written(marked.groupBy(*same).agg(F.min("conv_id").alias("rep"), F.count("*").alias("weight")))
    copies = marked.join(items.where("weight > 1"), same).select("rep", "conv_id")
    ends = chained_sha256(chunked(copies, "rep", "conv_id"), b",").select(F.col("key").alias("rep"), F.col("sha256").alias("ends_sha256"))
    alone = items.where("weight = 1").select("rep", F.sha2(F.col("rep").cast("string"), 256).alias("ends_sha256"))
    return items.select("rep", "weight", "size"), written(ends.unionByName(alone))


def levels(turns: DataFrame, items: DataFrame) -> list[DataFrame]:
    """By depth from 0: the nodes parent, conv_id, n_convs, items (sequences in it), chars (of its turn), end (the sequence that ends there), size."""
    end = lambda depth: F.max(F.when(F.col("size") == depth, F.col("rep"))).alias("end")
    members = (F.min("rep").alias("conv_id"), F.sum("weight").alias("n_convs"), F.count("*").alias("items"))
    root = items.agg(*members, end(0), F.max("size").alias("size")).select(F.lit(None).cast("long").alias("parent"), "conv_id", "n_convs", "items", F.lit(0).cast("long").alias("chars"), "end", "size")
    out = [written(root)]
    live = items.withColumn("node", F.lit(out[0].first()["conv_id"]))
    while True:
        depth = len(out)
        reached = written(live.where(F.col("size") >= depth).join(turns.where(F.col("pos") == depth - 1).drop("pos"), "rep"))
        nodes = reached.groupBy("node", "digest").agg(*members, F.first("chars").alias("chars"), end(depth), F.max("size").alias("size"))
        nodes = written(nodes.withColumnRenamed("node", "parent"))
        out.append(nodes)
        shared = nodes.where("items > 1").select(F.col("parent").alias("node"), "digest", F.col("conv_id").alias("below"))
        if shared.isEmpty():
            return out
        live = reached.join(shared, ["node", "digest"]).select("rep", "weight", "size", F.col("below").alias("node"))


def chains(turns: DataFrame, tops: DataFrame) -> DataFrame:
    """The nodes of conversations that are alone from a node on: tops (rep, top, parent, weight, size), down to their ends."""
    rows = turns.join(tops, "rep").where("pos >= top - 1").withColumn("bucket", F.floor(F.col("pos") / BUCKET))
    # only copies save anything: what stands below, by buckets, so that a long chain is summed by many tasks
    copied = rows.where("weight > 1")
    below = Window.partitionBy("rep").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    beyond = copied.groupBy("rep", "bucket").agg(F.sum("chars").alias("sum")).withColumn("beyond", F.coalesce(F.sum("sum").over(below), F.lit(0))).drop("sum")
    within = F.sum("chars").over(Window.partitionBy("rep", "bucket").orderBy(F.desc("pos")))
    summed = copied.withColumn("within", within).join(beyond, ["rep", "bucket"])
    saved = summed.withColumn("saved", (F.col("weight") - 1) * (F.col("within") + F.col("beyond"))).drop("within", "beyond")
    return saved.unionByName(rows.where("weight = 1").withColumn("saved", F.lit(0).cast("long")))


def trie(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """NODE of every node over turns (conv_id, pos, digest, chars); sizes has conv_id, size of every conversation."""
    items, ends = sequences(turns, sizes)
    if items.isEmpty():
        return sizes.sparkSession.createDataFrame([], ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in NODE))
    n = max(1, int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kept = turns.join(items.select(F.col("rep").alias("conv_id")), "conv_id").withColumnRenamed("conv_id", "rep")
    kept = written(kept.repartitionByRange(n, "pos", "rep").sortWithinPartitions("pos", "rep"))  # a level reads its own row groups
    by_depth = levels(kept, items)

    none: Column = F.lit(None).cast("long")
    tops = [d.where("items = 1").select(F.col("conv_id").alias("rep"), F.lit(k).cast("long").alias("top"), "parent", F.col("n_convs").alias("weight"), "size") for k, d in enumerate(by_depth) if k]
    below = tops[0]
    for x in tops[1:]:
        below = below.unionByName(x)
    lone = written(chains(kept, written(below)).withColumn("depth", F.col("pos") + 1))
    at_end = F.col("depth") == F.col("size")
    out = lone.select(
        F.col("rep").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("top"), F.col("parent")).otherwise(F.col("rep")).alias("parent_conv_id"),
        F.col("weight").alias("n_convs"), F.when(at_end, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.when(at_end, F.col("rep")).alias("end"),
    )

    children = lone.where("depth = top").select("depth", F.col("parent"), F.lit(1).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    above = None
    for depth in range(len(by_depth) - 1, -1, -1):
        nodes = by_depth[depth].where("items > 1") if depth else by_depth[0]
        kids = children.where(F.col("depth") == depth + 1).drop("depth")
        kids = kids if above is None else kids.unionByName(above.select(F.col("parent_conv_id").alias("parent"), "n_leaves", "saved_tokens"))
        sums = kids.groupBy(F.col("parent").alias("conv_id")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
        own = (F.col("n_convs") - 1) * F.col("chars")
        above = written(nodes.join(sums, "conv_id", "left").select(
            "conv_id", F.lit(depth).cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs",
            F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),
            (own + F.coalesce("below", F.lit(0))).alias("saved_tokens"), "end",
        ))
        out = out.unionByName(above)
    told = out.join(ends.withColumnRenamed("rep", "end"), "end", "left")
    return told.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING))).select(*NODE)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, sizes = with_family_starts(positions(read(spark, sf_dir, "conversations")))
    return trie(written(turns), sizes)


ORACLE = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS family, {CRC32.format(key="conv_id::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, 0 AS own, pos, role, text FROM c JOIN t ON t.conv_id = c.family AND pos < h
  UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN t USING (conv_id) WHERE pos >= h),
s AS (
  SELECT c.conv_id, coalesce(turns, []) AS turns
  FROM c LEFT JOIN (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY own, pos) AS turns FROM r GROUP BY conv_id) USING (conv_id)),
d AS (SELECT conv_id, turns, len(turns) AS n, unnest(range(len(turns) + 1)) AS depth FROM s),
m AS (SELECT *, min(conv_id) OVER (PARTITION BY depth, turns[1:depth]) AS node FROM d),
up AS (SELECT m.*, p.node AS parent FROM m LEFT JOIN m p ON p.conv_id = m.conv_id AND p.depth = m.depth - 1),
nodes AS (
  SELECT node, depth, any_value(parent) AS parent, count(*) AS n_convs, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth) AS ends,
         bool_and(n = depth) AS leaf, any_value(CASE WHEN depth = 0 THEN 0 ELSE length(turns[depth].text) END) AS chars
  FROM up GROUP BY node, depth),
kids AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
sub AS (
  SELECT a.node, a.depth, sum(x.leaf::INT) AS n_leaves, sum((x.n_convs - 1) * x.chars) AS saved
  FROM nodes x JOIN m a ON a.conv_id = x.node AND a.depth <= x.depth GROUP BY a.node, a.depth)
SELECT n.node::BIGINT AS conv_id, n.depth::BIGINT AS depth, n.parent::BIGINT AS parent_conv_id, n_convs::BIGINT AS n_convs,
       coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM nodes n JOIN sub USING (node, depth) LEFT JOIN kids USING (node, depth)
"""
