"""A trie of conversations by chained digests of their prefixes.

Each conversation is a chain: the digest of its first d turns is the SHA-256 of the digest of its first d - 1 turns and
the SHA-256 of turn d, cut to 128 bits. Every prefix of every conversation is a row, and rows are grouped by (depth,
digest) to nodes, so that a turn which a third of all conversations share is counted by partial sums.

Sums over subtrees come from sending nodes to all their ancestors. A node is named by its smallest member and its
depth, and the nodes of one smallest member are an unbroken piece of that conversation's path, its own piece. What
is sent up is the sum of a whole piece, once to each piece above it, to the depth at which the path leaves that piece;
inside a piece, a running sum from its end does the rest. A piece has fewer pieces above it than its conversation has
turns, so that the rows sent never exceed the turns read, however long a single conversation is.

Texts never move: a shuffle carries 32 bytes of hash for each turn. Nodes with many members are few (at most
HOT_NODES, since members add up to the number of prefix rows) and reach the prefixes by a broadcast; others by a join.
A conversation is streamed in order, turn by turn; the ids that end at a node are joined to blocks in parallel, and
the blocks are streamed through the hash.

Null roles and texts are empty; null turns come first. Turns of one number are ordered by their hash, so that repeated
rows stay repeated turns. Rows without a conv_id belong to no conversation and are left out. Conversations may lose all
their turns and then end at the root. Texts may be of any length; further columns are left out. An empty table has no
nodes, not even a root.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.common import WORD, batch, joined_sha256, stored, table

#: Conversations that take their first turns from the same one, and the most turns taken.
FAMILY, BORROWED = 20, 4
#: Members from which a node may count as hot, and the most nodes that do.
HOT_MEMBERS, HOT_NODES = 100, 100_000
DIGEST = 16


def hashed_turns(conversations: DataFrame) -> DataFrame:
    """base, conv_id, turn, t (SHA-256 of role and text) and words of every turn."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    t = F.unhex(F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256))
    c = F.col("conv_id").cast("long")
    rows = conversations.where(c.isNotNull())
    return rows.select((c - c % FAMILY).alias("base"), c.alias("conv_id"), "turn", t.alias("t"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, digest, words (of the last turn), last: every prefix of every rebuilt conversation, the empty one included."""
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("digest", pa.binary()), ("words", pa.int64()), ("last", pa.bool_())])
    root = hashlib.sha256().digest()[:DIGEST]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, home, heads, own, skip = None, None, [], 0, 0
        pending: tuple | None = None  # the longest prefix so far of the conversation `now`

        def grown(t: bytes, words: int) -> tuple:
            out.append((*pending, False))
            return now, pending[1] + 1, hashlib.sha256(pending[2] + t).digest()[:DIGEST], words

        for b in batches:
            for base, conv, t, words in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if conv != now:
                    if pending:
                        out.append((*pending, True))
                    if base != home:
                        home, heads = base, []
                    now, own, pending = conv, 0, (conv, 0, root, 0)
                    skip = 0 if conv == base else zlib.crc32(str(conv).encode()) % BORROWED
                    for head in heads[:skip]:
                        pending = grown(*head)
                own += 1
                if conv == base and own < BORROWED:
                    heads.append((t, words))
                if own > skip:
                    pending = grown(t, words)
            if len(out) >= 10_000:
                yield batch(schema, *zip(*out, strict=True))
                out = []
        if pending:
            out.append((*pending, True))
        if out:
            yield batch(schema, *zip(*out, strict=True))

    family = turns.repartition("base").sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.asc_nulls_first("turn"), "t")
    return family.select("base", "conv_id", "t", "words").mapInArrow(run, "conv_id long, depth long, digest binary, words long, last boolean")


def owned(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """conv_id, depth, last and owner (the node's smallest member) of every prefix."""
    owner = nodes.select("digest", F.col("conv_id").alias("owner"), "n_convs")
    least = max(HOT_MEMBERS, (nodes.agg(F.sum("n_convs")).first()[0] or 0) // HOT_NODES)
    hot = F.broadcast(owner.where(F.col("n_convs") > least).drop("n_convs"))
    met = rows.join(hot, "digest", "left")
    cold = met.where("owner is null").drop("owner").join(owner.where(F.col("n_convs") <= least).drop("n_convs"), "digest")
    cols = ["conv_id", "depth", "last", "owner"]
    return met.where("owner is not null").select(cols).unionByName(cold.select(cols))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    rows = stored(prefixes(hashed_turns(conversations)), "prefixes")
    nodes = rows.groupBy("depth", "digest").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if("last").alias("n_ends"), F.min("words").alias("words"))
    nodes = stored(nodes, "nodes").withColumn("leaf", (F.col("n_ends") == F.col("n_convs")).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("words"))
    of = stored(owned(rows, nodes), "owners")
    pieces = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    # a piece meets every piece above it; copies of a conversation own no piece and drop out
    above = of.where("owner <> conv_id").groupBy("conv_id", "owner").agg(F.max("depth").alias("depth")).join(pieces, "conv_id")
    above = stored(above.withColumn("child", (F.col("depth") == F.col("top") - 1).cast("long")), "above")
    below = above.groupBy(F.col("owner").alias("conv_id"), "depth").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"), F.sum("child").alias("child"))
    tops = above.where("child = 1").select("conv_id", F.col("top").alias("depth"), F.col("owner").alias("parent"))
    ends = joined_sha256(of.where("last").select(F.col("owner").alias("conv_id"), "depth", F.col("conv_id").alias("id")), ["conv_id", "depth"], "id")

    parts = [nodes.select("conv_id", "depth", "n_convs", "leaf", "saved"), below, tops, ends]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p, allowMissingColumns=True)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    made = both.groupBy("conv_id", "depth").agg(F.max("n_convs").alias("n_convs"), total("leaf"), total("saved"), total("child"), F.max("parent").alias("parent"), F.max("sha256").alias("sha256"))
    piece = Window.partitionBy("conv_id").orderBy(F.col("depth").desc())
    deeper = piece.rowsBetween(Window.unboundedPreceding, 0)
    return made.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id"),
        "n_convs",
        (F.col("child") + F.lag("depth").over(piece).isNotNull().cast("long")).alias("n_children"),
        F.sum("leaf").over(deeper).alias("n_leaves"),
        F.sum("saved").over(deeper).alias("saved_tokens"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


# crc32 of the decimal: eight shifts a byte; 3988292384 is the reversed polynomial (fixed value)
OP11_SQL = r"""
WITH RECURSIVE own AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT c, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda s, b: list_reduce(list_concat([xor(s, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, 3988292384 * (v & 1))))) % 4 AS h FROM (SELECT DISTINCT c FROM own)
), made AS (
  SELECT i.c, o.pos, o.role, o.text FROM ids i JOIN own o ON o.c = i.c - i.c % 20 AND o.pos <= i.h
  UNION ALL SELECT i.c, o.pos, o.role, o.text FROM ids i JOIN own o ON o.c = i.c AND o.pos > i.h
), turns AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY pos) AS d, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, sha256(role || chr(1) || text) AS t FROM made),
pre AS (
  SELECT c, 0 AS d, '' AS p, CAST(NULL AS VARCHAR) AS up, 0 AS words FROM ids
  UNION ALL SELECT c, d, p, coalesce(lag(p) OVER (PARTITION BY c ORDER BY d), '') AS up, words FROM (SELECT c, d, words, string_agg(t, '') OVER (PARTITION BY c ORDER BY d) AS p FROM turns)
), size AS (SELECT c, max(d) AS n FROM pre GROUP BY c),
node AS (SELECT p, any_value(d) AS d, min(c) AS c, any_value(up) AS up, count(*) AS n, any_value(words) AS words,
  sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = (SELECT n FROM size s WHERE s.c = pre.c)), '')) AS ends FROM pre GROUP BY p),
kids AS (SELECT up AS p, count(*) AS k FROM node WHERE up IS NOT NULL GROUP BY up),
full_ AS (SELECT node.*, coalesce(k, 0) AS k FROM node LEFT JOIN kids USING (p)),
up_ AS (SELECT p, p AS a, (n - 1) * words AS saved, CAST(k = 0 AS INT) AS leaf FROM full_ UNION ALL SELECT u.p, f.up, u.saved, u.leaf FROM up_ u JOIN full_ f ON f.p = u.a WHERE f.up IS NOT NULL),
sums AS (SELECT a AS p, CAST(sum(saved) AS BIGINT) AS saved, CAST(sum(leaf) AS BIGINT) AS leaves FROM up_ GROUP BY a)
SELECT f.c AS conv_id, CAST(f.d AS BIGINT) AS depth, u.c AS parent_conv_id, f.n AS n_convs, f.k AS n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, f.ends AS ends_sha256
FROM full_ f LEFT JOIN full_ u ON u.p = f.up JOIN sums s ON s.p = f.p
"""
