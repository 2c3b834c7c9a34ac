"""The prefix trie of conversations by prefix doubling.

Distinct turns get dense names. A block of 2**k turns is named by the pair of names of its halves: one grouping and one
join a level, and each level has half the blocks of the one before. The first d turns of a conversation are the blocks
that the binary digits of d spell out, the largest first, so a prefix is named by at most log2(d) + 1 numbers, and equal
prefixes are one group. No text is compared or moved after its turn is named, and no step walks turn by turn.

A node is held by its smallest member, who also holds all nodes below it on its own path; so what a node gathers from
its subtree is a sum over members of what each holds from that depth on: one running sum and one grouping.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import remove, table, written
from parley.operators.order import running_by, running_index

WORD = r"[^\x20\x09-\x0D]+"
#: Members whose ids differ only below so many bits are joined to one string before a node's digest is made.
CHUNK_BITS = 12
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def ranked_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, rank (from 0), digest (of role and text), words. Rows without a conv_id are left out; rows that share a
    turn stand by role and text; null role and text are empty."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *texts)
    digest = F.unhex(F.sha2(F.concat_ws(":", F.octet_length("role").cast("string"), F.concat("role", "text")), 256)).alias("digest")
    keep = ["conv_id", digest, F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")]
    return running_by(rows, ["conv_id"], ["turn", "role", "text"], {"rank": F.lit(1).cast("long")}, keep)


def dense_names(df: DataFrame, key: list[str]) -> DataFrame:
    """``df`` with ``key`` replaced by ``name``, the place of its value among the distinct ones. A value that a third of
    all rows share is counted by partial sums and split by the adaptive join."""
    return df.join(running_index(df.select(*key).distinct(), key, "name"), key).drop(*key)


def rebuilt(turns: DataFrame, prefix_of: Column, kept: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first ``kept`` turns (3 at most) come from the conversation ``prefix_of``, their own following.

    (conversations: conv_id, length; turns: conv_id, at, length, name, words). ``turns``: conv_id, rank, name, words.
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    base = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    shape = sizes.select("conv_id", "n", prefix_of.alias("base"), kept.alias("h")).join(base, "base", "left")
    shape = shape.withColumn("given", F.least("h", F.coalesce("n_base", F.lit(0))))
    shape = shape.withColumn("length", F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).select("conv_id", "base", "h", "given", "length")
    own = turns.join(shape, "conv_id").filter("rank >= h").select("conv_id", (F.col("given") + F.col("rank") - F.col("h")).alias("at"), "length", "name", "words")
    heads = turns.filter("rank < 3").select(F.col("conv_id").alias("base"), "rank", "name", "words")
    given = shape.join(heads, "base").filter("rank < given").select("conv_id", F.col("rank").alias("at"), "length", "name", "words")
    return shape.select("conv_id", "length"), own.unionByName(given)


def block_levels(turns: DataFrame, longest: int) -> list[tuple[DataFrame, str]]:
    """Tables conv_id, at, length, name of aligned blocks of 1, 2, 4, ... turns; ``at`` counts blocks."""
    levels = [written(turns.select("conv_id", "at", "length", "name"), "blocks")]
    while 2 << len(levels) - 1 <= longest:
        below = levels[-1][0]
        half = lambda odd: F.max(F.when(F.col("at") % 2 == odd, F.col("name")))
        pairs = below.groupBy("conv_id", F.shiftright("at", 1).alias("at")).agg(F.max("length").alias("length"), half(0).alias("first"), half(1).alias("second"))
        pairs, path = written(pairs.filter("second IS NOT NULL"), "pairs")
        levels.append(written(dense_names(pairs, ["first", "second"]).select("conv_id", "at", "length", "name"), "blocks"))
        remove(pairs.sparkSession, path)
    return levels


def prefixes(turns: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """conv_id, depth, key (names of the blocks that make up the prefix, largest first), words (of its last turn), length."""
    pieces = turns.select("conv_id", (F.col("at") + 1).alias("depth"), "length", "words", F.lit(None).cast("struct<under:int,name:long>").alias("piece"))
    for k, blocks in enumerate(levels):
        begin = F.col("at") * (1 << k) + (1 << k)
        to = F.least(begin + ((1 << k) - 1), "length")
        piece = F.struct(F.lit(-k).alias("under"), "name").alias("piece")
        each = blocks.filter("at % 2 = 0").select("conv_id", F.explode(F.sequence(begin, to)).alias("depth"), "length", F.lit(None).cast("long").alias("words"), piece)
        pieces = pieces.unionByName(each)
    key = F.transform(F.sort_array(F.collect_list("piece")), lambda x: x["name"])  # log2(depth) + 1 at most
    return pieces.groupBy("conv_id", "depth").agg(key.alias("key"), F.max("words").alias("words"), F.max("length").alias("length"))


def end_digests(ends: DataFrame) -> DataFrame:
    """top, depth, ends_sha256: of the comma-joined ascending conv_ids of each (top, depth). Ids are joined in chunks of
    ``2**CHUNK_BITS`` neighbours at most; the digest is fed chunk by chunk, so a node may have any number of members."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    chunks = ends.groupBy("top", "depth", F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]]), pa.array([state.hexdigest()])], names=["top", "depth", "ends_sha256"])
        for batch in batches:
            tops, depths, found = [], [], []
            for top, depth, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                if at != (top, depth):
                    if at:
                        tops.append(at[0])
                        depths.append(at[1])
                        found.append(state.hexdigest())
                    at, state = (top, depth), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(tops, pa.int64()), pa.array(depths, pa.int64()), pa.array(found, pa.string())], names=["top", "depth", "ends_sha256"])
        if at:
            yield row()

    dealt = chunks.repartition("top", "depth").sortWithinPartitions("top", "depth", "chunk")
    return dealt.mapInArrow(run, "top long, depth long, ends_sha256 string")


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """Nodes (``NODE``) of the trie of conversations; ``convs``: conv_id, length (0 too); ``turns``: conv_id, at, length,
    name, words. No conversation: no node, not even a root."""
    spark = convs.sparkSession
    n, least, longest, longer = convs.agg(F.count("*"), F.min("conv_id"), F.max("length"), F.count_if(F.col("length") > 0)).first()
    if not n:
        return spark.createDataFrame([], NODE)
    levels = block_levels(turns, longest)
    named, at_named = written(prefixes(turns, [df for df, _ in levels]), "prefixes")
    for _, path in levels:
        remove(spark, path)
    stats = named.groupBy("depth", "key").agg(F.min("conv_id").alias("top"), F.count("*").alias("n"), F.count_if(F.col("length") > F.col("depth")).alias("longer"))
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), "length", *[F.lit(v).cast("long").alias(c) for c, v in (("top", least), ("n", n), ("longer", longer))])
    rows = named.join(stats, ["depth", "key"]).drop("key").unionByName(root)
    holds = F.col("top") == F.col("conv_id")
    saved = F.when(holds, (F.col("n") - 1) * F.col("words")).otherwise(0).alias("saved")
    leaf = F.when(holds & (F.col("longer") == 0), 1).otherwise(0).cast("long").alias("leaf")
    rows, at_rows = written(rows.select("conv_id", "depth", "length", "top", "n", saved, leaf), "members")
    remove(spark, at_named)
    # From depth ``since`` on a conversation holds the nodes of its path; above it stands a node that ``above`` holds.
    over = F.when(~holds, F.col("depth"))
    own = rows.groupBy("conv_id").agg(F.min(F.when(holds, F.col("depth"))).alias("since"), F.max_by("top", over).alias("above"), F.sum("saved").alias("all_saved"), F.sum("leaf").alias("all_leaves"))
    lower = rows.filter(~holds).join(own, "conv_id")
    lower = lower.select("top", "depth", "n", F.lit(None).cast("long").alias("parent"), (F.col("depth") + 1 == F.col("since")).cast("long").alias("child"), F.col("all_leaves").alias("leaf"), F.col("all_saved").alias("saved"))
    kept = rows.filter(holds).select("conv_id", "depth", (-F.col("depth")).alias("up"), "length", "n", "saved", "leaf")
    kept = running_by(kept, ["conv_id"], ["up"], {"saved_below": F.col("saved"), "leaves_below": F.col("leaf")}).join(own, "conv_id")
    parent = F.when(F.col("depth") > F.col("since"), F.col("conv_id")).when(F.col("depth") > 0, F.col("above"))
    kept = kept.select(
        F.col("conv_id").alias("top"), "depth", "n", parent.alias("parent"), (F.col("depth") < F.col("length")).cast("long").alias("child"),
        (F.col("leaf") + F.col("leaves_below")).alias("leaf"), (F.col("saved") + F.col("saved_below")).alias("saved"),
    )
    nodes = lower.unionByName(kept).groupBy("top", "depth").agg(
        F.max("parent").alias("parent_conv_id"), F.max("n").alias("n_convs"), F.sum("child").alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens")
    )
    digests = end_digests(rows.filter("depth = length").select("top", "depth", "conv_id"))
    out = nodes.join(digests, ["top", "depth"], "left").fillna(hashlib.sha256(b"").hexdigest(), ["ends_sha256"])
    return out.withColumnRenamed("top", "conv_id").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(conversations: DataFrame, prefix_of: Column | None = None, kept: Column | None = None) -> DataFrame:
    """The trie's nodes (``NODE``) of ``conversations`` (conv_id, turn, role, text; others are ignored).

    ``prefix_of`` and ``kept`` (columns over conv_id): the conversation that gives the first ``kept`` turns, 3 at most; by
    default each keeps its own. A missing one gives none. A conversation may have a third of all turns: no step gathers it.
    """
    turns, path = written(dense_names(ranked_turns(conversations), ["digest"]), "turns")
    own = prefix_of if prefix_of is not None else F.col("conv_id")
    convs, rows = rebuilt(turns, own, kept if kept is not None else F.lit(0).cast("long"))
    convs, _ = written(convs, "conversations")
    rows, at_rows = written(rows, "rebuilt")
    remove(conversations.sparkSession, path)
    out = trie(convs, rows)
    remove(conversations.sparkSession, at_rows)
    return out


def op11_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    return prefix_trie(table(spark, sf_dir, "conversations"), F.col("conv_id") - F.col("conv_id") % 20, shared)


#: crc32 as SQL, of texts whose code points are below 256: the table of 256 entries follows from the polynomial.
CRC32_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t"


def crc32_sql(text: str) -> str:
    codes = "CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [(192 | (ord(c) >> 6))::BIGINT, (128 | (ord(c) & 63))::BIGINT] END"
    each = f"flatten(list_transform(string_split({text}, ''), lambda c: {codes}))"
    return f"xor(4294967295, list_reduce({each}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295))"


OP11_SQL = f"""
WITH tab AS ({CRC32_TABLE}),
ranked AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS rank
  FROM conversations WHERE conv_id IS NOT NULL),
shape AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {crc32_sql("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM ranked), tab),
given AS (
  SELECT s.conv_id, 0 AS part, r.rank, r.role, r.text FROM shape s JOIN ranked r ON r.conv_id = s.base AND r.rank < s.h
  UNION ALL SELECT s.conv_id, 1, r.rank, r.role, r.text FROM shape s JOIN ranked r ON r.conv_id = s.conv_id AND r.rank >= s.h),
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, rank) AS depth, role, text FROM given),
paths AS (
  SELECT conv_id, depth, list({{'role': role, 'text': text}}) OVER (PARTITION BY conv_id ORDER BY depth) AS path, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM turns
  UNION ALL SELECT conv_id, 0, [], 0 FROM shape),
groups AS (SELECT depth, path, min(conv_id) AS top, count(*) AS n FROM paths GROUP BY depth, path),
members AS (SELECT p.conv_id, p.depth, g.top, g.n, p.words FROM paths p JOIN groups g USING (depth, path)),
ends AS (SELECT conv_id, max(depth) AS depth FROM members GROUP BY conv_id),
near AS (
  SELECT m.top, m.depth, any_value(m.n) AS n, any_value(m.words) AS words, max(u.top) AS parent, count(DISTINCT d.top) AS children,
    coalesce(string_agg(CASE WHEN e.conv_id IS NOT NULL THEN m.conv_id::VARCHAR END, ',' ORDER BY m.conv_id), '') AS ids
  FROM members m LEFT JOIN members u ON u.conv_id = m.conv_id AND u.depth = m.depth - 1
  LEFT JOIN members d ON d.conv_id = m.conv_id AND d.depth = m.depth + 1 LEFT JOIN ends e ON e.conv_id = m.conv_id AND e.depth = m.depth
  GROUP BY m.top, m.depth),
below AS (
  SELECT a.top, a.depth, count_if(b.children = 0) AS leaves, sum((b.n - 1) * b.words) AS saved
  FROM near b JOIN members a ON a.conv_id = b.top AND a.depth <= b.depth GROUP BY a.top, a.depth)
SELECT top AS conv_id, depth, parent AS parent_conv_id, n AS n_convs, children AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(ids) AS ends_sha256
FROM near JOIN below USING (top, depth)"""
