"""The prefix trie of conversations: what their beginnings share, and how many words a cache of shared beginnings saves.

A turn is a digest of 16 bytes, a conversation the digests one after the other, and the trie's order that of those bytes, a conversation that ends
after those that go on. Conversations are range-partitioned in that order, by identifier where they are equal, so that copies spread as well.
A shard numbers its turns, puts the numbers into a padded matrix and sorts its rows (lexsort). Where a row first differs from the one before, and
in all columns after it (an OR accumulated along the row), a node starts; a node is a run of rows at a depth, and its measures are sums over the
run (reduceat), those of its subtree sums of what the nodes that start in the run and not above it hold.

Only nodes on a shard's first or last row can go on in another shard. How far is known from the neighbours' edge rows; their parts carry the prefix's
digest and are summed over the shards. Long conversations are taken in stretches of DEEP turns: those that share a stretch with others and go on after it are
sorted again by the next one, below the node that they share; those that go on alone are chains, a node for each turn.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripledger.llm.common import shuffle_partitions, spread_join, table, written
from tripledger.llm.spelling import CRC_SQL, crc_sql

#: Turns of a stretch, conversations of a shard at most and at least (about), bytes of a turn's digest.
DEEP, SHARD, LEAST, WIDTH = 128, 1 << 15, 1 << 10, 16
END = b"\xff" * WIDTH
EMPTY = hashlib.sha256(b"").hexdigest()
WORDS = "[^\x20\x09-\x0D]+"


def turn_digest(role: Column, text: Column) -> Column:
    """16 bytes of a digest of role and text, which the role's length keeps apart."""
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.substring(F.sha2(whole.cast("binary"), 256), 1, 2 * WIDTH))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos, turn, words: turns in order, null first, equal ones by digest. Rows without a conversation are left out.

    The order is that of a range sort, in which one long conversation may fill many partitions; each part counts on from those before.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    words = F.regexp_count(text, F.lit(WORDS))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("_at"), turn_digest(role, text).alias("turn"), words.alias("words"))
    order = ["conv_id", F.col("_at").asc_nulls_first(), "turn"]
    rows = rows.repartitionByRange(shuffle_partitions(conversations.sparkSession), *order).sortWithinPartitions(*order)
    rows = written(rows.select("conv_id", "turn", "words", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "turns")
    parts = rows.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part of the range sort
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return rows.join(parts, ["conv_id", "part"]).select("conv_id", (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "turn", "words")


def heads_shared(turns: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """conv_id, pos, turn, words of conversations rebuilt: the first h turns are those of the first conversation of the family, h the identifier's checksum modulo ``most``.

    A conversation without turns of its own after that, or of the first one, has a row with a null pos.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumn("h", h)
    first = turns.where((F.col("conv_id") % family == 0) & (F.col("pos") < most - 1))
    first = first.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "turn", "words"))).alias("head"))  # at most so many turns
    convs = sizes.withColumn("base", F.col("conv_id") - F.col("conv_id") % family).join(first, "base", "left")
    convs = convs.select("conv_id", "n", F.expr("slice(coalesce(head, array()), 1, h)").alias("head"), "h")
    own = turns.where(F.col("pos") >= h).withColumn("h", h)
    # Where the first conversation is shorter than h, the rest moves up.
    short = convs.where(F.size("head") < F.col("h")).select("conv_id", (F.col("h") - F.size("head")).alias("lack"))
    own = spread_join(written(own, "own"), short, "conv_id", "left").select("conv_id", (F.col("pos") - F.coalesce("lack", F.lit(0))).alias("pos"), "turn", "words")
    heads = convs.select("conv_id", F.inline("head"))
    none = convs.where((F.size("head") == 0) & (F.col("n") <= F.col("h"))).select("conv_id", F.lit(None).cast("bigint").alias("pos"), F.lit(None).cast("binary").alias("turn"), F.lit(None).cast("int").alias("words"))
    return own.unionByName(heads.select("conv_id", F.col("pos").cast("bigint").alias("pos"), "turn", "words")).unionByName(none)


NODE = pa.schema([
    ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
    ("ends_sha256", pa.string()), ("grp", pa.string()), ("node", pa.string()), ("parent", pa.string()), ("shard", pa.int32()), ("ends", pa.binary()),
])
NODE_DDL = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, grp string, node string, parent string, shard int, ends binary"


def _joined(ids: np.ndarray) -> bytes:
    return ",".join(map(str, ids.tolist())).encode()


def shard_nodes(rows: pd.DataFrame, base: int) -> pa.RecordBatch:
    """A shard's nodes. rows: grp, up (the smallest member of the node that the group hangs on), key, words, conv_id, below (of what hangs under the row's last turn: children, leaves, saved), left and right
    (columns shared with the last row of the shard before and the first of the one after, the group's included)."""
    n = len(rows)
    own = [k[:-WIDTH] if k.endswith(END) else k for k in rows.key]
    size = np.fromiter((len(k) // WIDTH for k in own), np.int64, n)
    ended = np.fromiter((k.endswith(END) for k in rows.key), bool, n)
    width = int(size.max(initial=0))
    flat = np.frombuffer(b"".join(own), ">u8").reshape(-1, WIDTH // 8)
    by = np.lexsort([flat[:, 1], flat[:, 0]])
    new = np.ones(len(by), np.int64)
    new[1:] = (flat[by[1:]] != flat[by[:-1]]).any(1)
    number = np.empty(len(by), np.int64)
    number[by] = np.cumsum(new)
    conv, group = rows.conv_id.to_numpy(np.int64), np.unique(rows.grp.to_numpy(str), return_inverse=True)[1]
    # Columns: group, turns, and whether the conversation ends or goes on in the next stretch; past its end a row holds the largest number.
    matrix = np.full((n, width + 2), len(by) + 1, np.int32)
    matrix[:, 0] = group
    inside = np.arange(width) < size[:, None]
    matrix[:, 1:-1][inside] = number
    words = np.zeros((n, width + 1), np.int64)
    words[:, 1:][inside] = np.concatenate([np.empty(0, np.int64), *rows.words])
    matrix[:, -1] = ended
    order = np.lexsort([conv, *(matrix[:, k] for k in range(width + 1, -1, -1))])
    matrix, words, size, ended, conv = matrix[order], words[order], size[order], ended[order], conv[order]
    below = rows[["below_children", "below_leaves", "below_saved"]].to_numpy(np.int64)[order]
    grp, up = rows.grp.to_numpy(object)[order], rows.up.to_numpy(object)[order]
    left, right = int(rows.left.iloc[0]), int(rows.right.iloc[0])

    change = np.ones((n, width + 1), bool)
    change[1:] = np.logical_or.accumulate(matrix[1:, :-1] != matrix[:-1, :-1], axis=1)
    member = np.arange(width + 1) <= size[:, None]
    starts = change & member
    begun = starts.copy()
    begun[0, :left] = False  # these started in an earlier shard
    at = [np.flatnonzero(starts[:, d]) for d in range(width + 1)]
    n_convs = [np.add.reduceat(member[:, d].astype(np.int64), at[d]) if len(at[d]) else np.empty(0, np.int64) for d in range(width + 1)]
    leaves, saved = np.zeros((n, width + 1), np.int64), np.zeros((n, width + 1), np.int64)
    for d in range(width + 1):
        r = at[d]
        # Rows that go on come first, so a node that its first row ends at has no children.
        leaves[r, d] = begun[r, d] & (size[r] == d) & ended[r]
        saved[r, d] = (n_convs[d] - begun[r, d]) * words[r, d]
    deep = np.flatnonzero(below[:, 0])
    leaves[deep, size[deep]] += below[deep, 1]
    saved[deep, size[deep]] += below[deep, 2]
    leaves, saved = (np.cumsum(x[:, ::-1], 1)[:, ::-1] for x in (leaves, saved))
    children = np.zeros((n, width + 1), np.int64)
    children[:, :-1] = begun[:, 1:]
    children[deep, size[deep]] += below[deep, 0]

    columns: dict[str, list] = {name: [] for name in NODE.names}
    smallest_above = above_last = np.zeros(n, np.int64)
    far = np.iinfo(np.int64).max
    path = {0: own[order[0]], n - 1: own[order[-1]]} if n else {}
    name = functools.cache(lambda r, d: hashlib.sha256(f"{grp[r]}/{base + d}/".encode() + path[r][: d * WIDTH]).hexdigest())
    before_row = np.zeros(n, np.int64)  # first row of the node one column up
    for d in range(width + 1):
        r = at[d]
        if not len(r):
            break
        smallest = np.minimum.reduceat(np.where(member[:, d], conv, far), r)
        sums = [np.add.reduceat(x[:, d], r) for x in (children, leaves, saved)]
        stop = np.append(r[1:], n)
        last = np.add.reduceat(member[:, d].astype(np.int64), r) + r - 1
        ends_here = (size == d) & ended
        n_ends = np.add.reduceat(ends_here.astype(np.int64), r)
        # On the first row's path the node may have begun before, on the last row's it may go on.
        shared_left, shared_right = (r == 0) & (d < left), (last == n - 1) & (d < right)
        split = shared_left | shared_right
        up_row = before_row[r]
        up_split = np.zeros(len(r), bool)
        if d:
            up_split = (((up_row == 0) & (d - 1 < left)) | ((above_last[up_row] == n - 1) & (d - 1 < right))) & (d > 1 or not base)
        which = np.where(shared_left, 0, n - 1)
        parents = smallest_above[up_row] if d else None
        for k in range(len(r)):
            i = int(r[k])
            enders = conv[i : stop[k]][ends_here[i : stop[k]]] if n_ends[k] else conv[:0]
            columns["node"].append(name(int(which[k]), d) if split[k] else None)
            up_path = 0 if up_row[k] == 0 and d - 1 < left else n - 1
            columns["parent"].append(name(up_path, d - 1) if d and up_split[k] else None)
            columns["parent_conv_id"].append(None if not d or up_split[k] else int(parents[k]))
            columns["ends"].append(_joined(enders) if split[k] and n_ends[k] else None)
            columns["ends_sha256"].append(None if split[k] else hashlib.sha256(_joined(enders)).hexdigest() if n_ends[k] else EMPTY)
        columns["conv_id"] += smallest.tolist()
        columns["depth"] += [base + d] * len(r)
        columns["n_convs"] += n_convs[d].tolist()
        for column, values in zip(("n_children", "n_leaves", "saved_tokens"), sums):
            columns[column] += values.tolist()
        columns["grp"] += grp[r].tolist()
        columns["shard"] += [int(rows.shard.iloc[0])] * len(r)
        lead = np.zeros(int(r[0]), np.int64)
        spans = stop - r
        # A group's node is that of the last stretch, whose smallest member is known from there.
        smallest_above = up.astype(np.int64) if base and not d else np.concatenate([lead, np.repeat(smallest, spans)])
        before_row, above_last = np.concatenate([lead, np.repeat(r, spans)]), np.concatenate([lead, np.repeat(last, spans)])
    return pa.RecordBatch.from_pydict(columns, NODE)


def _shared(first: tuple | None, second: tuple | None) -> int:
    """Columns that two rows (grp, key) share from the left, the group's included."""
    if first is None or second is None or first[0] != second[0]:
        return 0
    a, b = (k[:-WIDTH] if k.endswith(END) else k for k in (first[1], second[1]))
    n = 0
    while n + WIDTH <= min(len(a), len(b)) and a[n : n + WIDTH] == b[n : n + WIDTH]:
        n += WIDTH
    return 1 + n // WIDTH


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pair = lambda x: (x["grp"], x["key"]) if x and x["grp"] is not None else None
        rows = batch.to_pylist()
        shared = [[_shared(pair(r[a]), pair(r[b])) for r in rows] for a, b in (("before", "first"), ("last", "after"))]
        yield pa.RecordBatch.from_pydict({"shard": [r["shard"] for r in rows], "left": shared[0], "right": shared[1]}, pa.schema([("shard", pa.int32()), ("left", pa.int32()), ("right", pa.int32())]))


def _hashed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, ends_sha256 of rows (node, shard, ends) in order, one part at a time."""
    schema = pa.schema([("node", pa.string()), ("ends_sha256", pa.string())])
    node, digest = None, None
    for batch in batches:
        done = []
        for name, ends in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if name != node:
                if node is not None:
                    done.append({"node": node, "ends_sha256": digest.hexdigest()})
                node, digest = name, hashlib.sha256(ends)
            else:
                digest.update(b"," + ends)
        yield pa.RecordBatch.from_pylist(done, schema=schema)
    if node is not None:
        yield pa.RecordBatch.from_pylist([{"node": node, "ends_sha256": digest.hexdigest()}], schema=schema)


OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
KEY = ["grp", "key", "conv_id"]


def stretches_of(turns: DataFrame) -> DataFrame:
    """conv_id, k, key, words, more: a conversation's turns DEEP at a time, as digests one after the other, and whether others follow."""
    k = F.coalesce(F.floor(F.col("pos") / DEEP).cast("int"), F.lit(0))
    own = F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "turn", "words"))))  # at most DEEP turns
    rows = turns.groupBy("conv_id", k.alias("k")).agg(own.alias("own"))
    key = F.unhex(F.array_join(F.transform("own", lambda x: F.hex(x["turn"])), ""))
    rows = written(rows.select("conv_id", "k", key.alias("key"), F.col("own.words").alias("words")), "stretches")
    following = rows.where("k > 0").select("conv_id", (F.col("k") - 1).alias("k"), F.lit(True).alias("more"))
    return rows.join(following, ["conv_id", "k"], "left").withColumn("more", F.coalesce("more", F.lit(False)))


def _level(stretches: DataFrame, rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Nodes below the groups of rows (conv_id, grp, up), and what hangs under each group: grp, children, leaves, saved."""
    spark, base = rows.sparkSession, k * DEEP
    rows = written(rows.join(stretches.where(F.col("k") == k), "conv_id"), "level")
    extra: list[DataFrame] = []
    under = rows.withColumns({"below_children": F.lit(0), "below_leaves": F.lit(0), "below_saved": F.lit(0)})
    if not rows.where("more").isEmpty():
        cls = F.sha2(F.concat(F.col("grp").cast("binary"), F.lit("/").cast("binary"), F.col("key")), 256)
        full = rows.where(F.octet_length("key") == DEEP * WIDTH).withColumn("cls", cls)
        smallest = full.groupBy("cls").agg(F.min("conv_id").alias("smallest"), F.count_if("more").alias("n_deep"), F.min(F.when(F.col("more"), F.col("conv_id"))).alias("first_deep"))
        classes = written(smallest.where("n_deep > 0"), "classes")
        deep = written(spread_join(written(full.where("more").select("conv_id", "cls"), "deep"), classes, "cls"), "deep")
        alone = deep.where("n_deep = 1").select("conv_id", "smallest")
        # A conversation alone after a stretch is a chain: a node for each of its other turns.
        rest = stretches.where(F.col("k") > k)
        chain = spread_join(written(rest, "rest"), alone, "conv_id").select("conv_id", "smallest", "k", "more", F.size("words").alias("n"), F.posexplode("words").alias("i", "w"))
        at, end = F.col("k").cast("bigint") * DEEP + F.col("i"), ~F.col("more") & (F.col("i") == F.col("n") - 1)
        extra.append(chain.select(
            "conv_id", (at + 1).alias("depth"), F.when(at == base + DEEP, F.col("smallest")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.lit(1).cast("bigint").alias("n_convs"),
            F.when(end, 0).otherwise(1).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"), F.lit(0).cast("bigint").alias("saved_tokens"),
            F.when(end, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(EMPTY)).alias("ends_sha256"),
        ))
        hung = alone.select("conv_id", F.lit(1).alias("c"), F.lit(1).alias("l"), F.lit(0).alias("s"))
        if not classes.where("n_deep > 1").isEmpty():
            nodes, totals = _level(stretches, deep.where("n_deep > 1").select("conv_id", F.col("cls").alias("grp"), F.col("smallest").alias("up")), k + 1)
            extra.append(nodes)
            hung = hung.unionByName(totals.join(classes, totals.grp == classes.cls).select(F.col("first_deep").alias("conv_id"), F.col("children").alias("c"), F.col("leaves").alias("l"), F.col("saved").alias("s")))
        under = rows.join(hung, "conv_id", "left").select(*rows.columns, *(F.coalesce(a, F.lit(0)).alias(b) for a, b in (("c", "below_children"), ("l", "below_leaves"), ("s", "below_saved"))))
    under = under.withColumn("key", F.when(F.col("more"), F.col("key")).otherwise(F.concat("key", F.lit(END))))
    n = rows.count()
    parts = max(-(-n // SHARD), min(shuffle_partitions(spark), -(-n // LEAST)), 1)
    ranged = written(under.repartitionByRange(parts, *KEY).withColumn("shard", F.spark_partition_id()), "shards")
    edges = ranged.groupBy("shard").agg(F.min(F.struct(*KEY)).alias("first"), F.max(F.struct(*KEY)).alias("last"))
    beside = Window.orderBy("shard")  # a row for each shard
    edges = edges.select("shard", "first", "last", F.lag("last").over(beside).alias("before"), F.lead("first").over(beside).alias("after"))
    shared = edges.mapInArrow(_neighbours, "shard int, left int, right int")
    cut = ranged.join(F.broadcast(shared), "shard")  # three numbers a shard
    nodes = cut.groupBy("shard").applyInArrow(lambda t: pa.Table.from_batches([shard_nodes(t.to_pandas(), base)]), NODE_DDL)
    nodes = written(nodes, "nodes")
    totals = nodes.where(F.col("depth") == base).groupBy("grp").agg(F.sum("n_children").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    split = nodes.where("node IS NOT NULL")
    ends = split.where("ends IS NOT NULL").select("node", "shard", "ends").repartition("node").sortWithinPartitions("node", "shard").mapInArrow(_hashed_ends, "node string, ends_sha256 string")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    once = [F.min(c).alias(c) for c in ("conv_id", "depth", "parent_conv_id", "parent")]
    split = split.groupBy("node").agg(*once, *sums).join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
    split = written(split, "split")
    tops = split.select(F.col("node").alias("parent"), F.col("conv_id").alias("top"))
    whole = nodes.where("node IS NULL")
    names = [*OUT, "parent"]
    lost = written(whole.where("parent IS NOT NULL").select(names).unionByName(split.where("parent IS NOT NULL").select(names)), "lost")
    found = spread_join(lost, tops, "parent").withColumn("parent_conv_id", F.col("top"))
    known = whole.where("parent IS NULL").select(OUT).unionByName(split.where("parent IS NULL").select(OUT))
    out = known.unionByName(found.select(OUT))
    if base:
        out = out.where(F.col("depth") > base)  # the groups themselves are nodes of the last stretch
    return functools.reduce(DataFrame.unionByName, extra, out), totals


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The nodes of the trie of turns (conv_id, pos from 0, turn, words; a null pos for a conversation without turns): conv_id of the smallest member, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. An empty input has no nodes, not even a root."""
    stretches = written(stretches_of(turns), "stretches")
    first = stretches.where("k = 0").select("conv_id", F.lit("").alias("grp"), F.lit(None).cast("bigint").alias("up"))
    return _level(stretches, first, 0)[0]


def conversation_trie(conversations: DataFrame, rebuilt: bool = False) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text), as they are or rebuilt with the shared beginnings of their families.

    Null roles and texts are empty ones; turns without a number come first; turns of one number, and repeated rows, are in order of their digests and count each;
    rows without a conv_id are left out; an empty input has no nodes; other columns play no part. Texts are digested whole.
    """
    turns = numbered_turns(conversations)
    return prefix_trie(heads_shared(turns) if rebuilt else turns)


def op12(spark, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"), rebuilt=True)


OP12_SQL = f"""
WITH {CRC_SQL},
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))[:32] AS id
  FROM conversations WHERE conv_id IS NOT NULL
),
numbered AS (SELECT conv_id, id, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) - 1 AS pos FROM turns),
sizes AS (SELECT conv_id, count(*) AS n FROM numbered GROUP BY 1),
convs AS (SELECT s.conv_id, least({crc_sql("s.conv_id::VARCHAR")} % 4, coalesce(b.n, 0)) AS k, {crc_sql("s.conv_id::VARCHAR")} % 4 AS h FROM crc_table, sizes s LEFT JOIN sizes b ON b.conv_id = s.conv_id - s.conv_id % 20),
rebuilt AS (
  SELECT c.conv_id, pos, id, words FROM convs c JOIN numbered n ON n.conv_id = c.conv_id - c.conv_id % 20 AND n.pos < c.h
  UNION ALL SELECT conv_id, pos - h + k, id, words FROM convs JOIN numbered USING (conv_id) WHERE pos >= h
),
lists AS (SELECT conv_id, coalesce(list(id ORDER BY pos), []) AS ids, coalesce(list(words ORDER BY pos), []) AS words FROM (SELECT conv_id FROM convs) LEFT JOIN rebuilt USING (conv_id) GROUP BY 1),
clean AS (SELECT conv_id, list_filter(ids, lambda x: x IS NOT NULL) AS ids, list_filter(words, lambda x: x IS NOT NULL) AS words FROM lists),
steps AS (SELECT conv_id, len(ids) AS size, unnest(range(0, len(ids) + 1)) AS depth, ids, words FROM clean),
paths AS (SELECT conv_id, size, depth, sha256(array_to_string(ids[:depth], ',')) AS node, CASE WHEN depth > 0 THEN sha256(array_to_string(ids[:depth - 1], ',')) END AS parent, CASE WHEN depth > 0 THEN words[depth] ELSE 0 END AS w FROM steps),
nodes AS (
  SELECT node, parent, depth, w, min(conv_id) AS conv_id, count(*) AS n_convs, bool_and(size = depth) AS leaf, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256
  FROM paths GROUP BY ALL
),
under AS (
  SELECT p.node, count(*) FILTER (n.leaf) AS n_leaves, sum((n.n_convs - 1) * n.w)::BIGINT AS saved_tokens, count(*) FILTER (n.parent = p.node) AS n_children
  FROM nodes n JOIN paths p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY 1
)
SELECT n.conv_id, n.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, saved_tokens, n.ends_sha256
FROM nodes n JOIN under USING (node) LEFT JOIN nodes q ON q.node = n.parent
"""
