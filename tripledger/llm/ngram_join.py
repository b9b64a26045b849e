"""N-gram Jaccard self-join by MinHash banding, verified on the full n-gram sets.

1. Texts with the same words in the same order are one node; what follows compares nodes, so copies cost nothing.
2. A node's MinHash signature is cut into bands; band and row counts are the cheapest that reach the target recall
   at the threshold. Nodes that agree on a band's hash share a bucket. Buckets with the same members are one.
3. The words of nodes that share a bucket are sent to their buckets, compressed, and every pair in a bucket is
   verified on its full sets: small buckets set by set, large ones by counting common n-grams in matrices. A bucket
   of more than ``BLOCK`` nodes or ``BLOCK_WORDS`` words is cut into blocks, and each pair of blocks is a task of its own. Pairs are not
   emitted: a task returns each node's number of links, counting a pair only in the first bucket that the two
   share, and ties it to one node of its group.
4. Ties become classes by distributed connected components.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripledger.llm.common import lean, spread_join, written
from tripledger.llm.components import classes

NGRAM, THRESHOLD, RECALL, SEED = 5, 0.8, 0.9999, 20_240_601
BLOCK, BLOCK_WORDS = 1000, 1_000_000
#: A bucket of n nodes has sqrt(n) / SPREAD blocks at least, so that its pairs are not one task.
SPREAD = 8
WORD = re.compile(r"\w+")
MIX = np.uint64(0x9E3779B97F4A7C15)


def bands_for(threshold: float, recall: float, most_hashes: int = 256) -> tuple[int, int]:
    """Bands and rows: the most rows, so the fewest chance candidates, that 20 bands or fewer can reach the recall with."""
    best = None
    for rows in range(1, 17):
        miss = 1 - threshold**rows
        bands = max(1, int(np.ceil(np.log(1 - recall) / np.log(miss)))) if miss < 1 else 1
        if bands <= 20 and bands * rows <= most_hashes:
            best = (bands, rows)
    return best or (int(np.ceil(np.log(1 - recall) / np.log(1 - threshold))), 1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def node_of(words: list[str]) -> bytes | None:
    """The key of a word sequence; None without words."""
    return xxhash.xxh3_128_digest("\x00".join(words).encode()) if words else None


def ngrams(words: list[str], n: int) -> np.ndarray:
    """The distinct n-grams as 64-bit hashes, ascending; fewer than n words are one n-gram."""
    known: dict[str, int] = {}
    h = np.fromiter((known[w] if w in known else known.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words), np.uint64, len(words))
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = mixed(out * MIX + h[k : k + len(out)])
    return np.unique(out)


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    a = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(grams), 4096):
        least = np.minimum(least, (mixed(grams[lo : lo + 4096, None] * a + b)).min(0))
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        out = mixed(out * MIX + least.reshape(bands, rows)[:, k])
    return out.view(np.int64)


def with_nodes(docs: DataFrame, id_col: str, text_col: str, n: int, bands: int, rows: int) -> DataFrame:
    """id, node, n_words and bands for every row; node and bands are null where a text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, hashes = [], [], []
            for value in batch.column(1):
                words = words_of(value.as_py())
                nodes.append(node_of(words))
                sizes.append(len(words))
                hashes.append(band_hashes(ngrams(words, n), bands, rows) if words else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], ["id", "node", "n_words", "bands"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(run), "id bigint, node binary, n_words bigint, bands array<bigint>")


def with_words(docs: DataFrame, text_col: str) -> DataFrame:
    """node and its compressed words for every row that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, packs = [], []
            for value in batch.column(0):
                if words := words_of(value.as_py()):
                    nodes.append(node_of(words))
                    packs.append(zstandard.ZstdCompressor(level=3).compress(" ".join(words).encode()))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(packs, pa.binary())], ["node", "words"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(lean(run), "node binary, words binary")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets share."""
    n = len(sets)
    out = np.zeros((n, n), np.float32)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, code, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(code, kind="stable")
    owner, starts = owner[order], np.concatenate([[0], np.cumsum(df)[:-1]])
    for k in range(2, 17):  # rare elements: their pairs one by one
        at = starts[df == k]
        if len(at):
            rows = owner[at[:, None] + np.arange(k)]
            for i in range(k):
                for j in range(i + 1, k):
                    np.add.at(out, (rows[:, i], rows[:, j]), 1)
    out += out.T
    frequent = np.flatnonzero(df > 16)
    for lo in range(0, len(frequent), 2048):
        part = frequent[lo : lo + 2048]
        m = np.zeros((n, len(part)), np.float32)
        at = np.concatenate([starts[c] + np.arange(df[c]) for c in part])
        m[owner[at], np.repeat(np.arange(len(part)), df[part])] = 1
        out += m @ m.T
    return out


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which two sets have a Jaccard similarity of the threshold or more."""
    size = np.array([len(s) for s in sets], np.float64)
    if len(sets) <= 4:
        common = np.zeros((len(sets), len(sets)))
        for i in range(len(sets)):
            for j in range(i + 1, len(sets)):
                if min(size[i], size[j]) >= threshold * max(size[i], size[j]) - 1e-9:
                    common[i, j] = common[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        common = common_counts(sets).astype(np.float64)
    out = (common >= threshold * (size[:, None] + size[None] - common) - 1e-9) & (common > 0)
    np.fill_diagonal(out, False)
    return out


def roots_of(link: np.ndarray) -> np.ndarray:
    """The first member that each member reaches inside a group."""
    n = len(link)
    root = np.full(n, -1)
    for i in range(n):
        if root[i] < 0:
            root[i], edge = i, [i]
            while edge:
                near = np.flatnonzero(link[edge].any(0) & (root < 0))
                root[near] = i
                edge = near.tolist()
    return root


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal keys of a sorted partition."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        k = np.stack([t.column(c).to_numpy() for c in keys])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1).tolist(), t.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            key = tuple(k[:, lo].tolist())
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(t.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.concat_tables(held)


def _verifier(n: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        for group in groups_of(batches, ["bucket", "p", "q"]):
            bucket, p, q = (group.column(c)[0].as_py() for c in ("bucket", "p", "q"))
            nodes, own, copies = group.column("node").to_pylist(), group.column("own").to_numpy(), group.column("copies").to_numpy()
            if len(nodes) < 2 or (p != q and (own == own[0]).all()):
                continue
            sets = [ngrams(opener.decompress(w.as_py()).decode().split(" "), n) for w in group.column("words")]
            link = linked(sets, threshold)
            if p != q:
                link &= own[:, None] != own[None]
            if not link.any():
                continue
            # A pair counts in the first bucket that its nodes share.
            counts = link.copy()
            earlier: dict[int, list[int]] = {}
            for i, shared in enumerate(group.column("buckets").to_pylist()):
                for b in shared:
                    if b < bucket:
                        earlier.setdefault(b, []).append(i)
            for members in earlier.values():
                if len(members) > 1:
                    counts[np.ix_(members, members)] = False
            some = np.flatnonzero(link.any(1))
            root = roots_of(link)
            yield pa.RecordBatch.from_arrays(
                [pa.array([nodes[i] for i in some], pa.binary()), pa.array([nodes[root[i]] for i in some], pa.binary()), pa.array((counts @ copies)[some], pa.int64())],
                ["a", "b", "links"],
            )

    return run


def ngram_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """id, node, class_id, n_links and kept for every row.

    Words are runs of letters, digits and underscores, lower-cased; a text with fewer than n words has one n-gram.
    Two rows are linked where their n-gram sets have a Jaccard similarity of at least ``threshold``; ``n_links``
    counts the other rows linked directly, copies included. A class is what links reach; its id is its smallest
    identifier, and rows with that identifier are kept. A null, empty or wordless text is linked with nothing. A null
    identifier is never a class's id unless the whole class has none. Rows that repeat identifier and text are copies. An empty
    input gives an empty result; other columns play no part.
    """
    bands, rows = bands_for(threshold, recall)
    signed = written(with_nodes(docs, id_col, text_col, n, bands, rows), "signatures")
    nodes = signed.where("node is not null").groupBy("node").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.first("n_words").alias("n_words"), F.first("bands").alias("bands"))
    nodes = written(nodes, "nodes")
    members = nodes.select("node", "n_words", F.explode("bands").alias("bucket"))
    size = F.count(F.lit(1))
    blocks = F.greatest(F.ceil(size / F.lit(BLOCK)), F.ceil(F.sum("n_words") / F.lit(BLOCK_WORDS)), F.ceil(F.sqrt(size) / F.lit(SPREAD))).cast("int")
    buckets = members.groupBy("bucket").agg(size.alias("size"), blocks.alias("blocks"), F.expr("bit_xor(xxhash64(node))").alias("x"), F.expr("bit_xor(xxhash64(node, 1))").alias("y"))
    buckets = buckets.where("size > 1").groupBy("size", "blocks", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "blocks")
    shared = spread_join(members.select("node", "bucket"), written(buckets, "buckets"), "bucket").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("bucket", "blocks"))).alias("shared"))
    shared = written(shared.join(nodes.select("node", "copies"), "node"), "shared")

    words = shared.join(with_words(docs, text_col).dropDuplicates(["node"]), "node")
    dealt = words.select("node", "copies", "words", F.col("shared.bucket").alias("buckets"), F.explode("shared").alias("in")).withColumn("blocks", F.col("in.blocks"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(F.col("in.bucket").alias("bucket"), F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "node", "copies", "buckets", "words")
    found = dealt.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q").mapInArrow(_verifier(n, threshold), "a binary, b binary, links bigint")
    found = written(found, "found")

    return classes(signed, nodes, found)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without the rows that are not kept, with docs' columns: one row of each class.

    Null, empty and wordless texts are in no class and all stay. Of rows that repeat identifier and words, one stays. A class whose
    rows have no identifier keeps one of them. An empty input gives an empty result; columns may have any names.
    """
    found = written(ngram_classes(docs, id_col, text_col, **how).where("node is not null").groupBy("id", "node", "kept").count(), "classes")
    gone, again = found.where("not kept"), found.where("kept and count > 1")
    at = docs.columns.index(text_col)
    names = [f"c{i}" for i in range(len(docs.columns))]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([node_of(words_of(t.as_py())) for t in batch.column(at)], pa.binary())], [*names, "_node"])

    rows = docs.toDF(*names)
    rows = rows.mapInArrow(lean(keyed), T.StructType([*rows.schema.fields, T.StructField("_node", T.BinaryType())]))
    own = f"c{docs.columns.index(id_col)}"
    same = lambda other: F.col(own).eqNullSafe(other["id"]) & (F.col("_node") == other["node"])
    listed = gone.unionByName(again).select("id", "node")
    once = rows.join(listed, same(listed), "left_anti")
    twice = rows.join(again.select("id", "node"), same(again), "left_semi").dropDuplicates([own, "_node"])
    return once.unionByName(twice).select(*names).toDF(*docs.columns)


def op6(spark, sf_dir: str) -> DataFrame:
    from tripledger.llm.common import table

    return ngram_classes(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id", "n_links", "kept")


OP6_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS grams FROM t WHERE len(w) > 0
), g AS (
  SELECT doc_id, len(grams) AS size, md5(array_to_string(list_sort(grams), '|')) AS same, grams FROM s
), d AS (
  SELECT same, min(doc_id) AS node, any_value(size) AS size, any_value(grams) AS grams, count(*) AS copies FROM g GROUP BY 1
), e AS (
  SELECT node, size, unnest(grams) AS gram FROM d
), p AS (
  SELECT x.node AS a, y.node AS b FROM e x JOIN e y ON x.gram = y.gram AND x.node <> y.node GROUP BY 1, 2, x.size, y.size
  HAVING count(*) >= 0.8 * (x.size + y.size - count(*)) - 1e-9
), r AS (
  SELECT a AS node, a AS reached FROM p UNION SELECT r.node, p.b FROM r JOIN p ON r.reached = p.a
), c AS (
  SELECT node, min(reached) AS class_id FROM r GROUP BY 1
), n AS (
  SELECT a AS node, sum(copies)::BIGINT AS n FROM p JOIN d ON d.node = p.b GROUP BY 1
), o AS (
  SELECT g.doc_id, coalesce(c.class_id, d.node) AS class_id, d.copies - 1 + coalesce(n.n, 0) AS n_links FROM g JOIN d USING (same) LEFT JOIN c USING (node) LEFT JOIN n USING (node)
)
SELECT documents.doc_id, coalesce(o.class_id, documents.doc_id) AS class_id, coalesce(o.n_links, 0)::BIGINT AS n_links, documents.doc_id = coalesce(o.class_id, documents.doc_id) AS kept
FROM documents LEFT JOIN o USING (doc_id)
"""
