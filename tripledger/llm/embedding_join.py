"""Near-duplicate embeddings by an exact metric range join.

A cosine of c between two vectors is a distance of sqrt(2 - 2c) between their unit vectors, so links are a range
join in a metric space. Pivots, from a bounded sample, cut the space into cells, each vector being at home in the
cell of its nearest pivot. A vector also visits every cell that the triangle inequality does not rule out: one
whose bisector with its own cell is within the range, and whose nearest and farthest residents' distances from
their pivot leave room. Small cells that lie side by side share a block, large ones are cut into several; a vector goes
once to each block of a cell that it visits. Each pair of blocks is a join of its own, of the vectors at home in the one that visit
the other and the other way round: the first kind is held, the second streams past. Two vectors meet in the pair of their homes only, where a link counts
for both, so each is counted once, and no pairs are emitted. Nothing is approximate: where
the pivots cannot rule cells out, as for directions spread evenly over many dimensions, every block is visited.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripledger.llm.common import written
from tripledger.llm.components import classes

THRESHOLD = 0.9
#: Residents of a block: at most so many, of at most so many bytes; fewer where the vectors are few, so that all cores have a pair of blocks, but not under LEAST.
BLOCK, BLOCK_BYTES, LEAST = 65_536, 64 << 20, 1024
#: Pivots come from at most so many vectors, there are at most so many of them, and one for so many vectors.
SAMPLE, MOST_PIVOTS, CELL = 8192, 1024, 256
#: Tasks at most; each has a pair of blocks, or several.
MOST_TASKS = 1 << 17
#: Cosines held at once.
STRIP, COSINES = 1024, 1 << 22
#: Room for rounding in the bounds that rule cells out.
SLACK = 1e-9


def unit(raw: list[bytes], dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), "<f8" if raw and len(raw[0]) == 8 * dim else "<f4").astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def with_nodes(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, node, dim and raw for every row; all but id are null where a vector cannot be linked."""
    single = dict(vectors.dtypes)[vec_col] == "array<float>"
    kind = "<f4" if single else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, dims, raws = [], [], []
            for value in batch.column(1):
                raw = None
                if value.is_valid and len(value) and not value.values.null_count:
                    x = np.asarray(value.values.to_numpy(zero_copy_only=False), kind)
                    if np.isfinite(x).all() and x.any():
                        raw = (x + x.dtype.type(0)).tobytes()  # -0 and 0 are one
                nodes.append(xxhash.xxh3_128_digest(raw) if raw else None)
                dims.append(len(raw) // (4 if single else 8) if raw else None)
                raws.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.binary()), pa.array(dims, pa.int32()), pa.array(raws, pa.binary())], ["id", "node", "dim", "raw"])

    kept = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<float>" if single else "array<double>").alias("v"))
    return kept.mapInArrow(run, "id bigint, node binary, dim int, raw binary")


def pivots_for(nodes: DataFrame, dim: int, n: int) -> np.ndarray:
    """Centres of a few rounds of k-means over a bounded sample, by hash."""
    share = min(1.0, 1.5 * SAMPLE / max(1, n))
    hashed = F.xxhash64("node").bitwiseAND(F.lit((1 << 62) - 1))
    got = nodes.select(hashed.alias("h"), "raw").where(F.col("h") <= F.lit(int(share * (1 << 62)))).orderBy("h", "raw").limit(SAMPLE).collect()
    x = unit([bytes(r["raw"]) for r in got], dim)
    k = max(1, min(MOST_PIVOTS, -(-n // CELL), len(x)))
    centres = x[:k].copy()
    for _ in range(4):
        near = (x @ centres.T - 0.5 * (centres * centres).sum(1)).argmax(1)
        for j in range(k):
            if (near == j).any():
                centres[j] = x[near == j].mean(0)
    return centres


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T))


def _column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def residents(nodes: DataFrame, pivots: np.ndarray, dim: int) -> list:
    """cell, n, nearest and farthest resident's distance: a row for each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = distances(unit(_column(batch, "raw"), dim), pivots)
                yield pa.RecordBatch.from_arrays([pa.array(d.argmin(1), pa.int32()), pa.array(d.min(1))], ["cell", "d"])

    return nodes.select("raw").mapInArrow(run, "cell int, d double").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("near"), F.max("d").alias("far")).collect()


def blocks_of(pivots: np.ndarray, counts: np.ndarray, size: int) -> list[list[int]]:
    """The blocks of each cell. Cells are lined up along the direction in which pivots differ most and fill blocks of ``size`` residents evenly."""
    middle = pivots - pivots.mean(0)
    along = middle @ np.linalg.svd(middle, full_matrices=False)[2][0]
    total = max(1, int(counts.sum()))
    blocks = -(-total // size)
    out: list[list[int]] = [[] for _ in counts]
    before = 0
    for cell in np.argsort(along, kind="stable").tolist():
        n = int(counts[cell])
        first = min(blocks - 1, before * blocks // total)
        last = max(first, (before + n - 1) * blocks // total) if n > size else first
        out[cell] = list(range(first, last + 1))
        before += n
    return out


def pair_of(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Pairs of blocks, a block with itself included, by number."""
    return high.astype(np.int64) * (high + 1) // 2 + low


def _dealer(pivots: np.ndarray, cells: list, reach: float, dim: int, size: int):
    """Rows of each vector for the pair of its home with itself and with every other block that it must visit.

    side: 0 at home in its own pair, else 1 for the vectors of the pair's lower block, 2 for those of its upper one.
    """
    n = np.zeros(len(pivots), np.int64)
    near, far = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
    for c in cells:
        n[c["cell"]], near[c["cell"]], far[c["cell"]] = c["n"], c["near"], c["far"]
    blocks = blocks_of(pivots, n, size)
    in_block = np.zeros((len(pivots), max(b for own in blocks for b in own) + 1), bool)
    for cell, own in enumerate(blocks):
        in_block[cell, own] = n[cell] > 0
    first, several = np.array([own[0] for own in blocks]), np.array([len(own) for own in blocks], np.uint64)
    apart = np.maximum(distances(pivots, pivots), 1e-12)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, STRIP):
                batch = whole.slice(lo, STRIP)
                nodes, copies, raws = (_column(batch, c) for c in ("node", "copies", "raw"))
                d = distances(unit(raws, dim), pivots)
                home = d.argmin(1)
                rows = np.arange(len(home))
                beyond = (d**2 - d[rows, home][:, None] ** 2) / (2 * apart[home])
                beyond[rows, home] = 0
                open_ = (n > 0) & (beyond <= reach + SLACK) & (d <= far + reach + SLACK) & (d >= near - reach - SLACK)
                open_[rows, home] = True
                visited = open_.astype(np.float32) @ in_block.astype(np.float32) > 0
                own = first[home] + (np.fromiter((xxhash.xxh3_64_intdigest(x) for x in nodes), np.uint64, len(nodes)) % several[home]).astype(np.int64)
                visited[rows, own] = True
                i, block = np.nonzero(visited)
                low, high = np.minimum(block, own[i]), np.maximum(block, own[i])
                side = np.where(low == high, 0, np.where(own[i] == low, 1, 2))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pair_of(low, high), pa.int64()), pa.array(side, pa.int32()), *(pa.array(x, t).take(pa.array(i)) for x, t in ((nodes, pa.binary()), (copies, pa.int64()), (raws, pa.binary())))],
                    ["pair", "side", "node", "copies", "raw"],
                )

    return run


class Residents:
    """What a pair of blocks holds, its links so far, and which of it is joined, by links inside it or through what has streamed past."""

    def __init__(self, key: int):
        self.key, self.nodes, self.copies, self.raws, self.x = key, [], [], [], None

    def settle(self, dim: int, threshold: float, inside: bool) -> None:
        """inside: whether those held are to be linked with one another, as in a block's pair with itself."""
        self.x, self.copies = unit(self.raws, dim), np.asarray(self.copies, np.int64)
        self.raws, self.links, self.root = [], np.zeros(len(self.nodes), np.int64), np.arange(len(self.nodes))
        strip = max(1, COSINES // max(1, len(self.nodes)))
        for lo in range(0, len(self.nodes) if inside else 0, strip):
            link = self.x[lo : lo + strip] @ self.x.T >= threshold
            own = lo + np.arange(len(link))
            link[np.arange(len(link)), own] = False
            self.links[lo : lo + strip] += link @ self.copies
            link[np.arange(len(link)), own] = True
            self.unite(link)

    def unite(self, link: np.ndarray) -> None:
        """Joins the residents that a row of link marks, for all rows at once: each root that a row touches goes to the smallest of the row, until no row touches two."""
        link = link[link.any(1)]
        while len(link):
            apart = link & (self.root != self.root[link.argmax(1)][:, None])
            link, apart = link[apart.any(1)], apart[apart.any(1)]
            if not len(link):
                return
            i, j = np.nonzero(apart)
            starts = np.flatnonzero(np.diff(i, prepend=-1))
            first = self.root[link.argmax(1)]
            least = np.minimum(np.minimum.reduceat(self.root[j], starts), first)
            to = np.arange(len(self.root))
            np.minimum.at(to, self.root[j], least[i])
            np.minimum.at(to, first, least)
            while (to[to] != to).any():
                to = to[to]
            self.root = to[self.root]

    def meet(self, nodes: list[bytes], copies: np.ndarray, x: np.ndarray, threshold: float) -> Iterator[tuple[bytes, bytes, int]]:
        """What streams past, tied to one of those held each, with its links."""
        strip = max(1, COSINES // len(self.nodes))
        for lo in range(0, len(nodes), strip):
            link = x[lo : lo + strip] @ self.x.T >= threshold
            self.links += copies[lo : lo + strip] @ link
            self.unite(link)
            near, own = link.argmax(1), link @ self.copies
            for i in np.flatnonzero(own):
                yield nodes[lo + i], self.nodes[near[i]], int(own[i])

    def ties(self) -> Iterator[tuple[bytes, bytes, int]]:
        for i in np.flatnonzero(self.links):
            yield self.nodes[i], self.nodes[self.root[i]], int(self.links[i])


def _joiner(dim: int, threshold: float):
    """Over rows sorted by pair and side."""

    def batch_of(rows: list) -> pa.RecordBatch:
        a, b, links = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(links, pa.int64())], ["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: Residents | None = None
        inside = False

        def left() -> list:
            """The ties of the pair that ends here."""
            if at is None:
                return []
            if at.x is None and inside:
                at.settle(dim, threshold, inside)
            return [] if at.x is None else list(at.ties())

        for batch in batches:
            k = np.array([_column(batch, c) for c in ("pair", "side")]).reshape(2, -1)
            cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                part, (pair, side) = batch.slice(lo, hi - lo), k[:, lo].tolist()
                nodes, copies, raws = (_column(part, c) for c in ("node", "copies", "raw"))
                if at is None or at.key != pair:
                    if rows := left():
                        yield batch_of(rows)
                    at, inside = Residents(pair), side == 0
                if side < 2:
                    at.nodes += nodes
                    at.copies += copies
                    at.raws += raws
                    continue
                if not at.nodes:
                    continue  # nothing of the other block could be near
                if at.x is None:
                    at.settle(dim, threshold, inside)
                if rows := list(at.meet(nodes, np.asarray(copies, np.int64), unit(raws, dim), threshold)):
                    yield batch_of(rows)
        if rows := left():
            yield batch_of(rows)

    return run


def embedding_classes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """id, node, class_id, n_links and kept for every row.

    Two rows are linked where the cosine of their vectors, in double precision, is at least ``threshold``; vectors
    of different lengths never are. ``n_links`` counts the other rows linked directly, copies included; a class is
    what links reach, its id the smallest identifier in it. Vectors that are null, empty or zero, or hold null or
    non-finite components, are linked with nothing. A null identifier is never a class's id unless the whole class has none.
    An empty input gives an empty result; other columns play no part.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0 and at most 1")
    rows = written(with_nodes(vectors, id_col, vec_col), "vectors")
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.first("dim").alias("dim"), F.first("raw").alias("raw"))
    nodes = written(nodes, "nodes")
    reach = float(np.sqrt(2 - 2 * threshold))
    found = nodes.sparkSession.createDataFrame([], "a binary, b binary, links bigint")
    for (dim, n) in sorted((r["dim"], r["n"]) for r in nodes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()):
        own = nodes.where(F.col("dim") == dim).select("node", "copies", "raw")
        pivots = pivots_for(own, dim, n)
        at_once = -(-n // max(1, int(np.ceil(np.sqrt(2 * own.sparkSession.sparkContext.defaultParallelism)))))
        size = min(BLOCK, max(1, BLOCK_BYTES // (8 * dim)), max(LEAST, at_once))
        blocks = -(-n // size)
        tasks = min(blocks * (blocks + 1) // 2, MOST_TASKS)
        dealt = own.mapInArrow(_dealer(pivots, residents(own, pivots, dim), reach, dim, size), "pair bigint, side int, node binary, copies bigint, raw binary")
        joined = dealt.repartitionById(tasks, (F.col("pair") % tasks).cast("int")).sortWithinPartitions("pair", "side").mapInArrow(_joiner(dim, threshold), "a binary, b binary, links bigint")
        found = found.unionByName(joined)
    return classes(rows, nodes, written(found, "found"))


def op2(spark, sf_dir: str) -> DataFrame:
    from tripledger.llm.common import table

    out = embedding_classes(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("class_id").alias("component_id"), "kept")


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), g AS (
  SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), r AS (
  SELECT a AS vec_id, a AS reached FROM l UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.reached = l.a
), c AS (
  SELECT vec_id, min(reached) AS least FROM r GROUP BY 1
), n AS (
  SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1
)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.least, v.vec_id) AS component_id, coalesce(c.least, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
