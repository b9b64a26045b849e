"""Toxicity by a factorization machine over hashed terms.

A text is the set of its hashed lower-case terms. The machine scores w0 + sum w_i + sum_{i<j} <v_i, v_j> over
the terms present, so that a pair such as an insult beside the mention of a group has a weight of its own, which
a linear model cannot give it. It is fitted in numpy on a bounded sample of labelled rows.

Which terms carry weights is decided by likelihood-ratio tests over all candidates, so that long clean texts do not
gather chance weight: a term is taken if its presence depends on the label, and so are both terms of a pair whose
joint presence tells more than what is known of each, such as two terms that are neutral by themselves. All pairs of
terms that are frequent enough to pass at all are tested, in tiles that Spark deals to its tasks. The pull on the
factors is chosen on rows kept back. Scoring reads every whole text on the executors.

The sample comes to the driver in pieces and lies there once, as 32-bit numbers in one array; what is made of it is made lot by lot.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripledger.llm.blocks import gathered
from tripledger.llm.common import lean, written

#: At most so many labelled rows are learnt from, and so many (row, term) entries: those with the lowest hashes.
TRAIN_ROWS, TRAIN_TERMS = 20_000, 6_000_000
#: The sample's bytes that come to the driver at once, about, and its rows that are worked on at once.
PIECE, LOT = 1 << 20, 512
BUCKETS = 1 << 22
#: Added to the tests' bounds: the chance that any unrelated term, or pair, passes is about exp(-MARGIN / 2).
MARGIN = 6.0
#: A pair must move the label's share by so much.
SHIFT = 0.25
#: Terms of a tile of pairs.
TILE = 512
FACTORS, STEPS, BATCH, RATE, SEED = 8, 800, 256, 0.2, 7
#: Pulls towards zero: on single terms, and those tried on the factors.
DECAY, PAIR_DECAYS = 1e-5, (1e-5, 1e-4, 1e-3)


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the identifier as text, modulo folds; a null identifier counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(folds))


def terms_of(text: str | None) -> np.ndarray:
    """The distinct hashed terms of a whole text, ascending."""
    import re

    words = set(re.findall(r"[^\W_]+", (text or "").lower()))
    return np.unique(np.fromiter((zlib.crc32(w.encode()) % BUCKETS for w in words), np.int32, len(words)))


def _sigmoid(m):
    return 1 / (1 + np.exp(-np.clip(m, -30, 30)))


class Rows:
    """Sparse 0/1 rows: the numbers of each row's terms, one row after the other; ends has one more than there are rows."""

    def __init__(self, terms: np.ndarray, ends: np.ndarray):
        self.terms, self.ends = terms, ends

    def __len__(self) -> int:
        return len(self.ends) - 1

    def lots(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For lots of rows: the first one's number, the entries' terms, and the ends counted from the lot's own start."""
        for lo in range(0, len(self), LOT):
            ends = self.ends[lo : lo + LOT + 1]
            yield lo, self.terms[ends[0] : ends[-1]], ends - ends[0]

    def among(self, terms: np.ndarray, numbers: np.ndarray | None = None) -> Rows:
        """The entries that are among some ascending terms, each as its place there, or as the number at that place."""
        packed, n = array("i"), [np.zeros(1, np.int64)]
        for _, part, ends in self.lots():
            at = np.searchsorted(terms, part)
            found = terms[np.minimum(at, len(terms) - 1)] == part if len(terms) else np.zeros(len(part), bool)
            n.append(np.diff(np.concatenate([[0], np.cumsum(found)])[ends]))
            at = at[found] if numbers is None else numbers[at[found]]
            packed.frombytes(at.astype(np.int32).tobytes())
        return Rows(np.frombuffer(packed, np.int32), np.cumsum(np.concatenate(n)))

    def counts(self, which: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """How many of some rows hold each of the ascending terms, which are all that these rows have."""
        n = np.zeros(len(terms), np.int64)
        for lo in range(0, len(which), LOT):
            found, times = np.unique(self.lot(which[lo : lo + LOT])[1], return_counts=True)
            n[np.searchsorted(terms, found)] += times
        return n

    def lot(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries of some rows: for each the row's place in the lot, and its term."""
        n = self.ends[which + 1] - self.ends[which]
        return np.repeat(np.arange(len(which)), n), gathered(self.terms, self.ends, which)


def _summed(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Rows of values summed by place."""
    return np.stack([np.bincount(at, values[:, k], n) for k in range(values.shape[1])], 1)


@dataclass
class Machine:
    terms: np.ndarray  # hashed terms, ascending
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margin(self, found: np.ndarray) -> float:
        """found: a text's distinct hashed terms; those the machine does not know count for nothing."""
        at = np.searchsorted(self.terms, found)
        at = at[(at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == found)] if len(self.terms) else at[:0]
        v = self.factors[at]
        s = v.sum(0)
        return self.bias + float(self.linear[at].sum()) + 0.5 * float((s * s).sum() - (v * v).sum())

    def score(self, text: str | None) -> float:
        return float(_sigmoid(self.margin(terms_of(text))))


def _part(observed, expected):
    return np.where(observed > 0, observed * np.log(np.maximum(observed, 1e-12) / np.maximum(expected, 1e-12)), 0)


def deviance(n, pos, share):
    """How far pos of n rows are from a known share: a likelihood ratio, chi-square with one degree of freedom."""
    return 2 * (_part(pos, n * share) + _part(n - pos, n * (1 - share)))


def dependent_terms(n: np.ndarray, pos: np.ndarray, total: int, positives: int) -> np.ndarray:
    """Which terms' presence depends on the label: G beyond what the best of as many unrelated terms would reach."""
    share = positives / total
    g = deviance(n, pos, share) + deviance(total - n, positives - pos, share)
    return g > 2 * np.log(max(2, len(n))) + MARGIN


class Columns:
    """The same rows by term: the rows that hold each term, ascending."""

    def __init__(self, rows: Rows, y: np.ndarray, n: np.ndarray):
        """n: how many rows hold each term."""
        self.starts = np.concatenate([[0], np.cumsum(n)])
        self.rows = np.empty(len(rows.terms), np.int32)
        self.y = y.astype(bool)
        free = self.starts[:-1].copy()
        for lo, part, ends in rows.lots():
            order = np.argsort(part, kind="stable")
            found, times = np.unique(part, return_counts=True)
            place = np.arange(len(part)) + np.repeat(free[found] - np.cumsum(times) + times, times)
            self.rows[place] = lo + np.repeat(np.arange(len(ends) - 1), np.diff(ends))[order]
            free[found] += times

    def dense(self, lo: int, hi: int) -> np.ndarray:
        out = np.zeros((len(self.y), hi - lo), np.float32)
        a, b = self.starts[lo], self.starts[hi]
        out[self.rows[a:b], np.repeat(np.arange(hi - lo), np.diff(self.starts[lo : hi + 1]))] = 1
        return out


def interacting(of: Columns, known: np.ndarray, share: np.ndarray, bound: float, lo: int, hi: int, lo2: int, hi2: int) -> np.ndarray:
    """The terms of the pairs between two tiles whose joint presence tells more than their known parts do, and moves the share.

    share: what is known of each term, the label's share where it is, or over all rows if the term is not known. A pair is held
    against its known term; two known terms need no test.
    """
    x, z = of.dense(lo, hi), of.dense(lo2, hi2)
    n11, p11 = x.T @ z, x[of.y].T @ z[of.y]
    expected = np.where(known[lo:hi, None], share[lo:hi, None], share[None, lo2:hi2])
    g = deviance(n11, p11, np.clip(expected, 1e-6, 1 - 1e-6))
    moved = np.abs(p11 - expected * n11) >= SHIFT * n11
    i, j = np.nonzero((g > bound) & moved & ~(known[lo:hi, None] & known[None, lo2:hi2]) & (np.arange(lo, hi)[:, None] < np.arange(lo2, hi2)))
    return np.unique(np.concatenate([i + lo, j + lo2]))


def chosen_terms(rows: Rows, y: np.ndarray, spark: SparkSession | None = None) -> np.ndarray:
    """The hashed terms that carry weights; spark deals the tiles of pairs, without it they are gone through in turn."""
    if not len(rows) or not 0 < y.sum() < len(y):
        return np.empty(0, np.int32)
    vocabulary, n = np.unique(rows.terms, return_counts=True)
    pos = rows.counts(np.flatnonzero(y == 1), vocabulary)
    often = np.flatnonzero(n >= 3)
    known = np.zeros(len(vocabulary), bool)
    known[often[dependent_terms(n[often], pos[often], len(y), int(y.sum()))]] = True
    # A pair passes at best if the label that its known part makes the less likely is that of all its rows.
    bound = 2 * np.log(max(2.0, len(often) ** 2 / 2)) + MARGIN
    overall = y.mean()
    least = lambda p: np.ceil(bound / (2 * np.log(1 / p)))
    share = (pos + overall) / (n + 1)  # no term is certain
    up, down = (overall, overall) if not known.any() else (share[known].min(), share[known].max())
    free = (pos >= least(overall)) & (1 - overall >= SHIFT) | (n - pos >= least(1 - overall)) & (overall >= SHIFT)
    beside = (pos >= least(up)) & (1 - up >= SHIFT) | (n - pos >= least(1 - down)) & (down >= SHIFT)
    groups = [np.flatnonzero(known), np.flatnonzero(free & ~known), np.flatnonzero(beside & ~free & ~known) if known.any() else np.empty(0, np.int64)]
    tested = np.concatenate(groups)
    ends = np.cumsum([len(g) for g in groups])
    order = np.argsort(tested)
    kept = Columns(rows.among(vocabulary[tested[order]], order), y, n[tested])
    of = (kept, known[tested], np.where(known[tested], share[tested], overall), bound)
    cuts = sorted({0, *ends.tolist(), *range(0, len(tested), TILE)})
    strips = list(zip(cuts, cuts[1:]))
    # Known terms meet all others, the others each other where that can pass.
    tiles = [(*a, *b) for k, a in enumerate(strips) if a[0] < ends[1] for b in strips[k:] if a[0] < ends[0] or b[0] < ends[1]]
    found = _on_spark(spark, of, tiles) if spark and len(tiles) > 1 else [interacting(*of, *t) for t in tiles]
    known[tested[np.unique(np.concatenate([np.empty(0, np.int64), *found])).astype(np.int64)]] = True
    return vocabulary[known].astype(np.int32)


def _on_spark(spark: SparkSession, of: tuple, tiles: list[tuple[int, int, int, int]]) -> list[np.ndarray]:
    """The sample, bounded by TRAIN_TERMS, goes to every task that has tiles."""
    sent = spark.sparkContext.broadcast(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(interacting(*sent.value, *tiles[k]), pa.int64())], ["term"])

    tasks = min(len(tiles), 4 * spark.sparkContext.defaultParallelism)
    got = spark.range(0, len(tiles), 1, tasks).mapInArrow(lean(run), "term bigint").distinct().collect()
    sent.destroy()
    return [np.array([r["term"] for r in got], np.int64)]


def _fit(rows: Rows, y: np.ndarray, which: np.ndarray, terms: np.ndarray, pair_decay: float) -> Machine:
    """Logistic loss in which both labels weigh the same, sparse AdaGrad steps in a fixed order."""
    share = (y[which].sum() + 0.5) / (len(which) + 1)
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    rng = np.random.default_rng(SEED)
    m = Machine(terms, 0.0, np.zeros(len(terms)), rng.normal(0, 0.05, (len(terms), FACTORS)))
    grown_bias, grown_linear, grown_factors = 1e-8, np.full(len(terms), 1e-8), np.full((len(terms), FACTORS), 1e-8)
    lots = -(-len(which) // BATCH)
    for _ in range(max(2, -(-STEPS // lots))):
        for lot in np.array_split(rng.permutation(which), lots):
            at, term = rows.lot(lot)
            v = m.factors[term]
            s = _summed(at, v, len(lot))
            margin = m.bias + np.bincount(at, m.linear[term], len(lot)) + 0.5 * ((s * s).sum(1) - np.bincount(at, (v * v).sum(1), len(lot)))
            err = (_sigmoid(margin) - y[lot]) * weight[lot] / len(lot)
            used, own = np.unique(term, return_inverse=True)
            each = err[at]
            step = err.sum()
            grown_bias += step * step
            m.bias -= RATE * step / np.sqrt(grown_bias)
            if len(used):
                step = np.bincount(own, each, len(used)) + DECAY * m.linear[used]
                grown_linear[used] += step * step
                m.linear[used] -= RATE * step / np.sqrt(grown_linear[used])
                step = _summed(own, each[:, None] * (s[at] - v), len(used)) + pair_decay * m.factors[used]
                grown_factors[used] += step * step
                m.factors[used] -= RATE * step / np.sqrt(grown_factors[used])
    return m


def _loss(m: Machine, rows: Rows, y: np.ndarray, which: np.ndarray) -> float:
    margins = np.array([m.margin(m.terms[rows.terms[rows.ends[i] : rows.ends[i + 1]]]) for i in which])
    p = np.where(y[which] == 1, _sigmoid(margins), 1 - _sigmoid(margins))
    share = y[which].mean()
    return float((-np.log(p) * np.where(y[which] == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))).mean())


def distinct(labelled: Iterable[tuple[np.ndarray, int]]) -> tuple[Rows, np.ndarray]:
    """Rows of distinct hashed terms, ascending, and their labels, taken one by one; rows that repeat terms and label count once."""
    seen: set[tuple[bytes, int]] = set()
    terms, ends, y = array("i"), [0], []
    for r, k in labelled:
        packed = np.asarray(r, np.int32).tobytes()
        key = (hashlib.blake2b(packed, digest_size=16).digest(), int(k))
        if key not in seen:
            seen.add(key)
            terms.frombytes(packed)
            ends.append(len(terms))
            y.append(int(k))
    return Rows(np.frombuffer(terms, np.int32), np.array(ends, np.int64)), np.array(y, int)


def fitted(rows: Iterable[np.ndarray], labels: Iterable[int], spark: SparkSession | None = None) -> Machine:
    """The machine for rows of distinct hashed terms, ascending."""
    return machine_of(*distinct(zip(rows, labels)), spark)


def machine_of(rows: Rows, y: np.ndarray, spark: SparkSession | None = None) -> Machine:
    terms = chosen_terms(rows, y, spark)
    share = (y.sum() + 0.5) / (len(y) + 1)
    if not len(terms):
        return Machine(terms, float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, FACTORS)))
    own = rows.among(terms)
    order = np.random.default_rng(SEED).permutation(len(y))
    back, learn = order[: len(y) // 5], order[len(y) // 5 :]
    decay = PAIR_DECAYS[0]
    if 0 < y[back].sum() < len(back) and 0 < y[learn].sum() < len(learn):
        decay = min(PAIR_DECAYS, key=lambda d: _loss(_fit(own, y, learn, terms, d), own, y, back))
    return _fit(own, y, np.arange(len(y)), terms, decay)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, max_rows: int = TRAIN_ROWS, max_terms: int = TRAIN_TERMS) -> Machine:
    """Learns from labelled rows of every fold but 0. Without labels of both kinds the machine scores their share.

    The labels with the lowest hashes are broadcast, ``max_rows`` at most. Where identifiers repeat, so that they meet more
    texts than that, the texts with the lowest hashes are taken, and in either case rows by hash until there are ``max_terms`` entries.
    """
    own = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & (fold(id_col, folds) != 0))
    own = own.select(F.col(id_col).alias("_id"), F.col("toxic").cast("int").alias("_y"), F.xxhash64(id_col).alias("_hash"))
    wide = 1 << 62
    low = lambda c, share: c.bitwiseAND(F.lit(wide - 1)) <= F.lit(int(share * wide))
    share = min(1.0, 1.5 * max_rows / max(1, own.count()))
    sample = own.where(low(F.col("_hash"), share)).orderBy("_hash", "_id", "_y").limit(max_rows).select("_id", "_y")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = pa.array([terms_of(t.as_py()).tobytes() for t in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), terms], ["_hash", "_y", "terms"])

    meets = docs.select(F.col(id_col).alias("_id")).join(F.broadcast(sample), "_id").count()
    joined = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id")
    joined = joined.select(F.xxhash64("_id", "_text").alias("_hash"), "_y", "_text").where(low(F.col("_hash"), min(1.0, 1.1 * max_rows / max(1, meets))))
    drawn = written(joined.mapInArrow(lean(featured), "_hash bigint, _y int, terms binary").groupBy("_hash", "_y", "terms").count(), "toxicity-sample")
    return machine_of(*distinct(_lowest(drawn, max_rows, max_terms)), docs.sparkSession)


def _lowest(drawn: DataFrame, max_rows: int, max_terms: int) -> Iterator[tuple[np.ndarray, int]]:
    """The rows with the lowest hashes within the bounds; a piece comes to the driver when the one before it has been taken."""
    pieces = -(-(drawn.agg(F.sum(F.octet_length("terms"))).first()[0] or 1) // PIECE)
    order, held = ["_hash", "_y", "terms"], 0
    for k, r in enumerate(drawn.repartitionByRange(pieces, *order).sortWithinPartitions(*order).toLocalIterator()):
        terms = np.frombuffer(r["terms"], np.int32)
        held += len(terms)
        if k >= max_rows or held > max_terms:
            break
        yield terms, r["_y"]


def scored(docs: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """docs' columns as c0, c1, ... and score, 0 to 1, the higher the likelier toxic. A null text counts as empty."""
    at = docs.columns.index(text_col)
    names = [f"c{i}" for i in range(len(docs.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array([machine.score(t.as_py()) for t in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, score], [*names, "score"])

    rows = docs.toDF(*names)
    return rows.mapInArrow(lean(run), T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """doc_id, held_out, score and predicted for every row.

    Null and empty texts score as texts without terms. Null and repeated identifiers pass through, a row each (a
    null one is held out); an empty input gives an empty result; other columns play no part.
    """
    machine = train(docs, labels, id_col, text_col, folds)
    out = scored(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), machine)
    return out.select(F.col("c0").alias("doc_id"), (fold("c0", folds) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with a score under 0.5, with docs' columns.

    Null and empty texts score as texts without terms; repeated rows score alike; an empty input gives an empty result; columns may have any names.
    """
    return scored(docs, train(docs, labels, id_col, text_col), text_col).where("score < 0.5").drop("score").toDF(*docs.columns)


def op7(spark, sf_dir: str) -> DataFrame:
    from tripledger.llm.common import table

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
