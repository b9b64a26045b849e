"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are the 2- to 4-byte stretches of the lower-cased UTF-8 text, hashed. Their embeddings are averaged over
the text and a linear layer gives the languages' logits; both are trained by stochastic gradient descent in numpy on
a bounded sample, the same number of rows for each language. As everything before the softmax is linear, scoring
looks up one row of logits for each subword. A temperature and a rejection threshold are fitted on rows kept
back from training.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripledger.llm.toxicity import fold

#: At most so many rows are learnt from, in equal parts for each language: those with the lowest hashes.
TRAIN_ROWS = 3000
BUCKETS, DIM, EPOCHS, BATCH, RATE, SEED = 1 << 14, 16, 8, 32, 0.15, 11
LENGTHS = (2, 3, 4)
#: Accuracy that rows above the rejection threshold reach on the rows kept back.
ACCEPTED_ACCURACY = 0.99
PIECE = 1 << 20
#: Up to so many languages their row counts are broadcast.
MOST_BROADCAST = 10_000
LETTER = re.compile(r"[^\W\d_]")


def subwords(text: str) -> np.ndarray:
    """How often each hashed subword occurs in the whole text."""
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    count = np.zeros(BUCKETS)
    for lo in range(0, len(raw), PIECE):
        piece = raw[lo : lo + PIECE + max(LENGTHS) - 1].astype(np.uint32)
        for n in LENGTHS:
            ends = min(len(piece) - n + 1, PIECE)
            if ends > 0:
                h = np.full(ends, n, np.uint32)
                for k in range(n):
                    h = (h ^ piece[k : k + ends]) * np.uint32(16777619)
                count += np.bincount((h ^ (h >> np.uint32(14))) & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    return count


def averaged(text: str) -> np.ndarray:
    count = subwords(text)
    return count / max(1.0, count.sum())


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # each subword's logits
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.langs or not LETTER.search(text):
            return "und", 0.0, False
        z = (averaged(text) @ self.table + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.langs[best], float(p[best]), bool(p[best] >= self.threshold)


def fitted(rows: list[tuple[np.ndarray, np.ndarray]], langs: list[str]) -> Model:
    """rows: subword numbers and shares of each text; langs: its language."""
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs], int)
    rng = np.random.default_rng(SEED)
    e = rng.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32)
    w, b = np.zeros((DIM, len(names)), np.float32), np.zeros(len(names), np.float32)
    if len(names) < 2:
        return Model(names, np.zeros((BUCKETS, len(names))), b)

    def dense(lot: np.ndarray) -> np.ndarray:
        x = np.zeros((len(lot), BUCKETS), np.float32)
        for i, k in enumerate(lot):
            x[i, rows[k][0]] = rows[k][1]
        return x

    def softmax(z: np.ndarray) -> np.ndarray:
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    order = rng.permutation(len(rows))
    back, learn = order[: len(rows) // 5], order[len(rows) // 5 :]
    grown = [np.full(a.shape, 1e-12, np.float32) for a in (e, w, b)]
    for _ in range(EPOCHS):
        for lot in np.array_split(rng.permutation(learn), max(1, len(learn) // BATCH)):
            x = dense(lot)
            h = x @ e
            err = softmax(h @ w + b)
            err[np.arange(len(lot)), y[lot]] -= 1
            err /= len(lot)
            for a, g, step in zip((e, w, b), grown, (x.T @ (err @ w.T), h.T @ err, err.sum(0))):
                g += step**2
                a -= RATE * step / np.sqrt(g)
    model = Model(names, (e @ w).astype(float), b.astype(float))
    if len(back):
        z = np.concatenate([dense(lot) @ e @ w for lot in np.array_split(back, -(-len(back) // BATCH))]) + b
        own = np.arange(len(back)), y[back]
        losses = {t: -np.log(np.maximum(softmax(z / t)[own], 1e-12)).mean() for t in np.geomspace(0.2, 5, 33)}
        model.temperature = float(min(losses, key=losses.get))
        p = softmax(z / model.temperature)
        sure, right = p.max(1), p.argmax(1) == y[back]
        down = np.argsort(-sure, kind="stable")
        good = np.flatnonzero(np.cumsum(right[down]) >= ACCEPTED_ACCURACY * np.arange(1, len(down) + 1))
        model.threshold = float(sure[down[good[-1]]]) if len(good) else 1.0
    return model


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held: int = 1, max_rows: int = TRAIN_ROWS) -> Model:
    """Learns from rows with a language outside the held-out fold: for each language those with the lowest hashes of identifier and text, each once."""
    own = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (fold(id_col, folds) != held))
    counts = own.groupBy(F.col(lang_col).alias("_lang")).agg(F.count(F.lit(1)).alias("_n"))
    n_langs = max(1, counts.count())
    each = max(1, max_rows // n_langs)
    hashed = F.xxhash64(id_col, text_col).bitwiseAND(F.lit((1 << 62) - 1))
    rows = own.select(F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"), hashed.alias("_hash"))
    few = n_langs <= MOST_BROADCAST  # else both sides are shuffled
    low = F.col("_hash").cast("double") / float(1 << 62) * F.col("_n") <= 1.5 * each + 20
    rows = rows.join(F.broadcast(counts) if few else counts, "_lang").where(low).select("_hash", "_text", "_lang")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()  # rows that repeat, however often, give one
        for batch in batches:
            hashes, langs, ids, shares = [], [], [], []
            for h, t, lang in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                if (h, lang) in seen:
                    continue
                seen.add((h, lang))
                x = averaged(t.as_py())
                used = np.flatnonzero(x)
                hashes.append(h)
                langs.append(lang)
                ids.append(used.astype("<u2").tobytes())
                shares.append(x[used].astype("<f4").tobytes())
            columns = [pa.array(hashes, pa.int64()), pa.array(langs, pa.string()), pa.array(ids, pa.binary()), pa.array(shares, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["_hash", "_lang", "ids", "shares"])

    found = rows.mapInArrow(featured, "_hash bigint, _lang string, ids binary, shares binary").dropDuplicates(["_hash", "_lang"])
    lowest = Window.partitionBy("_lang").orderBy("_hash")
    table = found.withColumn("_k", F.row_number().over(lowest)).where(F.col("_k") <= each).toArrow().sort_by([("_hash", "ascending"), ("_lang", "ascending")])
    pairs = [(np.frombuffer(i, "<u2").astype(np.int64), np.frombuffer(s, "<f4").astype(float)) for i, s in zip(table.column("ids").to_pylist(), table.column("shares").to_pylist())]
    return fitted(pairs, table.column("_lang").to_pylist())


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score, and accepted: whether the score passes the calibrated rejection threshold.

    A null text, or one without a letter, is ``und`` with score 0; of languages with the same score the first by name is taken. Null and repeated identifiers pass through, a
    row each; where nothing can be learnt every row is ``und``; an empty input gives an empty result; other columns play no part.
    """
    model = train(docs, id_col, text_col, lang_col, folds, held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.predict(t.as_py()) for t in batch.column(1)]
            lang, score, accepted = (list(x) for x in zip(*got)) if got else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())], ["doc_id", "lang_pred", "score", "accepted"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, "doc_id bigint, lang_pred string, score double, accepted boolean")
    return out.select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "lang_pred", "score", "accepted")


def op8(spark, sf_dir: str) -> DataFrame:
    from tripledger.llm.common import table

    return identify(table(spark, sf_dir, "documents"))
