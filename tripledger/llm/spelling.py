"""Spelling variants: the words of a corpus that differ by one inserted, deleted or replaced character, and the form that each is a variant of.

Words that are one edit apart, the shorter n characters long, share their first n // 2 characters, or all from there on at the end.
So each word goes to the groups of its beginnings and ends (for n its own length and one less); a group whose words are many is
taken apart again by the halves of what its words do not share yet, until it is small or they differ in one or two characters
only. A pair meets in one group: where it shares the first half of every part that was halved, it is left to that group.

Inside the groups sorted-list dynamic programming finds the pairs. The words of all groups of a batch are one sorted list. A
row of the edit matrix, three cells wide, belongs to a query and to a range of words that share a prefix, so what neighbours have in
common is computed once; a range whose row holds no cell of one edit or less is skipped with all that it holds. All queries go down the list
together, a character at a time. Where the edit is spent already, only the characters that the row allows are looked up in the range.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripledger.llm.common import lean, shuffle_partitions, table, written

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
TYPO, LEAST_LENGTH, LEAST_COUNT, TIMES = 97, 5, 3, 2
#: Words of a group before it is taken apart; matrix cells of a batch; queries that go down the list at once.
GROUP, CELLS, QUERIES = 20_000, 4 << 20, 8192
ALL = 1 << 30
FAR = 9


def ascii_lowered(word: Column) -> Column:
    """Only A-Z change; a word without other letters takes the quick way."""
    from tripledger.llm.common import ascii_lower

    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(ascii_lower(word))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", typo: int | None = TYPO, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of all runs of letters. With typo, a run loses a character where the checksum of identifier and run is a multiple of it."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= least_length).select("id", ascii_lowered(F.col("run")).alias("run"))
    if typo:
        runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
        at = (F.col("h") % F.length("run")).cast("int")
        short = F.concat(F.expr("left(run, CAST(h % length(run) AS INT))"), F.substring("run", at + 2, F.length("run")))
        runs = runs.select(F.when(F.col("h") % typo == 0, short).otherwise(F.col("run")).alias("run"))
    counts = runs.where(F.length("run") >= least_length).groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= least_count)


def _halved(rows: DataFrame) -> DataFrame:
    """The two groups that each row goes to instead of its own: by the first half of what its group's words do not share, or by the rest."""
    pre, suf = F.length("head"), F.length("tail")
    middle = F.col("shorter") - pre - suf
    half = F.floor(middle / 2).cast("int")
    first = F.struct(F.expr("left(word, half)").alias("head"), F.col("tail"), F.col("below"))
    second = F.struct(F.col("head"), F.expr("right(word, rest)").alias("tail"), F.col("half").alias("below"))
    return rows.withColumns({"half": pre + half, "rest": suf + middle - half}).withColumn("g", F.explode(F.array(first, second))).select("word", "n", "shorter", "g.*")


def grouped(words: DataFrame, limit: int = GROUP) -> DataFrame:
    """word, n, shorter, head, tail, below: words of ``shorter`` characters or one more that begin with head and end with tail."""
    size = F.length("word")
    whole = words.withColumn("shorter", F.explode(F.array(size, size - 1))).where(F.col("shorter") > 0)
    rows = _halved(whole.select("word", "n", "shorter", F.lit("").alias("head"), F.lit("").alias("tail"), F.lit(ALL).alias("below")))
    key = ["shorter", "head", "tail", "below"]
    while True:
        many = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_size")).where((F.col("_size") > limit) & (F.col("shorter") - F.length("head") - F.length("tail") >= 2)).drop("_size")
        many = written(many, "many")
        if many.isEmpty():
            return rows
        marked = rows.join(many.withColumn("_many", F.lit(True)), key, "left")  # few keys; AQE splits the rows of each
        rows = written(marked.where("_many IS NULL").select("word", "n", *key).unionByName(_halved(marked.where("_many")).select("word", "n", *key)), "groups")


class SortedList:
    """Words of some groups as rows of characters, sorted by group and characters; ranges of a depth are named by their first word."""

    def __init__(self, group: np.ndarray, words: list[bytes]):
        width = max(map(len, words), default=0) + 1
        c = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        self.order = np.lexsort([*(c[:, k] for k in range(width - 1, -1, -1)), group])
        self.chars, self.group = c[self.order], group[self.order]
        self.size = np.fromiter(map(len, words), np.int64, len(words))[self.order]
        differs = self.chars[1:] != self.chars[:-1]
        lcp = np.where(differs.any(1), differs.argmax(1), width)
        self.lcp = np.concatenate([[-1], np.where(self.group[1:] == self.group[:-1], lcp, -1)])
        self.depth = width - 1

    def ranges(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last word of each range of words that share so many characters."""
        cuts = np.flatnonzero(self.lcp < depth)
        ends = np.append(cuts[1:], len(self.lcp))
        whole = self.size[cuts] >= depth
        return cuts[whole], ends[whole]


def near_pairs(words: SortedList, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, later word) of one group that are one edit apart, those of the words that end at each depth together."""
    c = np.pad(words.chars, ((0, 0), (1, 2)))  # a column before the first character and two after the last: no character is 0
    cuts, ends = words.ranges(0)
    node, q = cuts[np.searchsorted(cuts, queries, "right") - 1], queries
    row = np.stack([np.full(len(q), FAR), np.zeros(len(q), np.int64), np.where(words.size[q] > 0, 1, FAR)]).astype(np.int8)
    for d in range(words.depth):
        below, below_ends = words.ranges(d + 1)
        if not len(below) or not len(q):
            return
        # Children of each range, in order: parent and character name them.
        parent = cuts[np.searchsorted(cuts, below, "right") - 1]
        char = words.chars[below, d].astype(np.int64)
        exact = row[1] == 0
        # A row without an edit so far goes on to all children, one with the edit spent to those that its cells allow.
        first = np.searchsorted(parent, node[exact], "left")
        n = np.searchsorted(parent, node[exact], "right") - first
        state = np.repeat(np.flatnonzero(exact), n)
        child = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        spent, names = np.flatnonzero(~exact), parent * 256 + char
        states, children = [state], [child]
        wanted = [np.where(row[k, spent] == 1, c[q[spent], d + k], 0).astype(np.int64) for k in range(3)]
        wanted[1][wanted[1] == wanted[0]] = 0
        wanted[2][(wanted[2] == wanted[0]) | (wanted[2] == wanted[1])] = 0
        for w in wanted:
            s = spent[w > 0]
            name = node[s] * 256 + w[w > 0]
            at = np.searchsorted(names, name)
            hit = names[np.minimum(at, len(names) - 1)] == name
            states.append(s[hit])
            children.append(at[hit])
        state, child = np.concatenate(states), np.concatenate(children)
        later = below_ends[child] > q[state] + 1  # of each pair the query comes first
        state, child = state[later], child[later]
        q, node, w, (a, b, e) = q[state], below[child], char[child], row[:, state]
        left = words.size[q] - d  # characters of the query from here on
        a = np.where(left >= 0, np.minimum(a + (w != c[q, d]), b + 1), FAR)
        b = np.where(left >= 1, np.minimum(np.minimum(b + (w != c[q, d + 1]), e + 1), a + 1), FAR)
        e = np.where(left >= 2, np.minimum(e + (w != c[q, d + 2]), b + 1), FAR)
        row = np.minimum(np.stack([a, b, e]), FAR).astype(np.int8)
        ended = (words.size[node] == d + 1) & (node > q)
        cell = words.size[q] - d  # 0, 1 or 2 where the query ends within the band
        near = ended & (cell >= 0) & (cell <= 2)
        near[near] = row[cell[near], np.flatnonzero(near)] == 1
        yield q[near], node[near]
        alive = row.min(0) <= 1
        q, node, row = q[alive], node[alive], row[:, alive]
        cuts = below


def _near_of(rows: list[tuple]) -> Iterator[dict]:
    """rows: (shorter, below, head, tail, word, n), whole groups. What each word is near to in its group: how many, and the most frequent."""
    group = np.cumsum([False, *(a[:4] != b[:4] for a, b in pairwise(rows))])
    names = [r[4] for r in rows]
    middles = [r[4][len(r[2]) : len(r[4]) - len(r[3])].encode("latin-1") for r in rows]
    words = SortedList(group, middles)
    take = words.order
    n = np.array([r[5] for r in rows], np.int64)[take]
    head = np.array([len(r[2]) for r in rows])[take]
    below, shorter = np.array([r[1] for r in rows])[take], np.array([r[0] - len(r[2]) - len(r[3]) for r in rows])[take]
    rank = np.empty(len(rows), np.int64)
    rank[sorted(range(len(rows)), key=names.__getitem__)] = np.arange(len(rows))
    rank = rank[take]
    pairs = []
    for lo in range(0, len(rows), QUERIES):
        for q, w in near_pairs(words, np.arange(lo, min(lo + QUERIES, len(rows)))):
            own = np.minimum(words.size[q], words.size[w]) == shorter[q]  # two of the longer kind meet elsewhere
            q, w = q[own], w[own]
            same = np.cumprod(words.chars[q] == words.chars[w], 1).sum(1)
            own = head[q] + np.minimum(same, np.minimum(words.size[q], words.size[w])) < below[q]
            pairs.append((q[own], w[own]))
    q, w = (np.concatenate([np.empty(0, np.int64), *x]) for x in zip(*pairs)) if pairs else (np.empty(0, np.int64),) * 2
    of, other = np.concatenate([q, w]), np.concatenate([w, q])
    by = np.lexsort([rank[other], -n[other], of])
    of, other = of[by], other[by]
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    for i, k, count in zip(of[starts].tolist(), other[starts].tolist(), np.diff(starts, append=len(of)).tolist()):
        yield {"word": names[take[i]], "n_near": count, "best_n": int(n[k]), "best": names[take[k]]}


NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def near_words(words: DataFrame, limit: int = GROUP) -> DataFrame:
    """word, n_near, best_n, best for the words (word, n) that are one edit from another; of equal frequencies the first in code-point order is best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        cells = 0
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if cells > CELLS and row[:4] != held[-1][:4]:
                    yield pa.RecordBatch.from_pylist(list(_near_of(held)), schema=NEAR)
                    held, cells = [], 0
                held.append(row)
                cells += len(row[4]) + 8
        if held:
            yield pa.RecordBatch.from_pylist(list(_near_of(held)), schema=NEAR)

    key = ["shorter", "below", "head", "tail"]
    rows = grouped(words, limit).select(*key, "word", "n")
    parts = rows.repartition(shuffle_partitions(words.sparkSession), *key).sortWithinPartitions(*key).mapInArrow(lean(run), "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("b")
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.m")).alias("best_n"), "b.best")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of forms (word, form): every pointer jumps to where its target points until none moves. Frequencies double at each form, so chains are short."""
    found = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not found.where("moved").isEmpty():
        to = found.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        found = written(found.join(to, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
    return found.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", typo: int | None = None, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of at least so many letters and occurrences.

    A null text has no words; a null identifier counts as empty in the checksum of typo; repeated rows count each; an empty input gives an
    empty result; other columns play no part. Long texts and long words are taken whole.
    """
    words = written(word_counts(docs, id_col, text_col, typo, least_length, least_count), "words")
    near = near_words(words)
    own = words.join(near, "word", "left").withColumn("is_form", F.coalesce(F.col("best_n") >= times * F.col("n"), F.lit(False)))
    picked = lambda c: F.when(F.col("is_form"), F.col(c))
    own = written(own.select("word", picked("best").alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), picked("best_n").alias("form_n")), "variants")
    out = own.join(roots(own.where("form IS NOT NULL")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), typo=TYPO)


#: DuckDB has no checksum of this kind: a table of one byte's remainders, and a step for each byte of UTF-8.
CRC_SQL = """crc_table AS MATERIALIZED (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)
)"""


def crc_sql(text: str) -> str:
    """Of a text whose characters are below U+0100; crc_table is in scope as the table's list t."""
    codes = f"list_transform(string_split({text}, ''), lambda x: unicode(x)::BIGINT)"
    utf8 = f"flatten(list_transform({codes}, lambda u: CASE WHEN u < 128 THEN [u] ELSE [192 + u // 64, 128 + u % 64] END))"
    return f"xor(list_reduce({utf8}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"


OP13_SQL = f"""
WITH RECURSIVE {CRC_SQL},
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS named, run
  FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
),
each AS (SELECT named, run, count(*) AS n FROM runs GROUP BY ALL),
typed AS (SELECT run, n, {crc_sql("named")} AS h FROM each, crc_table),
words AS (
  SELECT CASE WHEN h % {TYPO} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM typed GROUP BY 1 HAVING length(word) >= {LEAST_LENGTH} AND sum(n) >= {LEAST_COUNT}
),
-- A deletion from one of two words gives the other, or deletions at the same place make them equal.
cut AS (SELECT word, n, i, CASE WHEN i = 0 THEN word ELSE left(word, i - 1) || substr(word, i + 1) END AS rest FROM (SELECT word, n, unnest(range(0, length(word) + 1)) AS i FROM words)),
near AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.word <> b.word AND (a.i = b.i OR a.i = 0 OR b.i = 0)),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY 1),
own AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {TIMES} * w.n THEN other END AS form, CASE WHEN other_n >= {TIMES} * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best USING (word)
),
chain AS (
  SELECT word, word AS at FROM own
  UNION ALL SELECT c.word, o.form FROM chain c JOIN own o ON o.word = c.at WHERE o.form IS NOT NULL
)
SELECT o.word, o.form, c.at AS root, o.n, o.n_near, o.form_n FROM own o JOIN chain c USING (word) JOIN own l ON l.word = c.at AND l.form IS NULL
"""
