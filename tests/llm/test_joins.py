"""Joins and the pipeline, against brute force."""

import re

import numpy as np
import pytest

from tripledger.llm import common, components, embedding_join, mixing, ngram_join


def reached(n, pairs):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in pairs:
        a, b = root(i), root(j)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


@pytest.fixture(params=["cold", "hot"])
def heat(request, monkeypatch):
    """hot: every key that two rows share is spread over tasks."""
    if request.param == "hot":
        monkeypatch.setattr(common, "LEAST_HOT", 1)
        monkeypatch.setattr(common, "HOT", 1 << 40)


def test_spread_join(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "LEAST_HOT", 5)
    data = [(i, None if i % 3 == 0 else "hot" if i % 3 == 1 else f"k{i}") for i in range(900)]
    spark.createDataFrame(data, "id long, key string").repartition(3).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    values = spark.createDataFrame([("hot", 1), ("k2", 2), ("none", 3)], "key string, v int")
    known = {"hot": 1, "k2": 2}
    for how in ("inner", "left"):
        got = sorted((r["id"], r["key"], r["v"]) for r in common.spread_join(rows, values, "key", how).collect())
        assert got == [(i, k, known.get(k)) for i, k in data if how == "left" or k in known]


def test_components(spark, heat):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 480)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = reached(500, edges)
    assert got == {i: root[i] for i in {x for a, b in edges if a != b for x in (a, b)}}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def texts():
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    out = []
    for _ in range(25):
        base = [word() for _ in range(int(rng.integers(20, 120)))]
        out.append(" ".join(base))
        for _ in range(int(rng.integers(0, 5))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 4))):
                copy[int(rng.integers(0, len(copy)))] = word()
            out.append(" ".join(copy))
    shared = [word() for _ in range(60)]
    out += [" ".join(shared + [word() for _ in range(int(rng.integers(1, 14)))]) for _ in range(40)]
    return out + ["One two, THREE.", "one two three", "", None, " .,; ", "x", "X", "w " * 30_000]


@pytest.mark.parametrize(("block", "words"), [(1000, 1_000_000), (7, 1_000_000), (1000, 400)])
def test_ngram_classes(spark, block, words, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "BLOCK_WORDS", words)
    if words == 400:
        monkeypatch.setattr(common, "LEAST_HOT", 1)
    data = [(i, t, "c", 0) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(data, "doc_id long, text string, class_id string, node int").repartition(3)
    got = {r["id"]: (r["class_id"], r["n_links"], r["kept"]) for r in ngram_join.ngram_classes(docs).collect()}
    sets = []
    for _, t, *_ in data:
        w = re.findall(r"\w+", (t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    pairs = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9]
    root = reached(len(sets), pairs)
    links = np.bincount(np.array(pairs).ravel(), minlength=len(sets))
    assert got == {i: (root[i], links[i], root[i] == i) for i in range(len(sets))}
    left = ngram_join.one_of_each(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == sorted(set(root))


def test_ngram_nulls_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, "alone here")], "doc_id long, text string")
    got = sorted((repr(r["id"]), r["class_id"], r["n_links"]) for r in ngram_join.ngram_classes(docs).where("n_links > 0").collect())
    assert got == [("4", 4, 2), ("4", 4, 2), ("None", 4, 2)]
    assert ngram_join.ngram_classes(docs.limit(0)).count() == 0
    assert ngram_join.one_of_each(docs.limit(0)).count() == 0


def test_many_long_near_copies(spark, monkeypatch):
    """2,000 texts of 200 words, each a word or two from the same one: every two are linked, in many blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK_WORDS", 60_000)
    base = [f"w{i}" for i in range(200)]
    data = []
    for i in range(2000):
        own = list(base)
        own[i % 100] = f"x{i}"
        data.append((i, " ".join(own)))
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    got = ngram_join.ngram_classes(docs).collect()
    assert len(got) == 2000 and {r["class_id"] for r in got} == {0} and sum(r["kept"] for r in got) == 1
    # Ten words are the most that two differ by: 186 of 206 n-grams at least are shared.
    assert {r["n_links"] for r in got} == {1999}


def test_bands_reach_the_recall():
    for threshold in (0.5, 0.8, 0.9):
        bands, rows = ngram_join.bands_for(threshold, 0.999)
        assert 1 - (1 - threshold**rows) ** bands >= 0.999


@pytest.mark.parametrize(("block", "cell"), [(65_536, 256), (16, 16), (16, 4), (100, 2)])
def test_embedding_classes(spark, block, cell, monkeypatch):
    monkeypatch.setattr(embedding_join, "BLOCK", block)
    monkeypatch.setattr(embedding_join, "CELL", cell)
    monkeypatch.setattr(embedding_join, "COSINES", 500)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    x = np.concatenate([centres[rng.integers(0, 12, 150)] + rng.normal(0, 0.35, (150, 8)), rng.normal(size=(80, 8))])
    data = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(500, x[3].tolist(), 0), (501, (x[3] * 7).tolist(), 1)]
    odd = [(900, None, 0), (901, [], 0), (902, [0.0] * 8, 0), (903, [float("nan")] * 8, 0), (904, [None] + [1.0] * 7, 0), (905, [float("inf")] + [1.0] * 7, 0), (906, [1.0, 2.0], 0), (907, [2.0, 4.0], 0), (908, [-0.0] * 8, 0)]
    vectors = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>, node int").repartition(3)
    got = {r["id"]: (r["class_id"], r["n_links"], r["kept"]) for r in embedding_join.embedding_classes(vectors).collect()}
    u = np.array([v for _, v, _ in data])
    u /= np.linalg.norm(u, axis=1)[:, None]
    pairs = [(i, j) for i, j in zip(*np.nonzero(u @ u.T >= 0.9)) if i < j]
    assert len(pairs) > 200
    root = reached(len(data), pairs)
    links = np.bincount(np.array(pairs).ravel(), minlength=len(data))
    ids = [d[0] for d in data]
    want = {ids[i]: (ids[root[i]], links[i], root[i] == i) for i in range(len(data))}
    want |= {i: (i, 0, True) for i, _, _ in odd} | {906: (906, 1, True), 907: (906, 1, False)}
    assert got == want


def test_embeddings_empty_and_repeated(spark):
    schema = "vec_id long, embedding array<float>, label int"
    rows = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.01], 0)], schema)
    assert sorted(r["n_links"] for r in embedding_join.embedding_classes(rows).collect()) == [2, 2, 2]
    assert embedding_join.embedding_classes(rows.limit(0)).count() == 0


def test_exactly_the_threshold(spark):
    """(1, 0) and (3, 4) have a cosine of 0.6 exactly."""
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [3.0, 4.0]), (3, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    links = lambda t: sorted((r["id"], r["n_links"], r["class_id"]) for r in embedding_join.embedding_classes(rows, threshold=t).collect())
    assert links(0.6) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]
    assert links(0.6 + 1e-12) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


def dealt(pivots, cells, raw, size):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([bytes([97 + i]) for i in range(len(raw))], pa.binary()), pa.array([1] * len(raw), pa.int64()), pa.array([np.array(v, "<f8").tobytes() for v in raw], pa.binary())], ["node", "copies", "raw"])
    out = list(embedding_join._dealer(pivots, cells, float(np.sqrt(0.2)), 4, size)([batch]))[0].to_pydict()
    return sorted(zip(out["node"], out["pair"], out["side"]))


def test_cells_rule_each_other_out():
    """Far clusters do not visit one another, and a block is visited once however many of its cells are."""
    pivots = np.eye(4)
    cells = [{"cell": i, "n": 10, "near": 0.0, "far": 0.2} for i in range(4)]
    raw = [[1, 0.01, 0, 0], [0, 0, 1, 0.02]]
    apart = dealt(pivots, cells, raw, 10)
    assert len(apart) == 2 and len({b for _, b, _ in apart}) == 2 and not any(side for *_, side in apart)
    assert dealt(pivots, [c | {"far": 2.0} for c in cells], raw, 1000) == [(b"a", 0, 0), (b"b", 0, 0)]
    large = dealt(pivots, [c | {"n": 30} for c in cells], raw, 10)
    assert [sum(n == k for n, *_ in large) for k in (b"a", b"b")] == [3, 3] and sum(side > 0 for *_, side in large) == 4


def test_two_vectors_meet_in_the_pair_of_their_homes():
    """All near one another, over several blocks: every two meet once, one held and one streaming past unless at home together."""
    rng = np.random.default_rng(4)
    raw = (np.eye(4)[rng.integers(0, 4, 40)] + rng.normal(0, 0.02, (40, 4))).tolist()
    cells = [{"cell": i, "n": 10, "near": 0.0, "far": 2.0} for i in range(4)]
    import pyarrow as pa

    apart: dict = {}
    batch = pa.RecordBatch.from_arrays([pa.array([bytes([i]) for i in range(40)], pa.binary()), pa.array([1] * 40, pa.int64()), pa.array([np.array(v, "<f8").tobytes() for v in raw], pa.binary())], ["node", "copies", "raw"])
    for out in embedding_join._dealer(np.eye(4), cells, 2.0, 4, 10)([batch]):
        for node, pair, side in zip(*(out.column(c).to_pylist() for c in ("node", "pair", "side"))):
            apart.setdefault(pair, []).append((node, side))
    met = [tuple(sorted((a, b))) for held in apart.values() for i, (a, s) in enumerate(held) for b, t in held[:i] if s == t == 0 or {s, t} == {1, 2}]
    assert len(apart) == 10 and len(met) == len(set(met)) == 40 * 39 // 2


@pytest.mark.parametrize("least", [16, 64])
def test_many_pairs_of_blocks_lose_no_link(spark, monkeypatch, least):
    rng = np.random.default_rng(least)
    centres = rng.normal(size=(6, 8))
    x = centres[rng.integers(0, 6, 300)] + rng.normal(0, 0.35, (300, 8))
    x[250:] = x[:50]  # copies
    monkeypatch.setattr(embedding_join, "LEAST", least)
    monkeypatch.setattr(embedding_join, "BLOCK", least)
    monkeypatch.setattr(embedding_join, "CELL", 20)
    got = {r["id"]: (r["n_links"], r["class_id"]) for r in embedding_join.embedding_classes(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    link = unit @ unit.T >= 0.9
    least_id = np.arange(300)
    for _ in range(300):
        least_id = np.array([least_id[row].min() for row in link])
    assert got == {i: (int(link[i].sum()) - 1, int(least_id[i])) for i in range(300)} and link.sum() > 2_000


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from tripledger.llm import bpe, exact_dedup, toxicity

    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(200)]
    docs = [(i, " ".join(rng.choice(words, 30)) + (" Vile" if i % 6 == 0 else ""), "en", f"s{i % 4}", 0) for i in range(360)]
    docs += [(1000 + i, docs[i][1].upper(), "en", "s0", 0) for i in range(1, 40, 2)]  # exact but for case
    docs += [(2000 + i, docs[i][1].replace(" ", " , ", 3), "en", "s1", 0) for i in range(1, 40, 2)]  # near
    docs += [(3000, None, None, None, None), (3001, "", "en", None, 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(360)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    text = {i: t for i, t, *_ in docs}
    machine = toxicity.train(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet")))
    clean = [i for i in text if machine.score(text[i]) < 0.5]
    assert {i for i in range(360) if i % 6} <= set(clean) and len(clean) < len(text) - 50
    last = {}
    for i in clean:
        key = (text[i] or "").lower()
        last[key] = max(last.get(key, i), i)
    exact = set(last.values())
    near = {i for i in exact if not (2000 <= i < 3000 and (i - 1000 in exact or i - 2000 in exact))}

    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = at.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        at = spark.read.parquet(str(tmp_path / f"out{k}"))
        assert k == 4 or at.columns == columns
        seen.append(sorted(r["doc_id"] for r in at.collect()))
    assert seen[0] == sorted(clean) and seen[1] == sorted(exact) and seen[2] == sorted(near)
    kept = spark.read.parquet(str(tmp_path / "out2"))
    assert seen[3] == sorted(i for r in mixing.mix(kept).collect() for i in [r["_id"]] * r["copies"]) and seen[4] == seen[3]
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == seen[4]
    assert exact_dedup.exact_dedup(kept, keep="largest").count() == len(near)
    assert set(bpe.bpe(kept, outputs=()).columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}


def stage_tables(spark, tmp_path, docs, labels):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, row string, _id int, score double"
    spark.createDataFrame([(*d, True, "r", 1, 0.0) for d in docs], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, stage_tables(spark, tmp_path, [], [])).count() == 0


def test_pipeline_of_awkward_rows(spark, tmp_path):
    """Nulls, very long texts, rows that repeat, and columns named as the operators' own."""
    import corpus_pipeline

    long = " ".join(f"w{i % 977}x{i % 1009}" for i in range(60_000))
    docs = [(1, None, None, None, None), (2, "", "en", None, 0), (None, "no identifier at all here", "en", "a", 1), (None, "no identifier at all here", "en", "a", 1), (3, long, "en", "b", 9), (4, long + " end", "en", "b", 9)]
    docs += [(5, "the same row twice over, as it is", "en", "a", 3)] * 2 + [(None, None, None, None, None)] + [(10 + i, f"text number {i} of its own kind, {i * 7} {i * 13} {i * 17}", "en", "c", 5) for i in range(20)]
    sf = stage_tables(spark, tmp_path, docs, [(10 + i, 1, 0) for i in range(20)])
    at = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = at.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        at = common.written(stage(spark, at, sf), f"awkward{k}")
        assert k == 4 or at.columns == columns
        kept.append([r["doc_id"] for r in at.collect()])
    assert len(kept[0]) == len(docs)
    assert sorted(map(repr, kept[1])) == sorted(map(repr, [2, None, 3, 4, 5, *range(10, 30)]))  # of null and empty texts the one with the largest identifier
    assert sorted(map(repr, kept[2])) == sorted(map(repr, [2, None, 3, 5, *range(10, 30)]))
    assert set(kept[3]) <= set(kept[2]) - {2} and len(kept[4]) == len(kept[3])


def test_one_of_each_keeps_one_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (None, "x y z"), (None, "x y z"), (3, None), (3, None), (1, "other words")], "doc_id long, text string")
    got = [(repr(r["doc_id"]), r["text"]) for r in ngram_join.one_of_each(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [("1", "a b c d e f"), ("None", "x y z"), ("3", None), ("3", None), ("1", "other words")]))


def test_residents_unite_as_links_reach():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = 50
        link = rng.random((n, n)) < 0.02
        link |= link.T
        np.fill_diagonal(link, True)
        r = embedding_join.Residents(0)
        r.root = np.arange(n)
        for lo in range(0, n, 11):
            r.unite(link[lo : lo + 11].copy())
        least = np.arange(n)
        for _ in range(n):
            least = np.array([least[own].min() for own in link])
        assert (r.root == least).all()
