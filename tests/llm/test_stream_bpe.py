"""The streaming transducers against the library: random texts, pieces and words cut anywhere, long words, and the registered query."""

import hashlib
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from tripledger.llm import queries, stream_bpe

SF = "/root/testdata/sf0.001"
PARTS = ["a", "th", "e", "ing", "aa", "é", "Σ", "'", "s", "'re", "1", " ", "\n", "!", "<|endoftext|>", "中", "e", "́", "가", "가", "ᆨ", "İ", "😀", "re", "in", "er", "<|start", " "]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(stream_bpe.vocabulary_path())


@pytest.fixture(scope="module")
def encoder():
    with open(stream_bpe.vocabulary_path(), "rb") as file:
        return stream_bpe.Encoder(file.read())


def ids(encoder, text):
    return np.frombuffer(b"".join(encoder.encode(text)), "<u4").tolist()


@pytest.mark.parametrize(("piece", "long"), [(1 << 16, 256), (64, 8), (7, 4)])
def test_equals_the_library_wherever_it_is_cut(encoder, library, monkeypatch, piece, long):
    monkeypatch.setattr(stream_bpe, "PIECE", piece)
    monkeypatch.setattr(stream_bpe, "LONG", long)
    encoder.known.clear()
    rng = random.Random(piece)
    for k in range(1500):
        parts = PARTS if k % 2 else list("aerthing")
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 400 if k % 20 == 0 else 40)))
        assert ids(encoder, text) == library.encode(text, add_special_tokens=False).ids, text


def test_long_words_keep_constant_memory(encoder, library):
    rng = random.Random(5)
    for word in ("a" * 5000, "".join(rng.choice("etaoin") for _ in range(5000)), "!" * 3000, "the" * 2000, "中文" * 900):
        machine, out, most = stream_bpe.Word(encoder.merges), [], 0
        symbols = encoder.symbols(word)
        for i in range(0, len(symbols), 50):
            out += machine.feed(symbols[i : i + 50])
            most = max(most, len(machine.text))
        assert [encoder.merges.ids[t] for t in out + machine.finish()] == library.encode(word, add_special_tokens=False).ids
        assert most <= encoder.merges.lookahead + 3 * encoder.merges.longest + 50


def test_the_lookahead_bounds_what_appended_symbols_change(encoder):
    rng = random.Random(6)
    for _ in range(400):
        start, more = ("".join(rng.choice("aethirnsgo") for _ in range(n)) for n in (rng.randint(1, 40), rng.randint(1, 40)))
        ends = []
        for symbols in (start, start + more):
            machine = stream_bpe.Word(encoder.merges)
            machine.text = symbols
            machine._advance(len(symbols))
            ends.append(set(np.cumsum([len(t) for t in machine.stack])))
        settled = {e for e in ends[0] if e <= len(start) - encoder.merges.lookahead}
        assert settled <= ends[1]


def test_lookahead_of_small_lists():
    assert stream_bpe.lookahead([]) == 0
    assert stream_bpe.lookahead([("a", "b")]) == 1
    assert stream_bpe.lookahead([("c", "d"), ("b", "c"), ("a", "b")]) == 3  # cd binds c, which frees b, which binds a
    assert stream_bpe.lookahead([("a", "b"), ("b", "c"), ("c", "d")]) == 1  # a chain runs forward in the list only


def test_other_merge_lists_are_refused():
    with pytest.raises(ValueError):
        stream_bpe.Merges({"a": 0, "b": 1, "ab": 2, "abb": 3}, [("ab", "b"), ("a", "b")])


def test_query_equals_the_library(spark, library):
    got = {r.doc_id: r for r in queries.queries()["op11_stream_bpe"](spark, SF).collect()}
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    assert len(got) == len(rows)
    for row in rows:
        want = library.encode(row["text"] or "", add_special_tokens=False).ids
        r = got[row["doc_id"]]
        assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_nulls_empty_texts_repeats_and_clashing_names(spark):
    schema = "doc_id bigint, text string, ids string, n_tokens int"
    docs = spark.createDataFrame([(1, None, "x", 1), (1, None, "x", 1), (None, "Hello, WORLD's é<|endoftext|>", "x", 2), (3, "", None, None), (4, "x" * 100_000, None, None)], schema)
    rows = stream_bpe.stream_bpe(docs).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert [r.n_tokens for r in rows if r.doc_id == 1] == [0, 0] and all(r.decoded_sha256 == empty == r.ids_sha256 for r in rows if r.doc_id in (1, 3))
    (r,) = [r for r in rows if r.doc_id is None]
    assert r.text == "hello , world 's é <|endoftext|>" and r.decoded.startswith("hello</w> ,</w> world</w>")
    assert len(next(r for r in rows if r.doc_id == 4).text.strip()) == 100_000
    assert stream_bpe.stream_bpe(docs.limit(0)).collect() == []
    back = {r.doc_id: r.text for r in stream_bpe.decoded_ids(stream_bpe.stream_bpe(docs)).collect()}
    assert back[None] == r.text and back[3] == ""
