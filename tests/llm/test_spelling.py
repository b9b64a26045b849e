"""Spelling variants against brute force: the sorted list, groups taken apart, and whole texts."""

import random
import re
import zlib

import numpy as np
import pytest

from tripledger.llm import spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[p + (len(a) == len(b)) :] == b[p + 1 :]


def plain_near(counts):
    near = {}
    for w in counts:
        others = [o for o in counts if one_edit(w, o)]
        if others:
            best = min(others, key=lambda o: (-counts[o], o))
            near[w] = (len(others), counts[best], best)
    return near


@pytest.mark.parametrize("trial", range(12))
def test_sorted_list_finds_each_pair_once(trial):
    rng = random.Random(trial)
    own = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(0, 6))) for _ in range(150)})
    group = np.array([len(w) % (trial % 3 + 1) for w in own])
    listed = spelling.SortedList(group, [w.encode("latin-1") for w in own])
    found = [tuple(sorted((own[listed.order[a]], own[listed.order[b]]))) for lo in range(0, len(own), 37) for q, w in spelling.near_pairs(listed, np.arange(lo, min(lo + 37, len(own)))) for a, b in zip(q, w)]
    assert len(found) == len(set(found))
    assert set(found) == {(a, b) for i, a in enumerate(own) for k, b in enumerate(own) if i < k and group[i] == group[k] and one_edit(a, b)}


@pytest.mark.parametrize("limit", [spelling.GROUP, 30, 3])
def test_near_words_in_groups_of_any_size(spark, limit):
    rng = random.Random(4)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(400)} | {"same" + "".join(rng.choice("xyÿ") for _ in range(4)) + "end" for _ in range(60)}
    counts = {w: rng.randint(1, 5) for w in sorted(words)}
    rows = spelling.near_words(spark.createDataFrame(list(counts.items()), "word string, n bigint"), limit).collect()
    assert len(rows) == len({r.word for r in rows})
    assert {r.word: (r.n_near, r.best_n, r.best) for r in rows} == plain_near(counts)


def test_roots_follow_long_chains(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [("x", "w5")]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "w37" for w, _ in chain}
    assert spelling.roots(spark.createDataFrame([], "word string, form string")).collect() == []


def test_whole_texts_equal_brute_force(spark):
    rng = random.Random(9)
    stems = ["running", "Straße", "éclairs", "letters", "abcde", "Überall", "tiny", "x" * 3000]
    def noisy():
        w = rng.choice(stems)
        k = rng.randrange(len(w))
        return rng.choice([w, w.upper(), w, w[:k] + w[k + 1 :], w[:k] + rng.choice("aeé") + w[k:]])
    docs = [(i, " ".join(noisy() for _ in range(rng.randint(0, 60))) + "… 77 ok") for i in range(150)]
    docs += [(5, docs[5][1]), (None, docs[6][1]), (7, None), (8, ""), (9, "×÷×÷×÷ " * 5)]
    counts = {}
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    counts = {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}
    near = plain_near(counts)
    form = {w: near[w][2] for w in near if near[w][1] >= 2 * counts[w]}
    def root(w):
        return root(form[w]) if w in form else w
    want = {(w, form.get(w), root(w), n, near.get(w, (0,))[0], counts[form[w]] if w in form else None) for w, n in counts.items()}
    rows = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id bigint, text string, word string, n int")
    got = [tuple(r) for r in spelling.spelling_variants(rows, typo=97).collect()]
    assert len(got) == len(want) and set(got) == want and form
    assert spelling.spelling_variants(rows.limit(0)).collect() == []
