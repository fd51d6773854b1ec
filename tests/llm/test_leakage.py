import random

from jobweft.llm.leakage import in_runs, leaked_items, leaked_passages, positional_index
from jobweft.llm.words import words

DOCS, ITEMS = "doc_id bigint, text string, item_id bigint, term bigint", "item_id bigint, text string, suite string, doc bigint"


def sample():
    rng = random.Random(2)
    vocab = [f"v{i}" for i in range(60)] + ["the", "of"] * 10
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(3, 60))), "s", 0) for i in range(30)]
    items += [(90, items[0][1], "t", 0), (91, None, "s", 0), (92, "", "s", 0), (None, items[1][1], "s", 0)]
    docs = []
    for d in range(120):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 2)):
            source = rng.choice(items[:30])[1].split()
            at, n = rng.randrange(len(source)), rng.randint(1, 40)
            w[len(w) // 2 : len(w) // 2] = source[at : at + n]
        docs.append((d, " ".join(w).upper() if d % 3 else "<p>" + " ".join(w) + "</p>", 0, 0))
    docs += [docs[0], (500, None, 0, 0), (501, "", 0, 0), (None, items[2][1], 0, 0), (502, (items[3][1] + " ") * 400, 0, 0)]
    docs += [(600 + i, items[5][1], 0, 0) for i in range(60)]  # one passage in a third of all documents
    return docs, items


def brute(docs, items, n=5, least=8):
    sets = lambda t: {tuple(w[k : k + n]) for w in [words(t)] for k in range(len(w) - n + 1)}
    b = {i: sets(t) for i, t, *_ in items if i is not None}
    return {(d, i) for d, t, *_ in docs if d is not None for s in [sets(t)] for i in b if len(s & b[i]) >= least}


def test_like_brute_force(spark):
    docs, items = sample()
    got = {(r["doc_id"], r["item_id"]) for r in leaked_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    want = brute(docs, items)
    assert got == want and len(want) > 80


def test_every_way_of_sending_terms_and_sequences(spark):
    docs, items = sample()
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    want = brute(docs, items)
    for bounds in ({"small_vocabulary": 0}, {"small_queries": 0}, {"small_vocabulary": 0, "small_queries": 0}):
        assert {(r["doc_id"], r["item_id"]) for r in leaked_items(d, i, **bounds).collect()} == want
    repeated = d.unionByName(d).unionByName(d)
    assert {tuple(r) for r in leaked_passages(repeated, i).collect()} == {tuple(r) for r in leaked_passages(d, i).collect()}


def test_runs_of_known_words():
    import numpy as np

    known, doc = np.array([1, 1, 0, 1, 1, 1, 1, 1, 0]) == 1, np.array([0, 0, 0, 0, 0, 1, 1, 1, 1])
    assert in_runs(known, doc, 2).astype(int).tolist() == [1, 1, 0, 1, 1, 1, 1, 1, 0] and in_runs(known, doc, 3).astype(int).tolist() == [0, 0, 0, 0, 0, 1, 1, 1, 0]
    assert in_runs(known, doc, 1).tolist() == known.tolist() and not in_runs(known[:2], doc[:2], 3).any()


def test_other_sizes_and_empty(spark):
    docs, items = sample()
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    for n in (1, 2, 3):
        assert {(r["doc_id"], r["item_id"]) for r in leaked_items(d, i, n=n, least=6).collect()} == brute(docs, items, n, 6)
    assert leaked_items(d.limit(0), i).count() == 0 and leaked_items(d, i.limit(0)).count() == 0


def test_passages_and_index(spark):
    d = spark.createDataFrame([(1, "x y a b c d e f g z z z a b c d e", 0, 0)], DOCS)
    i = spark.createDataFrame([(7, "a b c d e f g", "s", 0)], ITEMS)
    rows = {(r["first_word"], r["last_word"], r["sequences"], r["exact"]) for r in leaked_passages(d, i, gap=0).collect()}
    assert rows == {(2, 8, 3, True), (12, 16, 1, True)}
    assert {(r["first_word"], r["last_word"], r["exact"]) for r in leaked_passages(d, i, gap=10).collect()} == {(2, 16, False)}
    assert sorted(tuple(r["positions"]) for r in positional_index(d).collect())[:2] == [(0,), (1,)]
