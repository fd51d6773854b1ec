import random

import pytest

from jobweft.llm import packing
from jobweft.llm.packing import crossover, evolve, fitness, lower_bound, mutate, pack_report, pack_summary, pack_texts, place

pytestmark = pytest.mark.skipif(not __import__("os").path.exists(packing.VOCABULARY), reason="no vocabulary here")
SCHEMA = "doc_id bigint, text string, tokens bigint, bin string, pack_id bigint"
PACKS = [(1, "s", 16), (2, "m", 64), (3, "l", 100_000), (4, "bad", 0), (None, "none", 5)]


def packed(spark, texts, **k):
    df = spark.createDataFrame([(i, t, 0, "clash", 0) for i, t in texts], SCHEMA)
    packs = spark.createDataFrame(PACKS, "pack_id bigint, pack_name string, capacity_tokens bigint")
    return pack_texts(df, packs, **k), packs


def test_every_text_once_and_no_bin_overfull(spark):
    rng = random.Random(3)
    texts = [(i, " ".join(["word"] * rng.randint(1, 90))) for i in range(400)]
    texts += [texts[0], (1000, None), (1001, ""), (None, "x"), (1002, "long " * 20_000)]
    out, packs = packed(spark, texts, block_items=80)
    rows = out.collect()
    want = {(r["doc"]): r["tokens"] for r in packing.token_counts(spark.createDataFrame([(i, t) for i, t in texts], "doc_id bigint, text string")).collect()}
    assert want[1002] == 20_001 and 1000 not in want and 1001 not in want and len(want) == 401
    for pack, _, capacity in PACKS[:3]:
        mine = [r for r in rows if r["pack_id"] == pack]
        bins, docs = {}, {}
        for r in mine:
            bins[r["bin"]] = bins.get(r["bin"], 0) + r["tokens"]
            docs.setdefault(r["doc_id"], []).append((r["piece"], r["first_token"], r["tokens"]))
        assert max(bins.values()) <= capacity and set(docs) == set(want)
        for d, parts in docs.items():
            parts.sort()
            assert [p[0] for p in parts] == list(range(len(parts))) and sum(p[2] for p in parts) == want[d]
            assert len(parts) == -(-want[d] // capacity) and all(p[1] == p[0] * capacity for p in parts)
    filled = {r["pack_id"]: r["filled"] for r in pack_summary(out, packs).collect()}
    assert filled[1] > 0.95 and filled[2] > 0.95
    assert {r["pack_id"] for r in rows} == {1, 2, 3}
    again = {tuple(r) for r in packed(spark, texts, block_items=80)[0].collect()}
    assert again == {tuple(r) for r in rows}


def test_empty(spark):
    assert packed(spark, [])[0].count() == 0
    assert packed(spark, [(1, None)])[0].count() == 0


def test_operators_keep_all_items():
    rng = random.Random(1)
    sizes = [rng.randint(1, 60) for _ in range(200)]
    a = place(sorted(range(200), key=lambda i: -sizes[i]), sizes, 100, [])
    b = place(list(range(200)), sizes, 100, [])
    for child in (crossover(a, b, sizes, 100, rng), mutate(b, sizes, 100, rng), evolve(sizes, 100, [b], rng, 4, 20)[0]):
        assert sorted(i for x in child for i in x) == list(range(200)) and all(sum(sizes[i] for i in x) <= 100 for x in child)
    assert fitness(evolve(sizes, 100, [b], rng, 4, 20)[0], sizes, 100) >= fitness(b, sizes, 100)


def test_search_saves_bins_where_best_fit_leaves_a_gap():
    rng = random.Random(300)
    seed = found = least = 0
    for k in range(4):
        sizes = [rng.randint(60, 160) for _ in range(200)]
        seed += len(place(sorted(range(200), key=lambda i: -sizes[i]), sizes, 300, []))
        found += len(evolve(sizes, 300, [], random.Random(k), 6, 40)[0])
        least += lower_bound(sizes, 300)
    assert least <= found < seed and seed - found >= (seed - least) / 3


def test_no_packing_is_below_the_bound():
    rng = random.Random(4)
    for _ in range(60):
        sizes = [rng.randint(1, 10) for _ in range(rng.randint(1, 7))]
        best = min(len(place(list(order), sizes, 10, [])) for order in __import__("itertools").permutations(range(len(sizes))))
        assert 1 <= lower_bound(sizes, 10) <= best
    assert lower_bound([6, 6, 6], 10) == 3 and lower_bound([], 10) == 0


def test_report_has_the_bins_of_best_fit_alone(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(i, " ".join(["word"] * rng.randint(3, 9)), 0, "clash", 0) for i in range(300)], SCHEMA)
    packs = spark.createDataFrame(PACKS, "pack_id bigint, pack_name string, capacity_tokens bigint")
    rows = {r["pack_id"]: r for r in pack_report(df, packs, block_items=100).collect()}
    assert all(r["fewest"] <= r["bins"] <= r["seed_bins"] for r in rows.values()) and rows[1]["bins"] < rows[1]["seed_bins"]
