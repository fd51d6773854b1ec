"""Texts packed into containers of fixed capacity by a grouping genetic algorithm on islands.

A text that alone exceeds the capacity is cut at token boundaries; its full pieces fill containers, its
last piece is an item like any other text. Items are spread by hash over blocks of bounded size. Each
block is packed by several islands at once: a crossover injects whole well-filled bins of one parent into
the other, removes the bins that hold duplicates, and best-fits the displaced items. Between epochs the
best of each island migrates to the next. Bins that stay loose are packed again across blocks.
"""

from __future__ import annotations

import base64
import bisect
import math
import random
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweft.session import checkpointed, ship, shipped_file

# Fixed value: how the byte-level vocabulary cuts a text before its merges are applied.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
    return tiktoken.Encoding("vocabulary", pat_str=CUTS, mergeable_ranks=ranks, special_tokens={})


def _count_tokens(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import SparkFiles

        encode = encoding(SparkFiles.get(path)).encode_ordinary  # the driver's file, sent with the tasks
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc"], pa.array([len(encode(t)) for t in batch["text"].to_pylist()], pa.int64())], ["doc", "tokens"])

    return run


def token_counts(df: DataFrame, *, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Rows (doc, tokens), one for each distinct key with a text; whole texts are counted. Of several texts of one key the longest counts."""
    ship(df.sparkSession)
    source = df.where(F.col(key).isNotNull() & (F.length(text) > 0)).select(F.col(key).alias("doc"), F.col(text).alias("text"))
    return source.mapInArrow(_count_tokens(shipped_file(df.sparkSession, vocabulary)), f"doc {dict(df.dtypes)[key]}, tokens long").groupBy("doc").agg(F.max("tokens").alias("tokens"))


Bins = list[list[int]]


def lower_bound(sizes: list[int], capacity: int) -> int:
    """No packing has fewer bins: of all tokens together, and of the large items that cannot share with one another and what must lie beside them."""
    s = np.sort(np.asarray(sizes, dtype=np.int64))
    if not len(s):
        return 0
    before = np.r_[0, np.cumsum(s)]
    best = math.ceil(before[-1] / capacity)
    for a in np.unique(s[s * 2 <= capacity]).tolist() or [0]:
        # items over capacity - a stand alone, those over half one to a bin, and what is left from a on fills their room first
        alone, half, least = (int(np.searchsorted(s, x, side=side)) for x, side in ((capacity - a, "right"), (capacity // 2, "right"), (a, "left")))
        n1, n2 = len(s) - alone, alone - half
        room = n2 * capacity - (before[alone] - before[half])
        best = max(best, n1 + n2 + max(0, math.ceil((before[half] - before[least] - room) / capacity)))
    return best


def loads_of(bins: Bins, sizes: list[int]) -> list[int]:
    return [sum([sizes[i] for i in b]) for b in bins]


def place(items: list[int], sizes: list[int], capacity: int, bins: Bins, loads: list[int] | None = None) -> Bins:
    """Each item, in the order given, goes into the bin that it leaves the least room in; ``loads`` of the bins are carried along if given."""
    loads = loads_of(bins, sizes) if loads is None else loads
    room = sorted((capacity - used, j) for j, used in enumerate(loads))
    for i in items:
        size = sizes[i]
        at = bisect.bisect_left(room, (size, -1))
        if at < len(room):
            left, j = room.pop(at)
            bins[j].append(i)
            loads[j] += size
        else:
            left, j = capacity, len(bins)
            bins.append([i])
            loads.append(size)
        if left > size:
            bisect.insort(room, (left - size, j))
    return bins


def fitness(bins: Bins, sizes: list[int], capacity: int, loads: list[int] | None = None) -> float:
    """Mean square of how full the bins are: few full bins beat many half-full ones."""
    loads = loads_of(bins, sizes) if loads is None else loads
    return sum([(used / capacity) ** 2 for used in loads]) / max(1, len(bins))


def exchanged(items: list[int], sizes: list[int], capacity: int, bins: Bins, loads: list[int]) -> list[int]:
    """Displaced items change places with smaller ones of bins that they fill better, one for one or one for two; what is then displaced comes back."""
    out = sorted(items, key=lambda i: -sizes[i])
    for j in sorted(range(len(bins)), key=loads.__getitem__):
        if not (room := capacity - loads[j]):
            continue
        best, change = 0, None
        b = bins[j]
        for at, i in enumerate(out):
            for x in range(len(b)):
                gain = sizes[i] - sizes[b[x]]
                if best < gain <= room:
                    best, change = gain, (at, (x,))
                for y in range(x):
                    if best < (two := gain - sizes[b[y]]) <= room:
                        best, change = two, (at, (x, y))
            if best == room:
                break
        if change:
            at, gone = change
            back = [b[x] for x in gone]
            bins[j] = [i for x, i in enumerate(b) if x not in gone] + [out[at]]
            loads[j] += best
            out = sorted(out[:at] + out[at + 1 :] + back, key=lambda i: -sizes[i])
    return out


def crossover(a: Bins, b: Bins, sizes: list[int], capacity: int, rng: random.Random, loads_a: list[int] | None = None, loads_b: list[int] | None = None) -> Bins:
    """Well-filled bins of b go whole into a; bins of a with duplicates are broken up and what they lose is exchanged and best-fitted."""
    loads_a, loads_b = loads_a or loads_of(a, sizes), loads_b or loads_of(b, sizes)
    order = sorted(range(len(b)), key=lambda j: -loads_b[j])
    best = order[: max(1, len(order) // 2)]
    taken = rng.sample(best, rng.randint(1, max(1, len(best) // 2)))
    inside = {i for j in taken for i in b[j]}
    child, loads, displaced = [list(b[j]) for j in taken], [loads_b[j] for j in taken], []
    for x, used in zip(a, loads_a):
        if inside.isdisjoint(x):
            child.append(list(x))
            loads.append(used)
        else:
            displaced += [i for i in x if i not in inside]
    return place(exchanged(displaced, sizes, capacity, child, loads), sizes, capacity, child, loads)


def mutate(bins: Bins, sizes: list[int], capacity: int, rng: random.Random, loads: list[int] | None = None) -> Bins:
    """The loosest bins and a few others are emptied and their items exchanged and placed again, largest first."""
    loads = loads or loads_of(bins, sizes)
    order = sorted(range(len(bins)), key=loads.__getitem__)
    gone = {*order[: max(1, len(bins) // 20)], *rng.sample(range(len(bins)), min(len(bins), 3))}
    items = [i for j in sorted(gone) for i in bins[j]]
    kept = [j for j in range(len(bins)) if j not in gone]
    child, left = [list(bins[j]) for j in kept], [loads[j] for j in kept]
    return place(exchanged(items, sizes, capacity, child, left), sizes, capacity, child, left)


def evolve(sizes: list[int], capacity: int, population: list[Bins], rng: random.Random, members: int, generations: int) -> list[Bins]:
    """The population after so many generations, best first; no generation runs once no packing can have fewer bins."""
    largest = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    population = population or [place(largest, sizes, capacity, [])]
    fewest = lower_bound(sizes, capacity)
    if generations < 1 or min(map(len, population)) <= fewest:
        return sorted(population, key=lambda p: (len(p), -fitness(p, sizes, capacity)))
    while len(population) < members:
        shuffled = sorted(largest, key=lambda i: -sizes[i] * rng.uniform(0.7, 1.0))
        population.append(place(shuffled, sizes, capacity, []))
    scored = [(len(p), -fitness(p, sizes, capacity), k, p, loads_of(p, sizes)) for k, p in enumerate(population)]
    scored.sort(key=lambda x: x[:3])
    for g in range(generations):
        if scored[0][0] <= fewest:
            break
        (_, _, _, a, la), (_, _, _, b, lb) = (min(rng.sample(scored, 2), key=lambda x: x[:3]) for _ in range(2))
        child = crossover(a, b, sizes, capacity, rng, la, lb)
        if rng.random() < 0.5:
            child = mutate(child, sizes, capacity, rng)
        loads = loads_of(child, sizes)
        scored = sorted([*scored, (len(child), -fitness(child, sizes, capacity, loads), len(population) + g, child, loads)], key=lambda x: x[:3])[:members]
    return [x[3] for x in scored]


def as_labels(bins: Bins, n: int) -> list[int]:
    out = [0] * n
    for j, b in enumerate(bins):
        for i in b:
            out[i] = j
    return out


def as_bins(labels: list[int]) -> Bins:
    out: dict[int, list[int]] = {}
    for i, j in enumerate(labels):
        out.setdefault(j, []).append(i)
    return list(out.values())


_STATE = "pack_id long, capacity long, block long, island int, sizes array<long>, population array<array<int>>, score double"


def _epoch(members: int, generations: int, epoch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                rng = random.Random(f"{r['pack_id']} {r['block']} {r['island']} {epoch}")
                start = [as_bins(p) for p in [*(r.get("population") or []), *([r["elite"]] if r.get("elite") else [])]]
                after = evolve(r["sizes"], r["capacity"], start, rng, members, generations)
                r["population"] = [as_labels(p, len(r["sizes"])) for p in after]
                r["score"] = fitness(after[0], r["sizes"], r["capacity"]) - len(after[0])  # fewer bins first
            names = ["pack_id", "capacity", "block", "island", "sizes", "population", "score"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int32())), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)

    return run


def _again(members: int, generations: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = []
            for r in batch.to_pylist():
                before = as_bins(r["old"])
                after = evolve(r["sizes"], r["capacity"], [before], random.Random(f"{r['pack_id']} {r['block']} again"), members, generations)[0]
                labels.append(as_labels(after if len(after) <= len(before) else before, len(r["sizes"])))
            yield pa.RecordBatch.from_arrays([batch["pack_id"], batch["block"], pa.array(labels, pa.list_(pa.int32()))], ["pack_id", "block", "labels"])

    return run


def pack_texts(
    df: DataFrame, packs: DataFrame, *, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY,
    block_items: int = 500, islands: int = 2, epochs: int = 2, members: int = 6, generations: int = 40, full: float = 0.98, max_packs: int = 1000, counts: DataFrame | None = None,
) -> DataFrame:
    """Rows (pack_id, doc_id, piece, first_token, tokens, bin): the container of each piece, for every capacity of ``packs``.

    ``packs`` has (pack_id, capacity_tokens); a capacity under one is left out. A text is one piece,
    number 0, unless it alone exceeds the capacity; then its pieces are full but for the last. Texts
    without tokens, null texts and null keys are in no container; a key that is repeated is packed once.
    Empty tables give no rows. Very long texts are cut like others. Other columns are not read.

    A block holds about ``block_items`` items however large the table is, so that a task's memory and
    time are bounded; bins filled less than ``full`` are packed again across blocks. A block whose first
    packing, best fit of the largest first, has as few bins as any can have is not searched; ``generations``
    of 0 searches none. Runs on equal tables give equal containers. ``counts`` (doc, tokens) are taken
    instead of counting again if given.
    """
    sizes = counts if counts is not None else checkpointed(token_counts(df, key=key, text=text, vocabulary=vocabulary).where("tokens > 0"))
    packs = packs.select(F.col("pack_id").cast("long"), F.col("capacity_tokens").cast("long").alias("capacity")).where("pack_id IS NOT NULL AND capacity >= 1").distinct()
    capacities = [F.struct(F.lit(r["pack_id"]).cast("long").alias("pack_id"), F.lit(r["capacity"]).cast("long").alias("capacity")) for r in packs.limit(max_packs + 1).collect()]
    if len(capacities) > max_packs:
        raise ValueError("more capacities than max_packs")
    none = F.array().cast("array<struct<pack_id:bigint,capacity:bigint>>")
    pieces = sizes.select("doc", "tokens", F.inline(F.array(*capacities) if capacities else none))
    pieces = pieces.select("pack_id", "capacity", "doc", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("tokens") / F.col("capacity")) - 1).cast("int"))).alias("piece"), "tokens")
    pieces = pieces.select("pack_id", "capacity", "doc", "piece", (F.col("piece") * F.col("capacity")).alias("first_token"), F.least("capacity", F.col("tokens") - F.col("piece") * F.col("capacity")).alias("tokens"))
    whole = pieces.where("tokens = capacity").select("pack_id", "doc", "piece", "first_token", "tokens", F.concat_ws("-", F.lit("f"), F.col("doc").cast("string"), F.col("piece").cast("string")).alias("bin"))
    blocks = max(1, math.ceil(sizes.count() / block_items))
    items = pieces.where("tokens < capacity").withColumn("block", F.pmod(F.xxhash64("doc", "piece"), F.lit(blocks)))
    # a block has about block_items rows by its definition; sorting makes its order the same in every run
    grouped = items.groupBy("pack_id", "capacity", "block").agg(F.array_sort(F.collect_list(F.struct("doc", "piece", "first_token", "tokens"))).alias("items"))
    grouped = checkpointed(grouped.repartition("pack_id", "block"))
    state = grouped.select("pack_id", "capacity", "block", F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"), F.col("items.tokens").alias("sizes"))
    tasks = blocks * max(1, len(capacities)) * islands
    state = checkpointed(spread(state, tasks).mapInArrow(_epoch(members, generations, 0), _STATE))
    for epoch in range(1, epochs):
        elites = state.select("pack_id", "block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("population")[0].alias("elite"))
        state = checkpointed(spread(state.join(elites, ["pack_id", "block", "island"]), tasks).mapInArrow(_epoch(members, generations, epoch), _STATE))
    best = state.groupBy("pack_id", "block").agg(F.max_by(F.col("population")[0], F.struct("score", "island")).alias("labels"))
    placed = grouped.join(best, ["pack_id", "block"]).select("pack_id", "capacity", "block", F.explode(F.arrays_zip("items", "labels")).alias("z"))
    placed = placed.select("pack_id", "capacity", "block", "z.items.*", F.col("z.labels").alias("label"))
    bins = checkpointed(placed.groupBy("pack_id", "capacity", "block", "label").agg(F.array_sort(F.collect_list(F.struct("doc", "piece", "first_token", "tokens"))).alias("items"), F.sum("tokens").alias("used")))
    loose = bins.where(F.col("used") < F.col("capacity") * full)
    amount = loose.agg(F.sum(F.size("items"))).first()[0] or 0
    groups = max(1, math.ceil(amount / block_items))
    loose = loose.withColumn("again", F.pmod(F.xxhash64("block", "label"), F.lit(groups)))
    # whole bins come together, about block_items items to a group
    mixed = loose.groupBy("pack_id", "capacity", F.col("again").alias("block")).agg(F.array_sort(F.collect_list(F.struct("block", "label", "items"))).alias("b"))
    mixed = checkpointed(mixed.select(
        "pack_id", "capacity", "block", F.flatten(F.col("b.items")).alias("items"),
        F.flatten(F.transform("b", lambda b, j: F.transform(b["items"], lambda i: j.cast("int")))).alias("old")).repartition("pack_id", "block"))
    redone = spread(mixed.select("pack_id", "capacity", "block", F.col("items.tokens").alias("sizes"), "old"), groups * max(1, len(capacities))).mapInArrow(_again(members, 2 * generations), "pack_id long, block long, labels array<int>")
    repacked = mixed.join(redone, ["pack_id", "block"]).select("pack_id", "block", F.explode(F.arrays_zip("items", "labels")).alias("z")).select("pack_id", "block", "z.items.*", F.col("z.labels").alias("label"))
    kept = bins.where(F.col("used") >= F.col("capacity") * full).select("pack_id", "block", "label", F.explode("items").alias("i")).select("pack_id", "block", "label", "i.*")
    named = lambda d, first: d.select("pack_id", "doc", "piece", "first_token", "tokens", F.concat_ws("-", F.lit(first), F.col("block").cast("string"), F.col("label").cast("string")).alias("bin"))
    return whole.unionByName(named(kept, "b")).unionByName(named(repacked, "r")).withColumnRenamed("doc", "doc_id")


def spread(d: DataFrame, blocks: int, to_a_task: int = 16) -> DataFrame:
    """Blocks are few and costly: so many to a task, whatever their bytes would suggest."""
    return d.repartition(max(1, min(20_000, math.ceil(blocks / to_a_task))), *[c for c in ("pack_id", "block", "island") if c in d.columns])


def pack_report(df: DataFrame, packs: DataFrame, **settings) -> DataFrame:
    """pack_summary of pack_texts with ``seed_bins``, what best fit alone gives in the same blocks: the difference is what the search saved."""
    counts = checkpointed(token_counts(df, **{k: settings[k] for k in ("key", "text", "vocabulary") if k in settings}).where("tokens > 0"))
    seed = pack_summary(pack_texts(df, packs, counts=counts, **settings | {"generations": 0, "epochs": 1, "islands": 1}), packs)
    return pack_summary(pack_texts(df, packs, counts=counts, **settings), packs).join(seed.select("pack_id", F.col("bins").alias("seed_bins")), "pack_id")


def pack_summary(packed: DataFrame, packs: DataFrame) -> DataFrame:
    """Per capacity: containers, tokens, the fewest containers that could hold them, and the share of room that is used."""
    per_bin = packed.groupBy("pack_id", "bin").agg(F.sum("tokens").alias("used"))
    total = per_bin.groupBy("pack_id").agg(F.count(F.lit(1)).alias("bins"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    return total.join(packs.select(F.col("pack_id").cast("long"), F.col("capacity_tokens").cast("long").alias("capacity")), "pack_id").select(
        "pack_id", "capacity", "bins", "tokens", "fullest", F.ceil(F.col("tokens") / F.col("capacity")).alias("fewest"), F.round(F.col("tokens") / (F.col("bins") * F.col("capacity")), 4).alias("filled"))
