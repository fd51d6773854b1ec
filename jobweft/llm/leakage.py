"""Evaluation passages inside a corpus, by a distributed positional inverted index.

The index holds, for a term and a document, the positions of the term. A sequence of test words is
looked up from its rarest term: the positions of that term, shifted by its offset, are candidate starts,
and the lists of the other terms, each shifted by its own offset, must hold them too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobweft.llm.words import Sequences, WordHashes, words
from jobweft.session import checkpointed, ship

#: Up to so many distinct terms of test items, 32 MB, are sent to the tasks that read the corpus; beyond, the index is joined to them.
SMALL_VOCABULARY = 4_000_000
#: Up to so many test sequences are sent to every executor; beyond, they are shuffled by term.
SMALL_QUERIES = 2_000_000
#: A list holds the positions of a stretch of 1,024 words, so that no list grows with the length of a text.
BLOCK_BITS = 10


def in_runs(known: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in a run of n known ones of one document: only there can n words that are all known follow one another."""
    kept = np.zeros(len(known) + 1, dtype=np.int64)
    if len(known) >= n:
        total = np.r_[0, np.cumsum(known)]
        first = np.flatnonzero((total[n:] - total[:-n] == n) & (doc[n - 1 :] == doc[: len(doc) - n + 1]))
        kept[first] += 1
        np.subtract.at(kept, first + n, 1)
    return np.cumsum(kept[:-1]) > 0


def _postings(vocabulary: np.ndarray | None, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            docs = batch["doc"].to_pylist()
            texts = [words(t) for t in batch["text"].to_pylist()]
            lengths = np.array([len(t) for t in texts], dtype=np.int64)
            term = np.array([hashes[w] for t in texts for w in t], dtype=np.uint64).view(np.int64)
            doc = np.repeat(np.arange(len(texts)), lengths)
            position = (np.arange(len(term)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
            if vocabulary is not None:
                if not len(vocabulary):
                    continue
                known = in_runs(vocabulary[np.minimum(np.searchsorted(vocabulary, term), len(vocabulary) - 1)] == term, doc, n)
                term, doc, position = term[known], doc[known], position[known]
            if not len(term):
                continue
            order = np.lexsort((position, term, doc))
            term, doc, position = term[order], doc[order], position[order]
            block = position >> BLOCK_BITS
            first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1]) | (block[1:] != block[:-1])])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(term)].astype(np.int32)), pa.array(position))
            names = pa.array(docs, batch["doc"].type).take(pa.array(doc[first]))
            yield pa.RecordBatch.from_arrays([pa.array(term[first]), names, pa.array(block[first]), lists], ["term", "doc", "block", "positions"])

    return run


def positional_index(df: DataFrame, *, key: str = "doc_id", text: str = "text", vocabulary: np.ndarray | None = None, n: int = 1) -> DataFrame:
    """The index: one row (term, doc, block, positions) for each term of each stretch of each document.

    It is of all words, or of those of a sorted vocabulary that stand in a run of at least n such words.

    Whole texts are read, nulls and texts without words give no row, repeated rows give equal rows.
    """
    ship(df.sparkSession)
    kind = dict(df.dtypes)[key]
    source = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("doc"), F.col(text).alias("text"))
    return source.mapInArrow(_postings(vocabulary, n), f"term long, doc {kind}, block int, positions array<int>")


def _grams(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            items = batch["item"].to_pylist()
            texts = [words(t) for t in batch["text"].to_pylist()]
            seqs = Sequences(texts, n, hashes)
            rows = {"item": [], "gram": [], "offset": [], "term": []}
            for i, (item, text) in enumerate(zip(items, texts)):
                own = hashes.of(text).view(np.int64)
                grams, where = np.unique(seqs[i].view(np.int64), return_index=True)
                for gram, start in zip(grams.tolist(), where.tolist()):
                    rows["item"] += [item] * n
                    rows["gram"] += [gram] * n
                    rows["offset"] += range(n)
                    rows["term"] += own[start : start + n].tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["item"], batch["item"].type), pa.array(rows["gram"], pa.int64()), pa.array(rows["offset"], pa.int32()), pa.array(rows["term"], pa.int64())],
                ["item", "gram", "offset", "term"])

    return run


def sequence_matches(
    corpus: DataFrame, items: DataFrame, *, key: str, text: str, item_key: str, item_text: str, n: int, small_vocabulary: int = SMALL_VOCABULARY, small_queries: int = SMALL_QUERIES,
) -> DataFrame:
    """Rows (doc, item, gram, start), distinct: where a document holds a word sequence of an item."""
    spark = corpus.sparkSession
    ship(spark)
    kind = dict(items.dtypes)[item_key]
    source = items.where(F.col(item_key).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_key).alias("item"), F.col(item_text).alias("text"))
    wanted = checkpointed(source.mapInArrow(_grams(n), f"item {kind}, gram long, offset int, term long"))
    owners = wanted.select("item", "gram").distinct()
    grams = wanted.select("gram", "offset", "term").distinct()
    terms = grams.select("term").distinct()
    vocabulary = None
    if terms.count() <= small_vocabulary:
        vocabulary = np.sort(np.array([r[0] for r in terms.toLocalIterator()], dtype=np.int64))
    index = positional_index(corpus, key=key, text=text, vocabulary=vocabulary, n=n)
    if vocabulary is None:
        index = index.join(terms, "term", "left_semi")
    # written once where it is made; rows of repeated documents are dropped where lists are shuffled anyway
    index = checkpointed(index)
    frequency = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # a sequence with a term that no document holds is nowhere; of the others the terms are ordered from the rarest
    ranked = grams.join(frequency, "term").withColumn("rank", F.row_number().over(Window.partitionBy("gram").orderBy("df", "term", "offset")))  # n rows a group
    plan = checkpointed(ranked.groupBy("gram").agg(F.array_sort(F.collect_list(F.struct("rank", "offset", "term"))).alias("steps")).where(F.size("steps") == n))
    lookup = plan.select("gram", F.col("steps")[0]["term"].alias("term"), F.col("steps")[0]["offset"].alias("offset"), F.col("steps")[1]["term"].alias("next"), F.col("steps")[1]["offset"].alias("next_offset")) if n > 1 else plan.select("gram", F.col("steps")[0]["term"].alias("term"), F.col("steps")[0]["offset"].alias("offset"))
    if lookup.count() <= small_queries:
        lookup = F.broadcast(lookup)
    starts = index.join(lookup, "term").withColumn("start", F.explode("positions")).withColumn("start", F.col("start") - F.col("offset")).where("start >= 0")
    if n == 1:
        hits = starts.select("doc", "gram", "start")
    else:
        lists = index.select("doc", "term", "block", "positions").dropDuplicates(["doc", "term", "block"])
        stretch = F.shiftright("at", BLOCK_BITS).alias("block")
        second = starts.select("doc", "gram", "start", F.col("next").alias("term"), (F.col("start") + F.col("next_offset")).alias("at")).select("*", stretch)
        hits = second.join(lists, ["doc", "term", "block"]).where(F.array_contains("positions", F.col("at"))).select("doc", "gram", "start").distinct()
        if n > 2:
            rest = hits.join(plan, "gram").select("doc", "gram", "start", F.explode(F.slice("steps", 3, n - 2)).alias("s"))
            rest = rest.select("doc", "gram", "start", F.col("s.term").alias("term"), (F.col("start") + F.col("s.offset")).alias("at")).select("*", stretch)
            met = rest.join(lists, ["doc", "term", "block"]).where(F.array_contains("positions", F.col("at")))
            hits = met.groupBy("doc", "gram", "start").agg(F.count(F.lit(1)).alias("met")).where(F.col("met") == n - 2).select("doc", "gram", "start")
    return hits.join(owners, "gram").select("doc", "item", "gram", "start").distinct()


def leaked_items(
    corpus: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", n: int = 5, least: int = 8, **bounds,
) -> DataFrame:
    """Rows (doc_id, item_id, shared): documents and items whose sets of n-word sequences share at least ``least`` members.

    Sequences are compared as sets: one that a text repeats counts once. Null keys and texts, and texts
    with under n words, match nothing; repeated rows change nothing; equal items are each reported; an
    empty table on either side gives no rows. Whole texts are read, and other columns are not. ``bounds``
    are small_vocabulary and small_queries, up to which terms and sequences are sent rather than joined.
    """
    found = sequence_matches(corpus, items, key=key, text=text, item_key=item_key, item_text=item_text, n=n, **bounds)
    counts = found.groupBy("doc", "item").agg(F.count_distinct("gram").alias("shared")).where(F.col("shared") >= least)
    return counts.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "shared")


def leaked_passages(
    corpus: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", n: int = 5, gap: int = 10, **bounds,
) -> DataFrame:
    """Rows (doc_id, item_id, first_word, last_word, sequences, exact): passages of a document taken from an item.

    Matched sequences that overlap or lie at most ``gap`` words apart are one passage; ``exact`` says that
    it is one unbroken phrase, every word of it matched, rather than a proximity match.
    """
    found = sequence_matches(corpus, items, key=key, text=text, item_key=item_key, item_text=item_text, n=n, **bounds).select("doc", "item", "start").distinct()
    order = Window.partitionBy("doc", "item").orderBy("start")  # the matches of one document and item
    step = F.col("start") - F.lag("start").over(order)
    marked = found.withColumn("new", F.when(step.isNull() | (step > n + gap), 1).otherwise(0)).withColumn("broken", F.when((F.col("new") == 0) & (step > 1), 1).otherwise(0))
    passages = marked.withColumn("passage", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return passages.groupBy(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "passage").agg(
        F.min("start").alias("first_word"), (F.max("start") + n - 1).alias("last_word"), F.count(F.lit(1)).alias("sequences"), (F.max("broken") == 0).alias("exact")).drop("passage")
