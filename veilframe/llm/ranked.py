"""Ranked lexical search by the Best Position Algorithm.

Documents are cut into shards. In a shard every query term has an impact list: its documents, highest impact first. For an
item the lists of its terms are read side by side; a document met for the first time is looked up in all other lists at once
(direct access), and the places where it stands there count as seen too. The best position of a list is the end of its
seen part without a gap: no unseen document can have more impact there than the next place holds. When the sum of these
impacts over the lists is strictly below the score of the k-th best document so far, no unseen document can reach or tie it.

The k best of a task carry over from shard to shard, so later shards stop sooner. Tasks give their k best per item; rows below
the highest k-th score of any task cannot be in the result and go before the last ranking.

Items are taken in blocks of bounded size, each against all documents. Only occurrences of a block's terms are kept of a
document, in a written table. Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import lean, pieces, small_batches, utf8, word_hashes
from veilframe.session import cut_lineage

#: Terms are runs of ASCII letters and digits and of everything beyond ASCII.
BREAKS = np.ones(256, bool)
BREAKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

ITEM_BYTES = 512 << 10  # texts of items handled at once
PLACES = 16 << 20  # entries of the table of places of a shard
SHARD = 16384  # documents of a shard at most
SLICE = 4 << 20  # bytes of text split into terms at once
NO_ID = np.iinfo(np.int64).max  # a null identifier, which comes last among equal scores

_COUNTED = "doc_id bigint, n bigint, terms array<int>, tfs array<int>"


def _items(rows: list) -> tuple[list, list[np.ndarray], np.ndarray]:
    """Identifiers, places of the terms of each item in the vocabulary, and the vocabulary as sorted hashes."""
    hashes = []
    for row in rows:
        data, bounds = utf8(pa.array([row["text"] or ""], pa.large_string()))
        hashes.append(np.unique(word_hashes(data, bounds, BREAKS)[0]))
    vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]))
    return [r["item_id"] for r in rows], [np.searchsorted(vocabulary, h) for h in hashes], vocabulary


def _ints(parts: list[np.ndarray], bounds: np.ndarray) -> pa.Array:
    flat = np.concatenate([np.zeros(0, np.int32), *parts]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))


def _occurrences(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document that has a term: how many terms with repeats, and which of the vocabulary how often."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = utf8(batch.column("text"))
            for a, b in pieces(bounds, SLICE):
                hashes, words = word_hashes(data[bounds[a]:bounds[b]], bounds[a:b + 1] - bounds[a], BREAKS)
                n = np.diff(words)
                place = np.minimum(np.searchsorted(vocabulary, hashes), max(len(vocabulary) - 1, 0))
                known = vocabulary[place] == hashes if len(vocabulary) else np.zeros(len(hashes), bool)
                row = np.repeat(np.arange(b - a), n)[known]
                code, tf = np.unique(row * np.int64(max(len(vocabulary), 1)) + place[known], return_counts=True)
                row, term = np.divmod(code, max(len(vocabulary), 1))
                ends = np.r_[0, np.cumsum(np.bincount(row, minlength=b - a))]
                out = pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(n), _ints([term], ends), _ints([tf], ends)],
                    ["doc_id", "n", "terms", "tfs"])
                yield out.filter(pa.array(n > 0))

    return docs.mapInArrow(lean(count), _COUNTED)


class Shard:
    """The impact lists of some documents. Every list ends with an empty place of impact 0."""

    def __init__(self, ids: np.ndarray, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int) -> None:
        order = np.lexsort((doc, -impact, term))
        term, doc, impact = term[order], doc[order], impact[order]
        self.ids = ids
        self.length = np.bincount(term, minlength=n_terms)
        first = np.r_[0, np.cumsum(self.length)[:-1]]
        self.base = first + np.arange(n_terms)
        place = np.arange(len(term)) - first[term]
        self.docs = np.full(len(term) + n_terms, -1, np.int64)
        self.impacts = np.zeros(len(term) + n_terms, np.int64)
        self.docs[self.base[term] + place] = doc
        self.impacts[self.base[term] + place] = impact
        # Direct access: where a document stands in a list, or the list's empty place.
        self.places = np.repeat(self.length.astype(np.int32)[:, None], len(ids), axis=1)
        self.places[term, doc] = place

    def best(self, terms: np.ndarray, k: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents that may be among the k best, their scores, and how many were looked up. ``known`` are scores that count
        already. Documents left out score strictly below the k-th best of all."""
        terms = terms[self.length[terms] > 0]
        base, length = self.base[terms], self.length[terms]
        local = np.r_[0, np.cumsum(length + 1)[:-1]].astype(np.int64)
        seen_place = np.zeros(int((length + 1).sum()), bool)
        seen = np.zeros(len(self.ids), bool)
        position = np.zeros(len(terms), np.int64)
        found, scores, top = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], known
        depth, step = 0, 32
        while len(terms):
            reach = np.arange(depth, depth + step)
            inside = reach[None, :] < length[:, None]
            docs = np.unique(self.docs[(base[:, None] + reach[None, :])[inside]])
            docs = docs[~seen[docs]]
            seen[docs] = True
            places = self.places[terms[:, None], docs[None, :]]
            score = self.impacts[base[:, None] + places].sum(axis=0)
            found.append(docs)
            scores.append(score)
            seen_place[local[:, None] + places] = True
            seen_place[local + length] = False  # the empty place ends a list
            for i in np.flatnonzero(position < length):
                position[i] += int(seen_place[local[i] + position[i]:local[i] + length[i] + 1].argmin())
            bound = int(self.impacts[base + position].sum())
            top = np.concatenate([top, score])
            if len(top) > k:
                top = np.partition(top, len(top) - k)[len(top) - k:]
            if bound == 0 or len(top) >= k and bound < top.min():
                break
            depth += step
            step *= 2
        return np.concatenate(found), np.concatenate(scores), int(seen.sum())


def _searched(counted: DataFrame, items: list[np.ndarray], weights: np.ndarray, n_docs: int, n_words: int, k: int) -> DataFrame:
    """The k best documents of each task and item: (item, place, doc_id, score)."""
    n_terms = len(weights)
    most = int(min(SHARD, max(64, PLACES // max(n_terms, 1))))

    def impacts(tf: np.ndarray, term: np.ndarray, m: np.ndarray) -> np.ndarray:
        return weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in items]

        def shard(part: pa.RecordBatch) -> None:
            ids = part.column("doc_id").fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
            n = part.column("n").to_numpy(zero_copy_only=False)
            lists = part.column("terms")
            term = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            tf = part.column("tfs").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy(zero_copy_only=False))
            impact = impacts(tf, term, (50 + (50 * n * n_docs) // n_words)[doc])
            some = impact > 0
            lists = Shard(ids, term[some], doc[some], impact[some], n_terms)
            for number, terms in enumerate(items):
                old_ids, old_scores = best[number]
                docs, scores, _ = lists.best(terms, k, old_scores)
                new_ids, new_scores = np.concatenate([old_ids, ids[docs]]), np.concatenate([old_scores, scores])
                first = np.lexsort((new_ids, -new_scores))[:k]
                best[number] = new_ids[first], new_scores[first]

        for batch in batches:
            for at in range(0, batch.num_rows, most):
                shard(batch.slice(at, most))
        sizes = [len(s) for _, s in best]
        if sum(sizes):
            ids = np.concatenate([i for i, _ in best])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.arange(len(items)), sizes).astype(np.int32)),
                pa.array(np.concatenate([np.arange(n) for n in sizes]).astype(np.int32)),
                pa.array(ids, mask=ids == NO_ID), pa.array(np.concatenate([s for _, s in best]))], ["item", "place", "doc_id", "score"])

    return counted.mapInArrow(lean(search), "item int, place int, doc_id bigint, score bigint")


def _block(docs: DataFrame, rows: list, k: int) -> DataFrame:
    spark = docs.sparkSession
    item_ids, items, vocabulary = _items(rows)
    counted = cut_lineage(_occurrences(docs, vocabulary))
    total = counted.agg(F.count("*").alias("docs"), F.sum("n").alias("words")).first()
    n_docs, n_words = total["docs"], total["words"] or 1
    held = np.zeros(len(vocabulary), np.int64)
    for r in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        held[r["term"]] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in held], np.int64)
    found = cut_lineage(_searched(counted, items, weights, n_docs, n_words, k))
    # No row below the k-th score of some task is among the k best of all.
    least = F.broadcast(found.where(F.col("place") == k - 1).groupBy("item").agg(F.max("score").alias("least")))
    near = found.join(least, "item", "left").where(F.col("least").isNull() | (F.col("score") >= F.col("least"))).where("score > 0")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salt = F.pmod(F.xxhash64("doc_id", "score"), F.lit(16))
    for keys in ([F.col("item"), salt], [F.col("item")]):
        near = near.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, x) for i, x in enumerate(item_ids)], "item int, item_id bigint")
    return near.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The ``k`` documents of highest score for each row of ``items``: (item_id, rank, doc_id, score), rank from 1.

    Equal scores come by ascending identifier, null ones last. Null texts and texts without a term are found by nothing and
    count nowhere; an item without a term of the corpus gives no row. Repeated rows are documents, and items, of their own.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    items = items.select(F.col(f"`{item_col}`").cast("bigint").alias("item_id"), F.col(f"`{item_text_col}`").cast("string").alias("text")).where(
        "text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text") + 8).alias("bytes")).first()["bytes"] or 0
    blocks = -(-size // ITEM_BYTES)
    out = []
    for i in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).orderBy("item_id", "text").collect()
        if rows:
            out.append(_block(docs, rows, k))
    if not out:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return reduce(DataFrame.unionByName, out)
