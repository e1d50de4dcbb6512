"""Benchmark decontamination: rare n-gram seeds and Smith-Waterman alignment.

Seeds are word 3-grams of the test items: those that the corpus' word counts
make rare, and the rarest of every few in a row.  They join documents to items: inside the scan
where the items are few enough to be broadcast, else by a shuffle on the seeds'
hashes, in three passes over the documents however many items there are.  The
stretch of text around a seed is aligned with the item, and the score, as a
share of the best possible, says whether it is an edited copy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondeframe.llm.common import fresh, in_bitmap, key_bitmap, materialise, text_or_empty
from sondeframe.llm.wordscan import PUNCTUATION, Words, scan

SEED_WORDS = 3
#: Chance hits of all seeds together that one word of text may cost; a seed's share of it does not follow the corpus' size.
HITS_A_WORD = 2e-3
#: Of so many n-grams in a row one is a seed, however common.
STRETCH = 4
#: Items of one row that are aligned with a document.
ITEMS_A_ROW = 64
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST_SCORE = 0.5
#: Text of test items up to which they are broadcast.
BROADCAST_BYTES = 8 << 20


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman: (score, start, stop) of the best local alignment in text.

    One numpy step a word of the item; a gap costs as much for each word, so
    that gaps along the row are a running maximum.
    """
    score, stop = _best(item, text)
    if score <= 0:
        return 0, 0, 0
    _, length = _best(item[::-1], text[:stop][::-1])
    return score, stop - length, stop


def _best(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    slope = np.arange(len(text) + 1, dtype=np.int32) * -GAP
    row = np.zeros(len(text) + 1, dtype=np.int32)
    best, at = 0, 0
    for word in item:
        step = np.where(text == word, MATCH, MISMATCH)
        new = np.maximum(row + GAP, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + step)
        row = np.maximum.accumulate(new + slope) - slope
        k = int(row.argmax())
        if row[k] > best:
            best, at = int(row[k]), k
    return best, at


def _hashes(texts: list[str | None]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, words in scan(pa.array(texts, pa.large_string()), lower=True, space=PUNCTUATION):
        out += np.split(words.hashes, words.bounds[1:-1])
    return out


def _grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """The same hashes of n-grams as Words.grams; of all words where there are fewer."""
    n = min(n, len(hashes))
    return Words(hashes, hashes, hashes, hashes, np.array([0, len(hashes)])).grams(n)[1] if n else hashes[:0]


def _count(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        counts = np.zeros(len(known) + 1, dtype=np.int64)  # the last: all words
        for batch in batches:
            for _, words in scan(batch.column(0), lower=True, space=PUNCTUATION):
                at = np.minimum(np.searchsorted(known, words.hashes), len(known) - 1)
                counts[:-1] += np.bincount(at[known[at] == words.hashes], minlength=len(known))
                counts[-1] += len(words.hashes)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], names=["word", "n"])

    return run


def seed_rate(item_words: int) -> float:
    """The share of a corpus' n-grams that a seed may be, where the items have so many words in all."""
    return HITS_A_WORD / max(1, item_words)


def seed_places(item: np.ndarray, logs: np.ndarray, log_rate: float) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, places, hashes) of the item's seeds; logs are of its words' shares in the corpus.

    Seeds are the n-grams that words drawn at those shares would make up less
    often than the rate, and in each stretch of places the least likely one, so
    that seeds lie all over the item and are the same in a corpus of any size.
    """
    n = min(SEED_WORDS, len(item))
    if not n:
        return 0, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    expected = sum(logs[j : len(item) - n + 1 + j] for j in range(n))
    rare = set(np.flatnonzero(expected <= log_rate))
    rare |= {k + int(expected[k : k + STRETCH].argmin()) for k in range(0, len(expected), STRETCH)}
    places = np.array(sorted(rare), dtype=np.int64)
    return n, places, _grams(item, n)[places]


class _Seeds:
    """Items and their seeds, sorted by n-gram length and hash."""

    def __init__(self, ids: list[int], items: list[np.ndarray], seeds: list[tuple[int, np.ndarray, np.ndarray]]):
        self.ids, self.items = ids, items
        tables: dict[int, list[tuple[int, int, int]]] = {}
        for k, (n, places, hashes) in enumerate(seeds):
            if n:
                tables.setdefault(n, []).extend(zip(hashes.tolist(), [k] * len(places), places.tolist(), strict=True))
        self.tables = {}
        for n, rows in tables.items():
            rows.sort()
            self.tables[n] = (np.array([r[0] for r in rows], dtype=np.uint64), np.array([r[1:] for r in rows], dtype=np.int64))


_FOUND = "doc_id long, item_id long, score double, start long, n_words long"


def _hits(words: Words, own: _Seeds) -> np.ndarray:
    """Rows (document, item, diagonal) of all seeds in the words."""
    found = []
    docs = words.docs
    for n, (hashes, targets) in own.tables.items():
        at, grams = words.grams(n)
        low, high = np.searchsorted(hashes, grams, "left"), np.searchsorted(hashes, grams, "right")
        hit = np.flatnonzero(high > low)
        times = (high - low)[hit]
        seed = np.repeat(low[hit], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        where = np.repeat(at[hit], times)
        found.append(np.stack([docs[where], targets[seed, 0], where - targets[seed, 1]], axis=1))
    every = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    return every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]


def _aligned(words: Words, own: _Seeds) -> list[tuple[int, int, float, int, int]]:
    """(document, item, score, start, n_words) of the best copy of each item, around its seeds."""
    every = _hits(words, own)
    if not len(every):
        return []
    sizes = np.array([len(x) for x in own.items])[every[:, 1]]
    new = np.ones(len(every), dtype=bool)
    new[1:] = (every[1:, :2] != every[:-1, :2]).any(axis=1) | (np.diff(every[:, 2]) > sizes[1:])
    cuts = np.append(np.flatnonzero(new), len(every))
    best: dict[tuple[int, int], tuple] = {}
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        d, k = int(every[lo, 0]), int(every[lo, 1])
        item = own.items[k]
        slack = len(item) // 2 + 1
        begin = max(int(every[lo, 2]) - slack, int(words.bounds[d]))
        stop = min(int(every[hi - 1, 2]) + len(item) + slack, int(words.bounds[d + 1]))
        score, start, end = align(item, words.hashes[begin:stop])
        share = score / (MATCH * len(item))
        if share >= LEAST_SCORE and share > best.get((d, k), (0,))[0]:
            best[d, k] = (share, begin + start - int(words.bounds[d]), end - start)
    return [(d, k, *x) for (d, k), x in best.items()]


def _found(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    types = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "item_id", "score", "start", "n_words"])


def _search(seeds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = seeds.value
        for batch in batches:
            ids = batch.column("doc_id")
            rows = []
            for first, words in scan(batch.column("text"), lower=True, space=PUNCTUATION):
                rows += [(ids[first + d].as_py(), own.ids[k], *x) for d, k, *x in _aligned(words, own)]
            yield _found(rows)

    return run


def _by_broadcast(source: DataFrame, items: DataFrame) -> DataFrame:
    """Two passes over the documents; the items, of bounded text, go to every task."""
    context = source.sparkSession.sparkContext
    part = items.orderBy("item_id", "text").collect()
    hashes = _hashes([r["text"] for r in part])
    known = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
    if not len(known):
        return source.sparkSession.createDataFrame([], _FOUND)
    counts = np.zeros(len(known) + 1)
    counted = source.select("text").mapInArrow(_count(context.broadcast(known)), "word int, n long")
    for word, n in counted.groupBy("word").agg(F.sum("n")).collect():  # a row for each word of the items
        counts[word] = n
    logs = np.log(np.maximum(counts[:-1], 1.0)) - np.log(max(1.0, counts[-1]))
    log_rate = float(np.log(seed_rate(sum(map(len, hashes)))))
    seeds = [seed_places(item, logs[np.searchsorted(known, item)], log_rate) for item in hashes]
    return source.mapInArrow(_search(context.broadcast(_Seeds([r["item_id"] for r in part], hashes, seeds))), _FOUND)


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of runs of texts with their numbers; the word null: all words."""
    for batch in batches:
        for _, words in scan(batch.column(0), lower=True, space=PUNCTUATION):
            own, n = np.unique(words.hashes.view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([*own.tolist(), None], pa.int64()), pa.array([*n.tolist(), len(words.hashes)], pa.int64())], names=["word", "n"])


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [h.view(np.int64) for h in _hashes(batch.column("text").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("item_id"), pa.array(lists, pa.list_(pa.int64()))], names=["item", "item_id", "words"])


def _item_seeds(total: int, item_words: int):
    log_total, log_rate = float(np.log(max(1.0, total))), float(np.log(seed_rate(item_words)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for words, counts in zip(batch.column("words"), batch.column("counts"), strict=True):
                logs = np.log(np.maximum(np.array(counts.as_py(), dtype=float), 1.0)) - log_total
                n, places, hashes = seed_places(np.array(words.as_py(), dtype=np.int64).view(np.uint64), logs, log_rate)
                rows.append((n, places.tolist(), hashes.view(np.int64).tolist()))
            arrays = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("item_id"), batch.column("words"), *arrays], names=["item", "item_id", "words", "n", "places", "hashes"])

    return run


def _grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct n-grams of each document, of every length that seeds have."""
    for batch in batches:
        for first, words in scan(batch.column("text"), lower=True, space=PUNCTUATION):
            docs = words.docs
            for n in range(1, SEED_WORDS + 1):
                at, grams = words.grams(n)
                pairs = np.unique(np.stack([docs[at], grams.view(np.int64)], axis=1), axis=0)
                owners = pa.array(pairs[:, 0] + first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(owners), batch.column("key").take(owners), pa.array(np.full(len(pairs), n, np.int32)), pa.array(pairs[:, 1].copy())],
                    names=["doc_id", "key", "n", "gram"],
                )


def _align_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc, text, items in zip(batch.column("doc_id"), batch.column("text"), batch.column("items"), strict=True):
            rows = items.as_py()
            seeds = [(r["n"], np.array(r["places"], np.int64), np.array(r["hashes"], np.int64).view(np.uint64)) for r in rows]
            own = _Seeds([r["item_id"] for r in rows], [np.array(r["words"], np.int64).view(np.uint64) for r in rows], seeds)
            for _, words in scan(pa.array([text.as_py()], pa.large_string()), lower=True, space=PUNCTUATION):
                yield _found([(doc.as_py(), own.ids[k], *x) for _, k, *x in _aligned(words, own)])


def _by_join(source: DataFrame, items: DataFrame) -> DataFrame:
    """Three passes over the documents, whatever the number of items: word counts, seeds, alignment."""
    listed = materialise(
        items.distinct().withColumn("item", F.monotonically_increasing_id()).mapInArrow(_item_words, "item long, item_id long, words array<long>").filter(F.size("words") > 0)
    )
    each = listed.select("item", F.posexplode("words").alias("place", "word"))
    vocabulary = each.select("word").distinct()
    counted = source.select("text").mapInArrow(_words_of, "word long, n long")
    used = in_bitmap(counted.filter("word is not null"), key_bitmap(vocabulary, "word"), "word").unionByName(counted.filter("word is null"))
    counts = materialise(used.groupBy("word").agg(F.sum("n").alias("count")))
    total = counts.filter("word is null").first()
    of_items = (
        each.join(counts, "word", "left").groupBy("item").agg(F.sort_array(F.collect_list(F.struct("place", F.coalesce("count", F.lit(0)).alias("count")))).alias("x"))
        .select("item", F.col("x.count").alias("counts"))
    )
    item_words = listed.agg(F.sum(F.size("words"))).first()[0] or 0
    seeded = materialise(listed.join(of_items, "item").mapInArrow(_item_seeds(total["count"] if total else 0, item_words), "item long, item_id long, words array<long>, n int, places array<long>, hashes array<long>"))
    seeds = seeded.select("item", "n", F.explode("hashes").alias("gram"))
    keyed = source.withColumn("key", F.xxhash64("text"))
    grams = in_bitmap(keyed.mapInArrow(_grams_of, "doc_id long, key long, n int, gram long"), key_bitmap(seeds, "n", "gram"), "n", "gram")
    pairs = materialise(grams.join(seeds, ["n", "gram"]).select("doc_id", "key", "item").distinct())
    nth = F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("item"))
    wanted = (
        pairs.withColumn("row", F.floor((nth - 1) / ITEMS_A_ROW)).join(seeded, "item")
        .groupBy("doc_id", "key", "row").agg(F.collect_list(F.struct("item_id", "words", "n", "places", "hashes")).alias("items"))
    )
    texts = in_bitmap(keyed, key_bitmap(pairs, "key"), "key")
    rows = texts.join(wanted.withColumnsRenamed({"doc_id": "w_id", "key": "w_key"}), F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("key") == F.col("w_key")))
    return rows.select("doc_id", "text", "items").mapInArrow(_align_rows, _FOUND)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and test item that it holds an edited copy of.

    Words are runs of letters, digits and non-ASCII bytes, in lower case.  An
    item's seeds are its 3-grams that are rare if words were independent, so that
    all seeds together hit HITS_A_WORD times a word by chance, and the rarest of each
    STRETCH in a row; an item of fewer words is one seed, one without words has
    none.  Shares of words count, and not their numbers: seeds don't follow the
    corpus' size.  The score is the alignment's as a share
    of a perfect copy's; rows have at least LEAST_SCORE.  Null texts count as
    empty; a document repeated with its id gives one row, the best, and of
    placements of one score the first.  A null document or item id is an id
    like others.  Items of at most BROADCAST_BYTES of text are broadcast; of
    more the seeds are shuffled.  Both ways give the same rows.

    Columns: the id, the item's id, score, start (first word of the copy) and
    n_words (its length in words).
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(text_or_empty(text_col)).alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.lower(text_or_empty(item_text)).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = (_by_broadcast if size <= BROADCAST_BYTES else _by_join)(source, items)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", -F.col("start"), "n_words")).alias("x"))
    return best.select(F.col("doc_id").alias(id_col), F.col("item_id").alias(item_col), "x.score", (-F.col("x.col2")).alias("start"), "x.n_words")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows without the documents that hold a copy of a test item.

    All rows of an id go if one holds a copy; null and empty texts hold none.
    """
    bad_id = fresh(docs, "bad_id")
    bad = contaminated(docs, benchmark, id_col, text_col).select(F.col(id_col).alias(bad_id)).distinct()
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col(bad_id)), "left_anti")
