"""Substring dedup by suffix automata of reference shards.

Every window of 50 words has an anchor, its 8-gram of the smallest hash;
consecutive windows of one anchor make a context.  Equal windows have equal
anchors, so that only contexts whose anchor occurs in two documents matter.
Contexts equal as a whole are settled by counting.  Of the others one copy each
goes to the shard of its anchor.  A shard streams its contexts in the order of
document ids through the suffix automaton of those before: the matching
statistics give the maximal spans of 50 words or more.

A broadcast of the automata of all shards would grow with the corpus, so the
texts go to the shards instead, and only the contexts that need it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondeframe.llm.common import (
    key_bitmap, materialise, maybe_in_bitmap, remove_path, shuffle_partitions, stage_table, text_or_empty,
)
from sondeframe.llm.wordscan import _STEP, Words, _power_table, _prefix, mix, scan

WINDOW = 50
ANCHOR = 8
SHARD_CONTEXTS = 1000
#: An anchor with more distinct contexts is settled window by window.
HOT_CONTEXTS = 1000

_POSITION_BITS = 26


class SuffixAutomaton:
    """Of several word sequences; a state is its transitions, suffix link and length."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, p: int, symbol: int, q: int) -> int:
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: list[int]) -> None:
        last = 0
        for symbol in sequence:
            known = self.next[last].get(symbol)
            if known is not None:
                last = self._split(last, symbol, known)
                continue
            new = self._state(self.length[last] + 1, {}, 0)
            p = last
            while p >= 0 and symbol not in self.next[p]:
                self.next[p][symbol] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, symbol, self.next[p][symbol])
            last = new

    def spans(self, sequence: list[int], least: int) -> list[tuple[int, int]]:
        """Spans of the sequence covered by matches of at least ``least`` symbols.

        Every window of ``least`` symbols in a span matches; where one across a
        seam does not, a new span starts, which can overlap the one before.
        """
        moves, link, length = self.next, self.link, self.length
        state = matched = 0
        out: list[tuple[int, int]] = []
        for at, symbol in enumerate(sequence):
            while state and symbol not in moves[state]:
                state = link[state]
                matched = length[state]
            if symbol in moves[state]:
                state = moves[state][symbol]
                matched += 1
            else:
                matched = 0
            if matched >= least:
                begin = at + 1 - matched
                if out and out[-1][1] == at:
                    out[-1] = (out[-1][0], at + 1)
                else:
                    out.append((begin, at + 1))
        return out


def contexts(words: Words, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(document, anchor hash, context hash, first window, last window) of all contexts.

    Windows are numbered by their first word within the document.
    """
    n = len(words.hashes)
    empty = tuple(np.zeros(0, dtype=t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    at, grams = words.grams(anchor)
    if n < window or not len(at):
        return empty
    low = np.uint64((1 << _POSITION_BITS) - 1)
    keys = np.full(n, np.uint64(2**64 - 1))
    keys[at] = (grams & ~low) | (at.astype(np.uint64) & low)  # of equal hashes the leftmost
    width = window - anchor + 1
    reach, least = 1, keys
    while reach * 2 <= width:
        least = np.minimum(least[: len(least) - reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    last = np.repeat(words.bounds[1:], np.diff(words.bounds))[: len(least)]
    starts = np.flatnonzero(np.arange(len(least)) + window <= last)
    if not len(starts):
        return empty
    chosen = least[starts]
    doc = words.docs[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    stop = np.append(first[1:], len(starts)) - 1
    begin, end = starts[first], starts[stop] + window
    p = _prefix(words.hashes, _STEP)
    whole = mix((p[end] - p[begin]) * _power_table(_STEP, n)[1][begin] + (end - begin).astype(np.uint64))
    place = np.zeros(n, dtype=np.int64)
    place[at] = np.arange(len(at))
    position = begin - (begin & int(low)) + (chosen[first] & low).astype(np.int64)  # the high bits are those of the window's start
    position += np.where(position < begin, 1 << _POSITION_BITS, 0)
    base = words.bounds[doc[first]]
    return doc[first], grams[place[position]], whole, begin - base, starts[stop] - base


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, words in scan(batch.column("text")):
            doc, anchor, whole, begin, end = contexts(words)
            rows = pa.array(doc + first)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(rows), batch.column("key").take(rows), pa.array(anchor.view(np.int64)),
                 pa.array(whole.view(np.int64)), pa.array(begin, pa.int32()), pa.array(end, pa.int32())],
                names=["doc_id", "key", "anchor", "context", "first", "last"],
            )


_CONTEXTS = "doc_id long, key long, anchor long, context long, first int, last int"


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the wanted contexts; of hot anchors a row for each window, with its hash."""
    schema = pa.schema([("anchor", pa.int64()), ("context", pa.int64()), ("doc_id", pa.int64()), ("words", pa.string()), ("lo", pa.int32()), ("window", pa.int64())])
    rows: list[tuple] = []

    def packed() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for batch in batches:
        for doc, text, wanted in zip(*[batch.column(c) for c in ("doc_id", "text", "wanted")], strict=True):
            words = text.as_py().encode().split()
            for c in wanted.as_py():
                cut = b" ".join(words[c["first"] : c["last"] + WINDOW]).decode()
                if c["hot"]:
                    _, own = next(scan(pa.array([cut])))
                    hashes = own.grams(WINDOW)[1].view(np.int64).tolist()
                    rows += [(c["anchor"], c["context"], doc.as_py(), None, lo, h) for lo, h in enumerate(hashes)]
                else:
                    rows.append((c["anchor"], c["context"], doc.as_py(), cut, None, None))
            if len(rows) >= 5000:
                yield packed()
                rows = []
    yield packed()


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (shard, doc_id): spans known from smaller documents."""
    shard = doc = None
    automaton, ids, waiting = SuffixAutomaton(), {}, []
    for batch in batches:
        rows: list[tuple[int, int, int, int]] = []
        for s, d, anchor, context, text in zip(*[batch.column(c).to_pylist() for c in ("shard", "doc_id", "anchor", "context", "words")], strict=True):
            if s != shard:
                automaton, ids, waiting = SuffixAutomaton(), {}, []
            elif d != doc:
                for sequence in waiting:
                    automaton.add(sequence)
                waiting = []
            shard, doc = s, d
            sequence = [ids.setdefault(w, len(ids)) for w in text.encode().split()]
            spans = automaton.spans(sequence, WINDOW)
            rows += [(anchor, context, lo, hi) for lo, hi in spans]
            if spans != [(0, len(sequence))]:  # else all its windows are known
                waiting.append(sequence)
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["anchor", "context", "lo", "hi"]
        )


def _digest(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digests, texts = [], [], [], []
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                words = text.as_py().encode().split()
                n_words.append(len(words))
                if spans.as_py():
                    keep = np.ones(len(words), dtype=bool)
                    for span in spans.as_py():
                        keep[span["lo"] : span["hi"]] = False
                    words = list(compress(words, keep.tolist()))
                n_removed.append(n_words[-1] - len(words))
                kept = b" ".join(words)
                digests.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode() if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, spans): word ranges covered by windows of smaller documents."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).filter("doc_id is not null")
    source = source.withColumn("key", F.xxhash64("text"))
    every, path = stage_table(source.mapInArrow(_contexts, _CONTEXTS), "contexts")
    # written apart, so that both sides of the join are plain shuffles, which can be split where an anchor is hot
    shared, shared_path = stage_table(every.groupBy("anchor").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).filter("x != y").select("anchor"), "anchors")
    uses, uses_path = stage_table(every.join(shared, "anchor"), "shared-contexts")
    remove_path(spark, path)
    remove_path(spark, shared_path)

    distinct = uses.groupBy("anchor", "context").agg(F.min(F.struct("doc_id", "key", "first", "last")).alias("x")).select("anchor", "context", "x.*")
    per_anchor = distinct.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1")
    open_ = materialise(distinct.join(per_anchor, "anchor").withColumn("hot", F.col("n") > HOT_CONTEXTS).drop("n"))
    n_open = open_.filter("not hot").count()
    wanted = open_.groupBy("doc_id", "key").agg(F.collect_list(F.struct("anchor", "context", "first", "last", "hot")).alias("wanted"))
    holders = maybe_in_bitmap(source, key_bitmap(open_, "doc_id"), "hit", "doc_id").filter("hit").drop("hit")
    cut, cut_path = stage_table(
        holders.join(wanted, ["doc_id", "key"]).select("doc_id", "text", "wanted")
        .mapInArrow(_cut_out, "anchor long, context long, doc_id long, words string, lo int, window long"),
        "cut",
    )
    shards = max(shuffle_partitions(spark), -(-n_open // SHARD_CONTEXTS))
    matched = (
        cut.filter("words is not null").withColumn("shard", F.pmod("anchor", F.lit(shards)))
        .repartition(min(shards, shuffle_partitions(spark) * 4), "shard").sortWithinPartitions("shard", "doc_id")
        .mapInArrow(_match, "anchor long, context long, lo int, hi int")
    )
    windows = cut.filter("words is null").select("anchor", "context", "doc_id", "lo", "window")
    owners = windows.groupBy("anchor", "window").agg(F.min("doc_id").alias("owner"))
    hot = windows.join(owners, ["anchor", "window"]).filter("owner < doc_id").select("anchor", "context", "lo", (F.col("lo") + WINDOW).alias("hi"))

    parts = matched.unionByName(hot).groupBy("anchor", "context").agg(F.collect_set(F.struct("lo", "hi")).alias("parts"))
    # written apart for the same reason: a context can stand in very many documents
    known, known_path = stage_table(distinct.select("anchor", "context", F.col("doc_id").alias("owner")).join(parts, ["anchor", "context"], "left"), "known")
    spans = (
        uses.join(known, ["anchor", "context"])
        .withColumn("span", F.explode(
            F.when(F.col("doc_id") > F.col("owner"), F.array(F.struct(F.lit(0).alias("lo"), (F.col("last") - F.col("first") + WINDOW).alias("hi"))))
            .otherwise(F.col("parts"))))
        .select("doc_id", "key", F.struct((F.col("first") + F.col("span.lo")).alias("lo"), (F.col("first") + F.col("span.hi")).alias("hi")).alias("span"))
    )
    found = materialise(spans.groupBy("doc_id", "key").agg(F.collect_set("span").alias("spans")))
    for done in (uses_path, cut_path, known_path):
        remove_path(spark, done)
    return found


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per input row, without the words repeated from smaller documents.

    Words are runs outside 0x20 and 0x09-0x0D.  A word goes if a window of
    WINDOW consecutive words over it also starts in a document with a smaller
    id; windows are judged on the input.  A null text has no words.  A document
    without id loses nothing and takes nothing from others; documents of one id
    take nothing from each other.

    Columns: the id, n_words, n_removed (long), kept_sha256, kept_text (kept
    words joined by one space; null without ``with_text``).
    """
    spans = repeated_spans(docs, id_col, text_col)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("key", F.xxhash64("text"))
    flagged = maybe_in_bitmap(source, key_bitmap(spans, "doc_id"), "hit", "doc_id")
    none = F.lit(None).cast("array<struct<lo: int, hi: int>>").alias("spans")
    held = flagged.filter("hit").join(spans, ["doc_id", "key"], "left").select("doc_id", "text", "spans")
    free = flagged.filter("not hit").select("doc_id", "text", none)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    # the two scans stay apart: free rows need no shuffle
    out = held.mapInArrow(_digest(with_text), schema).unionByName(free.mapInArrow(_digest(with_text), schema))
    return out.withColumnRenamed("doc_id", id_col)
