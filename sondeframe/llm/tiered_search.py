"""Ranked lexical search over an index in tiers of impact.

Every document is scanned once: its terms and their counts go to a table by
document, from which postings (term, document, impact) follow.  The impact is
the part of a score that no query changes.  A histogram of impacts for each
term cuts its postings into tiers, the highest impacts first, and says how high
an impact is left below each cut.

A query reads the first tier of its terms.  The documents found there are scored
exactly where their bound allows a place in the result; a document not found
scores at most the sum of what is left below the cuts.  While that sum is not
below the last place, the query falls through to the next tier, for those terms
alone that could still bring a document in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sondeframe.llm.common import in_bitmap, key_bitmap, materialise, remove_path, scratch_path
from sondeframe.llm.wordscan import PUNCTUATION, scan

#: Postings of a term in its first tier, and in the first two; the last tier holds the rest.
TIERS = (1 << 10, 1 << 15)
#: Impacts are counted in steps of so many, as a power of two.
STEP_BITS = 8
#: Bits of the bitmap that tells which terms are wanted, as a power of two.
WANTED_BITS = 23
#: Rows of a table up to which it is broadcast.
BROADCAST_ROWS = 200_000


def _unsigned(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes >> np.uint64(64 - WANTED_BITS)).astype(np.int64)
    return (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


def _terms(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each text the number of its terms, and hash and count of each wanted one."""
        for batch in batches:
            for first, words in scan(batch.column("text"), lower=True, space=PUNCTUATION):
                n = len(words.bounds) - 1
                docs, hashes = words.docs, words.hashes
                if wanted is not None:
                    own = _unsigned(wanted.value, hashes)
                    docs, hashes = docs[own], hashes[own]
                order = np.lexsort((hashes, docs))
                docs, hashes = docs[order], hashes[order]
                starts = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])])) if len(docs) else np.zeros(0, np.int64)
                offsets = pa.array(np.searchsorted(docs[starts], np.arange(n + 1)).astype(np.int32))
                counts = np.diff(np.append(starts, len(docs))).astype(np.int32)
                keep = batch.slice(first, n).select([c for c in batch.schema.names if c != "text"])
                yield pa.RecordBatch.from_arrays(
                    [*keep.columns, pa.array(np.diff(words.bounds).astype(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(hashes[starts].view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(counts))],
                    names=[*keep.schema.names, "n", "terms", "tfs"],
                )

    return run


def _scanned(rows: DataFrame, wanted=None) -> DataFrame:
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(_terms(wanted), f"{kept}, n long, terms array<long>, tfs array<int>")


def _wanted_bits(terms: DataFrame) -> np.ndarray:
    """A bitmap of the terms' upper bits: at most 2**WANTED_BITS bits come to the driver."""
    at = F.shiftrightunsigned("term", 64 - WANTED_BITS)
    rows = (
        terms.select(F.shiftright(at, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int")).alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("mask")).collect()
    )
    bits = np.zeros(1 << (WANTED_BITS - 6), dtype=np.int64)
    bits[[r["word"] for r in rows]] = [r["mask"] for r in rows]
    return bits.view(np.uint64)


def _few(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


@dataclass(frozen=True)
class TieredIndex:
    """Tables in a folder: ``docs`` (uid, doc_id, n, terms, tfs), ``terms`` (term, weight, top, cuts, left) and ``postings`` (term, uid, impact; by tier).

    weight: of the term; top: its highest impact; left[k - 1]: the highest
    impact below its first k tiers.
    """

    spark: SparkSession
    path: str
    length: Column  # the documents' m
    n_terms: int

    def docs(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/docs").withColumn("m", self.length)

    def terms(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/terms")

    def postings(self, tier: int) -> DataFrame:
        return self.spark.read.schema("term long, uid long, impact long").parquet(f"{self.path}/postings/tier={tier}") if tier <= len(TIERS) + 1 else None

    def remove(self) -> None:
        remove_path(self.spark, self.path)


def _impact(tf: Column, m: Column) -> Column:
    return F.call_function("div", F.lit(1_000_000_000).cast("long") * tf, 1000 * tf + 8 * m)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", terms: DataFrame | None = None, path: str | None = None) -> TieredIndex:
    """Scan every document and write the index; with ``terms`` (term long) postings of those alone are kept.

    A term is a run of letters and digits of ASCII and of characters beyond it,
    A-Z in lower case, known by a 64-bit hash.  Null texts have none.  Every row
    is a document.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "index")
    wanted = None if terms is None else spark.sparkContext.broadcast(_wanted_bits(terms))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("uid", F.monotonically_increasing_id())
    _scanned(rows, wanted).write.parquet(f"{path}/docs")
    scanned = spark.read.parquet(f"{path}/docs")
    n, length = scanned.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    m = F.lit(10).cast("long") + (F.call_function("div", F.lit(90 * n).cast("long") * F.col("n"), F.lit(length).cast("long")) if length else F.lit(0).cast("long"))

    pairs = scanned.select("uid", m.alias("m"), F.explode(F.arrays_zip("terms", "tfs")).alias("x"))
    postings = pairs.select("uid", F.col("x.terms").alias("term"), _impact(F.col("x.tfs").cast("long"), F.col("m")).alias("impact"))
    step = F.shiftright("impact", STEP_BITS)
    counts = postings.groupBy("term", step.alias("step")).agg(F.count("*").alias("n"), F.max("impact").alias("top"))
    if terms is not None:
        counts = counts.join(terms.select("term").distinct(), "term", "left_semi")
    before = F.sum("n").over(Window.partitionBy("term").orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, -1))
    tier = F.lit(1)
    for size in TIERS:
        tier = tier + (F.coalesce(before, F.lit(0)) >= size).cast("int")
    each = range(1, len(TIERS) + 1)
    (
        counts.withColumn("tier", tier).groupBy("term").agg(
            F.sum("n").alias("df"), F.max("top").alias("top"),
            F.array(*[F.min(F.when(F.col("tier") <= k, F.col("step"))) for k in each]).alias("cuts"),
            F.array(*[F.coalesce(F.max(F.when(F.col("tier") > k, F.col("top"))), F.lit(0)) for k in each], F.lit(0).cast("long")).alias("left"),
        )
        .withColumn("weight", F.floor(1000 * F.log((F.lit(2.0) * n + 2) / (F.lit(2.0) * F.col("df") + 1))))
        .write.parquet(f"{path}/terms")
    )
    known = spark.read.parquet(f"{path}/terms")
    n_terms = known.count()
    own = F.lit(1)
    for k in each:
        own = own + (step < F.col("cuts")[k - 1]).cast("int")
    (
        postings.join(_few(known.select("term", "cuts"), n_terms), "term").select("term", "uid", "impact", own.alias("tier"))
        .write.partitionBy("tier").parquet(f"{path}/postings")
    )
    # a tier that no posting reached is an empty folder
    for k in range(1, len(TIERS) + 2):
        postings.select("term", "uid", "impact").limit(0).write.mode("append").parquet(f"{path}/postings/tier={k}")
    return TieredIndex(spark, path, m, n_terms)


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(item, item_id) of the different items, and (item, term) of their different terms."""
    own = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).distinct().withColumn("item", F.monotonically_increasing_id())
    scanned = materialise(_scanned(own))
    return scanned.select("item", "item_id"), scanned.select("item", F.explode("terms").alias("term"))


def search(index: TieredIndex, items: DataFrame, wanted: DataFrame, k: int = 10) -> DataFrame:
    """The k documents of highest score above 0 for each item, of equal ones the smaller doc_id (null last).

    Columns: item_id, rank (int, from 1), doc_id, score (long), tier (the
    deepest tier that was read for the item).
    """
    spark = index.spark
    terms = materialise(
        wanted.join(_few(index.terms(), index.n_terms), "term").filter("weight > 0")
        .select("item", "term", "weight", "left", (F.col("weight") * F.col("top")).alias("bound"), F.lit(1).alias("tier"))
    )
    n_terms = terms.count()
    best = spark.createDataFrame([], "item long, uid long, doc_id long, score long")
    out = []
    for tier in range(1, len(TIERS) + 2):
        # ``bound``: what the term adds at most to a document that no tier read so far has shown
        reading = terms.filter(F.col("tier") == tier)
        rest = F.when(F.col("tier") == tier, F.col("weight") * F.col("left")[tier - 1]).otherwise(F.col("bound"))
        floors = best.groupBy("item").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(0).alias("floor"))
        sums = terms.groupBy("item").agg(F.sum(rest).alias("rest"))
        state = sums.join(floors, "item", "left").select("item", "rest", F.coalesce("floor", F.lit(0)).alias("floor"))
        found = materialise(
            index.postings(tier).join(_few(reading.select("item", "term", "weight", "left"), n_terms), "term")
            .groupBy("item", "uid")
            .agg(F.sum(F.col("weight") * F.col("impact")).alias("known"), F.sum(F.col("weight") * (F.col("impact") - F.col("left")[tier - 1])).alias("over"))
        )
        by_known = Window.partitionBy("item").orderBy(F.col("known").desc())
        kth = (
            found.select("item", "known").withColumn("r", F.row_number().over(by_known)).filter(F.col("r") <= k)
            .groupBy("item").agg(F.when(F.count("*") >= k, F.min("known")).otherwise(0).alias("kth"))
        )
        may = materialise(
            found.join(_few(state.join(kth, "item"), n_terms), "item")
            .filter(F.col("over") + F.col("rest") >= F.greatest("floor", "kth")).select("item", "uid")
        )
        scored = _exact(index, may, terms, n_terms)
        by_score = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "uid")
        best = materialise(
            scored.unionByName(best).dropDuplicates(["item", "uid"]).withColumn("r", F.row_number().over(by_score)).filter(F.col("r") <= k).drop("r")
        )
        # an item is proven when no unseen document reaches its last place
        last = best.groupBy("item").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(0).alias("last"))
        open_terms = terms.withColumn("bound", rest).join(_few(sums.join(last, "item", "left").select("item", "rest", F.coalesce("last", F.lit(0)).alias("last")), n_terms), "item")
        proven = F.when(F.col("rest") == 0, True).otherwise(F.col("rest") < F.col("last"))
        done = open_terms.filter(proven).select("item").distinct()
        out.append(best.join(done, "item", "left_semi").withColumn("tier", F.lit(tier)))
        # the commonest terms stay where they are as long as all of them together stay below the last place
        common = Window.partitionBy("item").orderBy("weight", "term").rowsBetween(Window.unboundedPreceding, 0)
        terms = materialise(
            open_terms.filter(~proven).withColumn("sum", F.sum("bound").over(common))
            .select("item", "term", "weight", "left", "bound", F.when((F.col("sum") < F.col("last")) | (F.col("bound") == 0), F.lit(0)).otherwise(tier + 1).alias("tier"))
        )
        n_terms = terms.count()
        if not n_terms:
            break
        best = best.join(_few(terms.select("item").distinct(), n_terms), "item", "left_semi")
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    by_score = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "uid")
    return (
        every.filter("score > 0").withColumn("rank", F.row_number().over(by_score)).join(items, "item")
        .select("item_id", "rank", "doc_id", "score", "tier")
    )


def _exact(index: TieredIndex, may: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """(item, uid, doc_id, score) of pairs (item, uid): the documents' own terms are looked up by document."""
    docs = in_bitmap(index.docs(), key_bitmap(may, "uid"), "uid")
    pairs = may.join(docs, "uid").select("item", "uid", "doc_id", "m", F.explode(F.arrays_zip("terms", "tfs")).alias("x"))
    return (
        pairs.select("item", "uid", "doc_id", F.col("x.terms").alias("term"), _impact(F.col("x.tfs").cast("long"), F.col("m")).alias("impact"))
        .join(_few(terms.select("item", "term", "weight"), n_terms), ["item", "term"])
        .groupBy("item", "uid", "doc_id").agg(F.sum(F.col("weight") * F.col("impact")).alias("score"))
    )


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The k best documents of each item, by an index of the items' terms over all documents.

    Columns as in ``search``; doc_id is a long.  Items equal in id and text are
    one; items without a known term, and documents that score 0, give no row.
    Null texts have no terms; rows of a repeated doc_id are documents of their
    own, and a null doc_id comes last among equal scores.  Empty tables give an
    empty result; other columns are not read.
    """
    own, wanted = item_terms(items)
    index = build_index(docs.withColumn("doc_id", F.col("doc_id").cast("long")), terms=wanted)
    found = materialise(search(index, own, wanted, k))
    index.remove()
    return found
