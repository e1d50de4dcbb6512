"""N-gram Jaccard join by MinHash banding.

Documents with one text are one class, which is signed once.  The number of
rows a band (and of bands) follows from the recall wanted at the threshold.
Signatures meet in band buckets.  The members of a bucket compare their whole
signatures, a byte a hash: only pairs that agree in a share of hashes that no
pair at the threshold falls short of, but for a chance below that of the bands,
are candidates, so that chance meetings don't tie unlike texts together.  Groups
of candidates are verified on full n-gram sets.  Both comparisons run in blocks
of bounded size inside tasks, and give spanning edges and counts instead of a
row for a pair, so that a group of m near copies costs m rows times its number
of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondeframe.llm.common import fresh, in_bitmap, key_bitmap, materialise, once, shuffle_partitions, text_or_empty
from sondeframe.llm.components import connected_components
from sondeframe.llm.wordscan import Words, mix, scan

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
MAX_HASHES = 128
BLOCK = 256
#: Bytes of text of a block, on average over the blocks of a component.
BLOCK_BYTES = 8 << 20
SKETCH_BLOCK = 256
#: Standard deviations of a signature's estimate by which a candidate may fall short of the threshold: a chance of 3e-8.
SHORT = 5.4
COLUMNS = 8192


def choose_bands(threshold: float, recall: float, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective bands that reach the recall at the threshold.

    A pair of similarity s meets in one of b bands of r rows with probability
    1 - (1 - s**r)**b.
    """
    best = None
    for rows in range(1, max_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))) if threshold < 1 else 1
        if bands * rows > max_hashes:
            break
        best = (bands, rows)
    if best is None:
        raise ValueError("the recall can't be reached with so few hashes")
    return best


def least_agreement(threshold: float, hashes: int) -> int:
    """Hashes in which a candidate must agree."""
    return max(1, math.floor(threshold * hashes - SHORT * math.sqrt(threshold * (1 - threshold) * hashes)))


def gram_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Document numbers and hashes of the distinct n-grams of each document.

    A document of fewer words has one gram, all of its words; one without words
    has none.
    """
    at, grams = words.grams(n)
    docs = words.docs
    sizes = np.diff(words.bounds)
    short = np.flatnonzero((sizes > 0) & (sizes < n))
    extra = np.zeros(len(short), dtype=np.uint64)
    for k, d in enumerate(short):
        g = np.uint64(0)
        for h in words.hashes[words.bounds[d] : words.bounds[d + 1]]:
            g = np.uint64((int(g) * 0x100000001B3 + int(h)) & (2**64 - 1))
        extra[k] = g ^ np.uint64(sizes[d])
    owner = np.concatenate([docs[at], short])
    grams = np.concatenate([grams, mix(extra)])
    order = np.lexsort((grams, owner))
    owner, grams = owner[order], grams[order]
    fresh_ = np.ones(len(grams), dtype=bool)
    fresh_[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return owner[fresh_], grams[fresh_]


def _sign(n: int, bands: int, rows: int, sized: bool = False):
    rng = np.random.default_rng(7)
    mul = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary()), *([("size", pa.int64())] if sized else [])])

    def bands_of(owner: np.ndarray, grams: np.ndarray, docs: int) -> tuple[list[np.ndarray | None], list[bytes]]:
        cuts = np.searchsorted(owner, np.arange(docs + 1))
        sigs = np.full((docs, bands * rows), np.uint64(2**64 - 1))
        step = max(1, (1 << 21) // (bands * rows))
        full = np.flatnonzero(np.diff(cuts))
        at = 0
        while at < len(full):  # runs of documents of about `step` grams; a long one goes in parts
            stop = max(at + 1, int(np.searchsorted(cuts[full + 1], cuts[full[at]] + step, side="right")))
            own = full[at:stop]
            lo, hi = cuts[own[0]], cuts[own[-1] + 1]
            if len(own) > 1:
                sigs[own] = np.minimum.reduceat(grams[lo:hi, None] * mul + add, cuts[own] - lo, axis=0)
            else:
                for k in range(lo, hi, step):
                    part = grams[k : min(k + step, hi), None] * mul + add
                    sigs[own[0]] = np.minimum(sigs[own[0]], part.min(axis=0))
            at = stop
        keys = mix(sigs >> np.uint64(24)).reshape(docs, bands, rows)
        out = np.zeros((docs, bands), dtype=np.uint64)
        for r in range(rows):
            out = out * np.uint64(0x100000001B3) + keys[:, :, r]
        out = mix(out + np.arange(bands, dtype=np.uint64)).view(np.int64)
        sketches = (mix(sigs) >> np.uint64(56)).astype(np.uint8)
        return [out[d] if cuts[d + 1] > cuts[d] else None for d in range(docs)], [x.tobytes() for x in sketches]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, words in scan(batch.column("text")):
                docs = len(words.bounds) - 1
                bands_, sketches = bands_of(*gram_sets(words, n), docs)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, docs), batch.column("key").slice(first, docs),
                     pa.array(bands_, type=schema.field("bands").type), pa.array(sketches, pa.binary()),
                     *([pc.binary_length(batch.column("text").slice(first, docs)).cast(pa.int64())] if sized else [])],
                    schema=schema,
                )

    return run


def sketch_groups(sketches: np.ndarray, least: int) -> np.ndarray:
    """For each row the first row of its group: rows that agree in ``least`` bytes are tied.

    Groups grow from a row over all rows not yet reached, so that a group of
    near copies takes one step a row on a shrinking rest.
    """
    group = np.full(len(sketches), -1)
    rest = np.arange(len(sketches))
    while len(rest):
        first, rest = rest[0], rest[1:]
        group[first], todo = first, [first]
        while todo and len(rest):
            near = (sketches[rest] == sketches[todo.pop()]).sum(axis=1) >= least
            group[rest[near]] = first
            todo += rest[near].tolist()
            rest = rest[~near]
    return group


def _candidates(least: int):
    """Over rows sorted by (bucket, i, j): edges from each row to the first one of its group."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def edges(ids: np.ndarray, sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        group = sketch_groups(sketches, least)
        own = group != np.arange(len(group))
        return ids[own], ids[group[own]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, rows = None, np.zeros(0, np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("bucket", "i", "j")])
            new_ids = batch.column("doc_id").to_numpy()
            new_rows = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)
            if last is not None:  # the group at the end of the batch before goes on here
                keys = np.concatenate([np.repeat(last[:, None], len(ids), axis=1), keys], axis=1)
                new_ids, new_rows = np.concatenate([ids, new_ids]), np.concatenate([rows, new_rows])
            starts = np.flatnonzero(np.append(True, (np.diff(keys, axis=1) != 0).any(axis=0)))
            ends = np.append(starts[1:], len(new_ids))
            last, ids, rows = keys[:, starts[-1]], new_ids[starts[-1] :], new_rows[starts[-1] :]
            starts, ends = starts[:-1], ends[:-1]
            two = starts[ends - starts == 2]
            near = two[(new_rows[two] == new_rows[two + 1]).sum(axis=1) >= least]
            found = [(new_ids[near + 1], new_ids[near])]
            found += [edges(new_ids[s:e], new_rows[s:e]) for s, e in zip(starts, ends, strict=True) if e - s > 2]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], schema=schema)
        if last is not None and len(ids) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in edges(ids, rows)], schema=schema)

    return run


def candidate_groups(classes: DataFrame, bands: int, rows: int, threshold: float, block: int = SKETCH_BLOCK) -> DataFrame:
    """(node, component) of the classes (doc_id, bands, sketch) that have a candidate."""
    entries = classes.select("doc_id", F.explode("bands").alias("bucket"))
    buckets = (
        entries.groupBy("bucket").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("x"))
        .filter("low != high").groupBy("low", "high", "n", "x").agg(F.min("bucket").alias("bucket"))  # of buckets with the same members one is enough
        .select("bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    )
    # signatures join the few rows that share a bucket, not all of a document's bands
    placed = (
        entries.join(buckets, "bucket").join(classes.select("doc_id", "sketch"), "doc_id")
        .withColumn("at", F.pmod(F.xxhash64("doc_id", "bucket"), F.col("blocks")).cast("int"))
        .withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    )
    paired = placed.select("bucket", F.least("at", "to").alias("i"), F.greatest("at", "to").alias("j"), "doc_id", "sketch")
    edges = (
        paired.repartition(shuffle_partitions(classes.sparkSession), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
        .mapInArrow(_candidates(least_agreement(threshold, bands * rows)), "a long, b long")
    )
    return materialise(connected_components(edges))


def _links(left: list[tuple], right: list[tuple] | None, n: int, threshold: float) -> tuple[np.ndarray, np.ndarray, list]:
    """Weighted link counts of both sides' rows, and edges of a spanning forest.

    Rows are (id, copies, text).  right None: left against itself.
    """
    rows = left + (right or [])
    sets = []
    base = 0
    for first, words in scan(pa.array([r[2] for r in rows], type=pa.large_string())):
        owner, grams = gram_sets(words, n)
        sets.append((owner + first, grams))
        base = first
    owner = np.concatenate([s[0] for s in sets]) if sets else np.zeros(0, np.int64)
    grams = np.concatenate([s[1] for s in sets]) if sets else np.zeros(0, np.uint64)
    sizes = np.bincount(owner, minlength=len(rows)).astype(np.float64)
    _, column, often = np.unique(grams, return_inverse=True, return_counts=True)
    shared = often[column] > 1
    owner, column = owner[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    a, b = len(left), len(rows)
    common = np.zeros((a, b - a if right is not None else a), dtype=np.float64)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = int(column[-1]) + 1 if len(column) else 0
    for k in range(0, total, COLUMNS):
        lo, hi = np.searchsorted(column, [k, k + COLUMNS])
        m = np.zeros((b, min(COLUMNS, total - k)), dtype=np.float32)
        m[owner[lo:hi], column[lo:hi] - k] = 1
        common += m[:a] @ (m[a:] if right is not None else m).T
    other = sizes[a:] if right is not None else sizes
    linked = (common >= threshold * (sizes[:a, None] + other[None, :] - common) - 1e-9) & (common > 0)
    copies = np.array([r[1] for r in rows], dtype=np.int64)
    if right is None:
        np.fill_diagonal(linked, False)
        counts = linked.astype(np.int64) @ copies
        pairs = np.argwhere(np.triu(linked))
    else:
        counts = np.concatenate([linked.astype(np.int64) @ copies[a:], copies[:a] @ linked.astype(np.int64)])
        pairs = np.argwhere(linked) + [0, a]
    parent = list(range(b))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    edges = []
    for x, y in pairs.tolist():
        p, q = root(x), root(y)
        if p != q:
            parent[q] = p
            edges.append((rows[x][0], rows[y][0]))
    return counts, copies, edges


_OUT = pa.schema([("doc_id", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])


def _compare(n: int, threshold: float):
    """Over rows sorted by (component, i, j, side): the links of each pair of blocks."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        # by id: a row repeated in the input counts once
        left = list({r[1]: r[1:] for r in rows if r[0] == 0}.values())
        right = list({r[1]: r[1:] for r in rows if r[0] == 1}.values())
        counts, _, edges = _links(left, right or None, n, threshold)
        ids = [r[0] for r in left + right]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids + [e[0] for e in edges], pa.int64()), pa.array([*counts.tolist(), *[0] * len(edges)], pa.int64()),
             pa.array([None] * len(ids) + [e[1] for e in edges], pa.int64())], schema=_OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("component", "i", "j", "side", "doc_id", "copies", "text")]
            for c, i, j, side, doc, copies, text in zip(*columns, strict=True):
                if (c, i, j) != at and rows:
                    yield flush(rows)
                    rows = []
                at = (c, i, j)
                rows.append((side, doc, copies, text))
        if rows:
            yield flush(rows)

    return run


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS,
                    threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per document: its class and its number of links.

    Two documents are linked if the Jaccard similarity of their sets of word
    n-grams is at least the threshold; words are runs outside 0x20 and
    0x09-0x0D, unchanged.  A document of fewer than n words has one gram, all
    of its words.  A null, empty or blank text has no grams and no link.  A
    class is what chains of links connect; its id is its smallest document id.
    Documents without id can be no link's end: they get a null class and 0.
    Rows repeated with one id count as one document, by the smallest of their
    texts' digests.

    Columns: the id, class_id, n_links (long: other documents linked to it,
    copies included).
    """
    bands, rows = choose_bands(threshold, recall)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    keyed = source.withColumn("key", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)))
    signed = keyed.mapInArrow(_sign(n, bands, rows, sized=True), "doc_id long, key binary, bands array<long>, sketch binary, size long")
    members = materialise(
        signed.groupBy("doc_id").agg(F.min(F.struct("key", "bands", "sketch", "size")).alias("x")).select("doc_id", "x.key", "x.bands", "x.sketch", "x.size")
    )
    classes = materialise(
        members.filter("doc_id is not null and bands is not null").groupBy("key")
        .agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("size").alias("size"))
    )
    candidates = candidate_groups(classes, bands, rows, threshold)

    # a block is bounded in texts and in bytes
    known = candidates.join(classes.select(F.col("doc_id").alias("node"), "key", "copies", "size"), "node")
    sizes = known.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("size") / BLOCK_BYTES)).cast("int").alias("blocks"))
    placed = (
        known.join(sizes, "component")
        .withColumn("at", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .select(F.col("node").alias("doc_id"), "component", "blocks", "at", "copies", "key")
    )
    texts = in_bitmap(keyed, key_bitmap(placed, "doc_id"), "doc_id").join(placed, ["doc_id", "key"])
    paired = texts.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "component", F.least("at", "to").alias("i"), F.greatest("at", "to").alias("j"),
        F.when(F.col("at") > F.col("to"), 1).otherwise(0).alias("side"), "doc_id", "copies", "text",
    )
    compared = materialise(
        paired.repartition(shuffle_partitions(docs.sparkSession), "component", "i", "j")
        .sortWithinPartitions("component", "i", "j", "side")
        .mapInArrow(_compare(n, threshold), "doc_id long, links long, other long")
    )
    links = compared.filter("other is null").groupBy("doc_id").agg(F.sum("links").alias("links"))
    joined = connected_components(compared.filter("other is not null"), "doc_id", "other")
    found = (
        classes.select("key", "doc_id", "copies").join(links, "doc_id", "left")
        .join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("key", F.coalesce("component", "doc_id").alias("class_id"),
                (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    # copies of a text share the row of their class; the others are a class each
    in_class = members.filter("doc_id is not null and bands is not null").select("doc_id", "key").join(found, "key").select("doc_id", "class_id", "n_links")
    alone = members.filter("doc_id is null or bands is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return in_class.unionByName(alone).withColumnRenamed("doc_id", id_col)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input's rows, of each class the one whose id is the class id.

    Rows without id are kept; of rows repeated with one id one stays.
    """
    class_id = fresh(docs, "class_id")
    found = jaccard_classes(docs, id_col, text_col, **options)
    kept = found.filter(F.col(id_col) == F.col("class_id")).select(F.col("class_id").alias(class_id))
    same = docs.join(kept, F.col(id_col) == F.col(class_id), "left_semi")
    return once(same, [id_col]).unionByName(docs.filter(F.col(id_col).isNull()))
