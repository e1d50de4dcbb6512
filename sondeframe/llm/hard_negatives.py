"""Hard negatives by a vector-approximation file.

Rows are dealt over splits.  A split keeps, beside its vectors, the cell of each
component (at most CELLS a dimension).  For an anchor, tables hold the least and the
largest product of its component with a value in each cell; adding the entries
of a row's cells gives bounds of its score.  Only rows whose bounds may still
enter one of the anchor's lists are scored exactly.

Two passes: the first finds each anchor's positives, which set its windows of
scores, the second fills the windows with rows of other labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondeframe.llm.common import materialise

CELLS = 64
#: Bytes of vectors and cells that a split holds, and anchors and rows that are bounded at once.
SPLIT_BYTES = 96 << 20
TILE = 128
CHUNK = 512
#: Rows of a split from which cells take their bounds.
CELL_ROWS = 4096

_LEAST = np.iinfo(np.int64).min


class Approximation:
    """The cells of a split's vectors and the tables that bound scores by them."""

    def __init__(self, vectors: np.ndarray, cells: int = CELLS) -> None:
        n, d = vectors.shape
        some = np.sort(vectors[:: max(1, n // CELL_ROWS)], axis=0)
        edges = some[np.arange(1, cells) * len(some) // cells]
        self.codes = np.empty((d, n), dtype=np.uint8)
        for k in range(d):
            self.codes[k] = np.searchsorted(edges[:, k], vectors[:, k], side="right")
        self.low = np.concatenate([vectors.min(axis=0)[None], edges]).T.astype(np.int64)
        self.high = np.concatenate([edges - 1, vectors.max(axis=0)[None]]).T.astype(np.int64)

    def tables(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By dimension, cell and anchor: the least and the largest product."""
        one, two = (np.multiply(side[:, :, None], anchors.T[:, None, :]) for side in (self.low, self.high))
        least, most = np.minimum(one, two), np.maximum(one, two)
        room = np.abs(least).max(axis=(1, 2)).sum() + np.abs(most).max(axis=(1, 2)).sum() if least.size else 0
        return (least.astype(np.int32), most.astype(np.int32)) if room < 2**31 else (least, most)

    def bounds(self, tables: tuple[np.ndarray, np.ndarray], rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the rows' scores, a column for each anchor."""
        shape = (rows.stop - rows.start, tables[0].shape[2])
        out = []
        for table in tables:
            total, entry = np.zeros(shape, dtype=table.dtype), np.empty(shape, dtype=table.dtype)
            for k in range(len(table)):
                np.take(table[k], self.codes[k, rows], axis=0, out=entry, mode="clip")
                total += entry
            out.append(total)
        return out[0], out[1]


class Best:
    """For each of some lists its n best (score, id): the higher score, then the smaller id."""

    def __init__(self, lists: int, n: int) -> None:
        self.n = n
        self.scores = np.full((lists, n), _LEAST)
        self.ids = np.zeros((lists, n), dtype=np.int64)
        self.same = np.zeros((lists, n), dtype=bool)

    @property
    def last(self) -> np.ndarray:
        """The worst score of each full list; of another one the least number."""
        return self.scores[:, -1]

    def add(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray, same: np.ndarray) -> None:
        touched, at = np.unique(lists, return_inverse=True)
        held = self.scores[touched] > _LEAST
        own = np.nonzero(held)
        at = np.concatenate([own[0], at])
        scores, ids, same = (np.concatenate([old[touched][held], new]) for old, new in ((self.scores, scores), (self.ids, ids), (self.same, same)))
        order = np.lexsort((~same, ids, -scores, at))
        at = at[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        keep = rank < self.n
        where = (touched[at[keep]], rank[keep])
        self.scores[where], self.ids[where], self.same[where] = scores[order][keep], ids[order][keep], same[order][keep]


def _dense(column: pa.Array, d: int) -> np.ndarray:
    """Lists as rows of a matrix; a shorter one is filled up with zeros."""
    out = np.zeros((len(column), d), dtype=np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class _Split:
    """All rows of a split, in the order of their ids, or of labels and ids."""

    def __init__(self, parts: list[pa.RecordBatch], d: int, by_label: bool) -> None:
        table = pa.Table.from_batches(parts).combine_chunks()
        ids, labels = table["id"].to_numpy(), table["label"].to_numpy()
        order = np.lexsort((ids, labels)) if by_label else np.argsort(ids, kind="stable")
        self.ids, self.labels = ids[order], labels[order]
        self.vectors = np.concatenate([_dense(c, d).astype(np.int32) for c in table["q"].chunks])[order]
        self.cells = Approximation(self.vectors)

    def exact(self, rows: np.ndarray, vectors: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", self.vectors[rows].astype(np.int64), vectors[of])


def _positives(split: _Split, anchors: dict, k: int) -> Iterator[dict]:
    """The k + 1 best rows of the anchors' label, the anchor itself among them or not."""
    labels = anchors["label"]
    for label in np.unique(labels):
        own = np.flatnonzero(labels == label)
        begin, end = np.searchsorted(split.labels, [label, label + 1])
        for first in range(0, len(own), TILE):
            tile = own[first : first + TILE]
            vectors, best = anchors["q"][tile], Best(len(tile), k + 1)
            tables = split.cells.tables(vectors)
            for at in range(begin, end, CHUNK):
                rows = slice(at, min(at + CHUNK, end))
                _, upper = split.cells.bounds(tables, rows)
                row, of = np.nonzero(upper > best.last)  # of equal scores, later ids are no better
                row += at
                if len(row):
                    same = (split.ids[row] == anchors["id"][tile[of]]) & (split.vectors[row] == vectors[of]).all(axis=1)
                    best.add(of, split.exact(row, vectors, of), split.ids[row], same)
            of, rank = np.nonzero(best.scores > _LEAST)
            yield {"anchor": anchors["anchor"][tile[of]], "p": np.zeros(len(of), np.int32), "id": best.ids[of, rank], "score": best.scores[of, rank], "same": best.same[of, rank]}


def _negatives(split: _Split, anchors: dict, k: int) -> Iterator[dict]:
    """Of each window its k best rows of other labels."""
    for first in range(0, len(anchors["id"]), TILE):
        tile = slice(first, first + TILE)
        vectors, labels, low, high = anchors["q"][tile], anchors["label"][tile], anchors["low"][tile], anchors["high"][tile]
        n, windows = low.shape
        best = Best(n * windows, k)
        tables = split.cells.tables(vectors)
        for at in range(0, len(split.ids), CHUNK):
            rows = slice(at, min(at + CHUNK, len(split.ids)))
            lower, upper = split.cells.bounds(tables, rows)
            last = best.last.reshape(n, windows)
            least = np.where(last > _LEAST, np.maximum(low, last + 1), low)
            may = np.zeros(lower.shape, dtype=bool)
            for p in range(windows):
                may |= (upper >= least[:, p]) & (lower <= high[:, p])
            may &= split.labels[rows, None] != labels
            row, of = np.nonzero(may)
            row += at
            if len(row):
                scores = split.exact(row, vectors, of)
                hit, p = np.nonzero((scores[:, None] >= least[of]) & (scores[:, None] <= high[of]))
                if len(hit):
                    best.add(of[hit] * windows + p, scores[hit], split.ids[row[hit]], np.zeros(len(hit), dtype=bool))
        window, rank = np.nonzero(best.scores > _LEAST)
        yield {
            "anchor": anchors["anchor"][tile][window // windows], "p": (window % windows).astype(np.int32), "id": best.ids[window, rank],
            "score": best.scores[window, rank], "same": np.zeros(len(window), dtype=bool),
        }


_FOUND = pa.schema([("anchor", pa.int64()), ("p", pa.int32()), ("id", pa.int64()), ("score", pa.int64()), ("same", pa.bool_())])
_FOUND_DDL = "anchor long, p int, id long, score long, same boolean"


def _search(d: int, k: int, positives: bool, low: int, high: int):
    search = _positives if positives else _negatives

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A split's rows come first, its anchors follow in the same partition."""
        now, parts, split = None, [], None
        for batch in batches:
            splits, sides = batch.column("split").to_numpy(), batch.column("side").to_numpy()
            cuts = np.flatnonzero((np.diff(splits) != 0) | (np.diff(sides) != 0)) + 1
            for begin, end in zip([0, *cuts], [*cuts, len(splits)], strict=True):
                if begin == end:
                    continue
                piece = batch.slice(begin, end - begin)
                if splits[begin] != now:
                    now, parts, split = splits[begin], [], None
                if sides[begin] == 0:
                    parts.append(piece)
                    continue
                if split is None and parts:
                    split, parts = _Split(parts, d, positives), []
                if split is None:
                    continue
                anchors = {c: piece.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "id", "label")} | {"q": _dense(piece.column("q"), d)}
                if not positives:
                    scores = piece.column("scores")
                    width = max(1, int(np.diff(scores.offsets.to_numpy()).max(initial=0)))
                    own = _dense(scores, width)
                    there = np.arange(width) < np.diff(scores.offsets.to_numpy())[:, None]
                    anchors |= {"low": np.where(there, -(-low * own // 100), 1), "high": np.where(there, high * own // 100, 0)}
                for found in search(split, anchors, k):
                    if len(found["id"]):
                        yield pa.RecordBatch.from_arrays([pa.array(found[c]) for c in _FOUND.names], schema=_FOUND)

    return run


def hard_negatives(points: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """For each anchor and positive, the first rows of another label whose score lies in the positive's window.

    ``points``: (vec_id long, label, q array of integers); ``is_anchor`` chooses
    the anchors.  A row's score is the integer inner product with the anchor; a
    higher one comes first, of equal ones the smaller vec_id.  Positives are the
    first ``n_positives`` other rows of the anchor's label; negatives the first
    ``n_negatives`` rows of another label with low * positive_score <= 100 *
    negative_score <= high * positive_score.

    Columns: anchor_id, positive_id, rank (int, from 1), negative_id,
    positive_score, negative_score (long).

    Rows without id, label or vector, or with a null component, take no part.
    Components are held within the number whose square, times the dimensions,
    fits in 62 bits.  A shorter vector ends in zeros.  A repeated row is a row of its own: a copy of
    the anchor is one of its positives, and a repeated anchor gives its rows
    again.  An empty table, or one without anchors, gives an empty result.

    Rows are shuffled twice, anchors once to each split; a split gives
    n_negatives rows a window at most, which then meet.
    """
    spark = points.sparkSession
    size = F.greatest(F.size("q"), F.lit(1))
    most = F.least(F.floor(F.sqrt(F.lit(2.0**62) / size)), F.lit(2**30))
    rows = (
        points.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("q").isNotNull() & F.forall("q", lambda x: x.isNotNull()))
        .withColumn("anchored", F.coalesce(is_anchor, F.lit(False)))
        .select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.transform("q", lambda x: F.least(F.greatest(x, -most), most).cast("int")).alias("q"), "anchored")
    )
    n, d = rows.agg(F.count("*"), F.max(F.size("q"))).first()
    d = max(1, d or 1)
    splits = max(-(-n * (5 * d + 16) // split_bytes), spark.sparkContext.defaultParallelism)
    anchors = materialise(
        rows.filter("anchored").groupBy("id", "label", "q").agg(F.count("*").alias("copies")).withColumn("anchor", F.monotonically_increasing_id())
    )
    none = F.lit(None)
    left = rows.select(F.pmod(F.xxhash64("id"), F.lit(splits)).cast("int").alias("split"), F.lit(0).alias("side"), F.lit(0).cast("long").alias("anchor"), "id", "label", "q", none.cast("array<long>").alias("scores"))

    def searched(wanted: DataFrame, k: int, positives: bool) -> DataFrame:
        right = wanted.select(F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("split"), F.lit(1).alias("side"), "anchor", "id", "label", "q", "scores")
        dealt = left.unionByName(right).repartitionById(splits, F.col("split")).sortWithinPartitions("split", "side", "label")
        return dealt.mapInArrow(_search(d, k, positives, low, high), _FOUND_DDL)

    best = Window.partitionBy("anchor").orderBy(F.col("score").desc(), "id", F.col("same").desc())
    first = (
        searched(anchors.withColumn("scores", none.cast("array<long>")), n_positives, True)
        .withColumn("r", F.row_number().over(best)).filter(F.col("r") <= n_positives + 1)
        .withColumn("own", F.min(F.when(F.col("same"), F.col("r"))).over(Window.partitionBy("anchor")))
        .filter(F.col("r") != F.coalesce("own", F.lit(n_positives + 1)))
        .groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct(F.col("r").alias("r"), F.col("id").alias("id"), F.col("score").alias("score")))).alias("positives"))
    )
    wanted = materialise(anchors.join(first, "anchor").withColumn("scores", F.col("positives.score")))
    window = Window.partitionBy("anchor", "p").orderBy(F.col("score").desc(), "id")
    found = searched(wanted, n_negatives, False).withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= n_negatives)
    return (
        found.select("anchor", "p", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        .join(wanted.select("anchor", F.col("id").alias("anchor_id"), "copies", "positives"), "anchor")
        .select(
            "anchor_id", F.get("positives", F.col("p"))["id"].alias("positive_id"), "rank", "negative_id", F.get("positives", F.col("p"))["score"].alias("positive_score"), "negative_score",
            F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"),
        )
        .drop("copy")
    )


def embedding_points(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, q): components times ``scale``, rounded down; rows with a null or non-finite one get no vector."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")))
    return embeddings.select("vec_id", "label", F.when(finite, scaled).alias("q"))
