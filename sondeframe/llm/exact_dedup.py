"""Exact dedup by an exchange of Golomb-coded fingerprints.

Every input partition cuts its rows into chunks.  A chunk sorts its distinct
fingerprints, splits them by owner (equal ranges of the fingerprint space) and
sends each owner one Golomb-coded list of gaps: two or three bytes a row.  An
owner merges the lists it gets and answers each with a bitmap that marks the
fingerprints seen more than once.  Only rows with a marked fingerprint are
suspects; their texts alone are shuffled and compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondeframe.llm.common import fresh, in_bitmap, key_bitmap, materialise, once, shuffle_partitions, text_or_empty

FINGERPRINT_BITS = 48
CHUNK_ROWS = 32_768
#: Fingerprints of an owner, about, beyond as many owners as shuffle partitions.
OWNER_ROWS = 4_000_000


def golomb_encode(values: np.ndarray, rice: int) -> bytes:
    """Golomb code with parameter 2**rice of the gaps of a sorted array.

    First the quotients of all gaps in unary (ones, then a zero), then, from
    the next byte on, ``rice`` bits of each gap's remainder.
    """
    if not len(values):
        return b""
    gaps = np.diff(values.astype(np.int64), prepend=np.int64(0))
    high, low = gaps >> rice, gaps & ((1 << rice) - 1)
    unary = np.ones(int(high.sum()) + len(gaps), dtype=np.uint8)
    unary[np.cumsum(high + 1) - 1] = 0
    rest = (low[:, None] >> np.arange(rice - 1, -1, -1)) & 1
    return np.packbits(unary).tobytes() + np.packbits(rest.astype(np.uint8)).tobytes()


def golomb_decode(code: bytes, n: int, rice: int) -> np.ndarray:
    """The sorted array that ``golomb_encode`` was given; n is its length."""
    if not n:
        return np.zeros(0, dtype=np.int64)
    bits = np.unpackbits(np.frombuffer(code, dtype=np.uint8))
    zeros = np.flatnonzero(bits == 0)[:n]
    high = np.diff(zeros, prepend=-1) - 1
    begin = -(-(int(zeros[-1]) + 1) // 8) * 8
    rest = bits[begin : begin + n * rice].reshape(n, rice).astype(np.int64)
    return np.cumsum((high << rice) | (rest << np.arange(rice - 1, -1, -1)).sum(axis=1))


def _rice(span: int, n: int) -> int:
    """The parameter near ln 2 times the mean gap, the best one for random gaps."""
    return max(0, int(np.log2(max(1.0, 0.69 * span / max(1, n)))))


def _send(owners: int):
    span = -(-(1 << FINGERPRINT_BITS) // owners)

    def lists(chunk: int, pieces: list[np.ndarray]) -> pa.RecordBatch:
        own, counts = np.unique(np.concatenate(pieces), return_counts=True)
        cuts = np.searchsorted(own, np.arange(owners + 1, dtype=np.int64) * span)
        rows = []
        for owner in np.flatnonzero(np.diff(cuts)):
            part = slice(cuts[owner], cuts[owner + 1])
            values = own[part] - owner * span
            rice = _rice(span, len(values))
            rows.append((
                int(owner), int(chunk), len(values), rice, golomb_encode(values, rice),
                np.packbits(counts[part] > 1).tobytes(),
            ))
        return pa.RecordBatch.from_pylist(
            [dict(zip(_SENT.names, r, strict=True)) for r in rows], schema=_SENT
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A chunk may span batches: its rows follow each other, and it is sent when the next one begins."""
        now, pieces = None, []
        for batch in batches:
            chunks = batch.column("chunk").to_numpy(zero_copy_only=False)
            prints = batch.column("fp").to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.diff(chunks, prepend=chunks[:1] - 1)) if len(chunks) else []
            for begin, end in zip(starts, [*starts[1:], len(chunks)], strict=True):
                if pieces and chunks[begin] != now:
                    yield lists(now, pieces)
                    pieces = []
                now = chunks[begin]
                pieces.append(prints[begin:end])
        if pieces:
            yield lists(now, pieces)

    return run


_SENT = pa.schema([
    ("owner", pa.int32()), ("chunk", pa.int64()), ("n", pa.int32()), ("rice", pa.int32()),
    ("code", pa.binary()), ("repeats", pa.binary()),
])
_SENT_DDL = "owner int, chunk long, n int, rice int, code binary, repeats binary"


def _answer(lists: pd.DataFrame) -> pd.DataFrame:
    """Of one owner: for each list, the bitmap of fingerprints seen elsewhere too."""
    decoded = [golomb_decode(c, n, r) for c, n, r in zip(lists["code"], lists["n"], lists["rice"], strict=True)]
    local = [np.unpackbits(np.frombuffer(b, np.uint8))[:n].astype(bool) for b, n in zip(lists["repeats"], lists["n"], strict=True)]
    every, where = np.unique(np.concatenate(decoded), return_inverse=True)
    seen = np.bincount(where, minlength=len(every)) + np.bincount(where, weights=np.concatenate(local), minlength=len(every))
    marked = seen[where] > 1
    ends = np.cumsum([len(d) for d in decoded])
    bitmaps = [np.packbits(m).tobytes() for m in np.split(marked, ends[:-1])]
    keep = [any(b) for b in bitmaps]
    out = pd.DataFrame({"chunk": lists["chunk"], "owner": lists["owner"], "n": lists["n"], "bitmap": bitmaps})
    return out[keep]


def _mark(owners: int):
    span = -(-(1 << FINGERPRINT_BITS) // owners)

    def run(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        """Of one chunk: its rows with the owners' bitmaps laid on them."""
        suspect = np.zeros(len(rows), dtype=bool)
        if len(rows) and len(answers):
            own, where = np.unique(rows["fp"].to_numpy(), return_inverse=True)
            cuts = np.searchsorted(own, np.arange(owners + 1, dtype=np.int64) * span)
            marked = np.zeros(len(own), dtype=bool)
            if answers["owner"].duplicated().any():
                raise ValueError("a chunk was sent to an owner in more than one list")
            for owner, sent, bitmap in zip(answers["owner"], answers["n"], answers["bitmap"], strict=True):
                n = cuts[owner + 1] - cuts[owner]
                if n != sent:
                    raise ValueError(f"a list of {sent} fingerprints was answered to a chunk with {n} of that owner")
                marked[cuts[owner] : cuts[owner + 1]] = np.unpackbits(np.frombuffer(bitmap, np.uint8))[:n]
            suspect = marked[where]
        return rows.assign(suspect=suspect)

    return run


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owners: int | None = None) -> DataFrame:
    """One row per input row: which row of the same text stays.

    Texts are equal when identical byte for byte; null counts as empty.  Of
    equal texts the row with the largest id stays; a null id is the smallest,
    and of rows repeated with the same id one stays.  An empty table gives an
    empty result; other columns of the input are not read.

    Columns: the id, keep_id (id of the row that stays), group_size (long),
    kept (boolean), text_sha256 (lowercase hex), row_uid (long, this run's
    number of the row).
    """
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    numbered = (
        docs.select(F.col(id_col).alias("doc_id"), F.sha2(F.encode(text, "UTF-8"), 256).alias("sha"), F.xxhash64(text).alias("x"))
        .withColumn("row_uid", F.monotonically_increasing_id())
        # the partition's number stands in the id's upper bits
        .withColumn("chunk", F.col("row_uid") - F.col("row_uid").bitwiseAND((1 << 33) - 1)
                    + F.shiftright(F.col("row_uid").bitwiseAND((1 << 33) - 1), CHUNK_ROWS.bit_length() - 1))
        .withColumn("fp", F.conv(F.substring("sha", 1, FINGERPRINT_BITS // 4), 16, 10).cast("long"))
    )
    rows = materialise(numbered)  # row numbers and chunks must outlive a lost executor
    owners = owners or max(shuffle_partitions(spark), -(-rows.count() // OWNER_ROWS))

    sent = rows.select("chunk", "fp").mapInArrow(_send(owners), _SENT_DDL)
    answers = sent.groupBy("owner").applyInPandas(_answer, "chunk long, owner int, n int, bitmap binary")
    schema = "doc_id long, sha string, x long, row_uid long, chunk long, fp long, suspect boolean"
    marked = materialise(
        rows.withColumn("doc_id", F.col("doc_id").cast("long")).groupBy("chunk")
        .cogroup(answers.groupBy("chunk")).applyInPandas(_mark(owners), schema)
    )

    # A bitmap of bounded size lets the scan pass on suspects' texts alone (and a few
    # others, which the join then drops).  Rows find the group of their text by two
    # hashes: texts of one digest would be two groups.
    suspects = marked.filter("suspect").select("doc_id", "sha", "x", "row_uid")
    wanted = suspects.groupBy("doc_id", "sha", "x").agg(F.max("row_uid").alias("last_uid"))
    texts = docs.select(F.col(id_col).cast("long").alias("t_id"), text.alias("t_text")).withColumn(
        "t_sha", F.sha2(F.encode("t_text", "UTF-8"), 256)
    ).withColumn("t_x", F.xxhash64("t_text"))
    texts = in_bitmap(texts, key_bitmap(suspects, "sha"), "t_sha")
    verified = (
        texts.join(wanted, F.col("t_id").eqNullSafe(F.col("doc_id")) & (F.col("t_sha") == F.col("sha")) & (F.col("t_x") == F.col("x")))
        .groupBy("sha", "x", "t_text")
        .agg(F.max(F.struct("doc_id", "last_uid")).alias("keep"), F.count("*").alias("group_size"))
        .select("sha", "x", F.col("keep.doc_id").alias("keep_id"), F.col("keep.last_uid").alias("keep_uid"), "group_size")
    )
    grouped = suspects.join(verified, ["sha", "x"], "left").select(
        "doc_id", "keep_id", "group_size", (F.col("row_uid") == F.col("keep_uid")).alias("kept"), "sha", "row_uid"
    )
    alone = marked.filter("not suspect").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha", "row_uid"
    )
    return alone.unionByName(grouped).select(
        F.col("doc_id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"), "row_uid"
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows, of each group of equal texts only the one that stays.

    A row repeated with the same id and text comes out once.
    """
    sha, k_id, k_sha = (fresh(docs, x) for x in ("text_sha256", "keep_id", "keep_sha256"))
    kept = exact_duplicates(docs, id_col, text_col).filter("kept")
    keys = kept.select(F.col(id_col).alias(k_id), F.col("text_sha256").alias(k_sha))
    found = docs.withColumn(sha, F.sha2(F.encode(text_or_empty(text_col), "UTF-8"), 256)).join(
        keys, F.col(id_col).eqNullSafe(F.col(k_id)) & (F.col(sha) == F.col(k_sha)), "left_semi"
    )
    return once(found, [id_col, sha]).drop(sha)
