"""Packing by shortest-pack-first over the length histogram.

Documents are encoded once into pieces of at most ``size`` ids; from then on only lengths move. The histogram has at most
``size`` rows. The driver packs it: lengths longest first, each into the pack that is shortest so far and has room,
where a pack stands for a pattern and its count; equal lengths for which no pack has room fill new packs in turn. Pieces get a rank within their length without any window over a whole
length (hashed blocks, counted first), and patterns are joined back by rank.

Edge cases: null text is empty and still has its end id; repeated rows are packed as documents of their own; empty table:
no pieces; null doc_id is carried through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small, whole_text, written
from .tokens import encoder

SIZE = 2048
END_ID = 1
#: Pieces per block of ranks.
BLOCK = 2_048
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def encoded(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """One row per piece: full pieces of ``size`` ids and a rest."""

    def pieces(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode, end = encoder(tokenizer_path), np.array([end_id], "<u4")
        for b in batches:
            row, doc_ids = 0, b.column(0)
            for ids, at in encode.slices(b.column(1)):
                which, start, length, crc, total = [], [], [], [], []
                for i, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    own, n = np.concatenate((ids[lo:hi].astype("<u4"), end)), hi - lo + 1
                    for k in range(0, n, size):
                        which.append(row + i)
                        start.append(k)
                        length.append(min(size, n - k))
                        crc.append(zlib.crc32(own[k : k + size]))
                        total.append(n)
                row += len(at) - 1
                yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(which, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(pieces, PIECES)


def shortest_pack_first(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Patterns as (count, ((length, copies), ...)). ``room[r]`` holds open patterns with r ids left; the most room is used
    first. Where no open pack has room, packs are opened and filled with copies one after the other."""
    room: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = {}

    def put(count: int, pattern: tuple, left: int, length: int, copies: int) -> None:
        if count:
            if pattern and pattern[-1][0] == length:
                pattern, copies = pattern[:-1], pattern[-1][1] + copies
            room.setdefault(left, []).append((count, (*pattern, (length, copies))))

    for length in sorted(histogram, reverse=True):
        left, most_copies = histogram[length], size // length
        while left:
            most = max((r for r in room if r >= length), default=None)
            if most is None:
                full, rest = divmod(left, most_copies)
                put(full, (), size - most_copies * length, length, most_copies)
                put(int(rest > 0), (), size - rest * length, length, rest)
                break
            count, pattern = room[most].pop()
            if not room[most]:
                del room[most]
            used = min(count, left)
            left -= used
            if count > used:
                room.setdefault(most, []).append((count - used, pattern))
            put(used, pattern, most - length, length, 1)
    return [p for r in sorted(room) for p in room[r]]


def slots(patterns: list[tuple[int, tuple[tuple[int, int], ...]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, copies, sequence of the first rank, offset): where the pieces of a length go, by rank."""
    rows, taken, sequence = [], {}, 0
    for count, pattern in patterns:
        offset = 0
        for length, copies in pattern:
            at = taken.get(length, 0)
            rows.append((length, at, at + count * copies, copies, sequence, offset))
            taken[length], offset = at + count * copies, offset + length * copies
        sequence += count
    return rows


def packed(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """``pieces`` (a written table) with sequence_id and offset."""
    spark = pieces.sparkSession
    counted = pieces.groupBy("length").count().collect()  # at most ``size`` rows
    plan = slots(shortest_pack_first({r["length"]: r["count"] for r in counted}, size))
    schema = "length long, first long, end long, copies long, sequence long, base long"
    blocks = max(1, sum(r["count"] for r in counted) // BLOCK)
    block = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(blocks))
    keyed = pieces.withColumn("block", block)
    # Blocks are summed up in groups, so no task sees more of a length than its groups or a group's blocks.
    sizes = keyed.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n")).withColumn("group", F.floor(F.col("block") / BLOCK))
    sizes = written(sizes, "block_sizes")
    before = lambda n, *by: F.coalesce(F.sum(n).over(W.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    groups = sizes.groupBy("length", "group").agg(F.sum("n").alias("n")).select("length", "group", before("n", "length", "group").alias("groups_before"))
    sizes = sizes.select("length", "group", "block", before("n", "length", "group", "block").alias("before")).join(groups, ["length", "group"])
    inside = W.partitionBy("length", "block").orderBy("doc_id", "start", "ids_crc32")
    ranked = keyed.withColumn("rank", F.row_number().over(inside) - 1).join(sizes, ["length", "block"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before") + F.col("groups_before"))
    frame = small(written(spark.createDataFrame(plan, schema), "slots"))
    fits = (F.col("p.length") == F.col("s.length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end"))
    at = F.col("rank") - F.col("first")
    out = ranked.alias("p").join(frame.alias("s"), fits).withColumns({"sequence_id": F.col("sequence") + F.floor(at / F.col("copies")), "offset": F.col("base") + at % F.col("copies") * F.col("p.length")})
    return out.select("doc_id", "start", "p.length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def packing(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece."""
    return packed(written(encoded(docs, tokenizer_path, size, end_id), "pieces"), size)
