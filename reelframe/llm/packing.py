"""Documents packed into sequences: minimum bin slack over the histogram of piece lengths, pieces placed by their rank within a length."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelframe.llm.tokens import word_ids
from reelframe.session import staged

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every whole text's ids and `end_id`; longer ones cut at every `size` ids from their end."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)  # a vocabulary file, a few MB
    end = struct.pack("<I", end_id)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = word_ids(held.value)
        for frame in frames:
            rows = []
            for doc, text in zip(frame["doc_id"], frame["body"]):
                blob = ids.encode(text) + end
                n = len(blob) // 4
                start, length = 0, n % size or size
                for piece in range(-(-n // size)):
                    rows.append((doc, piece, start, length, zlib.crc32(memoryview(blob)[4 * start:4 * (start + length)])))
                    start, length = start + length, size
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    return rows.mapInPandas(cut, PIECES)


def fullest(left: dict[int, int], room: int, slack: int = 0) -> dict[int, int]:
    """Lengths, at most as many of each as left has, whose sum is the largest within room; bit s of the set says that sum s can be had. Longer lengths come first, and
    once they reach within `slack` of the room the shorter ones are left for others."""
    sums, steps, mask, enough = 1, [], (1 << (room + 1)) - 1, max(0, room - slack)
    for length in sorted((x for x in left if x <= room), reverse=True):
        many, take = min(left[length], room // length), 1
        while many and not sums >> enough:
            take = min(take, many)
            steps.append((length, take, sums))
            sums |= sums << length * take & mask
            many, take = many - take, take * 2
        if sums >> enough:
            break
    at, chosen = sums.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return chosen


def with_slack(counts: dict[int, int], size: int, slack: int) -> list[tuple[dict[int, int], int]]:
    """(lengths of one sequence with how many of each, how often): always the longest piece left with the fullest company for it, removed
    as often as the pieces left allow. Every round uses up a length or leaves fewer of it than one sequence holds, so the rounds are bounded by size, not by the data."""
    left, plan = {k: n for k, n in counts.items() if n > 0}, []
    while left:
        longest = max(left)
        rest = {k: n - (k == longest) for k, n in left.items() if n - (k == longest) > 0}
        bin_ = fullest(rest, size - longest, slack)
        bin_[longest] = bin_.get(longest, 0) + 1
        times = min(left[k] // n for k, n in bin_.items())
        plan.append((bin_, times))
        left = {k: m for k, n in left.items() if (m := n - times * bin_.get(k, 0)) > 0}
    return plan


LEVELS = (0, 1, 2, 3, 5, 8, 13, 21, 34, 55)


def sequences(plan: list[tuple[dict[int, int], int]]) -> int:
    return sum(times for _, times in plan)


def least_sequences(counts: dict[int, int], size: int) -> int:
    return -(-sum(k * n for k, n in counts.items()) // size)


def leveled(counts: dict[int, int], size: int) -> list[tuple[dict[int, int], int]]:
    """The plan with the fewest sequences over several slack levels, at once when one needs no more than all pieces together. Exact fills (level 0) use up the
    short pieces that the last long ones would need; a level leaves them more of it and costs at most that much per sequence."""
    best = None
    for slack in LEVELS:
        plan = with_slack(counts, size, slack)
        if best is None or sequences(plan) < sequences(best):
            best = plan
        if sequences(best) == least_sequences(counts, size):
            break
    return best


def minimum_slack(counts: dict[int, int], size: int) -> list[tuple[dict[int, int], int]]:
    """The best of the leveled plans, then repaired: the sequences with the most slack are taken apart together and planned anew, more of them at a time, while
    that saves one."""
    plan, width = leveled(counts, size), 4
    while width <= 256 and sequences(plan) > least_sequences(counts, size):
        slack = lambda entry: size - sum(k * n for k, n in entry[0].items())
        kept, open_, room = [], [], width
        for bin_, times in sorted(plan, key=slack, reverse=True):
            apart = min(times, room)
            room -= apart
            open_ += [(bin_, apart)] if apart else []
            kept += [(bin_, times - apart)] if times > apart else []
        loose: dict[int, int] = {}
        for bin_, times in open_:
            for k, n in bin_.items():
                loose[k] = loose.get(k, 0) + n * times
        anew = leveled(loose, size)
        if sequences(anew) < sequences(open_):
            plan = kept + anew
        else:
            width *= 2
    return plan


def places(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, pieces of it per sequence, first sequence, offset of its first piece)."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for bin_, times in plan:
        offset = 0
        for length, n in sorted(bin_.items(), reverse=True):
            rows.append((length, used.get(length, 0), times * n, n, sequence, offset))
            used[length] = used.get(length, 0) + times * n
            offset += length * n
        sequence += times
    return rows


def pack(pieces: DataFrame, size: int = 1024, group_rows: int = 512) -> DataFrame:
    """pieces (as token_pieces gives them) with sequence_id and offset.

    Only the counts per length, at most `size` numbers, come to the driver, which plans over them; the table of places follows from
    them and is bounded by size too, so it is broadcast. A piece's rank within its length is its row number within a hashed group of
    the length, of about group_rows rows even where one length is most of the table, plus the counts of the groups before.
    """
    spark = pieces.sparkSession
    pieces = staged(pieces, "pack-pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    groups = F.broadcast(spark.createDataFrame([(k, -(-n // group_rows)) for k, n in counts.items()], "length long, groups long"))  # a row per length
    pieces = pieces.join(groups, "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("groups"))).drop("groups")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = pieces.groupBy("length", "part").agg(F.count("*").alias("n")).select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(within) - 1).join(firsts, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("first"))
    slots = spark.createDataFrame(places(minimum_slack(counts, size)), "slot_length long, slot_rank long, slot_ranks long, per long, slot_sequence long, slot_offset long")
    at = F.col("rank") - F.col("slot_rank")
    placed = ranked.join(F.broadcast(slots), (F.col("length") == F.col("slot_length")) & (at >= 0) & (at < F.col("slot_ranks")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("slot_sequence") + F.floor(at / F.col("per"))).cast("long").alias("sequence_id"),
                         (F.col("slot_offset") + at % F.col("per") * F.col("length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; all rows and whole texts.

    A document is the ids of its text, strings of the vocabulary's added tokens as those tokens, and end_id. Null and empty texts are the end id
    alone. Rows that repeat an id are documents of their own; null ids stay null. Only a document of more than `size` ids is cut, its first
    piece is the shorter one. Other columns are not looked at; an empty table gives an empty result.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = f.read()
    return pack(token_pieces(docs, vocabulary, id_col, text_col, size, end_id), size)
