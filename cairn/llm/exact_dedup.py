"""Exact dedup by a tree-merge of sorted digest runs.

Each scan task writes one sorted run of (digest, smallest id, rows, bytes). The runs are then exchanged in rounds
over a hypercube of slots with a fan-in of ``FAN``: in round j a slot splits its run by the j-th digit of the digest,
sends one piece to each of the FAN slots that differ in that digit, and merges what it receives, keeping the
smallest identifier of equal digests. Equal digests (sha256, whose collisions nobody has found) must also agree in the length
of their text at every merge. After
the last round each slot owns one digest range completely.

Scale: the slot count grows with the rows (``ROWS_PER_SLOT``), copies shrink to one entry in the first run, so a group
with a third of all rows is one entry per run. The way back joins by digest; groups of over 1/1000 of all rows
(fewer than 1000 of them by arithmetic, whatever the input) are joined by broadcast, so no task holds a hot group.

Edge cases: null text counts as empty; a null id sorts last and is returned as null; repeated rows count as rows of
the group; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, Scratch, join_groups, text_or_empty

FAN_BITS = 3
FAN = 1 << FAN_BITS
ROWS_PER_SLOT = 200_000
RUN_ROWS = 500_000
NO_ID = np.iinfo(np.int64).max
RUN_SCHEMA = "slot long, digests binary, ids binary, counts binary, lengths binary"


def _merged(digests: np.ndarray, ids: np.ndarray, counts: np.ndarray, lengths: np.ndarray):
    """Sorts entries by digest and folds equal ones: smallest id, summed rows, verified length."""
    keys = digests.view(">u8").reshape(-1, 4)
    order = np.lexsort((keys[:, 3], keys[:, 2], keys[:, 1], keys[:, 0]))
    digests, keys, ids, counts, lengths = digests[order], keys[order], ids[order], counts[order], lengths[order]
    first = np.ones(len(ids), bool)
    first[1:] = (keys[1:] != keys[:-1]).any(axis=1)
    if (~first[1:] & (lengths[1:] != lengths[:-1])).any():
        raise ValueError("equal digests of texts of different length")
    at = np.flatnonzero(first)
    return digests[at], np.minimum.reduceat(ids, at), np.add.reduceat(counts, at), lengths[at]


def _pieces(slot: int, rounds: int, turn: int, run) -> Iterator[dict]:
    """Splits a merged run by the digit of this round and addresses each piece to its slot."""
    digests, ids, counts, lengths = run
    shift = np.uint64(64 - FAN_BITS * turn)
    digit = ((np.ascontiguousarray(digests).view(">u8").reshape(-1, 4)[:, 0].astype(np.uint64) >> shift) & np.uint64(FAN - 1)).astype(np.int64)
    place = FAN_BITS * (rounds - turn)
    for d in np.unique(digit):
        own = digit == d
        yield {
            "slot": (slot & ~((FAN - 1) << place)) | (int(d) << place), "digests": digests[own].tobytes(), "ids": ids[own].tobytes(),
            "counts": counts[own].tobytes(), "lengths": lengths[own].tobytes(),
        }


def digest_groups(rows: DataFrame, total: int) -> DataFrame:
    """rows (digest binary(32), id long, bytes long, part int) -> (digest, keep_id, group_size), one per digest."""
    rounds = 1
    while FAN**rounds * ROWS_PER_SLOT < total:
        rounds += 1

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n, slot = [], 0, 0
        for pdf in batches:
            if len(pdf):
                slot = int(pdf.part.iloc[0]) % FAN**rounds
                held.append((np.frombuffer(b"".join(pdf.digest), np.uint8).reshape(-1, 32), pdf.id.to_numpy(np.int64), np.ones(len(pdf), np.int64), pdf.bytes.to_numpy(np.int64)))
                n += len(pdf)
            if n >= RUN_ROWS:
                yield pd.DataFrame(list(_pieces(slot, rounds, 1, _merged(*map(np.concatenate, zip(*held, strict=True))))))
                held, n = [], 0
        if n:
            yield pd.DataFrame(list(_pieces(slot, rounds, 1, _merged(*map(np.concatenate, zip(*held, strict=True))))))

    def received(pdf: pd.DataFrame):
        whole = lambda name, kind: np.frombuffer(b"".join(pdf[name]), kind)
        return _merged(whole("digests", np.uint8).reshape(-1, 32), whole("ids", np.int64), whole("counts", np.int64), whole("lengths", np.int64))

    def exchange(turn: int):
        return lambda pdf: pd.DataFrame(list(_pieces(int(pdf.slot.iloc[0]), rounds, turn, received(pdf))))

    def leaves(pdf: pd.DataFrame) -> pd.DataFrame:
        digests, ids, counts, _ = received(pdf)
        blob = digests.tobytes()
        keep = pd.Series(ids, dtype="Int64").mask(pd.Series(ids == NO_ID))
        return pd.DataFrame({"digest": [blob[i : i + 32] for i in range(0, len(blob), 32)], "keep_id": keep, "group_size": counts})

    tree = rows.withColumn("id", F.coalesce("id", F.lit(NO_ID))).mapInPandas(runs, RUN_SCHEMA)
    for turn in range(2, rounds + 1):
        tree = tree.groupBy("slot").applyInPandas(exchange(turn), RUN_SCHEMA)
    return tree.groupBy("slot").applyInPandas(leaves, "digest binary, keep_id long, group_size long")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, digest (binary sha256 of the text with white space runs as one space), keep_id, group_size."""
    scratch = Scratch(docs.sparkSession, "exact")
    normal = F.regexp_replace(text_or_empty(text_col), SPACE_CLASS, " ")
    rows = scratch.save(
        docs.select(F.col(id_col).cast("long").alias("id"), normal.alias("normal"))
        .select("id", F.unhex(F.sha2(F.col("normal").cast("binary"), 256)).alias("digest"), F.octet_length("normal").cast("long").alias("bytes")),
        "rows",
    )
    total = rows.count()
    groups = scratch.save(digest_groups(rows.withColumn("part", F.spark_partition_id()), total), "groups")
    many = groups.where("group_size > 1")
    met = join_groups(rows.select("id", "digest"), many, ["digest"], "group_size", total)
    alone = F.col("group_size").isNull()
    return met.select("id", "digest", F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of equal texts the one with the smallest id (of repeated rows with that id, one)."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    groups = exact_groups(docs, id_col, text_col)
    stays = groups.where(F.col("id").eqNullSafe(F.col("keep_id"))).select(F.coalesce("id", F.lit(NO_ID)).alias("key"), "digest")
    normal = F.regexp_replace(text_or_empty(text_col), SPACE_CLASS, " ")
    # the row is one column, so that no name of its own is in the way
    marked = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), key.alias("key"), F.unhex(F.sha2(normal.cast("binary"), 256)).alias("digest"))
    # id and digest name a text that stays; of rows repeated with both, one is kept in the same partitioning
    kept = marked.join(stays, ["key", "digest"], "left_semi").dropDuplicates(["key", "digest"])
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
