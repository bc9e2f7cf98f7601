"""Exact duplicates: groups of equal normalised texts, each with the row that stays.

Method: rows are grouped by a 128-bit hash of the normalised text; of every hash
that more than one row has, the smallest and the largest text are compared byte
by byte. Where they differ, a collision, the texts themselves take part in the
grouping. Built-in functions only, no Python on the way.

A third of all rows may be one text: counts and keepers are aggregated before
the shuffle, and rows meet their group's single line in a plain join, which
adaptive execution splits. Texts are shuffled once, to compare them, and only
those that may share their hash: a bitmap of fixed size, which every task has,
holds a bit for each shared hash, and the join behind it is exact. The key of
that shuffle is salted, with as many salts as the group's rows need.

Defined results: null text counts as empty, so null, empty and blank texts are
equal; of equal texts the one with the most code points stays, then the smallest
id (a null id only if there is no other); rows that repeat id and text as well
are one keeper to ``equal_texts`` and come out of ``drop_copies`` once; an empty
table gives an empty one; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import digest, empty_if_null, keep_rows, pinned

#: Characters that normalisation deletes: space, tab to carriage return.
WHITE_SPACE = " \t\n\x0b\x0c\r"

#: Rows of one hash that a task should take; salts follow from a group's size.
ROWS_PER_SALT = 100_000
#: Bits of the bitmap of shared hashes (8 MB), and the binary logarithm of those of one of its rows.
FILTER_BITS, _PIECE_BITS = 1 << 26, 15


def normalised(text: Column) -> Column:
    return F.translate(empty_if_null(text), WHITE_SPACE, "")


def _collisions(docs: DataFrame, groups: DataFrame, text_column: str) -> DataFrame:
    """Hashes under which different texts have met, with those texts.

    Every row that shares its hash takes part. A task's rows fold into one smallest
    and one largest text before they move on.
    """
    shared = groups.where("_n > 1").select(F.col("_hash").alias("_shared"), F.ceil(F.col("_n") / F.lit(ROWS_PER_SALT)).cast("int").alias("_salts"))
    texts = docs.select(normalised(F.col(text_column)).alias("_text"), F.xxhash64(*_raw(docs)).alias("_deal"))
    texts = _perhaps_shared(texts.select("_text", "_deal", digest(F.col("_text")).alias("_hash")), shared)
    # Groups of several salts, at most one for each ROWS_PER_SALT rows, are told beforehand.
    large = F.broadcast(shared.where("_salts > 1").select(F.col("_shared").alias("_large"), F.col("_salts").alias("_of")))
    texts = texts.join(large, texts["_hash"] == large["_large"], "left")
    texts = texts.withColumn("_salt", F.pmod("_deal", F.coalesce("_of", F.lit(1))).cast("int"))
    salted = shared.withColumn("_shared_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    same = (F.col("_hash") == F.col("_shared")) & (F.col("_salt") == F.col("_shared_salt"))
    met = texts.join(salted, same, "left_semi")
    ends = met.groupBy("_hash").agg(F.min("_text").alias("_least"), F.max("_text").alias("_most"))
    return ends.where("_least <> _most").select(F.col("_hash").alias("_collided"))


def _bit(hash_: Column) -> Column:
    return F.xxhash64(hash_).bitwiseAND(F.lit(FILTER_BITS - 1))


def _perhaps_shared(texts: DataFrame, shared: DataFrame) -> DataFrame:
    """Rows whose hash may be among the shared ones, without moving any.

    With more shared hashes than bits all rows pass.
    """
    piece, within = lambda at: F.shiftright(at, _PIECE_BITS), lambda at: at.bitwiseAND(F.lit((1 << _PIECE_BITS) - 1))
    at = _bit(F.col("_shared"))
    pieces = shared.select(piece(at).alias("_piece"), within(at).alias("_position")).groupBy("_piece")
    pieces = F.broadcast(pieces.agg(F.bitmap_construct_agg("_position").alias("_bits")))
    mine = texts.withColumn("_at", _bit(F.col("_hash"))).withColumn("_of_piece", piece(F.col("_at")))
    byte = F.substring("_bits", F.shiftright(within(F.col("_at")), 3).cast("int") + 1, F.lit(1))
    bits = F.conv(F.hex(byte), 16, 10).cast("int")
    held = F.call_function("shiftright", bits, F.col("_at").bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1)) == 1
    met = mine.join(pieces, mine["_of_piece"] == pieces["_piece"])
    return met.where(held).select(*texts.columns)


def _raw(docs: DataFrame) -> list[Column]:
    """Columns that tell most copies apart, for the salt: those that can be hashed and are short."""
    short = [f.name for f in docs.schema.fields if f.dataType.typeName() in ("long", "integer", "short", "timestamp")]
    return [docs[c] for c in short] or [F.monotonically_increasing_id()]


def equal_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256; and _digest, that of its whole text.

    ``text_sha256`` is that of the normalised text in UTF-8, lowercase hex.
    """
    norm, raw = normalised(F.col(text_column)), empty_if_null(F.col(text_column))
    base = docs.select(F.col(id_column).cast("long").alias("doc_id"), raw.alias("_raw"), norm.alias("_norm"))
    marks = pinned(
        base.select(
            "doc_id",
            digest(F.col("_norm")).alias("_hash"),
            F.sha2(F.col("_norm").cast("binary"), 256).alias("text_sha256"),
            F.char_length("_raw").alias("_chars"),
            digest(F.col("_raw")).alias("_digest"),
        ),
        "marks",
    )
    counts = pinned(marks.groupBy("_hash").agg(F.count("*").alias("_n")), "hashes")
    collided = pinned(_collisions(docs.select(*_needed(docs, id_column, text_column)), counts, text_column), "collisions")
    # The second part of the key is null but under a collision, where it is the
    # text's own longer hash: such rows are few, and the bytes have been compared.
    keyed = marks.join(collided, marks["_hash"] == collided["_collided"], "left").withColumn(
        "_second", F.when(F.col("_collided").isNotNull(), F.col("text_sha256")).otherwise(F.lit(""))
    )
    # Most code points first, then the smallest id, a null id last.
    best = F.min(F.struct((-F.col("_chars")).alias("c"), F.col("doc_id").isNull().alias("u"), "doc_id"))
    groups = keyed.groupBy("_hash", "_second").agg(F.count("*").alias("group_size"), best.alias("_best"))
    groups = pinned(groups.select(F.col("_hash").alias("_h"), F.col("_second").alias("_s"), "group_size", "_best"), "groups")
    mine = (keyed["_hash"] == groups["_h"]) & (keyed["_second"] == groups["_s"])
    return keyed.join(groups, mine).select(
        "doc_id",
        F.col("_best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("_best.doc_id")) & (-F.col("_chars") == F.col("_best.c"))).alias("kept"),
        "text_sha256",
        "_digest",
    )


def _needed(docs: DataFrame, id_column: str, text_column: str) -> list[str]:
    return list(dict.fromkeys([id_column, text_column]))


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one for each normalised text."""
    kept = equal_texts(docs, id_column, text_column).where("kept")
    return keep_rows(docs, kept.select("doc_id", "_digest"), id_column, text_column)
