"""Exact duplicates with two Bloom filters: only rows whose hash may be repeated are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableglass.llm.common import lookup, stored

CELLS_PER_ROW = 16
MAX_CELLS = 1 << 29  # 64 MB of bitmaps are broadcast at most


def _cells(digest: str, cells: int) -> list[Column]:
    """Two cells of the filter, counted from 1 as the bitmap functions want them."""
    return [F.pmod(F.xxhash64(F.lit(seed), F.col(digest)), F.lit(cells)) + 1 for seed in (1, 2)]


def repeated_filter(digests: DataFrame, cells: int, digest: str = "digest") -> DataFrame:
    """(bucket, bits): first pass. Every hash sets its two cells in a filter that counts up to two; the cells set twice
    make the second filter, in bitmaps of 4 KB."""
    hits = digests.select(F.explode(F.array(*_cells(digest, cells))).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    return hits.filter("n > 1").groupBy(F.bitmap_bucket_number("cell").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits"))


def maybe_repeated(digests: DataFrame, twice: DataFrame, cells: int, digest: str = "digest") -> DataFrame:
    """The rows with a column ``maybe``: false only where no other row has the hash."""
    df = digests
    for i, cell in enumerate(_cells(digest, cells)):
        # bounded: MAX_CELLS bits
        side = F.broadcast(twice.select(F.col("bucket").alias(f"__bucket{i}"), F.col("bits").alias(f"__bits{i}")))
        df = df.withColumn(f"__bucket{i}", F.bitmap_bucket_number(cell)).join(side, f"__bucket{i}", "left")
        at = F.bitmap_bit_position(cell)
        byte = F.ascii(F.decode(F.substring(F.col(f"__bits{i}"), (F.floor(at / 8) + 1).cast("int"), F.lit(1)), "ISO-8859-1"))
        bit = F.floor(byte / F.pow(F.lit(2), at % 8)).cast("int") % 2
        df = df.withColumn(f"__hit{i}", F.coalesce(bit == 1, F.lit(False))).drop(f"__bucket{i}", f"__bits{i}")
    return df.withColumn("maybe", F.col("__hit0") & F.col("__hit1")).drop("__hit0", "__hit1")


def decisions(df: DataFrame, text: str = "text", id_col: str = "doc_id", max_cells: int = MAX_CELLS) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), one row for each row of ``df``.

    Texts are equal if they are identical; null counts as an empty text. Of equal texts the row with the largest id stays
    (a null id is smaller than all others; of rows with equal texts and ids exactly one stays). Other columns of ``df`` are
    not read, so their names don't matter. An empty table gives an empty result.

    The digests are written once, without texts. The first pass builds the filters, the second one tests every digest;
    rows that no other row can equal pass straight to the result, the others are grouped by digest. The filter has 16 cells a
    row up to ``max_cells`` (64 MB); beyond that more unique rows take the shuffled way, with the same result.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    digests = stored(df.select(
        F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.sha2(body.cast("binary"), 256).alias("digest")), "digests")
    total = digests.count()
    cells = min(max_cells, 1 << max(15, (CELLS_PER_ROW * total - 1).bit_length() if total else 15))
    tested = maybe_repeated(digests, repeated_filter(digests, cells), cells)
    once = tested.filter(~F.col("maybe")).select(
        F.col("id"), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    again = tested.filter("maybe").drop("maybe")
    groups = again.groupBy("digest").agg(
        F.max(F.struct("id", "row")).alias("winner"), F.count(F.lit(1)).alias("group_size"))
    rest = lookup(again, groups, ["digest"], "group_size", total).select(
        "id", F.col("winner.id").alias("keep_id"), "group_size", (F.col("row") == F.col("winner.row")).alias("kept"), "digest")
    return once.unionByName(rest).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))
