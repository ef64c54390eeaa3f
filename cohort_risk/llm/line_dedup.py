"""Line dedup [native]: explode normalised lines, hash them, find the hashes
held by several documents, drop their lines everywhere but in the first
document, and reassemble the text by line position.

Only (id, text hash, position, line hash) rows are shuffled to find and look up
repeated lines; a line's holders are reduced to (min id, max id) inside each
task, so a line found in a third of all documents costs one row per task. The
look-up join may be split by AQE when a line is hot (nothing above it needs
its keys together). The text moves once, to meet the positions to drop.

Defined results: a null or empty text is one empty line; rows sharing an id are
one document (each row is cleaned and returned); rows with a null id keep all
their lines and do not count as holders; extra columns pass through, and
``n_lines`` / ``n_dropped`` of the input are replaced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

BLANKS = " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2, min_chars: int = 10) -> DataFrame:
    """``df`` with the repeated lines removed from ``text_col``, plus ``n_lines``
    (before) and ``n_dropped``. A key is the line stripped of blanks with A-Z
    lower-cased; keys of at least ``min_chars`` code points found in at least
    ``min_docs`` documents stay only in the smallest id."""
    rows = df.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__text"), F.col(text_col).alias("__t"))
    lines = rows.filter("__id IS NOT NULL").select("__id", "__text", F.posexplode(_lines(F.col("__t"))).alias("__pos", "__line"))
    bare = F.btrim("__line", F.lit(BLANKS))
    key = C.ascii_lower(bare)
    # 128 bits: at 10^13 lines two different keys still do not meet
    keyed = lines.filter(F.length(bare) >= min_chars).select(
        "__id", "__text", "__pos", F.xxhash64(key).alias("__h1"), F.xxhash64(F.lit(1), key).alias("__h2")
    )
    stats = [F.min("__id").alias("__first"), F.max("__id").alias("__last")]
    found = F.col("__first") < F.col("__last")
    if min_docs > 2:
        stats.append(F.count_distinct("__id").alias("__docs"))
        found = F.col("__docs") >= min_docs
    repeated = keyed.groupBy("__h1", "__h2").agg(*stats).filter(found).select("__h1", "__h2", "__first")
    drops = (
        C.split_join(keyed, repeated, ["__h1", "__h2"])
        .filter("__id > __first")
        .groupBy(F.col("__id").alias("__drop_id"), F.col("__text").alias("__drop_text"))
        .agg(F.collect_set("__pos").alias("__drops"))
    )
    joined = df.join(drops, (F.col(id_col) == F.col("__drop_id")) & (F.xxhash64(text_col) == F.col("__drop_text")), "left")
    kept = F.transform(  # the outer array binds the split lines once
        F.array(_lines(F.col(text_col))),
        lambda ls: F.array_join(
            F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("__drops")), lambda p: ls[p]), "\n"
        ),
    )[0]
    out = {
        "n_lines": F.size(_lines(F.col(text_col))).cast("long"),
        "n_dropped": F.coalesce(F.size("__drops"), F.lit(0)).cast("long"),
        text_col: F.when(F.col("__drops").isNull(), F.col(text_col)).otherwise(kept),
    }
    names = [c for c in df.columns if c not in out or c == text_col]
    return joined.select(
        *[out[c].alias(c) if c == text_col else F.col(f"`{c}`") for c in names],
        *[e.alias(c) for c, e in out.items() if c != text_col],
    )
