"""Cross-site boilerplate lines, found by the spread of their sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import packed, whole_text, written

#: Sites from which a line counts as boilerplate; the relative margin around it within which sites are counted exactly.
SITES, MARGIN, LG_K = 5, 0.25, 10
#: Parts that the places of one line are dealt out in.
SALTS = 32
#: Characters from which a line is judged; shorter ones recur by chance.
MIN_CHARS = 20


def _key(line: Column) -> Column:
    """Two 64-bit hashes of the line, the second seeded by the first of a marker: 128 bits, so lines don't meet by chance."""
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("line"), line).alias("h2"))


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, whole, site, pos, key) of every line that is judged; whole is a hash of the text, which tells rows apart that repeat a doc_id."""
    each = docs.select(F.col("doc_id").cast("long"), F.xxhash64(whole_text()).alias("whole"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("site"), F.posexplode(F.split(whole_text(), "\n")).alias("pos", "line"))
    return each.filter(F.char_length("line") >= min_chars).select("doc_id", "whole", "site", "pos", _key(F.col("line")).alias("key"))


def boilerplate_lines(docs: DataFrame, sites: int = SITES, min_chars: int = MIN_CHARS, margin: float = MARGIN, lg_k: int = LG_K) -> DataFrame:
    """(key, n_sites) of the lines that stand on at least `sites` sites.

    One HyperLogLog sketch of the sites for each line hash, merged by aggregation; lines whose estimate is within `margin`
    of the threshold are counted exactly, by aggregating the distinct (line, site) pairs of those lines alone.
    """
    lines = _lines(docs, min_chars)
    spread = written(lines.groupBy("key").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch")).select("key", F.hll_sketch_estimate("sketch").alias("estimate")).filter(F.col("estimate") >= sites * (1 - margin)))
    near = spread.filter(F.col("estimate") <= sites * (1 + margin)).select("key")
    exact = lines.select("key", "site").join(near, "key", "left_semi").groupBy("key", "site").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("*").alias("n_sites"))
    sure = spread.filter(F.col("estimate") > sites * (1 + margin)).select("key", F.col("estimate").alias("n_sites"))
    return sure.unionByName(exact.filter(F.col("n_sites") >= sites))


def line_dedup(docs: DataFrame, sites: int = SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """All rows and columns of docs, with the text without boilerplate lines, and n_lines, n_removed.

    A line that stands on `sites` sites or more (values of source) goes everywhere but at its first place (smallest
    doc_id, then smallest line number), so what it says is kept once. Lines are split at \\n; each has `min_chars` characters at
    least, or stays. A null text or source counts as empty; a null text stays null. Rows that repeat a doc_id are told apart by their
    texts; rows alike in both are treated alike, the first place of a line included. A row without a doc_id counts for the sites but keeps
    its text. Columns n_lines and n_removed of docs, if it has them, are replaced; others may have any name. A text's lines
    are worked on in one row, in time linear in them. No rows give no rows. No Python runs on the executors.
    """
    flagged = written(boilerplate_lines(docs, sites, min_chars).select("key"))
    places = written(_lines(docs, min_chars).join(flagged, "key").select("key", "doc_id", "whole", "pos").filter("doc_id IS NOT NULL"))
    first = places.groupBy("key").agg(F.min(F.struct("doc_id", "whole", "pos")).alias("first"))
    # a line of a third of all documents is dealt over SALTS tasks, its first place to each of them
    spread = places.withColumn("salt", F.pmod(F.xxhash64("doc_id", "pos"), F.lit(SALTS)))
    firsts = first.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    extra = spread.join(firsts, ["key", "salt"]).filter(F.struct("doc_id", "whole", "pos") != F.col("first"))
    gone = extra.groupBy("doc_id", "whole").agg(F.collect_set("pos").alias("gone"))
    both = packed(docs.drop("n_lines", "n_removed")).join(gone, (F.col("row.doc_id").cast("long") == F.col("doc_id")) & (F.xxhash64(whole_text("row.text")) == F.col("whole")), "left")
    # an array of one, so that the text is split once and not once a line
    lines = F.array(F.split(F.col("row.text"), "\n"))
    keep = lambda found: F.array_except(F.sequence(F.lit(0), F.size(found) - 1), F.col("gone"))
    kept = F.element_at(F.transform(lines, lambda found: F.array_join(F.when(F.size("gone") >= F.size(found), F.array().cast("array<string>")).otherwise(F.transform(keep(found), lambda i: F.get(found, i))), "\n")), 1)
    return both.select(
        *[F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(kept).alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")],
        F.size(F.split(whole_text("row.text"), "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
