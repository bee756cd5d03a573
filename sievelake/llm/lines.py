"""Line deduplication by distinct-site spread.

A HyperLogLog sketch of the sites of each line is merged by aggregation. Lines
well under the threshold are left alone, lines well over it are boilerplate, and
those near it get an exact count of distinct sites. Of boilerplate the first
occurrence stays and all others are removed, so nothing is lost from the corpus
as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.llm.skew import join_counted
from sievelake.session import materialize

#: Sites on which a line must occur to be boilerplate; the sketch's size (2^10 registers: a standard error
#: of 3.3 %, and close to exact under a hundred sites); the band, as shares of the threshold, that is counted exactly.
MIN_SITES, SKETCH, NEAR = 10, 10, (0.8, 1.25)
#: What a line is trimmed of, and what makes it blank.
BLANK = "\t\u000b\f\r "


def _line_key(line: Column) -> list[Column]:
    """128 bits of a line, trimmed."""
    trimmed = F.btrim(line, F.lit(BLANK))
    return [F.xxhash64(trimmed).alias("h1"), F.xxhash64(F.lit(1), trimmed).alias("h2")]


def occurrences(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """``id``, ``t1``, ``t2`` (128 bits of the text), ``site``, ``pos``, ``h1``, ``h2`` of each line that isn't blank."""
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"),
        F.col(site_col).cast("string").alias("site"), F.posexplode(F.split(text, "\n")).alias("pos", "line"),
    )
    rows = rows.filter(F.btrim("line", F.lit(BLANK)) != "")
    return rows.select("id", "t1", "t2", "site", "pos", *_line_key(F.col("line")))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``h1``, ``h2``, ``first`` (struct of the first occurrence), ``n_sites`` (null unless counted exactly)
    and ``n`` (occurrences) of the lines on at least ``min_sites`` sites. A null site is none."""
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "t1", "t2", "pos")
    spread = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", SKETCH)).alias("estimate"), F.min(order).alias("first"), F.count("*").alias("n")
    )
    low, high = (F.lit(min_sites * x) for x in NEAR)
    likely = materialize(spread.filter(F.col("estimate") >= F.floor(low)), "likely")
    near = likely.filter(F.col("estimate") <= high).select("h1", "h2", "n")
    sites = join_counted(lines.filter(F.col("site").isNotNull()).select("h1", "h2", "site"), near, ["h1", "h2"]).distinct()
    exact = sites.groupBy("h1", "h2").agg(F.count("*").alias("n_sites"))
    settled = likely.join(exact, ["h1", "h2"], "left")
    over = (F.col("estimate") > high) | (F.col("n_sites") >= min_sites)
    return materialize(settled.filter(over).select("h1", "h2", "first", "n_sites", "n"), "boilerplate")


def _fresh(columns: list[str], name: str) -> str:
    taken = {c.lower() for c in columns}
    while name in taken:
        name = "_" + name
    return name


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
    min_sites: int = MIN_SITES, removed_col: str | None = None,
) -> DataFrame:
    """``docs`` with boilerplate lines taken out of the texts; all rows and columns stay.

    Lines are compared without white space at their ends; blank lines never go.
    The first occurrence (smallest id, then place) of a boilerplate line stays.
    Rows equal in id and text are treated alike: if one holds the first
    occurrence, so do all. Null ids come after all others. A null text stays null,
    a text of boilerplate alone becomes empty. ``removed_col`` adds the number of
    lines taken out. Line hashes, not texts, are shuffled by line, and partial
    sketches bound what one hot line sends; a document meets its own list of
    removed places only; lines that occur very often are broadcast, not met in a
    shuffle. An empty table gives no rows.
    """
    lines = occurrences(docs, id_col, text_col, site_col)
    known = boilerplate(lines, min_sites)
    here = F.struct(F.col("id").isNull().alias("no_id"), "id", "t1", "t2", "pos")
    extra = join_counted(lines.drop("site"), known, ["h1", "h2"]).filter(~here.eqNullSafe(F.col("first")))
    drop, d1, d2, d3 = (_fresh(docs.columns, x) for x in ("dropped_lines", "row_id", "row_t1", "row_t2"))
    places = extra.groupBy("id", "t1", "t2").agg(F.collect_set("pos").alias(drop))
    places = materialize(places.select(F.col("id").alias(d1), F.col("t1").alias(d2), F.col("t2").alias(d3), drop), "places")
    text = F.col(text_col).cast("string")
    keyed = docs.withColumns({"k" + d2: F.xxhash64(text), "k" + d3: F.xxhash64(F.lit(1), text)})
    same = F.col(id_col).cast("long").eqNullSafe(F.col(d1)) & (F.col("k" + d2) == F.col(d2)) & (F.col("k" + d3) == F.col(d3))
    joined = keyed.join(places.hint("shuffle_hash"), same, "left")
    parts = F.split(text, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(drop))
    cut = F.array_join(F.transform(kept, lambda i: F.element_at(parts, i + 1)), "\n")
    new = F.when(F.col(drop).isNull(), text).otherwise(cut)
    columns = [new.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    if removed_col:
        columns.append(F.coalesce(F.size(drop), F.lit(0)).cast("long").alias(removed_col))
    return joined.select(*columns)
