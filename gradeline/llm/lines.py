"""Cross-site line dedup by distinct-site spread.

Every line hash has a HyperLogLog sketch of the sites it occurs on; sketches merge in the
aggregation, so no line's sites are gathered. Lines far from the threshold are decided by the
estimate, lines near it by an exact distinct count. Lines on too many sites are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gradeline.llm.common import free_name
from gradeline.session import pin

#: log2 of the sketch's registers; the standard error is 1.04 / sqrt(2 ** LG_K).
LG_K = 10
#: Estimates within so many standard errors of the threshold are counted exactly.
ERRORS = 6


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_hash(line: Column) -> Column:
    """64-bit hash of a line without surrounding blanks; NULL for a blank line."""
    bare = F.trim(line)
    return F.when(F.length(bare) > 0, F.xxhash64(bare))


def _hashes(lines: Column) -> Column:
    return F.transform(lines, line_hash)


def line_sites(docs: DataFrame, text: str, site: str) -> DataFrame:
    """(line, site) of every non-blank line of every text; rows with a NULL text or site have none."""
    rows = docs.select(F.col(text).alias("text"), F.col(site).cast("string").alias("site"))
    rows = rows.where("text IS NOT NULL AND site IS NOT NULL")
    hashed = rows.select("site", F.explode(F.array_distinct(_hashes(split_lines(F.col("text"))))).alias("line"))
    return hashed.where("line IS NOT NULL")


def spread_lines(docs: DataFrame, text: str, site: str, least_sites: int) -> DataFrame:
    """(line, sites) of the line hashes found on at least ``least_sites`` distinct sites.

    ``sites`` is exact for lines whose estimate is near ``least_sites``, the rounded estimate else.
    """
    pairs = line_sites(docs, text, site)
    # a line that only one site has needs no sketch: two cheap bounds decide it, with map-side sums
    sketched = pairs.groupBy("line").agg(
        F.hll_sketch_agg("site", LG_K).alias("sketch"), F.min("site").alias("low"), F.max("site").alias("high")
    )
    margin = max(1.0, ERRORS * 1.04 / 2 ** (LG_K / 2) * least_sites)
    estimate = F.hll_sketch_estimate("sketch")
    rated = sketched.where("low <> high").select("line", estimate.cast("bigint").alias("sites"))
    rated = pin(rated.where(F.col("sites") >= least_sites - margin), "spread")
    near = rated.where(F.col("sites") <= least_sites + margin).select("line")
    exact = pairs.join(near, "line", "left_semi").distinct().groupBy("line").agg(F.count("*").alias("sites"))
    far = rated.where(F.col("sites") > least_sites + margin)
    return far.unionByName(exact).where(F.col("sites") >= least_sites)


def boilerplate_places(docs: DataFrame, key: str, text: str, site: str, least_sites: int) -> DataFrame:
    """(key, places) of the rows with boilerplate: 0-based numbers of the lines to remove.

    ``key`` must name a row; a NULL key has none. A text whose every line would go has none if the
    same text is on several rows: it is a copy, and near-duplicate removal chooses among copies.
    """
    spread = pin(spread_lines(docs, text, site, least_sites).select("line"), "boilerplate")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key IS NOT NULL AND text IS NOT NULL")
    rows = rows.withColumn("hashes", _hashes(split_lines(F.col("text"))))
    lines = F.size(F.filter("hashes", lambda line: line.isNotNull()))
    body = F.struct(F.xxhash64("text").alias("a"), F.hash("text").alias("b"), lines.alias("lines"))
    rows = rows.select("key", "hashes", body.alias("body"))
    found = rows.select("key", "body", F.posexplode("hashes").alias("place", "line"))
    found = found.where("line IS NOT NULL").join(spread, "line", "left_semi")
    found = found.groupBy("key").agg(F.array_sort(F.collect_set("place")).alias("places"), F.first("body").alias("body"))
    found = pin(found, "places")
    emptied = F.size("places") == F.col("body.lines")
    copies = found.where(emptied).groupBy("body").agg(F.count("*").alias("rows")).where("rows > 1").select("body")
    return found.join(copies, "body", "left_anti").select("key", "places")


def without_lines(text: Column, places: Column) -> Column:
    """The text less the lines at ``places``; a text left without lines is empty."""
    lines = split_lines(text)
    kept = F.filter(lines, lambda line, i: ~F.array_contains(places, i))
    return F.when(places.isNull(), text).otherwise(F.array_join(kept, "\n"))


def remove_boilerplate(
    docs: DataFrame, text: str, site: str, least_sites: int, counted: str | None = None
) -> DataFrame:
    """The rows and columns of ``docs``, without the lines found on ``least_sites`` sites or more.

    Lines are what line feeds separate, compared without surrounding blanks; blank lines stay. Only a
    text that is on several rows and of which nothing would be left stays as it is: it is a copy, and
    near-duplicate removal has to choose among copies. A row with a NULL site has its lines removed
    like any other but adds to no line's spread; a NULL text stays NULL, an empty one empty. Rows
    stay, in whatever number they come; every row gets a number of its own for the while, so
    repeated or NULL ids do no harm.
    ``counted`` names a column that is set to the new text's length where lines went.
    """
    row, places, kept = (free_name(docs, n) for n in ("_line_row", "_line_places", "_line_kept"))
    rows = pin(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = boilerplate_places(rows, row, text, site, least_sites)
    # merged at every size: a small table of places must not be broadcast to all texts and a large one not
    found = found.select(F.col("key").alias(row), F.col("places").alias(places)).hint("merge")
    joined = rows.join(found, row, "left")
    joined = joined.withColumn(kept, without_lines(F.col(text), F.col(places)))
    changed = F.col(places).isNotNull()
    new = {text: F.col(kept)}
    if counted and counted in docs.columns:
        length = F.length(kept).cast(dict(docs.dtypes)[counted])
        new[counted] = F.when(changed, length).otherwise(F.col(counted))
    return joined.withColumns(new).select(*docs.columns)
