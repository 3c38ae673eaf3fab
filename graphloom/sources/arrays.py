"""Files that hold one JSON array of objects, read by many tasks.

A file is read as text in pieces that end at closing braces, so the scan splits it like any text. Whether a
brace counts, and how deep it lies, follows from what stands before it: from the quotes and braces of its own split, added up
in order, and from one row of totals per earlier split. Texts are shuffled once, by split; only objects
that cross the border of a split are put together after that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.session import cut

UNSUPPORTED = "unsupported file format"
SPLIT = ["file", "block"]


def _before(value: str | Column) -> Column:
    """The sum over the pieces of a split before this one."""
    inside = Window.partitionBy(*SPLIT).orderBy("at")
    return F.coalesce(F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _earlier(value: str | Column) -> Column:
    """The sum over the splits of a file before this one."""
    splits = Window.partitionBy("file").orderBy("block")
    return F.coalesce(F.sum(value).over(splits.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Pieces in order ``at``, with their quotes, and their opening braces before, between and after pairs of quotes.

    An escape never reaches over a closing brace, so escapes go first.
    """
    parts = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"')
    opens = lambda odd: F.aggregate(
        F.filter(parts, lambda _, i: i % 2 == odd), F.lit(0), lambda n, p: n + F.length(p) - F.length(F.replace(p, F.lit("{"), F.lit("")))
    )
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]
    rows = spark.read.option("lineSep", "}").text(path).select(*place, "value")
    return rows.withColumns({"quotes": F.size(parts) - 1, "outer": opens(0), "inner": opens(1)})


def _depth(start: Column) -> tuple[Column, Column, Column]:
    """Opening braces of a piece, whether its closing one counts, and the change of depth; ``start`` is 1 where its split starts inside a string."""
    opened = F.when((F.col("quotes_before") + start) % 2 == 0, F.col("outer")).otherwise(F.col("inner"))
    closed = (F.col("quotes_before") + F.col("quotes") + start) % 2 == 0
    return opened, closed, opened - closed.cast("int")


def _splits(pieces: DataFrame) -> DataFrame:
    """One row per split: whether it starts inside a string, at which depth, and the depth of the objects of its file."""
    first = F.when(F.col("block") == 0, F.left(F.ltrim(F.regexp_replace(F.left("value", F.lit(1000)), r"\s", "")), F.lit(1)))
    marked = pieces.withColumns({"quotes_before": _before("quotes"), "first": first}).drop("value")
    change = [F.sum(_depth(F.lit(h))[2]).alias(f"change{h}") for h in (0, 1)]
    totals = marked.groupBy(*SPLIT).agg(F.sum("quotes").alias("quotes"), F.min_by("first", "at").alias("first"), *change)
    started = totals.withColumn("start", _earlier("quotes") % 2)
    depth = _earlier(F.when(F.col("start") == 0, F.col("change0")).otherwise(F.col("change1")))
    head = F.max("first").over(Window.partitionBy("file"))
    base = F.when(head == "[", 0).when(head == "{", 1).otherwise(F.raise_error(F.lit(UNSUPPORTED)).cast("int"))
    return started.select(*SPLIT, "start", depth.alias("depth"), base.alias("base"))


def _fragments(pieces: DataFrame, splits: DataFrame) -> DataFrame:
    """Texts up to each end of an object, numbered in their split; the last one of a split may be open."""
    rows = pieces.join(splits, SPLIT).withColumn("quotes_before", _before("quotes"))
    opened, closed, change = _depth(F.col("start"))
    rows = rows.withColumns({"opened": opened, "counts": closed, "after": F.col("depth") + _before(change) + change})
    rows = rows.withColumn("ends", F.col("counts") & (F.col("after") == F.col("base")))
    rows = rows.withColumn("number", _before(F.col("ends").cast("long")))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda p: F.concat(p["value"], F.lit("}"))), "")
    return rows.groupBy(*SPLIT, "number").agg(whole.alias("text"), F.max("ends").alias("ended"), F.max("base").alias("base"), F.sum("opened").alias("opened"))


def array_texts(spark: SparkSession, path: str, member: str = "data") -> DataFrame:
    """``(file, idx, text)``: the objects of each array file at ``path`` with their position in it.

    A file is an array, or an object whose ``member`` is one. Anything else raises: elements that are no objects, an
    object without the member, a file that ends early.
    """
    pieces = _pieces(spark, path)
    fragments = cut(_fragments(pieces, _splits(pieces)))
    ends = fragments.groupBy(*SPLIT).agg(F.sum(F.col("ended").cast("long")).alias("ends"))
    # behind the last object comes at least the end of the array; without it the file was cut off
    whole = fragments.groupBy("file").agg(F.max_by("ended", F.struct("block", "number")).alias("broken"))
    checked = ends.join(whole, "file").where(F.when(F.col("broken"), F.raise_error(F.lit(UNSUPPORTED)).cast("boolean")).otherwise(F.lit(True)))
    earlier = checked.select(*SPLIT, _earlier("ends").alias("earlier"))
    placed = fragments.join(earlier, SPLIT).withColumn("idx", F.col("earlier") + F.col("number"))
    inside = F.col("ended") & (F.col("number") > 0)
    parts = F.array_sort(F.collect_list(F.struct("block", "text")))
    crossing = placed.where(~inside).groupBy("file", "idx").agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"),
        F.max("ended").alias("ended"), F.max("base").alias("base"), F.sum("opened").alias("opened"),
    )
    objects = placed.where(inside).select(crossing.columns).unionByName(crossing)
    return _members(objects, member)


def _members(objects: DataFrame, member: str) -> DataFrame:
    """The objects that are elements of the array, without what stands before them."""
    first, after = rf'(?s)^\s*[{{,\]].*?"{member}"\s*:\s*\[\s*', r"^\s*,\s*"
    array = F.col("base") == 0
    plain = F.when(array & (F.col("idx") == 0), F.regexp_like("text", F.lit(r"^\s*\[\s*\{"))).otherwise(F.regexp_like("text", F.lit(r"^\s*,\s*\{")))
    opens = F.regexp_like("text", F.lit(first + r"\{"))
    wrong = F.raise_error(F.lit(UNSUPPORTED))
    # what is left behind the last object: the end of the array, or a wrapper without objects; the last brace is not the file's
    empty = F.regexp_like("text", F.lit(r"^\s*\[?\s*\]\s*\}$"))
    bare = F.regexp_like("text", F.lit(first + r"\]")) | ((F.col("opened") == 0) & (F.col("idx") > 0) & F.regexp_like("text", F.lit(r'^\s*(\]|\}|,\s*")')))
    rest_ok = F.when(array, empty).otherwise(bare)
    kind = (
        F.when(~F.col("ended"), F.when(rest_ok, "rest").otherwise(wrong))
        .when(array, F.when(plain, "element").otherwise(wrong))
        .when(plain, "element").when(opens, "first").otherwise("other")
    )
    known = objects.withColumn("kind", kind)
    # objects of other members of a wrapper, few rows a file, bound the stretch of the array
    borders = known.where((F.col("base") == 1) & F.col("kind").isin("first", "other")).select("file", "idx", "kind")
    stretch = Window.partitionBy("file").orderBy("idx")
    stretches = borders.withColumn("to", F.lead("idx").over(stretch)).where("kind = 'first'").groupBy("file").agg(F.min_by(F.struct(F.col("idx").alias("from"), "to"), "idx").alias("s"))
    elements = known.where(F.col("kind").isin("element", "first", "other")).join(stretches, "file", "left")
    missing = F.when((F.col("base") == 1) & F.col("s").isNull(), wrong.cast("boolean")).otherwise(F.lit(True))
    held = (F.col("base") == 0) | ((F.col("idx") >= F.col("s.from")) & (F.col("s.to").isNull() | (F.col("idx") < F.col("s.to"))))
    head = F.when(F.col("kind") == "first", F.regexp_replace("text", first, "")).otherwise(F.regexp_replace("text", r"^\s*[\[,]\s*", ""))
    return elements.where(missing & held).select("file", (F.col("idx") - F.coalesce("s.from", F.lit(0))).alias("idx"), head.alias("text"))


def read_array(spark: SparkSession, path: str, schema: str, member: str = "data") -> DataFrame:
    """``(file, idx, …)``: the objects of each array file at ``path`` as columns of ``schema``; broken ones raise."""
    rows = array_texts(spark, path, member)
    return rows.select("file", "idx", F.from_json("text", schema, {"mode": "FAILFAST"}).alias("row")).select("file", "idx", "row.*")
