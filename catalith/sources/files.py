"""Catalogue scans with exact headers, null markers, typed columns and stable row numbers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ranks import running
from .scratch import written


class SourceError(ValueError):
    """A source breaks its contract."""


@dataclass(frozen=True)
class Field:
    """1-based inclusive range of a fixed-width field."""

    name: str
    first: int
    last: int


def without_markers(c: Column, markers: Sequence[str]) -> Column:
    """Null for values that equal a marker; everything else, numeric sentinels too, stays."""
    return F.when(~c.isin(list(markers)), c) if markers else c


def fixed_width(lines: DataFrame, fields: Sequence[Field], markers: Sequence[str] = ("",), value: str = "value") -> DataFrame:
    """``lines`` with a column for each field, trimmed; what a short line lacks is empty."""
    rest = [c for c in lines.columns if c != value]
    cut = [without_markers(F.regexp_replace(F.substring(value, f.first, f.last - f.first + 1), r"^\s+|\s+$", ""), markers).alias(f.name) for f in fields]
    return lines.select(*rest, *cut)


def _lines(spark: SparkSession, path: str, deep: bool = False) -> DataFrame:
    """source_file, start (of the file block), id (ascending within a block), value of each line."""
    return spark.read.option("recursiveFileLookup", deep).text(path).select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("id"), "value")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """source_file, source_row (from 1), value for each line, however the files are split; of all files below a folder.

    Lines of a file block keep their order in a scan, so a line's number is its place in
    the block plus the lines of the file's earlier blocks; only the table of blocks is windowed.
    """
    lines = _lines(spark, path, True)
    blocks = lines.groupBy("source_file", "start").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    before = Window.partitionBy("source_file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    out = lines.join(blocks, ["source_file", "start"])
    return out.select("source_file", (F.col("before") + F.col("id") - F.col("least") + 1).cast("long").alias("source_row"), "value")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """source_file, source_row (from 1), value, whole for each record of CSV files: a line, or several, if line feeds stand inside quotes.

    Files are read in blocks whatever they hold. A line begins a record if the quotes before it in its file are even: their
    running count is taken within each block, on top of the sums of the file's earlier blocks (``running``). So are records
    counted, and only lines of records of several are brought together, by the record's number, also across blocks. Blank
    lines between records are none. Files without a quote open at a line's end or a blank line need no running count. ``whole`` is false
    for a record whose quotes are odd, which is the last of a file that ends inside them. Lines of a record are joined by one line feed each.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = written(_lines(spark, path).withColumns({"odd": (quotes % 2).cast("long"), "blank": (F.trim("value") == "").cast("long")}), "lines")
    blocks = lines.groupBy("source_file", "start").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.sum(F.col("odd") + F.col("blank")).alias("special"))
    file = Window.partitionBy("source_file")
    before = F.coalesce(F.sum("n").over(file.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = written(blocks.select("source_file", "start", "least", before.alias("before"), F.sum("special").over(file).alias("special")), "blocks")
    plain = lines.join(blocks.where("special = 0"), ["source_file", "start"])
    plain = plain.select("source_file", (F.col("before") + F.col("id") - F.col("least") + 1).cast("long").alias("source_row"), "value", F.lit(True).alias("whole"))
    if blocks.where("special > 0").isEmpty():
        return plain
    rest = lines.join(blocks.where("special > 0").select("source_file", "start"), ["source_file", "start"])
    rest = running(rest, "start", ["id"], {"quotes": F.col("odd")}, ["source_file"])
    closed = (F.col("quotes") - F.col("odd")) % 2 == 0
    rest = rest.withColumn("begins", closed & (F.col("blank") == 0)).where(~(closed & (F.col("blank") == 1)))
    rest = written(running(rest, "start", ["id"], {"record": F.col("begins").cast("long")}, ["source_file"]), "records")
    one = rest.where("begins and odd = 0").select("source_file", F.col("record").alias("source_row"), "value", F.lit(True).alias("whole"))
    parts = rest.where("not begins or odd = 1").groupBy("source_file", F.col("record").alias("source_row")).agg(F.sort_array(F.collect_list(F.struct("start", "id", "value"))).alias("parts"), (F.sum("odd") % 2 == 0).alias("whole"))
    return plain.unionByName(one).unionByName(parts.select("source_file", "source_row", F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("value"), "whole"))


def read_fixed_width(spark: SparkSession, path: str, fields: Sequence[Field], markers: Sequence[str] = ("",)) -> DataFrame:
    return fixed_width(numbered_lines(spark, path), fields, markers)


def read_csv(spark: SparkSession, path: str, columns: Mapping[str, str], markers: Sequence[str] = ("",)) -> DataFrame:
    """source_file, source_row, and text columns renamed by ``columns`` (source name -> target name, in file order).

    The header of every file must equal the declared names. Blank lines are not rows and
    have no number. A row with another number of cells, or in quotes that never close, fails the read when it is reached.
    Files are read once, in blocks, also where line feeds stand inside cells (see ``csv_records``).
    """
    want = list(columns)
    schema = ", ".join(f"`{c}` string" for c in [*want, "__bad"])
    options = {"quote": '"', "escape": '"', "columnNameOfCorruptRecord": "__bad", "mode": "PERMISSIVE", "multiLine": "true"}
    rows = csv_records(spark, path).select("source_file", "source_row", "whole", F.from_csv("value", schema, options).alias("rows"))
    cells = F.array(*[F.coalesce(F.col("rows")[c], F.lit("")) for c in want])
    wrong = rows.where("source_row = 1").where(F.col("rows.__bad").isNotNull() | ~F.col("whole") | (cells != F.array(*map(F.lit, want))))
    if bad := [r["source_file"] for r in wrong.select("source_file").limit(5).collect()]:
        raise SourceError(f"the header is not {want} in {bad}")
    place = F.concat(F.lit(f"not {len(want)} cells in row "), (F.col("source_row") - 1).cast("string"), F.lit(" of "), "source_file")
    sound = F.when(F.col("rows.__bad").isNull() & F.col("whole"), cells).otherwise(F.raise_error(place))
    body = rows.where("source_row > 1").select("source_file", (F.col("source_row") - 1).alias("source_row"), sound.alias("cells"))
    return body.select("source_file", "source_row", *[without_markers(F.col("cells")[i], markers).alias(t) for i, t in enumerate(columns.values())])


def typed(df: DataFrame, types: Mapping[str, str], strict: bool = True) -> DataFrame:
    """Columns cast to their types. A malformed value fails the load; with strict false it is null (see ``rejects``)."""
    return df.select(*[(F.col(c).cast(types[c]) if strict else F.col(c).try_cast(types[c])).alias(c) if c in types else F.col(c) for c in df.columns])


def rejects(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Rows with a malformed value, and the names of the columns that hold one."""
    bad = F.array_compact(F.array(*[F.when(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull(), F.lit(c)) for c, t in types.items()]))
    return df.withColumn("bad_columns", bad).where(F.size("bad_columns") > 0)


def require_columns(df: DataFrame, need: Sequence[str]) -> DataFrame:
    if missing := sorted(set(need) - set(df.columns)):
        raise SourceError(f"missing columns: {', '.join(missing)}")
    return df


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """source_file, n_bytes, sha256 of each file, of all below a folder (files under 2 GB)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)  # folders are listed by tasks
    return files.select(F.col("path").alias("source_file"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def preflight(spark: SparkSession, path: str, rows: DataFrame, sha256: str, expected_rows: int) -> None:
    """Fail unless the file's digest and the parsed row count are the declared ones (a truncated export fails here)."""
    found = file_digests(spark, path).collect()
    if len(found) != 1 or found[0]["sha256"] != sha256:
        raise SourceError(f"{path}: digest {[r['sha256'] for r in found]} instead of {sha256}")
    if (n := rows.count()) != expected_rows:
        raise SourceError(f"{path}: {n} rows instead of {expected_rows}")


def union_partitions(parts: Sequence[DataFrame], names: Mapping[str, str] | None = None) -> DataFrame:
    """Union by name of partition exports whose headers differ in case, blanks or the renamings of ``names``."""
    out = None
    for p in parts:
        clean = {c: (names or {}).get(c, c.strip().lower()) for c in p.columns}
        q = p.select(*[F.col(f"`{c}`").alias(t) for c, t in clean.items()])
        out = q if out is None else out.unionByName(q)
    if out is None:
        raise SourceError("no partitions")
    return out


def assemble(main: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Wide table of the rows both have under ``key``."""
    return main.join(other, key)
