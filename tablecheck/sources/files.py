"""Reading input files: tables, JSON, text, fixed-width reports, bundles."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tablecheck.functions.cells import is_empty, try_numeric
from tablecheck.operators.rownum import first_n, part_number, running_max, running_sum
from tablecheck.session import cut_lineage

#: Bytes of a part of a bundle.
PART_BYTES = 1 << 20
# How a file is read, by lower-case suffix.
LOADERS = {
    ".csv": "csv",
    ".json": "json",
    ".jsonl": "jsonl",
    ".xlsx": "workbook",
    ".xls": "workbook",
    ".pdf": "pdf",
    ".docx": "word",
    ".doc": "word",
    ".pptx": "slides",
    ".jpg": "image",
    ".jpeg": "image",
    ".png": "image",
    ".gif": "image",
    ".webp": "image",
}


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def loader_of(path: Column) -> Column:
    """Kind of loader a path needs; everything unknown is text."""
    kinds = F.create_map(*[F.lit(x) for pair in LOADERS.items() for x in pair])
    return F.coalesce(F.element_at(kinds, suffix(path)), F.lit("text"))


def image_placeholder(name: Column) -> Column:
    return F.concat(F.lit("[Image file: "), name, F.lit(" — visual content not extractable as text]"))


def read_table(spark: SparkSession, path: str, schema: T.StructType | str, sep: str | None = None) -> DataFrame:
    """Delimited table with a header.  TSV files are tab separated."""
    if sep is None:
        sep = "\t" if path.rstrip("/").lower().endswith(".tsv") else ","
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("escape", '"').csv(path)


SEPARATORS = (",", "\t", ";")
#: Lines of a file that show its separator.
HEAD_LINES = 20


def dialects(spark: SparkSession, path: str) -> DataFrame:
    """file_path, sep and has_rows of every delimited file below ``path``, from its first lines.

    The separator is the one that cuts the header into most fields (the comma where they tie); a ``.tsv`` file is tab
    separated.  Only the first block of a file is looked at, and at most ``HEAD_LINES`` of its lines travel.
    """
    lines = spark.read.text(path).where("_metadata.file_block_start = 0").select(
        F.col("_metadata.file_path").alias("file_path"), "value", F.monotonically_increasing_id().alias("at")
    )
    head = first_n(lines.where(F.btrim("value") != ""), ["file_path"], ["at"], HEAD_LINES)
    bare = F.regexp_replace("value", '"[^"]*"', "")
    fields = lambda sep: F.max(F.when(F.col("rn") == 1, F.size(F.split(bare, sep))))
    best = F.array_max(F.array(*[F.struct(fields(s).alias("n"), F.lit(-i).alias("rank"), F.lit(s).alias("sep")) for i, s in enumerate(SEPARATORS)]))
    found = head.groupBy("file_path").agg(best.alias("best"), (F.count(F.lit(1)) > 1).alias("has_rows"))
    sep = F.when(suffix(F.col("file_path")) == ".tsv", "\t").otherwise(F.col("best.sep"))
    return found.select("file_path", sep.alias("sep"), "has_rows")


def read_tables(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """All delimited files below ``path`` with a header and that schema, each read by its own separator; files without rows are left out.

    One read per separator; what reaches the driver is the list of files, as for any read.
    """
    by_sep: dict[str, list[str]] = {}
    for r in dialects(spark, path).where("has_rows").collect():
        by_sep.setdefault(r.sep, []).append(unquote(r.file_path))
    parts = [spark.read.schema(schema).option("header", True).option("sep", s).option("escape", '"').csv(files) for s, files in sorted(by_sep.items())]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def _any_case(suffix_: str) -> str:
    return "*" + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in suffix_)


def read_inputs(spark: SparkSession, root: str) -> DataFrame:
    """Contents of all files below ``root`` in one form: path, kind, ord, text.

    One listing pattern per kind of loader, each kind read by its own reader: tables and texts line by line (numbered from 1),
    JSON-lines files record by record, JSON files whole, images as a placeholder.  Kinds that need a codec of their own come
    with a null text, so that nothing is dropped silently.
    """
    glob = lambda names: "{" + ",".join(_any_case(n) for n in names) + "}"
    reader = lambda names, fmt: spark.read.format(fmt).option("pathGlobFilter", glob(names)).option("recursiveFileLookup", True)
    of = lambda kind: [s for s, k in LOADERS.items() if k == kind]
    path = F.col("_metadata.file_path").alias("path")
    lines = number_lines(spark, root, glob([*of("csv"), ".tsv", ".txt", ".md", ".log"]))
    kind = F.when(suffix(F.col("file_path")).isin(*of("csv"), ".tsv"), "csv").otherwise("text")
    parts = [lines.select(F.col("file_path").alias("path"), kind.alias("kind"), F.col("line_no").alias("ord"), F.col("value").alias("text"))]
    records = number_lines(spark, root, glob(of("jsonl")))
    parts.append(records.select(F.col("file_path").alias("path"), F.lit("jsonl").alias("kind"), F.col("line_no").alias("ord"),
                                F.concat(F.lit("Record "), F.col("line_no").cast("string"), F.lit(": "), "value").alias("text")))
    whole = reader(of("json"), "text").option("wholetext", True).load(root)
    parts.append(whole.select(path, F.lit("json").alias("kind"), F.lit(1).cast("bigint").alias("ord"), F.col("value").alias("text")))
    rest = [s for s, k in LOADERS.items() if k not in ("csv", "json", "jsonl")]
    listed = reader(rest, "binaryFile").load(root).select("path").withColumn("kind", loader_of(F.col("path")))
    name = F.element_at(F.split("path", "/"), -1)
    shown = F.when(F.col("kind") == "image", image_placeholder(name))
    parts.append(listed.select("path", "kind", F.lit(1).cast("bigint").alias("ord"), shown.alias("text")))
    return reduce(DataFrame.unionByName, parts)


def read_json_documents(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON document per file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def number_lines(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Lines of text files (of all below ``path`` whose names match ``pattern``) with their 1-based number inside the file.

    A large file arrives in blocks; lines are ranked inside their block and
    block sizes are summed, so no task holds more than one block.
    """
    reader = spark.read if pattern is None else spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    lines = reader.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("_id"),
    )
    sizes = lines.groupBy("file_path", "block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file_path", "block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rank = F.row_number().over(Window.partitionBy("file_path", "block").orderBy("_id"))
    ranked = lines.withColumn("_rn", rank).join(starts, ["file_path", "block"])
    return ranked.select("file_path", (F.col("_start") + F.col("_rn")).alias("line_no"), "value")


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Numbered records of JSON-lines files; bad lines are kept as they are."""
    lines = number_lines(spark, path)
    return lines.select(
        "file_path",
        "line_no",
        F.try_parse_json("value").isNotNull().alias("valid"),
        F.concat(F.lit("Record "), F.col("line_no").cast("string"), F.lit(": "), "value").alias("record"),
    )


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: UTF-8, or Latin-1 where the bytes are not UTF-8."""
    files = spark.read.format("binaryFile").load(path)
    utf8 = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(utf8, F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1"))
    return files.select(F.col("path").alias("file_path"), text.alias("text"), utf8.alias("is_utf8"))


def signed_amount(text: Column) -> Column:
    """Amount of a report; a trailing minus makes it negative."""
    digits = F.replace(F.regexp_replace(text, "-$", ""), F.lit(","), F.lit("")).try_cast("decimal(18,2)")
    return F.when(F.endswith(text, F.lit("-")), -digits).otherwise(digits)


BALANCE_RE = r"^(\d{4}-\d{4})\s+(.*?)\s+([\d,]+\.\d\d-?)\s+([\d,]+\.\d\d-?)\s+([al])\s*$"


def parse_trial_balance(lines: DataFrame, col: str = "value") -> DataFrame:
    """Account rows of a fixed-width trial balance; headings and rules are skipped."""
    rows = lines.where(F.col(col).rlike(BALANCE_RE))
    part = lambda i: F.regexp_extract(col, BALANCE_RE, i)
    return rows.select(
        part(1).alias("account"),
        part(2).alias("title"),
        signed_amount(part(3)).alias("period_balance"),
        signed_amount(part(4)).alias("year_to_date"),
        part(5).alias("kind"),
    )


def file_blocks(files: DataFrame) -> DataFrame:
    """Text block of every input file; a file that could not be read becomes an error block.

    ``files``: case_id, file_idx, path, description, content, error.
    """
    note = F.when(is_empty(F.col("description")), "").otherwise(F.concat(F.lit(" ("), "description", F.lit(")")))
    header = F.concat(F.lit("--- Input File: "), "path", note, F.lit(" ---"))
    failed = F.concat(F.lit("[Error loading file: "), F.coalesce("error", F.lit("not found")), F.lit("]"))
    body = F.when(F.col("content").isNotNull(), F.col("content")).otherwise(failed)
    return files.select("case_id", "file_idx", F.concat(header, F.lit("\n"), body).alias("block"))


def bundle(files: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """All inputs of a case in file order, in numbered parts of at most ``part_bytes`` bytes.

    ``files`` carries file_idx, dense from 0 inside a case.  The parts of a case joined by blank lines are its whole bundle; a part holds
    whole files, so only a file that is longer makes a longer part.
    """
    blocks = file_blocks(files).withColumn("n_bytes", F.octet_length("block").cast("bigint") + 2)
    placed = running_sum(blocks, ["case_id"], "file_idx", "n_bytes", "start")
    placed = placed.withColumn("part", part_number(F.col("start"), F.col("n_bytes"), part_bytes))
    ordered = F.array_sort(F.collect_list(F.struct("file_idx", "block")))
    return placed.groupBy("case_id", "part").agg(
        F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n").alias("text"), F.count(F.lit(1)).alias("files")
    )


def document_tables(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Cells of the tables inside text documents, with a flag for all-numeric columns.

    A table starts at a ``[Table n]`` line; its rows are ``a | b`` lines and the
    first of them is the header.  Which table a line belongs to and its place there come from running maxima and sums over slices
    of lines, so neither a long document nor a long table is one task.
    """
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))
    mark = F.regexp_extract("line", r"^\[Table (\d+)\]$", 1).try_cast("int")
    lines = lines.withColumn("mark", F.when(mark.isNotNull(), F.struct("line_no", mark.alias("table_no"))))
    lines = running_max(cut_lineage(lines, "document-lines"), [id_col], "line_no", "mark", "of")
    is_row = F.col("of").isNotNull() & F.col("mark").isNull() & F.contains("line", F.lit(" | "))
    lines = lines.select(id_col, "line_no", "line", F.col("of.line_no").alias("table_at"), F.col("of.table_no").alias("table_no"), is_row.cast("bigint").alias("is_row"))
    lines = running_sum(cut_lineage(lines, "table-lines"), [id_col], "line_no", "is_row", "rows_before")
    rows = cut_lineage(lines.where("is_row = 1").drop("is_row"), "table-rows")
    first = rows.groupBy(id_col, "table_at").agg(F.min("rows_before").alias("first_row"))
    rows = rows.join(cut_lineage(first, "table-starts"), [id_col, "table_at"])
    rows = rows.withColumn("row_no", F.col("rows_before") - F.col("first_row"))
    cells = rows.select(id_col, "table_at", "table_no", "row_no", F.posexplode(F.split("line", r" \| ")).alias("col_idx", "value"))
    head = cells.where("row_no = 0").select(id_col, "table_at", "col_idx", F.trim("value").alias("col_name"))
    body = cells.where("row_no > 0").withColumn("value", F.trim("value"))
    numeric = body.groupBy(id_col, "table_at", "col_idx").agg(
        (F.count_if(try_numeric(F.col("value")).isNull()) == 0).alias("is_numeric")
    )
    about = cut_lineage(head.join(numeric, [id_col, "table_at", "col_idx"]), "table-columns")
    return body.join(about, [id_col, "table_at", "col_idx"]).select(id_col, "table_no", "col_idx", "row_no", "value", "col_name", "is_numeric")
