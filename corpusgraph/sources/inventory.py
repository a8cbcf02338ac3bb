"""Inventories: listing, ignore rules, placeholders, differences with an index, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TOLERANCE_MS, MAX_BYTES, KEPT_SNAPSHOTS = 1500, 64 << 20, 60
# fixed values: folders and files that are skipped, and hidden names that are not
IGNORED_FOLDERS = (".git", ".obsidian", ".trash", ".smart-env", "node_modules", ".svn", "__macosx", ".stfolder", ".stversions")
IGNORED_FILES = (".ds_store", "thumbs.db", "desktop.ini", ".localized")
VISIBLE_HIDDEN = r"\.(md|txt|json)$"
# fixed values: families of extensions without text
FAMILIES = {
    "image": "png jpg jpeg gif heic heif webp tiff tif bmp svg avif",
    "audio": "m4a mp3 wav aac aiff caf",
    "video": "mp4 mov m4v avi mkv",
    "office": "doc xls xlsx ppt pptx pages numbers key",
    "compressed": "zip rar 7z gz tar",
    "apple": "icloud ds_store plist",
}
PARSERS = {"text": "md markdown mdown txt text log", "html": "html htm xhtml", "data": "csv tsv json", "rtf": "rtf", "pdf": "pdf", "docx": "docx"}


def list_folder(spark: SparkSession, root: str) -> DataFrame:
    """Files under root, without their content: path, size, modified."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,10})$", 1))


def is_ignored(path: Column) -> Column:
    parts = F.split(F.lower(path), "/")
    name = F.element_at(parts, -1)
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.exists(folders, lambda p: p.isin(*IGNORED_FOLDERS) | p.startswith(".")) | name.isin(*IGNORED_FILES) | (name.startswith(".") & ~name.rlike(VISIBLE_HIDDEN))


def without_root(path: Column) -> Column:
    """A file list's path without the chosen folder's own name."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "^[^/]*/", "")).otherwise(path)


def placeholder_name(name: Column) -> Column:
    """The real name of a file that is still in the cloud, else null."""
    real = F.regexp_extract(name, r"(?i)^\.(.+)\.icloud$", 1)
    return F.when(real != "", real)


def is_zip(name: Column) -> Column:
    return name.rlike(r"(?i)\.zip$")


def route(ext: Column, size: Column) -> tuple[Column, Column]:
    """The parser for an extension, and the state before parsing."""
    parser = F.lit("binary")
    for name, exts in PARSERS.items():
        parser = F.when(ext.isin(*exts.split()), name).otherwise(parser)
    state = F.when(size > MAX_BYTES, "error").when(parser == "binary", "metadata only").otherwise("ok")
    return parser, state


def family(ext: Column) -> Column:
    out = F.lit("other")
    for name, exts in FAMILIES.items():
        out = F.when(ext.isin(*exts.split()), name).otherwise(out)
    return out


def summary(files: DataFrame) -> DataFrame:
    return files.groupBy(extension(F.col("path")).alias("ext")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def difference(listing: DataFrame, index: DataFrame, tolerance_ms: int = TOLERANCE_MS) -> DataFrame:
    """path, size, modified_ms of both -> path, change, reason: metadata alone, nothing is read."""
    old = index.select("path", F.col("size").alias("old_size"), F.coalesce("modified_ms", F.lit(0)).alias("old_ms"), F.lit(1).alias("old"))
    new = listing.select("path", "size", F.coalesce("modified_ms", F.lit(0)).alias("modified_ms"), F.lit(1).alias("new"))
    late = F.abs(F.col("modified_ms") - F.col("old_ms")) > tolerance_ms
    change = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "deleted").when((F.col("size") != F.col("old_size")) | late, "candidate").otherwise("same")
    reason = F.when(change == "candidate", F.when(F.col("size") != F.col("old_size"), "size").otherwise("date"))
    return new.join(old, "path", "full_outer").select("path", change.alias("change"), reason.alias("reason"))


def content_hash(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """Documents whose hash differs; an unknown earlier hash counts as changed."""
    old = before.select("path", F.col("hash").alias("old_hash"))
    return now.join(old, "path").where("old_hash IS NULL OR hash <> old_hash").select("path", "hash", "old_hash")


def upsert(index: DataFrame, changes: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    kept = index.join(changes.select("path"), "path", "left_anti")
    kept = kept if deleted is None else kept.join(deleted.select("path"), "path", "left_anti")
    return kept.unionByName(changes)


def prune_snapshots(snapshots: DataFrame, keep: int = KEPT_SNAPSHOTS) -> DataFrame:
    """The latest snapshots by date; one row per snapshot goes through the window."""
    return snapshots.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("date")))).where(F.col("_r") <= keep).drop("_r")


# fixed values: the start and the multiplier (2^40 + 0x1B3) of the 64-bit FNV-1a hash
_FNV_HIGH, _FNV_LOW, _FNV_PRIME = 0xCBF29CE4, 0x84222325, 0x1B3


def content_hash_fnv(content: Column) -> Column:
    """fnv64:<16 hexadecimal digits>:<length in hexadecimal>, a fold over the bytes in two halves of 32 bits."""
    start = F.struct(F.lit(_FNV_HIGH).cast("long").alias("high"), F.lit(_FNV_LOW).cast("long").alias("low"))
    mask = F.lit(0xFFFFFFFF).cast("long")

    def step(h: Column, pair: Column) -> Column:
        low = h["low"].bitwiseXOR(F.conv(pair, 16, 10).cast("long"))
        product = low * _FNV_PRIME
        high = h["high"] * _FNV_PRIME + F.shiftright(product, 32) + F.shiftleft(low, 8).bitwiseAND(mask)
        return F.struct(high.bitwiseAND(mask).alias("high"), product.bitwiseAND(mask).alias("low"))

    digits = lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))
    folded = F.aggregate(F.regexp_extract_all(F.hex(content), F.lit(".."), F.lit(0)), start, step, lambda h: F.concat(digits(h["high"]), digits(h["low"])))
    return F.concat(F.lit("fnv64:"), folded, F.lit(":"), F.lower(F.hex(F.length(content))))
