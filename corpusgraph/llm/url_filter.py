"""URL filters: a blocked Bloom filter ahead of an exact hash join.

Listed entries are canonical URLs: a lower-case host and the start of a path,
with a verdict. An entry fits its host and all its subdomains where the path
starts with its own; the longest entry wins. A URL's candidates are therefore
its host's last labels joined to its path's first characters, as many of each
as any entry has. The filter holds eight words of 32 bits a block, one bit of each word for
an entry, at about 16 bits an entry; a candidate whose bits are not all set is
not listed. The rest goes to an exact hash join, which removes false positives.

Only DataFrame functions are used. The filter and the list are broadcast while
the list, which is counted, has at most ``broadcast_entries`` entries, and are
joined by shuffles beyond. Each distinct (host, path) is judged once.

Cases: a null url, or one without ://, has empty host and path and fits no
entry of a host; a URL that fits none has the default verdict; of entries of
equal length and equal key, the smallest verdict counts; entries with a null
host or path are left out; no URLs give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

WORDS, BITS_PER_ENTRY = 8, 16
BROADCAST_ENTRIES = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw, _UPPER, _LOWER), path


def _bits(key: Column) -> list[Column]:
    """For each word, the bit that the key sets in it."""
    h = F.xxhash64(key, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(h, 5 * i).bitwiseAND(F.lit(31)).cast("int")) for i in range(WORDS)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bloom(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """block, words: one row per block with any bit set."""
    words = [F.bit_or(bit).alias(f"w{i}") for i, bit in enumerate(_bits(F.col(key)))]
    return keys.groupBy(_block(F.col(key), blocks).alias("block")).agg(*words).select("block", F.array(*[f"w{i}" for i in range(WORDS)]).alias("words"))


def filter_urls(pages: DataFrame, entries: DataFrame, id_column: str = "page_id", url_column: str = "url", default: str = "allow", broadcast_entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """pages and entries (host, path, verdict) -> a row per page: id, host, path, rule, verdict."""
    host, path = host_and_path(F.col(url_column))
    judged = pages.select(F.col(id_column), host.alias("host"), path.alias("path"))
    listed = entries.where("host is not null and path is not null").select(F.concat(F.translate("host", _UPPER, _LOWER), F.lit("\u0001"), "path").alias("key"), F.length("path").alias("size"), F.concat("host", "path").alias("rule"), "verdict")
    listed = listed.groupBy("key", "size", "rule").agg(F.min("verdict").alias("verdict"))
    labels = F.length("host_part") - F.length(F.replace("host_part", F.lit("."), F.lit(""))) + 1
    shape = F.struct(labels.cast("int").alias("labels"), F.length("path_part").alias("size"))
    listed = listed.withColumns({"host_part": F.split_part("key", F.lit("\u0001"), F.lit(1)), "path_part": F.split_part("key", F.lit("\u0001"), F.lit(2))})
    stats = listed.agg(F.count("*").alias("n"), F.collect_set(shape).alias("shapes")).first()  # few: numbers of labels and lengths of paths
    listed = listed.drop("host_part", "path_part")
    if not stats["n"]:
        return judged.select(id_column, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    small = stats["n"] <= broadcast_entries
    place = F.broadcast if small else lambda df: df
    blocks = max(1, stats["n"] * BITS_PER_ENTRY // (32 * WORDS))
    table = bloom(listed, "key", blocks)
    urls = judged.groupBy("host", "path").agg(F.lit(1).alias("one")).where("host <> ''").select("host", "path")
    dots = F.length("host") - F.length(F.replace("host", F.lit("."), F.lit("")))
    shapes = F.array(*[F.struct(F.lit(a).alias("labels"), F.lit(b).alias("size")) for a, b in sorted((x["labels"], x["size"]) for x in stats["shapes"])])
    fitting = F.filter(shapes, lambda x: (x["labels"] <= F.col("dots") + 1) & (x["size"] <= F.length("path")))
    key = lambda x: F.concat(F.call_function("substring_index", F.col("host"), F.lit("."), -x["labels"]), F.lit("\u0001"), F.left(F.col("path"), x["size"]))
    candidates = urls.withColumn("dots", dots).select("host", "path", F.explode(F.transform(fitting, key)).alias("key"))
    probed = candidates.withColumn("block", _block(F.col("key"), blocks)).join(place(table), "block")
    possible = probed
    for i, bit in enumerate(_bits(F.col("key"))):
        possible = possible.where(F.col("words")[i].bitwiseAND(bit) == bit)
    exact = possible.select("host", "path", "key").join(place(listed), "key")
    order = F.struct(F.length("rule"), "rule")
    best = materialize(exact.groupBy("host", "path").agg(F.max_by("rule", order).alias("rule"), F.max_by("verdict", order).alias("verdict")), "url-hits")
    found = judged.where("host <> ''").join(best, ["host", "path"], "left").select(id_column, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
    # urls without a host fit no entry, however many they are, and need no join
    return found.unionByName(judged.where("host = ''").select(id_column, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")))
