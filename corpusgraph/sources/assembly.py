"""From files to an index: every file becomes a row, whatever its bytes are.

A file's extension chooses its parser; what cannot be read keeps its row, with
a state and a reason. The text then gives language, sentences, tokens, words
and the most frequent terms; terms of the path are kept in any case. Texts are
parsed once and tokens derived once, each written to the shared folder.

Cases: a placeholder of a file that is still elsewhere, a file over the bound
and a damaged file are errors with a reason; a file of a format without text
keeps its metadata alone; a file without text, and null content, have no
terms; no files give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions import batches as batches_of
from ..functions import text as tx
from ..operators import tallies
from ..storage import materialize, spread
from . import inventory as inv
from . import parsers as pr
from . import pdf
from .parsers import docx_text, rtf_text

MAX_TEXT, TOP_TERMS, REPEATS = 2 << 20, 400, 20
NOT_HERE, ERROR = "no content", "error"


def _spaced(x: Column) -> Column:
    return F.regexp_replace(x, r"[_\-.]+", " ")


def data_text(ext: Column, text: Column) -> tuple[Column, Column, Column]:
    """Tables and JSON: state, text and notice. The header's fields or the keys, repeated as often as they occur (20 times at most); values are never read."""
    fields, keys = pr.csv_headers(text), pr.json_key_counts(text)
    header = F.array_join(F.transform(fields, _spaced), " \n")
    pairs = F.transform(F.array_sort(F.map_entries(keys)), lambda e: F.array_join(F.array_repeat(_spaced(e["key"]), F.least(e["value"], F.lit(REPEATS))), " "))
    is_json = ext == "json"
    state = F.when(is_json, F.when(keys.isNull(), "error").when(F.size(keys) == 0, "no text").otherwise("ok")).when(F.size(fields) == 0, "no text").otherwise("ok")
    notice = F.when(is_json & keys.isNull(), "no valid JSON").when(is_json & (F.size(keys) == 0), "JSON without keys").when(~is_json & (F.size(fields) == 0), "no header line")
    return state, F.when(is_json, F.array_join(pairs, " ")).otherwise(header), notice


def _rtf(content: bytes) -> str:
    return rtf_text(content.decode("latin-1"))


def _read_bytes(readers: dict):
    @F.pandas_udf("struct<state: string, text: string, error: string>")
    def read(ext: pd.Series, content: pd.Series) -> pd.DataFrame:
        rows = []
        for e, data in zip(ext, content):
            try:
                text = readers[e](data or b"") if e in readers else None
                if isinstance(text, tuple):  # a reader that tells the state itself
                    rows.append(text)
                    continue
                rows.append(("metadata only", "", f"no reader for {e}") if text is None else ("ok" if text else "no text", text, None))
            except Exception as error:  # a damaged file must not end the job
                rows.append(("error", "", str(error) or type(error).__name__))
        return pd.DataFrame(rows, columns=["state", "text", "error"])

    return read


def parsed(files: DataFrame, readers: dict | None = None) -> DataFrame:
    """files (path, size, content, and placeholder, modified_ms and error if known) -> path, name, ext, size, modified_ms, hash, parser, state, text, links, error.

    Links are the local targets that a note or a page names, percent signs decoded.
    """
    known = {"rtf": _rtf, "docx": docx_text, "pdf": pdf.read, **(readers or {})}
    away = F.coalesce(F.col("placeholder"), F.lit(False)) if "placeholder" in files.columns else F.lit(False)
    name = F.regexp_extract("path", r"[^/]*$", 0)
    given = lambda c, kind: (F.col(c) if c in files.columns else F.lit(None)).cast(kind)
    f = files.select("path", name.alias("name"), inv.extension(F.col("path")).alias("ext"), "size", "content", away.alias("away"), given("modified_ms", "long").alias("modified_ms"), given("error", "string").alias("unread"))
    parser, state = inv.route(F.col("ext"), F.col("size"))
    f = f.withColumns({"parser": F.when(F.col("away"), "none").otherwise(parser), "state": F.when(F.col("away") | F.col("unread").isNotNull(), "error").otherwise(state)})
    open_ = F.col("state") == "ok"
    plain, packed = open_ & F.col("parser").isin("text", "html", "data"), open_ & F.col("parser").isin("rtf", "docx", "pdf")
    f = f.withColumn("decoded", F.when(plain, pr.decode_bytes(F.when(plain, F.col("content")))["text"]))
    f = f.withColumn("read", _read_bytes(known)("ext", F.when(packed, F.col("content"))))
    html = F.when(F.col("parser") == "html", pr.html_text(F.col("decoded")))
    f = f.withColumn("html", F.when(html.contains("&#"), pr.decode_numeric(html)).otherwise(html))
    markdown = F.col("ext").isin("md", "markdown", "mdown")
    data_state, data, notice = data_text(F.col("ext"), F.when(F.col("parser") == "data", F.col("decoded")))
    text = F.when(F.col("parser") == "text", F.when(markdown, pr.clean_markdown(F.col("decoded"))).otherwise(F.col("decoded"))).when(F.col("parser") == "html", F.col("html"))
    text = F.coalesce(F.when(plain & (F.col("parser") == "data"), data).when(plain, text).when(packed, F.col("read.text")), F.lit(""))
    found = F.when(~open_, F.col("state")).when(F.col("parser") == "data", data_state).when(packed, F.col("read.state")).when(~text.rlike(r"\S"), "no text").otherwise("ok")
    reason = F.when(F.col("away"), "still in the cloud").when(F.col("unread").isNotNull(), F.col("unread")).when(F.col("state") == "error", "over the size bound").when(F.col("state") == "metadata only", F.concat(F.lit("no text in "), inv.family(F.col("ext")))).when(packed, F.col("read.error")).when(F.col("parser") == "data", notice)
    content_hash = F.when(F.col("away"), NOT_HERE).when(F.col("state") == "error", ERROR).otherwise(inv.content_hash(F.coalesce("content", F.lit(b""))))
    none = F.array().cast("array<string>")
    noted = F.concat(pr.wiki_links(F.col("decoded")), pr.markdown_links(F.col("decoded")), pr.bare_paths(F.col("decoded")))
    links = F.when(F.col("parser") == "text", noted).when(F.col("parser") == "html", pr.html_links(F.col("decoded")))
    links = pr.unquote_all(F.array_distinct(F.filter(F.coalesce(links, none), lambda x: x != "")))
    kept = f.select("path", "name", "ext", "size", "modified_ms", content_hash.alias("hash"), "parser", found.alias("state"), text.alias("text"), links.alias("links"), reason.alias("error"))
    return kept


def assembled(rows: DataFrame, extra_stop=()) -> DataFrame:
    """Rows of parsed -> the index: with truncated, language, sentences, tokens, words, terms (lemma, form, n; the most frequent), path_terms."""
    cut = materialize(rows, "parsed").withColumn("truncated", F.length("text") > MAX_TEXT).withColumn("text", F.substring("text", 1, MAX_TEXT))
    cut = cut.withColumns({"words": F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))), "path_terms": F.array_distinct(tx.path_terms(F.col("path"), extra_stop))})
    stop, others = tx.stop_set(extra_stop), [c for c in cut.columns if c not in ("text", "words", "path_terms")]

    def analysed(batches):
        for part, t in batches_of.parts(batches, stop):
            texts = [x if x and x.strip(batches_of._SPACE) else None for x in part.column("text").to_pylist()]
            read = np.array([x is not None for x in texts], bool)
            r = tallies._terms_of(t, TOP_TERMS)
            own = pa.StructArray.from_arrays([batches_of._strings(t.known.lemmas, r["lemma"]), batches_of._strings(t.known.items, r["form"]), pa.array(r["n"], pa.int32())], ["lemma", "form", "n"])
            terms = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(r["text"], minlength=len(texts)))]), pa.int32()), own)
            new = {
                "language": batches_of._strings(list(batches_of.LANGUAGES), np.where(read, t.language, 3)), "sentences": pa.array([len(batches_of.sentences(x)) if x else 0 for x in texts], pa.int32()), "tokens": pa.array(np.diff(t.starts), pa.int32()),
                "words": part.column("words"), "path_terms": part.column("path_terms"), "terms": terms,
            }
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), *new.values()], [*others, *new])

    term = StructType([StructField("lemma", StringType()), StructField("form", StringType()), StructField("n", IntegerType())])
    schema = StructType([cut.schema[c] for c in others]).add("language", StringType()).add("sentences", IntegerType()).add("tokens", IntegerType()).add("words", IntegerType()).add("path_terms", ArrayType(StringType())).add("terms", ArrayType(term))
    return materialize(spread(cut).mapInArrow(analysed, schema), "assembled")
