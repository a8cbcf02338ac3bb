"""Text functions as Column expressions: term keys, sentences, language, lemmas, tokens, path terms.

Nothing here needs a shuffle or a Python worker: all of a document's tokens are
derived inside its row.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import stopwords

MIN_LENGTH = 3
WORD = r"[\p{L}\p{N}][\p{L}\p{N}\-·']*"
# fixed values: abbreviations that end no sentence
ABBREVIATIONS = r"dr|dra|sr|sra|lic|mtro|etc|vs|fig|tab|no|núm|nro|pág|aprox|ej|p\.?\s?ej|et al|e\.?g|i\.?e|mg|ml|kg|cm|mm|hrs?"
# fixed values: endings that singular and plural share
INVARIABLE = r"(sis|tis|xis|us|is|ax|ex|ix|ox)$"
_GUARD, _MARK = "\u0003", "\u0002"


def _bases(keep: str) -> tuple[str, str]:
    """Letters below U+3000 with a single plain letter or digit under their accents, and those."""
    source, target = [], []
    for code in range(0x80, 0x3000):
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not "̀" <= x <= "ͯ")
        if c not in keep and c == c.lower() and len(base) == 1 and base != c and (base.isascii() and base.isalnum()):
            source.append(c)
            target.append(base)
    return "".join(source), "".join(target)


_ACCENTED, _PLAIN = _bases("ñ")
_ACCENTED_N, _PLAIN_N = _bases("")


def term_key(word: Column) -> Column:
    """Lower case without accents, ñ kept, other than a-z, 0-9 and ñ removed."""
    return F.regexp_replace(F.translate(F.lower(word), _ACCENTED, _PLAIN), "[^a-z0-9ñ]", "")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    """The sentences of a text; a stop after an abbreviation ends none."""
    guarded = text
    for _ in range(2):  # twice, for neighbouring abbreviations
        guarded = F.regexp_replace(guarded, rf"(?iu)(^|[^A-Za-z0-9_])({ABBREVIATIONS})\.\s+", f"$1$2.{_GUARD} ")
    parts = F.split(F.regexp_replace(guarded, r"([.!?…]+|\n{2,})(\s+|\z)", f"$1{_MARK}"), _MARK)
    return F.filter(F.transform(parts, lambda p: trimmed(F.translate(p, _GUARD, ""))), lambda p: p != "")


def language(text: Column) -> Column:
    """es, en, mixto or indeterminado, by recognised function words among the first 20 000 characters."""
    sample = F.translate(F.lower(F.substring(text, 1, 20_000)), _ACCENTED_N, _PLAIN_N)
    words = F.regexp_extract_all(sample, F.lit("[a-zñ]{2,}"), F.lit(0))
    es = F.size(F.filter(words, lambda w: w.isin(stopwords.SPANISH)))
    en = F.size(F.filter(words, lambda w: w.isin(stopwords.ENGLISH)))
    return (
        F.when((F.size(words) < 20) | ((es == 0) & (en == 0)) | text.isNull(), "indeterminado")
        .when(es >= en * 1.3, "es")
        .when(en >= es * 1.3, "en")
        .otherwise("mixto")
    )


def _cut(p: Column, n: int) -> Column:
    return F.left(p, F.length(p) - n)


def lemma_es(p: Column) -> Column:
    n, base = F.length(p), _cut(p, 2)
    return (
        F.when(p.rlike(INVARIABLE), p)
        .when((n > 7) & p.endswith("mente"), _cut(p, 5))
        .when((n > 7) & p.endswith("ciones"), F.concat(_cut(p, 6), F.lit("cion")))
        .when((n > 7) & p.endswith("idades"), F.concat(_cut(p, 6), F.lit("idad")))
        .when((n > 4) & p.endswith("ces"), F.concat(_cut(p, 3), F.lit("z")))
        .when((n > 4) & p.endswith("es"), F.when(base.rlike("[lrndzjxy]$"), base).otherwise(_cut(p, 1)))
        .when((n > 4) & p.rlike("[aeiou]s$"), _cut(p, 1))
        .otherwise(p)
    )


def lemma_en(p: Column) -> Column:
    n, base = F.length(p), _cut(p, 3)
    doubled = (F.length(base) > 3) & (F.right(base, F.lit(1)) == F.substring(base, -2, 1))
    return (
        F.when(p.rlike(INVARIABLE), p)
        .when((n > 4) & p.endswith("ies"), F.concat(base, F.lit("y")))
        .when((n > 4) & p.rlike("(sses|shes|ches|xes|zes)$"), _cut(p, 2))
        .when((n > 5) & p.endswith("ing"), F.when(doubled, _cut(base, 1)).otherwise(base))
        .when((n > 4) & p.endswith("ed") & ~p.endswith("eed"), _cut(p, 2))
        .when((n > 3) & p.endswith("s") & ~p.endswith("ss"), _cut(p, 1))
        .otherwise(p)
    )


def lemma_mixed(p: Column) -> Column:
    return F.when(p.rlike(INVARIABLE), p).when((F.length(p) > 4) & p.rlike("[aeiou]s$"), _cut(p, 1)).otherwise(p)


def lemma(p: Column, lang: Column) -> Column:
    return F.when(lang == "es", lemma_es(p)).when(lang == "en", lemma_en(p)).otherwise(lemma_mixed(p))


def stop_set(extra: Iterable[str] = ()) -> list[str]:
    """The base stop words with a user's own, which are given as written."""
    own = {"".join(c for c in unicodedata.normalize("NFD", w.lower().replace("ñ", "\u0001")) if not "̀" <= c <= "ͯ").replace("\u0001", "ñ") for w in extra}
    return sorted(stopwords.BASE | {"".join(c for c in w if c in "ñ" or (c.isascii() and c.isalnum())) for w in own})


def parse_stop_words(text: str) -> list[str]:
    """A user's stop words: separated by commas, semicolons or line ends."""
    import re

    return [w.strip() for w in re.split(r"[\n,;]+", text or "") if w.strip()]


def tokens(text: Column, lang: Column, extra_stop: Iterable[str] = (), minimum: int = MIN_LENGTH) -> Column:
    """array<struct<lemma, form, sentence>> in the text's order; the sentence counts from 0."""
    stop = stop_set(extra_stop)
    per = F.transform(sentences(text), lambda s, i: F.transform(F.regexp_extract_all(s, F.lit(WORD), F.lit(0)), lambda w: F.struct(term_key(w).alias("key"), w.alias("form"), i.alias("sentence"))))
    keyed = F.filter(F.flatten(per), lambda t: (F.length(t["key"]) >= minimum) & ~t["key"].rlike(r"^\d+$") & ~t["key"].isin(stop))
    done = F.transform(keyed, lambda t: F.struct(lemma(t["key"], lang).alias("lemma"), t["form"].alias("form"), t["sentence"].alias("sentence")))
    return F.filter(done, lambda t: (F.length(t["lemma"]) >= minimum) & ~t["lemma"].isin(stop))


def path_terms(path: Column, extra_stop: Iterable[str] = ()) -> Column:
    """Distinct terms of a path, in its order: keys of words of three letters or more, not lemmatised."""
    stop = stop_set(extra_stop)
    text = F.regexp_replace(path, r"[/\\]", " ")
    text = F.regexp_replace(text, r"\.[A-Za-z0-9]{1,5}$", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"[_\-.]+", " "), "([a-z])([A-Z])", "$1 $2")
    keys = F.transform(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]{3,}"), F.lit(0)), term_key)
    return F.filter(keys, lambda k: (F.length(k) >= 3) & ~k.rlike(r"^\d+$") & ~k.isin(stop))


def word_rows(docs: DataFrame) -> DataFrame:
    """path, text -> path, k, form, begin, finish: every word with its place in the original text, in characters from 0.

    Between two words lies what a split leaves, so places are sums of lengths; a
    document's rows are summed in its own window.
    """
    words, gaps = F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.split("text", WORD, -1)
    rows = docs.select("path", F.posexplode(F.zip_with(words, F.slice(gaps, F.lit(1), F.size(words)), lambda w, g: F.struct(w.alias("form"), F.length(g).alias("gap")))).alias("k", "w"))
    through = F.sum(F.col("w.gap") + F.length("w.form")).over(Window.partitionBy("path").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.select("path", "k", F.col("w.form").alias("form"), through.alias("finish"))
    return placed.select("path", "k", "form", (F.col("finish") - F.length("form")).alias("begin"), "finish")


def token_places(docs: DataFrame, extra_stop: Iterable[str] = (), minimum: int = MIN_LENGTH) -> DataFrame:
    """path, text -> path, pos, form, lemma, begin, finish: the tokens of ``tokens``, in its order, with their places in the text."""
    stop = stop_set(extra_stop)
    lang = docs.select("path", language(F.col("text")).alias("detected"))
    rows = word_rows(docs).withColumn("key", term_key(F.col("form")))
    rows = rows.where((F.length("key") >= minimum) & ~F.col("key").rlike(r"^\d+$") & ~F.col("key").isin(stop)).join(lang, "path")
    rows = rows.withColumn("lemma", lemma(F.col("key"), F.col("detected"))).where((F.length("lemma") >= minimum) & ~F.col("lemma").isin(stop))
    pos = F.row_number().over(Window.partitionBy("path").orderBy("k")) - 1
    return rows.select("path", pos.alias("pos"), "form", "key", "lemma", "begin", "finish")
