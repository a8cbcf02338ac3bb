"""Terms, nodes and edges of documents, counted within tasks before anything is shuffled.

The same rows as the groupings over token rows in ``concepts`` give. Those
count a path once however many documents bear it, so where a path is null or
not a document's own, they are taken.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import batches as ba
from ..functions import text as tx
from ..storage import spread

HELD = 1 << 21  # rows that a task sums up before it gives them away


def own_paths(docs: DataFrame) -> bool:
    """Whether every document has a path, and no other document has it."""
    paths = docs.select("path")
    return paths.where("path IS NULL").isEmpty() and paths.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def _starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.zeros(len(sorted_keys[0]), bool)
    new[:1] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _terms_of(t: ba.Tokens, top: int) -> dict[str, np.ndarray]:
    """text, lemma, form, n, rank of each text's most frequent lemmas, in this order; forms are the most used, first seen."""
    own = t.text * np.int64(max(1, len(t.known.lemmas))) + t.lemma
    order = np.lexsort((t.form, own))  # stable, so that places rise
    own, form, seen = own[order], t.form[order], t.place[order]
    at = _starts(own, form)
    k = np.diff(np.append(at, len(own)))
    own, form, seen = own[at], form[at], seen[at]
    order = np.lexsort((seen, -k, own))
    own, form, k = own[order], form[order], k[order]
    at = _starts(own)
    n = np.add.reduceat(k, at) if len(at) else k
    text, lemma = np.divmod(own[at], max(1, len(t.known.lemmas)))
    form = form[at]
    used, place = np.unique(lemma, return_inverse=True)
    names = [t.known.lemmas[i] for i in used.tolist()]
    alphabetic = np.empty(len(names), np.int64)
    alphabetic[np.array(sorted(range(len(names)), key=names.__getitem__), np.int64)] = np.arange(len(names))
    order = np.lexsort((alphabetic[place.reshape(-1)], -n, text))
    text, lemma, form, n = text[order], lemma[order], form[order], n[order]
    at = _starts(text)
    rank = np.arange(len(text)) - np.repeat(at, np.diff(np.append(at, len(text)))) + 1
    kept = rank <= top
    return {"text": text[kept], "lemma": lemma[kept], "form": form[kept], "n": n[kept], "rank": rank[kept]}


def terms(docs: DataFrame, top: int, extra_stop: Iterable[str] = ()) -> DataFrame:
    """path, text (paths of their own) -> path, lemma, form, n, rank. No shuffle."""
    stop = tx.stop_set(extra_stop)

    def count(batches):
        for part, t in ba.parts(batches, stop):
            r = _terms_of(t, top)
            yield pa.RecordBatch.from_arrays([part.column("path").take(pa.array(r["text"])), ba._strings(t.known.lemmas, r["lemma"]), ba._strings(t.known.items, r["form"]), pa.array(r["n"], pa.int64()), pa.array(r["rank"], pa.int32())], ["path", "lemma", "form", "n", "rank"])

    return spread(docs.select("path", "text")).mapInArrow(count, "path string, lemma string, form string, n long, rank int")


def nodes(docs: DataFrame, extra_stop: Iterable[str] = ()) -> DataFrame:
    """path, text (paths of their own) -> lemma, form, frequency, docs."""
    stop = tx.stop_set(extra_stop)

    def count(batches):
        held, paths, known, size = [], [], None, 0

        def given():
            code, k, own, doc, pos = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(np.array(paths, object), kind="stable")
            rank = np.empty(len(paths), np.int64)
            rank[order] = np.arange(len(paths))
            rank = rank[doc]
            by = np.lexsort((pos, rank, code))
            at = _starts(code[by])
            first = by[at]
            lemma, form = code[first] >> 32, code[first] & 0xFFFFFFFF
            return pa.RecordBatch.from_arrays(
                [ba._strings(known.lemmas, lemma), ba._strings(known.items, form), pa.array(np.add.reduceat(k[by], at)), pa.array(np.add.reduceat(own[by], at)), pa.array([paths[i] for i in doc[first].tolist()], pa.string()), pa.array(pos[first], pa.int64())],
                ["lemma", "form", "k", "docs", "path", "pos"],
            )

        for part, t in ba.parts(batches, stop):
            if held and (t.known is not known or size > HELD):
                yield given()
                held, paths, size = [], [], 0
            known = t.known
            if not len(t.text):
                continue
            own = part.column("path").to_pylist()
            rank = np.empty(len(own), np.int64)
            rank[np.array(sorted(range(len(own)), key=own.__getitem__))] = np.arange(len(own))
            code = t.lemma << 32 | t.form
            by = np.lexsort((t.place, rank[t.text], code))
            at = _starts(code[by])
            first = by[at]
            pairs = np.unique(t.lemma * np.int64(len(own)) + t.text) // len(own)
            lemma, in_docs = np.unique(pairs, return_counts=True)
            docs_of = np.zeros(len(at), np.int64)
            of = code[first] >> 32
            docs_of[_starts(of)] = in_docs[np.searchsorted(lemma, of[_starts(of)])]
            held.append((code[first], np.diff(np.append(at, len(by))), docs_of, len(paths) + t.text[first], t.place[first]))
            paths += own
            size += len(at)
        if held:
            yield given()

    rows = spread(docs.select("path", "text")).mapInArrow(count, "lemma string, form string, k long, docs long, path string, pos long")
    forms = rows.repartition("lemma").groupBy("lemma", "form").agg(F.sum("k").alias("k"), F.sum("docs").alias("docs"), F.min(F.struct("path", "pos")).alias("seen"))
    return forms.groupBy("lemma").agg(F.min_by("form", F.struct(-F.col("k"), "seen")).alias("form"), F.sum("k").alias("frequency"), F.sum("docs").alias("docs"))


def edge_shares(docs: DataFrame, kept: Iterable[str] | None = None, window: int = 4, same: int = 10, cross: int = 4, extra_stop: Iterable[str] = ()) -> DataFrame:
    """path, text (paths of their own) -> a, b, tenths, docs as far as each task sums them. kept: the lemmas of the pairs that count."""
    stop = tx.stop_set(extra_stop)
    few = None if kept is None else frozenset(kept)

    def count(batches):
        held, known, size = [], None, 0

        def summed():
            code, tenths, own = (np.concatenate(x) for x in zip(*held))
            by = np.argsort(code, kind="stable")
            at = _starts(code[by])
            return code[by][at], np.add.reduceat(tenths[by], at), np.add.reduceat(own[by], at)

        def given(code, tenths, own):
            for i in range(0, len(code), 1 << 18):
                x, y = code[i : i + (1 << 18)] >> 32, code[i : i + (1 << 18)] & 0xFFFFFFFF
                used, at = np.unique(np.concatenate([x, y]), return_inverse=True)
                names = [known.lemmas[k] for k in used.tolist()]
                rank = np.empty(len(names), np.int64)
                rank[np.array(sorted(range(len(names)), key=names.__getitem__), np.int64)] = np.arange(len(names))
                words, at = pa.array(names, pa.string()), at.reshape(2, -1)
                swap = rank[at[0]] > rank[at[1]]
                yield pa.RecordBatch.from_arrays([words.take(pa.array(np.where(swap, at[1], at[0]))), words.take(pa.array(np.where(swap, at[0], at[1]))), pa.array(tenths[i : i + (1 << 18)]), pa.array(own[i : i + (1 << 18)])], ["a", "b", "tenths", "docs"])

        for part, t in ba.parts(batches, stop):
            if held and t.known is not known:
                yield from given(*summed())
                held, size = [], 0
            known = t.known
            asked = None if few is None else np.fromiter((x in few for x in known.lemmas), bool, len(known.lemmas))
            codes, tenths, texts = [], [], []
            for d in range(1, window):
                x, y = t.lemma[:-d], t.lemma[d:]
                good = (t.text[:-d] == t.text[d:]) & (x != y)
                if asked is not None:
                    good &= asked[x] & asked[y]
                x, y = x[good], y[good]
                codes.append(np.minimum(x, y) << 32 | np.maximum(x, y))
                tenths.append(np.where(t.sentence[:-d][good] == t.sentence[d:][good], same, cross))
                texts.append(t.text[:-d][good])
            code, ten, text = np.concatenate(codes), np.concatenate(tenths), np.concatenate(texts)
            if not len(code):
                continue
            by = np.lexsort((text, code))
            code, ten, text = code[by], ten[by], text[by]
            at = _starts(code)
            new = np.zeros(len(code), np.int64)
            new[_starts(code, text)] = 1
            held.append((code[at], np.add.reduceat(ten, at), np.add.reduceat(new, at)))
            size += len(at)
            if size > HELD:
                held = [summed()]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield from given(*held[0])
                    held, size = [], 0
        if held:
            yield from given(*summed())

    return spread(docs.select("path", "text")).mapInArrow(count, "a string, b string, tenths long, docs long")


def edges(docs: DataFrame, kept: Iterable[str] | None = None, **more) -> DataFrame:
    """path, text (paths of their own) -> a, b, tenths, docs."""
    return edge_shares(docs, kept, **more).groupBy("a", "b").agg(F.sum("tenths").alias("tenths"), F.sum("docs").alias("docs"))


def lemma_counts(docs: DataFrame, extra_stop: Iterable[str] = ()) -> DataFrame:
    """path, text (paths of their own) -> path, terms: how many lemmas each document with tokens has. No shuffle."""
    stop = tx.stop_set(extra_stop)

    def count(batches):
        for part, t in ba.parts(batches, stop):
            text, n = np.unique(np.unique(t.text * np.int64(max(1, len(t.known.lemmas))) + t.lemma) // max(1, len(t.known.lemmas)), return_counts=True)
            yield pa.RecordBatch.from_arrays([part.column("path").take(pa.array(text)), pa.array(n)], ["path", "terms"])

    return spread(docs.select("path", "text")).mapInArrow(count, "path string, terms long")


def partners(docs: DataFrame, lemma: str | None, window: int = 4, extra_stop: Iterable[str] = ()) -> DataFrame:
    """path, text -> path, a, b, sentence: the pairs that have a lemma. No shuffle."""
    stop = tx.stop_set(extra_stop)

    def found(batches):
        for part, t in ba.parts(batches, stop):
            asked = t.known.numbers.get(lemma, -1)
            for d in range(1, window):
                x, y = t.lemma[:-d], t.lemma[d:]
                good = np.flatnonzero((t.text[:-d] == t.text[d:]) & (x != y) & ((x == asked) | (y == asked)))
                other = np.where(x[good] == asked, y[good], x[good])
                yield pa.RecordBatch.from_arrays([part.column("path").take(pa.array(t.text[good])), pa.array([lemma] * len(good), pa.string()), ba._strings(t.known.lemmas, other), pa.array(t.sentence[good], pa.int32())], ["path", "a", "b", "sentence"])

    return spread(docs.select("path", "text")).mapInArrow(found, "path string, a string, b string, sentence int")


def _pairs(text: np.ndarray, lemma: np.ndarray, sentence: np.ndarray, window: int):
    """Of tokens in the order of texts: for every pair at a distance below window its code, text, the left token's sentence, and whether both share it."""
    out = []
    for d in range(1, window):
        x, y = lemma[:-d], lemma[d:]
        good = (text[:-d] == text[d:]) & (x != y)
        x, y = x[good].astype(np.int64), y[good].astype(np.int64)
        out.append((np.minimum(x, y) << 32 | np.maximum(x, y), text[:-d][good], sentence[:-d][good], (sentence[:-d] == sentence[d:])[good]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _named(code: np.ndarray, names: list[str]) -> list[pa.Array]:
    """The lemmas a < b of pairs."""
    used, at = np.unique(np.concatenate([code >> 32, code & 0xFFFFFFFF]), return_inverse=True)
    own = [names[k] for k in used.tolist()]
    rank = np.empty(len(own), np.int64)
    rank[np.array(sorted(range(len(own)), key=own.__getitem__), np.int64)] = np.arange(len(own))
    words, (x, y) = pa.array(own, pa.string()), at.reshape(2, -1)
    swap = rank[x] > rank[y]
    return [words.take(pa.array(np.where(swap, y, x))), words.take(pa.array(np.where(swap, x, y)))]


def edge_samples(docs: DataFrame, limit: int, window: int = 4, extra_stop: Iterable[str] = ()) -> DataFrame:
    """path, text (paths of their own) -> a, b, path, sentence, sample: an edge's first places; a task gives its own first few of each part."""
    stop = tx.stop_set(extra_stop)

    def places(batches):
        for part, t in ba.parts(batches, stop):
            own = part.column("path").to_pylist()
            rank = np.empty(len(own), np.int64)
            rank[np.array(sorted(range(len(own)), key=own.__getitem__), np.int64)] = np.arange(len(own))
            code, text, sentence, _ = _pairs(t.text, t.lemma, t.sentence, window)
            order = np.lexsort((sentence, rank[text], code))
            code, text, sentence = code[order], text[order], sentence[order]
            at = _starts(code, text, sentence)
            code, text, sentence = code[at], text[at], sentence[at]
            at = _starts(code)
            kept = np.arange(len(code)) - np.repeat(at, np.diff(np.append(at, len(code)))) < limit
            code, text, sentence = code[kept], text[kept], sentence[kept]
            for i in range(0, len(code), 1 << 18):
                few = slice(i, i + (1 << 18))
                yield pa.RecordBatch.from_arrays([*_named(code[few], t.known.lemmas), part.column("path").take(pa.array(text[few])), pa.array(sentence[few], pa.int32())], ["a", "b", "path", "sentence"])

    first = F.row_number().over(Window.partitionBy("a", "b").orderBy("path", "sentence"))
    found = spread(docs.select("path", "text")).mapInArrow(places, "a string, b string, path string, sentence int")
    return found.withColumn("sample", first).where(F.col("sample") <= limit)


def version_edges(analysis: DataFrame, window: int, same: int, cross: int) -> DataFrame:
    """tokens, valid_from, valid_to (a row for each version) -> a, b, tenths, docs, valid_from, valid_to as far as batches sum them."""

    def shares(batches):
        for batch in batches:
            lists = batch.column("tokens")
            values = lists.flatten()
            lemma = values.field("lemma").dictionary_encode()
            text = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            spans: dict = {}
            of = np.array([spans.setdefault(x, len(spans)) for x in zip(batch.column("valid_from").to_pylist(), batch.column("valid_to").to_pylist())], np.int64)
            firsts = np.unique(of, return_index=True)[1]
            code, text, _, together = _pairs(text, lemma.indices.to_numpy(), values.field("sentence").to_numpy(), window)
            tenths = np.where(together, same, cross)
            order = np.lexsort((text, code, of[text]))
            code, text, tenths = code[order], text[order], tenths[order]
            span = of[text]
            at = _starts(span, code)
            if not len(at):
                continue
            new = np.zeros(len(code), np.int64)
            new[_starts(code, text)] = 1
            tenths, docs, code, span = np.add.reduceat(tenths, at), np.add.reduceat(new, at), code[at], span[at]
            names = lemma.dictionary.to_pylist()
            for i in range(0, len(code), 1 << 18):
                few = slice(i, i + (1 << 18))
                row = pa.array(firsts[span[few]])
                yield pa.RecordBatch.from_arrays([*_named(code[few], names), pa.array(tenths[few], pa.int64()), pa.array(docs[few], pa.int64()), batch.column("valid_from").take(row), batch.column("valid_to").take(row)], ["a", "b", "tenths", "docs", "valid_from", "valid_to"])

    schema = StructType().add("a", "string").add("b", "string").add("tenths", "long").add("docs", "long").add(analysis.schema["valid_from"]).add(analysis.schema["valid_to"])
    return analysis.select("tokens", "valid_from", "valid_to").mapInArrow(shares, schema)
