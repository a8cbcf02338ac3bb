"""The concept graph kept up to date by a stream: only differences are written.

The stream is keyed by path. A path's state holds its last text's hash, time and
lemmas with their sentences; a newer text emits the new share of nodes and edges and
takes the old one back. Epochs append these differences; the graph is their sum,
and ``compacted`` writes that sum once, where many epochs have come together.

Cases: a null text deletes the path; of several texts of a path the one of the latest time counts,
of one time that of the largest hash, also across batches, so that the order in which batches
come changes nothing; a text that is the same emits nothing; a null path is left out.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as tx
from ..operators import concepts as co

DIFFERENCE = "kind string, a string, b string, amount long, docs long"
_STATE = "at long, hash string, lemmas string"


def _share(lemmas: list[str], sentences: list[int]) -> dict[tuple, int]:
    """(kind, a, b) -> a document's amount: occurrences of a lemma, tenths of a pair."""
    out: Counter = Counter(("node", x, "") for x in lemmas)
    for d in range(1, co.WINDOW):
        for i in range(len(lemmas) - d):
            a, b = sorted((lemmas[i].encode(), lemmas[i + d].encode()))
            if a != b:
                out["edge", a.decode(), b.decode()] += co.SAME if sentences[i] == sentences[i + d] else co.CROSS
    return out


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    at, known, held = state.get if state.exists else (-(1 << 62), "", "[[], []]")
    best = (at, known, None)
    for batch in batches:
        for when, text, lemmas, sentences in zip(batch["at"], batch["text"], batch["lemmas"], batch["sentences"]):
            digest = "" if text is None else hashlib.sha256(text.encode()).hexdigest()
            if (int(when), digest) > best[:2]:
                best = (int(when), digest, [[], []] if text is None else [list(lemmas), [int(x) for x in sentences]])
    if best[2] is None:
        return
    state.update((best[0], best[1], json.dumps(best[2])))
    if best[1] == known:
        return
    new, old = _share(*best[2]), _share(*json.loads(held))
    rows = []
    for k in {**new, **old}:
        amount, docs = new.get(k, 0) - old.get(k, 0), (k in new) - (k in old)
        if amount or docs:
            rows.append((*k, amount, docs))
    if rows:
        yield pd.DataFrame(rows, columns=["kind", "a", "b", "amount", "docs"])


def differences(stream: DataFrame) -> DataFrame:
    """A stream of (path, text, at: a number that grows with time) -> differences of nodes (b empty) and edges."""
    known = stream.where("path IS NOT NULL").select("path", F.coalesce(F.col("at").cast("long"), F.lit(0)).alias("at"), "text")
    tokens = tx.tokens(F.col("text"), tx.language(F.col("text")))
    rows = known.withColumn("t", tokens).select("path", "at", "text", F.col("t.lemma").alias("lemmas"), F.col("t.sentence").alias("sentences"))
    return rows.groupBy("path").applyInPandasWithState(_update, DIFFERENCE, _STATE, "append", GroupStateTimeout.NoTimeout)


def start(stream: DataFrame, folder: str, checkpoint: str):
    """Append each epoch's differences under folder; a repeated epoch is not written twice."""
    return differences(stream).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").start()


def graph(written: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Differences -> nodes (lemma, frequency, docs), edges (a, b, tenths, docs)."""
    sums = written.groupBy("kind", "a", "b").agg(F.sum("amount").alias("amount"), F.sum("docs").alias("docs")).where("docs > 0")
    nodes = sums.where("kind = 'node'").select(F.col("a").alias("lemma"), F.col("amount").alias("frequency"), "docs")
    return nodes, sums.where("kind = 'edge'").select("a", "b", F.col("amount").alias("tenths"), "docs")


def compacted(written: DataFrame) -> DataFrame:
    """The same graph with one difference for each node and edge."""
    return written.groupBy("kind", "a", "b").agg(F.sum("amount").alias("amount"), F.sum("docs").alias("docs")).where("docs <> 0 OR amount <> 0")
