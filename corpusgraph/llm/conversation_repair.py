"""Conversation structure repair: a dynamic program over a grammar.

A row of a conversation is one symbol: its role (system, user, assistant, other) and
its fault (blank, duplicate, truncated or none). The symbols of all conversations are
compressed by Re-Pair: the most frequent pairs become rules, round after round,
until no pair occurs twice or ``MAX_RULES`` are reached. Each rule has one min-plus
transfer matrix: for each pair of states (start, after system, after user, after
assistant) the least cost and, as a rope over its parts' ropes, the ASCII-least audit
of that cost. Matrices are made once, from the bottom up, and shared by all
conversations, which multiply the matrices of their few remaining symbols.

Inserts stand before the row they precede, so that no audit of a stretch of rows is
the beginning of another audit of it: the least of a stretch stays the least in
every context, and matrices can be multiplied in any grouping.

Rows are range-partitioned by conversation, turn, role and text and cut into pieces
of at most ``PIECE_ROWS`` rows and ``PIECE_CHARS`` characters, so that a conversation of any length spreads
over tasks. One of several pieces, or on the edge of two partitions, takes three small joins more: rows' first
occurrences, costs to the end and states at the pieces' beginnings, all over rows of
a few numbers per piece. What stays in order by definition is the hash of a
conversation's text: its pieces stream through one task, one piece at a time.

Cases: nulls in conversation or turn count as one space in the damage's key, null
roles and texts are one space; equal turns order by role and text; a null
conversation is one like the others; one without rows after the damage has zeros;
no conversations give no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

MAX_RULES, ROUNDS, PIECE_ROWS, PIECE_CHARS = 2048, 12, 4096, 4_000_000
BROADCAST_CONVERSATIONS = 100_000

#: States: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Symbols: role initials (x: any other), in capitals where the row is truncated; b and d are blank and duplicate rows.
LETTERS = "suaxSUAXbd"
_RULE = 0xE000
#: From a state, the shortest inserts to another.
_INSERTS = {START: {START: 0, USER: 1, ASSISTANT: 2}, SYSTEM: {SYSTEM: 0, USER: 1, ASSISTANT: 2}, USER: {USER: 0, ASSISTANT: 1}, ASSISTANT: {ASSISTANT: 0, USER: 1}}
#: Inserts that end a conversation from each state.
ENDING = (0, 2, 1, 0)
_CONTENT = re.compile(r"[^\x20\x09-\x0D]")
_LAST = re.compile(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z")

_PIECE = "conv string, piece long, turns array<long>, roles array<string>, texts array<string>, letters string"
_RESULT = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(conversations: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """conv, turn, role, text after the planted damage; a dropped row stays with a null text, so that its conversation is known."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name(id_column), F.lit(":"), name(turn_column)).cast("binary")) % 20
    role, text = name(role_column), name(text_column)
    text = F.when(kind == 0, None).when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    rows = conversations.select(
        F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("conv"),
        F.col(turn_column).cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        text.alias("text"),
        F.when(kind == 3, 2).otherwise(1).alias("copies"),
    )
    return rows.select(F.explode(F.array_repeat(F.struct("conv", "turn", "role", "text"), F.col("copies"))).alias("row")).select("row.*")


# --- one matrix per symbol ---------------------------------------------------------------------------


def text_of_rope(rope) -> str:
    """A rope is a string or a pair of ropes."""
    out, stack = [], [rope]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            out.append(top)
        else:
            stack.append(top[1])
            stack.append(top[0])
    return "".join(out)


def _less(new: tuple, old: tuple | None) -> bool:
    if old is None or new[0] != old[0]:
        return old is None or new[0] < old[0]
    return new[1] is not old[1] and text_of_rope(new[1]) < text_of_rope(old[1])


def letter_matrix(letter: str) -> dict[tuple[int, int], tuple]:
    """(state before, state after) -> (cost, audit) of one row with what is inserted before it."""
    actions, extra = {}, TRUNCATED if letter.isupper() else 0
    for state in range(4):
        actions[state] = [(DELETE, "D", state)]
        if letter in "bd":
            continue
        wanted = USER if state != USER else ASSISTANT
        actions[state].append((REROLE + extra, "R", wanted))
        role = letter.lower()
        if role == "s" and state == START:
            actions[state].append((KEEP + extra, "K", SYSTEM))
        elif role == "ua"[wanted == ASSISTANT]:
            actions[state].append((KEEP + extra, "K", wanted))
    out: dict = {}
    for state, inserts in _INSERTS.items():
        for between, n in inserts.items():
            for cost, audit, after in actions[between]:
                new = (INSERT * n + cost, "I" * n + audit)
                if _less(new, out.get((state, after))):
                    out[state, after] = new
    return out


def product(a: dict, b: dict) -> dict:
    """Min-plus product; ropes of the result point to those of a and b."""
    out: dict = {}
    for (state, between), (cost, rope) in a.items():
        for after in range(4):
            other = b.get((between, after))
            if other is not None:
                new = (cost + other[0], (rope, other[1]))
                if _less(new, out.get((state, after))):
                    out[state, after] = new
    return out


class Grammar:
    """Re-Pair rules over rows' symbols, each with its matrix."""

    def __init__(self, pairs: list[str] = ()):
        self.pairs: list[str] = []
        self.matrices = {x: letter_matrix(x) for x in LETTERS}
        self.add(pairs)

    def add(self, pairs: list[str]) -> None:
        for pair in pairs:
            self.matrices[chr(_RULE + len(self.pairs))] = product(self.matrices[pair[0]], self.matrices[pair[1]])
            self.pairs.append(pair)

    def compress(self, sequences: list[str]) -> list[str]:
        if not sequences:
            return []
        joined = "\n".join(sequences)
        for i, pair in enumerate(self.pairs):
            joined = joined.replace(pair, chr(_RULE + i))
        return joined.split("\n")

    def best(self, symbols: str, entry: int) -> dict[int, tuple]:
        """Of a compressed sequence: state at its end -> (cost, audit), from the state at its beginning."""
        here: dict[int, tuple] = {entry: (0, "")}
        for symbol in symbols:
            there: dict[int, tuple] = {}
            for (state, after), (cost, rope) in self.matrices[symbol].items():
                if state in here:
                    new = (here[state][0] + cost, (here[state][1], rope))
                    if _less(new, there.get(after)):
                        there[after] = new
            here = there
        return here

    def chosen(self, symbols: str, entry: int, ending: list[int]) -> tuple[int, str] | None:
        """State at the end and audit, where ending is the least cost from each state to the end of the conversation."""
        ends = [(cost + ending[after], text_of_rope(rope), after) for after, (cost, rope) in self.best(symbols, entry).items() if ending[after] >= 0]
        return (min(ends)[2], min(ends)[1]) if ends else None


def _pairs(grammar: Grammar):
    """Sequences -> counts of the pairs that are left in them, none counted twice in a run of equal symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            joined = "\n".join(grammar.compress(batch.column(0).to_pylist()))
            codes = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.int64)
            if len(codes) < 2:
                continue
            left, right = codes[:-1], codes[1:]
            starts = np.flatnonzero(np.append(True, left[1:] != left[:-1]))
            place = np.arange(len(left)) - np.repeat(starts, np.diff(np.append(starts, len(left))))
            use = (left != 10) & (right != 10) & ((left != right) | (place % 2 == 0))
            keys, counts = np.unique((left[use] << 32) | right[use], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([chr(k >> 32) + chr(k & 0xFFFFFFFF) for k in keys.tolist()], pa.string()), pa.array(counts, pa.int64())], names=["pair", "n"])

    return run


def learn(sequences: DataFrame, column: str = "letters", max_rules: int = MAX_RULES, rounds: int = ROUNDS) -> Grammar:
    """Re-Pair over all distinct sequences. A round takes the most frequent pairs that cannot overlap one another."""
    distinct, grammar = materialize(sequences.select(column).where(F.length(column) > 1).distinct(), "sequences"), Grammar()
    for _ in range(rounds):
        counted = distinct.mapInArrow(_pairs(grammar), "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1")
        taken: list[str] = []
        for row in counted.orderBy(F.col("n").desc(), "pair").limit(max_rules).collect():
            if not any(row["pair"][0] == other[1] or row["pair"][1] == other[0] for other in taken if other != row["pair"]):
                taken.append(row["pair"])
        grammar.add(taken[: max_rules - len(grammar.pairs)])
        if not taken or len(grammar.pairs) >= max_rules:
            break
    return grammar


# --- pieces of conversations -------------------------------------------------------------------------


def _letters(roles: list[str], texts: list[str], firsts: set[int] | None = None) -> str:
    """The rows' symbols. firsts: places of rows that no earlier row equals; else they are told from the rows alone."""
    seen, out = set(), []
    for i, (role, text) in enumerate(zip(roles, texts, strict=True)):
        again = (role, text) in seen if firsts is None else i not in firsts
        seen.add((role, text))
        last = _LAST.search(text)
        if last is None:
            out.append("b")
        elif again:
            out.append("d")
        else:
            letter = role[0] if role[:1] and role[0] in "sua" else "x"
            out.append(letter if last[1] in ".!?" else letter.upper())
    return "".join(out)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows -> pieces of conversations, without the rows that the damage dropped."""
    from pyspark import TaskContext

    number, conv, chars, rows, out, held = TaskContext.get().partitionId() << 32, None, 0, [], [], 0

    def close() -> None:
        nonlocal number, chars, held
        if conv is not None:
            turns, roles, texts = ([r[i] for r in rows] for i in range(3))
            out.append((conv, number, turns, roles, texts, _letters(roles, texts)))
            number, held, chars = number + 1, held + chars + 50 * len(rows), 0
            rows.clear()

    def emit() -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.string())
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv", "piece", "turns", "roles", "texts", "letters"])
        out.clear()
        return batch

    for batch in batches:
        for other, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if other != conv or len(rows) >= PIECE_ROWS or chars >= PIECE_CHARS:
                close()
                conv = other
                if len(out) >= 1000 or held >= 4 * PIECE_CHARS:
                    yield emit()
                    held = 0
            if text is not None:
                rows.append((turn, role, text))
                chars += len(text)
    close()
    if out:
        yield emit()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        conv, piece, roles, texts = (batch.column(i).to_pylist() for i in range(4))
        rows = [(c, p, k, hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest()) for c, p, rs, ts in zip(conv, piece, roles, texts, strict=True) for k, (r, t) in enumerate(zip(rs, ts, strict=True))]
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["conv", "piece", "k", "digest"])


def _relettered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        conv, piece, roles, texts, firsts = (batch.column(i).to_pylist() for i in range(5))
        letters = [_letters(r, t, set(f or ())) for r, t, f in zip(roles, texts, firsts, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(conv, pa.string()), pa.array(piece, pa.int64()), pa.array(letters, pa.string())], names=["conv", "piece", "letters"])


def _costs(grammar: Grammar):
    """A piece's least cost from each state to each, -1 where there is no way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for symbols in grammar.compress(batch.column(2).to_pylist()):
                ends = [grammar.best(symbols, entry) for entry in range(4)]
                out.append([ends[s][t][0] if t in ends[s] else -1 for s in range(4) for t in range(4)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], names=["conv", "piece", "costs"])

    return run


def _endings(rows: pa.Table) -> pa.Table:
    """Of one conversation's pieces: the least cost from each state after a piece to the end."""
    rows = rows.sort_by([("piece", "descending")])
    ending, out = [INSERT * n for n in ENDING], []
    for costs in rows.column("costs").to_pylist():
        out.append(ending)
        ways = [[costs[4 * s + t] + ending[t] for t in range(4) if costs[4 * s + t] >= 0 and ending[t] >= 0] for s in range(4)]
        ending = [min(w) if w else -1 for w in ways]
    return pa.table({"conv": rows.column("conv"), "piece": rows.column("piece"), "ending": pa.array(out, pa.list_(pa.int64()))})


def _steps(grammar: Grammar):
    """From each state before a piece, the state after it on the best way to the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for symbols, ending in zip(grammar.compress(batch.column(2).to_pylist()), batch.column(3).to_pylist(), strict=True):
                found = [grammar.chosen(symbols, entry, ending) for entry in range(4)]
                out.append([x[0] if x else -1 for x in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], names=["conv", "piece", "step"])

    return run


def _entries(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("piece")
    state, out = START, []
    for step in rows.column("step").to_pylist():
        out.append(state)
        state = step[state]
    return pa.table({"conv": rows.column("conv"), "piece": rows.column("piece"), "entry": pa.array(out, pa.int64())})


class _Conversation:
    """What a conversation's pieces come to, in order."""

    def __init__(self, conv: str):
        self.conv, self.state, self.hash, self.lines, self.audit, self.cost = conv, START, hashlib.sha256(), 0, [], 0
        self.counts = dict.fromkeys("bdt", 0)
        self.illegal, self.initial, self.first, self.last, self.turns = 0, None, None, None, 0

    def line(self, role: str, text: str) -> None:
        self.hash.update(("\n" * (self.lines > 0) + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.lines += 1

    def insert(self) -> None:
        self.state = ASSISTANT if self.state == USER else USER
        self.line("assistant" if self.state == ASSISTANT else "user", "")
        self.cost += INSERT

    def add(self, turns, roles, texts, letters: str, audit: str) -> None:
        self.audit.append(audit)
        i = 0
        for turn, role, text, letter in zip(turns, roles, texts, letters, strict=True):
            while audit[i] == "I":
                self.insert()
                i += 1
            edit, i = audit[i], i + 1
            if edit == "K":
                self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[letter.lower()]
                self.line(role, text)
            elif edit == "R":
                self.state = ASSISTANT if self.state == USER else USER
                self.line("assistant" if self.state == ASSISTANT else "user", text)
            self.cost += {"K": KEEP, "R": REROLE, "D": DELETE}[edit] + (TRUNCATED if letter.isupper() and edit != "D" else 0)
            if letter in "bd" or letter.isupper():
                self.counts["t" if letter.isupper() else letter] += 1
            if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.initial = role[:1]
            if turn is not None:
                self.turns += turn != self.last
                self.first, self.last = turn if self.first is None else self.first, turn

    def row(self) -> tuple:
        for _ in range(ENDING[self.state]):
            self.insert()
            self.audit.append("I")
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.conv, gaps, *self.counts.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


def _finished(grammar: Grammar):
    """Pieces, each conversation's in order -> a row per conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []

        def emit() -> pa.RecordBatch:
            kinds = (pa.string(), *[pa.int64()] * 6, pa.string(), pa.string())
            names = [x.split()[0] for x in _RESULT.split(", ")]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
            out.clear()
            return batch

        for batch in batches:
            compressed = grammar.compress(batch.column(4).to_pylist())
            for i, symbols in enumerate(compressed):
                conv, turns, roles, texts, letters, entry, ending = (batch.column(j)[i].as_py() for j in range(7))
                if now is None or now.conv != conv:
                    if now is not None:
                        out.append(now.row())
                    now = _Conversation(conv)
                now.add(turns, roles, texts, letters, grammar.chosen(symbols, entry, ending)[1])
            if len(out) >= 1000:
                yield emit()
        if now is not None:
            out.append(now.row())
        if out:
            yield emit()

    return run


def _of(many: DataFrame):
    """The conversations of more than one piece: at most two a partition besides very long ones; broadcast while they are few."""
    return F.broadcast(many) if many.count() <= BROADCAST_CONVERSATIONS else many


def repaired(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text -> a row per conversation: faults, least cost, audit and the hash of the repaired rows."""
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text").asc_nulls_first()]
    dealt = rows.repartitionByRange(*order[:3], F.left("text", F.lit(32)).asc_nulls_first()).sortWithinPartitions(*order)
    pieces = materialize(dealt.mapInArrow(_cut, _PIECE), "conversation-pieces")
    many = materialize(pieces.groupBy("conv").count().where("count > 1").select("conv"), "long-conversations")
    one = pieces.join(_of(many), "conv", "left_anti")
    ending = F.array(*[F.lit(INSERT * n).cast("long") for n in ENDING])
    columns = ["conv", "turns", "roles", "texts", "letters", "entry", "ending"]
    if many.isEmpty():
        grammar = learn(pieces)
        return pieces.withColumns({"entry": F.lit(START).cast("long"), "ending": ending}).select(*columns).mapInArrow(_finished(grammar), _RESULT)
    several = pieces.join(_of(many), "conv", "left_semi")
    digests = several.select("conv", "piece", "roles", "texts").mapInArrow(_digests, "conv string, piece long, k int, digest binary")
    firsts = digests.groupBy("conv", "digest").agg(F.min(F.struct("piece", "k")).alias("at"))  # many equal rows meet where they are read
    firsts = firsts.groupBy("conv", F.col("at.piece").alias("piece")).agg(F.collect_list("at.k").alias("firsts"))  # of one piece
    known = several.join(firsts, ["conv", "piece"], "left").select("conv", "piece", "roles", "texts", "firsts")
    lettered = materialize(known.mapInArrow(_relettered, "conv string, piece long, letters string"), "conversation-letters")
    grammar = learn(one.select("letters").unionByName(lettered.select("letters")))
    costs = lettered.mapInArrow(_costs(grammar), "conv string, piece long, costs array<long>")
    endings = costs.groupBy("conv").applyInArrow(_endings, "conv string, piece long, ending array<long>")
    reached = materialize(lettered.join(endings, ["conv", "piece"]).select("conv", "piece", "letters", "ending"), "conversation-endings")
    entries = reached.mapInArrow(_steps(grammar), "conv string, piece long, step array<long>").groupBy("conv").applyInArrow(_entries, "conv string, piece long, entry long")
    told = reached.join(entries, ["conv", "piece"])
    long = several.drop("letters").join(told, ["conv", "piece"]).repartition("conv").sortWithinPartitions("conv", "piece")
    short = one.withColumns({"entry": F.lit(START).cast("long"), "ending": ending}).select(*columns)
    return short.mapInArrow(_finished(grammar), _RESULT).unionByName(long.select(*columns).mapInArrow(_finished(grammar), _RESULT))


def conversation_id(conv: Column, kind) -> Column:
    return F.when(conv == "", None).otherwise(conv.cast(kind))
