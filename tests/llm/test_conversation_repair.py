import hashlib
import heapq
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusgraph.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, conv string, piece long, letters string"


def cheapest(letters, roles):
    """All cheapest edit sequences by a search over (row, role initials so far), then the ASCII-least."""
    start, best, found = (0, "", 0), None, []
    heap = [(0, "", "", 0)]
    del start
    while heap:
        cost, audit, made, i = heapq.heappop(heap)
        if best is not None and cost > best:
            break
        if i == len(letters) and re.fullmatch("(s?(ua)+)?", made):
            best = cost
            found.append(audit)
        if not any(re.fullmatch("(s?(ua)+)?", made + x) for x in ("", "a", "ua")):
            continue
        if len(audit) < 3 * len(letters) + 3:
            for x in "ua":
                if not made.endswith("II"):
                    heapq.heappush(heap, (cost + 3, audit + "I", made + x, i))
        if i < len(letters):
            heapq.heappush(heap, (cost + 4, audit + "D", made, i + 1))
            if letters[i] not in "bd":
                more = 3 if letters[i].isupper() else 0
                heapq.heappush(heap, (cost + more, audit + "K", made + (roles[i][:1] or "?"), i + 1))
                for x in "ua":
                    heapq.heappush(heap, (cost + 3 + more, audit + "R", made + x, i + 1))
    return best, min(found)


def brute(rows):
    """Damage, faults and repair of conv_id, turn, role, text, row by row."""
    conversations = {}
    for conv, turn, role, text, *_ in rows:
        kept = conversations.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        kept += [] if kind == 0 else [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, kept in conversations.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, letters = set(), ""
        for _, role, text in kept:
            body = [c for c in text if c not in " \t\n\x0b\x0c\r"]
            letter = "b" if not body else "d" if (role, text) in seen else (role[:1] if role[:1] in ("s", "u", "a") else "x")
            letters += letter.upper() if letter in "suax" and body[-1] not in ".!?" else letter
            seen.add((role, text))
        roles = [r[1] for r in kept]
        cost, audit = cheapest(letters, roles)
        lines, made, i = [], "", 0
        for edit in audit:
            want = "assistant" if made.endswith("u") else "user"
            if edit == "I":
                lines.append(f"{want}:")
                made += want[0]
                continue
            _, role, text = kept[i]
            i += 1
            if edit != "D":
                role = want if edit == "R" else role
                lines.append(f"{role}:{text}")
                made += role[0]
        turns = [r[0] for r in kept if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
        out[conv] = (gaps, letters.count("b"), letters.count("d"), sum(c.isupper() for c in letters), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def run(df):
    found = cr.repaired(cr.damaged(df))
    return {None if r[0] == "" else int(r[0]): tuple(r)[1:] for r in found.collect()}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=cr.LETTERS, max_size=5))
def test_least_audit_equals_a_search(letters):
    roles = [{"s": "system", "u": "user", "a": "assistant"}.get(x.lower(), "tool") for x in letters]
    grammar = cr.Grammar()
    end, audit = grammar.chosen(letters, cr.START, [cr.INSERT * n for n in cr.ENDING])
    cost = grammar.best(letters, cr.START)[end][0] + cr.INSERT * cr.ENDING[end]
    assert (cost, audit + "I" * cr.ENDING[end]) == cheapest(letters, roles)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=cr.LETTERS, max_size=30), st.lists(st.tuples(st.integers(0, 99), st.integers(0, 99)), max_size=8))
def test_rules_change_nothing(letters, rules):
    plain, grammar = cr.Grammar(), cr.Grammar()
    for a, b in rules:
        symbols = sorted(grammar.matrices)
        grammar.add([symbols[a % len(symbols)] + symbols[b % len(symbols)]])
    for entry in range(4):
        a, b = plain.best(letters, entry), grammar.best(grammar.compress([letters])[0], entry)
        assert {k: (c, cr.text_of_rope(r)) for k, (c, r) in a.items()} == {k: (c, cr.text_of_rope(r)) for k, (c, r) in b.items()}


def odd():
    rows = []
    roles, texts = ["user", "assistant", "system", "", None, "tool", "User"], ["Fine.", "", None, " \n", "No end", "Why? ", "ünï.", "a\x00b!", "."]
    for conv in [*range(40), None]:
        for turn in range((conv or 3) % 6):
            x = (7 * (conv or 0) + 13 * turn) % 97
            rows.append((conv, None if x % 11 == 0 else turn * (1 + x % 2), roles[x % len(roles)] if x % 3 == 0 else ["user", "assistant"][turn % 2], texts[x % len(texts)]) + ("x", 1, "y"))
    return [*rows, rows[5], rows[5], (None, None, None, None, None, None, None), (60, 1, "user", "long " * 50_000, None, None, None)]


@pytest.mark.parametrize("parts", [1, 5])
def test_odd_rows(spark, parts):
    assert run(spark.createDataFrame(odd(), SCHEMA).repartition(parts)) == brute(odd())


def test_pieces_of_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(cr, "PIECE_ROWS", 7)
    rows = odd() + [(100, t, ["user", "assistant", "system"][t * t % 3], f"{t % 30} text{'.' if t % 4 else ''}", "", 0, "") for t in range(50)]
    spread = [(c, t, r, x) for c, t, r, x, *_ in rows]
    got = run(spark.createDataFrame(rows, SCHEMA))
    monkeypatch.undo()
    assert got == run(spark.createDataFrame(spread, "conv_id long, turn long, role string, text string"))
    small = {k: v for k, v in brute([r for r in rows if r[0] != 100]).items()}
    assert {k: v for k, v in got.items() if k != 100} == small


def test_dropped_and_empty(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "x.")], "conv_id long, turn long, role string, text string")
    assert run(df) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert run(df.where("false")) == {}


def test_the_query_equals_brute_force(spark, sf_dir):
    from corpusgraph.llm.queries import op12_grammar_repair
    from corpusgraph.llm.common import table

    rows = [tuple(r) for r in table(spark, sf_dir, "conversations").where(F.col("conv_id") >= 0).collect()]
    assert {r[0]: tuple(r)[1:] for r in op12_grammar_repair(spark, sf_dir).collect()} == brute(rows)


def test_grammar_is_shared(spark):
    letters = spark.createDataFrame([("ua" * n,) for n in range(1, 40)], "letters string")
    grammar = cr.learn(letters)
    assert grammar.pairs[0] == "ua" and len(grammar.compress(["ua" * 32])[0]) <= 4
