"""The rules of ``text`` on Arrow batches: every form of a word is analysed once for all its occurrences.

The same tokens as ``text.tokens`` gives, which stays the form for single expressions. What is
known of forms is kept for a task, and forgotten once it holds ``FORMS`` of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from . import stopwords
from . import text as tx

FORMS, ROWS = 1 << 20, 2000
LANGUAGES = ("es", "en", "mixto", "indeterminado")
TOKENS = ArrayType(StructType().add("lemma", StringType()).add("form", StringType()).add("sentence", IntegerType()))
_SPACE = " \t\n\x0b\f\r"
_WORD = re.compile(r"\w[\w\-·']*")  # without _, \w is what \p{L} and \p{N} are
_END = re.compile(rf"([.!?…]+|\n{{2,}})([{_SPACE}]+|\Z)")
_SHORT = re.compile(rf"(?i)(?:^|[^A-Za-z0-9_])(?:{tx.ABBREVIATIONS})\Z".replace(r"\s", f"[{_SPACE}]"))
# a run of what may end sentences, between words and other signs
_ITEM = re.compile(rf"\w[\w\-·']*|[.!?…\n][.!?…{_SPACE}]*|[^\w.!?…{_SPACE}]+")
_INNER = re.compile(rf"([.!?…]+|\n{{2,}})[{_SPACE}]+")
# the last word of what may be an abbreviation
_LAST = re.compile(rf"(?i)(?:^|[^A-Za-z0-9_])(?:{tx.ABBREVIATIONS}|al|g|e)\Z")
_LONGEST = 9  # an abbreviation with the sign before it is shorter
_SAMPLE = re.compile("[a-zñ]{2,}")
_INVARIABLE = re.compile(tx.INVARIABLE)
_KEY = re.compile("[^a-z0-9ñ]")
_PLAIN, _PLAIN_N = str.maketrans(tx._ACCENTED, tx._PLAIN), str.maketrans(tx._ACCENTED_N, tx._PLAIN_N)
_SPANISH, _ENGLISH = frozenset(stopwords.SPANISH), frozenset(stopwords.ENGLISH)


def term_key(word: str) -> str:
    return _KEY.sub("", word.lower().translate(_PLAIN))


def language(text: str | None) -> int:
    """The place of a text's language in ``LANGUAGES``."""
    if text is None:
        return 3
    sample = text[:20_000].lower()
    words = _SAMPLE.findall(sample if sample.isascii() else sample.translate(_PLAIN_N))
    if len(words) < 20:
        return 3
    es, en = sum(map(_SPANISH.__contains__, words)), sum(map(_ENGLISH.__contains__, words))
    return 3 if es == 0 and en == 0 else 0 if es >= en * 1.3 else 1 if en >= es * 1.3 else 2


def sentences(text: str) -> list[str]:
    """As ``text.sentences``, with spaces around them and with another sign for each _, which no token holds."""
    out, start, plain = [], 0, text.replace("_", "\x1f")
    for m in _END.finditer(text):
        if m.group(1) == "." and m.end(2) > m.start(2) and _SHORT.search(text, max(0, m.start() - _LONGEST), m.start()):
            continue
        out.append(plain[start : m.end(1)])
        start = m.end()
    out.append(plain[start:])
    if "\x02" in text or "\x03" in text:
        out = [p for s in out for p in s.replace("\x03", "").split("\x02")]
    return [s for s in out if s and not s.isspace() or s.strip(_SPACE)]


def lemma_es(p: str) -> str:
    n = len(p)
    if _INVARIABLE.search(p):
        return p
    if n > 7:
        if p.endswith("mente"):
            return p[:-5]
        if p.endswith(("ciones", "idades")):
            return p[:-2]
    if n > 4:
        if p.endswith("ces"):
            return p[:-3] + "z"
        if p.endswith("es"):
            return p[:-2] if p[-3] in "lrndzjxy" else p[:-1]
        if p[-1] == "s" and p[-2] in "aeiou":
            return p[:-1]
    return p


def lemma_en(p: str) -> str:
    n = len(p)
    if _INVARIABLE.search(p):
        return p
    if n > 4:
        if p.endswith("ies"):
            return p[:-3] + "y"
        if p.endswith(("sses", "shes", "ches", "xes", "zes")):
            return p[:-2]
        if n > 5 and p.endswith("ing"):
            base = p[:-3]
            return base[:-1] if len(base) > 3 and base[-1] == base[-2] else base
        if p.endswith("ed") and not p.endswith("eed"):
            return p[:-2]
    return p[:-1] if n > 3 and p.endswith("s") and not p.endswith("ss") else p


def lemma_mixed(p: str) -> str:
    return p[:-1] if not _INVARIABLE.search(p) and len(p) > 4 and p[-1] == "s" and p[-2] in "aeiou" else p


class Forms(dict):
    """item -> its number. Items are words, ends of sentences with what follows them, and other signs.

    ``table`` has for each number: whether it is a word; by how much an end moves
    the sentence on, and by how much where nothing stands before it; whether a stop
    and a space begin it; whether a stop may shorten the word; how many words of the
    language's sample the form has, and how many are Spanish and English.
    """

    def __init__(self, stop: Iterable[str], minimum: int = tx.MIN_LENGTH):
        super().__init__()
        self.stop, self.minimum = frozenset(stop), minimum
        self.items: list[str] = []
        self.keys: list[str] = []
        self.new: list[tuple] = []
        self.table = np.zeros((0, 8), np.int32)
        self.lemmas: list[str] = []
        self.numbers: dict[str, int] = {}
        self.of = np.zeros((0, 3), np.int64)

    def __missing__(self, item: str) -> int:
        self[item] = n = len(self.items)
        self.items.append(item)
        if item.isascii() and item.isalnum():
            key, k = item.lower(), len(item)
            self.keys.append("" if k < self.minimum or key.isdigit() or key in self.stop else key)
            if key.isalpha():
                self.new.append((1, 0, 0, 0, k < 6 and _LAST.search(item) is not None, k > 1, k > 1 and key in _SPANISH, k > 1 and key in _ENGLISH))
            else:
                sample = _SAMPLE.findall(key)
                self.new.append((1, 0, 0, 0, 0, len(sample), sum(map(_SPANISH.__contains__, sample)), sum(map(_ENGLISH.__contains__, sample))))
        elif item[0].isalnum():
            key, sample = term_key(item), _SAMPLE.findall(item.lower().translate(_PLAIN_N))
            self.keys.append("" if len(key) < self.minimum or key.isdigit() or key in self.stop else key)
            self.new.append((1, 0, 0, 0, _LAST.search(item) is not None, len(sample), sum(map(_SPANISH.__contains__, sample)), sum(map(_ENGLISH.__contains__, sample))))
        else:
            self.keys.append("")
            self.new.append((0, _ends(item, True), _ends(item, False), item[0] == "." and item[1:2] in tuple(_SPACE), 0, 0, 0, 0))
        return n

    def grown(self) -> None:
        if self.new:
            self.table = np.concatenate([self.table, np.array(self.new, np.int32)])
            self.of = np.concatenate([self.of, np.full((len(self.new), 3), -2)])
            self.new = []

    def lemmas_of(self, form: np.ndarray, rule: np.ndarray) -> np.ndarray:
        """The numbers of lemmas by the rule of a language, or -1 where a form is no token."""
        found = self.of[form, rule]
        unknown = np.unique(form[found == -2] * 3 + rule[found == -2])
        for c in unknown.tolist():
            key = self.keys[c // 3]
            self.of[c // 3, c % 3] = self.number(_RULES[c % 3](key)) if key else -1
        return self.of[form, rule] if len(unknown) else found

    def number(self, lemma: str) -> int:
        if len(lemma) < self.minimum or lemma in self.stop:
            return -1
        n = self.numbers.get(lemma)
        if n is None:
            n = self.numbers[lemma] = len(self.lemmas)
            self.lemmas.append(lemma)
        return n


_RULES = (lemma_es, lemma_en, lemma_mixed)


def _ends(run: str, content: bool) -> int:
    """How many sentences end in a run of stops and spaces; content: whether anything stands before it."""
    n = start = 0
    for m in _INNER.finditer(run):
        n += content or run[start : m.end(1)].strip(_SPACE) != ""
        content, start = False, m.end()
    return n


class Tokens:
    """The tokens of some texts: language by text, and by token the text, lemma, form, sentence, and place in the text."""

    def __init__(self, texts: list[str | None], known: Forms):
        self.known = known
        ids: list[int] = []
        counts, look = np.zeros(len(texts), np.int64), known.__getitem__
        odd = set()
        for k, text in enumerate(texts):
            if text:
                before = len(ids)
                if "\x02" in text or "\x03" in text:
                    odd.add(k)
                    ids.extend(map(look, _by_sentence(text)))
                else:
                    ids.extend(map(look, _ITEM.findall(text.replace("_", "\x1f"))))
                counts[k] = len(ids) - before
        known.grown()
        item, of = np.array(ids, np.int64), np.repeat(np.arange(len(texts)), counts)
        at = np.cumsum(counts) - counts
        doubtful = (known.table[item[1:], 3] > 0) & (known.table[item[:-1], 4] > 0) & (of[1:] == of[:-1])
        again = set(of[1:][doubtful].tolist()) - odd
        if again:  # abbreviations
            new = {k: np.array([look(x) for x in _by_sentence(texts[k])], np.int64) for k in again}
            known.grown()
            item = np.concatenate([new[k] if k in new else item[a : a + c] for k, (a, c) in enumerate(zip(at, counts))])
            for k in again:
                counts[k] = len(new[k])
            of, at = np.repeat(np.arange(len(texts)), counts), np.cumsum(counts) - counts
        seen = known.table[item]
        self.language = self._languages(texts, seen, of, odd)
        step = seen[:, 1].astype(np.int64)
        first = at[counts > 0]
        step[first] = seen[first, 2]
        through = np.cumsum(step)
        sentence = through - np.repeat((through - step)[first], counts[counts > 0]) if len(item) else through
        word = seen[:, 0] > 0
        form, text, sentence = item[word], of[word], sentence[word]
        lemma = known.lemmas_of(form, np.minimum(self.language[text], 2).astype(np.int64))
        kept = lemma >= 0
        self.text, self.lemma, self.form, self.sentence = text[kept], lemma[kept], form[kept], sentence[kept].astype(np.int32)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(self.text, minlength=len(texts)))])
        self.place = np.arange(len(self.text)) - self.starts[self.text]

    @staticmethod
    def _languages(texts, seen, of, odd) -> np.ndarray:
        words, es, en = (np.bincount(of, seen[:, c], len(texts)) for c in (5, 6, 7))
        out = np.select([(words < 20) | ((es == 0) & (en == 0)), es >= en * 1.3, en >= es * 1.3], [3, 0, 1], 2).astype(np.int8)
        for k, text in enumerate(texts):
            if text is None or len(text) > 20_000 or k in odd:  # the sample is not the whole text
                out[k] = language(text)
        return out


def _by_sentence(text: str) -> list[str]:
    """The words of a text, with one end of a sentence between two sentences."""
    out = []
    for s in sentences(text):
        if out:
            out.append(". ")
        out += _WORD.findall(s) or ["\x1f"]
    return out


def parts(batches: Iterable[pa.RecordBatch], stop: Iterable[str]) -> Iterator[tuple[pa.RecordBatch, Tokens]]:
    """Batches with a column text, in parts of bounded size, with their tokens. Numbers hold for one part only."""
    known = Forms(stop)
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            if len(known) > FORMS:
                known = Forms(stop)
            yield part, Tokens(part.column("text").to_pylist(), known)


def _strings(values: list[str], numbers: np.ndarray) -> pa.Array:
    used, at = np.unique(numbers, return_inverse=True)
    return pa.array([values[i] for i in used.tolist()], pa.string()).take(pa.array(at.reshape(-1)))


def with_tokens(df: DataFrame, extra_stop: Iterable[str] = ()) -> DataFrame:
    """df (text and other columns) -> the other columns, detected, tokens. No shuffle."""
    stop, others = tx.stop_set(extra_stop), [c for c in df.columns if c != "text"]

    def tokens(batches):
        for part, t in parts(batches, stop):
            own = pa.StructArray.from_arrays([_strings(t.known.lemmas, t.lemma), _strings(t.known.items, t.form), pa.array(t.sentence, pa.int32())], ["lemma", "form", "sentence"])
            lists = pa.ListArray.from_arrays(pa.array(t.starts, pa.int32()), own)
            none = part.column("text").is_null()
            if none.true_count:
                lists = pc.if_else(none, pa.scalar(None, lists.type), lists)
            columns = [part.column(c) for c in others] + [_strings(list(LANGUAGES), t.language), lists]
            yield pa.RecordBatch.from_arrays(columns, [*others, "detected", "tokens"])

    schema = StructType([df.schema[c] for c in others]).add("detected", "string").add("tokens", TOKENS)
    return df.select(*others, "text").mapInArrow(tokens, schema)
