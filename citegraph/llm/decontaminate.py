"""Benchmark decontamination by template canonicalisation.

Texts become sequences of template tokens: numbers (with their separators), names
(runs of capitalised words) and units turn into typed placeholders, other words are
lower-cased and stripped of punctuation.  Windows of template tokens are hash-joined
with those of the benchmark; a hit counts if its slots are consistent, that is, if
the values on the two sides correspond one to one, so a re-parameterised copy is
caught and a chance meeting of placeholders is not.  A capitalised word that opens a
sentence may be a name or not, so every text has two templates.  Windows that are
short or mostly placeholders say too little as templates; they, like all others, are
also joined by their words, which must be equal.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.llm import words as W
from citegraph.llm.shared import by_value, small_batches

by_value(__name__)

WINDOW, MIN_WINDOW = 10, 5
#: Windows of the benchmark that go to every task at once, some 100 bytes each.
MAX_WINDOWS = 300_000
#: A window needs at least this share of plain words, and MIN_WINDOW tokens, to be matched as a template.
PLAIN = 0.5
NUM, NAME, UNIT = b"\x01", b"\x02", b"\x03"
UNITS = frozenset(b"mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces pound pounds lb lbs ton tons ml l liter liters litre litres gallon gallons second seconds sec minute minutes min hour hours day days week weeks month months year years cent cents dollar dollars euro euros percent degree degrees mph kmh watt watts volt volts byte bytes kb mb gb".split())

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ENDS = np.zeros(256, bool)
_ENDS[[10, 13, 33, 46, 58, 63]] = True
_SEPARATORS = np.frombuffer(b".,", np.uint8)
_KNOWN: dict[str, np.ndarray] = {}
_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def _constant(word: bytes) -> np.uint64:
    data = np.frombuffer(word, np.uint8)
    return W.word_hashes(data, np.array([0]), np.array([len(data)]))[0]


def _tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, the first of each text, and which are numbers, begin with a capital, and open a sentence."""
    starts, ends, first = W.spans(data, at, _WORD)
    lead = data[starts]
    number, capital = (lead >= 48) & (lead <= 57), (lead >= 65) & (lead <= 90)
    stops = np.cumsum(_ENDS[data], dtype=np.int32)
    opens = np.ones(len(starts), bool)
    if len(starts):
        opens[1:] = stops[starts[1:]] != stops[ends[:-1] - 1]
        opens[first[:-1][first[:-1] < len(starts)]] = True
    # A separator within a number ends no sentence.
    if len(starts) > 1:
        joined = number[1:] & number[:-1] & (starts[1:] - ends[:-1] == 1) & np.isin(data[np.minimum(ends[:-1], len(data) - 1)], _SEPARATORS)
        joined[first[1:-1][(first[1:-1] > 0) & (first[1:-1] < len(starts))] - 1] = False
        opens[1:] &= ~joined
    return starts, ends, first, number, capital, opens


def template_hashes(data: np.ndarray, at: np.ndarray, opening: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(template token hashes, first token of each text, word hashes, first word of each text).

    A word is a run of ASCII letters, digits and non-ASCII bytes.  Words that
    begin with a digit, joined by "." or ",", are a number; a known unit right after
    a number is a unit; words that begin with a capital, with one blank between, are
    a name unless they open a sentence (`opening`: even then); any other is a token as it is.
    """
    starts, ends, first, number, capital, opens = _tokens(data, at)
    words = W.word_hashes(_LOWER[data], starts, ends)
    if not len(starts):
        return words, first, words, first
    name = capital if opening else capital & ~opens
    apart = starts[1:] - ends[:-1] == 1
    between = data[np.minimum(ends[:-1], len(data) - 1)]
    goes_on = np.zeros(len(starts), bool)
    goes_on[1:] = apart & ~opens[1:] & ((number[1:] & number[:-1] & np.isin(between, _SEPARATORS)) | (name[1:] & name[:-1] & (between == 32)))
    keep = np.flatnonzero(~goes_on)
    before = np.append(0, np.cumsum(~goes_on))
    hashes, number, name, opens = words[keep], number[keep], name[keep], opens[keep]
    unit = np.zeros(len(keep), bool)
    after = np.flatnonzero(number[:-1]) + 1
    unit[after] = np.isin(hashes[after], _unit_hashes()) & ~opens[after]
    hashes[number], hashes[name], hashes[unit] = _constant(NUM), _constant(NAME), _constant(UNIT)
    return hashes, before[first], words, first


def _unit_hashes() -> np.ndarray:
    if "units" not in _KNOWN:
        _KNOWN["units"] = np.array([_constant(u) for u in sorted(UNITS)], np.uint64)
    return _KNOWN["units"]


def template(text: bytes, opening: bool = False) -> tuple[list[bytes], list[bytes]]:
    """The same template of one text as (tokens, values), where a plain word's value is empty."""
    tokens, values, end = [], [], 0
    for m in _TOKEN.finditer(text):
        word, gap, capital = m[0], text[end : m.start()], 65 <= m[0][0] <= 90
        number, end = 48 <= word[0] <= 57, m.end()
        part = bool(tokens) and number and tokens[-1] == NUM and gap in (b".", b",")
        opens = not part and (not tokens or any(c in b"\n\r!.:?" for c in gap))
        low = word.lower()
        if part or (tokens and tokens[-1] == NAME and capital and gap == b" "):
            values[-1] += gap + low
            continue
        if number:
            tokens.append(NUM)
        elif tokens and tokens[-1] == NUM and not opens and low in UNITS:
            tokens.append(UNIT)
        elif capital and (opening or not opens):
            tokens.append(NAME)
        else:
            tokens.append(low)
            low = b""
        values.append(low)
    return tokens, values


def consistent(left: list[bytes], right: list[bytes]) -> bool:
    """Whether equal slot values on one side stand for equal ones on the other."""
    pairs = {(a, b) for a, b in zip(left, right, strict=True) if a or b}
    return len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs})


def _windows(tokens: list[bytes], window: int) -> list[tuple[int, int, bool]]:
    """(begin, length, whether it can be matched as a template) of every window; a text of fewer tokens is one window."""
    n = min(window, len(tokens))
    return [(i, n, n >= MIN_WINDOW and sum(t not in (NUM, NAME, UNIT) for t in tokens[i : i + n]) >= PLAIN * n) for i in range(len(tokens) - n + 1) if n]


def plain(text: bytes) -> list[bytes]:
    """The words of a text, lower-case."""
    return [m[0].lower() for m in _TOKEN.finditer(text)]


class _Side:
    """Windows of the benchmark in one form: by length, their sorted hashes, and which item and token each begins at."""

    def __init__(self, items: list[list[bytes]], window: int, templates: bool):
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for nth, tokens in enumerate(items):
            begins = np.array([i for i, _, strong in _windows(tokens, window) if strong or not templates], np.int64)
            if len(begins):
                n = min(window, len(tokens))
                hashes = W.run_hashes(np.array([_constant(t) for t in tokens], np.uint64), n)[begins]
                found.setdefault(n, []).append((hashes, np.full(len(begins), nth), begins))
        self.by_length = {}
        for n, parts in found.items():
            hashes, item, begin = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(hashes, kind="stable")
            seen = np.zeros(1 << 18, bool)
            seen[hashes >> np.uint64(46)] = True
            self.by_length[n] = (hashes[order], item[order], begin[order], seen)

    def hits(self, n: int, runs: np.ndarray) -> np.ndarray:
        """Of `runs`, the indexes of those whose hash the benchmark has."""
        if n not in self.by_length or not len(runs):
            return np.empty(0, np.int64)
        hashes, *_, seen = self.by_length[n]
        some = np.flatnonzero(seen[runs >> np.uint64(46)])
        spot = np.minimum(np.searchsorted(hashes, runs[some]), len(hashes) - 1)
        return some[hashes[spot] == runs[some]]

    def places(self, n: int, run: np.uint64) -> list[tuple[int, int]]:
        hashes, item, begin, _ = self.by_length[n]
        a, b = np.searchsorted(hashes, run, "left"), np.searchsorted(hashes, run, "right")
        return list(zip(item[a:b].tolist(), begin[a:b].tolist(), strict=True))


class Matcher:
    """Finds, for pieces of text, the benchmark items that share a consistent window with each."""

    def __init__(self, items: list[tuple[int, bytes]], window: int):
        self.ids = [i for i, _ in items]
        self.forms = [[template(text, opening) for _, text in items] for opening in (False, True)]
        self.words = [plain(text) for _, text in items]
        self.sides = [_Side([tokens for tokens, _ in form], window, True) for form in self.forms]
        self.verbatim = _Side(self.words, window, False)

    def find(self, data: np.ndarray, at: np.ndarray) -> dict[int, dict[int, list[set]]]:
        """text -> item -> places of the windows that match as templates in either form, and of those equal in words."""
        out: dict[int, dict[int, list[set]]] = {}
        parsed: dict[tuple, object] = {}

        def of(i: int, how, *given):
            if (i, how, *given) not in parsed:
                parsed[i, how, *given] = how(data[at[i] : at[i + 1]].tobytes(), *given)
            return parsed[i, how, *given]

        def look(kind: int, side: _Side, hashes: np.ndarray, first: np.ndarray, equal) -> None:
            for n in side.by_length:
                begin, text = W.runs_within(first, n)
                if len(begin):
                    runs = W.run_hashes(hashes, n)[begin]
                    for h in side.hits(n, runs).tolist():
                        i, j = int(text[h]), int(begin[h] - first[text[h]])
                        for nth, b in side.places(n, runs[h]):
                            if equal(i, j, nth, b, n):
                                out.setdefault(i, {}).setdefault(self.ids[nth], [set(), set(), set()])[kind].add((n, j))

        def same(i: int, j: int, nth: int, b: int, n: int) -> bool:
            return of(i, plain)[j : j + n] == self.words[nth][b : b + n]

        for opening in (False, True):
            hashes, first, words, first_word = template_hashes(data, at, opening)

            def alike(i: int, j: int, nth: int, b: int, n: int, opening=opening) -> bool:
                (tokens, values), (theirs, slots) = of(i, template, opening), self.forms[opening][nth]
                return tokens[j : j + n] == theirs[b : b + n] and consistent(slots[b : b + n], values[j : j + n])

            look(int(opening), self.sides[opening], hashes, first, alike)
            if not opening:
                look(2, self.verbatim, words, first_word, same)
        return out


def _match(items: list[tuple[int, bytes]], window: int):
    """Rows (doc_id, item_id, n_windows, n_exact) of texts (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items, window)
        for batch in batches:
            for lo, _, data, at in W.chunks(batch.column(1)):
                rows, found, counts, exact = [], [], [], []
                for i, by_item in sorted(matcher.find(data, at).items()):
                    for item, (alike, opening, same) in sorted(by_item.items()):
                        rows.append(lo + i)
                        found.append(item)
                        counts.append(max(len(alike) or len(opening), len(same)))
                        exact.append(len(same))
                out = [pa.array(v, pa.int64()) for v in (found, counts, exact)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *out], ["doc_id", "item_id", "n_windows", "n_exact"])

    return run


def _drop(items: list[tuple[int, bytes]], window: int):
    """The rows (..., text) whose text, the last column, matches nothing; without that column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items, window)
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for lo, _, data, at in W.chunks(batch.column(batch.num_columns - 1)):
                clean[[lo + i for i in matcher.find(data, at)]] = False
            yield batch.select(range(batch.num_columns - 1)).filter(pa.array(clean))

    return run


def _parts(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """The items in parts of about MAX_WINDOWS words at most; all texts of an item_id are in one part."""
    items = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    total = items.agg(F.sum(F.size(F.split("text", r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+")))).first()[0] or 0
    parts = max(1, -(-total // MAX_WINDOWS))
    for p in range(parts):
        yield sorted((r.item_id, r.text.encode()) for r in items.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == p).collect())


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, n_windows, n_exact): the pairs of a row of `docs` (doc_id, text) and an item of `benchmark` (item_id, text) that share a window of template tokens with consistent slots, or a window of equal words.

    n_exact counts the document's windows of words that are the item's but for case,
    n_windows those of tokens that match as templates, each once however often the
    item has it, or n_exact if that is more; where no window matches, those count
    that do if words that open a sentence are names.  An item of fewer than `window` tokens is one window; under
    MIN_WINDOW tokens, or with more placeholders than plain words, a window matches
    only equal words.  The benchmark goes to every task in parts of MAX_WINDOWS words,
    one pass over `docs` each.
    Null and empty texts, on either side, match nothing; items without an id are
    ignored; repeated rows are reported each; an empty table gives an empty one.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = None
    for part in _parts(benchmark):
        found = small_batches(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_match(part, window), f"doc_id {kind}, item_id long, n_windows long, n_exact long")
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of `docs`, with all their columns whatever their names, whose text matches no item: each row is judged by its own text, whatever its doc_id, in the pass that compares it, so nothing is shuffled."""
    out = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema.fields)
    text = F.coalesce(F.col(f"c{docs.columns.index('text')}"), F.lit("")).alias("text")
    for part in _parts(benchmark):
        out = small_batches(out).select("*", text).mapInArrow(_drop(part, window), schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
