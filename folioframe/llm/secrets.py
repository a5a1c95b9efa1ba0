"""Secrets in text: fixed patterns, and values that a guessing attack would not reach.

Values in a credential context (a keyword, a separator, a value) are priced by
the cheapest way to guess them: dynamic programming over segmentations into
dictionary words, dates, repeats, keyboard walks and brute-force spans. A value
whose cheapest guess still costs more than a threshold is a secret; a
placeholder such as ``password1`` or ``changeme`` is not.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm.base import arrow_map

# The base patterns, run over UTF-8 bytes with A-Z lower-cased (assign, by keyword) or as they are.
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN = re.compile(rb"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
ASSIGN_LEAST = 6
BASE_KINDS = ("assign", "access", "hex")
GUESS = "guess"

#: Words before a separator that make the value behind it a credential.
CONTEXT_WORDS = (b"pass", b"pwd", b"secret", b"token", b"key", b"credential", b"auth")
CONTEXT = re.compile(
    rb"(?i)(?:pass(?:word|wd|phrase|code)?|pwd|(?:client_?|shared_?)?secret|(?:access_?|auth_?|refresh_?)?token|"
    rb"(?:api|access|private|secret|encryption)[_-]?key|credentials?|authorization)"
    rb"[\"']?[\x20\t]*(?::=|=>|[:=])[\x20\t]*"
    rb"(?:\"(?:bearer\x20+)?([^\"\r\n]+)\"|'(?:bearer\x20+)?([^'\r\n]+)'|[\"']?(?:bearer\x20+)?([^\s\"'<>]+))")  # in quotes that close on the line, or one word

# Common words of passwords, by falling frequency.
COMMON = (
    "password 123456 qwerty letmein admin welcome monkey dragon master login abc princess football sunshine shadow iloveyou "
    "trustno test guest root user changeme secret default example pass pw key token apikey api private public access hello "
    "freedom whatever baseball superman batman michael jordan summer winter spring autumn charlie daniel jessica ashley love "
    "money hunter soccer killer pepper ginger cookie flower orange banana apple silver golden purple yellow green black white "
    "server system manager temp demo sample dummy none null true false your my the and for with this that from here enter "
    "insert value string placeholder redacted xxxx"
).split()
RANK = {word: rank for rank, word in enumerate(COMMON, 1)}
LONGEST_WORD = max(map(len, COMMON))
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
# Usual replacements of letters.
LEET = str.maketrans("@4301$5!7", "aaeoissit")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01]))?|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)?\d\d")
#: Costs are exact below this; a value that costs more is reported with it.
MOST_COST = 40.0
#: Places back from which a word, a unit or a date may start.
WINDOW = max(LONGEST_WORD, 10)


@lru_cache(maxsize=1)
def _adjacent() -> frozenset[tuple[str, str]]:
    """Ordered pairs of neighbouring keys: along a row, or on the diagonals to the next row."""
    pairs = set()
    for y, row in enumerate(ROWS):
        for x, key in enumerate(row):
            for other in [row[x + 1:x + 2], *([ROWS[y + 1][max(x - 1, 0):x + 1]] if y + 1 < len(ROWS) else [])]:
                pairs |= {p for k in other for p in ((key, k), (k, key))}
    return frozenset(pairs)


def _brute(char: str) -> float:
    """log10 of the alphabet a character is guessed from."""
    if char.isdigit():
        return 1.0
    if char.isascii() and char.isalpha():
        return math.log10(26)
    return math.log10(33) if char.isascii() else 2.0


class _Open:
    """Starts of a repeat or walk of three or more characters that goes on, whatever its length.

    It costs ``best[start] + log10(length)``. Of two starts the earlier one, once
    no dearer, stays so, for the logarithm grows slower for it; the later one is
    then forgotten, so few starts are kept and none that could still be best.
    """

    def __init__(self, best: list[float]):
        self.best, self.starts = best, []

    def cheapest(self, end: int, length: int) -> float:
        """The cheapest start, when the last ``length`` characters belong together."""
        if length < 3:
            self.starts.clear()
            return math.inf
        kept, lowest = [], math.inf
        for start in [*self.starts, end - 3]:
            cost = self.best[start] + math.log10(end - start)
            if cost < lowest:
                lowest = cost
                kept.append(start)
        self.starts = kept
        return lowest

    def least(self) -> float:
        return min((self.best[s] for s in self.starts), default=math.inf)


def guess_cost(value: str, enough: float = math.inf) -> float:
    """log10 of the guesses that the cheapest segmentation needs; an empty value costs 0.

    Costs are not negative, so once every prefix that a later segment could
    start from costs ``enough``, the value does too and the walk stops there.
    A further segment doubles the guesses.
    """
    n = len(value)
    lower = value.lower() if len(value.lower()) == n else value
    plain = lower.translate(LEET)
    adjacent = _adjacent()
    best = [0.0] + [math.inf] * n
    dates: dict[int, list[int]] = {}
    for start in range(n):
        if lower[start].isdigit():
            dates[start] = [e for e in range(start + 4, min(n, start + 10) + 1) if DATE.fullmatch(lower, start, e)]
    run = 1  # characters of the keyboard walk or repeat that end before this place
    repeat = 1
    start_of_brute = [0.0] * (n + 1)  # brute force goes on without a new segment
    more = math.log10(2)
    open_brute = math.inf
    walks, repeats = _Open(best), _Open(best)
    for i in range(n):
        # brute force up to and with character i
        open_brute = min(open_brute, best[i] + more) + _brute(value[i])
        candidates = [open_brute]
        end = i + 1
        if i:
            run = run + 1 if (lower[i - 1], lower[i]) in adjacent else 1
            repeat = repeat + 1 if lower[i] == lower[i - 1] else 1
        candidates.append(walks.cheapest(end, run) + more + math.log10(47 * 4))
        candidates.append(repeats.cheapest(end, repeat) + more + _brute(value[i]))
        for length in range(2, min(LONGEST_WORD, end) + 1):
            begin = end - length
            rank = RANK.get(plain[begin:end]) or RANK.get(lower[begin:end])
            if rank:
                changed = sum(a != b for a, b in zip(value[begin:end], plain[begin:end]))
                candidates.append(best[begin] + more + math.log10(rank + 1) + 0.3 * changed)
            # a unit that occurred just before, again
            if 2 * length <= end and lower[begin:end] == lower[begin - length:begin]:
                candidates.append(best[begin] + math.log10(2 + length))
        for begin in range(max(0, end - 10), end - 3):
            if end in dates.get(begin, ()):
                candidates.append(best[begin] + more + math.log10(365 * 120 if end - begin > 4 else 120))
        best[end] = min(candidates)
        if end >= WINDOW and min(min(best[end - WINDOW:end + 1]), open_brute, walks.least(), repeats.least()) >= enough:
            return enough
    return best[n]


def find_secrets(text: str, least_cost: float = 10.0) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, float]]]:
    """Base spans, and guessed spans with their cost; (kind, start, end) in code points, end exclusive.

    Guessed spans are credential values of at least eight characters whose
    cheapest guess costs ``10 ** least_cost`` or more.
    """
    data = text.encode()
    low = data.lower()
    found = []
    if any(k in low for k in KEYWORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(data) if len(m[2]) >= ASSIGN_LEAST]
    if b"AKIA" in data:
        found += [("access", *m.span()) for m in ACCESS.finditer(data)]
    found += [("hex", *m.span()) for m in HEX.finditer(data)]
    values = []
    if any(k in low for k in CONTEXT_WORDS):
        for m in CONTEXT.finditer(data):
            value = m[m.lastindex].decode(errors="replace")
            if m.lastindex == 3:
                value = value.rstrip(".,;:)]}")
            if len(value) >= 8 and (cost := guess_cost(value, MOST_COST)) >= least_cost:
                start = m.start(m.lastindex)
                values.append((GUESS, start, start + len(value.encode()), cost))
    if len(data) != len(text) and (found or values):  # bytes to code points
        places = sorted({x for f in (*found, *values) for x in f[1:3]})
        at, chars, point = 0, 0, {}
        for place in places:
            chars += len(data[at:place].decode(errors="replace"))
            point[place], at = chars, place
        found = [(k, point[a], point[b]) for k, a, b in found]
        values = [(k, point[a], point[b], c) for k, a, b, c in values]
    order = {k: i for i, k in enumerate((*BASE_KINDS, GUESS))}
    return sorted(found, key=lambda f: (f[1], order[f[0]])), sorted(values, key=lambda f: f[1])


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_cost: float = 10.0) -> DataFrame:
    """One row per document: id, spans as ``array<struct<kind,start,end,cost>>`` (cost null for base spans).

    A cost of ``MOST_COST`` is a lower bound: pricing stops there.
    Null and empty texts have no spans; a null id stays null; rows that repeat
    stay; texts are scanned whole whatever their length.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("cost", pa.float64())])

    def work(batch: pa.RecordBatch):
        order = {k: i for i, k in enumerate((*BASE_KINDS, GUESS))}
        out = []
        for text in batch.column(1).to_pylist():
            base, values = find_secrets(text, least_cost) if text else ([], [])
            rows = [{"kind": k, "start": a, "end": b, "cost": None} for k, a, b in base]
            rows += [{"kind": k, "start": a, "end": b, "cost": c} for k, a, b, c in values]
            out.append(sorted(rows, key=lambda r: (r["start"], order[r["kind"]])))
        yield {"id": batch.column(0), "spans": out}

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(source, work, "id long, spans array<struct<kind:string,start:int,end:int,cost:double>>",
                     pa.schema([("id", pa.int64()), ("spans", pa.list_(span))]))


def secret_digest(found: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans and all spans as text."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != GUESS)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"), count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), count(GUESS).alias("n_guess"),
        F.array_max(F.transform("spans", lambda s: s["cost"])).alias("highest_cost"))
