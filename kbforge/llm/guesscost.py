"""Secret scan with a password guess-cost check (operator 5).

Base kinds, each leftmost and non-overlapping, matches that are too short dropped:
``assign`` (a credential name, a separator and a value of 6 or more characters; the
span is the whole match), ``access`` (AKIA..., 20 or more characters) and ``hex``
(24 or more lower-case hex digits).

Kind ``guess`` adds the values of a wider set of credential contexts (other names,
``is``, quoted values with any characters, bearer tokens) that are hard to guess:
the cheapest segmentation of the value into common words (with case and digit
look-alikes), dates, repeats, keyboard walks and brute-force characters, found by
dynamic programming, must cost at least ``MIN_BITS`` bits.  Words are a fixed list and
the ``TOP_WORDS`` words that most documents of the table have, a word costing the more
the rarer it is; walks go to any neighbouring key, each turn at a cost.  A brute-force character
costs the alphabet of all kinds of characters in the value; separators cost that of
marks at most, and letters of a value made of what looks like words cost ``WORD_LETTER_BITS``.
Placeholders, plain words and pass phrases of common words stay below.
The work is linear in the length of a value, whatever the length.

Spans are code points, end exclusive.  Null text is the empty text; no span gives
an empty ``spans`` and the SHA-256 of the empty string.  Repeated rows are scanned
separately, null ids are kept.  An empty table gives an empty result.  Other
columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbforge.llm.common import id_and_text, map_batches, save

KINDS = ("assign", "access", "hex", "guess")
MIN_BITS = 41.0              # nine in ten random values of 8 letters and digits are above, the tested placeholders below

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
                     re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")          # a shorter run is dropped
_HEX = re.compile(r"[0-9a-f]{24,}")                 # likewise
# Names that announce a credential.  The expression and the gate before it are made from the same.
_NAMES = ("password", "passwd", "passphrase", "passcode", "pwd", "secret", "token",
          *(f"{kind}{mark}key" for kind in ("api", "access", "private") for mark in ("", " ", "_", "-")), "credential")
CONTEXT_NAMES = (*_NAMES, "bearer")
_CONTEXT = re.compile(r"(?:" + "|".join(map(re.escape, _NAMES)) + r")s?"
                      r"[\"'\]]{0,2}[ \t]{0,3}(?::=|=>|[:=]|is[ \t])[ \t]{0,3}(?:\"([^\"\n]+)\"|'([^'\n]+)'|([^\s\"'`,;]+))"
                      r"|bearer[ \t]+([^\s\"'`,;]+)", re.IGNORECASE | re.ASCII)

# Frequent words of passwords and placeholders, most frequent first.
COMMON_WORDS = (
    "password passwd pass secret token admin root user login welcome letmein qwerty monkey dragon master shadow "
    "sunshine princess football baseball superman batman trustno starwars hello freedom whatever love iloveyou "
    "changeme change default example test testing demo sample guest temp temporary placeholder dummy none null "
    "undefined unknown your my the key api access private public client server database local localhost host here "
    "insert replace enter value string text name email account system service summer winter spring autumn january "
    "february march april june july august september october november december monday tuesday wednesday thursday "
    "friday saturday sunday home work office company money secure security strong weak random really not must should "
    "please this that with from have will what correct horse battery staple butterfly chocolate barcelona manchester "
    "liverpool arsenal chelsea computer internet michael jessica jennifer ashley daniel thomas charlie andrew matthew "
    "jordan robert william samantha nicole hannah maggie ginger pepper cookie banana orange purple silver diamond angel "
    "flower tiger eagle falcon phoenix hunter killer soccer hockey tennis guitar music lovely sweet happy lucky magic "
    "genius forever friend family mother father brother sister school london paris america spider rainbow dolphin").split()
# Keys of the usual keyboard with the place of each row's first key, and the alphabet.
KEY_ROWS = (("`1234567890-=", -1.0), ("qwertyuiop[]", 0.5), ("asdfghjkl;'", 0.75), ("zxcvbnm,./", 1.25))
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
LOOK_ALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})

TOP_WORDS = 20_000
LONGEST = 20                 # letters of a word at most
_RANK = {w: k + 1 for k, w in enumerate(COMMON_WORDS)}
_CORPUS_WORD = re.compile(rf"(?<![A-Za-z])[A-Za-z]{{4,{LONGEST}}}(?![A-Za-z])")
_DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])"
                   r"|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d", re.ASCII)
_YEAR = re.compile(r"(?:19|20)\d\d", re.ASCII)
_DATE_BITS = math.log2(366 * 120 * 4)
_YEAR_BITS = math.log2(120)
SEPARATORS = frozenset("-_./: ")
WORD_LETTER_BITS = 2.7       # a letter of a word that COMMON_WORDS lacks
_CLUSTER = re.compile(r"[^aeiouy]{6,}|[aeiouy]{5,}")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_SPLIT_BITS = 1.0            # for the choice of where a segment ends
MAX_PERIOD = 8
MAX_WALK = 32
MAX_TIMES = 16               # shorter repeats than the longest are tried up to this often


def _steps() -> dict[str, tuple]:
    """Direction of every step to a neighbouring key, and along the alphabet, by the two characters."""
    at = {c: (first + x, y) for y, (row, first) in enumerate(KEY_ROWS) for x, c in enumerate(row)}
    out = {a + b: ((bx > ax) - (bx < ax), by - ay) for a, (ax, ay) in at.items() for b, (bx, by) in at.items()
           if a != b and abs(bx - ax) <= 1 and abs(by - ay) <= 1}
    for a, b in zip(ALPHABET, ALPHABET[1:]):
        out.setdefault(a + b, "on")
        out.setdefault(b + a, "back")
    return out


_STEPS = _steps()
_TURN_BITS = math.log2(6)    # to one of the other neighbours of a key


def char_bits(c: str) -> float:
    """Brute force of one character, by its kind."""
    if c.isdigit():
        return math.log2(10)
    if c.isalpha():
        return math.log2(26) if c.isascii() else math.log2(120)
    return math.log2(33)


def word_shaped(word: str) -> bool:
    """ASCII letters with vowels and rare consonants as words have them."""
    low = word.lower()
    return (0.2 <= sum(c in "aeiouy" for c in low) / len(low) <= 0.7 and not _CLUSTER.search(low)
            and sum(c in "jqxz" for c in low) <= max(1, len(low) // 8))


def made_of_words(value: str) -> bool:
    """Letters and marks whose letters are words, at most one of them of less than three letters.

    Letters without a Latin base letter count as words.
    """
    if any(c.isdigit() for c in value):
        return False
    base = "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c))
    words = _WORDS.findall(base)
    short = sum(len(w) < 3 for w in words)
    return any(map(str.isalpha, value)) and short <= 1 and all(len(w) < 3 or word_shaped(w) for w in words)


def brute_bits(value: str) -> list[float]:
    """Brute force of every character of ``value``, by the kinds of characters that it has."""
    size = 0
    for some, n in ((str.isdigit, 10), (lambda c: c.isascii() and c.islower(), 26), (lambda c: c.isascii() and c.isupper(), 26),
                    (lambda c: c.isalpha() and not c.isascii(), 120), (lambda c: not c.isalnum(), 33)):
        size += n * any(map(some, value))
    each, mark, words = math.log2(size or 1), math.log2(33), made_of_words(value)
    out, seen = [], set()
    for c in value:
        if c.isalnum():
            out.append(WORD_LETTER_BITS if words else each)
        else:                                        # a separator costs as a mark, and little when it comes again
            out.append(1.0 if c in seen else mark if words or c in SEPARATORS else each)
            seen |= {c} & SEPARATORS
    return out


def segments(value: str, per_char: list[float], ranks: dict[str, int]) -> Iterator[list[tuple[int, float]]]:
    """One after the other, for each place of ``value`` the segments that begin there, as (end, bits)."""
    n, low = len(value), value.lower()
    if len(low) != n:
        low = value
    plain = low.translate(LOOK_ALIKES)
    step = [_STEPS.get(low[i:i + 2]) for i in range(n)]
    # same[p][i]: how many characters from i on are equal to the one p later
    same = []
    for p in range(1, MAX_PERIOD + 1):
        run = [0] * (n + 1)
        for i in range(n - p - 1, -1, -1):
            if value[i] == value[i + p]:
                run[i] = run[i + 1] + 1
        same.append(run)
    for i in range(n):
        found = [(i + 1, per_char[i])]
        for j in range(i + 3, min(n, i + LONGEST) + 1):
            rank, extra = ranks.get(low[i:j]), 0.0
            if rank is None:
                rank, extra = ranks.get(plain[i:j]), 2.0
            if rank is not None:
                upper = sum(c.isupper() for c in value[i:j])
                case = 0.0 if not upper else 1.0 if upper in (1, j - i) else min(upper, j - i - upper) + 1.0
                found.append((j, math.log2(rank + 1) + extra + case + _SPLIT_BITS))
        if low[i] in "0123":
            for pattern, bits in ((_DATE, _DATE_BITS), (_YEAR, _YEAR_BITS)):
                if m := pattern.match(low, i):
                    found.append((m.end(), bits + _SPLIT_BITS))
        turns, steps = 0, 0
        while i + steps < n and steps < MAX_WALK and step[i + steps] is not None:
            turns += steps > 0 and step[i + steps] != step[i + steps - 1]
            steps += 1
            if steps >= (2 if not turns else 3):             # three keys in a line, or four
                found.append((i + steps + 1, math.log2(47) + math.log2(steps + 1) + turns * _TURN_BITS + _SPLIT_BITS))
        for p in range(1, MAX_PERIOD + 1):
            most = same[p - 1][i] // p + 1
            if most >= 2:
                block = sum(per_char[i:i + p]) + _SPLIT_BITS
                found += [(i + p * times, block + math.log2(times)) for times in (*range(2, min(most, MAX_TIMES) + 1), most)]
        yield found


def guess_bits(value: str, per_char: list[float] | None = None, ranks: dict[str, int] | None = None) -> float:
    """Bits of the cheapest segmentation of ``value``; a character costs ``per_char``, or else its own kind's alphabet."""
    if per_char is None:
        per_char = [char_bits(c) + (1.0 if c.isupper() else 0.0) for c in value]
    cost = [0.0] + [math.inf] * len(value)
    for i, found in enumerate(segments(value, per_char, _RANK if ranks is None else ranks)):
        for j, bits in found:
            cost[j] = min(cost[j], cost[i] + bits)
    return cost[-1]


def common_words(docs: DataFrame, top: int = TOP_WORDS) -> dict[str, int]:
    """Rank of the fixed words and, after them, of the ``top`` words that most documents have (ties by the word).

    At most ``top`` words come to the driver and are sent to the tasks.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count: Counter = Counter()
            for text in batch.column(0):
                count.update({w.lower() for w in _CORPUS_WORD.findall(text.as_py())})
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())],
                                             names=["word", "docs"])

    counted = save(id_and_text(docs).select("text").mapInArrow(run, "word string, docs long").groupBy("word")
                   .agg(F.sum("docs").alias("docs")).where("docs > 1"), "word-counts")
    # the count that the last of the ``top`` words has, from how many words have each count
    least, held = 2, 0
    for n, words in counted.groupBy("docs").count().orderBy(F.desc("docs")).limit(top).collect():
        least, held = n, held + words
        if held >= top:
            break
    found = counted.where(F.col("docs") >= least).orderBy(F.desc("docs"), "word").limit(top).collect()
    words = list(dict.fromkeys([*COMMON_WORDS, *(r["word"] for r in found)]))
    return {w: k + 1 for k, w in enumerate(words)}


def spans(text: str, ranks: dict[str, int] | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all findings, by start and then kind."""
    out = [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    low = text.lower()
    if any(name in low for name in CONTEXT_NAMES):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
        for m in _CONTEXT.finditer(text):
            start, end = m.span(next(k for k in range(1, 5) if m[k] is not None))
            if m[3] is not None or m[4] is not None:
                value = text[start:end].rstrip(".,;:!?)]}>")
                end = start + len(value)
            value = text[start:end]
            if len(value) >= 6 and guess_bits(value, brute_bits(value), ranks) >= MIN_BITS:
                out.append(("guess", start, end))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in found)


def scan(docs: DataFrame, ranks: dict[str, int] | None = None) -> DataFrame:
    """Counts, digest of the base spans and all spans of every row (``ranks``: see :func:`common_words`)."""
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batch: pa.RecordBatch) -> dict:
        found = [spans(t.as_py(), sent.value) for t in batch.column(1)]
        count = lambda kind: [sum(s[0] == kind for s in f) for f in found]
        return {"doc_id": batch.column(0), "n_assign": count("assign"), "n_access": count("access"),
                "n_hex": count("hex"),
                "base_sha256": [hashlib.sha256(joined([s for s in f if s[0] != "guess"]).encode()).hexdigest()
                                for f in found],
                "spans": [joined(f) for f in found]}

    return map_batches(id_and_text(docs), run, "doc_id long, n_assign long, n_access long, n_hex long, "
                                               "base_sha256 string, spans string")
