"""Secret scans: fixed patterns, and the guess cost of values that stand in a credential context.

The guess cost of a value is the least sum, over all segmentations, of the log10 guesses of its parts: words, dates,
repeats, keyboard walks and brute-force spans, found by dynamic programming. A value that is cheap to guess is a
placeholder or prose; a dear one is a secret. Words are ranked by the documents that hold them outside credential contexts
(``frequent_words``: a count, and a list of at most ``WORDS`` words). Texts are scanned whole, in Arrow batches, without a
shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.session import cut_lineage

# The base patterns. A match must reach the given length to count.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

#: Contexts of the method: more names, and quoted values of any printable characters.
CONTEXT = re.compile(
    r"""(?<![A-Za-z])(pass(?:word|wd|phrase|code)?|pwd|secret|token|api_?key|access_?key|private_?key|credentials?|auth|bearer)"""
    r"""["']?(?:\x20*[:=]\x20*|\x20+(?=["']))(?:"([^"\s]+)"|'([^'\s]+)'|([^\s"',;]+))""", re.IGNORECASE | re.ASCII)
CONTEXT_HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer")

# Common parts of chosen passwords and placeholders, in order of rank.
COMMON = (
    "password pass admin root user login test guest demo example sample welcome secret token changeme change me default "
    "letmein hello love dragon monkey master shadow sunshine princess football baseball summer winter spring autumn "
    "monday friday january february march april may june july august october november december qwerty azerty access key "
    "private public api server client data base database system service account name mail email house money super star "
    "hunter michael charlie thomas daniel jordan robert andrew joshua your here value string null none true false todo "
    "insert replace placeholder undefined redacted hidden my the and for this that with from new old temp").split()
# Keyboard rows.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0?[1-9]|1[0-2])(?:[-/._]?(?:0?[1-9]|[12]\d|3[01]))?)?|"
                  r"(?:0?[1-9]|[12]\d|3[01])[-/._](?:0?[1-9]|1[0-2])[-/._](?:\d{4}|\d\d)")

#: A date at every place where one begins.
DATES = re.compile(f"(?=({DATE.pattern}))")

#: Words ranked by the documents at most, and the documents that must hold one.
WORDS, LEAST_DOCS = 100_000, 2

#: A value whose guess cost reaches this many decimal digits is a secret.
THRESHOLD = 10.0
#: Cost of starting another part: the choice of its kind.
PART = math.log10(5)

KINDS = ("assign", "access", "hex", "guess")


def _neighbours() -> dict[str, frozenset[str]]:
    near: dict[str, set[str]] = {}
    for r, row in enumerate(ROWS):
        for c, key in enumerate(row):
            for rr, cc in ((r, c - 1), (r, c + 1), (r - 1, c), (r - 1, c + 1), (r + 1, c), (r + 1, c - 1)):
                if 0 <= rr < len(ROWS) and 0 <= cc < len(ROWS[rr]):
                    near.setdefault(key, set()).add(ROWS[rr][cc])
    return {k: frozenset(v) for k, v in near.items()}


NEAR = _neighbours()
LEET = str.maketrans("@4310$5!7", "aaeiossit")


class GuessCost:
    """Least log10 guesses of a value. ``words`` are in order of rank; another list can be given."""

    def __init__(self, words: Sequence[str] = COMMON) -> None:
        self.rank = {w: i + 1 for i, w in reversed(list(enumerate(words)))}
        self.longest = max(map(len, words), default=0)

    def _char(self, c: str) -> float:
        if c.isdigit():
            return 1.0
        return math.log10(26) if c.isascii() and c.isalpha() else math.log10(33) if c.isascii() else 2.0

    def _word(self, low: str, plain: str, raw: str, i: int, j: int) -> float | None:
        rank = self.rank.get(low[i:j])
        leet = 0.0
        if rank is None and (rank := self.rank.get(plain[i:j])) is not None:
            leet = math.log10(2 ** min(8, sum(a != b for a, b in zip(low[i:j], plain[i:j]))))
        if rank is None:
            return None
        upper = sum(c.isupper() for c in raw[i:j])
        return math.log10(rank + 1) + leet + (math.log10(2 + upper) if upper else 0.0)

    def __call__(self, value: str) -> float:
        n, low = len(value), value.lower()
        if len(low) != n:  # a letter whose lower form is longer
            low = value
        plain = low.translate(LEET)
        dates: dict[int, list[int]] = {}
        for m in DATES.finditer(value):
            dates.setdefault(m.end(1), []).append(m.start())
        best = [0.0] + [math.inf] * n
        spread = [math.inf] * (n + 1)  # least cost with a brute-force span that ends here and may go on
        made: list[object] = [None] * (n + 1)  # the stretch whose part ends here at the least cost
        run, walk = _Stretch(3), _Stretch(4)
        units = {unit: _Stretch(2 * unit) for unit in range(2, 9)}
        for j in range(1, n + 1):
            at = j - 1
            char = self._char(value[at])
            least = spread[j] = min(spread[at], best[at] + PART) + char
            source: object = None
            for i in range(max(0, j - self.longest), j - 1):
                if (guesses := self._word(low, plain, value, i, j)) is not None and best[i] + guesses + PART < least:
                    least = best[i] + guesses + PART
            for i in dates.get(j, ()):
                least = min(least, best[i] + math.log10(365 * 120 if j - i > 4 else 120) + PART)
            if at == 0 or value[at] != value[at - 1]:
                run = _Stretch(3, at)
            if at == 0 or low[at] not in NEAR.get(low[at - 1], ()):
                walk = _Stretch(4, at)
            parts = [(run, char, 1.0, 1), (walk, math.log10(47 * 3), 2.0, 1)]
            # Repeats of a unit of 2 to 8 characters: one unit, times the count.
            for unit, stretch in units.items():
                if at >= unit and value[at] == value[at - unit]:
                    if stretch.start is None:
                        stretch = units[unit] = _Stretch(2 * unit, at - unit)
                    parts.append((stretch, sum(map(self._char, value[at - unit + 1:j])), 1.0, unit))
                elif stretch.start is not None:
                    units[unit] = _Stretch(2 * unit)
            for stretch, base, power, unit in parts:
                cost = stretch.cost(j, base, power, unit, best, made)
                if cost < least:
                    least, source = cost, stretch
            best[j], made[j] = least, source
        return best[n]


class _Stretch:
    """A run, walk or repetition that goes on, and the places in it where a part of the least cost can begin.

    A place where a part of the same stretch ends is none: one longer part costs less than two. A place falls out as soon as
    an earlier one costs no more, since its advantage only shrinks while the stretch goes on. So few places are left, however
    long the stretch.
    """

    def __init__(self, least: int, start: int | None = None) -> None:
        self.least, self.start, self.places = least, start, []

    def cost(self, end: int, base: float, power: float, unit: int, best: list[float], made: list[object]) -> float:
        """The least cost of a part that ends at ``end``; infinite if none can."""
        new = end - self.least
        if new >= self.start and made[new] is not self:
            self.places.append(new)
        least, left = math.inf, []
        for i in self.places:
            cost = best[i] + base + power * math.log10((end - i) / unit) + PART
            if cost < least:
                least = cost
                left.append(i)
        self.places = left
        return least


def find_secrets(text: str, cost: GuessCost, threshold: float = THRESHOLD) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of every span, by start and then kind as listed in ``KINDS``."""
    spans = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        spans += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    spans += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    if any(h in low for h in CONTEXT_HINTS):
        for m in CONTEXT.finditer(text):
            k = next(g for g in (2, 3, 4) if m.start(g) >= 0)
            value = m[k].rstrip(".,)") if k == 4 else m[k]
            if value and cost(value) >= threshold:
                spans.append((m.start(k), m.start(k) + len(value), 3))
    spans.sort()
    return [(a, b, KINDS[k]) for a, b, k in spans]


def masked(text: str, spans: Sequence[tuple[int, int, str]], mask: str = "<secret>") -> str:
    """The text with the union of the spans replaced; overlapping spans become one mask."""
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


SCHEMA = ("struct<n_assign:bigint,n_access:bigint,n_hex:bigint,n_guess:bigint,base_sha256:string,spans:string,masked:string>")


def frequent_words(docs: DataFrame, text: str = "text", most: int = WORDS) -> list[str]:
    """``COMMON``, then the words of 3 to 24 letters that most documents hold, in order of rank; at most ``most`` of these.

    A word counts once per row. Values in a credential context don't count, so that a secret that is often copied doesn't
    become a word; nor do parts of a run with digits.
    """
    outside = F.regexp_replace(F.col(text), f"(?i){CONTEXT.pattern}", " ")
    found = F.array_distinct(F.split(F.lower(outside), r"[^\p{L}\p{M}\p{N}]+"))
    words = docs.select(F.explode(found).alias("w")).where(F.col("w").rlike(r"^[\p{L}\p{M}]{3,24}$"))
    counts = cut_lineage(words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_DOCS)
                         .withColumn("bin", F.floor(F.log2("n") * 16)))
    # A sort would send a list of every task to the driver: whole bins of like counts instead, and a share of the last one.
    room, low, share = most, 0, 1.0
    for r in sorted(counts.groupBy("bin").agg(F.count(F.lit(1)).alias("k")).collect(), key=lambda r: -r["bin"]):
        if r["k"] > room:
            low, share = r["bin"], room / r["k"]
            break
        room -= r["k"]
    taken = (F.col("bin") > low) | ((F.col("bin") == low) & (F.pmod(F.xxhash64("w"), F.lit(1 << 30)) < int(share * (1 << 30))))
    found = sorted(((-r["n"], r["w"]) for r in counts.where(taken).collect()))[:most]
    return list(dict.fromkeys([*COMMON, *(w for _, w in found)]))


def _scan(names: list[str], text: str, threshold: float, words: Sequence[str], with_text: bool):
    kinds = pa.struct([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_guess", pa.int64()),
                       ("base_sha256", pa.string()), ("spans", pa.string()), ("masked", pa.string())])

    def one(value: str | None, cost: GuessCost) -> dict:
        found = find_secrets(value or "", cost, threshold)
        texts = [(k, f"{k}:{a}:{b}") for a, b, k in found]
        count = lambda kind: sum(k == kind for k, _ in texts)
        return {"n_assign": count("assign"), "n_access": count("access"), "n_hex": count("hex"), "n_guess": count("guess"),
                "base_sha256": sha256(",".join(s for k, s in texts if k != "guess").encode()).hexdigest(),
                "spans": ",".join(s for _, s in texts),
                "masked": (masked(value, found) if found else value) if with_text and value is not None else None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost = GuessCost(words)
        for batch in batches:
            values = batch.column(batch.schema.get_field_index("_text"))
            found = pa.array([one(v.as_py(), cost) for v in values], kinds)
            yield pa.record_batch([*[batch.column(batch.schema.get_field_index(n)) for n in names], found], names=[*names, "_found"])

    return run


def scan_secrets(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), threshold: float = THRESHOLD,
                 words: Sequence[str] = COMMON, with_text: bool = True) -> DataFrame:
    """The ``keep`` columns with ``n_assign``, ``n_access``, ``n_hex``, ``n_guess``, ``base_sha256``, ``spans`` and ``masked``.

    Base spans are those of the three fixed patterns, leftmost and non-overlapping per kind; ``guess`` spans are values in
    a credential context whose guess cost reaches ``threshold``. ``masked`` is the text with all spans replaced (null
    without ``with_text``). A null text is scanned as empty and stays null. Positions are code points, ends exclusive. Rows are independent: repeated
    rows and null ids make no difference, an empty table gives no rows. Kept columns must not carry an output's name.
    """
    keep = list(keep)
    rows = docs.select(*keep, F.col(text).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields)
    return rows.mapInArrow(_scan(keep, text, threshold, words, with_text), f"{fields}, _found {SCHEMA}").select(*keep, "_found.*")
