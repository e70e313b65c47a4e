"""Secret scans: patterns, and sliding-window entropy over candidate strings.

Three kinds of patterns (assignments, access keys, long hexadecimal runs) are found
first. Then candidate strings, runs of at least ``WINDOW`` key characters, are looked
through for the longest runs of each character class, and each run is read
with a window that moves a character at a time; the counts of its characters, and
from them the Shannon entropy, are kept up to date by adding one and dropping one. The
windows above the threshold of the run's class make up the spans
that are added, unless they lie in one that is known already. The allow-list drops
candidates and runs that only look random as a whole.

Edge cases: a null text is an empty one and has no spans; texts of any length are read
whole, in time proportional to their length; rows that repeat an id each get a row; an
empty table gives no rows; ``redacted`` carries other columns, ``scan`` does not read them.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Callable
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import map_batches, map_texts

WINDOW = 20
MASK = "[SECRET]"

# The patterns of the three kinds and their least lengths.
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base36", "entropy_base64")
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE
)
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_HINTS = ("passw", "secret", "token", "api")

CANDIDATE = re.compile(r"[A-Za-z0-9+/=_-]{20,}")
# Character classes in the order tried, the entropy in bits from which a window counts,
# and the digits it needs, so that words are no keys. Random strings of 20 have 3.36
# (hexadecimal), 3.59 (of both cases), 3.84 (digits and one case) and 4.05 on average; about
# one random window in 100 to 20 falls short.
CLASSES = (
    ("entropy_hex", re.compile(r"[0-9a-f]{20,}"), 2.9, 0),
    ("entropy_hex", re.compile(r"[0-9A-F]{20,}"), 2.9, 0),
    ("entropy_hex", re.compile(r"[0-9A-Fa-f]{20,}"), 3.1, 0),
    ("entropy_base36", re.compile(r"[0-9a-z]{20,}"), 3.5, 1),
    ("entropy_base36", re.compile(r"[0-9A-Z]{20,}"), 3.5, 1),
    ("entropy_base64", re.compile(r"[A-Za-z0-9+/=_-]{20,}"), 3.8, 0),
)
# Whole candidates and runs that are not secrets.
ALLOWED = (
    re.compile(r"[0-9]+([-_/][0-9]+)*"),  # numbers and dates
    re.compile(r"[A-Za-z]?[a-z]+|[A-Z]+"),  # a long word
    re.compile(r"([A-Za-z]+[-_/+=])+[A-Za-z]*"),  # words joined by signs
    re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"),  # identifiers
)
# No window reaches into a placeholder; what is before and after it is read.
PLACEHOLDER = re.compile(r"EXAMPLE|example|X{4,}|x{4,}|0123456789|abcdefgh|ABCDEFGH")

WEIGHT = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 1)]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    lower = text.lower()
    if any(hint in lower for hint in ASSIGN_HINTS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LENGTH]
    return found


def hot_windows(value: str, least: float, digits: int = 0) -> list[tuple[int, int]]:
    """Unions of the windows of ``value`` with at least ``least`` bits of entropy and ``digits`` digits."""
    counts: dict[str, int] = {}
    # Entropy is log2(W) - sum(c log2 c) / W.
    total, limit = 0.0, WINDOW * (math.log2(WINDOW) - least) + 1e-9
    spans: list[list[int]] = []
    held = 0
    for at, char in enumerate(value):
        n = counts.get(char, 0)
        if at >= WINDOW:
            gone = value[at - WINDOW]
            m = counts[gone]
            total += WEIGHT[m - 1] - WEIGHT[m]
            counts[gone] = m - 1
            held -= gone.isdigit()
            n = counts.get(char, 0)
        total += WEIGHT[n + 1] - WEIGHT[n]
        counts[char] = n + 1
        held += char.isdigit()
        if at >= WINDOW - 1 and total <= limit and held >= digits:
            start = at - WINDOW + 1
            if spans and spans[-1][1] >= start:
                spans[-1][1] = at + 1
            else:
                spans.append([start, at + 1])
    return [(a, b) for a, b in spans]


def cover(spans: list[tuple[str, int, int]]) -> Callable[[int, int], bool]:
    """Whether a single one of ``spans`` holds a given one."""
    places = sorted((start, end) for _, start, end in spans)
    starts = [start for start, _ in places]
    reach = list(accumulate((end for _, end in places), max))

    def held(start: int, end: int) -> bool:
        at = bisect_right(starts, start)
        return at > 0 and reach[at - 1] >= end

    return held


def between_placeholders(text: str, start: int, end: int) -> list[tuple[int, int]]:
    edges = [start, *(edge for m in PLACEHOLDER.finditer(text, start, end) for edge in m.span()), end]
    return [(a, b) for a, b in zip(edges[::2], edges[1::2]) if b - a >= WINDOW]


def entropy_spans(candidates: list[re.Match], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    found: list[tuple[str, int, int]] = []
    parts = [
        (candidate.string, *part)
        for candidate in candidates
        if not any(rule.fullmatch(candidate[0]) for rule in ALLOWED)
        for part in between_placeholders(candidate.string, *candidate.span())
    ]
    for kind, alphabet, least, digits in CLASSES if parts else ():
        held, added = cover(base + found), []
        for text, first, last in parts:
            for run in alphabet.finditer(text, first, last):
                if any(rule.fullmatch(run[0]) for rule in ALLOWED):
                    continue
                start = run.start()
                for a, b in hot_windows(run[0], least, digits):
                    if not held(start + a, start + b):
                        added.append((kind, start + a, start + b))
        found += added
    return found


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def spans_of(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and all spans of a text: (kind, start, end) in code points."""
    base = base_spans(text)
    candidates = []
    if max(map(len, text.split()), default=0) >= WINDOW:
        candidates = list(CANDIDATE.finditer(text))
        # A hexadecimal run that is long enough lies in a candidate.
        for candidate in candidates:
            base += [("hex", *m.span()) for m in HEX.finditer(text, *candidate.span()) if len(m[0]) >= HEX_LENGTH]
    base = ordered(base)
    return base, ordered(base + entropy_spans(candidates, base))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the number of each base kind, a digest of them, and all spans."""

    def run(batch: pa.RecordBatch) -> dict:
        rows = []
        for value in batch.column("text"):
            base, spans = spans_of(value.as_py() or "")
            kinds = [kind for kind, _, _ in base]
            digest = hashlib.sha256(joined(base).encode()).hexdigest()
            rows.append((*(kinds.count(k) for k in KINDS[:3]), digest, joined(spans), len(spans)))
        names = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans")
        return {"doc_id": batch.column("doc_id")} | dict(zip(names, zip(*rows)))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(
        rows, run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long"
    )


def mask(text: str | None) -> str | None:
    """The text with each union of overlapping spans replaced by ``MASK``."""
    if not text:
        return text
    out, at = [], 0
    for _, start, end in spans_of(text)[1]:
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def redacted(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with secrets masked; ``length_col``, if there is one, follows the text."""
    fields = docs.schema.fields

    def run(batch: pa.RecordBatch) -> dict:
        old = batch.column(text_col).to_pylist()
        new = [mask(text) for text in old]
        columns = {f.name: batch.column(f.name) for f in fields} | {text_col: new}
        if length_col in columns:
            lengths = batch.column(length_col).to_pylist()
            columns[length_col] = [n if a == b else len(b) for a, b, n in zip(old, new, lengths)]
        return columns

    return map_texts(docs, run, docs.schema)
