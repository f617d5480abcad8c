"""Secret scan: three base patterns plus windowed character entropy.

The entropy scan takes candidate strings (runs of ``[A-Za-z0-9+/_=-]`` of at
least ``window`` characters), keeps one count per character and moves the
window by one character at a time: one count down, one up, and the sum of
n*log2(n) changed by two table entries, so a string of any length costs one
pass. A candidate is reported from the first to the last window whose entropy
reaches the threshold of its character class (hex, alphanumeric, base64).
Allow-listed candidates are suppressed, allow-listed parts are cut out and the
rest is scanned; base matches are never suppressed.

Row-wise: no shuffle, one Arrow batch in memory. Defined results: a null text
is an empty text (no spans, the hash of an empty string); repeated rows are
kept; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Least bits a character over a window of ``WINDOW``, by character class.
THRESHOLDS = {"hex": 3.0, "alnum": 3.6, "base64": 3.8}
#: Whole candidates that look random but are not secrets: words and numbers, UUIDs, integrity hashes.
ALLOW = tuple(re.compile(p) for p in (r"[0-9]+", r"[A-Za-z]+(?:[-_/=+][A-Za-z]+)*=*", r"(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", r"(?i)sha(?:1|256|384|512)-.*"))
#: Parts that are no secret: runs of one character, sequences, and placeholder words that stand between separators.
PARTS = re.compile(r"(?i)(.)\1{7,}|abcdefghij|0123456789|(?<![a-z0-9])(?:example|placeholder|changeme|dummy|sample|lorem|x{4,})(?![a-z0-9])")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def char_class(s: str) -> str:
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s):
        return "hex"
    return "alnum" if s.isalnum() else "base64"


def entropy_span(s: str, window: int = WINDOW, thresholds: dict[str, float] = THRESHOLDS) -> tuple[int, int] | None:
    """First start and last end of the windows that reach the class's threshold, or None."""
    least = thresholds[char_class(s)]
    log = [0.0] + [n * math.log2(n) for n in range(1, window + 1)]
    counts: dict[str, int] = {}
    total, first, last = 0.0, None, 0
    whole = math.log2(window)
    for i, c in enumerate(s):
        if i >= window:
            n = counts[s[i - window]]
            counts[s[i - window]] = n - 1
            total += log[n - 1] - log[n]
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += log[n + 1] - log[n]
        if i >= window - 1 and whole - total / window >= least - 1e-12:
            first = i - window + 1 if first is None else first
            last = i + 1
    return None if first is None else (first, last)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def entropy_spans(text: str) -> list[tuple[int, int, str]]:
    """High-entropy spans of candidates; allowed parts are cut out, what lies between them is scanned on its own."""
    found = []
    for m in CANDIDATE.finditer(text):
        if any(p.fullmatch(m[0]) for p in ALLOW):
            continue
        edges = [m.start(), *[m.start() + x for part in PARTS.finditer(m[0]) for x in part.span()], m.end()]
        for a, z in zip(edges[::2], edges[1::2], strict=True):
            if z - a >= WINDOW and (span := entropy_span(text[a:z])):
                found.append((a + span[0], a + span[1], "entropy"))
    return found


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]))))


def scan_text(text: str | None) -> tuple[int, int, int, str, str]:
    text = text or ""
    base = base_spans(text)
    n = [sum(k == kind for _, _, k in base) for kind in KINDS[:3]]
    return *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + entropy_spans(text))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [scan_text(x) for x in b.column(1).to_pylist()]
        cols = list(zip(*rows, strict=True)) or [()] * 5
        types = [pa.int64()] * 3 + [pa.string()] * 2
        arrays = [b.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end in code points, comma-joined)."""
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_scan, SCHEMA)
