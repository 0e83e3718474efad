"""Secret scans: base patterns, and candidate strings whose sliding-window entropy is high.

Within a candidate, a window slides over each run of one character class while its symbol counts, and with
them its Shannon entropy, are updated in one step for the symbol that leaves and the one that enters.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
HEX_RUN = re.compile(rb"[0-9a-f]{24,}")
LEAST = {"assign": 6, "access": 20, "hex": 24}
HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{24,}")
#: Character classes, and the entropy in bits that a window of 24 of their characters must have.
CLASSES = {"hex": (re.compile(rb"[0-9A-Fa-f]{24,}"), 3.0), "alphanumeric": (re.compile(rb"[A-Za-z0-9]{24,}"), 3.7), "base64": (re.compile(rb"[A-Za-z0-9+/=]{24,}"), 3.9), "url-safe": (re.compile(rb"[A-Za-z0-9_-]{24,}"), 3.9)}
WINDOW = 24
#: Strings that look random and are no secrets: UUIDs, words joined by marks, paths, one letter case without digits, alphabets.
ALLOWED = (
    re.compile(rb"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"),
    re.compile(rb"([A-Za-z]+[-_/+=])*[A-Za-z]+"),
    re.compile(rb"/?([a-z0-9_.-]{1,20}/)+[A-Za-z0-9_.=-]{0,20}"),
    re.compile(rb"[0-9+/_=-]+"),
    re.compile(rb"(?i).*(abcdefghij|0123456789|example|placeholder|xxxxxx).*"),
)
PLOGP = [0.0] + [k / WINDOW * math.log2(WINDOW / k) for k in range(1, WINDOW + 1)]


def high_windows(run: bytes, least: float, size: int = WINDOW) -> tuple[int, int] | None:
    """(start, end) from the first to the last window of `run` with at least that entropy."""
    counts: dict[int, int] = {}
    entropy, first, last = 0.0, -1, -1
    for i, c in enumerate(run):
        k = counts.get(c, 0)
        entropy += PLOGP[k + 1] - PLOGP[k]
        counts[c] = k + 1
        if i >= size - 1:
            if entropy >= least:
                first, last = (i - size + 1 if first < 0 else first), i + 1
            gone = run[i - size + 1]
            k = counts[gone]
            entropy += PLOGP[k - 1] - PLOGP[k]
            counts[gone] = k - 1
    return (first, last) if first >= 0 else None


def allowed(candidate: bytes) -> bool:
    return any(p.fullmatch(candidate) for p in ALLOWED)


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, in bytes."""
    found = []
    low = text.lower()
    if any(hint in low for hint in HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if b"AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    return found + [(m.start(), 2, m.end()) for m in HEX_RUN.finditer(text)]  # a maximal run, as HEX finds it


def entropy_spans(text: bytes) -> list[tuple[int, int, int]]:
    found = []
    for m in CANDIDATE.finditer(text):
        if allowed(m[0]):
            continue
        spans = [(at.start() + w[0], at.start() + w[1]) for pattern, least in CLASSES.values() for at in pattern.finditer(m[0]) if (w := high_windows(at[0], least))]
        if spans:
            found.append((m.start() + min(a for a, _ in spans), 3, m.start() + max(b for _, b in spans)))
    return found


def scan_text(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) as (start, kind, end) in code points, by start, then kind."""
    data = (text or "").encode("utf-8", "surrogatepass")
    base, more = base_spans(data), entropy_spans(data)
    if base or more:
        if len(data) != len(text):
            # code points that begin before each byte, counted once for all spans
            before = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
            base, more = ([(int(before[a]), k, int(before[b])) for a, k, b in x] for x in (base, more))
    return sorted(base), sorted(base + more)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """docs with n_assign, n_access, n_hex, base_sha256, spans and found (an array of kind, start, end).

    A null text counts as an empty one. Each row is scanned by itself, so rows that repeat an id have results of
    their own; an empty table gives none, and other columns pass through unless they have the name of an added one,
    which wins. Offsets are code points, ends exclusive. Base spans always stay; an
    entropy span is added where a window of an unlisted candidate string has the entropy of its class.
    """
    kind = T.StructType([
        *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:3]), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()),
        T.StructField("found", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    ])
    out = pa.struct([*((f"n_{k}", pa.int64()) for k in KINDS[:3]), ("base_sha256", pa.string()), ("spans", pa.string()), ("found", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))])

    @F.arrow_udf(kind)
    def scanned(text: pa.Array) -> pa.Array:
        rows = []
        for t in text:
            base, every = scan_text(t.as_py())
            counts = {f"n_{name}": sum(k == i for _, k, _ in base) for i, name in enumerate(KINDS[:3])}
            rows.append(counts | {"base_sha256": hashlib.sha256(written(base).encode()).hexdigest(), "spans": written(every), "found": [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in every]})
        return pa.array(rows, out)

    names = [f.name for f in kind.fields]
    return docs.drop(*names).withColumn("__s", scanned("text")).select("*", *[F.col(f"__s.{n}").alias(n) for n in names]).drop("__s")
