"""Secret scans: fixed patterns, and sliding-window entropy per character class.

The base patterns are kept as they are. Beside them, candidate strings (unbroken runs of the characters that keys
are written in) are read by a window of fixed length per character class. The counts of the window's characters
are kept up to date as it slides, and with them the Shannon entropy; adjacent windows at or above the class's
threshold merge into one span. A candidate shorter than its class's window is one window of its own length, and the
threshold is lower by as much as the most entropy that such a length can have. A candidate may follow '=' directly
and has 20 characters at least, letters of one case alone are words. A candidate is suppressed if an allow-list
pattern says that such strings are public (UUIDs, words in a row as identifiers and paths have them, numbers, versions
and dates, repeats of one short piece); the patterns take whole candidates made of nothing but such pieces, so a piece
that mixes letters with digits, or cases at random, is never allowed. A span that a base span holds adds nothing.

Cases: a null text counts as empty, an empty one has no spans; offsets count code points, ends are exclusive;
repeated rows scan alike; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}", re.ASCII)
#: Per character class: what its candidates are, window, and bits of entropy that a window must reach.
CLASSES = (
    ("hex", re.compile(r"[0-9a-fA-F]+"), 24, 3.0),
    ("alnum", re.compile(r"[0-9a-zA-Z]+"), 24, 3.7),
    ("base64", re.compile(r"[0-9a-zA-Z+/_=-]+"), 32, 4.1),
)
#: Words of two letters in identifiers.
_SHORT = "(?:An|As|At|Be|By|Do|Id|If|In|Is|It|My|No|Of|On|Or|To|Up)"
#: Pieces of public strings: a word in one case or with a capital, with a short number behind it, or a number.
_WORD = r"(?:[A-Z]{2,}|[A-Z]?[a-z]{2,15}|[A-Za-z])"
_PIECE = rf"(?:{_WORD}[0-9]{{0,3}}|[0-9]{{1,8}})"
#: Strings that are public or no keys, whatever their entropy.
ALLOW = (
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
    # words that follow each other by capitals: an identifier in camel case
    re.compile(rf"(?:[a-z]{{2,15}})?(?:[A-Z][a-z]{{2,15}}|{_SHORT})+[0-9]{{0,3}}"),
    # one word or number between separators: a path, a slug, a constant's name, a date
    re.compile(rf"[-_/+]*{_PIECE}(?:[-_/+=.]+{_PIECE})+[-_/+=]*"),
    re.compile(r"[0-9]+"),
    re.compile(r"(.{1,8}?)\1+.{0,7}"),
)


def windows(s: str, width: int, least: float) -> list[tuple[int, int]]:
    """Merged (start, end) of the windows of s whose entropy is at least `least`."""
    # entropy of a window = log2(width) - sum(c * log2(c)) / width over its characters' counts c
    terms = [0.0] + [c * math.log2(c) for c in range(1, width + 1)]
    counts: Counter = Counter()
    total, out = 0.0, []
    most = (math.log2(width) - least) * width + 1e-9
    for i, c in enumerate(s):
        total += terms[counts[c] + 1] - terms[counts[c]]
        counts[c] += 1
        if i >= width:
            d = s[i - width]
            total += terms[counts[d] - 1] - terms[counts[d]]
            counts[d] -= 1
        if i >= width - 1 and total <= most:
            a = i - width + 1
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((a, i + 1))
    return out


def entropy_spans(text: str) -> list[tuple[int, int]]:
    out = []
    for m in CANDIDATE.finditer(text):
        s = m[0]
        if any(a.fullmatch(s) for a in ALLOW):
            continue
        for _, members, width, least in CLASSES:
            if members.fullmatch(s):
                kinds = (any("0" <= c <= "9" for c in s)) + any(c.islower() for c in s) + any(c.isupper() for c in s)
                if kinds >= 2:
                    short = min(width, len(s))
                    out += [(m.start() + a, m.start() + b) for a, b in windows(s, short, least - math.log2(width / short))]
                break
    return out


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed."""
    text = text or ""
    base = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    base += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    more = [("entropy", a, b) for a, b in entropy_spans(text) if not any(s <= a and b <= e for _, s, e in base)]
    return sorted(base + more, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_column(text: Column) -> Column:
    """struct(n_assign, n_access, n_hex, n_entropy, base_sha256, spans)."""

    @F.pandas_udf("n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string")
    def scanned(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            found = scan(t)
            n = Counter(k for k, _, _ in found)
            base = joined([x for x in found if x[0] != "entropy"])
            rows.append((*[n[k] for k in KINDS], hashlib.sha256(base.encode()).hexdigest(), joined(found)))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"])

    return scanned(text)
