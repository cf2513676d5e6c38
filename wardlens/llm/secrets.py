"""Secrets in texts: fixed patterns, and windows of high entropy in candidate strings.

Patterns (leftmost, not overlapping, per kind; a match that fails its test is dropped):

* assign: a name such as `password` or `api_key`, `:` or `=`, and a value of 12 or more characters;
* access: `AKIA` and capitals or digits, 18 or more characters;
* hex: 16 or more of `0-9a-f`.

Entropy: a candidate is a run of 20 or more of `A-Za-z0-9+/=_-`. Over each window of
`Entropy.window` characters of one class (hexadecimal digits, letters and digits, base64) the
Shannon entropy is kept up to date by the counts of the character that enters and the one that
leaves. Where a window reaches the class's threshold and has enough digits, or few digits but the
case of random letters or more entropy, the span from the first such window's start to the last
one's end is a secret of kind `entropy`. Of the allow-list, UUIDs and paths of words are passed over
whole; placeholders and runs of the alphabet only take away the windows that they overlap. A
placeholder at the start of a part between `=`, `/` and `+`, joined to what follows by `_` or `-`
(`sample_...`), also names that one word. The allow-list never removes a match of the patterns.

Null texts are empty: no spans. Rows are scanned one by one, so repeated rows and null doc_ids keep
their own rows; columns besides doc_id and text are not read. Positions are code points. An empty table
gives an empty result; a very long text is held whole by one task and scanned in linear time.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from wardlens.llm.common import as_texts, per_batch

SCHEMA = (
    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string,"
    " n_entropy long, redacted string"
)
# Fixed values
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(
    r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/=_-]{20,}")
ALLOWED = (
    re.compile(r"(?i)(?:(?<![A-Za-z0-9+_-])(?:example|sample|placeholder|changeme|dummy|redacted)[_-][A-Za-z0-9]+)"
               r"|example|sample|placeholder|changeme|dummy|redacted|xxxx|your[_-]"),
    re.compile(r"(?i)abcdefgh|0123456789|qwertyuiop"),
)
ALLOWED_WHOLE = (
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
    re.compile(r"[A-Za-z_]+([/-][A-Za-z_]+)+"),
)


@dataclass(frozen=True)
class Entropy:
    """Bits per character that a window of a class needs, and digits it must hold.

    A window with fewer digits needs `case_changes` between small and capital letters and two
    capitals in a row (names in CamelCase have none), or, with at most one such change,
    `few_digits` bits in letters and digits alone.
    """

    window: int = 20
    bits: dict = field(default_factory=lambda: {"hex": 3.0, "alnum": 3.6, "base64": 3.8})
    digits: int = 3
    case_changes: int = 5
    few_digits: float = 3.75


_CLASSES = {
    "hex": frozenset("0123456789abcdefABCDEF"),
    "alnum": frozenset("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "base64": frozenset("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/=_-"),
}
_DIGITS = frozenset("0123456789")


def class_runs(candidate: str):
    """(class, start, end) of the maximal runs of each class in a candidate."""
    for name, members in _CLASSES.items():
        start = None
        for i, c in enumerate(candidate):
            if c in members:
                start = i if start is None else start
            elif start is not None:
                yield name, start, i
                start = None
        if start is not None:
            yield name, start, len(candidate)


def dense_windows(
    run: str, window: int, bits: float, digits: int, case_changes: int = 99, few_digits: float = 99.0
):
    """Starts of the windows with entropy of `bits` or more and at least `digits` digits.

    With fewer digits, see `Entropy`.
    """
    weight = [0.0] + [k * math.log2(k) for k in range(1, window + 1)]
    total, counts, n_digits, n_changes, n_capitals = math.log2(window), {}, 0, 0, 0
    change = [a.isupper() and b.islower() or a.islower() and b.isupper() for a, b in zip(run, run[1:])]
    capitals = [a.isupper() and b.isupper() for a, b in zip(run, run[1:])]
    weighted = 0.0  # sum of k log k over the counts k of the window
    for i, c in enumerate(run):
        if i >= window:
            gone = run[i - window]
            k = counts[gone]
            weighted += weight[k - 1] - weight[k]
            counts[gone] = k - 1
            n_digits -= gone in _DIGITS
            n_changes -= change[i - window]
            n_capitals -= capitals[i - window]
        k = counts.get(c, 0)
        weighted += weight[k + 1] - weight[k]
        counts[c] = k + 1
        n_digits += c in _DIGITS
        n_changes += i > 0 and change[i - 1]
        n_capitals += i > 0 and capitals[i - 1]
        if i >= window - 1 and total - weighted / window >= bits - 1e-9:
            if (
                n_digits >= digits
                or (n_changes >= case_changes and n_capitals)
                or (n_changes < 2 and total - weighted / window >= few_digits - 1e-9)
            ):
                yield i - window + 1


def entropy_spans(text: str, rules: Entropy) -> list[tuple[int, int]]:
    """Merged spans of dense windows, over all classes."""
    found = []
    for match in CANDIDATE.finditer(text):
        candidate = match[0]
        if any(p.fullmatch(candidate) for p in ALLOWED_WHOLE):
            continue
        allowed = sorted(m.span() for p in ALLOWED for m in p.finditer(candidate))
        for name, start, end in class_runs(candidate):
            if end - start >= rules.window:
                few = rules.few_digits if name == "alnum" else 99.0
                next_ = 0
                for at in dense_windows(
                    candidate[start:end], rules.window, rules.bits[name], rules.digits,
                    rules.case_changes, few,
                ):
                    low = start + at
                    while next_ < len(allowed) and allowed[next_][1] <= low:
                        next_ += 1
                    if next_ < len(allowed) and allowed[next_][0] < low + rules.window:
                        continue
                    found.append((match.start() + low, match.start() + low + rules.window))
    merged: list[tuple[int, int]] = []
    for low, high in sorted(found):
        if merged and low <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
        else:
            merged.append((low, high))
    return merged


def pattern_spans(text: str) -> list[tuple[int, int, str]]:
    spans = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    return spans + [(*m.span(), "hex") for m in HEX.finditer(text)]


def joined(spans: list[tuple[int, int, str]]) -> str:
    order = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in order)


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """The text with each stretch covered by spans replaced by `mark`."""
    parts, at, high = [], 0, -1
    for start, end, _ in sorted(spans):
        if start >= high:
            parts += [text[at:start], mark]
        at = high = max(high, end)
    return "".join([*parts, text[at:]])


def find_secrets(docs: DataFrame, rules: Entropy = Entropy(), texts: bool = True) -> DataFrame:
    """One row per row of `docs`; `redacted` is null without `texts` or where nothing was found."""

    def scan(batch):
        out = {part.split()[0]: [] for part in SCHEMA.split(",")}
        for raw in batch.column("text").to_pylist():
            text = raw.decode("utf-8", "replace")
            base = pattern_spans(text)
            more = [(a, b, "entropy") for a, b in entropy_spans(text, rules)]
            kinds = [kind for _, _, kind in base]
            for kind in KINDS[:3]:
                out[f"n_{kind}"].append(kinds.count(kind))
            out["n_entropy"].append(len(more))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(base + more))
            out["redacted"].append(redact(text, base + more) if texts and base + more else None)
        return out | {"doc_id": batch.column("doc_id")}

    return per_batch(as_texts(docs), scan, SCHEMA)
