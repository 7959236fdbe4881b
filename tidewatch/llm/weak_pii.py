"""Personal data by weak supervision.

Base kinds (email, ip, card, phone) are found by fixed patterns and always kept.
Further candidates (secrets, account numbers) are looser, so six labelers vote on
every span: its shape (regex), its variety of characters, a gazetteer of cue words
before it, an assignment sign before it, its checksum, its edges. How often each
combination of kind and votes occurs is counted over all documents; expectation-maximisation turns the
counts (a few thousand at most) into the reliability of each labeler without any
labelled span, and a logistic span classifier is trained on the resulting
probabilities. Candidates it finds likely become spans.

Offsets are code points, ends exclusive. Texts are scanned without quadratic patterns.

Defined results: null counts as empty and has no spans; spans of equal place are
ordered by kind as listed; repeated rows each keep their row; an empty table trains
nothing and gives an empty result; other columns pass through ``redact`` untouched.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import chunks, free_name

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "account")
VOTE_FOR, VOTE_AGAINST, ABSTAIN = 1, 0, 2
ACCEPT = 0.5
BASE_PRIOR = 0.95
LEANING = 0.1

# Cue words.
CUES = {
    "password", "passwd", "pwd", "passphrase", "token", "secret", "key", "credential", "credentials", "login",
    "phone", "tel", "mobile", "fax", "call", "card", "visa", "mastercard", "credit", "iban", "account", "ssn",
    "social", "passport", "mail", "email", "contact", "ip", "address", "bearer", "auth",
}
ANTI_CUES = {
    "version", "isbn", "issn", "page", "pages", "figure", "table", "chapter", "order", "commit", "sha", "md5",
    "hash", "checksum", "build", "revision", "doi", "id", "copyright", "example",
}

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9][0-9.]{5,}[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_SECRET_WORDS = ("passw", "passphrase", "pwd", "secret", "token", "key", "credential", "bearer")
_ASSIGNED = re.compile(
    r"(?:password|passwd|passphrase|pwd|secret|token|key|credentials?)[\"']?[ \t]{0,4}[=:][ \t]{0,4}[\"']?([A-Za-z0-9_./+=-]{8,}+)",
    re.IGNORECASE,
)
_LONG_TOKEN = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]{16,}+(?![A-Za-z0-9])")
_GROUPED = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NUMBER = re.compile(r"(?<![0-9A-Za-z.+/-])[0-9]{7,}+(?![0-9A-Za-z./-])")
_STRICT_SECRET = re.compile(r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|(?:[0-9a-f]{8}){2,8}|eyJ[A-Za-z0-9_.-]{20,}")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")
_WORD = re.compile(r"[A-Za-z]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _mod97(text: str) -> bool:
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Local parts are walked back from each ``@``: never further than the last match or the last ``@``."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            done = match.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for run in _DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        for m in _IP.finditer(run.group()):
            parts = [p.lstrip("0") for p in m.group().split(".")]
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
                yield run.start() + m.start(), run.start() + m.end()


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, leftmost and non-overlapping per kind."""
    spans = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            spans += [(a, b, "ip") for a, b in _ips(text)]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
                spans.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_digits(m.group())) <= 15:
                    spans.append((m.start(), m.end(), "phone"))
    return spans


def more_candidates(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Looser spans that keep clear of the base ones and of each other."""
    found = []
    lower = text.lower()
    if any(w in lower for w in _SECRET_WORDS):
        found += [(*m.span(1), "secret") for m in _ASSIGNED.finditer(text)]
    if _DIGIT.search(text):  # none of these does without
        for m in _LONG_TOKEN.finditer(text):
            word = m.group()
            if _DIGIT.search(word) and not word.isdigit():
                found.append((*m.span(), "account" if _IBAN.fullmatch(word) and _mod97(word) else "secret"))
        found += [(*m.span(), "account") for m in _GROUPED.finditer(text)]
        found += [(*m.span(), "account") for m in _NUMBER.finditer(text)]
    clear, ends = [], sorted((a, b) for a, b, _ in taken)
    for a, b, kind in sorted(found, key=lambda s: (s[0], -s[1])):
        if not clear or a >= clear[-1][1]:
            if not any(a < y and x < b for x, y in ends):
                clear.append((a, b, kind))
    return clear


def votes(text: str, start: int, end: int, kind: str) -> tuple[int, ...]:
    """One vote of each labeler on a span."""
    value = text[start:end]
    before = text[max(0, start - 32) : start]
    words = {w.lower() for w in _WORD.findall(before)}
    if kind == "secret":
        shape = VOTE_FOR if _STRICT_SECRET.fullmatch(value) else ABSTAIN
        check = ABSTAIN
    elif kind == "account":
        plain = value.isdigit()
        shape = VOTE_AGAINST if plain else VOTE_FOR
        check = VOTE_FOR if _IBAN.fullmatch(value) else VOTE_AGAINST if plain and not luhn(value) else ABSTAIN
    else:
        shape = VOTE_FOR
        check = VOTE_FOR if kind in ("card", "ip") else ABSTAIN
    kinds = sum((any(map(str.isdigit, value)), any(map(str.islower, value)), any(map(str.isupper, value))))
    variety = len(set(value)) / min(len(value), 16)
    varied = VOTE_FOR if kinds > 1 and variety >= 0.5 else VOTE_AGAINST if variety < 0.25 else ABSTAIN
    cue = VOTE_FOR if words & CUES else VOTE_AGAINST if words & ANTI_CUES else ABSTAIN
    assigned = VOTE_FOR if before.rstrip(" \"'")[-1:] in ("=", ":") else ABSTAIN
    around = text[start - 1 : start] + text[end : end + 1]
    edges = VOTE_AGAINST if any(c.isalnum() for c in around) else VOTE_FOR
    return shape, varied, cue, assigned, check, edges


@dataclass(frozen=True)
class SpanModel:
    """Logistic weights: one a kind, one a labeler and vote."""

    kind: dict[str, float]
    vote: tuple[tuple[float, float, float], ...]
    reliability: tuple[tuple[float, float], ...] = ()

    def probability(self, kind: str, cast: tuple[int, ...]) -> float:
        z = self.kind.get(kind, 0.0) + sum(w[v] for w, v in zip(self.vote, cast))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def estimate(counts: Counter, rounds: int = 60) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """Probability of each counted (kind, votes) by expectation-maximisation, and labeler reliabilities.

    A labeler votes for, against or abstains with rates that depend on the hidden
    truth; priors differ by kind. It starts from the majority of the votes. Two things
    keep the hidden classes from drifting into something else than personal or not:
    base kinds passed strict patterns, so their prior is given, and a share of
    ``LEANING`` of all weight votes as a labeler better than chance would.
    """
    keys = list(counts)
    weight = np.array([counts[k] for k in keys], float)
    cast = np.array([k[1] for k in keys])
    kinds = np.array([KINDS.index(k[0]) for k in keys])
    lean = (cast == VOTE_FOR).sum(1) - 2 * (cast == VOTE_AGAINST).sum(1)
    p = 1 / (1 + np.exp(-(lean - 0.5)))
    rates = np.zeros((2, cast.shape[1], 3))
    base = np.isin(np.arange(len(KINDS)), [KINDS.index(k) for k in BASE_KINDS])
    lent = LEANING * weight.sum() * np.array([[0.5, 0.1, 0.4], [0.1, 0.5, 0.4]])
    for _ in range(rounds):
        for truth, share in ((0, weight * (1 - p)), (1, weight * p)):
            for j in range(cast.shape[1]):
                n = np.bincount(cast[:, j], weights=share, minlength=3) + lent[truth]
                rates[truth, j] = n / n.sum()
        seen = np.bincount(kinds, weights=weight, minlength=len(KINDS))
        prior = (np.bincount(kinds, weights=weight * p, minlength=len(KINDS)) + 1) / (seen + 2)
        prior[base] = BASE_PRIOR
        odds = np.log(prior[kinds]) - np.log1p(-prior[kinds])
        for j in range(cast.shape[1]):
            odds = odds + np.log(rates[1, j, cast[:, j]]) - np.log(rates[0, j, cast[:, j]])
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return p, [(float(rates[1, j, VOTE_FOR]), float(rates[0, j, VOTE_AGAINST])) for j in range(cast.shape[1])]


def train(counts: Counter, steps: int = 400, rate: float = 0.5, decay: float = 1e-3) -> SpanModel:
    """Logistic regression on the estimated probabilities, each combination weighted by its count."""
    labelers = len(votes("x", 0, 1, "email"))
    if not counts:
        return SpanModel({k: 0.0 for k in KINDS}, tuple((-0.5, 1.0, 0.0) for _ in range(labelers)))
    p, reliability = estimate(counts)
    keys = list(counts)
    x = np.zeros((len(keys), len(KINDS) + 3 * labelers))
    for i, (kind, cast) in enumerate(keys):
        x[i, KINDS.index(kind)] = 1
        for j, v in enumerate(cast):
            x[i, len(KINDS) + 3 * j + v] = 1
    weight = np.array([counts[k] for k in keys], float)
    # The square root keeps the commonest combination from drowning the rest.
    weight = np.sqrt(weight) / np.sqrt(weight).sum()
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        z = (x * w).sum(1)
        w -= rate * ((x * (weight * (1 / (1 + np.exp(-z)) - p))[:, None]).sum(0) * 4 + decay * w)
    table = w[len(KINDS) :].reshape(labelers, 3)
    return SpanModel(
        {k: float(w[i]) for i, k in enumerate(KINDS)}, tuple(tuple(map(float, r)) for r in table), tuple(reliability)
    )


def count_votes(docs: DataFrame) -> Counter:
    """How often each (kind, votes) occurs in all documents: at most kinds x 3^labelers rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for part in chunks(iter([batch])):
                for text in part.column(0).to_pylist():
                    base = base_spans(text) if text else []
                    for a, b, kind in [*base, *more_candidates(text or "", base)]:
                        counts[kind, "".join(map(str, votes(text, a, b, kind)))] += 1
            if counts:
                keys, n = zip(*counts.items())
                columns = pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array(n, pa.int64())
                yield pa.RecordBatch.from_arrays(list(columns), ["kind", "votes", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "kind string, votes string, n long")
    summed = rows.groupBy("kind", "votes").agg(F.sum("n").alias("n")).orderBy("kind", "votes").collect()
    return Counter({(r.kind, tuple(map(int, r.votes))): r.n for r in summed})


def fit(docs: DataFrame) -> SpanModel:
    return train(count_votes(docs))


def all_spans(text: str, model: SpanModel) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans in order."""
    base = base_spans(text)
    more = [s for s in more_candidates(text, base) if model.probability(s[2], votes(text, *s)) >= ACCEPT]
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    return sorted(base, key=order), sorted(base + more, key=order)


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def find(docs: DataFrame, model: SpanModel) -> DataFrame:
    """Counts and spans of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found = [all_spans(t or "", model) for t in batch.column(1).to_pylist()]
            numbers = [[sum(s[2] == k for s in base) for base, _ in found] for k in BASE_KINDS]
            digests = [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found]
            columns = [
                batch.column(0), *[pa.array(n, pa.int64()) for n in numbers], pa.array(digests),
                pa.array([written(every) for _, every in found]),
            ]
            names = ["doc_id", *[f"n_{k}" for k in BASE_KINDS], "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = ", ".join(["doc_id long", *[f"n_{k} long" for k in BASE_KINDS], "base_sha256 string", "spans string"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, schema)


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every stretch of overlapping spans replaced by the kind of its first span."""
    out, at, i = [], 0, 0
    while i < len(spans):
        a, b, kind = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < b:
            b = max(b, spans[i][1])
            i += 1
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join(out) + text[at:]


def redact(docs: DataFrame, model: SpanModel) -> DataFrame:
    """The documents with their spans masked; ``n_chars``, if there, follows the text."""

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else masked(t, all_spans(t, model)[1]) for t in texts], dtype=object)

    clean = free_name(docs, "clean")
    out = docs.withColumn(clean, mask(F.col("text").cast("string")))
    changed = {"text": F.col(clean)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(clean) == F.col("text"), F.col("n_chars")).otherwise(F.length(clean).cast("long"))
    return out.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])
