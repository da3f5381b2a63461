"""Personal data in records: fixed patterns, and a semi-Markov conditional random field that adds spans."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foldwise.llm.columns import id_type, pair

KINDS = ("email", "ip", "card", "phone")
# The base patterns. A match never starts inside a run of digits, so the look-behind changes nothing but time.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = int(c) * (1 + n % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and not NOT_LOCAL.match(text, start - 1):
            start -= 1
        domain = DOMAIN.match(text, at) if start < at else None
        if domain:
            done = domain.end()
            yield start, done, "email"
        else:
            done = max(done, at)
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns as ``(start, end, kind)`` in code points, by start, then kind as listed."""
    found = list(_emails(text))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            found.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        digits = digits_of(m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), "card"))
    for m in PHONE.finditer(text):
        if 9 <= len(digits_of(m.group())) <= 15:
            found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


CLUE = re.compile(r"[0-9@]")
#: Characters around clues that belong to their island, and the gap between clues that joins islands.
MARGIN, GAP = 32, 24
TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[^0-9A-Za-z]", re.S)
#: Tokens in one entity at most: bounds the dynamic programme.
LONGEST = 16
INSIDE_NUMBER = frozenset(" ().-+")


def islands(text: str) -> Iterator[tuple[int, str]]:
    """``(offset, piece)``: the stretches around digits and at-signs. No entity can lie elsewhere."""
    begin = end = None
    for m in CLUE.finditer(text):
        at = m.start()
        if begin is None:
            begin = at
        elif at - end > GAP + 2 * MARGIN:
            low = max(0, begin - MARGIN)
            yield low, text[low : end + 1 + MARGIN]
            begin = at
        end = at
    if begin is not None:
        low = max(0, begin - MARGIN)
        yield low, text[low : end + 1 + MARGIN]


def candidates(tokens: list[str]) -> list[tuple[int, int]]:
    """Token ranges that may be an entity: number-like runs from a digit, ``+`` or ``(`` to a digit, and runs around an
    at-sign; at most ``LONGEST`` tokens each."""
    out = []
    for i, t in enumerate(tokens):
        if t[0].isdigit() or t in "+(":
            for j in range(i, min(len(tokens), i + LONGEST)):
                u = tokens[j]
                if not ("0" <= u[0] <= "9") and u not in INSIDE_NUMBER:
                    break
                if "0" <= u[0] <= "9":
                    out.append((i, j + 1))
        if t == "@":
            starts, ends = [], []
            for s in range(i - 1, max(-1, i - LONGEST), -1):
                if NOT_LOCAL.search(tokens[s]):
                    break
                starts.append(s)
            for e in range(i + 1, min(len(tokens), i + LONGEST)):
                if not re.fullmatch(r"[A-Za-z0-9.-]+", tokens[e]):
                    break
                ends.append(e + 1)
            out += [(s, e) for s in starts for e in ends if e - s <= LONGEST]
    return sorted(set(out))


def span_features(tokens: list[str], start: int, end: int) -> list[str]:
    """Names of what holds for a whole candidate span and its two neighbours."""
    text = "".join(tokens[start:end])
    digits = digits_of(text)
    before = tokens[start - 1] if start else " "
    after = tokens[end] if end < len(tokens) else " "
    groups = "-".join(str(len(g)) for g in re.findall(r"[0-9]+", text))
    rest = sorted(set(c if not c.isalnum() else "a" if c.isalpha() else "" for c in text) - {""})
    out = [
        "bias", f"digits={min(len(digits), 20)}", f"groups={groups if len(groups) < 12 else 'many'}", f"marks={''.join(rest)}",
        f"first={text[0] if not text[0].isalnum() else 'x'}", f"numbers={min(groups.count('-') + 1, 6)}",
    ]
    if before[-1].isalnum() or before in "-+.@%_":
        out.append("joined before")
    if after[0].isalnum() or after in "@-_":
        out.append("joined after")
    if after == "." and end + 1 < len(tokens) and tokens[end + 1][0].isalnum():
        out.append("goes on after a point")
    if not digits or len(digits) < 7:
        out.append("few digits")
    if 12 <= len(digits) <= 19:
        out.append("luhn" if luhn(digits) else "no luhn")
    if "@" in text:
        out.append("one at-sign" if text.count("@") == 1 else "at-signs")
        domain = text.rpartition("@")[2]
        out.append("dotted domain" if re.fullmatch(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", domain) else "bare domain")
    parts = text.split(".")
    if len(parts) == 4 and all(p.isdigit() and p.isascii() for p in parts):
        out.append("quad" if all(len(p) <= 3 and int(p) <= 255 for p in parts) else "large quad")
    if text.count("(") != text.count(")"):
        out.append("open bracket")
    return out


@dataclass
class SemiCRF:
    """Whole-span features score every candidate segment for every kind; all other tokens are single segments of score 0."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def scores(self, features: list[list[str]]) -> np.ndarray:
        zero = np.zeros(len(KINDS))
        return np.array([sum((self.weights.get(f, zero) for f in fs), zero) for fs in features]).reshape(-1, len(KINDS))

    def decode(self, tokens: list[str]) -> list[tuple[int, int, str]]:
        """The segmentation of the highest score, by dynamic programming over segment ends: boundaries and kinds at once.
        Ties go to fewer entities."""
        spans = candidates(tokens)
        if not spans:
            return []
        scores = self.scores([span_features(tokens, a, b) for a, b in spans])
        kind, top = scores.argmax(axis=1).tolist(), scores.max(axis=1).tolist()
        ending: dict[int, list[int]] = {}
        for n, (_, b) in enumerate(spans):
            ending.setdefault(b, []).append(n)
        best, back = [0.0] * (len(tokens) + 1), [None] * (len(tokens) + 1)
        for at in range(1, len(tokens) + 1):
            best[at] = best[at - 1]
            for n in ending.get(at, ()):
                value = best[spans[n][0]] + top[n]
                if value > best[at] + 1e-12:
                    best[at], back[at] = value, n
        out, at = [], len(tokens)
        while at:
            if back[at] is None:
                at -= 1
            else:
                a, b = spans[back[at]]
                out.append((a, b, KINDS[kind[back[at]]]))
                at = a
        return out[::-1]


def _log_add(values: list[float]) -> float:
    top = max(values)
    return top + float(np.log(np.exp(np.array(values) - top).sum()))


def marginals(n_tokens: int, spans: list[tuple[int, int]], scores: np.ndarray) -> tuple[float, np.ndarray]:
    """Log partition sum over all segmentations, and the probability of each (candidate, kind), by forward and backward sums."""
    whole = np.logaddexp.reduce(scores, axis=1)
    ending: dict[int, list[int]] = {}
    starting: dict[int, list[int]] = {}
    for n, (a, b) in enumerate(spans):
        ending.setdefault(b, []).append(n)
        starting.setdefault(a, []).append(n)
    forward, backward = [0.0] * (n_tokens + 1), [0.0] * (n_tokens + 1)
    for at in range(1, n_tokens + 1):
        came = [forward[at - 1], *[forward[spans[n][0]] + whole[n] for n in ending.get(at, ())]]
        forward[at] = _log_add(came) if len(came) > 1 else came[0]
    for at in range(n_tokens - 1, -1, -1):
        goes = [backward[at + 1], *[backward[spans[n][1]] + whole[n] for n in starting.get(at, ())]]
        backward[at] = _log_add(goes) if len(goes) > 1 else goes[0]
    total = forward[n_tokens]
    outside = np.array([forward[a] + backward[b] - total for a, b in spans])
    return total, np.exp(scores + outside[:, None])


def fit(examples: list[tuple[list[str], set[tuple[int, int, str]]]], rounds: int = 12, rate: float = 0.5, l2: float = 1e-4) -> SemiCRF:
    """Maximum-likelihood weights from token lists with their entities, by AdaGrad over the examples in the given order."""
    model, seen = SemiCRF(), {}
    prepared = []
    for tokens, gold in examples:
        spans = candidates(tokens)
        if spans:
            truth = np.zeros((len(spans), len(KINDS)))
            place = {s: n for n, s in enumerate(spans)}
            for a, b, kind in gold:
                if (a, b) in place:
                    truth[place[a, b], KINDS.index(kind)] = 1.0
            prepared.append((len(tokens), spans, [span_features(tokens, a, b) for a, b in spans], truth))
    for _ in range(rounds):
        for n_tokens, spans, features, truth in prepared:
            _, expected = marginals(n_tokens, spans, model.scores(features))
            push: dict[str, np.ndarray] = {}
            for fs, delta in zip(features, truth - expected):
                for f in fs:
                    push[f] = push[f] + delta if f in push else delta
            for f, g in push.items():
                w = model.weights.get(f)
                if w is None:
                    w, seen[f] = np.zeros(len(KINDS)), np.full(len(KINDS), 1e-6)
                g = g - l2 * w
                seen[f] = seen[f] + g * g
                model.weights[f] = w + rate * g / np.sqrt(seen[f])
    return model


def examples_of(piece: str) -> Iterator[tuple[list[str], set[tuple[int, int, str]]]]:
    """Training examples from one island: as it is, with the base spans as entities; and, for each phone, without its country
    prefix, since numbers are as often written so."""
    spans = base_spans(piece)
    yield _tokenised(piece, spans)
    for start, end, kind in spans:
        short = re.sub(r"^\+[0-9]{1,3}[\x20.-]+", "", piece[start:end])
        if kind == "phone" and short != piece[start:end] and len(digits_of(short)) >= 7:
            text = piece[:start] + short + piece[end:]
            moved = [(s, e, k) for s, e, k in base_spans(text) if k != "phone"]
            yield _tokenised(text, [*moved, (start, start + len(short), "phone")])


def _tokenised(text: str, spans: list[Span]) -> tuple[list[str], set[tuple[int, int, str]]]:
    starts, ends, tokens = {}, {}, []
    for m in TOKEN.finditer(text):
        starts[m.start()], ends[m.end()] = len(tokens), len(tokens) + 1
        tokens.append(m.group())
    return tokens, {(starts[s], ends[e], k) for s, e, k in spans if s in starts and e in ends}


#: Records whose islands the field is fitted on at most, chosen by a hash of their id, and islands at most.
SAMPLE_RECORDS, SAMPLE_ISLANDS = 500, 1000


def fit_on(records: DataFrame, id: str = "entry_id", body: str = "body", rows: int = SAMPLE_RECORDS) -> SemiCRF:
    """Fit on the islands of at most ``rows`` records that hold a digit or an at-sign; the base patterns are the labels."""
    source = pair(records, id, body).filter(F.col("entry_id").isNotNull() & F.col("body").rlike("[0-9@]"))
    # Ids alone are ranked, so that no task gathers texts; the chosen ones are few enough to broadcast.
    ids = source.select("entry_id").distinct().orderBy(F.xxhash64("entry_id"), "entry_id").limit(rows)
    chosen = source.join(F.broadcast(ids), "entry_id").select("entry_id", "body")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = [p for text in batch.column(1).to_pylist() for _, p in islands(text) if len(p) <= 400]
            yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.string())], ["piece"])

    found = chosen.mapInArrow(cut, "piece string").distinct().orderBy(F.xxhash64("piece"), "piece").limit(SAMPLE_ISLANDS)
    pieces = sorted(r["piece"] for r in found.collect())
    return fit([e for p in pieces for e in examples_of(p)])


def all_spans(text: str, model: SemiCRF) -> tuple[list[Span], list[Span]]:
    """The base spans, and these with the field's spans that touch none of them; both in order."""
    if not CLUE.search(text):
        return [], []
    base = base_spans(text)
    more = list(base)
    for offset, piece in islands(text):
        tokens = TOKEN.findall(piece)
        entities = model.decode(tokens)
        if entities:
            places = np.concatenate(([0], np.cumsum([len(t) for t in tokens]))).tolist()
            more += [(offset + places[a], offset + places[b], k) for a, b, k in entities]
    taken = sorted(base)
    ends = np.maximum.accumulate([e for _, e, _ in taken]) if taken else np.zeros(0, np.int64)
    starts = np.array([s for s, _, _ in taken], np.int64)
    kept = list(base)
    for s, e, k in sorted(set(more[len(base) :])):
        n = int(np.searchsorted(starts, e))
        if not n or ends[n - 1] <= s:
            kept.append((s, e, k))
    return base, sorted(kept, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def find_pii(records: DataFrame, model: SemiCRF, id: str = "entry_id", body: str = "body") -> DataFrame:
    """``(entry_id, base array<struct>, spans array<struct>)``: personal data per record as ``(kind, start, end)`` in code points, end
    exclusive, ordered by start and kind.

    ``records`` are parsed writeup entries or any rows with an id and a text. ``base`` holds the matches of the fixed patterns,
    ``spans`` these and whatever the field finds besides without touching them. Whole texts are read; NULL and empty texts have
    no spans; repeated rows and NULL ids each keep their row.
    """
    source = pair(records, id, body)
    place = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [all_spans(text or "", model) for text in batch.column(1).to_pylist()]
            columns = [
                pa.array([[{"kind": k, "start": s, "end": e} for s, e, k in f[n]] for f in found], pa.list_(place)) for n in (0, 1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["entry_id", "base", "spans"])

    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    return source.mapInArrow(run, f"entry_id {id_type(source)}, base {spans}, spans {spans}")
