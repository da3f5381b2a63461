import itertools
import random
import re

import numpy as np
import pytest

from foldwise.llm import pii


def brute_base(text):
    """The contract's patterns, plainly."""
    out = []
    rules = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    for kind, rule in rules.items():
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = [sum(divmod(2 * int(c), 10)) if n % 2 else int(c) for n, c in enumerate(reversed(digits))]
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], list(rules).index(s[2])))


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choice("aB1234567890..@@-+ ()%é_") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == brute_base(text), text
    text = "4111 1111 1111 1111, +1 (456) 555-2186, a.b@c.de 10.0.0.256 10.0.0.25 a@b@c.d x@y"
    assert [k for _, _, k in pii.base_spans(text)] == ["card", "phone", "email", "ip", "email"]


def test_long_runs_take_linear_time():
    for c in "1", "a", "@", "1.", "+1 ", "a@":
        pii.base_spans(c * 200_000)


def segmentations(n, spans):
    """All sets of candidates that do not overlap."""
    for size in range(len(spans) + 1):
        for chosen in itertools.combinations(range(len(spans)), size):
            ordered = sorted(spans[i] for i in chosen)
            if all(a[1] <= b[0] for a, b in zip(ordered, ordered[1:])):
                yield chosen


def test_marginals_and_decoding_equal_enumeration():
    rng = np.random.default_rng(3)
    tokens = pii.TOKEN.findall("1 2-3 a@b.c")
    spans = pii.candidates(tokens)[:9]
    scores = rng.normal(0, 2, (len(spans), len(pii.KINDS)))
    total, gain = 0.0, np.zeros_like(scores)
    for chosen in segmentations(len(tokens), spans):
        for kinds in itertools.product(range(4), repeat=len(chosen)):
            weight = np.exp(sum(scores[i, k] for i, k in zip(chosen, kinds)))
            total += weight
            for i, k in zip(chosen, kinds):
                gain[i, k] += weight
    log_sum, found = pii.marginals(len(tokens), spans, scores)
    assert log_sum == pytest.approx(np.log(total))
    assert np.allclose(found, gain / total)


def test_decoding_finds_the_best_segmentation():
    rng = np.random.default_rng(4)
    tokens = pii.TOKEN.findall("12 34-56 7@b.c")
    spans = pii.candidates(tokens)
    for _ in range(20):
        model = pii.SemiCRF()
        scores = rng.normal(-0.5, 2, (len(spans), len(pii.KINDS)))
        model.scores = lambda features: scores
        found = model.decode(tokens)
        value = sum(scores[spans.index((a, b)), pii.KINDS.index(k)] for a, b, k in found)
        if len(spans) <= 16:
            best = max(sum(scores[i].max() for i in c) for c in segmentations(len(tokens), spans))
            assert value == pytest.approx(best)
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:]))


def sample_texts():
    rng = random.Random(1)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    out = []
    for n in range(150):
        parts = ["score", "0.97", "fold", digits(2), f"+1 ({digits(3)}) 555-{digits(4)}", "then", f"u{n}@mail.example.com", "and", digits(16)]
        parts.append(f"{rng.randint(0, 255)}.{rng.randint(0, 255)}.3.{rng.randint(0, 255)}")
        rng.shuffle(parts)
        out.append(" ".join(parts))
    return out


def test_field_adds_phones_without_prefix_and_keeps_base(spark, writeups, awkward):
    texts = sample_texts()
    fitted = pii.fit_on(writeups(list(enumerate(texts))))
    held_out = "call (456) 555-2186 or mail k@x.org, score 0.912345, fold 12, 2024-10-05"
    base, spans = pii.all_spans(held_out, fitted)
    assert (5, 19, "phone") in spans and set(base) <= set(spans) and len(spans) == 2
    rows = [*enumerate([*awkward, held_out]), (None, held_out), (3, held_out), (3, held_out)]
    out = pii.find_pii(writeups(rows), fitted).collect()
    assert len(out) == len(rows)
    flat = lambda spans: [(s["start"], s["end"], s["kind"]) for s in spans]
    assert sorted((str(r.entry_id), flat(r.base)) for r in out) == sorted((str(i), brute_base(t or "")) for i, t in rows)
    assert sum((5, 19, "phone") in flat(r.spans) for r in out) == 4
    empty = writeups([])
    assert pii.find_pii(empty, pii.fit_on(empty)).count() == 0
