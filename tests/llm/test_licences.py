import random
import re

import pytest

from foldwise.llm import licences


def plain_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain_places(text):
    words = plain_words(text)
    out = []
    for label, phrase in licences.PHRASES.items():
        p = phrase.split()
        out += [(at, label) for at in range(len(words)) if words[at : at + len(p)] == p]
    return words, out


def files():
    rng = random.Random(1)
    filler = ["import", "fold", "the", "license", "model", "of", "mit", "general", "public", "é", "x1", "apache", "2", "version"]
    out = []
    for n in range(200):
        parts = [" ".join(rng.choices(filler, k=rng.randint(0, 60)))]
        if n % 2:
            name = rng.choice(sorted(licences.TEMPLATES))
            parts.append("# " + licences.TEMPLATES[name].upper().replace(" ", "\n * ", 2))
        parts.append(" ".join(rng.choices(filler, k=rng.randint(0, 20))))
        out.append(" ".join(parts))
    return out


def test_words_places_and_templates_against_plain_search(writeups, awkward):
    texts = files() + awkward
    out = {r.entry_id: r for r in licences.scan_licences(writeups(list(enumerate(texts)))).collect()}
    for n, text in enumerate(texts):
        words, found = plain_places(text)
        r = out[n]
        assert (r.n_words, r.places) == (len(words), sorted(p for p, _ in found))
        assert r.phrase_labels == sorted({label for _, label in found})
        # Templates: every place where all words but half stand, with all key phrases in their place.
        expected, best = set(), 0.0
        for name, template in licences.TEMPLATES.items():
            run = plain_words(template)
            for at in range(-len(run) + 1, len(words)):
                share = sum(0 <= at + k < len(words) and words[at + k] == w for k, w in enumerate(run)) / len(run)
                if share >= 0.99:
                    expected.add(name)
                    best = max(best, share)
        assert expected <= set(r.template_labels)
        for name in r.template_labels:
            joined = f" {' '.join(words)} "
            assert all(f" {' '.join(plain_words(k))} " in joined for k in licences.KEY_PHRASES[name])
        assert 0.0 <= r.score <= 1.0 and r.score >= best and (r.score > 0) == bool(r.places or r.template_labels)


def test_key_phrases_are_mandatory_and_place_matters():
    index = licences.LicenceIndex({"t": "alpha beta gamma delta epsilon zeta"}, {"t": ["gamma delta"]}, {})
    scan = lambda text: index.scan(licences.words_of(text.encode()))
    assert scan("x alpha beta gamma delta epsilon zeta")[2:] == (["t"], 1.0)
    assert scan("alpha beta gamma other delta epsilon zeta")[2] == []
    assert scan("zeta epsilon delta gamma beta alpha")[2] == []
    assert scan("beta gamma delta epsilon")[2:] == (["t"], pytest.approx(4 / 6))
    with pytest.raises(ValueError):
        licences.LicenceIndex({"t": "a b"}, {"t": ["c"]}, {})


def test_rarity_counts_all_records(writeups):
    rows = [(n, "the license" if n % 4 == 0 else "the") for n in range(100)] + [(None, None)]
    rarity = licences.licence_word_rarity(writeups(rows), {b"the", b"license", b"never"})
    assert rarity[b"never"] > rarity[b"license"] > rarity[b"the"]


def test_repeated_and_empty(writeups):
    rows = [(1, "MIT License"), (1, "MIT License"), (None, "mit-license")]
    out = licences.scan_licences(writeups(rows)).collect()
    assert [r.places for r in out] == [[0]] * 3 and licences.scan_licences(writeups([])).count() == 0
