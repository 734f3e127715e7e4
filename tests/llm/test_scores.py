"""Scores of quality and toxicity against plain versions: a convolution place by place, and a kernel over all subsequences."""

import functools
import itertools
import random
import unicodedata

import numpy as np
import pytest

from sqltraffic.llm import quality_classifier as quality
from sqltraffic.llm import toxicity


def _scores(spark, texts, apply, model):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "0 AS score", "'r' AS row", "1 AS row_number")
    got = apply(df, model).select("row.doc_id", "score").collect()
    assert len(got) == len(texts)
    return [r["score"] for r in sorted(got, key=lambda r: r["doc_id"])]


def _plain_quality(net, text):
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    n = max(1, len(raw))
    raw = np.append(raw, np.zeros(quality.WIDTH + 1, np.uint8))
    at_place = np.array([sum(net.filters[j][raw[i + j]].astype(float) for j in range(quality.WIDTH)) for i in range(n)])
    segments = [at_place[k : k + quality.SEGMENT] for k in range(0, n, quality.SEGMENT)]
    chunks = segments if len(segments) == 1 else [np.vstack(pair) for pair in itertools.pairwise(segments)]
    h = np.array([np.tanh(c.max(0) + net.bias) for c in chunks])
    z = np.append(h.mean(0), h.max(0)) @ net.weights + net.offset
    return 1 / (1 + np.exp(-z))


def test_quality_is_a_convolution_over_whole_texts(spark):
    rng = np.random.default_rng(2)
    net = quality.ByteNetwork(rng.normal(size=(quality.WIDTH, 256, quality.FILTERS)).astype(np.float32), rng.normal(size=quality.FILTERS), rng.normal(size=2 * quality.FILTERS), 0.3)
    words = ["plain", "wörter", "日本", "x", "...", "\n"]
    texts = [None, "", "z", *["a" * n for n in (255, 256, 257, 512, 513)], *[" ".join(rng.choice(words, n)) for n in (3, 90, 400, 3000)], "b" * 30_000 + "!"]
    assert _scores(spark, texts, quality.quality, net) == pytest.approx([_plain_quality(net, t) for t in texts], abs=1e-5)


def _letter(c):
    if c in toxicity.LOOKALIKES:
        c = toxicity.LOOKALIKES[c]
    if not c.isalpha():
        return 0
    base = c if c.lower() in toxicity.OWN_LETTERS else unicodedata.normalize("NFD", c)[0].lower()
    return ord(base) - 96 if "a" <= base <= "z" else toxicity.LETTERS - 1


def _plain_strings(text):
    """The letters of each string: words, and single letters that are spaced out as one."""
    strings, spaced = [], []
    for word in [*(text or "").split(), "##"]:
        letters = [x for x in map(_letter, word) if x]
        if len(word) == 1:
            spaced += letters
            continue
        if spaced:
            strings.append(spaced)
        spaced = []
        if letters:
            strings.append(letters)
    half = toxicity.LONGEST // 2
    return [p for s in strings for p in ([s] if len(s) <= toxicity.LONGEST else [s[k : k + 2 * half] for k in range(0, len(s), half)])]


def _plain_value(machine, letters):
    own = [0, *letters, 0]
    total = 0.0
    for places in itertools.combinations(range(len(own)), 4):
        span = places[3] - places[0]
        if span <= toxicity.REACH:
            index = 0
            for p in places:
                index = index * toxicity.LETTERS + own[p]
            total += toxicity.DECAY**span * machine.sequences[index]
    steps = [f for f in range(3, toxicity.REACH + 1) for _ in itertools.combinations(range(1, f), 2)]
    norm = sum(max(len(own) - f, 0) * toxicity.DECAY ** (2 * f) for f in steps)
    return total / np.sqrt(max(norm, toxicity.DECAY**6)) + machine.offset


def test_toxicity_is_a_kernel_over_all_subsequences(spark):
    rng, pick = np.random.default_rng(5), random.Random(5)
    machine = toxicity.KernelMachine(rng.normal(size=toxicity.SEQUENCES) * 0.3, -0.2, np.array([1.5, 0.7, 0.2]), -0.4)
    word = lambda: "".join(pick.choice("abcdeéñß.-4$") for _ in range(pick.choice([2, 3, 5, 9, 14])))
    texts = [None, "", "a", "ab", "s p a c e d out", "f.o.u.l", "x" * 30, "abcdefghijklmnopqrstuvwxyzabcdefghij", *[" ".join(word() for _ in range(n)) for n in (1, 4, 30)], " ".join(["tail"] * 5000 + ["w0rst"])]
    want = []
    for text in texts:
        value = functools.cache(lambda letters: _plain_value(machine, letters))
        worst = sorted((value(tuple(s)) for s in _plain_strings(text)), reverse=True)[: toxicity.WORST]
        top = np.clip([*worst, *[machine.offset] * toxicity.WORST][: toxicity.WORST], -1, 1)
        want.append(1 / (1 + np.exp(-(top @ machine.slopes + machine.height))))
    assert _scores(spark, texts, toxicity.toxicity, machine) == pytest.approx(want, abs=1e-6)


def test_sentences_and_their_worst_strings():
    texts = ["You fool! Go home. Plain words", "", "one line\nno stop.here a b c", "Plain? words; plain words", "..."]
    y = np.array([1.0, 0, 1, 0, 0])
    got = toxicity._Sentences(texts, y)
    plain = [["you", "fool"], ["go", "home"], ["plain", "words"], ["one", "line"], ["no", "stophere", "abc"], ["plain"], ["words", "plain", "words"]]
    letters = lambda word: [ord(c) - 96 for c in word]
    ends = [*got.first[1:], len(got.string)]
    assert [[got.distinct[i].tolist() for i in got.string[a:b]] for a, b in zip(got.first, ends, strict=True)] == [[letters(w) for w in s] for s in plain]
    assert got.doc.tolist() == [0, 0, 0, 2, 2, 3, 3] and got.toxic.tolist() == [True] * 5 + [False] * 2
    number = {tuple(s.tolist()): i for i, s in enumerate(got.distinct)}
    of = lambda word: number[tuple(letters(word))]
    assert [got.in_toxic[of("plain")], got.in_clean[of("plain")], got.clean[of("plain")], got.clean[of("words")], got.clean[of("fool")]] == [1, 1, 2, 1, 0]
    value = np.array([len(s) for s in got.distinct], float)
    worst, top = got.worst(value)
    assert [got.distinct[i].tolist() for i in worst] == [letters(max(s, key=len)) for s in plain] and top.tolist() == [max(map(len, s)) for s in plain]


def test_toxicity_is_learned_from_sentences():
    pick = random.Random(9)
    word = lambda: "".join(pick.choice("aeinorst") for _ in range(pick.choice([3, 5, 7])))
    sentence = lambda *more: " ".join(pick.sample([*[word() for _ in range(8)], *more], 8 + len(more))) + "."
    bad = ["gulbwick", "fezzpug"]
    texts = [" ".join(sentence(*([pick.choice(bad), pick.choice(bad)] if toxic and k < 2 else [])) for k in range(5)) for toxic in (1, 0) for _ in range(80)]
    y = np.repeat([1.0, 0.0], 80)
    machine = toxicity.train(texts, y, np.ones(len(texts)))
    score = lambda t: float((toxicity._clipped(machine, [t]) @ machine.slopes + machine.height)[0])
    clean = sentence() + " " + sentence()
    for form in ("gulbwick", "gulb-wick", "g u l b w i c k", "gulbxwick", "GULBWICK", "fezzpugg"):
        assert score(f"{clean} {form} {form}. {form}") > 0 > score(clean)


def test_toxicity_with_nothing_to_learn():
    for texts, y in ([], []), (["", ""], [1, 0]), (["a", ""], [1, 0]), (["same words here"] * 4, [1, 1, 0, 0]):
        machine = toxicity.train(list(texts), np.array(y, float), np.ones(len(y)))
        z = toxicity._clipped(machine, ["", "same words here"]) @ machine.slopes + machine.height
        assert np.isfinite(z).all()
