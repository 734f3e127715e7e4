"""Decontamination, importance resampling and spelling variants against brute-force versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sqltraffic.llm import decontaminate, importance, spelling

WINDOWS = 10


def _tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def _contaminated(docs, items, n=WINDOWS):
    """Per document: words, hit places, items; each window looked for at each place."""
    found = []
    wins = [(str(i) if i is not None else "", w[k : k + n] if len(w) >= n else w) for i, t in items for w in [_tokens(t)] if w for k in range(max(1, len(w) - n + 1))]
    for d, text in docs:
        words, hit, which = _tokens(text), set(), set()
        for item, win in wins:
            for k in range(len(words) - len(win) + 1):
                if words[k : k + len(win)] == win:
                    hit |= set(range(k, k + len(win)))
                    which.add(item)
        found.append((d, len(words), frozenset(hit), tuple(sorted(which))))
    return Counter(found)


@pytest.mark.parametrize("at_once", [200_000, 7])
def test_decontamination(spark, at_once):
    """Against every place of every window: short items, shared windows, repeats, overlaps, nulls, cut-off words, very long texts; and in several passes."""
    rng = random.Random(6)
    vocab = ["a", "b", "Ab", "cé", "d1", "E", "日本", "x-y", "o'k"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([0, 1, 2, 3, 9, 10, 11, 14])))) for i in range(25)] + [(7, "a b a b a b a b a b a b"), (None, "solo wörd here"), (99, None), (98, "..."), (97, "a b a b a b a b a b a b")]
    items = [(i, t) for i, t in items if t is None or len(_tokens(t)) != 1] + [(50, "zzz")]
    texts = [" ".join(rng.choices(vocab, k=rng.randrange(60))) for _ in range(40)] + [None, "", "...", "zzz", "ZZZ.", "zzzz", "A.b\na b;a b a-b a b a B a b a b", "solo WÖRD here", "solo wörd here"]
    texts += [f"{'q ' * 5000}{t} {'r ' * rng.randrange(9000)}" for _, t in items[:6] if t]
    docs = [(i % 45, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS hits", "'x' AS items", "2 AS at", "3 AS row")
    given = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(df, given, at_once=at_once).collect()
    flat = Counter((r["row"]["doc_id"], r["n_words"], frozenset(k for h in r["hits"] for k in range(h["start"], h["end"])), tuple(r["items"])) for r in got)
    assert flat == _contaminated(docs, items)
    assert all(a["end"] < b["start"] for r in got for a, b in zip(r["hits"], r["hits"][1:], strict=False))
    clean = decontaminate.without_contaminated(df, given, at_once=at_once)
    assert clean.columns == df.columns and clean.count() == sum(n for (_, _, hit, _), n in flat.items() if not hit)
    assert decontaminate.contamination(df.limit(0), given).count() == 0
    assert all(not r["hits"] and not r["items"] for r in decontaminate.contamination(df, given.limit(0)).collect())


def test_importance_resampling(spark):
    """Against a plain version: nulls, short texts, ties of rows that repeat, very long texts, and pieces of texts."""
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["the", "Of", "x9", "né", "q-r"], k=rng.randrange(60))) for _ in range(120)] + [None, "", "word " * 30_000 + "z" * 3_000_000]
    docs = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5])] * 40 + [(None, texts[7])] * 3
    target = [(0, "the x9 the x9 né"), (1, None), (2, "q")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "0 AS score", "'a' AS at", "1 AS rank")

    def features(text):
        words = [w.encode() for w in _tokens(text)]
        return words + [a + b" " + b for a, b in zip(words, words[1:], strict=False)]

    s, t = Counter(), Counter()
    for side, rows in ((s, docs), (t, target)):
        for _, text in rows:
            side.update(zlib.crc32(f) % 10_000 for f in features(text))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000)))) for b in s}
    want = []
    for i, text in docs:
        f = features(text)
        weight = sum(gain[zlib.crc32(x) % 10_000] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(_tokens(text))])
    order = sorted((r for r in want if r[4] >= 20), key=lambda r: (-r[3], 1 << 64 if r[0] is None else r[0]))
    drawn = order[: 25 * len(order) // 100]
    got = importance.resample(df, spark.createDataFrame(target, "item_id long, text string"), keep=["doc_id", "score", "at", "rank"]).collect()
    assert Counter((r["row"]["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got) == Counter(tuple(r[:4]) for r in want)
    ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1)) and [(r["row"]["doc_id"], r["score"]) for r in ranked] == [(r[0], r[3]) for r in drawn]
    for percent in (0, 40, 77, 100):  # cuts through the rows that repeat, too
        again = importance.drawn(df, spark.createDataFrame(target, "item_id long, text string"), percent=percent)
        assert again.columns == df.columns and again.count() == percent * len(order) // 100
    assert importance.resample(df.limit(0), df).count() == 0 and importance.resample(df, df.limit(0)).count() == len(docs)


def test_least_is_the_smallest_that_holds_enough(spark):
    values = [-(1 << 60), -5, -5, 0, 3, 3, 3, 1 << 62]
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    assert [importance.least(rows, F.col("v"), n) for n in range(1, 9)] == sorted(values)


def _near_words(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("at_once", [8192, 2])
def test_spelling_variants(spark, at_once, monkeypatch):
    """Against all pairs of words: repeated letters, ties, chains of forms, very long words, slips; in one round of filters and in several."""
    if at_once == 2:
        monkeypatch.setattr(spelling, "SLAB", 200)
        monkeypatch.setattr(spelling, "COUNTED", 7)
    rng = random.Random(12)
    base = ["".join(rng.choices("abé", k=rng.randrange(5, 9))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "x" * 3000, "x" * 2999 + "y", "ÀBCDEF", "àbcdef", "÷×÷×÷×"]
    texts = [" ".join(w.upper() if rng.random() < 0.2 and w.isascii() else w for w in rng.choices(base, [1 + 40 * (i % 9 == 0) for i in range(len(base))], k=80)) for _ in range(50)] + [None, "", "1 2"] + ["x" * 3000 + "-" + "x" * 2999 + "y"] * 6
    docs = [(i % 40 if i % 11 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS n", "'w' AS word")
    counts = Counter()
    for i, t in docs:
        for w in re.findall("[A-Za-z\u00C0-\u00FF]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 19 == 0 else w] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    near = {w: [v for v in n if _near_words(w, v)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) if v else None for w, v in near.items()}
    form = {w: b if b and n[b] >= 5 * n[w] else None for w, b in best.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    want = {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}
    got = spelling.variants(spelling.word_counts(df, shortest=6, slips=19), at_once=at_once)
    assert {tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()} == want
    assert any(f and form[f] for f in form.values()) or any(form.values())
    assert spelling.variants(spelling.word_counts(df.limit(0))).count() == 0
