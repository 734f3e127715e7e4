"""The pipeline stage by stage on a small table, against what each stage has to keep."""

import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import pyarrow as pa
from test_operators import SCHEMA, _blankless, _docs, _near  # noqa: F401


def _check_packed(rows, docs):
    """Every document's ids are there once and whole, sequences are gapless, and those of few documents follow the mix."""
    from sqltraffic.llm.queries import vocabulary
    from sqltraffic.llm.token_ids import Encoder

    encode = Encoder(vocabulary()).encode
    want = Counter()
    for r in docs:
        ids, at = encode(pa.array([r[1]], pa.string()))
        whole = ids.tobytes() + b"\0\0\0\0"
        start = 0
        for k, stop in enumerate(range((len(whole) // 4 - 1) % 2048 + 1, len(whole) // 4 + 1, 2048)):
            want[(r[0], k, start, stop - start, zlib.crc32(whole[4 * start : 4 * stop]))] += 1
            start = stop
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    for s in {r["sequence_id"] for r in rows}:
        own = sorted((r["offset"], r["length"]) for r in rows if r["sequence_id"] == s)
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 2048


def test_stages(spark, tmp_path):
    rows = [r[:5] for r in _docs()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns
        docs.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        kept.append([tuple(r) for r in docs.collect()])
    lettered = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(kept[0], key=key) == sorted(((r[0], r[1], "en", *r[3:]) for r in lettered), key=key)
    assert Counter(_blankless(r[1]) for r in kept[1]) == Counter({_blankless(r[1]) for r in lettered})
    stay = Counter(i for i, _, c in _near(kept[1]) if i is None or i == c)
    assert Counter(r[0] for r in kept[2]) == stay
    words = lambda rs: sum(len(re.findall(r"\S+", r[1])) for r in rs)
    assert abs(words(kept[3]) - words(kept[2])) <= 4
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert packed.where("length > 2048").count() == 0
    _check_packed(packed.collect(), kept[3])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == packed.count()


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_table_without_labels(spark, tmp_path):
    """With no language to learn, none can be told; the stage keeps nothing."""
    docs = spark.createDataFrame([(1, "some words", None, "s", 10)], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.keep_languages(spark, docs, str(tmp_path)).count() == 0


def test_near_copies_are_dropped_by_few_pairs(spark, monkeypatch):
    """The stage's join compares a large group of near copies in about as many pairs as it has copies; all that stay are unlike."""
    from sqltraffic.llm import ngram_join

    rng = random.Random(3)
    base = [f"w{rng.randrange(900)}" for _ in range(150)]
    texts = [" ".join(base)]
    for _ in range(400):
        words = list(base)
        for i in rng.sample(range(150), rng.randint(1, 6)):
            words[i] = f"x{rng.getrandbits(40)}"
        texts.append(" ".join(words))
    compared, possible = [], ngram_join.possible

    def counted(pairs, marks):
        compared.append(pairs.count())
        return possible(pairs, marks)

    monkeypatch.setattr(ngram_join, "possible", counted)
    left = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "").collect()
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (r["text"].split() for r in left)]
    assert 0 in {r["doc_id"] for r in left} and len(left) < 250
    assert not any(100 * len(a & b) >= 80 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert sum(compared) < 3 * len(texts)
