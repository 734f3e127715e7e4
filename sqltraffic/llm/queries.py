"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import importance, license_scan, quality_classifier, spelling, toxicity
from .binary_records import record_digest
from .common import crc_mod, table
from .decontaminate import contamination, n_hit
from .exact_dedup import duplicate_groups
from .language_id import identify, learn
from .embedding_dedup import near_duplicates
from .mixing import taken_words
from .ngram_join import jaccard_components
from .packing import pack

#: Tokens in a packed sequence.
SEQUENCE = 2048


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """A public vocabulary file's place on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    judged = identify(docs.select("doc_id", "text"), learn(docs, ~held_out))
    return judged.select("row.doc_id", (crc_mod(F.col("row.doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op3_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_digest(table(spark, sf_dir, "documents"), vocabulary())


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary(), SEQUENCE)


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def _labelled(spark: SparkSession, sf_dir: str, label: str, chars: int, n: int) -> tuple:
    learnable = crc_mod(F.col("doc_id"), 5) != 0
    return quality_classifier.labelled_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), label, learnable, n, chars)


def _predicted(rows: DataFrame, threshold: float) -> DataFrame:
    held_out = (crc_mod(F.col("row.doc_id"), 5) == 0).alias("held_out")
    return rows.select("row.doc_id", held_out, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = quality_classifier.train(*_labelled(spark, sf_dir, "quality", quality_classifier.TRAIN_CHARS, quality_classifier.TRAIN_DOCS))
    return _predicted(quality_classifier.quality(table(spark, sf_dir, "documents").select("doc_id", "text"), net), 0.3)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    machine = toxicity.train(*_labelled(spark, sf_dir, "toxic", toxicity.TRAIN_CHARS, toxicity.TRAIN_DOCS))
    return _predicted(toxicity.toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), machine), 0.5)


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "row.doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated")
    )


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("row.doc_id", "n_features", "weight", "score", "rank")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = spelling.word_counts(table(spark, sf_dir, "documents"), shortest=6, slips=199)
    return spelling.variants(counts).select("word", "form", "root", "n", "n_near", "form_n")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_embedding_dedup, op3_binary_records, op4_license_scan, op5_mixing, op6_exact_dedup, op7_best_fit_packing, op8_ngram_jaccard, op9_quality, op10_toxicity, op11_decontamination, op12_importance, op13_spelling)}


def _license_sql() -> str:
    """One subquery for each rule, since what a rule matched is gone for the next."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    mapped = lambda table: "map {" + ", ".join(f"{text(k)}: {text(v)}" for k, v in table.items()) + "}"
    known, followers = mapped(license_scan.SENTENCES), mapped({f"{a} {b}": i for (a, b), i in license_scan.FOLLOWERS.items()})
    whole = mapped(license_scan.SENTENCES | {b: i for (_, b), i in license_scan.FOLLOWERS.items()})
    tags = mapped({k.replace(" or later", " later"): v for k, v in license_scan.TAGS.items()})
    clean = "x"
    for sign in (license_scan.SIGNS, license_scan.DOTS_BEFORE, license_scan.DOTS_AFTER):
        clean = f"regexp_replace({clean}, {text(sign)}, ' ', 'g')"

    def slotted(x: str) -> str:
        for begins, found, put in license_scan.SLOTS:
            x = f"(CASE WHEN starts_with({x}, {text(begins)}) THEN regexp_replace({x}, {text(found)}, {text(put)}) ELSE {x} END)" if begins else f"regexp_replace({x}, {text(found)}, {text(put)})"
        return x

    lines = f"list_filter(list_transform(string_split(p, chr(10)), lambda x: trim({clean})), lambda x: x <> '')"
    parts = f"regexp_split_to_array(replace(regexp_replace(x, {text(license_scan.EXCEPTION)}, '', 'g'), ' or later', ' later'), {text(license_scan.JOINS)})"
    sql = f"""
      SELECT doc_id, ids, list_aggregate(list_transform(ids, lambda x: coalesce('<' || x || '>', '.')), 'string_agg', '') AS rest, []::VARCHAR[] AS found
      FROM (SELECT doc_id, flatten(list_transform(seq, lambda x, i: CASE WHEN i > 1 AND {known}[seq[i - 1]] = {text(license_scan.TAG_NAME)} THEN list_transform({parts}, lambda y: {tags}[y])
                                                                   ELSE [coalesce({known}[x], CASE WHEN i > 1 THEN {followers}[{known}[seq[i - 1]] || ' ' || x] END)] END)) AS ids
            FROM (SELECT doc_id, flatten(list_transform(own, lambda l: CASE WHEN len(l) > 1 AND {whole}[{slotted("array_to_string(l, ' ')")}] IS NOT NULL
                                                                            THEN [{slotted("array_to_string(l, ' ')")}] ELSE list_transform(l, lambda x: {slotted("x")}) END)) AS seq
                  FROM (SELECT doc_id, list_transform(regexp_split_to_array(lower(coalesce(text, '')), {text(license_scan.SENTENCE_END)}), lambda p: {lines}) AS own FROM documents)))"""
    for name, needs in license_scan.RULES:
        rule = text(license_scan.pattern(needs))
        sql = f"""
      SELECT doc_id, ids, regexp_replace(rest, {rule}, '.', 'g') AS rest,
             CASE WHEN regexp_matches(rest, {rule}) AND NOT list_contains(found, {text(name)}) THEN list_append(found, {text(name)}) ELSE found END AS found
      FROM ({sql})"""
    return f"""
      SELECT doc_id, count(x) AS n_sentences, coalesce(string_agg(x, ',' ORDER BY i), '') AS sentence_ids, any_value(licenses) AS licenses
      FROM (SELECT doc_id, unnest(list_append(ids, NULL)) AS x, generate_subscripts(list_append(ids, NULL), 1) AS i, array_to_string(found, ',') AS licenses FROM ({sql}))
      GROUP BY doc_id"""


#: The crc32 of a list of bytes `b`, with the table of all bytes' remainders as `t`.
_CRC = "xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"
_CRC_TABLE = "SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t"
_BYTES = "list_transform(range(octet_length(encode({x}))), lambda i: ('0x' || substr(hex(encode({x})), 2 * i + 1, 2))::BIGINT)"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES = {
    "op11_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS words FROM benchmark),
w AS (
  SELECT DISTINCT item, least(10, len(words)) AS k, array_to_string(words[s:s + least(10, len(words)) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS s FROM i WHERE len(words) > 0)),
p AS (
  SELECT r, s, k, array_to_string(words[s:s + k - 1], ' ') AS win
  FROM (SELECT r, words, k, unnest(range(1, len(words) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM w))),
o AS MATERIALIZED (SELECT r, s, p.k, item FROM p JOIN w ON p.k = w.k AND p.win = w.win),
h AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS place FROM (SELECT DISTINCT r, s, k FROM o)) GROUP BY r),
n AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM o) GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN n USING (r)
""",
    "op12_importance": f"""
WITH t AS ({_CRC_TABLE}),
a AS (
  SELECT 0 AS side, row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, {_WORDS} FROM benchmark),
f AS MATERIALIZED (
  SELECT side, r, unnest(words) AS feature FROM a
  UNION ALL SELECT side, r, words[i] || ' ' || words[i + 1] FROM (SELECT side, r, words, unnest(range(1, len(words))) AS i FROM a)),
c AS MATERIALIZED (
  SELECT feature, {_CRC} % 10000 AS bucket FROM (SELECT feature, {_BYTES.format(x="feature")} AS b FROM (SELECT DISTINCT feature FROM f)), t),
n AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM f JOIN c USING (feature) GROUP BY bucket),
z AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s_all, coalesce(sum(t), 0)::DOUBLE AS t_all FROM n),
g AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM n, z),
w AS (SELECT r, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN c USING (feature) JOIN g USING (bucket) WHERE side = 0 GROUP BY r),
x AS (
  SELECT r, doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM a LEFT JOIN w USING (r) WHERE side = 0),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM x WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 25 * count(*) // 100 FROM k) THEN rank END AS rank FROM x LEFT JOIN k USING (r)
""",
    "op13_spelling": rf"""
WITH RECURSIVE t AS ({_CRC_TABLE}),
r AS MATERIALIZED (
  SELECT id, word, count(*) AS n
  FROM (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all({_LOWER}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS word FROM documents)
  WHERE length(word) >= 6 GROUP BY ALL),
h AS (SELECT word, n, {_CRC} AS h FROM (SELECT word, n, {_BYTES.format(x="(id || ':' || word)")} AS b FROM r), t),
w AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN left(word, h % length(word)) || substr(word, h % length(word) + 2) ELSE word END AS word, n FROM h)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
e AS MATERIALIZED (SELECT word, n, i, left(word, i) AS head, substr(word, i + 2) AS tail FROM (SELECT *, unnest(range(length(word))) AS i FROM w)),
p AS (
  SELECT x.word AS a, y.word AS b, y.n AS n FROM e x JOIN e y ON x.i = y.i AND x.head = y.head AND x.tail = y.tail AND x.word <> y.word
  UNION SELECT e.word, w.word, w.n FROM e JOIN w ON e.head || e.tail = w.word
  UNION SELECT w.word, e.word, e.n FROM e JOIN w ON e.head || e.tail = w.word),
b AS (SELECT a AS word, count(*) AS n_near, first(b ORDER BY n DESC, b) AS near, max(n) AS near_n FROM p GROUP BY a),
f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM w LEFT JOIN b USING (word)),
s AS (SELECT word, word AS root FROM f UNION ALL SELECT s.word, f.form FROM s JOIN f ON f.word = s.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, s.root, f.n, f.n_near, f.form_n FROM f JOIN s ON s.word = f.word JOIN f AS l ON l.word = s.root AND l.form IS NULL
""",
    "op2_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x, list_aggregate(list_transform(embedding, lambda c: c::DOUBLE * c), 'sum') AS norm FROM embeddings),
f AS (SELECT vec_id, label, x, sqrt(norm) AS norm FROM v WHERE label IS NOT NULL AND norm > 0 AND isfinite(norm) AND len(list_filter(x, lambda c: c IS NULL)) = 0),
e AS MATERIALIZED (
  SELECT p.vec_id AS a, q.vec_id AS b FROM f p JOIN f q ON p.label = q.label AND p.vec_id <> q.vec_id
  WHERE list_dot_product(p.x, q.x) / (p.norm * q.norm) >= 0.93),
r AS (SELECT a AS vec_id, a AS reached FROM e UNION SELECT r.vec_id, e.b FROM r JOIN e ON e.a = r.reached),
c AS (SELECT vec_id, min(reached) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM e GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
""",
    "op4_license_scan": _license_sql(),
    "op5_mixing": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM d GROUP BY source),
w AS (SELECT *, (number % 3 + 1)::DOUBLE AS weight FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS shared,
         row_number() OVER r AS room
  FROM w WINDOW r AS (ORDER BY source_size / weight, number)),
level AS (SELECT arg_min(shared, room) AS unit FROM l WHERE shared * weight <= 3 * source_size),
t AS (SELECT source, source_size, least(unit * weight, (3 * source_size)::DOUBLE) AS target FROM l, level),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS goal,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(d.doc_id::VARCHAR), d.doc_id
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, goal - pos)) + greatest(0, least(size, goal - source_size - pos))
        + greatest(0, least(size, goal - 2 * source_size - pos)))::BIGINT AS taken
FROM p
""",
    "op8_ngram_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + least(5, len(words)) - 1], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - least(5, len(words)) + 2)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS reached FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached),
c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
""",
    "op6_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
