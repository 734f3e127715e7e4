import random
import re

import pytest
from pyspark.sql import functions as F

from sqltraffic.functions import network, statements

DIGESTS = [
    ("SELECT * FROM users WHERE id = 1 AND age > 25", "select * from users where id = ? and age > ?"),
    ("UPDATE users SET score = 99.5 WHERE id = 3", "update users set score = ? where id = ?"),
    ("INSERT INTO users (name) VALUES ('it''s a test')", "insert into users (name) values (?)"),
    ('SELECT * FROM users WHERE name = "alice"', "select * from users where name = ?"),
    ("SELECT * FROM users WHERE id IN (1, 2, 3)", "select * from users where id in (?)"),
    ("  SELECT   *   FROM   users  ", "select * from users"),
    ("-- app annotation\nSELECT 1", "select ?"),
    ("SELECT * FROM users /* hint */ WHERE id = 1", "select * from users where id = ?"),
    ("SELECT * FROM users WHERE token = 0xDEADBEEF", "select * from users where token = ?"),
    ("", ""),
    (None, ""),
    ("SELECT MIN(x) FROM t0 JOIN (SELECT 1) y", "select min(?) from t? join (?) y"),
    ("-0x1F", "?x?f"),
    ("SELECT 1end", "select ?nd"),
    ("a IN (f(1), 'x)y')", "a in (?)"),
    ("a IN\n(1)", "a in (?)"),
]

CATEGORIES = [
    ("SELECT 1", "Select"), ("  select * from t", "Select"), ("DESC users", "Select"), ("WITH c AS (SELECT 1) SELECT 1", "Select"), ("SELECT", "Select"),
    ("SET @x = 1", "SessionState"), ("DO SLEEP(0)", "SessionState"), ("DEALLOCATE PREPARE s", "SessionState"), ("SET@x", "Unknown"), ("SELECT*", "Unknown"),
    ("CREATE TEMPORARY TABLE t (x INT)", "TempTable"), ("ALTER TEMPORARY TABLE t ADD y INT", "TempTable"),
    ("BEGIN", "Transaction"), ("start  transaction READ ONLY", "Transaction"), ("RELEASE SAVEPOINT s", "Transaction"),
    ("REPLACE INTO u VALUES (1)", "DML"), ("LOAD DATA INFILE 'x'", "DML"), ("-- note\nINSERT INTO t VALUES (1)", "DML"),
    ("CREATE TABLE t (x INT)", "DDL"), ("TRUNCATE users", "DDL"), ("CALL p()", "Admin"), ("RESET CONNECTION", "Admin"),
    ("SELECTIVE", "Unknown"), ("", "Unknown"), ("/* only a comment */", "Unknown"), ("/* open", "Unknown"), ("/*/ SELECT 1", "Select"),
]

TARGETS = [
    ("INSERT INTO users VALUES (1)", "users"), ("INSERT IGNORE INTO `My`.`Users` VALUES (1)", "users"), ("REPLACE t VALUES (1)", "t"), ("UPDATE db.t SET a = 1", "t"),
    ("UPDATE LOW_PRIORITY t SET a = 1", "low_priority"), ("DELETE FROM t WHERE 1", "t"), ("DELETE a FROM a JOIN b", ""), ("UPDATE a JOIN b ON 1 SET x = 1", ""),
    ("DROP TABLE IF EXISTS t", "t"), ("TRUNCATE TABLE t", "t"), ("ALTER TABLE t ADD x INT", "t"), ("CREATE TABLE t (x INT)", ""), ("SELECT 1", ""),
]


def _values(spark, texts, expression):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, q string")
    return [r[1] for r in rows.select("i", expression(F.col("q"))).orderBy("i").collect()]


def test_digest(spark):
    got = _values(spark, [q for q, _ in DIGESTS], statements.digest)
    assert got == [d for _, d in DIGESTS]


def test_digest_of_large_statements(spark):
    long = ["SELECT '" + "x" * 1_000_000 + "'", "SELECT '" + "''" * 20_000 + "'", "SELECT 1 WHERE a IN (" + ", ".join(map(str, range(100_000))) + ")"]
    assert _values(spark, long, statements.digest) == ["select ?", "select ?", "select ? where a in (?)"]


def test_category(spark):
    assert _values(spark, [q for q, _ in CATEGORIES], statements.category) == [c for _, c in CATEGORIES]


def test_write_target(spark):
    assert _values(spark, [q for q, _ in TARGETS], statements.write_target) == [t for _, t in TARGETS]


@pytest.mark.parametrize(
    ("cidrs", "inside", "outside"),
    [(["10.0.0.0/8"], ["10.1.2.3"], ["11.0.0.1"]), (["10.0.5.0/24"], ["10.0.5.255"], ["10.0.6.0"]), (["2001:db8::/32"], ["2001:db8::1", "2001:DB8:0:0:0:0:0:9"], ["2001:db9::1", "10.0.0.1"])],
)
def test_networks(spark, cidrs, inside, outside):
    test = lambda a: network.inside_any(a, cidrs)
    assert _values(spark, inside + outside, test) == [True] * len(inside) + [False] * len(outside)
    assert _values(spark, ["", "no address", "1.2.3", "::1::", None], test) == [None] * 5


def test_bad_network():
    with pytest.raises(ValueError):
        network.networks(["10.0.0.0/99"])


def test_host(spark):
    assert _values(spark, ["1.2.3.4:56", "1.2.3.4", "[::1]:80", "::1"], network.host) == ["1.2.3.4", "1.2.3.4", "::1", "::1"]


def _squeezed(query):
    """A slow model of IN lists alone: the list ends where its parentheses do."""
    out, i = "", 0
    while i < len(query):
        if query[i : i + 4] == "in (":
            depth, i = 1, i + 4
            while depth and i < len(query):
                depth += {"(": 1, ")": -1}.get(query[i], 0)
                i += 1
            out += "in (?)"
        else:
            out += query[i]
            i += 1
    return out


def test_deep_in_lists(spark):
    import random

    rng = random.Random(5)
    nested = lambda d: "x" if not d else "(" + ", ".join(nested(d - 1 if j == 0 else rng.randrange(d)) for j in range(rng.randint(1, 2))) + ")"
    cases = [f"select a from t where b in {nested(d)} and c = d" for d in [*range(1, 12), 40, 150]]
    assert _values(spark, cases, statements.digest) == [_squeezed(c) for c in cases]


def _quoted_end(q, at, sign):
    """Behind a quoted text that begins at `at`: a doubled sign and a backslashed one do not end it."""
    at += 1
    while at < len(q):
        if q[at] == "\\" and at + 1 < len(q):
            at += 2
        elif q[at] == sign and q[at + 1 : at + 2] == sign:
            at += 2
        elif q[at] == sign:
            return at + 1
        else:
            at += 1
    return at


def _list_end(q, at):
    """Behind the parenthesis that closes a list whose inside begins at `at`. Inside, a backslash takes the next sign with it only in single quotes."""
    depth = 1
    while at < len(q) and depth:
        if q[at] == "'":
            at += 1
            while at < len(q) and q[at] != "'":
                at += 2 if q[at] == "\\" else 1
        elif q[at] in "()":
            depth += 1 if q[at] == "(" else -1
        at += 1
    return min(at, len(q))


def _number_end(q, at):
    digits = "0123456789"
    if q[at] == "0" and q[at + 1 : at + 2] in ("x", "X"):
        at += 2
        while q[at : at + 1] and q[at] in digits + "abcdefABCDEF":
            at += 1
        return at
    at += q[at] == "-"

    def run(at):
        while q[at : at + 1] and q[at] in digits:
            at += 1
        return at

    at = run(at)
    if q[at : at + 1] == ".":
        at = run(at + 1)
    if q[at : at + 1] and q[at] in "eE":
        at += 1
        at = run(at + 1 if q[at : at + 1] in ("+", "-") and q[at : at + 1] else at)
    return at


def _slow_digest(q):
    """Sign by sign, by the rules as they are told."""
    q, out, at = q.strip(), "", 0
    while at < len(q):
        c, rest = q[at], q[at:]
        if rest.startswith("/*"):
            end = q.find("*/", at + 2)
            at = len(q) if end < 0 else end + 2
        elif rest.startswith("--") and (len(rest) == 2 or rest[2] in " \t\n"):
            end = q.find("\n", at)
            at = len(q) if end < 0 else end
        elif c in " \t\n\r":
            out, at = out + " ", at + 1
        elif c in "'\"":
            out, at = out + "?", _quoted_end(q, at, c)
        elif c in "0123456789" or c == "-" and rest[1:2] and rest[1] in "0123456789" and (at == 0 or q[at - 1] in "=(,><+-*/ \t\n\r"):
            out, at = out + "?", _number_end(q, at)
        elif rest[:2].upper() == "IN" and rest[2:].lstrip(" \t").startswith("("):
            inside = q.index("(", at) + 1
            out, at = out + rest[:2] + " " * (inside - 1 - at - 2) + "(?)", _list_end(q, inside)
        else:
            out, at = out + c, at + 1
    out = out.strip(" ").lower()
    while "  " in out:
        out = out.replace("  ", " ")
    return out


PARTS = ["select", "IN", "in (", "iN\t(", "IN\n(", "(", ")", "((", "'", "''", '"', "\\", "a", "x1", "_", "0x1F", "0xg", "12", "3.5", "1e5", "2E-", ".", "-", "-7", "--", "-- c\n", "--x", "/*", "*/", "/", "*", "=", ",", " ", "  ", "\t", "\n", "\r", ";", "é", "join", "min(1)"]


def test_digest_fuzz(spark):
    """Against a slow model of all rules: the native form as deep as it goes, the exact one at any depth."""
    rng = random.Random(11)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 25))) for _ in range(4000)]
    texts += ["a in " + "(" * n + "1, ')', (2" + ")" * rng.randrange(n + 2) + " b" for n in (1, 5, 6, 7, 8, 150, 199)]
    want = [_slow_digest(q) for q in texts]
    for exact in (False, True):
        got = _values(spark, texts, lambda q: statements.digest(q, exact))  # noqa: B023
        assert [(q, g, w) for q, g, w in zip(texts, got, want, strict=True) if g != w] == []
    scanned = [re.sub(" {2,}", " ", statements.scan(q.strip()).lower().strip(" ")) for q in texts]
    assert [(q, g, w) for q, g, w in zip(texts, scanned, want, strict=True) if g != w] == []


def test_exact_digest_of_deep_lists(spark):
    deep = ["SELECT 1 WHERE a IN " + "(" * n + "'x)', 2" + ")" * n + " AND b = 'c'" for n in (201, 250, 10_000)]
    deep += ["a IN (" + "(" * 500 + "1" + ")" * 400, "(" * 300 + "a = 1" + ")" * 300]
    assert _values(spark, deep, lambda q: statements.digest(q, exact=True)) == ["select ? where a in (?) and b = ?"] * 3 + ["a in (?)", "(" * 300 + "a = ?" + ")" * 300]
    assert _values(spark, [None, "", "select 1"], lambda q: statements.digest(q, exact=True)) == ["", "", "select ?"]
