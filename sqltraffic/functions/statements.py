"""Column expressions over one SQL statement: fingerprint, class, target, names of temporary tables."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fingerprint -----------------------------------------------------------------------------
_SINGLE = r"'[^'\\]*+(?:(?:''|\\[\s\S])[^'\\]*+)*+\\?'?"
_DOUBLE = r'"[^"\\]*+(?:(?:""|\\[\s\S])[^"\\]*+)*+\\?"?'
#: Quoted text as an IN list's end is looked for: there only single quotes count.
_IN_QUOTED = r"'[^'\\]*+(?:\\[\s\S][^'\\]*+)*+\\?(?:'|\z)"
#: How deep parentheses may be nested in an IN list: in statements of so few of them, and in all others.
IN_DEPTH, DEEPEST = 6, 200


def _in_body(depth: int) -> str:
    inner = _IN_QUOTED if not depth else rf"{_IN_QUOTED}|\({_in_body(depth - 1)}(?:\)|\z)"
    return rf"[^()']*+(?:(?:{inner})[^()']*+)*+"


#: The token kinds in the order in which they are tried at each place of a statement; {} is an IN list's inside.
_TOKENS = "|".join([
    r"/\*[\s\S]*?(?:\*/|\z)",
    r"--(?=[ \t\n]|\z)[^\n]*+",
    r"[ \t\n\r]++",
    _SINGLE,
    _DOUBLE,
    r"0[xX][0-9a-fA-F]*+",
    r"(?:(?:\A|(?<=[=(,><+*/\s-]))-)?[0-9]++(?:\.[0-9]*+)?(?:[eE][+-]?[0-9]*+)?",
    r"[iI][nN][ \t]*+\({}(?:\)|\z)",
    r"""[^ \t\n\r'"0-9/iI-]++""",
    r"[\s\S]",
])


TOKENS, DEEP_TOKENS = (_TOKENS.replace("{}", _in_body(depth)) for depth in (IN_DEPTH, DEEPEST))


def _replaced(token: Column) -> Column:
    first, two = F.substring(token, 1, 1), F.substring(token, 1, 2)
    return (
        F.when((two == "/*") | token.rlike(r"\A--(?:[ \t\n]|\z)"), F.lit(""))
        .when(first.isin(" ", "\t", "\n", "\r"), F.lit(" "))
        .when(first.isin("'", '"') | token.rlike(r"\A-?[0-9]"), F.lit("?"))
        .when(token.rlike(r"\A[iI][nN][ \t]*+\("), F.concat(F.translate(F.regexp_extract(token, r"\A([iI][nN][ \t]*+)", 1), "\t", " "), F.lit("(?)")))
        .otherwise(token)
    )


def _open_parentheses(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("("), F.lit("")))


def _squeezed(joined: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(joined)), " {2,}", " ")


def digest(query: Column, exact: bool = False) -> Column:
    """The statement with literals as `?`, comments removed, blanks squeezed, in lower case.

    IN lists may be nested DEEPEST deep. With `exact`, statements of more parentheses than that go through a scanner in Python workers, which
    has no such bound; the others stay native, and are sent there as nulls.
    """
    trimmed = F.regexp_replace(F.coalesce(query, F.lit("")), r"\A[\s\x85\xA0]+|[\s\x85\xA0]+\z", "")
    # More parentheses than the shorter pattern can nest are rare; they take the longer one.
    shallow = _open_parentheses(trimmed) <= IN_DEPTH + 1
    tokens = F.when(shallow, F.regexp_extract_all(trimmed, F.lit(TOKENS), F.lit(0))).otherwise(F.regexp_extract_all(trimmed, F.lit(DEEP_TOKENS), F.lit(0)))
    native = _squeezed(F.array_join(F.transform(tokens, _replaced), ""))
    if not exact:
        return native
    deep = _open_parentheses(trimmed) > DEEPEST
    return F.when(deep, _squeezed(_scanned(F.when(deep, trimmed)))).otherwise(native)


#: The same token kinds for the scanner, but that of an IN list is its beginning alone; and what counts inside a list.
_PIECE = re.compile(_TOKENS.replace(r"[ \t]*+\({}(?:\)|\z)", r"[ \t]*+\(").replace(r"\z", r"\Z"), re.ASCII)
_MARK = re.compile(rf"[()]|{_IN_QUOTED}".replace(r"\z", r"\Z"))


def scan(text: str) -> str:
    """A trimmed statement's tokens put together again with their stand-ins, in one pass; an IN list's end is found by counting."""
    out, at = [], 0
    while at < len(text):
        token = _PIECE.match(text, at)[0]
        at += len(token)
        if token[:2] == "/*" or re.match(r"--(?:[ \t\n]|\Z)", token):
            continue
        if token[0] in " \t\n\r":
            out.append(" ")
        elif token[0] in "'\"" or re.match("-?[0-9]", token):
            out.append("?")
        elif len(token) > 2 and token[:2] in ("IN", "In", "iN", "in") and token[-1] == "(":
            depth, end = 1, len(text)
            for mark in _MARK.finditer(text, at):
                depth += {"(": 1, ")": -1}.get(mark[0], 0)
                if not depth:
                    end = mark.end()
                    break
            at = end
            out.append(token[:-1].replace("\t", " ") + "(?)")
        else:
            out.append(token)
    return "".join(out)


@F.pandas_udf(T.StringType())
def _scanned(texts: pd.Series) -> pd.Series:
    return texts.map(scan, na_action="ignore")


# --- classes ---------------------------------------------------------------------------------
SELECT, SESSION_STATE, TEMP_TABLE, TRANSACTION = "Select", "SessionState", "TempTable", "Transaction"
DML, DDL, ADMIN, UNKNOWN = "DML", "DDL", "Admin", "Unknown"
#: Keywords of each class, as fixed values in natural order. A phrase's words may be any blanks apart.
KEYWORDS = [
    (SELECT, ["SELECT", "SHOW", "DESCRIBE", "DESC", "EXPLAIN", "WITH"]),
    (SESSION_STATE, ["SET", "USE", "PREPARE", "EXECUTE", "DEALLOCATE", "DO", "HELP"]),
    (TRANSACTION, ["BEGIN", "START TRANSACTION", "COMMIT", "ROLLBACK", "SAVEPOINT", "RELEASE SAVEPOINT"]),
    (TEMP_TABLE, ["CREATE TEMPORARY", "DROP TEMPORARY", "ALTER TEMPORARY", "TRUNCATE TEMPORARY"]),
    (DML, ["INSERT", "UPDATE", "DELETE", "REPLACE", "MERGE", "LOAD DATA"]),
    (DDL, ["CREATE", "DROP", "ALTER", "RENAME", "TRUNCATE"]),
    (ADMIN, ["GRANT", "REVOKE", "FLUSH", "RESET", "LOCK", "UNLOCK", "CALL", "KILL", "PURGE"]),
]
_END = r"(?:[ \t\n\r;(]|\z)"


def bare(query: Column) -> Column:
    """The statement without leading blanks and comments."""
    return F.regexp_replace(F.coalesce(query, F.lit("")), r"\A(?:\s+|/\*(?:/|[\s\S]*?\*/|[\s\S]*\z)|--[^\n]*+(?:\n|\z))+", "")


def category(query: Column) -> Column:
    """The statement's class by its leading keyword or phrase."""
    text = F.upper(bare(query))
    out = None
    for name, keywords in KEYWORDS:
        test = text.rlike(rf"\A(?:{'|'.join(k.replace(' ', r'\s+') for k in keywords)}){_END}")
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out.otherwise(F.lit(UNKNOWN))


# --- names -----------------------------------------------------------------------------------
#: An identifier, with an optional schema before it.
_PART = r"(?:`[^`]*`|[A-Za-z0-9_$]+)"
_NAME = rf"(?:{_PART}[ \t]*\.[ \t\n\r]*)?({_PART})"


def _named(text: Column, pattern: str) -> Column:
    return F.lower(F.translate(F.regexp_extract(text, rf"(?is)\A{pattern}", 1), "`", ""))


def _word(*words: str) -> str:
    """Keywords with their ends, and the blanks after them."""
    return "".join(rf"{w}(?=[ \t\n\r;(]|\z)[ \t\n\r]*" for w in words)


def _temp(verb: str) -> str:
    return rf"{_word(verb, 'TEMPORARY', 'TABLE')}(?:IF (?:NOT )?EXISTS[ \t\n\r]*)?{_NAME}"


def temp_name(query: Column) -> Column:
    """The (first) table of a CREATE, DROP or ALTER TEMPORARY TABLE statement, or an empty text."""
    return _named(bare(query), _temp("(?:CREATE|DROP|ALTER)"))


def temp_created(query: Column) -> Column:
    return _named(bare(query), _temp("CREATE"))


def temp_dropped(query: Column) -> Column:
    return _named(bare(query), _temp("DROP"))


def is_plain_drop(query: Column) -> Column:
    return bare(query).rlike(rf"(?i)\A{_word('DROP', 'TABLE')}")


#: How the statements that have a target begin.
_TARGETED = "|".join([
    rf"{_word('INSERT')}(?:{_word('IGNORE')})?(?:{_word('INTO')})?",
    rf"{_word('REPLACE')}(?:{_word('INTO')})?",
    _word("DELETE", "FROM"),
    _word("UPDATE"),
    rf"{_word('TRUNCATE')}(?:{_word('TABLE')})?",
    rf"{_word('DROP', 'TABLE')}(?:IF EXISTS[ \t\n\r]*)?",
    _word("ALTER", "TABLE"),
])


def write_target(query: Column) -> Column:
    """The one table that a DML or DDL statement writes; empty if none can be told, or with a JOIN after it."""
    text = bare(query)
    begin = rf"(?:{_TARGETED}){_NAME}"
    rest = F.upper(F.regexp_replace(text, rf"(?is)\A{begin}", ""))
    return F.when(rest.contains("JOIN "), F.lit("")).otherwise(_named(text, begin))
