"""Several values packed in one field: a quote-aware finite-state tokenizer.

`explode_packed` turns a text column into one row per value with its position. The machine reads
a field as a stream of lexemes (escape, quote, bracket, delimiter, list number, text) and keeps
three pieces of state: the open quote, the nesting depth of brackets and whether a value has begun.
A delimiter ends a value only outside quotes and when it is not escaped.

Defined results
- null, empty, blank, `[]`, `{}` and fields of delimiters only: no row.
- values are trimmed; empty values don't count; repeated values all count; positions start at 1.
- a quote that never closes, or a bracket that never closes: the rest of the field is read as if
  it had been closed at the end.
- fields of any length are read whole; the time is linear in the length.
- columns of the input named like the output columns are dropped unless listed in `keep`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Delimiters between values, and the words (lower case) that join the last two.
DELIMITERS = ",;|/\t\n\r+&、；，"
JOINING_WORDS = ("and", "und", "et", "y", "và")
# A joining word before one of these belongs to a firm's name.
FIRM_TAILS = ("sons", "co", "partners", "company", "daughters", "associates")

_OPEN, _CLOSE = "[{(", "]})"
_D = re.escape(DELIMITERS)
_WORDS = "|".join(JOINING_WORDS)
_LEX = re.compile(
    r"(?P<uni>\\u[0-9a-fA-F]{4})|(?P<esc>\\.)|(?P<quote>[\"'“”])"
    rf"|(?P<word>\s(?:{_WORDS})\s(?!(?i:{'|'.join(FIRM_TAILS)})\b))|(?P<delim>[{_D}])"
    rf"|(?P<text>[^\\\"'“”{_D}\s]+|\s)",
    re.DOTALL,
)
_NUMBER = re.compile(r"(?:^|(?<=[\s;,|/]))(?:\(\d+\)|\d+[.)])(?=\s)\s*")
_FIRST_NUMBER = re.compile(r"\s*(?:\(\d+\)|\d+[.)])\s")
_SPECIAL = re.compile(rf"[\\\"“”{_D}\[\]{{}}()\d]|\s(?:{_WORDS})\s")
_JSON_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def _unboxed(s: str) -> tuple[str, bool]:
    """The inside of all enclosing bracket pairs (of the outermost the closing one may lack), and whether there was one."""
    a, b, boxed = 0, len(s), False
    while a < b and s[a] in "[{" and (not boxed or s[b - 1] in "]}"):
        if s[b - 1] == _CLOSE[_OPEN.index(s[a])]:
            b -= 1
        a, boxed = a + 1, True
        while a < b and s[a].isspace():
            a += 1
        while a < b and s[b - 1].isspace():
            b -= 1
    return s[a:b], boxed


def tokenize(field: str | None) -> list[str]:
    """The values packed in one field, in order."""
    if field is None:
        return []
    s = field.strip()
    if not s:
        return []
    if not _SPECIAL.search(s):
        return [s]
    s, boxed = _unboxed(s)
    numbered = not boxed and _FIRST_NUMBER.match(s) is not None
    if numbered:
        s = _NUMBER.sub("\x00", s)
    escaped = "\\" in s
    out: list[str] = []
    buf: list[str] = []
    quote = ""  # the open quote
    closed = False  # the value's quotes have closed; only blanks may follow
    depth = 0
    started = False
    last_close = None  # the last place where a single quote can close

    def flush() -> None:
        nonlocal buf, closed, started
        v = "".join(buf).strip()
        if v:
            out.append(v)
        buf, closed, started = [], False, False

    end = len(s)
    pos = 0
    while pos < end:
        if s[pos] == "\x00":
            if quote:
                buf.append("")
            else:
                flush()
            pos += 1
            continue
        m = _LEX.match(s, pos)
        if m is None:
            buf.append(s[pos])
            pos += 1
            continue
        kind, lexeme = m.lastgroup, m.group()
        pos = m.end()
        if kind == "uni":
            buf.append(chr(int(lexeme[2:], 16)))
            started = True
        elif kind == "esc":
            c = lexeme[1]
            buf.append(_JSON_ESCAPES.get(c, c) if quote and boxed else c)
            started = True
        elif kind == "quote":
            c = lexeme
            if quote:
                shuts = c == quote or (quote == "“" and c == "”")
                if shuts and c == '"' and s[pos : pos + 1] == '"' and not boxed:
                    buf.append(c)
                    pos += 1
                elif shuts and _ends(s, pos):
                    quote, closed = "", True
                else:
                    buf.append(c)
            elif not started and (c != "'" or boxed):
                quote, started = c, True
            elif not started and pos <= (last_close := _last_close(s, c) if last_close is None else last_close):
                quote, started = c, True
            else:
                buf.append(c)
                started = True
        elif quote:
            buf.append(lexeme)
        elif kind == "delim":
            if depth == 0:
                flush()
            else:
                buf.append(lexeme)
        elif kind == "word":
            if depth == 0 and not boxed and not escaped and (started or closed):
                flush()
            else:
                buf.append(lexeme)
        else:
            if not lexeme.isspace():
                started = True
                if not boxed:
                    depth = max(0, depth + sum(lexeme.count(x) for x in _OPEN) - sum(lexeme.count(x) for x in _CLOSE))
            if not (closed and lexeme.isspace()):
                buf.append(lexeme)
    flush()
    out = _surrogates(out)
    return [v for v in (x.strip() for x in out) if v and v not in ("[]", "{}")]


def _surrogates(values: list[str]) -> list[str]:
    """Join \\uD83D\\uDE00 pairs; a lone half becomes U+FFFD."""
    if not any(0xD800 <= ord(c) <= 0xDFFF for v in values for c in v):
        return values
    return [v.encode("utf-16", "surrogatepass").decode("utf-16", "replace") for v in values]


_AFTER_QUOTE = re.compile(rf"\s*(?:$|\x00|[{_D}\]}}])|\s+(?:{_WORDS})\s")


def _ends(s: str, pos: int) -> bool:
    """Whether a value may end at pos: the quote before it is a closing one."""
    return _AFTER_QUOTE.match(s, pos) is not None


def _last_close(s: str, c: str) -> int:
    """The last place at which the quote c can be a closing one; -1 for none."""
    i = s.rfind(c)
    while i >= 0 and not _ends(s, i + 1):
        i = s.rfind(c, 0, i)
    return i


def explode_packed(df: DataFrame, column: str, keep: list[str], pos: str = "pos", item: str = "item") -> DataFrame:
    """One row per value of `column`: the `keep` columns, the position from 1, the value.

    Narrow: no shuffle; only the kept columns and the packed one leave the scan. A value's row
    needs nothing but its own field, so hot keys don't matter.
    """
    src = df.select(*keep, F.col(column).alias("__packed"))
    schema = T.StructType(
        [src.schema[c] for c in keep] + [T.StructField(pos, T.IntegerType(), False), T.StructField(item, T.StringType(), False)]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lists = [tokenize(v) for v in b["__packed"]]
            n = [len(x) for x in lists]
            out = b[keep].loc[b.index.repeat(n)].reset_index(drop=True)
            out[pos] = [i for k in n for i in range(1, k + 1)]
            out[pos] = out[pos].astype("int32")
            out[item] = [v for x in lists for v in x]
            yield out

    return src.where(F.length(F.trim(F.col("__packed"))) > 0).mapInPandas(run, schema)
