"""The answer inside a JSON text that is still growing."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What an escaped letter stands for.
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
OPENING = re.compile(r'"answer"\s*:\s*"')
PIECE = re.compile(r'\\u(.{4})|\\([^u])|([^"\\]+)', re.S)


def _unit(code: str) -> str:
    try:
        return chr(int(code, 16))
    except ValueError:
        return code


def answer_so_far(text: str | None) -> str | None:
    """The decoded answer up to its closing quote or to the last whole character; None before it begins.

    An escape that isn't complete is held back; an unknown one is its character; \\u escapes are
    decoded one unit at a time, and one without a number is its four characters.
    """
    decoded, _, begun, _ = decoded_further(text or "", False)
    return decoded if begun else None


def decoded_further(text: str, begun: bool) -> tuple[str, str, bool, bool]:
    """(decoded, rest, begun, ended): what of the answer a piece of the text adds, and what has to wait for more of it.

    begun: whether the piece stands inside the answer already. Pieces one after another, each
    behind what the last one left, give what answer_so_far gives of all.
    """
    at = 0
    if not begun:
        opened = OPENING.search(text)
        if opened is None:
            return "", text, False, False
        at = opened.end()
    out = []
    while piece := PIECE.match(text, at):
        code, letter, plain = piece.groups()
        out.append(_unit(code) if code else ESCAPES.get(letter, letter) if letter else plain)
        at = piece.end()
    return "".join(out), text[at:], True, text[at : at + 1] == '"'


def answer_prefix(text: Column) -> Column:
    """answer_so_far of a column; a lone surrogate, which no column can hold, becomes U+FFFD."""

    def decode(texts: pd.Series) -> pd.Series:
        found = texts.map(answer_so_far)
        return found.map(lambda x: x.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if isinstance(x, str) else None)

    return F.pandas_udf(decode, "string")(text)
