"""Answer extraction and text measures as column expressions.

Everything is JVM-side but the balanced-brace scan of boxed answers and Unicode
NFKC, which no built-in function expresses; those are Arrow UDFs.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as ST

TAIL_CHARS, BLOCK_CHARS = 4096, 40
#: The extraction policies.
POLICIES = ("boxed_strict", "boxed_last", "last_int", "answer_is")
#: The patterns of a box, an integer and a stated answer.
_BOX, _BRACE = re.compile(r"\\boxed\s*\{"), re.compile(r"[{}]")
INTEGER = r"-?\d[\d,]*"
STATED = r"(?:final answer|answer)\s*(?:is|:)\s*\$?\\?\(?\s*(-?[\d,]+|[^\s.$]{1,40})"


def boxed_items(text: str | None) -> list[str]:
    """Stripped contents of the outermost balanced ``\\boxed{...}``; a box that never closes is passed over."""
    if not text or "\\boxed" not in text:
        return []
    end, open_ = {}, []  # where each brace closes, in one pass
    for m in _BRACE.finditer(text):
        if m[0] == "{":
            open_.append(m.start())
        elif open_:
            end[open_.pop()] = m.start()
    found, at = [], 0
    while (m := _BOX.search(text, at)) is not None:
        at, close = m.end(), end.get(m.end() - 1)
        if close is not None:
            found.append(text[at:close].strip())
            at = close + 1
    return found


def unwrap(item: str, rounds: int = 4) -> str:
    """The content of a box that holds nothing but one further box, a few levels deep."""
    for _ in range(rounds):
        inner = boxed_items(item)
        if len(inner) != 1 or not item.startswith("\\boxed"):
            break
        item = inner[0]
    return item


@F.pandas_udf(ST.StructType([ST.StructField("strict", ST.StringType()), ST.StructField("last", ST.StringType())]))
def _boxed(text: pd.Series) -> pd.DataFrame:
    items = text.map(lambda t: [unwrap(x) for x in boxed_items(t)])
    return pd.DataFrame({"strict": items.map(lambda x: (x[0] or None) if len(x) == 1 else None), "last": items.map(lambda x: (x[-1] or None) if x else None)})


def _boxes(text: Column) -> Column:
    """The boxes of a text; Python is handed only texts that have any."""
    return _boxed(F.when(F.contains(text, F.lit("\\boxed")), text))


def extract(text: Column, policy: str) -> Column:
    """The answer that a policy reads from a completion, or null."""
    if policy == "boxed_strict":
        return _boxes(text)["strict"]
    if policy == "boxed_last":
        return _boxes(text)["last"]
    if policy == "last_int":
        return F.replace(F.try_element_at(F.regexp_extract_all(text, F.lit("(?U)" + INTEGER), F.lit(0)), F.lit(-1)), F.lit(","))
    if policy == "answer_is":
        got = F.try_element_at(F.regexp_extract_all(text, F.lit("(?iuU)" + STATED), F.lit(1)), F.lit(-1))
        return F.nullif(F.trim(F.replace(got, F.lit(","))), F.lit(""))
    raise ValueError(f"unknown extraction policy {policy!r}; known: {', '.join(POLICIES)}")


def extract_all(text: Column) -> Column:
    """A struct of all policies' answers; the boxes are scanned once."""
    box = _boxes(text)
    return F.struct(box["strict"].alias("boxed_strict"), box["last"].alias("boxed_last"), extract(text, "last_int").alias("last_int"), extract(text, "answer_is").alias("answer_is"))


def tail(text: Column, chars: int = TAIL_CHARS) -> Column:
    return F.right(text, F.lit(chars))


def find_last(text: Column, needle: Column) -> Column:
    """0-based place of the needle's last occurrence; null if the needle is null, empty or absent."""
    back = F.position(F.reverse(needle), F.reverse(text))
    return F.when((F.length(needle) > 0) & (back > 0), F.length(text) - F.length(needle) - back + 1)


def answer_token_pos(text: Column, start: Column, n_tokens: Column) -> Column:
    """The token at a character's share of the text (half to even); -1 without a start or a text."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), start / F.length(text).cast("double")))
    return F.when(start.isNull() | (F.coalesce(F.length(text), F.lit(0)) == 0), F.lit(-1)).otherwise(F.rint(share * n_tokens)).cast("bigint")


def repetition_ratio(text: Column, block: int = BLOCK_CHARS) -> Column:
    """1 - distinct / all of the text's consecutive blocks; 0 for texts under two blocks."""
    # One pass over the text; a block that would end with it is none.
    blocks = F.slice(F.regexp_extract_all(text, F.lit(f"(?s).{{{block}}}"), F.lit(0)), F.lit(1), F.ceil((F.length(text) - block) / block).cast("int"))
    ratio = F.lit(1.0) - F.size(F.array_distinct(blocks)) / F.size(blocks)
    return F.when(F.coalesce(F.length(text), F.lit(0)) < 2 * block, F.lit(0.0)).otherwise(ratio)


def n_distinct_ints(text: Column) -> Column:
    return F.size(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)-?\d+"), F.lit(0)))).cast("bigint")


def as_int(answer: Column) -> Column:
    """An integer answer in canonical form (a string, so of any length), or null."""
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    bare = strip(F.translate(strip(answer), ",$", ""))
    bare = strip(F.regexp_replace(bare, r"(?s)^\\text\{(.*)\}$", "$1"))
    digits = F.regexp_replace(F.regexp_replace(bare, r"^[+-]", ""), r"^0+(?=\d)", "")
    sign = F.when(F.startswith(bare, F.lit("-")) & (digits != "0"), F.lit("-")).otherwise(F.lit(""))
    return F.when(bare.rlike(r"^[+-]?[0-9]+$"), F.concat(sign, digits))


def _nfkc(text: str | None) -> str | None:
    return None if text is None else unicodedata.normalize("NFKC", text.replace("\u2212", "-").replace("\u00a0", " ")).replace("\u2212", "-")


@F.pandas_udf(ST.StringType())
def _normal(text: pd.Series) -> pd.Series:
    return text.map(_nfkc)


def _squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_question(text: Column) -> Column:
    """NFKC, plain minus and space, white space to single spaces, trimmed; ASCII texts stay JVM-side."""
    plain = F.octet_length(text) == F.length(text)
    return _squeeze(F.when(plain, text).otherwise(_normal(text)))


def normalize_answer(text: Column) -> Column:
    """As a question, without the dollar signs around it."""
    return _squeeze(F.regexp_replace(normalize_question(text), r"^\$+|\$+$", ""))


def prompt_tokens(prompt: Column) -> Column:
    """The mock backend's count: a token per four characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(prompt) / 4)).cast("bigint")
