"""Problem 4: text that looks ordinary but is made of other characters.

Method: confusables skeleton.  A text is decomposed, every character is replaced by its prototype from the table of
look-alikes (lookalikes_table), and the result is decomposed again; originals with equal skeletons are one group.
The one form that comes out (``canonical``) is the skeleton composed again, with characters that cannot be seen
dropped and blanks of all widths made ordinary; compatibility forms that do not look like their decomposition
(superscripts, fractions, circled digits) stay.  A field is a case if its one form is not the text itself.

Words of another script stay as they are where they hold a letter that is no look-alike (a Russian word in a text);
visible diacritics, tatweel, ordinary blanks and line breaks are no cases.

Nulls stay null and are no cases; empty texts are equal to themselves.  Texts are read whole.  Extra columns are kept
by normalised().
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.llm.codes import flatten
from daftar.llm.lookalikes_table import PROTOTYPES
from daftar.session import cut, small

# Kinds of compatibility decomposition whose two sides look the same.
ALIKE = {"<wide>", "<narrow>", "<isolated>", "<initial>", "<medial>", "<final>", "<noBreak>", "<compat>", "<font>"}
#: Invisible besides the format characters: Mongolian separator, combining joiner, fillers, variation selectors.
_UNSEEN = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180E, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10)}
_SCRIPTS = "Ͱ-ϿЀ-ԯᎠ-᏿Ա-֏Ⲁ-⳿ꓐ-꓿ꭰ-ꮿ"
_OTHER = re.compile(rf"[{_SCRIPTS}]")
_WORD = re.compile(r"\w+")
#: The yeh of other languages has no dots at the end of a word.
_FINAL_YEH = re.compile("[\u06cc\u06d2](?!\\w)")
BLOCK = 2000


def _form(ch: str) -> str:
    """The one form of a character, not yet composed with its neighbours."""
    c, cat = ord(ch), unicodedata.category(ch)
    if c in _UNSEEN or cat == "Cf" or cat == "Cc" and ch not in "\t\n\r":
        return ""
    if cat == "Zs":
        return " "
    if cat in ("Zl", "Zp"):
        return "\n"
    kind = unicodedata.decomposition(ch).split(" ")[0]
    d = unicodedata.normalize("NFKD", ch) if kind in ALIKE else unicodedata.normalize("NFD", ch)
    return unicodedata.normalize("NFD", "".join(PROTOTYPES.get(x, x) for x in d))


@functools.cache
def forms() -> dict[int, str]:
    """Code points whose one form is another text."""
    out = {}
    for c in range(sys.maxunicode + 1):
        if 0xD800 <= c < 0xE000 or 0x30000 <= c < 0xE0000 or 0xE1000 <= c:
            continue
        ch = chr(c)
        if unicodedata.category(ch) in ("Cn", "Co") or 0xAC00 <= c < 0xD7A4:
            continue
        f = _form(ch)
        if unicodedata.normalize("NFC", f) != ch and f != unicodedata.normalize("NFD", ch):
            out[c] = f
    return out


@functools.cache
def _suspects() -> np.ndarray:
    out = np.zeros(sys.maxunicode + 1, bool)
    out[list(forms())] = True
    return out


def canonical(text: str) -> str:
    """The one form of a text."""
    table = forms()
    text = _FINAL_YEH.sub("\u0649", text)
    if _OTHER.search(text):
        # words truly of another script stay
        def word(m: re.Match) -> str:
            w = unicodedata.normalize("NFC", m.group(0))
            return w if any(_OTHER.match(x) and x not in PROTOTYPES for x in w) else w.translate(table)

        out, at = [], 0
        for m in _WORD.finditer(text):
            out += [text[at : m.start()].translate(table), word(m)]
            at = m.end()
        text = "".join([*out, text[at:].translate(table)])
    else:
        text = text.translate(table)
    return unicodedata.normalize("NFC", text)


def suspicious(texts: list[str]) -> np.ndarray:
    """Texts that may have another form; all others are their own."""
    codes, starts = flatten(texts)
    if not texts:
        return np.zeros(0, bool)
    hits = np.flatnonzero(_suspects()[codes])
    out = np.zeros(len(texts), bool)
    out[np.searchsorted(starts, hits, "right") - 1] = True
    nfc = unicodedata.is_normalized
    return out | np.fromiter((not nfc("NFC", t) for t in texts), bool, len(texts))


def one_form(texts: pd.Series) -> pd.Series:
    """The one form of each text; nulls stay."""
    parts = []
    for i in range(0, len(texts), BLOCK):
        part = list(texts.iloc[i : i + BLOCK])
        for j in np.flatnonzero(suspicious(["" if t is None else t for t in part])):
            part[j] = canonical(part[j])
        parts += part
    return pd.Series(parts, index=texts.index, dtype=object)


def normalised(df: DataFrame, fields: list[str]) -> DataFrame:
    """df with every field in its one form; all other columns as they are."""
    udf = F.pandas_udf(one_form, "string")
    return df.withColumns({f: udf(f) for f in fields})


def found(qa: DataFrame) -> DataFrame:
    """row_id, field_name of the fields that hold look-alike or invisible characters."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name in ("question", "context"):
                same = pdf[name].dropna()
                changed = one_form(same) != same
                yield pd.DataFrame({"row_id": pdf.row_id[same.index][changed], "field_name": name})

    return qa.select("row_id", "question", "context").mapInPandas(scan, "row_id long, field_name string")


def _skeletons(qa: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """row_id, field_name, skeleton and original (128-bit hashes), opening of every field that is not null."""
    t = normalised(qa.select("row_id", *fields, *[F.col(f).alias(f"form_{f}") for f in fields]), [f"form_{f}" for f in fields])
    each = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("original"), F.col(f"form_{f}").alias("form")) for f in fields])
    t = t.select("row_id", F.explode(each).alias("t")).select("row_id", "t.*").where("original is not null")
    return t.select("row_id", "field_name", F.md5("form").alias("skeleton"), F.md5("original").alias("original"), F.substring("form", 1, 80).alias("opening"))


def _grouped(t: DataFrame) -> DataFrame:
    n = t.groupBy("field_name", "skeleton", "original").agg(F.count("*").alias("rows"), F.min("opening").alias("opening"))
    return n.groupBy("field_name", "skeleton").agg(F.sum("rows").alias("rows"), F.count("*").alias("originals"), F.min("opening").alias("opening")).where("originals > 1")


def groups(qa: DataFrame, *fields: str) -> DataFrame:
    """Skeletons of a field with several originals: field_name, skeleton key, rows, different originals, and one form as an example.

    Texts are compared by 128-bit hash; counts are aggregated before each shuffle, so a text in a third of all rows
    is one row a partition.
    """
    return _grouped(_skeletons(qa, fields))


def members(qa: DataFrame, *fields: str) -> DataFrame:
    """row_id, field_name, skeleton of every field in one of the groups."""
    t = cut(_skeletons(qa, fields))
    g = cut(_grouped(t).select("field_name", "skeleton"))
    return t.join(F.broadcast(g) if small(g) else g, ["field_name", "skeleton"], "left_semi").select("row_id", "field_name", "skeleton")
