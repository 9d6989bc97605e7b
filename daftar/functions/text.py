"""Text functions as Column expressions (Column or name in, Column out).  Null in, null out.

Python's regular expressions know Unicode and Java's shorthand classes do not, so classes are written out; \\d is
``\\p{Nd}`` and a word character is a letter, a number or an underscore.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Inside of a character class of all white space.
WS = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORD = r"\p{L}\p{N}_"
# Marks that page-wise text carries.
PAGE_MARK = r"Page number: \p{Nd}+"
DASHED_NUMBER = r"- \p{Nd}+ -"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(col(c), rf"^[{WS}]+|[{WS}]+\z", "")


def collapse(c: Column | str) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return F.trim(F.regexp_replace(col(c), rf"[{WS}]+", " "))


def remove_page_marks(c: Column | str) -> Column:
    return F.regexp_replace(col(c), PAGE_MARK, "")


def clean_arabic(c: Column | str, keep_digits: bool = True) -> Column:
    """Only the Arabic block and white space stay, and ASCII digits if kept; page marks and dashed numbers go first.

    Without digits, numbers standing by themselves go, in whatever digits; Arabic-Indic ones within words stay.
    """
    x = F.regexp_replace(remove_page_marks(c), DASHED_NUMBER, "")
    if not keep_digits:
        x = F.regexp_replace(x, rf"(?<![{_WORD}])\p{{Nd}}+(?![{_WORD}])", "")
    return collapse(F.regexp_replace(x, rf"[^\u0600-\u06ff{'0-9' if keep_digits else ''}{WS}]", ""))


def source_label(c: Column | str) -> Column:
    """Last segment of a path, without one trailing .txt, underscores as blanks."""
    last = F.element_at(F.split(col(c), "/", -1), -1)
    return F.translate(F.regexp_replace(last, r"\.txt\z", ""), "_", " ")


def first_answer(c: Column | str, is_json: bool = True) -> Column:
    """First text of an answers value: a JSON string or a struct with an array ``text``; null where there is none."""
    x = F.from_json(col(c), "text array<string>") if is_json else col(c)
    return F.get(x["text"], F.lit(0))


def merged(question: Column | str, answer: Column | str, context: Column | str) -> Column:
    """Three labelled lines; nulls are written None."""
    parts = [("السؤال: ", question), ("\nالإجابة: ", answer), ("\nالسياق: ", context)]
    return F.concat(*[x for label, c in parts for x in (F.lit(label), F.coalesce(col(c), F.lit("None")))])


def format_answer(c: Column | str) -> Column:
    """A line break behind every colon, then every line break doubled."""
    return F.replace(F.replace(col(c), F.lit(":"), F.lit(":\n")), F.lit("\n"), F.lit("\n\n"))


def numbered_documents(docs: Column | str, metas: Column | str) -> Column:
    """Documents with their metadata as one display string."""
    pairs = F.transform(F.arrays_zip(col(docs).alias("d"), col(metas).alias("m")), lambda x, i: F.concat(F.lit("**Document "), (i + 1).cast("string"), F.lit(":**\n"), x["d"], F.lit("\n**Metadata:** "), x["m"]))
    return F.array_join(pairs, "\n")


def numbered(label: str, items: Column | str) -> Column:
    """"label i:" and the item, blocks separated by empty lines."""
    return F.array_join(F.transform(col(items), lambda x, i: F.concat(F.lit(f"{label} "), (i + 1).cast("string"), F.lit(":\n"), x)), "\n\n")


def is_question_line(c: Column | str) -> Column:
    """A line that opens a numbered question: the letter, white space, digits, a bracket."""
    return col(c).rlike(rf"^س[{WS}]*\p{{Nd}}+\)")


def strip_join_lines(c: Column | str) -> Column:
    """Every line stripped and followed by a blank, one behind the other."""
    body = F.regexp_replace(col(c), r"\n\z", "")
    return F.concat(F.array_join(F.transform(F.split(body, "\n", -1), strip), " "), F.lit(" "))


def fill(template: str, **values: Column | str) -> Column:
    """A template with {name} replaced by columns; braces inside values are not read again."""
    parts, rest = [], template
    while rest:
        at = min((i for i in (rest.find("{" + k + "}") for k in values) if i >= 0), default=-1)
        if at < 0:
            parts.append(F.lit(rest))
            break
        name = next(k for k in values if rest.startswith("{" + k + "}", at))
        parts += [F.lit(rest[:at]), col(values[name])]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts) if parts else F.lit("")


def error_class(message: Column | str) -> Column:
    """What a failed call asks for: another key after a rate limit or an unknown error, a wait when unavailable."""
    m = col(message)
    limit = F.lower(m).contains("rate limit") | m.contains("429")
    away = m.contains("503") | m.contains("Service Unavailable")
    return F.when(m.isNull(), None).when(limit, "rate_limit").when(away, "unavailable").otherwise("unknown")


def document_lines(columns: list[str]) -> Column:
    """"name: value" lines of a row, in order of the columns; nulls are empty."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns])
