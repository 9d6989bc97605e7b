"""Question-answer pairs from generated responses and from numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daftar.functions.text import is_question_line, strip


def parse_responses(df: DataFrame, response: str, keep: list[str]) -> DataFrame:
    """Pairs of a response: what stands before the first "Question :" is skipped, parts need exactly one " | "."""
    parts = df.select(*keep, F.posexplode(F.split(response, "Question :", -1)).alias("pair_no", "part")).where("pair_no > 0")
    two = F.split("part", r" \| ", -1)
    return parts.where(F.size(two) == 2).select(*keep, "pair_no", strip(two[0]).alias("question"), strip(two[1]).alias("answer"))


def numbered_pairs(lines: DataFrame, file: str, line_no: str, line: str, unwanted: str | None = None) -> DataFrame:
    """Pairs from lines: a numbered question, then its answer lines up to the next question.

    Lines that start a page or equal ``unwanted`` are skipped; an answer needs at least one line, which may be blank.
    Files are the unit: the lines of one are read in order by one task.
    """
    x = lines.select(file, line_no, strip(line).alias("_line")).where(~F.col("_line").startswith("Page number"))
    if unwanted is not None:
        x = x.where(F.col("_line") != unwanted)
    w = Window.partitionBy(file).orderBy(line_no)
    x = x.withColumn("_q", is_question_line("_line").cast("int")).withColumn("pair_no", F.sum("_q").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = x.where("pair_no > 0").groupBy(file, "pair_no").agg(F.max(F.when(F.col("_q") == 1, F.col("_line"))).alias("question"), F.sort_array(F.collect_list(F.when(F.col("_q") == 0, F.struct(line_no, "_line")))).alias("_a"))
    return g.where(F.size("_a") > 0).select(file, "pair_no", "question", strip(F.array_join(F.transform("_a", lambda s: s["_line"]), " ")).alias("answer"))


def append(*frames: DataFrame) -> DataFrame:
    """All rows of all frames, columns by name, missing ones null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
