"""Problem 1: records of the evaluation splits that are, exactly or almost, in the training split.

Method: winnowing.  Of every question the rolling hashes of SEED words in a row are taken and the minimum of every
window of WINDOW of them is kept, so two questions that share SEED + WINDOW - 1 words in a row share a kept hash.
At most one word in eight may differ, so the longest common run of two matching questions has at least five words
(a question of 16 words with two changes), which is SEED + WINDOW - 1.  Only where both have fewer than FEW words it
may have four (8 or 9 words with one change): of such questions all hashes are kept.  Kept hashes of evaluation records are joined
with those of training records.  Each row carries the number of words and a bitmap of the words of its question and
its context, which the join compares: words of one text that the other lacks each cost an edit, and bits set in one
bitmap only are at most as many, so a pair with more such bits than DIFFER allows would not be verified either.  The
comparison throws out nothing else; the longer the texts, the less it throws out.
Candidates are verified on their texts: common seeds are chained in the same order, the gaps between the chained
seeds are aligned by bit-parallel edit distance, and the words matched are the coverage.  Where the chain finds too
many edits (a passage stands in two places and the chain took the wrong one), the whole texts are aligned.

So the result is all pairs whose edit distance is at most DIFFER of the words of the longer text, in the question and
in the context.  DIFFER is the share for which the runs above and below are sure: a pair beyond it would be found or
not as its hashes happen to be kept or hot, that is, by the size of the tables.

A hash that would make more than HOT pairs is not joined alone.  It is refined to the hashes of the SEED + 1 words
that contain it (a common run of five words has one of them in common), and where such a one is still hot, by the
kept hashes of the context; two questions of fewer than FEW words, which may have no five words in common, are refined by
the context at once.  A common run of CONTEXT_SEED + CONTEXT_WINDOW - 1 = 7 words is sure for contexts of CONTEXT_ALL
words or more (1/8 changed, runs between them); of shorter contexts, with runs of 5 and 6, all hashes are kept, and of
those of fewer than FEW words, with runs of 4, also all of 4 words.  So no group of pairs is emitted at once and
nothing is left out.

Exact copies (equal question and context in one of the two parts) are searched and verified once; their rows are put
in for their representative at the end, as every pair of rows is asked for.

Nulls: rows with null question or context never take part.  Texts without any word never take part.  Empty tables
give empty results.  Extra columns are ignored.  Repeated rows count like any rows.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daftar.llm.codes import Words, grams, winnow
from daftar.session import cut, small

SEED, WINDOW = 4, 2
CONTEXT_SEED, CONTEXT_WINDOW = 5, 3
#: Texts of fewer words may have only runs of SEED words in common; contexts of fewer words only runs below 7.
FEW, CONTEXT_ALL = 10, 56
HOT = 2_000_000
#: Bitmaps of words: 128 bits for the question, 256 for the context.
QUESTION_MAP, CONTEXT_MAP = ["q0", "q1"], ["c0", "c1", "c2", "c3"]
CARRIED = [*QUESTION_MAP, *CONTEXT_MAP, "q_words", "c_words"]
#: Share of words that may differ.
DIFFER = 1 / 8
BLOCK = 500


def kept(w: Words, k: int, window: int, every: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Kept hashes, the text of each, and the hashes of the k + 1 words ending and beginning with it (0: there are none).

    A text of fewer than k words has the hash of all its words; of texts of fewer than ``every`` words all hashes are kept.
    """
    g, at = grams(w.hashes, w.text, k)
    size = np.diff(w.first)
    s = np.union1d(winnow(g, at, w.text, window), np.flatnonzero(size[w.text[at]] < every))
    h, first, t = g[s], at[s], w.text[at[s]]
    longer, where = grams(w.hashes, w.text, k + 1)
    by = np.zeros(len(w.hashes) + 1, np.uint64)
    by[where] = longer
    left = np.where((first > 0) & (w.text[first - 1] == t), by[first - 1], np.uint64(0)) if len(h) else h
    right = by[first]
    short = np.flatnonzero((size > 0) & (size < k))
    if len(short):
        whole = np.array([np.bitwise_xor.reduce(w.of(i) * np.arange(1, 2 * size[i], 2, dtype=np.uint64)) for i in short], np.uint64)
        h, t = np.r_[h, whole], np.r_[t, short]
        left, right = np.r_[left, whole], np.r_[right, whole]
    return h.view(np.int64), t, left.view(np.int64), right.view(np.int64)


def bitmap(w: Words, n: int, longs: int) -> np.ndarray:
    """Of each of n texts the bits that its words' hashes name: n x longs int64 of 64 bits each."""
    out = np.zeros((n, 64 * longs), bool)
    out[w.text, (w.hashes % np.uint64(64 * longs)).astype(np.int64)] = True
    return np.packbits(out, axis=1).view(np.int64)


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for i in range(0, len(pdf), BLOCK):
            p = pdf.iloc[i : i + BLOCK]
            q, c = Words(list(p.question)), Words(list(p.context))
            h, t, left, right = kept(q, SEED, WINDOW, FEW)
            maps = np.hstack([bitmap(q, len(p), len(QUESTION_MAP)), bitmap(c, len(p), len(CONTEXT_MAP)), np.diff(q.first)[:, None], np.diff(c.first)[:, None]])[t]
            out = pd.DataFrame({"fp": h, "row_id": p.row_id.to_numpy()[t], "ev": p.ev.to_numpy()[t], **{x: maps[:, j] for j, x in enumerate(CARRIED)}, "left": left, "right": right})
            yield out[out.c_words > 0].drop_duplicates(["fp", "row_id", "left", "right"])


def _context_seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for i in range(0, len(pdf), BLOCK):
            p = pdf.iloc[i : i + BLOCK]
            c = Words(list(p.context))
            h, t, _, _ = kept(c, CONTEXT_SEED, CONTEXT_WINDOW, CONTEXT_ALL)
            small = np.flatnonzero(np.diff(c.first) < FEW)
            g, u, _, _ = kept(Words(list(p.context.iloc[small])), SEED, 1)
            h, t = np.r_[h, g], np.r_[t, small[u]]
            yield pd.DataFrame({"row_id": p.row_id.to_numpy()[t], "cfp": h}).drop_duplicates()


def edit_distance(a: list, b: list) -> int:
    """Words added, dropped or replaced, by bit-parallel dynamic programming over the words of b."""
    if not a or not b:
        return len(a) or len(b)
    peq: dict = {}
    for i, x in enumerate(a):
        peq[x] = peq.get(x, 0) | 1 << i
    m, full, top = len(a), (1 << len(a)) - 1, 1 << len(a) - 1
    pv, mv, score = full, 0, m
    for y in b:
        eq = peq.get(y, 0)
        xv = eq | mv
        xh = ((eq & pv) + pv ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 | 1, mh << 1
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv & full
    return score


def chained_distance(a: list, b: list, k: int = SEED) -> int:
    """Edits between two word lists: chain the seeds unique in both in the same order, align only the gaps."""
    if a == b:
        return 0
    here: dict = {}
    for i in range(len(a) - k + 1):
        g = tuple(a[i : i + k])
        here[g] = -1 if g in here else i
    seen: dict = {}
    for j in range(len(b) - k + 1):
        g = tuple(b[j : j + k])
        if here.get(g, -1) >= 0:
            seen[g] = -1 if g in seen else j
    seeds = [(here[g], j) for g, j in sorted(seen.items(), key=lambda x: x[1]) if j >= 0]
    tails: list = []  # longest chain of seeds increasing in both
    back: list = []
    import bisect

    ends: list = []
    for n, (i, _) in enumerate(seeds):
        p = bisect.bisect_left(ends, i)
        back.append(tails[p - 1] if p else -1)
        if p == len(ends):
            ends.append(i)
            tails.append(n)
        else:
            ends[p], tails[p] = i, n
    chain = []
    n = tails[-1] if tails else -1
    while n >= 0:
        chain.append(seeds[n])
        n = back[n]
    total, ai, bi = 0, 0, 0
    for i, j in reversed(chain):
        if i < ai or j < bi:  # overlaps the seed before: extend where both move alike
            d = max(ai - i, bi - j)
            i, j = i + d, j + d
            if i - ai == j - bi == 0 and d < k:
                ai, bi = i + k - d, j + k - d
                continue
            if d >= k:
                continue
            total += edit_distance(a[ai:i], b[bi:j])
            ai, bi = i + k - d, j + k - d
            continue
        total += edit_distance(a[ai:i], b[bi:j])
        ai, bi = i + k, j + k
    return total + edit_distance(a[ai:], b[bi:])


def coverage(a: list, b: list) -> float | None:
    """Share of the longer word list that is matched; None where more than DIFFER of it are edits, or both are empty."""
    n = max(len(a), len(b))
    most = DIFFER * n
    if not n or n - (Counter(a) & Counter(b)).total() > most:  # words that the other lacks each cost an edit
        return None
    d = chained_distance(a, b)
    if d > most:
        d = edit_distance(a, b)
    return 1 - d / n if d <= most else None


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for i in range(0, len(pdf), BLOCK):
            p = pdf.iloc[i : i + BLOCK]
            w = {c: Words(list(p[c])) for c in ("qa", "qb", "ca", "cb")}
            out = []
            for r in range(len(p)):
                share = []
                for x, y in (("qa", "qb"), ("ca", "cb")):
                    share.append(coverage(w[x].of(r).tolist(), w[y].of(r).tolist()))
                    if share[-1] is None:
                        break
                else:
                    out.append((p.row_id_a.iat[r], p.row_id_b.iat[r], share[0], share[1]))
            yield pd.DataFrame(out, columns=["train_id", "eval_id", "question_coverage", "context_coverage"]).astype({"train_id": "int64", "eval_id": "int64", "question_coverage": "float64", "context_coverage": "float64"})


def _near(e: str, t: str) -> Column:
    """Whether the bitmaps and the numbers of words allow that both texts differ in at most DIFFER of their words."""
    every = []
    for bits, n in ((QUESTION_MAP, "q_words"), (CONTEXT_MAP, "c_words")):
        longer = f"greatest({e}.{n}, {t}.{n})"
        every.append(f"least({e}.{n}, {t}.{n}) >= {1 - DIFFER}D * {longer}")
        every += [" + ".join(f"bit_count({a}.{x} & ~{b}.{x})" for x in bits) + f" <= {DIFFER}D * {longer}" for a, b in ((e, t), (t, e))]
    return F.expr(" and ".join(every))


def _joined(rows: DataFrame, keys: list[str]) -> DataFrame:
    e, t = rows.where("ev"), rows.where("not ev")
    on = _near("e", "t")
    for k in keys:
        on = (F.col(f"e.{k}") == F.col(f"t.{k}")) & on
    return e.alias("e").join(t.alias("t"), on).select(F.col("t.row_id").alias("row_id_a"), F.col("e.row_id").alias("row_id_b"))


def _hot(rows: DataFrame, hot: int) -> DataFrame:
    n = rows.groupBy("fp").agg(F.count_if("ev").alias("n_e"), F.count_if(~F.col("ev")).alias("n_t"))
    return cut(n.where(F.col("n_e") * F.col("n_t") > hot).select("fp"))


def _copies(rows: DataFrame) -> DataFrame:
    """row_id, rep of the rows whose question and context a row of smaller id has, in the same part."""
    base = rows.select("row_id", "ev", F.md5("question").alias("q"), F.md5("context").alias("c"))
    classes = cut(base.groupBy("ev", "q", "c").agg(F.min("row_id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n"))
    return cut(base.join(F.broadcast(classes) if small(classes) else classes, ["ev", "q", "c"]).where("row_id <> rep").select("row_id", "rep"))


def _expanded(pairs: DataFrame, copies: DataFrame) -> DataFrame:
    """The pairs of representatives, and those of their copies."""
    side = F.broadcast(copies) if small(copies) else copies
    for c in ("train_id", "eval_id"):
        more = pairs.join(side.select(F.col("rep").alias(c), F.col("row_id").alias("_copy")), c)
        pairs = pairs.union(more.select(*[F.col("_copy").alias(x) if x == c else F.col(x) for x in pairs.columns]))
    return pairs


def overlaps(qa: DataFrame, hot: int = HOT) -> DataFrame:
    """train_id, eval_id, question_coverage, context_coverage of all matching pairs (coverage: share of words matched)."""
    rows = qa.where("question is not null and context is not null and split in ('train', 'validation', 'test')")
    rows = rows.select("row_id", "question", "context", (F.col("split") != "train").alias("ev"))
    copies = _copies(rows)
    rows = rows.join(F.broadcast(copies.select("row_id")) if small(copies) else copies.select("row_id"), "row_id", "left_anti")
    longs = ", ".join(f"{x} long" for x in [*CARRIED, "left", "right"])
    f = cut(rows.mapInPandas(_fingerprints, f"fp long, row_id long, ev boolean, {longs}"))
    some = ["fp", "row_id", "ev", *CARRIED]
    heavy, parts = _hot(f, hot), []

    def by_context(x: DataFrame) -> DataFrame:
        c = rows.join(x.select("row_id").distinct(), "row_id", "left_semi").select("row_id", "context").mapInPandas(_context_seeds, "row_id long, cfp long")
        return _joined(x.join(c, "row_id"), ["fp", "cfp"])

    if heavy.head(1):
        keys = F.broadcast(heavy) if small(heavy) else heavy
        h = f.join(keys, "fp", "left_semi")
        short = h.where(F.col("q_words") < FEW).select(*some).distinct()
        if short.head(1):
            parts.append(by_context(short))
        h = h.withColumn("fp", F.explode(F.array("left", "right"))).where("fp <> 0").select(*some).distinct()
        f = f.join(keys, "fp", "left_anti")
        heavy = _hot(h, hot)
        if heavy.head(1):
            keys = F.broadcast(heavy) if small(heavy) else heavy
            parts.append(by_context(h.join(keys, "fp", "left_semi")))
            h = h.join(keys, "fp", "left_anti")
        parts.append(_joined(h, ["fp"]))
    pairs = cut(functools.reduce(DataFrame.union, [_joined(f.select(*some), ["fp"]), *parts]).distinct())
    side = F.broadcast if small(pairs) else lambda x: x
    texts = rows.select("row_id", "question", "context")
    a = texts.join(side(pairs), texts.row_id == pairs.row_id_a).select("row_id_a", "row_id_b", F.col("question").alias("qa"), F.col("context").alias("ca"))
    b = texts.join(side(pairs), texts.row_id == pairs.row_id_b).select("row_id_a", "row_id_b", F.col("question").alias("qb"), F.col("context").alias("cb"))
    verified = a.join(b, ["row_id_a", "row_id_b"]).mapInPandas(_verify, "train_id long, eval_id long, question_coverage double, context_coverage double")
    return _expanded(cut(verified), copies)


def found(qa: DataFrame) -> DataFrame:
    """row_id_a, row_id_b (smaller first)."""
    return overlaps(qa).select(F.least("train_id", "eval_id").alias("row_id_a"), F.greatest("train_id", "eval_id").alias("row_id_b")).distinct()


def records(qa: DataFrame) -> DataFrame:
    """Per evaluation record that is in train: split, source, training records that match it, coverage of the best match."""
    best = overlaps(qa).groupBy("eval_id").agg(F.count("*").alias("links"), F.round(F.max("question_coverage"), 6).alias("question_coverage"), F.round(F.max("context_coverage"), 6).alias("context_coverage"))
    ev = qa.where("split in ('validation', 'test')").select("row_id", "split", "source")
    return ev.join(best, ev.row_id == best.eval_id).drop("eval_id")


def report(qa: DataFrame) -> DataFrame:
    """Per evaluation split and source of the evaluation record: records, those found in train, share, mean coverage of their best match."""
    o = cut(overlaps(qa))
    best = o.groupBy("eval_id").agg(F.max("question_coverage").alias("q"), F.max("context_coverage").alias("c"), F.count("*").alias("links"))
    ev = qa.where("split in ('validation', 'test')").select("row_id", "split", "source")
    j = ev.join(best, ev.row_id == best.eval_id, "left")
    return j.groupBy("split", "source").agg(
        F.count("*").alias("records"), F.count("eval_id").alias("leaked"), F.coalesce(F.sum("links"), F.lit(0)).alias("links"),
        F.round(F.count("eval_id") / F.count("*"), 6).alias("leaked_share"), F.round(F.avg("q"), 6).alias("question_coverage"), F.round(F.avg("c"), 6).alias("context_coverage"),
    )
