"""Problem 7: noise in text from scanned pages: broken words, misread characters, running headers, page numbers.

Method: joint word segmentation over the text without its lines.  A lexicon with word frequencies is counted over all
texts of both tables.  Header lines (the title of the source, by edit distance, so also misread), page numbers and
repeated lines of problem 6 are taken out of the stream, words broken over two lines with a mark are joined where
the lexicon knows the joined word (also over a line in between), and the stream is decoded by dynamic programming: every stretch of
characters is a known word, a misread word (one confusion, or a stray sign), two words run together, or two pieces
of one word, each at a cost from the frequencies; the cheapest decoding wins.  Stretches are decoded around unknown words and spelled-out
letters and run over line ends: a word in pieces is merged across them, and a run of words without blanks is split
into any number of known words.  Lines are then joined to paragraphs;
the boundaries are chosen by dynamic programming over the line ends (a line that ends a sentence and is short ends a
paragraph cheaply) with a cost for very short and very long paragraphs.

Lexicon: words with at least max(MIN_COUNT, SHARE of all words) occurrences, so at most 1 / SHARE words, however large
the corpus; what is broadcast is bounded by that, and each worker builds it once.  Words that are one confusion away
from a word RATIO times as frequent are taken out: frequent misreadings.  Rarer words with MIN_COUNT occurrences that
are no such misreadings are known, too: they are never what a misread word is read as, but they stay as they are.
They are broadcast where they are at most RARE; where there are more, each text is joined with those of them that its
reading can ask for (its words and all that marks at line ends may join), so both ways give the same rows.

Only rows of sources of kind ``scan`` and rows without source are read.  For a row without source the titles of all
scanned sources count.  Null and empty texts have no noise.  Texts are read whole; repeated rows each count.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.llm import site_lines
from daftar.llm.lookalikes import canonical, suspicious
from daftar.llm.site_lines import keyed
from daftar.llm.codes import nfkc
from daftar.llm.split_overlap import edit_distance
from daftar.session import cut, small

MIN_COUNT, SHARE, RATIO = 3, 1e-6, 100
#: Share of a title's letters that may be misread in a header line.
HEADER = 0.15
#: Lines that may stand between the two halves of a broken word.
BETWEEN = 3
#: Letters of the longest words in the lexicon; most pieces of one word; rare words that are broadcast.
LONGEST, PIECES, RARE = 40, 12, 500_000
BLOCK = 500

_MARK = re.compile(r"(?<=\w)(?:[-‐‑¬­]+|ـ+[-¬]?)\s*$")
_NUMBER = r"[0-9٠-٩۰-۹]{1,5}"
# Ways a page number is written on a line.
_PAGE = re.compile(rf"^\s*(?:(?:صفحة|صحيفة|ص|page\s*number|page|p|pg|n[°o])\s*[.:]?\s*)?[-–—•·*\[\](){{}}|~ـ\s]*{_NUMBER}(?:\s*(?:/|من|of|sur)\s*{_NUMBER})?[-–—•·*\[\](){{}}|~ـ.\s]*$", re.IGNORECASE)
_EDGE_NUMBER = re.compile(rf"^\s*(?:{_NUMBER}[\s|—–\-•.:]+(?=\D))?(.*?)(?:[\s|—–\-•.:]+{_NUMBER})?\s*$")
_HAS_EDGE_NUMBER = re.compile(rf"^\s*{_NUMBER}\s*[\s|—–\-•.:]|[\s|—–\-•.:]\s*{_NUMBER}\s*$")
_EDGES = ".,،؛;:!?؟()[]{}«»\"“”‘’'…*•-–—/\\|"
_NOT_WORD = re.compile(r"[^\w]+")
_TASHKEEL = re.compile("[\u0640\u064b-\u065f\u0670]+")
# Signs and sequences that stand for letters in scanned text.
_MISREAD = {
    "1": "الli", "|": "ال", "[": "ل", ")": "ر", "(": "ر", "9": "وعg", "٩": "و", "٥": "ه", "5": "s", "3": "ع", "٣": "م", "~": "س", "0": "o", "@": "a", "+": "t", "!": "il", "$": "s", "٧": "v", "6": "bG", "8": "B", "٨": "ل", "4": "A", "7": "T", "2": "z", "٦": "ر", "١": "ا",
}
_PAIRS = {"أل": "ا", "rn": "m", "ri": "n", "ii": "u", "cl": "d", "vv": "w", "li": "h", "ni": "m", "nn": "m", "tl": "d", "لا": "ال"}
_STRAY = re.compile(r"[\^#~_*·¦|+@!`'´¨=<>°•,.;:\-]")


def fold(word: str) -> str:
    """Lower case, without diacritics and elongation."""
    return _TASHKEEL.sub("", word).lower()


class Lexicon:
    def __init__(self, counts: dict[str, int]):
        total = max(1, sum(counts.values()))
        wild: dict[str, int] = {}
        for w, n in counts.items():
            for i in range(len(w)):
                p = w[:i] + "\0" + w[i + 1 :]
                if wild.get(p, 0) < n:
                    wild[p] = n
        self.cost = {}
        self.wild: dict[str, str] = {}
        for w, n in counts.items():
            rival = max((wild[w[:i] + "\0" + w[i + 1 :]] for i in range(len(w))), default=0)
            bare = counts.get(_STRAY.sub("", w), 0) if _STRAY.search(w) else 0
            signs = max((counts.get(w[:i] + y + w[i + 1 :], 0) for i, x in enumerate(w) for y in _MISREAD.get(x, "")), default=0)
            pairs = max((counts.get(w.replace(a, b, 1), 0) for a, b in _PAIRS.items() if a in w), default=0)
            if max(rival, bare, signs, pairs) < RATIO * n or w.isdigit():
                self.cost[w] = -math.log(n / total)
        best: dict[str, tuple] = {}
        for w, c in self.cost.items():
            if any(x.isalpha() for x in w):
                for i in range(len(w)):
                    p = w[:i] + "\0" + w[i + 1 :]
                    if p not in best or best[p] > (c, w):
                        best[p] = (c, w)
        self.wild = {p: w for p, (_, w) in best.items()}
        self.starts = {w[:i] for w in self.cost for i in range(1, len(w))}
        self.ends = {w[i:] for w in self.cost for i in range(1, len(w))}
        self.memo: dict[str, tuple] = {}
        self.breaks: dict[str, tuple | None] = {}
        self.counts = counts
        self.rare: frozenset | set = frozenset()

    def misreading(self, word: str, n: int) -> bool:
        """Whether a rare word is one confusion away from a word of the lexicon that is RATIO times as frequent."""
        rivals = [self.counts[v] for i in range(len(word)) if (v := self.wild.get(word[:i] + "\0" + word[i + 1 :])) and len(word) > 2]
        r = self._reading(word)
        if r and r[0]:
            rivals.append(self.counts.get(fold(r[1]).strip(_EDGES), 0))
        return max(rivals, default=0) >= RATIO * n

    def broken(self, word: str) -> tuple[float, str] | None:
        """Cheapest way to read a word as two or more known words of at least two letters run together: cost, text."""
        if word not in self.breaks:
            if len(self.breaks) > 300_000:
                self.breaks.clear()
            best: list[tuple] = [(0.0, ())] + [(math.inf, ())] * len(word)
            for j in range(2, len(word) + 1):
                for i in range(max(0, j - LONGEST), j - 1):
                    c = self.cost.get(word[i:j])
                    if c is not None and (i or j < len(word)) and best[i][0] + c + 5 < best[j][0]:
                        best[j] = (best[i][0] + c + 5, (*best[i][1], word[i:j]))
            self.breaks[word] = (best[-1][0] - 5, " ".join(best[-1][1])) if best[-1][1] else None
        return self.breaks[word]

    def core(self, token: str, rare: frozenset | set | None = None) -> str:
        """The known word in a token, or "" where it has no letters; None where unknown."""
        rare = self.rare if rare is None else rare
        w = fold(token)
        if w in self.cost or w in rare:
            return w
        s = w.strip(_EDGES)
        if s in self.cost or s in rare or not any(x.isalpha() for x in s):
            return s if any(x.isalpha() for x in s) or not re.search(r"[^\W\d]|\d\D+\d", w) else s
        parts = [x for x in re.split(r"[-'’/.,،؛;:()«»\"]+", s) if x]
        if len(parts) > 1 and all(x in self.cost or x.isdigit() for x in parts):
            return s
        return None

    def reading(self, token: str) -> tuple | None:
        """(misread?, word, cost) of a token; None where it cannot be told."""
        known = self.memo.get(token)
        if known is None:  # without rare words, as each text may have its own
            w = fold(token)
            s = w.strip(_EDGES)
            known = (self._reading(token), () if w in self.cost or len(token) > LONGEST + 8 else (w,) if s in self.cost else (w, s))
            if len(self.memo) > 300_000:
                self.memo.clear()
            self.memo[token] = known
        out, unknown = known
        return (False, token, 12.0) if any(x in self.rare for x in unknown) else out

    def _reading(self, token: str) -> tuple | None:
        if len(token) > LONGEST + 8:
            return None  # longer than any known word
        w = self.core(token, frozenset())
        if w is not None:
            return (False, token, self.cost.get(w, 12.0))
        w = fold(token)
        options = []
        for s in dict.fromkeys((w, w.strip(_EDGES), w.rstrip(_EDGES), w.lstrip(_EDGES), w.rstrip(".,،؛;:؟?!"))):
            if sum(x.isalpha() for x in s) < 2 and len(s) < 3:
                continue
            at = w.find(s)
            before, after = w[:at], w[at + len(s) :]
            forms = {s: 6.0}
            for i, x in enumerate(s):
                if _STRAY.match(x):
                    forms[s[:i] + s[i + 1 :]] = 6.0
                for y in _MISREAD.get(x, ""):
                    forms[s[:i] + y + s[i + 1 :]] = 6.0
            for a, b in _PAIRS.items():
                j = s.find(a)
                while j >= 0:
                    forms[s[:j] + b + s[j + len(a) :]] = 7.0
                    j = s.find(a, j + 1)
            for f, c in forms.items():
                if f != s and f in self.cost:
                    options.append((c + self.cost[f], before + f + after))
                for i in range(len(f)):
                    v = self.wild.get(f[:i] + "\0" + f[i + 1 :])
                    if v and len(f) > 2:
                        options.append((c + (6.0 if f == s else 8.0) + self.cost[v], before + v + after))
        if options:
            c, v = min(options)
            return (True, v[:1].upper() + v[1:] if token[:1].isupper() else v, c)
        return None


OUT = 30.0


def decode(tokens: list[str], lex: Lexicon) -> list[tuple[str, str, int]]:
    """Cheapest reading of a stretch of tokens: (kind, text, tokens read) with kind keep, misread, split or merge."""
    n = len(tokens)
    folded = [fold(t) for t in tokens]
    readings = [lex.reading(t) for t in tokens]
    letter = [len(w) == 1 and w.isalpha() for w in folded]
    known = [bool(r) and not r[0] and not one for r, one in zip(readings, letter)]
    best: list[tuple] = [(0.0, None)] + [(math.inf, None)] * n
    for i in range(n):
        c0, r = best[i][0], readings[i]
        steps = [(1, "misread", r[1], r[2] + 4) if r and r[0] else (1, "keep", tokens[i], r[2] if r else OUT)]
        if not r or r[0]:
            if two := lex.broken(folded[i].strip(_EDGES)):  # words run together
                steps.append((1, "split", two[1], two[0]))
            steps.append((1, "keep", tokens[i], OUT))
        for j in range(i + 2, min(n, i + PIECES) + 1):  # one word in pieces: known words are none, unless one is unknown
            if all(known[i:j]):
                continue
            w = "".join(folded[i:j])
            if len(w) > LONGEST + 8:
                break
            if (w := w.strip(_EDGES)) in lex.cost:
                steps.append((j - i, "merge", "".join(tokens[i:j]), lex.cost[w] + 4 + (j - i) / 2))
        for size, kind, text, cost in steps:
            if c0 + cost < best[i + size][0]:
                best[i + size] = (c0 + cost, (i, kind, text))
    out, i = [], n
    while i:
        at, kind, text = best[i][1]
        out.append((kind, text, i - at))
        i = at
    return out[::-1]


def letters(text: str) -> str:
    return "".join(x for x in fold(text) if x.isalpha())


def is_header(line: str, titles: list[str]) -> bool:
    """Whether a line is one of the titles (given by their letters), perhaps misread, perhaps with a number at an edge."""
    size = len(line) - line.count(" ")
    if all(size < 0.8 * len(t) - 3 or size > 1.3 * len(t) + 16 for t in titles):
        return False
    m = _EDGE_NUMBER.match(line)
    bare = m.group(1) if m else line
    some = [x for x in fold(bare) if not x.isspace()]
    for t in titles:
        if abs(len(some) - len(t)) <= max(2, HEADER * len(t) + 2) and (edit_distance(list(t), some) <= max(1, HEADER * len(t))):
            return True
    return False


class Page:
    """The lines of a text, sorted into noise and text."""

    def __init__(self, text: str, titles: list[str], skip: set[int], lex: Lexicon):
        self.lines, self.lex = text.split("\n"), lex
        sizes = {len(t) for t in titles}
        low, high = (min(sizes) - 8, max(sizes) * 1.6 + 20) if sizes else (1, 0)
        self.kinds: set[str] = set()
        self.dropped = [False] * len(self.lines)
        for i, line in enumerate(self.lines):
            if len(line) < 26 and line.strip() and _PAGE.match(line):
                self.kinds.add("page_number")
                self.dropped[i] = True
            elif low <= len(line) <= high and is_header(line, titles):
                self.kinds.add("header")
                if _HAS_EDGE_NUMBER.search(line):
                    self.kinds.add("page_number")
                self.dropped[i] = True
        self.skip = skip
        self._join()

    def _known(self, a: str, b: str, line: list[str]) -> str | None:
        """How two halves belong together: "joined", "hyphen" (a compound at the line's end) or not at all."""
        one, two = fold(a + b).strip(_EDGES), fold(a + "-" + b).strip(_EDGES)
        if one in self.lex.cost or self.lex.core(a + b):
            return "joined"
        if two in self.lex.cost or self.lex.core(two):
            return "hyphen"
        r = self.lex.reading(a + b)
        return "joined" if r and r[0] else None

    def _join(self) -> None:
        words = [x.split() for x in self.lines]
        self.misread_joins = 0
        for i, line in enumerate(self.lines):
            if self.dropped[i] or not words[i] or not (m := _MARK.search(line)):
                continue
            a = line[: m.start()].split()[-1]
            options = [j for j in range(i + 1, min(len(words), i + 2 + BETWEEN)) if words[j]]
            # lines of text come first, then any line
            for j in sorted(options, key=lambda j: (self.dropped[j] or j in self.skip, j)):
                if self.dropped[j]:
                    continue
                b = words[j][0]
                how = self._known(a, b, words[j])
                if how == "joined":
                    self.kinds.add("hyphen")
                    words[i][-1] = a + b
                    words[j] = words[j][1:]
                    break
                if how == "hyphen":
                    words[i][-1] = a + "-" + b
                    words[j] = words[j][1:]
                    break
            else:
                if options and not self.lex.core(a) and "¬" in m.group(0) + line[-3:]:
                    self.kinds.add("hyphen")
        self.words = words

    def read(self) -> list[list[str]]:
        """Words of each line that stays, misread, broken and run-together ones corrected; a merged word stays on its first line."""
        out: list[list[str]] = [[] if d else list(w) for d, w in zip(self.dropped, self.words)]
        text = [i for i, w in enumerate(self.words) if w and not self.dropped[i]]
        stream = [(i, t) for i in text if i not in self.skip for t in self.words[i]]
        if not stream:
            return out
        lex = self.lex
        readings = [lex.reading(t) for _, t in stream]
        single = [len(t) == 1 and t.isalpha() for _, t in stream]
        bad = [k for k, r in enumerate(readings) if r is None or r[0] or single[k] and any(single[max(0, k - 2) : k]) and any(single[k + 1 : k + 3])]
        # a text may begin and end within a word
        if bad and bad[-1] == len(stream) - 1 and stream[-1][0] == text[-1] and fold(stream[-1][1]).strip(_EDGES) in lex.starts and stream[-1][1][-1:].isalpha():
            bad.pop()
        if bad and bad[0] == 0 and stream[0][0] == text[0] and fold(stream[0][1]).strip(_EDGES) in lex.ends:
            bad.pop(0)
        if not bad:
            return out
        for i in text:
            if i not in self.skip:
                out[i] = []
        at = n = 0
        while at < len(stream):
            while n < len(bad) and bad[n] < at:
                n += 1
            if n == len(bad):
                break
            lo, hi = max(at, bad[n] - 1), min(len(stream), bad[n] + 2)
            while n + 1 < len(bad) and bad[n + 1] <= hi:  # neighbours that are bad as well belong to the stretch
                n += 1
                hi = min(len(stream), bad[n] + 2)
            for i, t in stream[at:lo]:
                out[i].append(t)
            for kind, new, size in decode([t for _, t in stream[lo:hi]], lex):
                if kind == "misread":
                    self.kinds.add("char")
                out[stream[lo][0]] += new.split(" ")
                lo += size
            at = hi
        for i, t in stream[at:]:
            out[i].append(t)
        return out

    def paragraphs(self) -> str:
        """The text in paragraphs, without noise lines."""
        lines = self.read()
        rows = [(i, " ".join(w)) for i, w in enumerate(lines) if w]
        if not rows:
            return ""
        width = sorted(len(t) for _, t in rows)[int(0.8 * (len(rows) - 1))]
        n = len(rows)
        sizes = np.cumsum([0, *(len(t) + 1 for _, t in rows)]).tolist()
        ends = []
        for k, (i, t) in enumerate(rows):
            stop = t[-1:] in ".!?؟؛:»\")"
            blank = k + 1 < n and any(not self.lines[j].strip() for j in range(i + 1, rows[k + 1][0]))
            ends.append((0.0 if stop else 6.0) + (0.0 if len(t) < 0.85 * width else 2.0) - (4.0 if blank else 0.0))
        best = [0.0] + [math.inf] * n
        back = [0] * (n + 1)
        for j in range(1, n + 1):
            for k in range(j - 1, -1, -1):
                size = sizes[j] - sizes[k]
                c = best[k] + 1.5 + (ends[j - 1] if j < n else 0.0) + (3.0 if size < 40 else 0.0) + max(0.0, (size - 1500) / 300)
                if c < best[j]:
                    best[j], back[j] = c, k
                if size > 6000:
                    break
        cuts, j = [], n
        while j:
            cuts.append((back[j], j))
            j = back[j]
        return "\n".join(" ".join(t for _, t in rows[a:b]) for a, b in reversed(cuts))


def _tidy(texts: list) -> list[str]:
    """Line structure as it is; look-alikes and invisible characters in their one form (soft hyphens at line ends stay marks)."""
    texts = ["" if t is None else re.sub("­(?=[ \t]*\n)", "-", t) for t in texts]
    for j in np.flatnonzero(suspicious(texts)):
        texts[j] = canonical(texts[j])
    return texts


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: Counter = Counter()
    raw: Counter = Counter()

    def drain() -> None:
        for t, n in raw.items():
            w = fold(unicodedata.normalize("NFKC", t))
            total[w] += n
            s = w.strip(_EDGES)
            if s != w and s:
                total[s] += n
            for p in re.split(r"[-'’]", s) if re.search(r"[-'’]", s) else ():
                if p:
                    total[p] += n
        raw.clear()

    for pdf in batches:
        for t in pdf.text:
            raw.update(t.split())
        drain()
        if len(total) > 500_000:
            yield pd.DataFrame(list(total.items()), columns=["word", "n"])
            total = Counter()
    yield pd.DataFrame(list(total.items()), columns=["word", "n"])


def counted(texts: DataFrame) -> tuple[DataFrame, float]:
    """word, n of all texts (column text), long ones aside, and from how many occurrences a word is in the lexicon."""
    n = cut(texts.where("text is not null").select("text").mapInPandas(_count, "word string, n long").where(F.length("word").between(1, LONGEST)).groupBy("word").agg(F.sum("n").alias("n")))
    total = n.agg(F.sum("n")).first()[0] or 0
    return n, max(MIN_COUNT, SHARE * total)


def lexicon(texts: DataFrame) -> dict[str, int]:
    """Frequent words of all texts (column text) with their counts: at most 1 / SHARE words."""
    n, least = counted(texts)
    return {r.word: r.n for r in n.where(F.col("n") >= least).toLocalIterator()}


_BUILT: dict[str, Lexicon] = {}


def _built(token: str, counts) -> Lexicon:
    """The lexicon of a broadcast, built once in a worker; the one before goes."""
    if token not in _BUILT:
        _BUILT.clear()
        _BUILT[token] = Lexicon(counts.value)
    return _BUILT[token]


def _rare(counts: DataFrame, least: float, token: str, lex) -> DataFrame:
    """Words below the lexicon's bound that are no misreadings."""

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lx = _built(token, lex)
        lx.rare = frozenset()
        for pdf in batches:
            yield pd.DataFrame({"word": pd.Series([w for w, n in zip(pdf.word, pdf.n) if not w.isdigit() and not lx.misreading(w, n)], dtype=object)})

    return cut(counts.where((F.col("n") >= MIN_COUNT) & (F.col("n") < least)).mapInPandas(keep, "word string"))


def asked(text: str) -> set[str]:
    """All words that the reading of a text can look up: its own, and those that a mark at a line's end may join.

    A line may lose a first word to each of the BETWEEN + 1 lines before it.
    """
    lines = text.split("\n")
    words = [x.split() for x in lines]
    tokens = {t for line in words for t in line}
    for i, line in enumerate(lines):
        if m := _MARK.search(line):
            a = line[: m.start()].split()[-1]
            tokens.add(a)
            for j in range(i + 1, min(len(words), i + 2 + BETWEEN)):
                tokens.update(a + mark + b for b in words[j][: BETWEEN + 1] for mark in ("", "-"))
    folded = {fold(t) for t in tokens}
    return folded | {w.strip(_EDGES) for w in folded}


def _with_rare(texts: DataFrame, rare: DataFrame, token: str, lex) -> DataFrame:
    """texts with the rare words that each asks for (column rare): only words outside the lexicon are shuffled."""

    def strange(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lx = _built(token, lex)
        for pdf in batches:
            out = []
            for name, key, text in zip(pdf.table_name, pdf.row_key, _tidy(list(pdf.text))):
                out += [(name, key, w) for w in asked(text) if w and w not in lx.cost]
            yield pd.DataFrame(out, columns=["table_name", "row_key", "word"])

    has = texts.select("table_name", "row_key", "text").mapInPandas(strange, "table_name string, row_key long, word string")
    has = has.join(rare, "word").groupBy("table_name", "row_key").agg(F.collect_set("word").alias("rare"))  # words of one text
    return texts.drop("rare").join(has, ["table_name", "row_key"], "left")


def _texts(chunks: DataFrame, qa: DataFrame) -> DataFrame:
    a = chunks.select(F.lit("chunks").alias("table_name"), F.col("chunk_key").alias("row_key"), "source", F.col("page_content").alias("text"))
    return a.union(qa.select(F.lit("qa_pairs"), "row_id", "source", "context"))


def _scanned(chunks: DataFrame, qa: DataFrame, sources: DataFrame, result, schema: str) -> DataFrame:
    """result(page, table_name, row_key) -> rows, over all texts that may be scanned."""
    spark = chunks.sparkSession
    every = _texts(chunks, qa).where("text is not null")
    counts, least = counted(every)
    lex, token = spark.sparkContext.broadcast({r.word: r.n for r in counts.where(F.col("n") >= least).toLocalIterator()}), uuid.uuid4().hex
    rare = _rare(counts, least, token, lex)
    few = small(rare, RARE)
    everywhere = spark.sparkContext.broadcast({r.word for r in rare.toLocalIterator()} if few else None)
    scans = sources.where("kind = 'scan'").select("source", "title")
    side = F.broadcast if small(scans, 10_000) else lambda x: x
    # titles for rows without source: those of all scanned sources, a stated table that is small beside the texts
    titles = spark.sparkContext.broadcast(sorted({r.title for r in scans.where("title is not null").select("title").toLocalIterator()}))
    lines = site_lines.repeated(chunks.join(side(scans.select("source")), "source", "left_semi")).select("source", "key").distinct()
    by = lines.groupBy("source").agg(F.collect_set("key").alias("repeated"))  # at most (lines of a row) / MIN_SHARE a source
    meta = scans.join(by, "source", "left")
    texts = every.where("source is not null").join(side(meta), "source").select("table_name", "row_key", "source", "text", "title", "repeated")
    texts = texts.union(every.where("source is null").select("table_name", "row_key", "source", "text", F.lit(None).cast("string"), F.lit(None).cast("array<long>")))
    texts = texts.withColumn("rare", F.lit(None).cast("array<string>"))
    if not few:
        texts = _with_rare(texts, rare, token, lex)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lx = _built(token, lex)
        lx.rare = everywhere.value or frozenset()
        everyone = [y for y in ([x for x in fold(t) if not x.isspace()] for t in titles.value) if y]
        bare: dict = {None: []}
        sets: dict = {}
        for pdf in batches:
            for i in range(0, len(pdf), BLOCK):
                p = pdf.iloc[i : i + BLOCK]
                out = []
                originals = list(p.text)
                tidy = _tidy(originals)
                parts = [t.split("\n") for t in nfkc(tidy)]
                keys, real, _ = keyed([x for part in parts for x in part], bands=0)
                at = row = 0
                for name, key, source, text, title, rep, part in zip(p.table_name, p.row_key, p.source, tidy, p.title, p.repeated, parts):
                    if not few:
                        lx.rare = frozenset() if p.rare.iat[row] is None else frozenset(p.rare.iat[row])
                    row += 1
                    source, title = (None if pd.isna(x) else x for x in (source, title))
                    if title not in bare:
                        t = [x for x in fold(title) if not x.isspace()]
                        bare[title] = [t] if t else []
                    own = ()
                    if rep is not None and name == "chunks":
                        own = sets.get(source)
                        if own is None:
                            own = sets[source] = set(rep.tolist())
                    skip = {j for j in range(len(part)) if real[at + j] and keys[at + j] in own} if own else set()
                    at += len(part)
                    out += result(Page(text, everyone if source is None else bare[title], skip, lx), name, key, text)
                yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    return texts.mapInPandas(scan, schema)


def _kinds(page: Page, name: str, key: int, text: str) -> list:
    page.read()
    return [(name, key, k) for k in sorted(page.kinds)]


def found(chunks: DataFrame, qa: DataFrame, sources: DataFrame) -> DataFrame:
    """table_name, row_key, noise."""
    return _scanned(chunks, qa, sources, _kinds, "table_name string, row_key long, noise string")


def _repaired(page: Page, name: str, key: int, text: str) -> list:
    new = page.paragraphs()
    return [(name, key, new, len(page.kinds))]


def repaired(chunks: DataFrame, qa: DataFrame, sources: DataFrame) -> DataFrame:
    """table_name, row_key, text in paragraphs, number of kinds of noise it had."""
    return _scanned(chunks, qa, sources, _repaired, "table_name string, row_key long, text string, noises int")
