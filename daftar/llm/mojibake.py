"""Problem 10: text that was decoded with the wrong character encoding.

Method: code-page swaps as substitution ciphers, learned by expectation-maximisation against language bigrams and
applied with translate().  A wrong decoding replaces every byte (or byte sequence) of the true code page by a fixed
character of the assumed one.  Two rounds of EM:

1. Which swap (key: a pair of code pages, also UTF-8 read as single bytes, once or twice) garbled a document is
   hidden.  E step: the probability of each key, from the bigram likelihood of the document's suspicious words under
   the key times the source's share of the key.  M step: the shares of the keys of each source.  A document is
   garbled if the best key makes its words likelier than they are by GAIN nats (each word by WORD_GAIN).
2. For single-byte swaps, and for documents of mostly strange letters that no key explains (unknown swaps), the
   mapping itself is learned per source and swap (ciphers.learn): emissions of characters by letters, started from
   the key's table, or from letter frequencies where there is none, are fitted to all pairs of characters of the
   source's suspicious words.  The learned tables are what translate() applies, and what decides: a document counts as
   garbled if the learned letters make its words likelier by as much.

Correct text of another language also becomes likelier under some key.  So the restored words must read as the
corpus does: with their neighbours (NEAR words on both sides, as they are), their mean log-likelihood per pair of
letters may lie at most SLACK, and what chance makes of so few letters, below the mean of all ordinary text.

UTF-8 keys have nothing to learn: the sequences are decoded.

Also garbled, but past restoring: documents with replacement characters, with control characters of the C1 block
that no key explains, or with runs of words that are question marks only.

Bigrams: counted over all documents, on lines of ordinary characters only; the table has a fixed number of symbols
(_symbols), so what is broadcast does not grow.  Rare but correct characters are no case, as no key makes them
likelier.

Null and empty texts are no cases.  Texts are read whole.  Repeated rows each count.  Extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.llm import ciphers
from daftar.llm.codes import flatten
from daftar.llm.lookalikes import forms
from daftar.session import cut, small

GAIN, WORD_GAIN = 8.0, 2.0
ROUNDS = 3
#: Documents that may have an unknown swap: strange letters in their strange words, at least so many and such a share.
UNKNOWN_LETTERS, UNKNOWN_SHARE = 40, 0.6
#: Probability from which a learned letter is applied.
SURE = 0.5
#: Where a key of single bytes changes fewer letters (of Latin text twice as many), one must be out of place;
#: log-likelihood of two scripts in one word; share of the strange characters that must belong to the key's code page.
MIN_LETTERS, MIXED, FIT = 4, -25.0, 0.5
#: Share of words with letters of two scripts that a restored text may have.
MIXED_WORDS = 0.2
#: Share of the characters of an unknown swap that must have a letter of their own.
ONE_TO_ONE = 0.6
#: Words around a restored one that are read with it; nats a letter that it may read worse than ordinary text.
NEAR, SLACK = 2, 0.5
BLOCK = 1000

# Code pages a text may have been read with, and single-byte ones it may truly be in.
READ_AS = ["latin_1", "cp1252", "cp1250", "cp1251", "cp1254", "cp1256", "mac_roman", "cp437", "cp850", "cp866", "koi8_r", "iso8859_6", "iso8859_15"]
TRUE_ARABIC = ["cp1256", "iso8859_6", "cp720", "mac_arabic"]
TRUE_LATIN = ["cp1252", "mac_roman", "cp437", "cp850"]

#: Ordinary characters of the three languages: what is not among them makes a word suspicious.
_ORDINARY = "\n\t" + "".join(map(chr, range(32, 127))) + "àâçèéêëîïôùûœÀÇÈÉÊÎÔŒ«»’‘“”–—…€£§°±÷•" + "".join(map(chr, [*range(0x60C, 0x60D), 0x61B, 0x61F, *range(0x621, 0x653), *range(0x660, 0x66D), 0x670, 0x671]))


@functools.cache
def _ordinary() -> np.ndarray:
    """Ordinary characters, and blanks, invisible ones and look-alikes of problem 4, which are no sign of a wrong decoding."""
    out = np.zeros(0x110000, bool)
    out[[ord(x) for x in _ORDINARY]] = True
    for c in [0xA0, 0xAD, *range(0x300, 0x6FF), 0x180E, *range(0x2000, 0x2100), 0x3000, *range(0xFB50, 0xFFF0)]:
        if c in forms() and c not in range(0x2018, 0x2027):
            out[c] = True
    out[0x653:0x656] = True
    return out


def _strange(codes: np.ndarray) -> np.ndarray:
    """Of each code point whether it is not ordinary, or ordinary only by itself: a frequent first byte of UTF-8 before a sign, an Arabic letter behind a Latin one."""
    out = ~_ordinary()[codes]
    for lead in (0xE2, 0x622, 0x623):
        at = np.flatnonzero(codes[:-1] == lead)
        after = codes[at + 1]
        out[at[(after > 127) & ~((after >= 0x620) & (after < 0x660))]] = True
    latin = ((codes[:-1] | 32) >= 97) & ((codes[:-1] | 32) <= 122)
    out[1:] |= latin & (codes[1:] >= 0x621) & (codes[1:] <= 0x64A)
    return out


@functools.cache
def _cases() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters, small ones, capitals."""
    every = [chr(c) for c in range(0x10000)]
    return tuple(np.array([f(x) for x in every]) for f in (str.isalpha, str.islower, str.isupper))


def _misplaced(codes: np.ndarray) -> np.ndarray:
    """Strange characters that no correct word has there: behind a letter a capital after a small one, a letter of another script, or a sign before a letter."""
    letter, lower, upper = (x[codes] for x in _cases())
    before, behind = np.r_[False, letter[:-1]], np.r_[letter[1:], False]
    capital = upper & np.r_[False, lower[:-1]]
    other = letter & (codes >= 0x250) & np.r_[False, codes[:-1] < 0x250]
    return _strange(codes) & before & (capital | other | ~letter & behind)


@functools.cache
def _strange_sign() -> re.Pattern:
    """_strange as a pattern, for single words."""
    ok = "".join(map(re.escape, map(chr, np.flatnonzero(_ordinary()).tolist())))
    return re.compile(f"[^{ok}]|[\u00e2\u0622\u0623](?=[^\\x00-\\x7f\u0620-\u065f])|(?<=[A-Za-z])[\u0621-\u064a]")


@functools.cache
def _symbols() -> np.ndarray:
    """Code point -> symbol of the bigram table: ordinary ones (capitals as small, digits as 0), and 0 for all others."""
    out = np.zeros(0x110000, np.int32)
    known = {}
    for x in _ORDINARY:
        y = "0" if x.isdigit() else x.lower()
        out[ord(x)] = known.setdefault(y, len(known) + 1)
    return out


@functools.cache
def _plausible() -> np.ndarray:
    """Ordinary characters and other Latin letters."""
    out = _symbols() > 0
    out[0xC0:0x250] = True
    return out


def size() -> int:
    return int(_symbols().max()) + 1


def _bytes_of(codec: str) -> list[str]:
    """Character of each byte; bytes a code page does not define stay what they are (as lenient decoders do)."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


class Key:
    """One wrong decoding: read as ``read``, truly ``true``, ``times`` times."""

    def __init__(self, read: str, true: str, times: int = 1):
        self.name, self.true, self.times = f"{true} as {read}" + f" x{times}" * (times > 1), true, times
        chars = _bytes_of(read)
        self.memo: dict[str, str] = {}
        self.inside = np.zeros(0x10000, bool)  # characters that can come from a byte above 127
        self.inside[[ord(c) for c in chars[128:]]] = True
        if true == "utf_8":
            self.table = {ord(c): b for b, c in enumerate(chars) if ord(c) != b}
            self.byte = np.full(0x10000, 255, np.uint8)
            self.byte[[ord(c) for c in chars]] = np.arange(256)
        else:
            to = _bytes_of(true)
            self.table = {ord(c): to[b] for b, c in enumerate(chars) if b > 127 and to[b] != c}
            self.symbol = _symbols()[:0x10000].copy()
            for c, x in self.table.items():
                self.symbol[c] = _symbols()[ord(x)]
            self.changes = np.zeros(0x10000, bool)
            self.changes[list(self.table)] = True

    def restore(self, text: str) -> str:
        """The text before the wrong decoding; U+FFFD where the key does not fit."""
        if self.true != "utf_8":
            return text.translate(self.table)
        for _ in range(self.times):
            back = text.translate(self.table)
            try:
                raw = back.encode("latin_1")
            except UnicodeEncodeError:
                raw = "".join(x if x < "Ā" else "ÿ" for x in back).encode("latin_1")
            text = raw.decode("utf_8", "replace")
        return text


    def _remember(self, word: str) -> str:
        if len(self.memo) > 20_000:
            self.memo.clear()
        self.memo[word] = self.restore(word)
        return self.memo[word]

    def symbols(self, codes: np.ndarray) -> np.ndarray | None:
        """Symbols of the restored text; None where the key changes nothing, or few letters that all may be correct rare ones."""
        if self.true != "utf_8":
            n = np.count_nonzero(self.changes[codes])
            enough = n >= (MIN_LETTERS if self.true in TRUE_ARABIC else 2 * MIN_LETTERS)
            return self.symbol[codes] if enough or n and (self.changes[codes] & _misplaced(codes)).any() else None
        raw = self.byte[codes].tobytes()
        for _ in range(self.times - 1):
            raw = self.byte[np.frombuffer(raw.decode("utf_8", "replace").encode("utf-16-le"), np.uint16)].tobytes()
        text = raw.decode("utf_8", "replace")
        out = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if not ((out > 127) & _plausible()[out]).any():
            return None
        if (out == 0xFFFD).any():  # only the words the key turns into plausible ones; the others stay
            some = codes.astype(np.uint32).tobytes().decode("utf-32-le", "replace").split(" ")
            back = [w if w.isascii() else self.memo.get(w) or self._remember(w) for w in some]
            back = [x if all(_plausible()[ord(c)] for c in x) else w for w, x in zip(some, back)]
            if back == some:
                return None
            out = np.frombuffer(" ".join(back).encode("utf-32-le", "surrogatepass"), np.uint32)
        return _symbols()[out]


@functools.cache
def keys() -> list[Key]:
    out = [Key(r, "utf_8") for r in READ_AS] + [Key(r, "utf_8", 2) for r in ("cp1252", "latin_1", "cp1256", "mac_roman", "cp437")]
    out += [Key(r, t) for t in TRUE_ARABIC for r in READ_AS if r != t]
    return out + [Key(r, t) for t in TRUE_LATIN for r in READ_AS if r != t and {r, t} != {"latin_1", "cp1252"} or (r, t) == ("latin_1", "cp1252")]


def _bigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    n = size()
    total = np.zeros(n * n, np.int64)
    for pdf in batches:
        for i in range(0, len(pdf), BLOCK):
            codes, _ = flatten(list(pdf.text.iloc[i : i + BLOCK]))
            s = _symbols()[codes]
            odd = np.flatnonzero(s == 0)
            breaks = np.flatnonzero(codes == 10)
            bad = np.zeros(len(breaks) + 1, bool)
            bad[np.searchsorted(breaks, odd)] = True  # lines with other characters teach nothing
            line = np.cumsum(codes == 10)
            good = ~bad[line - (codes == 10)]
            pair = s[:-1] * n + s[1:]
            total += np.bincount(pair[good[:-1] & good[1:]], minlength=n * n)
    at = np.flatnonzero(total)
    yield pd.DataFrame({"pair": at, "n": total[at]})


def bigrams(documents: DataFrame) -> DataFrame:
    """pair, n: occurrences of two symbols in a row, over all documents."""
    return documents.where("text <> ''").select("text").mapInPandas(_bigrams, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def model(counts: pd.DataFrame) -> np.ndarray:
    """log P(second | first), interpolated with the second's own share."""
    n = size()
    c = np.zeros(n * n)
    c[counts.pair.to_numpy(np.int64)] = counts.n.to_numpy()
    c = c.reshape(n, n)
    own = (c.sum(0) + 0.02) / (c.sum() + 0.02 * n)
    own[0] = 1e-7
    out = np.log((c + 5 * own[None, :]) / (c.sum(1, keepdims=True) + 5))
    # letters of two scripts side by side are no word
    arabic, latin = np.zeros(n, bool), np.zeros(n, bool)
    for x in _ORDINARY:
        if x.isalpha():
            (arabic if "\u0600" <= x <= "\u06ff" else latin)[_symbols()[ord(x)]] = True
    out[np.outer(arabic, latin) | np.outer(latin, arabic)] = MIXED
    return out.astype(np.float32)


def _sum(lm: np.ndarray, s: np.ndarray) -> float:
    return float(lm.ravel().take(s[:-1] * lm.shape[0] + s[1:]).sum())


def likelihood(lm: np.ndarray, text: str) -> float:
    return _sum(lm, _symbols()[np.frombuffer((" " + text + " ").encode("utf-32-le", "surrogatepass"), np.uint32)])


@functools.cache
def _stationary(lm_bytes: bytes) -> tuple[float, float]:
    lm = np.frombuffer(lm_bytes, np.float32).reshape(size(), size())
    p = np.exp(lm.astype(np.float64))
    p /= p.sum(1, keepdims=True)
    own = np.full(len(p), 1 / len(p))
    for _ in range(50):
        own = own @ p
    joint = own[:, None] * p
    mean = float((joint * lm).sum())
    return mean, float(np.sqrt((joint * (lm - mean) ** 2).sum()))


class Reader:
    """Whether restored words read, among their neighbours, like the text the bigrams were counted on."""

    def __init__(self, lm: np.ndarray):
        self.lm = lm
        self.mean, self.deviation = _stationary(np.ascontiguousarray(lm, np.float32).tobytes())

    def around(self, parts: list[str], at: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Code points of the strange words and their neighbours, and which belong to the strange ones."""
        flagged, n = set(at), len(parts)
        near = sorted({j for i in at for j in range(max(0, i - 2 * NEAR), min(n, i + 2 * NEAR + 1), 2)})
        text = " " + " ".join(parts[j] for j in near) + " "
        codes = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF)
        own = np.repeat([j in flagged for j in near], [len(parts[j]) + 1 for j in near])
        return codes, np.r_[False, own]

    def holds(self, codes: np.ndarray, own: np.ndarray, symbols: np.ndarray) -> bool:
        """symbols: of the code points, after the swap."""
        pairs = len(codes) - 1
        return _sum(self.lm, np.where(own, symbols[codes], _symbols()[codes])) / pairs >= self.mean - SLACK - 2 * self.deviation / math.sqrt(pairs)


_ARABIC, _LATIN = re.compile("[\u0620-\u064a]"), re.compile("[a-zA-Z]")


def _words_hold(text: str) -> bool:
    """Whether a text restored byte by byte has words of one script (but for some) and no control characters."""
    some = text.split(" ")
    return not _C1.search(text) and sum(bool(_ARABIC.search(w) and _LATIN.search(w)) for w in some) <= MIXED_WORDS * len(some)


_LOST = re.compile(r"(?:(?:^|(?<=[ \n]))\?+[.,;:]?(?:[ \n]+|$)){3,}|[^\W\d_]\?[^\W\d_]")
_C1 = re.compile("[\x80-\x9f]")


def words(text: str) -> tuple[list[str], list[int]]:
    """All words, by blanks and line breaks only, with the separators between them; the suspicious ones' places."""
    parts = re.split(r"([ \n]+)", text)
    strange = _strange_sign().search
    flags = [i for i in range(0, len(parts), 2) if not parts[i].isascii() and strange(parts[i])]
    return parts, flags


def _suspects(batches: Iterator[pd.DataFrame], lm: np.ndarray) -> Iterator[pd.DataFrame]:
    """E step without shares: gains of all keys that may fit."""
    reader = Reader(lm)
    for pdf in batches:
        for i in range(0, len(pdf), BLOCK):
            p = pdf.iloc[i : i + BLOCK]
            texts = list(p.text)
            codes, starts = flatten(texts)
            hits = np.flatnonzero(_strange(codes))
            odd = set((np.searchsorted(starts, hits, "right") - 1).tolist())
            # runs of question marks
            q = np.flatnonzero((codes[:-1] == 63) & (codes[1:] != 10))
            odd |= set((np.searchsorted(starts, q, "right") - 1).tolist())
            out = []
            for r in sorted(odd):
                text = texts[r]
                lost = bool("�" in text or _C1.search(text) or "?" in text and _LOST.search(text))
                parts, at = words(text)
                some = " ".join(parts[j] for j in at)
                best, around = {}, None
                if some:
                    codes16 = np.minimum(np.frombuffer((" " + some + " ").encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF)
                    base = _sum(lm, _symbols()[codes16])
                    strange = codes16[_strange(codes16)]
                    for k, key in enumerate(keys()):
                        if np.count_nonzero(key.inside[strange]) < FIT * len(strange):
                            continue  # most of the strange characters cannot come from this code page
                        back = key.symbols(codes16)
                        if back is not None:
                            g = _sum(lm, back) - base
                            if g > 0 and (key.true == "utf_8" or reader.holds(*(around := around or reader.around(parts, at)), key.symbol) and _words_hold(key.restore(some))):
                                best[k] = g
                letters = sum(map(len, (parts[j] for j in at))) if at and not best else 0
                strange_letters = int(_strange(np.frombuffer(some.encode("utf-32-le", "surrogatepass"), np.uint32)).sum()) if letters else 0
                unknown = strange_letters >= UNKNOWN_LETTERS and strange_letters >= UNKNOWN_SHARE * letters and not lost
                if lost or best or unknown:
                    out.append((p.doc_id.iat[r], p.source.iat[r], text, lost, len(at), list(best), list(best.values())))
            yield pd.DataFrame(out, columns=["doc_id", "source", "text", "lost", "words", "keys", "gains"])


def judged(documents: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """doc_id, source, text, lost, key (null: none), gain, cipher (learned; null for UTF-8 keys); and the bigram table."""
    spark = documents.sparkSession
    docs = documents.where("text <> ''").select("doc_id", "source", "text")
    lm = model(bigrams(documents).toPandas())  # at most size() ** 2 rows
    shared = spark.sparkContext.broadcast(lm)
    e = cut(docs.mapInPandas(lambda b: _suspects(b, shared.value), "doc_id long, source string, text string, lost boolean, words int, keys array<int>, gains array<float>"))
    e = e.withColumn("source", F.coalesce("source", F.lit("")))
    n = len(keys())
    long = e.select("doc_id", "source", F.posexplode_outer(F.arrays_zip("keys", "gains")).alias("p", "k")).select("doc_id", "source", F.col("k.keys").alias("key"), F.col("k.gains").alias("gain")).where("key is not null")
    long = cut(long)
    share, best = None, None
    for _ in range(ROUNDS):
        # weights relative to the best key of the document; no key has the weight of GAIN nats
        w = long if share is None else long.join(F.broadcast(share) if small(share) else share, ["source", "key"], "left")
        w = w.withColumn("score", F.col("gain") + (F.lit(-math.log(n)) if share is None else F.coalesce("prior", F.lit(-math.log(n) - 5.0))))
        top = w.groupBy("doc_id").agg(F.max("score").alias("top"), F.max(F.struct("score", "gain", (-F.col("key")).alias("key"))).alias("b"))
        best = top.select("doc_id", (-F.col("b.key")).alias("key"), F.col("b.gain").alias("gain"))
        post = w.join(top.select("doc_id", "top"), "doc_id").withColumn("p", F.exp(F.col("score") - F.greatest("top", F.lit(GAIN))))
        z = post.groupBy("doc_id").agg(F.sum("p").alias("z"))
        post = post.join(z, "doc_id").groupBy("source", "key").agg(F.sum(F.col("p") / (F.col("z") + F.exp(F.lit(GAIN) - F.greatest("top", F.lit(GAIN))))).alias("m"))
        total = post.groupBy("source").agg(F.sum("m").alias("of"))
        share = cut(post.join(total, "source").select("source", "key", F.log((F.col("m") + 0.1) / (F.col("of") + 0.1 * n)).alias("prior")))
    j = e.join(best, "doc_id", "left")
    fits = (F.col("gain") >= GAIN) & (F.col("gain") >= WORD_GAIN * F.least("words", F.lit(20)))
    single = [k for k, key in enumerate(keys()) if key.true != "utf_8"]
    fits &= ~(F.col("lost") & F.col("key").isin(single))  # lost bytes leave nothing to restore one by one
    j = j.select("doc_id", "source", "text", "lost", F.when(fits, F.col("key")).alias("key"), "gain", F.col("keys").isNotNull() & (F.size("keys") == 0) & ~F.col("lost"))
    j = cut(j.toDF("doc_id", "source", "text", "lost", "key", "gain", "unknown").where("lost or key is not null or unknown"))
    swaps = j.where(F.col("key").isin(single) | F.col("unknown")).withColumn("swap", F.coalesce("key", F.lit(-1)))
    if not swaps.head(1):
        return j.withColumn("cipher", F.lit(None).cast("map<int,string>")), lm
    pairs = swaps.select("source", "swap", "text").mapInPandas(_pairs, "source string, swap int, a int, b int, n long").groupBy("source", "swap", "a", "b").agg(F.sum("n").alias("n"))
    # characters are at most 65,536, in practice some hundred, so a group is a small table of their pairs
    learned = cut(pairs.groupBy("source", "swap").applyInPandas(lambda key, pdf: _learn(key, pdf, shared.value), "source string, swap int, cipher map<int,string>"))
    known = swaps.join(F.broadcast(learned) if small(learned, 10_000) else learned, ["source", "swap"])
    judged = known.mapInPandas(lambda b: _fits(b, shared.value), "doc_id long, cipher map<int,string>, better boolean")
    j = j.join(judged, "doc_id", "left")
    swapped = F.col("unknown") | F.coalesce(F.col("key").isin(single), F.lit(False))
    return j.where(~swapped | F.col("better") | F.col("lost")).drop("unknown", "better"), lm


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of characters in the suspicious words, blanks around each word."""
    for pdf in batches:
        total: dict = {}
        for source, swap, text in zip(pdf.source, pdf.swap, pdf.text):
            parts, at = words(text)
            s = " " + " ".join(parts[i] for i in at) + " "
            for p, n in Counter(zip(s, s[1:])).items():
                k = (source, swap, ord(p[0].lower()[0]) if p[0].isascii() else ord(p[0]), ord(p[1].lower()[0]) if p[1].isascii() else ord(p[1]))
                total[k] = total.get(k, 0) + n
        yield pd.DataFrame([(*k, n) for k, n in total.items()], columns=["source", "swap", "a", "b", "n"])


@functools.cache
def _letters_of_symbols() -> list[str]:
    out = [""] * size()
    for x in _ORDINARY:
        if x == x.lower() and not (x.isdigit() and x != "0"):
            out[_symbols()[ord(x)]] = x
    return out


def _learn(group: tuple, pdf: pd.DataFrame, lm: np.ndarray) -> pd.DataFrame:
    """The cipher of one source and swap: code point -> character."""
    chars = sorted(set(pdf.a) | set(pdf.b))
    at = {c: i for i, c in enumerate(chars)}
    i, j, n = np.array([at[c] for c in pdf.a]), np.array([at[c] for c in pdf.b]), pdf.n.to_numpy(np.float64)
    often = np.bincount(i, n, len(chars)) + np.bincount(j, n, len(chars))
    # the stationary distribution of the bigrams gives the letters' own shares
    p = np.exp(lm.astype(np.float64))
    p /= p.sum(1, keepdims=True)
    single = np.full(len(p), 1 / len(p))
    for _ in range(50):
        single = single @ p
    names = _letters_of_symbols()
    allowed = np.zeros((len(p), len(chars)))
    first = np.zeros_like(allowed)
    arabic = np.array([bool(x) and not x.isascii() or x in " .,:;!?-" for x in names])
    key = keys()[group[1]] if group[1] >= 0 else None
    for x, c in enumerate(chars):
        own = int(_symbols()[c])
        if c < 128 and own:
            allowed[own, x] = first[own, x] = 1.0
            continue
        allowed[arabic, x] = 1.0
        to = key.table.get(c, chr(c)) if key else None
        if to is not None and (k := int(_symbols()[ord(to)])):
            allowed[k, x] = 1.0
            first[k, x] = 1.0
    first = first * often[None, :] + (1e-3 * allowed if key else ciphers.by_rank(often, single, allowed))
    post = ciphers.learn(i, j, n, single[:, None] * p, allowed, first)
    out = {}
    for i, c in enumerate(chars):
        if c > 127:
            k = int(np.argmax(post[:, i]))
            to = key.table.get(c) if key else None
            if to is not None and int(_symbols()[ord(to)]) in (0, k):
                out[c] = to  # the table's own character, also where the bigrams do not know it
            elif post[k, i] >= SURE and names[k]:
                out[c] = names[k]
    if not key and out:
        # a code page gives each letter one character; where many share a letter, there is no swap to learn
        weight = {c: often[at[c]] for c in out}
        best: dict = {}
        for c, x in out.items():
            best[x] = max(best.get(x, 0.0), weight[c])
        if sum(best.values()) < ONE_TO_ONE * sum(weight.values()):
            out = {}
    return pd.DataFrame({"source": [group[0]], "swap": [group[1]], "cipher": [out]})


def _swapped(cipher: dict) -> np.ndarray:
    out = _symbols()[:0x10000].copy()
    for c, x in cipher.items():
        if c < 0x10000:
            out[c] = _symbols()[ord(x[0])]
    return out


def _fits(batches: Iterator[pd.DataFrame], lm: np.ndarray) -> Iterator[pd.DataFrame]:
    reader = Reader(lm)
    for pdf in batches:
        out = []
        for doc, text, cipher in zip(pdf.doc_id, pdf.text, pdf.cipher):
            cipher = dict(cipher)
            parts, at = words(text)
            some = " ".join(parts[i] for i in at)
            back = some.translate(cipher)
            gain = likelihood(lm, back) - likelihood(lm, some)
            out.append((doc, cipher, bool(gain >= GAIN and gain >= WORD_GAIN * min(20, len(at)) and _words_hold(back) and reader.holds(*reader.around(parts, at), _swapped(cipher)))))
        yield pd.DataFrame(out, columns=["doc_id", "cipher", "better"])


def found(documents: DataFrame) -> DataFrame:
    return judged(documents)[0].select("doc_id").distinct()


def restored(documents: DataFrame) -> DataFrame:
    """doc_id, key (the wrong decoding, "unknown" where learned, null where lost), text restored where possible, whether all of it could be."""
    j, lm = judged(documents)
    shared = documents.sparkSession.sparkContext.broadcast(lm)

    def back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lm, out = shared.value, []
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                text, key = r.text, None if pd.isna(r.key) else keys()[int(r.key)]
                cipher = dict(r.cipher) if r.cipher is not None else {}
                if key is not None or cipher:
                    parts, _ = words(text)
                    for i in [i for i in range(0, len(parts), 2) if not parts[i].isascii()]:
                        new = key.restore(parts[i]) if key is not None and key.true == "utf_8" else parts[i].translate(cipher)
                        if "�" not in new and likelihood(lm, new) > likelihood(lm, parts[i]):
                            parts[i] = new
                    text = "".join(parts)
                whole = not ("�" in text or _C1.search(text) or "?" in text and _LOST.search(text))
                out.append((r.doc_id, key.name if key else "unknown" if cipher else None, text, whole))
            yield pd.DataFrame(out, columns=["doc_id", "key", "text", "whole"])

    return j.mapInPandas(back, "doc_id long, key string, text string, whole boolean")
