"""Problem 3: answers that do not answer their question, each with the one defect it has.

Method, in this order, the first that fits:
  empty      null, or nothing but blanks, marks or a placeholder.
  refusal    an Aho-Corasick automaton of refusal phrases in several languages finds one and little else is said
             (REFUSAL_REST words); a phrase in the first person counts only near the beginning (BEFORE words before it,
             apologies aside), so that a text that quotes one is no refusal.
  copy       the answer is traversed through a suffix automaton of the question's words, which gives the share of its
             words that lie in copied runs of at least RUN words; what is not copied are words of a fixed list that
             introduce an answer, or at most LEAD words before a run that has most of the question (WHOLE).
  language   scripts and stopwords vote for the language of question and answer, and the votes differ.
  truncated  a stack of delimiters is not empty at the end, or a list marker without item, a comma, a hyphen or an
             ellipsis ends the answer; or there is no closing mark and the last words do not end sentences: of all
             occurrences of the last two words in the contexts of all rows (of the last word, where those are rare)
             less than END_SHARE close a sentence.  A complete sentence without full stop is no case.

The counts of closing words are taken over all contexts, without caps; rows in doubt are joined with them by hash.

Null question: only empty, refusal and truncated can be told.  Empty tables give empty results; extra columns are
ignored; very long answers are read whole; repeated rows each get their defect.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.llm.codes import Words, mix, table
from daftar.session import cut

RUN = 3
REFUSAL_REST, BEFORE, LEAD, WHOLE = 14, 2, 3, 0.8
END_SHARE, SEEN = 0.01, 20
BLOCK = 1000

# Placeholders for a missing answer.
PLACEHOLDERS = {"n a", "na", "none", "null", "nan", "nil", "void", "empty", "tbd", "todo", "unknown", "لا شيء", "لا شي", "لا يوجد", "فارغ", "غير متوفر", "aucun", "aucune", "rien", "neant", "vide", "no answer"}
# Phrases that decline to answer, without diacritics, in lower case.
REFUSALS = [
    "لا استطيع الاجابه", "لا استطيع الرد", "لا استطيع المساعده", "لا يمكنني", "لا يسعني", "لست قادرا علي", "يتعذر علي", "ليس لدي معلومات", "ليست لدي معلومات", "لا تتوفر اجابه", "لا تتوفر لدي", "لا توجد اجابه",
    "لم اجد في السياق", "لم اجد في النص", "لا املك معلومات", "لا املك صلاحيه", "النص المعطي خال من الجواب", "السياق غير كاف", "خارج نطاق ما اتحدث", "خارج نطاق ما استطيع", "افضل الا اتناول", "افضل عدم", "الجواب غير متاح", "الاجابه غير متاحه", "بصفتي مساعدا", "بصفتي نموذجا",
    "i cannot answer", "i can not answer", "i can t answer", "i cannot help", "i can t help", "i can t provide", "i cannot provide", "i am unable to", "i m unable to", "i am not able to", "i m not able to", "i don t have enough", "i do not have enough", "no answer is available", "i would rather not",
    "i d rather not", "i must decline", "i have to decline", "outside what i can talk", "does not contain the answer", "doesn t contain the answer", "as an assistant", "as an ai", "i won t be able", "i refuse to",
    "je ne peux pas", "je ne puis", "il m est impossible", "je prefere ne pas", "je ne suis pas en mesure", "ne contient pas la reponse", "aucune reponse n est disponible", "je dois decliner", "je dois refuser", "je n ai pas assez", "je n ai pas suffisamment", "je ne dispose pas", "en tant qu assistant",
    "depasse ce dont je peux", "hors de ce dont je peux", "je regrette de ne pouvoir", "je refuse de", "je m abstiens",
]
# More phrases, in the first person or of what the text lacks, also in further languages.
REFUSALS += [
    "لا اعرف", "لا اعلم", "لا ادري", "لا استطيع ان", "لا اقدر", "ليس عندي", "لا تتوفر معلومات", "لا توجد معلومات", "لم يرد في النص", "لا يذكر النص", "لا يتضمن النص", "السياق لا يتضمن",
    "i have no information", "i don t know", "i do not know", "i have no answer", "i can t assist", "i cannot assist", "i m not sure", "i am not sure", "there is not enough information", "the text does not say", "the context does not",
    "je ne sais pas", "je n ai aucune information", "je n ai pas d information", "je ne connais pas", "le texte ne dit pas", "le contexte ne",
    "no puedo responder", "no puedo ayudar", "no puedo contestar", "no lo se", "no tengo informacion", "lo siento no", "ich kann nicht", "kann ich nicht", "ich weiß nicht", "ich weiss nicht", "keine informationen", "tut mir leid",
    "non posso rispondere", "non posso aiutare", "non lo so", "não posso responder", "nao posso responder", "não sei", "nao sei", "bilmiyorum", "yanıt veremem", "cevap veremem", "yardımcı olamam",
    "не могу ответить", "не могу помочь", "я не знаю", "нет информации", "نمي توانم", "نميتوانم", "نمي دانم", "نميدانم", "متاسفم",
]
#: Beginnings of phrases in the first person.
FIRST_PERSON = ("i ", "je ", "لا استطيع", "لا اعرف", "لا اعلم", "لا ادري", "لا اقدر", "لا املك", "ليس عندي", "ليس لدي", "لست", "ich ", "no puedo", "no lo se", "non posso", "non lo so", "não ", "nao ", "я ", "не могу")
#: Words of apology and address that may stand before a refusal.
APOLOGY = "merci pour votre question شكرا على سؤالك لك thanks hello hi good gracias por su pregunta hola danke für ihre frage grazie спасибо за вопрос teşekkürler sorry i m am afraid but unfortunately regret apologise apologize we to say that thank you for the your question عذرا اسف اعتذر للاسف معذره نعتذر مع الاسف لكن لكني فانا انا انني désolé désolée desole desolee malheureusement mais pardon je suis suis bien que cela lo siento disculpe leider entschuldigung es tut mir leid aber mi dispiace desculpe üzgünüm maalesef ama извините сожалению к но ببخشيد متاسفانه"
# Words that introduce an answer or name the question, normalised as words.
INTRO = "الجواب والجواب الإجابة والإجابة السؤال سؤالك سألت تسأل هو هي ج س جواب سؤال إجابة answer the question is a q r s response reply your you asked réponse la est question votre vous demandez"
# Frequent words of languages, those of one script compete.
STOPWORDS = {
    "en": "the of and in to a is that for on with by under be may must if has have not no one before without when which how can what who from this at its or other are was will shall it they",
    "fr": "le la les l d de du des et en est que qui pour dans sur avec par un une au aux ne pas il elle peut doit sans être selon quand quelles sont faut ses son ce cette puis avant à",
    "es": "el la los las de del y en es que para con por un una al no se su lo más pero como debe puede sin sobre entre según cuando este esta son fue ser ha",
    "de": "der die das den dem des und in ist zu mit von für auf ein eine einer einem nicht sich auch als an bei nach wird werden kann muss oder aus durch über wenn sind hat im zum zur",
    "it": "il lo la i gli le di del della e in è che per con da un una al non si suo sono come deve può senza nel nella dei delle anche ha questo",
    "pt": "o a os as de do da e em é que para com por um uma ao não se seu mais mas como deve pode sem no na dos das são foi ser ou pelo",
    "nl": "de het een en van in is dat op te voor met niet aan er zijn door om als bij ook kan moet wordt naar uit over of deze die",
    "tr": "ve bir bu da de için ile olarak olan gibi daha çok en ne ya veya değil kadar sonra ise her ancak göre tarafından",
    "pl": "i w na z do się nie jest to że o po od za jak przez oraz dla lub być może jego który która przed",
    "ar": "في من على إلى أن إن عن ما هو هي أو لا لم قد إذا كل هذا هذه ذلك التي الذي بعد قبل عند مع بين ثم حتى كما وفقا خلال أمام إلا بأن لمن وإذا",
    "fa": "را در با از به که و است باید این آن برای تا می کند شود خود یا هر نیز بر اگر پس پیش نماید دهد تواند شده بود هم",
    "ur": "کے کی کا میں ہے سے کو اور پر نے کہ ہیں یہ وہ ہو گا گی تھا نہیں بھی ایک کر لیے",
}
#: The script of each of these languages, and scripts that tell a language by themselves, by ranges of code points.
SCRIPTS = {"arabic": ("ar", "fa", "ur"), "latin": ("en", "fr", "es", "de", "it", "pt", "nl", "tr", "pl")}
OTHER_SCRIPTS = {"el": ((0x370, 0x400),), "cyrillic": ((0x400, 0x530),), "hy": ((0x531, 0x590),), "he": ((0x590, 0x600),), "hi": ((0x900, 0x980),), "th": ((0xE00, 0xE80),), "ka": ((0x10A0, 0x1100),), "ja": ((0x3040, 0x3100),), "zh": ((0x4E00, 0xA000),), "ko": ((0xAC00, 0xD7A4),)}
_MARKS = re.compile(r"[^\w\s]+|_+")
_SPACES = re.compile(r"\s+")
_FOLD = str.maketrans({"أ": "ا", "إ": "ا", "آ": "ا", "ٱ": "ا", "ى": "ي", "ی": "ي", "ة": "ه", "ک": "ك"})
_OPEN, _CLOSE = "([{«“", ")]}»”"
#: Ends that leave something open: commas, colons, hyphens, ellipses behind a letter, opening marks.
_BROKEN = re.compile(r"(?:[,،;؛:\-‐-―…/\\(\[{«“]|\.\.\.)\s*$")
#: A list marker without item, or with at most a few letters of it.
_MARKER = re.compile(r"(?:^|[\s.:؛;])(?:[0-9٠-٩۰-۹]{1,3}[)\-.]|[a-zA-Z]\)|(?:أولا|ثانيا|ثالثا|رابعا|خامسا)ً?\s*:|(?:firstly|secondly|thirdly|premièrement|deuxièmement|troisièmement)\s*[:,])\s*\w{0,3}\s*$", re.IGNORECASE)
_CLOSED = re.compile(r"[.!?؟][\"'»”’)\]\s]*$")
_SUSPENDED = re.compile(r"(?:\.\.\.|…)[\"'»”’)\]\s]*$")
_HIDDEN = re.compile("[­؜᠎​-‏‪-‮⁠-⁤﻿]+")


def plain(text: str) -> str:
    """Lower case, without diacritics and marks, hamza forms and ta marbuta folded, single blanks."""
    t = unicodedata.normalize("NFKD", text).translate(_FOLD)
    t = "".join(x for x in t if not unicodedata.combining(x)) if not t.isascii() else t
    return _SPACES.sub(" ", _MARKS.sub(" ", _HIDDEN.sub("", t).lower())).strip().replace("ـ", "")


@functools.cache
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for x in REFUSALS:
        x = plain(x)
        kind = (len(x.split()), len(x), x.startswith(tuple(y if y.endswith(" ") else plain(y) for y in FIRST_PERSON)))
        a.add_word(f" {x} ", (*kind, 1))
        a.add_word(f" {x}", (*kind, 0))  # a phrase may go on in the same word
    a.make_automaton()
    return a


@functools.cache
def _apologies() -> frozenset:
    return frozenset(plain(APOLOGY).split())


def _refused(text: str) -> int:
    """Words of the refusal phrases in a plain text between blanks; 0 where none counts."""
    said = {}
    for end, (words, length, first, blank) in _automaton().iter(text):
        if first:
            before = text[: end + 1 - blank - length].split()
            if sum(x not in _apologies() for x in before) > BEFORE:
                continue
        said[end - blank] = max(words, said.get(end - blank, 0))
    return sum(said.values())


@functools.cache
def _hashes(words: str) -> frozenset:
    return frozenset(Words([words]).hashes.tolist())


class SuffixAutomaton:
    """Of the words of a prompt: all its runs of words are the paths from the start."""

    def __init__(self, words: list):
        self.next: list[dict] = [{}]
        link, length, last = [-1], [0], 0
        for x in words:
            cur = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and x not in self.next[p]:
                self.next[p][x] = cur
                p = link[p]
            if p >= 0:
                q = self.next[p][x]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(x) == q:
                        self.next[p][x] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.link, self.length = link, length

    def copied(self, words: list, run: int) -> list[bool]:
        """Of each word whether it lies in a run of at least ``run`` words of the prompt."""
        out = [False] * len(words)
        state = size = 0
        for i, x in enumerate(words):
            while state and x not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if x in self.next[state]:
                state = self.next[state][x]
                size += 1
            if size >= run:
                out[i - size + 1 : i + 1] = [True] * size
        return out


def _copied(q: list, a: list) -> tuple[float, bool]:
    """Share of the answer's words that lie in copied runs, and whether the answer says nothing else."""
    known = set(q)
    run = min(RUN, len(q), len(a))
    if not run or sum(x in known for x in a) < run:
        return 0.0, False  # no run can be copied
    copied = SuffixAutomaton(q).copied(a, run)
    share = sum(copied) / len(a)
    if not any(copied):
        return share, False
    intro = _hashes(INTRO)
    lead = copied.index(True)
    rest = all(c or x in intro for c, x in zip(copied[lead:], a[lead:]))
    opening = all(x in intro for x in a[:lead]) or lead <= LEAD and sum(copied) >= WHOLE * len(q)
    return share, rest and opening


def _language(words: list, letters: dict[str, int]) -> str | None:
    """The language most votes are for; None where none is clear.  letters: how many there are of each script."""
    script, n = max(letters.items(), key=lambda x: x[1])
    if n < 3 or n <= 2 * (sum(letters.values()) - n):
        return None
    if script not in SCRIPTS:
        return script
    votes = sorted(((sum(x in _hashes(STOPWORDS[k]) for x in words), k) for k in SCRIPTS[script]), reverse=True)
    (most, best), (second, _) = votes[:2]
    if most >= 2 and most >= 1.5 * second:
        return best
    return "ar" if script == "arabic" and votes[0][0] < 2 else None


@functools.cache
def _scripts() -> np.ndarray:
    """Code point -> number of its script: 0 none, 1 Arabic, 2 Latin, then OTHER_SCRIPTS."""
    t = table("words")
    out = np.zeros(len(t), np.int8)
    out[(t >= 0x620) & (t < 0x700)] = 1
    out[(t >= 97) & (t <= 122) | (t >= 0xE0) & (t < 0x180)] = 2
    for n, ranges in enumerate(OTHER_SCRIPTS.values(), 3):
        for a, b in ranges:
            out[a:b][t[a:b] > 0] = n
    return out


def _letters(w: Words, n: int, starts: np.ndarray) -> list[dict[str, int]]:
    """How many letters of each script each text has."""
    names = ["arabic", "latin", *OTHER_SCRIPTS]
    s = _scripts()[w.raw]
    at = np.flatnonzero(s)
    text = np.searchsorted(starts, at, "right") - 1
    counts = np.bincount(text * (len(names) + 1) + s[at], minlength=n * (len(names) + 1)).reshape(n, -1)[:, 1:]
    return [dict(zip(names, row)) for row in counts.tolist()]


def _open(text: str) -> bool:
    """Whether a delimiter is left open."""
    stack = []
    for x in re.findall(r"[()\[\]{}«»“”]", text):
        if x in _OPEN:
            stack.append(x)
        elif stack and _OPEN.index(stack[-1]) == _CLOSE.index(x):
            stack.pop()
    return bool(stack)


_NUMBER = np.uint64(0x1234567)


def _pairs(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, numbers alike, and of every word with the one before."""
    h = np.where(w.number, _NUMBER, w.hashes)
    before = np.r_[np.uint64(0), h[:-1]] if len(h) else h
    first = np.r_[True, w.text[1:] != w.text[:-1]] if len(h) else np.zeros(0, bool)
    return h, mix(np.where(first, np.uint64(0), before) * np.uint64(0x100000001B3) + h)


def _closing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    ends = np.zeros(0x30000, bool)
    ends[[ord(x) for x in ".!?؟؛;:"]] = True
    for pdf in batches:
        hs, cs = [], []
        for i in range(0, len(pdf), BLOCK):
            w = Words(list(pdf.context.iloc[i : i + BLOCK]))
            if not len(w.hashes):
                continue
            marks = np.r_[0, np.cumsum(ends[np.minimum(w.raw, 0x2FFFF)])]
            after = np.r_[w.at_begin[1:], len(w.raw)]
            closes = (marks[after] > marks[w.at_end]) | np.r_[w.text[1:] != w.text[:-1], True]
            h, pair = _pairs(w)
            hs += [h, pair]
            cs += [closes, closes]
        if hs:
            keys, inverse = np.unique(np.concatenate(hs), return_inverse=True)
            c = np.concatenate(cs)
            yield pd.DataFrame({"h": keys.view(np.int64), "n": np.bincount(inverse), "closing": np.bincount(inverse, c).astype(np.int64)})


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for i in range(0, len(pdf), BLOCK):
            p = pdf.iloc[i : i + BLOCK]
            answers = [_HIDDEN.sub("", unicodedata.normalize("NFKC", x)) if x is not None else "" for x in p.answer]
            questions = ["" if x is None else x for x in p.question]
            a, q = Words(answers, already=True), Words(questions)
            starts = [np.cumsum([0, *(len(t) + 1 for t in ts)])[:-1] for ts in (answers, [unicodedata.normalize("NFKC", t) for t in questions])]
            alet, qlet = _letters(a, len(p), starts[0]), _letters(q, len(p), starts[1])
            h, pair = _pairs(a)
            out = []
            for r, (row, text) in enumerate(zip(p.row_id, answers)):
                aw, qw = a.of(r).tolist(), q.of(r).tolist()
                t = f" {plain(text)} "
                if not aw or t.strip() in PLACEHOLDERS:
                    out.append((row, "empty", 0.0, 0, 0))
                    continue
                said = _refused(t)
                share, copy = _copied(qw, aw)
                if said and len(aw) - said <= REFUSAL_REST + said:
                    out.append((row, "refusal", share, 0, 0))
                elif copy:
                    out.append((row, "copy", share, 0, 0))
                elif len(aw) >= 4 and (la := _language(aw, alet[r])) and (lq := _language(qw, qlet[r])) and la != lq:
                    out.append((row, "language", share, 0, 0))
                elif _BROKEN.search(text) and not _SUSPENDED.search(text) or _SUSPENDED.search(text) or _MARKER.search(text) or _open(text):
                    out.append((row, "truncated", share, 0, 0))
                elif not _CLOSED.search(text):
                    last = a.first[r + 1] - 1
                    out.append((row, None, share, pair[last].astype(np.int64), h[last].astype(np.int64)))
            yield pd.DataFrame(out, columns=["row_id", "defect", "copied", "pair", "word"]).astype({"row_id": "int64", "copied": "float64", "pair": "int64", "word": "int64"})


def defects(qa: DataFrame) -> DataFrame:
    """row_id, defect, copied (share of the answer's words in runs of the question) of every row with a broken answer."""
    judged = qa.select("row_id", "question", "answer").mapInPandas(_judge, "row_id long, defect string, copied double, pair long, word long")
    n = qa.where("context is not null").select("context").mapInPandas(_closing, "h long, n long, closing long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("closing").alias("closing"))
    judged = cut(judged)
    doubt = judged.where("defect is null").select("row_id", "copied", "pair", "word")
    keys = doubt.select(F.col("pair").alias("h")).union(doubt.select("word")).distinct()
    n = cut(n.join(keys, "h", "left_semi"))
    pairs = n.select(F.col("h").alias("pair"), F.col("n").alias("pn"), F.col("closing").alias("pc"))
    words = n.select(F.col("h").alias("word"), F.col("n").alias("wn"), F.col("closing").alias("wc"))
    doubt = doubt.join(pairs, "pair", "left").join(words, "word", "left")
    share = F.when(F.coalesce("pn", F.lit(0)) >= SEEN, F.col("pc") / F.col("pn")).when(F.coalesce("wn", F.lit(0)) > 0, F.col("wc") / F.col("wn")).otherwise(0.0)
    return judged.where("defect is not null").select("row_id", "defect", "copied").union(doubt.where(share < END_SHARE).select("row_id", F.lit("truncated"), "copied"))


def found(qa: DataFrame) -> DataFrame:
    """row_id, defect."""
    return defects(qa).select("row_id", "defect")


def report(qa: DataFrame) -> DataFrame:
    """Per source and defect: rows, their share of the source's rows, mean share of copied words."""
    d = qa.select("row_id", "source").join(defects(qa), "row_id", "left")
    n = d.groupBy("source", "defect").agg(F.count("*").alias("rows"), F.round(F.avg("copied"), 6).alias("copied"))
    total = n.groupBy(F.col("source").alias("_s")).agg(F.sum("rows").alias("of"))
    return n.join(total, n.source.eqNullSafe(total._s)).where("defect is not null").select("source", "defect", "rows", F.round(F.col("rows") / F.col("of"), 6).alias("share"), "copied")
