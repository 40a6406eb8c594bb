"""Problem 9: sentences of documents in any language and script.

A semi-Markov model: dynamic programming over the places where a sentence may
end picks whole spans. The score of a span is the sum of

* its length: a span of a few letters or of several hundred is unlikely
  (``length_score``), so of two doubtful ends close together one at most is taken;
* its opening word: known to open sentences, known to stand inside them, or neither;
* its closing word and mark: from SURE for a mark that can mean nothing else down
  to what an abbreviation before a number is worth; in between the end is doubtful
  and the rest of the span decides;
* its quotations: a span that cuts one is impossible, and one that begins with a
  quotation and would end with it is unlikely where the text goes on as a report
  of who said it.

The words that open sentences are counted over all documents at the places where
a beginning is certain.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from math import log
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: A word is listed if it holds 1 / OPENERS of all certain beginnings or of all words inside, so at most 2 x OPENERS are, however many texts there are.
OPENERS = 100_000
#: Letters of a word that are looked at; longer ones are in no list.
LETTERS = 40
#: Scores of ends that are certain, likely and doubtful, of what never ends a sentence, and of opening words.
SURE, LIKELY, DOUBTFUL, NEVER_ENDS = 8.0, 4.0, 2.0, -9.0
OPENS, INSIDE = 1.0, -0.5
#: Length: below SHORT letters a span loses SHORT_WEIGHT x the square of the logarithm of what it lacks, SHORT_MOST at most, beyond LONG letters LONG_WEIGHT a letter; a letter of a script without alphabet counts WIDE times.
SHORT, SHORT_WEIGHT, SHORT_MOST, LONG, LONG_WEIGHT, WIDE = 40.0, 1.2, 3.5, 300.0, 0.002, 2.5

# Abbreviations in lower case, by what may follow them.
# Titles, connectives and the like: a sentence does not end here.
NEVER = set(
    "mr mrs ms dr prof rev hon gov capt sgt insp lt col gen st dept messrs e.g i.e cf vs viz ca approx incl "
    "dipl hr fr vgl bes bzw z evtl ggf sog lt inkl zzgl ing lic sra srta dra sres mme mlle m me pr mgr env c.-à-d éd ej ex ee "
    "акад проф инж см напр ул г-жа тов гр т е डॉ श्री د أ م".split()
)
# Followed by a number or by small letters they do not end a sentence.
MAYBE = set(
    "fig figs sec secs vol vols pp p ch para ext avg min max hrs hr sq art no nos nr nos abb kap abs s cap núm núms num pág págs aprox chap n "
    "рис стр ч мин сек д г гг с руб тыс jan feb mar apr jun jul aug sept sep oct nov dec okt dez janv févr avr juil déc ene abr ago dic "
    "u.s u.k u.n e.u uu a.m p.m jr sr co ltd inc corp bros etc usw u.s.w др п bd al ed eds op cit tel aka".split()
)
# Of these, names of firms and states: what follows may belong to them.
NAMES = set("u.s u.k u.n e.u uu co ltd inc corp bros".split())
LINKS = set("by and or of from to for with in at on und oder von vom zu mit in bei für y e o de del por con en et ou par pour avec dans и или от по для с в the".split())
ORDINAL_BEFORE = set("der die das den dem des am vom zum zur im beim bis ab und seit dieser diese jeder jede jedem".split())
MONTHS = set("januar februar märz april mai juni juli august september oktober november dezember".split())
BUT = ("但", "然而", "可是", "不过", "而", "却", "并", "が", "けれど", "しかし", "だが", "でも", "と", "、", "，")
SAID = re.compile("写道|写|说|問|问|答|道|称|表示|喊|叫|回答|書|言|述べ|尋ね|答え")
JA_GOES_ON = "とっはがをのにもでやへ"

_STRONG = "!?！？؟。｡．।॥。۔։።"
_END = re.compile(rf"[.…‥{_STRONG}]+")
_PAIRS = {"“": "”", "«": "»", "「": "」", "『": "』", "„": "“”", "(": ")", "（": "）", "‘": "’", '"': '"', "《": "》", "【": "】"}
_BRACKETS = "(（【"
_CLOSERS = set("”’»」』)）]】》\"")
_OPENERS = set("“«「『„(（‘\"《【[¿¡")
_INVISIBLE = re.compile("[\u00ad\u200b\u200c\u200d\u2060\ufeff]")
_BLANKS = r"[ \t\u00a0\u3000]"
_MARKER = re.compile(rf"{_BLANKS}*(?:[-•*·▪◦‣]{_BLANKS}+|\d{{1,3}}[.)]{_BLANKS}+|\([A-Za-zА-я0-9]{{1,3}}\){_BLANKS}+|\[\d{{1,2}}:\d{{2}}(?::\d{{2}})?\]{_BLANKS}*)")
_LINE = re.compile("[^\r\n\u2028\u2029\x0b\x0c\x85]*(?:\r\n|[\r\n\u2028\u2029\x0b\x0c\x85]|$)")
_THAI_BLANK = re.compile(rf"(?<=[ก-๎๚๛”»’)]){_BLANKS}+(?=\S)")
_WORD = re.compile(rf"[^\W\d_][\w'’.-]{{0,{LETTERS}}}")
_LEAD = re.compile("[“«(‘„¿¡\"「『（\\[ \t\r\n ]*")
_TOKEN = re.compile(r"\S+")
_WIDE = re.compile("[฀-๿぀-ヿ㐀-鿿]")


def opening_words(documents: DataFrame) -> dict[str, bool]:
    """Words that open sentences (true) or stand inside them (false), counted over all documents.

    A beginning is certain after an empty line, after a mark other than a dot and
    after a long word's dot; a word with a capital after a small one stands inside.
    A word opens if it does so more than twice as often as it stands inside, two of
    the latter being taken for granted of every word.
    """
    lead = r"""["“«(‘„¿¡]?"""
    sure = rf"(?:\A|\n\s*\n|[!?؟]\s)\s*{lead}(\p{{L}}[\p{{L}}\p{{M}}'’-]*)"
    dotted = rf"\p{{Ll}}{{5,}}\.\s+{lead}(\p{{Lu}}[\p{{L}}\p{{M}}'’-]*)"
    inner = r"\p{Ll}{2,} (\p{Lu}[\p{L}\p{M}'’-]*)"
    found = lambda p, n: F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(1)), lambda w: F.struct(w.alias("w"), F.lit(n).alias("n")))
    words = documents.filter("text is not null").select(F.explode(F.concat(found(sure, 1), found(dotted, 1), found(inner, -1))).alias("x")).select("x.*")
    counts = cut(words.filter(F.length("w") <= LETTERS).groupBy("w").agg(F.count_if(F.col("n") > 0).alias("opens"), F.count_if(F.col("n") < 0).alias("inside")))
    total = counts.agg(F.coalesce(F.sum("opens"), F.lit(0)), F.coalesce(F.sum("inside"), F.lit(0))).first()
    often = (F.col("opens") * OPENERS >= total[0]) & (F.col("opens") > 2 * F.col("inside") + 2)
    within = (F.col("inside") * OPENERS >= total[1]) & (F.col("inside") > 2 * F.col("opens") + 2)
    return {r["w"]: r["o"] for r in counts.filter(often | within).select("w", often.alias("o")).collect()}


def length_score(letters: float, sure: bool) -> float:
    """0 for a span of ordinary length, less for shorter and longer ones; being short counts half where the end is certain."""
    if letters < SHORT:
        lacking = min(SHORT_MOST, SHORT_WEIGHT * log(SHORT / max(letters, 1.0)) ** 2)
        return -lacking / 2 if sure else -lacking
    return -LONG_WEIGHT * max(0.0, letters - LONG)


def segments(text: str) -> list[tuple[int, int, int]]:
    """(start, end, first) of the stretches that no sentence crosses; ``first`` is where the text after a marker begins."""
    out: list[list[int]] = []
    fresh, at, before = True, 0, ""
    while at < len(text):
        end = _LINE.match(text, at).end()
        line = text[at:end]
        if not line.strip():
            fresh = True
        else:
            mark = _MARKER.match(line)
            if mark and mark.group().strip()[0].isdigit() and not fresh:
                last = before.split()[-1:] or [""]
                if last[0].endswith(".") and _plain(last[0][:-1]) in MAYBE | NEVER:
                    mark = None  # a number that a line break parted from its "No."
            if mark and mark.end() >= len(line.rstrip()):
                mark = None
            if fresh or mark:
                out.append([at, end, at + (mark.end() if mark else 0)])
            else:
                out[-1][1] = end
            fresh = False
        before, at = line, end
    return [(s, e, f) for s, e, f in out]


def _plain(token: str) -> str:
    return unicodedata.normalize("NFKC", _INVISIBLE.sub("", token)).lower().lstrip("([{\"'“”„«»‘’¿¡-–—/")


_QUOTE = re.compile("[" + re.escape("".join(set("".join(k + v for k, v in _PAIRS.items())))) + "]")


def quotations(s: str) -> list[tuple[int, int]]:
    """(start, end) of the outermost closed quotations and brackets of ``s``; what is never closed is no quotation.

    One pass with a stack for each kind of opening, so linear whatever is left open.
    """
    marks = [m.start() for m in _QUOTE.finditer(s)]
    open_: dict[str, list[int]] = {k: [] for k in _PAIRS}
    close: dict[int, int] = {}
    straight = [i for i in marks if s[i] == '"']
    for a, b in zip(straight, straight[1:]):
        close[a] = b
    for i in marks:
        c = s[i]
        if c == '"':
            continue
        for k, closers in _PAIRS.items():
            if c in closers and open_[k] and not (k == "‘" and s[i + 1 : i + 2].isalpha()):
                close[open_[k].pop()] = i
        if c in open_:
            open_[c].append(i)
    out, at = [], 0
    for i in marks:
        if i < at or i not in close or s[i] not in _PAIRS:
            continue
        if s[i] == "‘" and i and s[i - 1].isalnum() or s[i] == '"' and s[i + 1 : i + 2].isspace() and i and not s[i - 1].isspace():
            continue
        at = close[i] + 1
        out.append((i, at))
    return out


class End(NamedTuple):
    """A place where a sentence may end: its score, and of one that a quotation closes where that starts and what to add if it opens the span, if it does not."""

    at: int
    score: float
    quote: int = -1
    opened: float = 0.0
    within: float = 0.0


class Text:
    """A stretch that no sentence crosses, with the places of its words, marks and quotations, each found once."""

    def __init__(self, s: str, begin: int) -> None:
        self.s, self.begin = s, begin
        self.spans = [(a, b) for a, b in quotations(s) if a >= begin]
        self._tokens: list[int] | None = None
        self.marks = [(m.start(), m.end()) for m in _END.finditer(s, begin)]
        self._said: list[int] | None = None

    @property
    def tokens(self) -> list[int]:
        if self._tokens is None:
            self._tokens = [m.start() for m in _TOKEN.finditer(self.s, self.begin)]
        return self._tokens

    def words_before(self, i: int, most: int = 3) -> list[str]:
        """Up to ``most`` words before ``i``, the last one ending there; of an overlong one the end."""
        k = bisect_left(self.tokens, i)
        starts = self.tokens[max(0, k - most) : k]
        ends = [*starts[1:], i]
        return [self.s[max(a, b - 3 * LETTERS) : b].rstrip() for a, b in zip(starts, ends)]

    def rest(self, i: int) -> int:
        """The place of the next letter that is no blank."""
        s, n = self.s, len(self.s)
        while i < n and s[i].isspace():
            i += 1
        return i

    def word(self, i: int) -> str:
        """The word that starts at ``i``, after quotation marks and brackets."""
        m = _WORD.match(self.s, _LEAD.match(self.s, i).end())
        return m.group() if m else ""

    def said_before_stop(self, i: int) -> bool:
        """Whether a verb of saying stands between ``i`` and the next end mark."""
        if self._said is None:
            self._said = [m.start() for m in SAID.finditer(self.s)]
        k = bisect_left(self.marks, (i, 0))
        stop = self.marks[k][0] if k < len(self.marks) else len(self.s)
        k = bisect_left(self._said, i)
        return k < len(self._said) and self._said[k] < stop


class Sentences:
    """Splits texts; ``openers`` tells of words whether they open sentences or stand inside them, as a set of those that open them."""

    def __init__(self, openers: dict[str, bool] | set[str]) -> None:
        self.openers = openers if isinstance(openers, dict) else dict.fromkeys(openers, True)
        self._known: dict[str, float] = {}

    def _opens(self, word: str) -> bool:
        w = _INVISIBLE.sub("", word)
        if w.endswith(".") and w[0].isupper() and (len(w) == 2 or w[:-1].lower() in NEVER):
            return True  # an initial or a title begins a name
        return self.openers.get(w, False) or self.openers.get(w.rstrip("."), False)

    def opening(self, word: str) -> float:
        """Score of a span that opens with ``word``."""
        score = self._known.get(word)
        if score is None:
            score = OPENS if self._opens(word) else INSIDE if self.openers.get(_INVISIBLE.sub("", word)) is False else 0.0
            if len(self._known) < OPENERS:
                self._known[word] = score
        return score

    def _dot(self, x: Text, i: int, after: int) -> float:
        """What closing at the single dot s[i] is worth; ``after`` is where the next text starts."""
        s = x.s
        tokens = x.words_before(i)
        token = tokens[-1] if tokens and not s[i - 1].isspace() else ""
        word, nxt = _plain(token), s[after]
        follow = x.word(after)
        small, number = nxt.islower(), nxt.isdigit()
        if after == i + 1:  # no blank between
            if nxt in _OPENERS and nxt != "[":
                return DOUBTFUL
            if not nxt.isalpha() or small or not (s[i - 1].isalnum() or s[i - 1] in _CLOSERS):
                return NEVER_ENDS
            if word in NEVER or word in MAYBE or "." in word or "@" in word or "/" in word or len(word) < 2:
                return NEVER_ENDS
            return LIKELY if not s[i - 1].isupper() or not nxt.isupper() or len(follow) > 3 else -DOUBTFUL
        if not word:
            return -DOUBTFUL if small else DOUBTFUL
        two = _plain(tokens[-2]) if len(tokens) > 1 else ""
        if word in ("д", "п") and two == "т.":
            return -LIKELY if small and not self._opens(follow) else SURE
        if word == "no":
            return NEVER_ENDS if number else SURE
        if word in NEVER:
            return NEVER_ENDS
        if word == "sr":  # a title before a name, or the end of one
            named = len(tokens) > 1 and tokens[-2][:1].isupper() and tokens[-2][-1].isalnum()
            return LIKELY if named and not small and not number else NEVER_ENDS
        if "-" in word and word.rpartition("-")[2] in NEVER:
            return NEVER_ENDS
        if len(word) == 1 and word.isalpha() and (word != "p" or token[-1].isupper()):
            if two.endswith(".") and len(two) == 2:
                return NEVER_ENDS if small or not self._opens(follow) else -LIKELY
            if token[-1].isupper() or unicodedata.normalize("NFKC", token)[-1].isupper():
                label = two and two.isalpha() and two not in LINKS and tokens[-2].islower()
                return LIKELY if label and (not small or self._opens(follow)) else NEVER_ENDS
            return NEVER_ENDS if small or number else DOUBTFUL if word in MAYBE else LIKELY
        if word in MAYBE or (len(word) <= 4 and word.isalpha() and word.isascii() and not set(word) & set("aeiouy")):
            if number or (small and not self._opens(follow)):
                return LIKELY if number and word in ("etc", "usw") else NEVER_ENDS
            if word in NAMES and nxt.isalpha():
                if (word.startswith("u.") or word in ("e.u", "uu")) and two == "the":
                    # "The U.S." right after a stop or a comma is a subject whose noun is still to come.
                    before = tokens[-3] if len(tokens) > 2 else ""
                    if not before or not before[-1].isalnum():
                        return -LIKELY
                # The name goes on or not: its length and the next word decide.
                return DOUBTFUL - OPENS if self._opens(follow) else -DOUBTFUL
            return LIKELY
        digits = word.rstrip(")").replace("–", "").replace("-", "").replace(",", "").replace(":", "")
        if digits.isdigit():
            if two in ORDINAL_BEFORE and (nxt.isalpha() or number) or follow.lower() in MONTHS:
                return NEVER_ENDS
            return LIKELY
        return SURE

    def ends(self, x: Text) -> list[End]:
        """The places where a sentence may end, in order; inside a quotation there is none."""
        s, n, spans, out = x.s, len(x.s), x.spans, []
        starts, k = {a for a, _ in spans}, 0
        for start, i in x.marks:
            while k < len(spans) and spans[k][1] <= start:
                k += 1
            if k < len(spans) and spans[k][0] < start < spans[k][1]:
                continue
            run, mark = s[start:i], i
            while i < n and s[i] in _CLOSERS and i not in starts:
                i += 1
            after = x.rest(i)
            if after >= n:
                continue
            nxt, blank = s[after], after > i
            if nxt in ",;:،，、；：" and not blank:
                continue
            apart = start > 0 and s[start - 1].isspace()
            if len(run) > 1 and set(run) <= set(".…‥") or run in "…‥":
                if s.startswith(BUT, after):
                    score = NEVER_ENDS
                elif nxt.islower():
                    score = NEVER_ENDS if apart or not self._opens(x.word(after)) else DOUBTFUL
                else:
                    score = LIKELY if blank or ord(nxt) > 0x2E7F or nxt in _OPENERS or ord(s[start - 1]) > 0x2E7F or nxt.isupper() else -LIKELY
                    if apart and not self._opens(x.word(after)):
                        score = -DOUBTFUL
            elif run == "." or run == "．":
                score = self._dot(x, start, after) if i == mark else LIKELY if blank else -DOUBTFUL
            elif blank or run[-1] not in "!?":
                score = SURE if nxt not in "—–" else -DOUBTFUL
            else:
                score = SURE if nxt.isupper() or ord(nxt) > 0x2E7F or nxt in _OPENERS else NEVER_ENDS
            if score > NEVER_ENDS:
                out.append(End(i, score))
        out += filter(None, (self._closing(x, a, b) for a, b in spans))
        if re.search("[ก-๛]", s):
            taken, k = {e.at for e in out}, 0
            for m in _THAI_BLANK.finditer(s, x.begin):
                while k < len(spans) and spans[k][1] <= m.start():
                    k += 1
                if k < len(spans) and spans[k][0] < m.start() < spans[k][1] or m.start() in taken:
                    continue
                a, b = s[m.start() - 1], s[m.end()]
                thai = "ก" <= a <= "๛" or "ก" <= b <= "๛"
                latin = b.isdigit() or a.isdigit() or (b.isalpha() and "LATIN" in unicodedata.name(b, ""))
                if thai and not latin and (b.isalpha() or b in _OPENERS or unicodedata.category(b)[0] == "L"):
                    out.append(End(m.start(), SURE))
        return sorted(out)

    def _closing(self, x: Text, a: int, b: int) -> End | None:
        """The end after the quotation s[a:b], if a sentence may end with it."""
        s, n = x.s, len(x.s)
        last = b - 2
        while last > a and s[last].isspace():
            last -= 1
        if last <= a or s[last] not in ".…" + _STRONG or b >= n:
            return None
        after = x.rest(b)
        if after >= n or s[after] in ",;:،，、；：—–" or s[after] in ".…" + _STRONG or (s[after] in _CLOSERS and after == b and s[after] not in '"'):
            return None
        nxt, bracket = s[after], s[a] in _BRACKETS
        wide = ord(nxt) > 0x2E7F
        if not wide and after == b and (nxt.islower() or nxt.isdigit()) or wide and nxt in JA_GOES_ON:
            return None
        follow = x.word(after)
        if bracket:
            return End(b, LIKELY if not nxt.islower() or self._opens(follow) else -DOUBTFUL, a, 0.0, -1.0)
        opened = 0.0
        if nxt.islower():
            opened = 0.0 if self._opens(follow) else -SURE
        elif wide and nxt not in _OPENERS:
            opened = -SURE if x.said_before_stop(after) else 0.0
        elif nxt.isalpha() and not nxt.isupper():
            opened = -SURE
        return End(b, DOUBTFUL if nxt.islower() else LIKELY, a, opened)

    def spans(self, x: Text) -> list[tuple[int, int]]:
        """The best sequence of spans, each as (start, end) in ``x``.

        Exact: starts within LONG letters of an end are tried one by one; beyond,
        a span loses the same for every further letter, so the best of all those
        starts is carried along.
        """
        s, n = x.s, len(x.s)
        ends = [e for e in self.ends(x) if 0 < e.at < n] + [End(n, SURE)]
        starts = [x.rest(0)] + [x.rest(e.at) for e in ends[:-1]]
        first = x.rest(max(starts[0], x.begin))
        place = {(first if i == 0 else a): i for i, a in reversed(list(enumerate(starts)))}
        opening = [0.0] + [self.opening(x.word(a)) for a in starts[1:]]
        wide = WIDE if not s.isascii() and len(_WIDE.findall(s)) * 3 > n else 1.0
        best, back = [0.0] + [float("-inf")] * len(ends), [0] * (len(ends) + 1)
        carried, held = 0, (float("-inf"), 0)  # starts before ``carried`` are beyond LONG letters
        for j, end in enumerate(ends, 1):
            while carried < j and (end.at - starts[carried]) * wide > LONG:
                held = max(held, (best[carried] + opening[carried] + LONG_WEIGHT * starts[carried] * wide, -carried))
                carried += 1
            value, at = held[0] - LONG_WEIGHT * (end.at * wide - LONG) + end.within, -held[1]
            near = range(carried, j)
            whole = place.get(end.quote, j) if end.quote >= 0 else j
            if whole < carried:
                near = (whole, *near)
            for i in near:
                if end.at <= starts[i]:
                    continue
                v = best[i] + opening[i] + length_score((end.at - starts[i]) * wide, end.score >= SURE) + (end.opened if i == whole else end.within)
                if v > value or v == value and i < at:
                    value, at = v, i
            best[j], back[j] = value + end.score, at
        j, out = len(ends), []
        while j > 0:
            i = back[j]
            b = ends[j - 1].at
            while b > starts[i] and s[b - 1].isspace():
                b -= 1
            if starts[i] < b:
                out.append((starts[i], b))
            j = i
        return out[::-1]

    def split(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of the sentences of ``text`` in order, code points counted from 0, end exclusive."""
        out: list[tuple[int, int]] = []
        for start, end, first in segments(text):
            x = Text(text[start:end].rstrip(), first - start)
            out += [(start + a, start + b) for a, b in self.spans(x)]
        return out


def split_sentences(documents: DataFrame) -> DataFrame:
    """(doc_id, sentence_no, start_char, end_char): the sentences of every document, numbered from 0 in order.

    Every non-blank character lies in exactly one sentence. A null, empty or blank
    text has none. Documents that share an id each give their own rows. An empty
    table gives an empty result; other columns do not matter.
    """
    openers = opening_words(documents)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        splitter = Sentences(openers)
        for pdf in batches:
            ids, numbers, starts, ends = [], [], [], []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                found = splitter.split(text) if isinstance(text, str) else []
                ids += [doc_id] * len(found)
                numbers += range(len(found))
                starts += [a for a, _ in found]
                ends += [b for _, b in found]
            yield pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "sentence_no": numbers, "start_char": starts, "end_char": ends})

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id bigint, sentence_no int, start_char int, end_char int")
