"""Sentence units of scanned pages in many languages and scripts."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from statistics import median

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolake.session import spread, written

# Marks, quotation marks and brackets of the scripts.
STRONG = "!?！？。｡।॥؟۔"
WEAK = ".．·…"
OPENERS = "「『《〈（(【[«‹“„‚‘¿¡"
CLOSERS = "」』》〉）)】]»›”’"
QUOTES = "\"'“”„‚‘’«»‹›「」『』《》〈〉（）()【】[]"
ALWAYS_OPEN = "「『《〈（(【["
ALWAYS_CLOSE = "」』》〉）)】]"
UPPER = "A-ZÀ-ÖØ-ÞŒА-ЯЁΑ-ΩΆΈ-Ώ"

_MARKS = STRONG + WEAK
_TAIL = _MARKS + "\"'“”‘’«»" + ALWAYS_CLOSE
#: A word in the sense of the counts: letters with their marks, apostrophes left out.
_WORD = re.compile(r"[^\W\d_]+(?:[̀-ͯऀ-ःऺ-ॏัิ-ฺ็-๎][^\W\d_]*)*")
_COUNTED = re.compile(rf"({_WORD.pattern})([{re.escape(_MARKS)}]?)(?:(?<=\.)(?=[\"”’“»«]*\s+(\w[^\W\d_]*)))?")
_CANDIDATE = re.compile(
    rf"(?P<mark>[{re.escape(_MARKS)};|][{re.escape(_TAIL)}]*(?:\s»(?=[\s.,;:!?]|$))?)"
    rf"|(?P<lost>(?<=[^\s\-‐=~¬—–])\s+(?=[{UPPER}][^\W\d_]*))"
)
_CASED = re.compile("[A-Za-zÀ-ÿĀ-ſЀ-џΆ-ώ]")
_WIDE = re.compile("[぀-鿿ｦ-ﾝ\U00020000-\U0002ffff]")
_THAI = re.compile("[ก-๎]")
_GREEK = re.compile("[Ͱ-Ͽ]")

#: A capitalised word right behind a bare number and its full stop.
_NUMBERED = re.compile(r"(?<!\d)(?<!\d[.,])\d{1,2}\.\s+([^\W\d_]+)")
#: In scripts without capitals: the marks at a sentence's end, the quotation marks that close there, and what follows up to the next mark.
_CASELESS = re.compile("[぀-鿿ऀ-ॏ؀-ۿ]")
_FOLLOWS = re.compile(rf"[{re.escape(_MARKS)}]([\"”’」』»]?)\s*([^{re.escape(_MARKS + OPENERS)}:：”’」』»]{{1,40}})(?=[{re.escape(_MARKS)}])")
_WIDE_LETTER = re.compile("[぀-鿿]")

#: Words that make up less than this share of the corpus are unknown; so a lexicon has fewer than 1 / RAREST words,
#: however large the corpus, and a word's fate does not depend on the corpus' size.
RAREST = 2.0**-22
#: Kinds of words that a task counts at most before it hands them on.
HELD = 400_000
#: Counted for each word: all occurrences, those in lower case, before a full stop, before another mark, behind a number
#: and its full stop. For what opens or closes the clause behind a quotation's end: times there and at other places.
COUNTS = ("total", "lower", "dotted", "marked", "numbered", "quoted", "unquoted")


def word_key(word: str) -> int:
    """64 bits that stand for a word in any case."""
    return xxhash.xxh64_intdigest(word.lower().encode("utf-8", "surrogatepass")) - (1 << 63)


def clause_ends(clause: str) -> tuple[str, str]:
    """What opens and what closes a clause: a letter in scripts without blanks, else a word; marked as such."""
    words = list(clause) if _WIDE_LETTER.search(clause) else clause.split()
    words = [w for w in words if not w.isspace()]
    return (f"\x01{words[0]}", f"\x02{words[-1]}") if words else ("", "")


class Counter_:
    """Counts of the words of texts, by kind of occurrence."""

    def __init__(self) -> None:
        self.seen: Counter = Counter()

    def add(self, text: str | None) -> None:
        if not text:
            return
        self.seen.update(_COUNTED.findall(text))
        self.seen.update([("", "1", w) for w in _NUMBERED.findall(text) if w[0].isupper()])
        if _CASELESS.search(text):
            for closed, clause in _FOLLOWS.findall(text):
                kind = "q" if closed else "u"
                self.seen.update([("", kind, w) for w in clause_ends(clause) if w])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word, word behind and counts. The word behind is PLAIN for a word's own counts; of a pair (the capitalised
        word behind a full stop, or SMALL for a small letter or digit) the first count says how often."""
        keys: dict[str, int] = {}

        def key(word: str) -> int:
            k = keys.get(word)
            if k is None:
                k = keys[word] = word_key(word)
            return k

        own: dict[int, list[int]] = {}
        pairs: Counter = Counter()
        for (word, mark, after), n in self.seen.items():
            if not word:
                row = own.setdefault(key(after), [0] * len(COUNTS))
                row[{"1": 4, "q": 5, "u": 6}[mark]] += n
                continue
            if len(word) > 3 and word.isupper():
                continue  # headings say nothing about case
            row = own.setdefault(key(word), [0] * len(COUNTS))
            row[0] += n
            if word[0].islower():
                row[1] += n
            if mark == ".":
                row[2] += n
                if after:
                    pairs[key(word), key(after) if after[0].isupper() else SMALL] += n
            elif mark:
                row[3] += n
        self.seen.clear()
        both = np.array(list(pairs), np.int64).reshape(-1, 2)
        word = np.r_[np.fromiter(own, np.int64, len(own)), both[:, 0]]
        behind = np.r_[np.full(len(own), PLAIN, np.int64), both[:, 1]]
        counts = np.zeros((len(word), len(COUNTS)), np.int64)
        counts[: len(own)] = np.array(list(own.values()), np.int64).reshape(-1, len(COUNTS))
        counts[len(own) :, 0] = np.fromiter(pairs.values(), np.int64, len(pairs))
        return word, behind, counts


PLAIN, SMALL = -2, -1
#: What is said of a word, each from 0 to 1; see Lexicon.word.
SHARES = ("opening", "abbreviation", "small", "closing", "ordinal", "attribution")


class Lexicon:
    """What the corpus says about words, each a row of SHARES; words are sorted by their keys."""

    def __init__(self, keys: np.ndarray, shares: np.ndarray):
        self.keys, self.shares = keys, shares
        self._known: dict[str, tuple[float, ...]] = {}

    def word(self, w: str) -> tuple[float, ...]:
        """How far a capital opens a sentence, share as an abbreviation, share of small letters behind its stop, share at a
        sentence's end, share behind a number and its stop, share behind a quotation (of what opens or closes a clause)."""
        got = self._known.get(w)
        if got is None:
            k = word_key(w)
            i = int(np.searchsorted(self.keys, k))
            got = tuple((self.shares[i] / 65535.0).tolist()) if i < len(self.keys) and self.keys[i] == k else UNKNOWN
            if len(self._known) < 500_000:
                self._known[w] = got
        return got


#: A word that the lexicon does not have.
UNKNOWN = (0.0, 0.0, 0.0, 0.06, 0.0, 0.0)


def shares_of(counts: np.ndarray, inside: np.ndarray, small: np.ndarray) -> np.ndarray:
    """SHARES of words from their counts, of the dotted those with a word behind that opens no sentence, and among these those with a small letter or digit."""
    total, lower, dotted, marked, numbered, quoted, unquoted = counts.T.astype(np.float64)
    shares = [
        np.minimum(1.0, lower / (0.6 * total + 0.5)),  # mostly written small: a capital then opens a sentence
        inside * inside / (np.maximum(dotted, 1) * (total + 3.0)),
        small / (inside + 1.0),
        (marked + np.maximum(0, dotted - inside) + 0.3) / (total + 5.0),
        numbered / (total + 3.0),
        quoted / (quoted + unquoted + 3.0),
    ]
    return np.round(np.clip(np.stack(shares, axis=1), 0, 1) * 65535).astype(np.uint16)


def _before(s: str, at: int) -> str:
    """The run of letters and digits that ends at ``at``."""
    i = at
    while i > 0 and at - i < 24 and (s[i - 1].isalnum() or "̀" <= s[i - 1] <= "ͯ" or "ऀ" <= s[i - 1] <= "ॏ"):
        i -= 1
    return s[i:at]


def _after(s: str, at: int) -> tuple[str, int]:
    m = _WORD.match(s, at)
    return (m.group(), m.end()) if m else ("", at)


def _quote_depths(s: str) -> list[tuple[int, int]]:
    """(place, +1 or -1) of the quotation marks and brackets that open or close, judged by their neighbours."""
    out = []
    n = len(s)
    for m in _QUOTE.finditer(s):
        i, c = m.start(), m.group()
        if c in ALWAYS_OPEN:
            out.append((i, 1))
        elif c in ALWAYS_CLOSE:
            out.append((i, -1))
        else:
            a, b = s[i - 1] if i else " ", s[i + 1] if i + 1 < n else " "
            if c in "'’‘" and a.isalnum() and (b.isalnum() or c != "‘" and not (a in _MARKS)):
                continue  # an apostrophe
            opens, closes = (a.isspace() or a in "([—–-:：" or a in ALWAYS_OPEN) and not b.isspace(), not a.isspace() and (b.isspace() or not b.isalnum())
            if opens == closes:  # no blanks between words: the mark's own direction
                opens = c in "“„‚‘«‹" if c not in "\"'" else a not in _MARKS
            out.append((i, 1 if opens else -1))
    return out


def _paired(s: str, quotes: list[tuple[int, int]]) -> list[bool]:
    """Which of the marks have their partner, a quotation mark or a bracket as they are."""
    held, stack = [False] * len(quotes), []
    for k, (i, way) in enumerate(quotes):
        if way > 0:
            stack.append(k)
        elif stack and (s[quotes[stack[-1]][0]] in _BRACKETS) == (s[i] in _BRACKETS):
            held[k] = held[stack.pop()] = True
    return held


_BRACKETS = "()（）[]【】"
_QUOTE = re.compile(f"[{re.escape(QUOTES)}]")
#: Shares from which on a word counts as one that follows ordinal numbers (a month, say), and as one that tells who said
#: what was quoted.
ORDINAL, ATTRIBUTION = 0.1, 0.43
_CLAUSE = re.compile(rf"\s*([^{re.escape(_MARKS + OPENERS)}:：]{{1,40}})[{re.escape(_MARKS)}]")


def _said(s: str, at: int, lex: Lexicon) -> bool:
    """Whether the clause at ``at``, behind a quotation's end, tells who said it: by what usually opens or closes such clauses."""
    m = _CLAUSE.match(s, at)
    clause = m.group(1) if m else s[at : at + 8].strip()
    if not clause:
        return False
    first, last = clause_ends(clause)
    wide = bool(_WIDE_LETTER.search(clause))
    short = bool(m) and len(clause.strip()) <= (16 if wide else 32)
    return bool(first) and (lex.word(first)[5] > ATTRIBUTION and (wide or short) or short and lex.word(last)[5] > ATTRIBUTION)


#: Words up to which a sentence's length costs nothing, and what each further one costs.
LONG_WORDS, LONG_COST = 50, 0.04


def _candidates(s: str, lex: Lexicon) -> list[tuple[int, float, int]]:
    """(end, score, place where the next unit begins) for each place where a sentence may end."""
    out: list[tuple[int, float, int]] = []
    n = len(s)
    for m in _CANDIDATE.finditer(s):
        a, b = m.span()
        if m.lastgroup == "lost":
            # a capital that opens a sentence though no mark is left
            prev_char = s[a - 1]
            if prev_char in _TAIL and (prev_char in _MARKS or a >= 2 and s[a - 2] in _MARKS):
                continue  # the mark speaks for itself
            if prev_char in ":：" or prev_char in "([“„«‘¿¡—":
                continue
            w, e = _after(s, b)
            if len(w) > 1 and w[1].isupper() or s[e : e + 1] in ("'", "’") or s[e : e + 1] == "." and len(w) < 6:
                continue
            opening = lex.word(w)[0]
            if opening < 0.6:
                continue
            end = a
            before = _before(s, end)
            if before.isupper() and len(before) > 1:
                continue  # among capitals
            if not before and prev_char in ",;،·|":
                before = _before(s, end - 1)
            close = lex.word(before)[3] if before else 0.05
            score = -7.5 + 10.0 * opening
            if before[:1].isupper():
                score -= 1.0
            if close < 0.012:
                score -= 5.0  # words that hardly ever close a sentence
            elif close > 0.05:
                score += 1.0
            out.append((end, score, b))
            continue
        mark = m.group()
        j = b
        while j < n and s[j].isspace():
            j += 1
        blank = j > b
        # what opens next: skip quotation marks and brackets
        k = j
        while k < n and s[k] in QUOTES + "¿¡—–-":
            k += 1
        nxt = s[k] if k < n else ""
        opened = k > j and j < n and s[j] in QUOTES + "¿¡"
        prev = _before(s, a)
        wide = bool(prev) and bool(_WIDE.match(prev[-1]))
        strong = any(c in STRONG for c in mark)
        first = mark[0]
        if first == ";":
            if not (prev and _GREEK.match(prev[-1])) or not blank:
                continue
            strong = True
        elif first == "|":
            if not (prev and "ऀ" <= prev[-1] <= "ॿ"):
                continue
            strong = True
        if not nxt:
            out.append((b, 4.0, n))
            continue
        cased = bool(_CASED.match(nxt))
        upper = cased and nxt.isupper()
        if strong:
            if cased:
                score = 6.0 if upper else (-6.0 if not opened else -1.0)
            elif nxt.isdigit():
                score = 3.0
            else:
                score = 6.0 if mark[-1] in STRONG or not _said(s, b, lex) else -6.0
            if not blank and cased and not upper:
                score -= 4.0
        elif "…" in mark or ".." in mark:
            if upper:
                opening = lex.word(_after(s, k)[0])[0]
                score = 1.0 + 2.0 * opening if a and not s[a - 1].isspace() else -3.0 + 4.0 * opening
            elif cased:
                score = -5.0
            elif wide or _WIDE.match(nxt):
                score = -3.0
            else:
                score = -3.0 if a and s[a - 1].isspace() else 2.0
        else:
            closed = len(mark) > 1  # a closing quotation mark stands behind the stop
            if not blank and not closed and not opened and not (upper and len(prev) > 2 and prev.islower() and k + 1 < n and s[k + 1].islower()):
                if not ((wide or first in "·") and first != "." and _WIDE.match(nxt)):
                    continue
            if wide:
                score = -0.5 if first == "." and not closed else 2.5
                if not blank and first == "." and not closed:
                    continue
            else:
                _, dotted, low, *_ = lex.word(prev) if prev else UNKNOWN
                digit = prev.isdigit()
                i = a - len(prev)
                number_before = prev and i >= 2 and (s[i - 1].isspace() and s[i - 2].isdigit())
                unit = bool(prev) and ((prev[0].isdigit() and not digit) or (number_before and len(prev) <= 3))
                letter = bool(prev) and not digit and sum(ch.isalpha() for ch in prev) == 1
                abbr = 0.9 if unit else (0.95 if letter else dotted)
                decimal = digit and i >= 2 and s[i - 1] in ".,·" and s[i - 2].isdigit()
                counted = digit and i >= 2 and s[i - 1].isspace() and s[i - 2] in ".№"  # No. 53
                if first == "·" and not prev:
                    continue
                if upper:
                    w, e = _after(s, k)
                    opening = 0.0 if len(w) == 1 and s[e : e + 1] == "." else lex.word(w)[0]
                    if letter and prev.isupper():
                        opening *= 0.5  # an initial
                    if prev.isupper() and w.isupper():
                        opening *= 0.2  # within capitals a capital says little
                    if digit:
                        score = 4.0 if decimal else -6.0 if lex.word(w)[4] > ORDINAL else 3.0 if counted else -3.0 + 7.0 * opening
                    elif abbr < 0.3:
                        score = 5.0
                    else:
                        score = -4.5 + 8.0 * opening * (1.0 if low > 0.4 or unit else 0.45)
                    if opened and abbr < 0.6:
                        score = max(score, 3.5)
                    elif opened:
                        score += 1.0
                elif cased:
                    score = -6.0
                elif nxt.isdigit():
                    score = 1.5 if digit or abbr < 0.45 else -5.0
                else:
                    score = (4.0 if abbr < 0.45 else -4.0) if not digit else 4.0 if decimal or counted else 3.0 if "؀" <= nxt <= "ۿ" else -1.0
                    if closed and _said(s, b, lex):
                        score = -6.0
                if first in "·．":
                    score -= 1.0
        out.append((b, score, j))
    return out


def _thai(s: str) -> list[tuple[int, float, int]]:
    """Thai sets no closing mark: sentences part at blanks, but blanks also stand around numbers."""
    out = []
    for m in re.finditer(r"[ \u00a0]+\n?", s):
        a, b = m.span()
        if b >= len(s) or a == 0:
            continue
        left = s[:a].rpartition(" ")[2].rpartition("\n")[2]
        nxt = s[b : b + 40]
        head = re.match(r"\S*", nxt).group()
        rest = nxt[len(head) :]
        score = 4.0
        if re.search(r"\d", left) or re.match(r"[\d\"“]?\d", head) or left.endswith(".") and len(left) < 8:
            score = -5.0
        elif len(head) <= 12 and re.match(r"\s+\d", rest):
            score = -5.0  # a word that belongs to the number behind it
        elif head.startswith(("ๆ", "ฯ")):
            score = -4.0
        out.append((a, score, b))
    return out


def segment(s: str, lex: Lexicon) -> list[int]:
    """Ends of the sentences of one block; the block's end is the last.

    A semi-Markov model: the best path over whole sentences, each scored by the place where it ends (mark, closing
    word, the next sentence's opening word), its length and whether its quotation marks and brackets are balanced.
    """
    end = len(s.rstrip())
    if not end:
        return []
    thai = _THAI.search(s) is not None and len(_THAI.findall(s)) * 2 > end
    cand = _candidates(s, lex)
    if thai:
        spaces = _thai(s)
        taken = {c[0] for c in spaces}
        cand = sorted([c for c in cand if c[0] not in taken and (c[1] > 3 and s[c[0] - 1] != ".")] + spaces)
    places = [(0, 0.0, 0)]
    for c in cand:
        if places[-1][0] < c[0] < end:
            places.append(c)
    places.append((end, 0.0, end))
    n = len(places)
    if n == 2:
        return [end]
    # before each place: how many quotations and brackets it lies in, marks without their partner, and words
    quotes = _quote_depths(s)
    held = _paired(s, quotes)
    inside, depth, qi, e, d = [], [], 0, 0, 0
    for p, _, _ in places:
        while qi < len(quotes) and quotes[qi][0] < p:
            if held[qi]:
                e += quotes[qi][1]
            else:
                d += quotes[qi][1]
            qi += 1
        inside.append(e)
        depth.append(d)
    wide = bool(_WIDE.search(s))
    if wide or thai:
        words = [p / (2.2 if wide else 5.0) for p, _, _ in places]
    else:
        blanks = [m.start() for m in _BLANKS.finditer(s)]
        words = [bisect_left(blanks, p) + 1 if p else 0 for p, _, _ in places]
    best, back = [0.0] + [-1e18] * (n - 1), [0] * n
    # the best score up to each place, as it is and with what words before it save in length
    most, saved = [0.0] * n, [0.0] * n
    cased = _CASED.search(s) is not None
    for j in range(1, n):
        wj, dj, top, arg = words[j], depth[j], -1e18, 0
        for i in range(j - 1, -1, -1):
            if top >= most[i] or top > saved[i] - LONG_COST * (wj - LONG_WORDS) + 1e-9:
                break  # no sentence that begins at i or before is better
            v, length = best[i], wj - words[i]
            if dj != depth[i]:
                v -= 5.0 * abs(dj - depth[i])
            if length < 4:
                v -= 1.2 * (4 - length)
            elif length > LONG_WORDS:
                v -= LONG_COST * (length - LONG_WORDS)
            if not cased and i and length < 5 and s[places[i][0] - 1] in "\"'“”‘’«»」』":
                v -= 5.0  # who said it belongs to what was said
            if v > top:
                top, arg = v, i
        best[j], back[j] = top + places[j][1] - 10.0 * inside[j], arg
        most[j], saved[j] = max(most[j - 1], best[j]), max(saved[j - 1], best[j] + LONG_COST * wj)
    out, j = [], n - 1
    while j:
        out.append(places[j][0])
        j = back[j]
    return out[::-1]


_BLANKS = re.compile(r"\s+")
_GUTTER = re.compile(r"\s*\|\s*|\s{2,}")
_WIDE_GUTTER = re.compile(r"\S(?:\s+\|\s|\s{3,})\S")


#: Four edges of each line, or of which there is none.
Boxes = tuple[list[int], list[int], list[int], list[int]]
NO_EDGE = -1_000_000


def boxes_of(lines: list | None) -> Boxes | None:
    """The edges x0, y0, x1, y1 of a page's lines as four lists; a line without its box has NO_EDGE throughout."""
    if lines is None:
        return None
    edges = ("x0", "y0", "x1", "y1")
    whole = [None not in [b[e] for e in edges] if b else False for b in lines]
    return tuple([b[e] if ok else NO_EDGE for b, ok in zip(lines, whole, strict=True)] for e in edges)


def _pieces(text: str, boxes: Boxes | None) -> list[tuple[int, int, int | None, int | None]]:
    """(begin, end, left edge, height) of each line, lines that run through two columns being cut in two.

    The height is None without a box, -1 for the left part of a cut line and -2 for the right one, whose edge is a guess.
    """
    lines = text.split("\n")
    if boxes is None or len(boxes[0]) != len(lines):
        boxes = None
    out = []
    at = 0
    usual = 0
    if boxes:
        x0s, y0s, x1s, y1s = boxes
        sizes = [(x1 - x0, y1 - y0) for x0, y0, x1, y1 in zip(x0s, y0s, x1s, y1s, strict=True) if NO_EDGE not in (x0, y0, x1, y1) and y1 > y0]
        widths = [w for w, h in sizes if h <= 40] or [w // 2 for w, _ in sizes]
        usual = median(widths) if widths else 0
        mixed = sum(h > 40 and w > 1.35 * usual for w, h in sizes)
    for i, line in enumerate(lines):
        end = at + len(line)
        if boxes is None or NO_EDGE in (x0s[i], y0s[i], x1s[i], y1s[i]):
            out.append((at, end, None, None))
        else:
            x0, width, height = x0s[i], x1s[i] - x0s[i], y1s[i] - y0s[i]
            cut = None
            if usual and (height > 40 and width > 1.35 * usual or height > 60 and width > usual or mixed > 2 and not height and _WIDE_GUTTER.search(line)):
                gaps = [m for m in _GUTTER.finditer(line) if m.start() > 0 and m.end() < len(line)]
                if gaps:
                    cut = min(gaps, key=lambda m: abs(m.start() - len(line) / 2) - 4 * len(m.group()))
            if cut:
                out.append((at, at + cut.start(), x0, -1))
                out.append((at + cut.end(), end, x0 + (width or 2 * usual) // 2, -2))
            else:
                out.append((at, end, x0, height))
        at = end + 1
    return out


Piece = tuple[int, int, int | None, int | None]


def _layout(text: str, boxes: Boxes | None) -> tuple[list[Piece], list[int], list[int], list[int], list[int] | None, float]:
    """Pieces of lines, their kinds (0 for running text), the columns' left edges, each piece's column, the order of the columns (None unless columns alternate) and the usual height."""
    pieces = _pieces(text, boxes)
    heights = [h for _, _, _, h in pieces if h is not None and h > 0]
    body = median(heights) if heights else 0
    if heights:
        counts = Counter(heights)
        common = counts.most_common(1)[0]
        body = min(body, common[0]) if common[1] * 4 >= len(heights) else body
    kinds: list[int] = []
    for a, b, x, h in pieces:
        line = text[a:b]
        if h is not None and h > 0:
            kinds.append(0 if h <= body * 1.15 + 1 else h)
        elif len(line) > 7 and line.isupper():
            kinds.append(-2 if x is None else -3)
        else:
            kinds.append(0)
    lefts: list[int] = []  # each column's usual left edge; some lines are indented, few stand out
    run: list[int] = []
    for x in [*sorted(x for (_, _, x, h), k in zip(pieces, kinds, strict=True) if x is not None and h and h > -2 and k == 0), None]:
        if run and (x is None or x - run[-1] > 150):
            lefts.append(run[len(run) // 4])
            run = []
        if x is not None:
            run.append(x)
    if len(lefts) == 1 and any(h == -2 for *_, h in pieces):
        lefts.append(lefts[0] - NO_EDGE)  # a column of which only right halves are seen
    column = [0 if x is None or not lefts else max(0, sum(x >= left - 40 for left in lefts) - 1) for _, _, x, _ in pieces]
    for i in range(1, len(pieces)):  # a line without a box stays with its neighbour
        if pieces[i][2] is None:
            column[i] = column[i - 1]
        elif pieces[i][3] == -2:  # and the right part of a cut line is in the next column
            column[i] = min(column[i - 1] + 1, max(0, len(lefts) - 1))
    for i, (a, b, x, h) in enumerate(pieces):
        if h != 0 or x is None or not lefts:
            continue
        # a box without size: its place tells whether the line belongs to a heading or advert next to it
        inset = x - lefts[column[i]]
        for j in (i - 1, i + 1):
            if 0 <= j < len(pieces) and kinds[j] > 0 and pieces[j][2] is not None and abs(pieces[j][2] - x) <= 9:
                if inset >= 35 or text[a:b].isupper() or (j < i and inset < 14):
                    kinds[i] = kinds[j]
                    break
    turns = sum(1 for i in range(1, len(column)) if column[i] < column[i - 1])
    order = sorted(range(len(pieces)), key=lambda i: (column[i], i)) if turns >= 2 else None  # articles flow from column to column
    return pieces, kinds, lefts, column, order, body


def column_order(text: str, boxes: Boxes | None) -> str | None:
    """The page's lines in the order of its columns; None if its columns don't alternate."""
    pieces, *_, order, _ = _layout(text, boxes)
    return None if order is None else "\n".join(text[pieces[i][0] : pieces[i][1]] for i in order)


def _blocks(text: str, boxes: Boxes | None) -> list[list[tuple[int, int]]]:
    """The page's blocks in reading order, each a list of (begin, end): headings, adverts, paragraphs.

    Headings and adverts are set in other sizes than the text around them; a paragraph begins with an indent. Lines of
    several columns that alternate are put in the order of the columns.
    """
    pieces, kinds, lefts, column, order, body = _layout(text, boxes)
    if order is None:
        order = list(range(len(pieces)))
    blocks: list[list[tuple[int, int]]] = []
    text_block: list[tuple[int, int]] | None = None
    other: list[tuple[int, int]] | None = None
    other_kind = 0
    for i in order:
        a, b, x, _ = pieces[i]
        if kinds[i]:
            if other is not None and _same_size(other_kind, kinds[i]):
                other.append((a, b))
            else:
                other = [(a, b)]
                blocks.append(other)
            other_kind = kinds[i]
            if kinds[i] == -2 or kinds[i] > 2 * body:
                text_block = None  # a heading ends the article before it, an advert stands inside it
            continue
        other = None
        left = lefts[column[i]] if lefts else None
        if text_block is None or (x is not None and left is not None and 14 <= x - left < 70 and pieces[i][3] != -2):
            text_block = []
            blocks.append(text_block)
        text_block.append((a, b))
    return blocks


def _same_size(a: int, b: int) -> bool:
    return a == b or (a > 0 and b > 0 and abs(a - b) <= 2)


def page_units(text: str | None, boxes: Boxes | None, lex: Lexicon) -> list[tuple[int, str]]:
    """Sentence units of a page in reading order: the offset right after the last character, and the unit's text.

    A unit's text is taken from its block, so it runs on over adverts and lines of other columns; line breaks are kept.
    An empty text has none.
    """
    if not text or not text.strip():
        return []
    units = []
    for block in _blocks(text, boxes):
        s = "\n".join(text[a:b] for a, b in block)
        if not s.strip():
            continue
        k, base, start = 0, 0, 0
        for end in segment(s, lex):
            while k < len(block) and end > base + (block[k][1] - block[k][0]):
                base += block[k][1] - block[k][0] + 1
                k += 1
            units.append((block[k][0] + end - base, s[start:end].strip()))
            start = end
    return units


def sentence_ends(text: str | None, boxes: Boxes | None, lex: Lexicon) -> list[int]:
    """Offsets right after the last character of each sentence of a page, ascending."""
    return sorted({end for end, _ in page_units(text, boxes, lex)})


_COUNTED_ROWS = "word bigint, behind bigint, " + ", ".join(f"{c} bigint" for c in COUNTS)


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counter = Counter_()

    def batch() -> pa.RecordBatch:
        word, behind, counts = counter.rows()
        return pa.record_batch([pa.array(word), pa.array(behind), *[pa.array(np.ascontiguousarray(c)) for c in counts.T]], names=["word", "behind", *COUNTS])

    for b in batches:
        for text in b["text"].to_pylist():
            counter.add(text)
            if len(counter.seen) >= HELD:
                yield batch()
    yield batch()


def lexicon(documents: DataFrame) -> Lexicon:
    """What all pages say about words. Fewer than 1 / RAREST words come to the driver, 20 bytes each, however large the corpus."""
    rows = spread(documents.where(F.col("text").isNotNull()).select("text")).mapInArrow(_counter, _COUNTED_ROWS)
    sums = written(rows.groupBy("word", "behind").agg(*[F.sum(c).alias(c) for c in COUNTS]), "word-counts")
    plain = sums.where(F.col("behind") == PLAIN).drop("behind")
    least = RAREST * (plain.agg(F.sum("total")).first()[0] or 0)
    words = plain.where(F.greatest("total", F.col("quoted") + F.col("unquoted")) >= least)
    # a capitalised word that is mostly written small opens a sentence; any other is a name or a noun inside one
    opens = plain.where(F.col("lower") >= 0.5 * F.col("total")).select(F.col("word").alias("_b"), F.lit(True).alias("opens"))
    pairs = sums.where(F.col("behind") != PLAIN).join(opens, F.col("behind") == F.col("_b"), "left")
    inside = pairs.groupBy(F.col("word").alias("_w")).agg(F.sum(F.when(~F.coalesce("opens", F.lit(False)), F.col("total")).otherwise(0)).alias("inside"), F.sum(F.when(F.col("behind") == SMALL, F.col("total")).otherwise(0)).alias("small"))
    told = words.join(inside, F.col("word") == F.col("_w"), "left").na.fill(0, ["inside", "small"]).select("word", *COUNTS, "inside", "small")
    got = told.mapInArrow(_shared, "word bigint, shares binary").toArrow()
    keys = got["word"].to_numpy()
    order = np.argsort(keys)
    table = np.frombuffer(b"".join(got["shares"].to_pylist()), np.uint16).reshape(-1, len(SHARES))
    return Lexicon(keys[order], table[order])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts = np.stack([b[c].to_numpy() for c in COUNTS], axis=1)
        shares = shares_of(counts, b["inside"].to_numpy(), b["small"].to_numpy())
        yield pa.record_batch([b["word"], pa.array([r.tobytes() for r in shares], pa.binary())], names=["word", "shares"])


_EDGES = ("x0", "y0", "x1", "y1")


def edge_columns() -> list[Column]:
    """The edges of a page's lines as four columns of arrays, NO_EDGE for none."""

    def edge(name: str) -> Column:
        return F.transform("lines", lambda line: F.coalesce(line[name], F.lit(NO_EDGE))).alias(name)

    return [edge(e) for e in _EDGES]


def _edges(b: pa.RecordBatch) -> list[Boxes | None]:
    """The boxes of a batch's pages, cut out of the columns' values."""
    there = b["x0"].is_valid().to_pylist()
    columns = []
    for e in _EDGES:
        values, offsets = b[e].values.to_numpy(zero_copy_only=False).tolist(), b[e].offsets.to_numpy().tolist()
        columns.append([values[i:j] for i, j in zip(offsets[:-1], offsets[1:], strict=True)])
    return [tuple(page) if ok else None for ok, *page in zip(there, *columns, strict=True)]


def _splitter(shared, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexicon(*shared.value)
        for b in batches:
            ids, texts, boxes = b["doc_id"].to_pylist(), b["text"].to_pylist(), _edges(b)
            out_ids, out_ends, out_texts = [], [], []
            for d, t, x in zip(ids, texts, boxes, strict=True):
                units = page_units(t, x, lex)
                out_ids += [d] * len(units)
                out_ends += [e for e, _ in units]
                if with_text:
                    out_texts += [u for _, u in units]
            columns = [pa.array(out_ids, pa.int64()), pa.array(out_ends, pa.int64())]
            names = ["doc_id", "sent_end"]
            if with_text:
                columns, names = [*columns, pa.array(out_texts, pa.string())], [*names, "sentence"]
            yield pa.record_batch(columns, names=names)

    return run


def sentences(documents: DataFrame, with_text: bool = False) -> DataFrame:
    """Sentence units of every page: ``doc_id``, ``sent_end`` and, if wanted, ``sentence``.

    Offsets count Unicode code points. Null and empty texts, and texts of blanks, have no sentences; a page whose boxes
    are missing or do not fit its lines is read as one column. Rows with equal doc_id give each of their ends once.
    Two passes: the corpus' word counts, then each page by itself. The ends of pages whose doc_id occurs more than once
    are shuffled, and pages are moved where a few tasks would read them all.
    """
    lex = lexicon(documents)
    shared = documents.sparkSession.sparkContext.broadcast((lex.keys, lex.shares))
    pages = documents.where(F.col("text").isNotNull()).select("doc_id", "text", *edge_columns())
    schema = "doc_id bigint, sent_end bigint" + (", sentence string" if with_text else "")
    repeated = written(pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("_id")), "repeated-pages")
    n, pages = repeated.count(), spread(pages)
    units = lambda df: df.mapInArrow(_splitter(shared, with_text), schema)
    if not n:
        return units(pages)
    repeated, same = F.broadcast(repeated) if n <= 100_000 else repeated, F.col("doc_id").eqNullSafe(F.col("_id"))
    return units(pages.join(repeated, same, "left_anti")).unionAll(units(pages.join(repeated, same, "left_semi")).dropDuplicates(["doc_id", "sent_end"]))
