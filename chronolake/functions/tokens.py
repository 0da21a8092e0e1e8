"""Words of product names: pieces, composites, light stemming and transliteration."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters of names besides those above the last Cyrillic letter.
KEPT = frozenset("/.,\\%*0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZабвгдежзийклмнопрстуфхцчшщъыьэюяАБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯёЁ")
LAST_KNOWN = "ё"
# The published light stemmer's endings by their length, each with the word length it asks for.
ENDINGS = (
    (6, 4, ("иями", "оями")),
    (5, 3, "иям иях оях ями оям оьв ами его ему ери ими ого ому ыми оев".split()),
    (4, 2, "ая яя ях юю ах ею их ия ию ьв ою ую ям ых ея ам ем ей ём ев ий им ое ой ом ов ые ый ым ми".split()),
    (3, 1, "а е и о у й ы я ь".split()),
)
# Latin spellings of Cyrillic letters.
LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "j", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p",
    "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "c", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}
_TRANSLATE = str.maketrans(LATIN | {k.upper(): v.upper() for k, v in LATIN.items()})


# Character sequences of names that were read in the wrong encoding.
REPAIRS = (("┬л", '"'), ("┬╗", '"'), ("╕", "ё"), ("╣", "№"))


def repaired(column: Column) -> Column:
    """Names with broken character sequences put right."""
    for broken, right in REPAIRS:
        column = F.replace(column, F.lit(broken), F.lit(right))
    return column


def latin(text: str) -> str:
    """Cyrillic letters in Latin spelling."""
    return text.translate(_TRANSLATE)


def kept(ch: str) -> bool:
    return ch > LAST_KNOWN or ch in KEPT


def stem(word: str) -> str:
    """The word without its case ending, then without a soft sign or doubled consonant at its end."""
    for longer_than, cut, endings in ENDINGS:
        if len(word) > longer_than and word[-cut:] in endings:
            word = word[:-cut]
            break
    if len(word) > 3 and (word[-1] in "ьи" or word.endswith("нн")):
        word = word[:-1]
    return word


#: What a character does to the words around it: it parts them, links two pieces of one composite and belongs to it, begins
#: the next piece of a composite, or is a letter like others.
BREAK, LINK, JOINT, LETTER = range(4)


def _role(before: str, ch: str, after: str) -> int:
    """The role of a character between its neighbours (blanks beyond the ends)."""
    in_number = before.isdigit() and after.isdigit()
    known = kept(ch)
    if ch in " \t":
        return BREAK
    if before.isdigit() and ch.isalpha() and known or before.isalpha() and ch.isdigit():
        return JOINT
    if ch in "/%\\" or ch in ",*" and in_number == (ch == "*"):
        return LINK if kept(after) and (after not in " \t" or ch == "%") else BREAK
    if not known or ch in "*." and not in_number or ch == ":" and before.isdigit() and not after.isdigit():
        return BREAK
    return LETTER


def raw_tokens(text: str) -> list[str]:
    """Lower-case words, numbers and composites of a name, in order.

    A composite is made of pieces, and told where it ends and at each of its links, after the piece before.
    """
    padded = f" {text} "
    roles = [_role(*padded[i : i + 3]) for i in range(len(text))]
    found: list[str] = []
    piece = composite = ""
    several = False
    for ch, role in zip([*map(str.lower, text), " "], [*roles, BREAK], strict=True):
        if role != LETTER and piece:
            found.append(piece)
            piece = ""
        if role in (BREAK, LINK) and several and composite:
            found.append(composite)
        if role == BREAK:
            composite, several = "", False
            continue
        several = several or role == LINK or role == JOINT and bool(composite)
        composite += ch
        if role != LINK:
            piece += ch
    return found


def tokens(text: str | None) -> list[str] | None:
    """Stemmed and transliterated tokens; null for null."""
    if text is None:
        return None
    out = (stem(t).translate(_TRANSLATE) for t in raw_tokens(text))
    return [t for t in out if t.strip()]


def words_column(column: Column, words: Callable[[str | None], list[str] | None]) -> Column:
    """``words`` over a column, one Arrow batch at a time; a value that comes several times in a batch is taken apart once."""

    @F.pandas_udf("array<string>")
    def udf(texts: pd.Series) -> pd.Series:
        made = {t: words(t) for t in texts.dropna().unique()}
        return texts.map(made.get, na_action="ignore").where(texts.notna(), None)

    return udf(column)


def tokens_column(column: Column) -> Column:
    return words_column(column, tokens)


@dataclass(frozen=True)
class Tokenizer:
    """How names become words: ``fix`` puts the column right first, ``words`` takes a text apart, ``spell`` writes the beginning of a word as ``words`` would."""

    words: Callable[[str | None], list[str] | None] = tokens
    fix: Callable[[Column], Column] = repaired
    spell: Callable[[str], str] = latin

    def column(self, column: Column) -> Column:
        return words_column(self.fix(column), self.words)
