"""Scalar text functions, all built-in expressions: columns in, columns out."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import classes as C


def squeeze(c: Column) -> Column:
    """Runs of white space, as Unicode has it, become one blank; none at the ends. What is one blank already is no match."""
    return F.trim(F.regexp_replace(c, f"[{C.WS[1:-1]}&&[^ ]]{C.WS}*| {C.WS}+", " "))


def words(c: Column) -> Column:
    """Words between white space; none for an empty text."""
    return F.array_remove(F.split(squeeze(c), " "), "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def letters(c: Column) -> Column:
    """Code points other than the blank."""
    return F.length(F.replace(c, F.lit(" "), F.lit("")))


def density(text: Column, seconds: Column) -> Column:
    """Words a second; null where there is no time."""
    return F.when(seconds > 0, word_count(text) / seconds)


def speaking_rate(text: Column, seconds: Column) -> Column:
    """Letters a second; null where there is no time."""
    return F.when(seconds > 0, letters(text) / seconds)


def _spaced(c: Column, kept: str) -> Column:
    """Runs of other characters than ``kept`` become one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, f"[^{kept} ][^{kept}]*| [^{kept}]+", " "))


def normalize(c: Column) -> Column:
    """The form that texts are compared in: no time stamps, marks or punctuation, one spelling of each letter.

    Texts of ASCII alone, as many bytes as characters, have no marks and no letters of two spellings.
    """

    def of(c: Column) -> Column:
        unstamped = F.regexp_replace(c, r"\((?U)\d{1,2}(:\d{2}){1,2}\)", " ")
        spelled = F.translate(F.regexp_replace(unstamped, C.MARKS, ""), C.LETTERS_FROM, C.LETTERS_TO)
        return F.when(F.octet_length(c) == F.length(c), _spaced(unstamped, "a-zA-Z0-9")).otherwise(_spaced(spelled, r"a-zA-Z0-9\p{L}\p{N}"))

    return F.get(F.transform(F.array(c), of), F.lit(0))


def tokens(c: Column) -> Column:
    """Words with punctuation taken for blanks; marks stay."""
    return words(F.regexp_replace(c, C.TOKEN_MARKS, " "))


def apply_corrections(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Each rule (wrong, right) in turn, on whole words of what the one before it left; then white space is squeezed.

    Both sides are literal text. For a few hundred rules; ``helpers.apply_many_rules`` is for more.
    """
    literal = lambda text: re.sub(r"([^\w\s])", r"\\\1", text)
    for wrong, right in rules:
        # what stands before is looked at where the first letter is found, not at each place
        first, rest = literal(wrong[:1]), literal(wrong[1:])
        c = F.regexp_replace(c, f"{first}(?<!{C.WORD}{first}){rest}(?!{C.WORD})", right.replace("\\", "\\\\").replace("$", "\\$"))
    return squeeze(c)


def join_broken_words(c: Column) -> Column:
    """Rejoin words that were split into single letters.

    Runs of two or more lone letters are joined, and put to the word before them if that has three letters at most and
    no punctuation at its end. Each word's own place tells whether a blank stands before it, so time grows with the words.
    """
    lone = lambda w: (F.length(w) == 1) & ~w.isin(*C.SINGLE_LETTER_WORDS) & ~w.rlike(r"\p{Nd}")
    one = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))

    def spaced(w: Column, flags: Column) -> Column:
        is_lone = lambda i: F.coalesce(F.get(flags, i), F.lit(False))

        def with_blank(x: Column, i: Column) -> Column:
            last = F.get(w, i - 1)
            tied = F.when(is_lone(i - 1), True).otherwise(is_lone(i + 1) & (F.length(last) <= 3) & ~last.rlike(C.FRAGMENT_END))
            return F.concat(F.when((i == 0) | (is_lone(i) & tied), "").otherwise(" "), x)

        return F.array_join(F.transform(w, with_blank), "")

    return one(words(c), lambda w: one(F.transform(w, lone), lambda flags: spaced(w, flags)))


def has_devanagari(c: Column) -> Column:
    return c.rlike(C.DEVANAGARI)


def has_arabic_only(c: Column) -> Column:
    """Letters or vowel marks that Urdu doesn't use."""
    return c.rlike(C.ARABIC_ONLY)


def has_arabic_letters(c: Column) -> Column:
    return c.rlike(C.ARABIC_LETTERS)


def has_latin(c: Column) -> Column:
    return c.rlike(C.LATIN)


def is_invented(c: Column) -> Column:
    """Holds a phrase that recognizers make up over music or noise."""
    return c.rlike(C.INVENTED)


def ends_sentence(c: Column) -> Column:
    return c.rlike(C.SENTENCE_END)


def repeated_phrase(c: Column, longest: int = 4) -> Column:
    """The first phrase of one word, else two, ... that stands three times in a row; null if none does."""

    def among(w: Column) -> Column:
        def of(n: int) -> Column:
            def thrice(i: Column) -> Column:
                same = [F.get(w, i + k) == F.get(w, i + k + n) for k in range(2 * n)]
                return reduce(lambda a, b: a & b, same)

            starts = F.when(F.size(w) >= 3 * n, F.sequence(F.lit(0), F.size(w) - 3 * n)).otherwise(F.array().cast("array<int>"))
            return F.get(F.transform(F.array(F.get(F.filter(starts, thrice), F.lit(0))), lambda i: F.when(i.isNotNull(), F.array_join(F.slice(w, i + 1, F.lit(n)), " "))), F.lit(0))

        return F.coalesce(*(of(n) for n in range(1, longest + 1)))

    # the words are made once, not again for each place
    return F.get(F.transform(F.array(words(c)), among), F.lit(0))


def safe_name(c: Column) -> Column:
    """A name that files can have: other characters than letters, digits, ``_`` and ``-`` become ``_``."""
    name = F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}_-]+", "_"), "^_+|_+$", "")
    return F.when(name == "", "clip").otherwise(name)


def clip_file(name: Column, number: Column) -> Column:
    """``name_0001.wav``."""
    digits = number.cast("string")
    return F.concat(name, F.lit("_"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits), F.lit(".wav"))
