"""Similarity of titles, names and descriptions.

Everything but the sequence ratio is a built-in expression. The ratio (twice the matched characters over all, by
repeatedly taking the longest common block) has none and runs as one Arrow function, behind blocking and length tests.
"""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

#: Words that titles may differ in.
MINOR = ["a", "an", "the", "and", "of", "for", "to", "in", "on", "with", "s"]
#: Fragments of publishers and series of the genre; spellings of a confirming mark.
ROMANCE = r"(?iu)harlequin|arlekin|silhouette|mira|cora|bastei|kelter|pabel|moewig|zauberkreis|mills|boon|harper\s*collins|j'ai lu|phantom press|awhe|amber|temptation|romance|romans|sonia"
YES = ("y", "yes", "j", "ja", "x", "1", "true", "ok", "oui", "tak")


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 * M / T of two strings. Not symmetric: the first argument is the record's, the second the candidate's."""
    matcher, last, out = difflib.SequenceMatcher(None), None, []
    for x, y in zip(a, b, strict=True):
        if x is None or y is None:
            out.append(None)
            continue
        if y != last:  # the matcher prepares its second string
            matcher.set_seq2(y)
            last = y
        matcher.set_seq1(x)
        out.append(matcher.ratio())
    return pd.Series(out, dtype="float64")


def content_words(key: Column) -> Column:
    """The words of a title key without minor words and numbers, repeats kept."""
    return F.filter(F.split(key, " "), lambda w: (w != "") & ~w.isin(*MINOR) & ~w.rlike("^[0-9]+$"))


def spelling_variant(x: Column, y: Column) -> Column:
    """Same first letter; and either one starts with the other and has at most two more letters, or the shorter has at
    least five letters and they are one edit apart."""
    starts = F.startswith(x, y) | F.startswith(y, x)
    near = (F.abs(F.length(x) - F.length(y)) <= 1) & (F.least(F.length(x), F.length(y)) >= 5) & (F.levenshtein(x, y) <= 1)
    return (F.substring(x, 1, 1) == F.substring(y, 1, 1)) & F.when(starts, F.abs(F.length(x) - F.length(y)) <= 2).otherwise(near)


def compatible(a: Column, b: Column, words_a: Column | None = None, words_b: Column | None = None) -> Column:
    """Whether two title keys can be one book: they may differ in minor words, numbers, spacing and spelling only.

    Not symmetric: each differing word of ``a`` needs a variant among those of ``b``. ``words_a`` and ``words_b`` are
    their content words, where these are at hand."""
    wa, wb = content_words(a) if words_a is None else words_a, content_words(b) if words_b is None else words_b
    rest_a, rest_b = F.filter(wa, lambda w: ~F.array_contains(wb, w)), F.filter(wb, lambda w: ~F.array_contains(wa, w))
    joined = F.array_join(wa, "") == F.array_join(wb, "")
    spelled = F.forall(rest_a, lambda x: F.exists(rest_b, lambda y: spelling_variant(x, y)))
    by_words = F.when((F.size(wa) == 0) | (F.size(wb) == 0), False).when(F.size(rest_a) != F.size(rest_b), joined).otherwise(spelled)
    return F.when(F.replace(a, F.lit(" "), F.lit("")) == F.replace(b, F.lit(" "), F.lit("")), True).otherwise(by_words)


def title_form(words: Column, joined: Column) -> Column:
    """What ``forms_may_agree`` compares: a key without its spaces, its content words joined, and their first letters as
    bits (letters whose codes differ by a multiple of 64 share one)."""
    bits = F.aggregate(words, F.lit(0).cast("long"), lambda m, w: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(w) % 64)))
    return F.struct(joined.alias("joined"), F.array_join(words, "").alias("content"), bits.alias("initials"))


def forms_may_agree(a: Column, b: Column) -> Column:
    """A cheap test of two ``title_form`` that every compatible pair passes: the first letters of one title's words are
    among the other's, or all letters agree."""
    bits = a["initials"].bitwiseAND(F.bitwise_not(b["initials"])) == 0
    return bits | (a["joined"] == b["joined"]) | (a["content"] == b["content"])


def may_be_compatible(words_a: Column, words_b: Column, joined_a: Column, joined_b: Column) -> Column:
    """``forms_may_agree`` of two keys, given as content words and without spaces; for many pairs, compute forms once."""
    return forms_may_agree(title_form(words_a, joined_a), title_form(words_b, joined_b))


def contained(a: Column, b: Column) -> Column:
    """Whether the key with fewer words has at least three, at least 60 % of the other's, and stands in it word by word."""
    na, nb = F.size(F.split(a, " ")), F.size(F.split(b, " "))
    short, long = F.when(na <= nb, a).otherwise(b), F.when(na <= nb, b).otherwise(a)
    inside = F.contains(F.concat(F.lit(" "), long, F.lit(" ")), F.concat(F.lit(" "), short, F.lit(" ")))
    return (F.least(na, nb) >= 3) & (F.least(na, nb) / F.greatest(na, nb) >= 0.6) & inside


def title_score(key: Column, candidate: Column, ratio: Column, threshold: float) -> Column:
    """The ratio; at least 0.95 if one key contains the other; just below ``threshold`` at most if they are incompatible."""
    return F.when(contained(key, candidate), F.greatest(ratio, F.lit(0.95))).when(~compatible(key, candidate), F.least(ratio, F.lit(threshold - 0.001))).otherwise(ratio)


def _one_edit(x: str, y: str) -> bool:
    """Whether two strings whose lengths differ by one at most are within one edit."""
    head = next((i for i, (c, d) in enumerate(zip(x, y, strict=False)) if c != d), min(len(x), len(y)))
    return x[head + (len(x) >= len(y)) :] == y[head + (len(y) >= len(x)) :]


def _may_be_one(a: str, b: str, wa: list[str], wb: list[str]) -> bool:
    """``compatible`` for the matcher below, which compares a key with many candidates in one call."""
    if a.replace(" ", "") == b.replace(" ", ""):
        return True
    left, right = [w for w in wa if w not in wb], [w for w in wb if w not in wa]
    if not wa or not wb or len(left) != len(right):
        return bool(wa and wb) and "".join(wa) == "".join(wb)

    def variant(x: str, y: str) -> bool:
        gap = abs(len(x) - len(y))
        if x[0] != y[0]:
            return False
        if x.startswith(y) or y.startswith(x):
            return gap <= 2
        return gap <= 1 and min(len(x), len(y)) >= 5 and _one_edit(x, y)

    return all(any(variant(x, y) for y in right) for x in left)


@F.pandas_udf(BooleanType())
def compatible_keys(a: pd.Series, b: pd.Series) -> pd.Series:
    """``compatible`` for many pairs, which the expression takes longer for."""
    return pd.Series([_may_be_one(x, y, TitleBlock.content(x), TitleBlock.content(y)) for x, y in zip(a, b, strict=True)], dtype="bool")


class TitleBlock:
    """Candidate keys of an author, prepared once for many titles: letters counted, words split, matchers built when needed."""

    def __init__(self, keys: list[str]):
        self.keys, self.matchers = keys, [None] * len(keys)
        self.words = [self.content(k) for k in keys]
        self.sizes, self.letters = np.array([len(k) for k in keys]), np.stack([self.count(k) for k in keys])

    @staticmethod
    def content(key: str) -> list[str]:
        return [w for w in key.split(" ") if w and w not in MINOR and not w.isdigit()]

    @staticmethod
    def count(key: str) -> np.ndarray:
        return np.bincount(np.frombuffer(key.encode("ascii", "replace"), np.uint8), minlength=128)

    def best(self, key: str, threshold: float) -> tuple[int, float]:
        """(place, score) of the first candidate with the largest score; (-1, 0) if none is above 0.

        No ratio exceeds twice the letters that both keys hold over all letters. Candidates are tried by falling bound,
        until none that is left can win.
        """
        n = key.count(" ") + 1
        inside = [n >= 3 and self._inside(key, n, other) for other in self.keys]
        bound = np.maximum(2 * np.minimum(self.count(key), self.letters).sum(1) / np.maximum(self.sizes + len(key), 1), np.where(inside, 0.95, 0.0))
        at, score, own, capped = -1, 0.0, self.content(key), threshold - 0.001
        for i in np.argsort(-bound, kind="stable").tolist():
            if bound[i] < score:
                break
            if score > capped and not inside[i] and not _may_be_one(key, self.keys[i], own, self.words[i]):
                continue
            if self.matchers[i] is None:
                self.matchers[i] = difflib.SequenceMatcher(None, "", self.keys[i])
            self.matchers[i].set_seq1(key)
            value = self.matchers[i].ratio()
            if inside[i]:
                value = max(value, 0.95)
            elif value > capped and not _may_be_one(key, self.keys[i], own, self.words[i]):
                value = capped
            if value > score or value == score > 0 and i < at:
                at, score = i, value
        return at, score

    @staticmethod
    def _inside(key: str, n: int, other: str) -> bool:
        m = other.count(" ") + 1
        short, long, few, many = (key, other, n, m) if n <= m else (other, key, m, n)
        return few >= 3 and few / many >= 0.6 and f" {short} " in f" {long} "


def may_be_same_name(a: Column, b: Column, *, shortest: int = 8) -> Column:
    """The tests before the ratio: first letter, length of the wanted name, and lengths at most two apart."""
    return (F.substring(a, 1, 1) == F.substring(b, 1, 1)) & (F.length(a) >= shortest) & (F.abs(F.length(a) - F.length(b)) <= 2)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements of two arrays; 0 for two empty ones."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def same_story(words_a: Column, words_b: Column, authors_a: Column, authors_b: Column) -> Column:
    """A shared author, and descriptions that share at least half of their words."""
    return F.arrays_overlap(authors_a, authors_b) & (jaccard(words_a, words_b) >= 0.5)


def is_romance(publisher: Column, series: Column) -> Column:
    return F.concat_ws(" ", publisher, series).rlike(ROMANCE)


def listed_publisher(publishers: Column, fragments: list[str]) -> Column:
    """Whether any of an array of publishers holds any fragment."""
    return F.exists(publishers, lambda p: F.lower(p).rlike("|".join(fragments)))


def is_yes(mark: Column) -> Column:
    return F.lower(F.trim(F.coalesce(mark, F.lit("")))).isin(*YES)
