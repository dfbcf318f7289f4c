"""Text functions, natively."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import let

DIM = 64
#: Phrases that mark a refusal.
REFUSALS = ["no information available", "not mentioned"]


def tokens(text) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def hash_embed(text, dim: int = DIM) -> Column:
    """Deterministic embedding: tokens counted by a hash bucket; not normalised, zero without tokens."""
    buckets = F.transform(tokens(text), lambda t: F.conv(F.substring(F.md5(t), 1, 4), 16, 10).cast("int") % dim)
    return let(buckets, lambda held: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(held, lambda b: b == i)).cast("double")))


#: Words that answers are compared without.
ARTICLES = ["a", "an", "the", "and"]


def answer_words(text) -> Column:
    """Words of an answer: lower case, without ASCII punctuation and articles."""
    bare = F.regexp_replace(F.lower(text), "[!\"#$%&'()*+,\\-./:;<=>?@\\[\\\\\\]^_`{|}~]", "")
    return F.filter(F.split(bare, "\\s+"), lambda w: (w != "") & ~w.isin(ARTICLES))


def normalize_answer(text) -> Column:
    return F.array_join(answer_words(text), " ")


def is_refusal(text) -> Column:
    return F.lower(text).rlike("|".join(REFUSALS))


def confidence(score: Column) -> Column:
    return F.when(score >= 1.0, "HIGH").when(score >= 0.3, "MEDIUM").otherwise("LOW")


def porter_stem(word: str) -> str:
    """Porter's stemmer (1980), with departures of none."""
    if len(word) <= 2:
        return word
    vowel = lambda w, i: w[i] in "aeiou" or (w[i] == "y" and i > 0 and not vowel(w, i - 1))

    def measure(s):
        kinds = "".join("v" if vowel(s, i) else "c" for i in range(len(s)))
        return sum(kinds[i : i + 2] == "vc" for i in range(len(kinds) - 1))

    has_vowel = lambda s: any(vowel(s, i) for i in range(len(s)))
    double = lambda s: len(s) > 1 and s[-1] == s[-2] and not vowel(s, len(s) - 1)
    cvc = lambda s: len(s) > 2 and not vowel(s, len(s) - 1) and vowel(s, len(s) - 2) and not vowel(s, len(s) - 3) and s[-1] not in "wxy"

    def swap(w, rules, least):
        for end, new in rules:
            if w.endswith(end):
                return w[: -len(end)] + new if measure(w[: -len(end)]) > least else w
        return w

    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and cvc(w):
                    w += "e"
                break
    if w.endswith("y") and has_vowel(w[:-1]):
        w = w[:-1] + "i"
    # The suffixes of the published algorithm.
    w = swap(w, [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")], 0)
    w = swap(w, [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")], 0)
    for end in ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"):
        if w.endswith(end):
            stem = w[: -len(end)]
            if measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        m = measure(w[:-1])
        if m > 1 or (m == 1 and not cvc(w[:-1])):
            w = w[:-1]
    if double(w) and w.endswith("l") and measure(w) > 1:
        w = w[:-1]
    return w
