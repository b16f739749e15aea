"""Cleaning of short incident descriptions; order matters, see clean_text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Road prefixes, domain words, and a general English list.
ROADS = ("I", "US", "SR", "SH", "RT", "NJ", "CR")
DOMAIN = ["accident", "road", "street", "st", "ave", "avenue", "traffic", "highway", "hwy", "due", "new", "jersey", "dot", "toc", "stmc"]
ENGLISH = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further "
    "had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own "
    "same she should so some such than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your yours yourself yourselves"
).split()
LANES = {"1": "one", "2": "two", "3": "three", "4": "four"}
_BOUNDARY = r"(^|[^0-9A-Za-z_])"


def fuse_highways(c: Column) -> Column:
    """I-95, I 95 and I95 become i95, and so on for each prefix."""
    for p in ROADS:
        c = F.regexp_replace(c, rf"(?i)\b{p}[- ]?(\d+)\b", f"{p.lower()}$1")
    return c


def fuse_exits(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)\bexit[\s\p{Punct}]*(\d+)\b", "exit$1")


def symbols_to_space(c: Column) -> Column:
    return F.translate(c, "/-", "  ")


def strip_punct(c: Column) -> Column:
    return F.regexp_replace(c, r"\p{Punct}", "")


def unify_lanes(c: Column) -> Column:
    """A count from 1 to 4 before (left, right or center) lanes becomes a word."""
    for digit, word in LANES.items():
        c = F.regexp_replace(c, rf"(?i)\b{digit}\b(\s*(?:left|right|center)?\s*lanes?)", f"{word}$1")
    return c


def english(spark) -> list[str]:
    """Spark's own English list with this module's, as they are and as they look without punctuation."""
    from pyspark.ml.feature import StopWordsRemover

    words = {*ENGLISH, *StopWordsRemover.loadDefaultStopWords("english")}
    return sorted(words | {w.replace("'", "") for w in words})


def remove_stopwords(c: Column, words: list[str]) -> Column:
    stop = list(dict.fromkeys(words))  # a set to Spark, so a word is looked up, not compared with each
    return F.array_join(F.filter(F.split(c, r"\s+"), lambda x: ~x.isin(stop)), " ")


def drop_numbers(c: Column) -> Column:
    return F.regexp_replace(c, r"\b\d+\b", "")


def drop_short(c: Column, max_len: int = 2) -> Column:
    return F.regexp_replace(c, rf"\b[a-z]{{1,{max_len}}}\b", "")


def squeeze_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean(c: Column, stopwords: list[str] | None = None) -> Column:
    """All steps but stemming. Null stays null. stopwords: lower-case words without punctuation; by default ENGLISH and DOMAIN."""
    c = F.lower(fuse_exits(fuse_highways(c)))
    c = unify_lanes(strip_punct(symbols_to_space(c)))
    c = remove_stopwords(c, ENGLISH + DOMAIN if stopwords is None else stopwords)
    return squeeze_space(drop_short(drop_numbers(c)))


def clean_text(df: DataFrame, col: str, key: str, stem_words: bool = False) -> DataFrame:
    """`df` with `col` cleaned; stem_words also replaces each term by its stem."""
    df = df.withColumn(col, clean(F.col(col)))
    return stem(df, col, key) if stem_words else df


def stem(df: DataFrame, col: str, key: str) -> DataFrame:
    """Each term replaced by its English stem. Each different term is stemmed once."""
    terms = df.select(key, F.posexplode(F.split(col, " ")).alias("pos", "term"))
    stems = terms.select("term").distinct().withColumn("stem", stems_of("term"))
    new = terms.join(stems, "term").groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "stem"))), lambda x: x["stem"]), " ").alias("__new"))
    return df.join(new, key, "left").withColumn(col, F.col("__new")).drop("__new")


def stems_of(col: str) -> Column:
    @F.pandas_udf("string")
    def run(terms: pd.Series) -> pd.Series:
        return terms.map(porter)

    return run(F.col(col))


_VOWEL = "aeiou"


def _measure(w: str) -> int:
    kinds = ["v" if c in _VOWEL or (c == "y" and i and w[i - 1] not in _VOWEL) else "c" for i, c in enumerate(w)]
    return sum(a == "v" and b == "c" for a, b in zip(kinds, kinds[1:]))  # noqa: B905


def _has_vowel(w: str) -> bool:
    return any(c in _VOWEL or (c == "y" and i > 0) for i, c in enumerate(w))


def _cvc(w: str) -> bool:
    return len(w) > 2 and w[-1] not in _VOWEL + "wxy" and (w[-2] in _VOWEL or w[-2] == "y") and w[-3] not in _VOWEL


#: Suffixes of Porter's published algorithm (1980), steps 2, 3 and 4.
_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou"]


def porter(w: str) -> str:
    """The stem of a lower-case English word by Porter's algorithm."""
    if w is None or len(w) < 3 or not w.isascii():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix) and _has_vowel(w[: -len(suffix)]):
                w = w[: -len(suffix)]
                if w.endswith(("at", "bl", "iz")) or (_measure(w) == 1 and _cvc(w)):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in _VOWEL + "lsz":
                    w = w[:-1]
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for suffix, new in sorted(table, key=lambda x: -len(x[0])):
            if w.endswith(suffix):
                if _measure(w[: -len(suffix)]) > 0:
                    w = w[: -len(suffix)] + new
                break
    for suffix in _STEP4:
        if w.endswith(suffix):
            head = w[: -len(suffix)]
            if _measure(head) > 1 and (suffix != "ion" or head.endswith(("s", "t"))):
                w = head
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w
