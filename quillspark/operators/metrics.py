"""Answer quality: BLEU, ROUGE and cosine, row by row over (expected, answer)."""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import ship


def bleu(reference: list[str], answer: list[str], most: int = 4, least: float = 0.1) -> float:
    """Sentence BLEU of one reference: geometric mean of clipped 1- to `most`-gram precisions, a numerator of 0 counting
    as `least`, times the brevity penalty. 0 without a common word."""
    if not answer:
        return 0.0
    logs = 0.0
    for n in range(1, most + 1):
        grams = lambda w, n=n: Counter(zip(*(w[i:] for i in range(n)), strict=False))
        have, ref = grams(answer), grams(reference)
        hit = sum(min(c, ref[g]) for g, c in have.items())
        if n == 1 and not hit:
            return 0.0
        logs += math.log((hit or least) / max(1, sum(have.values()))) / most
    short = 1.0 if len(answer) > len(reference) else math.exp(1 - len(reference) / len(answer))
    return short * math.exp(logs)



def _measure(stem: str) -> int:
    """How many vowel-consonant sequences a stem has."""
    kinds = "".join("v" if c in "aeiou" or (c == "y" and i and stem[i - 1] not in "aeiou") else "c" for i, c in enumerate(stem))
    return len(re.findall("v+c+", kinds))


def _has_vowel(stem: str) -> bool:
    return any(c in "aeiou" or (c == "y" and i and stem[i - 1] not in "aeiou") for i, c in enumerate(stem))


def _short_end(w: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    v = [c in "aeiou" or (c == "y" and i > 0 and w[i - 1] not in "aeiou") for i, c in enumerate(w)]
    return len(w) >= 3 and not v[-3] and v[-2] and not v[-1] and w[-1] not in "wxy"


#: Endings of the stemmer's second, third and fourth step, with what takes their place.
_SECOND = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_THIRD = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def stem(w: str) -> str:
    """The Porter stem of a word in lower case."""
    if len(w) <= 2:
        return w
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + new
            break
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeioulsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short_end(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table, least in ((_SECOND, 0), (_THIRD, 0), (tuple((e, "") for e in _FOURTH), 1)):
        found = max((e for e in table if w.endswith(e[0])), key=lambda e: len(e[0]), default=None)
        if found:
            base = w[: len(w) - len(found[0])]
            if _measure(base) > least and not (least and found[0] == "ion" and not base.endswith(("s", "t"))):
                w = base + found[1]
    if w.endswith("e"):
        base = w[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _short_end(base)):
            w = base
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def rouge_words(text: str) -> list[str]:
    """Words as ROUGE takes them: lower case, ASCII letters and digits, words of over three characters stemmed."""
    return [stem(w) if len(w) > 3 else w for w in re.findall("[a-z0-9]+", text.lower())]


def _f1(hit: int, a: int, b: int) -> float:
    return 2 * hit / (a + b) if hit else 0.0


def rouge_n(reference: list[str], answer: list[str], n: int) -> float:
    """F1 of the common n-grams."""
    grams = lambda w: Counter(zip(*(w[i:] for i in range(n)), strict=False))
    a, b = grams(reference), grams(answer)
    return _f1(sum((a & b).values()), sum(a.values()), sum(b.values()))


def rouge_l(reference: list[str], answer: list[str]) -> float:
    """F1 of the longest common subsequence."""
    row = [0] * (len(answer) + 1)
    for x in reference:
        last = 0
        for j, y in enumerate(answer, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return _f1(row[-1], len(reference), len(answer))


def bleu_udf():
    """BLEU of white-space tokens as an Arrow-batched function; null counts as empty."""

    @F.pandas_udf("double")
    def score(e: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series([bleu((x or "").split(), (y or "").split()) for x, y in zip(e, a, strict=True)], dtype="float64")

    return score


def rouge_l_udf():
    """ROUGE-L as an Arrow-batched function; null counts as empty."""

    @F.pandas_udf("double")
    def score(e: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series([rouge_l(rouge_words(x or ""), rouge_words(y or "")) for x, y in zip(e, a, strict=True)], dtype="float64")

    return score


def bleu_score(expected: Column, answer: Column) -> Column:
    """BLEU of white-space tokens; null counts as empty."""
    return bleu_udf()(expected, answer)


def rouge_scores(expected: Column, answer: Column) -> Column:
    """A struct of rouge1, rouge2 and rougeL; null counts as empty."""

    @F.pandas_udf("rouge1 double, rouge2 double, rougeL double")
    def score(e: pd.Series, a: pd.Series) -> pd.DataFrame:
        pairs = [(rouge_words(x or ""), rouge_words(y or "")) for x, y in zip(e, a, strict=True)]
        return pd.DataFrame({"rouge1": [rouge_n(x, y, 1) for x, y in pairs], "rouge2": [rouge_n(x, y, 2) for x, y in pairs], "rougeL": [rouge_l(x, y) for x, y in pairs]})

    return score(expected, answer)


def evaluation(pairs: DataFrame, similarity: Column) -> DataFrame:
    """pairs (question, expected_answer, model_answer) with bert_score, bleu_score, rouge1, rouge2, rougeL."""
    e, a = F.col("expected_answer"), F.col("model_answer")
    ship(pairs.sparkSession)
    r = pairs.withColumn("bert_score", similarity).withColumn("bleu_score", bleu_score(e, a)).withColumn("r", rouge_scores(e, a))
    return r.select("question", "expected_answer", "model_answer", "bert_score", "bleu_score", "r.rouge1", "r.rouge2", "r.rougeL")


def averages(table: DataFrame) -> DataFrame:
    """The mean of each metric."""
    return table.agg(*[F.avg(c).alias(c) for c in ("bert_score", "bleu_score", "rouge1", "rouge2", "rougeL")])
