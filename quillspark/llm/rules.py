"""Quality rules with adaptive thresholds, in DataFrame functions only.

Fixed rules come first (length, repetition). All other cutoffs are fences over each language and source: the upper
quartile plus REACH times the distance of the quartiles, from sketches of the metrics' distributions; there is no fixed
cutoff beside them. A quartile is known within its bucket, so the distance is taken between the buckets' outer ends and
is never zero. The metrics are those that vary among ordinary texts (punctuation, upper case, length of words); shares
that are zero in most texts have no quartiles to speak of and are left to the fixed rules.

A sketch is a table of counts by bucket, each bucket within 1/64 of its values (exact below 128), so sketches of parts
merge by addition: those of a source's documents are combined before the shuffle, and sum to those of a language and of
all. A group with few documents takes the sketch of its language, or of all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize

MIN_WORDS = 50
METRICS = ("mark_rate", "upper_rate", "word_length")
#: How many distances of the quartiles a fence lies above the upper one.
REACH = 6
#: Leading bits that tell buckets apart.
KEPT_BITS = 7
LEAST_GROUP = 50
WIDE = 10_000
_SPACES = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that come twice or more. Windows are told apart by their 64-bit hashes."""

    def covered(starts: Column) -> Column:
        begin = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("total"))
        step = lambda a, x: F.struct(x.alias("last"), (a["total"] + F.least(F.lit(3), x - a["last"])).alias("total"))
        return F.aggregate(starts, begin, step, lambda a: a["total"])

    def by_sort(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = lambda s: F.filter(s, lambda x, j: ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
        return let(pairs, lambda s: covered(F.sort_array(F.transform(again(s), lambda x: x["i"]))))

    def by_search(h: Column, twice: Column) -> Column:
        return covered(F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.array_contains(twice, F.get(h, i))))

    def repeated(h: Column) -> Column:
        twice = let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, j: (j > 0) & (F.get(s, j - 1) == x))))
        return let(twice, lambda d: F.when(F.size(d) <= 32, by_search(h, d)).otherwise(by_sort(h)))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    some = lambda w: let(windows(w), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), repeated(h)).otherwise(F.lit(0)))
    return F.when(F.size(words) >= 3, some(words)).otherwise(F.lit(0))


def _without(text: Column, chars: str) -> Column:
    return F.char_length(F.translate(text, chars, ""))


def measures(text: Column) -> Column:
    """A struct of a text's counts; null counts as empty."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, _SPACES, "")) > 0)

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).cast("long").alias("n_repeat_words"))

    def of_lines(x: Column) -> Column:
        return (F.size(x) - F.size(F.array_distinct(x))).cast("long")

    words = let(F.filter(F.split(t, "[ \\t-\\r]+"), lambda x: x != ""), of_words)
    return F.struct(
        words.alias("w"),
        let(lines, of_lines).alias("n_dup_lines"),
        _without(t, _SPACES).cast("long").alias("word_chars"),
        (F.char_length(t) - _without(t, _SYMBOLS)).cast("long").alias("n_symbols"),
        (F.char_length(t) - _without(t, _MARKS)).cast("long").alias("n_marks"),
        (F.char_length(t) - _without(t, _UPPER)).cast("long").alias("n_upper"),
    )


def _metrics() -> dict[str, Column]:
    per = lambda a, b, k: F.floor(F.lit(k) * F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("long")
    return {
        "mark_rate": per("n_marks", "word_chars", 1000),
        "upper_rate": per("n_upper", "word_chars", 1000),
        "word_length": per("word_chars", "n_words", 100),
    }


def _flat(df: DataFrame, m: str) -> dict[str, Column]:
    c = F.col(m)
    return {
        "n_words": c["w"]["n_words"], "word_chars": c["word_chars"], "n_symbols": c["n_symbols"], "n_dup_lines": c["n_dup_lines"],
        "n_repeat_words": c["w"]["n_repeat_words"], "n_marks": c["n_marks"], "n_upper": c["n_upper"],
    }


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def bucket(x: Column) -> Column:
    """The lowest value of x's bucket: x below 128, else x with all but its KEPT_BITS leading bits cleared."""
    s = F.length(F.bin(x)) - KEPT_BITS
    return F.when(x < 1 << KEPT_BITS, x).otherwise(F.call_function("shiftleft", F.call_function("shiftright", x, s), s))


def bucket_end(low: Column) -> Column:
    """The lowest value beyond a bucket."""
    s = F.greatest(F.length(F.bin(low)) - KEPT_BITS, F.lit(0)).cast("int")
    return low + F.call_function("shiftleft", F.lit(1).cast("long"), s)


def sketches(features: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n) of the rows that pass the fixed rules."""
    every = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), bucket(F.col(k)).alias("bucket")) for k in METRICS]))
    ok = features.where(~F.col("base_failed")).select("lang", "source", every.alias("m"))
    return ok.groupBy("lang", "source", F.col("m.metric").alias("metric"), F.col("m.bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def _fences(sketch: DataFrame, by: list[str]) -> DataFrame:
    """(by..., metric, n, fence) from merged sketches."""
    merged = sketch.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "metric")
    c = merged.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("total", F.sum("n").over(group))
    at = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("total"), F.col("bucket")))
    q = c.groupBy(*by, "metric").agg(F.max("total").alias("total"), at(1).alias("q1"), at(3).alias("q3"))
    end = bucket_end(F.col("q3"))
    return q.select(*by, "metric", "total", (end + REACH * (end - F.col("q1"))).alias("fence"))


def thresholds(sketch: DataFrame, least_group: int = LEAST_GROUP) -> DataFrame:
    """(lang, source, one fence for each metric): that of the smallest level with `least_group` documents."""
    own, lang, all_ = _fences(sketch, ["lang", "source"]), _fences(sketch, ["lang"]), _fences(sketch, [])
    k = F.struct("total", "fence")
    own, lang, all_ = (x.withColumn("k", k).drop("total", "fence") for x in (own, lang, all_))
    o, g, a = own.alias("o"), lang.alias("g"), all_.alias("a")
    j = o.join(g, (F.col("o.lang").eqNullSafe(F.col("g.lang"))) & (F.col("o.metric") == F.col("g.metric"))).join(a, F.col("o.metric") == F.col("a.metric"))
    fence = F.when(F.col("o.k.total") >= least_group, F.col("o.k.fence")).when(F.col("g.k.total") >= least_group, F.col("g.k.fence")).otherwise(F.col("a.k.fence"))
    j = j.select(F.col("o.lang").alias("lang"), F.col("o.source").alias("source"), F.col("o.metric").alias("metric"), fence.alias("fence"))
    cols = [F.max(F.when(F.col("metric") == m, F.col("fence"))).alias(f"max_{m}") for m in METRICS]
    return j.groupBy("lang", "source").agg(*cols)


def _judged(features: DataFrame, least_group: int) -> DataFrame:
    limits = materialize(thresholds(sketches(features), least_group), "fences")
    limits = limits.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), *[f"max_{m}" for m in METRICS])
    if limits.limit(WIDE + 1).count() <= WIDE:  # beyond, Spark joins as it sees fit
        limits = F.broadcast(limits)
    out = features.join(limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    inside = F.lit(True)
    for m in METRICS:
        inside = inside & (F.col(m) <= F.coalesce(F.col(f"max_{m}"), F.lit(1 << 40)))
    return out.withColumn("kept", ~F.col("base_failed") & inside)


def _features(docs: DataFrame) -> DataFrame:
    m = docs.withColumn("m", measures(F.col("text")))
    f = m.select("doc_id", "lang", "source", *[c.alias(k) for k, c in _flat(m, "m").items()])
    return f.withColumn("base_failed", _base_failed()).select("*", *[c.alias(k) for k, c in _metrics().items()])


def judge(docs: DataFrame, least_group: int = LEAST_GROUP) -> DataFrame:
    """Per row of docs (doc_id, text, lang, source): doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept.

    Null and empty texts have no words and fail. Null languages and sources are groups of their own. Repeated rows are
    judged each; other columns are ignored; an empty table gives no rows.
    """
    d = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    out = _judged(materialize(_features(d), "features"), least_group)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, least_group: int = LEAST_GROUP) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    m = row.withColumn("m", measures(F.col("row.text")))
    f = m.select("row", F.col("row.lang").cast("string").alias("lang"), F.col("row.source").cast("string").alias("source"), *[c.alias(k) for k, c in _flat(m, "m").items()])
    f = materialize(f.withColumn("base_failed", _base_failed()).select("*", *[c.alias(k) for k, c in _metrics().items()]), "features")
    return _judged(f, least_group).where("kept").select("row.*")
