"""Spelling correction as similarity joins of query words with a dictionary (ord, word).

Every corrector takes words (word) and returns candidates (word, candidate, place), the word itself where nothing is
near; place orders a word's candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize


def grams(word: Column, n: int) -> Column:
    """The set of a word's character n-grams; a shorter word is its own only one."""
    cut = F.transform(F.sequence(F.lit(1), F.char_length(word) - n + 1), lambda i: F.substr(word, i, F.lit(n)))
    return F.when(F.char_length(word) < n, F.array(word)).otherwise(F.array_distinct(cut))


def jaccard(a: Column, b: Column) -> Column:
    """|a and b| / |a or b| of two sets, 0 if both are empty."""
    return F.when(F.size(F.array_union(a, b)) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def phonetic(word: Column, seed_first: bool = True) -> Column:
    """Soundex in which h and w separate like vowels. seed_first: the first letter's code hides an equal second one."""
    up = F.upper(word)
    code = F.translate(up, "BFPVCGJKQSXZDTLMNRAEIOUHWY", "11112222222233455600000000")
    code = F.regexp_replace(code, "[^0-6]", "0")
    if not seed_first:
        code = F.concat(F.lit("0"), F.substr(code, F.lit(2)))
    runs = F.regexp_replace(code, r"(.)\1+", "$1")
    rest = F.translate(F.substr(runs, F.lit(2)), "0", "")
    return F.when(word == "", F.lit("")).otherwise(F.substring(F.concat(F.substring(up, 1, 1), rest, F.lit("000")), 1, 4))


def _kept(words: DataFrame, near: DataFrame) -> DataFrame:
    out = words.select("word").distinct().join(near, "word", "left")
    return out.select("word", F.coalesce("candidate", "word").alias("candidate"), F.coalesce("place", F.lit(1)).alias("place"))


def _variants(df: DataFrame, column: str, most: int) -> DataFrame:
    """df with a row for each variant of a column's word with up to `most` letters left out."""
    v = F.array(F.col(column))
    for _ in range(most):
        shorter = F.flatten(F.transform(v, lambda x: F.when(F.char_length(x) > 0, F.transform(F.sequence(F.lit(1), F.char_length(x)), lambda i: F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1)))).otherwise(F.array().cast("array<string>"))))
        v = F.array_distinct(F.concat(v, shorter))
    return df.withColumn("variant", F.explode(v))


def by_distance(words: DataFrame, dictionary: DataFrame, most: int = 2) -> DataFrame:
    """All dictionary words at the least edit distance, if that is at most `most`, in the dictionary's order.

    A word and its candidate are equal or share a variant with up to `most` letters left out, which is an equi-join;
    no word meets the whole dictionary. Distances are tried in turn, so that only words that nothing is nearer to meet
    the variants of the next, whose number grows with its power.
    """
    w = materialize(words.select("word").distinct(), "words")
    d = materialize(dictionary.select("ord", F.col("word").alias("candidate")), "dictionary")
    left, best = w.where(F.col("word").isNotNull()), None
    for k in range(most + 1):
        pairs = _variants(left, "word", k).join(_variants(d, "candidate", k), "variant").where(F.levenshtein("word", "candidate", k) >= 0)
        near = materialize(pairs.select("word", "candidate", "ord").distinct(), f"near-{k}")
        best = near if best is None else best.union(near)
        left = left.join(near, "word", "left_anti")
        if left.isEmpty():
            break
    return _kept(w, best.withColumn("place", F.row_number().over(Window.partitionBy("word").orderBy("ord"))).select("word", "candidate", "place"))


def by_sound(words: DataFrame, dictionary: DataFrame, frequencies: DataFrame, most: int = 3, seed_first: bool = True) -> DataFrame:
    """The `most` most frequent dictionary words of equal phonetic code; ties in the dictionary's order."""
    w = words.select("word").distinct().withColumn("code", phonetic(F.col("word"), seed_first))
    d = dictionary.join(frequencies, dictionary["word"] == frequencies["term"], "left").select("ord", F.col("word").alias("candidate"), F.coalesce("freq", F.lit(0)).alias("freq"))
    d = d.withColumn("code", phonetic(F.col("candidate"), seed_first))
    # the order doesn't depend on the word, so a code's first candidates are chosen before words meet them
    place = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("freq"), "ord"))
    near = w.join(d.withColumn("place", place).where(F.col("place") <= most), "code")
    return _kept(w, near.select("word", "candidate", "place"))


def gram_similarity(words: DataFrame, dictionary: DataFrame, n: int = 2) -> DataFrame:
    """(word, candidate, ord, similarity) of all pairs that share an n-gram."""
    a = words.select("word").distinct().select("word", grams(F.col("word"), n).alias("g")).select("word", F.size("g").alias("na"), F.explode("g").alias("gram"))
    b = dictionary.select("ord", F.col("word").alias("candidate"), grams(F.col("word"), n).alias("g")).select("ord", "candidate", F.size("g").alias("nb"), F.explode("g").alias("gram"))
    both = a.join(b, "gram").groupBy("word", "candidate", "ord", "na", "nb").agg(F.count(F.lit(1)).alias("both"))
    return both.select("word", "candidate", "ord", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("similarity"))


def by_grams(words: DataFrame, dictionary: DataFrame, n: int = 2) -> DataFrame:
    """All dictionary words of the highest n-gram similarity."""
    best = gram_similarity(words, dictionary, n).withColumn("r", F.rank().over(Window.partitionBy("word").orderBy(F.desc("similarity")))).where("r = 1")
    return _kept(words, best.withColumn("place", F.row_number().over(Window.partitionBy("word").orderBy("ord"))).select("word", "candidate", "place"))


def _gram_ranks(rows: DataFrame, column: str, ranks: DataFrame, n: int) -> DataFrame:
    """(column, code, size, rs, bits) of rows (column, code): how many n-grams a word has; of those that the code's
    dictionary has, the ranks in order and a bit map of 64 places."""
    g = rows.select(column, "code", F.explode(grams(F.col(column), n)).alias("gram")).join(ranks, ["code", "gram"], "left")
    bit = F.coalesce(F.expr("shiftleft(1L, r % 64)"), F.lit(0).cast("long"))
    return g.groupBy(column, "code").agg(F.count(F.lit(1)).cast("int").alias("size"), F.sort_array(F.collect_list("r")).alias("rs"), F.bit_or(bit).alias("bits"))


def _most_similar(words: DataFrame, dictionary: DataFrame, n: int) -> DataFrame:
    """(word, candidate) of each word (word, code) and all candidates (candidate, code) of its code that have the
    highest n-gram similarity.

    Words meet those that share a gram, rare grams first: those that share one of the three rarest give a similarity
    that the best has at least, and two words that reach it share one of the few rarest grams that it leaves (prefix
    filter). A word without a gram in common with its code's dictionary is equally far from all of it.
    """
    count = dictionary.select("code", F.explode(grams(F.col("candidate"), n)).alias("gram")).groupBy("code", "gram").count()
    ranks = materialize(count.select("code", "gram", F.row_number().over(Window.partitionBy("code").orderBy("count", "gram")).alias("r")), "gram-ranks")
    d = materialize(_gram_ranks(dictionary, "candidate", ranks, n).select("candidate", "code", F.col("size").alias("nd"), F.col("rs").alias("ds"), F.col("bits").alias("db")), "dictionary-grams")
    w = materialize(_gram_ranks(words, "word", ranks, n), "word-grams")
    both = F.size(F.array_intersect("rs", "ds"))
    few = lambda df, ranks: df.select("*", F.explode(F.slice(ranks, 1, 3)).alias("r"))
    least = few(w, "rs").join(few(d, "ds"), ["code", "r"]).groupBy("word").agg(F.max(both / (F.col("size") + F.col("nd") - both)).alias("least"))
    known = materialize(w.join(least, "word", "left").withColumn("least", F.coalesce("least", F.lit(1e-9))), "least-similarity")
    # grams that the dictionary lacks are the rarest
    w_at = known.select("word", "code", "size", "bits", "least", F.size("rs").alias("has"), F.posexplode("rs").alias("i", "r")).withColumn("i", F.col("i") + F.col("size") - F.col("has"))
    w_at = w_at.where(F.col("i") <= F.col("size") - F.ceil(F.col("least") * F.col("size") - 1e-9))
    need = F.ceil(F.col("least") / (1 + F.col("least")) * (F.col("size") + F.col("nd")) - 1e-9)
    may = (F.col("i") <= F.col("size") - need) & (F.col("j") <= F.col("nd") - need)
    may = may & (F.col("has") - F.expr("bit_count(bits & ~db)") >= need) & (F.col("nd") - F.expr("bit_count(db & ~bits)") >= need)
    d_at = d.select("candidate", "code", "nd", "db", F.posexplode("ds").alias("j", "r"))
    near = w_at.join(d_at, ["code", "r"]).where(may).select("word", "candidate").distinct()
    near = near.withColumn("s", jaccard(grams(F.col("word"), n), grams(F.col("candidate"), n)))
    best = near.withColumn("r", F.rank().over(Window.partitionBy("word").orderBy(F.desc("s")))).where("r = 1").select("word", "candidate")
    return best.union(w.where("size(rs) = 0").select("word", "code").join(d.select("candidate", "code"), "code").select("word", "candidate"))


def by_all(words: DataFrame, dictionary: DataFrame, n: int = 3, most: int = 3) -> DataFrame:
    """Words of equal sound, of them those of the highest n-gram similarity, of them the `most` nearest by distance."""
    w = materialize(words.select("word").distinct(), "words")
    d = materialize(dictionary.groupBy(F.col("word").alias("candidate")).agg(F.count(F.lit(1)).cast("int").alias("times")), "dictionary")
    code = lambda df, column: df.select(column, phonetic(F.col(column), False).alias("code")).where("code is not null")
    best = _most_similar(code(w, "word"), code(d, "candidate"), n)
    place = F.row_number().over(Window.partitionBy("word").orderBy("k", "candidate"))
    near = best.select("word", "candidate", F.levenshtein("word", "candidate").alias("k")).withColumn("place", place).where(F.col("place") <= most)
    # a word that the dictionary has more than once takes as many places
    each = near.join(d, "candidate").select("word", "candidate", "k", F.explode(F.array_repeat(F.lit(1), F.col("times"))))
    return _kept(w, each.withColumn("place", place).where(F.col("place") <= most).select("word", "candidate", "place"))


def query_words(queries: DataFrame) -> DataFrame:
    """(qid, pos, word) of queries (qid, query)."""
    return queries.select("qid", F.posexplode(F.filter(F.split(F.lower("query"), r"\s+"), lambda x: x != "")).alias("pos", "word"))


def corrected(queries: DataFrame, candidates: DataFrame, most: int = 10) -> DataFrame:
    """(qid, corrections): up to `most` combinations of the words' candidates, the last word changing fastest."""
    by_word = candidates.groupBy("word").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "candidate"))), lambda x: x["candidate"]).alias("c"))
    q = query_words(queries).join(by_word, "word").groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "c"))), lambda x: x["c"]).alias("cs"))
    more = lambda acc, c: F.slice(F.flatten(F.transform(acc, lambda x: F.transform(c, lambda y: F.trim(F.concat_ws(" ", x, y))))), 1, most)
    return q.select("qid", F.aggregate("cs", F.array(F.lit("")), more).alias("corrections"))


def accuracy(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(accuracy): percent of the queries (qid, corrected) whose corrections hold the expected one."""
    hit = F.coalesce(F.array_contains("corrections", F.col("corrected")), F.lit(False))
    return expected.join(found, "qid", "left").agg((F.avg(hit.cast("double")) * 100).alias("accuracy"))
