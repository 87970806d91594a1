"""Rows that operators make on groups of equal keys, and their results against brute force."""

import random

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from quillspark.functions import providers
from quillspark.operators import analyze, chunk, index, spell, vector
from quillspark.plans import catalog
from test_operators import lev


def made(df, metric="numOutputRows"):
    """df's rows, and the most rows that a node of its plan made."""
    rows, most = df.collect(), 0
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(p.plan())
        elif p.metrics().contains(metric):
            most = max(most, p.metrics().apply(metric).value())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return rows, most


def test_sound_meets_a_codes_first_candidates(spark):
    words = sorted({"b" + "aeiouyhw"[i % 8] * (1 + i // 8) for i in range(400)})
    d = spark.createDataFrame([(w, w) for w in words], "ord string, word string")
    freq = spark.createDataFrame([(w, 1 + i % 3) for i, w in enumerate(words)], "term string, freq long")
    rows, most = made(spell.by_sound(d.select("word"), d, freq))
    best = sorted(words, key=lambda w: (-1 - words.index(w) % 3, w))[:3]
    assert sorted(map(tuple, rows)) == sorted((w, c, k + 1) for w in words for k, c in enumerate(best))
    assert most <= 3 * len(words)


def test_similar_words_meet_by_rare_grams(spark):
    """Words of one code against brute force: ties, words without a common gram, short ones, repeated entries."""
    rng = random.Random(7)
    vowels = lambda k: "b" + "".join(rng.choice("aeiouyhw") for _ in range(k))
    words = sorted({vowels(rng.randrange(2, 14)) for _ in range(500)}) + ["taataa", "taataat", "zo"]
    entries = words + words[::50]
    probes = sorted({w[0] + w[2:] for w in words} | {vowels(3)[:2] for _ in range(4)} | {"b", "", "zaaa", "q", "tataata"})
    grams = lambda w: {w[i : i + 3] for i in range(len(w) - 2)} if len(w) > 2 else {w}
    code = lambda w: "B000" if w[:1] == "b" else {"taataat": "T330", "taataa": "T300", "tataata": "T330", "tataat": "T330", "tataa": "T300"}.get(w, w[:1])
    want = set()
    for p in probes:
        s = {c: len(grams(p) & grams(c)) / len(grams(p) | grams(c)) for c in words if code(c) == code(p)}
        best = sorted((lev(p, c), c) for c in entries if c in s and s[c] == max(s.values()))[:3]
        want |= {(p, c, k + 1) for k, (_, c) in enumerate(best or [(0, p)])}
    asked = spark.createDataFrame([(p,) for p in probes] + [(None,)], "word string")
    rows, most = made(spell.by_all(asked, spark.createDataFrame([(w, w) for w in entries], "ord string, word string")))
    assert {tuple(r) for r in rows if r.word is not None} == want and len(rows) == len(want) + 1
    assert most <= 20 * len(words)


def test_distances_are_tried_in_turn(spark, monkeypatch):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(8))) for _ in range(80)})
    d = spark.createDataFrame([(w, w) for w in words], "ord string, word string")
    variants, tried = spell._variants, set()
    monkeypatch.setattr(spell, "_variants", lambda df, column, most: tried.add(most) or variants(df, column, most))
    for probes, levels in ([w[:3] + w[4:] for w in words if w], {0, 1}), (["dcbadcbadc", None, "", "abcdabcdab"], {0, 1, 2}):
        tried.clear()
        got = sorted((w, k, c) for w, c, k in spell.by_distance(spark.createDataFrame([(p,) for p in probes], "word string"), d).collect() if w is not None)
        want = []
        for p in sorted({p for p in probes if p is not None}):
            best = min(lev(p, w) for w in words)
            want += [(p, k + 1, c) for k, c in enumerate([w for w in words if lev(p, w) == best] if best <= 2 else [p])]
        assert got == want and tried == levels


def test_corrections_dont_meet_documents(spark, tmp_path):
    words, sf = [f"w{x}{y}z" for x in "abcde" for y in "abcd"], str(tmp_path)
    texts = [(i % 290, " ".join(words), "en", "src") for i in range(300)]  # ten ids have two rows
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(0, " ".join(words))], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    rows, most = made(catalog.QUERIES["corrected_search"](spark, sf))
    assert len(rows) > len(words) and {r.n_docs for r in rows} == {290} and most <= 600 * len(words)


def test_nearest_with_copies_and_large_values(spark):
    rng = np.random.default_rng(6)
    m = np.vstack([rng.normal(size=(300, 8)), np.repeat(rng.normal(size=(3, 8)), 20, axis=0), 1e6 + rng.normal(size=(40, 8)) * 1e-3])
    xs = np.vstack([m[::9] + rng.normal(size=m[::9].shape) * 1e-3, m[300:360:7]])
    for got_rows, got_d, x in zip(*vector._closest(m, xs, 5), xs, strict=True):
        d = ((m - x) ** 2).sum(axis=1)
        want = np.lexsort((np.arange(len(m)), d))[:5]
        order = np.lexsort((got_rows, got_d))[:5]
        assert (got_rows[order] == want).all() and (got_d[order] == d[want]).all()


def test_answers_of_every_hundredth_conversation(spark, tmp_path):
    sf = str(tmp_path)
    texts = [(i, f"Word{i} stands here. Other words follow it in text {i}.", "en", f"src{i}") for i in range(30)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string").write.parquet(f"{sf}/documents.parquet")
    turns = [(c, 0, "user", f"Word{c % 29} stands") for c in (0, 7, 100, 150, 300)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{sf}/conversations.parquet")
    got = {r.query_id: r for r in catalog.QUERIES["cited_answers"](spark, sf).collect()}
    assert got.keys() == {0, 100, 300}
    for c, r in got.items():
        assert "stands here." in r.answer and r.answer.count("SOURCE: src") == 7 == r.context.count("\n")


def test_pieces_come_in_small_batches(spark):
    docs = spark.createDataFrame([(i, "ab cd " * 200, "s") for i in range(300)], "doc_id long, text string, source string").coalesce(1)
    sizes = chunk.recursive_chunks(docs, keep=["source"]).mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in bs), "n long").collect()
    pieces = len(chunk.split_recursively("ab cd " * 200))
    assert sum(r.n for r in sizes) == 300 * pieces and max(r.n for r in sizes) <= 10_000
    assert {tuple(r) for r in chunk.recursive_chunks(docs, keep=["source"]).groupBy("source", "doc_id").count().select("source", "count").collect()} == {("s", pieces)}


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning")


def test_postings_of_single_rows_need_no_shuffle(spark):
    rows = [(1, "flow heat flow"), (2, "heat"), (2, "heat cold"), (None, "flow")]
    a = analyze.Analyzer(stop_words=())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.term, r.df, r.ids) for r in index.listed(index.postings(docs, a)).collect()) == [("cold", 1, [2]), ("flow", 2, [1]), ("heat", 2, [1, 2])]
    single = docs.where("text <> 'heat'")
    known = index.postings(single, a, keys_differ=True)
    assert sorted(map(str, known.collect())) == sorted(map(str, index.postings(single, a).collect()))
    assert shuffles(known) == 0 and shuffles(index.listed(known)) == 1


def test_blocks_are_indexed_where_their_texts_are(spark):
    docs = spark.createDataFrame([(i, " ".join(f"t{i % 2}{k % 25}" for k in range(200))) for i in range(40)], "doc_id long, text string")
    rows, most = made(index.block_index(docs, 10))
    assert sorted((r.block_id, r.term, r.ids) for r in rows) == sorted((b, f"t{i}{k}", list(range(10 * b + i, 10 * b + 10, 2))) for b in range(4) for i in range(2) for k in range(25))
    rows, merging = made(index.merge_blocks(index.block_index(docs, 10)))
    assert {(r.term, r.df, tuple(r.ids)) for r in rows} == {(f"t{i}{k}", 20, tuple(range(i, 40, 2))) for i in range(2) for k in range(25)}
    assert max(most, merging) <= 200  # 8,000 words, 1,000 pairs of term and id


def test_blocks_of_equal_and_missing_ids(spark):
    """Equal ids fill blocks like others and may lie in two; a null id counts, as in SQL; batches end anywhere."""
    ids = [5] * 7 + [None] * 3 + [1, 2, 9, 2**60 + 1, 2**60 + 2]
    known = sorted({i for i in ids if i is not None})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for kind, order in (("long", known), ("string", sorted(map(str, known)))):
            docs = spark.createDataFrame([(i, f'w{k} "all\\ all') for k, i in enumerate(ids)], "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
            blocks = index.block_index(docs, 4).cache()
            assert sorted((r.block_id, r["count"]) for r in blocks.where("term <> 'all'").groupBy("block_id").count().collect()) == [(0, 4), (1, 4), (2, 4), (3, 3)]
            of = {str(r.term): r for r in index.merge_blocks(blocks).collect()}
            assert of.pop("all").ids == [None, *order] and len(of) == len(ids)
            assert all(r.df == 1 and r.ids == [None if ids[int(t[1:])] is None else docs.schema["doc_id"].dataType.typeName() == "long" and ids[int(t[1:])] or str(ids[int(t[1:])])] for t, r in of.items())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_field_search_shuffles_found_pairs(spark, tmp_path):
    rng, words = random.Random(8), [a + b for a in "abcdefgh" for b in "klmnopqr"]
    phrases = [(i, " ".join(rng.choices(words, k=1 + i % 4)) + (" zz" if i == 5 else "")) for i in range(12)] + [(12, ""), (13, None), (14, "Ab1 ä"), (None, words[0])]
    for name, ids in (("once", [*range(99), None]), ("twice", [*range(50), *range(50)])):
        sf = str(tmp_path / name)
        texts = [None if i == 7 else "\n".join(" ".join(rng.choices(words, k=24)) for _ in range(2)) for i in range(100)]
        spark.createDataFrame([(i, t, "en", words[(i or 0) % 64]) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, lang string, source string").write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame(phrases, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        held = {}
        for i, t in zip(ids, texts, strict=True):
            held.setdefault(i, set()).update((t or "").split())
        wanted = [(q, set(p.split())) for q, p in phrases if p and "ä" not in p]
        want = {(q, i) for q, p in wanted for i, ws in held.items() if p <= ws or p == {words[(i or 0) % 64]}}
        rows, most = made(catalog.QUERIES["field_search"](spark, sf), "shuffleRecordsWritten")
        assert {tuple(r) for r in rows} == want and len(rows) == len(want)
        assert name == "twice" or most <= 2 * len(want)


def test_answer_of_odd_questions(spark):
    told = "Chunk a: red fox. A red red hen!\nBlue cow? end"
    d = spark.createDataFrame([("red hen!", told), ("", told), (None, told), ("cow? COW?", told), ("red", ""), ("zzz", told)], "q string, c string")
    got = [r.a for r in d.select(providers.extract_answer(F.col("q"), F.col("c")).alias("a")).collect()]
    assert got == ["A red red hen!", "Chunk a: red fox.", "Chunk a: red fox.", "Blue cow?", "", "Chunk a: red fox."]
