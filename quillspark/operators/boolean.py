"""Boolean retrieval: two query syntaxes, one syntax tree, and one aggregate over the postings for any query.

A tree is a term (str) or ("not", x), ("and", x, y, ...), ("or", x, y, ...). NOT binds tightest, then AND, then OR.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .analyze import Analyzer, snippet

Tree = str | tuple
_SYMBOLS = re.compile(r"\s*(&&|\|\||~|\(|\)|(?:(?!&&|\|\|)[^\s~()])+)")
_AS = {"&&": "and", "||": "or", "~": "not"}


def symbol_tokens(query: str) -> list[tuple[str, str]]:
    """Tokens of the syntax with && || ~ ( ), no blanks needed."""
    return [(_AS[t], t) if t in _AS else (t, t) if t in "()" else ("term", t.lower()) for t in _SYMBOLS.findall(query)]


def keyword_tokens(query: str) -> list[tuple[str, str]]:
    """Tokens of the syntax with AND OR NOT ( ) in any case; parentheses need no blanks."""
    parts = re.findall(r"[()]|[^\s()]+", query)
    return [(t, t) if t in "()" else (t.lower(), t) if t.upper() in ("AND", "OR", "NOT") else ("term", t.lower()) for t in parts]


def parse(tokens: list[tuple[str, str]], implicit: str | None = None, loose_and: bool = False) -> Tree | None:
    """The tree of a query, None for an empty one.

    Neighbouring operands raise ValueError unless `implicit` is "and" or "or". loose_and: AND binds loosest.
    """
    order = ("and", "or") if loose_and else ("or", "and")
    at = 0

    def peek() -> str:
        return tokens[at][0] if at < len(tokens) else ""

    def level(k: int) -> Tree:
        nonlocal at
        if k == len(order):
            return unary()
        left = level(k + 1)
        grown: list = []
        while True:
            if peek() == order[k]:
                at += 1
            elif not (implicit == order[k] and peek() in ("term", "not", "(")):
                return (order[k], *grown) if grown else left
            right = level(k + 1)
            if grown and left[0] == order[k]:
                grown.append(right)
                continue
            grown = [left, right]
            left = (order[k], grown)

    def unary() -> Tree:
        nonlocal at
        kind = peek()
        if kind == "not":
            at += 1
            return ("not", unary())
        if kind == "(":
            at += 1
            inner = level(0)
            if peek() != ")":
                raise ValueError("a parenthesis isn't closed")
            at += 1
            return inner
        if kind != "term":
            raise ValueError(f"an operand is missing before {kind or 'the end'}")
        at += 1
        return tokens[at - 1][1]

    if not tokens:
        return None
    tree = level(0)
    if at < len(tokens):
        raise ValueError(f"unexpected {tokens[at][1]!r}")
    return tree


def parse_symbols(query: str, implicit: str | None = None) -> Tree | None:
    return parse(symbol_tokens(query), implicit)


def parse_keywords(query: str, implicit: str | None = None, loose_and: bool = False) -> Tree | None:
    return parse(keyword_tokens(query), implicit, loose_and)


def any_of(question: str) -> Tree | None:
    """A question's words, joined by OR; "and", "or" and "not" are words here."""
    words = list(dict.fromkeys(re.findall(r"\w+", question.lower())))
    return ("or", *words) if len(words) > 1 else words[0] if words else None


def fold(tree: Tree, of_term: Callable, of_not: Callable, of_and: Callable, of_or: Callable):
    """The tree with functions in the place of its nodes; those of AND and OR take two."""
    if isinstance(tree, str):
        return of_term(tree)
    parts = [fold(x, of_term, of_not, of_and, of_or) for x in tree[1:]]
    return of_not(*parts) if tree[0] == "not" else reduce(of_and if tree[0] == "and" else of_or, parts)


def terms(tree: Tree | None) -> list[str]:
    """The terms of a tree, sorted."""
    return [] if tree is None else sorted({tree} if isinstance(tree, str) else {t for x in tree[1:] for t in terms(x)})


def normalized(tree: Tree | None, analyzer: Analyzer) -> Tree | None:
    """The tree with terms as the index has them; a stop word's postings are empty."""
    if tree is None or isinstance(tree, str):
        return tree and analyzer.term(tree)
    return (tree[0], *(normalized(x, analyzer) for x in tree[1:]))


def needs_universe(tree: Tree) -> bool:
    """Whether a document without any of the terms satisfies the tree."""
    return fold(tree, lambda t: False, lambda x: not x, lambda x, y: x and y, lambda x, y: x or y)


Flag = str | frozenset


def flags_of(tree: Tree) -> set[Flag]:
    """What a tree asks of a document: terms, and sets of terms of which one will do (those of an OR)."""
    if isinstance(tree, str):
        return {tree}
    parts = [x for x in tree[1:] if not isinstance(x, str)]
    own = _any(tree)
    return {f for x in parts for f in flags_of(x)} | ({own} if own else {x for x in tree[1:] if isinstance(x, str)})


def _any(tree: tuple) -> frozenset | None:
    own = frozenset(x for x in tree[1:] if isinstance(x, str))
    return own if tree[0] == "or" and len(own) > 1 else None


def condition(tree: Tree, flag: Callable[[Flag], Column]) -> Column:
    """The tree as a column of flags."""
    if isinstance(tree, str):
        return flag(tree)
    own = _any(tree)
    parts = [condition(x, flag) for x in tree[1:] if not (own and isinstance(x, str))] + ([flag(own)] if own else [])
    return ~parts[0] if tree[0] == "not" else reduce((lambda x, y: x & y) if tree[0] == "and" else (lambda x, y: x | y), parts)


def evaluate(postings: DataFrame, tree: Tree | None, universe: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key) of the documents that satisfy a tree: one aggregate, whatever the tree. universe holds all keys."""
    return evaluate_all(postings, {0: tree}, universe, key).select(key)


def evaluate_all(postings: DataFrame, queries: dict[int, Tree | None], universe: DataFrame, key: str = "doc_id") -> DataFrame:
    """(qid, key) for several queries over one table of flags. An empty query has no result."""
    queries = {q: t for q, t in queries.items() if t is not None}
    asked = sorted({f for tree in queries.values() for f in flags_of(tree)}, key=lambda f: (isinstance(f, frozenset), sorted(f) if isinstance(f, frozenset) else f))
    names = {f: f"t{i}" for i, f in enumerate(asked)}
    all_terms = sorted({t for tree in queries.values() for t in terms(tree)})
    wanted = postings.where(F.col("term").isin(all_terms)) if names else postings.limit(0)
    has = lambda f: F.col("term").isin(sorted(f)) if isinstance(f, frozenset) else F.col("term") == f
    flags = wanted.groupBy(key).agg(F.max(F.lit(True)).alias("any"), *[F.coalesce(F.bool_or(has(f)), F.lit(False)).alias(n) for f, n in names.items()])
    if any(map(needs_universe, queries.values())):
        flags = universe.select(key).distinct().join(flags, key, "left").fillna(False, subset=list(names.values()))
    hit = [F.when(condition(tree, lambda t: F.col(names[t])), F.lit(q)) for q, tree in queries.items()]
    found = F.explode(F.array_compact(F.array(*hit))) if hit else F.explode(F.array().cast("array<int>"))
    return flags.select(found.alias("qid"), key)


def with_snippets(ids: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 500) -> DataFrame:
    """(key, snippet) of found documents."""
    return docs.join(ids.select(key), key, "left_semi").select(key, snippet(F.col(text), size).alias("snippet"))


def context(chunks: DataFrame, key: str = "doc_id", text: str = "text", most: int = 25) -> DataFrame:
    """(context): the first `most` chunks by key, numbered, in one string."""
    first = chunks.orderBy(key).limit(most)
    line = F.concat(F.lit("chunk "), F.col(key).cast("string"), F.lit(": "), F.col(text), F.lit("\n"))
    return first.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), line.alias("line")))), lambda x: x["line"]), "").alias("context"))


def first_of_any(questions: DataFrame, pairs: DataFrame, analyzer: Analyzer, key: str = "chunk_id", most: int = 25) -> DataFrame:
    """(query_id, key, rank): for each question (query_id, query) the first `most` keys, in order, that hold any of its
    words. Of a word's postings only the first `most` can matter, so a frequent word brings no more than that."""
    asked = questions.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("query", F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))).alias("term"))
    asked = asked.where(~F.col("term").isin(list(analyzer.stop_words))) if analyzer.stop_words else asked
    first = pairs.withColumn("n", F.row_number().over(Window.partitionBy("term").orderBy(key))).where(F.col("n") <= most).select("term", key)
    hits = asked.join(first, "term").select("query_id", key).distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(key))
    return hits.withColumn("rank", rank).where(F.col("rank") <= most)
