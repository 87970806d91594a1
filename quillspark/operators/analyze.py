"""Text analysis: tokens, filters, lemmas and small text functions, as column expressions."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Unicode white space, written so that Java's and RE2's engines read it alike.
SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

#: English stop words.
STOP_WORDS = tuple(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for with about against between into through during "
    "before after above below to from up down in out on off over under again further then once here there when where why how all any "
    "both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)

#: Irregular verbs, base form first.
IRREGULAR = tuple(
    x.split()
    for x in (
        "be am is are was were been being", "have has had having", "do does did done doing", "go goes went gone", "say said", "make made",
        "take took taken", "come came", "see saw seen", "know knew known", "get got gotten", "give gave given", "find found", "think thought",
        "tell told", "become became", "show showed shown", "leave left", "feel felt", "bring brought", "begin began begun", "keep kept",
        "hold held", "write wrote written", "stand stood", "hear heard", "let lets", "mean meant", "set sets", "meet met", "run ran", "pay paid",
        "sit sat", "speak spoke spoken", "lie lay lain", "lead led", "read reads", "grow grew grown", "lose lost", "fall fell fallen",
        "send sent", "build built", "understand understood", "draw drew drawn", "break broke broken", "spend spent", "rise rose risen",
        "drive drove driven", "buy bought", "wear wore worn", "choose chose chosen", "flow flowed flown",
    )
)
#: Regular verbs whose forms follow from rules.
REGULAR = tuple(
    "use work call try ask need seem help turn start play move like live believe happen include continue change follow stop create allow add "
    "offer remember consider appear wait serve expect stay reach remain suggest raise pass require report decide measure obtain study "
    "investigate present analyze compare discuss derive solve apply heat cool vary increase decrease depend determine describe".split()
)


def words(text: Column) -> Column:
    """The text's words in lower case, cut at white space; null and empty texts have none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE + "+"), lambda w: w != "")


def only_letters(tokens: Column) -> Column:
    """Tokens of letters alone: others are dropped, not trimmed."""
    return F.filter(tokens, lambda w: w.rlike(r"^\p{L}+$"))


def without(tokens: Column, stop_words: Iterable[str]) -> Column:
    """Tokens that are no stop words."""
    stop = list(stop_words)
    return F.filter(tokens, lambda w: ~w.isin(stop)) if stop else tokens


def word_runs(text: Column) -> Column:
    """Maximal runs of letters, digits and underscores, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def ascii_words(text: Column) -> Column:
    """Maximal word runs that are ASCII letters alone, in lower case; their places count these only."""
    return F.filter(word_runs(text), lambda w: w.rlike("^[a-z]+$"))


def block_words(text: str | None) -> set[str]:
    """Terms of the block index, each once: case is kept, backslashes and double quotes go, empty terms go. Python
    splits at the same white space as SPACE."""
    return set((text or "").replace("\\", "").replace('"', "").split())


def flat_line(text: Column) -> Column:
    """Line feeds as blanks."""
    return F.translate(text, "\n", " ")


def short_name(name: Column, size: int = 10) -> Column:
    """A name of more than `size` characters as its beginning and dots."""
    return F.when(F.char_length(name) > size, F.concat(F.substring(name, 1, size), F.lit("..."))).otherwise(name)


def snippet(text: Column, size: int = 500) -> Column:
    """The text's beginning and dots, which are always there."""
    return F.concat(F.substring(text, 1, size), F.lit("..."))


def verb_forms() -> list[tuple[str, str]]:
    """(form, base form) of the verbs above."""
    out = {f: base for base, *forms in IRREGULAR for f in forms}
    for v in REGULAR:
        stem = v[:-1] if v.endswith("e") else v
        ied = v.endswith("y") and v[-2] not in "aeiou"
        for f in (v[:-1] + "ies" if ied else v + ("es" if v.endswith(("s", "x", "ch", "sh")) else "s"), v[:-1] + "ied" if ied else stem + "ed", stem + "ing"):
            out.setdefault(f, v)
    return sorted(out.items())


def lexicon(spark: SparkSession, forms: Iterable[tuple[str, str]] | None = None) -> DataFrame:
    """(form, lemma), a form once."""
    return spark.createDataFrame(sorted(dict(verb_forms() if forms is None else forms).items()), "form string, lemma string")


def lemmatize(tokens: DataFrame, lemmas: DataFrame, column: str = "term") -> DataFrame:
    """tokens with the lemma of a column's words in their place, where the lexicon has one."""
    known = lemmas.select(F.col("form").alias("__form"), F.col("lemma").alias("__lemma"))
    return tokens.join(known, tokens[column] == F.col("__form"), "left").withColumn(column, F.coalesce("__lemma", column)).drop("__form", "__lemma")


@dataclass(frozen=True)
class Analyzer:
    """How texts become terms: stop words go by their surface form, before lemmas."""

    letters_only: bool = True
    stop_words: tuple[str, ...] = STOP_WORDS
    lemmas: tuple[tuple[str, str], ...] = ()

    def tokens(self, text: Column) -> Column:
        """Terms of a text in order, before lemmas."""
        out = words(text)
        return without(only_letters(out) if self.letters_only else out, self.stop_words)

    def terms(self, docs: DataFrame, key: str = "doc_id", text: str = "text", once: bool = False) -> DataFrame:
        """(key, term) for every token; once: a row's equal tokens count as one."""
        cut = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), SPACE + "+")
        out = docs.select(F.col(key), F.explode(F.array_distinct(cut) if once else cut).alias("term")).where("term <> ''")
        out = out.where(F.col("term").rlike(r"^\p{L}+$")) if self.letters_only else out  # rows, as filters of rows are compiled
        out = out.where(~F.col("term").isin(list(self.stop_words))) if self.stop_words else out
        return lemmatize(out, lexicon(docs.sparkSession, self.lemmas)) if self.lemmas else out

    def term(self, word: str) -> str:
        """A query's word as the index has it; "" for stop words."""
        w = word.lower()
        return "" if w in self.stop_words else dict(self.lemmas).get(w, w)

    def rewritten(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """docs with the text as its terms, joined by blanks."""
        lemma = dict(self.lemmas)
        tokens = self.tokens(F.col(text))
        if lemma:
            known = F.create_map(*[F.lit(x) for kv in lemma.items() for x in kv])
            tokens = F.transform(tokens, lambda w: F.coalesce(F.try_element_at(known, w), w))
        return docs.withColumn(text, F.array_join(tokens, " "))
