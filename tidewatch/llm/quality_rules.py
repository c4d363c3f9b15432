"""Quality rules: base counts, then divergence of a document's histograms from its language's.

For each document two histograms are made of its whole text: characters by class, and the
common words of its language (with all other words as one bin).  The references are the
mean histograms of each language over all documents that pass the base rules.  A document
is rejected when the Jensen-Shannon distance (base 2, 0 to 1) of either histogram from its
reference is above a limit, provided it is long enough for the histogram to mean something.
The word limit is a share of the distance that a text without any common word has, so it lies
within reach in every language.  Texts are measured once: histograms and counts are written,
references are taken from them and joined back.

Defined results: null or empty text has no words, fails the base rules and is not kept; a
language that is null or not in ``COMMON_WORDS`` gets the character test alone; a language
with fewer than ``min_reference_docs`` such documents gets no divergence test; rows are
judged one by one, so repeated rows and ties get equal verdicts and null doc_ids do not matter;
texts are measured whole, however long; an empty table gives no rows.  Other columns stay as
they are; where one has the name of a column made here, the made one replaces it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, give_back, own_columns, stage, whole_text

#: Frequent function words of each language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "that", "is", "for"],
    "fr": ["de", "la", "le", "les", "et", "des", "un", "que"],
    "de": ["der", "die", "und", "das", "ist", "in", "für", "den"],
    "es": ["de", "la", "que", "el", "en", "los", "un", "por"],
}
CHAR_CLASSES = ["lower", "other_letter", "upper", "digit", "space", "stop", "symbol"]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: Distances of characters above this reject; of words, above this share of the distance of a text without common words.
    char_limit: float = 0.25
    word_limit: float = 0.85
    #: Guards: shorter documents get no divergence test.
    min_chars: int = 300
    min_hist_words: int = 50
    min_reference_docs: int = 20


def _words_text(text: Column) -> Column:
    """The text's words joined and framed by single spaces."""
    return F.regexp_replace(text, f"[{SPACE}]+", " ")


def _split_words(flat: Column) -> Column:
    return F.array_remove(F.split(flat, " "), "")


def _char_classes(df: DataFrame) -> DataFrame:
    """Column char_hist: characters of the text in each of CHAR_CLASSES; each step strips one class."""
    steps = [("[a-z]+", "lower"), (f"[{SPACE}]+", "space"), ("[\\u00DF-\\u00F6\\u00F8-\\u00FF]+", "other_letter"), ("[A-Z\\u00C0-\\u00D6\\u00D8-\\u00DE]+", "upper"), ("[0-9]+", "digit"), ("[.,;:?'\"()-]+", "stop")]
    df = df.withColumn("_rest0", F.col("_text"))
    for k, (pattern, _) in enumerate(steps):
        df = df.withColumn(f"_rest{k + 1}", F.regexp_replace(f"_rest{k}", pattern, ""))
    sizes = {name: F.length(f"_rest{k}") - F.length(f"_rest{k + 1}") for k, (_, name) in enumerate(steps)}
    sizes["symbol"] = F.length(f"_rest{len(steps)}")
    # transform() keeps the optimizer from copying the counts into every later use of a bin.
    df = df.withColumn("char_hist", F.transform(F.array(*[sizes[c].cast("long") for c in CHAR_CLASSES]), lambda n: n))
    return df.drop(*[f"_rest{k}" for k in range(len(steps) + 1)])


def _common_words(df: DataFrame) -> DataFrame:
    """Column word_hist: counts of the language's common words (case ignored), then of all other words."""
    spaced = F.concat(F.lit(" "), F.replace(F.lower(F.col("_flat")), F.lit(" "), F.lit("  ")), F.lit(" "))
    df = df.withColumn("_spaced", spaced)
    words = F.lit(None).cast("array<string>")
    for lang, common in COMMON_WORDS.items():
        words = F.when(F.col("lang") == lang, F.array(*[F.lit(f" {w} ") for w in common])).otherwise(words)
    df = df.withColumn("_common", words)
    count = lambda w: ((F.length("_spaced") - F.length(F.replace(F.col("_spaced"), w, F.lit("")))) / F.length(w)).cast("long")
    df = df.withColumn("_counts", F.transform("_common", count))
    others = F.col("n_words") - F.aggregate("_counts", F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("word_hist", F.concat("_counts", F.transform(F.array(others), lambda n: n))).drop("_spaced", "_common", "_counts")


def _base(df: DataFrame, rules: Rules) -> DataFrame:
    """The base counts and base_failed; needs _text and _flat (white space made single spaces)."""
    has_word = lambda line: line.rlike(f"[^{SPACE}]")
    df = df.withColumn("_words", _split_words(F.col("_flat"))).withColumn("n_words", F.size("_words").cast("long"))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), has_word))
    # A window of three words as one string; words hold no spaces, so this is one to one.
    starts = F.when(F.col("n_words") >= 3, F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int"))).otherwise(F.array().cast("array<int>"))
    window = lambda i: F.concat_ws(" ", F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))
    df = df.withColumn("_windows", F.transform(starts, window))
    df = df.withColumn("_repeats", F.size(F.array_distinct("_windows")) < F.size("_windows"))
    # Only where a window repeats: sort (window, place) and keep the places whose neighbour is equal.
    df = df.withColumn("_sorted", F.when(F.col("_repeats"), F.sort_array(F.transform("_windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))))
    equal = lambda x, k: (x["w"] == F.get("_sorted", k - 1)["w"]) | (x["w"] == F.get("_sorted", k + 1)["w"])
    found = F.filter("_sorted", lambda x, k: F.coalesce(equal(x, k), F.lit(False)))
    covered = F.array_distinct(F.flatten(F.transform(found, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    return df.withColumns(
        {
            "word_chars": F.length(F.replace(F.col("_flat"), F.lit(" "), F.lit(""))).cast("long"),
            "n_symbols": F.length(F.regexp_replace("_text", "[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.when(F.col("_repeats"), F.size(covered)).otherwise(0).cast("long"),
        }
    ).withColumn("base_failed", (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")))


def _measured(docs: DataFrame, rules: Rules, keep: list[str] | None = None) -> DataFrame:
    """The caller's columns as ``_own``, lang, the base counts, base_failed and the histograms."""
    df = docs.select(own_columns(docs, keep), F.col("lang"), whole_text().alias("_text")).withColumn("_flat", _words_text(F.col("_text")))
    df = _char_classes(_base(df, rules))
    return _common_words(df).drop("_text", "_flat", "_words", "_lines", "_windows", "_repeats", "_sorted")


def _shares(df: DataFrame) -> DataFrame:
    """Columns char_shares and word_shares: each bin over the sum of bins (null where that is 0)."""
    for name in ("char", "word"):
        total = F.aggregate(f"{name}_hist", F.lit(0).cast("long"), lambda a, x: a + x)
        df = df.withColumn("_total", total).withColumn(f"{name}_shares", F.when(F.col("_total") > 0, F.transform(f"{name}_hist", lambda x: x / F.col("_total")))).drop("_total")
    return df


def references(shares: DataFrame, rules: Rules) -> DataFrame:
    """One row per language: mean share of each bin over the documents that pass the base rules, and the word limit."""
    words = len(next(iter(COMMON_WORDS.values()))) + 1
    means = lambda name, bins: F.array(*[F.avg(F.col(name)[k]) for k in range(bins)])
    found = (
        shares.where(~F.col("base_failed")).groupBy(F.col("lang").alias("ref_lang"))
        .agg(means("char_shares", len(CHAR_CLASSES)).alias("ref_chars"), means("word_shares", words).alias("ref_words"), F.count(F.lit(1)).alias("ref_docs"))
        .where(F.col("ref_docs") >= rules.min_reference_docs)
    )
    none = F.array(*[F.lit(float(k == words - 1)) for k in range(words)])
    return found.withColumn("ref_limit", rules.word_limit * js_distance(none, "ref_words"))


def js_distance(shares: Column | str, ref: Column | str) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of shares."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    terms = F.zip_with(shares, ref, lambda p, q: (part(p, (p + q) / 2) + part(q, (p + q) / 2)) / 2)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


MADE = (*COUNTS, "base_failed", "kept", "char_distance", "word_distance")


def judge(docs: DataFrame, rules: Rules = Rules(), keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns named in ``keep``) with the base counts, base_failed, kept, char_distance and word_distance."""
    df = _shares(stage(_measured(docs, rules, keep), "quality-measured"))
    # The references are a row per language; written first, their size is known when they are joined.
    refs = stage(references(df, rules), "quality-references")
    df = df.join(refs, F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    df = df.withColumns(
        {
            "char_distance": F.when(F.col("word_chars") >= rules.min_chars, js_distance("char_shares", "ref_chars")),
            "word_distance": F.when(F.col("n_words") >= rules.min_hist_words, js_distance("word_shares", "ref_words")),
        }
    )
    far = F.coalesce(F.col("char_distance") > rules.char_limit, F.lit(False)) | F.coalesce(F.col("word_distance") > F.col("ref_limit"), F.lit(False))
    return df.withColumn("kept", ~F.col("base_failed") & ~far).select(*give_back(docs, keep, MADE), *MADE)


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that are kept, with its columns."""
    whole = docs.select(own_columns(docs), *[F.col(c) for c in ("text", "lang")])
    return judge(whole, rules, ["_own"]).where("kept").select(*give_back(docs))
