"""Secret scan: candidate strings judged by a random forest.

Candidates lie in white-space words that hold a run of at least ``MIN_LENGTH`` characters of
``[A-Za-z0-9+/_=.-]`` and either a digit, or an assignment (``name=value``, ``name: value``),
or follow a word that names a secret.  Every token run of 8 characters or more in such a word
is one if it holds a digit or ends the word; a word without such a run is one as a whole.
The text since the candidate before it in the word is its context, and the words before count
for the first one alone.  Its features are its length, its character classes and the
transitions between them, the share of it that dictionary words cover (pieces between
non-letters and capitals that are whole words of a public vocabulary), signs of paths,
addresses and numbers, and the words beside it.  The forest is trained here from labelled
findings: seeded examples of secrets (access keys, prefixed tokens, hexadecimal and base-64
values and passwords behind key words) and of the usual false positives (UUIDs, commit and
file hashes, paths, addresses, mail, telephone and card numbers, dates, identifiers, settings,
versions).  Everything runs as SQL expressions and JVM ML.

Defined results: null or empty text has no candidates; texts are read whole, however long;
every candidate gives a row, with its word number and its place in the word, so repeated
candidates, ties and repeated rows are rows of their own; a null doc_id stays null; an empty
table gives no rows; other columns are ignored; the candidate itself is returned as a SHA-256
and a masked form.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, whole_text

MIN_LENGTH = 8
TREES, DEPTH, EXAMPLES, SEED = 30, 8, 6000, 11
#: Public vocabulary whose whole words of three letters or more are the dictionary.
VOCABULARY = "byte_bpe_50k"
#: Words beside secrets, and words beside other long strings.
SECRET_WORDS = ["password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "auth", "bearer", "credential", "private"]
OTHER_WORDS = ["commit", "sha", "md5", "uuid", "guid", "isbn", "checksum", "digest", "revision", "version", "id", "call", "tel", "phone", "card", "mail", "visit", "see", "at", "file"]
FEATURES = ["length", "digits", "uppers", "lowers", "others", "transitions", "longest_letters", "hex_only", "dictionary", "slashes", "dots", "at_sign", "dashes", "uuid", "assigned", "secret_near", "other_near", "quoted", "prefix_token"]
#: Token runs that are candidates: those with a digit, and the one that ends the word.
_TOKEN = "[A-Za-z0-9+/_.@-]"
RUNS = f"(?<!{_TOKEN})((?=[A-Za-z+/_.@-]*[0-9]){_TOKEN}{{8,}}={{0,2}}|{_TOKEN}{{8,}}={{0,2}}(?=[^A-Za-z0-9]*$))"


def _pieces(word: Column) -> Column:
    """The word cut after each candidate run; what follows the last one stays with it unless it holds letters or digits."""
    cut = F.split(F.regexp_replace(word, RUNS, "$1\n"), "\n")  # words hold no line ends
    return F.when(F.size(cut) < 2, F.array(word)).when(F.element_at(cut, -1).rlike("[A-Za-z0-9]"), F.slice(cut, 1, F.size(cut) - 1)).otherwise(
        F.concat(F.slice(cut, 1, F.size(cut) - 2), F.array(F.array_join(F.slice(cut, -2, 2), "")))
    )


def _core() -> Column:
    """The candidate without quotes, brackets and what stands before '=' or ':'."""
    return F.regexp_extract("word", r"([A-Za-z0-9+/_.@-]{8,}={0,2})[^A-Za-z0-9]*$", 1)


def dictionary_words(vocabulary: str = VOCABULARY) -> list[str]:
    """Whole words of the vocabulary, by their first two letters: 26 by 26 strings of words framed by spaces."""
    import base64

    import public_tokenizers

    starts: dict[tuple[str, str], set[str]] = {}
    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:  # a list of fixed length
        for line in lines:
            piece = base64.b64decode(line.split()[0]).decode("utf-8", "ignore")
            word = piece[1:].lower()
            if piece[:1] == " " and len(word) > 2 and word.isascii() and word.isalpha():
                starts.setdefault((word[0], word[1]), set()).add(word)
    letters = "abcdefghijklmnopqrstuvwxyz"
    return [" " + " ".join(sorted(starts.get((a, b), ()))) + " " for a in letters for b in letters]


def _dictionary_share(words: list[str]) -> Column:
    """Letters of the core in pieces that are dictionary words, over its length."""
    apart = F.regexp_replace("core", "([a-z])([A-Z])", "$1 $2")
    pieces = F.filter(F.split(F.lower(apart), "[^a-z]+"), lambda w: F.length(w) > 2)
    table = F.array(*map(F.lit, words))
    place = lambda w: (F.ascii(w) - 97) * 26 + F.ascii(F.substring(w, 2, 1)) - 97
    known = F.filter(pieces, lambda w: F.contains(F.get(table, place(w)), F.concat(F.lit(" "), w, F.lit(" "))))
    return F.aggregate(known, F.lit(0), lambda n, w: n + F.length(w)) / F.greatest(F.length("core"), F.lit(1))


def features(found: DataFrame, words: list[str] | None = None) -> DataFrame:
    """Feature columns from word, before2, before1 and after1 (all strings)."""
    n = lambda pattern, c="core": (F.length(c) - F.length(F.regexp_replace(c, pattern, ""))).cast("double")
    near = F.lower(F.concat_ws(" ", "before2", "before1", F.regexp_extract("word", r"^(.*?)[=:]", 1)))
    listed = lambda words: near.rlike(r"(^|[^a-z])(" + "|".join(words) + r")([^a-z]|$)").cast("double")
    df = found.withColumn("core", F.when(F.length(_core()) > 0, _core()).otherwise(F.col("word")))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("core", "[A-Z]+", "A"), "[a-z]+", "a"), "[0-9]+", "9")
    length = F.greatest(F.length("core"), F.lit(1)).cast("double")
    longest = F.array_max(F.transform(F.split("core", "[^A-Za-z]+"), lambda x: F.length(x)))
    return df.withColumns(
        {
            "length": length,
            "digits": n("[0-9]") / length,
            "uppers": n("[A-Z]") / length,
            "lowers": n("[a-z]") / length,
            "others": n("[^A-Za-z0-9]") / length,
            "transitions": F.length(shape) / length,
            "longest_letters": longest.cast("double"),
            "hex_only": F.col("core").rlike("^[0-9a-f]+$").cast("double"),
            "dictionary": _dictionary_share(words or dictionary_words()),
            "slashes": n("[^/\\\\]", "word") * -1 + F.length("word"),
            "dots": n("[^.]", "word") * -1 + F.length("word"),
            "at_sign": F.col("word").contains("@").cast("double"),
            "dashes": n("[^-]") * -1 + F.length("core"),
            "uuid": F.col("core").rlike("(?i)[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}").cast("double"),
            "assigned": (F.col("word").rlike("[A-Za-z_-]{3,}[=:]") | F.col("before1").isin("=", ":", ":=") | F.col("before1").endswith("=") | F.col("before1").endswith(":")).cast("double"),
            "secret_near": listed(SECRET_WORDS),
            "other_near": listed(OTHER_WORDS),
            "quoted": F.col("word").rlike("[\"'`]").cast("double"),
            "prefix_token": F.col("core").rlike("^(AKIA|ASIA|gh[pousr]_|sk_|pk_|xox[abp]-|AIza|eyJ|glpat-)").cast("double"),
        }
    )


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, word_index, part (place in the word), word (the part itself) and the words around it, one row for each candidate of each whole text."""
    words = F.array_remove(F.split(F.regexp_replace(whole_text(), f"[{SPACE}]+", " "), " "), "")
    df = docs.select("doc_id", F.transform(words, lambda w: w).alias("words"))
    named = "(?i)(" + "|".join(SECRET_WORDS) + ")[\"')]*[=:]*$"
    before = lambda i: F.coalesce(F.when(i > 0, F.get("words", i - 1)), F.lit(""))
    told = lambda w, i: w.rlike("[0-9]") | w.rlike("[A-Za-z_-]{3,}[\"']?[=:][\"']?[A-Za-z0-9+/_.-]") | before(i).rlike(named) | before(i).rlike("^[=:]+$")
    fits = lambda w, i: (F.length(w) >= MIN_LENGTH) & w.rlike("[A-Za-z0-9+/_=.-]{%d,}" % MIN_LENGTH) & told(w, i)
    numbered = F.filter(F.transform("words", lambda w, i: F.when(fits(w, i), i)), lambda i: i.isNotNull())
    df = df.withColumn("at", numbered)
    picked = F.transform("at", lambda i: F.struct(i.alias("i"), F.get("words", i).alias("word"), *[F.coalesce(F.when(i + k >= 0, F.get("words", i + k)), F.lit("")).alias(name) for k, name in ((-2, "before2"), (-1, "before1"), (1, "after1"))]))
    each = df.select("doc_id", F.explode(picked).alias("c")).select("doc_id", F.col("c.i").cast("long").alias("word_index"), "c.*")
    each = each.select("doc_id", "word_index", "before2", "before1", "after1", F.posexplode(_pieces(F.col("word"))).alias("part", "word"))
    first = lambda c: F.when(F.col("part") == 0, F.col(c)).otherwise("").alias(c)
    return each.select("doc_id", "word_index", "part", "word", first("before2"), first("before1"), "after1")


def labelled_findings(spark: SparkSession, n: int = EXAMPLES, seed: int = SEED) -> DataFrame:
    """Seeded labelled findings: word, before2, before1, after1 and label (1: a secret)."""
    hexa = F.sha2(F.concat(F.lit(f"{seed}-"), F.col("id")), 256)
    mixed = F.regexp_replace(F.base64(F.unhex(hexa)), "=", "")
    upper = F.upper(F.substring(F.regexp_replace(mixed, "[^A-Za-z0-9]", "Q"), 1, 24))
    digits = F.substring(F.conv(F.substring(hexa, 1, 14), 16, 10), 1, 16)
    cut = lambda c, low, span: F.substr(c, F.lit(1), F.lit(low) + F.pmod(F.xxhash64("id", F.lit(low)), F.lit(span)).cast("int"))
    word = F.element_at(F.array(*[F.lit(w) for w in ("the", "rather", "on", "une", "und", "con", "station", "measure")]), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(8)) + 1).cast("int"))
    pick = lambda words, s: F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(F.xxhash64("id", F.lit(s)), F.lit(len(words))) + 1).cast("int"))
    key = pick(SECRET_WORDS[:8], 2)
    long_word = pick(["production", "temperature", "observation", "development", "information", "environment", "application", "international", "measurements", "elizabeth"], 6)
    uuid = F.concat_ws("-", F.substring(hexa, 1, 8), F.substring(hexa, 9, 4), F.substring(hexa, 13, 4), F.substring(hexa, 17, 4), F.substring(hexa, 21, 12))
    octet = lambda k: F.conv(F.substring(hexa, k, 2), 16, 10)
    kinds = [  # (label, before2, before1, word)
        (1, word, word, F.concat(F.lit("AKIA"), F.substring(upper, 1, 16))),
        (1, key, F.lit("="), F.concat(F.lit('"'), cut(hexa, 20, 40), F.lit('"'))),
        (1, word, word, F.concat(key, F.lit("="), cut(hexa, 14, 12))),
        (1, word, F.concat(key, F.lit(":")), cut(mixed, 16, 24)),
        (1, word, word, F.concat(pick(["ghp_", "sk_live_", "xoxb-", "glpat-", "AIza"], 3), cut(F.regexp_replace(mixed, "[^A-Za-z0-9]", "x"), 24, 16))),
        (1, word, word, F.concat(key, F.lit("="), cut(mixed, 14, 26))),
        (0, word, pick(["uuid", "id", "guid"], 4), uuid),
        (0, word, pick(["commit", "sha", "revision", "digest", "checksum", "md5"], 4), cut(hexa, 32, 9)),
        (0, word, word, F.concat(F.lit("https://www.example"), octet(1), F.lit(".com/"), word, F.lit("/"), F.substring(hexa, 1, 10), F.lit(".html"))),
        (0, word, word, F.concat(word, F.lit("."), octet(1), F.lit("@mail"), F.substring(digits, 1, 1), F.lit(".example.com"))),
        (0, word, word, digits),
        (0, word, word, F.concat_ws(".", octet(1), octet(3), octet(5), octet(7))),
        (0, word, word, F.concat(F.lit("/usr/share/"), word, F.lit("/"), F.substring(digits, 1, 4), F.lit("/"), word, F.lit(".txt"))),
        (0, word, word, F.concat(word, word, F.substring(digits, 1, 2))),
        (0, word, word, F.concat(F.lit("version="), octet(1), F.lit("."), octet(3), F.lit("."), F.substring(digits, 1, 8))),
        (1, word, word, F.concat(key, F.lit("="), cut(F.regexp_replace(mixed, "[^A-Za-z]", ""), 9, 10))),
        (1, key, F.lit(":"), F.concat(F.initcap(long_word), F.substring(digits, 1, 3), F.lit("!"), cut(F.regexp_replace(mixed, "[^A-Za-z]", ""), 3, 4))),
        (0, word, word, F.concat(pick(["mode=", "name=", "title=", "label:", "type="], 5), long_word)),
        (0, word, F.lit("="), long_word),
        (0, word, word, F.concat(F.lit("20"), F.substring(digits, 1, 2), F.lit("-0"), F.substring(digits, 3, 1), F.lit("-1"), F.substring(digits, 4, 1))),
        (0, word, word, F.concat(long_word, F.lit("-"), long_word, F.substring(digits, 1, 1))),
        (0, F.lit("tel"), word, F.concat(F.lit("+1-"), F.substring(digits, 1, 3), F.lit("-"), F.substring(digits, 4, 3), F.lit("-"), F.substring(digits, 7, 4))),
    ]
    rows = F.element_at(F.array(*[F.struct(F.lit(y).alias("label"), b2.alias("before2"), b1.alias("before1"), w.alias("word")) for y, b2, b1, w in kinds]), (F.pmod("id", F.lit(len(kinds))) + 1).cast("int"))
    return spark.range(n).select(rows.alias("r"), word.alias("after1")).select("r.*", "after1")


def train(findings: DataFrame) -> RandomForestClassificationModel:
    """The forest, from labelled findings."""
    table = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features(findings))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="features", labelCol="label")
    return forest.fit(table.select("features", F.col("label").cast("double").alias("label")).coalesce(1))


def scan(docs: DataFrame, model: RandomForestClassificationModel | None = None) -> DataFrame:
    """doc_id, word_index, candidate_sha256, masked, length, score, is_secret and part of every candidate."""
    spark = docs.sparkSession
    model = model or train(labelled_findings(spark))
    table = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features(candidates(docs)))
    scored = model.transform(table).withColumn("score", vector_to_array("probability")[1])
    masked = F.concat(F.substring("core", 1, 4), F.lit("..."), F.length("core").cast("string"))
    return scored.select("doc_id", "word_index", F.sha2(F.encode("core", "UTF-8"), 256).alias("candidate_sha256"), masked.alias("masked"), F.length("core").cast("long").alias("n_chars"), F.round("score", 6).alias("score"), (F.col("score") >= 0.5).alias("is_secret"), "part")
