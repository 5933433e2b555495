"""Secret scans: candidate tokens and a random forest that removes false positives.

A candidate is a run of at least 15 letters, digits and ``_ + / -`` that holds a digit. Features are
its length, its character transitions (changes between lower case, upper case, digits and signs), its
shares of digits and of distinct characters, how much of it words of a dictionary cover, whether it
stands in a path or address, and what the neighbouring words say. The dictionary is the most frequent
words of the corpus itself. The forest is trained from labelled findings; ``labelled_findings`` makes
a table of ``FINDINGS`` of them (keys, tokens and passwords in assignments against card and phone
numbers, digests and commits in prose, identifiers, paths and versions), and any table of
(before, token, after, label) can be used instead. All steps are DataFrame operations and Spark's own
forest.

Cases: a null or empty text has no candidate. Equal tokens at several places are found at each.
Rows that repeat an id are scanned each. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CANDIDATE = r"(?<![A-Za-z0-9_+/\-])(?=[A-Za-z_+/\-]*[0-9])[A-Za-z0-9_+/\-]{15,}"
HINTS = r"(?i)(key|token|secret|passw|pwd|auth|credential|bearer|api)"
PLAIN = r"(?i)(sha|md5|digest|commit|checksum|uuid|version|card|phone|order|isbn|http|www)"
FINDINGS = 6000
TREES, DEPTH = 40, 8
DICTIONARY = 200
FEATURES = ["f_length", "f_transitions", "f_digits", "f_distinct", "f_upper", "f_hex", "f_words", "f_path", "f_assigned", "f_hint", "f_plain", "f_prefix"]


def labelled_findings(spark, n: int = FINDINGS) -> DataFrame:
    """n labelled findings (before, token, after, label), the same ones each time."""
    rows = spark.range(n).select("id", F.sha2(F.concat(F.lit("finding"), F.col("id").cast("string")).cast("binary"), 256).alias("h"))
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    upper = F.translate(F.substring("h", 1, 20), "0123456789abcdef", alphabet[3:19])
    upper = F.concat(F.substring(upper, 1, 12), F.translate(F.substring("h", 40, 8), "0123456789abcdef", "23456789ABQRSTUV"))
    mixed = F.concat(F.translate(F.substring("h", 1, 20), "0123456789abcdef", "aZ3kQ9xW7mB2pL5v"), F.translate(F.substring("h", 30, 16), "0123456789abcdef", "R8tYc1NsD4gJ6hF0"))
    digits = F.translate(F.substring("h", 1, 18), "abcdef", "907152")
    word = F.element_at(F.array(*[F.lit(w) for w in ("value", "thing", "result", "order", "the", "with", "from", "an", "und", "les", "para", "data")]), F.pmod(F.col("id"), F.lit(12)).cast("int") + 1)
    kinds: list[tuple[Column, Column, Column, int]] = [
        (word, F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)), word, 1),
        (F.concat(word, F.lit(" token = \"")), F.substring("h", 1, 40), F.lit("\" the"), 1),
        (F.concat(word, F.lit(" password=")), F.substring("h", 1, 18), F.concat(F.lit(" "), word), 1),
        (F.lit("api_key: '"), mixed, F.lit("' and"), 1),
        (F.lit("secret = "), F.substring(mixed, 1, 24), F.concat(F.lit(" "), word), 1),
        (word, F.concat(F.lit("ghp_"), mixed), word, 1),
        (F.concat(word, F.lit(" ")), F.substring(digits, 1, 16), F.concat(F.lit(" "), word), 0),
        (F.lit("commit "), F.substring("h", 1, 40), F.concat(F.lit(" "), word), 0),
        (F.lit("sha256 digest "), F.col("h"), word, 0),
        (word, F.concat_ws("-", F.substring("h", 1, 8), F.substring("h", 9, 4), F.substring("h", 13, 4), F.substring("h", 17, 4), F.substring("h", 21, 12)), word, 0),
        (F.lit("https://example.com/"), F.concat(word, F.lit("/archive/"), F.substring(digits, 1, 6), F.lit("/page")), F.lit(" "), 0),
        (F.concat(word, F.lit(" ")), F.concat(F.lit("interesting_"), word, F.lit("_version_"), F.substring(digits, 1, 2)), F.lit(" "), 0),
        (F.lit("version "), F.concat(F.lit("release-candidate-"), F.substring(digits, 1, 4)), word, 0),
    ]
    kind = F.pmod(F.col("id"), F.lit(len(kinds))).cast("int") + 1
    made = F.element_at(F.array(*[F.struct(b.alias("before"), t.alias("token"), a.alias("after"), F.lit(y).alias("label")) for b, t, a, y in kinds]), kind)
    return rows.select(made.alias("m")).select("m.*")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, before, token, after, pos) of each candidate; pos counts the text's blank-separated parts."""
    hit = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("text").rlike(CANDIDATE))
    parts = hit.select("id", F.split("text", r"\s+").alias("parts"))

    def near(i: Column) -> Column:
        at = lambda k: F.get(F.col("parts"), i + k)
        return F.struct(i.alias("pos"), at(0).alias("part"), F.concat_ws(" ", at(-2), at(-1), F.lit("")).alias("left"), F.concat_ws(" ", F.lit(""), at(1)).alias("right"))

    held = F.filter(F.sequence(F.lit(0), F.size("parts") - 1), lambda i: F.get(F.col("parts"), i).rlike(CANDIDATE))
    placed = parts.select("id", F.explode(F.transform(held, near)).alias("p")).select("id", "p.*")
    cut = placed.withColumns({"tokens": F.regexp_extract_all("part", F.lit(CANDIDATE), F.lit(0)), "between": F.split("part", CANDIDATE, -1)})

    def joined(first: Column, last: Column) -> Column:
        """What lies between two places of a part, tokens and what is between them in turn."""
        return F.array_join(F.transform(F.filter(F.sequence(F.lit(0), F.size("tokens")), lambda i: (i >= first) & (i <= last)), lambda i: F.concat(F.get(F.col("between"), i), F.when(i < last, F.get(F.col("tokens"), i)).otherwise(F.lit("")))), "")

    found = cut.select("*", F.posexplode("tokens").alias("k", "token"))
    k, end = F.col("k"), F.size("tokens")
    return found.select("id", "pos", "token", F.concat("left", joined(F.lit(0), k)).alias("before"), F.concat(joined(k + 1, end), F.col("right")).alias("after"))


def dictionary(docs: DataFrame, text_col: str = "text", size: int = DICTIONARY) -> list[str]:
    """The most frequent words of at least four letters over all documents."""
    words = docs.select(F.explode(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}]+")).alias("w")).where(F.length("w") >= 4)
    return [r["w"] for r in words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(size).collect()]


def with_features(found: DataFrame, words: list[str]) -> DataFrame:
    """found (before, token, after) with the forest's features."""
    t = F.col("token")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0"), r"[_+/\-]+", "-")
    n = F.length(t).cast("double")
    covering = "(?i)(" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + ")" if words else r"(?!)"
    return found.withColumns({
        "f_length": n,
        "f_transitions": (F.length(kinds) - 1) / n,
        "f_digits": F.length(F.regexp_replace(t, "[^0-9]", "")) / n,
        "f_distinct": F.size(F.array_distinct(F.split(t, ""))) / F.least(n, F.lit(36.0)),
        "f_upper": F.length(F.regexp_replace(t, "[^A-Z]", "")) / n,
        "f_hex": F.when(t.rlike("^[0-9a-f]+$"), 1.0).otherwise(0.0),
        "f_words": 1 - F.length(F.regexp_replace(t, covering, "")) / n,
        "f_path": F.when(F.concat("before", t).rlike(r"(://|www\.|\.[a-z]{2,4}/|/[^ ]*/)"), 1.0).otherwise(0.0),
        "f_assigned": F.when(F.col("before").rlike("[=:] ?[\"']?$"), 1.0).otherwise(0.0),
        "f_hint": F.when(F.concat_ws(" ", "before", "after").rlike(HINTS), 1.0).otherwise(0.0),
        "f_plain": F.when(F.concat_ws(" ", "before", "after").rlike(PLAIN), 1.0).otherwise(0.0),
        "f_prefix": F.when(t.rlike("^(AKIA|ASIA|ghp_|gho_|sk_live|xox)"), 1.0).otherwise(0.0),
    })


def fit(findings: DataFrame, words: list[str], seed: int = 11):
    rows = with_features(findings, words).select(*FEATURES, F.col("label").cast("double").alias("label"))
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    return RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=seed).fit(assembled)


def scan(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, token, probability, is_secret) of each candidate of docs."""
    words = dictionary(docs, text_col)
    forest = fit(labelled_findings(docs.sparkSession) if findings is None else findings, words)
    rows = with_features(candidates(docs, id_col, text_col), words)
    scored = forest.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows))
    p = vector_to_array("probability")[1]
    return scored.select("id", "pos", "token", p.alias("probability"), (p >= 0.5).alias("is_secret"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs).where("is_secret")
    return found.select(F.col("id").alias("doc_id"), "pos", F.sha2(F.col("token").cast("binary"), 256).alias("token_sha256"), F.length("token").alias("token_length"), F.round("probability", 6).alias("probability"))
