"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

A text is a sequence of lower-cased words (runs of letters and digits). A seed is a fixed mask over
a span of words; the words at its marked places are hashed, the ignored ones may differ. The hashes
of all test passages are joined with those at every place of the training documents. A hit names a
document, a passage and a diagonal; around it the aligned words are compared, and the best segment
on that diagonal is found, where an equal word counts +1 and a substituted one -4, so a segment
stays above zero only at a similarity of 0.8 or more. A document is contaminated where such a
segment scores ``least`` or more.

The passages' hashes are broadcast only if there are at most ``BROADCAST_HASHES`` of them; beyond
that, hits come from a shuffled join. Only narrow rows are exploded; the words of documents with hits
are joined to them afterwards.

Cases: a null or empty text on either side has no words. Passages or documents shorter than a seed's
span are compared by the seeds that fit. Where there are passages shorter than every seed, runs of
``least`` equal words are seeds too (such a passage reaches ``least`` by no other way); passages of fewer
words than ``least`` can't match. Passages with
equal texts are reported each. Rows that repeat an id are reported together. Empty tables give an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelake.llm.common import fresh, materialize, small_side, with_row_uid

SEEDS = ("11101101011", "110110010111", "1101000110011011")
LEAST = 8
BROADCAST_HASHES = 1_000_000


def word_hashes(text: Column) -> Column:
    """The 64-bit hashes of a text's words."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def places(rows: DataFrame, seeds: tuple[str, ...], *keep: str) -> DataFrame:
    """A row for each place and seed of rows with an array ``words``: keep, pos and h.

    A text's hashes are one array, seed after seed, so that exploded rows carry no words with them.
    """

    def hashes(k: int, mask: str) -> Column:
        marked = [x for x, c in enumerate(mask) if c == "1"]
        at = F.sequence(F.lit(0), F.size("words") - len(mask))
        made = F.transform(at, lambda i: F.xxhash64(F.lit(k), *[F.get(F.col("words"), i + x) for x in marked]))
        return F.when(F.size("words") >= len(mask), made).otherwise(F.array().cast("array<bigint>"))

    found = rows.select(*keep, F.size("words").alias("n"), F.concat(*[hashes(k, m) for k, m in enumerate(seeds)]).alias("hs"))
    # outer, because for a plain one the optimizer adds a filter on the array that computes it again for every element
    found = found.select(*keep, "n", F.posexplode_outer("hs").alias("p", "h")).where("h is not null")
    pos, before = F.lit(None).cast("int"), F.lit(0)
    counts = [F.greatest(F.col("n") - len(m) + 1, F.lit(0)) for m in seeds]
    for n in counts:
        pos = F.coalesce(pos, F.when(F.col("p") < before + n, F.col("p") - before))
        before = before + n
    return found.select(*keep, pos.alias("pos"), "h")


def segment(words: Column, item: Column, diagonal: Column) -> Column:
    """The best segment of item on a diagonal: struct of score, first and last word (in item)."""
    low, high = F.greatest(F.lit(0), -diagonal), F.least(F.size(item), F.size(words) - diagonal) - 1
    none = F.struct(F.lit(0).alias("run"), F.lit(0).alias("since"), F.lit(0).alias("score"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

    def step(acc: Column, i: Column) -> Column:
        gain = F.when(F.get(words, diagonal + i) == F.get(item, i), F.lit(1)).otherwise(F.lit(-4))
        since = F.when(acc["run"] > 0, acc["since"]).otherwise(i)
        run = F.greatest(acc["run"], F.lit(0)) + gain
        return F.struct(
            run.alias("run"), since.alias("since"), F.greatest(acc["score"], run).alias("score"),
            F.when(run > acc["score"], since).otherwise(acc["first"]).alias("first"), F.when(run > acc["score"], i).otherwise(acc["last"]).alias("last"),
        )

    return F.when(high >= low, F.aggregate(F.sequence(low, high), none, step))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
                 uid_col: str | None = None, seeds: tuple[str, ...] = SEEDS, least: int = LEAST, broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """(id, item_id, score, item_first, item_last, doc_first): the best segment of each pair that reaches least."""
    if uid_col is None:
        uid_col = fresh(docs, "__uid")
        docs = with_row_uid(docs, uid_col)
    doc = docs.select(F.col(id_col).cast("long").alias("id"), F.col(uid_col).alias("uid"), word_hashes(F.col(text_col)).alias("words"))
    test = items.select(F.col(item_id).cast("long").alias("item_id"), word_hashes(F.col(item_text)).alias("words")).where(F.size("words") > 0)
    short = min(map(len, seeds))
    if least < short and not test.where((F.size("words") >= least) & (F.size("words") < short)).isEmpty():
        seeds = (*seeds, "1" * least)
    index = places(test, seeds, "item_id").select("h", "item_id", F.col("pos").alias("item_pos"))
    small = index.limit(broadcast_hashes + 1).count() <= broadcast_hashes
    narrow = places(doc, seeds, "id", "uid").join(F.broadcast(index) if small else index, "h")
    narrow = materialize(narrow.select("id", "uid", "item_id", (F.col("pos") - F.col("item_pos")).alias("diagonal")).distinct(), "hits")
    narrow = small_side(narrow)
    own = doc.withColumnRenamed("uid", "u").withColumnRenamed("id", "i")
    hits = own.join(narrow, (F.col("uid") == F.col("u")) & F.col("id").eqNullSafe(F.col("i"))).join(test.select("item_id", F.col("words").alias("item")), "item_id")
    scored = hits.select("id", "uid", "item_id", "diagonal", segment(F.col("words"), F.col("item"), F.col("diagonal")).alias("s")).where(F.col("s.score") >= least)
    best = F.max(F.struct(F.col("s.score").alias("score"), F.col("s.first").alias("first"), F.col("s.last").alias("last"), F.col("diagonal").alias("diagonal"))).alias("b")
    return scored.groupBy("id", "uid", "item_id").agg(best).select("id", "uid", "item_id", F.col("b.score").alias("score"), F.col("b.first").alias("item_first"), F.col("b.last").alias("item_last"), (F.col("b.first") + F.col("b.diagonal")).alias("doc_first"))


def clean_rows(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs without a contaminated segment, all their columns."""
    uid = fresh(docs, "__uid")
    marked = with_row_uid(docs, uid)
    row, own = fresh(marked, "__row"), fresh(marked, "__id")
    bad = contaminated(marked, items, id_col, text_col, uid_col=uid, **options).select(F.col("uid").alias(row), F.col("id").alias(own)).distinct()
    bad = small_side(materialize(bad, "bad"))
    return marked.join(bad, (F.col(uid) == F.col(row)) & F.col(id_col).cast("long").eqNullSafe(F.col(own)), "left_anti").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contaminated(docs, items)
    return found.select(F.col("id").alias("doc_id"), "item_id", "score", "item_first", "item_last", "doc_first")
