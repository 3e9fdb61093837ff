"""Full-text search of contents: an inverted index, BM25, snippets, scopes, and the index's size limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: Characters of a text that are indexed, and bytes of a file that is read at all.
INDEXED_CHARS, MOST_FILE_BYTES = 2 << 20, 50 << 20
#: Folders that no scope includes.
EXCLUDED = ("AppData", "node_modules", ".git", "target", "build", "dist", "venv", ".venv", "__pycache__")
#: An index keeps its postings in so many folders by term, of which a search reads those of its terms.
BUCKETS = 64


def _words(text: Column) -> Column:
    return F.filter(F.split(F.left(F.coalesce(text, F.lit("")), F.lit(INDEXED_CHARS)), r"[ \t\n\r]+"), lambda w: w != "")


def readable(docs: DataFrame, size: str = "size") -> DataFrame:
    """Files that are read at all: those of at most MOST_FILE_BYTES."""
    return docs.where(F.col(size) <= MOST_FILE_BYTES)


def postings(docs: DataFrame) -> DataFrame:
    """doc_id, term, tf, size: words between white space, as they stand."""
    split = docs.select("doc_id", _words(F.col("text")).alias("words")).select("doc_id", F.size("words").alias("size"), F.explode("words").alias("term"))
    return split.groupBy("doc_id", "size", "term").agg(F.count("*").alias("tf"))


def build_index(docs: DataFrame, to: str) -> None:
    """Postings in folders by term, and the number and mean length of documents."""
    rows = postings(docs).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
    rows.repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(16))).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{to}/postings")
    docs.agg(F.count("*").alias("n_docs"), F.avg(F.size(_words(F.col("text")))).alias("mean_size")).write.parquet(f"{to}/statistics")


def _scores(hits: DataFrame, stats: DataFrame) -> DataFrame:
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    joined = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))  # a row a term, and one row
    idf = F.ln(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean_size")))
    return joined.groupBy("doc_id").agg(F.sum(part).alias("score"))


def search_index(spark: SparkSession, at: str, terms: list[str]) -> DataFrame:
    """doc_id and score of documents with any of the terms, from the postings of those terms alone."""
    wanted = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(F.pmod(F.xxhash64("t"), F.lit(BUCKETS))).distinct().collect()]  # at most the terms
    hits = spark.read.parquet(f"{at}/postings").where(F.col("bucket").isin(wanted) & F.col("term").isin(terms)).drop("bucket")
    return _scores(hits, spark.read.parquet(f"{at}/statistics"))


def parse_content(text: str) -> tuple[str, list[str]]:
    """Words of a name query, and the words that content: asks for."""
    words, asked = [], []
    for token in text.split():
        key, colon, value = token.partition(":")
        if colon and key.lower() == "content":
            asked += [value] if value else []
        else:
            words.append(token)
    return " ".join(words), asked


def bm25(docs: DataFrame, terms: list[str]) -> DataFrame:
    """The same without an index, in one pass over the texts: only postings of the asked terms are grouped."""
    sized = docs.select("doc_id", F.size(_words(F.col("text"))).alias("size"), _words(F.col("text")).alias("words"))
    stats = sized.agg(F.count("*").alias("n_docs"), F.avg("size").alias("mean_size"))
    hits = sized.select("doc_id", "size", F.explode(F.filter("words", lambda w: w.isin(*terms))).alias("term")).groupBy("doc_id", "size", "term").agg(F.count("*").alias("tf"))
    return _scores(hits, stats)


def snippet(text: Column, term: str, before: int = 30, length: int = 90) -> Column:
    """Characters around the term's first place; null without it."""
    at = F.instr(text, term)
    return F.when(at > 0, F.substr(text, F.greatest(at - before, F.lit(1)), F.lit(length)))


def in_scope(path: Column, excluded: tuple[str, ...] = EXCLUDED) -> Column:
    """Paths with no excluded folder among their parts, letters' case aside."""
    return ~F.arrays_overlap(F.split(F.lower(path), r"[/\\]"), F.array(*(F.lit(x.lower()) for x in excluded)))


#: Ages to a block when sizes are summed over all of them.
BLOCK_AGES = 4096


def within_size(rows: DataFrame, cap: int, size: str, age: str, tie: str) -> DataFrame:
    """The newest rows (greatest age column, a number) that fit into cap together; older ones go.

    Sizes are summed by age, within blocks of ages and over the blocks' sums;
    ties within one age by a window of that age.
    """
    by_age = rows.groupBy(age).agg(F.sum(size).alias("_sum")).withColumn("_block", F.floor(F.col(age) / BLOCK_AGES))
    sums = by_age.groupBy("_block").agg(F.sum("_sum").alias("_all"))  # a row a block
    newer = sums.select("_block", (F.sum("_all").over(Window.orderBy(F.desc("_block"))) - F.col("_all")).alias("_newer"))
    inside = F.sum("_sum").over(Window.partitionBy("_block").orderBy(F.desc(age))) - F.col("_sum")
    before = by_age.withColumn("_inside", inside).join(newer, "_block").select(age, (F.col("_newer") + F.col("_inside")).alias("_before"))
    within = F.sum(size).over(Window.partitionBy(age).orderBy(tie).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.join(before, age).withColumn("running", F.col("_before") + within).where(F.col("running") <= cap).drop("_before")


def batches(rows: DataFrame, size: int, *order) -> DataFrame:
    """seq: pages of size rows in order, told apart within one result page."""
    return rows.withColumn("seq", F.floor((F.row_number().over(Window.orderBy(*order)) - 1) / size).cast("int"))


def owned(found: DataFrame, docs: DataFrame, sid: str) -> DataFrame:
    """Documents found that belong to the user: contents are served to the owner of their scope alone."""
    return found.join(docs.where(F.col("sid") == sid).select("doc_id"), "doc_id", "left_semi")
