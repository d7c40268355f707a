"""Two sources reconciled: fallbacks, set comparisons, corpus counts of terms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.columns import computed_once
from linkloom.functions.text import last_segment, substring_count


def with_fallback(rows: DataFrame, key: str, first: DataFrame, second: DataFrame, columns: Sequence[str], flag: str = "exists_online") -> DataFrame:
    """rows with columns from the first source, or from the second where the first lacks the key, and whether the first has it.

    Of several rows of a key in a source the first in the order of the columns is used. A key in neither has nulls.
    """
    one = first.groupBy(key).agg(F.min(F.struct(*columns)).alias("_one"))
    two = second.groupBy(key).agg(F.min(F.struct(*columns)).alias("_two"))
    joined = rows.join(one, key, "left").join(two, key, "left")
    rest = [c for c in rows.columns if c not in columns]
    has = F.col("_one").isNotNull()
    return joined.select(*rest, *[F.when(has, F.col("_one")[c]).otherwise(F.col("_two")[c]).alias(c) for c in columns], has.alias(flag))


def id_from_link(link, separator: str = "="):
    """The number that ends an address."""
    return last_segment(link, separator).try_cast("long")


def set_comparison(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """One row: equal, n_a, n_b, only_a, only_b, n_union, n_symmetric of the distinct non-null values of a column."""
    left = a.select(F.col(column).alias("v")).where("v is not null").distinct().withColumn("in_a", F.lit(True))
    right = b.select(F.col(column).alias("v")).where("v is not null").distinct().withColumn("in_b", F.lit(True))
    both = left.join(right, "v", "full")
    has_a, has_b = F.col("in_a").isNotNull(), F.col("in_b").isNotNull()
    return both.agg(
        (F.count_if(~(has_a & has_b)) == 0).alias("equal"),
        F.count_if(has_a).alias("n_a"),
        F.count_if(has_b).alias("n_b"),
        F.count_if(has_a & ~has_b).alias("only_a"),
        F.count_if(has_b & ~has_a).alias("only_b"),
        F.count(F.lit(1)).alias("n_union"),
        F.count_if(has_a != has_b).alias("n_symmetric"),
    )


def _words(text: Column) -> Column:
    """The distinct words of a text: runs of letters, marks and digits."""
    return F.array_distinct(F.filter(F.split(text, r"[^\p{L}\p{M}\p{N}]+"), lambda w: F.length(w) > 0))


def _by_rarest_word(words: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (with a list of words) with word, the one of its words that the fewest texts have; words has a row per text and word."""
    asked = wanted.withColumn("word", F.explode("words"))
    often = words.join(asked.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("_often"))
    counted = asked.join(often, "word", "left").withColumn("_o", F.struct(F.coalesce("_often", F.lit(0)).alias("n"), "word"))
    columns = [c for c in wanted.columns if c != "words"]
    return counted.groupBy(*columns).agg(F.min("_o")["word"].alias("word"))


def discovery_ratio(texts: DataFrame, text: str, terms: DataFrame) -> DataFrame:
    """(term, positive_count, total_count, discovery_ratio): how often terms occur in all texts, and the known share.

    terms has term and positive_count. A term counts in texts that have its words; terms meet texts at their rarest
    word, not each with each. Equal texts are one with their number; only what a text meets is counted in it, so that no
    text is copied before. Words are split at white space and punctuation. The ratio is null if a term doesn't occur.
    """
    distinct = texts.select(F.col(text).alias("text")).where("text is not null").groupBy("text").agg(F.count(F.lit(1)).alias("many"))
    keyed = distinct.withColumn("id", F.sha2("text", 256))
    words = keyed.select("id", F.explode(_words(F.col("text"))).alias("word"))
    wanted = terms.select("term").where("term is not null").distinct().select("term", _words(F.col("term")).alias("words")).where(F.size("words") > 0)
    met = words.join(_by_rarest_word(words, wanted), "word").select("id", "term")
    # the text is fetched once for all terms that it meets, in 64 lists
    part = F.pmod(F.xxhash64("term"), F.lit(64)).alias("part")
    lists = met.join(wanted, "term").groupBy("id", part).agg(F.collect_list(F.struct("term", "words")).alias("met"))
    found = computed_once(keyed.select("id", "text", "many").join(lists, "id"), "has", _words(F.col("text")))
    whole = F.filter("met", lambda t: F.size(F.array_except(t["words"], F.col("has"))) == 0)
    counts = F.transform(whole, lambda t: F.struct(t["term"].alias("term"), (substring_count(F.col("text"), t["term"]) * F.col("many")).alias("n")))
    counted = found.select(F.explode(counts).alias("c")).groupBy(F.col("c.term").alias("term")).agg(F.sum("c.n").alias("total_count"))
    joined = terms.select("term", "positive_count").join(counted, "term", "left").fillna({"total_count": 0})
    return joined.select("term", "positive_count", "total_count", F.try_divide("positive_count", "total_count").alias("discovery_ratio"))


def valid_terms(discovered: DataFrame, min_count: int = 10, min_ratio: float = 0.1) -> DataFrame:
    """Terms with more than min_count positive occurrences and more than min_ratio of all."""
    return discovered.where((F.col("positive_count") > min_count) & (F.col("discovery_ratio") > min_ratio))


def gazetteer_mentions(articles: DataFrame, key: str, text: str, names: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(organization, article): distinct names of a one-column list that occur in each text as whole words.

    Names meet texts at their rarest word, then are checked as a whole; only (article, word) and the names met travel, and
    each text is fetched once for them. terms (organization, term) makes names canonical; they are distinct again
    after that. Null texts and names, and names without a letter or digit, occur nowhere.
    """
    plain = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}\p{N}]+", " ")), F.lit(" "))
    wanted = names.toDF("organization").where("organization is not null").distinct()
    wanted = wanted.select("organization", plain("organization").alias("padded")).withColumn("words", _words(F.col("padded"))).where(F.size("words") > 0)
    read = articles.select(F.col(key).alias("article"), plain(text).alias("body")).where("body is not null")
    words = read.select("article", F.explode(_words(F.col("body"))).alias("word"))
    met = words.join(_by_rarest_word(words, wanted), "word")
    part = F.pmod(F.xxhash64("organization"), F.lit(64)).alias("part")
    lists = met.groupBy("article", part).agg(F.collect_set(F.struct("organization", "padded")).alias("met"))
    inside = lambda m: F.col("body").contains(m["padded"])
    found = read.join(lists, "article").select("article", F.explode(F.filter("met", inside)).alias("m")).select(F.col("m.organization").alias("organization"), "article").distinct()
    if terms is None:
        return found
    to = terms.select("organization", "term")
    return found.join(to, "organization", "left").select(F.coalesce("term", "organization").alias("organization"), "article").distinct()


def category_counts(rows: DataFrame, categories: str) -> DataFrame:
    """(category, n) over a column of lists."""
    return rows.select(F.explode(categories).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
