"""Set similarity join inside groups, exact and without pairing everybody with everybody."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuswright.functions.text import word_set
from corpuswright.session import materialise


def similar_classes(items: DataFrame, group: str, item: str, text: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(members, links): (group, class, item), and (group, a, b, jaccard) between classes, a < b.

    A class holds the items of a group with equal word sets, so copies meet once. Words are ordered
    from rare to frequent over the whole table; two sets can only reach the threshold if they share a word
    among their first n - ceil(threshold * n) + 1, so only those words are join keys (prefix filter):
    frequent words and with them hot join keys stay out. Items without words form no class.
    """
    base = items.select(group, item, F.array_sort(word_set(F.col(text))).alias("words")).where(F.col(item).isNotNull() & (F.size("words") > 0))
    base = base.withColumn("group_key", F.coalesce(F.col(group).cast("string"), F.lit("")))
    classes = base.groupBy("group_key", "words").agg(F.min(item).alias("class"))
    members = base.join(classes, ["group_key", "words"]).select("group_key", "class", item)
    classes = materialise(classes, "classes")
    flat = classes.select("group_key", "class", F.size("words").alias("n"), F.explode("words").alias("word"))
    df = flat.groupBy("word").agg(F.count("*").alias("df"))
    ordered = flat.join(df, "word").groupBy("group_key", "class", "n").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("ws"))
    take = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - F.lit(1e-9)).cast("int") + 1
    prefix = ordered.select("group_key", "class", "n", F.explode(F.slice("ws", F.lit(1), take)).alias("w")).select("group_key", "class", "n", F.col("w.word").alias("word"))
    a, b = (prefix.select("group_key", "word", F.col("class").alias(k), F.col("n").alias(f"n_{k}")) for k in "ab")
    fit = (F.col("n_a") >= threshold * F.col("n_b") - 1e-9) & (F.col("n_b") >= threshold * F.col("n_a") - 1e-9)
    met = a.join(b, ["group_key", "word"]).where((F.col("a") < F.col("b")) & fit).select("group_key", "a", "b").distinct()
    wa, wb = (classes.select("group_key", F.col("class").alias(k), F.col("words").alias(f"w_{k}")) for k in "ab")
    both = F.size(F.array_intersect("w_a", "w_b"))
    scored = met.join(wa, ["group_key", "a"]).join(wb, ["group_key", "b"]).withColumn("both", both).withColumn("jaccard", F.col("both") / (F.size("w_a") + F.size("w_b") - F.col("both")))
    return members, scored.where(F.col("jaccard") >= threshold).select("group_key", "a", "b", "jaccard")
