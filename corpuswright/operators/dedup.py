"""Duplicate elimination and merging with explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuswright.functions.text import patent_key, title_key
from corpuswright.operators.graph import components
from corpuswright.session import materialise


def keep_first(df: DataFrame, key: Column, seq: str) -> DataFrame:
    """(key, n, first): of each key the number of rows and the row with the smallest ``seq``.

    An aggregation of the minimum, not a window: it combines before the shuffle, so a key that a third
    of all rows carry costs one row a partition. Null keys form one group.
    """
    cols = [c for c in df.columns if c != seq]
    return df.withColumn("key", key).groupBy("key").agg(F.count("*").alias("n"), F.min_by(F.struct(seq, *cols), F.col(seq)).alias("first"))


def distinct_texts_capped(items: DataFrame, group: str, text: str, seq: str, cap: int) -> DataFrame:
    """The first ``cap`` texts of each group, without case repeated, in order of ``seq``."""
    once = items.withColumn("_k", F.lower(F.trim(text))).where("_k <> ''").groupBy(group, "_k").agg(F.min_by(F.struct(seq, text), F.col(seq)).alias("r"))
    flat = once.select(group, F.col(f"r.{seq}").alias(seq), F.col(f"r.{text}").alias(text))
    from corpuswright.operators.ranking import top_n

    return top_n(flat, [group], [seq], cap)


# Names that stand for an unknown applicant.
PLACEHOLDERS = ("Unknown Assignee", "Patent Holder", "EPO Applicant")


def filled(name: str, seq: str = "seq", kind: str = "string") -> Column:
    """First non-empty value of a column (a string, or an array of them) by order; of an applicant the first that
    names somebody, else the first."""
    v, at = F.col(name), F.col(seq)
    usable = F.size(v) > 0 if kind.startswith("array") else v.isNotNull() & (F.trim(v) != "")
    first = F.min_by(F.when(usable, v), F.when(usable, at))
    if name == "applicant":
        real = usable & ~v.isin(*PLACEHOLDERS)
        first = F.coalesce(F.min_by(F.when(real, v), F.when(real, at)), first)
    return first.alias(name)


def united(single: str, several: str | None = None) -> Column:
    """Sorted set of the sources of all rows: the one in ``single`` and those listed in ``several``; nulls are no source."""
    own = F.flatten(F.collect_set(F.array_compact(F.array(single))))
    listed = F.flatten(F.collect_set(F.array_compact(F.coalesce(several, F.array().cast("array<string>"))))) if several else F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.concat(own, listed)))


def merged_fields(df: DataFrame, fields: list[str]) -> list[Column]:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return [filled(f, "seq", kinds[f]) for f in fields]


def merge_by_key(df: DataFrame, key: Column, seq: str, fields: list[str], source: str = "source", listed: str | None = None) -> DataFrame:
    """One row a key: first non-empty value of each field, united sources, number of rows."""
    rows = df.withColumn("key", key).withColumn("seq", F.col(seq)).where("key <> ''")
    return rows.groupBy("key").agg(F.min("seq").alias("first_seq"), F.count("*").alias("rows"), united(source, listed).alias("merged_sources"), *merged_fields(df, fields))


def merge_two_keys(df: DataFrame, seq: str, fields: list[str], source: str = "source", listed: str | None = None) -> DataFrame:
    """Merge by publication key, else by title, in order of ``seq``.

    A row joins the group of the first row with its publication key; failing that, that of the first
    row with its title. Rows that found a group by one key do not register the other, so groups
    are decided in order. What can interact at all is a connected component of the key graph;
    components are found first, and inside one the order is folded over (key, title) states that are already
    reduced to their first row, not over rows.
    """
    keyed = df.withColumn("pkey", patent_key(F.coalesce(F.nullif(F.trim("patent_id"), F.lit("")), F.col("publication_number")))).withColumn("tkey", title_key(F.col("title")))
    keyed = keyed.where("pkey <> '' or tkey <> ''").withColumn("seq", F.col(seq))
    states = keyed.groupBy("pkey", "tkey").agg(F.min("seq").alias("at"))
    a = F.when(F.col("pkey") != "", F.xxhash64(F.lit("p"), "pkey"))
    b = F.when(F.col("tkey") != "", F.xxhash64(F.lit("t"), "tkey"))
    states = materialise(states.withColumn("a", a).withColumn("b", b), "states")
    comp = components(states.where("a is not null and b is not null"), "a", "b")
    whole = states.withColumn("node", F.coalesce("a", "b")).join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))

    def fold(pdf):
        import pandas as pd

        owner, since, titles, out = {}, {}, {}, []
        for r in pdf.sort_values("at").itertuples():
            group = owner.get(r.pkey) if r.pkey else None
            if group is None and r.tkey:
                group = titles.get(r.tkey)
            if group is None:
                group = r.at
                if r.pkey:
                    owner[r.pkey], since[r.pkey] = group, r.at
                else:
                    owner[r.tkey] = group
                if r.tkey:
                    titles[r.tkey] = group
            out.append((r.pkey, r.tkey, group))
        # a later row with a key that a group owns by then goes to that group
        out = [(p, t, g, owner.get(p, g), since.get(p, 2**62)) for p, t, g in out]
        return pd.DataFrame(out, columns=["pkey", "tkey", "state_group", "owner_group", "owner_since"])

    groups = whole.groupBy("component").applyInPandas(fold, "pkey string, tkey string, state_group long, owner_group long, owner_since long")
    rows = keyed.join(groups, ["pkey", "tkey"])
    rows = rows.withColumn("group_seq", F.when((F.col("pkey") != "") & (F.col("seq") > F.col("owner_since")), F.col("owner_group")).otherwise(F.col("state_group")))
    return rows.groupBy("group_seq").agg(F.count("*").alias("rows"), united(source, listed).alias("merged_sources"), *merged_fields(df, fields))
