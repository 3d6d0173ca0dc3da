"""Ranking rules as integer bucket columns.

The evidence table has one row for each place in a document where a unit (query word or phrase)
occurs: ``doc_id, unit, fid, pos, last, typo``. One pass over it, partitioned by document, yields all
that the rules need; each rule is then an expression over the columns of one row a document, and the
ranking is one lexicographic top-k.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pharos.plans.derive import found
from pharos.plans.query import Phrase, Query

FAR = 7
ATTRIBUTE_SCALE = 2520
FIELD = 65_536


def evidence(tokens: DataFrame, vocabulary: DataFrame, units: list) -> DataFrame:
    """Occurrences of every unit, in the fields and documents of ``tokens``. Exact attributes count for words without typos only."""
    words = [(i, u.word, u.prefix, u.typos) for i, u in enumerate(units) if isinstance(u, Query)]
    out = None
    if words:
        out = found(tokens, vocabulary, words).where("typo = 0 or not exact").select("doc_id", F.col("leaf").alias("unit"), "fid", "pos", F.col("pos").alias("last"), "typo")
    for i, u in enumerate(units):
        if isinstance(u, Phrase):
            p = phrase_places(tokens, u.words).withColumn("unit", F.lit(i)).withColumn("typo", F.lit(0)).select("doc_id", "unit", "fid", "pos", "last", "typo")
            out = p if out is None else out.unionByName(p)
    return out


def phrase_places(tokens: DataFrame, words: tuple[str | None, ...]) -> DataFrame:
    """(doc_id, fid, pos, last) where the words stand in a row; a None may be anything.

    Every word of the phrase proposes the place at which the phrase would begin; a place that all
    propose is a match.
    """
    wanted = [(i, w) for i, w in enumerate(words) if w is not None]
    slots = F.array(*[F.when(F.col("word") == w, F.lit(i)) for i, w in wanted])
    proposed = (
        tokens.where(F.col("word").isin(sorted({w for _, w in wanted})))
        .select("doc_id", "fid", "pos", F.explode(F.filter(slots, lambda x: x.isNotNull())).alias("slot"))
        .groupBy("doc_id", "fid", (F.col("pos") - F.col("slot")).alias("begin"))
        .agg(F.count("*").alias("n"))
    )
    first, final = wanted[0][0], wanted[-1][0]
    return proposed.where(F.col("n") == len(wanted)).select("doc_id", "fid", (F.col("begin") + first).alias("pos"), (F.col("begin") + final).alias("last"))


def per_document(ev: DataFrame, units: list, pairs: set[tuple[int, int]]) -> DataFrame:
    """One row a document: t{i} least typos, p{i} first absolute place, d{i}_{j} least distance - 1."""
    by = Window.partitionBy("doc_id", "fid").orderBy("pos").rangeBetween(Window.unboundedPreceding, -1)
    cols = []
    for i, j in sorted(pairs):
        left = F.last(F.when(F.col("unit") == i, F.col("last")), ignorenulls=True).over(by)
        right = F.last(F.when(F.col("unit") == j, F.col("last")), ignorenulls=True).over(by)
        forward = F.when(F.col("unit") == j, F.col("pos") - left)
        backward = F.when(F.col("unit") == i, F.col("pos") - right + 1)
        cols.append(F.least(forward, backward).alias(f"x{i}_{j}"))
    keep = ev.select("*", *cols) if cols else ev
    aggs = []
    for i in range(len(units)):
        mine = F.col("unit") == i
        aggs += [F.min(F.when(mine, F.col("typo"))).alias(f"t{i}"), F.min(F.when(mine, F.col("fid").cast("long") * FIELD + F.col("pos"))).alias(f"p{i}")]
    aggs += [F.min(f"x{i}_{j}").alias(f"x{i}_{j}") for i, j in sorted(pairs)]
    out = keep.groupBy("doc_id").agg(*aggs)
    for i, j in sorted(pairs):
        out = out.withColumn(f"d{i}_{j}", F.least(F.lit(FAR), F.greatest(F.lit(0), F.coalesce(F.col(f"x{i}_{j}"), F.lit(FAR + 1)) - 1))).drop(f"x{i}_{j}")
    return out


def matched(seq: tuple[int, ...]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"t{i}").isNotNull() for i in seq])


def _least(cols: list[Column]) -> Column:
    return cols[0] if len(cols) == 1 else F.least(*cols)


def words_bucket(branches: list[tuple[int, tuple[int, ...]]]) -> Column:
    """Dropped words of the first form that the document matches; null if it matches none."""
    return _least([F.when(matched(s), F.lit(k)) for k, s in branches])


def over_branches(branches, value, words_rule: bool) -> Column:
    """Least value over the matched sequences, of the document's own form if ``words_rule``."""
    return _least([F.when((F.col("words") == k) & matched(s) if words_rule else matched(s), value(s)) for k, s in branches])


def typo_value(seq: tuple[int, ...]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(f"t{i}") for i in seq])


def proximity_value(seq: tuple[int, ...]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(f"d{i}_{j}") for i, j in zip(seq, seq[1:], strict=False)], F.lit(0))


def attribute_value(seq: tuple[int, ...]) -> Column:
    """Sum over the sorted first places of place - rank, scaled, divided by the number of units."""
    places = F.array_sort(F.array(*[F.col(f"p{i}") for i in seq]))
    total = reduce(lambda a, b: a + b, [F.greatest(F.lit(0), F.element_at(places, n + 1) - n) for n in range(len(seq))])
    return F.floor(total * ATTRIBUTE_SCALE / len(seq)).cast("long")


def exactness(tokens: DataFrame, lengths: DataFrame, parts: list) -> DataFrame:
    """(doc_id, full, starts, contained): is an attribute equal to the query, does one start with it, and
    how many parts of the query occur as written."""
    slots, offset = [], 0
    for n, p in enumerate(parts):
        words = p.words if hasattr(p, "words") else (p.text,)
        for w in words:
            if w is not None:
                slots.append((offset, w, n))
            offset += 1
    hits = F.array(*[F.when(F.col("word") == w, F.struct(F.lit(o).alias("o"), F.lit(n).alias("part"))) for o, w, n in slots])
    found = tokens.where(F.col("word").isin(sorted({w for _, w, _ in slots}))).select("doc_id", "fid", "pos", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("h"))
    per_field = found.groupBy("doc_id", "fid").agg(F.count_if(F.col("pos") == F.col("h.o")).alias("placed"), F.collect_set("h.part").alias("parts"))
    starts = F.col("placed") == len(slots)
    return (
        per_field.join(lengths, ["doc_id", "fid"])
        .groupBy("doc_id")
        .agg(F.bool_or(starts & (F.col("n") == offset)).alias("full"), F.bool_or(starts).alias("starts"), F.size(F.array_distinct(F.flatten(F.collect_list("parts")))).alias("contained"))
    )


def exactness_bucket(n_parts: int) -> Column:
    """0 equal, 1 starts with, then 2 + the parts that are missing."""
    rest = F.lit(2 + n_parts) - F.coalesce(F.col("contained"), F.lit(0))
    return F.when(F.col("full"), 0).when(F.col("starts"), 1).otherwise(rest).cast("int")


def sort_columns(column: Column, numeric: bool | None, ascending: bool, array: bool = False) -> list[Column]:
    """Order of one field: numbers, then strings, then documents without a value, in both directions;
    of several values the least counts ascending, the greatest descending."""
    value = (F.array_min(column) if ascending else F.array_max(column)) if array else column
    value = value if numeric else F.lower(F.trim(value.cast("string")))
    return [value.isNull().cast("int").asc(), value.asc() if ascending else value.desc()]
