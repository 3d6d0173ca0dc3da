"""Word derivations: which vocabulary words a query word stands for, with how many typos.

One edit is an insertion, deletion, substitution or transposition of neighbours (optimal string
alignment); for a prefix, the distance is the least over the candidate's prefixes. With a budget of
one the first character must agree; with two, a wrong first character counts as two.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pharos.runtime import materialise


def distance(a: str, b: str, prefix: bool = False, most: int = 2) -> int:
    """Edits from ``a`` to ``b`` (or to the nearest prefix of ``b``); ``most + 1`` if there are more."""
    if not prefix and abs(len(a) - len(b)) > most:
        return most + 1
    if prefix:
        b = b[: len(a) + most]
    # rows are prefixes of b, columns prefixes of a
    before, last = None, list(range(len(a) + 1))
    best = last[-1]
    for j in range(1, len(b) + 1):
        row = [j]
        for i in range(1, len(a) + 1):
            x = min(last[i] + 1, row[i - 1] + 1, last[i - 1] + (a[i - 1] != b[j - 1]))
            if before is not None and i > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                x = min(x, before[i - 2] + 1)
            row.append(x)
        before, last = last, row
        best = min(best, row[-1])
    return min(best if prefix else last[-1], most + 1)


def typos(word: str, candidate: str, prefix: bool, budget: int) -> int | None:
    """Typos that ``candidate`` costs as a derivation of ``word``, None if it isn't one."""
    if candidate == word or prefix and candidate.startswith(word):
        return 0
    if not budget:
        return None
    d = distance(word, candidate, prefix, budget)
    if candidate[:1] == word[:1]:
        return d if d <= budget else None
    return 2 if budget == 2 and d <= 1 else None


#: Words that differ from a query's by typos and are looked for by name; more of them are joined.
NAMED = 4096


def plain(word: str, prefix: bool) -> Column:
    """Is the column ``word`` what a leaf says, without a typo?"""
    return F.col("word").startswith(word) if prefix else F.col("word") == word


def misspelt(vocabulary: DataFrame, leaves: list[tuple[int, str, bool, int]]) -> DataFrame | None:
    """(leaf, word, typo) of the vocabulary words that leaves (number, word, prefix, budget) stand for with a
    typo at least, None if no leaf may have any: one pass over the vocabulary.

    Words first pass a filter on length and on Spark's own edit distance (a transposition is two of its
    edits), so that Python sees few; what it sees is named by the leaf, so that the optimiser can't move it
    to another table.
    """
    near = []
    for number, word, prefix, budget in leaves:
        if not budget:
            continue
        w = F.col("word")
        if prefix:
            head = F.levenshtein(F.expr(f"left(word, {len(word)})"), F.lit(word), 3 * budget)
            ok = (F.length("word") >= len(word) - budget) & (head >= 0) & (head <= 3 * budget)
        else:
            ok = F.length("word").between(len(word) - budget, len(word) + budget) & (F.levenshtein(w, F.lit(word), 2 * budget) >= 0)
        if budget == 1:  # the first character must agree
            ok = F.col("word").startswith(word[:1]) & ok
        near.append((ok & ~plain(word, prefix), number))
    if not near:
        return None
    by = {number: (word, prefix, budget) for number, word, prefix, budget in leaves}

    @F.pandas_udf("int")
    def cost(leaf: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([typos(by[n][0], c, *by[n][1:]) for n, c in zip(leaf, s, strict=True)], dtype="Int32")

    # as a plain condition on the word, the filter goes below the vocabulary's aggregation and reaches the tokens
    some = vocabulary.where(reduce(lambda a, b: a | b, [ok for ok, _ in near]))
    some = some.select("word", F.explode(F.filter(F.array(*[F.when(ok, F.lit(n)) for ok, n in near]), lambda x: x.isNotNull())).alias("leaf"))
    return some.select("leaf", "word", cost("leaf", "word").alias("typo")).where("typo is not null")


def found(tokens: DataFrame, vocabulary: DataFrame, leaves: list[tuple[int, str, bool, int]]) -> DataFrame:
    """The rows of ``tokens`` whose word a leaf stands for, with ``leaf`` and ``typo``, one row a leaf.

    Misspelt words are looked up in the vocabulary first. As names and prefixes they reach the scan of the
    tokens, which nothing is joined with; only where there are more than ``NAMED`` they are joined.
    """
    wrong = misspelt(vocabulary, leaves)
    rows = wrong.limit(NAMED + 1).collect() if wrong is not None else []
    many = len(rows) > NAMED
    cost = {}
    for r in [] if many else rows:
        cost.setdefault((r["leaf"], r["typo"]), []).append(r["word"])
    wanted, each = None, []
    for number, word, prefix, _ in leaves:
        ok, typo = plain(word, prefix), F.when(plain(word, prefix), 0)
        for n in (1, 2):
            if words := cost.get((number, n)):
                named = F.col("word").isin(sorted(words))
                ok, typo = ok | named, typo.when(named, n)
        wanted = ok if wanted is None else wanted | ok
        each.append(F.when(ok, F.struct(F.lit(number).alias("leaf"), typo.alias("typo"))))
    out = tokens.where(wanted).withColumn("_d", F.explode(F.filter(F.array(*each), lambda x: x.isNotNull()))).select(*tokens.columns, "_d.leaf", "_d.typo")
    return out.unionByName(tokens.join(materialise(wrong), "word").select(out.columns)) if many else out
