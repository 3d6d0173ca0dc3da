"""Derived tables of an index, each a lazy frame over the documents.

lines(doc_id, fid, text, exact)         texts of fields
tokens(doc_id, fid, pos, word, exact)   every occurrence; the fact table
postings(word, doc_id, loose, exact)    word to document, in typo-tolerant and in exact attributes
vocabulary(word, df)                    distinct words and their document counts
word_pairs(w1, w2, prox, doc_id)        least forward distance 1..7 of ordered pairs in an attribute
field_len(doc_id, fid, n)               words of a field: last position + 1, gaps included
facets(doc_id, field, num, norm, orig)  facet values, one row a value
present(doc_id, field)                  fields that a document has
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pharos.functions import tokenizer as Z
from pharos.functions.times import epoch, is_time
from pharos.operators.by_document import distinct, whole

#: Files that hold the occurrences of one word.
SPREAD = 4


def text_of(column: Column, kind: T.DataType) -> Column:
    """Searchable text of any value: arrays joined by ``. `` (a hard separator), structs as ``key: value. ``."""
    if isinstance(kind, T.ArrayType):
        return F.concat(F.array_join(F.transform(column, lambda x: text_of(x, kind.elementType)), ". "), F.lit(". "))
    if isinstance(kind, T.StructType):
        parts = [F.coalesce(F.concat(F.lit(f"{f.name}: "), text_of(column[f.name], f.dataType), F.lit(". ")), F.lit("")) for f in kind.fields]
        return F.when(column.isNotNull(), F.concat(*parts))
    return column.cast("string")


def field_text(df: DataFrame, name: str) -> Column:
    """Text of a field by its literal name or its dotted path; of what a path finds inside an array, all
    values. A field that doesn't exist has none."""
    if name in df.columns:
        return text_of(F.col(f"`{name}`"), df.schema[name].dataType)
    head, *rest = name.split(".")
    if head not in df.columns:
        return F.lit("")
    column, kind = F.col(f"`{head}`"), df.schema[head].dataType
    for part in rest:
        depth, inner = 0, kind
        while isinstance(inner, T.ArrayType):
            depth, inner = depth + 1, inner.elementType
        if not isinstance(inner, T.StructType) or part not in inner.names:
            return F.lit("")
        column, kind = column[part] if not depth else _inside(column, part, depth), inner[part].dataType
        for _ in range(depth):
            kind = T.ArrayType(kind)
    return text_of(column, kind)


def _inside(column: Column, part: str, depth: int) -> Column:
    return F.transform(column, lambda x: x[part] if depth == 1 else _inside(x, part, depth - 1))


def is_faceted(field: str, names: set[str]) -> bool:
    """Is the field named, or nested in a named one?"""
    return any(field == n or field.startswith(n + ".") for n in names)


def stored(tokens: DataFrame) -> DataFrame:
    """``tokens`` as they are best stored for searches: rows of a word together and in order, so that a scan
    for words skips the rest, with frequent words in several files. No pass goes before the shuffle."""
    return tokens.repartition("word", F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD))).sortWithinPartitions("word", "doc_id", "fid", "pos")


def lines(df: DataFrame, fields: list[str], key: str = "doc_id", exact: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fid, text, exact): the texts of ``fields`` (in order of importance), without a shuffle."""
    if not fields:
        return df.where("false").select(F.col(key).alias("doc_id"), *(F.lit(None).cast(t).alias(n) for n, t in (("fid", "int"), ("text", "string"), ("exact", "boolean"))))
    each = F.array(*[F.struct(F.lit(i).alias("fid"), F.coalesce(field_text(df, f), F.lit("")).alias("text"), F.lit(is_faceted(f, set(exact))).alias("exact")) for i, f in enumerate(fields)])
    return df.select(F.col(key).alias("doc_id"), F.explode(each).alias("f")).select("doc_id", "f.*")


def tokens(df: DataFrame, fields: list[str], key: str = "doc_id", stop_words: frozenset[str] = frozenset(), exact: tuple[str, ...] = ()) -> DataFrame:
    """Words of ``fields`` (in order of importance), without a shuffle."""
    out = (
        lines(df, fields, key, exact)
        .select("doc_id", "fid", "exact", F.posexplode(Z.tokens(F.col("text"))).alias("pos", "word"))
        .where(Z.is_word(F.col("word")) & (F.col("pos") < Z.MAX_POSITIONS))
    )
    return out.where(~F.col("word").isin(sorted(stop_words))) if stop_words else out


# Where a document's words are needed together, ``lines`` serve best: texts are shuffled, not their words.
# ``tokens`` (without stop words, as they are) do as well.


def postings(lines: DataFrame, stop_words: frozenset[str] = frozenset()) -> DataFrame:
    def work(w):
        doc, word, loose, exact = w.words()
        yield {"word": w.names.take(word), "doc_id": w.ids.take(doc), "loose": loose, "exact": exact}

    return whole(lines, "word string, doc_id {doc_id}, loose boolean, exact boolean", work, stop_words)


def vocabulary(tokens: DataFrame) -> DataFrame:
    """Of ``tokens``: filters on the word reach them. ``document_counts`` is for all words of ``lines``."""
    return tokens.select("word", "doc_id").distinct().groupBy("word").agg(F.count("*").alias("df"))


def document_counts(lines: DataFrame, stop_words: frozenset[str] = frozenset()) -> DataFrame:
    """``vocabulary`` of ``lines``: counts of some documents each, summed."""

    def work(w):
        word, n = np.unique(w.words()[1], return_counts=True)
        yield {"word": w.names.take(word), "n": n}

    return whole(lines, "word string, n long", work, stop_words).groupBy("word").agg(F.sum("n").alias("df"))


def common_prefixes(words: DataFrame, least: int = 100, longest: int = 4) -> DataFrame:
    """(prefix): those of up to ``longest`` bytes that at least ``least`` of the distinct ``words`` share."""
    return words.select(_prefixes(longest)).groupBy("prefix").agg(F.count("*").alias("words")).where(F.col("words") >= least).select("prefix")


def _prefixes(longest: int) -> Column:
    each = F.expr(f"transform(sequence(1, least({longest}, length(word))), k -> left(word, k))")
    return F.explode(F.filter(each, lambda p: F.octet_length(p) <= longest)).alias("prefix")


def prefix_postings(lines: DataFrame, least: int = 100, longest: int = 4, stop_words: frozenset[str] = frozenset()) -> DataFrame:
    """(prefix, doc_id) of the common prefixes."""

    def work(w):
        doc, word, *_ = w.words()
        names, places = w.prefixes(longest)
        for place in places:
            has = place[word] >= 0
            doc_, prefix = np.divmod(distinct(doc[has] * len(names) + place[word[has]]), max(1, len(names)))
            yield {"prefix": names.take(prefix), "doc_id": w.ids.take(doc_)}

    return whole(lines, "prefix string, doc_id {doc_id}", work, stop_words).join(common_prefixes(document_counts(lines, stop_words), least, longest), "prefix")


def prefix_positions(tokens: DataFrame, least: int = 100, longest: int = 4) -> DataFrame:
    """(prefix, fid, pos, doc_id): where words of a common prefix stand."""
    common = common_prefixes(tokens.select("word").distinct(), least, longest)
    return tokens.select("fid", "pos", "doc_id", _prefixes(longest)).join(common, "prefix").select("prefix", "fid", "pos", "doc_id").distinct()


def prefix_pairs(lines: DataFrame, least: int = 100, longest: int = 4, forward: bool = True, stop_words: frozenset[str] = frozenset()) -> DataFrame:
    """``word_pairs`` with the second word (or, not ``forward``, the first) by its common prefixes:
    (word, prefix, prox, doc_id), least distances."""

    def work(w):
        for names, doc, word, prefix, prox in w.prefix_pairs(longest, forward):
            yield {"word": w.names.take(word), "prefix": names.take(prefix), "prox": prox.astype(np.int32), "doc_id": w.ids.take(doc)}

    return whole(lines, "word string, prefix string, prox int, doc_id {doc_id}", work, stop_words).join(common_prefixes(document_counts(lines, stop_words), least, longest), "prefix").select("word", "prefix", "prox", "doc_id")


def prefix_pair_counts(lines: DataFrame, least: int = 100, longest: int = 4, forward: bool = True, stop_words: frozenset[str] = frozenset()) -> DataFrame:
    """(prefix, prox, n): rows of ``prefix_pairs``, counted where they arise."""

    def work(w):
        for names, _, _, prefix, prox in w.prefix_pairs(longest, forward):
            key, n = np.unique(prefix << 3 | prox, return_counts=True)
            yield {"prefix": names.take(key >> 3), "prox": (key & 7).astype(np.int32), "n": n}

    counted = whole(lines, "prefix string, prox int, n long", work, stop_words).groupBy("prefix", "prox").agg(F.sum("n").alias("n"))
    return counted.join(common_prefixes(document_counts(lines, stop_words), least, longest), "prefix")


def geo_points(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, lat, lng) of the documents that have a point."""
    if "_geo" not in df.columns:
        return df.where("false").select(F.col(key).alias("doc_id"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"))
    number = lambda f: F.expr(f"try_cast(_geo.{f} as double)").alias(f)
    return df.select(F.col(key).alias("doc_id"), number("lat"), number("lng")).where("lat is not null and lng is not null")


def field_len(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("doc_id", "fid").agg((F.max("pos") + 1).alias("n"))


def word_pairs(lines: DataFrame, stop_words: frozenset[str] = frozenset()) -> DataFrame:
    """Pairs of words of a field, with their least distance in the document."""

    def work(w):
        doc, first, second, prox = w.pairs()
        yield {"w1": w.names.take(first), "w2": w.names.take(second), "doc_id": w.ids.take(doc), "prox": prox.astype(np.int32)}

    return whole(lines, "w1 string, w2 string, doc_id {doc_id}, prox int", work, stop_words)


def word_pair_counts(lines: DataFrame, stop_words: frozenset[str] = frozenset()) -> DataFrame:
    """(doc_id, prox, pairs): rows of ``word_pairs``, counted where they arise."""

    def work(w):
        doc, _, _, prox = w.pairs()
        key, n = np.unique(doc << 3 | prox, return_counts=True)
        yield {"doc_id": w.ids.take(key >> 3), "prox": (key & 7).astype(np.int32), "pairs": n}

    return whole(lines, "doc_id {doc_id}, prox int, pairs long", work, stop_words)


def _leaves(kind: T.DataType, path: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], T.DataType]]:
    if isinstance(kind, T.StructType):
        return [leaf for f in kind.fields for leaf in _leaves(f.dataType, (*path, f.name))]
    return [(path, kind)]


def _facet_value(name: str, element: T.DataType):
    number = is_time(element) or isinstance(element, T.NumericType)

    def value(x: Column) -> Column:
        num = epoch(x, element) if is_time(element) else x.cast("double") if number else F.lit(None).cast("double")
        text = F.lit(None).cast("string") if number else x.cast("string")
        return F.struct(F.lit(name).alias("field"), num.alias("num"), F.lower(F.trim(text)).alias("norm"), text.alias("orig"))

    return value


def facets(df: DataFrame, names: list[str], key: str = "doc_id") -> DataFrame:
    """Values of the named fields and of what is nested below them; numbers and times are ``num``, other
    scalars ``norm`` (trimmed, lower case) with an original spelling; nulls and maps have none."""
    rows = []
    for path, kind in _leaves(df.schema):
        name = ".".join(path)
        if not any(name == n or name.startswith(n + ".") for n in names):
            continue
        column = F.col(".".join(f"`{p}`" for p in path))
        element = kind.elementType if isinstance(kind, T.ArrayType) else kind
        values = column if isinstance(kind, T.ArrayType) else F.array(column)
        if isinstance(element, (T.StructType, T.MapType, T.ArrayType)):
            continue
        rows.append(F.transform(F.filter(F.coalesce(values, F.array()), lambda x: x.isNotNull()), _facet_value(name, element)))
    if not rows:
        return df.select(F.col(key).alias("doc_id")).where("false").select("doc_id", *(F.lit(None).cast(t).alias(n) for n, t in (("field", "string"), ("num", "double"), ("norm", "string"), ("orig", "string"))))
    return df.select(F.col(key).alias("doc_id"), F.explode(F.concat(*rows)).alias("v")).select("doc_id", "v.*").where("num is null or (not isnan(num) and abs(num) < double('infinity'))")


def present(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, field) of top-level and nested fields that aren't null."""
    names, conds = [], []

    def walk(kind: T.StructType, path: tuple[str, ...]) -> None:
        for f in kind.fields:
            at = (*path, f.name)
            names.append(".".join(at))
            conds.append(F.col(".".join(f"`{p}`" for p in at)).isNotNull())
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, at)

    walk(df.schema, ())
    found = F.array(*[F.when(c, F.lit(n)) for n, c in zip(names, conds, strict=True)])
    return df.select(F.col(key).alias("doc_id"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("field"))


def field_distribution(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents by top-level field, in one aggregation without exploding."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(df.columns)])
    pairs = functools.reduce(lambda a, b: a + b, [[F.lit(c), F.col(str(i))] for i, c in enumerate(df.columns)])
    return counts.select(F.explode(F.create_map(*pairs)).alias("field", "n")).where("n > 0")
