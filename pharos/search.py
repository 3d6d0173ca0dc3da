"""The search builder: query text, filter, ranking rules, sort, distinct and pagination in one plan."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pharos.functions import geo
from pharos.functions.times import is_time
from pharos.operators import index as I
from pharos.operators import rank as R
from pharos.operators.distinct import distinct_hits
from pharos.plans import filters
from pharos.plans.criteria import CriterionError, parse_criterion, parse_sort
from pharos.plans.query import Planner, Phrase, branches, primitive
from pharos.runtime import ship
from pharos.settings import Settings


#: Pages up to so many hits are ranked without their documents, which are fetched afterwards.
PAGE = 1000


class Index:
    """Documents with their settings; derived tables are lazy frames, or persisted ones if given."""

    def __init__(self, documents: DataFrame, settings: Settings | None = None, key: str = "doc_id", tokens: DataFrame | None = None, vocabulary: DataFrame | None = None, word_pairs: DataFrame | None = None, lengths: DataFrame | None = None):
        ship(documents.sparkSession)
        self.documents, self.settings, self.key = documents, settings or Settings(), key
        names = [f.name for f in documents.schema.fields if f.name != key]
        self.fields = list(self.settings.searchable) if self.settings.searchable is not None else names
        self.lines = tokens if tokens is not None else I.lines(documents, self.fields, key, self.settings.exact_attributes)
        self.tokens = tokens if tokens is not None else I.tokens(documents, self.fields, key, self.settings.stop_words, self.settings.exact_attributes)
        self.vocabulary = vocabulary if vocabulary is not None else I.vocabulary(self.tokens)
        self.lengths = lengths if lengths is not None else I.field_len(self.tokens)
        self._pairs = word_pairs

    def search(self, query: str | None = None) -> Search:
        return Search(self, query)

    def word_documents_count(self, word: str) -> int:
        return self.word_counts([word])[word]

    def word_counts(self, words: list[str]) -> dict[str, int]:
        """Documents that have each word: one lookup in the vocabulary."""
        rows = self.vocabulary.where(F.col("word").isin(sorted(set(words)))).collect()
        return dict.fromkeys(words, 0) | {r["word"]: r["df"] for r in rows}

    def pair_counts(self, words: list[str]) -> dict[tuple[str, str], int]:
        """Documents in which the two halves of any split of ``words`` stand side by side: one scan."""
        halves = {(w[:i], w[i:]) for w in words for i in range(1, len(w))}
        if not halves:
            return {}
        if self._pairs is not None:
            near = self._pairs.where("prox = 1").select("w1", "w2", "doc_id")
        else:
            t = self.tokens.where(F.col("word").isin(sorted({h for p in halves for h in p}))).select("doc_id", "fid", "pos", "word")
            near = t.alias("a").join(t.alias("b"), (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.fid") == F.col("b.fid")) & (F.col("b.pos") == F.col("a.pos") + 1))
            near = near.select(F.col("a.word").alias("w1"), F.col("b.word").alias("w2"), F.col("a.doc_id").alias("doc_id"))
        keys = sorted(a + "\x00" + b for a, b in halves)
        rows = near.where(F.concat_ws("\x00", "w1", "w2").isin(keys)).groupBy("w1", "w2").agg(F.count_distinct("doc_id").alias("n")).collect()
        return {(r["w1"], r["w2"]): r["n"] for r in rows}


@dataclass(frozen=True)
class Search:
    index: Index
    text: str | None = None
    start: int = 0
    size: int = 20
    sorts: tuple[str, ...] = ()
    strategy: str = "last"
    typos: bool = True
    limit_words: int | None = 10
    condition: object = None
    rules: tuple[str, ...] | None = None
    ngrams: bool = True
    split: bool = True
    distinct_on: str | None = None

    def offset(self, n: int) -> Search:
        return replace(self, start=n)

    def limit(self, n: int) -> Search:
        return replace(self, size=n)

    def sort_criteria(self, *sorts: str) -> Search:
        return replace(self, sorts=sorts)

    def terms_matching_strategy(self, strategy: str) -> Search:
        return replace(self, strategy=strategy)

    def authorize_typos(self, yes: bool) -> Search:
        return replace(self, typos=yes)

    def words_limit(self, n: int | None) -> Search:
        return replace(self, limit_words=n)

    def filter(self, condition: str | list) -> Search:
        return replace(self, condition=filters.parse(condition) if isinstance(condition, str) else filters.parse_array(condition))

    def criteria(self, *rules: str) -> Search:
        return replace(self, rules=rules)

    def distinct(self, field: str) -> Search:
        return replace(self, distinct_on=field)

    def expand(self, ngrams: bool = True, split: bool = True) -> Search:
        """Whether adjacent words are also read as one and words as two."""
        return replace(self, ngrams=ngrams, split=split)

    # planning

    def parts(self) -> list:
        return primitive(self.text or "", self.index.settings.stop_words, self.limit_words)

    def tree(self):
        s = self.index.settings
        parts = self.parts()
        words = [p.text for p in parts if hasattr(p, "text")]
        pairs = self.index.pair_counts(words) if self.split and words else {}
        counts = self.index.word_counts(words) if self.strategy == "frequency" and words else {}
        return Planner(
            self.typos and s.authorize_typos, s.one_typo, s.two_typos, s.exact_words, s.synonyms, lambda w: counts.get(w, 0), lambda a, b: pairs.get((a, b), 0), self.split, self.ngrams
        ).build(parts, self.strategy)

    # execution

    def candidates(self) -> DataFrame:
        """Matching documents with a column for each rule's bucket."""
        ix = self.index
        docs = ix.documents.where(filters.compile(self.condition, ix.documents, set(ix.settings.filterable), strict=False))
        tree = self.tree()
        if tree is None:
            return docs
        forms = branches(tree)
        units = list(dict.fromkeys(u for _, s in forms for u in s))
        number = {u: i for i, u in enumerate(units)}
        seqs = [(k, tuple(number[u] for u in s)) for k, s in forms]
        rules = [parse_criterion(r).name for r in self.active_rules()]
        pairs = {p for _, s in seqs for p in zip(s, s[1:], strict=False)} if "proximity" in rules else set()
        tokens = ix.tokens
        if self.condition is not None:  # documents that the filter rejects are neither aggregated nor ranked
            tokens = tokens.join(docs.select(F.col(ix.key).alias("doc_id")), "doc_id", "left_semi")
        per = R.per_document(R.evidence(tokens, ix.vocabulary, units), units, pairs)
        per = per.withColumn("words", R.words_bucket(seqs)).where("words is not null")
        first = "words" in rules
        cols = []
        if "typo" in rules:
            cols.append(R.over_branches(seqs, R.typo_value, first).alias("typo"))
        if "proximity" in rules:
            cols.append(R.over_branches(seqs, R.proximity_value, first).alias("proximity"))
        if "attribute" in rules:
            cols.append(R.over_branches(seqs, R.attribute_value, first).alias("attribute"))
        per = per.select("doc_id", "words", *cols)
        if "exactness" in rules:
            parts = self.parts()
            ex = R.exactness(tokens, ix.lengths, parts)
            per = per.join(ex, "doc_id", "left").withColumn("exactness", R.exactness_bucket(len(parts))).drop("full", "starts", "contained")
        hits = per.withColumnRenamed("doc_id", ix.key)
        clash = [c for c in docs.columns if c != ix.key and c in hits.columns]
        for c in clash:  # a document field of a rule's name keeps its name; the bucket gets another
            hits = hits.withColumnRenamed(c, f"_{c}")
        return hits.join(docs, ix.key)

    def active_rules(self) -> tuple[str, ...]:
        return self.rules if self.rules is not None else self.index.settings.criteria

    def _orders(self, hits: DataFrame) -> list:
        ix, out = self.index, []
        sorts = [parse_sort(s) for s in self.sorts]
        rules = self.active_rules()
        if sorts and "sort" not in rules:
            raise CriterionError("a sort was asked for, but the ranking rules have no `sort`")
        for s in sorts:
            name = s.field or "_geo"
            if not any(name == a or name.startswith(a + ".") for a in ix.settings.sortable):
                raise CriterionError(f"attribute `{name}` isn't sortable; sortable are: {', '.join(ix.settings.sortable) or 'none'}")
        for r in rules:
            c = parse_criterion(r)
            if c.name == "sort":
                for s in sorts:
                    out += self._order(hits, s.field, s.ascending, s.point)
            elif c.field:
                out += self._order(hits, c.field, c.name == "asc", None)
            else:
                bucket = f"_{c.name}" if f"_{c.name}" in hits.columns else c.name
                if bucket in hits.columns and (bucket not in ix.documents.columns or bucket.startswith("_")):
                    out.append(F.col(bucket).asc())
        return [*out, F.col(ix.key).asc()]

    def _order(self, hits, name, ascending, point) -> list:
        if point is not None:
            d = geo.distance(F.col("_geo.lat").cast("double"), F.col("_geo.lng").cast("double"), *point)
            return [d.isNull().cast("int").asc(), d.asc() if ascending else d.desc()]
        column, kind = filters._column(hits, name)
        if column is None:
            return []
        array = isinstance(kind, T.ArrayType)
        element = kind.elementType if array else kind
        return R.sort_columns(column, is_time(element) or isinstance(element, T.NumericType), ascending, array)

    def ranked(self) -> tuple[DataFrame, list]:
        hits = self.candidates()
        return hits, self._orders(hits)

    def execute(self) -> DataFrame:
        """The page of hits, best first. A setting of ``pagination_max_total_hits`` ends it at so many hits."""
        if (cap := self.index.settings.pagination_max_total_hits) is not None and self.size > max(0, cap - self.start):
            return replace(self, size=max(0, cap - self.start)).execute()
        hits, orders = self.ranked()
        on = self.distinct_on or self.index.settings.distinct
        if on is not None:
            column, kind = filters._column(hits, on)
            if column is None:
                return hits.where("false")
            return distinct_hits(hits, orders, column, isinstance(kind, T.ArrayType), self.start, self.size, self.index.key)
        out = hits.orderBy(*orders)
        if self.start:
            out = out.offset(self.start)
        if self.size > PAGE:
            return out.limit(self.size)
        # rank narrow rows, then fetch the page's documents by their ids, which reach the scan
        ix = self.index
        scores = [c for c in hits.columns if c not in ix.documents.columns]
        spark, kind = hits.sparkSession, hits.select(ix.key, *scores).schema
        best = out.limit(self.size).select(ix.key, *scores).collect()
        ranked = spark.createDataFrame([(*r, i) for i, r in enumerate(best)], kind.add("_place", T.IntegerType()))
        rest = [c for c in hits.columns if c != ix.key]
        page = ix.documents.where(F.col(ix.key).isin([r[0] for r in best]))
        return page.join(F.broadcast(ranked), ix.key).orderBy("_place").select(ix.key, *rest)  # a page: bounded by PAGE

    def count(self) -> int:
        """Exact number of hits, however many a page shows; of a distinct attribute of single values, each
        value counts once (hits that share array values depend on the order: they count each)."""
        hits = self.candidates()
        on = self.distinct_on or self.index.settings.distinct
        if on is None:
            return hits.count()
        column, kind = filters._column(hits, on)
        if column is None:
            return 0
        if isinstance(kind, T.ArrayType):
            return hits.count()
        return hits.agg(F.count_distinct(column) + F.count_if(column.isNull())).first()[0]

    def documents(self) -> DataFrame:
        """The page with the displayed attributes only."""
        d = self.index.settings.displayed
        return self.execute().select(*(d if d is not None else self.index.documents.columns))


def fetch(index: Index, ids: list) -> DataFrame:
    """Documents by id; an id that doesn't exist is an error."""
    wanted = list(dict.fromkeys(ids))
    out = index.documents.where(F.col(index.key).isin(wanted))
    if out.count() != len(wanted):
        raise KeyError("some of the documents don't exist")
    return out


__all__ = ["Index", "Phrase", "Search", "fetch"]
