"""Registered queries and their oracle SQL: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pharos import oracle as O
from pharos.functions import formatting, geo
from pharos.operators import facet_counts, index, lifecycle
from pharos.plans.criteria import DEFAULT_CRITERIA
from pharos.runtime import materialise, scratch, table
from pharos.search import Index
from pharos.settings import Settings
from pharos.sources import readers

QUERIES: dict = {}
SQL: dict = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def documents(spark: SparkSession, sf: str, **settings) -> Index:
    base = {"searchable": ("text",), "filterable": ("lang", "source", "n_chars"), "sortable": ("n_chars", "source")}
    return Index(table(spark, sf, "documents"), Settings(**base | settings))


def parts(spark: SparkSession, sf: str, **settings) -> Index:
    base = {"searchable": O.PARTS[2], "filterable": ("p_size", "p_brand", "p_type", "p_retailprice"), "sortable": ("p_size", "p_retailprice", "p_name")}
    return Index(table(spark, sf, "part"), Settings(**base | settings), key="p_partkey")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked, typo-tolerant, filtered search with sort and pagination."""
    ix = documents(spark, sf_dir)
    return ix.search("the thing wor").filter("lang = en AND n_chars > 100").sort_criteria("n_chars:desc").execute().drop("text")


def _buckets(search, rules: tuple[str, ...]) -> DataFrame:
    key = search.index.key
    kept = [r for r in rules if r in ("typo", "proximity", "attribute", "exactness")]
    return search.criteria(*rules).candidates().select(key, F.col("words").cast("long").alias("words"), *[F.col(r).cast("long").alias(r) for r in kept])


# analysis and derived tables


@register("tokenize_positions", f"SELECT doc_id, CAST(pos AS INT) AS pos, word FROM {O.tokens(O.DOCS)}")
def _(spark, sf):
    return documents(spark, sf).tokens.select("doc_id", "pos", "word")


@register("postings", f"SELECT DISTINCT word, doc_id FROM {O.tokens(O.DOCS)}")
def _(spark, sf):
    return index.postings(documents(spark, sf).lines).select("word", "doc_id")


@register("postings_exact_attributes", f"SELECT word, doc_id AS p_partkey, bool_or(fid <> 2) AS loose, bool_or(fid = 2) AS exact FROM {O.tokens(O.PARTS)} GROUP BY ALL")
def _(spark, sf):
    return index.postings(parts(spark, sf, exact_attributes=("p_brand",)).lines).withColumnRenamed("doc_id", "p_partkey")


@register("vocabulary_df", f"SELECT word, count(DISTINCT doc_id) AS df FROM {O.tokens(O.DOCS)} GROUP BY word")
def _(spark, sf):
    return index.document_counts(documents(spark, sf).lines)


@register(
    "prefix_postings",
    f"WITH w AS (SELECT DISTINCT word, doc_id FROM {O.tokens(O.DOCS)}), p AS (SELECT DISTINCT word, left(word, k) AS prefix FROM (SELECT word, unnest(range(1, least(4, length(word)) + 1)) AS k FROM w) WHERE strlen(left(word, k)) <= 4), "
    "c AS (SELECT prefix FROM p GROUP BY prefix HAVING count(*) >= 100) SELECT prefix, count(DISTINCT doc_id) AS n_docs FROM p JOIN c USING (prefix) JOIN w USING (word) GROUP BY prefix",
)
def _(spark, sf):
    return index.prefix_postings(documents(spark, sf).lines).groupBy("prefix").agg(F.count("*").alias("n_docs"))


_COMMON = (
    "p AS (SELECT DISTINCT word, left(word, k) AS prefix FROM (SELECT word, unnest(range(1, least(4, length(word)) + 1)) AS k FROM tk) WHERE strlen(left(word, k)) <= 4), "
    "c AS (SELECT p.* FROM p JOIN (SELECT prefix FROM p GROUP BY prefix HAVING count(*) >= 20) USING (prefix))"
)


@register("prefix_positions", f"WITH tk AS {O.tokens(O.PARTS)}, {_COMMON.replace('>= 20', '>= 3')} SELECT DISTINCT prefix, CAST(fid AS INT) AS fid, CAST(pos AS INT) AS pos, doc_id AS p_partkey FROM tk JOIN c USING (word)")
def _(spark, sf):
    return index.prefix_positions(parts(spark, sf).tokens, 3).withColumnRenamed("doc_id", "p_partkey")


for _forward in (True, False):

    @register(
        f"prefix_pairs_{'forward' if _forward else 'backward'}",
        f"WITH tk AS {O.tokens(O.DOCS)}, {_COMMON}, m AS (SELECT a.doc_id, a.word AS w1, b.word AS w2, min(b.pos - a.pos) AS prox FROM tk a JOIN tk b ON a.doc_id = b.doc_id AND a.fid = b.fid AND b.pos BETWEEN a.pos + 1 AND a.pos + 7 GROUP BY ALL), "
        f"x AS (SELECT doc_id, {'w1' if _forward else 'w2'} AS word, prefix, min(prox) AS prox FROM m JOIN c ON {'w2' if _forward else 'w1'} = c.word GROUP BY ALL) SELECT prefix, CAST(prox AS INT) AS prox, count(*) AS n FROM x GROUP BY ALL",
    )
    def _(spark, sf, forward=_forward):
        return index.prefix_pair_counts(documents(spark, sf).lines, 20, forward=forward)


@register(
    "word_pair_proximity",
    f"WITH tk AS {O.tokens(O.DOCS)}, m AS (SELECT a.doc_id, a.word AS w1, b.word AS w2, min(b.pos - a.pos) AS prox FROM tk a JOIN tk b ON a.doc_id = b.doc_id AND a.fid = b.fid AND b.pos BETWEEN a.pos + 1 AND a.pos + 7 GROUP BY ALL) "
    "SELECT doc_id, CAST(prox AS INT) AS prox, count(*) AS pairs FROM m GROUP BY ALL",
)
def _(spark, sf):
    return index.word_pair_counts(documents(spark, sf).lines)


@register(
    "word_pair_proximity_fields",
    f"WITH tk AS {O.tokens(O.PARTS)} SELECT a.doc_id AS p_partkey, a.word AS w1, b.word AS w2, CAST(min(b.pos - a.pos) AS INT) AS prox FROM tk a JOIN tk b ON a.doc_id = b.doc_id AND a.fid = b.fid AND b.pos BETWEEN a.pos + 1 AND a.pos + 7 GROUP BY ALL",
)
def _(spark, sf):
    return index.word_pairs(parts(spark, sf).lines).withColumnRenamed("doc_id", "p_partkey")


@register("field_word_count", f"SELECT doc_id AS p_partkey, CAST(fid AS INT) AS fid, CAST(max(pos) + 1 AS INT) AS n FROM {O.tokens(O.PARTS)} GROUP BY ALL HAVING max(pos) + 1 <= 10")
def _(spark, sf):
    return index.field_len(parts(spark, sf).tokens).where("n <= 10").withColumnRenamed("doc_id", "p_partkey")


@register("stop_words", f"SELECT doc_id, count(*) AS n FROM {O.tokens(O.DOCS)} WHERE word NOT IN ('the', 'of', 'and', 'la', 'der') GROUP BY doc_id")
def _(spark, sf):
    return documents(spark, sf, stop_words=frozenset(["the", "of", "and", "la", "der"])).tokens.groupBy("doc_id").agg(F.count("*").alias("n"))


# retrieval and ranking: name, table, query, units (word, prefix, typos), forms, rules, strategy

_LAST3 = [[0, 1, 2], [0, 1], [0]]
_SEARCHES = [
    ("search_exact_and", "documents", "idiot clown ", [("idiot", False, 0), ("clown", False, 0)], [[0, 1]], ("words",), "all"),
    ("search_or_any", "documents", "idiot clown ", [("idiot", False, 0), ("clown", False, 0)], [[0, 1], [0], [1]], ("words",), "any"),
    ("search_prefix", "documents", "wor", [("wor", True, 0)], [[0]], ("words",), "last"),
    ("search_one_letter_prefix", "documents", "w", [("w", True, 0)], [[0]], ("words",), "last"),
    ("search_typo_one", "documents", "clwon ", [("clwon", False, 1)], [[0]], ("words", "typo"), "last"),
    ("search_typo_two", "documents", "worthlass ", [("worthlass", False, 2)], [[0]], ("words", "typo"), "last"),
    ("search_typo_prefix", "documents", "worth", [("worth", True, 1)], [[0]], ("words", "typo"), "last"),
    ("rank_words", "documents", "worthless clown idiot ", [("worthless", False, 0), ("clown", False, 0), ("idiot", False, 0)], _LAST3, ("words",), "last"),
    ("rank_typo", "documents", "worthlass clwon ", [("worthlass", False, 2), ("clwon", False, 1)], [[0, 1], [0]], ("words", "typo"), "last"),
    ("rank_proximity", "documents", "worthless clown idiot ", [("worthless", False, 0), ("clown", False, 0), ("idiot", False, 0)], _LAST3, ("words", "proximity"), "last"),
    ("rank_attribute", "part", "large economy ", [("large", False, 0), ("economy", False, 0)], [[0, 1], [0]], ("words", "attribute"), "last"),
    ("rank_exactness", "part", "small ring ", [("small", False, 0), ("ring", False, 0)], [[0, 1], [0]], ("words", "exactness"), "last"),
    ("rank_default", "part", "small widgit ", [("small", False, 1), ("widgit", False, 1)], [[0, 1], [0]], DEFAULT_CRITERIA, "last"),
    ("rank_default_documents", "documents", "stupid losers ", [("stupid", False, 1), ("losers", False, 1)], [[0, 1], [0]], DEFAULT_CRITERIA, "last"),
    ("rank_without_words_rule", "part", "large economy ", [("large", False, 1), ("economy", False, 1)], [[0, 1], [0]], ("typo", "proximity", "attribute"), "last"),
    ("matching_strategy_last", "part", "hot economy anvil ", [("hot", False, 0), ("economy", False, 0), ("anvil", False, 0)], _LAST3, ("words",), "last"),
    ("matching_strategy_first", "part", "hot economy anvil ", [("hot", False, 0), ("economy", False, 0), ("anvil", False, 0)], [[0, 1, 2], [1, 2], [2]], ("words",), "first"),
    ("matching_strategy_size", "part", "hot economy anvil ", [("hot", False, 0), ("economy", False, 0), ("anvil", False, 0)], [[0, 1, 2], [1, 2], [1]], ("words",), "size"),
    ("matching_strategy_frequency", "documents", "idiot the ", [("idiot", False, 0), ("the", False, 0)], [[0, 1], [0]], ("words",), "frequency"),
    ("matching_strategy_all", "part", "hot economy anvil ", [("hot", False, 0), ("economy", False, 0), ("anvil", False, 0)], [[0, 1, 2]], ("words",), "all"),
    ("matching_strategy_any", "part", "hot economy anvil ", [("hot", False, 0), ("economy", False, 0), ("anvil", False, 0)], [[0, 1, 2], [0], [1], [2]], ("words",), "any"),
]


def _search_query(source, text, rules, strategy, tolerant):
    def run(spark, sf):
        ix = documents(spark, sf) if source == "documents" else parts(spark, sf)
        s = ix.search(text).terms_matching_strategy(strategy).authorize_typos(tolerant).expand(False, False)
        return _buckets(s, rules)

    return run


for _name, _table, _text, _units, _forms, _rules, _strategy in _SEARCHES:
    _tolerant = any(u[2] for u in _units)
    _sql = O.search(O.DOCS if _table == "documents" else O.PARTS, _units, _forms, _rules, words_rule="words" in _rules)
    register(_name, _sql)(_search_query(_table, _text, _rules, _strategy, _tolerant))


@register(
    "search_phrase",
    f"WITH tk AS {O.tokens(O.PARTS)} SELECT DISTINCT a.doc_id AS p_partkey FROM tk a JOIN tk b ON a.doc_id = b.doc_id AND a.fid = b.fid AND b.pos = a.pos + 1 WHERE a.word = 'small' AND b.word = 'ring'",
)
def _(spark, sf):
    return parts(spark, sf).search('"small ring"').criteria("words").candidates().select("p_partkey")


@register(
    "search_phrase_documents",
    f"WITH tk AS {O.tokens(O.DOCS)} SELECT DISTINCT a.doc_id FROM tk a JOIN tk b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 JOIN tk c ON a.doc_id = c.doc_id AND c.pos = a.pos + 2 WHERE a.word = 'of' AND b.word = 'the' AND c.word = 'in'",
)
def _(spark, sf):
    return documents(spark, sf).search('"of the in"').criteria("words").candidates().select("doc_id")


@register("search_placeholder", "SELECT p_partkey FROM part WHERE p_size >= 40")
def _(spark, sf):
    return parts(spark, sf).search("").filter("p_size >= 40").candidates().select("p_partkey")


@register("synonyms_search", f"SELECT DISTINCT doc_id AS p_partkey FROM {O.tokens(O.PARTS)} WHERE word IN ('tiny', 'small', 'cold')")
def _(spark, sf):
    ix = parts(spark, sf, synonyms={"tiny": ["small", "cold"]}, authorize_typos=False)
    return ix.search("tiny ").criteria("words").candidates().select("p_partkey")


@register(
    "synonyms_phrase",
    f"WITH tk AS {O.tokens(O.PARTS)} SELECT doc_id AS p_partkey FROM tk WHERE word = 'gadget' UNION SELECT a.doc_id FROM tk a JOIN tk b ON a.doc_id = b.doc_id AND a.fid = b.fid AND b.pos = a.pos + 1 WHERE a.word = 'red' AND b.word = 'gizmo'",
)
def _(spark, sf):
    ix = parts(spark, sf, synonyms={"gadget": ["red gizmo"]}, authorize_typos=False)
    return ix.search("gadget ").criteria("words").candidates().select("p_partkey")


@register(
    "ngram_concat",
    f"SELECT DISTINCT doc_id AS p_partkey FROM {O.tokens(O.PARTS)} WHERE word = 'widget'",
)
def _(spark, sf):
    ix = parts(spark, sf, authorize_typos=False)
    return ix.search("wid get ").terms_matching_strategy("all").criteria("words").expand(True, False).candidates().select("p_partkey")


@register(
    "split_word",
    f"WITH tk AS {O.tokens(O.PARTS)} SELECT DISTINCT a.doc_id AS p_partkey FROM tk a JOIN tk b ON a.doc_id = b.doc_id AND a.fid = b.fid AND b.pos = a.pos + 1 WHERE a.word = 'hot' AND b.word = 'gear'",
)
def _(spark, sf):
    ix = parts(spark, sf, authorize_typos=False)
    return ix.search("hotgear ").criteria("words").candidates().select("p_partkey")


@register("search_filtered", O.search(O.DOCS, [("worthless", False, 0), ("clown", False, 0)], [[0, 1], [0]], ("words", "proximity"), "lang = 'en' AND n_chars > 1000"))
def _(spark, sf):
    s = documents(spark, sf).search("worthless clown ").authorize_typos(False).expand(False, False).filter("lang = en AND n_chars > 1000")
    return _buckets(s, ("words", "proximity"))


@register("pagination", "SELECT doc_id FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 40")
def _(spark, sf):
    return documents(spark, sf).search().filter("lang = en").sort_criteria("n_chars:desc").offset(40).limit(20).execute().select("doc_id")


@register("pagination_ranked", "SELECT * FROM (" + O.search(O.PARTS, [("large", False, 0), ("economy", False, 0)], [[0, 1], [0]], ("words", "attribute")) + ") ORDER BY words, attribute, p_partkey LIMIT 25 OFFSET 10")
def _(spark, sf):
    s = parts(spark, sf).search("large economy ").authorize_typos(False).expand(False, False).criteria("words", "attribute").offset(10).limit(25)
    return s.execute().select("p_partkey", F.col("words").cast("long").alias("words"), F.col("attribute").cast("long").alias("attribute"))


# filters

_FILTERS = {
    "filter_eq": ("part", "p_partkey", "p_type = economy", "lower(trim(p_type)) = 'economy'"),
    "filter_neq": ("part", "p_partkey", "p_type != economy", "lower(trim(p_type)) <> 'economy'"),
    "filter_eq_number": ("part", "p_partkey", "p_size = 7", "p_size = 7"),
    "filter_gt": ("lineitem", "l_orderkey, l_linenumber", "l_quantity > 45", "l_quantity > 45"),
    "filter_lt": ("lineitem", "l_orderkey, l_linenumber", "l_discount < 0.02", "l_discount < 0.02"),
    "filter_between": ("orders", "o_orderkey", "o_totalprice 1000 TO 20000.5", "o_totalprice BETWEEN 1000 AND 20000.5"),
    "filter_in": ("orders", "o_orderkey", "o_orderpriority IN ['1-URGENT', 2-HIGH,]", "lower(o_orderpriority) IN ('1-urgent', '2-high')"),
    "filter_not_in": ("orders", "o_orderkey", "o_orderstatus NOT IN [F, o]", "lower(o_orderstatus) NOT IN ('f', 'o')"),
    "filter_exists": ("orders", "o_orderkey", "o_orderstatus EXISTS AND NOT missing EXISTS", "o_orderstatus IS NOT NULL"),
    "filter_not_exists": ("orders", "o_orderkey", "o_orderstatus NOT EXISTS OR missing NOT EXISTS AND o_orderstatus = f", "o_orderstatus IS NULL OR lower(o_orderstatus) = 'f'"),
    "filter_and_or_not": (
        "lineitem", "l_orderkey, l_linenumber", "(l_returnflag = r AND NOT (l_quantity < 30 OR l_tax >= 0.05)) OR NOT NOT l_linestatus = 'O' AND l_discount = 0.1",
        "(lower(l_returnflag) = 'r' AND NOT (l_quantity < 30 OR l_tax >= 0.05)) OR (lower(l_linestatus) = 'o' AND l_discount = 0.1)",
    ),
    "filter_time": ("orders", "o_orderkey", "o_orderdate >= 883612800", "epoch(o_orderdate) >= 883612800"),
    "filter_large": (
        "lineitem", "l_orderkey, l_linenumber", " OR ".join(f"(l_suppkey = {k} AND l_quantity {k % 40} TO {k % 40 + 9})" for k in range(40)),
        " OR ".join(f"(l_suppkey = {k} AND l_quantity BETWEEN {k % 40} AND {k % 40 + 9})" for k in range(40)),
    ),
}


def _filter_query(name: str, keys: str, text: str):
    from pharos.plans import filters

    def run(spark, sf):
        df = table(spark, sf, name)
        return df.where(filters.compile(filters.parse(text), df, strict=False)).select(*keys.split(", "))

    return run


for _name, (_table, _keys, _text, _where) in _FILTERS.items():
    register(_name, f"SELECT {_keys} FROM {_table} WHERE {_where}")(_filter_query(_table, _keys, _text))


@register("filter_schemaless", "SELECT event_id FROM events WHERE event_id % 4 = 0 OR event_id % 4 = 2 AND event_id > 50")
def _(spark, sf):
    from pharos.plans import filters

    # of each four, one has a null, one lacks the field, one holds an array, one a word
    text = F.element_at(F.array(F.lit('{"a": {"b": null}}'), F.lit('{"c": 1}'), F.format_string('{"a": {"b": ["x", %d]}}', F.col("event_id")), F.lit('{"a": {"b": "Word"}}')), (F.col("event_id") % 4 + 1).cast("int"))
    e = table(spark, sf, "events").select("event_id", F.parse_json(text).alias("document"))
    return e.where(filters.compile(filters.parse("a.b EXISTS AND NOT a.b = word AND a.b != x OR a.b > 50 OR NOT a EXISTS AND c = 2"), e)).select("event_id")


@register("count_distinct_hits", "SELECT count(DISTINCT o_custkey) AS n FROM orders WHERE o_totalprice > 100000")
def _(spark, sf):
    ix = Index(table(spark, sf, "orders"), Settings(searchable=("o_orderpriority",), filterable=("o_totalprice",), distinct="o_custkey"), key="o_orderkey")
    return spark.createDataFrame([(ix.search().filter("o_totalprice > 100000").count(),)], "n long")


@register("geo_points", "SELECT c_custkey AS doc_id, CAST((c_custkey * 37) % 180 - 90 AS DOUBLE) AS lat, CAST((c_custkey * 91) % 360 - 180 AS DOUBLE) AS lng FROM customer")
def _(spark, sf):
    return index.geo_points(_places(spark, sf).documents, "c_custkey")


@register("filter_array", "SELECT doc_id FROM documents WHERE lower(lang) = 'de' OR lower(source) = 'src3'")
def _(spark, sf):
    return documents(spark, sf).search().filter([["lang = de", "source = SRC3"], ""]).candidates().select("doc_id")


# geo: coordinates follow from the key

_LAT, _LNG = "(({k} * 37) % 180 - 90)", "(({k} * 91) % 360 - 180)"


def _places(spark, sf) -> Index:
    c = table(spark, sf, "customer")
    point = F.struct(F.expr(_LAT.format(k="c_custkey")).cast("double").alias("lat"), F.expr(_LNG.format(k="c_custkey")).cast("double").alias("lng"))
    return Index(c.withColumn("_geo", point), Settings(searchable=("c_mktsegment",), filterable=("_geo", "c_acctbal"), sortable=("_geo",)), key="c_custkey")


def _metres(lat: float, lng: float) -> str:
    return geo.SQL.format(lat=_LAT.format(k="c_custkey"), lng=_LNG.format(k="c_custkey"), to_lat=lat, to_lng=lng)


@register("geo_radius", f"SELECT c_custkey FROM customer WHERE {_metres(48.8, 2.3)} <= 2000000")
def _(spark, sf):
    return _places(spark, sf).search().filter("_geoRadius(48.8, 2.3, 2000000)").candidates().select("c_custkey")


for _order in ("asc", "desc"):

    @register(f"geo_sort_{_order}", f"SELECT c_custkey, round({_metres(10, 20)}, 3) AS metres FROM customer ORDER BY metres {_order}, c_custkey LIMIT 50")
    def _(spark, sf, order=_order):
        page = _places(spark, sf).search().sort_criteria(f"_geoPoint(10, 20):{order}").limit(50).execute()
        return page.select("c_custkey", F.round(geo.distance(F.col("_geo.lat"), F.col("_geo.lng"), 10, 20), 3).alias("metres"))


# sort, distinct, facets


@register("sort_asc", "SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 100")
def _(spark, sf):
    ix = Index(table(spark, sf, "orders"), Settings(searchable=("o_orderpriority",), sortable=("o_totalprice",)), key="o_orderkey")
    return ix.search().sort_criteria("o_totalprice:asc").limit(100).execute().select("o_orderkey")


@register("sort_desc", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def _(spark, sf):
    ix = Index(table(spark, sf, "orders"), Settings(searchable=("o_orderpriority",), criteria=("o_totalprice:desc",)), key="o_orderkey")
    return ix.search().limit(100).execute().select("o_orderkey")


@register("sort_strings_then_missing", "SELECT p_partkey FROM part ORDER BY CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END, CASE WHEN p_size % 3 = 0 THEN NULL ELSE lower(p_type) END DESC, p_partkey LIMIT 1500")
def _(spark, sf):
    p = table(spark, sf, "part").withColumn("p_type", F.when(F.col("p_size") % 3 != 0, F.col("p_type")))
    ix = Index(p, Settings(searchable=("p_name",), sortable=("p_type",)), key="p_partkey")
    return ix.search().sort_criteria("p_type:desc").limit(1500).execute().select("p_partkey")


@register("distinct_attribute", "SELECT o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def _(spark, sf):
    ix = Index(table(spark, sf, "orders"), Settings(searchable=("o_orderpriority",), sortable=("o_totalprice",), distinct="o_custkey"), key="o_orderkey")
    return ix.search().sort_criteria("o_totalprice:desc").limit(2_000_000_000).execute().select("o_orderkey")


@register("facet_distribution", "SELECT 'lang' AS field, lang AS value, count(*) AS count FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def _(spark, sf):
    return facet_counts.distribution(table(spark, sf, "documents"), ["lang", "source"])


@register("facet_distribution_filtered", "SELECT 'p_size' AS field, CAST(p_size AS VARCHAR) AS value, count(*) AS count FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part) GROUP BY p_size ORDER BY p_size LIMIT 20")
def _(spark, sf):
    mean = table(spark, sf, "part").agg(F.avg("p_retailprice")).first()[0]
    hits = parts(spark, sf).search().filter(f"p_retailprice > {mean!r}").candidates()
    return facet_counts.distribution(hits, ["p_size"], "p_partkey", 20)


@register(
    "facet_distribution_search",
    f"SELECT 'lang' AS field, lang AS value, count(*) AS count FROM documents WHERE doc_id IN (SELECT doc_id FROM {O.tokens(O.DOCS)} WHERE word IN ('idiot', 'clown')) GROUP BY lang",
)
def _(spark, sf):
    hits = documents(spark, sf).search("idiot clown ").terms_matching_strategy("any").authorize_typos(False).expand(False, False).criteria("words").candidates()
    return facet_counts.distribution(hits, ["lang"])


@register("facet_minmax", "SELECT 'o_totalprice' AS field, min(o_totalprice) AS least, max(o_totalprice) AS greatest FROM orders")
def _(spark, sf):
    return facet_counts.min_max(table(spark, sf, "orders"), ["o_totalprice"], "o_orderkey")


@register("field_distribution", "SELECT 'event_id' AS field, count(event_id) AS n FROM events UNION ALL SELECT 'ts', count(ts) FROM events UNION ALL SELECT 'user_id', count(user_id) FROM events UNION ALL SELECT 'event_type', count(event_type) FROM events UNION ALL SELECT 'value', count(value) FROM events UNION ALL SELECT 'props', count(props) FROM events")
def _(spark, sf):
    return index.field_distribution(table(spark, sf, "events"))


# documents over time


def _orders_and_delta(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    d = o.where("o_orderkey % 7 = 0").select((F.col("o_orderkey") + 3).alias("o_orderkey"), F.lit("X").alias("o_orderstatus"), F.lit(None).cast("double").alias("o_totalprice"))
    twice = d.withColumn("seq", F.lit(1)).unionByName(d.withColumn("o_orderstatus", F.lit("Y")).where("o_orderkey % 2 = 0").withColumn("seq", F.lit(2)))
    return o, twice


_NEW = "(SELECT o_orderkey + 3 AS o_orderkey, CASE WHEN (o_orderkey + 3) % 2 = 0 THEN 'Y' ELSE 'X' END AS o_orderstatus FROM orders WHERE o_orderkey % 7 = 0)"


@register("upsert_replace", f"SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {_NEW}) UNION ALL SELECT o_orderkey, o_orderstatus, NULL FROM {_NEW}")
def _(spark, sf):
    return lifecycle.upsert_replace(*_orders_and_delta(spark, sf), key="o_orderkey")


@register("upsert_update", f"SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, coalesce(n.o_orderstatus, o.o_orderstatus) AS o_orderstatus, o.o_totalprice FROM orders o FULL JOIN {_NEW} n ON o.o_orderkey = n.o_orderkey")
def _(spark, sf):
    return lifecycle.upsert_update(*_orders_and_delta(spark, sf), key="o_orderkey")


@register("changed_documents", "SELECT p_partkey, p_name FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'new ' || p_name ELSE p_name END AS p_name FROM part) x ANTI JOIN part USING (p_partkey, p_name)")
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    return lifecycle.changed(p, p.withColumn("p_name", F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("new "), "p_name")).otherwise(F.col("p_name"))), "p_partkey")


@register("delete_documents", "SELECT o_orderkey FROM orders WHERE o_orderkey % 11 <> 4")
def _(spark, sf):
    o = table(spark, sf, "orders")
    return lifecycle.delete(o, o.where("o_orderkey % 11 = 4"), "o_orderkey").select("o_orderkey")


@register(
    "allocate_ids",
    "WITH used AS (SELECT p_partkey AS doc_id FROM part WHERE p_partkey % 10 <> 3), new AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS r FROM supplier), "
    "free AS (SELECT i AS doc_id, row_number() OVER (ORDER BY i) AS r FROM range(0, (SELECT max(doc_id) + 1 FROM used) + (SELECT count(*) FROM supplier)) t(i) WHERE i NOT IN (SELECT doc_id FROM used)) "
    "SELECT s_suppkey, doc_id FROM new JOIN free USING (r)",
)
def _(spark, sf):
    used = table(spark, sf, "part").where("p_partkey % 10 != 3").select(F.col("p_partkey").alias("doc_id"))
    return lifecycle.allocate(used, table(spark, sf, "supplier").select("s_suppkey"), "s_suppkey")


@register("flatten_json", "SELECT event_id, 'k' AS field, CAST(CAST(props->>'$.k' AS BIGINT) AS VARCHAR) AS value FROM events WHERE json_exists(props, '$.k')")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.parse_json("props").alias("document"))
    return readers.flatten_variant(e, "document", "event_id")


@register("flatten_nested", "SELECT c_custkey, c_name AS \"who.name\", c_nationkey AS \"who.nation.key\", [c_acctbal, c_acctbal * 2][1] + [c_acctbal, c_acctbal * 2][2] AS total FROM customer")
def _(spark, sf):
    c = table(spark, sf, "customer")
    nested = c.select("c_custkey", F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_nationkey").alias("key")).alias("nation")).alias("who"), F.array(F.struct(F.col("c_acctbal").alias("b")), F.struct((F.col("c_acctbal") * 2).alias("b"))).alias("list"))
    flat = readers.flatten(nested)
    return flat.select("c_custkey", F.col("`who.name`"), F.col("`who.nation.key`"), (F.col("`list.b`")[0] + F.col("`list.b`")[1]).alias("total"))


# sources (rows only where a file has to be written first)


@register("source_csv_typed", "SELECT p_partkey, p_name, p_retailprice FROM part")
def _(spark, sf):
    path = scratch(spark)
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("p_partkey:number"), F.col("p_name").alias("p_name:string"), F.col("p_retailprice").alias("p_retailprice:number"))
    p.write.option("header", True).csv(path)
    return readers.typed_csv(spark, path).withColumn("p_partkey", F.col("p_partkey").cast("long"))


@register("source_json_lines", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _(spark, sf):
    path = scratch(spark)
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    s.write.json(path)
    return readers.json_lines(spark, path, s.schema)


@register("snapshot_store", "SELECT p_partkey, p_name FROM part WHERE p_size < 25")
def _(spark, sf):
    store = lifecycle.Store(spark, scratch(spark))
    p = table(spark, sf, "part")
    store.write(p)
    store.write(store.read().where("p_size < 25"))
    return store.read().select("p_partkey", "p_name")


@register("streaming_ingest", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _(spark, sf):
    from pharos.indexing import StoredIndex
    from pharos.streaming.ingest import ingest

    s = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    source, root = scratch(spark), scratch(spark)
    s.repartition(3).write.parquet(source)
    ix = StoredIndex(spark, root)
    ix.update_settings(primary_key="s_suppkey", searchable=("s_name",))
    stream = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(source)
    ingest(stream, ix, scratch(spark)).awaitTermination()
    return ix.documents().select("s_suppkey", "s_name", "s_acctbal")


# formatting

_EM = r"regexp_replace(p_name, '\b(red|ring)\b', '<em>\1</em>', 'g')"


@register("highlight", f"SELECT p_partkey, {_EM} AS formatted FROM part WHERE regexp_matches(p_name, '\\b(red|ring)\\b')")
def _(spark, sf):
    s = parts(spark, sf, searchable=("p_name",), authorize_typos=False).search("red ring ").terms_matching_strategy("any").expand(False, False)
    m = formatting.Matcher(s.tree())
    return s.criteria("words").candidates().select("p_partkey", m.formatted(F.col("p_name"), formatting.FormatOptions(highlight=True)).alias("formatted"))


@register("match_bounds", "SELECT p_partkey, CAST(strpos(p_name, 'ring') - 1 AS INT) AS start, 4 AS length FROM part WHERE regexp_matches(p_name, '\\bring\\b')")
def _(spark, sf):
    s = parts(spark, sf, searchable=("p_name",), authorize_typos=False).search("ring ").expand(False, False)
    m = formatting.Matcher(s.tree())
    return s.criteria("words").candidates().select("p_partkey", F.explode(m.bounds_of(F.col("p_name"))).alias("b")).select("p_partkey", "b.start", "b.length")


@register(
    "crop",
    # the words of a name, numbered; the crop starts (3 - 1) // 2 words before the match, but ends with the name at the latest
    "WITH w AS (SELECT p_partkey, string_split(p_name || ' of ' || lower(p_type) || ' and ' || p_name, ' ') AS ws FROM part), "
    "m AS (SELECT p_partkey, ws, list_position(ws, 'ring') AS place FROM w WHERE list_contains(ws, 'ring')), "
    "c AS (SELECT *, least(greatest(1, place - 1), len(ws) - 2) AS a FROM m) "
    "SELECT p_partkey, CASE WHEN a > 1 THEN '…' ELSE '' END || array_to_string([CASE WHEN x = 'ring' THEN '<em>ring</em>' ELSE x END FOR x IN ws[a : a + 2]], ' ') || CASE WHEN a + 2 < len(ws) THEN '…' ELSE '' END AS formatted FROM c",
)
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", F.lit("of"), F.lower("p_type"), F.lit("and"), "p_name").alias("text"))
    s = Index(p, Settings(searchable=("text",), authorize_typos=False), "p_partkey").search("ring ").expand(False, False)
    m = formatting.Matcher(s.tree())
    return s.criteria("words").candidates().select("p_partkey", m.formatted(F.col("text"), formatting.FormatOptions(highlight=True, crop=3)).alias("formatted"))


@register("persisted_index", f"SELECT word, count(DISTINCT doc_id) AS df FROM {O.tokens(O.PARTS)} GROUP BY word")
def _(spark, sf):
    ix = parts(spark, sf)
    return Index(ix.documents, ix.settings, ix.key, tokens=materialise(index.stored(ix.tokens))).vocabulary


# a stored index: parts are added, a third of them replaced, some deleted, none of it in one batch

_STORED_NAME = "CASE WHEN p_partkey % 3 = 0 THEN 'renewed ' || p_name ELSE p_name END"
_STORED = f"(SELECT p_partkey, {_STORED_NAME} AS p_name, p_type, p_brand, p_size FROM part WHERE p_partkey % 10 <> 4)"


def _stored(spark, sf):
    from pharos.indexing import StoredIndex

    ix = StoredIndex(spark, scratch(spark))
    ix.update_settings(searchable=("p_name", "p_type", "p_brand"), filterable=("p_size", "p_type"), sortable=("p_size",), primary_key="p_partkey", authorize_typos=False)
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size")
    ix.add_documents(p)
    ix.add_documents(p.where("p_partkey % 3 = 0").withColumn("p_name", F.concat(F.lit("renewed "), "p_name")).unionByName(p.where("p_partkey % 3 = 1")))
    ix.delete_documents(p.where("p_partkey % 10 = 4").select("p_partkey"))
    return ix


@register("index_documents", f"SELECT * FROM {_STORED}")
def _(spark, sf):
    return _stored(spark, sf).documents().drop("_docid", "_extid")


@register("index_documents_vocabulary", "SELECT word, count(DISTINCT doc_id) AS df FROM " + O.tokens(("st", "p_partkey", ("p_name", "p_type", "p_brand"))).replace("FROM st ", f"FROM {_STORED} st ") + " GROUP BY word")
def _(spark, sf):
    return _stored(spark, sf).index().vocabulary


@register(
    "index_documents_search",
    "SELECT p_partkey, words, proximity FROM (" + O.search(("st", "p_partkey", ("p_name", "p_type", "p_brand")), [("renewed", False, 0), ("ring", False, 0)], [[0, 1], [0]], ("words", "proximity"), "p_size > 10").replace("FROM st ", f"FROM {_STORED} st ") + ")",
)
def _(spark, sf):
    s = _stored(spark, sf).search("renewed ring ").expand(False, False).filter("p_size > 10").criteria("words", "proximity")
    return s.candidates().select("p_partkey", F.col("words").cast("long").alias("words"), F.col("proximity").cast("long").alias("proximity"))


@register("index_documents_update", "SELECT p_partkey, p_name, p_size + 1 AS p_size FROM part")
def _(spark, sf):
    from pharos.indexing import IndexDocumentsConfig, StoredIndex

    ix = StoredIndex(spark, scratch(spark))
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    ix.update_settings(primary_key="p_partkey", searchable=("p_name",))
    ix.add_documents(p)
    ix.add_documents(p.select("p_partkey", (F.col("p_size") + 1).alias("p_size")), IndexDocumentsConfig("update"))
    return ix.documents().select("p_partkey", "p_name", "p_size")


@register("page_default", "SELECT * FROM (" + O.search(O.PARTS, [("small", False, 1), ("widgit", False, 1)], [[0, 1], [0]], DEFAULT_CRITERIA) + ") ORDER BY words, typo, proximity, attribute, exactness, p_partkey LIMIT 40")
def _(spark, sf):
    s = parts(spark, sf).search("small widgit ").expand(False, False).limit(40)
    return s.execute().select("p_partkey", *(F.col(r).cast("long").alias(r) for r in ("words", "typo", "proximity", "attribute", "exactness")))


@register("primary_key_ids", "SELECT count(*) AS n, count(*) FILTER (NOT regexp_full_match(ext, '[a-zA-Z0-9_-]+')) AS bad FROM (SELECT trim(s_name || CASE WHEN s_suppkey % 4 = 0 THEN ' x' ELSE '' END) AS ext FROM supplier)")
def _(spark, sf):
    s = table(spark, sf, "supplier").select(F.struct(F.concat("s_name", F.when(F.col("s_suppkey") % 4 == 0, " x").otherwise("")).alias("id")).alias("o"))
    ids = lifecycle.with_ids(s, "o.id")
    return ids.agg(F.count("*").alias("n")).crossJoin(lifecycle.invalid_ids(ids).agg(F.count("*").alias("bad")))


@register("geo_validation", "SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0")
def _(spark, sf):
    lat = F.when(F.col("c_custkey") % 5 == 0, "north").otherwise("12.5")
    return lifecycle.geo_errors(table(spark, sf, "customer").withColumn("_geo", F.struct(lat.alias("lat"), F.lit(3.0).alias("lng")))).select("c_custkey")


@register("source_json_array", "SELECT n_nationkey, n_name FROM nation")
def _(spark, sf):
    path = scratch(spark)
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    n.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).coalesce(1).write.text(path)
    return readers.json_array(spark, path, n.schema)


@register("snapshot_copy", "SELECT s_suppkey, s_name FROM supplier")
def _(spark, sf):
    store, copy = lifecycle.Store(spark, scratch(spark)), scratch(spark)
    store.write(table(spark, sf, "supplier").select("s_suppkey", "s_name").repartition(5))
    store.copy_to(copy, 1)
    return lifecycle.Store(spark, copy).read()


@register("searchable_dotted_fields", "SELECT DISTINCT doc_id AS c_custkey FROM " + O.tokens(("customer", "c_custkey", ("c_mktsegment", "c_name"))) + " WHERE word = 'building'")
def _(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.struct(F.col("c_name").alias("name"), F.array(F.struct(F.col("c_mktsegment").alias("of"))).alias("segment")).alias("who"))
    return Index(c, Settings(searchable=("who.segment.of", "who.name"), authorize_typos=False), "c_custkey").search("building ").expand(False, False).criteria("words").candidates().select("c_custkey")

