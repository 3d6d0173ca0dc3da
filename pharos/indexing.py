"""A stored index: documents with their derived tables in a folder, changed by adding files.

A version is a manifest that names, for each table, the folders it consists of. A change writes folders of
the rows it adds and of the ids it removes (tombstones), then moves the pointer to a manifest that lists
them too, so a batch costs what it holds and not what the index holds, and a writer that dies leaves the
index as it was. When folders or tombstones have become many, everything is rewritten once.

Tables: ``documents`` (``_docid``, ``_extid``, fields), ``tokens`` (by word, see ``operators.index.stored``),
``lengths`` (words of each field), ``vocabulary`` (signed counts of documents by word, summed when read) and
``tombstones`` (``_docid``). A replaced document gets a new ``_docid``, its old one a tombstone.
"""

from __future__ import annotations

import dataclasses
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pharos.operators import facet_counts
from pharos.operators import index as I
from pharos.operators import lifecycle as L
from pharos.runtime import materialise, ship
from pharos.search import Index, Search
from pharos.settings import Settings

DOCID, EXTID = "_docid", "_extid"
TABLES = ("documents", "tokens", "lengths", "vocabulary", "tombstones")


class Aborted(RuntimeError):
    """The caller asked to stop; the index is as it was."""


@dataclass(frozen=True)
class IndexerConfig:
    """How tables are kept: rewritten beyond so many folders, or tombstones of so many bytes of documents."""

    most_folders: int = 8
    tombstone_bytes: int = 1 << 30


@dataclass(frozen=True)
class IndexDocumentsConfig:
    """``method`` replaces or updates documents of an id that exists; ``autogenerate`` makes ids where a
    document has none."""

    method: str = "replace"
    autogenerate: bool = False


class StoredIndex:
    def __init__(self, spark: SparkSession, root: str, config: IndexerConfig | None = None):
        ship(spark)
        self.spark, self.store, self.config = spark, L.Store(spark, root), config or IndexerConfig()

    # reads

    @property
    def meta(self) -> dict:
        return self.store.settings() if self.store.version() is not None else {"tables": {}, "next": 0, "settings": json.loads(Settings().to_json())}

    @property
    def settings(self) -> Settings:
        return Settings.from_json(json.dumps(self.meta["settings"]))

    @property
    def primary_key(self) -> str | None:
        return self.settings.primary_key

    def _table(self, meta: dict, name: str) -> DataFrame | None:
        parts = [self.spark.read.parquet(f"{self.store.root}/{p}") for p in meta["tables"].get(name, [])]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None

    def _live(self, meta: dict, name: str, key: str) -> DataFrame | None:
        df, gone = self._table(meta, name), self._table(meta, "tombstones")
        return df if df is None or gone is None else df.join(gone.withColumnRenamed(DOCID, key), key, "left_anti")

    def documents(self) -> DataFrame:
        """Live documents with ``_docid`` and ``_extid``."""
        df = self._live(self.meta, "documents", DOCID)
        return df if df is not None else self.spark.createDataFrame([], f"{DOCID} long, {EXTID} string")

    def number_of_documents(self) -> int:
        return self.documents().count()

    def external_ids(self) -> DataFrame:
        return self.documents().select(EXTID, DOCID)

    def fields(self) -> dict[str, int]:
        """Top-level fields and their numbers, in the order in which they came."""
        return {c: i for i, c in enumerate(c for c in self.documents().columns if c not in (DOCID, EXTID))}

    def field_distribution(self) -> DataFrame:
        return I.field_distribution(self.documents().drop(DOCID, EXTID))

    def size(self) -> int:
        """Bytes of the folders of the current version."""
        path, fs = self.store._path, self.store._fs
        return sum(fs.getContentSummary(path(f"{self.store.root}/{p}")).getLength() for t in self.meta["tables"].values() for p in t)

    def index(self) -> Index:
        meta, s = self.meta, self.settings
        docs = self.documents()
        fields = tuple(c for c in docs.columns if c not in (DOCID, EXTID))
        s = dataclasses.replace(s, searchable=s.searchable if s.searchable is not None else fields, displayed=s.displayed if s.displayed is not None else fields)
        words = self._table(meta, "vocabulary")
        words = words.groupBy("word").agg(F.sum("df").alias("df")).where("df > 0") if words is not None else None
        return Index(docs, s, DOCID, tokens=self._live(meta, "tokens", "doc_id"), vocabulary=words, lengths=self._live(meta, "lengths", "doc_id"))

    def search(self, query: str | None = None) -> Search:
        return self.index().search(query)

    def facets(self, names: list[str], hits: DataFrame | None = None) -> DataFrame:
        """Facet distribution of ``hits`` (or all documents), with the settings' bound of values."""
        s = self.settings
        return facet_counts.distribution(hits if hits is not None else self.documents(), names, DOCID, s.max_values_per_facet, set(s.filterable))

    # changes

    def _derived(self, docs: DataFrame, s: Settings) -> DataFrame:
        fields = list(s.searchable) if s.searchable is not None else [c for c in docs.columns if c not in (DOCID, EXTID)]
        return I.tokens(docs, fields, DOCID, s.stop_words, s.exact_attributes)

    def _commit(self, meta: dict, added: dict[str, DataFrame], step: Callable[[str], None], keep: bool = True, **changes) -> None:
        name = f"v-{uuid.uuid4().hex}"
        tables = {t: list(meta["tables"].get(t, [])) if keep else [] for t in TABLES}
        for t, df in added.items():
            step(f"writing {t}")
            df.write.parquet(f"{self.store.root}/{name}/{t}")
            tables[t].append(f"{name}/{t}")
        step("publishing")
        now = time.time()
        self.store.publish(name, json.dumps(meta | {"tables": tables, "created_at": meta.get("created_at", now), "updated_at": now} | changes))

    def _counts(self, tokens: DataFrame, sign: int) -> DataFrame:
        return I.vocabulary(tokens).select("word", (F.col("df") * sign).alias("df"))

    def _step(self, progress, should_abort) -> Callable[[str], None]:
        def step(name: str) -> None:
            if should_abort is not None and should_abort():
                raise Aborted(f"stopped before {name}")
            if progress is not None:
                progress(name)

        return step

    def add_documents(
        self, docs: DataFrame, config: IndexDocumentsConfig | None = None, seq: str | None = None,
        progress: Callable[[str], None] | None = None, should_abort: Callable[[], bool] | None = None, **changes,
    ) -> dict:
        """Index a batch of documents; returns how many documents were ``given``, ``indexed`` and left ``unchanged``.

        Of several rows of one id the greatest ``seq`` counts (else the last in the frame's order); rows
        that are stored already as they are keep their ``_docid``. Missing or malformed ids and ``_geo``
        values are errors, and nothing of the batch is indexed then.
        """
        config, step, meta, s = config or IndexDocumentsConfig(), self._step(progress, should_abort), self.meta, self.settings
        if config.method not in ("replace", "update"):
            raise ValueError(f"unknown method {config.method}; use replace or update")
        step("reading")
        key = L.infer_primary_key(docs.columns, s.primary_key, config.autogenerate)
        rows = L.with_ids(docs, key, config.autogenerate).withColumnRenamed("ext_id", EXTID)
        rows = materialise(rows.withColumn("_seq", F.col(seq).cast("long") if seq else F.monotonically_increasing_id()))
        if key not in rows.columns and "." not in key:
            rows = rows.withColumn(key, F.col(EXTID))
        step("validating")
        self._validate(rows)
        old = self.documents()
        touched = old.join(rows.select(EXTID).distinct(), EXTID, "left_semi")
        fields = [c for c in old.columns if c != DOCID]
        if config.method == "update":
            new = L.upsert_update(touched.select(fields), rows, EXTID, "_seq")
        else:
            new = L.latest(rows, EXTID, "_seq").drop("_seq")
        given = rows.select(EXTID).distinct().count()
        same = [c for c in new.columns if c in fields and c != EXTID]
        extra = [c for c in fields if c not in new.columns]
        if set(new.columns) <= set(fields):  # otherwise a field is new, and all rows differ
            alike = reduce(lambda a, c: a & F.col(f"n.`{c}`").eqNullSafe(F.col(f"o.`{c}`")), same, F.lit(True))
            alike = reduce(lambda a, c: a & F.col(f"o.`{c}`").isNull(), extra, alike)
            known = new.alias("n").join(touched.alias("o"), EXTID).where(alike).select(F.col(EXTID), F.col(f"o.{DOCID}").alias(DOCID))
            known = materialise(known)
            new = new.join(known.select(EXTID), EXTID, "left_anti")
            touched = touched.join(known.select(DOCID), DOCID, "left_anti")
        step("numbering")
        numbered = materialise(L.number(new, EXTID, "_n").withColumn(DOCID, F.col("_n") + meta["next"]).drop("_n"))
        n = numbered.count()
        if s.primary_key is None:
            s = dataclasses.replace(s, primary_key=key)
        tokens = materialise(self._derived(numbered, s))
        words = self._counts(tokens, 1).unionByName(self._counts(self._derived(touched, s), -1)).groupBy("word").agg(F.sum("df").alias("df")).where("df != 0")
        self._commit(
            meta, {"documents": numbered, "tokens": I.stored(tokens), "lengths": I.field_len(tokens), "vocabulary": words, "tombstones": touched.select(DOCID)},
            step, next=meta["next"] + n, settings=json.loads(s.to_json()), **changes,
        )
        self._tidy(step)
        return {"given": given, "indexed": n, "unchanged": given - n}

    def _validate(self, rows: DataFrame) -> None:
        bad = L.invalid_ids(rows.withColumnRenamed(EXTID, "ext_id")).select("ext_id").limit(3).collect()
        if bad:
            raise L.DocumentError("missing or malformed ids, such as " + ", ".join("none" if r[0] is None else repr(r[0]) for r in bad))
        wrong = L.geo_errors(rows).select(EXTID, "error").limit(3).collect()
        if wrong:
            raise L.DocumentError("; ".join(f"document {r[0]}: {r[1]}" for r in wrong))

    def delete_documents(self, ids: DataFrame | list, progress=None, should_abort=None) -> int:
        """Documents of these external ids become tombstones; returns how many there were."""
        step, meta = self._step(progress, should_abort), self.meta
        wanted = ids.select(F.col(ids.columns[0]).cast("string").alias(EXTID)) if isinstance(ids, DataFrame) else self.spark.createDataFrame([(str(i),) for i in ids], f"{EXTID} string")
        gone = materialise(self.documents().join(wanted.distinct(), EXTID, "left_semi"))
        n = gone.count()
        if n:
            self._commit(meta, {"vocabulary": self._counts(self._derived(gone, self.settings), -1), "tombstones": gone.select(DOCID)}, step)
            self._tidy(step)
        return n

    def clear(self) -> int:
        """All documents go; settings stay. Returns how many there were."""
        n = self.number_of_documents()
        self._commit(self.meta, {}, lambda _: None, keep=False)
        return n

    def update_settings(self, progress=None, should_abort=None, **changes) -> bool:
        """Set, reset (``RESET``) or keep each setting; derived tables are rebuilt if they depend on a change."""
        meta = self.meta
        new, again = self.settings.update(self.number_of_documents() > 0, **changes)
        step = self._step(progress, should_abort)
        self._commit(meta, {}, step, settings=json.loads(new.to_json()))
        if again and meta["tables"].get("documents"):
            self.rebuild(step)
        return again

    def rebuild(self, step: Callable[[str], None] = lambda _: None) -> None:
        """Live documents and their derived tables written anew, without tombstones."""
        docs, s = self.documents(), self.settings
        tokens = materialise(self._derived(docs, s))
        self._commit(self.meta, {"documents": docs, "tokens": I.stored(tokens), "lengths": I.field_len(tokens), "vocabulary": self._counts(tokens, 1)}, step, keep=False)

    def _tidy(self, step: Callable[[str], None]) -> None:
        meta = self.meta
        gone = self._table(meta, "tombstones")
        soft = gone.count() if gone is not None else 0
        stored = self._table(meta, "documents")
        total = stored.count() if stored is not None else 0
        mean = self.size() / max(1, total)
        if max(len(t) for t in meta["tables"].values()) > self.config.most_folders or soft and not L.should_soft_delete(total - soft, soft, mean, self.config.tombstone_bytes):
            self.rebuild(step)
