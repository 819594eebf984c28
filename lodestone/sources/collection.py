"""Collections: documents of users with vectors and attributes, in immutable segments under versioned manifests.

    <root>/config.json             the configuration
    <root>/versions/version_N.json segments, tombstone tables and the sequence number of version N; the highest N counts
    <root>/log/A-B                 operations A to B, in order
    <root>/segments/S/{docs,terms,centroids,postings}
    <root>/tombstones/T            (user_id, doc_id, seq)

Inserts and deletes go to the log. `flush` turns what is new there into a segment and a tombstone table and publishes a
version. A document is live if no delete of higher sequence number names it. Within a segment the last insert of a (user,
document) wins; across segments both copies live on with dedup="segment", and the later one alone with "latest". Deletes are
seen at once, inserts after the flush; a snapshot stands at one version and sequence number, and stays as it is.

One writer at a time; any number of readers.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.distance import l2_squared
from lodestone.functions.packed import split_vectors, unpack_floats
from lodestone.functions.quantise import ProductQuantiser
from lodestone.functions.stemmers import language_name
from lodestone.functions.text import keyword_terms, lower_tokens, text_terms
from lodestone.operators import ann, kmeans, search
from lodestone.operators.filters import Filter, Schema, matches
from lodestone.sources.files import Files

OPS = "seq long, op string, user_id {id}, doc_id {id}, vector array<float>, attributes map<string,string>"


class NotFound(LookupError):
    pass


class AlreadyExists(ValueError):
    pass


@dataclass
class CollectionConfig:
    """Defaults of a collection; attribute types are "keyword" or "text:<language>", others are kept and not indexed."""

    num_features: int = 768
    attributes: dict[str, str] = field(default_factory=dict)
    id_type: str = "long"
    metric: str = "l2"
    quantization: str = "none"
    pq_subvector: int = 8
    pq_bits: int = 8
    pq_training_rows: int = 10000
    initial_num_centroids: int = 10
    training_rows: int = 20000
    max_clusters_per_vector: int = 1
    clustering_distance_threshold: float = 0.1
    max_posting_list_size: int | None = None
    unbalanced_penalty: float = 0.0
    max_iterations: int = 100
    max_number_of_segments: int = 10
    max_pending_ops: int = 0
    max_time_to_flush_ms: int = 10000
    vacuum_ratio: float = 0.1
    dedup: str = "segment"

    def __post_init__(self) -> None:
        if self.quantization not in ("none", "pq"):
            raise ValueError("quantization is none or pq")
        if self.quantization == "pq" and (self.pq_subvector <= 0 or self.num_features % self.pq_subvector or not 1 <= self.pq_bits <= 8):
            raise ValueError("pq_subvector must divide num_features, and pq_bits be 8 at most")
        if self.num_features <= 0 or self.id_type not in ("long", "string") or self.dedup not in ("segment", "latest"):
            raise ValueError("num_features must be positive, id_type long or string, dedup segment or latest")
        for name, kind in self.attributes.items():
            if kind.split(":")[0] not in ("keyword", "text", "int", "float", "bool", "vector_int", "vector_keyword"):
                raise ValueError(f"{name}: no such attribute type as {kind}")

    @property
    def id_type_sql(self) -> str:
        return "bigint" if self.id_type == "long" else "string"

    @property
    def schema(self) -> Schema:
        return Schema(frozenset(n for n, k in self.attributes.items() if k == "keyword"), {n: language_name(k.partition(":")[2] or "english") for n, k in self.attributes.items() if k.startswith("text")})


@dataclass(frozen=True)
class Snapshot:
    """The live documents at one version and sequence number."""

    collection: Collection
    version: int
    segments: tuple[str, ...]
    tombstones: tuple[str, ...]
    sequence: int
    pending_deletes_to: int

    def _read(self, table: str) -> DataFrame | None:
        c = self.collection
        paths = [(s, f"{c.root}/segments/{s}/{table}") for s in self.segments if c.files.exists(f"{c.root}/segments/{s}/{table}")]
        out = None
        for s, path in paths:
            part = c.spark.read.parquet(path).withColumn("segment", F.lit(s))
            if table == "postings" and c.config.quantization == "pq":  # each segment has its own codes
                part = part.withColumn("vector", c.quantiser(s).original("code")).drop("code")
            out = part if out is None else out.unionByName(part)
        return out

    def deletes(self) -> DataFrame:
        c = self.collection
        out = c.spark.createDataFrame([], f"user_id {c.config.id_type_sql}, doc_id {c.config.id_type_sql}, seq long") if not self.tombstones else c.spark.read.parquet(*[f"{c.root}/tombstones/{t}" for t in self.tombstones])
        pending = c.log(self.sequence, self.pending_deletes_to).filter("op = 'delete'").select("user_id", "doc_id", "seq")
        return out.unionByName(pending).groupBy("user_id", "doc_id").agg(F.max("seq").alias("deleted"))

    def _live(self, rows: DataFrame) -> DataFrame:
        gone = self.deletes()
        rows = rows.join(gone, ["user_id", "doc_id"], "left").filter("deleted IS NULL OR deleted < seq").drop("deleted")
        if self.collection.config.dedup == "latest":
            # other tables name their rows by seq, so that the latest seq of a document decides there as well
            latest = self._read("docs").groupBy("user_id", "doc_id").agg(F.max("seq").alias("seq"))
            rows = rows.join(latest, ["user_id", "doc_id", "seq"], "left_semi")
        return rows

    def docs(self) -> DataFrame:
        rows = self._read("docs")
        return self._live(rows) if rows is not None else self.collection._no_docs()

    def table(self, name: str) -> DataFrame | None:
        rows = self._read(name)
        return rows if rows is None or "seq" not in rows.columns else self._live(rows)

    def matched(self, where: Filter, users: Sequence) -> DataFrame:
        """user_id, segment and doc_id of the live documents of these users that match."""
        keys = ["user_id", "segment", "doc_id"]
        mine = F.col("user_id").isin(list(users))
        docs = ann.point_ids(self.docs().filter(mine)).select(*keys, "point_id")
        terms = self.table("terms")
        terms = self.collection._no_terms() if terms is None else terms.filter(mine)
        return matches(where, terms.select(*keys, "term"), docs, self.collection.config.schema, keys)

    def search(self, vector: Sequence[float], k: int, users: Sequence, where: Filter | str = "") -> DataFrame:
        """doc_id and score of the k closest over all these users (exact); `where`, even None, restricts them."""
        docs = self.docs().filter(F.col("user_id").isin(list(users)))
        if where != "":
            docs = docs.join(self.matched(where, users), ["user_id", "segment", "doc_id"], "left_semi")
        return search.top_k(docs.select("user_id", "segment", "doc_id", "vector"), vector, k, self.collection.config.metric).select("doc_id", "score")

    def probe_search(self, vector: Sequence[float], k: int, users: Sequence, probes: int | None = None, ratio: float | None = 0.1, where: Filter | str = "") -> DataFrame:
        """The same over the lists of the nearest centroids of each user and segment."""
        keys = ["user_id", "segment"]
        postings, centroids = self.table("postings"), self._read("centroids")
        if postings is None or centroids is None:
            return self.collection.spark.createDataFrame([], f"doc_id {self.collection.config.id_type_sql}, score double")
        mine = F.col("user_id").isin(list(users))
        query = self.collection.spark.createDataFrame([(0, [float(x) for x in vector])], "query_id long, vector array<double>")
        matched = None if where == "" else self.matched(where, users)
        score = None
        if self.collection.config.quantization == "pq":  # both sides quantised, by the segment's codes, and squared
            pairs = []
            for s in self.segments:
                pq = self.collection.quantiser(s)
                code = pq.encode_array(np.array([vector], np.float64))[0]
                pairs += [F.lit(s), F.array(*[F.lit(float(x)) for i, c in enumerate(code) for x in pq.codebook[i, c]])]
            score = l2_squared("vector", F.create_map(*pairs)[F.col("segment")])
        found = ann.search(query, centroids.filter(mine), postings.filter(mine), k, probes or k, ratio, keys, self.collection.config.metric, matched, score=score)
        return found.orderBy("score", "doc_id").select("doc_id", "score")

    def term_search(self, where: Filter, limit: int | None, users: Sequence) -> DataFrame:
        return search.term_search(self.matched(where, users), limit)


class Collection:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root, Files(spark)
        if not self.files.exists(f"{root}/config.json"):
            raise NotFound(root)
        self.config = CollectionConfig(**self.files.read_json(f"{root}/config.json"))
        self._flushed_at = time.time()

    @staticmethod
    def create(spark: SparkSession, root: str, config: CollectionConfig) -> Collection:
        files = Files(spark)
        if files.exists(f"{root}/config.json"):
            raise AlreadyExists(root)
        files.write_json(f"{root}/config.json", asdict(config))
        files.write_json(f"{root}/versions/version_0.json", {"segments": [], "tombstones": [], "sequence": -1})
        return Collection(spark, root)

    # manifests

    def versions(self) -> list[int]:
        return sorted(int(n[8:-5]) for n in self.files.names(f"{self.root}/versions") if n.startswith("version_") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> tuple[int, dict]:
        known = self.versions()
        version = known[-1] if version is None else version
        if version not in known:
            raise NotFound(f"version {version} of {self.root}")
        return version, self.files.read_json(f"{self.root}/versions/version_{version}.json")

    def _publish(self, after: int, manifest: dict) -> int:
        self.files.write_json(f"{self.root}/versions/version_{after + 1}.json", manifest)
        return after + 1

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest version with the deletes logged so far, or an older one as it was published."""
        number, m = self.manifest(version)
        return Snapshot(self, number, tuple(s["name"] for s in m["segments"]), tuple(m["tombstones"]), m["sequence"], self.last_seq() if version is None else m["sequence"])

    # the log

    def _log_parts(self) -> list[tuple[int, int]]:
        return sorted(tuple(map(int, n.split("-"))) for n in self.files.names(f"{self.root}/log") if n.count("-") == 1)

    def last_seq(self) -> int:
        parts = self._log_parts()
        return max(parts[-1][1] if parts else -1, self.manifest()[1]["sequence"])

    def _ops_schema(self) -> str:
        return OPS.format(id=self.config.id_type_sql)

    def log(self, after: int = -1, to: int | None = None) -> DataFrame:
        """Operations with after < seq <= to."""
        parts = [p for p in self._log_parts() if p[1] > after and (to is None or p[0] <= to)]
        rows = self.spark.read.schema(self._ops_schema()).parquet(*[f"{self.root}/log/{a}-{b}" for a, b in parts]) if parts else self.spark.createDataFrame([], self._ops_schema())
        rows = rows.filter(F.col("seq") > after)
        return rows if to is None else rows.filter(F.col("seq") <= to)

    def append(self, ops: DataFrame) -> tuple[int, int]:
        """Appends operations (op, user_id, doc_id, vector, attributes), which `order` puts in order if it is there; returns their first and last number."""
        start = self.last_seq() + 1
        d = self.config.num_features
        order = F.col("order") if "order" in ops.columns else F.lit(0)
        # a number for each row: within its partition after those of the partitions before
        ops = ops.withColumn("__order", order).sort("__order")
        tagged = ops.withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id())
        folder = f"{self.root}/incoming/{uuid.uuid4().hex}"
        bad = F.when((F.col("op") == "insert") & ((F.size("vector") != d) | F.col("vector").isNull()), F.raise_error(F.lit(f"a vector of {d} numbers is needed"))).otherwise(F.col("vector"))
        tagged.withColumn("vector", bad).write.parquet(folder)
        stored = self.spark.read.parquet(folder)
        counts = sorted((r["__part"], r["count"]) for r in stored.groupBy("__part").count().collect())
        n, offsets = 0, []
        for part, c in counts:
            offsets.append((part, start + n))
            n += c
        if n == 0:
            self.files.delete(folder)
            return start, start - 1
        at = self.spark.createDataFrame(offsets, "__part int, __start long")
        seq = F.col("__row").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__start")  # the lower 33 bits count a partition's rows
        rows = stored.join(F.broadcast(at), "__part").withColumn("seq", seq.cast("long"))  # a row for each partition
        kind = self.config.id_type_sql
        rows.select("seq", "op", F.col("user_id").cast(kind), F.col("doc_id").cast(kind), F.col("vector").cast("array<float>"), F.col("attributes").cast("map<string,string>")).write.parquet(f"{self.root}/log/{start}-{start + n - 1}")
        self.files.delete(folder)
        return start, start + n - 1

    def insert(self, docs: DataFrame) -> tuple[int, int]:
        """docs: doc_id, vector, attributes (map of strings, optional), and user_id or user_ids (an array: one copy for each)."""
        if "user_ids" in docs.columns:
            docs = docs.withColumn("user_id", F.explode("user_ids")).drop("user_ids")
        if "attributes" not in docs.columns:
            docs = docs.withColumn("attributes", F.create_map().cast("map<string,string>"))
        return self.append(docs.withColumn("op", F.lit("insert")))

    def insert_packed(self, batches: DataFrame) -> tuple[int, int]:
        """batches: doc_ids (an array), vectors (one binary of little-endian 32-bit floats), user_ids, and attributes (an array of maps, optional).

        Each row holds a vector for each of its documents, and each user gets all of them; other lengths are an error.
        """
        flat = batches.withColumn("vectors", unpack_floats("vectors"))
        cut = flat.withColumn("vectors", split_vectors("vectors", self.config.num_features))
        none = F.transform("doc_ids", lambda _: F.create_map().cast("map<string,string>"))
        cut = cut.withColumn("attributes", F.coalesce("attributes", none) if "attributes" in batches.columns else none)
        fits = (F.size("vectors") == F.size("doc_ids")) & (F.size("attributes") == F.size("doc_ids"))
        rows = F.when(fits, F.arrays_zip("doc_ids", "vectors", "attributes")).otherwise(F.raise_error(F.lit("a vector and a map are needed for each document")))
        docs = cut.select("user_ids", F.explode(rows).alias("x"))
        return self.insert(docs.select("user_ids", F.col("x.doc_ids").alias("doc_id"), F.col("x.vectors").alias("vector"), F.col("x.attributes").alias("attributes")))

    def remove(self, users: Sequence, doc_ids: Sequence) -> tuple[int, int]:
        """Deletes every one of the documents of every one of the users; those that aren't there are no error."""
        kind = self.config.id_type_sql
        lists = self.spark.createDataFrame([(list(users), list(doc_ids))], f"users array<{kind}>, docs array<{kind}>")
        return self.remove_rows(lists.select(F.explode("users").alias("user_id"), "docs").select("user_id", F.explode("docs").alias("doc_id")))

    def remove_rows(self, rows: DataFrame) -> tuple[int, int]:
        """Deletes the documents of these rows (user_id, doc_id), however many there are."""
        ops = rows.select(F.lit("delete").alias("op"), "user_id", "doc_id")
        return self.append(ops.withColumn("vector", F.lit(None).cast("array<float>")).withColumn("attributes", F.lit(None).cast("map<string,string>")))

    # segments

    def quantiser(self, segment: str) -> ProductQuantiser:
        """That of the codes in the segment's lists."""
        return ProductQuantiser(self.files.read_json(f"{self.root}/segments/{segment}/codebook.json"))

    def _no_docs(self) -> DataFrame:
        k = self.config.id_type_sql
        return self.spark.createDataFrame([], f"user_id {k}, doc_id {k}, vector array<float>, attributes map<string,string>, seq long, segment string")

    def _no_terms(self) -> DataFrame:
        k = self.config.id_type_sql
        return self.spark.createDataFrame([], f"user_id {k}, segment string, doc_id {k}, term string")

    def terms(self, docs: DataFrame) -> DataFrame:
        """user_id, doc_id, seq and term: keywords as they are, all other declared text and undeclared attributes as stems."""
        schema = self.config.schema
        unindexed = [n for n, k in self.config.attributes.items() if n not in schema.keywords and n not in schema.languages]
        rows = docs.select("user_id", "doc_id", "seq", F.explode("attributes").alias("name", "value")).filter(~F.col("name").isin(unindexed) & F.col("value").isNotNull())
        language = F.lit("english")
        for name, lang in schema.languages.items():
            language = F.when(F.col("name") == name, F.lit(lang)).otherwise(language)
        is_keyword = F.col("name").isin(list(schema.keywords))
        is_plain = F.col("name").isin([n for n, lang in schema.languages.items() if lang == "none"])
        words = rows.filter(~is_keyword & ~is_plain).withColumn("terms", text_terms("value", language))
        keys = rows.filter(is_keyword | is_plain).withColumn("terms", F.when(is_keyword, keyword_terms("value")).otherwise(F.array_distinct(lower_tokens("value"))))
        both = words.unionByName(keys).select("user_id", "doc_id", "seq", "name", F.explode("terms").alias("t"))
        # distinct as it is: a segment has a document of a user once
        return both.select("user_id", "doc_id", "seq", F.concat_ws(":", "name", "t").alias("term"))

    def _write_segment(self, docs: DataFrame) -> dict | None:
        """Writes docs (user_id, doc_id, vector, attributes, seq) as a segment with its indexes."""
        name = f"seg_{uuid.uuid4().hex[:12]}"
        at, c = f"{self.root}/segments/{name}", self.config
        # ranges, not hashes: a large tenant is written by many tasks, and files hold few tenants each
        docs.repartitionByRange("user_id", "doc_id").sortWithinPartitions("user_id", "doc_id").write.option("parquet.bloom.filter.enabled#doc_id", "true").parquet(f"{at}/docs")
        docs = self.spark.read.parquet(f"{at}/docs")
        stats = docs.agg(F.count("*").alias("n"), F.min("seq").alias("a"), F.max("seq").alias("b")).first()
        if not stats.n:
            self.files.delete(at)
            return None
        self.terms(docs).repartitionByRange("user_id", "term", "doc_id").sortWithinPartitions("user_id", "term", "doc_id").write.parquet(f"{at}/terms")
        # centroids are trained on all users' vectors; each user has its own means of them, which only its vectors move
        trained = kmeans.build_centroids(docs.select("doc_id", "vector"), c.initial_num_centroids, c.max_posting_list_size, c.training_rows, c.max_iterations, c.unbalanced_penalty)
        shared = kmeans.table(self.spark, trained)
        first = ann.assign(docs.select("user_id", "doc_id", "vector", "seq").withColumnRenamed("doc_id", "__d").withColumn("doc_id", F.struct("user_id", "__d")), shared)
        ann.cluster_means(first.withColumn("vector", F.col("vector").cast("array<double>")), c.num_features, ["user_id"]).write.parquet(f"{at}/centroids")
        centroids = self.spark.read.parquet(f"{at}/centroids")
        lists = ann.assign(docs.select("user_id", "doc_id", "vector", "seq"), centroids, ["user_id"], c.max_clusters_per_vector, c.clustering_distance_threshold)
        lists = lists.drop("distance")
        if c.quantization == "pq":
            pq = ProductQuantiser.train(docs, c.pq_subvector, c.pq_bits, c.pq_training_rows)
            self.files.write_json(f"{at}/codebook.json", pq.codebook.tolist())
            lists = lists.withColumn("code", pq.quantise("vector")).drop("vector")
        lists.repartitionByRange("user_id", "centroid_id", "doc_id").sortWithinPartitions("user_id", "centroid_id").write.parquet(f"{at}/postings")
        return {"name": name, "docs": stats.n, "first": stats.a, "last": stats.b, "bytes": self.files.size(at)}

    def flush(self) -> str:
        """Makes what is new in the log a segment; its name, or "" if no document came."""
        number, m = self.manifest()
        last = self.last_seq()
        ops = self.log(m["sequence"], last)
        if last <= m["sequence"]:
            return ""
        order = Window.partitionBy("user_id", "doc_id").orderBy(F.desc("seq"))
        newest = ops.withColumn("__r", F.row_number().over(order)).filter("__r = 1 AND op = 'insert'").drop("__r", "op")
        segment = self._write_segment(newest)
        tombs = ops.filter("op = 'delete'").groupBy("user_id", "doc_id").agg(F.max("seq").alias("seq"))
        tombstones = list(m["tombstones"])
        if not tombs.isEmpty():
            tombs.write.parquet(f"{self.root}/tombstones/to_{last}")
            tombstones.append(f"to_{last}")
        self._publish(number, {"segments": m["segments"] + ([segment] if segment else []), "tombstones": tombstones, "sequence": last})
        self._flushed_at = time.time()
        return segment["name"] if segment else ""

    def auto_flush(self, now: float | None = None) -> str:
        """Flushes if enough operations wait or the last flush is long enough ago."""
        c, waiting = self.config, self.last_seq() - self.manifest()[1]["sequence"]
        late = ((now or time.time()) - self._flushed_at) * 1000 >= c.max_time_to_flush_ms
        return self.flush() if waiting > 0 and (c.max_pending_ops and waiting >= c.max_pending_ops or late) else ""

    def segments(self) -> DataFrame:
        """name, docs, bytes, live and version of the segments."""
        number, m = self.manifest()
        rows = [(s["name"], s["docs"], s["bytes"], number) for s in m["segments"]]
        out = self.spark.createDataFrame(rows, "name string, docs long, bytes long, version long")
        live = self.snapshot().docs().groupBy(F.col("segment").alias("name")).agg(F.count("*").alias("live"))
        return out.join(live, "name", "left").select("name", "docs", "bytes", F.coalesce("live", F.lit(0)).alias("live"), "version")

    def merge(self, names: Sequence[str]) -> str:
        """One segment of the live documents of these; deletes logged meanwhile keep counting."""
        number, m = self.manifest()
        known = {s["name"] for s in m["segments"]}
        if missing := set(names) - known:
            raise NotFound(f"segments {sorted(missing)}")
        if len(set(names)) < 2:
            raise ValueError("merging takes two segments or more")
        return self._rewrite(number, m, set(names))

    def vacuum(self, name: str) -> str:
        """The segment without its deleted documents."""
        number, m = self.manifest()
        if name not in {s["name"] for s in m["segments"]}:
            raise NotFound(f"segment {name}")
        return self._rewrite(number, m, {name})

    def _rewrite(self, number: int, m: dict, names: set[str]) -> str:
        live = self.snapshot().docs().filter(F.col("segment").isin(list(names)))
        order = Window.partitionBy("user_id", "doc_id").orderBy(F.desc("seq"))
        live = live.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r", "segment")
        segment = self._write_segment(live)
        rest = [s for s in m["segments"] if s["name"] not in names]
        self._publish(number, m | {"segments": rest + ([segment] if segment else [])})
        return segment["name"] if segment else ""

    def auto_optimize(self) -> list[str]:
        """Vacuums segments with too many deleted documents, then merges the smallest if there are too many segments."""
        done = []
        for r in self.segments().collect():
            if r.docs and (r.docs - r.live) / r.docs > self.config.vacuum_ratio:
                done.append(self.vacuum(r.name))
        rows = sorted((r.docs, r.name) for r in self.segments().collect())
        surplus = len(rows) - (self.config.max_number_of_segments - 1)
        if len(rows) > self.config.max_number_of_segments and surplus >= 2:
            done.append(self.merge([n for _, n in rows[:surplus]]))
        return done


class Catalog:
    """Collections by name under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root, Files(spark)

    def create(self, name: str, config: CollectionConfig) -> Collection:
        if not name or "/" in name:
            raise ValueError(f"{name!r} is no name")
        return Collection.create(self.spark, f"{self.root}/{name}", config)

    def get(self, name: str) -> Collection:
        return Collection(self.spark, f"{self.root}/{name}")

    def names(self) -> list[str]:
        return [n for n in self.files.names(self.root) if self.files.exists(f"{self.root}/{n}/config.json")]


class ShardDirectory:
    """Which shards an index has and on which nodes, as versioned JSON files of which the newest counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.files, self.root = Files(spark), root

    def publish(self, shards: dict[str, list[tuple[int, int]]], nodes: list[tuple[int, str, int]]) -> int:
        version = max((int(n[8:-5]) for n in self.files.names(self.root) if n.endswith(".json")), default=-1) + 1
        self.files.write_json(f"{self.root}/version_{version}.json", {"shards": shards, "nodes": nodes})
        return version

    def shards(self, index: str) -> list[tuple[str, int, str, int]]:
        """The name of each shard's collection, and the id, host and port of its node."""
        versions = [int(n[8:-5]) for n in self.files.names(self.root) if n.endswith(".json")]
        if not versions:
            raise NotFound(self.root)
        m = self.files.read_json(f"{self.root}/version_{max(versions)}.json")
        if index not in m["shards"]:
            raise NotFound(index)
        nodes = {n[0]: n for n in m["nodes"]}
        return [(f"{index}--{shard}", *nodes[node]) for shard, node in m["shards"][index]]


def attributes_json(value: object) -> str:
    """The stored form of an attribute that isn't a string."""
    return value if isinstance(value, str) else json.dumps(value)
