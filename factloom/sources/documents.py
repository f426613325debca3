"""Documents of a folder, their hashes, and a store of chunks that changes in place."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factloom.operators.manifest import chunk_page, manifest_diff, without_chunks
from factloom.operators.retrieval import where
from factloom.operators.sparse import read_index, write_index
from factloom.sources.commits import CommitLog

EXTENSIONS = ("txt", "md")
#: Leaves of the store: a change touches those of its documents alone.
BUCKETS = 64
#: A bucket with more deltas than this is rewritten by ``compact``.
MOST_DELTAS = 8


def document_files(spark: SparkSession, folder: str, extensions: Sequence[str] = EXTENSIONS) -> DataFrame:
    """Files below a folder by extension: path, file_hash (SHA-256 of the bytes), n_bytes, text (bad bytes replaced)."""
    pattern = r"(?i)\.(" + "|".join(extensions) + r")$"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(F.col("path").rlike(pattern))
    clean = F.expr("make_valid_utf8(cast(content as string))")
    return files.select("path", F.sha2("content", 256).alias("file_hash"), F.length("content").alias("n_bytes"), clean.alias("text"))


def corpus_manifest(files: DataFrame, source: str) -> DataFrame:
    """One row per file, in a form that two runs can compare: source, path, file_hash, n_bytes."""
    return files.select(F.lit(source).alias("source"), "path", "file_hash", "n_bytes")


class CorruptIndex(RuntimeError):
    """An index that is there but doesn't agree with itself."""


class NoChunks(RuntimeError):
    """Documents that were read but gave no chunk, so that no search would find them."""


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def leaf_signatures(chunks: DataFrame, buckets: int) -> DataFrame:
    """A digest for each bucket of chunks (id, doc_id and others): bucket, n, leaf.

    It is made of the sums of four parts of the rows' SHA-256, so the rows' order doesn't matter, tasks sum
    what they have first and no bucket is ever gathered.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(chunks.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    rows = chunks.select(bucket_of(F.col("doc_id"), buckets).alias("bucket"), row.alias("h"))
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256).alias("leaf"))


def root_signature(leaves: Mapping[str, Sequence]) -> str:
    """The digest over the leaves (bucket -> n, leaf) in the order of their buckets."""
    return hashlib.sha256(",".join(f"{b}:{leaves[b][0]}:{leaves[b][1]}" for b in sorted(leaves, key=int)).encode()).hexdigest()


class ChunkStore:
    """Chunks (id, doc_id, source_type, text, ..., embedding) as a log of deltas in buckets of documents.

    A change writes the chunks of its documents, in the buckets of those documents alone, and
    commits a version of the log that names them.  A delta replaces all earlier chunks of its
    documents; one without chunks for a document is a tombstone.  A state has, for each bucket, its deltas in
    order and the number and digest of its chunks, so the signature of the store needs no chunk that
    didn't change.  Readers keep the version that they began with; of two writers the later one
    looks again.  A log that can't be read is an error for readers (``Unreadable``); ``reset`` begins anew.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS, stemmed: bool = False):
        self.spark, self.folder, self.stemmed = spark, folder.rstrip("/"), stemmed
        self.log, self._buckets = CommitLog(spark, folder), buckets

    def version(self) -> int:
        return self.log.version()

    # ------------------------------------------------------------ reading

    def chunks(self, filters: Mapping[str, object] | None = None, version: int | None = None) -> DataFrame:
        """All chunks, or those of a filter; a store without any version is an error."""
        version, state = self.log.state(version)
        if version == 0 or "schema" not in state:
            raise LookupError("the store is empty")
        return self._live(state).where(where(filters))

    def ordered(self, filters: Mapping[str, object] | None = None) -> DataFrame:
        """The same by id."""
        return self.chunks(filters).orderBy("id")

    def _live(self, state: dict, only: set[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(state["schema"]))
        deltas = {b: d for b, d in state["deltas"].items() if only is None or b in only}
        plain = [(b, d[0]) for b, d in deltas.items() if len(d) == 1]
        merged = [(b, x, i) for b, d in deltas.items() if len(d) > 1 for i, x in enumerate(d)]
        out = self._read(schema, [(b, x) for b, x in plain]).where("not _gone").drop("_gone", "_file", "_row")
        if merged:
            # the place of a delta in its bucket, by its folder; a document's last delta counts
            order = F.create_map(*[v for x, i in sorted({(f"{x}/_bucket={b}", i) for b, x, i in merged}) for v in (F.lit(x), F.lit(i))])
            rows = self._read(schema, [(b, x) for b, x, _ in merged]).withColumn("_row", F.col("_row") + 1)
            keys = rows.select("doc_id", "_file", "_row", order[F.regexp_extract("_file", "([0-9a-f]{32}/_bucket=[0-9]+)/", 1)].alias("_nth"))
            last = keys.groupBy(F.col("doc_id").alias("_doc")).agg(F.max("_nth").alias("_last"))
            old = keys.join(last, F.col("doc_id").eqNullSafe(F.col("_doc"))).where("_nth < _last")
            # only keys are dealt out and compared; what comes back to the rows is a bit for each, 4 KB for 32,768 rows of a file
            part, bit = F.bitmap_bucket_number("_row"), F.bitmap_bit_position("_row")
            replaced = old.groupBy("_file", part.alias("_part")).agg(F.bitmap_construct_agg(bit).alias("_old"))
            byte = F.conv(F.hex(F.substring("_old", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            marked = rows.where("not _gone").withColumn("_part", part).join(F.broadcast(replaced), ["_file", "_part"], "left")
            kept = marked.where(F.col("_old").isNull() | (F.getbit(byte, (bit % 8).cast("int")) == 0))
            out = out.unionByName(kept.select(*out.columns))
        return out

    def _read(self, schema: StructType, places: list[tuple[str, str]]) -> DataFrame:
        full = StructType([*schema.fields]).add("_gone", "boolean")
        if not places:
            return self.spark.createDataFrame([], full).withColumn("_file", F.lit("")).withColumn("_row", F.lit(0).cast("long"))
        paths = [f"{self.folder}/data/{x}/_bucket={b}" for b, x in places]
        return self.spark.read.schema(full).parquet(*paths).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))

    def counts(self) -> DataFrame:
        return self.chunks().groupBy("doc_id").agg(F.count("*").alias("n_chunks"))

    def total(self) -> int:
        """Chunks in the store, from the log alone."""
        return sum(n for n, _ in self.log.state()[1].get("leaves", {}).values())

    def signature(self) -> str:
        """Of all chunks, from the log alone."""
        return root_signature(self.log.state()[1].get("leaves", {}))

    def by_ids(self, ids: DataFrame) -> DataFrame:
        return self.chunks().join(ids.select("id").distinct(), "id", "left_semi")

    def document_page(self, doc_id: object, limit: int, offset: int = 0) -> tuple[DataFrame, int]:
        """(a page of a document's chunks in the order of their numbers, the number of all of them); reads one bucket."""
        version, state = self.log.state()
        if version == 0 or "schema" not in state:
            raise LookupError("the store is empty")
        found = self.spark.range(1).select(bucket_of(F.lit(doc_id), state["buckets"]).alias("b")).first().b
        chunks = self._live(state, {str(found)}).withColumn("chunk_id", F.col("id").cast("string"))
        page = chunk_page(chunks, doc_id, limit, offset)
        return page.drop("chunk_id"), chunks.where(F.col("doc_id") == F.lit(doc_id)).count()

    # ------------------------------------------------------------ writing

    def add(self, chunks: DataFrame, embeddings: DataFrame | None = None) -> int:
        """Add chunks, with embeddings by id (a chunk without one is an error at run time); documents that are there are replaced."""
        if embeddings is not None:
            joined = chunks.join(embeddings.select("id", "embedding"), "id", "left")
            chunks = joined.withColumn("embedding", F.coalesce("embedding", F.raise_error(F.lit("a chunk has no embedding")).cast(embeddings.schema["embedding"].dataType)))
        return self._write(chunks, chunks.schema)

    def delete(self, docs: DataFrame) -> int:
        """Drop the chunks of documents (doc_id)."""
        return self.replace(docs, None)

    def replace(self, docs: DataFrame, chunks: DataFrame | None) -> int:
        """In one version: the documents ``docs`` (doc_id) lose the chunks they had, ``chunks`` (of these or other documents) come."""
        schema = self._schema() if chunks is None else chunks.schema
        marks = docs.select("doc_id").distinct().select(*[F.col("doc_id").cast(schema["doc_id"].dataType).alias("doc_id") if f.name == "doc_id" else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields], F.lit(True).alias("_gone"))
        rows = marks if chunks is None else marks.unionByName(chunks.withColumn("_gone", F.lit(False)))
        return self._write(rows, schema)

    def reset(self) -> int:
        """Drop everything; also the way out of a log that can't be read."""
        return self.log.commit(self.log.version(), {"buckets": self._buckets, "deltas": {}, "leaves": {}})

    def _schema(self) -> StructType:
        state = self.log.state()[1]
        if "schema" not in state:
            raise LookupError("the store is empty")
        return StructType.fromJson(json.loads(state["schema"]))

    def _put(self, rows: DataFrame, buckets: int) -> tuple[str, set[str]]:
        """Write rows by bucket in a folder of their own: (its name, the buckets that it has)."""
        name = uuid.uuid4().hex
        marked = rows if "_gone" in rows.columns else rows.withColumn("_gone", F.lit(False))
        placed = marked.withColumn("_bucket", bucket_of(F.col("doc_id"), buckets))
        try:
            # several tasks for a bucket, so that neither a large bucket nor a document of many chunks lies in one
            tasks = max(4, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // buckets)
            placed.repartition("_bucket", F.pmod(F.xxhash64("id"), F.lit(tasks))).write.partitionBy("_bucket").parquet(f"{self.folder}/data/{name}")
        except Exception:
            self.log.files.remove(f"data/{name}")
            raise
        return name, {n.removeprefix("_bucket=") for n in self.log.files.names(f"data/{name}") if n.startswith("_bucket=")}

    def _write(self, rows: DataFrame, schema: StructType) -> int:
        buckets = self.log.state()[1].get("buckets", self._buckets)
        name, touched = self._put(rows, buckets)

        def change(state: dict) -> dict | None:
            if not touched:
                return None
            if "schema" in state and [(f.name, f.dataType) for f in StructType.fromJson(json.loads(state["schema"])).fields] != [(f.name, f.dataType) for f in schema.fields]:
                raise ValueError("the chunks have other columns than the store")
            state = {"buckets": buckets, "deltas": {}, "leaves": {}, **state, "schema": state.get("schema", schema.json())}
            for b in touched:
                state["deltas"].setdefault(b, []).append(name)
            return self._signed(state, touched)

        return self.log.update(change)

    def _signed(self, state: dict, touched: set[str]) -> dict:
        """The state with the leaves of some buckets made anew."""
        fresh = {str(r.bucket): [r.n, r.leaf] for r in leaf_signatures(self._live(state, touched), state["buckets"]).collect()}
        for b in touched:
            state["leaves"].pop(b, None)
        state["leaves"].update(fresh)
        return state

    def compact(self, most: int = MOST_DELTAS) -> int:
        """Rewrite the buckets that have more than ``most`` deltas as one each; the chunks and the signature stay."""
        version, state = self.log.state()
        full = {b for b, d in state.get("deltas", {}).items() if len(d) > most}
        if not full:
            return version
        name, written = self._put(self._live(state, full), state["buckets"])
        for b in full:
            state["deltas"][b] = [name] if b in written else []
        state["deltas"] = {b: d for b, d in state["deltas"].items() if d}
        return self.log.commit(version, state)

    def vacuum(self) -> list[str]:
        """Delete deltas that the newest version doesn't name; readers of older versions have to be done."""
        live = {x for d in self.log.state()[1].get("deltas", {}).values() for x in d}
        gone = [n for n in self.log.files.names("data") if n not in live]
        for n in gone:
            self.log.files.remove(f"data/{n}")
        return gone

    # ------------------------------------------------------------ the sparse index

    def save_index(self) -> None:
        """The sparse index of the chunks, with the signature of the chunks that it was made from."""
        version, _ = self.log.state()
        write_index(self.chunks(version=version), f"{self.folder}/index", self.signature(), "id", stemmed=self.stemmed)

    def load_index(self):
        """The stored index: FileNotFoundError if there is none, CorruptIndex if it doesn't fit the chunks.  Reads no chunk."""
        found = read_index(self.spark, f"{self.folder}/index")
        if found is None:
            raise FileNotFoundError("no index")
        if found.signature != self.signature() or found.stemmed != self.stemmed:
            raise CorruptIndex("the index belongs to other chunks")
        return found

    def healed_index(self):
        """The stored index, made anew if there is none or it doesn't fit."""
        try:
            return self.load_index()
        except (FileNotFoundError, CorruptIndex):
            self.save_index()
            return self.load_index()


class IndexManifest:
    """What a source has indexed: doc_id, content_hash, chunk_count, as versions of a small log of tables.

    A manifest that can't be read counts as empty, so that everything is indexed anew.
    """

    SCHEMA = "doc_id string, content_hash string, chunk_count long"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.log = spark, CommitLog(spark, folder)

    def load(self) -> DataFrame:
        from factloom.sources.commits import Unreadable

        try:
            place = self.log.state()[1].get("place")
            return self.spark.read.schema(self.SCHEMA).parquet(f"{self.log.files.folder}/{place}") if place else self.spark.createDataFrame([], self.SCHEMA)
        except Unreadable:
            return self.spark.createDataFrame([], self.SCHEMA)

    def save(self, rows: DataFrame) -> int:
        place, version = f"data/{uuid.uuid4().hex}", self.log.version()
        rows.select("doc_id", "content_hash", F.col("chunk_count").cast("long")).write.parquet(f"{self.log.files.folder}/{place}")
        return self.log.commit(version, {"place": place})


def index_documents(store: ChunkStore, manifest: IndexManifest, documents: DataFrame, chunked, embedded=None, force: bool = False) -> dict[str, int]:
    """Bring a store up to date with documents (doc_id, content_hash, text, ...); counts of states.

    ``chunked(documents)`` gives the chunks of the documents that changed, ``embedded(chunks)`` their embeddings.  Chunks of changed
    documents replace the old ones and those of removed ones go, in one version; a changed document without chunks is an error
    (NoChunks) before anything changes.  If the store doesn't hold what the manifest says, or by ``force``, this manifest's documents are indexed anew;
    those of other manifests stay.
    """
    from factloom.session import settled

    known = settled(manifest.load())
    there = store.counts() if store.total() else store.spark.createDataFrame([], "doc_id string, n_chunks long")
    diff = settled(manifest_diff(known, documents.select("doc_id", "content_hash"), there))
    if force or not diff.where("state = 'inconsistent'").isEmpty():
        diff = diff.withColumn("state", F.when(F.col("state").isin("skipped", "inconsistent"), "updated").otherwise(F.col("state")))
    todo = documents.join(diff.where(F.col("state").isin("added", "updated")).select("doc_id"), "doc_id", "left_semi")
    fresh = settled(chunked(todo))
    if empty := [r.doc_id for r in without_chunks(fresh, diff).limit(5).collect()]:
        raise NoChunks(f"documents without chunks: {', '.join(map(str, empty))}")
    whole = fresh if embedded is None else fresh.join(embedded(fresh).select("id", "embedding"), "id")
    touched = diff.where(F.col("state") != "skipped").select("doc_id")
    if not touched.isEmpty():
        store.replace(touched, whole)
    counts = fresh.groupBy("doc_id").agg(F.count("*").alias("n"))
    now = documents.select("doc_id", "content_hash").join(counts, "doc_id", "left").join(known.select("doc_id", "chunk_count"), "doc_id", "left")
    manifest.save(now.select("doc_id", "content_hash", F.coalesce("n", "chunk_count").alias("chunk_count")))
    found = {r.state: r.n for r in diff.groupBy("state").agg(F.count("*").alias("n")).collect()}
    return {state: found.get(state, 0) for state in ("added", "updated", "skipped", "removed")}
