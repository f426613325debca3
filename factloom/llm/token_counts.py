"""Token counts without token ids: each distinct pre-token is counted once and joined to the documents' frequencies."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import doc_out, id_and_text, ship, written

#: Most frequent pre-tokens whose counts go to every task; all others are joined.
FREQUENT = 200_000
#: Pre-tokens that a task gathers before it hands their counts on.
GATHERED = 400_000
#: A longer pre-token (in characters) is known by its beginning and a digest.
LONGEST = 64


def key_of(piece: str) -> str:
    """A key of bounded length that no other pre-token has."""
    if len(piece) <= LONGEST:
        return piece
    return piece[:LONGEST] + hashlib.blake2b(piece.encode(), digest_size=16).hexdigest()


def piece_counts(texts: DataFrame, tokenizer: str) -> DataFrame:
    """key, n (occurrences in the corpus) and n_tokens of every distinct pre-token, each counted once."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from factloom.llm.token_counts import GATHERED, LONGEST, key_of
        from factloom.llm.tokens import encoder

        split = encoder(tokenizer).split

        def rows(found):
            return pa.RecordBatch.from_arrays([pa.array(map(key_of, found), pa.string()), pa.array([p if len(p) > LONGEST else None for p in found], pa.string()), pa.array(found.values(), pa.int64())], ["key", "long_piece", "n"])

        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(1).to_pylist():
                found.update(split(text)[0])
                if len(found) >= GATHERED:
                    yield rows(found)
                    found = Counter()
        yield rows(found)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from factloom.llm.tokens import encoder

        pieces = encoder(tokenizer).pieces
        for batch in batches:
            n = [len(pieces(whole if whole is not None else key)) for key, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["key", "n", "n_tokens"])

    distinct = texts.mapInArrow(gather, "key string, long_piece string, n long").groupBy("key", "long_piece").agg(F.sum("n").alias("n"))
    return distinct.mapInArrow(count, "key string, n long, n_tokens long")


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The pre-tokens above a frequency, the lowest one (in steps of an eighth of an octave) that at most ``most`` exceed.

    A histogram of that many steps finds it, so that no task sorts the keys of all others.
    """
    step = F.floor(F.log2("n") * 8)
    sizes = sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("distinct")).collect(), reverse=True)
    least, taken = None, 0
    for row in sizes:  # fewer than 512, as n is a long
        taken += row.distinct
        if taken > most:
            break
        least = row.step
    return counts.where(step >= least) if least is not None else counts.where(F.lit(False))


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, frequent: int = FREQUENT) -> DataFrame:
    """Tokens of each document: doc_id, n_bytes, n_tokens, over_limit.

    Two passes over the texts.  The first gathers the distinct pre-tokens of the corpus,
    of which every one is tokenised once.  The second takes the pre-token frequencies of
    each document, multiplies those of the most frequent pre-tokens with
    their counts (a broadcast of at most ``frequent`` keys of at most 96 characters), and hands on
    the others, which are joined to their counts and summed by row.  Ids are never made.
    A pre-token outside the broadcast is rarer than all inside it, so no key of the join
    is hot; the documents' rows are written to the shared folder, and know themselves by
    task and number.

    A null or empty text has 0 bytes and 0 tokens; texts of any length are counted
    whole.  Each input row gives one row, also where ids repeat or are null.  Other
    columns are ignored.  No documents: no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = id_and_text(docs)
    counts = written(spark, piece_counts(texts, tokenizer), "pre-tokens")
    top = most_frequent(counts, frequent).select("key", "n_tokens").toArrow()
    known = spark.sparkContext.broadcast((top.column(0).to_pylist(), top.column(1).to_pylist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from factloom.llm.token_counts import LONGEST, key_of
        from factloom.llm.tokens import encoder

        split, task, row = encoder(tokenizer).split, TaskContext.get().partitionId(), 0
        tokens_of = dict(zip(*known.value, strict=True)).get
        for batch in batches:
            totals, keys, amounts, edges = [], [], [], [0]
            for text in batch.column(1).to_pylist():
                found, total = split(text)
                for piece, n in Counter(found).items():
                    key = piece if len(piece) <= LONGEST else key_of(piece)
                    each = tokens_of(key)
                    if each is None:
                        keys.append(key)
                        amounts.append(n)
                    else:
                        total += n * each
                totals.append(total)
                edges.append(len(keys))
            rest = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays([pa.array(keys, pa.string()), pa.array(amounts, pa.int64())], ["key", "n"]))
            places = pa.array(range(row, row + len(batch)), pa.int64())
            row += len(batch)
            yield pa.RecordBatch.from_arrays([pa.array([task] * len(batch), pa.int32()), places, batch.column(0), batch.column(2), pa.array(totals, pa.int64()), rest], ["task", "row", "doc_id", "n_bytes", "total", "rest"])

    sized = texts.withColumn("n_bytes", F.octet_length("text").cast("long"))
    rows = written(spark, sized.mapInArrow(run, "task int, row long, doc_id long, n_bytes long, total long, rest array<struct<key:string,n:long>>"), "frequencies")
    rare = rows.select("task", "row", F.inline("rest")).join(counts.select("key", "n_tokens"), "key")
    more = rare.groupBy("task", "row").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("more"))
    out = rows.drop("rest").join(more, ["task", "row"], "left").withColumn("n_tokens", F.col("total") + F.coalesce("more", F.lit(0)))
    return out.select(doc_out(), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
