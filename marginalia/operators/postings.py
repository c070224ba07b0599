"""A persistent inverted index over notes: kept up by deltas, and searched without reading a text.

The index is a row of segments. A segment holds the postings of the notes that one batch added,
in partitions by the hash of the token, their lengths, and the ids of the notes that the batch took away or
replaced. A posting counts if no later segment names its id. A batch writes one segment, whatever the
size of the index; beyond ``MAX_SEGMENTS`` they are merged into one. The number of notes and of tokens is
kept in the manifest.

A search reads the partitions of its own tokens, filtered by token, and nothing else.

Defined cases: null ids are not indexed; a note added again replaces its old version; ids that aren't
in the index can be removed without effect; an empty index finds nothing.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import fts
from marginalia.operators.bounded import bounded_side
from marginalia.operators.shared import Manifests, exists, written

BUCKETS = 64
MAX_SEGMENTS = 8
MAX_BROADCAST_IDS = 500_000
POSTINGS = "token string, id long, col int, d int, pos int"


def bucket_of(token: Column | str) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def note_postings(notes: DataFrame) -> DataFrame:
    """(token, id, col, d, pos): one row for each place of a token in a column; ``d`` counts the note's tokens."""
    columns = F.array(*[F.struct(F.lit(i).alias("col"), fts.tokens(F.col(c)).alias("tokens")) for i, c in enumerate(fts.COLUMNS)])
    # the tokens are used twice, so the projection that makes them stays one of its own
    one = notes.where("id IS NOT NULL").select("id", columns.alias("cs"))
    one = one.select("id", F.aggregate("cs", F.lit(0), lambda n, x: n + F.size(x["tokens"])).alias("d"), F.explode("cs").alias("c"))
    return one.select("id", "d", "c.col", F.posexplode("c.tokens").alias("pos", "token")).select("token", "id", "col", "d", "pos")


class PostingsIndex:
    """The index under ``root``, as manifest ``number`` has it (the last one if none is given; 0 is empty).

    ``apply`` and ``compact`` go on from that state and lead to a new manifest; one that a failed run left behind
    is passed over.
    """

    def __init__(self, spark: SparkSession, root: str, number: int | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.manifests = Manifests(spark, self.root)
        self.number = self.manifests.current()[0] if number is None else number

    def _state(self) -> dict:
        return {"segments": [], "notes": 0, "tokens": 0} | (self.manifests.read(self.number) if self.number else {})

    def _publish(self, state: dict) -> None:
        number = self.manifests.current()[0] + 1
        self.manifests.publish(number, state)
        self.number = number

    def _table(self, segment: str, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{segment}/{name}")

    def _live(self, rows: list[DataFrame], segments: list[str]) -> DataFrame:
        """The rows of the segments, in order, without those whose id a later segment names."""
        every = functools.reduce(DataFrame.unionByName, [r.withColumn("seg", F.lit(i)) for i, r in enumerate(rows)])
        gone = [self._table(s, "gone", "gone long").withColumn("at", F.lit(i)) for i, s in enumerate(segments) if i]
        if not gone:
            return every.drop("seg")
        last, _ = bounded_side(functools.reduce(DataFrame.unionByName, gone).groupBy("gone").agg(F.max("at").alias("at")), MAX_BROADCAST_IDS)
        return every.join(last, (F.col("id") == F.col("gone")) & (F.col("at") > F.col("seg")), "left_anti").drop("seg")

    def lengths(self) -> DataFrame:
        """(id, d) of the notes in the index."""
        segments = self._state()["segments"]
        if not segments:
            return self.spark.createDataFrame([], "id long, d int")
        return self._live([self._table(s, "lengths", "id long, d int") for s in segments], segments)

    def postings(self, tokens: list[str] | None = None) -> DataFrame:
        """The postings of the given tokens; only their partitions are read."""
        segments = self._state()["segments"]
        if not segments or tokens == []:
            return self.spark.createDataFrame([], POSTINGS)
        if tokens is None:
            return self._live([self._table(s, "postings", f"{POSTINGS}, bucket int").drop("bucket") for s in segments], segments)
        wanted = self.spark.createDataFrame([(t,) for t in tokens], "t string").select(bucket_of("t")).distinct().collect()
        rows = []
        for s in segments:
            folders = [f for (b,) in wanted if exists(self.spark, f := f"{self.root}/{s}/postings/bucket={b}")]
            part = self.spark.read.schema(POSTINGS).parquet(*folders) if folders else self.spark.createDataFrame([], POSTINGS)
            rows.append(part.where(F.col("token").isin(tokens)))
        return self._live(rows, segments)

    def _write(self, postings: DataFrame, lengths: DataFrame, gone: DataFrame) -> str:
        segment = f"s-{uuid.uuid4().hex[:12]}"
        lengths.select("id", "d").write.parquet(f"{self.root}/{segment}/lengths")
        gone.select(F.col("id").alias("gone")).write.parquet(f"{self.root}/{segment}/gone")
        parts = postings.withColumn("bucket", bucket_of("token")).hint("rebalance", "bucket").sortWithinPartitions("bucket", "token", "id")
        parts.write.partitionBy("bucket").parquet(f"{self.root}/{segment}/postings")
        return segment

    def apply(self, added: DataFrame, removed: DataFrame | None = None) -> "PostingsIndex":
        """Indexes the notes ``added``, in place of older versions of them, and forgets the ids ``removed``."""
        state = self._state()
        ids = added.select("id").where("id IS NOT NULL")
        gone = ids if removed is None else ids.unionByName(removed.select("id").where("id IS NOT NULL")).distinct()
        if not state["segments"]:
            gone = gone.limit(0)
        before = self.lengths().join(gone, "id", "left_semi").agg(F.count("*"), F.sum("d")).first() if state["segments"] else (0, 0)
        size = functools.reduce(lambda a, b: a + b, [F.size(fts.tokens(F.col(c))) for c in fts.COLUMNS])
        segment = self._write(note_postings(added), added.where("id IS NOT NULL").select("id", size.alias("d")), gone)
        after = self._table(segment, "lengths", "id long, d int").agg(F.count("*"), F.sum("d")).first()
        counts = {"notes": state["notes"] - before[0] + after[0], "tokens": state["tokens"] - (before[1] or 0) + (after[1] or 0)}
        self._publish({"segments": [*state["segments"], segment], **counts})
        if len(state["segments"]) >= MAX_SEGMENTS:
            self.compact()
        return self

    def compact(self) -> None:
        """Merges the segments into one."""
        state = self._state()
        if len(state["segments"]) > 1:
            segment = self._write(self.postings(), self.lengths(), self.spark.createDataFrame([], "id long"))
            self._publish(state | {"segments": [segment]})

    def bm25_many(self, queries: dict[int, list[list[str]]], limit: int | None = None) -> DataFrame:
        """(query_no, id, rank) as ``fts.bm25_many``, from the postings of the queries' tokens."""
        order: dict[tuple[str, ...], int] = {}
        for phrases in queries.values():
            for p in phrases:
                order.setdefault(tuple(p), len(order))
        tokens = sorted({t for p in order for t in p})
        at = {t: i for i, t in enumerate(tokens)}
        # places are needed only of tokens in phrases of several
        placed = {t for p in order if len(p) > 1 for t in p}
        n_of = [F.count_if(F.col("token") == t).alias(f"n{i}") for t, i in at.items()]
        one = self.postings(tokens).groupBy("id", "col").agg(
            F.max("d").cast("double").alias("d"), *n_of, *[F.collect_list(F.when(F.col("token") == t, F.col("pos"))).alias(f"p{i}") for t, i in at.items() if t in placed]
        )

        def occurrences(phrase: tuple[str, ...]) -> Column:
            if len(phrase) == 1:
                return F.col(f"n{at[phrase[0]]}")
            follows = lambda x: functools.reduce(lambda a, b: a & b, [F.array_contains(F.col(f"p{at[t]}"), x + i + 1) for i, t in enumerate(phrase[1:])])
            return F.size(F.filter(F.col(f"p{at[phrase[0]]}"), follows))

        counts = one.select("id", "d", *[occurrences(p).cast("double").alias(f"f{i}") for p, i in order.items()])
        rows = written(counts.groupBy("id").agg(F.max("d").alias("d"), *[F.sum(f"f{i}").alias(f"f{i}") for i in order.values()]))
        state = self._state()
        stats = rows.agg(*[F.count_if(F.col(f"f{i}") > 0).cast("double").alias(f"n{i}") for i in order.values()])
        stats = stats.select("*", F.lit(float(state["notes"])).alias("n"), F.lit(float(state["tokens"])).alias("total"))
        return fts.ranked(rows, stats, queries, order, limit)


_OF_TABLES: dict[tuple[str, str], PostingsIndex] = {}


def index_of(notes: DataFrame, root: str) -> PostingsIndex:
    """The index of a table of files, built under ``root`` when a session first asks for it, and again only when its files change."""
    spark = notes.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files = []
    for f in sorted(notes.inputFiles()):
        at = jvm.org.apache.hadoop.fs.Path(f)
        status = at.getFileSystem(conf).getFileStatus(at)
        files.append(f"{f} {status.getLen()} {status.getModificationTime()}")
    key = (spark.sparkContext.applicationId, "\n".join(files))
    if key not in _OF_TABLES:
        _OF_TABLES[key] = PostingsIndex(spark, root).apply(notes)
    return _OF_TABLES[key]
