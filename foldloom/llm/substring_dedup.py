"""Substring deduplication with a log-structured fingerprint index.

A window is ``WINDOW`` consecutive words. Of the hashes of its runs of ``GRAM`` words the least is its fingerprint, so
equal windows have the same one, and neighbouring windows share it: about one word in seven starts a stored
fingerprint. Stored with it is a hash of its whole surroundings (all words of the windows it may stand for).

The index is a list of runs, each an immutable table bucketed and sorted by fingerprint. A batch of documents (all
with greater ids than the documents before) is merge-joined with the runs, bucket by bucket, without dealing the runs
out again; only the history rows whose fingerprint the batch has go on. Then

* a fingerprint with surroundings that occurred before: all its windows are repeats. Surroundings are told by 64 bits
  of digests of their words and the fingerprint by other 64; words are told by a cryptographic digest;
* a fingerprint that occurred before in other surroundings: its windows are verified one by one by a 128-bit
  cryptographic digest of their words, read from the stored texts of the batches that hold such documents.

The batch becomes a new run; ``fanout`` runs of one level are compacted into one of the next. Repeats within a task are
settled there as far as they occur twice in one chunk of it, so a hot passage sends about one row a task. After each
batch a manifest names the runs and texts, from which a later session opens the index (``FingerprintIndex.open``).

Defined results: null or empty text has no words; fewer than ``WINDOW`` words have no window; every row is a document
of its own, rows that share an id in the order of their texts; a null id is the smallest.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldloom.llm.common import BASES, Rolling, keyed, numbered, partitions, remove, row_chunks, staged, text_buffer, tidy, word_bounds, word_digests

WINDOW, GRAM = 20, 8
#: Runs of GRAM words in a window.
SPREAD = WINDOW - GRAM + 1
#: Hot keys that a task keeps in mind.
KEPT = 50_000
TEXTS, RUN = "doc_id bigint, text string", "a bigint, c bigint, doc_id bigint, pos int, kind int"


def _sliding(x: np.ndarray, pick: np.ufunc) -> np.ndarray:
    """pick over each SPREAD neighbours."""
    size = 1
    while 2 * size <= SPREAD:
        x, size = pick(x[:-size], x[size:]), 2 * size
    rest = SPREAD - size
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(words: np.ndarray, others: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint, hash of the surroundings, row and place in the row (in words) of every chosen run of words, from the
    two halves of the words' digests."""
    n = len(words)
    if n < WINDOW:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.arange(n - GRAM + 1)
    gram = np.maximum(Rolling(words, BASES[1])(at, at + GRAM), np.uint64(1))
    least = _sliding(gram, np.minimum)
    least[row[: len(least)] != row[WINDOW - 1 :]] = 0
    padded = np.concatenate([np.zeros(SPREAD - 1, np.uint64), least, np.zeros(SPREAD - 1, np.uint64)])
    chosen = np.flatnonzero(_sliding(padded, np.maximum)[: len(gram)] == gram)
    begin, stop = bounds[row[chosen]], bounds[row[chosen] + 1]
    low, high = np.maximum(begin, chosen - SPREAD + 1), np.minimum(stop, chosen + WINDOW)
    around = Rolling(others, BASES[2])(low, high) + (chosen - low).astype(np.uint64)
    return gram[chosen], around, row[chosen], chosen - begin


def _later(keys: list[np.ndarray], docs: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Rows whose keys occur in this chunk at an earlier place."""
    order = np.lexsort((places, docs, *reversed(keys)))
    same = np.ones(len(order), bool)
    for k in keys:
        same &= np.r_[False, k[order][1:] == k[order][:-1]]
    first = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    out = np.zeros(len(order), bool)
    out[order] = (docs[order] != docs[first]) | (places[order] != places[first])
    return out


class Seen:
    """Tells later occurrences of keys from the first, in a chunk and, of keys that one chunk has twice, in all chunks
    of a task. An occurrence is only called later if an earlier one was passed on."""

    def __init__(self) -> None:
        #: Hot keys in the order of ``mixed``: both halves, and the earliest document and place so far.
        self.one = self.two = self.doc = self.place = np.zeros(0, np.int64)
        self.mixed = np.zeros(0, np.uint64)

    def later(self, one: np.ndarray, two: np.ndarray, docs: np.ndarray, places: np.ndarray) -> np.ndarray:
        out = _later([one, two], docs, places)
        one, two = one.view(np.int64), two.view(np.int64)
        mixed = one.view(np.uint64) ^ (two.view(np.uint64) * np.uint64(BASES[0]))
        known = np.zeros(len(out), bool)
        if len(self.mixed):
            at = np.minimum(np.searchsorted(self.mixed, mixed), len(self.mixed) - 1)
            known = ~out & (self.one[at] == one) & (self.two[at] == two)
            mine = np.flatnonzero(known)
            k = at[mine]
            after = (docs[mine] > self.doc[k]) | ((docs[mine] == self.doc[k]) & (places[mine] > self.place[k]))
            out[mine[after]] = True
            self.doc[k[~after]], self.place[k[~after]] = docs[mine[~after]], places[mine[~after]]
        if len(self.mixed) < KEPT and out.any():
            new = np.flatnonzero(~out & ~known & np.isin(mixed, np.unique(mixed[out]), kind="sort"))[: KEPT - len(self.mixed)]
            if len(new):
                joined = np.r_[self.mixed, mixed[new]]
                order = np.argsort(joined, kind="stable")
                self.mixed = joined[order]
                for name, x in (("one", one), ("two", two), ("doc", docs), ("place", places)):
                    setattr(self, name, np.r_[getattr(self, name), x[new]].astype(np.int64)[order])
        return out


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = Seen()
    for batch in batches:
        raw, offsets = text_buffer(batch.column(1))
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for i, j in row_chunks(offsets):
            part = raw[offsets[i] : offsets[j]]
            starts, ends, bounds = word_bounds(part, offsets[i : j + 1] - offsets[i])
            print_, around, row, place = anchors(*word_digests(part, starts, ends), bounds)
            doc = ids[i:j][row]
            dup = seen.later(print_, around, doc, place)
            yield pa.RecordBatch.from_arrays([pa.array(print_.view(np.int64)), pa.array(around.view(np.int64)), pa.array(doc, pa.int64()), pa.array(place.astype(np.int32)), pa.array(dup)], ["a", "c", "doc_id", "pos", "dup"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of all windows that the given fingerprints may stand for."""
    seen = Seen()
    for batch in batches:
        ids, texts, places = (batch.column(k).to_pylist() for k in range(3))
        digests, docs, starts = [], [], []

        def out() -> pa.RecordBatch:
            pair = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            one, two = np.ascontiguousarray(pair[:, 0]), np.ascontiguousarray(pair[:, 1])
            d, s = np.array(docs, np.int64), np.array(starts, np.int32)
            dup = seen.later(one, two, d, s)
            return pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(d), pa.array(s), pa.array(dup)], ["w1", "w2", "doc_id", "start", "dup"])

        for doc, text, at in zip(ids, texts, places, strict=True):
            words = text.encode().split()
            for s in sorted({s for p in at for s in range(max(0, p - SPREAD + 1), min(p, len(words) - WINDOW) + 1)}):
                digests.append(hashlib.blake2b(b" ".join(words[s : s + WINDOW]), digest_size=16).digest())
                docs.append(doc)
                starts.append(s)
                if len(docs) > 50_000:
                    yield out()
                    digests, docs, starts = [], [], []
        if docs:
            yield out()


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text, covers in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            words = (text or "").encode().split()
            n = len(words)
            if covers:
                steps = np.zeros(n + 1, np.int64)
                low = np.minimum([c["low"] for c in covers], n)
                high = np.minimum([c["high"] for c in covers], n)
                np.add.at(steps, low, 1)
                np.add.at(steps, high, -1)
                words = list(itertools.compress(words, (np.cumsum(steps[:n]) == 0).tolist()))
            rows.append((doc, n, n - len(words), b" ".join(words).decode()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_words", "n_removed", "kept"])


class FingerprintIndex:
    """Runs of fingerprints and the texts behind them, in the shared folder. Their tables are only in the catalog while
    the index is open."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None, fanout: int = 4):
        self.spark, self.folder, self.fanout = spark, folder, fanout
        self.buckets = buckets or partitions(spark)
        self.runs: list[tuple[int, str]] = []
        #: Name, least and greatest document of each batch.
        self.texts: list[tuple[str, int, int]] = []
        self.version = 0

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> FingerprintIndex:
        """The index that an earlier session left in the folder."""
        root = spark._jvm.org.apache.hadoop.fs.Path(folder)
        done = root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest-*/_SUCCESS"))
        versions = sorted(int(f.getPath().getParent().getName().split("-")[1]) for f in done)
        state = json.loads(spark.read.text(f"{folder}/manifest-{versions[-1]}").first().value)
        index = cls(spark, folder, state["buckets"], state["fanout"])
        index.version = versions[-1]
        index.runs, index.texts = [tuple(r) for r in state["runs"]], [tuple(t) for t in state["texts"]]
        for name, columns, key in [*((n, RUN, "a") for _, n in index.runs), *((t[0], TEXTS, "doc_id") for t in index.texts)]:
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {index.buckets} BUCKETS LOCATION '{folder}/{name}'")
        return index

    def close(self) -> None:
        """Take the tables out of the catalog; their files stay."""
        for name in [*(n for _, n in self.runs), *(t[0] for t in self.texts)]:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _record(self) -> None:
        """A new manifest, complete before the one before goes."""
        self.version += 1
        state = json.dumps({"buckets": self.buckets, "fanout": self.fanout, "runs": self.runs, "texts": self.texts})
        self.spark.createDataFrame([(state,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/manifest-{self.version}")
        remove(self.spark, f"{self.folder}/manifest-{self.version - 1}")

    def _store(self, df: DataFrame, key: str) -> str:
        """An immutable table of one sorted file a bucket."""
        name = f"foldloom_{uuid.uuid4().hex}"
        dealt = df.repartition(self.buckets, key).sortWithinPartitions(key)
        dealt.write.bucketBy(self.buckets, key).sortBy(key).option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        remove(self.spark, f"{self.folder}/{name}")

    def history(self) -> list[DataFrame]:
        """First occurrences in each run."""
        return [self.spark.table(name).filter("kind < 2").select("a", "c", "doc_id", "pos") for _, name in self.runs]

    def add(self, docs: DataFrame) -> DataFrame:
        """Deduplicate a batch (doc_id, unique and never null, and text) against the index and itself, then make it part
        of the index. Returns doc_id, n_words, n_removed, kept (the kept words, joined by one blank)."""
        spark, tag = self.spark, uuid.uuid4().hex
        name = self._store(docs, "doc_id")
        texts = spark.table(name)
        ends = texts.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
        self.texts.append((name, *((0, -1) if ends.low is None else (ends.low, ends.high))))
        prints = staged(texts.mapInArrow(_fingerprints, "a long, c long, doc_id long, pos int, dup boolean"), f"{self.folder}/prints-{tag}")
        fresh = prints.filter("NOT dup").select("a", "c", "doc_id", "pos", F.lit(False).alias("old"))
        for run in self.history():
            met = run.join(fresh.select("a"), "a", "left_semi")
            fresh = fresh.unionByName(met.withColumn("old", F.lit(True)))
        place = Window.partitionBy("a", "c").orderBy("doc_id", "pos")
        alike = Window.partitionBy("a")
        judged = fresh.repartition(self.buckets, "a").select(
            "*", ((F.col("doc_id") == F.first("doc_id").over(place)) & (F.col("pos") == F.first("pos").over(place))).alias("first"),
            (F.min("c").over(alike) != F.max("c").over(alike)).alias("open"),
        )
        kind = F.when(~F.col("first"), 2).when(F.col("old"), F.when(F.col("open"), 3)).when(F.col("open"), 1).otherwise(0)
        run = self._store(judged.select("a", "c", "doc_id", "pos", kind.alias("kind")).filter("kind IS NOT NULL"), "a")
        tidy(spark)
        table = spark.table(run)
        need = table.filter("kind IN (1, 3)").groupBy("doc_id").agg(F.collect_list("pos").alias("at"))
        read = lambda name: spark.table(name).join(need, "doc_id").select("doc_id", "text", "at").mapInArrow(_windows, "w1 long, w2 long, doc_id long, start int, dup boolean")
        # Only the texts of batches that hold such documents are read.
        hit = need.agg(*(F.count_if(F.col("doc_id").between(low, high)).alias(f"n{k}") for k, (_, low, high) in enumerate(self.texts))).first()
        read_from = [k for k in range(len(self.texts)) if hit[f"n{k}"]] or [len(self.texts) - 1]
        windows = [staged(read(self.texts[k][0]), f"{self.folder}/windows-{tag}-{k}") for k in read_from]
        every = windows[0]
        for w in windows[1:]:
            every = every.unionByName(w)
        earliest = Window.partitionBy("w1", "w2").orderBy("doc_id", "start")
        seen = every.filter("NOT dup").withColumn("first", (F.col("doc_id") == F.first("doc_id").over(earliest)) & (F.col("start") == F.first("start").over(earliest)))
        later = seen.filter("NOT first").select("doc_id", "start").unionByName(every.filter("dup").select("doc_id", "start"))
        around = prints.filter("dup").select("doc_id", "pos").unionByName(table.filter("kind = 2").select("doc_id", "pos"))
        covers = later.select("doc_id", F.col("start").alias("low"), (F.col("start") + WINDOW).alias("high")).unionByName(
            around.select("doc_id", F.greatest(F.col("pos") - (SPREAD - 1), F.lit(0)).alias("low"), (F.col("pos") + WINDOW).alias("high")))
        covers = staged(covers.groupBy("doc_id").agg(F.collect_set(F.struct("low", "high")).alias("covers")), f"{self.folder}/covers-{tag}")
        for path in (f"{self.folder}/prints-{tag}", *(f"{self.folder}/windows-{tag}-{k}" for k in read_from)):
            remove(spark, path)
        self.runs.append((0, run))
        self._compact()
        self._record()
        tidy(spark)
        joined = texts.join(covers, "doc_id", "left").select("doc_id", "text", "covers")
        return joined.mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept string")

    def forget(self) -> None:
        """Drop the runs; results that were returned only need the files of the texts."""
        for _, name in self.runs:
            self._drop(name)
        self.runs = []
        self.close()

    def _compact(self) -> None:
        """Merge ``fanout`` runs of one level; of equal fingerprints in equal surroundings the first stays."""
        level = 0
        while len(same := [name for k, name in self.runs if k == level]) >= self.fanout:
            merged = None
            for name in same:
                part = self.spark.table(name).filter("kind < 2")
                merged = part if merged is None else merged.unionByName(part)
            best = merged.groupBy("a", "c").agg(F.min(F.struct("doc_id", "pos")).alias("m")).select("a", "c", "m.doc_id", "m.pos", F.lit(0).alias("kind"))
            self.runs.append((level + 1, self._store(best, "a")))
            self.runs = [(k, name) for k, name in self.runs if k != level]
            for name in same:
                self._drop(name)
            level += 1


def dedup(df: DataFrame, folder: str, batches: int = 3, fanout: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A whole table through the index, in batches of ascending id: a row of results for each row."""
    spark = df.sparkSession
    rows, by_id = numbered(keyed(df, id_col, text_col), f"{folder}/rows")
    docs = rows.select(F.col("row_number").alias("doc_id"), "text")
    cuts = docs.select(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000).alias("q")).first().q if batches > 1 else []
    edges = [None, *sorted(set(cuts or [])), None]
    index, out = FingerprintIndex(spark, folder, fanout=fanout), None
    for low, high in zip(edges, edges[1:], strict=False):
        batch = docs
        if low is not None:
            batch = batch.filter(F.col("doc_id") > low)
        if high is not None:
            batch = batch.filter(F.col("doc_id") <= high)
        done = index.add(batch)
        out = done if out is None else out.unionByName(done)
    index.forget()
    if by_id:
        return out
    named = out.withColumnRenamed("doc_id", "row_number").join(rows.select("row_number", "doc_id"), "row_number")
    return named.select("doc_id", "n_words", "n_removed", "kept")


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, s, array_to_string(ws[s : s + 19], ' ') AS k FROM w, unnest(range(1, len(ws) - 18)) AS u(s)),
f AS (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM g),
c AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(s, s + 20)) AS p FROM f WHERE r > 1)),
l AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
k AS (SELECT l.doc_id, count(c.p) AS gone, string_agg(l.word, ' ' ORDER BY l.p) FILTER (c.p IS NULL) AS kept FROM l LEFT JOIN c ON c.doc_id = l.doc_id AND c.p = l.p GROUP BY l.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id"""
