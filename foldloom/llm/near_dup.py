"""MinHash near-deduplication with order: Order MinHash and banded alignment.

The k-mers of a text are its runs of five words, each labelled with its occurrence number. A sketch takes the
``picked`` labelled k-mers with the least hashes and keeps them in text order; two texts are candidates if one of the
``sketches`` tuples is equal, unless exact bounds on their common k-mers rule the threshold out. A pair with m aligned
of u k-mers in all is missed with probability (1 - C(m, 6) / C(u, 6)) ^ 32 at most: at similarity 0.8 six times in
100,000 for long texts, 21 times for 28 of 35. Texts of at most ``EXACT`` k-mers, for which that would be more, are
candidates without chance: of a k-mers a similar text has at least 0.8 a, so two similar texts share one of the
a - 0.8 a + 1 k-mers of each with the least hashes. A candidate pair is verified by aligning the two sequences of labelled k-mers: matches
off the band that the threshold allows can't belong to a sufficient alignment, and as no label occurs twice in a text,
the best alignment in the band is a longest increasing subsequence. m aligned of a and b k-mers make a similarity of
m / (a + b - m).

No pair of a bucket is skipped unless its two texts are in one class already, and no bucket is expanded into all its
pairs first: equal texts are one text; then everything in a bucket is compared with its leading text; what that leaves
outside the leading text's class is compared, a growing number of texts at a time, with all of the bucket that is in
other classes by then. Before any text is read, a parity bound rules pairs out: each text has ``64 * WORDS`` bits, one
flipped for each labelled k-mer, so two texts differ in at least as many k-mers as in bits. Classes are connected components, found by label spreading over stored tables.

Defined results: a text without words (null, empty) is a class of its own; texts of under five words are linked if
their words are equal; a null id joins the class of an equal text, else its class is null; rows that share an id
share its links.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldloom.llm.common import BASES, Rolling, keyed, mixed, remove, row_chunks, staged, text_buffer, tidy, word_bounds, word_hashes

SHINGLE = 5
#: Texts that may have a rare k-mer in common; rare k-mers of a text that are listed with it.
RARE, LISTED = 8, 32
#: Pairs of texts of at most so many k-mers are found by a prefix filter, not by sketches.
EXACT = 32
#: 64-bit words of a text's parity.
WORDS = 8
#: Pairs that one copy of a leading text serves.
SERVED = 256
#: How fast the number of texts of a bucket grows that are compared with the rest of it in a round.
GROWTH = 8


PARITY = [f"p{k}" for k in range(WORDS)]


def labelled_hashes(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the labelled k-mers of all rows in text order, and their n+1 offsets."""
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.flatnonzero(row[:n] == row[SHINGLE - 1 :])
    kmer = Rolling(words, BASES[1])(at, at + SHINGLE)
    order = np.lexsort((at, kmer, row[at]))
    new = np.r_[True, (kmer[order][1:] != kmer[order][:-1]) | (row[at][order][1:] != row[at][order][:-1])]
    count = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    occurrence = np.empty(len(order), np.uint64)
    occurrence[order] = count
    return mixed(kmer + occurrence * np.uint64(BASES[2])), np.searchsorted(row[at], np.arange(len(bounds)))


def sketch(labels: np.ndarray, sketches: int, picked: int) -> np.ndarray:
    """One key for each sketch: a hash of the picked k-mers in text order.

    The labels are mixed already, so an odd factor orders them anew. Only those under a bound that about four times
    ``picked`` of them keep are sorted; a sketch that the bound leaves too few of sorts all.
    """
    n, take = len(labels), min(picked, len(labels))
    seeds = mixed(np.arange(1, sketches + 1, dtype=np.uint64) * np.uint64(BASES[0])) | np.uint64(1)
    keys = mixed(seeds)
    bound = np.uint64(min((1 << 64) - 1, (1 << 64) * 4 * picked // n))
    for i in range(0, sketches, step := max(1, 2_000_000 // n)):
        rank = labels[None, :] * seeds[i : i + step, None]
        row, at = np.nonzero(rank < bound) if n > 8 * picked else (None, None)
        if row is None or (count := np.bincount(row, minlength=len(rank))).min() < take:
            least = np.argpartition(rank, take - 1, axis=1)[:, :take]
        else:
            order = np.lexsort((rank[row, at], row))
            first = np.cumsum(count) - count
            least = at[order][first[:, None] + np.arange(take)]
        least.sort(axis=1)
        key = keys[i : i + step]
        for k in range(take):
            key = mixed(key * np.uint64(BASES[1]) + labels[least[:, k]])
        keys[i : i + step] = key
    return keys


def prefix(labels: np.ndarray, least: float) -> np.ndarray:
    """Keys of the least labels of a text: any two texts that are similar enough share one."""
    n = len(labels)
    return mixed(np.sort(labels)[: n - math.ceil(least * n - 1e-9) + 1] ^ np.uint64(BASES[2]))


def keys_of(labels: np.ndarray, sketches: int, picked: int, least: float) -> np.ndarray:
    """Keys of a text's buckets. Sketches are only for texts that a similar text of over ``EXACT`` k-mers may have."""
    keys = [prefix(labels, least)] if 0 < len(labels) <= EXACT else []
    if len(labels) > EXACT * least + 1e-9:
        keys.append(sketch(labels, sketches, picked))
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *keys]))


def parity(labels: np.ndarray) -> np.ndarray:
    """One bit for each residue of the labels: whether an odd number of them has it."""
    return np.packbits((np.bincount((labels % np.uint64(64 * WORDS)).astype(np.int64), minlength=64 * WORDS) & 1).astype(np.uint8)).view(np.int64)


def alike(least: float, n: str, m: str) -> Column:
    """Whether two texts of ``n`` and ``m`` k-mers (parities p0, ... and x0, ...) may be similar enough, by their parities."""
    apart = reduce(add, (F.bit_count(F.col(f"p{k}").bitwiseXOR(F.col(f"x{k}"))) for k in range(WORDS)))
    return apart <= F.lit((1 - least) / (1 + least)) * (F.col(n) + F.col(m)) + F.lit(1e-6)


def similarity(one: bytes, other: bytes, least: float) -> float:
    """Similarity by banded alignment, 0 where it can't reach ``least``."""
    a, b = one.split(), other.split()
    if len(a) < SHINGLE or len(b) < SHINGLE:
        return float(bool(a) and a == b)
    n, m = len(a) - SHINGLE + 1, len(b) - SHINGLE + 1
    need = least * (n + m) / (1 + least) - 1e-9
    if min(n, m) < need:
        return 0.0
    band = n + m - 2 * need
    place, seen = {}, {}
    for i, gram in enumerate(zip(*(a[k:] for k in range(SHINGLE)), strict=False)):
        k = seen[gram] = seen.get(gram, -1) + 1
        place[gram, k] = i
    seen, met = {}, []
    for j, gram in enumerate(zip(*(b[k:] for k in range(SHINGLE)), strict=False)):
        k = seen[gram] = seen.get(gram, -1) + 1
        i = place.get((gram, k))
        if i is not None and abs(i - j) <= band:
            met.append(i)
    if len(met) < need:
        return 0.0
    tails: list[int] = []
    for i in met:
        if not tails or i > tails[-1]:
            tails.append(i)
        else:
            tails[bisect_left(tails, i)] = i
    return len(tails) / (n + m - len(tails)) if len(tails) >= need else 0.0


def sketches_of(df: DataFrame, sketches: int, picked: int, least: float) -> DataFrame:
    """doc_id, digest of the words (null without words), number of k-mers, keys, parity words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            for i, j in row_chunks(offsets):
                part = raw[offsets[i] : offsets[j]]
                at = offsets[i : j + 1] - offsets[i]
                starts, ends, bounds = word_bounds(part, at)
                labels, cut = labelled_hashes(word_hashes(part, starts, ends), bounds)
                digests, keys, bits = [], [], []
                for k in range(j - i):
                    words = part[at[k] : at[k + 1]].tobytes().split()
                    digests.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None)
                    mine = labels[cut[k] : cut[k + 1]]
                    keys.append(keys_of(mine, sketches, picked, least).view(np.int64))
                    bits.append(parity(mine))
                bands = pa.ListArray.from_arrays(np.cumsum([0, *map(len, keys)]).astype(np.int32), np.concatenate(keys))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(digests, pa.binary()), pa.array(np.diff(cut).astype(np.int32)), bands, *map(pa.array, np.stack(bits).T)], ["doc_id", "digest", "n", "keys", *PARITY])

    return df.mapInArrow(run, "doc_id long, digest binary, n int, keys array<long>, " + ", ".join(f"{p} long" for p in PARITY))


def kmers_of(texts: DataFrame) -> DataFrame:
    """doc, label: the labelled k-mers of each text (a label occurs once in a text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j in row_chunks(offsets):
                starts, ends, bounds = word_bounds(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                labels, cut = labelled_hashes(word_hashes(raw[offsets[i] : offsets[j]], starts, ends), bounds)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[i:j], np.diff(cut)), pa.int64()), pa.array(labels.view(np.int64))], ["doc", "label"])

    return texts.mapInArrow(run, "doc long, label long")


def rarities(kmers: DataFrame) -> DataFrame:
    """doc, alone (k-mers that no other text has), rare (those that at most RARE texts have, null if over LISTED)."""
    spread = kmers.groupBy("label").agg(F.count("*").alias("df"), F.min("doc").alias("doc"))
    alone = spread.filter("df = 1").groupBy("doc").agg(F.count("*").alias("alone"))
    few = kmers.join(spread.filter(F.col("df").between(2, RARE)).select("label"), "label")
    many = few.groupBy("doc").agg(F.count("*").alias("n_rare"))
    lists = few.join(many.filter(F.col("n_rare") <= LISTED).select("doc"), "doc", "left_semi").groupBy("doc").agg(F.collect_list("label").alias("rare"))
    few = many.join(lists, "doc", "left").select("doc", "rare", F.lit(True).alias("some"))
    met = alone.join(few, "doc", "full")
    return met.select("doc", F.coalesce("alone", F.lit(0)).alias("alone"), F.when(F.col("some").isNull(), F.array().cast("array<bigint>")).otherwise(F.col("rare")).alias("rare"))


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts are similar. A text that is ``a`` in many pairs is copied once for about
    ``SERVED`` of them, so that they can go to many tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(k).to_pylist() for k in range(4))
            good = [similarity(s.encode(), t.encode(), least) >= least for s, t in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, g in zip(a, good, strict=True) if g], pa.int64()), pa.array([i for i, g in zip(b, good, strict=True) if g], pa.int64())], ["a", "b"])

    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / SERVED).alias("shares"))
    dealt = pairs.join(shares, "a").select("a", "b", F.pmod(F.xxhash64("b"), "shares").alias("share"))
    copies = shares.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"))
    left = copies.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), "a")
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y"))
    return dealt.join(right, "b").join(left, ["a", "share"]).select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components(links: DataFrame, folder: str) -> DataFrame:
    """doc, comp (the least id it is connected with) of everything that has a link; each round is stored."""
    both = staged(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{folder}/both")
    labels = staged(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).select(F.col("a").alias("doc"), "comp"), f"{folder}/labels-0")
    turn = 0
    while True:
        turn += 1
        near = both.join(labels.select(F.col("doc").alias("b"), F.col("comp").alias("other")), "b").groupBy(F.col("a").alias("doc")).agg(F.min("other").alias("other"))
        spread = labels.join(near, "doc").select("doc", F.least("comp", "other").alias("next"), F.col("comp").alias("was"))
        jump = labels.select(F.col("doc").alias("next"), F.col("comp").alias("further"))
        new = spread.join(jump, "next", "left").select("doc", F.least("next", "further").alias("comp"), "was")
        new = staged(new, f"{folder}/labels-{turn}")
        labels = new.select("doc", "comp")
        if not new.filter("comp != was").limit(1).count():
            return labels


def merged(labels: DataFrame, links: DataFrame, folder: str) -> DataFrame:
    """``labels`` (doc, comp) with the components that ``links`` connect made one."""
    of = lambda name: labels.select(F.col("doc").alias(name), F.col("comp").alias(f"c{name}"))
    between = links.join(of("a"), "a").join(of("b"), "b").filter("ca != cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
    moved = components(between, folder).select(F.col("doc").alias("comp"), F.col("comp").alias("to"))
    return staged(labels.join(moved, "comp", "left").select("doc", F.coalesce("to", "comp").alias("comp")), f"{folder}/merged")


def near_duplicates(df: DataFrame, folder: str, least: float = 0.8, sketches: int = 32, picked: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``class_id`` (the least id of its class) of every row. ``folder``: shared, for stored steps."""
    spark = df.sparkSession
    docs = keyed(df, id_col, text_col)
    kept, folder = folder, f"{folder}/steps"
    sketched = staged(sketches_of(docs, sketches, picked, least), f"{kept}/sketched")
    tidy(spark)
    worded = sketched.filter("digest IS NOT NULL")
    texts_of = worded.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc"), F.min_by(F.struct("n", "keys", *PARITY), "doc_id").alias("s"))
    firsts = staged(texts_of.select("digest", "doc", "s.*"), f"{folder}/firsts")
    rows = firsts.select("doc", "n", F.explode("keys").alias("key"))
    sizes = rows.groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count("*").alias("size")).filter("low != high").select("key", "size")
    shared = staged(rows.join(sizes, "key"), f"{folder}/shared")
    # The text in the largest buckets leads: of copies of one text it is the least edited.
    ranked = shared.join(shared.groupBy("doc").agg(F.sum("size").alias("weight")), "doc").select("key", "doc", "n", "weight")
    leads = ranked.groupBy("key").agg(F.max(F.struct("weight", (-F.col("doc")).alias("d"), "n")).alias("m")).select("key", (-F.col("m.d")).alias("lead"), F.col("m.n").alias("lead_n"))
    buckets = staged(ranked.join(leads, "key"), f"{folder}/buckets")
    tidy(spark)
    members = staged(buckets.select("doc").distinct(), f"{folder}/members")
    texts = staged(docs.join(members.select(F.col("doc").alias("doc_id")), "doc_id", "left_semi"), f"{folder}/texts")
    # Texts whose numbers of k-mers differ too much can't be similar enough.
    sized = lambda m, n: F.least(F.col(m), F.col(n)) >= F.lit(least) * F.greatest(F.col(m), F.col(n))
    pairs = buckets.filter((F.col("doc") != F.col("lead")) & sized("n", "lead_n")).select(F.col("lead").alias("a"), F.col("doc").alias("b")).distinct()
    bits = lambda name, as_: firsts.select(F.col("doc").alias(name), F.col("n").alias(f"n_{name}"), *(F.col(p).alias(f"{as_}{k}") for k, p in enumerate(PARITY)))
    near = pairs.join(bits("b", "p"), "b").join(bits("a", "x"), "a").filter(alike(least, "n_a", "n_b"))
    tested = staged(near.select("a", "b"), f"{folder}/pairs-0")
    links = staged(verified(tested, texts, least), f"{folder}/links-0")
    tidy(spark)
    labels = merged(members.select("doc", F.col("doc").alias("comp")), links, f"{folder}/round-0")
    here = buckets.join(labels, "doc")
    split = here.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max(F.when(F.col("doc") == F.col("lead"), F.col("comp"))).alias("home")).filter("low != high").select("key", "home")
    open_ = staged(here.join(split, "key").filter("doc != lead").select("key", "doc", "n", "weight", "comp", "home"), f"{folder}/open")
    # A place for each text outside the class of its lead, drawn by a hash from as many as the largest bucket has: no
    # bucket is sorted or counted in one task. In a smaller bucket the first places are empty, and few are drawn first.
    outside = open_.filter("comp != home").select("key", "doc")
    drawn = F.pmod(F.xxhash64("key", "doc"), F.lit(1 << 32)) / (1 << 32)
    most = outside.groupBy("key").count().agg(F.max("count")).first()[0] or 0
    rest = outside.select("key", "doc", (F.floor(drawn * most) + 1).alias("rank"))
    # What two texts can align: no k-mer that one of them has alone, and of the rare ones only those that both have.
    kmers = staged(kmers_of(texts.join(open_.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi")), f"{folder}/kmers")
    none = F.array().cast("array<bigint>")
    rest = open_.select("key", "doc", "n").join(rest, ["key", "doc"], "left").join(rarities(kmers).withColumn("told", F.lit(True)), "doc", "left")
    rest = rest.withColumns({"shared": F.col("n") - F.coalesce("alone", F.lit(0)), "rare": F.when(F.col("told").isNull(), none).otherwise(F.col("rare"))})
    rest = rest.filter(F.col("shared") >= F.lit(least - 1e-9) * F.col("n")).join(firsts.select("doc", "keys", *PARITY), "doc")
    rest = staged(rest.withColumn("common", F.col("shared") - F.size("rare")).drop("alone", "told"), f"{folder}/rest")
    loose = F.least("shared", "xshared")
    tight = F.least("common", "xcommon") + F.size(F.array_intersect("rare", "xrare"))
    enough = lambda: F.coalesce(tight, loose) >= F.lit(least / (1 + least) - 1e-9) * (F.col("n") + F.col("xn"))
    # Of the buckets that two texts share the one with the least key brings them together.
    once = F.array_min(F.array_intersect("keys", "xkeys")) == F.col("key")
    turn, low = 0, 1
    while low <= most:
        turn += 1
        high = low * GROWTH - 1
        now = rest.join(labels, "doc")
        leaders = now.filter(F.col("rank").between(low, high)).select("key", F.col("doc").alias("x"), F.col("n").alias("xn"), F.col("shared").alias("xshared"), F.col("common").alias("xcommon"), F.col("rare").alias("xrare"), F.col("keys").alias("xkeys"), F.col("rank").alias("r"), F.col("comp").alias("c"), *(F.col(p).alias(f"x{k}") for k, p in enumerate(PARITY)))
        fresh = now.join(leaders, "key").filter((F.col("comp") != F.col("c")) & (F.col("rank").isNull() | (F.struct("rank", "doc") > F.struct("r", "x"))) & sized("n", "xn") & alike(least, "n", "xn") & enough() & once)
        fresh = fresh.select(F.least("x", "doc").alias("a"), F.greatest("x", "doc").alias("b")).join(tested, ["a", "b"], "left_anti")
        pairs = staged(fresh, f"{folder}/pairs-{turn}")
        found = staged(verified(pairs, texts, least), f"{folder}/links-{turn}")
        if found.limit(1).count():
            labels = merged(labels, found, f"{folder}/round-{turn}")
        tidy(spark)
        low = high + 1
    classes = firsts.select("digest", "doc").join(labels, "doc", "left").select("digest", F.coalesce("comp", "doc").alias("class_id"))
    classes = staged(classes, f"{kept}/classes")
    remove(spark, folder)
    tidy(spark)
    placed = worded.select("doc_id", "digest").join(classes, "digest", "left").select("doc_id", "class_id")
    return placed.unionByName(sketched.filter("digest IS NULL").select("doc_id", F.col("doc_id").alias("class_id")))
