"""Near-duplicates: banded MinHash candidates, odd sketches to verify them, exact confirmation on full shingle sets.

1. One pass over whole texts gives each document's set of hashed 5-word shingles, its MinHash samples, their band keys and their
   odd sketch (each sample flips one bit; the population count of two sketches' XOR tells how many samples differ).
   Documents with equal sets form a class; from here on only classes take part, so copies cost nothing.
2. In every bucket of a band the class that meets most others is the hub and all others are paired with it. Pairs that the sketches
   find similar are confirmed on full sets, and confirmed links are joined into components. A group of thousands of near copies has
   thus a few pairs a class, not all of them. A second round does the same with random hubs in buckets that hold several components still.
3. What is left of those buckets is searched exhaustively for links between components. Small buckets compare their pairs by size and
   sketch. For classes of large buckets, which a common passage fills with dissimilar documents, a prefix filter over their full sets finds
   every pair that can be similar, by the places of the first common shingle and the sets' sizes. Both are confirmed like before. No bucket is capped.

With 40 bands of 4 rows two sets of similarity 0.75 share no band with probability 3e-7; a sketch says less than ``LENIENT`` for them
in none of 400 000 simulated pairs (5.5 standard errors). So a pair at the threshold is missed less often than once in 100 000 by both filters
together, and more similar ones less still. Full sets are rebuilt from the texts for the classes in question only.

A bucket that many classes share is dealt to several tasks: rows get a salt below ceil(size / ``HOT``), and the one row a
bucket that they are joined with is repeated for each salt. A very long text is hashed in blocks of words; its set (8 bytes a
shingle) is held whole.

Defined results: null and empty texts have no shingles and are linked with nothing; fewer than five words are one shingle; component_id
is the smallest non-null doc_id, a null doc_id sorts after all; repeated rows share a class; an empty table gives no rows; extra columns
pass through ``one_of_each``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm.common import once, text_of, trim
from seriesloom.llm.components import components
from seriesloom.plans.scratch import Scratch, small_batches

WORDS = 5
BANDS, ROWS = 40, 4
SAMPLES = BANDS * ROWS
#: Bits of an odd sketch, and the long columns that hold it.
BITS = 1024
PARTS = [f"s{i}" for i in range(BITS // 64)]
#: Estimated similarity from which a pair is confirmed on full sets.
LENIENT = 0.55
#: Rows of one bucket that a task gets in joins on it; larger buckets are dealt to several.
HOT = 256
#: Bytes of a text whose words are split at once.
BLOCK = 1 << 20
#: Classes up to which a bucket's pairs are compared one by one; classes of larger ones are joined by prefixes.
SMALL = 32
#: Shingles up to which a set goes along into the join by prefixes, to be compared there; pairs of longer ones are listed and confirmed later.
CARRIED = 1024
#: Classes in question (40 bytes each) up to which they are broadcast to the texts; beyond, both are shuffled.
BROADCAST_ROWS = 250_000

GAP = re.compile(rb"[ \t\n\x0b\x0c\r]")
_rng = np.random.Generator(np.random.PCG64(20240501))
_MUL = (_rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint64) | 1).astype(np.uint32)
_ADD = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32)
_PLACE = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_ORDER = _rng.integers(0, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    import xxhash

    raw = text.encode("utf-8", "surrogatepass").lower()  # of bytes: A-Z only, and below, ASCII white space only
    parts, few, lo = [], [], 0
    while lo < len(raw):
        gap = GAP.search(raw, lo + BLOCK) if len(raw) - lo > BLOCK else None
        hi = gap.start() if gap else len(raw)
        words = raw[lo:hi].split()
        parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
        few += words[: WORDS - len(few)] if len(few) < WORDS else []
        lo = hi
    if not few:
        return np.zeros(0, np.uint64)
    if len(few) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(few), seed=len(few))], np.uint64)
    h = np.concatenate(parts) if len(parts) > 1 else parts[0]
    n = len(h) - WORDS + 1
    with np.errstate(over="ignore"):
        acc = h[:n] * _ORDER[0]
        for j in range(1, WORDS):
            acc += h[j : j + n] * _ORDER[j]
    return np.unique(_mix(acc))


def samples(hashes: np.ndarray) -> np.ndarray:
    """MinHash samples of a set that is not empty."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 2048):
        v = x[lo : lo + 2048, None] * _MUL
        v += _ADD
        np.minimum(out, v.min(axis=0), out=out)
    return out


def band_keys(sample: np.ndarray) -> np.ndarray:
    rows = sample.astype(np.uint64).reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        key = _mix(key * np.uint64(31) + rows[:, j] + np.uint64(j + 1))
    return key.view(np.int64)


def odd_sketch(sample: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        at = (_mix(sample.astype(np.uint64) + _PLACE) % np.uint64(BITS)).astype(np.int64)
    bits = (np.bincount(at, minlength=BITS) & 1).astype(np.uint8)
    return np.packbits(bits, bitorder="little").view("<i8")


def estimate(differing_bits: Column) -> Column:
    """Similarity of two sets whose sketches differ in so many bits."""
    left = F.greatest(1 - 2 * differing_bits / F.lit(float(BITS)), F.lit(1e-9))
    return 1 + F.log(left) * (BITS / 4 / SAMPLES)


def _sizes_fit(a: str, b: str) -> Column:
    """Whether the set sizes of the rows aliased a and b allow for a link."""
    return 4 * F.least(f"{a}.n", f"{b}.n") >= 3 * F.greatest(f"{a}.n", f"{b}.n")


def _similar(a: str, b: str) -> Column:
    """Whether sizes and sketches of the rows aliased a and b allow for a link."""
    flips = sum((F.bit_count(F.col(f"{a}.{p}").bitwiseXOR(F.col(f"{b}.{p}"))) for p in PARTS), F.lit(0))
    return _sizes_fit(a, b) & (estimate(flips) >= LENIENT)


def _salts(size: str | Column) -> Column:
    """Into how many parts the rows of a bucket of this size are dealt."""
    return F.greatest(F.lit(1), F.ceil((F.col(size) if isinstance(size, str) else size) / HOT)).cast("int")


def _salted(rows: DataFrame, size: str = "size") -> DataFrame:
    """``rows`` (c, ...) with the part of their bucket that they are in."""
    return rows.withColumn("salt", F.pmod(F.xxhash64("c"), _salts(size)).cast("int"))


def _repeated(table: DataFrame, size: str = "size") -> DataFrame:
    """``table`` (one row a bucket) once for each part of the bucket."""
    return table.withColumn("salt", F.explode(F.sequence(F.lit(0), _salts(size) - 1)))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, cls, n, keys, s0...): the text's digest, class, set size, band keys and sketch of each document."""
    import xxhash

    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64()), *[pa.int64()] * len(PARTS)]
    names = ["doc_id", "digest", "cls", "n", "keys", *PARTS]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                cls, n, keys, sketch = [], [], [], []
                for text in part.column(2).to_pylist():
                    s = shingles(text)
                    cls.append(xxhash.xxh3_128_digest(s.tobytes()))
                    n.append(len(s))
                    m = samples(s) if len(s) else None
                    keys.append(band_keys(m) if len(s) else None)
                    sketch.append(odd_sketch(m) if len(s) else np.zeros(len(PARTS), np.int64))
                parts = [pa.array(c) for c in np.stack(sketch).T.copy()]
                columns = [part.column(0), part.column(1), pa.array(cls, pa.binary()), pa.array(n, pa.int64()), pa.array(keys, kinds[4]), *parts]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
        trim()

    rows = docs.select("doc_id", F.unhex(F.md5(text_of())).alias("digest"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, digest binary, cls binary, n bigint, keys array<bigint>, " + ", ".join(f"{p} bigint" for p in PARTS))


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(c, hashes) for the classes of ``wanted`` (c, cls, doc_id), a written table, rebuilt from the text of that document."""
    import xxhash

    schema = pa.schema([("c", pa.int64()), ("hashes", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                c, cls, texts = (part.column(i).to_pylist() for i in range(3))
                hit = [(i, s.view(np.int64)) for i, k, s in zip(c, cls, map(shingles, texts), strict=True) if xxhash.xxh3_128_digest(s.tobytes()) == k]
                if hit:
                    yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in hit], pa.int64()), pa.array([s for _, s in hit], schema.field(1).type)], schema=schema)
        trim()

    small = wanted.count() <= BROADCAST_ROWS
    wanted = wanted.select("c", "cls", F.col("doc_id").alias("__of"))
    texts = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(wanted) if small else wanted, F.col("doc_id").eqNullSafe(F.col("__of")))
    return texts.select("c", "cls", "text").mapInArrow(run, "c bigint, hashes array<bigint>").groupBy("c").agg(F.any_value("hashes").alias("hashes"))


class NearDuplicates:
    """Components of near-duplicate documents: ``rows`` has (doc_id, digest, cls, n), ``roots`` the root of each linked class."""

    def __init__(self, docs: DataFrame, scratch: Scratch):
        self.docs, self.scratch = docs, scratch
        with small_batches(docs.sparkSession):
            signed = scratch.keep(signatures(docs))
            self._solve(signed)

    def _solve(self, signed: DataFrame) -> None:
        scratch = self.scratch
        self.rows = signed.select("doc_id", "digest", "cls", "n")
        same = [F.any_value(c).alias(c) for c in ("n", "keys", *PARTS)]
        classes = signed.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), *same)
        # short names, given once as the table is written; they follow the hash of cls, so their order has nothing to do with texts
        classes = scratch.keep(classes.withColumn("c", F.monotonically_increasing_id()))
        self.classes = classes.drop("keys")
        exploded = classes.select("c", F.explode("keys").alias("key"))
        shared = scratch.keep(exploded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
        members = scratch.keep(self._sized(exploded, shared))
        # the hub is the class that meets most others: near the middle of its group
        score = members.groupBy("c").agg(F.sum("size").alias("score"))
        hubs = scratch.keep(members.join(score, "c").groupBy("key").agg(F.max_by("c", F.struct("score", "c")).alias("hub"), F.max("size").alias("size")))
        links = self._confirmed(self._filtered(self._in_bucket(members, hubs).where("c != hub").select("hub", "c")))
        self.roots = components(links, scratch)
        left = self._open(members.where("size > 2"), self.roots)
        scratch.drop(shared, hubs)
        if left.isEmpty():
            return
        hub = F.min_by(F.struct(F.col("c").alias("hub"), F.col("root").alias("hub_root")), F.xxhash64("c", "key"))
        hubs = scratch.keep(left.groupBy("key").agg(hub.alias("h"), F.max("size").alias("size")).select("key", "size", "h.*"))
        more = self._confirmed(self._filtered(self._in_bucket(left, hubs).where("root != hub_root").select("hub", "c")))
        links = links.union(more)
        self.roots = components(links, scratch)
        left = self._open(left.select("key", "c", "size"), self.roots)
        if left.isEmpty():
            return
        small, large = self._within_small(left.where(F.col("size") <= SMALL)), self._within_large(left.where(F.col("size") > SMALL))
        self.roots = components(links.union(self._confirmed(small.union(large).distinct())), scratch)

    @staticmethod
    def _in_bucket(members: DataFrame, table: DataFrame) -> DataFrame:
        """``members`` (key, c, size, ...) joined with the one row that the written ``table`` has for their bucket."""
        return _salted(members).join(_repeated(table).drop("size"), ["key", "salt"]).drop("salt")

    @staticmethod
    def _sized(exploded: DataFrame, shared: DataFrame) -> DataFrame:
        """(key, c, size) of the classes of shared buckets. Which buckets are large is told by a broadcast if those are few, else all are salted."""
        hot = shared.where(F.col("size") > HOT)
        if hot.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            known = exploded.join(F.broadcast(hot.withColumnRenamed("size", "large")), "key", "left").withColumn("large", F.coalesce("large", F.lit(1)))
            return _salted(known, "large").drop("large").join(_repeated(shared), ["key", "salt"]).drop("salt")
        wide = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
        return exploded.withColumn("salt", F.pmod(F.xxhash64("c"), F.lit(16)).cast("int")).join(wide, ["key", "salt"]).drop("salt")

    def _open(self, members: DataFrame, roots: DataFrame) -> DataFrame:
        """(key, c, size, root) of the buckets that hold several components."""
        placed = members.join(roots.select(F.col("node").alias("c"), "root"), "c", "left").withColumn("root", F.coalesce("root", "c"))
        placed = self.scratch.keep(placed.select("key", "c", "size", "root"))
        ends = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("size").alias("size"))
        several = self.scratch.keep(ends.where("lo != hi").select("key", "size"))
        return self.scratch.keep(self._in_bucket(placed, several))

    def _filtered(self, pairs: DataFrame) -> DataFrame:
        """Distinct pairs (hub, c) as (a, b), where sizes and sketches allow for a link."""
        sketches = self.classes.select("c", "n", *PARTS)
        x = pairs.distinct().join(sketches, "c").alias("y").join(sketches.withColumnRenamed("c", "hub").alias("x"), F.col("y.hub") == F.col("x.hub"))
        return x.where(_similar("x", "y")).select(F.col("x.hub").alias("a"), F.col("y.c").alias("b"))

    def _confirmed(self, pairs: DataFrame) -> DataFrame:
        """Pairs of classes (a, b) whose full sets have at least 0.75 of their union in common."""
        pairs = self.scratch.keep(pairs)
        ends = pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b").alias("c"))).distinct()
        wanted = self.scratch.keep(self.classes.select("c", "cls", "doc_id").join(ends, "c", "left_semi"))
        sets = self.scratch.keep(full_sets(self.docs, wanted))
        one = pairs.join(sets.select(F.col("c").alias("b"), F.col("hashes").alias("hb")), "b")
        both = one.join(sets.select(F.col("c").alias("a"), F.col("hashes").alias("ha")), "a")
        common = F.size(F.array_intersect("ha", "hb"))
        out = both.select("a", "b", common.alias("i"), (F.size("ha") + F.size("hb") - common).alias("u"))
        links = self.scratch.keep(out.where(100 * F.col("i").cast("long") >= 75 * F.col("u").cast("long")).select("a", "b"))
        self.scratch.drop(pairs, wanted, sets)
        return links

    def _within_small(self, left: DataFrame) -> DataFrame:
        """Similar pairs of different components within buckets of at most ``SMALL`` classes."""
        rows = self.scratch.keep(left.select("key", "c", "root").join(self.classes.select("c", "n", *PARTS), "c"))
        apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & (F.col("x.c") < F.col("y.c"))
        return rows.alias("x").join(rows.alias("y"), apart & _similar("x", "y")).select(F.col("x.c").alias("a"), F.col("y.c").alias("b")).distinct()

    def _within_large(self, left: DataFrame) -> DataFrame:
        """Similar pairs of different components among the classes of larger buckets, by prefixes of their full sets.

        With shingles ordered from rare to frequent, sets of similarity 0.75 have one in common among the first n - ceil(0.75 n) + 1 of
        each. What made the bucket large, a passage that many share, is frequent and so stands outside of the prefixes.
        """
        keep, drop = self.scratch.keep, self.scratch.drop
        names = keep(left.select("c", "root").distinct())
        if names.isEmpty():
            return self.docs.sparkSession.createDataFrame([], "a bigint, b bigint")
        sets = keep(full_sets(self.docs, keep(self.classes.select("c", "cls", "doc_id").join(names, "c", "left_semi"))))
        tokens = sets.select("c", F.explode("hashes").alias("h"))
        often = keep(tokens.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
        # shingles of one class alone come first in its order and match nothing: only their number counts
        shared = tokens.join(often, "h").groupBy("c").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("order"))
        n = F.col("n")
        first = F.greatest(F.lit(0), F.size("order") - F.ceil(n * 3 / 4) + 1).cast("int")  # the first n - ceil(0.75 n) + 1, less what is not shared
        rows = shared.join(self.classes.select("c", "n", *PARTS), "c").withColumn("first", first).where("first > 0")
        # what stands behind a shingle in its set's order, itself included, bounds what two sets have in common from there on
        rows = rows.withColumn("px", F.slice("order", F.lit(1), F.col("first"))).withColumn("total", F.size("order"))
        prefix = rows.select("c", "n", "total", *PARTS, F.col("px")["h"].alias("px"), F.posexplode("px").alias("at", "e"))
        prefix = prefix.select("c", "n", *PARTS, "px", (F.col("total") - F.col("at")).alias("rest"), "e.h")
        light = sets.where(F.size("hashes") <= CARRIED)
        prefix = keep(prefix.join(names, "c").join(light, "c", "left"))
        common = F.size(F.array_intersect("x.hashes", "y.hashes")).cast("long")
        linked = F.coalesce(100 * common >= 75 * (F.col("x.n") + F.col("y.n") - common), F.lit(True))  # unknown for longer sets: confirmed later
        at_first = F.get(F.array_intersect("x.px", "y.px"), 0) == F.col("x.h")  # each pair once, at the rarest shingle in common
        reach = 7 * F.least("x.rest", "y.rest") >= 3 * (F.col("x.n") + F.col("y.n"))  # from the first common shingle on: 0.75 / 1.75 of both sizes
        hit = F.when(~_sizes_fit("x", "y") | ~reach, False).when(~_similar("x", "y"), False).when(at_first, linked).otherwise(False)
        apart = (F.col("x.h") == F.col("y.h")) & (F.col("x.root") != F.col("y.root")) & (F.col("x.c") < F.col("y.c"))
        found = keep(prefix.alias("x").join(prefix.alias("y"), apart & hit).select(F.col("x.c").alias("a"), F.col("y.c").alias("b")).distinct())
        drop(sets, often, prefix)
        return found

    def of_class(self) -> DataFrame:
        """(cls, component_id) for classes that are not empty."""
        of = self.classes.select("c", "cls", "doc_id").join(self.roots.select(F.col("node").alias("c"), "root"), "c", "left")
        of = of.withColumn("root", F.coalesce("root", "c"))
        least = self.scratch.keep(of.groupBy("root").agg(F.min("doc_id").alias("component_id")))
        return self.scratch.keep(of.select("cls", "root").join(least, "root"))

    def verdicts(self) -> DataFrame:
        """Each document with the size of its set and its component; empty ones are their own."""
        full = self.rows.where("n > 0").join(self.of_class().select("cls", "component_id"), "cls").drop("cls")
        none = self.rows.where("n = 0").drop("cls").withColumn("component_id", F.col("doc_id"))
        return full.unionByName(none)


def one_of_each(docs: DataFrame, near: NearDuplicates) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest doc_id, then digest; and all without words."""
    full = near.rows.where("n > 0").join(near.of_class().select("cls", "root"), "cls")
    same = full.groupBy("root", "doc_id", "digest").agg(F.count(F.lit(1)).alias("c"))
    best = same.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "c")).alias("b"))
    stay = best.select(F.col("b.doc_id").alias("__of"), F.col("b.digest").alias("__digest"), F.col("b.c").alias("__copies"))
    own = docs.withColumn("__digest", F.unhex(F.md5(text_of())))
    hit = own.join(stay, "__digest").where(F.col("doc_id").eqNullSafe(F.col("__of")))
    empty = docs.where(~text_of().rlike(r"[^\x20\x09-\x0D]"))
    return once(hit, "__copies", ["__digest"]).select(*docs.columns).unionByName(empty)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of near-duplicates of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = NearDuplicates(docs, Scratch(spark, "op4")).verdicts()
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


#: All pairs that share a shingle, compared in full; for documents with their own doc_id.
OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
k AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 75 * (a.n + b.n - i)),
e AS (SELECT x, y FROM k UNION ALL SELECT y, x FROM k),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON c.x = d.doc_id
"""
