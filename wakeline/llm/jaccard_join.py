"""N-gram Jaccard join: documents whose sets of 5-word shingles overlap by three quarters or more.

Method: rare-first prefix filtering. Shingles are ordered by a whole-corpus
frequency sketch (then by hash), rarest first; two sets that reach the threshold
share a shingle of their prefixes, of a quarter of the larger set and a seventh of
the smaller. Candidates are met by an equi-join on prefix shingles, thinned by
the length filter, the positional filter (what can still follow the shared
shingle) and a suffix filter (sets differ in at least as many shingles as their
parity bitmaps of ``BITS`` bits differ in bits), and verified once per pair.

What is wanted is the classes that links make, so pairs inside a class that is
already known are not expanded. Exact copies join by fingerprint. Star rounds then
pair every member of a posting list with hubs of about its size, and verified
links give components; after the first, rounds take only lists that are still
mixed, and only pairs across components. The last round is exact: it pairs all
that share a prefix shingle and still lie in different components. A group of
copies thus costs a few pairs a member, and no link between different texts is
lost.

Order of size: postings are a quarter of the shingles; those in a single
document go in one grouped count and a semi-join. Hot shingles stay out of
prefixes, grouped minima combine map-side, and the joins are plain equi-joins
that Spark splits where a key is hot. The sketch and the filters of wanted ids
are arrays of bounded size (``MOST_BITS``); where they fill up the result is the
same and only more rows are read.

Defined results: a text of under five words has its whole sequence as its one
shingle; null and empty texts have an empty set and link with nothing; shingles
are equal where their 64-bit hashes are; rows that share a doc_id are one vertex,
each with its own ``n_shingles``; a null doc_id is linked with nothing.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import SALTS, SEPARATORS, discard, give_back, materialise, small_batches
from .components import connected

WORDS = 5
BITS = 1024
#: Of the id filters and of the frequency sketch (slots).
MOST_BITS, MOST_SLOTS = 27, 1 << 22
#: Slots of the sketch that are shipped and added together.
CHUNK = 1024
#: Rounds that pair the members of still mixed posting lists with hubs, and hubs a list in each.
ROUNDS, HUBS = 1, 3
#: Bytes hashed at a time.
SEGMENT = 1 << 19
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_SEPARATOR = np.isin(np.arange(256), list(SEPARATORS.encode()))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hasher:
    """64-bit hashes of the words in UTF-8 bytes, A-Z lower-cased.

    Every byte stands for a random number; a word's hash is the polynomial of its
    bytes, taken from running sums over a segment and moved to power 0.
    """

    def __init__(self) -> None:
        values = _mixed(np.arange(1, 257, dtype=np.uint64) * _PRIME)
        values[65:91] = values[97:123]
        self.values = values
        base = 0xD1342543DE82EF95
        inverse = pow(base, -1, 1 << 64)
        self.up, self.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(SEGMENT, np.uint64(b))]), dtype=np.uint64) for b in (base, inverse))

    def words(self, text: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of a segment, and each word's first byte; ``breaks`` are bytes at which a new text begins."""
        gap = _SEPARATOR[text]
        start = ~gap
        start[1:] &= gap[:-1]
        inside = breaks[breaks < len(text)]
        start[inside] |= ~gap[inside]
        first = np.flatnonzero(start)
        if not len(first):
            return np.empty(0, np.uint64), first
        # Separators count as nothing, so a word's sum may run up to the next word's first byte.
        terms = self.values[text] * self.up[: len(text)]
        terms[gap] = 0
        sums = np.add.reduceat(terms, first)
        return _mixed(sums * self.down[first]), first

    def texts(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """(position, word hashes) of every text of a string column, in order."""
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
        i = 0
        while i < len(column):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SEGMENT, "right")) - 1)
            a, b = int(offsets[i]), int(offsets[j])
            if b - a <= SEGMENT:
                h, first = self.words(data[a:b], offsets[i : j + 1] - a)
                cuts = np.searchsorted(first, offsets[i : j + 1] - a)
                for k in range(i, j):
                    yield k, h[cuts[k - i] : cuts[k - i + 1]]
            else:
                yield i, self._long(data[a:b])
            i = j

    def _long(self, text: np.ndarray) -> np.ndarray:
        """Word hashes of a text of more than a segment, cut where words end."""
        parts, a = [], 0
        while a < len(text):
            b = min(len(text), a + SEGMENT)
            if b < len(text):
                gaps = np.flatnonzero(_SEPARATOR[text[a:b]])
                if len(gaps):
                    b = a + int(gaps[-1]) + 1
                else:  # one word of more than a segment
                    ends = np.flatnonzero(_SEPARATOR[text[b:]])
                    b = b + int(ends[0]) if len(ends) else len(text)
                    parts.append(np.array([int.from_bytes(hashlib.sha256(bytes(text[a:b]).lower()).digest()[:8], "little")], np.uint64))
                    a = b
                    continue
            parts.append(self.words(text[a:b], np.zeros(1, np.int64))[0])
            a = b
        return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def _shingles(w: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of a text's words."""
    if not len(w):
        return w
    size = min(WORDS, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        h = h * _PRIME + w[k : len(w) - size + 1 + k]
    h = np.sort(_mixed(h))
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def shingles(column: pa.Array, hasher: _Hasher) -> Iterator[tuple[int, np.ndarray]]:
    """(position, sorted distinct shingle hashes) of every text."""
    for i, w in hasher.texts(column):
        yield i, _shingles(w)


def _bit(ids: np.ndarray, bits: int) -> np.ndarray:
    return (_mixed(ids.astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


class _Ids:
    """A bounded set of bits: ids it does not have are certainly not wanted."""

    def __init__(self, ids: DataFrame, n: int):
        self.bits = bits = max(10, min(MOST_BITS, math.ceil(math.log2(8 * n + 1))))

        def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bit = _bit(batch.column(0).to_numpy(), bits)
                yield pa.RecordBatch.from_arrays([pa.array(bit >> 6), pa.array(np.left_shift(1, bit & 63))], names=["word", "mask"])

        marked = ids.mapInArrow(marks, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
        self.words = np.zeros(1 << max(0, bits - 6), np.int64)
        self.words[marked.column("word").to_numpy()] = marked.column("mask").to_numpy()

    def has(self, ids: np.ndarray) -> np.ndarray:
        bit = _bit(ids, self.bits)
        return (self.words[bit >> 6] >> (bit & 63)) & 1 == 1

    def keep(self, df: DataFrame) -> DataFrame:
        """The rows of ``df`` whose first column may be wanted: a cheap sieve before a join."""
        shipped = df.sparkSession.sparkContext.broadcast(self)

        def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(shipped.value.has(batch.column(0).to_numpy())))

        return df.mapInArrow(sieve, df.schema)


def _ceil(a: Column, times: int, by: int) -> Column:
    return F.floor((times * a + (by - 1)) / by)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _profiles(docs: DataFrame, slot_bits: int) -> DataFrame:
    """One row a document: set size, 128-bit fingerprint, parity bitmap; and rows (chunk, times) of a partition's shingle counts."""
    ddl = "doc_id long, n int, f1 long, f2 long, odd array<long>, chunk long, times binary"
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("f1", pa.int64()), ("f2", pa.int64()), ("odd", pa.list_(pa.int64())), ("chunk", pa.int64()), ("times", pa.binary())])

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hasher, times = _Hasher(), np.zeros(1 << slot_bits, np.int64)
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            slots: list[np.ndarray] = []
            for _, h in shingles(batch.column(1), hasher):
                digest = xxhash.xxh3_128_digest(h.tobytes())
                for column, value in zip(rows, (len(h), int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), np.packbits(np.bincount((h >> np.uint64(20)).astype(np.int64) % BITS, minlength=BITS) & 1).view(np.int64)), strict=True):
                    column.append(value)
                slots.append((h >> np.uint64(64 - slot_bits)).astype(np.int64))
            times += np.bincount(np.concatenate(slots), minlength=len(times)) if slots else 0
            none = [pa.nulls(len(rows[0]), t) for t in schema.types[5:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(r, t) for r, t in zip(rows, schema.types[1:5], strict=True)], *none], schema=schema)
        for k in range(0, len(times), CHUNK):
            if times[k : k + CHUNK].any():
                yield pa.RecordBatch.from_arrays([*[pa.nulls(1, t) for t in schema.types[:5]], pa.array([k // CHUNK]), pa.array([times[k : k + CHUNK].tobytes()])], schema=schema)
        give_back()

    return _texts(docs).mapInArrow(profile, ddl)


def _levels(chunks: DataFrame, slot_bits: int) -> np.ndarray:
    """How often each slot's shingles occur, in eighths of a doubling, from the partitions' counts."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, times in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[k] = np.frombuffer(times.as_buffer(), np.int64) + total.get(k, 0)
        levels = [(np.log2(np.maximum(t, 1)) * 8).astype(np.int16).tobytes() for t in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(levels, pa.binary())], names=["chunk", "level"])

    summed = chunks.repartition("chunk").mapInArrow(add, "chunk long, level binary").toArrow()
    level = np.zeros(1 << slot_bits, np.int16)
    for k, part in zip(summed.column("chunk").to_pylist(), summed.column("level"), strict=True):
        level[k * CHUNK : (k + 1) * CHUNK] = np.frombuffer(part.as_buffer(), np.int16)
    return level


def _wanted(batch: pa.RecordBatch, wanted: _Ids, hasher: _Hasher) -> Iterator[tuple[int, np.ndarray]]:
    """(position, shingles) of the wanted rows of a batch (id, text)."""
    at = np.flatnonzero(wanted.has(batch.column(0).to_numpy(zero_copy_only=False)))
    for k, h in shingles(batch.column(1).take(pa.array(at)), hasher):
        yield int(at[k]), h


def _postings(docs: DataFrame, wanted: _Ids, level: np.ndarray) -> DataFrame:
    """(h, doc, n, place): the prefix shingles of the wanted documents, ``place`` counted from the rarest."""
    shipped = docs.sparkSession.sparkContext.broadcast((wanted, level))
    schema = pa.schema([("h", pa.int64()), ("doc", pa.int64()), ("n", pa.int32()), ("place", pa.int32())])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, level = shipped.value
        bits, hasher = int(math.log2(len(level))), _Hasher()
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            hs, docs_, ns, places, held = [], [], [], [], 0
            for i, h in _wanted(batch, wanted, hasher):
                n = len(h)
                if not n:
                    continue
                order = np.argsort(level[(h >> np.uint64(64 - bits)).astype(np.int64)], kind="stable")
                prefix = h[order[: n - (3 * n + 3) // 4 + 1]].view(np.int64)
                hs.append(prefix)
                docs_.append(np.full(len(prefix), ids[i]))
                ns.append(np.full(len(prefix), n, np.int32))
                places.append(np.arange(len(prefix), dtype=np.int32))
                held += len(prefix)
                if held > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (hs, docs_, ns, places)], schema=schema)
                    hs, docs_, ns, places, held = [], [], [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (hs, docs_, ns, places)], schema=schema)
        give_back()

    return _texts(docs).mapInArrow(post, "h long, doc long, n int, place int")


def _sets(docs: DataFrame, wanted: _Ids) -> DataFrame:
    """(doc, shingles): the whole sets of the wanted documents, as sorted 64-bit integers."""
    shipped = docs.sparkSession.sparkContext.broadcast(wanted)
    schema = pa.schema([("doc", pa.int64()), ("shingles", pa.binary())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher()
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            ids_, sets, held = [], [], 0
            for i, h in _wanted(batch, shipped.value, hasher):
                ids_.append(ids[i])
                sets.append(h.tobytes())
                held += len(sets[-1])
                if held > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(ids_, pa.int64()), pa.array(sets, pa.binary())], schema=schema)
                    ids_, sets, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids_, pa.int64()), pa.array(sets, pa.binary())], schema=schema)
        give_back()

    return _texts(docs).mapInArrow(build, "doc long, shingles binary")


def _possible(x: str, y: str) -> Column:
    """Length and positional filters for a shared prefix shingle, each side with ``n`` and ``place``."""
    nx, ny = F.col(f"{x}n"), F.col(f"{y}n")
    left = F.least(nx - F.col(f"{x}place"), ny - F.col(f"{y}place"))
    return (4 * F.least(nx, ny) >= 3 * F.greatest(nx, ny)) & (left >= _ceil(nx + ny, 3, 7))


def _near(nx: str, ny: str, odd_x: str, odd_y: str) -> Column:
    """Suffix filter: no more bits differ than shingles may."""
    total = F.col(nx) + F.col(ny)
    differ = F.aggregate(F.zip_with(odd_x, odd_y, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return differ <= total - 2 * _ceil(total, 3, 7)


def _verify(docs: DataFrame, pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """The pairs (a, b) of candidates that reach the threshold: suffix filter, then the sets themselves."""
    part = lambda side: profiles.select(F.col("doc_id").alias(side), F.col("n").alias(f"n{side}"), F.col("odd").alias(f"odd{side}"))
    pairs = pairs.join(part("a"), "a").join(part("b"), "b").where(_near("na", "nb", "odda", "oddb")).select("a", "b").distinct()
    pairs = materialise(pairs, "candidates")
    ids = materialise(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "candidate-ids")
    sets = _sets(docs, _Ids(ids, ids.count()))
    both = pairs.join(sets.select(F.col("doc").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("doc").alias("b"), F.col("shingles").alias("sb")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(100 * shared >= 75 * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long").distinct()


def _ordered(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _star(postings: DataFrame, turn: int) -> DataFrame:
    """Pairs of each posting with one hub of its shingle and about its size; postings of one ``root`` are not paired."""
    banded = postings.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / math.log(1.2) + turn / 2).cast("int"))
    hub = banded.groupBy("h", "band").agg(F.min(F.struct(F.xxhash64("doc", F.lit(turn)).alias("by"), "doc", "n", "place", "root")).alias("hub"))
    hub = hub.select("h", "band", *[F.col(f"hub.{c}").alias(f"hub_{c}") for c in ("doc", "n", "place", "root")])
    met = banded.join(hub, ["h", "band"]).where((F.col("root") != F.col("hub_root")) & _possible("", "hub_"))
    return met.select(*_ordered(F.col("doc"), F.col("hub_doc"))).distinct()


def _mixed_lists(postings: DataFrame, roots: DataFrame) -> DataFrame:
    """The postings of lists that hold more than one component, with ``root`` and ``top``, the list's largest component."""
    own = postings.drop("root", "top").join(roots.select(F.col("v").alias("doc"), "root"), "doc", "left").withColumn("root", F.coalesce("root", "doc"))
    own = materialise(own, "rooted")
    lists = own.groupBy("h", "root").agg(F.count("*").alias("m")).groupBy("h").agg(F.count("*").alias("k"), F.max(F.struct("m", "root")).alias("t"))
    return materialise(own.join(lists.where("k > 1").select("h", F.col("t.root").alias("top")), "h"), "mixed")


def _across(mixed: DataFrame) -> DataFrame:
    """All pairs that share a prefix shingle, may reach the threshold and lie in different components.

    One side at least of such a pair is outside its list's largest component.
    """
    columns = ("doc", "n", "place", "root", "odd")
    x = mixed.where("root <> top").select("h", *[F.col(c).alias(f"x_{c}") for c in columns])
    y = mixed.select("h", *[F.col(c).alias(f"y_{c}") for c in columns])
    indexed = lambda s: F.col(f"{s}place") <= F.col(f"{s}n") - _ceil(F.col(f"{s}n"), 6, 7)
    smaller = F.when(F.col("x_n") < F.col("y_n"), indexed("x_")).otherwise(indexed("y_"))
    met = x.join(y, "h").where(smaller & (F.col("x_root") != F.col("y_root")) & _possible("x_", "y_") & _near("x_n", "y_n", "x_odd", "y_odd"))
    return met.select(*_ordered(F.col("x_doc"), F.col("y_doc"))).distinct()


def link_components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n) of every row, and (v, root) of every document that links to a smaller one."""
    small_batches(docs.sparkSession)
    slot_bits = max(12, min(int(math.log2(MOST_SLOTS)), math.ceil(math.log2(docs.count() + 1))))
    found = materialise(_profiles(docs, slot_bits), "profiles")
    profiles = found.where("chunk is null").drop("chunk", "times")
    level = _levels(found.where("chunk is not null").select("chunk", "times"), slot_bits)

    full = profiles.where("n > 0 and doc_id is not null")
    classes = full.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("m"))
    # Classes of several rows stand on every salt, so that the copies of one are dealt over SALTS tasks.
    salted = classes.where("m > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).drop("m")
    keyed = full.select("n", "f1", "f2", "doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    copies = keyed.join(salted, ["n", "f1", "f2", "salt"]).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()
    copies = materialise(copies, "copies")
    reps = materialise(classes.select(F.col("rep").alias("id")).distinct(), "representatives")
    prefixes = materialise(_postings(docs, _Ids(reps, reps.count()), level), "prefixes")
    shared = materialise(prefixes.groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select("h"), "shared")
    postings = materialise(_Ids(shared, shared.count()).keep(prefixes).join(shared, "h").withColumn("root", F.col("doc")), "postings")
    discard(prefixes, shared, reps)

    first = _verify(docs, _star(postings, 0).unionByName(_star(postings, 1)).distinct(), full)
    roots = connected(copies.unionByName(first))
    mixed = _mixed_lists(postings, roots)
    discard(postings)
    for turn in range(ROUNDS):
        pairs = _star(mixed, 2 + HUBS * turn)
        for more in range(1, HUBS):
            pairs = pairs.unionByName(_star(mixed, 2 + HUBS * turn + more))
        linked = materialise(_verify(docs, pairs.distinct(), full), "links")
        if linked.isEmpty():
            break
        roots = connected(roots.select(F.col("v").alias("a"), F.col("root").alias("b")).unionByName(linked))
        mixed = _mixed_lists(mixed, roots)
    odd = full.select(F.col("doc_id").alias("doc"), F.col("n").alias("n"), "odd")
    rest = _verify(docs, _across(mixed.join(odd, ["doc", "n"])), full)
    joined = connected(roots.select(F.col("v").alias("a"), F.col("root").alias("b")).unionByName(rest))
    discard(mixed)
    return profiles.select("doc_id", "n"), joined


def component_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs``."""
    rows, roots = link_components(docs)
    joined = rows.join(roots, rows["doc_id"] == roots["v"], "left")
    return joined.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))


def _vertices(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_v``: the doc_id, or, where an id has several texts, numbers of (doc_id, text) in the order of ids."""
    marked = docs.where("doc_id is not null").withColumns({"_h1": F.xxhash64("text"), "_h2": F.xxhash64(F.lit(1), "text")})
    text = F.struct("_h1", "_h2")
    if marked.groupBy("doc_id").agg(F.min(text).alias("a"), F.max(text).alias("b")).where("a <> b").isEmpty():
        return marked.withColumn("_v", F.col("doc_id").cast("long")).drop("_h1", "_h2")
    keys = ["doc_id", "_h1", "_h2"]
    each = marked.select(*keys).distinct().orderBy(*keys)
    numbers = each.rdd.zipWithIndex().map(lambda x: (*x[0], x[1]))
    numbers = docs.sparkSession.createDataFrame(numbers, StructType([*each.schema.fields, StructField("_v", LongType())]))
    return marked.join(materialise(numbers, "vertices"), keys).drop("_h1", "_h2")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest id, and one row of it. Null ids are kept.

    Texts that share an id are documents of their own.
    """
    rows = _vertices(docs)
    roots = link_components(rows.select(F.col("_v").alias("doc_id"), "text"))[1]
    kept = rows.join(roots.select(F.col("v").alias("_w")), F.col("_v") == F.col("_w"), "left_anti")
    same = Window.partitionBy("_v").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    single = kept.withColumn("_turn", F.row_number().over(same)).where("_turn = 1").select(*[f"`{c}`" for c in docs.columns])
    return single.unionByName(docs.where("doc_id is null"))
