"""Near-duplicate groups by fast similarity sketching.

Sketch (Dahlgaard, Knudsen, Thorup 2017) of a set with t = 128 coordinates:
in round i < t every element is hashed to one coordinate and a value, in round
t + j every element goes to coordinate j.  A coordinate keeps the least
(round, value) that reached it, so after 2t rounds every coordinate is filled,
and for two sets each coordinate agrees with probability equal to their
similarity.

1. ``tokenized``: every row's word sequence is hashed; exact copies become
   one class with the smallest id as representative (pre-aggregated).
2. Representatives are sketched; bands of 4 coordinates give 32 bucket keys.
   At 0.85 a pair shares no bucket with probability below 1e-10, at 0.8 below
   1e-7.
3. Each bucket links its members to one pivot, another one in every band.
   Links are confirmed on the full shingle sets.
4. Connected components of the links.  In a bucket that still holds several
   components, the pairs of members from different components are compared
   inside tasks: members are dealt to blocks of bounded size, so no task holds
   a whole bucket; a pair is looked at in the first bucket that it shares;
   sketches that agree in too few coordinates (6 standard deviations below the
   threshold) set it aside, else the full sets decide.  Only links that join
   components leave a task, so rows stay in proportion.  Nothing is capped.

Cases: words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z.  With fewer words
than a shingle, the whole sequence is the one shingle; a null or wordless text
is an empty set and linked with nothing, not even with other empty texts.
Repeated rows of an id share their component and each get a row; with
different texts under one id all of them belong to the id.  Rows with a null
id are returned with a null component and are not compared.  Extra columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenledger.llm import arrow_text as at
from tokenledger.session import checkpoint_root, scratch_path

COORDS = 128
BAND = 4
BLOCK_SHINGLES = 2_000_000
SALTS = 16
FILTER_BITS = 26


def shingle_sets(texts: pa.LargeStringArray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): the distinct shingle hashes of each text, sorted."""
    offsets, values = at.words(texts, at.LOWER_SPACED)
    h = at.word_hashes(values)
    count = np.diff(offsets)
    short = (count > 0) & (count < words)
    n_shingles = np.where(short, 1, np.maximum(count - words + 1, 0))
    # a shingle is a chained hash of its words; the length is in the seed
    pad = np.concatenate([h, np.zeros(words, np.uint64)])
    chain = np.full(len(h), words, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words):
            chain = at.mix(chain * np.uint64(0x9E3779B97F4A7C15) + pad[k:k + len(h)])
    row = at.row_of(offsets)
    place = np.arange(len(h)) - offsets[:-1][row]
    keep = place < n_shingles[row]
    chain, row = chain[keep], row[keep]
    begin = np.concatenate(([0], np.cumsum(n_shingles)))
    for r in np.flatnonzero(short):
        x = np.uint64(count[r])
        with np.errstate(over="ignore"):
            for w in h[offsets[r]:offsets[r + 1]]:
                x = at.mix(np.array([x * np.uint64(0x9E3779B97F4A7C15) + w], np.uint64))[0]
        chain[begin[r]] = x
    order = np.lexsort((chain, row))
    chain, row = chain[order], row[order]
    new = np.ones(len(chain), bool)
    new[1:] = (chain[1:] != chain[:-1]) | (row[1:] != row[:-1])
    chain, row = chain[new], row[new]
    return np.searchsorted(row, np.arange(len(texts) + 1)), chain


def sketch(offsets: np.ndarray, elements: np.ndarray, coords: int = COORDS) -> np.ndarray:
    """(sets, coords) matrix of 32-bit coordinates; empty sets give zeros."""
    n = len(offsets) - 1
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    best = np.full(n * coords, none, np.uint64)
    row = at.row_of(offsets)
    x = elements
    bits = np.uint64(coords.bit_length() - 1)
    for i in range(2 * coords):
        if not len(x):
            break
        with np.errstate(over="ignore"):
            h = at.mix(x + np.uint64(i + 1) * np.uint64(0xD1B54A32D192ED03))
        if i < coords:
            at_bin = (h & np.uint64(coords - 1)).astype(np.int64)
        else:
            at_bin = np.full(len(x), i - coords)
        value = (np.uint64(i) << np.uint64(54)) | (h >> np.uint64(10))
        slot = row * coords + at_bin
        np.minimum.at(best, slot, value)
        # sets with every coordinate filled take no further round
        full = (best.reshape(n, coords) != none).all(1)
        on = ~full[row]
        x, row = x[on], row[on]
    out = (at.mix(best) >> np.uint64(32)).astype(np.uint32).reshape(n, coords)
    out[np.diff(offsets) == 0] = 0
    return out


def band_keys(sk: np.ndarray, band: int = BAND) -> np.ndarray:
    """(sets, bands) bucket keys."""
    bands = sk.shape[1] // band
    key = np.tile(np.arange(bands, dtype=np.uint64) + np.uint64(1), (len(sk), 1))
    with np.errstate(over="ignore"):
        for k in range(band):
            key = at.mix(key * np.uint64(0x9E3779B97F4A7C15) + sk[:, k:bands * band:band].astype(np.uint64))
    return (key & ~np.uint64(63)) | np.arange(bands, dtype=np.uint64)  # the band number stays readable


def _sketch_rows(docs: DataFrame, shingle: int) -> DataFrame:
    """id, n (set size), whole (hash of the shingle set), sk (sketch bytes)."""
    def run(batches):
        for batch in at.slices(batches, "t"):
            offsets, sets = shingle_sets(at.texts_of(batch.column("t")), shingle)
            sk = sketch(offsets, sets)
            n = np.diff(offsets)
            whole = [np.frombuffer(_digest(sets[offsets[k]:offsets[k + 1]]), np.int64) for k in range(len(n))]
            whole = np.array(whole, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(whole[:, 0]), pa.array(whole[:, 1]),
                 pa.array([s.tobytes() for s in sk], pa.binary())], ["id", "n", "w1", "w2", "sk"])
    return docs.mapInArrow(run, "id long, n long, w1 long, w2 long, sk binary")


def _digest(values: np.ndarray) -> bytes:
    import xxhash
    return xxhash.xxh3_128_digest(values.tobytes())


def _bands(sketched: DataFrame) -> DataFrame:
    """(key, id) for every band of every sketch."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sk = np.frombuffer(b"".join(batch.column("sk").to_pylist()), np.uint32).reshape(batch.num_rows, COORDS)
            keys = band_keys(sk)
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(ids, keys.shape[1]))], ["key", "id"])
    return sketched.select("id", "sk").mapInArrow(run, "key long, id long")


def _id_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of hashed ids, 16 bits an id up to ``FILTER_BITS`` in all, so
    its size is bounded. It lets through every given id and few others (more
    of them once the bound is reached; joins remove them)."""
    bits = 1 << min(FILTER_BITS, max(17, (16 * ids.count()).bit_length()))

    def places(batches):
        for batch in batches:
            h = at.mix(batch.column("id").to_numpy(zero_copy_only=False).astype(np.uint64)) & np.uint64(bits - 1)
            h = np.unique(h.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(h >> 16), pa.array(h & 0xFFFF)], ["part", "bit"])

    def pack(table: pa.Table) -> pa.Table:
        own = np.zeros(1 << 16, bool)
        own[table.column("bit").to_numpy()] = True
        return pa.table({"part": table.column("part")[:1], "b": [np.packbits(own).tobytes()]})

    parts = (ids.select("id").mapInArrow(places, "part long, bit long").distinct()
             .groupBy("part").applyInArrow(pack, "part long, b binary").collect())
    out = np.zeros(bits >> 3, np.uint8)
    for r in parts:
        out[r.part << 13:(r.part + 1) << 13] = np.frombuffer(r.b, np.uint8)
    return out


def _passes(ids: pa.Array, bitmap: np.ndarray) -> np.ndarray:
    """Which ids the bitmap lets through; null never."""
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    h = at.mix(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64)) & np.uint64(8 * len(bitmap) - 1)
    return known & ((bitmap[(h >> np.uint64(3)).astype(np.int64)] >> (7 - (h & np.uint64(7)))) & 1).astype(bool)


def without(docs: DataFrame, gone: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is not among the ids ``gone`` (null ids
    stay).  Rows that the bitmap of ``gone`` does not let through are kept as
    they are; only the others are joined, so most texts are never shuffled."""
    gone = gone.select(F.col(doc_id).cast("long").alias("id"))
    shared = docs.sparkSession.sparkContext.broadcast(_id_filter(gone))
    kind = docs.schema[doc_id].dataType

    def part(through: bool):
        def run(batches):
            for batch in batches:
                hit = _passes(batch.column(doc_id).cast(pa.int64()), shared.value)
                yield batch.filter(pa.array(hit if through else ~hit))
        return docs.mapInArrow(run, docs.schema)

    sure = part(False)
    # the same kind of join at every size
    rest = part(True).join(gone.select(F.col("id").cast(kind).alias(doc_id)).distinct().hint("merge"), doc_id, "left_anti")
    return sure.union(rest.select(*docs.columns))


def _sets(docs: DataFrame, shingle: int, wanted: DataFrame) -> DataFrame:
    """(id, s): the sorted shingle hashes of the wanted documents and a few
    others. Texts are read, not shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(_id_filter(wanted))

    def run(batches):
        bitmap = shared.value
        for batch in batches:
            for part in at.slices([batch.filter(pa.array(_passes(batch.column("id"), bitmap)))], "t"):
                offsets, sets = shingle_sets(at.texts_of(part.column("t")), shingle)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([sets[offsets[k]:offsets[k + 1]].tobytes()
                                                  for k in range(len(offsets) - 1)], pa.binary())], ["id", "s"])
    return docs.mapInArrow(run, "id long, s binary")


def _confirmed(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold.  Only documents
    that occur in a pair are turned into sets and shuffled."""
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    sets = _sets(docs, shingle, wanted)
    both = (pairs.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
            .join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a"))

    def run(batches):
        for batch in batches:
            sa, sb = batch.column("sa"), batch.column("sb")
            keep = []
            for k in range(batch.num_rows):
                x = np.frombuffer(sa[k].as_py(), np.uint64)
                y = np.frombuffer(sb[k].as_py(), np.uint64)
                small, large = (x, y) if len(x) < len(y) else (y, x)
                if not len(small) or 100 * len(small) < percent * len(large):
                    keep.append(False)
                    continue
                at_ = np.minimum(np.searchsorted(large, small), len(large) - 1)
                common = int((large[at_] == small).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id of each connected component, for the ids
    on edges (a, b).  Alternating large-star and small-star steps; each is a
    pair of pre-aggregated groupings, and the table is written after each
    round, so no lineage grows and nothing meets on the driver but a count."""
    edges = _stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                    .distinct(), "edges")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"))
        # small star: a node and its smaller neighbours go to their least
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low2.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        after = _stored(small, "edges")
        same = (after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
                == edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        edges = after
        if same:
            break
    return (edges.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "id")
            .union(edges.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct()))


def _remaining_links(members: DataFrame, reps: DataFrame, labels: DataFrame, docs: DataFrame, shingle: int,
                     percent: int) -> DataFrame:
    """Links between different components that share a bucket: enough of them
    to connect all components that any such pair connects.

    Every pair is looked at once, in the first bucket that it shares, if its
    sketches agree well enough; the full sets decide."""
    rate = percent / 100
    least = max(0.0, rate - 6 * (rate * (1 - rate) / COORDS) ** 0.5)
    named = (members.join(labels, "id", "left").join(reps.select("id", "n"), "id")
             .select("key", "id", "n", F.coalesce("label", "id").alias("label")))
    open_ = (named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("k"),
                                      F.sum("n").alias("total"))
             .where("lo <> hi and k > 2")  # two members are compared by the pivot already
             .select("key", F.ceil(F.col("total") / BLOCK_SHINGLES).cast("int").alias("blocks")))
    rows = _stored(named.join(open_, "key").withColumn("own", F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int")),
                   "open")
    wanted = rows.select("id").distinct()
    sets = _sets(docs, shingle, wanted).join(reps.select("id", "sk"), "id")
    # each pair of blocks is one group; a member goes to all pairs of its block
    dealt = (rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(sets, "id")
             .select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"),
                     "own", "id", "label", "sk", "s"))

    def compare(table: pa.Table) -> pa.Table:
        return pa.table(dict(zip("ab", linked_pairs(table, least, percent))), pa.schema(
            [("a", pa.int64()), ("b", pa.int64())]))

    return dealt.groupBy("key", "p", "q").applyInArrow(compare, "a long, b long").distinct()


def linked_pairs(table: pa.Table, least: float, percent: int) -> tuple[list[int], list[int]]:
    ids, label, own = (table.column(c).to_numpy() for c in ("id", "label", "own"))
    key, p, q = (table.column(c)[0].as_py() for c in ("key", "p", "q"))
    band = key & 63
    n = len(ids)
    sk = np.frombuffer(b"".join(table.column("sk").to_pylist()), np.uint32).reshape(n, COORDS)
    sets = [np.frombuffer(x, np.uint64) for x in table.column("s").to_pylist()]
    size = np.array([len(x) for x in sets])
    begin = np.concatenate(([0], np.cumsum(size)))
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(int(code.max(initial=0)) + 1, np.int64)
    _, group = np.unique(label, return_inverse=True)
    parent = np.arange(group.max() + 1)
    out: tuple[list[int], list[int]] = ([], [])
    side = np.flatnonzero(own == q)
    for i in np.flatnonzero(own == p):
        others = side[side > i] if p == q else side
        others = others[parent[group[others]] != parent[group[i]]]
        same = sk[others] == sk[i]
        near = same.mean(1) >= least
        if band:
            near &= ~same[:, :band * BAND].reshape(len(others), band, BAND).all(2).any(1)
        others = others[near]
        if not len(others):
            continue
        mark[code[begin[i]:begin[i + 1]]] = 1
        total = np.concatenate(([0], np.cumsum(mark[code[gather(begin[others], size[others])]])))
        ends = np.cumsum(size[others])
        common = total[ends] - total[ends - size[others]]
        mark[code[begin[i]:begin[i + 1]]] = 0
        for j in others[100 * common >= percent * (size[i] + size[others] - common)]:
            a, b = parent[group[i]], parent[group[j]]
            if a != b:
                out[0].append(int(min(ids[i], ids[j])))
                out[1].append(int(max(ids[i], ids[j])))
                parent[parent == b] = a
    return out


def gather(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions start .. start + size - 1 of every pair, joined (sizes over 0)."""
    step = np.ones(int(size.sum()), np.int64)
    step[0] = start[0]
    step[np.cumsum(size)[:-1]] = start[1:] - start[:-1] - size[:-1] + 1
    return np.cumsum(step)


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                    shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``.

    ``percent``: pairs with 100 * common >= percent * union are linked.
    component_id is the smallest doc_id reachable by links (the id itself
    without any); kept marks doc_id = component_id.
    """
    spark = docs.sparkSession
    checkpoint_root(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t"))
    all_rows = _stored(_sketch_rows(rows, shingle), "sketches")
    # exact classes: equal shingle sets; the smallest id stands for them
    known = all_rows.where("n > 0 and id is not null")
    classes = _stored(known.groupBy("w1", "w2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("size")), "classes")
    one = _stored(known.join(classes.select(F.col("rep").alias("id"), "w1", "w2", "n"), ["id", "w1", "w2", "n"],
                             "left_semi").select("id", "n", "sk").distinct(), "reps")
    members = _bands(one)
    buckets = members.groupBy("key").agg(
        F.min_by("id", F.struct(F.xxhash64("key", "id"), F.col("id"))).alias("pivot"),
        F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("key", "pivot")
    shared = _stored(members.join(buckets, "key"), "buckets")
    pairs = _stored(shared.where("id <> pivot")
                    .select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct(), "pairs")
    texts = rows.where("id is not null")
    links = _stored(_confirmed(pairs, texts, shingle, percent), "links")
    labels = _stored(components(links), "labels")
    more = _remaining_links(shared.select("key", "id").distinct(), one, labels, texts, shingle, percent)
    # an id with several texts ties their classes together
    several = known.select("id", "w1", "w2", "n").distinct().groupBy("id").agg(F.count("*").alias("k")).where("k > 1")
    ties = (known.join(several, "id").join(classes, ["w1", "w2", "n"]).where("id <> rep")
            .select(F.col("rep").alias("a"), F.col("id").alias("b")))
    extra = _stored(more.union(ties), "links")
    if not extra.isEmpty():
        labels = _stored(components(links.union(extra)), "labels")
    # copies: hot classes are salted, so one class is not one task
    copies = (classes.where("size > 1").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
              .select("w1", "w2", "n", F.coalesce("label", "rep").alias("of_class"))
              .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    return (all_rows.select("id", "n", "w1", "w2", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
            .join(copies, ["w1", "w2", "n", "salt"], "left").join(labels, "id", "left")
            .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
                    F.when(F.col("id").isNotNull(), F.coalesce(F.least("of_class", "label"), F.col("id")))
                    .alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(False))))
