"""Near-duplicates by exact similarity of word shingles: SimHash joins most of a group, a set join with prefix filter finds the rest."""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebar.llm.components import components
from tidebar.llm.simhash import covering_links
from tidebar.llm.text import byte_column, list_column, space_words
from tidebar.sources.scratch import drop, materialize, scratch_path

#: Texts are linked where the Jaccard similarity of their shingles is at least OVER[0] / OVER[1].
OVER = (4, 5)
#: Shingles that summaries count in more texts than this go to the end of the order, so that they fill no prefix.
COMMON = 16
#: Counters of the summary of one task, and the longest list of common shingles. Any list gives the same links.
COUNTERS, LISTED = 1 << 14, 1 << 20
#: Buckets of more sets than this are crowded. Where crowded buckets hold more than ``PAIRS`` pairs a set, their shingles are listed too.
CROWD, PAIRS = 32, 8
#: Fingerprints that differ in at most this many bits are compared first.
RADIUS = 3
#: Members of a bucket that are paired in one group; larger buckets are split into pairs of blocks.
BLOCK = 2048
#: Sets of one SimHash group that a task keeps to compare others with.
HELD = 8
#: Neighbours in a bucket are compared at once if they are so in 1 / NEAR of the shorter prefix; the others wait for all pairs.
NEAR = 4
#: Links that one task joins to components; graphs of more are contracted by joins first.
JOINED = 1 << 16
#: A row number is its task's number and its place in the task, which takes the lower bits.
_ROW_BITS = 33
_STEP = 1 << 15
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def _grams(hashes: np.ndarray, shingle: int) -> np.ndarray:
    """Hashes of 62 bits of the runs of ``shingle`` words, from the words' hashes."""
    n = len(hashes) - shingle + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(shingle):
        mixed = (mixed ^ hashes[k:k + n]) * _FACTORS[k % len(_FACTORS)]
        mixed ^= mixed >> np.uint64(29 + k % 5)
    return (mixed >> np.uint64(2)).view(np.int64)


def shingle_set(data: bytes, shingle: int, seed: int) -> np.ndarray:
    """Sorted distinct hashes of 62 bits of the word shingles; a shorter text is one shingle, a blank one none."""
    parts, held, words = [], np.zeros(0, np.uint64), []
    for found in space_words(data.lower()):
        words = (words + found[:shingle])[:shingle]
        run = np.concatenate((held, np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in found), np.uint64, len(found))))
        for at in range(0, len(run) - shingle + 1, _STEP):
            parts.append(np.unique(_grams(run[at:at + _STEP + shingle - 1], shingle)))
        held = run[max(0, len(run) - shingle + 1):]
    if words and not parts:
        parts.append(np.array([xxhash.xxh64_intdigest(b" ".join(words), seed) >> 2], np.int64))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)


def _name(s: np.ndarray, seed: int) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), seed)


def _fingerprint(s: np.ndarray) -> int:
    """SimHash of a set: the majority of the bits of its shingles."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(s), _STEP):
        count += np.unpackbits(s[at:at + _STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > len(s), bitorder="little").view(np.int64)[0])


def _summed(keys: np.ndarray, counts: np.ndarray, counters: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts added by key; beyond ``counters`` keys all counts fall by the largest that has to go."""
    keys, at = np.unique(keys, return_inverse=True)
    counts = np.bincount(at, counts, len(keys)).astype(np.int64)
    if len(keys) > counters:
        counts -= np.partition(counts, -counters - 1)[-counters - 1]
        keys, counts = keys[counts > 0], counts[counts > 0]
    return keys, counts


def common_shingles(docs: DataFrame, shingle: int, seed: int, text_col: str) -> pa.Table:
    """``(h, k)`` of the most frequent shingles, ``LISTED`` at most, from a summary of ``COUNTERS`` counters for each task.

    A shingle gets a counter when it is met twice in about two million. The list only orders the shingles, and any order
    gives the same links; so neither its bound nor counts that are too small lose a link."""
    counters = COUNTERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, waiting, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def settled():
            new = np.concatenate((keys, *waiting))  # a key that is held is there once more
            new.sort()
            at = np.flatnonzero(np.concatenate(([True], new[1:] != new[:-1])))
            times = np.diff(at, append=len(new))
            again = times > 1
            return _summed(np.concatenate((keys, new[at[again]])), np.concatenate((counts, times[again] - np.isin(new[at[again]], keys))), counters)
        for batch in batches:
            for t in byte_column(batch, "text"):
                waiting.append(shingle_set(t, shingle, seed))
                size += len(waiting[-1])
                if size > 1 << 21:
                    keys, counts = settled()
                    waiting, size = [], 0
        if size:
            keys, counts = settled()
        yield pa.record_batch([pa.array(keys), pa.array(counts)], ["h", "k"])

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "h bigint, k bigint").groupBy("h").agg(F.sum("k").alias("k"))
    return counted.filter(F.col("k") > COMMON).orderBy(F.desc("k"), "h").limit(LISTED).toArrow()


def crowded_shingles(met: DataFrame, sets: int, late: pa.Table) -> pa.Table:
    """``(h, k)`` of the crowded buckets of ``met (h, sig, k)`` that are not in ``late``, as far as the list has room; none
    where their pairs are no more than ``PAIRS`` times ``sets``. Summaries miss shingles that are spread thinly over many tasks."""
    listed = late.column("h").to_numpy()

    def fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~np.isin(batch.column("h").to_numpy(), listed)))
    found = met.filter(F.col("k") > CROWD).groupBy("h").agg(F.first("k").alias("k")).mapInArrow(fresh, "h bigint, k bigint")
    found = materialize(found, "crowded")
    room = found.orderBy(F.desc("k"), "h").limit(max(0, LISTED - late.num_rows)).toArrow()
    pairs = found.agg(F.sum(F.col("k").cast("double") * (F.col("k") - 1) / 2)).first()[0] or 0
    drop(found)
    return room if pairs > PAIRS * sets else room.slice(0, 0)


def _bucketed(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` with a column ``row`` of row numbers, written once in buckets of their tasks: ``_chosen`` moves none of them."""
    spark, name = rows.sparkSession, f"tidebar_{label}_{uuid.uuid4().hex}"
    buckets = min(100_000, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = rows.withColumn("task", F.shiftright("row", _ROW_BITS))
    rows.write.format("parquet").option("compression", "zstd").option("path", scratch_path(spark, label)).bucketBy(buckets, "task").saveAsTable(name)
    return spark.table(name)


def _bits(rows: pa.Table) -> pa.Table:
    """One bit for each place in a task."""
    place = rows.column("row").to_numpy() & (1 << _ROW_BITS) - 1
    flags = np.zeros(-(-(int(place.max()) + 1) // 64) * 64, np.uint8)
    flags[place] = 1
    return pa.table({"task": rows.column("task")[:1], "bits": pa.array([np.packbits(flags, bitorder="little").view("<i8")], pa.list_(pa.int64()))})


def _chosen(bucketed: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``bucketed`` whose number is in ``rows (row)``: only bits go to where they stand."""
    bits = rows.select(F.shiftright("row", _ROW_BITS).alias("task"), "row").groupBy("task").applyInArrow(_bits, "task bigint, bits array<bigint>")
    word = F.get("bits", F.shiftright(F.col("row").bitwiseAND((1 << _ROW_BITS) - 1), 6).cast("int"))
    return bucketed.join(bits.hint("shuffle_hash"), "task").filter(F.getbit(word, F.col("row").bitwiseAND(63).cast("int")) == 1).drop("task", "bits")


def prefixes(held: DataFrame, late: pa.Table, shingle: int, seed: int) -> DataFrame:
    """``(id, row, text_key, sig, n, fp, pre)`` of every row of ``held (id, row, text)``: ``sig`` names its set of ``n`` shingles, ``fp`` is the SimHash of
    the set, ``pre`` has the first n - ceil(0.8 n) + 1 shingles: those of ``late (h, k)`` last, by the binary length of k, and each by hash.

    Similar sets share 0.8 of either, and so the first shared shingle lies in both prefixes."""
    listed = late.sort_by("h")
    keys, levels = listed.column("h").to_numpy(), np.frexp(listed.column("k").to_numpy())[1].astype(np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, sizes, fp, first = [], [], [], []
            for t in byte_column(batch, "text"):
                s = shingle_set(t, shingle, seed)
                sig.append(_name(s, seed))
                sizes.append(len(s))
                fp.append(_fingerprint(s))
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                    s = s[np.argsort(np.where(keys[at] == s, levels[at], 0), kind="stable")]
                first.append(s[: len(s) + OVER[0] * len(s) // -OVER[1] + 1])
            yield pa.record_batch([batch.column("id"), batch.column("row"), batch.column("text_key"), pa.array(np.array(sig, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()),
                                   pa.array(fp, pa.int64()), list_column(first, pa.int64())], ["id", "row", "text_key", "sig", "n", "fp", "pre"])

    kind = held.schema["id"].dataType.simpleString()
    source = held.select("id", "row", F.xxhash64("text").alias("text_key"), "text")
    return source.mapInArrow(run, f"id {kind}, row bigint, text_key bigint, sig bigint, n bigint, fp bigint, pre array<bigint>")


def shingle_sets(texts: DataFrame, shingle: int, seed: int) -> DataFrame:
    """``(sig, sh)`` of ``texts (text)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, shingle, seed) for t in byte_column(batch, "text")]
            sig = np.array([_name(s, seed) for s in sets], np.uint64).view(np.int64)
            yield pa.record_batch([pa.array(sig), list_column(sets, pa.int64())], ["sig", "sh"])
    return texts.select("text").mapInArrow(run, "sig bigint, sh array<bigint>")


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    return sum(OVER) * len(np.intersect1d(x, y, assume_unique=True)) >= OVER[0] * (len(x) + len(y))


def sketch_links(nodes: DataFrame, held: DataFrame, shingle: int, seed: int) -> DataFrame:
    """Links ``(a, b)`` between similar sets whose fingerprints lie in one SimHash component: each set is compared with
    some of those before it in the order of fingerprints. What they miss is left to ``prefix_links``."""
    found = covering_links(nodes.select("fp").distinct(), RADIUS)
    joined = components(found, JOINED).withColumnRenamed("node", "fp")
    grouped = materialize(nodes.join(joined, "fp", "left").select("sig", "row", "fp", F.coalesce("root", "fp").alias("group")), "grouped")
    drop(found)
    several = grouped.groupBy("group").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("group")
    members = grouped.join(several, "group")
    members = members.join(_chosen(held, members).select("row", "text"), "row").select("group", "fp", "sig", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            a, b = [], []
            for g, sig, text in zip(batch.column("group").to_pylist(), batch.column("sig").to_pylist(), byte_column(batch, "text")):
                if g != group:
                    group, held = g, []
                s = shingle_set(text, shingle, seed)
                near = next((k for k, (_, other) in enumerate(held) if _similar(s, other)), None)
                if near is None:
                    held = [(sig, s)] + held[:HELD - 1]
                else:
                    a.append(held[near][0])
                    b.append(sig)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    ordered = members.repartitionByRange("group", "fp", "sig").sortWithinPartitions("group", "fp", "sig")
    links = materialize(ordered.mapInArrow(run, "a bigint, b bigint"), "sketched")
    drop(grouped)
    return links


def _pairs(batches: Iterator[pa.RecordBatch], nearest: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of different roots and fitting sizes in each bucket ``(h, cell)`` of a sorted partition, or only those next to each other."""
    names = ["h", "cell", "part", "root", "sig", "n"]
    held = [np.zeros(0, np.int64)] * len(names)

    def settle(h, cell, part, root, sig, n):
        i, shift = np.arange(len(h)), 1
        across = cell >> 31 != cell & (1 << 31) - 1
        while True:
            i = i[i + shift < len(h)]
            i = i[(h[i] == h[i + shift]) & (cell[i] == cell[i + shift])]
            if not len(i):
                return
            j = i + shift
            fits = (root[i] != root[j]) & (np.minimum(n[i], n[j]) * OVER[1] >= np.maximum(n[i], n[j]) * OVER[0]) & ((part[i] != part[j]) | ~across[i])
            x, y = i[fits], j[fits]
            x, y = np.where(sig[x] < sig[y], x, y), np.where(sig[x] < sig[y], y, x)
            yield pa.record_batch([pa.array(v) for v in (sig[x], sig[y], root[x], root[y], n[x], n[y])], ["a", "b", "root_a", "root_b", "n_a", "n_b"])
            if nearest:
                return
            shift += 1
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [np.concatenate((old, batch.column(k).to_numpy(zero_copy_only=False))) for old, k in zip(held, names)]
        new = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]))
        cut = new[-1] + 1 if len(new) else 0
        held = [r[cut:] for r in rows]
        yield from settle(*(r[:cut] for r in rows))
    yield from settle(*held)


def _candidates(met: DataFrame, nodes: DataFrame, links: DataFrame, nearest: bool) -> DataFrame:
    """Pairs ``(a, b, root_a, root_b, n_a, n_b)`` of sets of ``met (h, sig)`` in one bucket, without those that ``links`` join already."""
    joined = components(links, JOINED).withColumnRenamed("node", "sig")
    rows = met.join(nodes.select("sig", "n").join(joined, "sig", "left").select("sig", "n", F.coalesce("root", "sig").alias("root")), "sig")
    live = rows.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
    rows = rows.join(live.select("h", F.ceil(F.col("k") / BLOCK).alias("parts")), "h").withColumn("part", F.pmod(F.xxhash64("sig"), "parts"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)) if not nearest else F.col("part")
    rows = rows.withColumn("other", other).withColumn("cell", F.shiftleft(F.least("part", "other"), 31) + F.greatest("part", "other"))
    ordered = rows.select("h", "cell", "part", "root", "sig", "n").repartition("h", "cell").sortWithinPartitions("h", "cell", "sig")
    return ordered.mapInArrow(lambda batches: _pairs(batches, nearest), "a bigint, b bigint, root_a bigint, root_b bigint, n_a bigint, n_b bigint")


def _verified(pairs: DataFrame, nodes: DataFrame, held: DataFrame, shingle: int, seed: int, label: str) -> DataFrame:
    """Those of ``pairs (a, b)`` whose whole sets are similar; only their texts are read again."""
    pairs = materialize(pairs, "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    sets = materialize(shingle_sets(_chosen(held, nodes.join(wanted, "sig", "left_semi")), shingle, seed), "sets")
    left, right = (sets.select(F.col("sig").alias(k), F.col("sh").alias(f"sh_{k}")) for k in ("a", "b"))
    shared = F.size(F.array_intersect("sh_a", "sh_b")) * sum(OVER)
    links = materialize(pairs.join(left, "a").join(right, "b").filter(shared >= OVER[0] * (F.size("sh_a") + F.size("sh_b"))).select("a", "b"), label)
    drop(pairs, sets)
    return links


def prefix_links(met: DataFrame, nodes: DataFrame, held: DataFrame, links: DataFrame, shingle: int, seed: int) -> DataFrame:
    """``links`` and links ``(a, b)`` that connect all other similar sets of ``met (h, sig)``.

    First those that are neighbours in many buckets are compared, one pair for two components, which joins most of what
    the fingerprints left apart. Then all pairs of different components remain. Up to the last element of the prefix that
    ends first all shared shingles are known from the buckets, and behind it there are no more than that set's
    rest; pairs that cannot reach the similarity so are not read."""
    near = _candidates(met, nodes, links, True).groupBy("root_a", "root_b").agg(
        F.min(F.struct("a", "b")).alias("p"), F.count(F.lit(1)).alias("k"), F.min(F.least("n_a", "n_b")).alias("n"))
    near = near.filter(F.col("k") * NEAR * OVER[1] >= F.col("n") * (OVER[1] - OVER[0])).select("p.a", "p.b").distinct()
    links = links.unionAll(_verified(near, nodes, held, shingle, seed, "neighbours"))

    def rest(n: str):
        return F.ceil(F.col(n) * OVER[0] / OVER[1]) - 1
    pairs = _candidates(met, nodes, links, False).groupBy("a", "b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("shared"))
    most = F.col("shared") + F.greatest(rest("n_a"), rest("n_b"))
    far = pairs.filter(most * sum(OVER) >= (F.col("n_a") + F.col("n_b")) * OVER[0]).select("a", "b")
    return links.unionAll(_verified(far, nodes, held, shingle, seed, "similar"))


def drop_similar(docs: DataFrame, shingle: int = 5, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row with the smallest id of each component of rows linked by similar shingle sets, with its columns. Of repeated
    rows, and of rows of a component that share its id, one stays; a component without ids keeps one row. Null and
    blank texts are linked with each other.

    The rows are written once and stay where they stand: what is asked of them later goes to them as bits."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    whole = F.struct(*[F.col(c).alias(k) for c, k in zip(docs.columns, names)]).alias("whole")
    rows = _bucketed(docs.select(whole, F.monotonically_increasing_id().alias("row")), "held")
    at = dict(zip(docs.columns, names))
    held = rows.select("task", "row", F.col("whole").getField(at[id_col]).alias("id"), F.col("whole").getField(at[text_col]).alias("text"))
    late = common_shingles(held, shingle, seed, "text")
    while True:
        marked = _bucketed(prefixes(held, late, shingle, seed), "prefixes")
        nodes = materialize(marked.groupBy("sig").agg(*(F.min(c).alias(c) for c in ("row", "n", "fp"))), "nodes")
        single = _chosen(marked, nodes).select(F.explode("pre").alias("h"), "sig")
        met = materialize(single.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("h"))).filter("k > 1").select("h", "sig", "k"), "met")
        more = crowded_shingles(met, nodes.count(), late)
        if not more.num_rows:
            break
        late = pa.concat_tables([late, more])
        drop(marked, nodes, met)
    links = sketch_links(nodes, held, shingle, seed)
    links = prefix_links(met.select("h", "sig"), nodes, held, links, shingle, seed)
    joined = components(links, JOINED).withColumnRenamed("node", "sig")
    named = marked.select("id", "text_key", "row", "sig").join(joined, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "text_key", "row")).alias("first")
    kept = materialize(named.groupBy("root").agg(first).select(F.col("first.row").alias("row")), "kept")
    drop(marked, nodes, met, links)
    return _chosen(rows, kept).select(*[F.col("whole").getField(k).alias(c) for c, k in zip(docs.columns, names)])
