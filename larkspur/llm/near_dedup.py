"""Near-duplicate groups by SuperMinHash, banding, exact verification and components.

A document's set holds the hashes of its distinct five-word shingles. Documents with equal sets are one class,
known by its smallest doc_id, so copies meet only in one aggregation. SuperMinHash gives each element a random
permutation of the signature's slots, step j offering j plus a fraction to one slot; a document stops as soon as
no slot can improve, after a step or two for long ones. Classes that agree in a band (ROWS slots) share a
bucket. In each bucket classes are first compared with one centre, and what those links join into a component isn't
compared again; then all classes of one bucket that are still in different components are compared, but for pairs
whose counts against the bucket's centre rule a link out: two sets share at most the centre's shingles that neither
misses and those beside the centre's that other sets hold too, both counted in PARTS parts by hash. So no link
between different texts is lost, and a large group of near copies costs about as many comparisons as it has members.
All comparisons are of full sets. Where many pairs share a bucket or a member, they are dealt to several tasks, and
the other side of the join goes to each of these.

Null or blank texts have an empty set, are linked with nothing and kept. Rows without a doc_id are linked with
nothing: component_id is null and kept is true. Rows with equal doc_id are one document: what any of their texts is
linked with is one component, and all of them are kept if one is. A very long text is hashed whole within one task, in
slices of its shingles; its set takes eight bytes a distinct shingle. Further columns of the input are not read; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.components import components
from larkspur.llm.hashing import ODD, mix, shingle_hashes, slices
from larkspur.llm.shared import giving_back, materialize, plain, release, worker_for

SLOTS = 360
ROWS = 6
WIDTH = 5
PERCENT = 75
CHUNK = 6_000
FIRST_BANDS = 4
PARTS = 8  # a power of two
SPLIT = 256  # rows of one join key that one task takes; more are dealt out


def superminhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """One signature row for each (non-empty) set of 64-bit hashes."""
    out = np.full((len(sets), slots), np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    elements = np.concatenate([np.zeros(0, np.uint64), *sets])
    for at in range(0, len(elements), CHUNK):
        _offer(elements[at : at + CHUNK], owner[at : at + CHUNK], out, slots)
    return out


def _offer(elements: np.ndarray, owner: np.ndarray, out: np.ndarray, slots: int) -> None:
    flat = out.reshape(-1)
    order = np.tile(np.arange(slots, dtype=np.uint16), (len(elements), 1))
    row, low, high = np.arange(len(elements)), owner[0], owner[-1] + 1
    for j in range(slots):
        # a signature whose slots are all below j can't improve
        open_docs = out[low:high].max(axis=1) >= np.uint64(j << 53)
        row = row[open_docs[owner[row] - low]]
        if not len(row):
            return
        x = mix(elements[row] + np.uint64(j * int(ODD[10]) % (1 << 64)))
        k = j + ((x >> np.uint64(40)) % np.uint64(slots - j)).astype(np.int64)
        slot = order[row, k]
        order[row, k] = order[row, j]
        fraction = mix(x + ODD[11]) >> np.uint64(11)
        np.minimum.at(flat, owner[row] * slots + slot, fraction | np.uint64(j << 53))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_hash, bands."""
    per = SLOTS // ROWS

    def run(batches):
        worker_for("near_dedup")
        for b in batches:
            texts = b.column(1).to_pylist()
            for x, y in slices(texts):
                sets = [np.unique(s) for s in shingle_hashes([t or "" for t in texts[x:y]], WIDTH)]
                sig = superminhash(sets)
                bands = np.zeros((len(sets), per), np.uint64)
                for r in range(ROWS):
                    bands += mix(sig[:, r::ROWS] + ODD[20 + r]) * ODD[30 + r]
                bands = mix(bands + np.arange(per, dtype=np.uint64) * ODD[40]).view(np.int64)
                full = np.array([len(s) > 0 for s in sets])
                ends = pa.array(np.concatenate([[0], np.cumsum(full * per)]), pa.int32())
                hashes = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                lists = pa.ListArray.from_arrays(ends, pa.array(bands[full].reshape(-1)))
                columns = [b.column(0).slice(x, y - x), pa.array([len(s) for s in sets], pa.int64()), pa.array(hashes, pa.binary()), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "set_hash", "bands"])

    read = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return read.mapInArrow(giving_back(run), "doc_id long, n_shingles long, set_hash binary, bands array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id and its set as a list of 64-bit hashes."""

    def run(batches):
        worker_for("near_dedup")
        for b in batches:
            texts = b.column(1).to_pylist()
            for x, y in slices(texts):
                sets = [np.unique(s).view(np.int64) for s in shingle_hashes([t or "" for t in texts[x:y]], WIDTH)]
                offsets = pa.array(np.cumsum([0] + [len(s) for s in sets]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(x, y - x), lists], names=["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(giving_back(run), "doc_id long, shingles array<long>")


def _by_part(test) -> Column:
    """An array of test(k) for each part k."""
    return F.array(*[test(k) for k in range(PARTS)])


def _part(e: Column) -> Column:
    return e.bitwiseAND(F.lit(PARTS - 1))


def _counts(shingles: Column) -> Column:
    """How many of the shingles each part has."""
    return _by_part(lambda k: F.size(F.filter(shingles, lambda e: _part(e) == k)))


def _dealt(x: DataFrame, y: DataFrame, key: str, by: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on `key` with a further key `deal`: x's rows of a frequent key go to several values by the
    column `by`, y's row or rows to each of these."""
    tasks = x.groupBy(key).agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("tasks")).filter("tasks > 1")
    one = F.coalesce("tasks", F.lit(1))
    x = x.join(tasks, key, "left").withColumn("deal", F.pmod(F.xxhash64(by), one).cast("int")).drop("tasks")
    y = y.join(tasks, key, "left").withColumn("deal", F.explode(F.sequence(F.lit(0), one - 1))).drop("tasks")
    return x, y


def _measured(pairs: DataFrame, sets: DataFrame, parts: bool = False) -> DataFrame:
    """The pairs (a, b) with the sizes of their sets' intersection and union; with parts also what a has beside b and misses of it."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b"))
    pairs, right = _dealt(pairs, right, "b", "a")
    both = pairs.join(left, "a").join(right, ["b", "deal"])
    common = F.size(F.array_intersect("set_a", "set_b"))
    out = ["a", "b", common.alias("common"), (F.size("set_a") + F.size("set_b") - common).alias("all")]
    if parts:
        beside, missing = F.array_except("set_a", "set_b"), F.array_except("set_b", "set_a")
        out += [_counts(beside).alias("beside"), _counts(missing).alias("missing")]
    return both.select(*out)


def _placed(members: DataFrame, centred: DataFrame, measured: DataFrame, sets: DataFrame) -> DataFrame:
    """members with their centre's size (size), what they miss of it (missing) and have beside it that other members may have (beside)."""
    near = centred.select("bucket", "a", "b", F.col("nb").alias("size"))
    near = near.join(measured.select("a", "b", "beside", "missing"), ["a", "b"], "left")
    placed = members.join(near.withColumnRenamed("a", "rep"), ["bucket", "rep"])
    # with the centres, so that what only one class and a centre hold isn't single
    own = placed.select(F.explode(F.array("rep", "b")).alias("doc_id")).distinct()
    held = sets.join(own, "doc_id", "left_semi").select("doc_id", F.explode("shingles").alias("e"))
    single = held.groupBy("e").agg(F.count("*").alias("holders"), F.min("doc_id").alias("rep")).filter("holders = 1")
    single = single.groupBy("rep").agg(_by_part(lambda k: F.count_if(_part(F.col("e")) == k)).alias("single"))
    placed = placed.join(single, "rep", "left")
    count = lambda name, k: F.coalesce(F.col(name)[k], F.lit(0))
    return placed.select(
        "bucket", "rep", "n", "component", "size",
        _by_part(lambda k: count("missing", k)).alias("missing"),
        _by_part(lambda k: F.greatest(count("beside", k) - count("single", k), F.lit(0))).alias("beside"),
    )


def _against_centre(rows: DataFrame, rank: Column) -> DataFrame:
    """Every row of rows with the centre of its bucket, the row of the least rank."""
    centres = rows.groupBy("bucket").agg(F.min(F.struct(rank.alias("k"), "rep", "n", "component")).alias("c"))
    own = [F.col("rep").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca")]
    centre = [F.col("c.rep").alias("b"), F.col("c.n").alias("nb"), F.col("c.component").alias("cb")]
    return rows.join(centres, "bucket").select("bucket", *own, *centre)


def _alike(percent: int) -> Column:
    """The sizes alone don't rule a link out."""
    return 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")


def _not_ruled_out(placed: DataFrame, percent: int) -> DataFrame:
    """Pairs of one bucket in different components whose counts against the bucket's centre allow a link."""
    of = lambda *names: [F.col(n).alias(x) for n, x in zip(("rep", "n", "component", "missing", "beside"), names)]
    x = placed.select("bucket", "size", *of("a", "na", "ca", "missing_a", "beside_a"))
    y = placed.select("bucket", *of("b", "nb", "cb", "missing_b", "beside_b"))
    x, y = _dealt(x, y, "bucket", "a")
    least = lambda k: F.least(F.col("beside_a")[k], F.col("beside_b")[k])
    most = lambda k: F.greatest(F.col("missing_a")[k], F.col("missing_b")[k])
    common = sum((least(k) - most(k) for k in range(PARTS)), F.col("size"))
    allowed = (100 + percent) * common >= percent * (F.col("na") + F.col("nb"))
    return x.join(y, ["bucket", "deal"]).filter((F.col("ca") < F.col("cb")) & _alike(percent) & allowed)


def near_groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document."""
    rows = materialize(signatures(docs), "signatures")
    classes = rows.filter("n_shingles > 0 and doc_id is not null").groupBy("set_hash").agg(F.min("doc_id").alias("rep"))
    classes = materialize(classes, "classes")
    reps = rows.join(classes.select("set_hash", F.col("rep").alias("doc_id")), ["set_hash", "doc_id"], "left_semi")
    banded = reps.select(F.posexplode("bands").alias("band", "bucket"), F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"))
    shared = banded.groupBy("bucket").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi").select("bucket")
    members = materialize(banded.join(shared, "bucket"), "members")
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    texts = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").join(wanted, "doc_id", "left_semi")
    sets = materialize(shingle_sets(texts), "sets")
    linked = 100 * F.col("common") >= percent * F.col("all")

    labels, old = None, [members, sets]
    joined = members.withColumn("component", F.col("rep"))
    for turn in range(4):
        if turn == 3:  # all pairs with a centre have been measured
            beside = centred.filter("a <> b").select("bucket", F.col("a").alias("rep"))
            joined = joined.join(beside, ["bucket", "rep"], "left_semi")
        if turn:  # buckets whose members are in several components
            split = joined.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
            joined = materialize(joined.join(split.filter("lo < hi").select("bucket"), "bucket"), "open")
            old.append(joined)
            if joined.isEmpty():
                break
        if turn == 0:  # a few bands join most of what belongs together
            met = _against_centre(joined.filter(F.col("band") < FIRST_BANDS), F.col("rep")).filter(_alike(percent))
        elif turn == 1:  # one class of each component in a bucket
            one = F.min(F.struct(F.xxhash64("rep").alias("k"), "rep", "n")).alias("r")
            one = joined.groupBy("bucket", "component").agg(one).select("bucket", "r.rep", "r.n", "component")
            met = _against_centre(one, F.xxhash64("rep")).filter(_alike(percent))
        elif turn == 2:  # every class in an open bucket, whatever its size: the counts serve the last turn
            met = centred = materialize(_against_centre(joined, F.col("rep")), "centred")
        else:
            placed = materialize(_placed(joined, centred, measured, sets), "placed")
            old += [centred, placed]
            met = _not_ruled_out(placed, percent)
        if turn != 2:
            met = met.filter(F.col("ca") != F.col("cb"))
        measured = materialize(_measured(met.filter("a <> b").select("a", "b").distinct(), sets, parts=turn == 2), "measured")
        old.append(measured)
        links = measured.filter(linked).select("a", "b")
        if labels is not None:  # what is linked already is a star around each component's smallest member
            links = links.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
            old.append(labels)
        labels = components(links)
        named = labels.withColumnRenamed("node", "rep")
        joined = members.join(named, "rep", "left").select("bucket", "band", "rep", "n", F.coalesce("component", "rep").alias("component"))
    release(*old)
    own = rows.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_hash")).alias("set_hash"))
    named = own.join(classes, "set_hash", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return named.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))
