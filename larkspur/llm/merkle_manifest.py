"""Merkle manifest of a dataset: one root for all rows, and a proof for each of them.

A row's leaf is the sha256 of its fields. Leaves of one tree (here: one language) ascend by doc_id; every ARITY consecutive
nodes, at the end maybe fewer, are a run and have the sha256 of their hex digests as parent, until one is left. The trees'
roots are the leaves of a last tree, in the order of their names.

The nodes that are known but whose parent isn't form a sparse forest: {(tree, level, index): digest}. How many leaves a
tree has tells how many siblings each run has, so any two forests of disjoint rows can be merged: `merge` puts their nodes
together and replaces each run that is now complete by its parent, as often as it can. That is associative and commutative
with the empty forest as its unit. A fragment is CHUNK consecutive rows; its own forest is worked out in one task and keeps
at most 2 * (ARITY - 1) nodes a level for the trees that go on beyond it. `tree_reduce` then merges FAN neighbouring
fragments to one, and again, until all are one; neighbours close nearly all runs between them, so forests stay as small on
the way up. (`RDD.treeReduce` pairs partitions by remainder, where neighbours meet last, and ends on the driver.) The runs
closed on the way are kept: those that a fragment's first or last rows lie in are what it lacks for the proofs of its rows.

Defined results: null fields are written `-`; null languages are a tree of their own, the first one; null doc_ids come
first in a tree; rows of one doc_id are ordered by their leaves, and equal rows are leaves of their own. Very long texts
are hashed where they lie and never moved. An empty table has no rows and no root. Further columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.shared import Temporary, materialize, partitions, plain, worker_for

SHIFT = 3
ARITY = 1 << SHIFT
CHUNK = 1 << 15
FAN = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BROADCAST_ROWS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NODES = "fragment long, tree string, level int, at long, total long, kind string, digest string, run array<string>"
STEPS = "array<struct<at:int,others:string>>"
Forest = dict[tuple[str, int, int], str]
Runs = dict[tuple[str, int, int], list[str]]


def digest_of(parts: str) -> str:
    return sha256(parts.encode()).hexdigest()


# forests


def width(total: int, level: int) -> int:
    """How many nodes a tree of so many leaves has on a level."""
    return -(-total // (1 << SHIFT * level))


def settle(nodes: Forest, totals: dict[str, int]) -> tuple[Forest, Runs]:
    """The forest with every complete run replaced by its parent, and those runs by (tree, level, number of the run)."""
    levels: dict[int, dict[tuple[str, int], dict[int, str]]] = defaultdict(lambda: defaultdict(dict))
    for (tree, level, at), digest in nodes.items():
        levels[level][tree, at >> SHIFT][at] = digest
    left, runs = {}, {}
    while levels:
        level = min(levels)
        for (tree, run), here in levels.pop(level).items():
            n = width(totals[tree], level)
            if n > 1 and len(here) == min(ARITY, n - (run << SHIFT)):
                runs[tree, level, run] = siblings = [here[at] for at in sorted(here)]
                levels[level + 1][tree, run >> SHIFT][run] = digest_of("".join(siblings))
            else:
                left.update({(tree, level, at): digest for at, digest in here.items()})
    return left, runs


def merge(a: Forest, b: Forest, totals: dict[str, int]) -> Forest:
    """The forest of the rows of both, which are disjoint."""
    return settle(a | b, totals)[0]


def fold(digest: str, steps) -> str:
    """The root above a node, from its siblings on each level: (its place among them, their digests joined)."""
    for at, others in steps:
        digest = digest_of(others[: 64 * at] + digest + others[64 * at :])
    return digest


def paths(tree: str, first: int, last: int, total: int, runs: Runs) -> Iterator[tuple[int, tuple, str]]:
    """(at, steps, digests of all siblings) of the leaves from first to last, from the runs above them."""
    above = {0: ((), "")}
    top = 0
    while width(total, top) > 1:
        top += 1
    if not top:
        yield 0, (), ""
    for level in reversed(range(top)):
        here = {}
        for at in range(first >> SHIFT * level, (last >> SHIFT * level) + 1):
            run, place = runs[tree, level, at >> SHIFT], at & (ARITY - 1)
            others = "".join(run[:place] + run[place + 1 :])
            steps, text = above[at >> SHIFT]
            if level:
                here[at] = (((place, others), *steps), others + text)
            else:
                yield at, ((place, others), *steps), others + text
        above = here


# leaves


def leaf(row: dict[str, Column]) -> Column:
    each = []
    for name in FIELDS:
        text = row[name].cast("string")
        each.append(F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*each), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """tree, doc_id, digest, and the digest of the row after tampering where a doc_id's crc32 is divisible by 3."""
    row = {n: F.col(n) for n in FIELDS}
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, leaf(row | {"text": F.translate("text", UPPER, LOWER)}))
    tree = F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree")
    return plain(docs, *FIELDS).select(tree, F.col("doc_id").cast("long").alias("doc_id"), leaf(row).alias("digest"), tampered.alias("tampered"))


def numbered(rows: DataFrame, order: list[str], chunk: int = CHUNK) -> DataFrame:
    """rows, given by tree, with their place `at` in their tree, its `total` and their `fragment`, as a table."""
    spark = rows.sparkSession
    rows = rows.withColumn("salt", F.monotonically_increasing_id())  # lets a range border lie between equal rows
    by = ["tree", *order, "salt"]
    place = F.monotonically_increasing_id()  # after sorting: the partition, and the row's number in it
    dealt = rows.repartitionByRange(partitions(spark), *by).sortWithinPartitions(*by).withColumn("place", place).drop("salt")
    dealt = materialize(dealt, "sorted")
    part, row = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    spans = dealt.groupBy(part.alias("part"), "tree").agg(F.count("*").alias("n"), F.min(row).alias("low"), F.max(row).alias("high"))
    tree = Window.partitionBy("tree")
    before = F.sum("n").over(tree.orderBy("part")) - F.col("n")
    spans = spans.select("part", "tree", (before - F.col("low")).alias("shift"), F.sum("n").over(tree).alias("total"), "high")
    spans = materialize(spans, "spans")
    sizes = spans.groupBy("part").agg(F.expr(f"max(high) div {chunk} + 1").alias("fragments"))  # one row a partition
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("fragments").over(earlier), F.lit(0)).alias("start"))
    known = spans.drop("high").join(F.broadcast(starts), "part")
    if spans.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    out = dealt.withColumns({"part": part, "row": row}).join(known, ["part", "tree"])
    fragment = F.col("start") + F.expr(f"row div {chunk}")
    out = out.withColumns({"at": F.col("row") + F.col("shift"), "fragment": fragment})
    return materialize(out.drop("place", "part", "row", "shift", "start"), "numbered")


# from leaves to roots and back


def _rows(fragment: int, left: Forest, runs: Runs, totals: dict[str, int]) -> pd.DataFrame:
    out = [(fragment, t, n, i, totals[t], "node" if width(totals[t], n) > 1 else "root", d, None) for (t, n, i), d in left.items()]
    out += [(fragment, t, n, i, totals[t], "run", None, run) for (t, n, i), run in runs.items()]
    return pd.DataFrame(out, columns=["fragment", "tree", "level", "at", "total", "kind", "digest", "run"])


def _forest(rows: pd.DataFrame, level=None) -> tuple[Forest, dict[str, int]]:
    levels = [0] * len(rows) if level is None else rows[level]
    return dict(zip(zip(rows.tree, levels, rows["at"]), rows.digest)), dict(zip(rows.tree, rows.total))


def tree_reduce(rows: DataFrame, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """Roots (tree, root) and the runs (tree, level, at, run) that no fragment holds as a whole, from numbered rows."""

    def start(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        worker_for("manifest")
        nodes, totals = _forest(part)
        return _rows(key[0], settle(nodes, totals)[0], {}, totals)

    def join(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        nodes, totals = _forest(part, "level")
        return _rows(key[0], *settle(nodes, totals), totals)

    fragments = (rows.agg(F.max("fragment")).first()[0] or 0) + 1
    now = rows.select("fragment", "tree", "at", "total", "digest").groupBy("fragment").applyInPandas(start, NODES)
    now = materialize(now, "fragments")
    roots, runs = now.filter("kind = 'root'"), now.filter("kind = 'run'")
    while fragments > 1:
        nodes = now.filter("kind = 'node'").drop("kind", "run").withColumn("group", F.expr(f"fragment div {fan}"))
        now = materialize(nodes.groupBy("group").applyInPandas(join, NODES), "merged")
        roots, runs = roots.unionByName(now.filter("kind = 'root'")), runs.unionByName(now.filter("kind = 'run'"))
        fragments = -(-fragments // fan)
    return roots.select("tree", F.col("digest").alias("root")), runs.select("tree", "level", "at", "run")


def _beside(rows: DataFrame, runs: DataFrame, trees: DataFrame) -> DataFrame:
    """For each fragment what it lacks: the runs at its borders, and what `trees` (tree, root, top, above) says of its trees."""
    spans = rows.groupBy("fragment", "tree").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.max("total").alias("total"))
    one = F.lit(1).cast("long")
    levels = F.filter(F.sequence(F.lit(0), F.lit(20)), lambda n: F.call_function("shiftleft", one, n * SHIFT) < F.col("total"))
    above = lambda x: F.call_function("shiftright", F.col(x), (F.col("level") + 1) * SHIFT)
    lacking = spans.withColumn("level", F.explode(levels))
    lacking = lacking.select("fragment", "tree", "level", F.explode(F.array_distinct(F.array(above("first"), above("last")))).alias("at"))
    found = lacking.join(runs, ["tree", "level", "at"]).select("fragment", "tree", "level", "at", "run")
    about = spans.select("fragment", "tree").join(trees, "tree")
    return found.unionByName(about, allowMissingColumns=True)


def _above(part: pd.DataFrame, beside: pd.DataFrame):
    """(position of the row, steps, siblings' digests, what is known of its tree) of each row of a fragment."""
    nodes, totals = _forest(part)
    runs = settle(nodes, totals)[1]
    lacking = beside[beside.level.notna()]
    runs |= {(t, int(n), int(i)): list(run) for t, n, i, run in zip(lacking.tree, lacking.level, lacking["at"], lacking.run)}
    about = {t.tree: t for t in beside[beside.level.isna()].itertuples()}
    for tree, some in part.groupby("tree", sort=False):
        places = dict(zip(some["at"], some.index))
        for at, steps, text in paths(tree, min(places), max(places), totals[tree], runs):
            yield places[at], steps, text, about[tree]


def top_tree(roots: DataFrame, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """tree, root, top, above: the trees' roots as leaves of the last tree, with its root and each one's steps up to it."""
    names = roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"))
    rows = numbered(names, ["name"], chunk)
    tops, runs = tree_reduce(rows, fan)

    def climb(part: pd.DataFrame, beside: pd.DataFrame) -> pd.DataFrame:
        out = []
        for i, steps, _, tree in _above(part, beside):
            above = [{"at": at, "others": others} for at, others in steps]
            out.append((part.at[i, "name"], part.at[i, "digest"], tree.root, above))
        return pd.DataFrame(out, columns=["tree", "root", "top", "above"])

    beside = materialize(_beside(rows, runs, tops), "beside")
    climbed = rows.groupBy("fragment").cogroup(beside.groupBy("fragment")).applyInPandas(climb, f"tree string, root string, top string, above {STEPS}")
    return materialize(climbed, "top")


def manifest(docs: DataFrame, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row."""
    with Temporary() as tables:
        rows = tables.keep(numbered(materialize(leaves(docs), "leaves"), ["doc_id", "digest"], chunk))
        roots, runs = tree_reduce(rows, fan)
        trees = top_tree(roots, chunk, fan)
        beside = tables.keep(materialize(_beside(rows, runs, trees), "beside"))

    def prove(part: pd.DataFrame, beside: pd.DataFrame) -> pd.DataFrame:
        worker_for("manifest")
        out, own = [], part.digest
        now = part.tampered.where(part.tampered.notna(), own)
        for i, steps, text, tree in _above(part, beside):
            steps = (*steps, *((s["at"], s["others"]) for s in tree.above))
            proof = digest_of(text + "".join(s["others"] for s in tree.above))
            folded = fold(now[i], steps)
            out.append((part.at[i, "id"], own[i], tree.root, tree.top, proof, folded, folded == tree.top))
        return pd.DataFrame(out, columns=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    schema = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    id_ = F.col("doc_id").cast("string").alias("id")  # a number with nulls would lose digits in pandas
    needed = rows.select("fragment", "tree", "at", "total", id_, "digest", "tampered")
    proven = needed.groupBy("fragment").cogroup(beside.groupBy("fragment")).applyInPandas(prove, schema)
    return proven.select(F.col("id").cast("long").alias("doc_id"), *proven.columns[1:])


def _forest_sql(name: str, leaves: str) -> str:
    """(tree, id, steps, root) of leaves (tree, spot, id, digest); a step is the digests to the left, a comma, those to the right."""
    return f"""
{name}_nodes as (
    select tree, 0 as level, spot, digest, count(*) over (partition by tree) as n from {leaves}
    union all
    select tree, level + 1, spot >> 3, sha256(string_agg(digest, '' order by spot)), (n + 7) >> 3
    from {name}_nodes where n > 1 group by tree, level, spot >> 3, n
), {name}_runs as (
    select tree, level, spot >> 3 as run, list(digest order by spot) as members from {name}_nodes where n > 1 group by all
), {name}_climbed as (
    select tree, id, 0 as level, spot, []::varchar[] as steps from {leaves}
    union all
    select c.tree, id, c.level + 1, spot >> 3,
        list_append(steps, array_to_string(members[:spot & 7], '') || ',' || array_to_string(members[(spot & 7) + 2:], ''))
    from {name}_climbed c join {name}_runs r on c.tree = r.tree and c.level = r.level and c.spot >> 3 = r.run
), {name} as (
    select c.tree, id, steps, r.digest as root
    from (select tree, id, arg_max(steps, level) as steps from {name}_climbed group by all) c
    join (select tree, digest from {name}_nodes where n = 1) r on r.tree = c.tree
)"""


_BYTE = "list_reduce([xor(crc, byte)] || list_resize([0::bigint], 8, 0), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"


def _field_sql(column: str) -> str:
    text = f"({column})::varchar"
    return f"coalesce(octet_length(encode({text})) || ':' || {text}, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(map(_field_sql, (*FIELDS[:-1], text))) + ")"


ORACLE_SQL = f"""
with recursive hashed as (
    select doc_id, coalesce('=' || lang, '') as tree, {_leaf_sql("text")} as leaf,
        {_leaf_sql(f"translate(text, '{UPPER}', '{LOWER}')")} as tampered,
        xor(list_reduce([4294967295] || list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint),
            lambda crc, byte: {_BYTE}), 4294967295) % 3 = 0 as chosen
    from documents
), leaves as (
    select doc_id, tree, leaf as digest, if(chosen, tampered, leaf) as now,
        row_number() over (order by tree, doc_id nulls first, leaf) as id,
        row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as spot
    from hashed
), {_forest_sql("proven", "leaves")}, roots as (
    select '' as tree, id, digest, row_number() over (order by id) - 1 as spot from (select distinct tree as id, root as digest from proven)
), {_forest_sql("placed", "roots")}, proofs as (
    select doc_id, l.digest as leaf, p.root as subroot, t.root, l.now, p.steps || t.steps as steps
    from leaves l join proven p on p.id = l.id join placed t on t.id = l.tree
), folded as (
    select *, list_reduce([now] || steps, lambda d, s: sha256(split_part(s, ',', 1) || d || split_part(s, ',', 2))) as folded_root
    from proofs
)
select doc_id, leaf, subroot, root, sha256(replace(array_to_string(steps, ''), ',', '')) as proof_sha256, folded_root,
    folded_root = root as verified
from folded
"""
