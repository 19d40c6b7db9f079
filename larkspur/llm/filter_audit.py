"""How text filters act on each other: what each removes in every order, from one pass over the documents.

Each document fails a set of the filters A to E, a mask of five bits. `parity_sums` adds up, for each part and label, the
32 signed parities of the masks: the Walsh-Hadamard transform of how many documents have each mask. It has 32 numbers a
part and label whatever the corpus, and sums of parts of the corpus add up, so tasks combine theirs before the one small
shuffle. `mask_cells` inverts it exactly in whole numbers; every order and step is then a sum over the 32 cells, and a
filter's Shapley value times 120 is, in closed form, 120 divided by the number of filters that a mask fails, summed over
the documents that fail it, as each of its failures comes first in as many orders as any other.

E asks for copies over the whole table: texts meet by their sha256, first within equal part, label and outcome, so that
a group of copies is a few rows with counts before it meets as a whole. Null texts are empty texts and null sources the
part of the empty string. A document without doc_id has no smaller one and is no smaller one: it never fails E. Rows of
equal doc_id and text are documents of their own, none smaller than the other. Documents without labels are neither good
nor toxic; where a doc_id has several labels, one that says so is enough. An empty table has no parts and gives no rows.
Further columns are not read.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.shared import plain

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
LABELS = ("all", "good", "toxic")
BLANKS = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def own_failures(text: Column) -> Column:
    """The mask of A to D, which a text decides alone."""
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    few = F.size(words) < 50
    repeated = 100 * F.size(F.array_distinct(words)) < 65 * F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    loud = 100 * capitals > 5 * F.length(text)
    marked = text.rlike(r"[#$%&*|]")
    return sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate((few, repeated, loud, marked))), F.lit(0)).cast("int")


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, good, toxic, mask, n: how many documents of a part fail which filters; several rows may be alike."""
    text = F.coalesce("text", F.lit(""))
    rows = plain(docs, "doc_id", "source", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("sha"), own_failures(text).alias("mask"),
    )
    rows = rows.groupBy("doc_id", "part", "sha", "mask").agg(F.count("*").alias("n"))
    known = plain(labels, "doc_id", "quality", "toxic").filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    said = lambda column: F.max(F.coalesce(F.col(column) == 1, F.lit(False)))
    known = known.agg(said("quality").alias("good"), said("toxic").alias("toxic"))
    named = rows.filter("doc_id is not null").join(known.hint("merge"), "doc_id", "left").fillna(False, ["good", "toxic"])
    nameless = rows.filter("doc_id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    rows = named.unionByName(nameless)
    # of each text's copies alike in part, label and mask: how many there are, and the smallest doc_id with its rows
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "times")))
    alike = rows.groupBy("doc_id", "sha", "part", "mask", "good", "toxic").agg(F.sum("n").alias("times"))
    alike = alike.groupBy("sha", "part", "mask", "good", "toxic", F.col("doc_id").isNull().alias("nameless"))
    alike = alike.agg(F.sum("times").alias("n"), least.alias("least"))
    first = F.min("least.doc_id").over(Window.partitionBy("sha"))
    originals = F.when(F.col("nameless"), F.col("n")).when(F.col("least.doc_id") == first, F.col("least.times")).otherwise(0)
    alike = alike.withColumn("originals", originals)
    outcomes = F.array(
        F.struct(F.col("mask"), F.col("originals").alias("n")),
        F.struct(F.col("mask").bitwiseOR(16).alias("mask"), (F.col("n") - F.col("originals")).alias("n")),
    )
    return alike.select("part", "good", "toxic", F.explode(outcomes).alias("x")).select("part", "good", "toxic", "x.mask", "x.n").filter("n > 0")


def _sign(a: Column | int, b: Column | int) -> Column:
    both = (a if isinstance(a, Column) else F.lit(a)).bitwiseAND(b)
    return 1 - 2 * (F.bit_count(both) % 2)


def parity_sums(masked: DataFrame) -> DataFrame:
    """part, label, sums: element u is the sum over documents of -1 to the number of filters of u that they fail."""
    label = F.array(F.lit("all"), F.when(F.col("good"), "good"), F.when(F.col("toxic"), "toxic"))
    rows = masked.select("part", "mask", "n", F.explode(F.array_compact(label)).alias("label"))
    sums = [F.sum(F.col("n") * _sign(F.col("mask"), u)).alias(f"s{u}") for u in range(MASKS)]
    return rows.groupBy("part", "label").agg(*sums).select("part", "label", F.array(*(f"s{u}" for u in range(MASKS))).alias("sums"))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def _range(to: int) -> Column:
    return F.sequence(F.lit(0), F.lit(to - 1))


def mask_cells(sums: DataFrame) -> DataFrame:
    """part, and for each label the number of documents with each of the 32 masks: the transform again, divided by 32."""
    back = F.transform("sums", lambda s, u: F.transform(_range(MASKS), lambda m: s * _sign(m, u)))
    cells = F.transform(_range(MASKS), lambda m: F.call_function("div", _total(F.transform(back, lambda row: row[m])), F.lit(MASKS)))
    none = F.array_repeat(F.lit(0).cast("long"), MASKS)
    each = [F.coalesce(F.max(F.when(F.col("label") == name, F.col("cells"))), none).alias(name) for name in LABELS]
    return sums.select("part", "label", cells.alias("cells")).groupBy("part").agg(*each)


def _sum_of(cells: str, wanted) -> Column:
    return _total(F.transform(cells, lambda n, m: F.when(wanted(m), n).otherwise(0)))


def orders(cells: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, from the part's cells."""
    rows = cells.withColumn("filter_order", F.explode(F.lit(ORDERS))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    bits = {"own": F.lit(0), "before": F.lit(0)}
    for i, f in enumerate(FILTERS):
        bits["own"] = bits["own"] + F.when(letter == f, 1 << i).otherwise(0)
        bits["before"] = bits["before"] + F.when(F.instr("filter_order", f) < F.col("step"), 1 << i).otherwise(0)
    rows = rows.withColumns(bits)
    own, before = F.col("own"), F.col("before")
    fails, gone = (lambda m: m.bitwiseAND(own) != 0), (lambda m: m.bitwiseAND(before) != 0)
    removed = lambda m: fails(m) & ~gone(m)
    share = F.transform("all", lambda n, m: F.when(fails(m), n * F.call_function("div", F.lit(len(ORDERS)), F.bit_count(m))).otherwise(0))
    return rows.select(
        "part", "filter_order", "step",
        _sum_of("all", lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        _sum_of("all", removed).alias("removed"),
        _sum_of("all", lambda m: fails(m) & gone(m)).alias("redundant"),
        _sum_of("all", lambda m: m == own).alias("unique_fails"),
        _sum_of("good", removed).alias("good_lost"),
        _sum_of("toxic", removed).alias("toxic_lost"),
        _total(share).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return orders(mask_cells(parity_sums(masks(docs, labels))))


ORACLE_SQL = """
with words as (
    select doc_id, coalesce(source, '') as part, coalesce(text, '') as t,
        regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w
    from documents
), judged as (
    select doc_id, part, len(w) < 50 as a, 100 * len(list_distinct(w)) < 65 * len(w) as b,
        100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * len(t) as c, regexp_matches(t, '[#$%&*|]') as d,
        coalesce(doc_id > min(doc_id) over (partition by t), false) as e
    from words
), known as (
    select doc_id, max(coalesce(quality, 0) = 1) as good, max(coalesce(toxic, 0) = 1) as toxic from labels group by doc_id
), cells as (
    select part, a, b, c, d, e, count(*) as n, count_if(good) as good, count_if(toxic) as toxic
    from judged left join known using (doc_id) group by all
), letters as (
    select unnest(['A', 'B', 'C', 'D', 'E']) as x
), orders as (
    select p.x || q.x || r.x || s.x || t.x as filter_order from letters p, letters q, letters r, letters s, letters t
    where len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
), steps as (
    select filter_order, unnest(range(1, 6))::int as step from orders
), failures as (
    select *, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x, i: [a, b, c, d, e][i]) as failed from cells
), placed as (
    select part, filter_order, step, n, good, toxic, filter_order[step] as letter,
        len(failed) as failures, list_contains(failed, filter_order[step]) as fails,
        len(list_filter(failed, lambda x: position(x in filter_order) < step)) > 0 as gone
    from failures, steps
), counted as (
    select part, filter_order, step, letter,
        sum(if(fails or gone, 0, n))::bigint as kept, sum(if(fails and not gone, n, 0))::bigint as removed,
        sum(if(fails and gone, n, 0))::bigint as redundant, sum(if(fails and failures = 1, n, 0))::bigint as unique_fails,
        sum(if(fails and not gone, good, 0))::bigint as good_lost, sum(if(fails and not gone, toxic, 0))::bigint as toxic_lost
    from placed group by all
)
select * exclude (letter), sum(removed) over (partition by part, letter)::bigint as shapley from counted
"""
