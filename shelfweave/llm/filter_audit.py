"""Interaction audit of a filter chain: what every filter removes in every order.

A row fails some of n filters. The states are the subsets of filters that have been applied; an edge
leads from a state to the same with one filter more. What an edge removes depends on its state only, not
on the order in which the state was reached, so all n! orders are read from n 2^(n-1) edges:

* forward counting gives the orders that reach a state, backward counting those that leave it to the end;
* an order passes an edge in forward(start) x backward(end) ways, so the sum of removals over the edges of a
  filter with these weights is its Shapley sum over all orders;
* one order's steps are the removals of the edges along its path.

Rows meet as counts: each is reduced to a bit mask of the filters it fails, and per part at most
2^n masks remain. All steps are DataFrame functions.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfweave.session import fresh_path, store_table

#: A path has a row for every order and step: 7 filters give 35,280, and each further one some nine times as many.
MAX_FILTERS = 7


def lattice(n: int) -> list[tuple[int, int, int]]:
    """(state, filter, ways): the edges of the subset lattice and the number of orders that pass each."""
    size = 1 << n
    forward, backward = [0] * size, [0] * size
    forward[0] = backward[-1] = 1
    for state in range(size):
        for f in range(n):
            if not state >> f & 1:
                forward[state | 1 << f] += forward[state]
    for state in range(size - 1, -1, -1):
        for f in range(n):
            if not state >> f & 1:
                backward[state] += backward[state | 1 << f]
    return [(s, f, forward[s] * backward[s | 1 << f]) for s in range(size) for f in range(n) if not s >> f & 1]


def paths(names: list[str]) -> list[tuple[str, int, int, int]]:
    """(order, step from 1, state before it, filter) of every order of the filters."""
    found = []
    for order in permutations(range(len(names))):
        state = 0
        for step, f in enumerate(order, 1):
            found.append(("".join(names[i] for i in order), step, state, f))
            state |= 1 << f
    return found


def first_copies(rows: DataFrame, digest: str, row_id: str) -> DataFrame:
    """digest and the smallest id that has it, of all digests; rows without an id make nothing a copy."""
    return rows.filter(F.col(row_id).isNotNull()).groupBy(digest).agg(F.min(row_id).alias(row_id))


def mark_copies(rows: DataFrame, digest: str, row_id: str, name: str) -> DataFrame:
    """``rows`` with ``name``: true if a smaller id has the same digest.

    The first of a digest are looked up by digest and id together, so a digest of a third of all rows spreads over
    all partitions. Rows without an id are no copies; rows that repeat an id and a digest fare alike.
    """
    first = first_copies(rows, digest, row_id).withColumn("is_first", F.lit(True))
    return rows.join(first, [digest, row_id], "left").withColumn(
        name, F.col(row_id).isNotNull() & F.col("is_first").isNull()).drop("is_first")


def audit(failures: DataFrame, names: list[str], part: str, gold: list[str]) -> DataFrame:
    """Counts of every order and step of the filters, per part.

    ``failures`` has a boolean column for every filter in ``names`` (true: the row fails it; NULL: it does not), the text
    column ``part`` and a boolean column for each of ``gold``. Result: ``part``, ``filter_order``, ``step``, ``filter``,
    ``kept``, ``removed``, ``redundant`` (failing the filter, removed earlier), ``unique_fails``, ``shapley``, and for each
    of ``gold`` its rows removed at the step, as ``{name}_lost``. All orders and steps of every part come back, zeros
    included; an empty table has no part. A NULL part is a part of its own.
    """
    n = len(names)
    if not 0 < n <= MAX_FILTERS:
        raise ValueError(f"1 to {MAX_FILTERS} filters can be audited in all orders, not {n}")
    spark = failures.sparkSession
    mask = sum((F.when(F.col(f), F.lit(1 << i)).otherwise(0) for i, f in enumerate(names)), F.lit(0))
    counts = ["n", *gold]
    # combined map-side: a part of a third of all rows costs at most 2^n rows per task
    masks = failures.select(F.col(part).alias("part"), mask.alias("mask"), *gold).groupBy("part", "mask").agg(
        F.count("*").alias("n"), *[F.count_if(F.col(g)).alias(g) for g in gold])
    # a part's masks become one row: for every state the rows that no applied filter fails
    held = masks.groupBy("part").agg(F.collect_list(F.struct("mask", *counts)).alias("masks"))  # 2^n at most
    none = F.struct(*[F.lit(0).cast("long").alias(c) for c in counts])
    survivors = F.transform(F.sequence(F.lit(0), F.lit((1 << n) - 1)), lambda state: F.aggregate(
        F.filter("masks", lambda m: m["mask"].bitwiseAND(state) == 0), none,
        lambda total, m: F.struct(*[(total[c] + m[c]).alias(c) for c in counts])))
    states = held.select("part", survivors.alias("alive"))

    edges = F.array(*[F.struct(
        F.lit(s).alias("state"), F.lit(f).alias("f"), F.lit(s | 1 << f).alias("next"), F.lit(ways).cast("long").alias("ways"))
        for s, f, ways in lattice(n)])
    gone = lambda e, c: F.col("alive")[e["state"]][c] - F.col("alive")[e["next"]][c]
    full = F.lit((1 << n) - 1)
    bits = F.array(*[F.lit(1 << i) for i in range(n)])
    walked = states.withColumn("edges", F.transform(edges, lambda e: F.struct(
        e["state"].alias("state"), e["f"].alias("f"), e["ways"].alias("ways"),
        F.col("alive")[e["next"]]["n"].alias("kept"), gone(e, "n").alias("removed"),
        *[gone(e, g).alias(f"{g}_lost") for g in gold])))
    of = lambda e: F.filter("edges", lambda x: x["f"] == e["f"])
    alone = lambda e: F.filter(of(e), lambda x: x["state"] == full - bits[e["f"]])
    steps = walked.select("part", F.explode(F.transform("edges", lambda e: F.struct(
        e["state"].alias("state"), e["f"].alias("f"), e["kept"].alias("kept"), e["removed"].alias("removed"),
        # the edge from the empty state removes all that fail the filter, the one to the full state what no other removes
        (F.filter(of(e), lambda x: x["state"] == 0)[0]["removed"] - e["removed"]).alias("redundant"),
        alone(e)[0]["removed"].alias("unique_fails"),
        F.aggregate(of(e), F.lit(0).cast("long"), lambda total, x: total + x["ways"] * x["removed"]).alias("shapley"),
        *[e[f"{g}_lost"].alias(f"{g}_lost") for g in gold]))).alias("e")).select("part", "e.*")
    order = spark.createDataFrame(paths(names), "filter_order string, step int, state int, f int")
    labels = F.array(*[F.lit(x) for x in names])
    # at most n! n rows of a fixed size, so broadcast; every path reads its steps from the same edges
    return steps.join(F.broadcast(order), ["state", "f"]).select(
        "part", "filter_order", "step", labels[F.col("f")].alias("filter"), "kept", "removed", "redundant", "unique_fails",
        "shapley", *[f"{g}_lost" for g in gold])


#: Between words.
SPACE = r"[\x20\x09-\x0D]+"


def text_failures(
    documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang",
) -> DataFrame:
    """part, A to E (conditions on the whole text) and the labels ``good`` and ``toxic`` of every document.

    A: under 200 words. B: under half of the words distinct. C: over 3 % of the code points in A-Z. D: any of ``#$%&*|``. E: the
    text of a smaller id. A NULL text is empty, a NULL part the empty one. Of several labels of one id any 1 counts;
    documents without a label, or without an id, are neither good nor toxic. Other columns are ignored.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    rows = documents.select(
        F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), value.alias("text"))
    words = F.array_remove(F.split("text", SPACE), "")
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    # read once: what the later joins need of a text is its digest and four flags
    read = rows.withColumn("w", words).select(
        "id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), (F.size("w") < 200).alias("A"),
        (100 * F.size(F.array_distinct("w")).cast("long") < 50 * F.size("w").cast("long")).alias("B"),
        (100 * capitals.cast("long") > 3 * F.length("text").cast("long")).alias("C"),
        F.col("text").rlike(r"[#$%&*|]").alias("D"))
    read = store_table(read, fresh_path(documents.sparkSession, "failures"))
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    return mark_copies(read, "digest", "id", "E").join(known, "id", "left").select(
        "part", "A", "B", "C", "D", "E", F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"))
