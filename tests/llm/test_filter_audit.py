import random
from itertools import permutations

import pytest

from shelfweave.llm import filter_audit


def simulated(rows, names):
    """(part, order, step) -> counts, by applying the filters one after another to every row."""
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        removed_by = dict.fromkeys(names, 0)
        for order in permutations(range(len(names))):
            left = own
            for step, f in enumerate(order, 1):
                gone, fails = [r for r in left if r[1][f]], [r for r in own if r[1][f]]
                left = [r for r in left if not r[1][f]]
                removed_by[names[f]] += len(gone)
                out[part, "".join(names[i] for i in order), step] = [
                    names[f], len(left), len(gone), len(fails) - len(gone), sum(sum(r[1]) == 1 for r in fails),
                    sum(r[2] for r in gone)]
        for key, counts in out.items():
            if key[0] == part:
                counts.append(removed_by[counts[0]])
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("names", [["A"], ["A", "B", "C"], ["v", "w", "x", "y"]])
def test_every_order_against_a_simulation(spark, names):
    rng = random.Random(len(names))
    rows = [(rng.choice(["en", "de", None]), [rng.random() < 0.4 for _ in names], rng.random() < 0.5) for _ in range(300)]
    df = spark.createDataFrame(
        [(p, *f, g) for p, f, g in rows], ", ".join(["lang STRING", *(f"`{n}` BOOLEAN" for n in names), "gold BOOLEAN"]))
    got = {(r.part, r.filter_order, r.step): (r.filter, r.kept, r.removed, r.redundant, r.unique_fails, r.gold_lost, r.shapley)
           for r in filter_audit.audit(df, names, "lang", ["gold"]).collect()}
    assert got == simulated(rows, names)


def test_orders_through_the_lattice():
    edges = filter_audit.lattice(5)
    assert len(edges) == 80 and len(filter_audit.paths(list("ABCDE"))) == 600
    for step in range(5):  # every order passes one edge per step
        assert sum(ways for state, _, ways in edges if state.bit_count() == step) == 120
    with pytest.raises(ValueError):
        filter_audit.audit(None, list("ABCDEFGH"), "part", [])


def test_awkward_documents(spark, corpus, no_documents):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (4, None, None), (None, 1, 1), (99, 1, 1)], "doc_id LONG, quality INT, toxic INT")
    rows = [r.asDict() for r in filter_audit.text_failures(corpus, labels).collect()]
    assert len(rows) == corpus.count() and {r["part"] for r in rows} == {"en", "de", "fr", ""}
    # 17 repeats 16, 4 repeats 3 (NULL is empty); rows that repeat id and text, and rows without an id, are no copies
    assert sum(r["E"] for r in rows) == 2
    assert sum(r["good"] and r["toxic"] for r in rows) == 2 and sum(r["good"] for r in rows) == 2
    empty = filter_audit.text_failures(no_documents, labels)
    assert filter_audit.audit(empty, list("ABCDE"), "part", ["good"]).count() == 0
    counts = filter_audit.audit(filter_audit.text_failures(corpus, labels), list("ABCDE"), "part", ["good", "toxic"])
    assert counts.count() == 4 * 600


def test_conditions_at_their_limits(spark):
    cases = {
        "A": [("w " * 199, True), ("w " * 200, False)],
        "B": [("a b", False), ("a a", False), ("a a a", True), ("", False)],
        "C": [("A" * 3 + "b" * 97, False), ("A" * 4 + "b" * 96, True), ("É" * 100, False), ("", False)],
        "D": [("50 %", True), ("a^b", False), ("a|b", True)],
    }
    rows = [(i, name, text, want) for i, (name, text, want) in enumerate(
        (n, t, w) for n, found in cases.items() for t, w in found)]
    docs = spark.createDataFrame([(i, t, str(i)) for i, _, t, _ in rows], "doc_id LONG, text STRING, lang STRING")
    none = spark.createDataFrame([], "doc_id LONG, quality INT, toxic INT")
    got = {r["part"]: r for r in filter_audit.text_failures(docs, none).collect()}
    assert [(i, n) for i, n, _, want in rows if got[str(i)][n] != want] == []
