import random

from shelfweave.llm.line_dedup import dedup_lines
from tests.llm import brute


def test_random_lines_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice(["a", "b", "", " "]) for _ in range(rng.randint(1, 14)))) for i in range(150)]
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id LONG, text STRING")).collect()}
    assert got == brute.line_dedup(rows)


def test_awkward_rows(corpus, no_documents):
    rows = dedup_lines(corpus).collect()
    assert len(rows) == corpus.count() and dedup_lines(no_documents).count() == 0
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by_id[3].text is None and by_id[3].n_lines == 0 and by_id[4].text == "" and by_id[4].n_lines == 1
    assert by_id[11].n_removed == 0
    assert by_id[12].text == "x\ny" and by_id[12].removed == [1, 2, 3]
    assert by_id[13].text == "q\nz" and by_id[13].removed == [1, 2, 3, 4]
    assert by_id[16].n_removed == by_id[17].n_removed == 0  # blank windows do not count
    assert len({r.text for r in rows if r.doc_id == 1}) == 1  # repeated rows fare alike
