import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np

from shelfweave.llm import quality_rules
from tests.llm import brute


def expected(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    found = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum((text or "").count(c) for c in "#*$%&|<>")}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    later = [x for i, x in enumerate(lines) if x in lines[:i]]
    found["n_dup_lines"] = len(later)
    total = max(1, found["word_chars"])
    found["line_share"] = sum(len(re.sub(r"[\x20\x09-\x0D]", "", x)) for x in later) / total
    for n in (3, *quality_rules.NGRAM_LIMITS):
        grams = [tuple(words[i:i + n]) for i in range(len(words) - n + 1)]
        count, seen, held = Counter(grams), set(), set()
        for i, g in enumerate(grams):
            if count[g] > 1 if n == 3 else g in seen:
                held.update(range(i, i + n))
            seen.add(g)
        if n == 3:
            found["n_repeat_words"] = len(held)
        else:
            found[f"share_{n}"] = sum(len(words[i]) for i in held) / total
    return found


def measured(texts):
    data = [(t or "").encode() for t in texts]
    flat = np.frombuffer(b"".join(data), np.uint8)
    out = quality_rules.measure(flat, np.concatenate(([0], np.cumsum([len(d) for d in data]))))
    return [{k: v[i] for k, v in out.items()} for i in range(len(texts))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "é", "　", " ", "\n", "\t", "##", "𝄞"]), max_size=60).map("".join), min_size=1, max_size=4))
def test_measures_by_hand(texts):
    for text, got in zip(texts, measured(texts)):
        assert got == pytest.approx(expected(text)), repr(text)


def test_a_very_long_text_between_short_ones():
    texts = ["x y", " ".join(f"w{i % 40_000}" for i in range(60_000)), "", "x y"]
    got = measured(texts)
    assert got[1]["n_repeat_words"] == 40_000 and got[0] == got[3] == pytest.approx(expected("x y"))
    assert got[1]["share_5"] == pytest.approx(sum(len(f"w{i}") for i in range(20_000)) / got[1]["word_chars"])


def test_awkward_documents(corpus, no_documents):
    rows = quality_rules.repetition(corpus).collect()
    texts = Counter((r.doc_id, r.text) for r in corpus.collect())
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _ in texts.elements())
    wanted = {d: expected(t) for d, t in texts if d is not None}
    for r in rows:
        if r.doc_id is not None:
            assert {k: r[k] for k in wanted[r.doc_id]} == pytest.approx(wanted[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert quality_rules.repetition(no_documents).count() == quality_rules.keep_varied(no_documents).count() == 0


def test_limits_are_inclusive_and_columns_stay(spark):
    sound = " ".join(f"w{i:03d}" for i in range(60))
    line = " ".join(f"x{i:03d}" for i in range(20))
    rows = [(1, sound), (1, sound), (2, None), (3, f"{sound} {line}\n{line}\n"), (4, "a b c " * 40), (5, "\n".join([line] * 2 + [sound]))]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id LONG, text STRING, kept INT, key STRING")
    kept = quality_rules.keep_varied(docs)
    # 3 and 5: twenty words of a hundred seen before, above 15 %
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 1]
    exact = " ".join(f"a{i:03d}" for i in range(85)) + " " + " ".join(f"a{i:03d}" for i in range(15))
    at = quality_rules.repetition(spark.createDataFrame([(1, exact)], "doc_id LONG, text STRING")).first()
    assert at.share_5 == 0.15 and at.kept
