"""Quality rules on repetition: the share of a text inside repeated n-grams and lines.

A batch of texts is one array of bytes. A rolling sum of byte times odd base to the power of its place, modulo
2^64, gives the hash of any stretch (Rabin, Karp 1987): of every word and every line. N-grams roll on
over the words' hashes, from one length to the next. Equal hashes within one text are found by
sorting; a word counts as covered by a length if an n-gram of that length holds it that stood earlier in the
text, so overlapping repeats count once and first occurrences not at all. The measure is characters: those of covered
words by all characters in words, per length, and likewise those in lines that equal an earlier one.

A text fails if a share passes its limit (Rae et al. 2021). Whole texts are read; memory follows the
slice of a batch, SLICE bytes, or the one text that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfweave.llm.text import packed, row_key, unpacked

#: Most that words inside n-grams seen before may take of a text's characters, per n. The published limits fall to 0.10 with
#: n; that rejects sound texts of 80 words for one line said twice, so the limit for five words holds for all.
NGRAM_LIMITS = {n: 0.15 for n in range(5, 11)}
#: Most that lines seen before may take of the characters in words.
LINE_LIMIT = 0.20
#: Words of a window whose repeats the base counts report, and the limits of the base rule: least words, most repeated (%).
WINDOW, LEAST_WORDS, MOST_REPEATED = 3, 50, 50
#: Bytes of text whose arrays are held at once.
SLICE = 2 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits (the finaliser of splitmix64), so that sums over hashes do not meet by structure."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Stretches:
    """Hashes of stretches of one byte array; holds 8 bytes a byte, and powers of the base in two levels."""

    def __init__(self, data: np.ndarray, step: int = 4096):
        blocks = len(data) // step + 1
        self.step = step
        self.low, self.high = (_powers(_inverse(int(_BASE)), step), _powers(_inverse(pow(int(_BASE), step, 1 << 64)), blocks))
        near, far = _powers(int(_BASE), step), _powers(pow(int(_BASE), step, 1 << 64), blocks)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        for b in range(blocks):
            cut = slice(b * step, min((b + 1) * step, len(data)))
            part = (data[cut].astype(np.uint64) + np.uint64(1)) * near[:cut.stop - cut.start] * far[b]
            self.sums[cut.start + 1:cut.stop + 1] = self.sums[cut.start] + np.cumsum(part, dtype=np.uint64)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The same for equal bytes wherever they stand; the length is part of it."""
        back = self.low[start % self.step] * self.high[start // self.step]
        return _mixed((self.sums[end] - self.sums[start]) * back + (end - start).astype(np.uint64) * _BASE)


def _earlier(text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every entry: whether an earlier one of its text has its hash, and whether any other one has."""
    order = np.lexsort((h, text))  # stable: equal entries stay in their order
    same = (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1])
    later, repeated = np.zeros(len(h), bool), np.zeros(len(h), bool)
    later[order[1:]] = same
    repeated[order[1:]] = same
    repeated[order[:-1]] |= same
    return later, repeated


def _covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """True for the places 0 .. n-1 inside a run of ``width`` from any of ``starts``."""
    edge = np.zeros(n + 1, np.int64)
    edge[starts] += 1
    edge[starts + width] -= 1
    return np.cumsum(edge[:-1]) > 0


def measure(data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...] = tuple(NGRAM_LIMITS)) -> dict[str, np.ndarray]:
    """The measures of every text of a UTF-8 byte array; ``offsets`` has one entry more than there are texts."""
    n = len(offsets) - 1
    data, offsets = data[offsets[0]:offsets[-1]], (offsets - offsets[0]).astype(np.int64)
    texts = np.arange(n)
    of_byte = np.repeat(texts.astype(np.int32), np.diff(offsets))
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)))  # code points before each byte
    stretches = Stretches(data)

    # words end at white space and at the edges of texts
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))))
    end = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    word_text, word_chars = of_byte[start], chars[end] - chars[start]
    word = stretches.hash(start, end)
    n_words = np.bincount(word_text, minlength=n)
    total_chars = np.bincount(word_text, word_chars, n)
    found = {"n_words": n_words, "word_chars": total_chars.astype(np.int64),
             "n_symbols": np.bincount(of_byte[_SYMBOLS[data]], minlength=n)}

    # lines end at \n and at the edges of texts; the ones without a word do not count
    cuts = np.unique(np.concatenate((offsets, np.flatnonzero(data == 10) + 1)))
    line_start, line_end = cuts[:-1], cuts[1:] - (data[cuts[1:] - 1] == 10)
    used = np.concatenate(([0], np.cumsum(inside & ((data & 0xC0) != 0x80), dtype=np.int32)))  # code points in words
    own = used[line_end] - used[line_start]
    line_start, line_end, own = line_start[own > 0], line_end[own > 0], own[own > 0]
    line_text = of_byte[line_start]
    later, _ = _earlier(line_text, stretches.hash(line_start, line_end))
    found["n_dup_lines"] = np.bincount(line_text[later], minlength=n)
    found["line_share"] = np.bincount(line_text[later], own[later], n) / np.maximum(total_chars, 1)

    rolled = np.zeros(len(word), np.uint64)
    for width in range(1, max((WINDOW, *lengths)) + 1):
        m = len(word) - width + 1
        if m <= 0:
            break
        rolled = rolled[:m] * _BASE + word[width - 1:]
        if width != WINDOW and width not in lengths:
            continue
        whole = np.flatnonzero(word_text[:m] == word_text[width - 1:])  # an n-gram does not cross texts
        later, repeated = _earlier(word_text[whole], _mixed(rolled[whole]))
        if width == WINDOW:
            held = _covered(whole[repeated], width, len(word))
            found["n_repeat_words"] = np.bincount(word_text[held], minlength=n)
        if width in lengths:
            held = _covered(whole[later], width, len(word))
            found[f"share_{width}"] = np.bincount(word_text[held], word_chars[held], n) / np.maximum(total_chars, 1)
    for name in ("n_repeat_words", *(f"share_{width}" for width in lengths)):
        found.setdefault(name, np.zeros(n, np.int64 if name.startswith("n_") else float))
    return found


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``measure`` of column ``text``, beside the other columns."""
    for batch in batches:
        text = batch.column("text").cast(pa.large_string()).fill_null("")
        _, places, data = text.buffers()
        places = np.frombuffer(places, np.int64)[text.offset:text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
        data, at = np.frombuffer(data or b"", np.uint8), 0
        while at < len(text):
            # as many texts as SLICE holds, one at least
            to = max(at + 1, int(np.searchsorted(places, places[at] + SLICE, side="right")) - 1)
            found = measure(data, places[at:to + 1])
            kept = [batch.column(i).slice(at, to - at) for i, name in enumerate(batch.schema.names) if name != "text"]
            yield pa.RecordBatch.from_arrays(
                [*kept, *[pa.array(found[name], pa.int64()) for name in COUNTS], *[pa.array(found[name], pa.float64()) for name in SHARES]],
                [*[name for name in batch.schema.names if name != "text"], *COUNTS, *SHARES])
            at = to


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SHARES = ["line_share", *(f"share_{n}" for n in NGRAM_LIMITS)]


def repetition(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, the counts, the shares, ``base_failed`` and ``kept`` of every row.

    ``n_words``; ``word_chars``, code points in words; ``n_symbols``, characters of ``#*$%&|<>``; ``n_dup_lines``, lines with a
    word that equal an earlier one; ``n_repeat_words``, words inside windows of three that occur twice or more.
    ``line_share`` and ``share_5`` to ``share_10`` are the method's measures, from 0 to 1. ``base_failed``: under LEAST_WORDS words, or
    over MOST_REPEATED percent of them repeated. ``kept``: the base holds and no share is above its limit; a share
    equal to its limit passes.

    NULL, empty and blank texts have no words, all measures 0, and fail the base. Words are told apart by
    64-bit hashes. Rows that repeat stay as they are, with equal results; an empty table gives no rows; other
    columns are ignored.
    """
    id_type = documents.schema[doc_id].dataType.simpleString()
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = ", ".join([f"doc_id {id_type}", *(f"{c} long" for c in COUNTS), *(f"{s} double" for s in SHARES)])
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    limits = [(F.col("line_share") <= LINE_LIMIT), *(F.col(f"share_{n}") <= most for n, most in NGRAM_LIMITS.items())]
    passes = limits[0]
    for limit in limits[1:]:
        passes = passes & limit
    return rows.mapInArrow(_batches, schema).select(
        "*", failed.alias("base_failed"), (~failed & passes).alias("kept"))


def keep_varied(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` without the rows that ``repetition`` rejects; all columns stay as they are, NULL texts go.

    Rows that repeat id and text share a verdict, so all stay or go; an empty table stays empty.
    """
    verdict = repetition(packed(documents, doc_id=row_key(F.col(doc_id), F.col(text)), text=F.col(text)))
    kept = verdict.filter("kept").select(F.col("doc_id").alias("key")).distinct()
    return unpacked(packed(documents, key=row_key(F.col(doc_id), F.col(text))).join(kept, "key", "left_semi"))
