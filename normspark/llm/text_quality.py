"""Text quality statistics per document, with mergeable quantile sketches per language and flagged tails.

Every document gets statistics of its characters, words, lines and stretches (``STATISTICS``); no list of
words takes part but the given common words. Over the whole corpus a KLL quantile sketch is built for each
statistic and language (partial sketches merge, so the shuffle carries one sketch a task, statistic and language). From
the merged sketches each value becomes a percentile step and a robust z-score, (value - median) / IQR * 1.349.

Tails are put together to one score in two steps, without labels:

1. **Seeds.** A document with two or more statistics beyond ``TAIL_Z`` that hardly has sentences in form
   (``sentence_form``) is a junk seed; one without any, mostly near the medians and in sentences, is a prose seed. How
   much more often the seeds of one kind have a percentile step of a statistic than those of the other
   (log ratio, within ``MOST_WEIGHT``) is the step's weight, and the mean weight over the statistics is
   ``tail_score``: below 0 a document lies in the tails.
2. **Words.** Documents well inside (``tail_score`` above ``SURE``) and well in the tails teach the same log ratio for pairs
   of neighbouring tokens (words, numbers, marks, line ends), hashed into ``BUCKETS``; after each of
   ``ROUNDS`` rounds the documents are told apart anew. Like sketches and weights of the steps it is fitted on all documents.

``sentence_share`` is the share of non-blank characters around which the pairs' mean weight over
``WINDOW`` tokens and the document's ``tail_score`` speak for running text; a document below ``LEAST_SHARE`` is flagged (``not_prose``).

The texts are read once: statistics and pairs of a document are kept as a row (four bytes a token), and sketches, rounds and the
result go over these. All of it is numpy over the code points of a batch. A language with fewer than ``LEAST_DOCUMENTS`` takes the sketches of the whole corpus.

Defined results: null and blank texts have 0 words, null statistics, and are never flagged. Language
notations (case, region) are brought together; a null language is ``und``. Whole texts are read.
Repeated ids keep their rows. Further columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normspark.session import cut, require, spread

#: A document with less of its characters in running text is flagged.
LEAST_SHARE = 0.5
#: Common words sent to the executors, at most.
MOST_COMMON = 5_000
#: Robust z-score beyond which a value is in a tail, and within which it is near the median.
TAIL_Z, NEAR_Z = 3.5, 1.5
#: Share of sentences in form that parts the seeds.
SEED_FORM = 0.5
#: Steps of the percentiles that are read from a sketch, and the most that a step weighs.
STEPS, MOST_WEIGHT = 20, 3.0
#: Characters that are measured at once.
PART = 1 << 17
#: A language's own sketches need so many documents.
LEAST_DOCUMENTS = 50
#: The pair model: hash buckets; rounds; sure tail scores; tokens of a window; weight of the tail score.
BUCKETS, ROUNDS, SURE, WINDOW, TAIL_WEIGHT = 1 << 18, 4, 0.2, 9, 0.25
#: A kept token is its bucket, whether its pair is the document's first of that bucket, and its size; the sizes from this one on are kept apart.
FIRST, SIZE, LONG = BUCKETS, 19, (1 << 12) - 1

STATISTICS = [
    "mean_word_length", "symbol_ratio", "digit_ratio", "punctuated_lines", "common_share", "words_per_line",
    "word_variety", "run_words", "sentence_form", "separators", "short_lines", "marked_lines",
]

_TAG = re.compile(r"</?[A-Za-z][^<>]{0,500}>")
_INVISIBLE = re.compile("[­​‌‍﻿]")
_MARKUP = re.compile(r"\*\*|__|``?|~~")

# bits of a code point
LETTER, DIGIT, SPACE, NEWLINE, LOWER, SINGLE, END, WIDE_END, CLOSER, OPENER, SEPARATOR, JOINER = (1 << i for i in range(12))
_BITS: dict[int, np.ndarray] = {}
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _bits_of(code: int) -> int:
    c = chr(code)
    bits = (LETTER if c.isalpha() else 0) | (DIGIT if c.isdigit() else 0) | (SPACE if c.isspace() else 0) | (NEWLINE if c in "\n\r\x85  " else 0) | (LOWER if c.islower() else 0)
    if 0x3040 <= code <= 0x30FF or 0x3400 <= code <= 0x9FFF:
        bits |= SINGLE  # written without blanks: each character is a word
    bits |= (END if c in ".!?…" else 0) | (WIDE_END if c in "。！？" else 0) | (CLOSER if c in "\"'”’»)]*」" else 0) | (OPENER if c in "\"'“„«(¿¡—–>*-「" else 0)
    return bits | (SEPARATOR if c in "|{}[]=<>/\\_" else 0) | (JOINER if c in "'’-" else 0)


def bits_of(codes: np.ndarray) -> np.ndarray:
    """The bits of code points; the first plane from a table, the rare others one by one."""
    if 0 not in _BITS:
        _BITS[0] = np.array([_bits_of(i) for i in range(1 << 16)], np.uint16)
    out = _BITS[0][np.minimum(codes, 0xFFFF)]
    high = np.flatnonzero(codes > 0xFFFF)
    if len(high):
        own, back = np.unique(codes[high], return_inverse=True)
        out[high] = np.array([_bits_of(int(c)) for c in own], np.uint16)[back]
    return out


def cleaned(text: str | None) -> str:
    """The text without invisible characters, tags and marks of emphasis."""
    t = text or ""
    if not t.isascii():
        t = _INVISIBLE.sub("", t)
    if "<" in t:
        t = _TAG.sub(" ", t)
    return _MARKUP.sub("", t)


def language(column: str = "lang"):
    """A language notation without case and region; ``und`` where there is none."""
    base = F.regexp_extract(F.lower(F.trim(column)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(F.length(base) > 0, base).otherwise("und")


def word_hashes(words: list[str]) -> np.ndarray:
    """The hashes that ``Batch`` gives to words; one that it takes for several words (Japanese, of more than one character) has none."""
    found = [Batch([w]).word_hash.tolist() for w in words]
    return np.unique(np.array([h[0] for h in found if len(h) == 1], np.uint64))


def _ratio(top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
    return np.divide(top, bottom, out=np.full(len(top), np.nan), where=bottom > 0)


class Batch:
    """The texts of a batch as one array of code points, with words, lines and tokens as arrays."""

    def __init__(self, texts: list[str]) -> None:
        self.n = len(texts)
        joined = "\n".join(texts) + "\n"
        ends = np.cumsum([len(t) + 1 for t in texts])
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.int32)
        low = joined.lower()
        lowered = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32) if len(low) == len(joined) else np.array([ord(c.lower()[0]) for c in joined], np.uint32)
        self.codes, self.bits = codes, bits_of(codes)
        self.doc = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(ends, prepend=0))
        self.letter, self.digit, self.space, self.newline = (self.bits & b != 0 for b in (LETTER, DIGIT, SPACE, NEWLINE))
        self.newline[ends - 1] = True  # the end of a text ends its line
        self.solid = ~self.space
        # a token is a word, one character of a script without blanks, a number, a line end, or one mark
        single = self.bits & SINGLE != 0
        kind = np.where(self.solid, np.int8(4), np.int8(0))
        kind[self.newline], kind[self.digit], kind[self.letter & ~single] = 3, 2, 1
        new = np.ones(len(codes), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 4)
        # runs of line ends (with blanks between them) are one token
        starts = np.flatnonzero(new & (kind > 0))
        k = kind[starts]
        keep = np.ones(len(starts), bool)
        keep[1:] = ~((k[1:] == 3) & (k[:-1] == 3) & (self.doc[starts[1:]] == self.doc[starts[:-1]]))
        # a polynomial hash of any range from two sums
        powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(codes), _ODD)]))
        sums = np.concatenate([[np.uint64(0)], np.add.accumulate((lowered.astype(np.uint64) + np.uint64(1)) * powers[:-1])])
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(codes), inverse)]))
        at = np.flatnonzero(new)
        stop = np.append(at[1:], len(codes))[kind[at] > 0]
        hashes = (sums[stop] - sums[starts]) * back[starts]
        hashes = np.where(k == 2, np.uint64(2), np.where(k == 3, np.uint64(3), np.where(stop - starts > 20, np.uint64(5), hashes)))
        word = (k == 1) | ((k == 4) & single[starts] & self.letter[starts])
        self.word_start, self.word_size, self.word_hash = starts[word], (stop - starts)[word], hashes[word]
        self.token_start, self.token_size, self.token_hash, self.token_doc = starts[keep], np.where(k == 3, 0, stop - starts)[keep], hashes[keep], self.doc[starts[keep]]

    def per_doc(self, positions: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(self.doc[positions], weights, self.n).astype(np.float64)

    def statistics(self, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of words, and one row a text with the values of ``STATISTICS`` (NaN where undefined)."""
        bits, doc, n = self.bits, self.doc, self.n
        solid = np.flatnonzero(self.solid)
        n_solid, n_words = self.per_doc(solid), self.per_doc(self.word_start)
        symbols = np.flatnonzero(self.solid & ~self.letter & ~self.digit)
        near = common[np.minimum(np.searchsorted(common, self.word_hash), len(common) - 1)] if len(common) else np.zeros(len(self.word_hash), np.uint64)
        common_words = self.word_start[(near == self.word_hash) & (len(common) > 0)]
        pairs = np.unique(self.doc[self.word_start].astype(np.uint64) << np.uint64(40) ^ (self.word_hash >> np.uint64(24)))
        kinds = np.bincount((pairs >> np.uint64(40)).astype(np.int64), minlength=n).astype(np.float64)

        # lines: number of solid characters, words, first and last solid character
        line_of = np.cumsum(self.newline, dtype=np.int32) - self.newline
        n_lines = int(line_of[-1]) + 1
        line_doc = np.zeros(n_lines, np.int64)
        line_doc[line_of] = doc
        own = line_of[solid]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        last = np.append(first[1:], len(solid)) - 1
        held = own[first] if len(first) else np.empty(0, np.int64)
        line_words = np.bincount(line_of[self.word_start], minlength=n_lines)
        line_size = np.bincount(own, minlength=n_lines)
        lines = np.bincount(line_doc[held], minlength=n).astype(np.float64)

        def share(flag: np.ndarray) -> np.ndarray:
            return _ratio(np.bincount(line_doc[held], flag.astype(np.float64), n), lines)

        # what a place ends with: the last character that closes nothing
        s_bits, place = bits[solid], np.arange(len(solid))
        plain = np.maximum.accumulate(np.where(s_bits & CLOSER == 0, place, 0)) if len(solid) else place
        ended = s_bits[plain] & (END | WIDE_END) != 0 if len(solid) else np.empty(0, bool)
        marks = self.codes[solid]
        colon = (marks == ord(":")) | (marks == ord(";"))
        short = (line_words[held] < 4) & (line_size[held] < 36)
        opens = s_bits[first] if len(first) else s_bits
        # a label: a colon and a blank within the first characters of a line, after two words at most
        marks = np.flatnonzero((self.codes[:-1] == ord(":")) & self.space[1:] & ~self.newline[1:])
        begin = solid[first] if len(first) else solid
        mark = np.append(marks, len(self.codes))[np.searchsorted(marks, begin)]
        blanks = np.concatenate([[0], np.cumsum(self.space, dtype=np.int32)])
        label = (mark - begin <= 32) & (mark > begin) & (line_of[np.minimum(mark, len(self.codes) - 1)] == held) & (blanks[np.minimum(mark, len(self.codes))] - blanks[begin] <= 1)
        marked = ((opens & (LETTER | OPENER) == 0) | (opens & DIGIT != 0) | label) if len(first) else np.empty(0, bool)

        # stretches: to an end followed by a blank, or to a line end that the next line doesn't go on from in lower case
        n_s = len(solid)
        form = np.zeros(n)
        if n_s:
            gap = np.diff(solid, append=solid[-1] + 2)
            next_line = np.append(own[1:] != own[:-1], True)
            next_doc = np.append(doc[solid[1:]] != doc[solid[:-1]], True)
            next_low = np.append(s_bits[1:] & LOWER != 0, False)
            stop = next_doc | (next_line & (ended | ~next_low)) | ((gap > 1) & ended) | (s_bits & WIDE_END != 0)
            b = np.flatnonzero(stop)
            a = np.concatenate([[0], b[:-1] + 1])
            telling = np.minimum.accumulate(np.where(s_bits & OPENER == 0, place, n_s - 1)[::-1])[::-1]
            starts = s_bits[telling[a]]
            good = (starts & LETTER != 0) & (starts & LOWER == 0) & ended[b] & (b - a >= 7)
            form = np.bincount(doc[solid[a]], np.where(good, b - a + 1, 0), n)

        # separators: tabs, bars and brackets, gaps and leaders, commas and semicolons without a blank
        c = self.codes
        nxt = np.append(bits[1:], SPACE)
        tight = ((c == ord(",")) | (c == ord(";"))) & (nxt & (SPACE | DIGIT) == 0)
        dot = np.concatenate([c == ord("."), [False] * 4])
        leader = dot[:-4] & dot[1:-3] & dot[2:-2] & dot[3:-1] & ~np.concatenate([[False], dot[:-5]])
        wide_gap = np.zeros(len(c), bool)
        if n_s > 1:
            wide_gap[solid[:-1][(np.diff(solid) > 3) & (own[1:] == own[:-1])]] = True
        parts = np.flatnonzero((bits & SEPARATOR != 0) | (c == 9) | tight | leader | wide_gap)

        # runs of words between marks
        dash = np.zeros(len(c), bool)
        dash[1:-1] = (bits[1:-1] & JOINER != 0) & self.space[:-2] & self.space[2:]
        double = np.zeros(len(c), bool)
        double[1:] = self.space[1:] & self.space[:-1]
        breaks = np.cumsum((self.solid & ~self.letter & ~self.digit & (bits & JOINER == 0)) | self.newline | dash | double | (c == 9), dtype=np.int32)
        run = breaks[self.word_start]
        runs = np.bincount(doc[self.word_start[np.flatnonzero(np.diff(run, prepend=-1))]], minlength=n).astype(np.float64)

        letters = np.bincount(doc[self.word_start], self.word_size, n)
        columns = [
            _ratio(letters, n_words), _ratio(self.per_doc(symbols), n_solid), _ratio(self.per_doc(np.flatnonzero(self.digit)), n_solid),
            share(ended[last] | colon[plain[last]]) if len(first) else np.full(n, np.nan), _ratio(self.per_doc(common_words), n_words), _ratio(n_words, lines),
            _ratio(kinds, np.sqrt(n_words)), _ratio(n_words, runs), _ratio(form, n_solid), _ratio(self.per_doc(parts), np.where(n_solid > 0, np.maximum(n_words, 1), 0)),
            share(short), share(marked),
        ]
        return n_words, np.stack(columns, 1)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token the bucket of the pair with the token before it, its document and its size."""
        before = np.concatenate([[np.uint64(3)], self.token_hash[:-1]])
        before[np.flatnonzero(np.diff(self.token_doc, prepend=-1))] = np.uint64(3)  # a text begins like a line
        h = (before * np.uint64(0xBF58476D1CE4E5B9) + self.token_hash) * _ODD
        h ^= h >> np.uint64(29)
        return ((h * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - 18)).astype(np.int64) % BUCKETS, self.token_doc, self.token_size


def window_share(weights: np.ndarray, doc: np.ndarray, size: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Per document the share of characters around which the mean weight and the document's ``base`` are above 0."""
    n = len(base)
    sums = np.concatenate([[0.0], np.cumsum(weights)])
    first, last = np.searchsorted(doc, np.arange(n), "left")[doc], np.searchsorted(doc, np.arange(n), "right")[doc]
    at, half = np.arange(len(doc)), WINDOW // 2
    low, high = np.maximum(first, at - half), np.minimum(last, at + half + 1)
    good = (sums[high] - sums[low]) / WINDOW + base[doc] > 0
    return _ratio(np.bincount(doc, size * good, n), np.bincount(doc, size, n).astype(np.float64))


class Scale:
    """Percentiles of each statistic per language, read from the merged sketches, and the weights of the steps."""

    def __init__(self, grids: dict[str, np.ndarray], weights: np.ndarray | None = None) -> None:
        self.grids, self.weights = grids, weights

    def steps_and_z(self, languages: list[str], values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Percentile step (0 to ``STEPS``, -1 if undefined) and robust z-score of each value."""
        steps, z = np.full(values.shape, -1, np.int64), np.full(values.shape, np.nan)
        names = np.array(languages, dtype=object)
        for name in set(languages):
            own = np.flatnonzero(names == name)
            grid = self.grids.get(name, self.grids[""])
            for j in range(values.shape[1]):
                g, v = grid[j], values[own, j]
                if np.isnan(g).any():
                    continue
                inner = g[1:-1]
                at = (np.searchsorted(inner, v, "left") + np.searchsorted(inner, v, "right")) // 2  # ties take the middle of their steps
                steps[own, j] = np.where(np.isnan(v), -1, at)
                q1, median, q3 = g[STEPS // 4], g[STEPS // 2], g[3 * STEPS // 4]
                if q3 > q1:
                    z[own, j] = (v - median) / (q3 - q1) * 1.349
        return steps, z

    def tail_score(self, steps: np.ndarray) -> np.ndarray:
        """The mean weight of the steps; undefined values weigh nothing."""
        weights = np.concatenate([self.weights, np.zeros((len(self.weights), 1))], 1)  # step -1 is the last column
        return np.stack([weights[j][steps[:, j]] for j in range(steps.shape[1])], 1).mean(1)


def seeds(values: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(prose, junk): documents near the medians and in sentences; documents in several tails and hardly in sentences."""
    size = np.nan_to_num(np.abs(z), nan=0.0)
    tails, near, form = (size > TAIL_Z).sum(1), (size < NEAR_Z).mean(1), values[:, STATISTICS.index("sentence_form")]
    with np.errstate(invalid="ignore"):
        return (tails == 0) & (near > 0.7) & (form >= SEED_FORM), (tails >= 2) & (form < SEED_FORM)


def log_ratios(prose: np.ndarray, junk: np.ndarray, n_prose: float, n_junk: float, smooth: float) -> np.ndarray:
    ratio = np.log((prose + smooth) / (n_prose + 2 * smooth)) - np.log((junk + smooth) / (n_junk + 2 * smooth))
    return np.clip(ratio, -MOST_WEIGHT, MOST_WEIGHT)


# --- passes


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Batches of up to ``PART`` characters, so that the arrays stay in a core's cache (one longer text is whole)."""
    for batch in batches:
        sizes = np.cumsum([len(t or "") for t in batch.column("text").to_pylist()]) if batch.num_rows else np.empty(0)
        start = 0
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, base + PART, "right")))
            part = batch.slice(start, stop - start)
            yield part, [cleaned(t) for t in part.column("text").to_pylist()]
            start = stop


def _values(columns: np.ndarray) -> list[pa.Array]:
    return [pa.array(c, pa.float64(), from_pandas=True) for c in columns.T]


def _measure(common: np.ndarray, pairs: bool):
    """Statistics of each document, on demand with its tokens."""
    names = ["doc_id", "language", "n_words", *STATISTICS, *(["tokens", "long_sizes"] if pairs else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _parts(batches):
            batch = Batch(texts)
            n_words, values = batch.statistics(common)
            kept = _kept(batch) if pairs else []
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("language"), pa.array(n_words, pa.int64()), *_values(values), *kept], names)

    return run


def _kept(batch: Batch) -> list[pa.Array]:
    """The tokens of each document as 32-bit numbers, and the sizes that don't fit into them, in order."""
    bucket, doc, size = batch.pairs()
    _, at = np.unique(doc.astype(np.int64) * BUCKETS + bucket, return_index=True)
    first = np.zeros(len(bucket), np.int64)
    first[at] = FIRST
    words = (bucket | first | np.minimum(size, LONG).astype(np.int64) << SIZE).astype(np.int32)
    bounds, long = np.arange(batch.n + 1), size >= LONG
    tokens = pa.Array.from_buffers(pa.binary(), batch.n, [None, pa.py_buffer((4 * np.searchsorted(doc, bounds)).astype(np.int32)), pa.py_buffer(words)])
    return [tokens, pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[long], bounds), pa.int32()), pa.array(size[long], pa.int32()))]


def _tokens(batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of up to ``PART`` tokens at once (one longer document is whole): the documents, and for each token its bucket, its document among these, its size, whether it is first."""
    column = batch.column("tokens")
    ends = np.cumsum(np.asarray(pc.binary_length(column)) // 4) if batch.num_rows else np.empty(0, np.int64)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + PART, "right")))
        words = np.frombuffer(b"".join(column.slice(start, stop - start).to_pylist()), np.int32)
        size = words >> SIZE
        long = np.flatnonzero(size == LONG)
        if len(long):
            size = size.copy()
            size[long] = np.asarray(batch.column("long_sizes").slice(start, stop - start).flatten())
        yield slice(start, stop), (words & (BUCKETS - 1)).astype(np.int64), np.repeat(np.arange(stop - start), np.diff(ends[start:stop], prepend=base)), size, words & FIRST != 0
        start = stop


def _statistics(batch: pa.RecordBatch) -> np.ndarray:
    """The columns of ``STATISTICS`` as rows; NaN where undefined."""
    return np.stack([batch.column(s).to_numpy(zero_copy_only=False) for s in STATISTICS], 1).astype(np.float64) if batch.num_rows else np.empty((0, len(STATISTICS)))


def _count_steps(scale):
    """For each statistic and step the prose and junk seeds that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(STATISTICS), STEPS + 1), np.int64)
        for batch in batches:
            values = _statistics(batch)
            steps, z = scale.value.steps_and_z(batch.column("language").to_pylist(), values)
            for c, own in enumerate(seeds(values, z)):
                for j in range(len(STATISTICS)):
                    known = steps[own, j]
                    total[c, j] += np.bincount(known[known >= 0], minlength=STEPS + 1)
        c, j, step = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()) for x in (c, j, step)] + [pa.array(total[c, j, step], pa.int64())], ["c", "j", "step", "n"])

    return run


def _teach(scale, weights):
    """Documents of either kind in which a pair stands; the kinds by the weights so far, or else by the tail score alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            tails = scale.value.tail_score(scale.value.steps_and_z(batch.column("language").to_pylist(), _statistics(batch))[0])
            for own, bucket, doc, size, first in _tokens(batch):
                tail = tails[own]
                if weights is None:
                    prose, junk = tail > SURE, tail < -SURE
                else:
                    good = window_share(weights.value[bucket], doc, size, TAIL_WEIGHT * tail)
                    with np.errstate(invalid="ignore"):
                        prose, junk = (good >= LEAST_SHARE) & (tail > -SURE), (good < LEAST_SHARE) & (tail < SURE)
                once, in_doc = bucket[first], doc[first]
                for c, kind in enumerate((prose, junk)):
                    total[c] += np.bincount(once[kind[in_doc]], minlength=BUCKETS)
                    n[c] += kind.sum()
        c, at = np.nonzero(total)
        keys, counts = np.concatenate([c * BUCKETS + at, [-1, -2]]), np.concatenate([total[c, at], n])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], ["key", "n"])

    return run


def _judge(scale, weights, whole: bool):
    """Statistics, steps, scores and shares of each document; not ``whole``: only what the flag needs."""
    names = ["doc_id", "language", "n_words", *STATISTICS, *(f"{s}_pct" for s in STATISTICS), *(f"{s}_z" for s in STATISTICS), "tail_score", "sentence_share"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _statistics(batch)
            steps, z = scale.value.steps_and_z(batch.column("language").to_pylist(), values)
            tail = scale.value.tail_score(steps)
            share = np.concatenate([np.empty(0), *(window_share(weights.value[bucket], doc, size, TAIL_WEIGHT * tail[own]) for own, bucket, doc, size, _ in _tokens(batch))])
            if not whole:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_values(share[:, None])], ["doc_id", "sentence_share"])
                continue
            tail = np.where(np.isnan(share), np.nan, tail)
            percent = np.where(steps < 0, np.nan, steps / STEPS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("language"), batch.column("n_words"), *_values(values), *_values(percent), *_values(z), *_values(np.stack([tail, share], 1))], names)

    return run


def _common(common_words: DataFrame) -> np.ndarray:
    require(common_words, ["word"])
    words = [r[0] for r in common_words.where("word IS NOT NULL").select(F.lower("word").alias("word")).distinct().limit(MOST_COMMON + 1).collect()]
    if len(words) > MOST_COMMON:
        raise ValueError(f"more than {MOST_COMMON} common words")
    return word_hashes(words)


def _texts(documents: DataFrame) -> DataFrame:
    require(documents, ["doc_id", "text", "lang"])
    return spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), language().alias("language"), F.col("text").cast("string").alias("text")))


#: Columns of the measured documents.
MEASURED = "doc_id long, language string, n_words long, " + ", ".join(f"{s} double" for s in STATISTICS)


def document_statistics(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """``doc_id, language, n_words`` and the ``STATISTICS`` (doubles) of every document."""
    return _texts(documents).mapInArrow(_measure(_common(common_words), False), MEASURED)


def language_sketches(measured: DataFrame) -> DataFrame:
    """One row a language: a KLL sketch of each statistic (``<statistic>_sketch``, binary, mergeable)."""
    return measured.groupBy("language").agg(F.count(F.lit(1)).alias("n_documents"), *(F.kll_sketch_agg_double(s).alias(f"{s}_sketch") for s in STATISTICS))


def merged_sketches(parts: DataFrame, keys: tuple[str, ...] = ("language",)) -> DataFrame:
    """The sketches of several parts of a corpus brought together, per language or (no keys) all in one."""
    return parts.groupBy(*keys).agg(F.sum("n_documents").alias("n_documents"), *(F.kll_merge_agg_double(f"{s}_sketch").alias(f"{s}_sketch") for s in STATISTICS))


def quartiles(sketches: DataFrame) -> DataFrame:
    """Per language and statistic the number of values, quartiles and median."""
    entries = F.array(*(F.struct(F.lit(s).alias("statistic"), F.col(f"{s}_sketch").alias("sketch")) for s in STATISTICS))
    n = F.kll_sketch_get_n_double("sketch")
    at = [F.when(n > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(q))).alias(name) for q, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    return sketches.select("language", F.explode(entries).alias("e")).select("language", "e.*").select("language", "statistic", n.alias("n_values"), *at)


def percentile_grids(sketches: DataFrame) -> dict[str, np.ndarray]:
    """Language -> percentiles of each statistic; ``""`` is the whole corpus.

    A language is two or three letters, so there are at most 18,279 of them, of a few numbers each.
    """
    at = F.array(*(F.lit(i / STEPS) for i in range(STEPS + 1)))
    wanted = merged_sketches(sketches, ()).withColumn("language", F.lit("")).unionByName(sketches.where(F.col("n_documents") >= LEAST_DOCUMENTS))
    columns = [F.when(F.kll_sketch_get_n_double(f"{s}_sketch") > 0, F.kll_sketch_get_quantile_double(f"{s}_sketch", at)).alias(s) for s in STATISTICS]
    missing = [float("nan")] * (STEPS + 1)
    grids = {r["language"]: np.array([r[s] or missing for s in STATISTICS]) for r in wanted.select("language", *columns).collect()}
    return grids or {"": np.array([missing] * len(STATISTICS))}


def flagged(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """``doc_id, sentence_share, not_prose`` of every document, as ``profile`` has them."""
    return _with_flag(_judged(documents, common_words, False))


def _with_flag(judged: DataFrame) -> DataFrame:
    return judged.withColumn("not_prose", F.coalesce(F.col("sentence_share") < LEAST_SHARE, F.lit(False)))


def profile(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """The statistics with, for each, percentile step and robust z-score within the language, and the tails.

    ``tails``: the statistics whose robust z-score is beyond ``TAIL_Z``. ``not_prose``: whether ``sentence_share`` is below ``LEAST_SHARE``.
    """
    judged = _judged(documents, common_words, True)
    return _with_flag(judged.withColumn("tails", F.array_compact(F.array(*(F.when(F.abs(f"{s}_z") > TAIL_Z, F.lit(s)) for s in STATISTICS)))))


def _judged(documents: DataFrame, common_words: DataFrame, whole: bool) -> DataFrame:
    """Sketches, weights of the steps and the pair model, and each document judged by them."""
    context = documents.sparkSession.sparkContext
    read = cut(_texts(documents).mapInArrow(_measure(_common(common_words), True), MEASURED + ", tokens binary, long_sizes array<int>"))
    measured = read.where("n_words > 0 OR symbol_ratio IS NOT NULL").select("language", *STATISTICS)
    grids = percentile_grids(cut(language_sketches(measured)))
    # at most as many rows as statistics, steps and kinds
    seen = np.full((2, len(STATISTICS), STEPS + 1), 0, np.int64)
    for r in measured.mapInArrow(_count_steps(context.broadcast(Scale(grids))), "c int, j int, step int, n long").groupBy("c", "j", "step").agg(F.sum("n").alias("n")).collect():
        seen[r.c, r.j, r.step] = r.n
    weights = np.stack([log_ratios(p, q, p.sum() + STEPS - 1, q.sum() + STEPS - 1, 1.0) for p, q in zip(*seen, strict=True)])
    scale = context.broadcast(Scale(grids, weights))

    taught = read.select("language", *STATISTICS, "tokens", "long_sizes")
    pair_weights = None
    for _ in range(ROUNDS):
        rows = taught.mapInArrow(_teach(scale, pair_weights), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()  # at most 2 * BUCKETS + 2 rows
        keys, counts = (np.asarray(rows.column(c).combine_chunks()) for c in ("key", "n"))
        both, n = np.zeros(2 * BUCKETS), {int(k): float(v) for k, v in zip(keys[keys < 0], counts[keys < 0], strict=True)}
        both[keys[keys >= 0]] = counts[keys >= 0]
        pair_weights = context.broadcast(log_ratios(both[:BUCKETS], both[BUCKETS:], n.get(-1, 0.0), n.get(-2, 0.0), 0.5))

    if not whole:
        return read.select("doc_id", "language", *STATISTICS, "tokens", "long_sizes").mapInArrow(_judge(scale, pair_weights, False), "doc_id long, sentence_share double")
    doubles = [*STATISTICS, *(f"{s}_pct" for s in STATISTICS), *(f"{s}_z" for s in STATISTICS), "tail_score", "sentence_share"]
    return read.mapInArrow(_judge(scale, pair_weights, True), "doc_id long, language string, n_words long, " + ", ".join(f"{c} double" for c in doubles))
