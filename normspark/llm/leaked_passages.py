"""Passages of held-out items in a corpus: q-gram lemma filtering and banded alignment.

Documents and items are brought to the same words (NFC, no soft hyphens or zero-width characters, lower
case, runs of letters and digits) joined by single blanks. The passages looked for are an item's windows
of ``WORDS`` consecutive words, or all its words if it has fewer. A text region within ``edits`` edits of
a window of ``L`` characters shares at least ``L + 1 - Q - Q * edits`` of the window's character
``Q``-grams, all in one band of diagonals (place in the document less place in the item). So

1. of a window cut into ``edits + 1`` pieces, one stands in the region unchanged; the rarest gram of each piece (among the
   items) is its signature, and only documents with a signature gram of an item are looked at for that item;
2. for such a pair the shared grams are counted in overlapping bands of diagonals, and the windows
   whose count in a band meets the bound are kept;
3. those are verified by an alignment within the band.

Steps 1 and 2 are done for all documents of a batch at once, on arrays. A window too short for the edits gets fewer, down to none; one shorter than ``Q`` is looked for
as it is. The corpus is only read, in one pass and without a shuffle; what travels are the items'
grams, in blocks of at most ``BLOCK_CHARACTERS`` of their texts (about 200 MB an executor process); more text is several blocks and passes.

Defined results: null, empty and wordless texts hold and reveal nothing. An item id whose text is
given several times is revealed by any of them; a document id likewise. Null ids are left out. Whole
texts are searched, in pieces of bounded memory. Further columns are ignored; empty tables give no pairs.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normspark.session import require, spread

#: Words of a passage, characters of a gram, and edits that a passage may differ by if nothing else is asked for.
WORDS, Q, EDITS = 12, 16, 1
#: Characters of items sent to the executors at once.
BLOCK_CHARACTERS = 8_000_000
#: Characters of documents that are searched at once; longer documents are cut into overlapping pieces.
PIECE = 1 << 17
#: Bits of the filters that tell most grams of the corpus from those of items.
FILTER_BITS = 22

# Fixed value: characters that are taken out of a text.
REMOVED = "\u00ad\u200b\u200c\u200d\ufeff"

_WORD = regex.compile(r"[\p{L}\p{N}]+")
_REMOVE = regex.compile(f"[{REMOVED}]")


def words_of(text: str) -> list[str]:
    """The words of a text in the notation that is compared."""
    if text.isascii():
        return text.lower().translate(_ASCII).split()
    return _WORD.findall(_REMOVE.sub("", unicodedata.normalize("NFC", text)).lower())


#: ASCII characters that are no letters or digits, to blanks.
_ASCII = {i: " " for i in range(128) if not chr(i).isalnum()}


def gram_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each gram of ``Q`` (a power of two) characters, by place, from those of half the length."""
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(h) < Q:
        return np.empty(0, np.uint64)
    size, power = 1, 0x9E3779B97F4A7C15
    while size < Q:
        h = h[:-size] * np.uint64(power) + h[size:]
        size, power = 2 * size, power * power % (1 << 64)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Item:
    """An item's text, its windows as (start, end, least shared grams, edits), and its grams by place."""

    def __init__(self, item_id: int, words: list[str], edits: int) -> None:
        self.id, self.text = item_id, " ".join(words)
        starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])]).tolist()
        size = min(WORDS, len(words))
        self.windows: list[tuple[int, int, int, int]] = []
        for i in range(len(words) - size + 1):
            a, b = starts[i], starts[i + size] - 1
            own = max(0, min(edits, (b - a) // Q - 1))
            while own and b - a + 1 - Q - Q * own < 1:
                own -= 1
            self.windows.append((a, b, b - a + 1 - Q - Q * own, own))
        self.begin, self.end, self.least, self.edits = np.array(self.windows, np.int64).T
        self.hashes = gram_hashes(self.text)

    def signature(self, often: dict[int, int]) -> set[int]:
        """The rarest gram of each of the ``edits + 1`` pieces of each window."""
        rarity = np.array([often[h] for h in self.hashes.tolist()])
        chosen: set[int] = set()
        for a, b, _, edits in self.windows:
            for i in range(edits + 1):
                low, high = a + (b - a) * i // (edits + 1), a + (b - a) * (i + 1) // (edits + 1) - Q
                if high >= low:
                    chosen.add(int(self.hashes[low + int(np.argmin(rarity[low : high + 1]))]))
        return chosen


def aligned(window: str, region: str, edits: int) -> int | None:
    """The least edits between ``window`` and any part of ``region``, or None if more than ``edits``.

    Only a band around the diagonals of ``region`` is filled; it starts and ends anywhere in it.
    """
    if window in region:
        return 0
    if not edits:
        return None
    most = edits + 1
    n = len(region)
    row = [0] * (n + 1)
    for i, c in enumerate(window, 1):
        low, high = max(1, i - edits), min(n, i + (n - len(window)) + edits)
        new = [most] * (n + 1)
        if low == 1:
            new[0] = min(i, most)
        for j in range(low, high + 1):
            v = row[j - 1] + (region[j - 1] != c)
            if row[j] + 1 < v:
                v = row[j] + 1
            if new[j - 1] + 1 < v:
                v = new[j - 1] + 1
            new[j] = v if v < most else most
        row = new
        if min(row) > edits:
            return None
    best = min(row)
    return best if best <= edits else None


def _grouped(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes in order, where the entries of each begin, and the order of the entries."""
    order = np.argsort(hashes, kind="stable")
    own, first = np.unique(hashes[order], return_index=True)
    return own, np.append(first, len(hashes)), order


def _filter(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << FILTER_BITS, bool)
    out[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    return out


class Index:
    """The grams of a block of items: all with their items and places, and the signature grams with their items."""

    def __init__(self, items: list[tuple[int, str]], edits: int = EDITS) -> None:
        self.most = edits
        parsed = [Item(i, w, edits) for i, t in items if (w := words_of(t or ""))]
        self.shorts = [x for x in parsed if any(e - a < Q for a, e, _, _ in x.windows)]  # some window has no gram
        self.items = [x for x in parsed if len(x.text) >= Q]
        often: Counter = Counter()
        for x in self.items:
            often.update(set(x.hashes.tolist()))
        nothing = [np.empty(0, np.int64)]
        hashes = np.concatenate([x.hashes for x in self.items] or [np.empty(0, np.uint64)])
        owners = np.concatenate([np.full(len(x.hashes), n) for n, x in enumerate(self.items)] or nothing)
        places = np.concatenate([np.arange(len(x.hashes)) for x in self.items] or nothing)
        self.grams, self.first, order = _grouped(hashes)
        self.owners, self.places = owners[order], places[order]
        signed = [np.array(sorted(x.signature(often)), np.uint64) for x in self.items]
        self.signs, self.sign_first, order = _grouped(np.concatenate(signed or [np.empty(0, np.uint64)]))
        self.sign_owners = np.concatenate([np.full(len(x), n) for n, x in enumerate(signed)] or nothing)[order]
        self.least = np.array([min(w[2] for w in x.windows if w[2] > 0) if any(w[2] > 0 for w in x.windows) else 1 for x in self.items], np.int64)
        self.filter, self.sign_filter = _filter(self.grams), _filter(self.signs)
        self.longest = max((int((x.end - x.begin).max()) for x in parsed), default=0) + 2 * (Q + edits)

    @staticmethod
    def _hits(hashes: np.ndarray, at: np.ndarray, known: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each place ``at`` with each entry of its gram."""
        found = np.searchsorted(known, hashes[at])
        same = known[np.minimum(found, len(known) - 1)] == hashes[at]
        at, found = at[same], found[same]
        times = first[found + 1] - first[found]
        entry = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[found], times)
        return np.repeat(at, times), entry

    def leaks(self, texts: list[str]) -> Iterator[tuple[int, Item, int, int, int]]:
        """(text's number, item, edits, window's start, window's end) of each item with a verified window in a text, its best one."""
        for n, text in enumerate(texts):
            for x in self.shorts:
                padded = f" {text} "
                for a, e, _, _ in x.windows:
                    if e - a < Q and f" {x.text[a:e]} " in padded:
                        yield n, x, 0, a, e
                        break
        if not self.items:
            return
        joined = "\n".join(texts)  # no gram of an item has a line end
        hashes = gram_hashes(joined)
        high = (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
        begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        m = len(self.items)
        at, entry = self._hits(hashes, np.flatnonzero(self.sign_filter[high]), self.signs, self.sign_first)
        candidate = np.zeros((len(texts), m), bool)
        candidate[np.searchsorted(begins, at, "right") - 1, self.sign_owners[entry]] = True
        if not candidate.any():
            return
        # grams of texts without a candidate needn't be looked up
        open_text = np.repeat(candidate.any(1), np.diff(begins))[: len(hashes)]
        at, entry = self._hits(hashes, np.flatnonzero(self.filter[high] & open_text), self.grams, self.first)
        item, own, text = self.owners[entry], self.places[entry], np.searchsorted(begins, at, "right") - 1
        keep = candidate[text, item]
        pair, own, diagonal = (text * m + item)[keep], own[keep], (at - begins[text] - own)[keep]
        # bands of twice the edits (at least two diagonals), each overlapping the next by the edits
        band = diagonal // max(1, self.most)
        if not len(band):
            return
        base = int(band.min()) - 1
        span = int(band.max()) - base + 2
        low = pair * span + band - base
        keys, counts = np.unique(np.concatenate([low, low - 1]), return_counts=True)
        keys = keys[counts >= self.least[keys // span % m]]
        if not len(keys):
            return
        # the hits of the bands that are left, in the order of the bands
        order = np.argsort(low, kind="stable")
        low, own, diagonal = low[order], own[order], diagonal[order]
        starts, stops = np.searchsorted(low, keys, "left"), np.searchsorted(low, keys + 1, "right")
        best: dict[int, tuple[int, int, int]] = {}
        for key, i, j in zip(keys.tolist(), starts.tolist(), stops.tolist(), strict=True):
            n = key // span
            found = self._verified(self.items[n % m], texts[n // m], own[i:j], diagonal[i:j], self.most)
            if found and (n not in best or found < best[n]):
                best[n] = found
        for n, found in best.items():
            yield n // m, self.items[n % m], *found

    @staticmethod
    def _verified(x: Item, text: str, own: np.ndarray, diagonal: np.ndarray, most: int) -> tuple[int, int, int] | None:
        """The best aligned window among those whose shared grams in the band meet their bound."""
        have = np.zeros(len(x.hashes) + 1, np.int64)
        have[own + 1] = 1
        have = np.cumsum(have)
        ends = np.maximum(x.begin, x.end - Q + 1)
        shared = have[ends] - have[x.begin]
        fit = np.flatnonzero((shared >= x.least) & (x.end - x.begin >= Q))
        if not len(fit):
            return None
        base, top = int(diagonal.min()), int(diagonal.max())
        best: tuple[int, int, int] | None = None
        for w in fit[np.argsort(-shared[fit], kind="stable")].tolist():
            a, e, _, edits = x.windows[w]
            cost = aligned(x.text[a:e], text[max(0, base + a - edits) : top + e + edits], edits)
            if cost is not None and (best is None or (cost, a, e) < best):
                best = (cost, a, e)
                if not cost:
                    break
        return best


def holds(item: Item, text: str) -> bool:
    """Whether the words of a window stand in the text in a row, exactly."""
    padded = f" {text} "
    return any(f" {item.text[a:b]} " in padded for a, b, _, _ in item.windows)


def _scan(kept, exact: bool):
    """For mapInArrow: documents with a verified window of an item of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = kept.value
        found: dict[tuple[int, int], tuple[int, int]] = {}
        docs: list[int] = []
        texts: list[str] = []
        size = 0

        def search() -> None:
            for n, x, edits, a, b in index.leaks(texts):
                if not exact or holds(x, texts[n]):
                    key = (docs[n], x.id)
                    found[key] = min(found.get(key, (edits, a - b)), (edits, a - b))
            docs.clear()
            texts.clear()

        for batch in batches:
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = " ".join(words_of(raw))
                # pieces overlap by more than a passage and begin and end at words, so that each passage is whole in one
                start = 0
                while True:
                    stop = min(len(text), start + PIECE + index.longest)
                    if stop < len(text):
                        stop = text.rfind(" ", start, stop) if text.rfind(" ", start, stop) > start + index.longest else stop
                    docs.append(doc)
                    texts.append(text[start:stop])
                    size += stop - start
                    if size >= PIECE:
                        search()
                        size = 0
                    if stop >= len(text):
                        break
                    back = text.rfind(" ", start, stop - index.longest)
                    start = back + 1 if back > start else stop - index.longest
            search()
            size = 0
            rows = [(doc, item, e, -n) for (doc, item), (e, n) in found.items()]
            found.clear()
            columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32())],
                ["doc_id", "item_id", "edits", "passage_chars"],
            )

    return run


def leaks(documents: DataFrame, items: DataFrame, exact: bool = False, edits: int = EDITS) -> DataFrame:
    """``doc_id, item_id, edits, passage_chars``: every document with a passage of an item.

    ``exact`` keeps the pairs whose document holds the words of a passage unchanged (as words, in
    the compared notation); otherwise passages within ``edits`` count too.
    """
    require(documents, ["doc_id", "text"])
    require(items, ["item_id", "text"])
    context = documents.sparkSession.sparkContext
    docs = spread(documents.where("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    held = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    blocks = (held.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARACTERS + 1
    found = None
    for block in range(blocks):
        own = held if blocks == 1 else held.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        index = context.broadcast(Index([(r.item_id, r.text) for r in own.collect()], edits))
        part = docs.mapInArrow(_scan(index, exact), "doc_id long, item_id long, edits int, passage_chars int")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "passage_chars")).alias("b")).select("doc_id", "item_id", "b.*")


def per_item(found: DataFrame, items: DataFrame) -> DataFrame:
    """Per item: suite, and the number of documents that reveal it (0 too)."""
    counts = found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"))
    return items.where("item_id IS NOT NULL").groupBy("item_id").agg(F.min("suite").alias("suite")).join(counts, "item_id", "left").select("suite", "item_id", F.coalesce("n_documents", F.lit(0)).alias("n_documents"))
