"""Evaluation passages printed in a corpus: a BM25 index of the test items, searched with block-max WAND.

The items are the documents of the index and each page's text is a query. Terms are runs of
``GRAM`` folded letters (see ``print_text``), so misread letters, hyphens and line breaks keep most
of a printed passage's terms. Items lie in blocks with the greatest impact of each term, so that most
pages are done after one sum per block; within the blocks that can reach the threshold,
cursors pivot. All items above the threshold are retrieved, not a top k, and then aligned
with the page letter by letter.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .print_text import fold, fold_fragments, folded_ends, spaced, words

GRAM, BLOCK = 9, 16
#: BM25's usual parameters.
K1, B = 1.2, 0.75
#: Greatest score that a page must have for an item to be aligned. A run of 15 words has about 75 terms of weight 4 to 6.
THRESHOLD = 100.0
#: An item is aligned from this share of the score of its weakest run: the rest may be misread or cut by line ends.
MISREAD_SHARE = 0.4
#: Least weight of a term; those of half the items or more have it.
LEAST_IDF = 0.05
#: Least number of items that weights are made for, so that a block of few items has scores like those of many.
ITEMS = 250
#: Words that must be printed one after another.
RUN = 15


#: Multiplier of the hashes of terms; any odd number does.
ODD = 0x9E3779B97F4A7C15


def _hashes(folded: str) -> np.ndarray:
    """A hash of each run of GRAM letters, mixed best in its upper bits."""
    letters = np.frombuffer(folded.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = max(0, len(letters) - GRAM + 1)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(GRAM):
            h = (h ^ letters[i : i + n]) * np.uint64(ODD)
            h ^= h >> np.uint64(29)
    return h * np.uint64(ODD)


class Index:
    """The inverted index. ``items``: (ordinal passage text); texts that fold to nothing are never found."""

    def __init__(self, passages: list[str]):
        self.folded = [fold(p) for p in passages]
        counts: dict[str, dict[int, int]] = defaultdict(dict)
        for k, f in enumerate(self.folded):
            for j in range(len(f) - GRAM + 1):
                row = counts[f[j : j + GRAM]]
                row[k] = row.get(k, 0) + 1
        n = max(ITEMS, len(passages))
        mean = sum(map(len, self.folded)) / max(1, len(passages)) or 1
        norm = [K1 * (1 - B + B * len(f) / mean) for f in self.folded]
        #: term -> (items ascending, impacts, and of each block the greatest impact and where its items begin)
        self.post: dict[str, tuple] = {}
        for term, row in counts.items():
            idf = max(LEAST_IDF, math.log((n - len(row) + 0.5) / (len(row) + 0.5)))
            items = sorted(row)
            impacts = [idf * row[k] * (K1 + 1) / (row[k] + norm[k]) for k in items]
            best: dict[int, float] = {}
            first: dict[int, int] = {}
            for i, (k, x) in enumerate(zip(items, impacts)):
                best[k // BLOCK] = max(best.get(k // BLOCK, 0.0), x)
                first.setdefault(k // BLOCK, i)
            self.post[term] = items, impacts, best, first
        self.terms = self.post.keys()
        #: which hashes some term has, for passing over most letters of a page without making their terms
        self.shift = np.uint64(64 - max(12, (16 * len(self.post)).bit_length()))
        self.hashed = np.zeros(1 << (64 - int(self.shift)), bool)
        for f in self.folded:
            self.hashed[_hashes(f) >> self.shift] = True
        self.blocks = -(-max(1, len(passages)) // BLOCK)

    def weakest_run(self, k: int, ends: list[int], run: int) -> float:
        """The least score that a clean print of ``run`` words of item ``k`` can have; ``ends``: ends of its words."""
        f, begins = self.folded[k], [0, *ends]
        impact = {}
        for j in range(len(f) - GRAM + 1):
            if (t := f[j : j + GRAM]) not in impact:
                items, impacts = self.post[t][:2]
                impact[t] = impacts[bisect_left(items, k)]
        runs = range(max(1, len(ends) - run + 1))
        return min(sum(impact[t] for t in {f[j : j + GRAM] for j in range(begins[i], begins[min(i + run, len(ends))] - GRAM + 1)}) for i in runs)

    def search(self, folded: str, threshold: float | list[float] = THRESHOLD) -> list[tuple[int, float]]:
        """All (item, score) with a score of at least ``threshold``, which may be given for each item."""
        near = np.flatnonzero(self.hashed[_hashes(folded) >> self.shift])
        terms = {folded[j : j + GRAM] for j in near.tolist()} & self.terms
        if not terms:
            return []
        lists = [self.post[t] for t in terms]
        bound = [0.0] * self.blocks
        for _, _, best, _ in lists:
            for b, x in best.items():
                bound[b] += x
        out = []
        each = isinstance(threshold, list)
        for b, total in enumerate(bound):
            # a block is passed over only if it can't reach the lowest threshold of its items
            if total > 0 and total >= (low := min(threshold[b * BLOCK : (b + 1) * BLOCK]) if each else threshold):
                out += [(k, score) for k, score in self._block(b, lists, low) if not each or score >= threshold[k]]
        return out

    def _block(self, b: int, lists: list[tuple], threshold: float) -> list[tuple[int, float]]:
        """WAND within one block: cursors in order of item, the pivot where their bounds reach the threshold."""
        end, cursors = (b + 1) * BLOCK, []
        for items, impacts, best, first in lists:
            if b in best:
                cursors.append([items[first[b]], best[b], first[b], items, impacts])
        out = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            reach, pivot = 0.0, -1
            for c in cursors:
                reach += c[1]
                if reach >= threshold:
                    pivot = c[0]
                    break
            if pivot < 0:
                break
            if cursors[0][0] == pivot:
                score = sum(c[4][c[2]] for c in cursors if c[0] == pivot)
                if score >= threshold:
                    out.append((pivot, score))
                pivot += 1
            for c in cursors:
                if c[0] < pivot:
                    items, i = c[3], c[2]
                    while i < len(items) and items[i] < pivot:
                        i += 1
                    c[0], c[2] = (items[i] if i < len(items) else end), i
            cursors = [c for c in cursors if c[0] < end]
        return out


#: Letters of a seed, and least score of an aligned piece (equal letters 1, others -2).
SEED, PIECE = 5, 8
#: Letters that may be unread between two pieces that continue one another, and by how many the page may have more or fewer there.
HOLE, SHIFT = 10, 4
#: Letters beside the seeds of a diagonal that are compared.
MARGIN = 16
#: Share of a stretch's letters that must be equal after folding.
READ = 0.85


def _pieces(page: np.ndarray, item: np.ndarray, diagonal: int, first: int, last: int) -> list[tuple[int, int, int]]:
    """Stretches, with their numbers of equal letters, of ``item`` that ``page`` prints on one diagonal (item position
    minus page position), around its seeds from ``first`` to ``last``."""
    lo, hi = max(0, diagonal, first - MARGIN), min(len(item), len(page) + diagonal, last + SEED + MARGIN)
    same = page[lo - diagonal : hi - diagonal] == item[lo:hi]
    out, start, score, best, stop = [], lo, 0, 0, lo
    for i, equal in enumerate([*same.tolist(), None], lo):
        score += 1 if equal else -2
        if score > best:
            best, stop = score, i + 1
        if equal is None or score <= 0 or best - score > 6:
            if best >= PIECE:
                out.append((start, stop, int(same[start - lo : stop - lo].sum())))
            start, score, best, stop = i + 1, 0, 0, i + 1
    return out


class Page:
    """The folded fragments of a page, long ones cut, with what aligning any item with them needs, made once."""

    def __init__(self, page_fragments: list[str]):
        self.fragments = [f[i : i + FRAGMENT] for f in page_fragments for i in range(0, len(f), FRAGMENT)]
        self.letters = [np.frombuffer(f.encode("utf-32-le"), np.uint32) for f in self.fragments]
        self.tiny = {f for f in self.fragments if len(f) <= HOLE}
        #: seed -> (fragment, position) of all its places
        self.places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, f in enumerate(self.fragments):
            for j in range(len(f) - SEED + 1):
                self.places[f[j : j + SEED]].append((n, j))


def _aligned(page: Page, item: str, seeds: dict[str, list[int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(item start, item end, fragment, letters before it, letters after it, equal letters) of all aligned pieces."""
    hits: dict[tuple[int, int], list[int]] = defaultdict(list)
    for seed in seeds.keys() & page.places.keys():
        for p in seeds[seed]:
            for n, j in page.places[seed]:
                hits[n, p - j].append(p)
    target = np.frombuffer(item.encode("utf-32-le"), np.uint32)
    out = set()
    for (n, d), at in hits.items():
        if len(at) >= 2:
            size = len(page.fragments[n])
            out.update((a, b, n, a - d, size - (b - d), same) for a, b, same in _pieces(page.letters[n], target, d, min(at), max(at)))
    return sorted(out)


def _follows(x: tuple, y: tuple) -> bool:
    """Whether piece y goes on where piece x of the same fragment ends."""
    hole, between = y[0] - x[1], y[3] - x[6]
    return -HOLE <= hole <= HOLE and -HOLE <= between <= HOLE and abs(hole - between) <= SHIFT


class _Ends:
    """Stretches that end at the end of a fragment, by item position and unread letters: of each place only those that
    may be the best for a piece that goes on, so their number is bounded by the item, whatever the page's length."""

    def __init__(self, item: str, tiny: set[str]):
        self.item, self.tiny, self.lost = item, tiny, {}
        self.at: dict[int, dict[int, list[tuple[int, int, int]]]] = defaultdict(dict)

    def add(self, end: int, after: int, fragment: int, begin: int, equal: int) -> None:
        """A stretch is no use beside one that is no worse in its fragment, or beside two in other fragments."""
        kept = self.at[end].setdefault(after, [])
        kept.append((begin, equal, fragment))
        for x in kept[::-1]:
            better = {z[2] for z in kept if z is not x and _no_worse(z, x)}
            if x[2] in better or len(better) > 1:
                kept.remove(x)

    def before(self, y: tuple):
        """(begin, equal, end) of all stretches of other fragments that piece y goes on from."""
        if y[3] > HOLE:
            return
        for end in range(y[0] - HOLE, min(y[0] + HOLE, y[1] - 1) + 1):
            for after, kept in self.at.get(end, {}).items():
                gap = after + y[3]
                if gap <= HOLE and (abs(y[0] - end - gap) <= SHIFT or gap <= 2 and self._between(end, y[0])):
                    for begin, equal, fragment in kept:
                        if fragment != y[2]:
                            yield begin, equal, end

    def _between(self, end: int, start: int) -> bool:
        """Whether a fragment too short to be aligned by itself prints what stands there."""
        if (end, start) not in self.lost:
            lost = self.item[end:start]
            self.lost[end, start] = any(abs(len(t) - len(lost)) <= 1 and sum(a == b for a, b in zip(t, lost)) >= 0.6 * len(lost) for t in self.tiny)
        return self.lost[end, start]


def _no_worse(x: tuple, y: tuple) -> bool:
    """Whether stretch x, which ends where y does, serves each piece that goes on at least as well."""
    return x[0] <= y[0] and x[1] + READ * x[0] >= y[1] + READ * y[0] and (x[0] < y[0] or x[1] >= y[1])


def longest_print(page: Page, item: str, seeds: dict[str, list[int]]) -> tuple[int, int]:
    """The longest stretch of the folded ``item`` that the page prints, in whatever order its fragments stand.

    Pieces belong together only if one goes on where the other ends, so phrases that many texts
    share don't add up. Between two fragments anything may stand: adverts, heads, other columns.
    """
    ends = _Ends(item, page.tiny)
    #: fragment -> its pieces so far, each with where it ends in the fragment and the begin and equal letters of its stretch
    own: dict[int, list[tuple]] = defaultdict(list)
    best = (0, 0)
    for y in _aligned(page, item, seeds):
        begin, equal = y[0], y[5]
        inside = [(x[7], x[8], x[1]) for x in own[y[2]] if x[1] < y[1] and _follows(x, y)]
        for start, read, end in [*inside, *ends.before(y)]:
            same = read + y[5] - max(0, end - y[0])
            # a stretch must be well read at each step, lest a long bad one hides a good one
            if start <= y[0] and (-start, same) > (-begin, equal) and same >= READ * (y[1] - start):
                begin, equal = start, same
        own[y[2]].append((*y, len(page.fragments[y[2]]) - y[4], begin, equal))
        if y[4] <= HOLE:
            ends.add(y[1], y[4], y[2], begin, equal)
        if y[1] - begin > best[1] - best[0] and equal >= READ * (y[1] - begin):
            best = begin, y[1]
    return best


#: Letters of a fragment; longer ones are cut, and pieces go on over the cuts as over other ends of fragments.
FRAGMENT = 400


def seeds_of(item: str) -> dict[str, list[int]]:
    out: dict[str, list[int]] = defaultdict(list)
    for j in range(len(item) - SEED + 1):
        out[item[j : j + SEED]].append(j)
    return dict(out)


def word_ends(passage: str, folded: str) -> list[int]:
    """End of each word of ``passage`` among its folded letters."""
    ends = folded_ends(words(passage))
    if ends:
        ends[-1] = len(folded)
    return ends


def words_in(stretch: tuple[int, int], ends: list[int]) -> int:
    """How many words have most of their letters in the stretch."""
    n = at = 0
    for e in ends:
        n += e > at and min(e, stretch[1]) - max(at, stretch[0]) >= 0.6 * (e - at)
        at = e
    return n


class Searcher:
    """An index with what aligning needs, made once per Python worker."""

    def __init__(self, items: list[tuple[str, str, str, str]]):
        # passages that differ only in case, punctuation or confused letters are one; their words are counted by text
        texts: dict[str, dict[str, list[tuple[str, str, str]]]] = {}
        for item_id, passage, question, answer in items:
            texts.setdefault(fold(passage), {}).setdefault(passage, []).append((item_id, question, answer))
        self.owners = list(texts.values())
        self.index = Index([next(iter(own)) for own in self.owners])
        self.seeds = [seeds_of(f) for f in self.index.folded]
        self.ends = [{p: word_ends(p, f) for p in own} for own, f in zip(self.owners, self.index.folded)]
        self.least: dict[tuple[int, float], list[float]] = {}

    def thresholds(self, run: int, most: float) -> list[float]:
        """The score from which each item is aligned."""
        if (run, most) not in self.least:
            self.least[run, most] = [min(most, *(MISREAD_SHARE * self.index.weakest_run(k, e, run) for e in own.values())) for k, own in enumerate(self.ends)]
        return self.least[run, most]

    def page(self, text: str, run: int, threshold: float):
        """(item id, words printed, words of the passage, score, share of the question's words on the page, whether its answer is there)."""
        pieces = fold_fragments(text)
        page, printed = None, None
        for k, score in self.index.search("".join(pieces), self.thresholds(run, threshold)):
            page = page or Page(pieces)
            stretch = longest_print(page, self.index.folded[k], self.seeds[k])
            for passage, ends in self.ends[k].items():
                n = words_in(stretch, ends)
                if n < run:
                    continue
                printed = spaced(text) if printed is None else printed
                for item_id, question, answer in self.owners[k][passage]:
                    asked, told = spaced(question or "").split(), spaced(answer or "")
                    share = sum(f" {w} " in printed for w in asked) / len(asked) if asked else None
                    yield item_id, n, len(ends), score, share, (told in printed if told.strip() else None)


_LOADED: dict[int, Searcher] = {}


def _searcher(items: tuple) -> Searcher:
    """The index of a block, made once per Python worker while there is one block; of several one is held at a time."""
    key = hash(items)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Searcher(list(items))
    return _LOADED[key]


#: Letters of passages in one index, which takes some 500 bytes a letter in each worker; a larger test set is searched in blocks of this size.
INDEX_LETTERS = 500_000

LEAK_SCHEMA = "id {id}, item_id string, words int, passage_words int, score double, question_share double, answer_printed boolean"


def leaked_items(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, threshold: float = THRESHOLD, index_letters: int = INDEX_LETTERS) -> DataFrame:
    """``(id_col, item_id, words, passage_words, score, question_share, answer_printed)`` of every page that prints at least
    ``run`` consecutive words of an item's passage.

    ``items`` needs ``item_id, passage, question, answer``. NULL and blank passages and passages shorter than
    ``run`` words are never found; items with the same passage are all reported; NULL, empty and blank texts report
    none. ``question_share`` is the share of the question's words on the page and ``answer_printed``
    whether the answer stands there, by whole words; both are NULL where the item has none. Repeated
    rows of a page give one row. The corpus is read once, whatever the number of items, and isn't shuffled but for the result; each
    batch of pages is searched for block after block of items.
    """
    spark = docs.sparkSession
    rows = items.where("item_id is not null and passage is not null").select("item_id", "passage", "question", "answer").distinct().orderBy("item_id", "question", "answer")
    blocks, block, letters = [], [], 0
    for r in rows.toLocalIterator():
        if len(words(r.passage)) < run:
            continue
        block.append((r.item_id, r.passage, r.question, r.answer))
        letters += len(r.passage)
        if letters >= index_letters:
            blocks.append(tuple(block))
            block, letters = [], 0
    if block or not blocks:
        blocks.append(tuple(block))
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = texts.mapInArrow(_search([spark.sparkContext.broadcast(b) for b in blocks], run, threshold), LEAK_SCHEMA.format(id=kind))
    return out.dropDuplicates(["id", "item_id"]).withColumnRenamed("id", id_col)


def _search(blocks: list, run: int, threshold: float):
    names = ["item_id", "words", "passage_words", "score", "question_share", "answer_printed"]
    types = [pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.bool_()]

    def search(batches):
        for batch in batches:
            at, rows = [], []
            for items in blocks:
                searcher = _searcher(items.value)
                for i, text in enumerate(batch.column(1).to_pylist()):
                    for row in searcher.page(text, run, threshold):
                        at.append(i)
                        rows.append(row)
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *cols], ["id", *names])

    return search
