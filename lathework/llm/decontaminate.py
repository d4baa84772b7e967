"""Benchmark decontamination: a BM25 inverted index of test items with block maxima, searched as in WAND.

Test items are the indexed side: each term has a posting list of items in order
of their blocks, with its largest weight overall and in each block of its list.
Every passage of every document is a query. A passage is left when the sum of its
terms' largest weights can't reach any threshold, a block of items when the sum
of the terms' block maxima can't; the postings of what is left are scored in
full, and every item at or above its threshold is verified by the five-word
shingles of its question and of its answer. An item's threshold is the least score
that a passage which holds enough of its shingles can have, so retrieval loses
none of these. Passages overlap by half, and are as
long as two longest items, so that an item's copy lies in one of them whole. A
longer item than ITEM_WORDS is searched by pieces of about equal length, each a
candidate only: where one is found, the whole item is verified in the words as
far as it reaches on both sides. Document frequencies, the mean length and the
length of passages are those of all items, however many indexes hold them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import LOWER, NOT_ALNUM, mixed, row_blocks, running_hash, small_batches, span_hash, spread, string_bytes, tidy, word_spans

K1, B = 1.2, 0.75
#: Least words of an item; shorter ones stand in too many texts to tell a copy, and are no items.
LEAST_WORDS = 5
#: Least share of the question's and of the answer's shingles that the passage holds. Where it is that of the whole item,
#: each part needs the lower share only: one changed word is in five shingles, which of a short part are many.
OVERLAP, PART_OVERLAP = 0.8, 0.4
SHINGLE = 5
BLOCK_ITEMS = 8
#: Words of an item; a longer item is searched by several pieces.
ITEM_WORDS = 512
#: Bytes of text searched together.
SEARCH_BYTES = 250_000
#: Words of the items that are sent to executors as one index (some 40 bytes a word); more take more passes over the documents.
PASS_WORDS = 1_000_000


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of the lower-cased runs of letters and digits."""
    data = LOWER[data]
    starts, ends, rows = word_spans(data, offsets, NOT_ALNUM)
    return span_hash(running_hash(data), starts, ends), rows


def shingles(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of n words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = mixed(out + words[k : len(words) - n + 1 + k])
    return out


@dataclass
class Statistics:
    """Of all items: pieces, hashes of their words in order, pieces that have each, mean words of a piece, most words of one."""

    pieces: int
    terms: np.ndarray
    frequency: np.ndarray
    mean: float
    longest: int

    def weights(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct terms of a text and their BM25 weights in it."""
        terms, tf = np.unique(words, return_counts=True)
        df = self.frequency[np.searchsorted(self.terms, terms)]
        idf = np.log(1 + (self.pieces - df + 0.5) / (df + 0.5))
        return terms, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / self.mean))


def _cut(words: np.ndarray) -> list[np.ndarray]:
    return np.array_split(words, -(-len(words) // ITEM_WORDS))


def statistics(items) -> Statistics:
    """Of (item_id, text); null texts and those of under LEAST_WORDS words are no items. Holds a number for each distinct word."""
    terms, frequency = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    new: list[np.ndarray] = []
    pieces = total = longest = held = 0

    def merge():
        nonlocal terms, frequency, new, held
        every, back = np.unique(np.concatenate([terms, *new]), return_inverse=True)
        frequency = np.bincount(back, weights=np.concatenate([frequency, np.ones(len(back) - len(terms))]), minlength=len(every)).astype(np.int64)
        terms, new, held = every, [], 0

    for _, text in items:
        words = _words(text or "")
        for piece in _cut(words) if len(words) >= LEAST_WORDS else []:
            pieces, total, longest = pieces + 1, total + len(piece), max(longest, len(piece))
            new.append(np.unique(piece))
            held += len(new[-1])
        if held > 1_000_000:
            merge()
    merge()
    return Statistics(pieces, terms, frequency, total / max(pieces, 1), longest)


@dataclass
class Index:
    """Posting lists of items, or of pieces of long ones; both by column, with blocks of BLOCK_ITEMS columns."""

    items: list
    terms: np.ndarray  # sorted hashes
    top: np.ndarray  # of each term: largest weight
    lists: np.ndarray  # first posting of each term, and the end
    columns: np.ndarray  # of each posting, ascending in a list
    weights: np.ndarray
    block_lists: np.ndarray  # first block of each term's list, and the end
    blocks: np.ndarray  # of each block of a list, ascending
    block_first: np.ndarray  # its first posting, and the end
    block_top: np.ndarray  # its largest weight
    least: np.ndarray  # of each column: threshold
    block_least: np.ndarray  # of each block
    marks: np.ndarray  # of each column: the number of its item here
    #: of the whole item, also where the column is a piece of it
    questions: list
    answers: list
    wholes: list  # of a piece: words, terms and weights of its item; else None


def question_words(text: str) -> int:
    """Words of an item that count as its question: all sentences but the last; of one sentence, two thirds."""
    body = text.rstrip().rstrip(".!?")
    cut = max(body.rfind(x) for x in (". ", "? ", "! ", "\n"))
    whole = _words(text)
    if cut > 0 and (n := len(_words(body[:cut]))) and n < len(whole):
        return n
    return max(1, len(whole) * 2 // 3)


def _words(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return words_of(data, np.array([0, len(data)]))[0]


def _lost(shares: list[int]) -> int:
    """Most shingles that a passage may lack: of sets of so many that must each be held to OVERLAP."""
    return sum(int((1 - OVERLAP) * n + 1e-9) for n in shares)


def least_score(words: np.ndarray, terms: np.ndarray, weights: np.ndarray, lost: int) -> float:
    """The least weight of the terms that a text has which lacks at most `lost` of the shingles of words.

    A term is lacking only where all shingles with it are, and each lacking shingle has SHINGLE terms: so the terms that
    lack have no more places in shingles than SHINGLE * lost. The most weight for so many places bounds what lacks.
    """
    count = max(1, len(words) - SHINGLE + 1)
    at = np.searchsorted(terms, words)
    spots = np.stack([at[k : k + count] for k in range(min(SHINGLE, len(words)))], axis=1)
    hashes = shingles(words)
    _, first = np.unique(hashes, return_index=True)  # a shingle that repeats is one
    cells = np.unique(np.repeat(np.arange(len(first)), spots.shape[1]) * len(terms) + spots[first].reshape(-1))
    places = np.bincount(cells % len(terms), minlength=len(terms))
    order = np.argsort(-weights / np.maximum(places, 1), kind="stable")
    used = np.cumsum(places[order])
    whole = int(np.searchsorted(used, SHINGLE * lost, "right"))
    gone = float(weights[order[:whole]].sum())
    if whole < len(order):
        room = SHINGLE * lost - (int(used[whole - 1]) if whole else 0)
        gone += float(weights[order[whole]]) * room / int(places[order[whole]])
    return float(weights.sum()) - gone


def build(items: list[tuple], known: Statistics) -> Index | None:
    """The index of (item_id, text); null texts and those of under LEAST_WORDS words are left out, and match nothing."""
    cut, marks = [], []
    for item, text in items:
        words = _words(text or "")
        if len(words) < LEAST_WORDS:
            continue
        q, all_of = question_words(text), shingles(words)
        question, answer = np.unique(all_of[: max(1, min(q, len(all_of)))]), np.unique(all_of[min(max(0, q - SHINGLE + 1), len(all_of) - 1) :])
        whole = (len(words), *known.weights(words)) if len(words) > ITEM_WORDS else None
        marks.append((question, answer, whole))
        pieces = _cut(words)
        for piece in pieces:
            own = known.weights(piece)
            if whole is None:
                lost = max(_lost([len(question), len(answer)]), _lost([len(np.union1d(question, answer))]))
            else:  # of the pieces one lacks no more than its share, and that of the shingles between pieces
                lost = int((1 - OVERLAP) * (len(piece) + SHINGLE) + 1)
            cut.append((item, own, len(marks) - 1, least_score(piece, *own, lost)))
    if not cut:
        return None
    cut.sort(key=lambda x: x[3])  # blocks of like thresholds
    hashes, weights = (np.concatenate([x[1][k] for x in cut]) for k in (0, 1))
    columns = np.repeat(np.arange(len(cut), dtype=np.int32), [len(x[1][0]) for x in cut])
    order = np.lexsort((columns, hashes))
    hashes, weights, columns = hashes[order], weights[order], columns[order]
    terms, lists = np.unique(hashes, return_index=True)
    lists = np.append(lists, len(hashes))
    block = columns // BLOCK_ITEMS
    opens = np.ones(len(block), bool)
    opens[1:] = (block[1:] != block[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(opens)
    least, of = np.array([x[3] for x in cut]), np.array([x[2] for x in cut])
    return Index(
        [x[0] for x in cut], terms, np.maximum.reduceat(weights, lists[:-1]), lists, columns, weights,
        np.searchsorted(first, lists), block[first], np.append(first, len(hashes)), np.maximum.reduceat(weights, first),
        least, np.minimum.reduceat(least, np.arange(0, len(cut), BLOCK_ITEMS)), of,
        *([marks[i][k] for i in of.tolist()] for k in range(3)),
    )


def search(index: Index, words: np.ndarray, passage: np.ndarray):
    """(passage, column, score) at or above thresholds.

    words: hashes in order of documents; passage: the number of each word's segment. Passage k is the segments
    k and k + 1; numbers of segments of different documents aren't adjacent.
    """
    at = np.minimum(np.searchsorted(index.terms, words), len(index.terms) - 1)
    known = index.terms[at] == words
    n = len(index.terms)
    pairs = np.unique(passage[known] * n + at[known])
    pairs = np.unique(np.concatenate([pairs, pairs[pairs >= n] - n]))
    query, term = pairs // n, pairs % n
    if not len(query):
        return []
    slack = 1 - 1e-9  # sums of another order may differ in the last place
    begins = np.flatnonzero(np.diff(query, prepend=query[0] - 1))
    bound = np.add.reduceat(index.top[term], begins)
    alive = np.repeat(bound >= index.block_least.min() * slack, np.diff(np.append(begins, len(query))))
    query, term = query[alive], term[alive]
    if not len(query):
        return []
    # of each passage that is left, the blocks of its terms' lists, and the sums of their maxima
    owner, place = spread(index.block_lists[term + 1] - index.block_lists[term])
    entry = index.block_lists[term][owner] + place
    queries, number = np.unique(query, return_inverse=True)
    width = len(index.block_least)
    cell, back = np.unique(number[owner] * width + index.blocks[entry], return_inverse=True)
    good = np.bincount(back, weights=index.block_top[entry]) >= index.block_least[cell % width] * slack
    kept = good[back]
    entry, number = entry[kept], number[owner][kept]
    if not len(entry):
        return []
    owner, place = spread(index.block_first[entry + 1] - index.block_first[entry])
    posting = index.block_first[entry][owner] + place
    cell, back = np.unique(number[owner] * len(index.items) + index.columns[posting], return_inverse=True)
    score, column = np.bincount(back, weights=index.weights[posting]), cell % len(index.items)
    found = np.flatnonzero(score >= index.least[column] * slack)
    return list(zip(queries[cell[found] // len(index.items)].tolist(), column[found].tolist(), score[found].tolist(), strict=True))


def _overlaps(question: np.ndarray, answer: np.ndarray, words: np.ndarray) -> tuple[float, float, float]:
    """Shares of the shingles of the item, its question and its answer that are among the words."""
    have = shingles(words)
    return tuple(float(np.isin(x, have).mean()) for x in (np.union1d(question, answer), question, answer))


def matches(index: Index, step: int, data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
    """(row, item, score, question share, answer share) of verified items, the best passage of each; items of one id
    with different texts are items each.

    step: words of a segment, as many as the longest item or piece has and a shingle more.
    """
    words, rows = words_of(data, offsets)
    if not len(words):
        return []
    per_row = np.bincount(rows, minlength=len(offsets) - 1)
    first = np.cumsum(per_row) - per_row
    segments = -(-per_row // step)
    base = np.cumsum(segments + 1) - segments  # one number between documents stays free
    passage = base[rows] + (np.arange(len(words)) - first[rows]) // step
    best: dict[tuple, tuple] = {}
    seen: set[tuple] = set()  # long items and the words that these were verified in
    for number, column, score in search(index, words, passage):
        low, high = np.searchsorted(passage, [number, number + 2])
        row = int(rows[low]) if low < len(rows) else -1
        if whole := index.wholes[column]:
            reach, terms, weights = whole
            low, high = max(first[row], low - reach), min(first[row] + per_row[row], high + reach)
            if (int(index.marks[column]), low, high) in seen:
                continue
            seen.add((int(index.marks[column]), low, high))
            score = float(weights[np.isin(terms, words[low:high])].sum())
        share, q, a = _overlaps(index.questions[column], index.answers[column], words[low:high])
        key = (row, int(index.marks[column]))
        held = min(q, a) >= OVERLAP or share >= OVERLAP and min(q, a) >= PART_OVERLAP
        if held and (key not in best or best[key][1] < score):
            best[key] = (index.items[column], score, q, a)
    return [(row, *x) for (row, _), x in sorted(best.items())]


def _items(benchmark: DataFrame):
    """Distinct (item_id, text) in order."""
    last = None
    for r in benchmark.select("item_id", "text").filter("text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        if tuple(r) != last:
            last = tuple(r)
            yield last


def _finders(docs: DataFrame, benchmark: DataFrame):
    """For each index of items a function that gives the matches in a column of texts."""
    small_batches(docs.sparkSession)
    known = statistics(_items(benchmark))
    step = known.longest + SHINGLE

    def finder(part: list[tuple]):
        sent = docs.sparkSession.sparkContext.broadcast(build(part, known))

        def find(column):
            data, offsets, _ = string_bytes(column)
            for low, high in row_blocks(offsets, SEARCH_BYTES):
                for row, *rest in matches(sent.value, step, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]):
                    yield low + row, *rest

        return find

    part, held = [], 0
    for item, text in _items(benchmark) if known.pieces else []:
        if (size := len(_words(text))) < LEAST_WORDS:
            continue
        if part and held + size > PASS_WORDS:
            yield finder(part)
            part, held = [], 0
        part.append((item, text))
        held += size
    if part:
        yield finder(part)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: a row for each document and item that it holds.

    A passage holds an item with OVERLAP of the shingles of question and answer each, or OVERLAP of the item's and PART_OVERLAP
    of each part's. Rows of docs that repeat give rows each. Null and empty texts hold nothing. Items that are null or have
    under LEAST_WORDS words match nothing; items that repeat count once, and several texts of one item_id are items
    each, with a row each. Without items the result is empty. Only doc_id and text are read. The result doesn't depend on how
    many indexes (PASS_WORDS) hold the items. Items pass through the driver one by one, where an index of at most PASS_WORDS is built.
    """
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    out = None
    for find in _finders(docs, benchmark):

        def hits(batches, find=find):
            for batch in batches:
                rows = list(find(batch.column(1)))
                if rows:
                    row, item, score, q, a = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(item, pa.int64()), pa.array(score), pa.array(q), pa.array(a)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        made = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(tidy(hits), schema)
        out = made if out is None else out.unionAll(made)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, with all their columns; no shuffle.

    Null and empty texts hold nothing and stay; rows that repeat are judged alike; without items (of LEAST_WORDS words or more)
    all rows stay.
    """
    column = docs.columns.index("text")
    out = docs
    for find in _finders(docs, benchmark):

        def kept(batches, find=find):
            for batch in batches:
                mask = np.ones(batch.num_rows, bool)
                mask[[row for row, *_ in find(batch.column(column))]] = False
                yield batch.filter(pa.array(mask))

        out = out.mapInArrow(tidy(kept), docs.schema)
    return out
