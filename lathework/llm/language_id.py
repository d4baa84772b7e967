"""Language ID by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A document is
parsed into the longest phrases that occur in that text; the fewer phrases a
character takes, the closer the document is to it. Each language's automaton has
the alphabet of its own text and becomes a table (state, symbol) -> state with a
mark where a phrase ends, and documents are parsed in windows, all windows of a
batch step by step together.
Every window of every text is parsed; a phrase never crosses windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from .shared import row_blocks, small_batches, string_bytes, tidy

#: Labelled text that an automaton is built from: characters of a language, documents taken for it,
#: characters of one document, from a place in it by hash. More labelled rows than these aren't fitted on.
TRAIN_CHARS, TRAIN_DOCS, DOC_CHARS = 16_000, 48, 1_500
#: Bytes of a table with a place for each state and symbol; of a larger alphabet only the transitions are kept.
TABLE_BYTES = 12 << 20
#: Bytes of tables that are laid out together; the text is parsed with more tables in several passes.
PASS_BYTES = 192 << 20
WINDOW = 256
UNKNOWN = "und"
#: accepted() rejects a text of so many letters or more whose best language needs over so many times the phrases that the
#: language's own text needs. Shorter texts can't be judged by their phrases.
LEAST_LETTERS, MOST_RATE = 40, 3.5
BLOCK = 500_000


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings of codes; state 0 is the start."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if p != -1:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nexts[p].get(c) == q:
                    nexts[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return nexts


class Table:
    """An automaton's transitions: state * symbols + symbol -> next state * symbols, plus 1 where the symbol begins a new phrase."""

    def __init__(self, codes: np.ndarray, local: np.ndarray):
        """codes: the text in its own symbols; local: the own symbol of each of the model's, 0 where the text has none."""
        self.local = local
        self.symbols = int(local.max(initial=0)) // 2 * 2 + 2  # even, as the mark is the lowest bit
        nexts = suffix_automaton(codes.tolist())
        self.states = len(nexts)
        self.start = np.ones(self.symbols, np.int32)  # an unseen symbol is a phrase of its own
        for c, s in nexts[0].items():
            self.start[c] = s * self.symbols + 1
        moves = sorted((s * self.symbols + c, t * self.symbols) for s, row in enumerate(nexts) if s for c, t in row.items())
        self.moves, self.to = np.array(moves or [(-1, 0)], np.int32).T.copy()

    def size(self) -> int:
        """Bytes of whole(); 0 for None."""
        size = self.states * self.symbols * 4
        return size if size <= TABLE_BYTES else 0

    def whole(self) -> np.ndarray | None:
        """A place for each state and symbol, or None where that is too large."""
        if not self.size():
            return None
        table = np.tile(self.start, self.states)
        table[self.moves[self.moves >= 0]] = self.to[self.moves >= 0]
        return table

    def step(self, now: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """As whole()[now + symbol], by a search among the transitions."""
        key = now + symbol
        at = np.minimum(np.searchsorted(self.moves, key), len(self.moves) - 1)
        return np.where(self.moves[at] == key, self.to[at], self.start[symbol])


class Model:
    """languages, symbol of each code point, and a parse table for each language."""

    def __init__(self, texts: dict[str, str]):
        """texts: labelled text of each language."""
        self.languages = sorted(texts)
        folded = {k: fold(v) for k, v in texts.items()}
        points = np.unique(np.concatenate([*folded.values(), np.array([32], np.uint32)]))
        self.symbol = np.zeros(0x110000, np.int32)  # 0: in no language's text
        self.symbol[points] = np.arange(1, len(points) + 1)
        self.tables, self.rates = [], []
        for k in self.languages:
            codes = self.symbol[folded[k]]
            held = len(codes) // 5
            local = np.zeros(len(points) + 1, np.int32)
            own = np.unique(codes[held:])
            local[own] = np.arange(1, len(own) + 1)
            self.tables.append(Table(local[codes[held:]], local))
            # phrases a character takes in other text of the language itself: automata of more varied text need more
            taken = self._parsed(self.tables[-1:], [self.tables[-1].whole()], codes[:held], np.array([0, held]))[0, 0] if held else 1
            self.rates.append(max(float(taken) / max(held, 1), 1e-3))
        if self.rates:
            middle = float(np.median(self.rates))
            self.rates = [min(max(r, 0.7 * middle), 1.5 * middle) for r in self.rates]
        self._kept: list | None = None

    def __getstate__(self):
        return self.__dict__ | {"_kept": None}

    def _passes(self):
        """Runs of tables of at most PASS_BYTES together, and these laid out; those of a single run are kept."""
        ends = np.cumsum([t.size() for t in self.tables])
        if not len(ends) or ends[-1] <= PASS_BYTES:
            self._kept = self._kept or [t.whole() for t in self.tables]
            yield self.tables, self._kept
            return
        at = 0
        while at < len(ends):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PASS_BYTES, "right")))
            yield self.tables[at:end], [t.whole() for t in self.tables[at:end]]
            at = end

    def phrases(self, symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases of each row (column) by each language (row)."""
        return np.concatenate([self._parsed(*tables, symbols, offsets) for tables in self._passes()])

    @staticmethod
    def _parsed(tables: list[Table], wholes: list, symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows = len(offsets) - 1
        out = np.zeros((len(tables), rows), np.int64)
        counts = -(-np.diff(offsets) // WINDOW)
        owner = np.repeat(np.arange(rows), counts)
        if not len(owner):
            return out
        place = np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]
        begin = offsets[owner] + place * WINDOW
        length = np.minimum(WINDOW, offsets[owner + 1] - begin)
        order = np.argsort(-length, kind="stable")
        owner, begin, length = owner[order], begin[order], length[order]
        live = len(owner) - np.searchsorted(length[::-1], np.arange(WINDOW), "right")
        state = [np.zeros(len(owner), np.int32) for _ in tables]
        found = [np.zeros(len(owner), np.int32) for _ in tables]
        for k in range(int(length[0])):
            n = int(live[k])
            at = symbols[begin[:n] + k]
            for table, whole, now, seen in zip(tables, wholes, state, found, strict=True):
                symbol = table.local[at]
                step = whole[now[:n] + symbol] if whole is not None else table.step(now[:n], symbol)
                mark = step & 1
                seen[:n] += mark
                now[:n] = step - mark
        for i, seen in enumerate(found):
            out[i] = np.bincount(owner, weights=seen, minlength=rows).astype(np.int64)
        return out

    def judged(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, rate and letters of each text (bytes). rate: phrases that the language needs for the text, over
        those that it needs for its own; 0 without languages."""
        points, at = code_points(data, offsets)
        count = np.concatenate([[0], np.cumsum(LETTER[points])])
        letters = count[at[1:]] - count[at[:-1]]
        none = np.zeros(len(letters))
        if not self.languages:
            return [UNKNOWN] * len(letters), none, none, letters
        symbols = self.symbol[LOWER_POINT[points]]
        size = np.maximum(np.diff(at), 1)
        # normalised phrases: phrases a character, over those of the language's own text
        normal = self.phrases(symbols, at) / size / np.array(self.rates)[:, None]
        best = normal.argmin(0)
        least = normal.min(0)
        fit = (least[None, :] / np.maximum(normal, 1e-9)) ** 8
        score = np.clip(np.where(letters > 0, 1 / np.maximum(fit.sum(0), 1e-9), 0.0), 0, 1)
        return [self.languages[b] if n else UNKNOWN for b, n in zip(best.tolist(), letters.tolist(), strict=True)], score, least, letters

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each text (bytes)."""
        return self.judged(data, offsets)[:2]


def _points() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point: whether it's a letter; its lower case, or a space for all but letters."""
    letter, lower = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
    for p in range(0x110000):
        if not 0xD800 <= p < 0xE000 and (c := chr(p)).isalpha():
            letter[p] = True
            if len(low := c.lower()) == 1:
                lower[p] = ord(low)
    lower[~letter] = 32
    return letter, lower


LETTER, LOWER_POINT = _points()


def fold(text: str) -> np.ndarray:
    return LOWER_POINT[np.frombuffer(text.encode("utf-32-le"), np.uint32)]


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts in UTF-8 and where each text begins in them."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return points, heads[offsets]


def train(labelled: DataFrame) -> Model:
    """A model from labelled (doc_id, text, lang); every language, bounded by TRAIN_DOCS and TRAIN_CHARS for each.

    Documents of a language are taken by a hash of doc_id, so that the order and number of the
    partitions don't matter. Null texts, null languages and null ids are left out; rows that repeat a doc_id
    are rows each. No rows make a model without languages.
    """
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    order = lambda *more: F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", *more))
    keys = rows.select("lang", F.xxhash64("doc_id").alias("h"), "doc_id")
    chosen = keys.withColumn("r", order()).filter(F.col("r") <= TRAIN_DOCS).select("doc_id").distinct()
    begin = F.pmod(F.xxhash64("doc_id", F.length("text")), F.greatest(F.length("text") - DOC_CHARS, F.lit(0)) + 1).cast("int") + 1
    taken = rows.join(F.broadcast(chosen), "doc_id", "left_semi").select("lang", "doc_id", F.xxhash64("doc_id").alias("h"), F.substr("text", begin, F.lit(DOC_CHARS)).alias("text"))
    taken = taken.withColumn("r", order("text")).filter(F.col("r") <= TRAIN_DOCS)
    texts: dict[str, str] = {}
    for r in taken.select("lang", "doc_id", "text").orderBy("lang", "doc_id", "text").collect():  # at most TRAIN_DOCS a language
        if len(texts.get(r[0], "")) < TRAIN_CHARS * 5 // 4:
            texts[r[0]] = texts.get(r[0], "") + r[2] + "\n"
    return Model({k: v[: TRAIN_CHARS * 5 // 4] for k, v in texts.items()})


def predictions(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (default doc_id), lang_pred and score, for each row.

    Null text and text without a letter: `und`, score 0, as all texts where nothing was learned. Only the text is
    looked at; rows that repeat are rows each.
    """
    keep = keep or ["doc_id"]
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.select(*keep).schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def judge(batches):
        for batch in batches:
            data, offsets, _ = string_bytes(batch.column(len(keep)))
            langs, scores = [], []
            for low, high in row_blocks(offsets, BLOCK):
                a, b = sent.value.predict(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                langs += a
                scores.append(b)
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=schema.names)

    return docs.select(*keep, F.col("text").cast("string").alias("_text")).mapInArrow(tidy(judge), schema)


def accepted(docs: DataFrame, model: Model, languages: list[str] | None = None, least_score: float = 0.0, most_rate: float = MOST_RATE) -> DataFrame:
    """The rows of docs in one of the languages (default: all that were learned), with all their columns; no shuffle.

    A row goes if its text is null or has no letter, if its language isn't one of `languages`, if its score is under
    least_score, or if no language fits it: a text of LEAST_LETTERS letters or more that takes over most_rate times the phrases of
    its best language's own text, such as another script or strings of random letters. Where nothing was
    learned nothing can be judged, and all rows stay. Rows that repeat are judged alike.
    """
    small_batches(docs.sparkSession)
    if not model.languages:
        return docs
    sent, column = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")
    wanted = set(model.languages if languages is None else languages)

    def kept(batches):
        for batch in batches:
            data, offsets, _ = string_bytes(batch.column(column))
            mask = []
            for low, high in row_blocks(offsets, BLOCK):
                said = sent.value.judged(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                mask += [lang in wanted and score >= least_score and (n < LEAST_LETTERS or rate <= most_rate) for lang, score, rate, n in zip(*said, strict=True)]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(tidy(kept), docs.schema)
