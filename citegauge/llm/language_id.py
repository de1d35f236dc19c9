"""Language identification by cross-parsing: phrases of a text against a suffix automaton of labelled text per language."""

from __future__ import annotations

import sys
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import fresh, learn_row, slices, table, text_bytes, written

TRAIN_CHARS = 24_000  # letters and spaces of labelled text per language, the bound of the fit
WINDOW = 2000  # characters of a text that the fit may read
BLOCK = 512  # a text is parsed in blocks of so many symbols at once, which are then joined, see `Model.phrases`
SHARPNESS = 12.0
UNKNOWN = "und"
STATES = 400_000  # states of the automata that one pass holds, 100 MB; more languages take more passes


def _alphabet(texts: list[str]) -> dict[str, int]:
    """Letters of the training texts, most frequent first: at most 62; the others are spelt out, see `_symbols`. 0 parts words."""
    counts: dict[str, int] = {}
    for t in texts:
        for c in t.lower():
            if c.isalpha():
                counts[c] = counts.get(c, 0) + 1
    return {c: k + 1 for k, c in enumerate(sorted(counts, key=lambda c: (-counts[c], c))[:62])}


def _table(alphabet: dict[str, int]) -> np.ndarray:
    """Symbol of each code point: 0 for what is no letter, 63 for letters that were not learnt."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for k in range(sys.maxunicode + 1):
        c = chr(k)
        if c.isalpha():
            out[k] = alphabet.get(c.lower()[:1], 63)
    return out


@cache
def _lower() -> np.ndarray:
    """Lower-case code point of each code point."""
    return np.array([ord(chr(k).lower()[0]) for k in range(sys.maxunicode + 1)], np.uint32)


def _symbols(text: str, symbol: np.ndarray) -> np.ndarray:
    """Symbols of a text; a letter that was not learnt is 63 and the four digits of its code point to base 62, so each stays distinct."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    s = symbol[points]
    if not len(s):
        return s
    keep = (s != 0) | np.r_[True, s[:-1] != 0]
    points, s = points[keep], s[keep]
    other = s == 63
    if not other.any():
        return s
    sizes = np.where(other, 5, 1)
    begins = np.cumsum(sizes) - sizes
    out = np.repeat(s, sizes)
    code, at = _lower()[points[other]], begins[other]
    for k in range(4):
        out[at + 1 + k] = code // 62 ** (3 - k) % 62 + 1
    return out


def suffix_automaton(symbols: np.ndarray) -> np.ndarray:
    """Transitions (states x 64, -1: none) of the automaton that accepts each substring; state 0 is the root."""
    n = len(symbols)
    to = np.full((2 * n + 2, 64), -1, np.int32)
    link, size = [-1], [0]
    last = 0
    for c in symbols.tolist():
        new = len(size)
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p != -1 and to[p, c] == -1:
            to[p, c] = new
            p = link[p]
        if p != -1:
            q = int(to[p, c])
            if size[p] + 1 == size[q]:
                link[new] = q
            else:
                twin = len(size)
                size.append(size[p] + 1)
                link.append(link[q])
                to[twin] = to[q]
                while p != -1 and to[p, c] == q:
                    to[p, c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return to[: len(size)]


def parser(to: np.ndarray) -> np.ndarray:
    """Complete transitions for greedy parsing: 4 * next state, plus the phrases that end there.

    A symbol that can't go on opens the next phrase; one that was never learnt is a phrase of its own.
    """
    root = to[0].astype(np.int64)
    opens = np.where(root > 0, root * 4 + 1, 2)
    out = np.where(to >= 0, to.astype(np.int64) * 4, opens)
    out[0] = np.where(root > 0, root * 4, 1)
    return out.astype(np.int32)


def learnt(texts: list[str], symbol: np.ndarray, most: int) -> np.ndarray:
    """The texts one after another, parted by 0, up to `most` letters and gaps, whatever the script: a letter that is spelt out counts once."""
    s = np.concatenate([np.zeros(1, np.uint8), *[np.r_[_symbols(t, symbol), np.uint8(0)] for t in texts]])
    digit = np.zeros(len(s) + 4, bool)
    for k in range(1, 5):
        digit[np.flatnonzero(s == 63) + k] = True
    return s[np.cumsum(~digit[: len(s)]) <= most]


class Model:
    """Languages, the symbol of each code point, and their parsers one after another."""

    def __init__(self, texts: dict[str, list[str]], most: int = TRAIN_CHARS):
        self.langs = sorted(texts)
        alphabet = _alphabet([t for lang in self.langs for t in texts[lang]])
        self.symbol = _table(alphabet)
        parts, self.roots, self.bits, at = [], [], [], 0
        for lang in self.langs:
            s = learnt(texts[lang], self.symbol, most)
            made = parser(suffix_automaton(s))
            parts.append(made + 4 * at)
            self.roots.append(at)
            self.bits.append(np.log2(len(s) + 1))  # a phrase is told by its place in the text learnt
            at += len(made)
        self.next = np.concatenate(parts).ravel() if parts else np.zeros(0, np.int32)

    def parted(self, states: int = STATES) -> list[Model]:
        """Models of some of the languages each, in order, of at most so many states, or of one language."""
        ends = [*self.roots[1:], len(self.next) // 64]
        out: list[Model] = []
        first = 0
        for k in range(len(self.langs)):
            if k + 1 < len(self.langs) and ends[k + 1] - self.roots[first] <= states:
                continue
            part = object.__new__(Model)
            low, high = self.roots[first], ends[k]
            part.langs, part.bits, part.symbol = self.langs[first : k + 1], self.bits[first : k + 1], self.symbol
            part.roots = [r - low for r in self.roots[first : k + 1]]
            part.next = self.next[low * 64 : high * 64].copy()
            # transitions are 4 * state + phrases, states counted from the first language on
            part.next -= np.int32(4 * low)
            out.append(part)
            first = k + 1
        return out

    def phrases(self, symbols: list[np.ndarray]) -> np.ndarray:
        """Phrases (texts x languages) that the greedy parse of each whole text needs.

        All blocks of all texts are parsed side by side, each as if it began a text; then each is joined to the one before.
        """
        sizes = np.array([len(s) for s in symbols], np.int64)
        blocks = -(-sizes // BLOCK)
        of = np.repeat(np.arange(len(sizes)), blocks)
        total = int(blocks.sum())
        grid = np.full(total * BLOCK, 255, np.uint8)
        at = np.cumsum(blocks) - blocks
        for k, s in enumerate(symbols):
            grid[at[k] * BLOCK : at[k] * BLOCK + len(s)] = s
        grid = grid.reshape(total, BLOCK)
        lengths = np.full(total, BLOCK)
        full = blocks > 0
        last = (at + blocks - 1)[full]
        lengths[last] = (sizes - (blocks - 1) * BLOCK)[full]
        order = np.argsort(-lengths, kind="stable")
        columns = np.ascontiguousarray(grid[order].T)
        alive = np.searchsorted(-lengths[order], -np.arange(BLOCK), side="left")  # blocks longer than j
        out = np.zeros((len(sizes), len(self.langs)))
        for k, root in enumerate(self.roots):
            state = np.full(total, root, np.int32)
            seen = np.zeros(total, np.int32)
            for j in range(BLOCK):
                m = alive[j]
                if not m:
                    break
                got = self.next.take((state[:m] << 6) + columns[j, :m])
                seen[:m] += got & 3
                np.right_shift(got, 2, out=state[:m])
            ends, count = np.empty(total, np.int32), np.empty(total, np.int64)
            ends[order], count[order] = state, seen
            ends, count = self._joined(grid, lengths, of, root, ends, count)
            out[:, k] = np.bincount(of, count, len(sizes))
            out[full, k] += ends[last] != root  # the phrase that the text's end cuts off
        return out

    def _joined(self, grid: np.ndarray, lengths: np.ndarray, of: np.ndarray, root: int, ends: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """End state and phrases of each block where it goes on from the end of the one before.

        From there the parse meets the one that began afresh after a few symbols, and both are one from then on. A block
        in which they don't meet ends in another state, so the block after it is joined once more.
        """
        fresh, afresh = ends.copy(), count.copy()
        todo = np.flatnonzero(np.r_[False, of[1:] == of[:-1]])
        while len(todo):
            run, state, own, more = todo, ends[todo - 1], np.full(len(todo), root, np.int32), np.zeros(len(todo), np.int64)
            final, place = fresh[todo], np.arange(len(todo))
            for j in range(BLOCK):
                apart = state != own
                over = apart & (lengths[run] <= j)
                final[place[over]] = state[over]
                go = apart & ~over
                if not go.any():
                    break
                run, place, state, own = run[go], place[go], state[go], own[go]
                symbol = grid[run, j]
                got, new = self.next.take((state << 6) + symbol), self.next.take((own << 6) + symbol)
                more[place] += (got & 3) - (new & 3)
                state, own = got >> 2, new >> 2
            else:
                final[place] = state
            count[todo] = afresh[todo] + more
            changed = todo[final != ends[todo]]
            ends[todo] = final
            after = changed + 1
            after = after[after < len(of)]
            todo = after[of[after] == of[after - 1]]
        return ends, count

    def rates(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a symbol (texts x languages), and whether a text has a letter."""
        symbols = [_symbols(t or "", self.symbol) for t in texts]
        letters = np.array([bool(s.any()) for s in symbols], bool)
        length = np.maximum([len(s) for s in symbols], 1)[:, None]
        return self.phrases(symbols) * np.array(self.bits) / length, letters

    def judge(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text the language whose phrases cost the fewest bits a symbol, its rate, and the sum of all languages' odds
        against it; no language and no rate for a text without a letter."""
        rate, letters = self.rates(texts)
        best = rate.argmin(axis=1)
        least = rate.min(axis=1)
        odds = np.exp(-SHARPNESS * (rate - least[:, None])).sum(axis=1)
        names = np.array([*self.langs, None], object)[np.where(letters, best, len(self.langs))]
        return names, np.where(letters, least, np.inf), np.where(letters, odds, 0.0)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text."""
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        return told(*self.judge(texts))


def told(names: np.ndarray, least: np.ndarray, odds: np.ndarray) -> tuple[list[str], np.ndarray]:
    return [UNKNOWN if n is None else n for n in names], np.divide(1.0, odds, out=np.zeros(len(odds)), where=odds > 0)


def joined(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """What two models of different languages judge together; ties go to the first."""
    (x, p, s), (y, q, t) = a, b
    least = np.minimum(p, q)
    some = np.isfinite(least)
    part = lambda own, odds: np.exp(-SHARPNESS * np.where(some & np.isfinite(own), np.where(some, own, 0.0) - np.where(some, least, 0.0), 0.0)) * odds
    return np.where(q < p, y, x), least, part(p, s) + part(q, t)


def training_texts(docs: DataFrame, most: int = TRAIN_CHARS, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, list[str]]:
    """About 2 * `most` characters of text per language, of distinct texts drawn by a hash of the id; learnable rows with a language only.

    Equal texts of a language count once, under their smallest id. Of each text drawn a window of WINDOW characters at a
    hashed place is sent to the driver, so what is sent is bounded by the languages.
    """
    rows = docs.where(learn_row(F.col(doc_id)) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(lang).alias("lang"), F.xxhash64(F.col(text)).alias("key"), F.col(doc_id).alias("id"), F.col(text).alias("text"))
    distinct = written(rows.groupBy("lang", "key").agg(F.min("id").alias("id")), "distinct")
    counts = {r[0]: r[1] for r in distinct.groupBy("lang").count().collect()}
    want = max(50, most // 200)
    draw, place = F.lit(False), F.xxhash64("id", F.lit("language"))
    for name, n in counts.items():
        draw = draw | ((F.col("lang") == name) & (F.pmod(place, F.lit(1_000_000)) < int(1_000_000 * min(1.0, want / n)) + 1))
    drawn = distinct.where(draw)
    begin = F.pmod(F.xxhash64("id", F.lit("window")), F.greatest(F.char_length("text") - WINDOW, F.lit(0)) + 1).cast("int") + 1
    got = rows.join(F.broadcast(drawn), ["lang", "key", "id"], "left_semi").select("lang", place, "key", F.substring("text", begin, F.lit(WINDOW))).collect()
    out: dict[str, list[str]] = {name: [] for name in counts}
    for name, _, _, t in sorted({tuple(r) for r in got}):
        if sum(map(len, out[name])) < 2 * most:
            out[name].append(t)
    return {k: v for k, v in out.items() if v}


def fit(docs: DataFrame, most: int = TRAIN_CHARS, **columns) -> Model:
    return Model(training_texts(docs, most, **columns), most)


def identify(docs: DataFrame, model: Model, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score", states: int = STATES) -> DataFrame:
    """docs + lang_pred, score: whole texts, narrow passes without shuffle.

    Null texts and texts without a letter are `und` with score 0; ties go to the language first in order. Rows and other
    columns stay as they are, repeated ones too. Without a learnt language everything is `und`. What a pass holds is bounded: the
    languages are judged some at a time, and the rows are written to the shared folder between; few languages take one pass.
    """
    fresh(docs, lang_out, score_out, "__least__", "__odds__")
    parts = model.parted(states) or [model]
    rows = docs
    for k, part in enumerate(parts):
        rows = _pass(rows, part, text, lang_out, score_out, k == 0, k == len(parts) - 1)
        if k < len(parts) - 1:
            rows = written(rows, "judged")
    return rows


def _pass(rows: DataFrame, model: Model, text: str, lang_out: str, score_out: str, first: bool, last: bool) -> DataFrame:
    """rows with the judgement of the passes before, if any, joined with this model's."""
    held = rows.sparkSession.sparkContext.broadcast(model)  # its size is bounded by `parted`
    names = [c for c in rows.columns if first or c not in (lang_out, "__least__", "__odds__")]
    kept = [rows.schema[c] for c in names]
    more = [StructField(lang_out, StringType()), *([StructField(score_out, DoubleType())] if last else [StructField("__least__", DoubleType()), StructField("__odds__", DoubleType())])]

    def run(batches):
        for batch in batches:
            for part in slices(batch, text, 1 << 21):
                texts = part.column(text).to_pylist()
                if not held.value.langs:
                    found = [pa.array([UNKNOWN] * len(texts), pa.string()), pa.array([0.0] * len(texts), pa.float64())]
                else:
                    judged = held.value.judge(texts)
                    if not first:
                        before = [part.column(c).to_numpy(zero_copy_only=False) for c in (lang_out, "__least__", "__odds__")]
                        judged = joined((before[0], before[1], before[2]), judged)
                    if last:
                        judged = told(*judged)
                    found = [pa.array(judged[0], pa.string()), *[pa.array(c, pa.float64()) for c in judged[1:]]]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], *found], names=[*names, *[f.name for f in more]])

    return rows.mapInArrow(run, StructType([*kept, *more]))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", (~learn_row(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")
