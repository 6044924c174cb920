"""Evaluation passages inside training texts.

The items' n-grams of normalised words go out as a hash set, in blocks of bounded size.
Every window of every text is looked up in it; hits on one diagonal are exact runs, and each
run that is long enough is extended both ways by an exact alignment. A passage counts if it
covers enough words of the item with few edits. Case, accents, punctuation, markup, quote marks and line breaks don't matter.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a seed. At most ``MAX_EDITS`` in ten words leave runs of at least this length.
SEED = 5
#: Words of an item that a text must carry in a row, and the share of them that may be altered, added or missing.
LEAST_WORDS, MAX_EDITS = 25, 0.11
#: Most words of items in one broadcast; larger sets are searched in several blocks.
BLOCK_WORDS = 2_000_000

WORD = re.compile(r"[^\W_]+(?:[̀-ͯ]+[^\W_]*)*")
MARKS = re.compile("[̀-ͯ]+")
MARKUP = re.compile(r"</?[A-Za-z][^<>]{0,300}>|&(?:[A-Za-z]{2,8}|#\d{1,6}|#x[0-9A-Fa-f]{1,5});|(?<=\])\([^()\s]{1,300}\)|(?<=\[\[)[^\[\]|]{1,100}\||\\[A-Za-z]{2,20}(?=\{)")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def without_markup(text: str) -> str:
    """The text with markup blanked out, character by character, so that offsets stay."""
    if "<" in text or "&" in text or "](" in text or "[[" in text or "\\" in text:
        return MARKUP.sub(lambda m: " " * len(m.group()), text)
    return text


def norm_word(w: str) -> str:
    if w.isascii():
        return w.lower()
    return MARKS.sub("", unicodedata.normalize("NFKD", w)).casefold()


def norm_words(text: str) -> list[str]:
    return [norm_word(w) for w in WORD.findall(without_markup(text))]


class _Ids(dict):
    """Spelled word -> id of its normal form, -1 for words of no item."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, w: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[w] = x = self.vocabulary.get(norm_word(w), -1)
        return x


def _grams(ids: np.ndarray, n: int) -> np.ndarray:
    k = len(ids) - n + 1
    u = ids.astype(np.uint64)
    g = u[:k].copy()
    for i in range(1, n):
        g *= _BASE
        g += u[i : i + k]
    return g


class Index:
    """The n-grams of a block of items."""

    def __init__(self, items: list[tuple[int, str]], n: int = SEED):
        self.n, self.vocabulary, self.items = n, {}, {}
        keys, places = [], []
        for item, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in norm_words(text)], np.int64)
            self.items[item] = ids.tolist()
            if len(ids) >= n:
                keys.append(_grams(ids, n))
                places.extend((item, i) for i in range(len(ids) - n + 1))
        flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.keys, self.first = np.unique(flat[order], return_index=True)
        self.ends = np.append(self.first[1:], len(flat))
        number = {item: k for k, item in enumerate(self.items)}
        self.names = list(self.items)
        self.place_item = np.array([number[places[i][0]] for i in order], np.int64)
        self.place_word = np.array([places[i][1] for i in order], np.int64)

    @classmethod
    def of(cls, data: dict) -> Index:
        """From plain data, the form in which it is broadcast."""
        self = cls.__new__(cls)
        self.__dict__.update(data)
        return self


def least_run(least: int, most: float) -> int:
    """Words of the longest exact run that any leaked passage holds at least.

    A passage of ``2 * least`` words or more splits in two of ``least`` or more, and one of them
    is no more edited than the whole; so only shorter ones matter, and e edits leave e + 1 runs.
    """
    return min(-(-(s - int(most * s)) // (int(most * s) + 1)) for s in range(least, 2 * least))


def _reach(doc: list[int], item: list[int], d: int, i: int, step: int, edits: int) -> list[tuple[int, int]]:
    """Most words of the item (and those of the text) gained from (d, i) on, for 0, 1, ... edits.

    The alignment is exact: the furthest point of every diagonal is kept for each number of
    edits. Gains end with equal words, so an altered word at the edge gains nothing.
    """
    room_d, room_i = (len(doc) - d, len(item) - i) if step > 0 else (d + 1, i + 1)
    far, out = {0: 0}, [(0, 0)]
    for e in range(1, edits + 1):
        now, best = {}, out[-1]
        for k in range(-e, e + 1):  # words of the text less words of the item
            x = max(far.get(k, -2) + 1, far.get(k + 1, -2) + 1, far.get(k - 1, -1))
            if x < 0 or x > room_i or not 0 <= x + k <= room_d:
                continue
            start = x
            while x < room_i and x + k < room_d and doc[d + step * (x + k)] == item[i + step * x]:
                x += 1
            now[k] = x
            if x > start and x > best[0]:
                best = (x, x + k)
        out.append(best)
        far = now
    return out


def _window(doc: list[int], item: list[int], d: int, i: int, run: int, least: int, most: float, edits: int) -> tuple[int, int, int, int] | None:
    """(first word, end word, words of the item, edits) of the longest passage around an exact run."""
    left, right = _reach(doc, item, d - 1, i - 1, -1, edits), _reach(doc, item, d + run, i + run, 1, edits)
    best = None
    for a, (li, ld) in enumerate(left):
        for b, (ri, rd) in enumerate(right[: edits + 1 - a]):
            n = run + li + ri
            if n >= least and a + b <= most * n and (best is None or (n, -a - b) > (best[2], -best[3])):
                best = (d - ld, d + run + rd, n, a + b)
    return best


def leaks(doc: list[int], index: Index, least: int = LEAST_WORDS, most: float = MAX_EDITS, every: bool = False) -> list[tuple[int, int, int, int, int]]:
    """(item, first word, end word, words of the item, edits) of the longest passage of each leaked item, or of ``every`` passage.

    Seeds on one diagonal that follow each other are one exact run. Any passage holds a run of
    ``least_run`` words; each such run is extended both ways by an exact alignment within the
    edits that the whole passage may have. Runs inside a passage found already are passed over.
    """
    n = index.n
    if len(doc) < n or not len(index.keys):
        return []
    ids = np.array(doc, np.int64)
    known = (ids >= 0).astype(np.int32)
    if int(known.sum()) < n:
        return []
    whole = np.convolve(known, np.ones(n, np.int32), "valid") == n
    g = _grams(ids, n)
    at = np.minimum(np.searchsorted(index.keys, g), len(index.keys) - 1)
    hit = np.flatnonzero(whole & (index.keys[at] == g))
    run_least = least_run(least, most)
    if len(hit) < run_least - n + 1:
        return []
    # every (word of the text, item, word of the item) that a hit stands for
    lo, sizes = index.first[at[hit]], index.ends[at[hit]] - index.first[at[hit]]
    place = np.repeat(lo - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(int(sizes.sum()))
    word, item_no, item_word = np.repeat(hit, sizes), index.place_item[place], index.place_word[place]
    order = np.lexsort((word, word - item_word, item_no))
    word, item_no, item_word = word[order], item_no[order], item_word[order]
    new = np.ones(len(word), bool)
    new[1:] = (item_no[1:] != item_no[:-1]) | (np.diff(word - item_word) != 0) | (np.diff(word) != 1)
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(word))) + n - 1
    good = length >= run_least
    runs = sorted(zip(item_no[first[good]].tolist(), word[first[good]].tolist(), item_word[first[good]].tolist(), length[good].tolist()))
    out, now, found, end = [], None, [], 0

    def close() -> None:
        if found:
            out.extend((index.names[now], *f) for f in (found if every else [max(found, key=lambda f: (f[2], -f[3], -f[0]))]))

    few = int(most * (2 * least - 1))
    for item, d, i, k in runs:
        if item != now:
            close()
            now, found, end = item, [], 0
        if d + k <= end:
            continue
        words = index.items[index.names[item]]
        if doc[d : d + k] != words[i : i + k]:  # two n-grams with one key
            continue
        w = _window(doc, words, d, i, k, least, most, few)
        if w is not None:
            w = max(w, _window(doc, words, d, i, k, least, most, int(most * len(words))) or w, key=lambda f: (f[2], -f[3]))
            found.append(w)
            end = max(end, w[1])
    close()
    return out


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most about BLOCK_WORDS words."""
    src = items.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t")).where("i is not null and t is not null")
    words = src.agg(F.sum(F.length("t") / 5)).first()[0] or 0
    blocks = max(1, int(-(-words // (BLOCK_WORDS / 2))))
    for b in range(blocks):
        part = src if blocks == 1 else src.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b)
        yield [(r["i"], r["t"]) for r in part.collect()]


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[Column] | tuple = (), least: int = LEAST_WORDS, most: float = MAX_EDITS) -> DataFrame:
    """One row per text and leaked item: ids, ``first_word``, ``end_word``, ``n_words`` of the item, ``n_edits``.

    NULL ids and NULL or empty texts and items give no rows; repeated rows give repeated rows.
    Items shorter than ``least`` words can't be found. Whole texts are searched.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(f"`{doc_id}`"), *keep, F.col(f"`{text_col}`").alias("_text")).where(F.col("_text").isNotNull() & F.col(f"`{doc_id}`").isNotNull())
    rest = [c for c in src.columns if c != "_text"]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "_text"]
    schema = ", ".join([*fields, f"`{item_id}` long", "first_word long", "end_word long", "n_words long", "n_edits long"])
    out = None
    for block in _blocks(items, item_id, item_text):
        shared = spark.sparkContext.broadcast(vars(Index(block)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index.of(shared.value)
            ids = _Ids(index.vocabulary)
            for b in batches:
                rows, found = [], []
                for r, t in enumerate(b.column("_text")):
                    got = leaks(list(map(ids.__getitem__, WORD.findall(without_markup(t.as_py())))), index, least, most)
                    rows.extend([r] * len(got))
                    found.extend(got)
                kept = b.select(rest).take(pa.array(rows, pa.int64()))
                cols = [pa.array([f[j] for f in found], pa.int64()) for j in range(5)]
                yield pa.RecordBatch.from_arrays([*kept.columns, *cols], [*rest, item_id, "first_word", "end_word", "n_words", "n_edits"])

        part = src.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def remove_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", drop_share: float = 0.5) -> DataFrame:
    """(id, text, n_cut, dropped): texts with leaked spans cut out; ``dropped`` marks those that lose ``drop_share`` or more of their words.

    Texts without leaks come out unchanged; NULL texts stay NULL. All blocks of items are applied one after the other.
    """
    spark = docs.sparkSession
    out = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.lit(0).cast("long").alias("n_cut"), F.lit(0).cast("long").alias("n_all"))
    for block in _blocks(items, item_id, item_text):
        shared = spark.sparkContext.broadcast(vars(Index(block)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index.of(shared.value)
            ids = _Ids(index.vocabulary)
            for b in batches:
                texts, cuts, alls = [], [], []
                for t, c, a in zip(b.column("text"), b.column("n_cut"), b.column("n_all")):
                    t, c, a = t.as_py(), c.as_py(), a.as_py()
                    if t:
                        at = [(m.start(), m.end(), ids[m.group()]) for m in WORD.finditer(without_markup(t))]
                        a = a or len(at)
                        spans = sorted((f[1], f[2]) for f in leaks([x[2] for x in at], index, every=True))
                        keep, end = [], 0
                        for lo, hi in spans:
                            if at[hi - 1][1] <= end:
                                continue
                            keep.append(t[end : max(end, at[lo][0])])
                            end = at[hi - 1][1]
                        if spans:
                            c += len(set().union(*(range(lo, hi) for lo, hi in spans)))
                            t = "".join([*keep, t[end:]])
                    texts.append(t)
                    cuts.append(c)
                    alls.append(a)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(texts, pa.string()), pa.array(cuts, pa.int64()), pa.array(alls, pa.int64())], ["id", "text", "n_cut", "n_all"])

        out = out.mapInArrow(run, out.schema)
    return out.select(F.col("id").alias(doc_id), F.col("text").alias(text_col), "n_cut", (F.coalesce(F.col("n_cut") / F.nullif(F.col("n_all"), F.lit(0)), F.lit(0.0)) >= drop_share).alias("dropped"))
