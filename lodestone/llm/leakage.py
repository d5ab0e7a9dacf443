"""Evaluation texts inside training texts, found by latent semantic retrieval and confirmed word by word.

1. A text's words are the longest runs of letters and digits, in lower case. Documents become arrays of ids in the
   vocabulary of the items (-1: no word of any item).
2. Passages are 26 words long and begin every 13 words, so that 13 words in a row always lie in one. A randomised SVD
   of all passages' TF-IDF vectors gives the latent space.
3. A passage and an item are a candidate for a case when the passage has enough words of the item in a row, whatever its
   cosine: each pair without such a run can't hold wording of the item (an exact condition). Items are also cut into
   windows of 16 words that begin every 4 words; a passage with enough words of the item is a candidate for a paraphrase
   when its cosine with one of the windows reaches ``TAU``. Enough is an exact condition too, and each item's own.
4. Each candidate gets its longest common subsequence, its longest common run and the share of the item's distinctive
   words that are named (the answer check). For a paraphrase every stretch that the passage holds enough of is tried.

The items are the stated query set: they are sent out in blocks of at most ``BLOCK`` items. Documents are never gathered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.latent import project, randomised_svd, unit
from lodestone.plans.staging import ship, spread, stage

WORD = re.compile(r"[^\W_]+")
RUN, PASSAGE, WINDOW, STEP = 13, 26, 16, 4
#: Least cosine of a candidate for a paraphrase (less for items of fewer than 13 words, with the root of their length). Wording word by word is found without it.
TAU = 0.3
RANK = 96
BLOCK = 2000
#: Passages compared at a time.
ROWS = 128
#: Of a candidate without a long common run: a paraphrase has this share of the words of a stretch, or of a shorter item, in order. The stretch is as long as the item, 13 words at least and 26 at most; ...
PARAPHRASE = 0.7
#: ... of one that begins anywhere some passage holds all but so many words at most.
OUTSIDE = PASSAGE // 2 - RUN // 2 - 1
#: Places at which such a stretch may begin.
STARTS = PASSAGE - RUN + 2 * OUTSIDE + 1
#: ... and names this share of the distinctive words of the nearest window.
ANSWER = 0.5


def words(text: str | None) -> list[str]:
    return [w.lower() for w in WORD.findall(text)] if text else []


@dataclass
class Items:
    """What is sent out of a block of items."""

    item_ids: list[int]
    vocabulary: dict[str, int]
    texts: np.ndarray  # items x longest, -1 behind the end
    need: np.ndarray  # words in a row that make a case
    width: np.ndarray  # words of the stretch in which a paraphrase lies
    told: np.ndarray  # words in order that make a paraphrase
    held: np.ndarray  # of these, words in the nearest passage
    window_of: np.ndarray  # first window of each item
    windows: list[np.ndarray]
    distinctive: list[frozenset]


def prepare(rows: list[tuple[int, str]]) -> Items:
    """Items without a word are left out."""
    split = [(i, words(t)) for i, t in rows]
    split = [(i, w) for i, w in split if w]
    vocabulary: dict[str, int] = {}
    for _, ws in split:
        for w in ws:
            vocabulary.setdefault(w, len(vocabulary))
    coded = [np.array([vocabulary[w] for w in ws], dtype=np.int32) for _, ws in split]
    longest = max((len(c) for c in coded), default=1)
    texts = np.full((len(coded), longest), -1, dtype=np.int32)
    holders = np.zeros(len(vocabulary), dtype=np.int64)
    for i, c in enumerate(coded):
        texts[i, : len(c)] = c
        holders[np.unique(c)] += 1
    windows, first = [], []
    for c in coded:
        first.append(len(windows))
        windows += [c[s : s + WINDOW] for s in range(0, max(1, len(c) - WINDOW + STEP), STEP)]
    rare = max(1, len(coded) // 50)
    distinctive = [frozenset(int(t) for t in np.unique(c) if holders[t] <= rare) for c in coded]
    need = np.array([min(RUN, len(c)) for c in coded], dtype=np.int32)
    width = np.array([min(PASSAGE, max(RUN, len(c))) for c in coded], dtype=np.int32)
    told = np.array([-int(-PARAPHRASE * min(PASSAGE, len(c)) // 1) for c in coded], dtype=np.int32)
    held = np.maximum(1, told - (width - RUN) // 2)
    return Items([i for i, _ in split], vocabulary, texts, need, width, told, held, np.array(first, dtype=np.int64), windows, distinctive)


def passages_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For documents of these lengths: the document and the first word of each passage."""
    count = np.where(lengths > 0, np.maximum(1, -(-(lengths - RUN) // RUN)), 0)
    doc = np.repeat(np.arange(len(lengths)), count)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    return doc, (np.arange(len(doc)) - first[doc]) * RUN


def passage_words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document row and first word of each passage, and its word ids (passages x 26, -2 behind the end)."""
    column = batch.column("ids")
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy()
    doc, at = passages_of(np.diff(offsets))
    place = offsets[doc][:, None] + at[:, None] + np.arange(PASSAGE)
    inside = place < offsets[doc + 1][:, None]
    out = np.where(inside, flat[np.minimum(place, max(len(flat) - 1, 0))] if len(flat) else -2, -2).astype(np.int32)
    return doc, at, out


def weighted(table: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of word ids (negative: none) as unit TF-IDF vectors; a repeated word has several entries."""
    known = table >= 0
    ids = table[known]
    weights = idf[ids].astype(np.float32)
    offsets = np.concatenate([[0], np.cumsum(known.sum(axis=1))])
    # length with repeats summed
    row = np.repeat(np.arange(len(table)), np.diff(offsets))
    order = np.lexsort((ids, row))
    r, t, w = row[order], ids[order], weights[order]
    if len(r):
        new = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (t[1:] != t[:-1])])
        square = np.zeros(len(table))
        np.add.at(square, r[new], np.add.reduceat(w, new) ** 2)
        weights = weights / np.sqrt(np.where(square > 0, square, 1))[row].astype(np.float32)
    return offsets, ids, weights


def longest_run_known(table: np.ndarray) -> np.ndarray:
    """Longest run of known words in each row."""
    best = now = np.zeros(len(table), dtype=np.int32)
    for j in range(table.shape[1]):
        now = np.where(table[:, j] >= 0, now + 1, 0)
        best = np.maximum(best, now)
    return best


def stretches(batch: pa.RecordBatch, doc: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Word ids of the ``width`` words from ``first`` on of these documents; -2 before the beginning and behind the end."""
    column = batch.column("ids")
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy()
    place = (offsets[doc] + first)[:, None] + np.arange(width)
    inside = (place >= offsets[doc][:, None]) & (place < offsets[doc + 1][:, None])
    return np.where(inside, flat[np.clip(place, 0, max(len(flat) - 1, 0))] if len(flat) else -2, -2).astype(np.int32)


def possible(held: np.ndarray, need: np.ndarray) -> np.ndarray:
    """For each passage and item whether the words can do for a case, which needs a run of words that the item has.

    held (passages x words x items): is the word in the item.
    """
    now = best = np.zeros((held.shape[0], held.shape[2]), dtype=np.uint8)
    for j in range(held.shape[1]):
        now = (now + 1) * held[:, j]
        best = np.maximum(best, now)
    return best >= need


def held_from(held: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The words held in the stretch of each row's width that begins at each word. held (rows x words): is the word in the item."""
    summed = np.zeros((held.shape[0], held.shape[1] + 1), dtype=np.int16)
    np.cumsum(held, axis=1, out=summed[:, 1:])
    ends = np.minimum(np.arange(held.shape[1]) + width[:, None], held.shape[1])
    return np.take_along_axis(summed, ends, axis=1) - summed[:, :-1]


def common(passages: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longest common subsequence and longest common run of paired rows of word ids (negative never matches)."""
    n, width = passages.shape
    bit = np.uint64(1) << np.arange(width, dtype=np.uint64)
    full = np.uint64((1 << width) - 1)
    v = np.full(n, full, dtype=np.uint64)
    run = np.zeros((n, width + 1), dtype=np.int16)
    best = np.zeros(n, dtype=np.int16)
    for j in range(items.shape[1]):
        word = items[:, j]
        same = (passages == word[:, None]) & (word >= 0)[:, None]
        m = (same * bit).sum(axis=1, dtype=np.uint64)
        u = v & m
        v = ((v + u) | (v - u)) & full
        run[:, 1:] = np.where(same, run[:, :-1] + 1, 0)
        best = np.maximum(best, run.max(axis=1))
    zeros = np.zeros(n, dtype=np.int16)
    left = v.copy()
    for _ in range(width):
        zeros += (left & np.uint64(1)).astype(np.int16)
        left >>= np.uint64(1)
    return (width - zeros).astype(np.int16), best


def code(documents: DataFrame, vocabulary: dict[str, int], doc_id: str, text: str) -> DataFrame:
    """(doc_id, ids) of every document that has a word."""
    sent = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = sent.value.get
        for batch in batches:
            ids = [[get(w, -1) for w in words(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    picked = documents.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return spread(picked.where("text is not null and text != ''")).mapInArrow(run, "doc_id bigint, ids array<int>")


def passage_counts(coded: DataFrame, terms: int) -> tuple[np.ndarray, int]:
    """In how many passages each term occurs, and the number of passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(terms + 1, dtype=np.int64)
        for batch in batches:
            table = np.sort(passage_words(batch)[2], axis=1)
            new = np.ones(table.shape, dtype=bool)
            new[:, 1:] = table[:, 1:] != table[:, :-1]
            acc[:terms] += np.bincount(table[new & (table >= 0)], minlength=terms)
            acc[terms] += len(table)
        at = np.flatnonzero(acc)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(acc[at])], names=["term", "n"])

    got = coded.mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(terms + 1, dtype=np.int64)
    out[got["term"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=np.int64)
    return out[:terms], int(out[terms])


def _search(coded: DataFrame, items: Items, tau: float, rank: int, seed: int) -> DataFrame:
    counts, total = passage_counts(coded, len(items.vocabulary))
    idf = np.log((1 + total) / (1 + counts)).astype(np.float32) + 1

    def weigh(batch: pa.RecordBatch):
        return weighted(passage_words(batch)[2], idf)

    basis, _ = randomised_svd(coded, len(items.vocabulary), rank, weigh, seed=seed)
    if basis.shape[1] == 0:  # no document has a word of the items
        basis = np.zeros((len(items.vocabulary), 1), dtype=np.float32)
    padded = np.full((len(items.windows), WINDOW), -1, dtype=np.int32)
    for i, w in enumerate(items.windows):
        padded[i, : len(w)] = w
    latent = unit(project(*weighted(padded, idf), basis)).astype(np.float32)
    sent = coded.sparkSession.sparkContext.broadcast((items, idf, basis, latent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, idf, basis, latent = sent.value
        item_ids = np.array(items.item_ids, dtype=np.int64)
        least = int(items.need.min())
        holds = np.zeros((len(items.vocabulary) + 2, len(item_ids)), dtype=np.uint8)  # the last two rows are for -1 and -2
        enough = tau * np.sqrt(items.need / RUN)  # a short item makes up less of a passage
        for i, text in enumerate(items.texts):
            holds[text[text >= 0], i] = 1
        # of the items that ask for the same number of words, the words of any
        some_of = [(h, holds[:, items.held == h].any(axis=1)) for h in np.unique(items.held)]

        def out(doc_ids, item, cosine, lcs, long, told, full) -> pa.RecordBatch:
            """Rows of pairs; told: the words among which the distinctive ones are looked for."""
            share = np.array([len(items.distinctive[b] & set(w.tolist())) / max(1, min(len(items.distinctive[b]), 4)) for w, b in zip(told, item)])
            good = full | (share >= ANSWER)
            columns = [
                pa.array(doc_ids[good]),
                pa.array(item_ids[item[good]]),
                pa.array(cosine[good].astype(np.float64)),
                pa.array(lcs[good].astype(np.int32)),
                pa.array(long[good].astype(np.int32)),
                pa.array(np.minimum(share[good], 1.0)),
                pa.array(full[good]),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "cosine", "lcs", "run", "answer", "verbatim"])

        for batch in batches:
            doc, at, table = passage_words(batch)
            running = longest_run_known(table) >= least
            keep = running.copy()
            for h, own in some_of:
                keep |= own[table].sum(axis=1) >= h
            doc, at, table, running = doc[keep], at[keep], table[keep], running[keep]
            doc_ids = batch.column("doc_id").to_numpy()
            for k in range(0, len(table), ROWS):
                some = table[k : k + ROWS]
                near = holds[some].sum(axis=1, dtype=np.uint8) >= items.held
                worth = np.flatnonzero(near.any(axis=1) | running[k : k + ROWS])
                if not len(worth):
                    continue
                some, near, of, begin, runs = some[worth], near[worth], doc[k + worth], at[k + worth], np.flatnonzero(running[k + worth])
                z = unit(project(*weighted(some, idf), basis)).astype(np.float32)
                cosine = np.maximum.reduceat(z @ latent.T, items.window_of, axis=1)
                p, i = np.nonzero(possible(holds[some[runs]], items.need))
                p = runs[p]
                told = np.zeros(near.shape, dtype=bool)  # a case is no paraphrase
                for c in range(0, len(p), 4096):
                    pc, ic = p[c : c + 4096], i[c : c + 4096]
                    lcs, long = common(some[pc], items.texts[ic])
                    good = long >= items.need[ic]
                    if good.any():
                        pc, ic = pc[good], ic[good]
                        told[pc, ic] = True
                        yield out(doc_ids[of[pc]], ic, cosine[pc, ic], lcs[good], long[good], some[pc], np.ones(len(pc), dtype=bool))
                p, i = np.nonzero(near & (cosine >= enough) & ~told)
                for c in range(0, len(p), 4096):
                    pc, ic = p[c : c + 4096], i[c : c + 4096]
                    # every stretch of which the passage holds enough lies in these words
                    wide = stretches(batch, of[pc], begin[pc] - OUTSIDE, PASSAGE + 2 * OUTSIDE)
                    enough_from = held_from(holds[wide, ic[:, None]], items.width[ic])[:, :STARTS] >= items.told[ic][:, None]
                    good = enough_from.any(axis=1)
                    if good.any():
                        good[good] = common(wide[good], items.texts[ic[good]])[0] >= items.told[ic[good]]
                    row, shift = np.nonzero(enough_from & good[:, None])
                    if not len(row):
                        continue
                    pc, ic = pc[row], ic[row]
                    place = shift[:, None] + np.arange(PASSAGE)
                    there = wide[row[:, None], np.minimum(place, wide.shape[1] - 1)]
                    there[(np.arange(PASSAGE) >= items.width[ic][:, None]) | (place >= wide.shape[1])] = -2
                    lcs, long = common(there, items.texts[ic])
                    good = lcs >= items.told[ic]
                    if good.any():
                        pc, ic = pc[good], ic[good]
                        yield out(doc_ids[of[pc]], ic, cosine[pc, ic], lcs[good], long[good], there[good], np.zeros(len(pc), dtype=bool))

    return coded.mapInArrow(run, "doc_id bigint, item_id bigint, cosine double, lcs int, run int, answer double, verbatim boolean")


def leaks(
    documents: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    tau: float = TAU,
    rank: int = RANK,
    seed: int = 7,
) -> DataFrame:
    """Documents that contain wording of items.

    Result, one row per (doc_id, item_id): ``cosine`` (greatest), ``lcs`` and ``run`` (words in common, in order and in a
    row, of the best passage), ``answer`` (share of the item's distinctive words named, 4 at most counted), ``verbatim``
    (13 words in a row, or the whole of a shorter item). Rows that aren't verbatim are paraphrases: a stretch of the
    document, as long as the item but of 13 words at least and 26 at most, has at least ``PARAPHRASE`` of the item's words
    (of 26, if they are more) in order, and ``ANSWER`` of its distinctive ones. Whether an item is found doesn't depend on the other items but through the weights of words.

    Null and empty texts and texts without a word give no rows; neither do items without a word. Repeated documents or
    items count once; rows that share an id are taken together. Texts of any length are processed whole. Empty tables
    give an empty result. Other columns are ignored.
    """
    ship(documents.sparkSession)
    picked = items.select(F.col(f"`{item_id}`").cast("bigint").alias("item"), F.col(f"`{text}`").alias("text")).where("item is not null").distinct()
    listed = ((r[0], r[1]) for r in picked.orderBy("item", "text").toLocalIterator())  # the query set, a block at a time
    out = None
    while rows := list(islice(listed, BLOCK)):
        block = prepare(rows)
        if not block.item_ids:
            continue
        found = _search(stage(code(documents, block.vocabulary, doc_id, text)), block, tau, rank, seed)
        out = found if out is None else out.unionByName(found)
    if out is None:
        schema = "doc_id bigint, item_id bigint, cosine double, lcs int, run int, answer double, verbatim boolean"
        return documents.sparkSession.createDataFrame([], schema)
    return out.groupBy("doc_id", "item_id").agg(
        F.max("cosine").alias("cosine"),
        F.max("lcs").alias("lcs"),
        F.max("run").alias("run"),
        F.max("answer").alias("answer"),
        F.max("verbatim").alias("verbatim"),
    )
