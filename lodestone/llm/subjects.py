"""Subject areas of documents by latent semantic analysis.

1. Documents are embedded by TF-IDF and a distributed randomised SVD. From each embedding the mean of its language is
   taken off, so that what is left tells subjects apart.
2. Seed centroids, one for each subject and language, come from documents with a single hand label and from the subjects'
   descriptions. They are refined: documents clearly nearest to a centroid by cosine move it, the seeds holding on to it.
3. Terms get their cosine with the centroids; a clear one must also occur more in documents of its subject than elsewhere.
   Sentences with clear terms then tell, term by term, how often the rest of a
   sentence is on a subject: a term is ``strong`` for a subject when most sentences with it are, ``weak`` when it leans
   to the subject though it has other uses. This is done twice, the second time from clear terms that turned out strong.
4. A sentence is about the subject it scores highest on, if it has two mentions (runs of adjacent terms) of it, one of
   them strong. A document is about the subjects of at least two of its sentences.

Only matrices of (terms or centroids x rank) reach the driver. Terms must occur in ``MIN_SHARE`` of all documents, which
bounds their number by the mean number of distinct words of a document divided by that share; ``latent.MOST_TERMS`` is
checked.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.latent import project, randomised_svd, unit
from lodestone.plans.staging import ship, spread, stage

WORD = re.compile(r"[^\W\d_]+")
CAMEL = re.compile(r"(?<=[a-zß-ÿ])(?=[A-Z])")
BREAK = re.compile(r"(?<=[.!?])[\"”»)]*\s+|\r\n\s*|\n\s*|\r\s*")
#: A line that goes on in the next one.
WRAPPED = re.compile(r"(?<![.!?:;\s])[ \t]*(?:\r\n|\n|\r)[ \t]*(?:[#>/]+[ \t]*)?(?=[a-zß-ÿ])")
#: Words inside a term of several words; they don't part two mentions.
LINKS = ("of", "de", "del", "la", "al", "der", "des")
#: Codes of languages by their other notations.
LANGUAGES = {"eng": "en", "english": "en", "deu": "de", "ger": "de", "german": "de", "spa": "es", "spanish": "es", "fra": "fr", "fre": "fr"}

RANK = 128
MIN_SHARE = 5e-4
MIN_DOCS = 3
#: A language needs this share of the documents to have centroids of its own.
LANGUAGE_SHARE = 0.005
#: Labelled documents that a subject must have in a language for a centroid there: fewer may have anything else in common.
MIN_SEEDS = 3
#: Cosine, and its lead over the next subject, from which a document moves a centroid.
NEAR, LEAD = 0.5, 0.2
ROUNDS = 2
#: Share of a centroid's best terms' cosine from which a term is clear.
CLEAR = 0.6
#: Share of all sentences with a term that are on the subject from which it is strong, and the least such share of a weak one.
STRONG, SEEN = 0.6, 0.07
#: Of a term's sentences that are on any subject, the least share of the subject, and its least ratio to the subject's share overall.
WEAK, LIFT = 0.12, 2.5


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence or list entry; identifiers are split at changes of case."""
    out = []
    for s in BREAK.split(WRAPPED.sub(" ", text)):
        ws = [w.lower() for w in WORD.findall(CAMEL.sub(" ", s))]
        if ws:
            out.append(ws)
    return out


def language(lang):
    """A column of language codes from their notations; unknown ones stay null."""
    plain = F.lower(F.trim(lang))
    out = plain
    for k, v in LANGUAGES.items():
        out = F.when(plain == k, v).otherwise(out)
    return F.when(plain != "", out)


def vocabulary_of(documents: DataFrame, langs: list[str], min_share: float) -> tuple[list[str], np.ndarray]:
    """Terms, and their inverse document frequencies in each language and, in the last row, overall."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted({w for s in sentences(t) for w in s}) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(terms, pa.list_(pa.string()))], names=["lang", "terms"])

    sizes = [F.count_if(F.col("lang") == g).alias(f"n{i}") for i, g in enumerate(langs)]
    totals = documents.agg(*sizes, F.count(F.lit(1)).alias("n")).first()
    least = max(MIN_DOCS, int(np.ceil(min_share * totals["n"])))
    found = documents.select("lang", "text").mapInArrow(run, "lang string, terms array<string>").select("lang", F.explode("terms").alias("term"))
    kept = found.groupBy("term").agg(*sizes, F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).orderBy("term").toPandas()
    counts = kept.drop(columns="term").to_numpy(dtype=np.float64).T
    idf = np.log((1 + np.array(tuple(totals)))[:, None] / (1 + counts))
    return kept["term"].tolist(), np.minimum(idf, idf[-1])  # a word of another language isn't telling


class Weigher:
    """Unit TF-IDF vectors of coded documents (ids; -1: no term, -2: end of a sentence).

    Term weights are those of the document's language, in which its everyday words are common; overall ones where it is
    unknown.
    """

    def __init__(self, idf: np.ndarray, place: dict[str, int]):
        self.idf, self.place = idf.astype(np.float32), place

    def __call__(self, batch: pa.RecordBatch):
        column = batch.column("ids")
        offsets = column.offsets.to_numpy()
        flat = column.values.to_numpy()[offsets[0] : offsets[-1]]
        row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        known = flat >= 0
        terms = np.int64(self.idf.shape[1])
        lang = np.array([self.place.get(x, len(self.idf) - 1) for x in batch.column("lang").to_pylist()], dtype=np.int64)
        pair, times = np.unique(row[known] * terms + flat[known], return_counts=True)
        r, ids = pair // terms, (pair % terms).astype(np.int64)
        weights = ((1 + np.log(times)) * self.idf[lang[r], ids]).astype(np.float32)
        length = np.sqrt(np.bincount(r, weights.astype(np.float64) ** 2, minlength=batch.num_rows))
        weights = weights / np.where(length > 0, length, 1)[r].astype(np.float32)
        return np.concatenate([[0], np.cumsum(np.bincount(r, minlength=batch.num_rows))]), ids, weights


def group_sums(rows: DataFrame, weigh: Weigher, basis: np.ndarray, groups: int, assign) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of vectors by group. ``assign(batch, z)`` gives (row places, groups, vectors)."""
    sent = rows.sparkSession.sparkContext.broadcast(basis)
    rank = basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros((groups, rank + 1))
        for batch in batches:
            if batch.num_rows:
                group, vectors = assign(batch, project(*weigh(batch), sent.value))
                for g in np.unique(group):
                    acc[g, :rank] += vectors[group == g].sum(axis=0)
                    acc[g, rank] += (group == g).sum()
        g, d = np.nonzero(acc)
        yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), pa.array(d.astype(np.int32)), pa.array(acc[g, d])], names=["g", "d", "v"])

    got = rows.mapInArrow(run, "g int, d int, v double").groupBy("g", "d").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((groups, rank + 1))
    out[got["g"].to_numpy(dtype=np.int64), got["d"].to_numpy(dtype=np.int64)] = got["v"].to_numpy()
    return out[:, :rank], out[:, rank]


def row_sums(rows: DataFrame, weigh: Weigher, terms: int, place: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of the documents' vectors by language, not yet projected."""
    groups = len(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(groups * (terms + 1))
        for batch in batches:
            if batch.num_rows:
                offsets, ids, weights = weigh(batch)
                group = np.array([place.get(x, 0) for x in batch.column("lang").to_pylist()], dtype=np.int64)
                at = np.repeat(group, np.diff(offsets)) * (terms + 1) + ids
                acc += np.bincount(at, weights, minlength=len(acc)) + np.bincount(group * (terms + 1) + terms, minlength=len(acc))
        k = np.flatnonzero(acc)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(acc[k])], names=["k", "v"])

    got = rows.mapInArrow(run, "k bigint, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(groups * (terms + 1))
    out[got["k"].to_numpy(dtype=np.int64)] = got["v"].to_numpy()
    out = out.reshape(groups, terms + 1)
    return out[:, :terms], out[:, terms]


def term_subjects(rows: DataFrame, weigh: Weigher, basis: np.ndarray, subjects: int, assign) -> np.ndarray:
    """Of the documents that hold a term, how many are on each subject (terms x subjects). ``assign`` as for ``group_sums``."""
    sent = rows.sparkSession.sparkContext.broadcast(basis)
    terms = len(basis)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(terms * subjects, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                offsets, ids, weights = weigh(batch)
                row, subject = assign(batch, project(offsets, ids, weights, sent.value))
                of = np.full(batch.num_rows, -1, dtype=np.int64)
                of[row] = subject
                each = np.repeat(of, np.diff(offsets))
                acc += np.bincount(ids[each >= 0] * subjects + each[each >= 0], minlength=len(acc))
        k = np.flatnonzero(acc)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(acc[k])], names=["k", "n"])

    got = rows.mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(terms * subjects)
    out[got["k"].to_numpy(dtype=np.int64)] = got["n"].to_numpy()
    return out.reshape(terms, subjects)


def encode(documents: DataFrame, terms: list[str]) -> DataFrame:
    sent = documents.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = sent.value.get
        for batch in batches:
            coded = [[i for s in sentences(t) for i in (*(get(w, -1) for w in s), -2)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), pa.array(coded, pa.list_(pa.int32()))], names=["doc_id", "lang", "ids"]
            )

    return documents.mapInArrow(run, "doc_id bigint, lang string, ids array<int>")


def phrases(ids: list[int], use: np.ndarray, links: frozenset) -> list[list[int]]:
    """Runs of adjacent terms in use; linking words inside a run don't part it."""
    out, now = [], []
    for i in ids:
        if i >= 0 and use[i]:
            now.append(i)
        elif now and i in links:
            continue
        elif now:
            out.append(now)
            now = []
    if now:
        out.append(now)
    return out


def split_ids(flat: np.ndarray) -> list[list[int]]:
    ends = np.flatnonzero(flat == -2)
    begin = np.concatenate([[0], ends[:-1] + 1])
    whole = flat.tolist()
    return [whole[a:b] for a, b in zip(begin.tolist(), ends.tolist())]


class Lexicon:
    """Scores of terms: (terms x subjects) for weak and strong use."""

    def __init__(self, score: np.ndarray, weak: np.ndarray, strong: np.ndarray, links: frozenset):
        self.score, self.weak, self.strong, self.links = np.where(weak, score, 0.0), weak, strong, links
        self.use = weak.any(axis=1)

    def subject(self, ids: list[int]) -> int:
        """The subject a sentence is about, or -1."""
        runs = phrases(ids, self.use, self.links)
        if len(runs) < 2:
            return -1
        total = np.sum([self.score[r].max(axis=0) for r in runs], axis=0)
        k = int(total.argmax())
        mentions = sum(1 for r in runs if self.weak[r, k].any())
        return k if mentions >= 2 and any(self.strong[r, k].any() for r in runs) else -1


def _lexicon(coded: DataFrame, clear: np.ndarray, nearest: np.ndarray, subjects: int, links: frozenset) -> Lexicon:
    """From terms that are clear for a subject (``nearest``): how often the rest of a term's sentences is on which subject."""
    terms = len(clear)
    sent = coded.sparkSession.sparkContext.broadcast((clear, nearest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clear, nearest = sent.value
        acc = np.zeros((terms + 1, subjects + 1))
        for batch in batches:
            column = batch.column("ids")
            offsets, flat = column.offsets.to_numpy(), column.values.to_numpy()
            for a, b in zip(offsets[:-1], offsets[1:]):
                for ids in split_ids(flat[a:b]):
                    own = [i for i in dict.fromkeys(ids) if i >= 0]
                    for i in own:
                        acc[i, subjects] += 1
                    runs = phrases(ids, clear, links)
                    if not runs:
                        continue
                    subject_of = [Counter(nearest[r].tolist()).most_common(1)[0][0] for r in runs]
                    for s in set(subject_of):
                        acc[terms, s] += 1 / len(set(subject_of))
                    for i in own:
                        rest = {s for r, s in zip(runs, subject_of) if i not in r}
                        for s in rest:
                            acc[i, s] += 1 / len(rest)
        t, s = np.nonzero(acc)
        yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), pa.array(s.astype(np.int32)), pa.array(acc[t, s])], names=["t", "s", "v"])

    got = coded.mapInArrow(run, "t int, s int, v double").groupBy("t", "s").agg(F.sum("v").alias("v")).toPandas()
    table = np.zeros((terms + 1, subjects + 1))
    table[got["t"].to_numpy(dtype=np.int64), got["s"].to_numpy(dtype=np.int64)] = got["v"].to_numpy()
    with_subject, seen = table[:terms, :subjects], np.maximum(table[:terms, subjects:], 1)
    prior = (table[terms, :subjects] + 1e-9) / (table[terms, :subjects].sum() + 1e-9 * subjects)
    share = (with_subject + 5 * prior) / (with_subject.sum(axis=1, keepdims=True) + 5)
    lean = (share >= WEAK) & (share / prior >= np.minimum(LIFT, 0.75 / prior)) & (with_subject >= MIN_DOCS)
    return Lexicon(share, lean & (with_subject / seen >= SEEN), lean & (with_subject / seen >= STRONG), links)


def assign_subjects(
    documents: DataFrame,
    subjects: DataFrame,
    labels: DataFrame,
    *,
    rank: int = RANK,
    min_share: float = MIN_SHARE,
    rounds: int = ROUNDS,
    seed: int = 7,
) -> DataFrame:
    """(doc_id, subject, sentences) for each subject that at least two sentences of a document are about.

    documents: doc_id, text, lang. subjects: subject, description. labels: doc_id, subject; only documents with one
    label, read without regard to case and blanks, serve as seeds. Null and empty texts have no subject, nor do all
    documents if there are no subjects, no labels and no matching descriptions. Documents that share an id are taken
    together. Texts are processed whole. A null or unknown language is the one whose documents are nearest. Extra columns
    are ignored, and empty tables give an empty result.
    """
    spark = documents.sparkSession
    ship(documents.sparkSession)
    names = sorted({r[0].strip() for r in subjects.select("subject").where("trim(subject) != ''").collect()})
    about = {r[0].strip(): r[1] or "" for r in subjects.select("subject", "description").where("trim(subject) != ''").collect()}
    schema = "doc_id bigint, subject string, sentences bigint"
    if not names:
        return spark.createDataFrame([], schema)
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), language(F.col("lang")).alias("lang"), "text").where("text != ''")
    texts = spread(texts)
    by_lang = texts.groupBy("lang").count().collect()  # as many rows as there are notations of languages
    whole = sum(r["count"] for r in by_lang)
    langs = sorted(r["lang"] for r in by_lang if r["lang"] is not None and r["count"] >= LANGUAGE_SHARE * whole) or [""]
    place = {g: i for i, g in enumerate(langs)}
    terms, idf = vocabulary_of(texts, langs, min_share)
    if not terms:
        return spark.createDataFrame([], schema)
    coded, weigh = stage(encode(texts, terms)), Weigher(idf, place)
    basis, values = randomised_svd(coded, len(terms), min(rank, len(terms)), weigh, seed=seed)
    if basis.shape[1] == 0:
        return spark.createDataFrame([], schema)

    sums, n = row_sums(coded.where(F.col("lang").isin(langs)) if langs != [""] else coded, weigh, len(terms), place)
    means = (sums / np.maximum(n, 1)[:, None]) @ basis
    ways = unit(means)

    def centred(batch: pa.RecordBatch, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        g = np.array([place.get(x, -1) for x in batch.column("lang").to_pylist()])
        g = np.where(g < 0, (unit(z) @ ways.T).argmax(axis=1), g)
        return g, unit(z - means[g])

    of = {s.lower(): i for i, s in enumerate(names)}
    listed = spark.createDataFrame(list(of.items()), "subject string, s int")  # the subjects: as many as their table has
    single = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower(F.trim("subject")).alias("subject"))
        .join(F.broadcast(listed), "subject")
        .groupBy("doc_id")
        .agg(F.min("s").alias("s"), F.max("s").alias("other"))
        .where("s = other")
        .drop("other")
    )
    size = len(names) * len(langs)

    def seeded(batch: pa.RecordBatch, z: np.ndarray):
        g, v = centred(batch, z)
        return np.array(batch.column("s").to_pylist(), dtype=np.int64) * len(langs) + g, v

    seeds, labelled = group_sums(coded.join(single, "doc_id"), weigh, basis, size, seeded)
    seeds[labelled < MIN_SEEDS] = 0
    index = {t: i for i, t in enumerate(terms)}
    home = place.get("en", 0)
    for i, s in enumerate(names):
        known = [index[w] for ws in sentences(f"{s}. {about[s]}") for w in ws if w in index]
        if known:
            seeds[i * len(langs) + home] += unit((weigh.idf[home, known] @ basis[known])[None, :] / len(known) - means[home])[0]
    seeds = unit(seeds)
    centroids = seeds

    def sure(batch: pa.RecordBatch, z: np.ndarray, centroids: np.ndarray):
        """Places, subjects, languages and vectors of the documents that are clearly nearest to one centroid."""
        g, v = centred(batch, z)
        cosine = (v @ centroids.T).reshape(len(v), len(names), len(langs))[np.arange(len(v)), :, g]
        order = np.sort(np.column_stack([np.zeros(len(v)), cosine]), axis=1)
        at = np.flatnonzero((order[:, -1] > NEAR) & (order[:, -1] - order[:, -2] > LEAD))
        return at, cosine[at].argmax(axis=1), g[at], v[at]

    for _ in range(rounds):

        def nearest(batch: pa.RecordBatch, z: np.ndarray, centroids=centroids):
            _, s, g, v = sure(batch, z, centroids)
            return s * len(langs) + g, v

        moved, _ = group_sums(coded, weigh, basis, size, nearest)
        centroids = unit(seeds + unit(moved))
    final = centroids
    held = term_subjects(coded, weigh, basis, len(names), lambda b, z: sure(b, z, final)[:2])
    prior = held.sum(axis=0) / max(held.sum(), 1)
    share = (held + 5 * prior) / (held.sum(axis=1, keepdims=True) + 5)
    leaning = share >= np.minimum(LIFT * prior, 0.75)
    # terms against centroids; singular values bring terms onto the scale of documents
    cosine = unit(basis * values) @ centroids.T
    best = np.sort(cosine, axis=0)[::-1][:5].mean(axis=0)
    relative = (cosine / np.where(best > 0.2, best, np.inf)).reshape(len(terms), len(names), len(langs)).max(axis=2)
    links = frozenset(index[w] for w in LINKS if w in index)
    nearest_to = relative.argmax(axis=1)
    clear = (relative.max(axis=1) >= CLEAR) & leaning[np.arange(len(terms)), nearest_to]
    first = _lexicon(coded, clear, nearest_to, len(names), links)
    lexicon = _lexicon(coded, clear & first.strong[np.arange(len(terms)), nearest_to], nearest_to, len(names), links)
    sent = spark.sparkContext.broadcast((lexicon, names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, names = sent.value
        for batch in batches:
            column = batch.column("ids")
            offsets, flat = column.offsets.to_numpy(), column.values.to_numpy()
            docs, found, times = [], [], []
            for d, a, b in zip(batch.column("doc_id").to_pylist(), offsets[:-1], offsets[1:]):
                for s, n in Counter(lexicon.subject(ids) for ids in split_ids(flat[a:b])).items():
                    if s >= 0:
                        docs.append(d)
                        found.append(names[s])
                        times.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(found, pa.string()), pa.array(times, pa.int64())], names=["doc_id", "subject", "sentences"])

    return coded.mapInArrow(run, schema).groupBy("doc_id", "subject").agg(F.sum("sentences").alias("sentences")).where("sentences >= 2")
