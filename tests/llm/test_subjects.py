import random

import pytest

from lodestone.llm.subjects import assign_subjects, sentences

from ..conftest import rows

TERMS = {
    "music": ["violin", "chord", "melody", "octave", "sonata", "tempo", "choir", "drummer"],
    "farming": ["tractor", "harvest", "orchard", "barn", "silo", "herd", "pasture", "wheat"],
    "law": ["verdict", "subpoena", "statute", "plaintiff", "bailiff", "appeal", "tribunal", "affidavit"],
}
FRAMES = ["The report lists the {a}, the {b} and whatever was left.", "See the page for how the {a} relates to the {b}.", "Users asked for a view of each {a} beside the {b}."]
FILLER = ["Nothing else changed in this release.", "Run the checks before you open a request.", "Open questions are collected at the end.", "Somebody joked that this release needs a {a}."]


def corpus(seed, n=600):
    rng = random.Random(seed)
    docs, truth, labels = [], set(), []
    for d in range(n):
        chosen = rng.sample(sorted(TERMS), rng.choice([0, 1, 1, 1, 2]))
        text = [rng.choice(FILLER).format(a=rng.choice(TERMS[rng.choice(sorted(TERMS))])) for _ in range(rng.randrange(1, 5))]
        for s in chosen:
            k = rng.choice([1, 2, 3, 4])
            for _ in range(k):
                a, b = rng.sample(TERMS[s], 2)
                text.append(rng.choice(FRAMES).format(a=a, b=b))
            if k >= 2:
                truth.add((d, s))
            if len(chosen) == 1 and rng.random() < 0.2:
                labels.append((d, s.upper() if rng.random() < 0.2 else s, "x"))
        rng.shuffle(text)
        docs.append((d, "\n".join(f"- {s}" for s in text) if d % 2 else " ".join(text), "en", "x"))
    return docs, truth, labels


@pytest.fixture(scope="module")
def subjects(spark):
    return spark.createDataFrame([(s, f"About {s}.") for s in TERMS], "subject string, description string")


DOCS, LABELS = "doc_id bigint, text string, lang string, subject string", "doc_id bigint, subject string, annotator string"


def test_held_out_accuracy(spark, subjects):
    docs, truth, labels = corpus(1)
    got = set(rows(assign_subjects(spark.createDataFrame(docs, DOCS), subjects, spark.createDataFrame(labels, LABELS), rank=24).select("doc_id", "subject")))
    assert len(got & truth) >= 0.97 * len(truth) and len(got & truth) >= 0.97 * len(got)


def test_odd_rows(spark, subjects):
    docs, _, labels = corpus(2, 200)
    docs += [(900, None, None, "x"), (901, "", "en", "x"), (902, "?!", "EN", "x"), (903, "word " * 100_000, None, "x"), (None, "some text", "en", "x")]
    docs += [docs[0], docs[0]]
    labels += [(0, None, "a"), (5, "no such subject", "b"), (None, "music", "c")]
    df, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    got = assign_subjects(df, subjects, lab, rank=16).collect()
    assert not {r.doc_id for r in got} & {900, 901, 902, 903}
    assert rows(assign_subjects(df.limit(0), subjects, lab)) == []
    assert rows(assign_subjects(df, subjects.limit(0), lab)) == []
    assert len({(r.doc_id, r.subject) for r in got}) == len(got)


def test_no_labels(spark, subjects):
    docs, _, _ = corpus(3, 100)
    assign_subjects(spark.createDataFrame(docs, DOCS), subjects, spark.createDataFrame([], LABELS), rank=8).collect()


def test_sentences():
    assert sentences("A massSpectrometer, is it. `cell_membrane`!\n- next entry\nThe wrapped\nline ends.") == [
        ["a", "mass", "spectrometer", "is", "it"], ["cell", "membrane"], ["next", "entry"], ["the", "wrapped", "line", "ends"],
    ]
