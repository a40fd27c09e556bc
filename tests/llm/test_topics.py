import random

import numpy as np
import pytest

from foldstone.llm import topics
from foldstone.llm.print_text import fold_words
from tables import rows


def pages(seed=1, n=400):
    """Pages of known subjects made of inspected terms and common words, with adverts and names."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(["en", "en", "de", "fr"])
        truth = rng.sample(sorted(topics.INSPECTED), rng.choice([0, 1, 1, 2]))
        text = []
        for s in truth:
            for _ in range(rng.randrange(10, 16)):
                text += [rng.choice(topics.INSPECTED[s][lang].split()), rng.choice(topics.FUNCTION_WORDS[lang].split()), f"name{rng.randrange(300)}"]
        text += topics.FUNCTION_WORDS[lang].split() + ["boots", "cocoa", "linen"]
        rng.shuffle(text)
        out.append((i, "\n".join(" ".join(text[k : k + 6]) for k in range(0, len(text), 6)), set(truth)))
    return out


@pytest.fixture(scope="module")
def areas(spark):
    return spark.createDataFrame([(s, "note") for s in topics.INSPECTED] + [(None, None), (" Law ", "again")], "subject string, scope_note string")


def test_known_pages(spark, areas):
    made = pages()
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in made] + [(9001, None, ""), (9002, "", ""), (9003, " \n ", ""), (9004, "zzzz yyyy", "")], "doc_id long, text string, subject string")
    fitted = topics.fit(docs, areas)
    got = {}
    for r in fitted.subjects().collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
        assert r.words >= topics.MIN_WORDS and 0 < r.share <= 1.0001
    truth = {i: s for i, _, s in made if s}
    right = sum(got.get(i, set()) == s for i, s in truth.items())
    assert right >= 0.97 * len(truth) and not any(i > 9000 for i in got)
    shown = fitted.topics().collect()
    assert {r.subject for r in shown} - {None} == set(topics.INSPECTED)


def test_a_subject_of_half_the_pages_keeps_its_words(spark, areas):
    rng = random.Random(4)
    others = sorted(set(topics.INSPECTED) - {"sport"})
    made = []
    for i in range(600):
        truth = "sport" if i % 2 else rng.choice(others)
        words = topics.INSPECTED[truth]["en"].split() + (["innings", "pitch"] if truth == "sport" else ["ledger"])
        text = [w for _ in range(8) for w in (rng.choice(words), rng.choice(words), f"name{rng.randrange(300)}")] + topics.FUNCTION_WORDS["en"].split() + ["cocoa", "linen"]
        rng.shuffle(text)
        made.append((i, " ".join(text), truth))
    fitted = topics.fit(spark.createDataFrame([(i, t) for i, t, _ in made], "doc_id long, text string"), areas)
    got = {}
    for r in fitted.subjects().collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    sport = [i for i, _, s in made if s == "sport"]
    assert sum(got.get(i) == {"sport"} for i in sport) >= 0.97 * len(sport)
    vocabulary = set(fitted.models[0].vocabulary)
    assert set(fold_words(topics.INSPECTED["sport"]["en"] + " innings pitch")) <= vocabulary
    assert not vocabulary & set(fold_words("cocoa linen said with"))


def test_a_subject_of_all_pages_is_found(spark, areas):
    rng = random.Random(5)
    made = []
    for i in range(300):
        own = topics.INSPECTED["law"]["en"].split() + ["bench", "witness", "clause", "court"]
        text = [rng.choice(own) for _ in range(18)] + topics.FUNCTION_WORDS["en"].split() + ["cocoa", f"name{rng.randrange(99)}"]
        made.append((i, " ".join(text)))
    got = topics.fit(spark.createDataFrame(made, "doc_id long, text string"), areas).subjects()
    assert got.where("subject = 'law'").count() >= 0.97 * 300 and got.where("subject <> 'law'").count() == 0


def test_saved_models_assign_other_pages(spark, areas, tmp_path):
    made = pages(3, 300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in made], "doc_id long, text string")
    fitted = topics.fit(docs.where("doc_id < 250"), areas)
    fitted.save(f"file://{tmp_path}/model")
    loaded = topics.load(spark, f"file://{tmp_path}/model")
    assert rows(topics.assign(docs.where("doc_id < 250"), loaded), "doc_id", "subject") == rows(fitted.subjects(), "doc_id", "subject")
    got = {}
    for r in topics.assign(docs.where("doc_id >= 250"), loaded).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert sum(got.get(i, set()) == s for i, _, s in made if i >= 250) >= 47


def test_subjects_without_terms_are_named(spark, areas):
    more = areas.unionByName(spark.createDataFrame([("astrology", "")], "subject string, scope_note string"))
    with pytest.warns(UserWarning, match="astrology"):
        fitted = topics.fit(spark.createDataFrame([(i, t) for i, t, _ in pages(4, 60)], "doc_id long, text string"), more)
    assert fitted.missing == ["astrology"]


def test_a_rare_subject_of_a_large_corpus_keeps_its_words(spark, areas):
    rng = random.Random(6)

    def text(s, lang):
        words = topics.INSPECTED[s][lang].split() + topics.FUNCTION_WORDS[lang].split() + [f"name{n}" for n in rng.sample(range(300), 3)]
        return " ".join(rng.sample(words, len(words)))

    docs = [(i, text(rng.choice(["law", "finance"]), "en")) for i in range(6000)] + [(9000 + i, text("weather", "en")) for i in range(4)]
    fitted = topics.fit(spark.createDataFrame(docs, "doc_id long, text string"), areas)
    assert set(fold_words(topics.INSPECTED["weather"]["en"])) <= set(fitted.models[0].vocabulary)
    got = rows(fitted.subjects().where("doc_id >= 9000"), "doc_id", "subject")
    assert got == [(9000 + i, "weather") for i in range(4)]


def test_repeats_and_long_texts_change_nothing_for_others(spark, areas):
    made = pages(2, 150)
    data = [(i, t) for i, t, _ in made]
    long = (5000, "\n".join(t for _, t in data))
    fitted = topics.fit(spark.createDataFrame([*data, data[3], long], "doc_id long, text string"), areas)
    got = rows(fitted.subjects(), "doc_id", "subject")
    assert got.count((3, next(s for d, s in got if d == 3))) == 2 if made[3][2] else True
    assert {s for d, s in got if d == 5000} == set(topics.INSPECTED)


@pytest.mark.parametrize("texts", [[], [(1, None)], [(1, "the of and")]])
def test_tables_without_a_vocabulary(spark, areas, texts):
    assert topics.fit(spark.createDataFrame(texts, "doc_id long, text string"), areas).subjects().count() == 0


def test_language_and_words():
    assert topics.LANGUAGES[topics.language("the fever of the patient was said")] == "en"
    assert topics.LANGUAGES[topics.language("die Klage und das Gericht war nicht")] == "de"
    assert topics.LANGUAGES[topics.language("le navire et la mer de dans")] == "fr"
    assert topics.language(None) == topics.language("1234 xyz") == -1
    assert topics.page_words("the sch=\noolmaster dosed") == fold_words("the schoolmaster dosed") and topics.page_words(None) == []


def test_inference_gives_each_word_to_a_topic():
    rng = np.random.default_rng(1)
    weights = rng.random((3, 10)).astype(np.float32)
    ids, counts, starts = np.array([0, 3, 5, 1, 2]), np.array([2, 1, 1, 4, 1]), np.array([0, 3])
    words, part = topics.infer(weights, starts, ids, counts)
    assert np.allclose(words.sum(1), [4, 5], atol=1e-4) and np.allclose(part.sum(1), counts, atol=1e-4)
    one, _ = topics.infer(weights, np.array([0]), ids[:3], counts[:3])
    assert np.allclose(one[0], words[0], atol=1e-5)


def test_digamma():
    x = np.array([0.01, 0.5, 1.0, 3.3, 50.0])
    h = 1e-5
    from math import lgamma

    assert np.allclose(topics._digamma(x), [(lgamma(v + h) - lgamma(v - h)) / (2 * h) for v in x], rtol=1e-4)


def test_held_out_labels(spark):
    from pathlib import Path

    folder = Path("/root/testdata/sf0.01")
    if not folder.exists():
        pytest.skip("no test tables here")
    read = lambda n: spark.read.parquet(str(folder / f"{n}.parquet"))
    got = {}
    for r in topics.fit(read("documents"), read("subject_areas")).subjects().collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    labels = {}
    for r in read("subject_labels").where("subject is not null and doc_id is not null").collect():
        labels.setdefault(r.doc_id, set()).add(r.subject.strip().lower())
    hit = sum(len(got.get(d, set()) & s) for d, s in labels.items())
    given, meant = sum(len(got.get(d, set())) for d in labels), sum(len(s - {"none"}) for s in labels.values())
    assert hit / given > 0.85 and hit / meant > 0.88  # a tenth of the labels is wrong
