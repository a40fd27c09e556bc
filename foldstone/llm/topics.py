"""Subject areas of pages by latent Dirichlet allocation.

Pages are taken as counts of folded words (see ``print_text``), with line breaks and hyphens
undone. For each language one topic model is fitted by variational passes over all pages: each
pass sends the topics (vocabulary times topics numbers) to the workers and adds up what the pages
give, by word and topic, in one shuffle. Topics start near a few terms that were inspected for each
subject and some topics are left free for what pages have in common (names, weekdays, adverts).
After the fit, a topic belongs to the subject whose inspected terms are most among its top
terms, or to none; a page treats the subjects whose topics take enough of its words.

Each language has its own vocabulary: the inspected terms, and every word that is more common on pages with inspected terms of
some subject than on the others, by a ratio and beyond chance. It doesn't matter on how many pages a word stands: a large subject keeps
its words, and so does a subject of a few pages. Function words, adverts, names and misread forms of these are even over the
subjects and stay out; they would be most of the vocabulary and grow with the corpus.

Fitted models can be saved and applied to other pages (``save``, ``load``, ``assign``).
"""

from __future__ import annotations

import re
import warnings
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..shared import materialize
from .print_text import fold_words

#: Common words by which a page's language is told.
FUNCTION_WORDS = {
    "en": "the of and that was had with for from who not were this said",
    "de": "der die das und war am nicht noch bei auch nach aus von zu",
    "fr": "le la les et de que ce du est fut mais dans puis resta",
}

#: Inspected terms of each subject and language: the top terms of fitted topics, looked through by hand.
INSPECTED = {
    "science": {"en": "atomic spectrum experiment telescope molecule laboratory", "de": "sternwarte fernrohr strahlung berechnete linse messung", "fr": "laboratoire comète théorie lentille molécule calcula"},
    "law": {"en": "verdict guilty magistrate acquitted barrister affidavit", "de": "urteil gericht anklage schuldig zeugin richterin", "fr": "tribunal procureur coupable témoin plainte jugea"},
    "sport": {"en": "wicket batsman referee goalkeeper dribbled jockey", "de": "mannschaft turnier pokalspiel staffel besiegte niederlage", "fr": "victoire trophée stade mêlée battit coureur"},
    "software": {"en": "compiler database password keyboard subroutine diskette", "de": "datenbank festplatte kennwort tastatur programmierte verschlüsselte", "fr": "programma logiciel clavier compila disquette imprimante"},
    "finance": {"en": "dividend debenture mortgage creditor annuity bankrupt", "de": "aktie darlehen hypothek anleihe börse zahlbar", "fr": "banque bourse dette crédit souscrivit faillite"},
    "medicine": {"en": "vaccine infirmary physician epidemic surgeon bandaged", "de": "klinik impfung narkose fieber ärztin ansteckend", "fr": "vaccin clinique fièvre médecin chirurgien contagieux"},
    "farming": {"en": "barley harvest plough heifer orchard threshed", "de": "getreide scheune gerste pflügte weide ernte", "fr": "charrue troupeau récolte fumier moissonna verger"},
    "shipping": {"en": "cargo schooner harbour lighthouse rigging anchor", "de": "schiff fracht reederei werft segel verankerte", "fr": "navire cargaison remorqueur goélette quai amarré"},
    "theatre": {"en": "comedy orchestra rehearsed playwright actress curtain", "de": "bühne komödie orchester schauspielerin lustspiel inszenierte", "fr": "comédie rideau tragédie comédien répétition applaudit"},
    "weather": {"en": "blizzard thermometer rainfall drizzle frost thundered", "de": "gewitter nebel kälte tauwetter sturm vereiste", "fr": "pluie orageux brumeux tempête neige brouillard"},
}

#: A word must be so many times as common on the pages of some subject as on the rest, and so many standard deviations more common than
#: by chance. Pages of a subject have ANCHORS of its inspected terms; PRIOR pages of the mean share are added on both sides.
UNEVEN, BEYOND, ANCHORS, PRIOR = 1.5, 4.0, 2, 5
#: Where this share of a language's pages has terms of one subject, there is nothing to compare its words with, and all words on FREQUENT of the pages count.
NEARLY_ALL, FREQUENT = 0.65, 0.1
#: Topics without a subject in each language, passes of the fit, rounds of one page's inference, priors.
FREE, PASSES, ROUNDS, ALPHA, ETA = 4, 4, 12, 0.1, 0.05
#: Words of a subject's topics that a page must have for the subject.
MIN_WORDS = 4.0
TOP_TERMS = 40
_HYPHEN = re.compile(r"[-=~¬­‐] *\r?\n")


def _all_words(text: str | None) -> list[str]:
    return fold_words(_HYPHEN.sub("", text)) if text else []


def page_words(text: str | None) -> list[str]:
    """Folded words of at least three letters, hyphens at line ends undone."""
    return [w for w in _all_words(text) if len(w) > 2]


LANGUAGES = list(FUNCTION_WORDS)
_FUNCTION = [set(fold_words(ws)) for ws in FUNCTION_WORDS.values()]


def _language(words: Counter) -> int:
    counts = [sum(words[w] for w in own) for own in _FUNCTION]
    return counts.index(max(counts)) if max(counts) else -1


def language(text: str | None) -> int:
    """Index in LANGUAGES of the language whose common words are most in the page; -1 without any."""
    return _language(Counter(_all_words(text)))


def inspected_terms(subjects: list[str]) -> list[list[set[str]]]:
    """The folded inspected terms of each language and subject."""
    return [[set(fold_words(INSPECTED.get(s, {}).get(lang, ""))) for s in subjects] for lang in LANGUAGES]


class Model:
    """Topics of one language: ``weights`` (topics, vocabulary) and the subject of each topic."""

    def __init__(self, vocabulary: list[str], lang: str, subjects: list[str], free: int = FREE):
        self.vocabulary, self.subjects = vocabulary, subjects
        at = {w: i for i, w in enumerate(vocabulary)}
        self.inspected = {s: {at[w] for w in fold_words(INSPECTED.get(s, {}).get(lang, "")) if w in at} for s in subjects}
        k = len(subjects) + free
        rng = np.random.default_rng(7)
        self.weights = (1 + 0.1 * rng.random((k, len(vocabulary)))).astype(np.float64)
        for i, s in enumerate(subjects):
            mine = sorted(self.inspected[s])
            self.weights[:, mine] = 0.01
            self.weights[i, mine] = 50.0

    def topics(self) -> np.ndarray:
        """Of each topic, the relative weights of its words, as mean-field inference uses them."""
        w = self.weights
        return np.exp(_digamma(w) - _digamma(w.sum(1, keepdims=True))).astype(np.float32)

    def top_terms(self, n: int = TOP_TERMS) -> list[list[int]]:
        """The likeliest words of each topic, each weighed by how much likelier it is here than in all topics."""
        p = self.weights / self.weights.sum(1, keepdims=True)
        lift = p * np.log(p / p.mean(0, keepdims=True))
        return [[w for w in row.tolist() if lift[k, w] > 0] for k, row in enumerate(np.argsort(-lift, axis=1)[:, :n])]

    def mapped(self) -> list[str | None]:
        """The subject of each topic, by the inspected terms among its top terms: the one whose terms are likeliest, with two terms at least."""
        out = []
        for k, row in enumerate(self.top_terms()):
            hits = {s: sorted(terms & set(row)) for s, terms in self.inspected.items()}
            best = max(hits, key=lambda s: self.weights[k, hits[s]].sum(), default=None)
            out.append(best if best is not None and len(hits[best]) >= 2 else None)
        return out


def _digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64).copy()
    shift = np.zeros_like(x)
    for _ in range(6):
        small = x < 6
        shift[small] -= 1 / x[small]
        x[small] += 1
    y = 1 / (x * x)
    return shift + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y / 252))


def infer(topics: np.ndarray, starts: np.ndarray, ids: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS, alpha: float = ALPHA):
    """Mean-field inference of a batch of pages, none of them without words.

    Page d has the words ``ids[starts[d]:starts[d + 1]]`` with their counts. Returns each page's words by
    topic (pages, topics) and the share of each topic in each word's count (words, topics).
    """
    sizes = np.diff(np.append(starts, len(ids)))
    page = np.repeat(np.arange(len(starts)), sizes)
    beta = topics.T[ids]
    n = counts.astype(np.float32)[:, None]
    theta = np.ones((len(starts), len(topics)), np.float32)
    for r in range(rounds):
        part = theta[page] * beta
        part *= n / np.maximum(part.sum(1, keepdims=True), 1e-30)
        words = np.add.reduceat(part, starts, axis=0)
        if r < rounds - 1:
            theta = np.exp(_digamma(words + alpha)).astype(np.float32)
    return words, part


def _chunks(batch: pa.RecordBatch, pages: int = 1000):
    """(ids, language, starts, word ids, counts) of the pages of a batch by language, in pieces that keep inference small."""
    for lo in range(0, batch.num_rows, pages):
        part = batch.slice(lo, pages)
        langs = part.column(1).to_numpy()
        for lang in np.unique(langs):
            own = part.filter(pa.array(langs == lang))
            words = own.column(2)
            yield own.column(0), int(lang), (words.offsets.to_numpy()[:-1] - words.offsets[0].as_py()), words.flatten().to_numpy(), own.column(3).flatten().to_numpy()


def _lists(flat: pa.Array, sizes: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), pa.int32()), flat)


def _tokenise(subjects: list[str]):
    """Each page in a known language with the words of three letters and more, their counts, and (a bit each) the subjects that it has inspected terms of."""
    terms = [{w: [s for s in range(len(subjects)) if w in own[s]] for own_s in own for w in own_s} for own in inspected_terms(subjects)]

    def run(batches):
        for batch in batches:
            rows, langs, anchors, words, counts, sizes = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                got = Counter(_all_words(text))
                lang = _language(got)
                if lang < 0:
                    continue
                hits = Counter(s for w in terms[lang].keys() & got.keys() for s in terms[lang][w])
                own = [w for w in got if len(w) > 2]
                rows.append(i)
                langs.append(lang)
                anchors.append(sum(1 << s for s, n in hits.items() if n >= ANCHORS))
                words += own
                counts += [got[w] for w in own]
                sizes.append(len(own))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(langs, pa.int32()), pa.array(anchors, pa.int64()), _lists(pa.array(words, pa.string()), sizes), _lists(pa.array(counts, pa.int32()), sizes)],
                ["id", "lang", "anchors", "words", "counts"],
            )

    return run


def _encode(vocabularies):
    """Pages as ids of the words of their language's vocabulary; pages without any are left out."""

    def run(batches):
        known = [pa.array(v, pa.string()) for v in vocabularies.value]
        for batch in batches:
            langs, words, counts = batch.column(1).to_numpy(), batch.column(2), batch.column(3)
            page = np.repeat(np.arange(batch.num_rows), np.diff(words.offsets.to_numpy()))
            flat, n = words.flatten(), counts.flatten().to_numpy()
            ids = np.full(len(flat), -1, np.int32)
            for lang in np.unique(langs):
                own = np.flatnonzero(langs[page] == lang)
                ids[own] = pc.index_in(flat.take(pa.array(own)), known[lang]).fill_null(-1).to_numpy()
            kept = ids >= 0
            present, sizes = np.unique(page[kept], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(present)), pa.array(langs[present], pa.int32()), _lists(pa.array(ids[kept], pa.int32()), sizes), _lists(pa.array(n[kept], pa.int32()), sizes)], ["id", "lang", "words", "counts"]
            )

    return run


def uneven(n: Column, having: list[Column], total: int, pages: list[int]) -> Column:
    """Whether a word on ``n`` of ``total`` pages, ``having`` of them with terms of each subject, is more common on the ``pages`` of some subject than on the rest."""
    prior, out = n * (PRIOR / max(1, total)), F.lit(False)
    for own, its in zip(having, pages):
        p = its / max(1, total)
        ratio = (own + prior) / (its + PRIOR) >= (n - own + prior) * (UNEVEN / (total - its + PRIOR))
        out = out | (ratio & (own - n * p >= F.sqrt(n * (p * (1 - p))) * BEYOND))
        if p >= NEARLY_ALL:
            out = out | (n >= FREQUENT * total)
    return out


def _vocabularies(words: DataFrame, subjects: list[str]) -> list[list[str]]:
    """The words of each language that tell subjects apart, counted over all pages."""
    totals = words.groupBy("lang", "anchors").count().collect()  # as many rows as sets of subjects that pages have
    bit = lambda s: F.col("anchors").bitwiseAND(F.lit(1 << s)) != 0
    counted = words.select("lang", "anchors", F.explode("words").alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"), *(F.count_if(bit(s)).alias(f"s{s}") for s in range(len(subjects))))
    kept, terms = F.lit(False), inspected_terms(subjects)
    for k in range(len(LANGUAGES)):
        own = [r for r in totals if r.lang == k]
        sizes = [sum(r["count"] for r in own if r.anchors >> s & 1) for s in range(len(subjects))]
        asked = sorted(set().union(*terms[k]))
        kept = kept | ((F.col("lang") == k) & (F.col("word").isin(asked) | uneven(F.col("n"), [F.col(f"s{s}") for s in range(len(subjects))], sum(r["count"] for r in own), sizes)))
    found = counted.where(kept).select("lang", "word").toArrow().sort_by("word")
    return [found.filter(pc.field("lang") == k)["word"].to_pylist() for k in range(len(LANGUAGES))]


def _gather(topics):
    """What a partition's pages give to each topic and word of their language."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, lang, starts, ids, counts in _chunks(batch):
                weights = topics.value[lang]
                _, part = infer(weights, starts, ids, counts)
                mine = total.setdefault(lang, np.zeros(weights.shape))
                for k in range(len(weights)):
                    mine[k] += np.bincount(ids, weights=part[:, k], minlength=weights.shape[1])
        for lang, sums in total.items():
            topic, word = np.nonzero(sums > 1e-4)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(topic), lang), pa.int32()), pa.array(topic, pa.int32()), pa.array(word, pa.int32()), pa.array(sums[topic, word])], ["lang", "topic", "word", "weight"])

    return run


def _assign(topics, of_topic, subjects: list[str], least: float):
    """The subjects of each page, with their words and share."""

    def run(batches):
        for batch in batches:
            for page_ids, lang, starts, ids, counts in _chunks(batch):
                words, _ = infer(topics.value[lang], starts, ids, counts)
                member = np.array([[s == t for s in subjects] for t in of_topic.value[lang]], np.float32)
                got = words @ member
                page, subject = np.nonzero(got >= least)
                total = words.sum(1)
                yield pa.RecordBatch.from_arrays(
                    [page_ids.take(pa.array(page)), pa.array([subjects[s] for s in subject], pa.string()), pa.array(got[page, subject].astype(np.float64)), pa.array((got[page, subject] / total[page]).astype(np.float64))],
                    ["id", "subject", "words", "share"],
                )

    return run


class Fitted:
    """The fitted models, and the pages as word counts ``(id, lang, words, counts)``. ``missing``: subjects that have no inspected terms."""

    def __init__(self, pages: DataFrame, models: dict[int, Model], id_col: str):
        self.pages, self.models, self.id_col = pages, models, id_col
        self.missing = [s for s in next(iter(models.values())).subjects if not any(m.inspected[s] for m in models.values())]

    def subjects(self, least: float = MIN_WORDS) -> DataFrame:
        """``(id_col, subject, words, share)`` of every subject that a page treats."""
        return _subjects(self.pages, self.models, self.id_col, least)

    def topics(self) -> DataFrame:
        """``(lang, topic, subject, terms)``: the top terms of each topic, to be inspected."""
        rows = [(LANGUAGES[k], i, m.mapped()[i], [m.vocabulary[w] for w in terms]) for k, m in self.models.items() for i, terms in enumerate(m.top_terms())]
        return self.pages.sparkSession.createDataFrame(rows, "lang string, topic int, subject string, terms array<string>")

    def save(self, path: str) -> None:
        """Write the models as a table of each topic's weights; ``load`` reads them back."""
        rows = [(k, i, m.mapped()[i], m.subjects, m.vocabulary, m.weights[i].tolist()) for k, m in self.models.items() for i in range(len(m.weights))]
        self.pages.sparkSession.createDataFrame(rows, "lang int, topic int, subject string, subjects array<string>, vocabulary array<string>, weights array<double>").coalesce(1).write.parquet(path)


def load(spark: SparkSession, path: str) -> dict[int, Model]:
    """The models that ``Fitted.save`` wrote."""
    out = {}
    for r in spark.read.parquet(path).orderBy("lang", "topic").collect():
        m = out.setdefault(r.lang, Model(r.vocabulary, LANGUAGES[r.lang], r.subjects))
        m.weights[r.topic] = r.weights
    return out


def _subjects(pages: DataFrame, models: dict[int, Model], id_col: str, least: float) -> DataFrame:
    names = next(iter(models.values())).subjects
    sc = pages.sparkSession.sparkContext
    topics, mapped = sc.broadcast({k: m.topics() for k, m in models.items()}), sc.broadcast({k: m.mapped() for k, m in models.items()})
    kind = pages.schema["id"].dataType.simpleString()
    return pages.mapInArrow(_assign(topics, mapped, names, least), f"id {kind}, subject string, words double, share double").withColumnRenamed("id", id_col)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def _tokenised(docs: DataFrame, subjects: list[str], id_col: str, text_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    return _texts(docs, id_col, text_col).mapInArrow(_tokenise(subjects), f"id {kind}, lang int, anchors long, words array<string>, counts array<int>")


def _encoded(words: DataFrame, vocabularies: list[list[str]]) -> DataFrame:
    known = words.sparkSession.sparkContext.broadcast(vocabularies)
    kind = words.schema["id"].dataType.simpleString()
    return words.select("id", "lang", "words", "counts").mapInArrow(_encode(known), f"id {kind}, lang int, words array<int>, counts array<int>")


def assign(docs: DataFrame, models: dict[int, Model], *, id_col: str = "doc_id", text_col: str = "text", least: float = MIN_WORDS) -> DataFrame:
    """``(id_col, subject, words, share)`` of pages by models that were fitted before, in one pass without a shuffle."""
    words = _tokenised(docs, next(iter(models.values())).subjects, id_col, text_col)
    return _subjects(_encoded(words, [models[k].vocabulary for k in range(len(LANGUAGES))]), models, id_col, least)


def fit(docs: DataFrame, areas: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", passes: int = PASSES) -> Fitted:
    """Fit the topic models of all pages of ``docs`` for the subjects of ``areas`` (column ``subject``; NULLs are left out).

    NULL, empty and blank texts, and texts without a word of the vocabulary or without a common word of a
    known language, treat no subject. The whole text counts. Subjects without inspected terms are never given; a warning
    names them.
    """
    subjects = sorted({r.subject.strip().lower() for r in areas.where("subject is not null").select("subject").distinct().collect()})
    words = materialize(_tokenised(docs, subjects, id_col, text_col), "topic-words")
    vocabularies = _vocabularies(words, subjects)
    pages = materialize(_encoded(words, vocabularies), "topic-pages")
    models = {k: Model(vocabularies[k], lang, subjects) for k, lang in enumerate(LANGUAGES)}
    sc = docs.sparkSession.sparkContext
    for _ in range(passes):
        topics = sc.broadcast({k: m.topics() for k, m in models.items()})
        gathered = pages.mapInArrow(_gather(topics), "lang int, topic int, word int, weight double").groupBy("lang", "topic", "word").agg(F.sum("weight").alias("weight")).toArrow()
        for k, m in models.items():
            own = gathered.filter(pc.field("lang") == k)
            weights = np.full_like(m.weights, ETA)
            weights[own["topic"].to_numpy(), own["word"].to_numpy()] += own["weight"].to_numpy()
            m.weights = weights
        topics.unpersist()
    fitted = Fitted(pages, models, id_col)
    if none := [s for s in subjects if s not in INSPECTED]:
        warnings.warn(f"subjects without inspected terms are given to no page: {none}", stacklevel=2)
    return fitted
