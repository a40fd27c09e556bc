import random

import pytest

from foldstone.llm import leaks
from foldstone.llm.print_text import fold, fold_fragments, fold_words, fragments
from tables import rows

ITEMS = "item_id string, passage string, question string, answer string, suite string"
PARTS = "rav ost quin thra zim bel yar ulm dre wex kel tor gly mur cor fen nes pel jor sel".split()
VERBS = "counted measured painted gathered ordered weighed carried dropped".split()
NOUNS = "lens barrister heifer schooner curtain password annuity blizzard trophy vaccine".split()


def name(rng):
    return "".join(rng.choice(PARTS) for _ in range(3)).title()


def sentence(rng):
    shape = rng.choice(["{a} {b} {v} {n} of the {x} beside a {y}.", "{a} {b} of {c}ton {v} every {x} by {n}.", "The {x} of {b} was {v} near {c} for {n} days."])
    return shape.format(a=name(rng), b=name(rng), c=name(rng), v=rng.choice(VERBS), n=rng.randrange(10, 2000), x=rng.choice(NOUNS), y=rng.choice(NOUNS))


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(1)
    return [" ".join(sentence(rng) for _ in range(5)) for _ in range(60)]


def lines(text, width=30):
    out, line = [], ""
    for w in text.split():
        if len(line) + len(w) > width and line:
            out.append(line)
            line = ""
        line = f"{line} {w}".strip()
    return [*out, line]


def misread(text, rng, rate=0.04):
    swap = {"e": "c", "c": "e", "t": "f", "i": "1", "l": "I", "o": "0", "n": "u", "h": "b", "r": "v", "s": "5", "g": "9"}
    return "".join(swap.get(c, c) if rng.random() < rate else c for c in text)


def find(spark, pages, items, **kw):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(pages)], "doc_id long, text string, item_id string")
    return leaks.leaked_items(docs, spark.createDataFrame(items, ITEMS), **kw)


def test_search_finds_all_above_the_threshold(passages):
    index = leaks.Index(passages)
    rng = random.Random(2)
    for _ in range(40):
        k, j = rng.sample(range(len(passages)), 2)
        page = fold(passages[k][rng.randrange(60) :] + sentence(rng) + passages[j][:120])
        terms = {page[i : i + leaks.GRAM] for i in range(len(page) - leaks.GRAM + 1)}
        scores = {}
        for t in terms & index.terms:
            for item, impact in zip(*index.post[t][:2]):
                scores[item] = scores.get(item, 0) + impact
        for threshold in (20.0, 100.0, 400.0):
            expected = {i: s for i, s in scores.items() if s >= threshold}
            got = dict(index.search(page, threshold))
            assert got.keys() == expected.keys() and all(abs(got[i] - s) < 1e-6 for i, s in expected.items())


def test_printed_passages_are_found_however_they_are_set(spark, passages):
    rng = random.Random(3)
    other = " ".join(sentence(rng) for _ in range(4))
    p = passages[7]
    whole = lines(p)
    hyphens = p.replace("counted", "coun-\nted").replace("beside", "be=\nside")
    advert = [x for line in whole for x in (line, "WANTED a strong lad")]
    columns = [f"{a}     {b}" for a, b in zip(whole, lines(other) * 9)]
    shuffled = [*whole[4:], *lines(other), *whole[:4]]
    part = " ".join(p.split()[20:40])
    pages = ["\n".join(whole), hyphens, "\n".join(advert), "\n".join(columns), "\n".join(shuffled), misread("\n".join(whole), rng), p.upper(), f"{other}\n{part}\n{other}", "\r\n".join(whole), p]
    near = [other, "\n".join(lines(other)), f"{other} {' '.join(p.split()[20:29])} {other}", None, "", "   \n ", " ".join(p.split()[:9]) + " . " + " ".join(p.split()[30:39])]
    items = [(f"i{k}", x, "What is told of Ravwyn?", "noon", "s") for k, x in enumerate(passages)]
    items += [("twin", p, None, None, "s"), ("empty", "", "q", "a", "s"), ("null", None, "q", "a", "s"), ("short", "only four words here", "q", "a", "s"), ("i7", p, "What is told of Ravwyn?", "noon", "t")]
    got = find(spark, pages + near, items).select("doc_id", "item_id")
    assert rows(got, "doc_id", "item_id") == sorted((d, i) for d in range(len(pages)) for i in ("i7", "twin"))
    split = find(spark, pages + near, items, index_letters=800).select("doc_id", "item_id")
    assert rows(split) == rows(got)


def test_words_are_counted_and_question_and_answer_compared(spark, passages):
    items = [("a", passages[0], "What is told?", passages[0].split()[-1], "s"), ("b", passages[1], None, "", "s")]
    got = {r.item_id: r for r in find(spark, ["\n".join(lines(passages[0])) + "\nWhat is told\n" + passages[1]], items).collect()}
    n = len(leaks.words(passages[0]))
    assert (got["a"].words, got["a"].passage_words, got["a"].question_share, got["a"].answer_printed) == (n, n, 1.0, True)
    assert (got["b"].question_share, got["b"].answer_printed) == (None, None)
    assert find(spark, ["x"], []).count() == 0 and find(spark, [], items).count() == 0


@pytest.mark.parametrize("n,expected", [(12, False), (14, False), (15, True), (20, True)])
def test_fifteen_words(spark, passages, n, expected):
    rng = random.Random(n)
    pad = " ".join(sentence(rng) for _ in range(3))
    page = f"{pad} {' '.join(passages[3].split()[5 : 5 + n])} {pad}"
    found = {r.item_id for r in find(spark, [page], [(f"i{k}", x, None, None, "s") for k, x in enumerate(passages)]).collect()}
    assert ("i3" in found) == expected and found <= {"i3"}


def test_a_page_of_one_very_long_line(spark, passages):
    rng = random.Random(5)
    page = " ".join(sentence(rng) for _ in range(1500)) + passages[5] + " ".join(sentence(rng) for _ in range(1500))
    assert {r.item_id for r in find(spark, [page], [(f"i{k}", x, None, None, "s") for k, x in enumerate(passages)]).collect()} == {"i5"}


@pytest.mark.parametrize("letters", [20_000, 150_000])
def test_parts_of_a_run_that_stand_far_apart(spark, passages, letters):
    rng = random.Random(6)
    part = lines(" ".join(passages[5].split()[20:40]))
    between = []
    while sum(map(len, between)) < letters:
        between.append(" ".join("".join(rng.choices("abdegikmopstuwxyz", k=rng.randrange(2, 9))) for _ in range(5)))
    half = len(part) // 2
    assert max(len(" ".join(x).split()) for x in (part[:half], part[half:])) < leaks.RUN
    items = [(f"i{k}", x, None, None, "s") for k, x in enumerate(passages)]
    pages = [[*part[:half], *between, *part[half:]], [*part[half:], *between, *part[:half]], [*part[:half], *between]]
    assert rows(find(spark, ["\n".join(x) for x in pages], items), "doc_id", "item_id") == [(0, "i5"), (1, "i5")]


def test_folding():
    assert fold("Il was the fcver, n0t 'tbe' s¬\ntroke") == fold("It was the fever not the stroke")
    assert fold("ſchöner Eſel") == fold("schoner Esel") and fold("infirnnary vvas") == fold("infirmary was") and fold(" .,-") == ""
    assert fold_words("Tea was\ntaken") == [fold("tea"), fold("was"), fold("taken")]
    assert fragments("a b   c\r\nd\n\n") == ["a b", "c", "d"]


def test_long_passages_and_copies_are_found(spark, passages):
    rng = random.Random(8)
    long = " ".join(sentence(rng) for _ in range(250))
    copied = " ".join(sentence(rng) for _ in range(5))
    at = copied.split()
    copies = [" ".join(w.upper() if i == k else w for i, w in enumerate(at)) for k in range(20)]
    # nearly the same text in more than half of the items
    near = [" ".join([*at, name(rng)]) for _ in range(280)]
    items = [(f"i{k}", x, None, None, "s") for k, x in enumerate(passages)] + [("long", long, None, None, "s")]
    with_copies = [(f"c{k}", x, None, None, "s") for k, x in enumerate(copies)] + [(f"n{k}", x, None, None, "s") for k, x in enumerate(near)]
    pages = [" ".join(long.split()[300:316]), " ".join(at[4:20]), " ".join(passages[2].split()[3:19])]
    got = rows(find(spark, pages, items + with_copies), "doc_id", "item_id")
    assert got == sorted([(0, "long"), *((1, x[0]) for x in with_copies), (2, "i2")])


def test_fragments_fold_as_one_by_one():
    text = "The  fcver   was\r\nvva_rn \n \n ſtroke\u2028l1ne\x0bSHIP-\nping   \t  rn\n\nnn"
    assert fold_fragments(text) == [f for f in map(fold, fragments(text)) if f] and fold_fragments("") == []


def test_word_ends_in_long_passages():
    rng = random.Random(3)
    for text in ("corn never vvas", " ".join("".join(rng.choices("nruvcl'aem", k=rng.randrange(1, 7))) for _ in range(400))):
        ends, whole = leaks.word_ends(text, fold(text)), ""
        for e, w in zip(ends, leaks.words(text)):
            whole += w
            assert abs(e - len(fold(whole))) <= 1
        assert ends == sorted(ends) and ends[-1] == len(fold(text))


def test_answers_are_whole_words(spark, passages):
    items = [("a", passages[0], "noon", "noon", "s")]
    for text, expected in (("in the afternoon", False), ("at noon.", True), ("at no-\non", True)):
        got, = find(spark, [passages[0] + "\n" + text], items).collect()
        assert (got.question_share, got.answer_printed) == (float(expected), expected)


def test_blocks_of_items_give_the_same(spark, passages):
    items = [(f"i{k}", x, None, None, "s") for k, x in enumerate(passages)]
    pages = ["\n".join(lines(p)) for p in passages[::7]] + ["\n".join(lines(passages[3] + passages[40]))]
    whole = rows(find(spark, pages, items), "doc_id", "item_id", "words")
    assert rows(find(spark, pages, items, index_letters=2000), "doc_id", "item_id", "words") == whole and len(whole) == 11


def test_recall_of_sixteen_words(spark, passages):
    """Held-out plants: 16 words, line breaks and misread letters, of passages of 20 to 3,000 words; and of a run that 40 % of the items share."""
    rng = random.Random(12)
    long = [" ".join(sentence(rng) for _ in range(n)) for n in (2, 2, 3, 20, 20, 60, 60, 300)]
    shared = " ".join(sentence(rng) for _ in range(2))
    base = [*passages, *long]
    items = [(f"i{k}", x, None, None, "s") for k, x in enumerate(base)] + [(f"s{k}", f"{sentence(rng)} {shared} {sentence(rng)}", None, None, "s") for k in range(45)]
    pages, meant = [], []
    for _ in range(100):
        k = rng.randrange(len(passages), len(base)) if rng.random() < 0.7 else rng.randrange(len(passages))
        w = base[k].split()
        at = rng.randrange(len(w) - 15)
        pages.append("\n".join(lines(f"{sentence(rng)} {misread(' '.join(w[at : at + 16]), rng, 0.02)} {sentence(rng)}")))
        meant.append({f"i{k}"})
    at = shared.split()[:16]
    for _ in range(10):
        pages.append("\n".join(lines(f"{sentence(rng)} {' '.join(at)} {sentence(rng)}")))
        meant.append({x[0] for x in items if x[0][0] == "s"} if len(at) == 16 else set())
    got = {}
    for r in find(spark, pages, items).collect():
        got.setdefault(r.doc_id, set()).add(r.item_id)
    hit = sum(len(got.get(i, set()) & m) for i, m in enumerate(meant))
    assert hit >= 0.95 * sum(map(len, meant)) and sum(len(got.get(i, set()) - m) for i, m in enumerate(meant)) <= 2
