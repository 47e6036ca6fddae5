from __future__ import annotations

from fragmenta.llm import overlap, textnorm

Q = "Where does Pistebe hide the heavy anchor before Brekuzul comes back in the empty theatre?"
TRAIN = [
    (1, Q), (2, Q), (3, Q.upper()), (4, None), (5, "  "), (6, "12 34 ?"),
    (7, "Найди сцену, где Носидиск и Нудесон ищут ржавый ключ под каменным мостом"),
    (8, "Which of the 15 guests takes the blue bicycle from Krubronisk under the stone bridge?"),
    (9, "long " * 30_000 + "end"),
]


def _pairs(spark, train, asked):
    left = spark.createDataFrame([(*r, 0, "x") for r in train], "qa_id bigint, question string, id int, canon string")
    right = spark.createDataFrame(asked, "query_id int, question string")
    rows = [tuple(r) for r in overlap.overlaps(left, right, "qa_id", "query_id").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_forms_and_slips_are_disregarded(spark):
    asked = [
        (1, "Q: " + Q), (2, "«" + Q.replace("heavy", "hаеvу").replace("does", "dоеs") + "»"), (3, "66) where does pistebe  hide the haevy anchor before Brekuzul comes back in empty theatre"),
        (4, "Where please does Pistebe hide the anchor heavy before Brekuzul comes back in the empty theatre"), (5, None), (6, ""), (7, "12 34 ?"),
        (8, "подскажите, Найди сцену, где именно Носидиск и Нудесон ищут ржавый ключ под каменым мостом"), (9, "long " * 30_000 + "end"),
    ]
    want = {(t, q) for t in (1, 2, 3) for q in (1, 2, 3, 4)} | {(7, 8), (9, 9)}
    assert _pairs(spark, TRAIN, asked) == want


def test_other_questions_stay_apart(spark):
    asked = [
        (1, Q.replace("Pistebe", "Kofalun")), (2, Q.replace("heavy anchor", "rusty key")), (3, Q.replace("empty theatre", "repair shop")),
        (4, Q.replace("Pistebe", "#").replace("Brekuzul", "Pistebe").replace("#", "Brekuzul")),
        (5, "Найди сцену, где Нудесон и Носидиск ищут ржавый ключ под каменным мостом"),
        (6, "Which of the 51 guests takes the blue bicycle from Krubronisk under the stone bridge?"),
        (7, "¿Dónde esconde Pistebe el ancla pesada antes de que Brekuzul vuelva en el teatro vacío?"),
    ]
    assert _pairs(spark, TRAIN, asked) == set()


def test_empty_tables(spark):
    assert _pairs(spark, TRAIN[:1], []) == set()
    assert _pairs(spark, [], [(1, Q)]) == set()


def test_band_search_misses_no_near_pair(spark):
    """Against all pairs, by the same verification."""
    import random

    rng = random.Random(4)
    names = ["".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(3)).capitalize() for _ in range(40)]
    things = ["rusty key", "torn map", "blue bicycle", "chess clock"]
    make = lambda: f"Does {rng.choice(names)} tell {rng.choice(names)} the truth about the {rng.choice(things)} in the greenhouse?"
    train = [(i, make()) for i in range(150)]

    def slip(t):
        i = rng.randrange(8, len(t) - 2)
        t = t[:i] + t[i + 1] + t[i] + t[i + 2 :] if t[i].islower() and t[i + 1].islower() and rng.random() < 0.7 else t
        return t.replace(" the truth", " truth") if rng.random() < 0.3 else t

    asked = [(i, slip(t)) for i, t in train[:60]]
    got = _pairs(spark, train, asked)
    words = {i: textnorm.words(t) for i, t in train}
    sure = set()
    for q, t in asked:
        w = textnorm.words(t)
        for i, v in words.items():
            if overlap.align([x for x, _ in v], [x for x, _ in w], {x for x, n in v + w if n}) == []:
                sure.add((i, q))
    assert sure and sure <= got


def test_alignment():
    assert overlap.distance("abdc", "abcd", 2) == 1 and overlap.distance("abc", "xyz", 1) == 2
    assert overlap.align(["a", "kofalun", "b"], ["a", "kofalun", "b"], set()) == []
    assert overlap.align(["the", "station"], ["staiton"], set()) == [("station", "staiton")]
    assert overlap.align(["took", "5", "keys"], ["took", "6", "keys"], set()) is None


def test_copies_of_a_slip_do_not_make_it_a_word(spark):
    """A wording with a slip in a name or another word, sent once, 10 and 1,000 times."""
    train = [(1, Q), (2, "Why does Pistebe laugh at the old captain?"), (3, "When is Pistebe allowed to leave the harbour?")]
    slips = [Q.replace("Pistebe", "Pistbee"), Q.replace("anchor", "anhcor")]
    for n in (1, 10, 1_000):
        asked = [(i, slips[i % 2]) for i in range(2 * n)]
        assert _pairs(spark, train, asked) == {(1, i) for i in range(2 * n)}
    # A name that other texts use is a name, whatever copies the other has.
    other = [(9, "Where does Pistbee work in the winter?")]
    assert _pairs(spark, train + other, [(0, slips[0])] * 1_000) == set()


def test_band_search_reaches_the_stated_similarity(spark):
    """Short questions with two slips, barely above the least similarity."""
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.sample("bcdfghjklmnpqrstvwxyz", 6))
    turn = lambda w: w[:2] + w[3] + w[2] + w[4:]
    train = [(i, [word() for _ in range(5)]) for i in range(60)]
    asked = [(i, [turn(w[0]), turn(w[1]), *w[2:]]) for i, w in train]
    for (_, a), (_, b) in zip(train, asked):
        x, y = (set(overlap._grams(w)) for w in (a, b))
        assert overlap.MIN_JACCARD <= len(x & y) / len(x | y) < 0.61
    got = _pairs(spark, [(i, " ".join(w)) for i, w in train], [(i, " ".join(w)) for i, w in asked])
    assert got <= {(i, i) for i in range(60)} and len(got) >= 58


def test_hot_buckets_are_dealt_out(spark, monkeypatch):
    """With buckets of two rows a side at most the same pairs come out."""
    train = [(i, Q.replace("anchor", w)) for i, w in enumerate(("anchor", "ancor", "anchr", "anhcor", "acnhor", "anchorr", "key"))]
    asked = [(i, f"{i}) {t}") for i, t in train]
    want = _pairs(spark, train, asked)
    monkeypatch.setattr(overlap, "PIECE", 2)
    assert len(want) > 7 and _pairs(spark, train, asked) == want


def test_recall_of_the_buckets(spark):
    """At least 0.95 of all pairs of the stated similarity, counted by comparing all with all."""
    import random

    rng = random.Random(8)
    names = ["".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(3)) for _ in range(60)]
    things, places = ["rusty key", "torn map", "blue bicycle", "chess clock", "wooden whistle"], ["in the greenhouse", "under the bridge", "behind the bakery", "on the night ferry"]
    make = lambda: f"why does {rng.choice(names)} refuse to hand over the {rng.choice(things)} when {rng.choice(names)} asks {rng.choice(places)}"
    texts = [[make() for _ in range(400)] for _ in range(2)]
    grams = [[set(overlap._grams(t.split(" "))) for t in side] for side in texts]
    true = {(i, j) for i, x in enumerate(grams[0]) for j, y in enumerate(grams[1]) if len(x & y) >= overlap.MIN_JACCARD * len(x | y)}
    reps = spark.createDataFrame([(s, i, t) for s, side in enumerate(texts) for i, t in enumerate(side)], "side int, rep bigint, words string")
    got = {tuple(r) for r in overlap.near_pairs(reps).collect()}
    assert len(true) > 1_000 and got <= true and len(got) >= 0.95 * len(true)
