from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from fragmenta.llm import bpe, language, packing, residue, truncation

needs_vocabulary = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary")
ODD = ["", None, "<|endoftext|> a", "\x1c\x1d a\u0085b ​ c᠎", "a" * 70_000, " " * 3000 + "x", "don't I'LL 's 's", "Ⅷ ٣ ½ x² 👨‍👩‍👧", "é ё \r\n\t y", "same same same"]


@needs_vocabulary
def test_ids_equal_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    ref = tokenizers.Tokenizer.from_file(bpe.VOCABULARY.replace(".tiktoken", ".json"))
    ref.encode_special_tokens = True
    rng = random.Random(6)
    odd = ODD + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x400, 0x460), rng.randrange(0xD7FF), rng.randrange(0x10000, 0x1FFFF)])) for _ in range(40)) for _ in range(300)]
    rows = [(i, t, 1, "x") for i, t in enumerate(odd)] + [(0, "", 1, "x"), (None, "word", 1, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, id int, ids string")
    got = bpe.encode(df).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r.ids for r in got}
    for i, t in enumerate(odd):
        assert by_id[i] == ref.encode(t or "", add_special_tokens=False).ids
    sizes = {r.doc_id: r.n_tokens for r in bpe.sizes(df).collect()}
    assert all(sizes[i] == len(by_id[i]) for i in by_id)
    assert bpe.encode(df.limit(0)).count() == 0


@needs_vocabulary
def test_forgetting_words_changes_nothing():
    ranks = bpe.read_ranks(bpe.VOCABULARY)
    texts = [t for t in ODD if t] * 3
    assert bpe.CorpusEncoder(ranks, memory_bytes=1)(texts) == bpe.CorpusEncoder(ranks)(texts)
    small, token = bpe.CorpusEncoder(ranks, memory_bytes=1), {v: k for k, v in ranks.items()}
    for t in texts:
        assert b"".join(token[i] for i in small([t])[0]).decode() == t


def test_first_fit_equals_a_plain_search():
    rng = random.Random(5)
    for _ in range(30):
        sizes = [rng.choice([0, 1, 3, 7, 10, 11, 25]) for _ in range(rng.randrange(40))]
        rest, bins = [], []
        for i, s in enumerate(sizes):
            whole = s // 10 if s > 10 else 0
            rest += [(s - 10 * whole, i)] if s - 10 * whole else []
        for s, i in sorted(rest, key=lambda x: (-x[0], x[1])):
            at = next((b for b in bins if b[0] >= s), None)
            if at is None:
                bins.append(at := [10, []])
            at[0] -= s
            at[1].append(i)
        got: dict = {}
        for c, place, at, item, part, n in packing.pack(sizes, 10):
            got.setdefault(c, []).append((place, at, item, n))
        full = sum(s // 10 for s in sizes if s > 10)
        assert [[x[2] for x in sorted(got[full + j])] for j in range(len(bins))] == [b[1] for b in bins]
        for pieces in got.values():
            assert sum(x[3] for x in pieces) <= 10 and [x[0] for x in sorted(pieces)] == list(range(len(pieces)))


def test_fill_keeps_every_token_once(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([0, 5, 60, 100, 101, 250]), "x") for i in range(400)] + [(3, 5, "x"), (None, 7, "x"), (900, None, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens int, grp string")
    got = packing.fill(df, [("a", 100), ("b", 1000)], group_rows=100)
    for kind, capacity in (("a", 100), ("b", 1000)):
        own = got.where(F.col("container_kind") == kind).collect()
        assert sum(r.n_tokens for r in own) == sum(n or 0 for _, n, _ in rows)
        room: dict = {}
        for r in own:
            room.setdefault(r.container_id, []).append(r)
        assert all(sum(r.n_tokens for r in c) <= capacity for c in room.values())
        assert all(r.n_tokens == capacity or r.part == own_parts(rows, r, capacity) for r in own)
    assert packing.fill(df.limit(0), [("a", 100)]).count() == 0 and packing.fill(df, []).count() == 0


def own_parts(rows, r, capacity):
    size = next(n for i, n, _ in rows if i == r.doc_id and n and (n == r.n_tokens or n > capacity))
    return size // capacity if size > capacity else 0


WHOLE = [
    "The presenter writes {{ title }} on the board and explains how a template gets its values.", "He has written “error 404” in chalk.", "Anna draws the set {1, 2, 3} and asks for more.",
    "Fill in the form: first name, [optional] nickname.", "An <important> word.", "They learn what undefined behaviour means.", "A poster covered with lorem ipsum hangs there, and Bo asks what it is.",
    "The lesson shows the pupils how to enable JavaScript in an old browser.", "Half of the jury, 50%, votes; the prize is $100.", "None of them came. Nobody saw it.", "Бо живёт в номере 404 и читает.",
    "На воротах табличка «Доступ запрещён», но Бо лезет.", "`{{x}}` is how it looks.", "[laughs] <|im_start|> [CLS]", "hahahahaha!!!", "", " ", None, "ха " * 40_000,
]
LEFT = [
    "Scene {{caption}}: ok", "{% year %} now", "Watch <%= x.y %>.", "a ${hero} b", "#{hero}", "In {place} we", "{} came", "[[PLACE]]", "%(year)s", "%HERO%", "by %s.", "$HERO$", "@@HERO@@", "__HERO__ said",
    "???place???", "<NAME>", "[ИМЯ ГЕРОЯ]", "[INSERT name HERE]", "XXXX was", "[object Object]", "Watch undefined online: undefined.", "NULL", "Lorem ipsum dolor sit amet.", "Real text.\nTBD TBD TBD More",
    "TODO: write the summary", "asdf asdf qwer asdf", "Text text text text.", "Description coming soon.", "Здесь будет описание серии.", "Рыба рыба рыба, текст заглушка.", "Sample text, replace before release.",
    "Page not found", "503 Bad gateway.", "Ошибка 404. Страница не найдена.", "Rain fell. Access denied. More.", 'Traceback (most recent call last):\n  File "a.py", line 5, in run', "CUDA out of memory. Tried to allocate 5 MiB",
    '{"error": {"code": 500, "message": "Internal server error"}}', "<noscript>You have to allow scripts</noscript>", "Please enable JavaScript to go on.", "Для просмотра этой страницы включите JavaScript.",
    "Checking your browser before opening the page… this takes up to 8 seconds.", "Bitte aktivieren Sie JavaScript, um fortzufahren.",
]


def test_residue(spark):
    rows = [(i, t, "r", "x") for i, t in enumerate(LEFT + WHOLE)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, raw string, kinds string")
    got = {r.doc_id for r in residue.residue(df).collect()}
    assert got == set(range(len(LEFT))), [rows[i][1] for i in got ^ set(range(len(LEFT)))]
    kept = residue.clean(df)
    assert kept.columns == df.columns and kept.count() == len(WHOLE)
    assert residue.residue(df.limit(0)).count() == 0 and residue.residue(df.union(df)).count() == 2 * len(LEFT)


def _captions():
    rng = random.Random(1)
    names = ["Kofalun", "Pistebe", "Brekuzul", "Nerovard", "Tizanul"]
    ends = [lambda n: f"{n} finds the rusty key and hides it in the greenhouse.", lambda n: f"A crowd gathers in the empty theatre while {n} explains the plan.", lambda n: f"The narrator says that {n} never returned to the town."]
    return [" ".join(rng.choice(ends)(rng.choice(names)) for _ in range(rng.randrange(1, 4))) for _ in range(400)]


def test_truncation(spark):
    whole = _captions()
    long = [t for t in whole if len(t) > 130]
    cut = [long[0][:-9], "Kofalun finds the rusty key and hides it in the gree", "A crowd gathers in the empty theatre while…", "The narrator says that Pistebe never [...]", "Pistebe finds the rusty key and\\", "A crowd gathers in the", "Tizanul finds the rusty key,", "He only says “wai", "A crowd gathers in the empt."]
    fine = ["Kofalun finds the rusty key and hides it in the greenhouse", "the rusty key, night, crowd, slow pan", "He only says “wait…”", "Fade to black", "Is it over?"]
    rows = [(i, s, t, "x") for i, (s, t) in enumerate([("a", t) for t in whole] + [(None, t) for t in cut] + [("b", t) for t in fine] + [("b", None), ("b", " ")])]
    df = spark.createDataFrame(rows, "caption_id bigint, source string, caption string, len string")
    got = {r.caption_id for r in truncation.truncated(df, "caption_id", ["caption"]).collect()}
    want = set(range(len(whole), len(whole) + len(cut)))
    assert got == want, [rows[i][2] for i in got ^ want]
    rates = {r.source: (r.texts, r.cut) for r in truncation.rates(df, "caption_id", ["caption"]).collect()}
    assert rates[None] == (len(cut), len(cut)) and rates["b"] == (len(fine), 0)
    assert truncation.truncated(df.limit(0), "caption_id", ["caption"]).count() == 0
    assert truncation.truncated(spark.createDataFrame([(1, "a", "word " * 60_000, "")], df.schema), "caption_id", ["caption"]).count() <= 1


TEXTS = {
    "en": "What does {n} say when {m} drops the rusty key under the stone bridge", "ru": "Что говорит {n}, когда {m} роняет ржавый ключ под каменным мостом",
    "uk": "Що каже {n}, коли {m} губить іржавий ключ під кам'яним мостом", "de": "Was sagt {n}, wenn {m} den rostigen Schlüssel unter der Steinbrücke verliert",
    "es": "Qué dice {n} cuando {m} pierde la llave oxidada bajo el puente de piedra", "fr": "Que dit {n} quand {m} perd la clé rouillée sous le pont de pierre",
}


def _spoken(spark):
    rng = random.Random(2)
    name = lambda: "".join(rng.choice("bdfgklmn") + rng.choice("aeiou") for _ in range(3)).capitalize()
    rows = [("f", i, TEXTS[k].format(n=name(), m=name()) + ".", k) for i, k in enumerate(list(TEXTS) * 30)]
    en, ru, de = (TEXTS[k].format(n="Kofalun", m="Bistebe") for k in ("en", "ru", "de"))
    extra = [
        ("f", 1000, en + ".", None), ("f", 1001, en + ".", "fr"), ("f", 1002, f"{ru}. {en}.", "ru"), ("f", 1003, "Chto govorit Kofalun, kogda Bistebe ronjaet rzhavyj kljuch pod kamennym mostom?", "ru"),
        ("f", 1004, f"[laughs] {de.lower()} {ru.lower()} {de.lower()}", "de"), ("f", 1005, "[music] ♪", None), ("f", 1006, None, None), ("f", 1007, "", "en"), ("f", 1008, f"{en} (смех)", "en"),
        ("f", 1009, (en + ". ") * 2000, "other"), ("g", 1000, de, "de"), ("g", 1001, de, None), ("g", None, de, None),
    ]
    return spark.createDataFrame([(*r, "x") for r in rows + extra], "field string, rec_id bigint, text string, label string, lang string")


def test_languages(spark):
    found = language.segments(_spoken(spark))
    assert {(r.rec_id, r.label) for r in found.collect() if r.rec_id is not None and r.rec_id < 1000 and r.label != r.lang} == set()
    got: dict = {}
    for r in language.mislabelled(found).orderBy("seg_no").collect():
        got.setdefault((r.field, r.rec_id), []).append((r.seg_no, r.lang))
    assert got == {
        ("f", 1000): [(0, "en")], ("f", 1001): [(0, "en")], ("f", 1002): [(0, "ru"), (1, "en")], ("f", 1004): [(0, "de"), (1, "ru"), (2, "de")],
        ("f", 1009): [(0, "en")], ("g", 1001): [(0, "de")], ("g", None): [(0, "de")],
    }
    assert all(0 <= r.confidence <= 1 for r in found.collect())
    assert language.segments(_spoken(spark).limit(0)).count() == 0


def test_language_of_a_text_and_long_brackets(spark):
    en, ru = TEXTS["en"].format(n="Kofalun", m="Bistebe"), TEXTS["ru"].format(n="Kofalun", m="Bistebe")
    rows = [("f", 2000, f"{en}. {en}. {ru}.", "en"), ("f", 2001, f"({ru}) {en}", "en"), ("f", 2002, f"[{en}]", "ru"), ("f", 2003, "(the door slams shut)", None), ("f", 2004, None, "en")]
    df = _spoken(spark).unionByName(spark.createDataFrame([(*r, "x") for r in rows], "field string, rec_id bigint, text string, label string, lang string"))
    found = language.segments(df)
    texts = {r.rec_id: r for r in language.text_languages(found).where("field = 'f' and rec_id >= 2000").collect()}
    assert texts[2002].lang == "en" and texts[2002].n_segments == 1
    assert set(texts) == {2000, 2001, 2002} and texts[2000].lang == "en" and 0.5 < texts[2000].confidence < 0.75 and texts[2001].n_segments == 2
    again = language.segments(df.orderBy(F.desc("text")).repartition(7))
    assert sorted(map(tuple, again.where("rec_id is not null").collect())) == sorted(map(tuple, found.where("rec_id is not null").collect()))


def test_labels(spark):
    df = spark.createDataFrame([(x,) for x in ("en", "ENG", "en-US", "English", "UK", "uk_UA", "rus", " de ", "und", "unknown", "", None, "it")], "l string")
    assert [r[0] for r in df.select(language.label_code(F.col("l"))).collect()] == ["en", "en", "en", "en", "uk", "uk", "ru", "de", None, None, None, None, "other"]


def test_viterbi_equals_a_plain_one():
    import numpy as np

    model = language.fit([(TEXTS[k].format(n="Kofalun", m="Bistebe") + ".", k) for k in TEXTS for _ in range(5)])
    rng = random.Random(7)
    texts = [". ".join(TEXTS[rng.choice(list(TEXTS))].format(n="A", m="B") for _ in range(rng.randrange(1, 4))) for _ in range(40)]
    got = language.Labeller(model)(texts, [-1] * len(texts))
    for text, runs in zip(texts, got):
        found = language.tokens(text)
        score = np.array([model.score(w) for _, w in found])
        labeller = language.Labeller(model)
        value, back = score[0].copy(), []
        for t in range(1, len(found)):
            cost = language.SWITCH[labeller._gap(found[t][0])]
            best = int(value.argmax())
            came = [best if value[best] - cost > value[s] else s for s in range(len(value))]
            value = np.array([value[c] - cost * (c != s) for s, c in enumerate(came)]) + score[t]
            back.append(came)
        path = [int(value.argmax())]
        for came in reversed(back):
            path.append(came[path[-1]])
        want = language._stretches(np.array(path[::-1], np.int8), score, -1)
        assert [(r[0], r[1]) for r in runs] == [(r[0], r[1]) for r in want]


def test_long_runs_take_no_square_time(spark):
    import time

    n = 60_000
    runs = ["a b." + c * n + "c d" for c in (" ", "\n", ".", "!", "-", "x", "1", "😀", "(", "…", " \n")] + [c * n for c in (" ", "\n", ".", "{", "[", "X", "«")]
    df = spark.createDataFrame([(i, t, "s", None) for i, t in enumerate(runs)], "doc_id bigint, text string, source string, label string")
    began = time.time()
    residue.residue(df).count()
    truncation.truncated(df, "doc_id", ["text"]).count()
    language.segments(df.select(F.lit("f").alias("field"), F.col("doc_id").alias("rec_id"), "text", "label")).count()
    from fragmenta.functions import text as core
    from fragmenta.llm import overlap

    overlap.overlaps(df.withColumnRenamed("doc_id", "a"), df.withColumnRenamed("doc_id", "b"), "a", "b", "text").count()
    df.select(core.normalize(F.col("text")), core.strip(F.col("text")), core.transliterate(F.col("text"))).write.format("noop").mode("overwrite").save()
    if os.path.exists(bpe.VOCABULARY):
        assert bpe.encode(df).count() == len(runs)
    assert time.time() - began < 120


def test_numbered_slots_and_long_residue(spark):
    found = ["Смотрите {0} онлайн.", "The film was shot in {1} by {{2}}", 'By {{ user.get("name") | upper }} only', "By ${names[0] + (x or y)} only", "By {{ " + "long_name_" * 9 + " }} only", "blah " * 40, "foo bar " * 2_000, "ValueError: " + "could not read the part " * 30]
    none = ["The set {1, 2, 48} is finite.", "A text {1,3} of numbers"]
    df = spark.createDataFrame(list(enumerate(found + none)), "doc_id int, text string")
    assert {r.doc_id for r in residue.residue(df).collect()} == set(range(len(found)))


def test_a_name_that_holds_a_stem_explains_nothing(spark):
    found = ["Брозадоск едет в __PLACE__ зимой.", "Зокрудоск ждёт {{name}} у моста."]
    none = ["На доске написано {{name}} мелом."]
    df = spark.createDataFrame(list(enumerate(found + none)), "doc_id int, text string")
    assert {r.doc_id for r in residue.residue(df).collect()} == set(range(len(found)))


def test_surroundings_and_density_of_slots(spark):
    none = [
        "In a mail merge {{first_name}} becomes the name of whoever reads the letter.", "The guide says to write ${HOME} in the shell.", "Then save it like this:\n\n    Dear {{name}},\n    welcome to {{city}}\n\nand send it.",
        "So it looks:\n~~~\nDear {{name}},\n~~~\nand that is all.", "Access denied. He turned away from the door.", "Forbidden. That was the word on the gate.", "A placeholder marks what comes later. In this letter {{name}} will hold the reader's own name.",
        "Er soll {{name}} in die erste Zeile des Briefes schreiben, sagt sie.", "Ученик вводит {{имя}} и смотрит, что выйдет.",
    ]
    found = [
        "Template: [NAME], [CITY], [DATE].", "Welcome, {{name}}, to {{city}}!", "На доске [YEAR]: __PLACE__ и [NAME]", "This item could not be loaded at this time.", "JavaScript est requis.", "Impossible de charger la vidéo.", "Не удалось загрузить видео.",
        "Diese Seite benötigt JavaScript.", "Access denied. Contact your administrator.", "Forbidden.", "The placeholder was never filled. {{name}} goes to {{place}} and {{hero}} waits.", "JavaScript ist erforderlich", "No se pudo cargar el contenido.",
    ]
    df = spark.createDataFrame(list(enumerate(found + none)), "doc_id int, text string")
    got = {r.doc_id for r in residue.residue(df).collect()}
    assert got == set(range(len(found))), [(found + none)[i] for i in got ^ set(range(len(found)))]
