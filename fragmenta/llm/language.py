"""Languages of texts and of the parts of texts that mix several.

The script of a word narrows its candidate languages; word scores, learned from a
bounded sample of labelled rows, compare them; a Viterbi pass with a penalty for
switching (smaller at sentence ends, larger inside a clause) labels every word, and
equal neighbours form a stretch. The pass runs over a whole batch of texts at once,
position by position, so its cost is a few array operations for each word.

Nothing is shuffled: the model (its size is bounded by the sample) is broadcast.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The languages in question; the last state is Russian in Latin letters.
LANGUAGES = ("en", "ru", "uk", "de", "es", "fr")
STATES = (*LANGUAGES, "ru")
_LATIN = [0, 3, 4, 5, 6]
_CYRILLIC = [1, 2]

#: Labelled texts that the model is fitted on, for each field.
SAMPLE = 8_000
#: Rounds of labelling the sample by the model and fitting again: labels may be wrong.
ROUNDS = 2
#: Penalty for a switch inside a clause, after a comma or dash, after a sentence.
SWITCH = (9.0, 6.0, 3.5)
#: Words with evidence that a stretch has at least, unless it is the whole text.
MIN_WORDS = 3
#: What a label counts for, in nats.
LABEL = 2.0

# Frequent small words of each language.
SEEDS = {
    "en": "the of and to in is was that it for on with as at by from his her they who what where when how why which does not this are be has after before says an or but so he she",
    "ru": "и в не на что он с как по это она к но из у за от то все так его же бы для кто где когда почему который если чтобы уже или ли был была они её до",
    "uk": "і в не на що він з як по це вона до але із у за від то все так його ж би для хто де коли чому який якщо щоб вже або чи був була вони її та й під",
    "de": "der die das und in zu den ist nicht von mit sich auf für ein eine dem des im er sie es wer was wo wann wie warum wenn nach bei aus als auch wird an hat dass",
    "es": "el la de que y en los se del las un por con no una su para es al lo como más pero sus le ya o este quién qué dónde cuándo cómo cuando después hasta está",
    "fr": "le la les de des et en un une du est que qui dans pour pas au sur se il elle ne par plus avec ce son sa ses où quand comment pourquoi après avant aux l d qu",
}
# Ways to write Cyrillic in Latin letters, one column each.
ROMAN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e yo jo", "ж": "zh j", "з": "z", "и": "i", "й": "y j i", "к": "k",
    "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h kh", "ц": "c ts",
    "ч": "ch", "ш": "sh", "щ": "sch shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu ju iu", "я": "ya ja ia",
}
# Names of labels.
LABELS = {
    "en": "en eng english", "ru": "ru rus russian", "uk": "uk ukr ukrainian ua", "de": "de deu ger german",
    "es": "es spa spanish", "fr": "fr fra fre french",
}
# Letters that only one of the Cyrillic languages has.
_ONLY_UK, _ONLY_RU = frozenset("іїєґ"), frozenset("ыэъё")

# A sound tag: at most four words in brackets or asterisks, or notes. More words are speech like any other.
_TAGGED = r"{0}[^{0}{1}\s]{{0,60}}(?:[ \t]+[^{0}{1}\s]{{1,60}}){{0,3}}[ \t]*{1}"
_SOUND = re.compile("|".join(_TAGGED.format(*x) for x in ((r"\[", r"\]"), (r"\(", r"\)"), ("<", ">"), (r"\*", r"\*"))) + "|[♪♫♬♩]+")
_TOKEN = re.compile(r"([^\w]*)([^\W\d_]+(?:['’ʼ][^\W\d_]+)*)")
_RUN = re.compile(r"[^\w]{9,}")
_MIX = {"̀": None, "́": None}
_UNSEEN, _NAME, _FOREIGN, _FLOOR = 1.5, 0.2, 6.0, 9.0


def _script(word: str) -> int:
    """0 Latin, 1 Cyrillic, 2 another or mixed."""
    latin = cyrillic = 0
    for c in word:
        if "Ѐ" <= c <= "ӿ":
            cyrillic += 1
        elif c.isalpha():
            if c < "ɐ" or "Ḁ" <= c <= "ỿ":
                latin += 1
            else:
                return 2
    return 0 if latin and not cyrillic else 1 if cyrillic and not latin else 2


def romanised(word: str) -> set[str]:
    """A Russian word in Latin letters, each way of writing taken throughout."""
    return {"".join((ROMAN.get(c, c).split() or [""])[min(i, max(0, len(ROMAN.get(c, c).split()) - 1))] for c in word) for i in range(3)}


def tokens(text: str) -> list[tuple[str, str]]:
    """(what stands before, word); sound tags are taken out."""
    import unicodedata

    text = unicodedata.normalize("NFC", _SOUND.sub(" . ", text)).translate(_MIX)
    # Long runs without a word shrink to what they mean, else each place in them is tried as a start.
    text = _RUN.sub(lambda m: " . " if re.search(r"[.!?…\n;:/|]", m[0]) else " , " if re.search(r"[,—–\-]", m[0]) else " ", text)
    return _TOKEN.findall(text)


class Model:
    """Word scores for each state: counts with small words as a start, letters for the rest."""

    def __init__(self, counts: list[Counter], names: frozenset[str]):
        self.counts, self.names = counts, names
        self.total = [sum(c.values()) + 1.0 for c in counts]
        self.letters: list[defaultdict] = []
        for c in counts:
            grams: defaultdict = defaultdict(float)
            for w in c:
                for g in self._grams(w):
                    grams[g] += 1
            self.letters.append(grams)
        self.sizes = [sum(g.values()) + 1.0 for g in self.letters]

    @staticmethod
    def _grams(word: str) -> list[str]:
        w = f"^{word}$"
        return [w[i : i + 3] for i in range(len(w) - 2)]

    def score(self, raw: str) -> np.ndarray:
        """Nats by which the word speaks against each state; zeros: it says nothing."""
        word = raw.lower()
        kind = _script(word)
        out = np.zeros(len(STATES), np.float32)
        if kind == 2:
            return out
        among = _LATIN if kind == 0 else _CYRILLIC
        others = [s for s in range(len(STATES)) if s not in among]
        if word in self.names:
            out[others] = _NAME if kind == 0 else _UNSEEN
            return -out
        seen = [self.counts[s].get(word, 0) for s in among]
        if any(seen):
            value = np.array([math.log((n + 0.02) / self.total[s]) for n, s in zip(seen, among)])
            floor = _FLOOR
        else:
            grams = self._grams(word)
            value = np.array([sum(math.log((self.letters[s].get(g, 0) + 0.5) / self.sizes[s]) for g in grams) for s in among])
            floor = _NAME if raw[:1].isupper() else _UNSEEN
        out[among] = np.minimum(value.max() - value, floor)
        if kind == 1:
            marks = {2} if set(word) & _ONLY_UK else {1} if set(word) & _ONLY_RU else set()
            for s in _CYRILLIC:
                if marks and s not in marks:
                    out[s] = max(out[s], _FOREIGN)
        out[others] = (_FOREIGN if kind == 1 or any(seen) else floor) + out[among].min()
        return -out


def _seed_counts() -> list[Counter]:
    counts = [Counter({w: 20 for w in SEEDS[lang].split()}) for lang in LANGUAGES]
    counts.append(Counter({r: 20 for w in SEEDS["ru"].split() for r in romanised(w) if r}))
    return counts


def _clauses(found: list[tuple[str, str]]) -> Iterator[list[str]]:
    part: list[str] = []
    for before, word in found:
        if part and re.search(r"[.!?…\n;:/]", before):
            yield part
            part = []
        part.append(word)
    if part:
        yield part


def fit(rows: list[tuple[str, str | None]]) -> Model:
    """The model of labelled texts (text, language or None).

    A start from the small words; then each clause is given to the state that fits it
    best, the label counting as weak evidence, and words are counted anew.
    """
    clauses = []
    upper, lower = Counter(), Counter()
    for text, label in rows:
        found = tokens(text) if text else []
        for part in _clauses(found):
            clauses.append((part, label))
            if any(w[:1].isupper() for w in part) and not all(w.isupper() for w in part):
                for w in part[1:]:
                    (upper if w[:1].isupper() else lower)[w.lower()] += 1
    model = Model(_seed_counts(), frozenset())
    for _ in range(ROUNDS + 1):
        scores: dict[str, np.ndarray] = {}
        counts = _seed_counts()
        seeded = dict(counts[1])
        for part, label in clauses:
            total = np.zeros(len(STATES), np.float32)
            for w in part:
                s = scores.get(w)
                if s is None:
                    s = scores[w] = model.score(w)
                total += s
            if label in LANGUAGES:
                total[LANGUAGES.index(label)] += LABEL
                total[6] += LABEL * (label == "ru")
            best = int(total.argmax())
            if len(part) < 2 or np.sort(total)[-2] > total[best] - 1:
                continue
            for w in part:
                w = w.lower()
                if _script(w) == (1 if best in _CYRILLIC else 0):
                    counts[best][w] += 1
        for w, n in counts[1].items():
            if n > seeded.get(w, 0):
                for r in romanised(w):
                    counts[6][r] += n - seeded.get(w, 0)
        # Names: written with a capital inside sentences, and not only in German.
        names = frozenset(w for w, n in upper.items() if n > 2 * lower[w] and sum(c[w] for c in counts) > 1.2 * counts[3][w])
        model = Model(counts, names)
    return model


def _plain(model: Model) -> tuple:
    return [dict(c) for c in model.counts], model.names


class Labeller:
    """Stretches of batches of texts."""

    def __init__(self, model: Model, memory: int = 400_000):
        self.model, self.memory = model, memory
        self.rows: dict[str, int] = {}
        self.table: list[np.ndarray] = []
        self.gap: dict[str, int] = {}

    def _row(self, word: str) -> int:
        at = self.rows[word] = len(self.table)
        self.table.append(self.model.score(word))
        return at

    def _gap(self, before: str) -> int:
        level = 2 if re.search(r"[.!?…\n;:/|]", before) else 1 if re.search(r"[,—–\-]", before) else 0
        if len(self.gap) < 100_000:
            self.gap[before] = level
        return level

    def __call__(self, texts: list[str | None], labels: list[int]) -> list[list[tuple[int, int, float]]]:
        """(language, words, confidence) of the stretches of each text; labels: -1 if missing."""
        if len(self.rows) > self.memory:
            self.rows, self.table = {}, []
        rows, gaps = [], []
        get, gap = self.rows.get, self.gap.get
        for text in texts:
            found = tokens(text) if text else []
            rows.append([r if (r := get(w)) is not None else self._row(w) for _, w in found])
            gaps.append([g if (g := gap(b)) is not None else self._gap(b) for b, _ in found])
        scores = np.array(self.table, np.float32).reshape(-1, len(STATES))
        out: list[list[tuple[int, int, float]]] = [[] for _ in texts]
        order = sorted((i for i, r in enumerate(rows) if r), key=lambda i: len(rows[i]))
        at = 0
        while at < len(order):
            # Texts of about one length together; a very long one by itself.
            size = max(1, min(2048, 400_000 // len(rows[order[at]])))
            part = order[at : at + size]
            while len(part) > 1 and len(rows[part[-1]]) > 1.5 * len(rows[part[0]]) + 8:
                part = part[: len(part) // 2]
            at += len(part)
            for i, found in zip(part, self._viterbi([rows[i] for i in part], [gaps[i] for i in part], [labels[i] for i in part], scores)):
                out[i] = found
        return out

    def _viterbi(self, rows: list[list[int]], gaps: list[list[int]], labels: list[int], scores: np.ndarray) -> Iterator[list[tuple[int, int, float]]]:
        n, longest, k = len(rows), max(map(len, rows)), len(STATES)
        lengths = np.array([len(r) for r in rows])
        word = np.zeros((n, longest), np.int64)
        cost = np.full((n, longest), SWITCH[0], np.float32)
        penalty = np.array(SWITCH, np.float32)
        for i, (r, g) in enumerate(zip(rows, gaps)):
            word[i, : len(r)] = r
            cost[i, : len(g)] = penalty[g]
        value = np.zeros((n, k), np.float32)
        for i, label in enumerate(labels):
            if label >= 0:
                value[i, label] += LABEL
                if label == 1:
                    value[i, 6] += LABEL
        value += scores[word[:, 0]]
        back = np.full((longest, n, k), -1, np.int8)
        final = value.copy()
        for t in range(1, longest):
            best = value.argmax(axis=1)
            jump = value[np.arange(n), best] - cost[:, t]
            switch = jump[:, None] > value
            back[t] = np.where(switch, best[:, None], -1)
            value = np.where(switch, jump[:, None], value) + scores[word[:, t]]
            live = lengths > t
            final[live] = value[live]
        state = final.argmax(axis=1)
        path = np.zeros((n, longest), np.int8)
        for t in range(longest - 1, -1, -1):
            live = lengths > t
            path[live, t] = state[live]
            came = back[t, np.arange(n), state]
            state = np.where(live & (came >= 0), came, state)
        for i in range(n):
            yield _stretches(path[i, : lengths[i]], scores[rows[i]], labels[i])


def _stretches(path: np.ndarray, score: np.ndarray, label: int) -> list[tuple[int, int, float]]:
    """Runs of one language; those too short for a clause go to a neighbour."""
    lang = np.where(path == 6, 1, path)
    telling = score.min(axis=1) < -1
    if not len(lang):
        return []
    edges = [0, *(np.flatnonzero(np.diff(lang)) + 1).tolist(), len(lang)]
    runs = [[int(lang[a]), a, b] for a, b in zip(edges, edges[1:])]
    while len(runs) > 1:
        sizes = [int(telling[a:b].sum()) for _, a, b in runs]
        least = min(range(len(runs)), key=sizes.__getitem__)
        if sizes[least] >= MIN_WORDS:
            break
        beside = [j for j in (least - 1, least + 1) if 0 <= j < len(runs)]
        to = max(beside, key=sizes.__getitem__)
        runs[to][1:] = [min(runs[to][1], runs[least][1]), max(runs[to][2], runs[least][2])]
        del runs[least]
        merged = [runs[0]]
        for r in runs[1:]:
            if r[0] == merged[-1][0]:
                merged[-1][2] = r[2]
            else:
                merged.append(r)
        runs = merged
    out = []
    for language, a, b in runs:
        total = score[a:b].sum(axis=0)
        each = np.array([max(total[1], total[6]) if s == 1 else total[s] for s in range(len(LANGUAGES))], np.float64)
        weight = np.exp(each - each.max())
        out.append((language, b - a, float(weight[language] / weight.sum())))
    return out


def _main(runs: list[tuple[int, int, float]]) -> tuple[str | None, float]:
    """The language of most words of a text (the first in case of a tie), and its confidence."""
    if not runs:
        return None, 0.0
    share: dict[int, list[float]] = {}
    for language, n, confidence in runs:
        own = share.setdefault(language, [0.0, 0.0])
        own[0] += n
        own[1] += n * confidence
    best = max(share, key=lambda x: share[x][0])
    return LANGUAGES[best], round(share[best][1] / sum(n for _, n, _ in runs), 6)


def label_code(label: Column) -> Column:
    """The language of a label: codes of two or three letters, with a region, or English names.

    Null for no label (null, empty, ``und``, ``unknown``); ``other`` for one that names
    a language beyond the six.
    """
    base = F.lower(F.regexp_extract(F.trim(label), r"^([A-Za-z]+)", 1))
    code = F.when(label.isNull() | base.isin("", "und", "unknown", "unk", "none", "null", "mul", "zxx"), F.lit(None).cast("string"))
    for lang, spelled in LABELS.items():
        code = code.when(base.isin(*spelled.split()), F.lit(lang))
    return code.otherwise(F.lit("other"))


def segments(fields: DataFrame) -> DataFrame:
    """``(field, rec_id, label, seg_no, lang, n_words, confidence, n_segments, text_lang, text_confidence)``.

    ``fields`` holds ``field, rec_id, text, label`` (label as ``label_code`` gives it). One
    row for each stretch, in reading order; the language of a text is that of most of its
    words, with the mean confidence of its words in it and none in the others. Texts that
    are null or have no word besides sound tags give none. Repeated rows give their rows
    again. The model is fitted on about ``SAMPLE`` labelled texts of each field, chosen by
    their hash, so that neither order nor layout of the rows matters.
    """
    spark = fields.sparkSession
    labelled = fields.where("field is not null and text is not null and label is not null").select("field", "rec_id", "text", "label")
    sizes = {r.field: r["count"] for r in labelled.groupBy("field").count().collect()}  # the fields are parameters
    share = F.element_at(F.create_map(*[F.lit(x) for n, size in sizes.items() for x in (n, SAMPLE / size)]), F.col("field")) if sizes else F.lit(0.0)
    some = labelled.where(F.pmod(F.xxhash64("rec_id", "text", "label"), F.lit(1 << 30)) < share * (1 << 30))
    rows = sorted((r.text, r.label) for r in some.limit(2 * SAMPLE * max(1, len(sizes))).collect())
    shared = spark.sparkContext.broadcast(_plain(fit(rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, known = shared.value
        labeller = Labeller(Model([Counter(c) for c in counts], known))
        code = {lang: i for i, lang in enumerate(LANGUAGES)}
        for batch in batches:
            labels = batch.column("label").to_pylist()
            found = labeller(batch.column("text").to_pylist(), [code.get(x, -1) for x in labels])
            at, number, lang, words, sure, of, most, mean = [], [], [], [], [], [], [], []
            for i, runs in enumerate(found):
                main, its = _main(runs)
                for j, (language, n, confidence) in enumerate(runs):
                    most.append(main)
                    mean.append(its)
                    at.append(i)
                    number.append(j)
                    lang.append(LANGUAGES[language])
                    words.append(n)
                    sure.append(round(confidence, 6))
                    of.append(len(runs))
            at = pa.array(at, pa.int64())
            kept = [batch.column(c).take(at) for c in ("field", "rec_id", "label")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(number, pa.int32()), pa.array(lang, pa.string()), pa.array(words, pa.int32()), pa.array(sure, pa.float64()), pa.array(of, pa.int32()), pa.array(most, pa.string()), pa.array(mean, pa.float64())],
                ["field", "rec_id", "label", "seg_no", "lang", "n_words", "confidence", "n_segments", "text_lang", "text_confidence"],
            )

    schema = "field string, rec_id bigint, label string, seg_no int, lang string, n_words int, confidence double, n_segments int, text_lang string, text_confidence double"
    return fields.select("field", "rec_id", "text", "label").mapInArrow(run, schema)


def mislabelled(found: DataFrame) -> DataFrame:
    """The rows of ``segments`` of texts without a label, with a wrong one, or that mix languages."""
    return found.where("label is null or n_segments > 1 or label <> lang")


def text_languages(found: DataFrame) -> DataFrame:
    """``(field, rec_id, lang, confidence, n_segments)``: one row of ``segments`` for each text, with the language of the whole."""
    return found.where("seg_no = 0").select("field", "rec_id", F.col("text_lang").alias("lang"), F.col("text_confidence").alias("confidence"), "n_segments")
