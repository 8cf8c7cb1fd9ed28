"""Language of every narrative and of every stretch of a mixed one (problem 3).

Words are bags of character n-grams weighted by inverse frequency over the whole corpus. A sparse
multinomial logistic regression, trained with follow-the-regularised-leader under elastic-net penalties
and calibrated by a temperature, gives each short stretch of words a probability per language; the best
path through the stretches, with a price on every change, gives the segments.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talasik.llm.formdups import FIELD_LABELS
from talasik.llm.scanrepair import Headers, _word_counts, is_page_number, learn_headers
from talasik.session import spread

LANGUAGES = ("tl", "en", "ceb", "pam")
#: Codes and names of the languages in lower case (fixed values).
CODES = {
    "tl": "tl", "tgl": "tl", "fil": "tl", "tagalog": "tl", "filipino": "tl", "pilipino": "tl", "en": "en", "eng": "en", "english": "en",
    "ceb": "ceb", "cebuano": "ceb", "bisaya": "ceb", "binisaya": "ceb", "visayan": "ceb", "pam": "pam", "kapampangan": "pam", "pampanga": "pam", "pampango": "pam",
}
FEATURES = 1 << 15
#: The classifier is fitted on at most so many labelled rows of each table, those with the smallest hash of their key.
SAMPLE_ROWS = 3000
#: Of a sampled row the classifier sees at most so many stretches, and so many stretches in all.
ROW_STRETCHES, SAMPLE_STRETCHES = 40, 40_000
#: Words that make up one stretch at most.
STRETCH = 8
#: Price of a change of language between sentences and within one.
CHANGE, CHANGE_INSIDE = 5.0, 10.0
#: Labels of the field that holds the narrative proper (fixed values).
STORY = ("salaysay", "facts", "salese", "sugilanon")

_WORD = re.compile(r"[^\W\d_][\w'’-]*")
_ADDRESS = re.compile(r"(?<![\w.+-])[\w.+-]+(?:\s?@\s?[\w.-]+|\(at\)[\w.-]+|\sat\s(?:[\w-]+\sdot\s)+\w+)")
_SENTENCE = re.compile(r"[.!?;][\"'”)]*\s+|//|\|")
#: A form's text begins with one of its labels.
_FORM = re.compile(rf"(?i)\W*(?:{'|'.join(FIELD_LABELS)})\s*[:=\-–—]")
_CUT_WORD = re.compile(r"(?<=[^\W\d_])-\n\s*(?=[^\W\d_])")
_LABEL = regex.compile(rf"(?i)(?<![\p{{L}}\p{{N}}])({'|'.join(FIELD_LABELS)})\s*[:=\-–—]")


def declared(column: Column) -> Column:
    """The language a label names, NULL if it names none."""
    key = F.regexp_replace(F.lower(F.trim(column)), r"[-_ (].*$", "")
    pairs = [F.lit(x) for kv in CODES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word index, hashed character n-gram (1 to 4, with the word's boundaries) and count, in that order."""
    codes = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], dtype=np.int64)
    word = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # characters to the word's end
    keys = []
    with np.errstate(over="ignore"):
        for n in range(1, 5):
            at = np.flatnonzero(left >= n)
            h = np.full(len(at), 0x9E3779B97F4A7C15 * n & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
            for k in range(n):
                h = (h ^ codes[at + k]) * np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(29)
            keys.append(word[at] * FEATURES + ((h >> np.uint64(20)) % np.uint64(FEATURES)).astype(np.int64))
    key, n = np.unique(np.concatenate(keys), return_counts=True)
    return key // FEATURES, key % FEATURES, n


def _gram_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(FEATURES)
    for pdf in batches:
        if len(pdf):
            word, gram, _ = grams(pdf["word"].tolist())
            total += np.bincount(gram, weights=pdf["n"].to_numpy()[word], minlength=FEATURES)
    at = np.flatnonzero(total)
    yield pd.DataFrame({"gram": at, "n": total[at].astype(np.int64)})


def inverse_frequency(texts: DataFrame) -> np.ndarray:
    """Of each n-gram, log of all words over those that hold it, counted over all of `texts`.

    Words are counted first, so each distinct word is cut into n-grams once.
    """
    counts = texts.select("text").mapInPandas(_word_counts, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("word").rlike(r"^\p{L}[\p{L}\p{M}'’-]*$"))
    rows = counts.mapInPandas(_gram_counts, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(FEATURES)
    for r in rows:
        df[r["gram"]] = r["n"]
    most = max(df.max(), 1)
    return np.log((1 + most * 4) / (1 + df))


@dataclass
class Model:
    """Weights (features x languages), bias and temperature, with a cache of words."""

    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    cache: dict[str, np.ndarray] = field(default_factory=dict)

    def features(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        _, at, n = grams([word])
        v = n * self.idf[at]
        return at, v / (np.linalg.norm(v) or 1)

    def word(self, word: str) -> np.ndarray:
        hit = self.cache.get(word)
        if hit is None:
            at, v = self.features(word)
            hit = v @ self.weights[at]
            if len(self.cache) > 300_000:
                self.cache.clear()
            self.cache[word] = hit
        return hit

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.full(len(LANGUAGES), -math.log(len(LANGUAGES)))
        z = (self.bias + sum(self.word(w) for w in words) / math.sqrt(len(words))) / self.temperature
        z = z - z.max()
        return z - math.log(np.exp(z).sum())


Prepared = list[tuple[np.ndarray, np.ndarray, int]]


def prepare(units: list[tuple[list[str], int]], idf: np.ndarray) -> Prepared:
    """Features (the last is the bias), their values and the language of every unit (words, language)."""
    model = Model(idf, np.zeros((FEATURES, len(LANGUAGES))), np.zeros(len(LANGUAGES)))
    cache: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    out = []
    for words, label in units:
        for x in words:
            if x not in cache:
                cache[x] = model.features(x)
        at = np.concatenate([cache[x][0] for x in words] + [[FEATURES]])
        v = np.concatenate([cache[x][1] for x in words] + [[math.sqrt(len(words))]]) / math.sqrt(len(words))
        at, back = np.unique(at, return_inverse=True)
        out.append((at.astype(np.int32), np.bincount(back, weights=v), label))
    return out


def train(units: Prepared, idf: np.ndarray, epochs: int = 2, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> Model:
    """FTRL-proximal with elastic net on prepared units, in the order given."""
    k = len(LANGUAGES)
    z, n, w = np.zeros((FEATURES + 1, k)), np.zeros((FEATURES + 1, k)), np.zeros((FEATURES + 1, k))
    model = Model(idf, w[:-1], w[-1])
    for _ in range(epochs):
        for at, v, label in units:
            zi, ni = z[at], n[at]
            wi = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            s = v @ wi
            p = np.exp(s - s.max())
            p /= p.sum()
            p[label] -= 1
            g = v[:, None] * p[None, :]
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[at] = zi + g - sigma * wi
            n[at] = ni + g * g
    w[:] = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return model


def calibrate(model: Model, units: list[tuple[list[str], int]]) -> float:
    """The temperature with the least log loss on held-out units."""
    model.temperature = 1.0
    logits = np.array([model.log_probabilities(words) for words, _ in units])
    labels = np.array([label for _, label in units])
    best = (math.inf, 1.0)
    for t in np.geomspace(0.2, 5, 41):
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        loss = -(z[np.arange(len(z)), labels] - np.log(np.exp(z).sum(axis=1))).mean()
        best = min(best, (float(loss), float(t)))
    return best[1]


def story(text: str, headers: Headers) -> str:
    """The text without page furniture, form fields but the story's, and breaks within words."""
    if "\n" in text:
        lines = [x for x in text.split("\n") if not is_page_number(x.strip("\f")) and not headers.match(x)]
        text = _CUT_WORD.sub("", "\n".join(lines))
    marks = list(_LABEL.finditer(text)) if _FORM.match(text) else []
    if len({m[1].lower() for m in marks}) > 1:
        told = [text[m.end() : (marks[i + 1].start() if i + 1 < len(marks) else len(text))] for i, m in enumerate(marks) if m[1].lower() in STORY]
        text = " ".join(told) or text
    return _ADDRESS.sub(" ", text) if "@" in text or "(at)" in text or " dot " in text else text


def stretches(text: str) -> list[tuple[list[str], bool]]:
    """Consecutive stretches of words, and whether each begins a sentence."""
    out = []
    for sentence in _SENTENCE.split(text.lower()):
        words = _WORD.findall(sentence)
        if not words:
            continue
        parts = max(1, round(len(words) / STRETCH))
        ends = [round(len(words) * (i + 1) / parts) for i in range(parts)]
        at = 0
        for i, e in enumerate(ends):
            out.append((words[at:e], i == 0))
            at = e
    return out


class Scorer:
    """Log-probabilities of many stretches at once, with a row of weights for every word seen."""

    def __init__(self, model: Model) -> None:
        self.model = model
        #: Row of a token as written; 0 for one without a word.
        self.ids: dict[str, int] = {}
        self.rows = np.zeros((1, len(LANGUAGES)))

    def prepare(self, texts: list[list[str]]) -> None:
        """Give every token of `texts`, lists of sentences, its row."""
        if len(self.ids) > 500_000:
            self.ids.clear()
            self.rows = self.rows[:1]
        fresh = {t for text in texts for sentence in text for t in sentence.split()} - self.ids.keys()
        words: dict[str, int] = {}
        for t in fresh:
            found = _WORD.search(t.lower())
            self.ids[t] = words.setdefault(found[0], len(self.rows) + len(words)) if found else 0
        if words:
            word, gram, n = grams(list(words))
            v = n * self.model.idf[gram]
            norm = np.sqrt(np.bincount(word, weights=v * v, minlength=len(words)))
            own = np.stack([np.bincount(word, weights=v * w, minlength=len(words)) for w in self.model.weights[gram].T], axis=1)
            self.rows = np.concatenate([self.rows, own / np.maximum(norm, 1e-12)[:, None]])

    def cut(self, sentences: list[str]) -> list[tuple[list[int], bool]]:
        """As `stretches`, with the rows of the words."""
        out = []
        for sentence in sentences:
            own = [i for i in map(self.ids.__getitem__, sentence.split()) if i]
            n = len(own)
            if n <= STRETCH * 3 // 2:
                if n:
                    out.append((own, True))
                continue
            parts = round(n / STRETCH)
            ends = [round(n * k / parts) for k in range(parts + 1)]
            out += [(own[a:b], a == 0) for a, b in zip(ends, ends[1:])]
        return out

    def log_probabilities(self, units: list[list[int]]) -> np.ndarray:
        sizes = np.array([len(u) for u in units])
        at = np.array([i for u in units for i in u], dtype=np.int64)
        sums = np.add.reduceat(self.rows[at], np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        z = (self.model.bias + sums / np.sqrt(sizes)[:, None]) / self.model.temperature
        z -= z.max(axis=1, keepdims=True)
        z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
        return z * np.minimum(1.0, sizes / 3)[:, None]


def best_path(logp: list[list[float]], begins: list[bool]) -> list[int]:
    """Languages of consecutive stretches with the best sum of log-probabilities less the price of changes."""
    score, back = list(logp[0]), []
    for own, begin in zip(logp[1:], begins[1:]):
        best = max(range(len(score)), key=score.__getitem__)
        floor = score[best] - (CHANGE if begin else CHANGE_INSIDE)
        back.append([k if s >= floor else best for k, s in enumerate(score)])
        score = [max(s, floor) + p for s, p in zip(score, own)]
    path = [max(range(len(score)), key=score.__getitem__)]
    for b in reversed(back):
        path.append(b[path[-1]])
    return path[::-1]


def segments(scorer: Scorer, texts: list[list[tuple[list[int], bool]]]) -> list[list[tuple[int, float]]]:
    """For each text, (language, confidence) of its longest runs: the best path over its stretches."""
    units = [words for own in texts for words, _ in own]
    if not units:
        return [[] for _ in texts]
    logp = scorer.log_probabilities(units)
    top = logp.argmax(axis=1).tolist()
    listed, size = logp.tolist(), [len(u) for u in units]
    out, at = [], 0
    for own in texts:
        n = len(own)
        mine = range(at, at + n)
        path = top[at : at + n] if len(set(top[at : at + n])) < 2 else best_path(listed[at : at + n], [b for _, b in own])
        runs: list[list] = []
        for i, lang in zip(mine, path):
            p = size[i] * math.exp(listed[i][lang])
            if runs and runs[-1][0] == lang:
                runs[-1][1] += p
                runs[-1][2] += size[i]
            else:
                runs.append([lang, p, size[i]])
        out.append([(lang, p / k) for lang, p, k in runs])
        at += n
    return out


def spread_over(items: list, most: int) -> list:
    """At most so many of the items, at even distances from the first on."""
    return items if len(items) <= most else [items[i * len(items) // most] for i in range(most)]


def _sample(df: DataFrame, key: str, text: str, label: str, forms: list[str]) -> list[tuple[int, str, str]]:
    """(hash, language, words) of stretches of the SAMPLE_ROWS labelled rows with the smallest hashes of key and text.

    Of each row ROW_STRETCHES stretches from all over its text are cut out where the row is, so what reaches the
    driver has a bound whatever the texts.
    """
    named = df.select(F.col(text).alias("text"), declared(F.col(label)).alias("lang"), F.xxhash64(key, text).alias("h")).filter("lang IS NOT NULL AND length(text) > 0")

    def cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        headers = Headers(forms)
        for pdf in batches:
            rows = [(h, lang, " ".join(w)) for h, lang, t in zip(pdf["h"], pdf["lang"], pdf["text"]) for w, _ in spread_over(stretches(story(t, headers)), ROW_STRETCHES) if len(w) > 2]
            yield pd.DataFrame(rows, columns=["h", "lang", "words"])

    rows = named.orderBy("h", "text", "lang").limit(SAMPLE_ROWS).mapInPandas(cut_out, "h bigint, lang string, words string")
    return sorted((r["h"], r["lang"], r["words"]) for r in rows.collect())


def learn(narratives: DataFrame, documents: DataFrame, forms: list[str]) -> Model | None:
    """Model from the labels of both tables (narratives: record_id, text, lang); None without any label. `forms`: learnt headers."""
    said = narratives.select("text").unionByName(documents.select("text")).filter(F.length("text") > 0)
    idf = inverse_frequency(said)
    rows = _sample(narratives, "record_id", "text", "lang", forms) + _sample(documents, "doc_id", "text", "lang", forms)
    units, held = [], []
    for h, lang, words in sorted(rows):
        (held if h % 5 == 0 else units).append((words.split(), LANGUAGES.index(lang)))
    if not units:
        return None
    order = np.random.default_rng(5).permutation(len(units))
    units = [units[i] for i in order[:SAMPLE_STRETCHES]]
    ready = prepare(units, idf)
    rough = train(ready, idf, epochs=1)
    # labels are partly wrong: what the first model finds implausible doesn't teach the second
    sure = [x for x, (w, y) in zip(ready, units) if rough.log_probabilities(w)[y] > math.log(0.25)]
    model = train(sure or ready, idf)
    held = [(w, y) for w, y in held if rough.log_probabilities(w)[y] > math.log(0.25)]
    if held:
        model.temperature = calibrate(model, held)
    model.cache.clear()
    return model


def identified(narratives: DataFrame, documents: DataFrame) -> DataFrame:
    """record_id, declared language and segments (seg_no, lang, confidence) of every narrative.

    `narratives` has record_id, text and lang. NULL and blank texts give no row; a text without a single
    word has no segments; repeated rows keep a row each; other columns are ignored.
    """
    some = narratives.filter(F.length(F.regexp_replace("text", r"(?U)[\s\p{Z}\p{Cf}]+", "")) > 0)
    forms = learn_headers(some.select("text"))
    model = learn(some, documents, forms)
    weights = None if model is None else (model.idf, model.weights, model.bias, model.temperature)
    shared = some.sparkSession.sparkContext.broadcast((forms, weights))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forms, weights = shared.value
        headers = Headers(forms)
        scorer = Scorer(Model(*weights)) if weights else None
        for pdf in batches:
            runs = [[] for _ in range(len(pdf))]
            if scorer:
                told = [_SENTENCE.split(story(text, headers)) for text in pdf["text"]]
                scorer.prepare(told)
                runs = segments(scorer, [scorer.cut(t) for t in told])
            found = [[(i, LANGUAGES[lang], float(p)) for i, (lang, p) in enumerate(own, 1)] for own in runs]
            yield pd.DataFrame({"record_id": pdf["record_id"], "declared": pdf["declared"], "segments": found})

    rows = spread(some.select("record_id", "text", declared(F.col("lang")).alias("declared")))
    return rows.mapInPandas(run, "record_id bigint, declared string, segments array<struct<seg_no:int,lang:string,confidence:double>>")


def narratives_of(blotter: DataFrame) -> DataFrame:
    return blotter.select("record_id", F.col("narrative_summary").alias("text"), F.col("narrative_lang").alias("lang"))


def languages(blotter: DataFrame, documents: DataFrame) -> DataFrame:
    """record_id, seg_no, lang and confidence of every segment of every narrative."""
    return identified(narratives_of(blotter), documents).select("record_id", F.explode("segments").alias("s")).select("record_id", "s.seg_no", "s.lang", "s.confidence")


def found_languages(blotter: DataFrame, documents: DataFrame) -> DataFrame:
    """Segments of the records whose label is missing or another language, or whose narrative is mixed."""
    own = identified(narratives_of(blotter), documents)
    odd = own.filter((F.size("segments") > 1) | F.col("declared").isNull() | (F.col("declared") != F.col("segments")[0]["lang"]))
    return odd.select("record_id", F.explode("segments").alias("s")).select("record_id", "s.seg_no", "s.lang")
