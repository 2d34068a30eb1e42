"""Scores for abusive, hateful and sexual language, from subword-bag embeddings averaged into a linear softmax.

A document's raters judge it as a whole, the language in question fills a sentence or two. Texts are therefore cut into short
windows and a document scores as its worst window. The model is fitted in rounds: at first every window inherits its document's
label; then only those windows of a labelled document that the model finds telling keep it, documents without any are taken for
rating errors, and so are unlabelled documents with a flagrant window. Windows lie in partitions; in every epoch each partition
takes its steps from the shared model, and the ways they went are averaged bucket by bucket, weighted by how often a partition saw the bucket. The driver
holds the model and one number per labelled document, never windows. Disguises (look-alike letters, digits for letters, spaced or
stretched words, invisible characters) are undone before words are cut into hashed character n-grams, so that unseen misspellings
share vectors with what was seen.
"""

from __future__ import annotations

import re
import unicodedata
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import cut

CLASSES = ("none", "abusive", "hateful", "sexual")
#: Labelled documents that the model is fitted on, at most, taken by smallest hash; all their windows count.
SAMPLE = 20_000
#: Partitions the windows lie in, whatever the cluster, passes over them per fit, and rounds of fitting and judging.
PARTS, EPOCHS, ROUNDS = 4, 5, 3
#: Windows' worth of weight that all ordinary windows of a document have together, at most.
VOICE = 80.0
#: Windows of a step.
BATCH = 64
#: Words of a window, and words from one window's start to the next.
WORDS, STRIDE = 14, 7
BUCKETS, DIMENSIONS = 1 << 16, 16
#: Score from which a document counts as a case.
THRESHOLD = 0.5
#: Gradient below which a bucket's steps shrink, so that what was seen once is not learnt by heart.
DAMPING = 0.02
_KEPT = 300_000

#: Letters of other alphabets, digits and signs that pass for Latin letters.
LOOKALIKES = str.maketrans("авеёкмнорстухіѕјԁɡһӏοαενικρτυ", "abeekmhopctyxisjdghloaevikptu")
DIGITS = str.maketrans("013457@$!|", "oieastasil")
INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]")
SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_]){3,}[^\W\d_](?![^\W_])")
STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
TOKEN = re.compile(r"[^\W_]+(?:[@$!|*'’][^\W_]*)*|[@$][^\W_]+(?:[@$!|*'’][^\W_]*)*|[\U0001f300-\U0001faff]")
SENTENCE = re.compile(r"(?<=[.!?…。！？])\s+|[\n\r  ]+|(?<=[。！？])")
#: A checksum or key: hexadecimal digits, which spell nothing.
KEY = re.compile(r"[0-9a-f-]+")
#: Letters of the overlapping pieces that a longer word is read in.
PIECE = 40
WIDE = re.compile(r"[぀-ヿ㐀-鿿가-힯]")


def plain(text: str) -> str:
    """A text in lower case with its disguises undone."""
    text = INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)) if not text.isascii() else text
    text = unicodedata.normalize("NFKC", text).lower().translate(LOOKALIKES)
    return STRETCHED.sub(r"\1", SPACED.sub(lambda m: re.sub(r"[ .\-_]", "", m.group()), text))


def words(sentence: str) -> list[str]:
    """Tokens of a plain sentence: digits that stand for letters made letters, other numbers made one, censored letters one star."""
    out = []
    for token in TOKEN.findall(sentence):
        letters = sum(c.isalpha() for c in token)
        if not letters:
            token = "9" if token[:1].isdigit() else token
        elif letters < len(token):
            token = token.rstrip("!|'’")
            if len(token) > 14 and KEY.fullmatch(token):
                token = "9"
            elif "*" in token:
                token = re.sub(r"\*+", "*", token)
            elif letters * 2 >= len(token) and len(token) > 2 or token[0] in "@$":
                token = STRETCHED.sub(r"\1", token.translate(DIGITS))
        if len(token) > 3 and WIDE.search(token):
            out += [token[i : i + 2] for i in range(len(token) - 1)]
        elif token:
            out += [token[i : i + PIECE] for i in range(0, max(1, len(token) - PIECE // 2), PIECE // 2)] if len(token) > PIECE else [token]
    return out


def windows(text: str | None) -> list[tuple[str, ...]]:
    """The distinct windows of a text; null, empty and blank texts have none."""
    if not text:
        return []
    found: dict[tuple[str, ...], None] = {}
    for sentence in SENTENCE.split(plain(text)):
        w = words(sentence) if sentence else []
        for at in range(0, max(1, len(w) - WORDS + STRIDE), STRIDE):
            if w[at : at + WORDS]:
                found[tuple(w[at : at + WORDS])] = None
    return list(found)


def grams(word: str) -> list[int]:
    """Buckets of a word and its character n-grams."""
    marked = f"<{word}>"
    parts = {marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)} | {marked}
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in sorted(parts)]


def bigram(a: str, b: str) -> int:
    return zlib.crc32(f"{a} {b}".encode("utf-8", "surrogatepass")) % BUCKETS


def bag(window: tuple[str, ...], known: dict[str, list[int]]) -> np.ndarray:
    """The buckets of a window's words and word pairs."""
    if len(known) > _KEPT:
        known.clear()
    for w in window:
        if w not in known:
            known[w] = grams(w)
    return np.array([g for w in window for g in known[w]] + [bigram(*p) for p in zip(window, window[1:], strict=False)], np.int32)


class Model:
    """Embedding table and linear layer, and what Adagrad has seen of either."""

    def __init__(self, table: np.ndarray, layer: np.ndarray, seen: np.ndarray | None = None, seen_layer: np.ndarray | None = None) -> None:
        self.table, self.layer, self.seen, self.seen_layer = table, layer, seen, seen_layer
        self.known: dict = {}

    def __reduce__(self):
        return Model, (self.table, self.layer, self.seen, self.seen_layer)

    @classmethod
    def fresh(cls, seed: int = 3) -> Model:
        layer = np.zeros((DIMENSIONS + 1, len(CLASSES)), np.float32)
        layer[:-1] = np.random.default_rng(seed).normal(0, 1.0, (DIMENSIONS, len(CLASSES)))
        return cls(np.zeros((BUCKETS, DIMENSIONS), np.float32), layer, np.full(BUCKETS, DAMPING**2, np.float32), np.ones(layer.shape, np.float32))

    @classmethod
    def knowing_nothing(cls) -> Model:
        """A model that finds nothing."""
        layer = np.zeros((DIMENSIONS + 1, len(CLASSES)), np.float32)
        layer[-1, 0] = 20.0
        return cls(np.zeros((BUCKETS, DIMENSIONS), np.float32), layer)

    def _sum(self, key, buckets) -> np.ndarray:
        """Sum of the bucket vectors, with their number behind it."""
        if key not in self.known:
            if len(self.known) > _KEPT:
                self.known.clear()
            at = buckets()
            self.known[key] = np.append(self.table[at].sum(axis=0), np.float32(len(at)))
        return self.known[key]

    def probabilities(self, some: list[tuple[str, ...]]) -> np.ndarray:
        """Class probabilities of windows."""
        bags = np.empty((len(some), DIMENSIONS + 1), np.float32)
        for i, w in enumerate(some):
            parts = [self._sum(x, lambda x=x: grams(x)) for x in w]
            parts += [self._sum(p, lambda p=p: [bigram(*p)]) for p in zip(w, w[1:], strict=False)]
            bags[i] = np.sum(parts, axis=0)
        return _softmax(np.append(bags[:, :-1] / bags[:, -1:], np.ones((len(some), 1), np.float32), axis=1) @ self.layer)

    def of_bags(self, bags: list[np.ndarray]) -> np.ndarray:
        """Class probabilities of bags of buckets."""
        out = np.empty((len(bags), len(CLASSES)), np.float32)
        for at in range(0, len(bags), 2000):
            some = bags[at : at + 2000]
            n = np.array([len(b) for b in some])
            mean = np.add.reduceat(self.table[np.concatenate(some)], np.cumsum(n) - n, axis=0) / n[:, None]
            out[at : at + 2000] = _softmax(np.append(mean, np.ones((len(some), 1), np.float32), axis=1) @ self.layer)
        return out

    def step(self, bags: list[np.ndarray], targets: np.ndarray, weights: np.ndarray, rate: float) -> None:
        """One damped Adagrad step of embeddings and layer jointly; buckets never seen stay zero and say nothing."""
        n = np.array([len(b) for b in bags])
        flat = np.concatenate(bags)
        mean = np.add.reduceat(self.table[flat], np.cumsum(n) - n, axis=0) / n[:, None]
        inputs = np.append(mean, np.ones((len(bags), 1), np.float32), axis=1).astype(np.float32)
        error = _softmax(inputs @ self.layer)
        error[np.arange(len(bags)), targets] -= 1.0
        error *= weights[:, None]
        step = inputs.T @ error
        back = (error @ self.layer[:-1].T) / n[:, None]
        self.seen_layer += step**2
        self.layer -= (0.3 * rate * step / np.sqrt(self.seen_layer)).astype(np.float32)
        by = np.argsort(flat, kind="stable")
        buckets, edges = np.unique(flat[by], return_index=True)
        gradient = np.add.reduceat(np.repeat(back, n, axis=0)[by], edges, axis=0).astype(np.float32)
        self.seen[buckets] += (gradient**2).mean(axis=1)
        self.table[buckets] -= rate * gradient / np.sqrt(self.seen[buckets])[:, None]


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def labelled_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, label (class number) of the documents whose raters agree, or agree that it is not none; labels in any case."""
    said = F.lower(F.trim("label"))
    votes = labels.filter(said.isin(*CLASSES) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.when(said != "none", said)).alias("bad"), F.count_if(said == "none").alias("none"), F.count("*").alias("n"))
    clear = votes.filter("bad is null or none = 0")
    number = F.coalesce(*[F.when(F.col("bad") == c, i) for i, c in enumerate(CLASSES)], F.lit(0))
    sample = clear.select("doc_id", number.alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    return documents.filter("text is not null").select("doc_id", "text").join(sample, "doc_id")


def distinct_windows(labelled: DataFrame) -> DataFrame:
    """bag (bytes), docs (doc_id, own label, fold, windows of the document) of every distinct window, in PARTS partitions.

    A window's list holds at most the SAMPLE labelled documents.
    """

    def cut_up(batches):
        known: dict[str, list[int]] = {}
        for pdf in batches:
            for doc, text, label in zip(pdf.doc_id, pdf.text, pdf.label, strict=True):
                some = windows(text)
                for at in range(0, len(some), 5000):
                    part = some[at : at + 5000]
                    yield pd.DataFrame({"bag": [bag(w, known).tobytes() for w in part], "doc": doc, "own": np.int32(label), "fold": np.int32(zlib.crc32(str(doc).encode()) % 2), "size": np.int32(len(some))})

    rows = labelled.select("doc_id", "text", "label").mapInPandas(cut_up, "bag binary, doc long, own int, fold int, size int")
    each = rows.repartition(PARTS, "bag").groupBy("bag").agg(F.collect_list(F.struct("doc", "own", "fold", "size")).alias("docs"))
    return cut(each)


def _instances(bags: list[np.ndarray], docs: pd.Series, before: tuple[list[Model], dict[int, float]] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, label, weight, fold) columns of every occurrence, by the models and the documents' worst windows of the round before."""
    win = np.repeat(np.arange(len(bags)), [len(d) for d in docs])
    flat = [x for d in docs for x in d]
    own, fold, size = (np.array([x[c] for x in flat], np.int64) for c in ("own", "fold", "size"))
    if before is None:
        # a window that several documents of a fold hold, most of them not ordinary, is telling whatever else they say
        bad, fine = np.zeros((len(bags), 2)), np.zeros((len(bags), 2))
        np.add.at(bad, (win, fold), own > 0)
        np.add.at(fine, (win, fold), own == 0)
        sure = ((bad >= 3) & (bad > fine))[win, fold]
        return win, own, np.where(own == 0, np.minimum(1.0, VOICE / size), np.where(sure, 1.0, 1.0 / size)), fold
    models, worst = before
    bad = np.stack([1.0 - m.of_bags(bags)[:, 0] for m in models])[fold, win]
    most = np.array([worst[x["doc"]] for x in flat])
    telling = (own > 0) & (bad >= 0.7 * most) & (most > 0.5)
    open_ = (own > 0) & (most <= 0.5)  # nothing telling yet: an error, or language seen too seldom so far
    doubtful = (bad > 0.5) & ~telling  # overlooked by a rater, or beside a telling window
    return win, np.where(telling | open_, own, 0), np.where(telling, 1.0, np.where(open_, 1.0 / size, np.where(doubtful, 0.0, np.minimum(1.0, VOICE / size)))), fold


def _targets(n: int, win: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, label, strength): one instance per distinct window; a window that many unlabelled documents hold is an ordinary one."""
    total = np.zeros((n, len(CLASSES)))
    np.add.at(total, (win, label), weight)
    use = np.nonzero(total.sum(axis=1) > 0)[0]
    best = np.where(total[use, 0] > total[use, 1:].max(axis=1) * 0.5, 0, total[use, 1:].argmax(axis=1) + 1)
    return use, best, np.sqrt(np.minimum(total[use, best], 25.0))


def _read(batches) -> tuple[list[np.ndarray], pd.Series]:
    whole = [pdf for pdf in batches if len(pdf)]
    if not whole:
        return [], pd.Series(dtype=object)
    pdf = pd.concat(whole).sort_values("bag", kind="stable")  # the order of rows decides nothing
    return [np.frombuffer(b, np.int32) for b in pdf.bag], pdf.docs


def _epoch(seen: DataFrame, models: list[Model], held_out: bool, before, epoch: int) -> list[Model]:
    """The models after one pass: each partition's way, averaged. With held_out, model k passes over documents of the other fold."""
    spark = seen.sparkSession
    shared = spark.sparkContext.broadcast((models, before))

    def walk(batches):
        bags, docs = _read(batches)
        models, before = shared.value
        if not bags:
            return
        win, label, weight, fold = _instances(bags, docs, before)
        for k, start in enumerate(models):
            own = fold != k if held_out else np.ones(len(fold), bool)
            use, best, strength = _targets(len(bags), win[own], label[own], weight[own])
            if not len(use):
                continue
            strength = strength / strength.mean()
            model = Model(start.table.copy(), start.layer.copy(), start.seen.copy(), start.seen_layer.copy())
            rng = np.random.default_rng([epoch, k])
            order = rng.permutation(len(use))
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                model.step([bags[i] for i in use[some]], best[some], strength[some], 0.6)
            times = np.bincount(np.concatenate([bags[i] for i in use]), minlength=BUCKETS).astype(np.float32)
            moved = (model.table - start.table) * times[:, None]
            layer = np.concatenate([model.layer - start.layer, model.seen_layer - start.seen_layer])
            parts = {"table": moved, "times": times, "seen": (model.seen - start.seen) * times, "layer": layer.astype(np.float32)}
            yield pd.DataFrame({"model": [k], **{c: [x.tobytes()] for c, x in parts.items()}})

    # to the driver come PARTS tables of the model's size, whatever the windows
    rows = seen.mapInPandas(walk, "model int, table binary, times binary, seen binary, layer binary").collect()
    out = []
    for k, start in enumerate(models):
        own = [r for r in rows if r.model == k]
        if not own:
            out.append(start)
            continue
        table, times, grown, layer = (np.sum([np.frombuffer(r[c], np.float32) for r in own], axis=0) for c in ("table", "times", "seen", "layer"))
        often = np.maximum(times, 1.0)
        layer, seen_layer = np.split(layer.reshape(2 * (DIMENSIONS + 1), -1) / len(own), 2)
        out.append(Model(start.table + table.reshape(BUCKETS, -1) / often[:, None], start.layer + layer, start.seen + grown / often, start.seen_layer + seen_layer))
    shared.destroy()
    return out


def _worst(seen: DataFrame, models: list[Model]) -> dict[int, float]:
    """The worst window of every labelled document, by the model that has not seen it: at most SAMPLE numbers."""
    shared = seen.sparkSession.sparkContext.broadcast(models)

    def judge(batches):
        for pdf in batches:
            bags = [np.frombuffer(b, np.int32) for b in pdf.bag]
            if bags:
                bad = np.stack([1.0 - m.of_bags(bags)[:, 0] for m in shared.value])
                yield pd.DataFrame([(x["doc"], float(bad[x["fold"], i])) for i, d in enumerate(pdf.docs) for x in d], columns=["doc", "bad"])

    worst = {r.doc: r.bad for r in seen.mapInPandas(judge, "doc long, bad double").groupBy("doc").agg(F.max("bad").alias("bad")).collect()}
    shared.destroy()
    return worst


def fit_labels(documents: DataFrame, labels: DataFrame) -> Model:
    """The model fitted on at most SAMPLE labelled documents, on all their windows; every document is then scored."""
    seen = distinct_windows(labelled_documents(documents, labels))
    if seen.isEmpty():
        return Model.knowing_nothing()
    before = None
    for _ in range(ROUNDS - 1):
        models = [Model.fresh(), Model.fresh()]  # documents are judged by a model that has not seen them, lest it learn the raters' errors by heart
        for epoch in range(EPOCHS):
            models = _epoch(seen, models, True, before, epoch)
        before = models, _worst(seen, models)
    models = [Model.fresh()]
    for epoch in range(EPOCHS):
        models = _epoch(seen, models, False, before, epoch)
    return Model(models[0].table, models[0].layer)


def score_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, source, score (0 to 1), label (the likeliest of the classes but none), found (score at least THRESHOLD) of every
    document. Null and wordless texts score 0; repeated rows repeat; without labels nothing is found."""
    shared = documents.sparkSession.sparkContext.broadcast(fit_labels(documents, labels))

    def score(batches):
        model = shared.value
        for pdf in batches:
            for start in range(0, len(pdf), 500):
                some = pdf.iloc[start : start + 500]
                each = [windows(t) for t in some.text]
                flat = [w for ws in each for w in ws]
                p = model.probabilities(flat) if flat else np.empty((0, len(CLASSES)))
                worst, which, at = np.zeros(len(some)), np.zeros(len(some), int), 0
                for i, ws in enumerate(each):
                    if ws:
                        own = p[at : at + len(ws)]
                        k = int(own[:, 0].argmin())
                        worst[i], which[i] = 1.0 - own[k, 0], int(own[k, 1:].argmax())
                        at += len(ws)
                yield pd.DataFrame({"doc_id": some.doc_id, "source": some.source.tolist(), "score": worst, "label": np.array(CLASSES[1:])[which], "found": worst >= THRESHOLD})

    return documents.select("doc_id", "source", "text").mapInPandas(score, "doc_id long, source string, score double, label string, found boolean")


def rates(scores: DataFrame) -> DataFrame:
    """source, documents, cases, rate; documents without a source are a group of their own."""
    return scores.groupBy("source").agg(F.count("*").alias("documents"), F.count_if("found").alias("cases"), F.avg(F.col("found").cast("double")).alias("rate"))
