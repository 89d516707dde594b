"""Abusive, hateful and sexual content.

Method: compression-distance classification. From a bounded sample of labelled documents two zstandard
dictionaries are trained, one on toxic and one on ordinary lines. A window (an utterance, also one
that runs over two cues) is compressed with either; its distance is how much shorter the toxic
dictionary makes it. A document's score is its highest distance, and thresholds are calibrated on
labelled documents that the dictionaries haven't seen.

Labels are of documents while the dictionaries need lines: at first the toxic lines are those of
documents labelled so whose words and word pairs speak for such documents; then the dictionaries
themselves choose the lines anew, twice. The lines of each half of the documents are always chosen by
what the other half teaches.

Scale: every document is read once and scored where it is read; only id, source and score leave the
task. Training sees at most ``MAX_LABELLED`` documents (those whose ids hash lowest), whatever the
size of the corpus. Scores of repeated windows are remembered within a task, up to ``REMEMBERED`` of
them; forgetting changes no result.

Defined results: a null or empty text, and one without letters, scores 0 and isn't flagged; repeated
documents each get a row; documents without id are scored too; without labelled documents of both
kinds nothing can be learned and no document is flagged (score 0); extra columns are ignored.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mixing import same_source
from .subtitles import CUE, fold, is_advert, may_advertise, parts

MAX_LABELLED = 20_000
REMEMBERED = 300_000
#: Bytes of either dictionary, and the compression level.
DICTIONARY, LEVEL = 96 * 1024, 12
#: Windows of fewer letters are too short for distances; they are looked up whole.
LEAST = 6
#: How likely a short line may be to occur in toxic documents only by chance, to be looked up.
CHANCE = 1e-5
ROUNDS = 2
#: Share of documents labelled ordinary that may hold a toxic line all the same.
STRAY = 0.04
#: Share of new words and word pairs from which on a line enters the ordinary dictionary.
NOVELTY = 0.15

_LEET = str.maketrans("@$0134!|", "asoieaii")
_SPELT = re.compile(r"\b(?:[a-z] ){2,}[a-z]\b")
_DRAWN = re.compile(r"(.)\1{2,}")
_UTTERANCES = re.compile(r"(?:^|\n|(?<=[.!?…\"”]) )[ \t]*[-–—] ?")
_HEADER = re.compile(r"\A\s*WEBVTT[^\n\x1e]*")
_ENDS, _AFTER_END = frozenset(".!?…:;♪)]"), " \t\n\"\u201d»\u2019'"
_DASHES = " \t\n-–—"
#: Between consonants a "v" stands for a "u", as in "scvmbag".
_V_FOR_U = re.compile(r"(?<=[b-df-hj-np-tw-z])v(?=[b-df-hj-np-tw-z])")
_INSIDE = re.compile(r"(?<=\w)[@$0134!|](?=\w)|(?<!\w)[@$](?=\w)")


def canonical(window: str) -> str:
    """A window's spelling without case, accents, look-alike signs, drawn-out or spelt-out letters."""
    s = " ".join(fold(_INSIDE.sub(lambda m: m[0].translate(_LEET), window)).split())
    if " " in s:
        s = _SPELT.sub(lambda m: m[0].replace(" ", ""), s)
    if "v" in s:
        s = _V_FOR_U.sub("u", s)
    return _DRAWN.sub(r"\1", s)


def windows(text: str, pairs: bool = True, adverts: bool = True) -> list[str]:
    """Utterances, and (with ``pairs``) pairs of neighbours of which the first doesn't end its sentence.

    Cues that look like adverts, and what brackets and notes hold, are windows of their own (with
    ``adverts``); their neighbours pair across them.
    """
    speech, aside = parts(text)
    out: list[str] = aside.split(CUE) if aside and adverts else []
    held, clean = "", _HEADER.sub("", speech)
    some = may_advertise(clean)
    for cue in clean.split(CUE):
        cue = cue.strip()
        if not cue:
            continue
        apart = some and is_advert(cue)
        if apart and not adverts:
            continue
        for part in _UTTERANCES.split(cue) if "-" in cue or "–" in cue or "—" in cue else (cue,):
            part = part.strip(_DASHES)
            if not part:
                continue
            if apart:
                out.append(part)
                continue
            if held and pairs:
                out.append(f"{held} {part}")
            out.append(part)
            core = part.rstrip(_AFTER_END)
            held = "" if core[-1:] in _ENDS and core else part
    return out


class Model:
    """Two dictionaries, a threshold and short toxic lines. Compressors are made when first needed, in each process."""

    def __init__(self, toxic: bytes, ordinary: bytes, threshold: float = 0.0, short: frozenset[str] = frozenset()):
        self.toxic, self.ordinary, self.threshold, self.short = toxic, ordinary, threshold, short
        self._with: tuple | None = None
        self._known: dict[str, float] = {}

    def __getstate__(self):
        return self.toxic, self.ordinary, self.threshold, self.short

    def __setstate__(self, state):
        self.__init__(*state)

    def _compressors(self):
        if self._with is None:
            made = []
            for d in (self.toxic, self.ordinary):
                z = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                z.precompute_compress(level=LEVEL)
                made.append(zstandard.ZstdCompressor(dict_data=z, write_checksum=False, write_content_size=False, write_dict_id=False).compress)
            self._with = tuple(made)
        return self._with

    def distance(self, line: str) -> float:
        """By what share the toxic dictionary makes a canonical line shorter than the ordinary one does."""
        if len(line) < LEAST:
            return float(line in self.short)
        toxic, ordinary = self._compressors()
        b = f" {line} ".encode()
        x, y = len(toxic(b)), len(ordinary(b))
        return (y - x) / (max(x, y) + 4)

    def score(self, text: str | None) -> float:
        best, known = 0.0, self._known
        for w in windows(text or ""):
            d = known.get(w)
            if d is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                d = known[w] = self.distance(canonical(w))
            if d > best:
                best = d
        return best


# ---------------------------------------------------------------- training


def _grams(line: str) -> set[str]:
    words = line.split()
    return {*(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)), *words}


def _dictionary(lines: Counter, novelty: float) -> bytes:
    """Distinct lines, the most frequent nearest to the end, where they are cheapest to refer to.

    A line gets in if at least the share ``novelty`` of its words and word pairs isn't there yet.
    """
    out, size, there = [], 0, set()
    for line, _ in sorted(lines.items(), key=lambda x: (-x[1], x[0])):
        grams, b = _grams(line), f" {line} ".encode()
        if len(grams - there) < novelty * len(grams):
            continue
        if size + len(b) > DICTIONARY:
            break
        there |= grams
        out.append(b)
        size += len(b)
    return b"".join(reversed(out))


def _seeds(docs: list[tuple[int, list[str]]]) -> dict[str, float]:
    """For each word and word pair, how much it speaks for documents labelled toxic."""
    yes, no, n = Counter(), Counter(), [0, 0]
    for label, lines in docs:
        grams = set().union(*map(_grams, lines)) if lines else set()
        n[label] += 1
        (yes if label else no).update(grams)
    out = {}
    for g, k in yes.items():
        if k >= 2:
            # both counts are taken at the cautious end of what chance makes of them
            z = math.log((k - 0.7 * math.sqrt(k)) / (n[1] + 1)) - math.log((no[g] + 0.7 * math.sqrt(no[g]) + 0.3) / (n[0] + 1))
            if z > 0:
                out[g] = min(z, 4.0)
    return out


Doc = tuple[int, list[str]]


def _exceeding(docs: list[Doc], score, share: float) -> float:
    """What the best line of a document labelled ordinary exceeds in ``share`` of them."""
    best = sorted(max(map(score, lines), default=0.0) for label, lines in docs if not label)
    return best[min(len(best) - 1, int(len(best) * (1 - share)))] if best else 0.0


def _by_words(fit: list[Doc], docs: list[Doc]) -> tuple[Counter, frozenset[str]]:
    """Lines of ``docs`` labelled toxic that words and word pairs of ``fit`` speak for, and all lines they speak for a little."""
    seeds = _seeds(fit)
    ranks: dict[str, float] = {}
    for line in {x for _, lines in docs for x in lines}:
        grams = _grams(line)
        if found := sum(seeds.get(g, 0.0) for g in grams):
            ranks[line] = found / (len(grams) + 2)
    score = lambda line: ranks.get(line, 0.0)
    cut = max(_exceeding(docs, score, STRAY), 1e-9)
    loose = max(_exceeding(docs, score, 5 * STRAY), 1e-9)
    return Counter(x for label, lines in docs if label for x in set(lines) if score(x) > cut), frozenset(k for k, v in ranks.items() if v > loose)


def _model(toxic: Counter, docs: list[Doc], spoken_for: frozenset[str]) -> Model:
    """Ordinary are the lines of documents labelled ordinary that words don't speak against."""
    ordinary = Counter(x for label, lines in docs if not label for x in set(lines))
    clean = Counter({k: v for k, v in toxic.items() if ordinary[k] <= v})
    return Model(_dictionary(clean, 0.0), _dictionary(Counter({k: v for k, v in ordinary.items() if k not in clean and k not in spoken_for}), NOVELTY))


def _by_distance(model: Model, docs: list[Doc], spoken_for: frozenset[str]) -> Counter:
    """Lines of documents labelled toxic for which both their distance and their words speak."""
    distances = {x: model.distance(x) for x in {x for _, lines in docs for x in lines} & spoken_for}
    score = lambda line: distances.get(line, 0.0)
    cut = max(_exceeding(docs, score, STRAY), 0.02)
    return Counter(x for label, lines in docs if label for x in set(lines) if score(x) >= cut)


def _fit(docs: list[Doc]) -> Model:
    """Each half's toxic lines are chosen by what the other half teaches, so that no line speaks for itself."""
    halves = [docs[0::2], docs[1::2]]
    toxic, spoken_for = zip(*(_by_words(halves[1 - i], halves[i]) for i in (0, 1)), strict=True)
    for _ in range(ROUNDS):
        models = [_model(toxic[i], halves[i], spoken_for[i]) for i in (0, 1)]
        toxic = [_by_distance(models[1 - i], halves[i], spoken_for[i]) for i in (0, 1)]
    return _model(toxic[0] + toxic[1], docs, spoken_for[0] | spoken_for[1])


def _threshold(model: Model, docs: list[Doc]) -> float:
    """The distance that tells the labelled documents apart with the best F1."""
    distances = {x: model.distance(x) for x in {x for _, lines in docs for x in lines}}
    scores = sorted(((max((distances[x] for x in lines), default=0.0), label) for label, lines in docs), reverse=True)
    total, hits, best, cut = sum(label for _, label in scores), 0, 0.0, 1.0
    for i, (score, label) in enumerate(scores, 1):
        hits += label
        if (i == len(scores) or scores[i][0] < score) and (f := 2 * hits / (i + total)) >= best:
            best, cut = f, (score + scores[i][0]) / 2 if i < len(scores) else score
    return max(cut, 0.02)


def _short(docs: list[Doc]) -> frozenset[str]:
    """Lines shorter than ``LEAST`` that (nearly) only documents labelled toxic hold, in more of them than by chance."""
    counts, n = (Counter(), Counter()), [0, 0]
    for label, lines in docs:
        n[label] += 1
        counts[label].update({x for x in lines if x and len(x) < LEAST})
    share = n[1] / max(1, sum(n))
    return frozenset(x for x, k in counts[1].items() if counts[0][x] <= STRAY * k and share**k < CHANCE)


def train(docs: list[tuple[int, str]]) -> Model | None:
    """Fit on ``label, text``; None if a kind is missing.

    The dictionaries are made of single utterances, since a pair may join an ordinary one to a toxic
    one, and without adverts, which would take room from speech. The threshold comes from one half,
    with all windows, by what the other half teaches.
    """
    spelt: dict[str, str] = {}

    def read(text: str, pairs: bool, short: bool = False) -> list[str]:
        out = []
        for w in windows(text, pairs, adverts=pairs):
            c = spelt.get(w)
            if c is None:
                c = spelt[w] = canonical(w)
            if (len(c) < LEAST) == short:
                out.append(c)
        return out

    single = [(label, read(text, False)) for label, text in docs]
    if len({label for label, _ in single}) < 2:
        return None
    model = _fit(single)
    held = [(label, read(text, True)) for label, text in docs[1::2]]
    if all(len({label for label, _ in half}) == 2 for half in (single[0::2], held)):
        model.threshold = _threshold(_fit(single[0::2]), held)
    else:
        model.threshold = _threshold(model, held)
    model.short = _short([(label, read(text, False, short=True)) for label, text in docs])
    return model


# ---------------------------------------------------------------- over tables


def labelled_sample(documents: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """``doc_id, label, text`` of at most ``most`` documents whose reviewers agree, those whose ids hash lowest.

    A document is toxic if a reviewer flagged anything; reviews without any flag set either way don't
    count. The ids are at most ``most``, which bounds their broadcast.
    """
    flag = F.greatest("abusive", "hateful", "sexual")
    seen = labels.where(F.col("doc_id").isNotNull() & flag.isNotNull()).groupBy("doc_id").agg(F.max(flag).alias("label"), F.min(flag).alias("least"))
    ids = seen.where(F.col("label") == F.col("least")).select("doc_id", "label", F.xxhash64("doc_id").alias("place")).orderBy("place", "doc_id").limit(most)
    texts = documents.where(F.length("text") > 0).select("doc_id", "text")
    return texts.join(F.broadcast(ids), "doc_id").select("place", "doc_id", (F.col("label") > 0).cast("int").alias("label"), "text")


def _trainer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = sorted(row for b in batches for row in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True))
    model = train([(label, text) for _, _, label, text in docs])
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])


def fit(documents: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Model | None:
    """Train in one task on the bounded sample; only the model (two dictionaries) reaches the driver."""
    rows = labelled_sample(documents, labels, most).repartition(1).mapInArrow(_trainer, "model binary").collect()
    return pickle.loads(rows[0][0]) if rows else None


def _scorer(model: Model | None):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [model.score(t) if model and t else 0.0 for t in b.column("text").to_pylist()]
            flags = [bool(model) and s >= model.threshold for s in scores]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("source"), pa.array(scores, pa.float64()), pa.array(flags, pa.bool_())], names=["doc_id", "source", "score", "flagged"]
            )

    return score


def score_documents(documents: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, source, score, flagged`` of every document."""
    return documents.select("doc_id", "source", "text").mapInArrow(_scorer(model), "doc_id bigint, source string, score double, flagged boolean")


def rates(scored: DataFrame) -> DataFrame:
    """Documents and flagged ones per source, whose spellings are brought together."""
    per = scored.groupBy(same_source(F.col("source")).alias("source")).agg(
        F.count(F.lit(1)).alias("n_documents"), F.count_if("flagged").alias("n_flagged"), F.avg("score").alias("mean_score")
    )
    return per.withColumn("rate", F.col("n_flagged") / F.col("n_documents"))
