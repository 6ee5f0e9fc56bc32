"""Toxicity by a weighted finite-state grammar over clauses.

A word transducer turns words into symbols: insults and threats (learned:
words, and stems that words begin with), targets, negations, words of
reporting, and hints: stems that words of toxic texts begin with far more often
than those of others, though chance forms them there too.  Three small transducers over symbols follow, for reported speech,
negation and targets; composed they are one automaton that reads a clause and
emits events, such as an insult at a target or a negated one.  Its arcs have the
learned weights of their events; a clause scores the weight of its path, and a
document a logistic function of what its clauses score together.  In a text
with hints every word weighs a little against them, since longer texts have
more of them by chance.

Labels, language, source and ids take no part in a score.  NULL and empty
texts have no events and get the score of texts without any.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from murmura.llm import storage, tokens, wordhash

#: At most about so many labelled rows are learned from.
FIT_ROWS = 30_000
THRESHOLD = 0.7
#: A stem or word is taken when it is in so many toxic texts at least, texts with it are toxic in so large a
#: share, and the chance that any such gram arises from labels dealt at random is below ``CHANCE``.
SUPPORT, PRECISION, CHANCE = 5, 0.97, 0.01
#: A stem is a hint when texts with it are toxic in so large a share, by chance as seldom.
HINTING = 0.3
#: So large a share of labels is taken to be wrong, and in so many turns guessed which.
NOISE, GUESSES = 0.01, 20
STEM = (3, 8)

# Closed classes in the languages of the corpus, fixed values.
TARGETS = "you your yours u ur du dich dir dein ihr euch tu toi te vous vos tes ton tú ti usted ustedes vosotros".split()
NEGATIONS = "not no never neither nor isn't aren't wasn't don't nicht kein keine nie pas jamais aucun nunca jamás ningún".split()
REPORTS = "said says say wrote writes called quoted quote according sagte sagt schrieb dit disait écrit dijo dice escribió".split()
THREATS = "kill hurt destroy burn attack töten vernichten tuer détruire matar destruir".split()

_TOKEN = re.compile(r"[\w']+|[.!?;\n]")
_RUN = re.compile(r"[\w']+")
_WORD = re.compile(r"\w+")
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, HINT = SYMBOLS = range(7)
EVENTS = ("insult", "insult_at", "threat", "threat_at", "negated", "reported", "hint", "hint_at", "hint_denied")

_HINTS = tuple(x for x in EVENTS if x.startswith("hint"))

Transducer = dict[tuple[int, object], tuple[int, object]]
"""``(state, symbol) -> (state, symbol)``; state 0 starts."""


def reported_speech() -> Transducer:
    """After a word of reporting, insults and threats are reported, hints denied."""
    said = {INSULT: "reported", THREAT: "reported", HINT: "hint_denied"}
    table: Transducer = {}
    for state, symbol in product((0, 1), SYMBOLS):
        table[state, symbol] = (1 if symbol == REPORT else state, said.get(symbol, symbol) if state else symbol)
    return table


def negation(reach: int = 3) -> Transducer:
    """Up to ``reach`` words after a negation, insults and threats are negated, hints denied."""
    denied = {INSULT: "negated", THREAT: "negated", HINT: "hint_denied"}
    table: Transducer = {}
    for state, symbol in product(range(reach + 1), [*SYMBOLS, "reported", "hint_denied"]):
        output = denied.get(symbol, symbol) if state else symbol
        table[state, symbol] = (reach if symbol == NEGATION else max(0, state - 1), output)
    return table


def target() -> Transducer:
    """Once somebody is addressed, insults, threats and hints are aimed; emits events or None."""
    kinds = {INSULT: "insult", THREAT: "threat", HINT: "hint"}
    table: Transducer = {}
    for state, symbol in product((0, 1), [*SYMBOLS, "reported", "negated", "hint_denied"]):
        if symbol in kinds:
            event: object = kinds[symbol] + ("_at" if state else "")
        else:
            event = symbol if isinstance(symbol, str) else None
        table[state, symbol] = (1 if symbol == TARGET else state, event)
    return table


def composed(*chain: Transducer) -> Transducer:
    """One transducer that feeds each one's output to the next."""
    numbers, table, todo = {(0,) * len(chain): 0}, {}, [(0,) * len(chain)]
    while todo:
        states = todo.pop()
        for symbol in SYMBOLS:
            reached, output = [], symbol
            for state, transducer in zip(states, chain):
                state, output = transducer[state, output]
                reached.append(state)
            key = tuple(reached)
            if key not in numbers:
                numbers[key] = len(numbers)
                todo.append(key)
            table[numbers[states], symbol] = (numbers[key], output)
    return table


def _lower(text: str) -> str:
    """``text`` in lower case; what has no lower case of one code point stays, so that places do not shift."""
    lowered = text.lower()
    if len(lowered) == len(text):
        return lowered
    return "".join(x if len(x.lower()) > 1 else x.lower() for x in text)


@dataclass
class Model:
    words: frozenset[str] = frozenset()
    stems: frozenset[str] = frozenset()
    hints: frozenset[str] = frozenset()
    #: Of texts as such, of the events, and of a hundred words in texts with hints.
    weights: np.ndarray = field(default_factory=lambda: np.zeros(2 + len(EVENTS)))

    def __post_init__(self) -> None:
        weight = dict(zip(EVENTS, self.weights[1:-1].tolist()))
        grammar = composed(reported_speech(), negation(), target())
        # (state, symbol) -> (state, event, weight)
        self.arcs = {arc: (state, event, weight.get(event, 0.0)) for arc, (state, event) in grammar.items()}
        closed = ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT), (THREATS, THREAT))
        self.classes = {w: kind for words, kind in closed for w in words} | dict.fromkeys(self.words, INSULT)
        self.lengths = sorted({len(x) for x in self.stems | self.hints})
        # Without an insult, a threat or a hint no clause emits an event.
        stems = [re.escape(x) for x in sorted(self.stems | self.hints)]
        words = [re.escape(x) + r"(?![\w'])" for x in sorted({*self.words, *THREATS})]
        self.telling = re.compile(rf"(?<![\w'])(?:{'|'.join(stems + words)})")

    def symbol(self, word: str) -> int:
        kind = self.classes.get(word)
        if kind is not None:
            return kind
        begins = [word[:n] for n in self.lengths]
        if any(x in self.stems for x in begins):
            return INSULT
        return HINT if any(x in self.hints for x in begins) else OTHER

    def paths(self, text: str) -> Iterator[tuple[int, int, Counter, float]]:
        """``(start, end, events, weight)`` of the clauses of ``text`` in which the grammar finds any events."""
        if not self.telling.search(lowered := _lower(text)):
            return
        state, events, score, start, end = 0, Counter(), 0.0, 0, 0
        for match in _TOKEN.finditer(lowered):
            if match[0] in ".!?;\n":
                if events:
                    yield start, match.start(), events, score
                state, events, score, start = 0, Counter(), 0.0, match.end()
            else:
                state, event, weight = self.arcs[state, self.symbol(match[0])]
                if event:
                    events[event] += 1
                    score += weight
                end = match.end()
        if events:
            yield start, end, events, score

    def clauses(self, text: str) -> Iterator[tuple[int, int, Counter]]:
        """``paths`` without weights."""
        for start, end, events, _ in self.paths(text):
            yield start, end, events

    def features(self, text: str) -> np.ndarray:
        """1, how often each event occurs, and what ``reach`` says, to which the weights belong."""
        total: Counter = Counter()
        for _, _, events in self.clauses(text):
            total.update(events)
        return np.array([1.0, *(float(total[x]) for x in EVENTS), self.reach(text, total)])

    @staticmethod
    def reach(text: str, events: Counter) -> float:
        """Hundreds of words in which hints can arise by chance: those of a text that has any."""
        return len(_RUN.findall(text)) / 100 if any(x in events for x in _HINTS) else 0.0

    def scores(self, paths: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Of documents whose clauses weigh ``paths`` together and whose words ``reach`` so far."""
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + paths + self.weights[-1] * reach, -500, 500)))


def held_out(doc_id: Column) -> Column:
    """Rows never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _grams(text: str, among: frozenset[str] | None = None) -> Counter:
    """Words of ``text``, closed by a mark, and stems, with how many different words begin with them; "" with all.

    Of those ``among`` if given.
    """
    words = set(_WORD.findall(_lower(text)))
    grams = [word + "$" for word in words]
    for n in range(STEM[0], STEM[1] + 1):
        grams += [word[:n] for word in words if len(word) >= n]
    found = Counter(grams if among is None else [g for g in grams if g in among])
    found[""] = len(words)
    return found


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """``(text, toxic)``: about ``rows`` labelled documents by a hash of the id, none held out, copies once.

    Of texts that share their smallest shingle hash one is taken, so that
    copies of one text do not make its words look telling.
    """
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    share = min(1.0, rows / max(1, usable.count()))
    taken = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)).select("doc_id", "toxic")
    # Bounded by ``rows``, whatever the size of the tables.
    chosen = docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id")

    def first_shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = []
            for first, end, data, offsets in wordhash.slices(batch["text"]):
                hashes, _, bounds = wordhash.words(data, offsets)
                for k in range(end - first):
                    own = wordhash.shingles(hashes[bounds[k] : bounds[k + 1]])
                    least.append(int(own.min().view(np.int64)) if len(own) else 0)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["text"], batch["toxic"], pa.array(least, pa.int64())],
                names=["doc_id", "text", "toxic", "least"],
            )

    marked = chosen.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("toxic").cast("int").alias("toxic"))
    marked = marked.mapInArrow(first_shingle, "doc_id bigint, text string, toxic int, least bigint")
    # The smallest id of each stays, whatever the order of rows.
    kept = marked.groupBy("least").agg(F.min_by(F.struct("text", "toxic"), "doc_id").alias("row"))
    return storage.written(kept.select("row.text", "row.toxic"), compression="zstd")


def _counted(rows: DataFrame, among: frozenset[str] | None) -> DataFrame:
    """``(gram, n, words)``: in how many texts each gram is and their different words with it, of those ``among`` if given."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, words = Counter(), Counter()
            for text in tokens.texts(batch["text"]):
                own = _grams(text, among)
                found.update(own.keys())
                words.update(own)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(found), pa.string()),
                    pa.array(list(found.values()), pa.int64()),
                    pa.array([words[g] for g in found], pa.int64()),
                ],
                names=["gram", "n", "words"],
            )

    counted = rows.select("text").mapInArrow(counts, "gram string, n bigint, words bigint")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))


def _logistic(features: np.ndarray, labels: np.ndarray, prior: float = 0.05, turns: int = 50) -> np.ndarray:
    """Weights by Newton's method, drawn to 0 by ``prior``; the intercept is free.

    Expectation and maximization in turns: a label that the weights contradict
    counts as right only as far as the share of wrong ones makes that likely, so
    that a single wrong label of a text with many events does not settle their weights.
    """
    weights, truth = np.zeros(features.shape[1]), labels
    for _ in range(GUESSES):
        weights = _newton(features, truth, weights, prior, turns)
        p = 1 / (1 + np.exp(-np.clip(features @ weights, -30, 30)))
        said = np.where(labels == 1, 1 - NOISE, NOISE) * p
        truth = said / (said + np.where(labels == 1, NOISE, 1 - NOISE) * (1 - p))
    return weights


def _newton(features: np.ndarray, labels: np.ndarray, weights: np.ndarray, prior: float, turns: int) -> np.ndarray:
    ridge = np.full(len(weights), prior)
    ridge[0] = 1e-6
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(features @ weights, -30, 30)))
        gradient = features.T @ (labels - p) - ridge * weights
        hessian = (features * (p * (1 - p))[:, None]).T @ features + np.diag(ridge + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        weights = weights + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return weights


def _evidence(hits: int, misses: int, share: float) -> float:
    """How much more often than with ``share`` these are hits: minus the logarithm of Chernoff's bound of that chance."""
    p = hits / (hits + misses)
    if p <= share:
        return 0.0
    return hits * np.log(p / share) + (misses * np.log((1 - p) / (1 - share)) if misses else 0.0)


def _hinting(toxic: dict[str, Row], other: dict[str, Row], telling: set[str], share: float) -> set[str]:
    """Stems with which a text is toxic much more often than with ``share``, none the beginning of another.

    Of stems that begin one another the one whose words say most is taken, and
    none whose words say less than something in ``telling`` that begins with it.
    """
    least = np.log(max(len(toxic), 1) / CHANCE)
    none = Row(n=0, words=0)
    words = toxic.get("", none).words / max(1, toxic.get("", none).words + other.get("", none).words)

    def weight(gram: str) -> float:
        return _evidence(toxic[gram].words, other.get(gram, none).words, words)

    strongest: dict[str, float] = {}
    for gram in telling:
        for n in range(STEM[0], min(len(gram), STEM[1]) + 1):
            strongest[gram[:n]] = max(strongest.get(gram[:n], 0.0), weight(gram))
    found = {}
    for gram, row in toxic.items():
        misses = other.get(gram, none).n
        if gram in telling or gram.endswith("$") or not gram or row.n < HINTING * (row.n + misses):
            continue
        if _evidence(row.n, misses, share) >= least and weight(gram) > strongest.get(gram, 0.0):
            found[gram] = weight(gram)
    taken: set[str] = set()
    begun: set[str] = set()
    for gram in sorted(found, key=lambda g: (-found[g], -len(g), g)):
        begins = {gram[:n] for n in range(STEM[0], len(gram) + 1)}
        if gram not in begun and not begins & taken:
            taken.add(gram)
            begun |= begins
    return taken


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Insults, stems and hints, then the weights of the grammar's events."""
    train = training_rows(docs, labels, rows)
    toxic = {r.gram: r for r in _counted(train.where("toxic = 1"), None).where(F.col("n") >= SUPPORT).collect()}
    other = {r.gram: r for r in _counted(train.where("toxic <> 1"), frozenset(toxic)).collect()}
    n_toxic, n_all = train.agg(F.count_if(F.col("toxic") == 1), F.count("*")).first()
    share = max(n_toxic, 1) / max(n_all, 2)
    needed = np.log(CHANCE / max(len(toxic), 1)) / np.log(share) if share < 1 else np.inf
    seen = {g: r.n + (other[g].n if g in other else 0) for g, r in toxic.items()}
    telling = {g for g, r in toxic.items() if g and r.n >= needed and r.n >= PRECISION * seen[g]}
    hints = _hinting(toxic, other, telling, share)
    # What begins with a hint that says more of the labels is part of that hint.
    telling = {g for g in telling if not any(g[:n] in hints for n in range(STEM[0], STEM[1] + 1))}
    # The shortest stem says all that longer ones do; a word counts where no stem covers it.
    covered = lambda g: any(g[:n] in telling for n in range(STEM[0], min(len(g.rstrip("$")), STEM[1] + 1)))
    least = {g for g in telling if not covered(g)}
    whole = {g for g in least if g.endswith("$")}
    # A stem that is nearly always one and the same word is that word.
    stems = set()
    for stem in least - whole:
        as_word = [g for g in telling if g.endswith("$") and g.startswith(stem) and toxic[g].n >= 0.9 * toxic[stem].n]
        if as_word:
            whole.update(as_word)
        else:
            stems.add(stem)
    model = Model(frozenset(g[:-1] for g in whole), frozenset(stems), frozenset(hints))

    def observed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = Counter(
                (tuple(model.features(text)), int(label == 1))
                for text, label in zip(tokens.texts(batch["text"]), batch["toxic"].to_pylist())
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([list(f) for f, _ in seen], pa.list_(pa.float64())),
                    pa.array([y for _, y in seen], pa.int32()),
                    pa.array(list(seen.values()), pa.int64()),
                ],
                names=["features", "toxic", "n"],
            )

    seen = train.mapInArrow(observed, "features array<double>, toxic int, n bigint").collect()
    if seen:
        features = np.repeat(np.array([x["features"] for x in seen]), [x["n"] for x in seen], axis=0)
        labels_ = np.repeat([float(x["toxic"]) for x in seen], [x["n"] for x in seen])
        return Model(model.words, model.stems, model.hints, _logistic(features, labels_))
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score, clauses)``; ``clauses`` holds ``(start, end, events, score)`` of matched clauses."""
    fields = [("start", pa.int64()), ("end", pa.int64()), ("events", pa.list_(pa.string())), ("score", pa.float64())]
    kind = pa.list_(pa.struct(fields))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.parts(batch):
                weights, reach, found = [], [], []
                for text in tokens.texts(part["text"]):
                    paths = list(model.paths(text))
                    weights.append(sum(x for _, _, _, x in paths))
                    reach.append(model.reach(text, sum((c for _, _, c, _ in paths), Counter())))
                    found.append([{"start": a, "end": b, "events": sorted(c), "score": x} for a, b, c, x in paths])
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(model.scores(np.array(weights, float), np.array(reach, float))), pa.array(found, kind)],
                    names=["doc_id", "score", "clauses"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        rows,
        "doc_id bigint, score double, clauses array<struct<start: bigint, end: bigint, events: array<string>, score: double>>",
    )
