"""Toxicity by a weighted finite-state grammar of clauses.

A text is read clause by clause (up to a stop, question or exclamation mark, semicolon or line end).
Transducers, composed into one machine, read the classes of a clause's words:

1. the lexicon turns words into classes: insult, threat, target, negation, report, other;
2. negation marks an insult or threat that follows it within three words;
3. reported speech marks what follows a verb of saying in its clause;
4. the target transducer notes whether someone is addressed, and passes on the gravest finding.

The state at the clause's end names a pattern, such as "insult, addressed, not negated, not
reported". A document's score is the logistic of a bias and, for each pattern, its weight times the
logarithm (base 2) of 1 + its number of clauses. Weights start from fixed priors and are fitted to labelled
documents; the insult class takes in stems that they show to be insulting. Both use at most
``PER_CLASS`` documents of each label. Scoring reads all clauses of all texts.

Defined results: null, empty and harmless texts get the score of a text without findings; repeated
rows score alike; without labels the priors hold; an empty table gives no rows;
texts of any length are read whole; an input column named like a result column is left out in favour
of the result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, table, without
from .labelled import sample

#: Documents of each label to learn from, at most.
PER_CLASS = 2000
#: A stem (beginning of words, of so many letters) is learned as an insult if it tells this share of
#: the toxic documents beyond the stems before it, and this share of the documents with it are toxic.
STEMS, GAIN, PRECISION, MIN_DOCS = (4, 10), 0.002, 0.95, 4
#: Stems that are tried: those in most toxic documents.
TRIED = 3000
THRESHOLD = 0.7
# Seed words of each class, lower case, in English, German, French and Spanish.
LEXICON = {
    "insult": "idiot idiots moron morons imbecile stupid dumb fool loser losers pathetic scum worthless trash garbage clown disgusting filth vermin bastard bitch asshole jerk retard creep freak coward idiotin dummkopf blödmann trottel arschloch abschaum versager widerlich erbärmlich wertlos imbécile crétin débile connard salaud ordure minable abruti dégoûtant estúpido imbécil tonto basura asqueroso patético cabrón inútil escoria payaso".split(),
    "threat": "kill murder destroy hurt strangle stab beat shoot burn crush töten umbringen vernichten verletzen schlagen erschießen tuer détruire frapper égorger brûler matar destruir golpear apuñalar quemar".split(),
    "target": "you your yours yourself u he she they them him her those these all du dich dir dein deine ihr euch sie er tu toi te vous votre ton ils elles lui tú ti tus usted ustedes ellos ellas él ella".split(),
    "negation": "not no never n't isn't aren't wasn't don't doesn't without hardly nicht kein keine nie niemals ohne ne pas jamais aucun sans nunca jamás sin tampoco".split(),
    "report": "said says say claimed claims wrote writes quoted quote called according reportedly alleged sagte sagt behauptet schrieb nannte laut dit affirme écrit selon déclaré dijo dice afirma escribió llamó según".split(),
}
#: Prior weight of a pattern: that of its finding, and what being addressed, negated, reported adds.
PRIORS = {"insult": 3.0, "threat": 1.0, "addressed": 0.5, "negated": -1.2, "reported": -0.8}
BIAS, RIDGE = -2.0, 0.002
#: Words within which a negation holds.
REACH = 3
BREAK = re.compile(r"[.!?;\n]")
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")

Arcs = dict[tuple[object, object], tuple[object, object]]


def negation() -> tuple[object, Arcs, list]:
    """Reads classes, writes (class, negated)."""
    arcs: Arcs = {}
    for left in range(REACH + 1):
        for c in ("insult", "threat"):
            arcs[left, c] = (max(0, left - 1), (c, left > 0))
        for c in ("target", "report", "other"):
            arcs[left, c] = (max(0, left - 1), (c, False))
        arcs[left, "negation"] = (REACH, ("other", False))
    return 0, arcs, ["insult", "threat", "target", "report", "other", "negation"]


def reported(inputs: list) -> tuple[object, Arcs, list]:
    """Reads (class, negated), writes (class, negated, reported)."""
    arcs: Arcs = {}
    for after in (False, True):
        for c, negated in inputs:
            arcs[after, (c, negated)] = (after or c == "report", ("other" if c == "report" else c, negated, after and c in ("insult", "threat")))
    return False, arcs, inputs


def addressed(inputs: list) -> tuple[object, Arcs, list]:
    """Holds whether a target was read, and the gravest finding so far; that state is the pattern."""
    findings = sorted({i for i in inputs if i[0] in ("insult", "threat")}, key=grave)
    arcs: Arcs = {}
    for target in (False, True):
        for best in (None, *findings):
            for i in inputs:
                new = i if i in findings and (best is None or grave(i) > grave(best)) else best
                arcs[(target, best), i] = ((target or i[0] == "target", new), None)
    return (False, None), arcs, inputs


def grave(finding: tuple) -> float:
    c, negated, told = finding
    return PRIORS[c] + PRIORS["negated"] * negated + PRIORS["reported"] * told


def compose(first: tuple[object, Arcs, list], second: tuple[object, Arcs, list]) -> tuple[object, Arcs, list]:
    """The machine that feeds what ``first`` writes to ``second``; only states that can be reached."""
    start, arcs = (first[0], second[0]), {}
    todo, seen = [start], {start}
    while todo:
        p, q = state = todo.pop()
        for x in first[2]:
            p2, y = first[1][p, x]
            q2, z = second[1][q, y]
            arcs[state, x] = ((p2, q2), z)
            if (p2, q2) not in seen:
                seen.add((p2, q2))
                todo.append((p2, q2))
    return start, arcs, first[2]


def grammar() -> tuple[np.ndarray, list, np.ndarray]:
    """The composed machine as a table (state, class) -> state; the classes; each state's pattern, or -1."""
    one = negation()
    between = sorted({y for _, y in one[1].values()})
    two = reported(between)
    three = addressed(sorted({y for _, y in two[1].values()}))
    start, arcs, classes = compose(compose(one, two), three)
    states = [start, *sorted({s for s, _ in arcs} - {start}, key=repr)]
    number = {s: i for i, s in enumerate(states)}
    step = np.array([[number[arcs[s, c][0]] for c in classes] for s in states])
    known = {p: i for i, p in enumerate(patterns())}
    ends = np.array([known.get((s[1][1], s[1][0]), -1) for s in states])
    return step, classes, ends


def patterns() -> list[tuple[tuple, bool]]:
    """(class, negated, reported), addressed: in order."""
    return [((c, n, r), a) for c in ("insult", "threat") for n in (False, True) for r in (False, True) for a in (False, True)]


def priors() -> np.ndarray:
    return np.array([max(0.2, grave(f) + PRIORS["addressed"] * a) for f, a in patterns()])


class Reader:
    """Counts patterns. Only clauses with an insult or threat are read word by word."""

    def __init__(self, stems: list[str]) -> None:
        self.step, classes, self.ends = grammar()
        code = {c: i for i, c in enumerate(classes)}
        self.other, self.insult = code["other"], code["insult"]
        self.word = {w: code[c] for c in ("report", "negation", "target", "threat", "insult") for w in LEXICON[c]}
        self.stems = sorted(stems)
        self.lengths = sorted({len(w) for w in stems})
        self.known = set(stems)
        self.grave = ahocorasick.Automaton()
        for w in {*LEXICON["insult"], *LEXICON["threat"], *stems}:
            self.grave.add_word(w, (len(w), w in self.known))
        self.grave.make_automaton()

    def classed(self, word: str) -> int:
        found = self.word.get(word)
        if found is None or found == self.other:
            return self.insult if any(word[:n] in self.known for n in self.lengths) else self.other
        return found

    def __call__(self, text: str) -> np.ndarray:
        counts = np.zeros(len(patterns()))
        text = text.lower()
        done = -1
        for end, (length, stem) in self.grave.iter(text):
            start = end - length + 1
            if start < done or (start and text[start - 1].isalnum()) or (not stem and end + 1 < len(text) and text[end + 1].isalnum()):
                continue
            a = max(text.rfind(c, max(done, 0), start) for c in ".!?;\n") + 1
            stop = BREAK.search(text, end + 1)
            done, begin = (stop.start() if stop else len(text)), max(a, done, 0)
            state = 0
            for w in WORD.findall(text, begin, done):
                state = self.step[state, self.classed(w)]
            if self.ends[state] >= 0:
                counts[self.ends[state]] += 1
        return counts


def _counted(stems: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(stems)
        for batch in batches:
            counts = [reader(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.list_(pa.float64()))], ["label", "counts"])

    return run


def learn_stems(texts: DataFrame) -> list[str]:
    """Beginnings of words that tell toxic documents, each beyond the seeds and the stems before it.

    ``texts`` is a bounded sample, and ``TRIED`` bounds what of it comes to the driver.
    """
    low, high = STEMS
    words = F.filter(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")), lambda w: F.length(w) >= low)
    stems = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(low), F.least(F.lit(high), F.length(w))), lambda n: F.substring(w, F.lit(1), n))))
    rows = texts.select("key", "label", F.explode(F.array_distinct(stems)).alias("stem"))
    seen = rows.groupBy("stem").agg(F.sum("label").alias("toxic"), F.count("*").alias("docs"))
    seeded = texts.where("label = 1").select("key", F.arrays_overlap(words, F.array(*[F.lit(w) for w in LEXICON["insult"]])).alias("seeded"))
    left = seeded.where(~F.col("seeded")).select("key")
    likely = seen.where((F.col("toxic") >= MIN_DOCS) & (F.col("toxic") >= F.col("docs") * PRECISION)).select("stem")
    told = rows.where("label = 1").join(F.broadcast(left), "key").join(likely, "stem").select("stem", "key")
    most = told.groupBy("stem").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "stem").limit(TRIED).select("stem")
    found = told.join(F.broadcast(most), "stem").toArrow()
    holds: dict[str, set] = {}
    for w, k in zip(found.column("stem").to_pylist(), found.column("key").to_pylist(), strict=True):
        holds.setdefault(w, set()).add(k)
    least = max(MIN_DOCS, GAIN * texts.where("label = 1").count())
    chosen: list[str] = []
    while holds:
        # Of stems that tell equally many, the longest says most.
        best = max(sorted(holds), key=lambda w: (len(holds[w]), len(w)))
        new = holds.pop(best)
        if len(new) < least:
            break
        chosen.append(best)
        holds = {w: k - new for w, k in holds.items()}
    return chosen


def fit(texts: DataFrame) -> dict:
    """Stems, bias and weights from a bounded sample (key, label, text)."""
    texts = texts.cache()
    try:
        stems = learn_stems(texts)
        rows = texts.select("label", "text").mapInArrow(_counted(stems), "label int, counts array<double>").toArrow()
    finally:
        texts.unpersist()
    y = rows.column("label").to_numpy().astype(np.float64)
    prior = np.concatenate(([BIAS], priors()))
    w = prior.copy()
    if len(y) and 0 < y.sum() < len(y):
        x = np.log2(1.0 + np.array(rows.column("counts").to_pylist()))
        x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
        weight = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
        for _ in range(50):  # Newton steps on the penalised likelihood
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient = x.T @ (weight * (p - y)) / len(y) + RIDGE * (w - prior)
            hessian = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x / len(y) + RIDGE * np.eye(len(w))
            step = np.linalg.solve(hessian, gradient)
            w -= step
            if np.abs(step).max() < 1e-9:
                break
        w[1:] = np.maximum(w[1:], 0.0)
    return {"stems": stems, "weights": w}


def _scorer(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, w = Reader(model["stems"]), model["weights"]
        for batch in batches:
            counts = np.array([reader(t or "") for t in batch.column(1).to_pylist()]).reshape(len(batch), -1)
            score = 1 / (1 + np.exp(-np.clip(np.log2(1.0 + counts) @ w[1:] + w[0], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["row", "score", "predicted"])

    return run


def toxicity(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """The rows with ``score`` and ``predicted``."""
    kept = without(docs, ("score", "predicted"))
    row = F.struct(*kept) if kept else F.struct(F.lit(0).alias("none"))
    rows = docs.select(row.alias("row"), F.col(text).cast("string").alias("text"))
    out = rows.mapInArrow(_scorer(model), T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
    return out.select(*(["row.*"] if kept else []), "score", "predicted")


def op2_toxic_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    model = fit(sample(docs, table(spark, sf_dir, "labels"), "toxic", held_out, PER_CLASS))
    return toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
