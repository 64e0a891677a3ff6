"""Toxicity by a weighted finite-state grammar over clauses; lexicon and weights are learned from labels."""

from __future__ import annotations

import math
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamlens.llm.common import text_bytes
from streamlens.llm.fit import fit_logistic, margin

#: Labelled documents that lexicon and weights are learned from at most: toxic and other ones.
TOXIC_SAMPLE, OTHER_SAMPLE = 4_000, 8_000
#: Prefix lengths that may become stems of the lexicon, and how many terms it may have.
STEMS, MAX_TERMS = (4, 5, 6, 7, 8), 20_000
#: Evidence (likelihood ratio statistic) that a term needs.
MIN_EVIDENCE = 20.0

# Word classes of the grammar in the languages of the corpus; insults are learned.
TARGETS = ("you", "your", "yours", "youre", "u", "he", "she", "they", "him", "her", "them", "du", "dich", "dir", "dein", "sie", "ihr", "tu", "toi",
           "te", "vous", "votre", "ton", "ta", "il", "elle", "usted", "ustedes", "ti", "tus")
NEGATIONS = ("not", "no", "never", "isnt", "arent", "dont", "nobody", "nicht", "kein", "keine", "nie", "pas", "jamais", "aucun", "nunca", "ni")
REPORTS = ("said", "says", "say", "wrote", "writes", "called", "quote", "quoted", "claims", "claimed", "reported", "sagte", "schrieb", "dit", "dijo", "escribió", "écrit")
INTENTS = ("will", "gonna", "going", "shall", "should", "must", "werde", "wird", "vais", "va", "voy")
HARMS = ("kill", "hurt", "die", "beat", "destroy", "shoot", "stab", "punch", "burn", "hang", "murder", "töten", "sterben", "tuer", "mourir", "matar", "morir")

OTHER, INSULT, HARM, INTENT, TARGET, NEGATION, REPORT, STOP = range(8)
_FIXED = {w.encode(): c for c, words in ((HARM, HARMS), (INTENT, INTENTS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words}

# a-z, 0-9 and bytes from 0x80 make words (A-Z lower-cased); clause marks become a full stop, quotation marks a report.
_MAP = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 46 if b in b".!?;:\n" else 34 if b == 34 else 32 for b in range(256))


class Transducer(NamedTuple):
    """A deterministic transducer: ``step[state][symbol]`` is (next state, output); state 0 starts every clause."""

    step: tuple[tuple[tuple[int, str], ...], ...]


def transducer(n_states: int, arcs: dict[tuple[int, int], tuple[int, str]]) -> Transducer:
    """Arcs not given stay in their state with no output; STOP goes back to state 0."""
    return Transducer(tuple(
        tuple(arcs.get((s, c), (0, "") if c == STOP else (s, "")) for c in range(8)) for s in range(n_states)))


#: An insult puts out a match.
INSULTS = transducer(1, {(0, INSULT): (0, "insult")})
#: An intent, with anything between, followed by a harm is a threat; a harm without one is none.
THREATS = transducer(2, {(0, INTENT): (1, ""), (1, HARM): (0, "threat")})
#: Whether a target came before in the clause.
TARGETED = transducer(2, {(0, TARGET): (1, ""), (1, INSULT): (1, "aimed"), (1, HARM): (1, "aimed")})
#: A negation holds for the next three words.
NEGATED = transducer(4, {
    **{(s, NEGATION): (3, "") for s in range(4)},
    **{(s, c): (s - 1, "negated" if c in (INSULT, HARM) else "") for s in (1, 2, 3) for c in (OTHER, INSULT, HARM, INTENT, TARGET, REPORT)}})
#: After a verb of speech or a quotation mark the clause is reported.
REPORTED = transducer(2, {(0, REPORT): (1, ""), (1, INSULT): (1, "reported"), (1, HARM): (1, "reported")})


def compose(*parts: Transducer) -> tuple[list[list[int]], list[list[frozenset]]]:
    """The product machine: next state and set of outputs by state and symbol, over the states that can be reached."""
    start = (0,) * len(parts)
    number, queue, to, out = {start: 0}, [start], [], []
    for state in queue:
        row_to, row_out = [], []
        for c in range(8):
            moves = [p.step[s][c] for p, s in zip(parts, state)]
            after = tuple(m[0] for m in moves)
            if after not in number:
                number[after] = len(number)
                queue.append(after)
            row_to.append(number[after])
            row_out.append(frozenset(m[1] for m in moves if m[1]))
        to.append(row_to)
        out.append(row_out)
    return to, out


_TO, _OUT = compose(INSULTS, THREATS, TARGETED, NEGATED, REPORTED)
#: What outputs do to the weight of a match.
FACTORS = {"aimed": 1.5, "negated": 0.25, "reported": 0.5}
THREAT_WEIGHT = 3.0
_FACTOR = {o: math.prod(FACTORS[x] for x in o if x in FACTORS) for o in {x for row in _OUT for x in row}}

FEATURES = ("strongest", "total", "clauses", "density", "threats")


def clause_words(text: bytes) -> list[bytes]:
    return text.translate(_MAP).replace(b".", b" . ").replace(b'"', b' " ').split()


class Grammar:
    """Classes of words, remembered for each distinct word, and the scores of clauses."""

    def __init__(self, lexicon: dict[str, float]):
        self.whole = {t[1:].encode(): w for t, w in lexicon.items() if t[0] == "="}
        self.stems = {t[1:]: w for t, w in lexicon.items() if t[0] == "^"}
        self.seen: dict[bytes, tuple[int, float]] = {}

    def _look(self, word: bytes) -> tuple[int, float]:
        if word == b".":
            return STOP, 0.0
        if word == b'"':
            return REPORT, 0.0
        if word in _FIXED:
            return _FIXED[word], 0.0
        w = self.whole.get(word, 0.0)
        if len(word) >= STEMS[0]:
            t = word.decode("utf-8", "replace")
            for n in STEMS:
                if n <= len(t):
                    w = max(w, self.stems.get(t[:n], 0.0))
        return (INSULT, w) if w > 0 else (OTHER, 0.0)

    def features(self, text: bytes) -> tuple[float, ...]:
        """FEATURES of a text: the strongest clause, log of all clauses' weights, of matched clauses, per word, and threats."""
        words = clause_words(text)
        seen = self.seen
        if len(seen) > 500_000:
            seen.clear()
        for w in set(words).difference(seen):
            seen[w] = self._look(w)
        codes = bytes([seen[w][0] for w in words])
        if INSULT not in codes and HARM not in codes:
            return (0.0,) * len(FEATURES)
        best, total, clauses, threats, at = 0.0, 0.0, 0, 0, 0
        for clause in codes.split(bytes([STOP])):
            if INSULT in clause or HARM in clause:
                state, sum_ = 0, 0.0
                for k, c in enumerate(clause):
                    out = _OUT[state][c]
                    if out:
                        weight = seen[words[at + k]][1] if "insult" in out else THREAT_WEIGHT if "threat" in out else 0.0
                        sum_ += weight * _FACTOR[out]
                        threats += "threat" in out
                    state = _TO[state][c]
                if sum_:
                    best, total, clauses = max(best, sum_), total + sum_, clauses + 1
            at += len(clause) + 1
        return best, math.log1p(total), math.log1p(clauses), total / len(words), math.log1p(threats)


# -- learning --------------------------------------------------------------------------------------------------
def training_rows(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC_SAMPLE, other: int = OTHER_SAMPLE) -> tuple[DataFrame, dict[int, float]]:
    """(id, y, text) of the labelled documents to learn from and the weight of a row of each label. Of documents whose
    crc32(doc_id as text) mod 5 is not 0, those of least hash, at most ``toxic`` and ``other`` of them."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    known = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("y"))
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    some = known.where("y = 1").orderBy(F.xxhash64("id"), "id").limit(toxic).union(known.where("y = 0").orderBy(F.xxhash64("id"), "id").limit(other))
    weight = {1: max(1.0, n.get(1, 0) / toxic), 0: max(1.0, n.get(0, 0) / other)}
    return docs.join(F.broadcast(some), F.col("doc_id").cast("long") == F.col("id")).select("id", "y", text_bytes().alias("text")), weight


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Terms (=word or ^stem) that speak for the label, with their log odds, from document frequencies in both labels."""
    def count(batches):
        tally = [Counter(), Counter()]
        docs = [0, 0]
        for batch in batches:
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                docs[y] += 1
                terms = set()
                for w in set(clause_words(t.as_py() or b"")):
                    if len(w) > 2 and w not in _FIXED:
                        s = w.decode("utf-8", "replace")
                        terms.add("=" + s)
                        terms.update("^" + s[:n] for n in STEMS if n < len(s))
                tally[y].update(terms)
            if len(tally[0]) > 1_000_000:
                yield part(tally)
                tally = [Counter(), Counter()]
        tally[0][""], tally[1][""] = docs
        yield part(tally)

    def part(tally):
        terms = list(tally[0] | tally[1])
        return pa.RecordBatch.from_arrays([pa.array(terms), *(pa.array([t[x] for x in terms], pa.int64()) for t in tally)], ["term", "neg", "pos"])

    counts = rows.select("y", "text").mapInArrow(count, "term string, neg long, pos long").groupBy("term").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    total = counts.where("term = ''").select(F.col("neg").alias("n"), F.col("pos").alias("p"))
    both = counts.where("term <> '' and pos >= 3").crossJoin(F.broadcast(total))
    log = lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(F.lit(0.0))
    share = (F.col("pos") + F.col("neg")) / (F.col("p") + F.col("n"))
    g2 = 2 * (log(F.col("pos").cast("double"), F.col("p") * share) + log(F.col("neg").cast("double"), F.col("n") * share))
    odds = F.log((F.col("pos") + 0.5) / (F.col("p") + 1)) - F.log((F.col("neg") + 0.5) / (F.col("n") + 1))
    best = both.select("term", g2.alias("g"), odds.alias("w")).where((F.col("g") >= MIN_EVIDENCE) & (F.col("w") >= math.log(10)))
    return {r["term"]: float(r["w"]) for r in best.orderBy(F.desc("w"), "term").limit(MAX_TERMS).collect()}


def fit(docs: DataFrame, labels: DataFrame):
    """(lexicon, weights of FEATURES): from one half of the training rows the lexicon, from the other the weights, so that
    words which are in the lexicon by chance weigh nothing; with under 200 toxic rows both from all. None without labels."""
    rows, weight = training_rows(docs, labels)
    rows = rows.persist()
    try:
        toxic = rows.where("y = 1").count()
        if not toxic or not rows.where("y = 0").limit(1).count():
            return None
        half = F.xxhash64(F.col("id"), F.lit(7)) % 2 == 0 if toxic >= 200 else F.lit(True)
        other = F.xxhash64(F.col("id"), F.lit(7)) % 2 != 0 if toxic >= 200 else F.lit(True)
        lexicon = learn_lexicon(rows.where(half))
        found = rows.where(other).mapInArrow(_featurise(lexicon), "id long, y int, " + ", ".join(f"{c} double" for c in FEATURES)).toPandas()
    finally:
        rows.unpersist()
    found = found.sort_values(["id", *FEATURES])
    y = found["y"].to_numpy(float)
    if len(set(y)) < 2:
        return None
    w = np.where(y == 1, weight[1], weight[0])
    return lexicon, fit_logistic(found[list(FEATURES)].to_numpy(), y, w, ridge=1e-2)


def _featurise(lexicon):
    def run(batches):
        grammar = Grammar(lexicon)
        for batch in batches:
            x = np.array([grammar.features(t.as_py() or b"") for t in batch.column(batch.num_columns - 1)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(x[:, i]) for i in range(len(FEATURES)))], [*batch.schema.names[:-1], *FEATURES])

    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted and the FEATURES of every row of docs.

    Words get a class by learned insults (whole words and stems) and short lists of targets, negations, verbs of speech,
    intents and harms. The composed transducer reads every clause of the whole text once: a match weighs its log odds, times
    1.5 if aimed at a target named before, 0.25 if negated, 0.5 if reported. The weights of these features, and the lexicon, are
    learned from a bounded sample of labelled rows that are not held out. Null and empty texts match nothing and get the
    score of no match; without labels of both kinds the score is 0.5 for a match and 0 otherwise. Rows are scored each; a null
    doc_id is not held out. No shuffle.
    """
    made = fit(docs, labels)
    lexicon, model = made or ({}, None)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        for batch in _featurise(shared.value)(batches):
            x = np.column_stack([batch.column(1 + i).to_numpy() for i in range(len(FEATURES))])
            p = 1 / (1 + np.exp(-margin(x, model))) if model is not None else np.where(x[:, 0] > 0, 0.5, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), *batch.columns[1:]], ["doc_id", "score", *FEATURES])

    out = docs.select(F.col("doc_id").cast("long"), text_bytes()).mapInArrow(run, "doc_id long, score double, " + ", ".join(f"{c} double" for c in FEATURES))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.withColumns({"held_out": held, "predicted": (F.col("score") >= 0.5).cast("int")})
