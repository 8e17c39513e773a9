"""Mixing to target weights with soft membership.

A naive Bayes classifier, fitted on a bounded sample of labelled rows, gives every document
posteriors over the domains. Nonnegative rates are then fitted so that the expected tokens of
each domain, sum(rate * tokens * posterior), come to its target: projected gradient on the
squared misfit, each domain scaled by its tokens and each document by its length, for which
step 1 never overshoots. Steps go in rounds of one aggregate over the table; what it gives, a few
numbers per domain, is all that reaches the driver, and a document's rate follows from its posteriors and
these numbers alone. So the fitted mixture is a column expression, and no join is needed.

DataFrame functions only. ``targets`` names the domains and their shares; labelled rows of
other or null domains, or without a document, count for nothing; without any labelled row all
posteriors are equal. Null and empty texts have no tokens and get the prior; repeated rows
count each; an empty table gives rates of 1 to nobody. Extra columns are ignored."""

from __future__ import annotations

from dataclasses import dataclass, field
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import stage

#: At most so many labelled rows, those of the smallest hashes, fit the classifier; every
#: fourth of them sets the temperature instead.
LABELLED = 20_000
SMOOTHING = 1.0
#: A feature speaks for or against a domain if it is off its expected count by so many
#: deviations; of each domain the MOST_FEATURES clearest are kept, in a table of SLOTS.
CLEAR, MOST_FEATURES, SLOTS = 5.0, 500, 1 << 14
TEMPERATURES = (0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0)
STEPS, ROUNDS, TOLERANCE, TOGETHER = 16, 12, 1e-4, 6
SEED = 11


#: Shares of tokens by domain of the given labels.
TARGETS = {"good": 0.84, "poor": 0.08, "toxic": 0.08}


def domains(labels: DataFrame) -> DataFrame:
    """doc_id, domain of rows labelled by quality and toxic."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return labels.select("doc_id", domain.alias("domain"))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _features(words: str) -> str:
    """Distinct hashes of the words in lower case without punctuation around them, of the
    characters they end with, and of how much of the text repeats earlier words."""
    return (
        f"array_distinct(concat(transform({words}, w -> xxhash64(trim(BOTH '.,;:!?' FROM lower(w)))), "
        f"transform({words}, w -> xxhash64('end', right(w, 1))), "
        f"array(xxhash64('fresh', CAST(10 * size(array_distinct({words})) / greatest(1, size({words})) AS INT)))))"
    )


def _numbers(values: list, kind: str = "double") -> str:
    """A constant array: one text that is folded once, not thousands of literals."""
    return f"from_json('[{','.join(map(repr, values))}]', 'array<{kind}>')"


@dataclass
class Mixture:
    """``slots``: the feature that owns each slot, or 0; ``weights``: per domain the log
    likelihood ratio by slot; ``pulls``: per step a number per domain."""

    domains: list[str]
    priors: list[float]
    slots: list[int]
    weights: list[list[float]]
    temperature: float = 1.0
    pulls: list[list[float]] = field(default_factory=list)

    def posteriors(self, docs: DataFrame, *keep: str) -> DataFrame:
        """``keep``, n_tokens and _p, an array with a posterior per domain."""
        rows = docs.select(*keep, _words(F.col("text")).alias("_words"))
        rows = rows.select(*keep, F.size("_words").cast("long").alias("n_tokens"), F.expr(_features("_words")).alias("_features"))
        rows = rows.select(*keep, "n_tokens", F.expr(self.evidence()).alias("_p"))
        rows = rows.withColumn("_p", F.expr(f"transform(_p, (x, i) -> x / {self.temperature}D + {_numbers([log(p) for p in self.priors])}[i])"))
        rows = rows.withColumn("_p", F.expr("transform(_p, x -> exp(x - array_max(_p)))"))
        return rows.withColumn("_p", F.expr("transform(_p, x -> x / aggregate(_p, 0D, (s, y) -> s + y))"))

    def evidence(self) -> str:
        """Of a row with _features: the sum of log likelihood ratios per domain."""
        slot = f"CAST(pmod(f, {SLOTS}) AS INT)"
        known = f"transform(filter(_features, f -> {_numbers(self.slots, 'bigint')}[{slot}] = f), f -> {slot})"
        return f"array({', '.join(f'aggregate({known}, 0D, (s, f) -> s + {_numbers(w)}[f])' for w in self.weights)})"

    def rate(self) -> Column:
        """Of a row with _p: 1, moved by every step, never below 0."""
        if not self.pulls:
            return F.lit(1.0)
        pulls = "[" + ",".join(f"[{','.join(repr(x) for x in pull)}]" for pull in self.pulls) + "]"
        return F.expr(f"aggregate(from_json('{pulls}', 'array<array<double>>'), 1D, (r, x) -> {self._moved('r', [f'x[{d}]' for d in range(len(self.domains))])})")

    def _moved(self, rate: str, pull: list[str]) -> str:
        return f"greatest(0D, {rate} + {' + '.join(f'_p[{d}] * {x}' for d, x in enumerate(pull))})"


def fit_classifier(docs: DataFrame, labels: DataFrame, domains: list[str], labelled: int = LABELLED) -> Mixture:
    """``labels``: doc_id, domain."""
    known = labels.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).select("doc_id", "domain")
    sample = known.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id", "domain").limit(labelled)
    texts = docs.select("doc_id", "text").join(F.broadcast(stage(sample)), "doc_id")  # at most ``labelled`` rows
    rows = texts.select("doc_id", "domain", _words(F.col("text")).alias("_words"))
    rows = stage(rows.select("doc_id", "domain", F.expr(_features("_words")).alias("_features")))
    fit, check = (rows.where(c) for c in ("pmod(xxhash64(doc_id), 4) <> 0", "pmod(xxhash64(doc_id), 4) = 0"))
    total = {r["domain"]: r["n"] for r in fit.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    everyone = sum(total.values())
    priors = [(total.get(d, 0) + 1) / (everyone + len(domains)) for d in domains]
    own = {d: f"CAST(n{i} AS DOUBLE)" for i, d in enumerate(domains)}
    counts = fit.select("domain", F.explode("_features").alias("f")).groupBy("f").agg(
        *[F.count_if(F.col("domain") == d).alias(f"n{i}") for i, d in enumerate(domains)]
    )
    share = f"(({' + '.join(own.values())}) / {max(1, everyone)})"
    ratios = [f"ln(({c} + {SMOOTHING}) / ({total.get(d, 0)} * {share} + {SMOOTHING}))" for d, c in own.items()]
    clear = [f"abs({c} - {total.get(d, 0)} * {share}) / sqrt({total.get(d, 0)} * {share} + 1)" for d, c in own.items()]
    counts = stage(counts.selectExpr("f", f"array({', '.join(ratios)}) AS w", f"array({', '.join(clear)}) AS z"))
    slots, weights = [0] * SLOTS, [[0.0] * SLOTS for _ in domains]
    best: dict[int, float] = {}
    for i in range(len(domains)):  # a bounded number of features a domain
        for r in counts.where(F.col("z")[i] > CLEAR).orderBy(F.col("z")[i].desc(), "f").limit(MOST_FEATURES).collect():
            at, z = r["f"] % SLOTS, max(r["z"])
            if z > best.get(at, 0):
                best[at], slots[at] = z, r["f"]
                for d, w in enumerate(r["w"]):
                    weights[d][at] = w
    return _tempered(Mixture(domains, priors, slots, weights), check)


def _tempered(mixture: Mixture, check: DataFrame) -> Mixture:
    """With the temperature of least log loss on rows that the fit has not seen."""
    rows = check.select("domain", F.expr(mixture.evidence()).alias("s"))
    priors = f"array({', '.join(f'{log(p)!r}D' for p in mixture.priors)})"
    place = f"array_position(array({', '.join(repr(d) for d in mixture.domains)}), domain) - 1"
    logits = [F.expr(f"transform(s, (x, i) -> x / {t}D + {priors}[i])").alias(f"t{k}") for k, t in enumerate(TEMPERATURES)]
    rows = rows.select("*", *logits)
    loss = "sum(ln(aggregate(transform({0}, x -> exp(x - array_max({0}))), 0D, (a, b) -> a + b)) + array_max({0}) - {0}[CAST({1} AS INT)])"
    losses = [F.expr(loss.format(f"t{k}", place)) for k in range(len(TEMPERATURES))]
    loss = rows.agg(*losses).first()
    if loss[0] is not None:
        mixture.temperature = min(zip(loss, TEMPERATURES))[1]
    return mixture


def combined_pull(short: list[float], tokens: list[float], overlap: list[list[float]], steps: int = STEPS) -> list[float]:
    """What ``steps`` gradient steps add up to while the same rates stay above 0. ``overlap``:
    per pair of domains the tokens that those documents share between them."""
    left, total = list(short), [0.0] * len(short)
    for _ in range(steps):
        step = [x / max(n, 1e-9) for x, n in zip(left, tokens)]
        total = [t + x for t, x in zip(total, step)]
        left = [x - sum(o * y for o, y in zip(row, step)) for x, row in zip(left, overlap)]
    return total


def fit_rates(rows: DataFrame, mixture: Mixture, targets: dict[str, float], epochs: float = 1.0, rounds: int = ROUNDS) -> Mixture:
    """Rounds of projected gradient over a staged table with n_tokens and _p, until all
    domains are within TOLERANCE of their targets: shares of ``epochs`` times all tokens. A
    round looks at the table once, for the misfit and the overlap of the domains; the steps
    until rates reach 0 follow from these, and then rates are cut off at 0. They are written
    every TOGETHER rounds."""
    k = range(len(mixture.domains))
    share = [targets[d] / sum(targets.values()) for d in mixture.domains]
    rows, rate = rows.select("n_tokens", "_p", F.lit(1.0).alias("_rate")), "_rate"

    def look() -> tuple[list[float], list[list[float]]]:
        at = rows.selectExpr("n_tokens", "_p", f"{rate} AS _r")
        reached = [F.expr(f"sum(n_tokens * _p[{d}] * _r)") for d in k]
        shared = [F.expr(f"sum(IF(_r > 0, n_tokens * _p[{d}] * _p[{e}], 0D))") for d in k for e in k]
        found = [x or 0.0 for x in at.agg(*reached, *shared).first()]
        return found[: len(k)], [found[len(k) * (d + 1) : len(k) * (d + 2)] for d in k]

    reached, overlap = look()
    tokens, total = reached, sum(reached) * epochs
    for number in range(1, rounds + 1):
        short = [s * total - r for s, r in zip(share, reached)]
        if all(abs(x) <= TOLERANCE * s * total for x, s in zip(short, share)):
            break
        mixture.pulls.append(combined_pull(short, tokens, overlap))
        rate = mixture._moved(rate, [f"({x!r}D)" for x in mixture.pulls[-1]])
        if number % TOGETHER == 0:
            rows, rate = stage(rows.withColumn("_rate", F.expr(rate))), "_rate"
        reached, overlap = look()
    return mixture


def fit(docs: DataFrame, labels: DataFrame, targets: dict[str, float], epochs: float = 1.0) -> tuple[Mixture, DataFrame]:
    """The mixture, and doc_id, n_tokens, _p of every row, staged."""
    if not targets or any(t <= 0 for t in targets.values()):
        raise ValueError("targets must be positive shares")
    mixture = fit_classifier(docs, labels, sorted(targets))
    rows = stage(mixture.posteriors(docs, "doc_id"))
    return fit_rates(rows, mixture, targets, epochs), rows


def mix_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float], epochs: float = 1.0) -> DataFrame:
    """doc_id, n_tokens, p_<domain>, rate of every row."""
    mixture, rows = fit(docs, labels, targets, epochs)
    shares = [F.col("_p")[d].alias(f"p_{name}") for d, name in enumerate(mixture.domains)]
    return rows.select("doc_id", "n_tokens", *shares, mixture.rate().alias("rate"))


def resample(docs: DataFrame, labels: DataFrame, targets: dict[str, float], epochs: float = 1.0, seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as its rate says: the whole part for certain, the
    rest by a draw that depends on doc_id, text and seed alone."""
    mixture, _ = fit(docs, labels, targets, epochs)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = mixture.posteriors(docs.select(row, "text", F.xxhash64("doc_id", "text", F.lit(seed)).alias("_draw")), "_row", "_draw")
    copies = F.floor(mixture.rate() + F.pmod("_draw", F.lit(1 << 30)) / F.lit(float(1 << 30)))
    return rows.select("_row", F.explode(F.sequence(F.lit(0), copies)).alias("_copy")).where("_copy > 0").select("_row.*")
