"""Mixing domains to target weights with soft membership, in DataFrame functions only.

1. A labelled table (id, domain) teaches a classifier: Spark counts tokens by
   domain, the most telling ones are the vocabulary, and a multinomial logistic
   model of their presence is fitted to the labelled rows. A quarter of them is left
   out to choose the temperature of the posteriors.
2. Every document gets a posterior over the domains.
3. Rates r in [0, ``max_rate``] are fitted by distributed projected gradient least
   squares: half the sum of squared relative residuals, ``(sum r * tokens *
   posterior - target) / target`` over the domains, falls with every accepted step.
   A round is two passes of Spark: one sums the residuals' curvature over the
   documents whose rates can move, one tries steps against the gradient, scaled by
   that curvature and damped more or less, each projected back into the bounds; the
   best is kept. The driver holds a few numbers for each domain, and a rate is a
   function of the posterior. The fit ends when all targets are met to ``CLOSE``, or
   when no step gains. ``met`` says whether the targets are met, ``converged`` whether
   that, or a projected gradient of about zero (no rates come nearer), is the case.
4. A rate becomes copies: its whole part, and one more with the odds of the rest,
   drawn by a hash of the id.

Bounds: about ``max_labelled`` labelled rows, picked by a hash of the id where
there are more, teach (as lists of vocabulary tokens they reach the driver, which
fits the model), and ``VOCABULARY`` tokens are sent to all tasks.
Posteriors, sums and rates cover all documents and whole texts.

Defined results
* null or empty text: no tokens, the evidence of holding nothing.
* rows that share an id share tokens (the largest count), posterior (of their mean
  evidence, so repeated rows change nothing) and rate.
* null labels teach nothing; of several labels for an id the smallest counts.
* no label at all, or an empty table: no rows, as there is nothing to match.
* a single domain: all posteriors are 1, and all rates alike.
* a target for a domain without labels is refused; so is one that is not above 0.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.store import Scratch

#: Words, and runs of anything that is neither letter nor white space.
TOKEN = r"\p{L}+|[^\p{L}\s]+"
SIGNS = r"[|#$%&*!<>={}_~^]"
CAPITALS = "[A-Z]"
#: Letters of the beginning of a longer word, a token of its own.
PREFIX = 5
VOCABULARY = 500
LEAST_DOCS = 5
#: So many standard deviations from its expected count must a token be in some domain.
LEAST_TELLING = 5.0
#: Evidence is divided by that of these which suits unseen labels best.
TEMPERATURES = (0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0, 16.0)
#: Penalty of squared weights, as labelled rows, and steps of the fit.
RIDGE, FIT_STEPS = 2.0, 400
ROUNDS = 40
#: Damping of the steps that a round tries, as parts of the largest curvature; the last is a plain gradient step.
DAMPING = (1e-9, 1e-5, 1e-3, 1e-2, 1e-1, 1.0)
#: Targets count as met when none is off by more than this part of itself.
CLOSE = 1e-4
#: The projected gradient counts as zero when a step along it moves no more than this part of all tokens.
STILL = 1e-5


def _features(docs: DataFrame, *keys: str) -> DataFrame:
    """(keys, tokens, held): a count; distinct tokens, and tokens for a text's shape, which begin with a colon and a letter.

    Each step is a projection of its own: what is used several times is computed once.
    """
    step = lambda name, x, most: F.concat(F.lit(name), F.least(F.floor(x), F.lit(most)).cast("string"))
    body = docs.select(*keys, F.coalesce("text", F.lit("")).alias("__body"))
    split = body.select(*keys, "__body", F.regexp_extract_all(F.lower("__body"), F.lit(TOKEN), F.lit(0)).alias("__all"))
    new = split.select(*keys, "__body", F.size("__all").cast("long").alias("tokens"), F.array_distinct("__all").alias("words"))
    size, chars = F.greatest("tokens", F.lit(1)), F.greatest(F.length("__body"), F.lit(1))
    shape = F.array(
        step(":new:", 20 * F.size("words") / size, 20),
        step(":signs:", 20 * F.regexp_count("__body", F.lit(SIGNS)) / size, 40),
        step(":length:", 4 * chars / size, 80),
        step(":capitals:", 50 * F.regexp_count("__body", F.lit(CAPITALS)) / chars, 50),
    )
    return new.select(*keys, "tokens", F.concat("words", shape).alias("held"))


def _begins(token: Column) -> Column:
    """What a longer word begins with, marked; null for other tokens."""
    return F.when((F.length(token) > PREFIX) & ~token.startswith(":"), F.concat(F.lit("^"), F.left(token, F.lit(PREFIX))))


@dataclass(frozen=True)
class Classifier:
    domains: tuple[str, ...]
    #: Evidence of a text that holds nothing of the vocabulary, by domain.
    bias: tuple[float, ...] = ()
    #: (token, w0, w1, ...): at most ``VOCABULARY`` rows.
    weights: DataFrame | None = None
    temperature: float = 1.0


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic weights and intercepts by accelerated gradient steps; y: one column for each domain."""
    n, k = y.shape
    a = np.column_stack([x, np.ones(n, x.dtype)])
    penalty = (np.r_[np.full(x.shape[1], ridge), 1e-3][:, None] / n).astype(x.dtype)
    v = (np.ones(a.shape[1]) / np.sqrt(a.shape[1])).astype(x.dtype)
    for _ in range(20):  # the largest curvature, for the length of a step
        v = a.T @ (a @ v)
        size = float(np.linalg.norm(v))
        v /= max(size, 1e-12)
    step = 1 / (0.5 * size / n + float(penalty.max()))
    w = ahead = np.zeros((a.shape[1], k), x.dtype)
    for i in range(FIT_STEPS):
        z = a @ ahead
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        after = (ahead - step * (a.T @ (p - y) / n + penalty * ahead)).astype(x.dtype)
        ahead = after + i / (i + 3) * (after - w)
        w = after
    return w[:-1], w[-1]


def _evidence(featured: DataFrame, model: Classifier, *keys: str) -> DataFrame:
    """(keys, tokens, s0, s1, ...) of ``_features``: one row for each doc_id, the mean over its rows.

    A token counts once in a row, a beginning once for each word that has it.
    """
    # The empty token stands for the row itself. Never empty; a plain explode would add a filter that computes all of it a second time.
    spread = featured.select(*keys, "tokens", F.explode_outer(F.concat(F.array(F.lit("")), "held")).alias("token")).withColumn("start", _begins(F.col("token")))
    k = len(model.domains)
    mark = lambda of: model.weights.select(F.col("token").alias(of), *[F.col(f"w{i}").alias(f"{of}{i}") for i in range(k)])
    weighed = spread.join(F.broadcast(mark("token")), "token", "left").join(F.broadcast(mark("start")), "start", "left")
    rows, none = F.count_if(F.col("token") == ""), F.lit(0.0)
    weight = lambda i: F.coalesce(f"token{i}", none) + F.coalesce(f"start{i}", none)
    sums = [(F.sum(weight(i)) / rows + model.bias[i]).alias(f"s{i}") for i in range(k)]
    return weighed.groupBy(*keys).agg(F.max("tokens").alias("tokens"), *sums)


def _softmax(k: int, temperature: float) -> list[Column]:
    logit = [F.col(f"s{i}") / temperature for i in range(k)]
    top = F.greatest(*logit, F.lit(-1e300))
    parts = [F.exp(x - top) for x in logit]
    total = sum(parts[1:], parts[0])
    return [p / total for p in parts]


def train(scratch: Scratch, docs: DataFrame, labelled: DataFrame, max_labelled: int = 20_000) -> Classifier:
    """``docs`` (doc_id, text), ``labelled`` (doc_id, domain)."""
    known = labelled.where("doc_id IS NOT NULL AND domain IS NOT NULL").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    sizes = {r["domain"]: r["count"] for r in known.groupBy("domain").count().collect()}
    domains = tuple(sorted(sizes))
    if not domains:
        return Classifier(())
    total = sum(sizes.values())
    draw = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(4))
    picked = known.where(draw < F.lit(min(1.0, max_labelled / total) * 1e6)).withColumn("unseen", fold == 0)
    # All documents are read once: what the labelled ones hold is written down.
    labelled_docs = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    numbered = _features(labelled_docs, "doc_id", "domain", "unseen").withColumn("row", F.monotonically_increasing_id())
    featured = scratch.keep(numbered, "labelled")
    taught = featured.where("NOT unseen")
    counts = [F.count_if(F.col("domain") == d).alias(f"n{i}") for i, d in enumerate(domains)]
    n = [float(x) for x in taught.agg(*counts).first()]
    token = taught.select("row", "domain", F.explode_outer("held").alias("token"))
    start = token.select("row", "domain", _begins(F.col("token")).alias("token")).where("token IS NOT NULL")
    by_token = token.unionByName(start.distinct()).groupBy("token").agg(F.count("*").alias("n"), *counts)
    told = by_token.where(F.col("n") >= LEAST_DOCS)
    parts = [max(x, 0.5) / max(sum(n), 1.0) for x in n]
    off = [F.abs(F.col(f"n{i}") - F.col("n") * p) / F.sqrt(F.col("n") * p * max(1 - p, 1e-9)) for i, p in enumerate(parts)]
    telling = F.greatest(*off, F.lit(0.0))
    best = told.where(telling >= LEAST_TELLING).orderBy(telling.desc(), "token").limit(VOCABULARY).select("token")
    vocabulary = [r["token"] for r in best.collect()]  # VOCABULARY rows at most
    place = {t: i for i, t in enumerate(vocabulary)}
    listed = docs.sparkSession.createDataFrame([(t, i) for t, i in place.items()], "token string, place int")
    held = token.unionByName(start).join(F.broadcast(listed), "token").groupBy("row").agg(F.collect_list("place").alias("held"))
    rows = taught.select("row", "domain").join(held, "row", "left").select("domain", "held").collect()  # about max_labelled rows at most, each with tokens of the vocabulary
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    for i, r in enumerate(rows):
        np.add.at(x[i], r["held"] or [], 1)
    y = np.array([[r["domain"] == d for d in domains] for r in rows], np.float32).reshape(len(rows), len(domains))
    w, bias = _fit_logistic(x, y) if rows else (np.zeros((len(vocabulary), len(domains))), np.zeros(len(domains)))
    shape = ", ".join(["token string", *(f"w{i} double" for i in range(len(domains)))])
    weights = docs.sparkSession.createDataFrame([(t, *map(float, w[i])) for t, i in place.items()], shape)
    model = Classifier(domains, tuple(map(float, bias)), weights)
    # Unseen labels choose how far the evidence is believed.
    judged = _evidence(featured.where("unseen").drop("row"), model, "doc_id", "domain")
    loss = []
    for t in TEMPERATURES:
        p = _softmax(len(domains), t)
        own = F.coalesce(*[F.when(F.col("domain") == d, p[i]) for i, d in enumerate(domains)])
        loss.append(F.sum(-F.log(F.greatest(own, F.lit(1e-12)))).alias(f"t{len(loss)}"))
    row = judged.agg(*loss).first()
    losses = [np.inf if x is None else x for x in row]
    return replace(model, temperature=TEMPERATURES[int(np.argmin(losses))])


def posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, tokens, posterior): one row for each id."""
    p = _softmax(len(model.domains), model.temperature)
    return _evidence(_features(docs, "doc_id"), model, "doc_id").select("doc_id", "tokens", F.array(*p).alias("posterior"))


@dataclass(frozen=True)
class Fit:
    #: (doc_id, tokens, posterior, rate).
    rated: DataFrame
    #: (expected - target) / target by domain.
    residuals: dict[str, float]
    #: Are all targets met?
    met: bool
    #: Met, or as near as rates within the bounds come.
    converged: bool


def _dot(g: list[float]) -> Column:
    parts = [F.col("posterior")[i] * x for i, x in enumerate(g)]
    return sum(parts[1:], parts[0])


def _stepped(step: list[float], most: float) -> Column:
    """The rate after a step: lowered by step times posterior and projected back into [0, most]."""
    return F.least(F.greatest(F.col("rate") - _dot(step), F.lit(0.0)), F.lit(most))


def fit_rates(scratch: Scratch, judged: DataFrame, domains: tuple[str, ...], targets: dict[str, float], max_rate: float) -> Fit:
    """``targets``: tokens by domain, above 0; a domain without one is left free."""
    if unknown := set(targets) - set(domains):
        raise ValueError(f"no labels for {sorted(unknown)}")
    aimed = [i for i, d in enumerate(domains) if d in targets]
    goal = np.array([targets[domains[i]] for i in aimed])
    k = len(aimed)
    tokens = F.col("tokens")
    each = [F.col("posterior")[i] for i in aimed]

    def spread(c: np.ndarray) -> list[float]:
        """A step on relative residuals -> one number for each domain, for ``_rate``."""
        out = [0.0] * len(domains)
        for i, x in zip(aimed, c / goal, strict=True):
            out[i] = float(x)
        return out

    def sums(rated: DataFrame, rates: list[Column]) -> list[np.ndarray]:
        """Relative residuals under each of these rates."""
        cells = [F.sum(r * tokens * a).alias(f"e{n}_{i}") for n, r in enumerate(rates) for i, a in enumerate(each)]
        row = rated.agg(*cells).first()
        return [np.array([row[f"e{n}_{i}"] or 0.0 for i in range(k)]) / goal - 1 for n in range(len(rates))]

    def curvature(rated: DataFrame, miss: np.ndarray) -> np.ndarray:
        """Of residuals, over documents that a step against the gradient can move."""
        r, slope = F.col("rate"), _dot(spread(miss))
        free = ((r > 0) | (slope < 0)) & ((r < max_rate) | (slope > 0))
        cells = [F.sum(F.when(free, tokens * a * b)).alias(f"g{i}_{j}") for i, a in enumerate(each) for j, b in enumerate(each)]
        row = rated.agg(*cells).first()
        return np.array([[row[f"g{i}_{j}"] or 0.0 for j in range(k)] for i in range(k)]) / np.outer(goal, goal)

    def moved(rated: DataFrame, step: list[float]) -> float:
        """Part of all tokens that a projected step along the plain gradient moves."""
        change = F.abs(F.col("rate") - _stepped(step, max_rate))
        row = rated.agg(F.sum(change * tokens).alias("moved"), F.sum(tokens).alias("all")).first()
        return (row["moved"] or 0.0) / max(row["all"] or 0.0, 1.0)

    rated = judged.withColumn("rate", F.lit(1.0))
    (miss,) = sums(rated, [F.col("rate")])
    last, slow, reach = np.zeros(k), 0, 1e-12
    for n in range(ROUNDS):
        if np.abs(miss).max() <= CLOSE or slow == 3:
            break
        gram = curvature(rated, miss)
        reach = max(reach, float(np.linalg.eigvalsh(gram)[-1]))
        tries = [np.linalg.solve(gram + d * reach * np.eye(k), miss) for d in DAMPING]
        tries += [c + last for c in tries[-3:]] + [last, 4 * last]  # and on along the step before
        found = sums(rated, [_stepped(spread(c), max_rate) for c in tries])
        best = int(np.argmin([x @ x for x in found]))
        gain = 1 - (found[best] @ found[best]) / (miss @ miss)
        slow = slow + 1 if gain < 1e-3 else 0
        if gain <= 0:
            break
        # Rates are a written table: neither the plan nor a lost executor's work grows with the rounds.
        rated = scratch.keep(rated.withColumn("rate", _stepped(spread(tries[best]), max_rate)), f"rated-{n}")
        scratch.drop(f"rated-{n - 1}")
        miss, last = found[best], tries[best]
    met = bool(np.abs(miss).max() <= CLOSE)
    converged = met or moved(rated, spread(miss / reach)) <= STILL
    return Fit(rated, {domains[i]: float(x) for i, x in zip(aimed, miss, strict=True)}, met, converged)


def mix(
    spark: SparkSession,
    docs: DataFrame,
    labelled: DataFrame,
    weights: dict[str, float],
    total: float | None = 1.0,
    max_rate: float = 4.0,
    max_labelled: int = 20_000,
    seed: int = 7,
) -> DataFrame:
    """(doc_id, tokens, posterior map, rate, copies, residual map, met, converged) for each id; the last three are the fit's.

    ``weights``: part of the output's tokens by domain, normalized. ``total``: output
    tokens as a multiple of the input's; if None, each weight is a multiple of its
    own domain's expected tokens.
    """
    scratch = Scratch(spark, "mixing")
    model = train(scratch, docs, labelled, max_labelled)
    shape = "doc_id long, tokens long, posterior map<string,double>, rate double, copies long, residual map<string,double>, met boolean, converged boolean"
    if not model.domains:
        return spark.createDataFrame([], shape)
    judged = scratch.keep(posteriors(docs, model), "judged")
    own = judged.agg(
        *[F.sum(F.col("tokens") * F.col("posterior")[i]).alias(d) for i, d in enumerate(model.domains)]
    ).first()
    mass = {d: own[d] or 0.0 for d in model.domains}
    parts, tokens = sum(weights.values()), sum(mass.values())
    goal = {d: w * (mass.get(d, 0.0) if total is None else total * tokens / parts) for d, w in weights.items()}
    if any(w <= 0 for w in goal.values()):
        raise ValueError("targets must be above 0")
    fit = fit_rates(scratch, judged, model.domains, goal, max_rate)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(2**31)) / F.lit(float(2**31))
    texts = lambda names: F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    return fit.rated.select(
        "doc_id",
        "tokens",
        F.map_from_arrays(texts(model.domains), "posterior").alias("posterior"),
        "rate",
        (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")).alias("copies"),
        F.map_from_arrays(texts(list(fit.residuals)), F.array(*map(F.lit, fit.residuals.values()))).alias("residual"),
        F.lit(fit.met).alias("met"),
        F.lit(fit.converged).alias("converged"),
    )
