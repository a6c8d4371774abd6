"""Mixing to target weights with soft membership, in DataFrame functions only.

* **Classifier.** Multinomial naive Bayes over hashed words, fitted on a bounded sample of the labelled rows
  (at most ``PER_DOMAIN`` rows of each domain). Every row gets a posterior per domain;
  its own label is no input.
* **Rates.** With ``m[d, k] = tokens[d] * posterior[d, k]`` the rates ``r >= 0`` minimise
  ``sum_k (sum_d r[d] m[d, k] - target[k])**2 / (2 mass[k]) + ridge / 2 * sum_d tokens[d] (r[d] - 1)**2``
  by projected gradient steps in the metric of the tokens. A step needs one number per domain from all rows
  (one aggregate without a shuffle of rows), and a row's rate follows from those numbers alone, so no
  rates are joined or stored between steps.
* **Copies.** A row stands ``floor(rate)`` times, once more with the probability of the rest, by a hash of
  its id. ``at_least`` keeps rows whose rate is below one.

Tokens are words between blanks. Null or blank texts have no tokens; their posterior is the prior and
they follow the common rate. Null labels teach nothing. With fewer than two domains every rate is one.
Repeated rows are rows of their own with the same rate; a very long text is one row of buckets. Columns carried
along get names that no column of the table can meet. An empty table gives no rows.
"""

from __future__ import annotations

import math
import warnings

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bellwire.llm.quality import literal_array, words_of
from bellwire.llm.sample import carried, sample_ids
from bellwire.session import broadcast_if_small, materialise

BUCKETS, PER_DOMAIN = 1 << 13, 2000
RIDGE, ROUNDS, CLOSE, MISSED = 1e-3, 25, 1e-4, 0.01
#: Words whose evidence counts in full; longer texts are scaled down to it.
EVIDENCE = 50


def _buckets(text: Column, buckets: int) -> Column:
    return F.transform(words_of(F.lower(text)), lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))


def fit_classifier(docs: DataFrame, labelled: DataFrame, domain_col: str, id_col: str, text_col: str, per_domain: int, buckets: int) -> tuple[list, list[float], list[list[float]]]:
    """Domains, their log shares, and a log probability per domain and bucket."""
    ids = sample_ids(labelled.where(F.col(domain_col).isNotNull()).select(id_col, domain_col), domain_col, per_domain, None, id_col)
    # At most per_domain narrow rows of each domain.
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_t")).join(broadcast_if_small(ids), id_col)
    seen = rows.select(F.col(domain_col).alias("_domain"), F.explode(_buckets(F.col("_t"), buckets)).alias("_b")).groupBy("_domain", "_b").count().collect()
    domains = sorted({r[0] for r in seen})
    counts = {d: [0] * buckets for d in domains}
    for domain, b, n in seen:
        counts[domain][b] = n
    logs = []
    for d in domains:
        total = sum(counts[d]) + 0.1 * buckets
        logs.append([round(math.log((n + 0.1) / total), 6) for n in counts[d]])
    rows_of = {r[0]: r["count"] for r in labelled.where(F.col(domain_col).isin(*domains)).groupBy(domain_col).count().collect()} if domains else {}
    whole = sum(rows_of.values())
    return domains, [math.log(rows_of[d] / whole) for d in domains], logs


def _evidence(logs: list[float]) -> Column:
    weights = literal_array(logs)
    return F.aggregate("_b", F.lit(0.0), lambda a, b: a + F.get(weights, b))


def with_posteriors(docs: DataFrame, model: tuple, id_col: str, text_col: str, buckets: int, carry: Sequence[str] = ()) -> DataFrame:
    """``_id``, ``carry`` as ``_x0``, ``_x1``, ..., ``_tokens`` and one posterior column ``_p<k>`` per domain."""
    domains, priors, logs = model
    kept = [F.col("_id"), *[F.col(f"_x{i}") for i in range(len(carry))]]
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), *carried(docs, list(carry))[0], _buckets(F.col(f"`{text_col}`").cast("string"), buckets).alias("_b"))
    rows = rows.withColumn("_n", F.size("_b"))
    scale = F.least(F.lit(1.0), F.lit(float(EVIDENCE)) / F.greatest(F.col("_n"), F.lit(1)))
    scored = rows.select(
        *kept, F.col("_n").cast("double").alias("_tokens"),
        *[(F.lit(priors[k]) + scale * _evidence(logs[k])).alias(f"_l{k}") for k in range(len(domains))],
    )
    names = [f"_l{k}" for k in range(len(domains))]
    top = F.greatest(*names) if len(names) > 1 else F.col(names[0])
    scored = scored.select(*kept, "_tokens", *[F.exp(F.col(n) - top).alias(f"_e{k}") for k, n in enumerate(names)])
    total = sum((F.col(f"_e{k}") for k in range(1, len(names))), F.col("_e0"))
    return scored.select(*kept, "_tokens", *[(F.col(f"_e{k}") / total).alias(f"_p{k}") for k in range(len(names))])


def rate_after(steps: list[list[float]], ridge: float = RIDGE) -> Column:
    """The rate of a row after these steps; each step is one number per domain."""
    eta = 1.0 / (1.0 + ridge)
    rate = F.lit(1.0)
    for step in steps:
        pull = sum((F.col(f"_p{k}") * F.lit(float(u)) for k, u in enumerate(step)), F.lit(0.0))
        rate = F.greatest(F.lit(0.0), rate * F.lit(1.0 - eta * ridge) + F.lit(eta * ridge) - F.lit(eta) * pull)
    return rate


def fit_rates(rows: DataFrame, targets: list[float] | None, n: int, power: float, ridge: float = RIDGE, rounds: int = ROUNDS) -> tuple[list[list[float]], list[float], list[float]]:
    """Steps, target tokens and reached tokens per domain.

    ``targets`` are shares of the whole token mass. Without them the shares are those of the data to
    ``power``, and the mass is scaled so that no domain has to shrink.
    """

    def totals(rate: Column) -> list[float]:
        row = rows.agg(*[F.sum(F.col("_tokens") * rate * F.col(f"_p{k}")).alias(f"t{k}") for k in range(n)]).first()
        return [float(x or 0.0) for x in row]

    mass = totals(F.lit(1.0))
    whole = sum(mass)
    if not whole or n < 2:
        return [], mass, mass
    if targets is None:
        raised = [m**power for m in mass]
        grow = max(m / x for m, x in zip(mass, raised) if x > 0)
        target = [x * grow for x in raised]
    else:
        target = [whole * t / sum(targets) for t in targets]
    steps: list[list[float]] = []
    reached = mass
    for _ in range(rounds):
        if max(abs(a - t) for a, t in zip(reached, target)) <= CLOSE * whole:
            break
        steps.append([(a - t) / m if m > 0 else 0.0 for a, t, m in zip(reached, target, mass)])
        reached = totals(rate_after(steps, ridge))
    return steps, target, reached


def mix(
    docs: DataFrame,
    labels: DataFrame,
    domain_col: str = "lang",
    targets: dict | None = None,
    power: float = 0.7,
    at_least: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Sequence[str] = (),
    per_domain: int = PER_DOMAIN,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Per row: the id, ``n_tokens``, ``posterior`` by domain, ``rate`` and ``copies``; ``carry`` adds columns as ``_x0``, ``_x1``, ...

    ``targets`` maps domains to weights; learnt domains it leaves out get none, and a weight for a domain without
    labelled rows is an error. Totals that stay more than ``MISSED`` of the mass from their target are reported
    in a warning: rows whose posteriors never favour a domain cannot fill it.
    """
    labelled = docs.select(id_col, domain_col).join(labels.select(id_col).where(F.col(id_col).isNotNull()).distinct(), id_col, "left_semi")
    model = fit_classifier(docs, labelled, domain_col, id_col, text_col, per_domain, buckets)
    domains = model[0]
    if targets is not None:
        unknown = sorted(str(d) for d, w in targets.items() if w > 0 and d not in domains)
        if unknown:
            raise ValueError(f"targets for domains without labelled rows: {', '.join(unknown)}")
    more = [F.col(f"_x{i}") for i in range(len(carry))]
    if not domains:
        empty = F.create_map().cast("map<string,double>")
        tokens = F.size(words_of(F.col(f"`{text_col}`"))).cast("bigint")
        return docs.select(F.col(f"`{id_col}`").alias(id_col), tokens.alias("n_tokens"), empty.alias("posterior"), F.lit(1.0).alias("rate"), F.lit(1).alias("copies"), *carried(docs, list(carry))[0])
    rows = materialise(with_posteriors(docs, model, id_col, text_col, buckets, carry), "mixing")
    steps, wanted, reached = fit_rates(rows, None if targets is None else [float(targets.get(d, 0.0)) for d in domains], len(domains), power)
    missed = {str(d): (round(r), round(t)) for d, r, t in zip(domains, reached, wanted) if abs(r - t) > MISSED * sum(reached)}
    if missed:
        warnings.warn(f"token totals (reached, target) off by more than {MISSED:.0%} of the mass: {missed}", stacklevel=2)
    chance = F.pmod(F.xxhash64(F.col("_id"), F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    posterior = F.map_from_arrays(F.array(*[F.lit(str(d)) for d in domains]), F.array(*[F.col(f"_p{k}") for k in range(len(domains))]))
    out = rows.select("_id", *more, F.col("_tokens").cast("bigint").alias("n_tokens"), posterior.alias("posterior"), rate_after(steps).alias("rate"), chance.alias("_u"))
    whole = F.floor("rate")
    copies = F.greatest(F.lit(at_least), whole + F.when(F.col("_u") < F.col("rate") - whole, 1).otherwise(0)).cast("int")
    return out.select(F.col("_id").alias(id_col), "n_tokens", "posterior", "rate", copies.alias("copies"), *more)
