"""Evaluating candidates of several methods against their factuals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores, series
from .kept import digest, written
from .objectives import judged_values
from .predictors import Predictor, label, predict


def evaluate(candidates: DataFrame, factuals: DataFrame, predict, tau=None) -> DataFrame:
    """Per (``query_id``, ``method``): predictions before and after, the flip, outcome, proximity and sparsity.

    ``candidates`` has ``method``, ``tab`` and ``ser``, each of which may be null and is then the factual's; ``factuals``
    has ``query_id``, ``tab``, ``ser`` and ``target``. ``predict`` is a column function of (tab, ser) that gives class
    probabilities. Rows are sorted by method, flips first, then by outcome.
    """
    f = factuals.select("query_id", F.col("tab").alias("f_tab"), F.col("ser").alias("f_ser"), "target")
    j = f.join(candidates, "query_id", "left").withColumn("tab", F.coalesce("tab", "f_tab")).withColumn("ser", F.coalesce("ser", "f_ser"))
    label = lambda p: (F.array_position(p, F.array_max(p)) - 1).cast("int")
    j = j.withColumn("before", label(predict(F.col("f_tab"), F.col("f_ser")))).withColumn("after", label(predict(F.col("tab"), F.col("ser"))))
    both = lambda a, b: F.when(F.col("ser").isNull(), a).when(F.col("tab").isNull(), b).otherwise((a + b) / 2)
    near = both(scores.tabular_proximity(F.col("f_tab"), F.col("tab")), series.proximity(F.col("f_ser"), F.col("ser")))
    sparse = both(scores.tabular_sparsity(F.col("f_tab"), F.col("tab")), series.sparsity(F.col("f_ser"), F.col("ser"), tau))
    out = j.select(
        "query_id", "method", "before", "after", scores.flipped(F.col("before"), F.col("after")).alias("flipped"),
        scores.outcome(F.col("after"), F.col("target")).alias("outcome"), near.alias("proximity"), sparse.alias("sparsity")
    )
    return out.orderBy("method", F.col("flipped").desc(), "outcome")


def _misfit(name: str, series: bool):
    """Why a candidate's column can't be judged, or null: holes, or another shape than the factual's."""
    own, factual = F.col(name), F.col(f"f_{name}")
    if series:
        holes = F.exists(own, lambda ch: ch.isNull() | F.exists(ch, lambda x: x.isNull()))
        shape = F.transform(own, lambda ch: F.size(ch)) != F.transform(factual, lambda ch: F.size(ch))
    else:
        holes, shape = F.exists(own, lambda x: x.isNull()), F.size(own) != F.size(factual)
    return F.when(holes, f"{name} holds nulls").when(shape, f"{name} has another shape than the factual")


def evaluate_methods(
    candidates: DataFrame, factuals: DataFrame, predictor: Predictor, tab: str | None = "tab", series_names: tuple[str, ...] = ("ser",),
    reference: DataFrame | None = None, taus: dict | None = None, tab_weight: float = 0.5, how: str = "percentile"
) -> DataFrame:
    """Every candidate of every method judged by itself: what goes wrong with one is its ``error``, never the others'.

    ``factuals`` has ``query_id``, ``target`` and the branches: ``tab`` (a vector) and any ``series_names`` (channel-major), such
    as laboratory values and medication apart. ``candidates`` has ``query_id``, ``method``, ``cand_rank``, the branches, each null
    where the factual's holds, and may have ``error``, the message of a method that gave none. ``reference`` (``sample_id``
    and the branches) is what plausibility is measured against; without it there is none. All go to one ``predictor``.

    Gives ``query_id``, ``method``, ``cand_rank``, ``kind`` (``both``, ``tab-only``, ``series-only``), ``before``, ``after`` (classes),
    ``score``, ``flipped``, ``outcome``, ``proximity``, ``sparsity``, ``plausibility`` and ``error``; with an error all but the
    first four are null. A candidate whose query has no factual, or a factual that can't be scored, says so. A factual
    without candidates has no row. Of several series proximity pools the values and sparsity is their mean; with the
    tabular part both are the mean of the two, while plausibility weighs the tabular part by ``tab_weight``.
    """
    branches, taus = [*([tab] if tab else []), *series_names], taus or {}
    given = F.col("error") if "error" in candidates.columns else F.lit(None).cast("string")
    rows = candidates.select("query_id", "method", "cand_rank", *branches, given.alias("_given"))
    said = predict(factuals.select("query_id", "target", *branches), predictor, "_f_")
    facts = said.select("query_id", "target", *[F.col(c).alias(f"f_{c}") for c in branches], F.col("_f_probability"), F.col("_f_error"))
    changed_tab = F.col(tab).isNotNull() if tab else F.lit(False)
    changed_series = reduce(lambda a, b: a | b, [F.col(s).isNotNull() for s in series_names], F.lit(False))
    kind = F.when(changed_tab & changed_series, "both").when(changed_tab, "tab-only").when(changed_series, "series-only")
    rows = rows.withColumn("kind", kind).join(facts.withColumn("_known", F.lit(True)), "query_id", "left")
    wrong = F.coalesce(
        F.col("_given"), F.when(F.col("_known").isNull(), "no factual"), F.concat(F.lit("factual: "), F.col("_f_error")),
        F.when(F.col("kind").isNull(), "no branch is given"), *[_misfit(c, c != tab) for c in branches]
    )
    rows = rows.withColumn("_wrong", wrong)
    rows = rows.select(*[F.when(F.col("_wrong").isNull(), F.coalesce(c, f"f_{c}")).alias(c) if c in branches else F.col(c) for c in rows.columns])
    rows = predict(rows, predictor, "_c_").withColumn("error", F.coalesce("_wrong", "_c_error"))
    good = F.col("error").isNull()
    f, c = (lambda s: F.col(f"f_{s}")), F.col
    near, sparse = [], []
    if tab:
        near.append(scores.tabular_proximity(f(tab), c(tab)))
        sparse.append(scores.tabular_sparsity(f(tab), c(tab)))
    if series_names:
        pairs = [(f(s), c(s)) for s in series_names]
        near.append(series.split_proximity(pairs))
        sparse.append(series.split_sparsity(pairs, [F.array(*[F.lit(float(x)) for x in taus[s]]) if taus.get(s) else None for s in series_names]))
    mean = lambda parts: sum(parts[1:], parts[0]) / len(parts)
    plausible = F.lit(None).cast("double")
    if reference is not None:
        rows = written(rows, "judged")  # read by every branch
        for s in branches:
            flat = F.flatten(s) if s != tab else F.col(s)
            values = rows.where(good).select(flat.alias("value"))
            known = judged_values(values, reference.select("sample_id", flat.alias("value")).where("value IS NOT NULL"), how)
            known = known.select(F.col("d0").alias("_d0"), F.col("d1").alias("_d1"), F.col("plausibility").alias(f"_p_{s}"))
            rows = rows.withColumns({f"_d{i}": d for i, d in enumerate(digest(flat))}).join(known, ["_d0", "_d1"], "left").drop("_d0", "_d1")
        own = series.split_plausibility([(c(f"_p_{s}"), c(s)) for s in series_names]) if series_names else None
        plausible = c(f"_p_{tab}") if own is None else tab_weight * c(f"_p_{tab}") + (1 - tab_weight) * own if tab else own
    before, after = label(c("_f_probability")), label(c("_c_probability"))
    out = {
        "before": before, "after": after, "score": c("_c_score"), "flipped": scores.flipped(before, after),
        "outcome": scores.outcome(after, c("target")), "proximity": mean(near), "sparsity": mean(sparse), "plausibility": plausible,
    }
    return rows.select("query_id", "method", "cand_rank", "kind", *[F.when(good, x).alias(n) for n, x in out.items()], "error")
