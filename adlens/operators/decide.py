"""Decide: Bayesian arm beliefs -> bid and budget recommendations.

A31-A33, A36-A37, M10-M13, J8-J10, W5, W7-W8, T4, U2.

Beliefs are closed-form aggregates (sums of precisions and precision-weighted
rewards per arm), so they are computed with partial/final aggregation and
never hold a group in memory.  Where the reference draws random samples
(D3, D5) the default here is the deterministic posterior mean; a seeded
sampled variant exists for the allocator.  Decision D4: the reference's
noise model makes a more profitable bid level *less* believed, so bid
levels are ranked by expected profit of the bid-response model (M11) and the
Normal posterior (A31) is kept as a reusable operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adlens.functions.formatting import fixed, sign_char
from adlens.functions.ranking import global_row_number, hashed_normal
from adlens.functions.ratios import MONEY, round_half_up
from adlens.operators import trends as T
from adlens.session import ensure_checkpoint_dir

# Fixed values from the reference's optimiser.
BID_LEVELS = (0.80, 0.90, 0.95, 1.00, 1.05, 1.10, 1.20)
ROAS_TARGETS = {"google": 3.0, "meta": 2.5, "amazon": 3.5}
DEFAULT_ROAS_TARGET = 3.0
HOLD_BELOW_PCT = 3.0           # |change| < 3 % -> hold
EPS = 1e-10                    # added to every variance in the Normal update
SHIFT_LIST_PCT = 0.03          # changes above 3 % of the budget are listed
SHIFT_MIN_PCT = 0.02           # a paired shift must be at least 2 % of the budget


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ── A31 / A32: posteriors ────────────────────────────────────────────

def normal_posterior(obs: DataFrame, keys, reward: str = "reward", noise: str | Column = "noise",
                     mu0: float = 0.0, sigma0: float = 1.0) -> DataFrame:
    """Normal posterior per arm with known per-observation noise.

    precision = 1/(sigma0^2 + eps) + sum 1/(noise^2 + eps);
    mean = (mu0/(sigma0^2 + eps) + sum reward/(noise^2 + eps)) / precision.
    Order-free (the sequential update differs only through the eps terms).
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    w = 1.0 / (_c(noise) * _c(noise) + F.lit(EPS))
    prior_prec = 1.0 / (sigma0 ** 2 + EPS)
    a = obs.groupBy(*keys).agg(
        F.sum(w).alias("_prec"), F.sum(w * _c(reward)).alias("_wsum"),
        F.count(F.lit(1)).alias("n_obs"))
    prec = F.lit(prior_prec) + F.col("_prec")
    mean = (F.lit(prior_prec * mu0) + F.col("_wsum")) / prec
    return a.select(*keys, mean.alias("mean_exact"),
                    round_half_up(mean, 4).alias("mean"),
                    round_half_up(1.0 / F.sqrt(prec), 4).alias("uncertainty"),
                    "n_obs")


def beta_posterior(obs: DataFrame, keys, success: str = "reward",
                   alpha0: float = 1.0, beta0: float = 1.0) -> DataFrame:
    """Beta-Bernoulli posterior per arm; n_obs excludes the prior counts."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    ok = _c(success).cast("boolean")
    a = obs.groupBy(*keys).agg(F.count_if(ok).alias("_s"), F.count_if(~ok).alias("_f"))
    al = F.lit(alpha0) + F.col("_s")
    be = F.lit(beta0) + F.col("_f")
    var = al * be / ((al + be) * (al + be) * (al + be + 1))
    return a.select(*keys, F.col("_s").alias("successes"), F.col("_f").alias("failures"),
                    round_half_up(al / (al + be), 4).alias("mean"),
                    round_half_up(F.sqrt(var), 4).alias("uncertainty"),
                    (F.col("_s") + F.col("_f")).alias("n_obs"))


def relative_gap(best: Column, second: Column) -> Column:
    return F.when(second.isNull(), F.lit(0.0)).otherwise((best - second) / (F.abs(best) + F.lit(EPS)))


def gap_confidence(gap: Column, n_obs: Column) -> Column:
    return (F.when((gap > 0.15) & (n_obs >= 20), "high")
            .when((gap > 0.05) & (n_obs >= 10), "medium").otherwise("low"))


def best_arm_confidence(beliefs: DataFrame, entity, arm: str = "arm", mean: str = "mean",
                        n_obs: str = "n_obs") -> DataFrame:
    """Best arm per entity and a confidence from the best-vs-second gap.

    gap = (m1 - m2) / (|m1| + 1e-10); high if > .15 and n >= 20, medium if
    > .05 and n >= 10, else low.  Ties on the mean go to the smaller arm.
    """
    entity = [entity] if isinstance(entity, str) else list(entity)
    w = Window.partitionBy(*entity).orderBy(F.col(mean).desc(), F.col(arm))
    r = beliefs.withColumn("_rk", F.row_number().over(w)).withColumn(
        "_next", F.lead(F.col(mean)).over(w))
    top = r.where(F.col("_rk") == 1)
    top = top.withColumn("relative_gap", relative_gap(F.col(mean), F.col("_next")))
    conf = gap_confidence(F.col("relative_gap"), F.col(n_obs))
    return top.select(*entity, F.col(arm).alias("best_arm"), F.col(mean).alias("best_mean"),
                      F.col(n_obs).alias("best_n_obs"),
                      round_half_up("relative_gap", 6).alias("relative_gap"), conf.alias("confidence"))


# ── M11 / J8: expected bid-response grid ─────────────────────────────

def bid_levels_column(levels=BID_LEVELS) -> Column:
    """The bid grid as an exploded literal array (7 rows per campaign, no join)."""
    return F.explode(F.array(*[F.lit(float(m)) for m in levels]))


def bid_response_grid(base: DataFrame, levels=BID_LEVELS) -> DataFrame:
    """Expected outcome of every bid multiplier m for every campaign.

    Impressions scale with m^0.5, CPC with m, CTR, conversion rate and AOV
    stay constant (the reference's response model without its noise), so
    profit(m) = impr*m^0.5*ctr*(cr*aov - cpc*m), maximised at m* = roas/3.
    """
    g = base.select("*", bid_levels_column(levels).alias("bid_multiplier"))
    return g.select("*", *[c.alias(name) for name, c in bid_response(F.col("bid_multiplier")).items()])


def bid_response(m: Column) -> dict[str, Column]:
    """The expected outcomes of one bid multiplier, over the base metrics of a row."""
    impr = F.col("base_impressions") * F.sqrt(m)
    clicks = impr * F.col("base_ctr")
    spend = clicks * (F.col("base_cpc") * m)
    conv = clicks * F.col("base_conv_rate")
    revenue = conv * F.col("base_aov")
    return {"exp_impressions": impr, "exp_clicks": clicks, "exp_spend": spend, "exp_conversions": conv,
            "exp_revenue": revenue, "exp_profit": revenue - spend,
            "exp_roas": F.when(spend > 0, revenue / spend).otherwise(F.lit(0.0))}


def best_bid(base: DataFrame, levels=BID_LEVELS) -> DataFrame:
    """The best bid level of every campaign by expected profit (ties to the lower level) and the
    confidence of its lead over the second (A33): the levels are few, so both are
    found inside the row."""
    def level(m):
        out = bid_response(F.lit(float(m)))
        return F.struct((-out["exp_profit"]).alias("order"), F.lit(float(m)).alias("arm"), out["exp_profit"].alias("profit"),
                        out["exp_roas"].alias("roas"))
    g = base.withColumn("_by", F.array_sort(F.array(*[level(m) for m in levels])))
    g = g.select("*", F.get("_by", F.lit(0)).alias("_1"), F.get("_by", F.lit(1)).alias("_2"))
    gap = relative_gap(F.col("_1.profit"), F.col("_2.profit"))
    return g.select(*base.columns, F.col("_1.arm").alias("best_arm"), F.col("_1.roas").alias("exp_roas"),
                    gap_confidence(gap, F.col("n_days")).alias("confidence"))


# ── M10: bid recommendations ─────────────────────────────────────────

def _target(platform: Column, targets: dict) -> Column:
    expr = None
    for k, v in targets.items():
        expr = (F.when(platform == k, F.lit(float(v))) if expr is None
                else expr.when(platform == k, F.lit(float(v))))
    return expr.otherwise(F.lit(DEFAULT_ROAS_TARGET)) if expr is not None else F.lit(DEFAULT_ROAS_TARGET)


def bid_recommendations(daily: DataFrame, campaigns: DataFrame, forecasts: DataFrame | None = None,
                        targets: dict | None = None, levels=BID_LEVELS) -> DataFrame:
    """One bid recommendation per campaign with >= 14 rows and spend.

    A13 base metrics -> best and second-best level by expected profit inside
    each row (M11, A33 gap rules with n = rows in the 30-row window) -> action
    (hold below 3 %) -> reasoning text (F5).
    """
    targets = targets or ROAS_TARGETS
    base = T.recent_base_metrics(daily).join(
        campaigns.select("campaign_id", "campaign_name", "platform"), "campaign_id")
    r = best_bid(base, levels)
    change = round_half_up((F.col("best_arm") - 1.0) * 100, 1)
    r = r.withColumn("_chg", change)
    hold = F.abs(F.col("_chg")) < HOLD_BELOW_PCT
    action = F.when(hold, "hold").when(F.col("_chg") > 0, "increase").otherwise("decrease")
    r = r.select("*", action.alias("recommended_action"),
                 F.when(hold, F.lit(0.0)).otherwise(F.col("_chg")).alias("recommended_change_pct"),
                 F.when(hold, F.lit(1.0)).otherwise(F.col("best_arm")).alias("recommended_multiplier"),
                 _target(F.col("platform"), targets).alias("roas_target"))
    trend = T.roas_mean_trend(daily).select("campaign_id", F.col("trend_pct").alias("_tp"),
                                             F.col("direction").alias("_dir"))
    r = r.join(trend, "campaign_id", "left")
    if forecasts is not None:
        has_fc = forecasts.select("campaign_id").distinct().withColumn("_fc", F.lit(True))
        r = r.join(has_fc, "campaign_id", "left")
    else:
        r = r.withColumn("_fc", F.lit(None).cast("boolean"))
    cur = F.col("current_roas")
    part1 = F.concat(F.lit("Current ROAS is "), fixed(cur, 1), F.lit("x ("),
                     F.when(cur >= F.col("roas_target"), "above").otherwise("below"),
                     F.lit(" "), fixed("roas_target", 1), F.lit("x target)."))
    part2 = F.when(F.col("_tp").isNotNull(), F.concat(
        F.lit("Performance is "), F.col("_dir"), F.lit(" ("), sign_char("_tp"),
        F.format_string("%.1f", round_half_up(F.abs(F.col("_tp")), 1)),
        F.lit("% ROAS change over 14 days).")))
    part3 = F.when(F.col("_fc"), F.lit("Demand forecast factored into optimization."))
    pct_txt = F.format_string("%.0f", round_half_up(F.abs(F.col("recommended_change_pct")), 0))
    exp_txt = fixed("exp_roas", 1)
    part4 = (F.when(F.col("recommended_action") == "increase", F.concat(
                F.lit("The bid-response model recommends increasing bid by "), pct_txt,
                F.lit("% (expected ROAS: "), exp_txt, F.lit("x). Confidence is "),
                F.col("confidence"), F.lit(" based on the profit gap to the next bid level.")))
             .when(F.col("recommended_action") == "decrease", F.concat(
                F.lit("The bid-response model recommends decreasing bid by "), pct_txt,
                F.lit("% to improve efficiency (expected ROAS: "), exp_txt, F.lit("x).")))
             .otherwise(F.lit("Current bid level is near-optimal. No adjustment recommended.")))
    return r.select(
        "campaign_id", "campaign_name", "platform",
        round_half_up(cur, 2).alias("current_roas"),
        "recommended_action", "recommended_change_pct", "recommended_multiplier",
        round_half_up("exp_roas", 2).alias("expected_roas_after"),
        "confidence",
        F.concat_ws(" ", part1, part2, part3, part4).alias("reasoning"),
    )


def top_bid_rows(recs: DataFrame, n: int = 8) -> DataFrame:
    """T4: the first n recommendations (platform, name order) numbered 1..n."""
    order = [F.col("platform"), F.col("campaign_name"), F.col("campaign_id")]
    top = recs.orderBy(*order).limit(n)
    # numbering the n rows left after the limit (a bounded, tiny window)
    return top.withColumn("priority", F.row_number().over(Window.orderBy(*order)))


# ── M12: budget allocation ───────────────────────────────────────────

def allocation_beliefs(summary: DataFrame, n_obs: int = 30) -> DataFrame:
    """A31 closed form with x = ROAS seen n_obs times, noise = 0.2*ROAS + 0.1."""
    roas = F.coalesce(F.col("roas"), F.lit(0.0))
    o = roas * 0.2 + 0.1
    w = F.lit(float(n_obs)) / (o * o + F.lit(EPS))
    prior = 1.0 / (1.0 + EPS)
    mean = (w * roas) / (F.lit(prior) + w)
    return summary.withColumn("belief_mean", mean)


def budget_allocation(summary: DataFrame, total_daily_budget: float | None = None,
                      days: int = 90, n_obs: int = 30) -> DataFrame:
    """M12 (deterministic, D5): current vs recommended daily allocation per campaign.

    W8 on posterior means: shifted = max(mean - min + 0.1, 0.1), share =
    shifted / sum.  Budget = total spend / ``days`` unless given (D6).
    Global min and sums are scalar subqueries, not windows over all rows.
    """
    b = allocation_beliefs(summary, n_obs)
    min_mean = b.select(F.min("belief_mean")).scalar()
    shifted = F.greatest(F.col("belief_mean") - min_mean + 0.1, F.lit(0.1))
    b = b.withColumn("_shift", shifted)
    tot_shift = b.select(F.sum("_shift")).scalar()
    tot_spend = summary.select(F.sum(F.col("spend").cast(MONEY)).cast("double")).scalar()
    n = summary.select(F.count(F.lit(1))).scalar()
    budget = F.lit(float(total_daily_budget)) if total_daily_budget is not None else tot_spend / days
    # dollars come from the exact shares; only the displayed share is rounded,
    # so small campaigns keep their money however many there are
    cur = F.when(tot_spend > 0, F.col("spend") / tot_spend).otherwise(F.lit(1.0) / n)
    out = b.select("*", budget.alias("total_daily_budget"), cur.alias("_cur"),
                   (F.col("_shift") / tot_shift).alias("_rec"))
    out = out.select("*", round_half_up("_cur", 4).alias("current_share"),
                     round_half_up("_rec", 4).alias("recommended_share"),
                     round_half_up(F.col("_cur") * F.col("total_daily_budget"), 2).alias("current_daily"),
                     round_half_up(F.col("_rec") * F.col("total_daily_budget"), 2).alias("recommended_daily"))
    return out.select(
        "campaign_id", "campaign_name", F.coalesce(F.col("roas"), F.lit(0.0)).alias("roas"),
        round_half_up("belief_mean", 4).alias("belief_mean"),
        round_half_up("total_daily_budget", 2).alias("total_daily_budget"),
        "current_share", "recommended_share", "current_daily", "recommended_daily",
        round_half_up(F.col("recommended_daily") - F.col("current_daily"), 2).alias("change"),
    )


def budget_shifts(allocation: DataFrame) -> DataFrame:
    """Pair the i-th largest increase with the i-th largest decrease.

    Changes beyond 3 % of the budget are ranked (W7, a distributed global
    row number), paired by rank (J10, equi-join) and kept when the shift is
    at least 2 % of the budget.  Leftovers are not carried over.
    """
    budget = F.col("total_daily_budget")
    inc = allocation.where(F.col("change") > budget * SHIFT_LIST_PCT)
    dec = allocation.where(F.col("change") < -budget * SHIFT_LIST_PCT)
    inc = global_row_number(inc, [F.col("change").desc(), F.col("campaign_id")], "pair_rank")
    dec = global_row_number(dec, [F.col("change").asc(), F.col("campaign_id")], "pair_rank")
    to = inc.select("pair_rank", F.col("campaign_id").alias("to_campaign"),
                    F.col("campaign_name").alias("to_campaign_name"), F.col("roas").alias("to_roas"),
                    F.col("change").alias("to_change"), "total_daily_budget")
    fr = dec.select("pair_rank", F.col("campaign_id").alias("from_campaign"),
                    F.col("campaign_name").alias("from_campaign_name"), F.col("roas").alias("from_roas"),
                    F.col("change").alias("from_change"))
    j = to.join(fr, "pair_rank")
    amount = round_half_up(F.least(F.col("to_change"), F.abs(F.col("from_change"))), 2)
    j = j.withColumn("amount", amount).where(F.col("amount") >= budget * SHIFT_MIN_PCT)
    reasoning = F.concat(
        F.lit("Shift $"), F.format_string("%.0f", round_half_up("amount", 0)), F.lit("/day from "),
        F.col("from_campaign_name"), F.lit(" (ROAS "), fixed("from_roas", 1), F.lit("x) to "),
        F.col("to_campaign_name"), F.lit(" (ROAS "), fixed("to_roas", 1),
        F.lit("x). The posterior indicates higher expected returns."))
    return j.select(
        "pair_rank", "from_campaign", "from_campaign_name", "to_campaign", "to_campaign_name",
        "amount", reasoning.alias("reasoning"),
        F.when(F.abs(F.col("to_roas") - F.col("from_roas")) > 1.0, "high").otherwise("medium")
         .alias("confidence"))


def sampled_allocation_shares(summary: DataFrame, n_samples: int = 1000, seed: int = 42,
                              n_obs: int = 30) -> DataFrame:
    """M12 sampled form (J9): mean normalised share over seeded posterior draws.

    Each (sample, campaign) draw is mean + sd * z, with z a standard normal
    fixed by (seed, campaign, sample); the per-sample min and sum are group
    aggregates by sample (W8), broadcast back on sample.

    A campaign is a few bytes and a thousand draws: adaptive execution would put all campaigns
    into one task by their bytes, so they are dealt to all cores, and kept for both passes.
    """
    roas = F.coalesce(F.col("roas"), F.lit(0.0))
    o = roas * 0.2 + 0.1
    w = F.lit(float(n_obs)) / (o * o + F.lit(EPS))
    prior = 1.0 / (1.0 + EPS)
    b = summary.select("campaign_id", ((w * roas) / (F.lit(prior) + w)).alias("mu"),
                       (1.0 / F.sqrt(F.lit(prior) + w)).alias("sd"))
    ensure_checkpoint_dir(summary.sparkSession)
    b = b.repartition(4 * summary.sparkSession.sparkContext.defaultParallelism, "campaign_id").checkpoint(eager=True)
    # the draw is a function of (seed, campaign, sample), not of row position,
    # so a recomputed partition after an executor loss draws the same values
    draws = b.select("campaign_id", "mu", "sd", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))).alias("sample"))
    draws = draws.select("campaign_id", "sample", (F.col("mu") + F.col("sd") * hashed_normal(
        seed, F.col("campaign_id"), F.col("sample"))).alias("x"))
    # x - min + 0.1 is never below 0.1, so min, sum and count of one pass give
    # every sample's minimum and total; n_samples rows (a proven bound): broadcast
    per = draws.groupBy("sample").agg(F.min("x").alias("_min"), F.sum("x").alias("_sum"),
                                      F.count(F.lit(1)).alias("_n"))
    per = per.select("sample", "_min", (F.col("_sum") - F.col("_n") * (F.col("_min") - 0.1)).alias("_tot"))
    d = draws.join(F.broadcast(per), "sample")
    share = F.sum((F.col("x") - F.col("_min") + 0.1) / F.col("_tot")) / n_samples
    return d.groupBy("campaign_id").agg(share.alias("share")).select(
        "campaign_id", round_half_up("share", 4).alias("recommended_share"), "share")


# ── M13 / W5 / A37: policy replay ────────────────────────────────────

def round_robin_choices(rewards: DataFrame, policy: str = "round_robin") -> DataFrame:
    """A logged policy: on day index d choose arm number (d mod #arms), arms by name."""
    # numbering the distinct arms: the arm set of a bandit is small by definition
    arms = rewards.select("arm").distinct().withColumn(
        "arm_no", F.dense_rank().over(Window.orderBy("arm")) - 1)
    n_arms = arms.select(F.count(F.lit(1))).scalar()
    first = rewards.select(F.min("round")).scalar()
    days = rewards.select("round").distinct().withColumn(
        "arm_no", (F.datediff(F.col("round"), first) % n_arms).cast("int"))
    return days.join(arms, "arm_no").select(F.lit(policy).alias("policy"), "round", "arm")


def follow_the_leader_choices(rewards: DataFrame, policy: str = "follow_the_leader") -> DataFrame:
    """A logged policy: choose the arm with the best total reward before this round."""
    w = Window.partitionBy("arm").orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
    c = rewards.withColumn("_before", F.coalesce(F.sum(F.col("reward").cast(MONEY)).over(w),
                                                 F.lit(0).cast(MONEY)))
    pick = Window.partitionBy("round").orderBy(F.col("_before").desc(), F.col("arm"))
    return (c.withColumn("_rk", F.row_number().over(pick)).where(F.col("_rk") == 1)
            .select(F.lit(policy).alias("policy"), "round", "arm"))


def policy_replay(rewards: DataFrame, choices: DataFrame) -> DataFrame:
    """Per policy and round: reward, per-round best, cumulative reward and regret.

    Windows are partitioned by policy and ordered by round (bounded by the
    number of rounds); money is accumulated as DECIMAL so the running sums
    are exact.
    """
    best = rewards.groupBy("round").agg(F.max(F.col("reward").cast(MONEY)).alias("_best"))
    got = choices.join(rewards, ["round", "arm"]).join(best, "round")
    w = Window.partitionBy("policy").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    cum_r = F.sum(F.col("reward").cast(MONEY)).over(w)
    cum_o = F.sum(F.col("_best")).over(w)
    return got.select(
        "policy", "round", "arm", F.col("reward").cast("double").alias("reward"),
        F.col("_best").cast("double").alias("oracle_reward"),
        cum_r.cast("double").alias("cumulative_reward"),
        cum_o.cast("double").alias("cumulative_oracle"),
        (cum_o - cum_r).cast("double").alias("cumulative_regret"))


def policy_summary(rewards: DataFrame, choices: DataFrame) -> DataFrame:
    """Total reward, final regret and the oracle per policy."""
    rep = policy_replay(rewards, choices)
    per = rep.groupBy("policy").agg(
        F.sum(F.col("reward").cast(MONEY)).cast("double").alias("total_reward"),
        F.sum(F.col("oracle_reward").cast(MONEY)).cast("double").alias("oracle_total"),
        F.count(F.lit(1)).alias("n_rounds"))
    best_arm = (rewards.groupBy("arm").agg(F.sum(F.col("reward").cast(MONEY)).alias("_t"))
                .select(F.max_by("arm", F.struct(F.col("_t"), F.col("arm")))).scalar())
    return per.select(
        "policy", "n_rounds", "total_reward", "oracle_total",
        round_half_up(F.col("oracle_total") - F.col("total_reward"), 2).alias("final_regret"),
        best_arm.alias("oracle_best_arm"))


def arm_pull_counts(choices: DataFrame, rewards: DataFrame) -> DataFrame:
    """Pulls per policy and arm; every arm that has rewards gets a row,
    with zero if the policy never chose it."""
    pulled = choices.groupBy("policy", "arm").agg(F.count(F.lit(1)).alias("pulls"))
    # the arms of a bandit are few: one array, exploded per policy
    arms = rewards.select(F.sort_array(F.collect_set("arm"))).scalar()
    grid = choices.select("policy").distinct().select("policy", F.explode(arms).alias("arm"))
    return grid.join(pulled, ["policy", "arm"], "left").select(
        "policy", "arm", F.coalesce("pulls", F.lit(0)).cast("bigint").alias("pulls"))


# ── U2: one recommendation log ───────────────────────────────────────

def recommendation_log(bids: DataFrame, *shifts: DataFrame) -> DataFrame:
    """Bid and budget-shift recommendations in one log schema (JSON detail).
    A shift is logged for the campaign (or segment) that receives the money; each frame of
    ``shifts`` keeps the type of its ids in the detail."""
    b = bids.select(
        F.col("campaign_id").cast("string").alias("campaign_id"), F.lit("bid_adjustment").alias("action_type"),
        F.to_json(F.struct(F.col("recommended_action").alias("action"),
                           F.col("recommended_change_pct").alias("change_pct"),
                           F.col("recommended_multiplier").alias("multiplier"),
                           F.col("expected_roas_after").alias("expected_roas"))).alias("action_detail"),
        "reasoning", "confidence")
    u = b
    for s in shifts:
        u = u.unionByName(s.select(
            F.col("to_campaign").cast("string").alias("campaign_id"), F.lit("budget_reallocation").alias("action_type"),
            F.to_json(F.struct(F.col("from_campaign").alias("from"), F.col("to_campaign").alias("to"),
                               "amount")).alias("action_detail"),
            "reasoning", "confidence"), allowMissingColumns=True)
    return u.select("*", F.lit("pending").alias("status"))
