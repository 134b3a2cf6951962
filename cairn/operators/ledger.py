"""Ledgers: costs, usage, budgets, state folding, and the two-tier routing decision."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions.text import SPACE, confidence, is_json


def cost_per_thousand(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    return F.round(tokens_in / 1000 * price_in + tokens_out / 1000 * price_out, 8)


def cost_per_million(calls: DataFrame, prices: DataFrame, default: tuple[float, float] = (0.15, 0.60)) -> DataFrame:
    """calls (model, tokens_in, tokens_out) with `cost`, rounded to 6 places; models without a price take the default."""
    priced = calls.join(prices.select("model", "price_in", "price_out"), "model", "left")
    at = [F.coalesce(F.col(c), F.lit(d)) for c, d in zip(("price_in", "price_out"), default, strict=True)]
    return priced.withColumn("cost", F.round((F.col("tokens_in") * at[0] + F.col("tokens_out") * at[1]) / 1_000_000, 6)).drop("price_in", "price_out")


def usage(calls: DataFrame, by: list[str]) -> DataFrame:
    """Calls, tokens and cost of each group."""
    return calls.groupBy(*by).agg(F.count("*").alias("calls"), F.sum(F.col("tokens_in") + F.col("tokens_out")).alias("tokens"), F.round(F.sum("cost"), 6).alias("cost"))


@dataclass(frozen=True)
class Budget:
    loops: int = 3
    tokens: int = 50_000
    cost: float = 1.0
    calls: int = 30

    @classmethod
    def of(cls, config: dict) -> Budget:
        """From a mapping, flat or below `budget`; caps may be named max_loops or loop_cap and so on."""
        own = config.get("budget", config)
        names = {"loops": ("max_loops", "loop_cap"), "tokens": ("max_tokens", "token_cap"), "cost": ("max_cost_usd", "dollar_cap"), "calls": ("max_tool_calls", "tool_call_cap")}
        return cls(**{k: next(own[n] for n in ns if n in own) for k, ns in names.items() if any(n in own for n in ns)})


def exceeded(loops: Column, tokens: Column, cost: Column, calls: Column, budget: Budget) -> Column:
    return (loops >= budget.loops) | (tokens >= budget.tokens) | (cost >= budget.cost) | (calls >= budget.calls)


def budget_cut(steps: DataFrame, budget: Budget, by: list[str], order: str) -> DataFrame:
    """steps (by, order, loops, tokens, cost, calls) with running sums and whether the budget is spent after each."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = steps.select(*by, order, *(F.sum(c).over(w).alias(f"total_{c}") for c in ("loops", "tokens", "cost", "calls")))
    return run.withColumn("exceeded", exceeded(F.col("total_loops"), F.col("total_tokens"), F.col("total_cost"), F.col("total_calls"), budget))


def fold_state(deltas: DataFrame, by: list[str], order: str, add: list[str], concat: list[str], last: list[str]) -> DataFrame:
    """The state after all deltas: counters are summed, lists concatenated in order, other fields take their last value that isn't null."""
    agg = [F.sum(c).alias(c) for c in add]
    agg += [F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(c).alias("v")))), lambda x: F.coalesce(x["v"], F.array().cast(deltas.schema[c].dataType)))).alias(c) for c in concat]
    agg += [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in last]
    return deltas.groupBy(*by).agg(*agg)


def new_evidence(rows: DataFrame, held: DataFrame, by: list[str], key: str, order: str) -> DataFrame:
    """Rows whose key the group doesn't hold yet, the first of each key."""
    fresh = rows.join(held.select(*by, key).distinct(), [*by, key], "left_anti")
    w = Window.partitionBy(*by, key).orderBy(order)
    return fresh.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


@dataclass(frozen=True)
class RouterRules:
    threshold: float = 0.75
    on_empty: bool = True
    on_invalid_json: bool = True
    on_low_confidence: bool = True


def escalation(content: Column, require_json: Column, rules: RouterRules, valid: Column | None = None) -> Column:
    """Why a cheap reply must be asked again of the strong tier: the first that holds, else null."""
    sure = confidence(content)
    none = F.lit(None).cast("string")
    out = F.when(F.lit(rules.on_empty) & (F.btrim(content, F.lit(SPACE)) == ""), "empty_response")
    out = out.when(F.lit(rules.on_invalid_json) & require_json & ~is_json(content), "invalid_json")
    out = out.when(F.lit(rules.on_low_confidence) & (sure < rules.threshold), F.format_string("low_confidence:%.2f<%.2f", sure, F.lit(rules.threshold)))
    return out.when(~valid, "validator_failed").otherwise(none) if valid is not None else out.otherwise(none)


def route(replies: DataFrame, rules: RouterRules = RouterRules(), strong_tasks: tuple[str, ...] = (), enabled: bool = True) -> DataFrame:
    """replies (task, content, require_json) with tier, attempts and reason; strong_tasks, or all if routing is off, go to the strong tier at once."""
    direct = F.lit(not enabled) | (F.col("task").isin(*strong_tasks) if strong_tasks else F.lit(False))
    why = F.when(~direct, escalation(F.col("content"), F.col("require_json"), rules))
    return replies.withColumn("reason", why).withColumn("tier", F.when(direct | F.col("reason").isNotNull(), "strong").otherwise("cheap")).withColumn("attempts", F.when(F.col("reason").isNotNull(), 2).otherwise(1))


def free_with_tokens(calls: DataFrame) -> DataFrame:
    """Integrity check: calls that used tokens but cost nothing."""
    return calls.where((F.col("tokens_in") + F.col("tokens_out") > 0) & (F.coalesce(F.col("cost"), F.lit(0.0)) == 0))


def allowed_tools(tools: DataFrame, stages: tuple[str, ...], write_enabled: bool = False) -> DataFrame:
    """Tools (tool, is_write, stage) of the stages that may be called: writing ones only if enabled."""
    return tools.where(F.col("stage").isin(*stages) & (F.lit(write_enabled) | ~F.col("is_write")))


def claims(evidence: DataFrame, by: list[str], passed: Column, most: int = 5) -> DataFrame:
    """The first evidence rows of each run as claims: its content, citation, and whether the tests passed."""
    w = Window.partitionBy(*by).orderBy("ord")
    return evidence.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).select(*by, "ord", "content", "citation", passed.alias("verified"))
