"""Mixing sources to target weights by hierarchical budgeting.

A plan's weights are propagated through a tree domain - language - source. A leaf that can't fill its
budget (tokens x greatest number of uses) leaves the shortage to its siblings, what they can't take to
the other languages of the domain, and only then to other domains. Each leaf then takes whole seeded
epochs and a token prefix of one more, so a document is used at most ``max_repeats`` times.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping
from dataclasses import dataclass
from types import MappingProxyType

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Spellings of languages; everything else is "und".
LANGUAGES = {"en": ["en", "eng", "english", "en-gb", "en-us", "en_gb", "en_us"], "de": ["de", "ger", "deu", "german", "deutsch", "de-de", "de_de"], "fr": ["fr", "fre", "fra", "french", "français", "francais", "fr-fr", "fr_fr"]}
SLICES = 4096
#: Without domains each source is a domain of its own.
NO_DOMAINS: Mapping[str, str] = MappingProxyType({})


@dataclass
class Leaf:
    """A source's documents in one language: tokens at hand, greatest uses, weight, and the budget given."""

    domain: str
    language: str
    source: str
    tokens: int
    repeats: int
    weight: float
    budget: float = 0.0

    @property
    def capacity(self) -> float:
        return float(self.tokens * self.repeats)


def _fill(weights: list[float], capacities: list[float], budget: float) -> list[float]:
    """``budget`` shared by weight; what a full one can't take goes to the others by weight."""
    given = [0.0] * len(weights)
    open_ = [i for i, c in enumerate(capacities) if c > 0]
    left = budget
    while open_ and left > 1e-9:
        total = sum(weights[i] for i in open_)
        shares = {i: left * (weights[i] / total if total > 0 else 1 / len(open_)) for i in open_}
        full = [i for i in open_ if given[i] + shares[i] >= capacities[i] - 1e-9]
        if not full:
            for i in open_:
                given[i] += shares[i]
            break
        for i in full:
            left -= capacities[i] - given[i]
            given[i] = capacities[i]
        open_ = [i for i in open_ if i not in full]
    return given


def budgets(leaves: list[Leaf], total: float) -> list[Leaf]:
    """Gives each leaf its budget, from the root down: a node's own leaves take up its shortages first."""

    def share(nodes: list[Leaf], budget: float, levels: tuple[str, ...]) -> None:
        if not levels:
            for leaf, b in zip(nodes, _fill([x.weight for x in nodes], [x.capacity for x in nodes], budget)):
                leaf.budget = b
            return
        children = defaultdict(list)
        for leaf in nodes:
            children[getattr(leaf, levels[0])].append(leaf)
        groups = list(children.values())
        for group, b in zip(groups, _fill([sum(x.weight for x in g) for g in groups], [sum(x.capacity for x in g) for g in groups], budget)):
            share(group, b, levels[1:])

    share(leaves, total, ("domain", "language"))
    return leaves


def language(lang: Column) -> Column:
    """"en", "de", "fr" or "und", whatever the spelling."""
    known = F.create_map(*[x for code, names in LANGUAGES.items() for n in names for x in (F.lit(n), F.lit(code))])
    return F.coalesce(F.element_at(known, F.coalesce(F.lower(F.trim(lang)), F.lit(""))), F.lit("und"))


def plan_leaves(sizes: list[tuple[str, str, int]], targets: list[tuple[str, float, int]], domains: Mapping[str, str] = NO_DOMAINS) -> list[Leaf]:
    """The leaves of a plan: a source's weight falls to its languages by their tokens.

    A source without tokens keeps its weight in a leaf without capacity, in the languages of its
    domain, so that its siblings take its share.
    """
    by_source: dict[str, dict[str, int]] = defaultdict(dict)
    for source, lang, tokens in sizes:
        by_source[source][lang] = tokens
    named = {s for s, _, _ in targets}
    of_domain: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
    for source in named & by_source.keys():
        for lang, tokens in by_source[source].items():
            of_domain[domains.get(source, source)][lang] += tokens
    leaves = []
    for source, weight, repeats in targets:
        domain = domains.get(source, source)
        own = by_source.get(source, {})
        spread = own if sum(own.values()) else dict(of_domain[domain]) or {"und": 1}
        total = sum(spread.values()) or 1
        leaves += [Leaf(domain, lang, source, own.get(lang, 0), repeats, weight * tokens / total) for lang, tokens in spread.items()]
    return leaves


def exact_total(leaves: list[Leaf]) -> float:
    """The greatest total at which every source that has documents gets its full share (shares of absent sources fall to their siblings)."""
    low, high = 0.0, sum(x.capacity for x in leaves)
    absent = {x.source for x in leaves} - {x.source for x in leaves if x.tokens}

    def met(total: float) -> bool:
        budgets(leaves, total)
        given: dict[str, float] = defaultdict(float)
        wanted: dict[str, float] = defaultdict(float)
        for x in leaves:
            given[x.source] += x.budget
            wanted[x.source] += x.weight * total
        return all(given[s] >= wanted[s] * (1 - 1e-6) for s in wanted if s not in absent)

    if met(high):
        return high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if met(middle) else (low, middle)
    return low


def planned(sized: DataFrame, targets: DataFrame, *, total_tokens: int | None = None, totals: Mapping[str, int] | None = None, policy: str = "one_epoch", domains: Mapping[str, str] = NO_DOMAINS, most_targets: int = 10_000) -> dict[str, list[Leaf]]:
    """The leaves of each plan with their budgets.

    ``totals`` has the corpus size in tokens of single plans, ``total_tokens`` that of all others; None
    takes, by ``policy``, the plan's tokens at hand ("one_epoch") or the greatest size that leaves no source short ("exact").
    The driver sees one row per source and language that a plan names: a targets table of more than ``most_targets`` rows is refused.
    """
    plans: dict[str, list[tuple[str, float, int]]] = defaultdict(list)
    rows = targets.select("mix_plan", "source", "target_share", "max_repeats").where("mix_plan is not null and source is not null").limit(most_targets + 1).collect()
    if len(rows) > most_targets:
        raise ValueError(f"more than {most_targets} targets")
    for r in rows:
        plans[r["mix_plan"]].append((r["source"], float(r["target_share"] or 0), int(r["max_repeats"] or 0)))
    named = F.broadcast(targets.select("source").distinct())  # at most most_targets rows, checked above
    docs = sized.where("n_tokens > 0 and source is not null").select("source", language(F.col("lang")).alias("language"), F.col("n_tokens").cast("bigint").alias("n_tokens"))
    sizes = [tuple(r) for r in docs.join(named, "source", "left_semi").groupBy("source", "language").agg(F.sum("n_tokens")).collect()]
    out = {}
    for plan, wanted in sorted(plans.items()):
        leaves, own = plan_leaves(sizes, wanted, domains), {s for s, _, _ in wanted}
        total = (totals or {}).get(plan, total_tokens)
        if total is None:
            total = exact_total(leaves) if policy == "exact" else sum(n for s, _, n in sizes if s in own)
        out[plan] = budgets(leaves, float(total))
    return out


def mix(sized: DataFrame, plans: Mapping[str, list[Leaf]], *, key: str = "doc_id", seed: int = 20260626) -> DataFrame:
    """(mix_plan, key, source, language, n_tokens, n_used) of every document that a plan uses.

    ``sized`` has key, source, lang and n_tokens; it is read again, so it should be written or
    checkpointed. ``plans`` are those of ``planned``. Documents without tokens or without a source in the plan aren't used.
    """
    spark = sized.sparkSession
    docs = sized.where("n_tokens > 0 and source is not null").select(F.col(key).alias("k"), "source", language(F.col("lang")).alias("language"), F.col("n_tokens").cast("bigint").alias("n_tokens"))
    table = []
    for plan, leaves in plans.items():
        for leaf in leaves:
            if leaf.tokens and leaf.budget > 0:
                epochs = min(int(leaf.budget // leaf.tokens + 1e-9), leaf.repeats)
                table.append((plan, leaf.source, leaf.language, epochs, leaf.budget - epochs * leaf.tokens if epochs < leaf.repeats else 0.0))
    schema = "mix_plan string, source string, language string, epochs int, rest double"
    leaf_df = F.broadcast(spark.createDataFrame(table, schema))
    # the order of a leaf's last epoch is a hash; its slices' sums show where the prefix ends
    placed = docs.join(leaf_df, ["source", "language"]).withColumn("order", F.xxhash64(F.lit(seed), "epochs", "k")).withColumn("slice", F.shiftrightunsigned("order", 52).cast("int"))
    leaf_key = ["mix_plan", "source", "language"]
    sums = placed.groupBy(*leaf_key, "rest", "slice").agg(F.sum("n_tokens").alias("w"))
    before = F.sum("w").over(Window.partitionBy(*leaf_key).orderBy("slice")) - F.col("w")
    edge = sums.withColumn("before", before).where("before < rest").groupBy(*leaf_key).agg(F.max(F.struct("slice", "before")).alias("e")).select(*leaf_key, F.col("e.slice").alias("edge"), F.col("e.before").alias("edge_before"))
    marked = placed.join(F.broadcast(edge), leaf_key, "left")  # one row per leaf
    whole = marked.where("edge is null or slice != edge").withColumn("extra", F.coalesce((F.col("slice") < F.col("edge")).cast("int"), F.lit(0)))
    # within the slice where the prefix ends (1/4096 of a leaf) the documents are put in order
    run = F.sum("n_tokens").over(Window.partitionBy(*leaf_key).orderBy("order", "k")) - F.col("n_tokens")
    part = marked.where("slice = edge").withColumn("extra", (F.col("edge_before") + run + F.col("n_tokens") / 2 <= F.col("rest")).cast("int"))
    used = whole.unionByName(part).withColumn("n_used", F.col("epochs") + F.col("extra")).where("n_used > 0")
    return used.select("mix_plan", F.col("k").alias(key), "source", "language", "n_tokens", "n_used")


def shares(mixed: DataFrame, targets: DataFrame, plans: Mapping[str, list[Leaf]]) -> DataFrame:
    """What each source of each plan reached.

    (mix_plan, source, target_share, planned_share, actual_share, tokens, documents, most_used, max_repeats):
    the planned share is that of the budgets, after redistribution; the actual one differs from it by
    less than one document in each language, as documents are used whole.
    """
    budget: dict[tuple[str, str], float] = defaultdict(float)
    total: dict[str, float] = defaultdict(float)
    for plan, leaves in plans.items():
        for leaf in leaves:
            budget[plan, leaf.source] += leaf.budget
            total[plan] += leaf.budget
    rows = [(plan, source, round(b / total[plan], 6) if total[plan] else 0.0) for (plan, source), b in budget.items()]
    plan_df = mixed.sparkSession.createDataFrame(rows, "mix_plan string, source string, planned_share double")
    used = F.sum(F.col("n_tokens") * F.col("n_used")).alias("tokens")
    by = mixed.groupBy("mix_plan", "source").agg(used, F.count(F.lit(1)).alias("documents"), F.max("n_used").alias("most_used"))
    whole = by.groupBy("mix_plan").agg(F.sum("tokens").alias("all_tokens"))
    out = targets.select("mix_plan", "source", "target_share", "max_repeats").join(by, ["mix_plan", "source"], "left").join(whole, "mix_plan", "left").join(plan_df, ["mix_plan", "source"], "left")
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    actual = F.coalesce(F.round(F.col("tokens") / F.col("all_tokens"), 6), F.lit(0.0)).alias("actual_share")
    return out.select("mix_plan", "source", "target_share", F.coalesce("planned_share", F.lit(0.0)).alias("planned_share"), actual, none("tokens"), none("documents"), none("most_used"), "max_repeats")
