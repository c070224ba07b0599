"""Best representative of each duplicate group, field by field.

A field rule names the output, the condition under which a record can give it and the
order in which records are preferred (completeness, trust, recency, key). Every record
becomes one candidate for each rule it satisfies, in one scan for all rules, and a window orders
the candidates of (group, rule). Spark applies the ``row_number() <= k`` limit inside each partition
before the shuffle, so a group that holds a third of all rows sends at most ``k`` candidates a
rule from each partition; no group is ever gathered whole.

Defined cases: records without a group key belong to no group; a rule that no record of a
group satisfies gives null; equal ranks are broken by the larger record key; repeated rows
are equal candidates and one of them wins.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FieldRule:
    """Take ``value`` for the output ``name`` from the best record where ``when`` holds; ``prefer``: descending."""

    name: str
    value: Column
    prefer: list[Column] = field(default_factory=list)
    when: Column | None = None


def completeness(*columns: Column) -> Column:
    """How many of the columns hold more than blanks."""
    score = F.lit(0)
    for c in columns:
        score = score + F.when(F.length(F.trim(c.cast("string"))) > 0, 1).otherwise(0)
    return score


def trust(source: Column, weights: dict[str, float], default: float = 0.0) -> Column:
    """A source's trust from a fixed table."""
    if not weights:
        return F.lit(default)
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return F.coalesce(F.try_element_at(table, source), F.lit(default))


def source_trust(df: DataFrame, source: Column, *columns: Column) -> DataFrame:
    """(source, trust): how complete a source's records are on average, in thousandths; a measure where no table of trust is given."""
    score = F.sum(completeness(*columns).cast("long"))
    return df.groupBy(source.alias("source")).agg((score * 1000 / F.count("*")).cast("long").alias("trust"))


def survivors(df: DataFrame, group: Column, key: Column, rules: list[FieldRule], min_size: int = 1, group_name: str = "group") -> DataFrame:
    """(group_name, one column for each rule) of the groups with at least ``min_size`` records. One scan for all rules."""
    # a rule that every record satisfies also tells, by its first candidates, whether the group is large enough
    free = next((i for i, r in enumerate(rules) if r.when is None), len(rules))
    used = rules if free < len(rules) else [*rules, FieldRule("__size", key)]
    depth = max(len(r.prefer) for r in used)
    columns = [group.alias("__g"), key.alias("__key")]
    for i, r in enumerate(used):
        ok = F.lit(True) if r.when is None else F.coalesce(r.when, F.lit(False))
        columns += [r.value.alias(f"__v{i}"), ok.alias(f"__ok{i}"), *[p.alias(f"__p{i}_{depth - len(r.prefer) + j}") for j, p in enumerate(r.prefer)]]
    base = df.select(columns).where(F.col("__g").isNotNull())
    kind = {f.name: f.dataType for f in base.schema}

    def place(j: int) -> str:
        """The common type of the rules' preferences at one place, counted from the last."""
        found = {kind[f"__p{i}_{j}"].simpleString() for i in range(len(used)) if f"__p{i}_{j}" in kind}
        return found.pop() if len(found) == 1 else "decimal(38,9)"

    candidates = []
    for i in range(len(used)):
        values = [(F.col(f"__v{i}") if j == i else F.lit(None).cast(kind[f"__v{j}"])).alias(f"v{j}") for j in range(len(used))]
        ranks = [(F.col(f"__p{i}_{j}") if f"__p{i}_{j}" in kind else F.lit(None)).cast(place(j)).alias(f"p{j}") for j in range(depth)]
        candidates.append(F.when(F.col(f"__ok{i}"), F.struct(F.lit(i).alias("rule"), *ranks, *values)))
    each = base.select("__g", "__key", F.explode(F.array_compact(F.array(*candidates))).alias("c")).select("__g", "__key", "c.*")
    best_first = [F.col(f"p{j}").desc_nulls_last() for j in range(depth)] + [F.col("__key").desc_nulls_last()]
    rank = F.row_number().over(Window.partitionBy("__g", "rule").orderBy(*best_first))
    kept = each.withColumn("n", rank).where(F.col("n") <= max(1, min_size))
    first = lambda i: F.max(F.when((F.col("rule") == i) & (F.col("n") == 1), F.col(f"v{i}")))
    size = F.max(F.when(F.col("rule") == free, F.col("n"))).alias("__size")
    best = kept.groupBy("__g").agg(size, *[first(i).alias(r.name) for i, r in enumerate(rules)])
    return best.where(F.col("__size") >= min_size).select(F.col("__g").alias(group_name), *[r.name for r in rules])
