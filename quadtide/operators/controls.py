"""Control sets: visibility expressions, validation, access and roll-up, all as array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import paired_token

# The namespaces of the generic policy and the ranks of its classes.
SENSITIVE = ("CLS", "LBL")
SHARED = ("ENTITY",)
RANKS = {"U": 0, "R": 1}


def of_namespace(controls: Column, name: str) -> Column:
    """The tokens of a namespace in order, without repeats."""
    return F.array_sort(F.array_distinct(F.filter(controls, lambda t: t.startswith(f"{name}:"))))


def expression(controls: Column, sensitive: tuple[str, ...] = SENSITIVE, shared: tuple[str, ...] = SHARED) -> Column:
    """Sensitive tokens and-ed, each shared namespace in parentheses with its tokens or-ed."""
    parts = [of_namespace(controls, n) for n in sensitive]
    for n in shared:
        own = of_namespace(controls, n)
        parts.append(F.when(F.size(own) > 0, F.array(F.concat(F.lit("("), F.array_join(own, "|"), F.lit(")")))).otherwise(F.array().cast("array<string>")))
    return F.array_join(F.flatten(F.array(*parts)), "&")


def accessible(controls: Column, auths: Column, sensitive: tuple[str, ...] = SENSITIVE, shared: tuple[str, ...] = SHARED) -> Column:
    """Whether the authorisations satisfy :func:`expression`: every sensitive token, and one of each shared namespace that occurs."""
    out = F.lit(True)
    for n in sensitive:
        out = out & F.forall(of_namespace(controls, n), lambda t: F.array_contains(auths, t))
    for n in shared:
        out = out & ((F.size(of_namespace(controls, n)) == 0) | F.arrays_overlap(of_namespace(controls, n), auths))
    return out


def permitted(policies: Column, known: dict[str, Column]) -> Column:
    """All policies of a row must be known and grant access; a row without policy is closed."""
    granted = F.create_map(*(c for name, access in known.items() for c in (F.lit(name), access)))
    return F.coalesce(F.size(policies) > 0, F.lit(False)) & F.forall(policies, lambda p: F.coalesce(F.try_element_at(granted, p), F.lit(False)))


def errors(controls: Column) -> Column:
    """Array of the codes of all that is wrong with a control set; empty if nothing is."""
    tokens = F.transform(controls, paired_token)
    broken = F.exists(tokens, lambda t: t.isNull())
    spaces = F.array_distinct(F.transform(tokens, lambda t: t["prefix"]))
    classes = F.array_distinct(F.transform(F.filter(tokens, lambda t: t["prefix"] == "CLS"), lambda t: t["value"]))
    unknown = F.exists(spaces, lambda s: ~s.isin(*SENSITIVE, *SHARED))
    of_class = (
        F.when(F.size(classes) == 0, "no class").when(F.size(classes) > 1, "many classes").when(~classes[0].isin(*RANKS), "bad class")
        .when((classes[0] == "U") & (F.size(spaces) > 1), "open with tags")
    )
    found = F.when(broken, F.array(F.lit("bad token"))).otherwise(F.array(F.when(unknown, "unknown namespace"), of_class))
    return F.filter(found, lambda e: e.isNotNull())


def roll_up(portions: DataFrame, keys: list[str], controls: str = "controls") -> DataFrame:
    """One control set a key: union of sensitive tokens with the highest class, intersection of shared ones.

    ``conflict`` tells that portions with shared tokens have none in common; a header cannot mark them then. Tokens are
    counted by portion, so no group is gathered in one task.
    """
    rows = portions.withColumn("_n", F.monotonically_increasing_id()).withColumn("_t", F.explode(F.array_distinct(controls)))
    rows = rows.withColumn("_space", F.substring_index("_t", ":", 1))
    total = rows.groupBy(*keys, "_space").agg(F.countDistinct("_n").alias("_portions"))
    tokens = rows.groupBy(*keys, "_space", "_t").agg(F.count("*").alias("_c")).join(total, [*keys, "_space"])
    keep = ~F.col("_space").isin(*SHARED) | (F.col("_c") == F.col("_portions"))
    rank = F.when(F.col("_space") == "CLS", F.coalesce(*(F.when(F.col("_t") == f"CLS:{c}", r) for c, r in RANKS.items()), F.lit(-1)))
    shared = F.col("_space").isin(*SHARED)
    out = tokens.groupBy(*keys).agg(
        F.collect_list(F.when(keep & (F.col("_space") != "CLS"), F.col("_t"))).alias("_rest"),
        F.max(F.when(F.col("_space") == "CLS", F.struct(rank.alias("r"), F.col("_t").alias("t")))).alias("_cls"),
        (F.max(shared.cast("int")) > F.max((shared & keep).cast("int"))).alias("conflict"),
    )
    merged = F.array_sort(F.concat("_rest", F.when(F.col("_cls").isNotNull(), F.array("_cls.t")).otherwise(F.array().cast("array<string>"))))
    return out.select(*keys, merged.alias(controls), "conflict")
