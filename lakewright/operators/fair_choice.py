"""Fair choice of leads: gaps take turns, each takes its best lead that is left, no host more than its share, until a round's budget is spent.

Of the leads of one gap and host only the best few can ever be taken (a host's share), and of those of one gap only as many as may be passed over
before the budget is spent.  So each scope's leads are cut, exactly, to a set that its budget bounds, by ranks that Spark limits before it
shuffles; only that set is dealt in turns.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakewright.plans.registry import query

LEAD = "scope string, place int, url string, why string"


def dealt(gaps: list[str], leads: Iterable[dict], limit: int, per_host: int, roots: int) -> list[tuple[str, str]]:
    """(url, why) of the chosen leads, in order, from leads in order of rank: url, host, gaps, pinned, portal, root.

    Pinned leads come first, whatever their host has; then, if there is room for two at least, the best portal; then the gaps take turns.  At the
    end the best `roots` roots that are not chosen get a place: a free one, or that of the last chosen that is no root, never the first's.
    """
    leads = list(leads)
    chosen: dict[str, str] = {x["url"]: "pinned" for x in [x for x in leads if x["pinned"]][:limit]}
    held: dict[str, int] = {}

    def take(lead: dict, why: str) -> None:
        chosen[lead["url"]] = why
        held[lead["host"]] = held.get(lead["host"], 0) + 1

    portal = next((x for x in leads if x["portal"]), None)
    if limit > 1 and portal and portal["url"] not in chosen and len(chosen) < limit:
        take(portal, "portal")
    left = {gap: iter([x for x in leads if gap in x["gaps"]]) for gap in gaps}
    open_gaps = list(gaps)
    while len(chosen) < limit and open_gaps:
        still = []
        for gap in open_gaps:
            # what is passed over once stays so: chosen leads stay chosen, full hosts stay full
            lead = next((x for x in left[gap] if x["url"] not in chosen and held.get(x["host"], 0) < per_host), None)
            if lead and len(chosen) < limit:
                take(lead, gap)
                still.append(gap)
        open_gaps = still
    order = list(chosen.items())
    is_root = {x["url"]: x["root"] for x in leads}
    if limit > 1:
        for root in [x for x in leads if x["root"] and x["url"] not in chosen][:roots]:
            if len(order) < limit:
                order.append((root["url"], "root"))
            else:
                at = next((i for i in range(len(order) - 1, 0, -1) if not is_root.get(order[i][0])), None)
                if at is not None:
                    order[at] = (root["url"], "root")
    return order


def fair_choice(leads: DataFrame, gaps: DataFrame, limit: int, per_host: int = 2, roots: int = 0) -> DataFrame:
    """(scope, place, url, why) of leads(scope, url, host, score, gaps, pinned, portal, root) for the open gaps(scope, gap, turn).

    Rank is by falling score, ties by address; a lead of no open gap can be chosen only as a pinned one, portal or root.  An address is one lead in a scope: of several rows the one of
    the highest score counts.  A scope without gaps or leads has no choice; nulls in gaps, host or score are none, empty and lowest.
    """
    rank = [F.desc_nulls_last("score"), F.asc("url")]
    one = leads.groupBy("scope", "url").agg(F.max_by(F.struct(F.coalesce("host", F.lit("")).alias("host"), "score", F.coalesce("gaps", F.array().cast("array<string>")).alias("gaps"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("pinned", "portal", "root"))), F.struct(F.coalesce("score", F.lit(float("-inf"))), "host")).alias("x")).select("scope", "url", "x.*")
    asked = gaps.groupBy("scope", "gap").agg(F.min("turn").alias("turn"))
    by_gap = one.select("scope", "url", "host", "score", F.explode(F.array_distinct("gaps")).alias("gap")).join(asked.select("scope", "gap"), ["scope", "gap"])
    within = lambda rows, keys, most: rows.withColumn("_w", F.row_number().over(Window.partitionBy(*keys).orderBy(*rank))).where(F.col("_w") <= most)
    # pinned leads and a portal do not all count for a host's share, so as many more of a host may be chosen beside it
    more = one.where("pinned").groupBy("scope").agg(F.least(F.count("*"), F.lit(limit)).alias("_p"))
    spare = by_gap.join(more, "scope", "left").withColumn("_n", F.row_number().over(Window.partitionBy("scope", "gap", "host").orderBy(*rank))).where(F.col("_n") <= per_host + limit).where(F.col("_n") <= per_host + F.coalesce("_p", F.lit(0)))
    few = within(spare, ("scope", "gap"), (limit + 1) ** 2).select("scope", "url")
    special = [within(one.where(kind), ("scope",), most).select("scope", "url") for kind, most in (("pinned", limit), ("portal", 1), ("root", limit + roots))]
    needed = few.union(special[0]).union(special[1]).union(special[2]).distinct()
    turns = asked.groupBy("scope").agg(F.array_sort(F.collect_list(F.struct("turn", "gap"))).alias("turns"))
    bounded = one.join(needed, ["scope", "url"]).join(turns, "scope").select("scope", "url", "host", "score", "gaps", "pinned", "portal", "root", F.col("turns.gap").alias("turns"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values(["score", "url"], ascending=[False, True], na_position="last")
        order = dealt(list(rows.turns.iloc[0]), [{**r, "gaps": set(r["gaps"])} for r in rows.to_dict("records")], limit, per_host, roots)
        return pd.DataFrame({"scope": rows.scope.iloc[0], "place": range(1, len(order) + 1), "url": [u for u, _ in order], "why": [w for _, w in order]})

    return bounded.groupBy("scope").applyInPandas(run, LEAD)


@query("fair_leads")
def fair_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve leads for each top-level domain among the pages: gaps are the kinds of elements that a page may have, scores their number."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("url", F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    names = ("h2", "form", "table", "li", "aside", "b", "footer", "script")
    has = F.filter(F.array(*(F.when(F.col("html").rlike(f"<{n}[ >]"), n) for n in names)), lambda x: x.isNotNull())
    score = F.regexp_count("html", F.lit("<p[ >]")).cast("double")
    leads = pages.select(F.regexp_extract("host", r"\.([a-z]+)$", 1).alias("scope"), "url", "host", score.alias("score"), has.alias("gaps"), F.lit(False).alias("pinned"), F.col("url").rlike("/(?:fr|en)/").alias("portal"), F.col("url").rlike(r"\?page=").alias("root"))
    gaps = leads.select("scope").distinct().select("scope", F.posexplode(F.array(*map(F.lit, names))).alias("turn", "gap"))
    return fair_choice(leads, gaps, 12, 2, 2)
