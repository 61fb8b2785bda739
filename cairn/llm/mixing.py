"""Mixing sources to target weights by budgets handed down a domain, language, source tree."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, Held, bins_for, by_ids, running

#: Default domains by source; sources not named here are 'other'.
DOMAINS = {"src0": "bulk", **{f"src{i}": "web" for i in range(1, 10)}, **{f"src{i}": "books" for i in range(10, 15)}}
#: Integer weights by path in the tree; a path not named here weighs 1.
WEIGHTS = {"bulk": 2, "web": 5, "books": 3, "other": 2, "web/en": 3, "web/de": 2, "books/en": 2, "web/en/src1": 4, "books/en/src10": 3}

SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words between runs of the six ASCII white-space characters; none in a null text."""
    t = F.coalesce(text, F.lit(""))
    ends = F.when(t.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0) + F.when(F.substring(t, -1, 1).rlike(r"[\x20\x09-\x0D]"), 1).otherwise(0)
    return F.when(t == "", 0).otherwise(F.greatest(F.size(F.split(t, SPACE)) - ends, F.lit(0))).cast("long")


def _lookup(table: Mapping, key: Column, default) -> Column:
    if not table:
        return F.lit(default)
    pairs = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def fill(nodes: DataFrame, parent: list[str], child: str, budget: str, weight: str, cap: str) -> DataFrame:
    """Adds given: the parent's budget shared among its children by weight, none above its cap.

    What a child cannot use goes to its siblings by weight. Children are taken by rising cap per weight: up to some child
    all are filled to the cap, and the rest share what is left. Shares round down. All is integer arithmetic, so
    budget x weight and cap x (sum of weights) must stay below 2**63.
    """
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    rising = by.orderBy(F.when(F.col(weight) > 0, F.col(cap) / F.col(weight)).otherwise(F.lit(float("inf"))), F.col(child))
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    after = rising.rowsBetween(0, Window.unboundedFollowing)
    left = F.col(budget) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    nodes = nodes.withColumn("_full", (F.col(weight) > 0) & (F.col(cap) * F.sum(weight).over(after) <= F.col(weight) * left))
    rest = F.col(budget) - F.coalesce(F.sum(F.when(F.col("_full"), F.col(cap))).over(by), F.lit(0))
    share = F.sum(F.when(F.col("_full"), 0).otherwise(F.col(weight))).over(by)
    nodes = nodes.withColumns({"_rest": rest, "_share": share})
    given = F.when(F.col("_full"), F.col(cap)).when(F.col("_share") > 0, F.least(F.col(cap), F.expr(f"({weight} * _rest) div nullif(_share, 0)"))).otherwise(F.lit(0))
    return nodes.withColumn("given", given.cast("long")).drop("_full", "_rest", "_share")


def budgets(leaves: DataFrame, total: Column, weights: Mapping[str, int], most_epochs: int) -> DataFrame:
    """leaves (domain, lang, source, tokens) -> with given: the tokens that each leaf is to yield.

    A leaf's cap is most_epochs times its tokens; a node's cap is the sum of its children's, of those that weigh more than 0,
    since the others can be given nothing. So a shortage is made up by siblings first; only where a whole subtree is short
    does the node above hand its part to the subtree's siblings.
    """
    weigh = lambda *path: _lookup(weights, F.concat_ws("/", *path), 1).cast("long")
    can = F.sum(F.when(F.col("w") > 0, F.col("cap")).otherwise(0)).cast("long").alias("cap")
    leaves = leaves.withColumns({"cap": F.col("tokens") * most_epochs, "w": weigh("domain", "lang", "source")})
    langs = leaves.groupBy("domain", "lang").agg(can, F.sum("tokens").alias("tokens")).withColumn("w", weigh("domain", "lang"))
    domains = langs.groupBy("domain").agg(can, F.sum("tokens").alias("tokens")).withColumn("w", weigh("domain"))
    everything = Window.partitionBy(F.lit(0))
    domains = domains.withColumn("budget", F.sum("tokens").over(everything)).withColumn("budget", total)
    domains = fill(domains, [], "domain", "budget", "w", "cap").select("domain", F.col("given").alias("budget"))
    langs = fill(langs.join(domains, "domain"), ["domain"], "lang", "budget", "w", "cap").select("domain", "lang", F.col("given").alias("budget"))
    return fill(leaves.join(langs, ["domain", "lang"]), ["domain", "lang"], "source", "budget", "w", "cap").select("domain", "lang", "source", "tokens", "given")


def order_key(seed: int, epoch: Column, key: Column) -> Column:
    """A document's place in a leaf's epoch: the first 15 hex digits of an md5, as a bigint over the whole signed range."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.shiftleft(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") - F.lit(1 << 59), 4)


def mix(docs: DataFrame, domains: Mapping[str, str] = DOMAINS, weights: Mapping[str, int] = WEIGHTS, share: tuple[int, int] = (3, 5), most_epochs: int = 4, seed: int = 17) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, epochs, partial, copies: how often the mix takes each document.

    The mix's size is share[0]/share[1] of the corpus's tokens (words). A leaf takes its whole documents once for each full
    epoch that its budget holds, then, in the seeded order of the next epoch, the documents whose running token count stays
    within the rest. A weight of 0 gives nothing to what is below it, whose part goes to its siblings. Null lang or source: 'unknown'; null or empty texts have no tokens and take part like others. Repeated
    rows are taken separately; equal keys tie by token count and are then alike. An empty table gives an empty result;
    other columns are ignored. A hot leaf is ordered in hash ranges, never by one task.
    """
    held = Held(docs.sparkSession, "mix")
    source = F.coalesce(F.col("source"), F.lit("unknown"))
    rows = docs.select("doc_id", _lookup(domains, source, "other").alias("domain"), F.coalesce(F.col("lang"), F.lit("unknown")).alias("lang"), source.alias("source"), words(F.col("text")).alias("n_tokens"))
    rows = held.put(rows, "rows")
    leaf = ["domain", "lang", "source"]
    leaves = rows.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens"))
    total = F.expr(f"(budget * {int(share[0])}) div {int(share[1])}")
    plan = held.put(budgets(leaves, total, weights, most_epochs), "plan")
    plan = plan.select(*leaf, F.expr("coalesce(given div nullif(tokens, 0), 0)").alias("epochs"), F.expr("given - coalesce(given div nullif(tokens, 0), 0) * tokens").alias("_rest"))
    if plan.count() <= BROADCAST_IDS // 10:
        plan = F.broadcast(plan)
    rows = rows.join(plan, leaf)
    rows = rows.withColumn("_h", order_key(seed, F.col("epochs") + 1, F.col("doc_id")))
    rows = running(rows, leaf, ["_h", "doc_id", "n_tokens"], bins_for(rows.count()), "n_tokens")
    partial = F.when((F.col("_rest") > 0) & (F.col("_before") + F.col("n_tokens") <= F.col("_rest")), 1).otherwise(0)
    return rows.select("doc_id", *leaf, "n_tokens", "epochs", partial.cast("long").alias("partial"), (F.col("epochs") + partial).alias("copies"))


def take(docs: DataFrame, **mix_options) -> DataFrame:
    """The mix's documents with all their columns, as often as it takes them (mix's parameters).

    With one epoch at most, the chosen ids are broadcast if they are few and no text is shuffled; with more, documents are
    joined to their number of copies and repeated. Rows that share a doc_id are taken together, as often as the most taken.
    """
    held = Held(docs.sparkSession, "take")
    picks = mix(docs, **mix_options).filter("copies > 0").groupBy("doc_id").agg(F.max("copies").alias("_copies"))
    picks = held.put(picks, "picks")
    if mix_options.get("most_epochs", 4) == 1:
        return by_ids(docs, picks, "left_semi")
    picks = picks.withColumnRenamed("doc_id", "_taken")
    out = docs.join(picks, docs["doc_id"].eqNullSafe(F.col("_taken")))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).drop("_taken", "_copies", "_copy")
