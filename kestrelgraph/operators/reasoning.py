"""Inference over (g, s, r, o, confidence): chains, inheritance, contradictions, rules, traces and spreading activation.

g is the instance: nothing is ever joined across instances.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrelgraph.functions import confidence as C
from kestrelgraph.runtime import materialize

#: Relations that are transitive, that members inherit, and that are handed down; opposites.
TRANSITIVE = ["looks_like", "is", "causes", "leads_to", "part_of"]
INHERITED = ["has", "can", "color", "size", "shape"]
HANDED_DOWN = ["can", "has", "has_property", "eats", "needs"]
OPPOSITE = {"is": "is_not", "can": "cannot", "has": "has_not"}
#: Members of the same categories that are handed something at once; members that are broadcast; shares of what a full lot is handed.
LOT, FEW, SALTS = 4000, 200_000, 8
TRIPLE, FACT = ["s", "r", "o"], ["g", "s", "r", "o"]


def chains(edges: DataFrame, depth: int = 5) -> DataFrame:
    """(g, s, r, o, depth, score): the best product of weights by relation from s to o, and the fewest hops that reach it.

    One join a hop, over the pairs that the hop before improved: weights are at most 1, so a walk that is no better than
    a shorter one leads to nothing better, and cutting a loop out of a walk never lowers its product.
    """
    step = materialize(edges.groupBy(*FACT).agg(F.max(C.weight(F.col("confidence"))).alias("w")))
    e = step.select(F.col("g").alias("eg"), F.col("r").alias("er"), F.col("s").alias("es"), F.col("o").alias("eo"), "w")
    best = step.select(*FACT, F.col("w").alias("score"), F.lit(1).alias("depth"))
    delta = best
    for hop in range(2, depth + 1):
        on = F.col("g").eqNullSafe(F.col("eg")) & (F.col("r") == F.col("er")) & (F.col("o") == F.col("es")) & (F.col("eo") != F.col("s"))
        far = delta.join(e, on).groupBy("g", "s", "r", F.col("eo").alias("o")).agg(F.max(F.col("score") * F.col("w")).alias("score"))
        had = best.groupBy(*[F.col(c).alias(f"h{c}") for c in FACT]).agg(F.max("score").alias("had"))
        same = F.col("g").eqNullSafe(F.col("hg")) & (F.col("s") == F.col("hs")) & (F.col("r") == F.col("hr")) & (F.col("o") == F.col("ho"))
        better = far.join(had, same, "left").where(F.col("had").isNull() | (F.round("score", 9) > F.round("had", 9)))
        delta = materialize(better.select(*FACT, "score", F.lit(hop).alias("depth")))
        if delta.isEmpty():
            break
        best = best.unionByName(delta)
    top = best.groupBy(*FACT).agg(F.max(F.struct(F.round("score", 9).alias("k"), (-F.col("depth")).alias("d"), "score")).alias("b"))
    return top.select(*FACT, (-F.col("b.d")).alias("depth"), F.round("b.score", 6).alias("score"))


def _without(rows: DataFrame, known: DataFrame, keys: Sequence[str] = FACT) -> DataFrame:
    """rows whose keys are not in known; g may be null."""
    k = known.select(*[F.col(c).alias(f"__{c}") for c in keys]).distinct()
    on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys])
    return rows.join(k, on, "left_anti")


def inferred(edges: DataFrame, depth: int = 5) -> DataFrame:
    """The chained facts of more than one hop that are not stated and whose score is kept, with their label."""
    far = chains(edges, depth).where((F.col("depth") > 1) & (F.col("score") >= C.KEPT_FROM - C.SLACK))
    return _without(far, edges).select("*", C.label(F.col("score")).alias("confidence"))


def inherited(membership: DataFrame, properties: DataFrame, depth: int = 3) -> DataFrame:
    """(g, s, r, o, score, confidence): properties of categories that reach their members within `depth` levels.

    membership is edges of one relation, properties is (g, s, r, o, confidence). Score is membership times property
    weight; what the member has already is left out, and the best score holds.
    """
    up = chains(membership, depth).select(F.col("g").alias("mg"), F.col("s").alias("member"), F.col("o").alias("category"), F.col("score").alias("m"))
    p = properties.select("g", F.col("s").alias("ps"), "r", "o", C.weight(F.col("confidence")).alias("w"))
    got = up.join(p, F.col("mg").eqNullSafe(F.col("g")) & (F.col("category") == F.col("ps"))).groupBy("g", F.col("member").alias("s"), "r", "o").agg(F.round(F.max(F.col("m") * F.col("w")), 6).alias("score"))
    return _without(got.where(F.col("score") >= C.KEPT_FROM - C.SLACK), properties).select("*", C.label(F.col("score")).alias("confidence"))


def _opposed(opposite: dict[str, str]):
    return F.create_map(*[F.lit(x) for kv in opposite.items() for x in kv])


def contradictions(facts: DataFrame, opposite: dict[str, str] = OPPOSITE, fresh: DataFrame | None = None) -> DataFrame:
    """(g, s, positive, o): what is stated of a subject together with its opposite.

    With fresh, only conflicts that a fresh fact has part in: each is probed against the stored facts and the other fresh ones.
    """
    back = _opposed({v: k for k, v in opposite.items()})
    split = lambda rows, negative: rows.where(F.col("r").isin([*(opposite.values() if negative else opposite)])).select("g", "s", (back[F.col("r")] if negative else F.col("r")).alias("positive"), "o").distinct()
    both = lambda x, y: _semi(split(x, False), split(y, True), ["g", "s", "positive", "o"])
    if fresh is None:
        return both(facts, facts)
    whole = facts.select(*FACT).unionByName(fresh.select(*FACT))
    return both(fresh, whole).unionByName(both(whole, fresh)).distinct()


def _semi(rows: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    k = known.select(*[F.col(c).alias(f"__{c}") for c in keys])
    return rows.join(k, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]), "left_semi")


def temporal_conflicts(facts: DataFrame, now: Sequence[str] = ("always", "currently")) -> DataFrame:
    """(g, s, o): what a subject both can and cannot among the facts (..., temporal) that hold now."""
    return contradictions(facts.where(F.col("temporal").isin(list(now))), {"can": "cannot"}).select("g", "s", "o")


def propagated(membership: DataFrame, properties: DataFrame, opposite: dict[str, str] = OPPOSITE, handed: Sequence[str] = HANDED_DOWN, few: int = FEW) -> DataFrame:
    """Properties handed one level down, unless the member has them or states the opposite.

    The product of members and properties is neither shuffled nor compared. Members of the same categories are dealt over
    lots of about LOT; a lot gets each property of its categories once, together with the places in the lot of those who
    have it or its opposite, and is listed without them. Up to few members are broadcast.
    """
    same = lambda *pairs: reduce(lambda x, y: x & y, [F.col(x).eqNullSafe(F.col(y)) for x, y in pairs])
    m = membership.select(F.col("g").alias("mg"), F.col("s").alias("member"), F.col("o").alias("category")).where("category is not null")
    m = m.groupBy("mg", "member").agg(F.sort_array(F.collect_set("category")).alias("of"))
    m = m.withColumn("part", F.pmod(F.xxhash64("member"), F.ceil(F.count("*").over(Window.partitionBy("mg", "of")) / LOT)))
    lots = m.groupBy("mg", "of", "part").agg(F.sort_array(F.collect_list(F.struct("member"))).alias("all"))
    lots = materialize(lots.select("mg", "of", F.monotonically_increasing_id().alias("lot"), F.col("all.member").alias("all")))
    most = lots.agg(F.sum(F.size("of") + F.size("all"))).first()[0] or 0
    put = F.broadcast if most <= few else lambda rows: rows
    lots = lots.withColumn("n", F.lit(1) if most <= few else F.least(F.ceil(F.size("all") * SALTS / LOT), F.lit(SALTS)))
    share = (F.col("lot") * SALTS + F.pmod(F.xxhash64("r", "o"), F.col("n"))).alias("lot")

    p = properties.where(F.col("r").isin(list(handed))).join(put(lots.select("mg", "lot", "n", F.explode("of").alias("category"))), same(("g", "mg")) & (F.col("s") == F.col("category")))
    held = properties.select("g", "s", F.explode(F.array("r", _opposed({v: k for k, v in opposite.items()})[F.col("r")])).alias("r"), "o").where(F.col("r").isin(list(handed)))
    held = held.join(put(lots.select("mg", "lot", "n", F.posexplode("all").alias("at", "member"))), same(("g", "mg"), ("s", "member")))
    met = p.select(share, "r", "o", F.lit(None).cast("int").alias("at")).unionByName(held.select(share, "r", "o", "at"))
    met = met.groupBy("lot", "r", "o").agg(F.collect_set("at").alias("barred"), F.max(F.col("at").isNull()).alias("given")).where("given")
    who = lots.select(F.col("mg").alias("g"), F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.col("lot") * SALTS + k)).alias("lot"), "all")
    down = met.join(put(who), "lot").select("g", F.posexplode("all").alias("at", "s"), "r", "o", "barred")
    return down.where(~F.array_contains("barred", F.col("at"))).select(*FACT, F.lit("low").alias("confidence"))


@dataclass(frozen=True)
class Rule:
    """Premises and a conclusion over (subject, relation, object) of one instance; names that start with "?" are variables."""

    name: str
    premises: tuple[tuple[str, str, str], ...]
    conclusion: tuple[str, str, str]

    def ordered(self) -> list[tuple[str, str, str]]:
        """The premises so that each, if it can, shares a variable with those before it; most constants first."""
        left = sorted(self.premises, key=lambda p: sum(x.startswith("?") for x in (p[0], p[2])))
        out, bound = [], set()
        while left:
            pick = next((p for p in left if bound & {p[0], p[2]}), left[0])
            left.remove(pick)
            out.append(pick)
            bound |= {x for x in (pick[0], pick[2]) if x.startswith("?")}
        if any(x.startswith("?") and x not in bound for x in (self.conclusion[0], self.conclusion[2])):
            raise ValueError(f"{self.name}: the conclusion has a variable that no premise binds")
        return out


def _bindings(rule: Rule, facts: DataFrame, fresh: DataFrame | None) -> DataFrame:
    """The variable bindings of a rule's premises; with fresh, only those that use a fresh fact somewhere."""
    premises = rule.ordered()
    total = None
    for use in range(len(premises)) if fresh is not None else [-1]:
        rows = None
        for i, (s, r, o) in enumerate(premises):
            source = (fresh if i == use else facts).where(F.col("r") == r)
            for column, term in (("s", s), ("o", o)):
                if not term.startswith("?"):
                    source = source.where(F.col(column) == term)
            if s == o and s.startswith("?"):
                source = source.where("s = o")
            names = {f"v_{term[1:]}": column for column, term in (("s", s), ("o", o)) if term.startswith("?")}
            part = source.select("g", *[F.col(c).alias(n) for n, c in names.items()]).distinct()
            if rows is None:
                rows = part
                continue
            shared = [n for n in names if n in rows.columns]
            if not shared:
                raise ValueError(f"{rule.name}: premise {i} shares no variable with those before it")
            rows = rows.join(part, ["g", *shared])
        total = rows if total is None else total.unionByName(rows)
    return total.distinct()


def conclusions(rule: Rule, facts: DataFrame, fresh: DataFrame | None = None) -> DataFrame:
    s, r, o = rule.conclusion
    term = lambda t: F.col(f"v_{t[1:]}") if t.startswith("?") else F.lit(t)
    return _bindings(rule, facts, fresh).select("g", term(s).alias("s"), F.lit(r).alias("r"), term(o).alias("o")).distinct()


def dry_run(rules: Sequence[Rule], facts: DataFrame) -> DataFrame:
    """(rule, g, s, r, o, known): what each rule would derive, and whether it is known already."""
    known = facts.select(*FACT).distinct().withColumn("known", F.lit(True))
    all_ = reduce(DataFrame.unionByName, [conclusions(rule, facts).withColumn("rule", F.lit(rule.name)) for rule in rules])
    return all_.join(known, FACT, "left").select("rule", *FACT, F.coalesce("known", F.lit(False)).alias("known"))


def forward_chain(rules: Sequence[Rule], facts: DataFrame, rounds: int = 10, exceptions: DataFrame | None = None) -> DataFrame:
    """(g, s, r, o, round): the facts that the rules derive until nothing new comes, semi-naively.

    From the second round on only derivations that use a fact of the round before are joined. exceptions (r, er, eo)
    blocks conclusions of relation r for subjects that have the fact (er, eo). Facts without an instance derive nothing.
    """
    known = materialize(facts.select(*FACT).where("g is not null").distinct())
    fresh, derived = None, None
    for k in range(1, rounds + 1):
        new = reduce(DataFrame.unionByName, [conclusions(rule, known, fresh) for rule in rules]).distinct().join(known, FACT, "left_anti")
        if exceptions is not None:
            x = exceptions.select(F.col("r").alias("xr"), "er", "eo")
            blocked = known.join(x, (F.col("r") == F.col("er")) & (F.col("o") == F.col("eo"))).select("g", "s", F.col("xr").alias("r")).distinct()
            new = new.join(blocked, ["g", "s", "r"], "left_anti")
        fresh = materialize(new)
        if fresh.isEmpty():
            break
        step = fresh.withColumn("round", F.lit(k))
        derived = step if derived is None else derived.unionByName(step)
        known = known.unionByName(fresh)
    return derived if derived is not None else facts.select(*FACT, F.lit(0).alias("round")).limit(0)


def learned_exceptions(expected: DataFrame, facts: DataFrame) -> DataFrame:
    """(r, er, eo, subjects): exceptions to learn where a subject denies what a rule expects of it.

    expected is (g, s, r, o). A subject that states the opposite gives its first fact by is, has or has_property as the
    exception to relation r.
    """
    against = facts.where(F.col("r").isin(list(OPPOSITE.values()))).select("g", "s", _opposed({v: k for k, v in OPPOSITE.items()})[F.col("r")].alias("r"), "o")
    denied = _semi(expected.select(*FACT).distinct(), against, FACT)
    order = F.when(F.col("fr") == "is", 0).when(F.col("fr") == "has", 1).otherwise(2)
    own = facts.where(F.col("r").isin("is", "has", "has_property")).select(F.col("g").alias("fg"), F.col("s").alias("fs"), F.col("r").alias("fr"), F.col("o").alias("fo"))
    first = own.groupBy("fg", "fs").agg(F.min(F.struct(order.alias("k"), "fo", "fr")).alias("f"))
    got = denied.join(first, F.col("g").eqNullSafe(F.col("fg")) & (F.col("s") == F.col("fs")))
    return got.groupBy("r", F.col("f.fr").alias("er"), F.col("f.fo").alias("eo")).agg(F.count_distinct("g", "s").alias("subjects"))


def traces(identity: DataFrame, facts: DataFrame, relations: Sequence[str], depth: int = 4) -> DataFrame:
    """(g, s, r, o, steps, path): why a subject has a property: its own fact, or the nearest ancestor's within `depth`.

    The walk goes down from those who state the property, so only nodes below one are visited.
    """
    down = identity.select(F.col("g").alias("ug"), F.col("s").alias("us"), F.col("o").alias("uo")).distinct()
    p = materialize(facts.where(F.col("r").isin(list(relations))).select(*FACT).distinct())
    holders = p.select("g", F.col("s").alias("at")).distinct()
    level = holders.select("g", F.col("at").alias("s"), "at", F.col("at").alias("path"), F.lit(0).alias("steps"))
    levels = [level]
    for k in range(1, depth + 1):
        step = level.join(down, F.col("g").eqNullSafe(F.col("ug")) & (F.col("s") == F.col("uo")))
        level = materialize(step.groupBy("g", F.col("us").alias("s"), "at").agg(F.min(F.concat_ws(">", "us", "path")).alias("path")).withColumn("steps", F.lit(k)))
        levels.append(level)
    ways = reduce(DataFrame.unionByName, levels).select(F.col("g").alias("wg"), F.col("s").alias("ws"), "at", "path", "steps")
    hits = ways.join(p, F.col("wg").eqNullSafe(F.col("g")) & (F.col("at") == F.col("s")))
    first = hits.groupBy("g", "ws", "r", "o").agg(F.min(F.struct("steps", "path")).alias("w"))
    return first.select("g", F.col("ws").alias("s"), "r", "o", "w.steps", "w.path")


def spread(edges: DataFrame, levels: DataFrame, rounds: int = 2, share: float = 0.5, least: float = 0.1, cap: float = 2.0) -> DataFrame:
    """(g, node, level, sources): activation after some rounds: active nodes add half of their level, times the edge's
    weight, to each neighbour.

    levels is (g, node, level), edges (g, s, o, weight). Parallel edges count each. sources counts the different nodes
    that reached a node; they are never gathered, so a hub is only aggregated.
    """
    e = edges.select(F.col("g").alias("eg"), F.col("s").alias("es"), F.col("o").alias("eo"), "weight")
    state, reached = levels.select("g", "node", "level"), None
    for _ in range(rounds):
        active = state.where(F.col("level") >= least).join(e, F.col("g").eqNullSafe(F.col("eg")) & (F.col("node") == F.col("es")))
        sent = active.select("g", F.col("eo").alias("to"), "node", (F.col("level") * share * F.col("weight")).alias("level"))
        pairs = sent.select("g", F.col("to").alias("node"), F.col("node").alias("source"))
        reached = pairs if reached is None else reached.unionByName(pairs)
        state = materialize(state.unionByName(sent.select("g", F.col("to").alias("node"), "level")).groupBy("g", "node").agg(F.least(F.sum("level"), F.lit(cap)).alias("level")))
    counts = reached.distinct().groupBy(F.col("g").alias("cg"), F.col("node").alias("cn")).agg(F.count("*").alias("sources"))
    both = state.join(counts, F.col("g").eqNullSafe(F.col("cg")) & (F.col("node") == F.col("cn")), "left")
    return both.select("g", "node", F.round("level", 6).alias("level"), F.coalesce("sources", F.lit(0)).alias("sources"))


def coactivated(spreaded: DataFrame, sources: int = 2, level: float = 0.3) -> DataFrame:
    """Nodes that several sources reached and whose level is high enough."""
    return spreaded.where((F.col("sources") >= sources) & (F.col("level") >= level))
