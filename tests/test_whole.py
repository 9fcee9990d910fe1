"""Queries read all rows and keep all results that their definition asks for."""

import duckdb

import __spark_entry__ as registry


def test_analogies_keep_all_links_of_all_subjects(spark, data):
    """Pairs of classes, spelled out with their members, are all pairs of subjects, those with one property in common too."""
    member = {}
    for r in registry.queries()["property_classes"](spark, data).collect():
        member.setdefault((r.g, r["class"]), []).append(r.holder)
    got = set()
    for r in registry.queries()["analogies"](spark, data).collect():
        xs, ys = member[r.g, r.a], member[r.g, r.b]
        assert (len(xs), len(ys)) == (r.members_a, r.members_b)
        got |= {(r.g, min(x, y), max(x, y), r.similarity) for x in xs for y in ys if x != y}
    rows = duckdb.sql(f"""with e as (select distinct instance as g, subject as s, relation || '|' || object as v from '{data}/facts.parquet'
      where instance is not null and subject is not null and relation is not null and object is not null), z as (select g, s, list(v) as vs from e group by 1, 2)
    select x.g, x.s, y.s, round(len(list_intersect(x.vs, y.vs)) / len(list_distinct(list_concat(x.vs, y.vs))), 6) as j from z x join z y on x.g = y.g and x.s < y.s where j >= 0.3""").fetchall()
    assert got == set(rows)


def test_similar_classes(spark):
    from kestrelgraph.operators import mining

    held = {"a": "v", "b": "v", "c": "vw", "d": "vwx", "e": "vwxy", "f": "z"}
    items = spark.createDataFrame([(g, h, v) for g in ("one", None) for h, vs in held.items() for v in vs], "g string, holder string, value string")
    got = {tuple(r) for r in mining.similar_classes(items, 1, 0.3).collect()}
    first = {h: min(k for k in held if held[k] == held[h]) for h in held}
    size = lambda h: sum(held[k] == held[h] for k in held)
    want = set()
    for g in ("one", None):
        for a, x in held.items():
            for b, y in held.items():
                both, n = len(set(x) & set(y)), len(set(x) | set(y))
                if both / n >= 0.3 and a < b:
                    want.add((g, *sorted((first[a], first[b])), both, len(held[min(first[a], first[b])]), len(held[max(first[a], first[b])]), size(min(first[a], first[b])), size(max(first[a], first[b]))))
    assert got == want and ("one", "a", "a", 1, 1, 1, 2, 2) in got


def test_retraction_follows_a_chain_of_any_length(spark):
    from kestrelgraph.operators import store

    n = 103
    premise = lambda k: [(f"f{k - 1}", "r", "o")] if k else []
    facts = spark.createDataFrame([("i", f"f{k}", "r", "o", premise(k)) for k in range(n)], "instance string, subject string, relation string, object string, premises array<struct<subject:string,relation:string,object:string>>").coalesce(1)
    seeds = spark.createDataFrame([("i", "f0", "r", "o")], "instance string, s string, r string, o string")
    assert {(r.s, r.step) for r in store.retract(facts, seeds).collect()} == {(f"f{k}", k) for k in range(n)}


def test_hypotheses_match_brute_force(spark):
    import random

    from kestrelgraph.operators import insight

    rng = random.Random(4)
    rows = [(rng.choice("ij"), f"h{rng.randrange(25)}", rng.choice(["hub", *"abcdefghk"])) for _ in range(260)]
    held = {}
    for g, h, v in rows:
        held.setdefault((g, h), set()).add(v)
    want = {}
    for g, a in held:
        near = [held[k] for k in held if k[0] == g and k[1] != a and len(held[k] & held[g, a]) >= 2]
        for v in set().union(*near) - held[g, a]:
            if (n := sum(v in x for x in near)) >= 2:
                want[g, a, v] = n
    got = insight.supported_facts(spark.createDataFrame(rows, "g string, holder string, value string")).collect()
    assert {(r.g, r.holder, r.value): r.support for r in got} == want and len(got) == len(want) > 0


def test_hypotheses_leave_out_what_joins_nobody(spark, shuffled):
    """Of 3,000 subjects with two values of their own, ten share two more; rows that join nobody are shuffled once."""
    from kestrelgraph.plans import answers as plans

    rows = [("i", f"s{k:04}", "r", f"o{k}_{j}") for k in range(3000) for j in range(2)]
    rows += [("i", f"s{k:04}", "r", v) for k in range(10) for v in ("x", "y")] + [("i", f"s{k:04}", "r", "z") for k in range(2, 5)]
    import tempfile

    with tempfile.TemporaryDirectory() as d:
        spark.createDataFrame(rows, "instance string, subject string, relation string, object string").write.parquet(f"{d}/facts.parquet")
        got = []
        assert shuffled(lambda: got.extend(plans.hypotheses(spark, d).collect())) < 2 * len(rows)
    assert {(r.holder, r.value, r.support) for r in got} == {(f"s{k:04}", "r|z", 3) for k in (0, 1, *range(5, 10))}
