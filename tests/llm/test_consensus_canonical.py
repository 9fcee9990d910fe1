"""Consensus of planted annotators, and value mapping against brute force."""

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from kestrelgraph.llm import canonical, consensus, queries

VOTE = "g string, s string, r string, label string, who string"


def planted(seed, items=600):
    """Votes of good, weak, random and colluding annotators over items with four labels, and the true labels."""
    rng = random.Random(seed)
    kinds = {f"good{i}": 0.9 for i in range(6)} | {f"weak{i}": 0.6 for i in range(4)} | {f"noise{i}": 0.25 for i in range(3)}
    liars = [f"liar{i}" for i in range(3)]
    truth, votes = {}, []
    for i in range(items):
        labels = ["p", "q", "u", "v"]
        t = rng.choice(labels)
        truth[str(i)] = t
        lie = rng.choice([x for x in labels if x != t])
        for who in rng.sample([*kinds, *liars], 5):
            if who in liars:
                said = lie if rng.random() < 0.9 else t
            else:
                said = t if rng.random() < kinds[who] else rng.choice([x for x in labels if x != t])
            votes.append(("g", str(i), "r", said, who))
    return truth, votes


@pytest.mark.parametrize("hot", [100_000, 3])
def test_reliability_and_labels_of_planted_annotators(spark, monkeypatch, hot):
    monkeypatch.setattr(consensus, "HOT_ITEM", hot)
    truth, votes = planted(5)
    df = spark.createDataFrame(votes, VOTE)
    claims = df.select("g", "s", "r", "label").distinct().selectExpr("*", "0L as unnamed")
    labels, people = consensus.consensus(df, claims)
    found = {r.s: r.label for r in labels.collect()}
    right = sum(found[i] == t for i, t in truth.items()) / len(truth)
    plain = 0
    for i, t in truth.items():
        n = [v[3] for v in votes if v[1] == i]
        plain += max(sorted(set(n)), key=n.count) == t
    assert right > plain / len(truth) + 0.05 and right > 0.85
    acc = {r.who: r.accuracy for r in people.collect()}
    assert min(v for k, v in acc.items() if k.startswith("good")) > max(v for k, v in acc.items() if k.startswith("weak"))
    assert max(v for k, v in acc.items() if k.startswith(("noise", "liar"))) < 0.4
    sure = consensus.confidences(df, claims).collect()
    assert {r.s: r.label for r in sure} == found
    assert all(0 < r.agreement <= 1 and 0 < r.confidence <= 1 + 1e-9 for r in sure)


@pytest.mark.parametrize("hot", [100_000, 3])
def test_reliability_is_the_leading_eigenvector(spark, monkeypatch, hot):
    """Against the dense matrix: the eigenvector of the overlap-corrected agreement, scaled by least squares."""
    import numpy as np

    monkeypatch.setattr(consensus, "HOT_ITEM", hot)
    monkeypatch.setattr(consensus, "TOLERANCE", 1e-6)
    _, votes = planted(7, 200)
    votes += [("g", "5", "r", "q", "good1"), ("g", "lone", "r", "p", "hermit")]
    weighted = consensus.weigh(spark.createDataFrame(votes, VOTE).distinct())
    rows = weighted.collect()
    names = sorted({r.who for r in rows})
    n = len(names)
    S, O = np.zeros((n, n)), np.zeros((n, n))
    for x in rows:
        for y in rows:
            if x.s == y.s and x.who != y.who:
                S[names.index(x.who), names.index(y.who)] += x.share * y.share * ((x.label == y.label) - x.chance)
                O[names.index(x.who), names.index(y.who)] += x.share * y.share * (1 - x.chance)
    met = O.sum(1) > 0
    d = np.where(met, O.sum(1), 1)
    values, vectors = np.linalg.eigh(S / np.sqrt(np.outer(d, d)))
    assert values[-1] > 2 * values[-2]  # the gap
    z = vectors[:, -1] * np.sign(vectors[:, -1].sum()) / np.sqrt(d)
    want = z * np.sqrt(values[-1] / (z**2 @ O @ z**2))
    got = {r.who: r.reliability for r in consensus.reliability(weighted).collect()}
    assert got.pop("hermit") == consensus.UNKNOWN and len(got) == n - 1
    assert all(got[w] == pytest.approx(want[i], abs=1e-4) for i, w in enumerate(names) if w != "hermit")


def test_annotators_who_always_disagree_are_at_chance(spark):
    df = spark.createDataFrame([("g", str(i), "r", "ab"[(i + k) % 2], "xy"[k]) for i in range(20) for k in (0, 1)], VOTE)
    people = consensus.reliability(consensus.weigh(df)).collect()
    assert [r.reliability for r in people] == [0.0, 0.0] and [r.accuracy for r in people] == [0.5, 0.5]


def test_votes_of_review_facts(spark):
    schema = "instance string, subject string, relation string, object string, context string, speaker_id string, agreed_by array<string>, agreement_count bigint, corrected_by string, original_speaker_id string, original_value string"
    rows = [
        ("i", "a", "r", "x", "review", " Ann ", ["bob", "BOB", "ann", None, " "], 5, None, None, None),
        ("i", "a", "r", "y", "review", None, None, None, "Cy", "dan", "z"),
        ("i", "a", "r", "x", "review", "ann", [], None, None, None, None),
        ("i", "a", "r", "w", "general", "eve", [], 0, None, None, None),
        (None, "b", "r", "only", "review", None, None, 2, None, None, None),
    ]
    votes, claims = consensus.review_votes(spark.createDataFrame(rows, schema))
    assert sorted((r.label, r.who) for r in votes.collect()) == [("x", "ann"), ("x", "bob"), ("y", "cy"), ("z", "dan")]
    assert {(r.s, r.label, r.unnamed) for r in claims.collect()} == {("a", "x", 2), ("a", "y", 0), ("a", "z", 0), ("b", "only", 2)}
    labels, people = consensus.consensus(votes, claims)
    got = {(r.g, r.s): (r.label, r["values"]) for r in labels.collect()}
    assert got["i", "a"] == ("x", 3) and got[None, "b"] == ("only", 1)
    none = spark.createDataFrame([], schema)
    labels, people = consensus.consensus(*consensus.review_votes(none))
    assert labels.count() == 0 and people.count() == 0


def test_ties_go_to_the_first_label(spark):
    df = spark.createDataFrame([("g", "1", "r", "b", "ann"), ("g", "1", "r", "a", "bob")], VOTE)
    labels, _ = consensus.consensus(df, df.select("g", "s", "r", "label").selectExpr("*", "0L as unnamed"))
    assert [(r.label, r["values"]) for r in labels.collect()] == [("a", 2)]


SHORT = st.text(alphabet="abc", max_size=6)


@given(SHORT, SHORT, SHORT)
def test_distance_is_a_metric(a, b, c):
    d = canonical.distance
    assert d(a, b) == d(b, a) and (d(a, b) == 0) == (a == b) and d(a, c) <= d(a, b) + d(b, c)


def test_a_chain_of_equal_distances_is_no_limit():
    tree = canonical.BKTree()
    for i in range(3000):
        tree.add(chr(0x4E00 + i))
    tree.add(chr(0x4E00))
    assert len(tree.spellings) == 3000 and len(tree.find("x", 1)) == 3000
    import pickle

    assert pickle.loads(pickle.dumps(tree)).find(chr(0x4E05), 0) == [(0, chr(0x4E05))]


def test_distance_values():
    assert [canonical.distance(*x) for x in (("ca", "abc"), ("abcd", "acbd"), ("", "ab"), ("kitten", "sitting"))] == [2, 1, 2, 3]


@given(st.lists(SHORT, max_size=25, unique=True), SHORT, st.integers(0, 3))
def test_the_tree_returns_every_spelling_within(spellings, value, within):
    tree = canonical.BKTree()
    for s in spellings:
        tree.add(s)
    assert sorted(tree.find(value, within)) == sorted((k, s) for s in spellings if (k := canonical.distance(value, s)) <= within)


REF = [("drifts_toward", "drift toward", "drifted toward"), ("mends", "mend", "mended"), ("echoes", "echo", "echoed"), ("whistles_at", "whistle at", None)]


@pytest.mark.parametrize("shard", [100, 1])
def test_values_are_mapped_through_noise(spark, shard):
    ref = spark.createDataFrame(REF, "entry string, base string, past string")
    want = {
        "Drifted Toward": "drifts_toward", "driftedToward": "drifts_toward", "d r i f t": "drifts_toward", "sometimes mendd their": "mends", "m3nds": "mends", "mеnds": "mends", "écho": "echoes", "medn": "mends",
        "whistl..": "whistles_at", "mends": "mends", "is_not": "unmatched", "": "unmatched", "??": "unmatched", "x" * 5000: "unmatched", "grumble": "unmatched",
    }
    rows = spark.createDataFrame([(v, 1) for v in want] + [(None, 2), ("medn", 3)], "relation string, canonical_note int")
    got = canonical.map_values(rows, "relation", ref, "entry", ["base", "past"], shard).collect()
    assert len(got) == len(want) + 2
    assert {r.relation: r.canonical_relation for r in got} == want | {None: "unmatched"}
    left = canonical.strays(rows, "relation", ref.selectExpr("entry as relation"), "relation")
    assert left.count() == len(got) - 1
    assert canonical.map_values(rows.limit(0), "relation", ref, "entry", ["base"]).count() == 0
    assert {r.canonical_relation for r in canonical.map_values(rows, "relation", ref.limit(0), "entry", ["base"]).collect()} == {"unmatched"}


def test_queries_of_consensus_and_mapping(spark, data):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view facts as select * from '{data}/facts.parquet'")
    con.sql(f"create view relation_defs as select * from '{data}/relation_defs.parquet'")
    items = {tuple(r) for r in con.sql("""select instance, subject, relation from (select instance, subject, relation, object as v from facts where context = 'review'
        union all select instance, subject, relation, original_value from facts where context = 'review' and original_value is not null) group by 1, 2, 3 having count(distinct v) > 1""").fetchall()}
    got = queries.p1_found(spark, data).collect()
    assert len(got) == len(items) and {(r.instance, r.subject, r.relation) for r in got} == items
    assert queries.p1_agreement(spark, data).count() >= len(got) and queries.p1_annotators(spark, data).count() > 0
    stray = {r[0] for r in con.sql("select fact_id from facts where relation not in (select relation from relation_defs)").fetchall()}
    got = queries.p4_found(spark, data).collect()
    assert len(got) == len(stray) and {r.fact_id for r in got} == stray
    names = {r[0] for r in con.sql("select relation from relation_defs").fetchall()} | {"unmatched"}
    assert {r.relation for r in got} <= names


def test_ambiguous_beginnings_are_unmatched_in_shards_too(spark):
    ref = spark.createDataFrame([(f"whistles_{x}",) for x in ("at", "by", "for", "over", "past", "under")] + [("drifts_toward",)], "entry string")
    want = {
        "whist": "unmatched", "drift": "drifts_toward", "often drifts": "drifts_toward", "whistles_und": "whistles_under", "grumble": "unmatched",
        "often drifts toward": "drifts_toward", "never drifts toward": "unmatched", "rarely drifts to": "unmatched",
    }
    rows = spark.createDataFrame([(v,) for v in want], "relation string")
    for shard in (100, 4, 1):
        assert {r.relation: r.canonical_relation for r in canonical.map_values(rows, "relation", ref, "entry", [], shard).collect()} == want
