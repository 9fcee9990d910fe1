"""Texts, words and conversations against literal examples."""

from pyspark.sql import functions as F

from kestrelgraph.functions import text as T
from kestrelgraph.operators import context, grammar, insight, language, questions, reading


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_keys(spark):
    want = {
        "The rain makes the ground wet": "rain_make_ground_wet", "the ground is wet": "ground_wet", "a tail": "tail", "four legs": "four_legs", "seeds": "seed", "roses": "roses", "waves": "waves", "bus": "bus",
        "penguin birds that cannot fly": "penguin_birds", "United States": "united_state", "the capital of france": "capital_france",
    }
    assert column(spark, list(want), T.normalize) == list(want.values())


def test_questions(spark):
    got = column(spark, ["who founded valdoria?", "what is cheese made from?", "is mount velar a volcano?"], language.question)
    assert (got[0].direction, got[0].relation, got[0].object) == ("reverse", "founded", "valdoria")
    assert (got[1].direction, got[1].subject, got[1].relation) == ("forward", "cheese", "made_of")
    assert (got[2].direction, got[2].subject, got[2].object) == ("yesno", "mount velar", "volcano")


def test_encyclopedic_statements(spark):
    want = {
        "Dolphins communicate using clicks and whistles.": {("dolphins", "communicates_using", "clicks"), ("dolphins", "communicates_using", "whistles")},
        "Otters are commonly found in rivers and lakes.": {("otters", "found_in", "rivers"), ("otters", "found_in", "lakes")},
        "Corals can be found in warm seas, including the red sea.": {("corals", "found_in", "warm_seas"), ("corals", "found_in", "red_sea")},
        "Mammals, such as whales, can live in water.": {("mammals", "has_instance", "whales"), ("mammals", "lives_in", "water")},
        "Reptiles, like snakes, do not have fur": {("reptiles", "has_instance", "snakes"), ("reptiles", "has_not", "fur")},
        "Parrots, such as macaws, are known for their colours": {("parrots", "has_instance", "macaws"), ("parrots", "known_for", "colours")},
        "Most birds can fly.": {("birds", "can", "fly")},
        "Whales give birth to calves and feed them milk.": {("whales", "gives_birth_to", "calves"), ("whales", "feeds_young", "milk")},
        "Reptiles and most fish lay eggs.": {("reptiles", "lays", "eggs"), ("fish", "lays", "eggs")},
        "Beavers use mud to build dams.": {("beavers", "uses", "mud"), ("beavers", "uses_for", "build_dams")},
        "Animals range from the tiny shrew to the huge whale.": {("animals", "ranges_from", "tiny_shrew"), ("animals", "ranges_to", "huge_whale")},
        "Bees play a vital role in pollination.": {("bees", "plays_role_in", "pollination")},
        "All plants depend on sunlight and water.": {("plants", "depends_on", "sunlight"), ("plants", "depends_on", "water")},
        "Cats are hunters, while cows are grazers.": {("cats", "is", "hunters"), ("cows", "is", "grazers")},
        "Cats have claws, whereas cows have hooves.": {("cats", "has", "claws"), ("cows", "has", "hooves")},
        "Animals are classified into groups such as mammals, birds and fish.": {("animals", "classified_into", x) for x in ("mammals", "birds", "fish")},
        "For example, penguins are birds.": {("penguins", "is", "birds")},
        "Leaves vary in size.": {("leaves", "varies_in", "size")},
        "Trees, whose roots protect the soil": {("trees", "has", "roots"), ("roots", "protects", "soil")},
        "Hello there": set(), "": set(),
    }
    got = column(spark, [*want, None], reading.encyclopedic)
    assert [{tuple(f) for f in x} for x in got] == [*want.values(), set()]


def test_simpler_sentences(spark):
    want = {
        "The fox, a clever hunter, sleeps by day.": ["the fox is a clever hunter", "the fox sleeps by day"],
        "The river, which crosses the valley, feeds the lake.": ["the river crosses the valley", "the river feeds the lake"],
        "The sun is hot, but the moon is cold.": ["the sun is hot", "the moon is cold"],
        "Owls, hawks, and eagles are predators.": ["owls are predators", "hawks are predators", "eagles are predators"],
        "In summer, the bear eats berries and catches fish.": ["the bear eats berries", "the bear catches fish"],
        "Dogs bark.": ["dogs bark"], " ": [],
    }
    assert column(spark, list(want), reading.simplified) == list(want.values())
    rows = spark.createDataFrame([(1, "In summer, the bear eats berries and catches fish. Bees play a role in pollination. Foo bars baz.")], "k int, t string")
    got = {tuple(r)[3:] for r in reading.pipeline(rows, "k", "t").collect()}
    assert got == {("plain", "bear", "eats", "berries"), ("first verb", "bear", "catches", "fish"), ("encyclopedic", "bees", "plays_role_in", "pollination"), ("first verb", "foo", "bars", "baz")}


def test_word_forms(spark):
    words = ["child", "city", "fox", "leaf", "knife", "dog", "dogs", "fish", "day"]
    assert column(spark, words, context.plural) == ["children", "cities", "foxes", "leaves", "knives", "dogs", "dogs", "fish", "days"]
    assert column(spark, ["children", "cities", "wolves", "boxes", "dogs", "glass"], context.singular) == ["child", "city", "wolf", "box", "dog", "glass"]
    assert column(spark, ["apple", "university", "hour", "dog", "european"], context.article) == ["an", "a", "an", "a", "a"]
    assert column(spark, ["dogs", "dog"], lambda w: context.verb_form(w, F.lit("has"))) == ["have", "has"]
    assert column(spark, ["in", "on", "up"], lambda p: context.preposition_relation(p, F.lit("lives"))) == ["lives_in", "located_on", "up"]
    assert column(spark, ["in"], lambda p: context.preposition_relation(p, F.lit("stands"))) == ["located_in"]


def test_refinements_and_extras(spark):
    got = column(spark, ["Birds are calm, only when it rains.", "Birds fly", None], context.refined)
    assert [g and tuple(g) for g in got] == [("birds are calm", "only when", "it rains"), None, None]
    got = column(spark, ["It has 1,200 legs.", "Cats are faster than dogs.", "They dig to find water.", "No."], context.extras)
    assert [[tuple(x) for x in g] for g in got] == [[("quantity", "legs:1200")], [("comparison", "dogs")], [("purpose", "find water")], []]


def test_antecedents_prefer_the_number_of_the_pronoun(spark):
    turns = spark.createDataFrame([(1, 0, "x", "Dogs"), (1, 1, "x", "Rex"), (1, 2, "they run", None), (1, 3, "it runs", None), (2, 0, "she", None)], "k int, turn int, said string, named string")
    assert {tuple(r) for r in context.antecedents(turns, "k", "said").collect()} == {(1, 2, "they", "Dogs"), (1, 3, "it", "Rex")}
    assert [(r.place, r.name) for r in context.topic_stack(turns, "k").orderBy("place").collect()] == [(1, "Rex"), (2, "Dogs")]


def test_commands_small_talk_and_rules(spark):
    got = column(spark, ["/load-all", "/load a b", "/nothing", "load x", None], reading.command)
    assert [g and tuple(g) for g in got] == [("load-all", ""), ("load", "a b"), None, None, None]
    assert column(spark, ["hello you", "Dogs bark"], reading.small_talk) == ["Hello!", None]
    rules = spark.createDataFrame([("r1", "candidate"), ("r2", "candidate"), ("r3", "active")], "id string, status string")
    decisions = spark.createDataFrame([("r1", "confirm", 1), ("r2", "confirm", 1), ("r2", "reject", 2)], "id string, verdict string, at int")
    assert {tuple(r) for r in reading.decided(rules, decisions, ["id"]).collect()} == {("r1", "active"), ("r2", "rejected"), ("r3", "active")}
    rule = insight.generalised([("rex", "is", "dog"), ("dog", "can", "bark")], ("rex", "can", "bark"))
    assert rule.premises == (("?x1", "is", "?x2"), ("?x2", "can", "?x3")) and rule.conclusion == ("?x1", "can", "?x3")


def test_verdicts_in_the_order_of_branches(spark):
    rows = [
        ("cat", "is", "small_mammal"), ("mammal", "is", "animal"), ("dog", "is", "mammal"), ("animal", "has_property", "alive"), ("dog", "has_property", "loyal"), ("dog", "can_be", "wild"), ("dog", "is_not", "plant"),
    ]
    e = spark.createDataFrame([("i", *r, "high") for r in rows] + [("j", "yak", "is", "animal", "high")], "g string, s string, r string, o string, confidence string")
    asked = {"cat mammal": "yes", "dog animal": "yes, through what it is", "dog alive": "yes, inherited", "dog loyal": "yes, as a property", "dog wild": "some", "dog plant": "no", "dog rock": "no, as far as is known", "yak animal": "unknown"}
    q = spark.createDataFrame([(k, "i", *k.split()) for k in asked], "id string, g string, s string, o string")
    assert {r.id: r.verdict for r in questions.is_verdicts(e, q).collect()} == asked


def test_resolution_order(spark):
    names = spark.createDataFrame([("i", "big_red_ball"), ("i", "red_ball"), ("i", "rex_tail"), ("i", "moon")], "g string, name string")
    aliases = spark.createDataFrame([("i", "luna", "moon")], "g string, alias string, name string")
    asked = {"Red Ball": ("red_ball", "exact"), "Rex's tail": ("rex_tail", "possessive"), "luna": ("moon", "alias"), "ball": ("red_ball", "suffix"), "sun": ("sun", "new")}
    p = spark.createDataFrame([(k, "i", k) for k in asked] + [("x", "j", "moon")], "id string, g string, phrase string")
    got = {r.id: (r.entity, r.how) for r in reading.resolved(p, names, aliases).collect()}
    assert got == asked | {"x": ("moon", "new")}


def test_project_names(spark):
    assert column(spark, ["/home/a/b/c", "C:\\x\\y", ""], T.project_name) == ["b/c", "x/y", "unknown"]


def test_the_grammar(spark):
    want = {
        "The dog chased the cat.": {("dog", "chased", "cat")},
        "The big owl lives in the old barn.": {("big_owl", "lives_in", "old_barn")},
        "Birds cannot swim.": {("birds", "cannot", "swim")}, "A gull can open shells.": {("gull", "can", "open_shells")},
        "The lid of the box is red.": {("lid", "part_of", "box"), ("lid", "is", "red")},
        "In summer, bears eat berries, nuts and fish.": {("bears", "eat", x) for x in ("berries", "nuts", "fish")},
        "Wolves hunt deer because deer are slow.": {("wolves", "hunt", "deer"), ("deer", "is", "slow")},
        "Dogs have tails but cats have claws and whiskers.": {("dogs", "has", "tails"), ("cats", "has", "claws"), ("cats", "has", "whiskers")},
        "Whales are not fish.": {("whales", "is_not", "fish")}, "Hello.": set(), "": set(), ", ; of": set(),
    }
    verbs = frozenset({"chased", "hunt"})
    assert {k: set(grammar.facts_of(k, verbs)) for k in want} == want
    rows = spark.createDataFrame([(1, "Whales are not fish. Birds cannot swim."), (2, None), (3, "x " * 5000)], "k bigint, t string")
    forms = spark.createDataFrame([("Hunt",), (None,)], "form string")
    assert {tuple(r) for r in grammar.read(rows, "k", "t", forms).collect()} == {(1, 0, "whales", "is_not", "fish"), (1, 1, "birds", "cannot", "swim")}
