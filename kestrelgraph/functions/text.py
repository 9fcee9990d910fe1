"""Key normalization, name predicates, inflection and classifiers as native column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words removed from keys in this order, words that end a key, words whose plural "s" stays.
REMOVED = ["the", "a", "an", "of the", "of", "it", "is", "are", "was", "were", "gets", "get", "becomes", "become", "very", "really", "then"]
ENDING = ["that", "which", "who", "whom", "whose", "where", "when", "what", "why", "how", "can", "cannot", "could", "would", "should", "will", "do", "does", "did", "have", "has", "had"]
PROTECTED = (
    "grass glass class less mess boss loss things always sometimes perhaps yes no legs wings fins gills scales feathers whiskers eyes ears claws paws tails horns tusks "
    "hands feet teeth arms dogs cats birds fish wolves leaves knives dolphins whales horses cows pigs sheep lions tigers bears foxes deer mice geese elephants giraffes "
    "monkeys snakes frogs bees butterflies flies spiders ants calves trees flowers plants rocks clouds stars cars planes trains buses houses buildings humans persons peoples "
    "kids babies friends pets reefs beaches anemones oceans ecosystems spaces bones tentacles species predators hearts lungs brains limbs clicks whistles songs stings cells "
    "mammals animals reptiles amphibians insects hunters herbivores carnivores omnivores vertebrates creatures organisms"
).split()
# Fixed values of the name predicate.
BAD_STARTS = (
    "and or but because so yet the a an that which who whom whose when where how why what by for with from to in on at of about into onto upon highly very really sometimes often "
    "always never usually also just only even still already is are was were be been being has have had do does did can could will would should may might"
).split()
BAD_ENDS = "and or but the a an is are was were be has have had do does can will would should to for with from in on at that which who".split()
PRONOUNS = "they them it he she we i you your this that these those its their".split()
INNER_VERBS = "possess possesses contain contains include includes provide provides cause causes create creates exist exists form forms call calls called kill kills support supports".split()
FIRST_WORDS = (
    "highly very really sometimes often always never usually incredibly extremely mostly probably possibly actually basically generally typically commonly rarely frequently "
    "occasionally primarily mainly largely particularly"
).split()
LAST_WORDS = "is are was were be been being has have had do does did can could will would should may might believe believes think thinks know knows say says said make makes made".split()
SINGLE_WORDS = "will would could should may might must shall can do does did has have had is are was were be been being the a an and or but so yet".split()
COMPOUND_VERBS = "believe believes think thinks say says make makes know knows see sees show shows prove proves suggest suggests indicate indicates reveal reveals composed formed named called".split()
# The pattern families of the statement classifiers, tried in order.
CONTEXTS = [
    ("scientific", r"\b(?:scientifically|biologically|chemically|physically|science|biology|chemistry|physics|nature|species|genus|taxonomy|classification|molecule|atom|cell|organism)\b"),
    ("domestic", r"\b(?:pet|pets|domestic|domesticated|at\s+home|in\s+the\s+house|indoors|house\s*(?:cat|dog)|indoor\s+(?:cat|dog))\b"),
    ("cultural", r"\b(?:culture|traditionally|culturally|mythology|folklore|legend)\b"),
    ("temporal", r"\b(?:past|history|historically|nowadays|currently|today|modern|\d{4}s?|century)\b"),
    # place names are written in capitals there but met by lower-cased text, so only the words below can match
    ("geographic", r"\b(?:tropical|arctic|desert|marine|ocean)\b"),
]
TEMPORAL = [
    ("always", r"\b(?:always|invariably|universally)\b"),
    ("sometimes", r"\b(?:sometimes|occasionally|often|usually|typically)\b"),
    ("past", r"\b(?:used\s+to|formerly|in\s+the\s+past|historically|once)\b"),
    ("future", r"\b(?:will|going\s+to|in\s+the\s+future|eventually)\b"),
    ("currently", r"\b(?:currently|now|nowadays|today|presently)\b"),
]
SCOPES = [
    ("universal", r"\b(?:all|every|each|any)\b"),
    ("typical", r"\b(?:most|many|typically|usually|generally)\b"),
    ("specific", r"\b(?:some|certain|specific|particular|this|that)\b"),
]


def normalize(text: Column) -> Column:
    """The key of a phrase: filler words removed, cut before a clause word, plain plurals without "s", joined by "_"."""
    s = F.trim(F.lower(text))
    for word in REMOVED:
        s = F.regexp_replace(s, rf"\b{word}\b\s*", "")
    s = F.regexp_replace(s, "^so ", "")
    s = F.trim(F.replace(F.replace(s, F.lit("ocean water"), F.lit("ocean_water")), F.lit("water ocean"), F.lit("ocean_water")))
    words = F.filter(F.split(s, r"\s+"), lambda w: w != "")
    cut = F.array_min(F.transform(F.array(*map(F.lit, ENDING)), lambda w: F.nullif(F.array_position(words, w), F.lit(0).cast("bigint"))))
    kept = F.slice(words, F.lit(1), F.greatest(F.coalesce(cut - 1, F.size(words).cast("bigint")), F.lit(1).cast("bigint")).cast("int"))
    whole = lambda w: (
        F.contains(w, F.lit("_")) | w.isin(PROTECTED) | F.rlike(w, F.lit("(ves|ies|gs)$")) | ((F.length(w) > 3) & F.rlike(w, F.lit("[chxsz]es$")))
    )
    bare = F.transform(kept, lambda w: F.when(~whole(w) & (F.length(w) > 3) & F.rlike(w, F.lit("[^siu]s$")), F.regexp_replace(w, "s$", "")).otherwise(w))
    return F.regexp_replace(F.array_join(bare, "_"), "^_+|_+$", "")


def _any(column: Column, words: list[str], shape: str) -> Column:
    return F.rlike(column, F.lit(shape.format("|".join(words))))


def valid_entity(name: Column) -> Column:
    """Whether a key can be an entity: a short name, not the rest of a sentence. Null is no name."""
    low = F.trim(F.lower(name))
    words = F.filter(F.split(F.replace(low, F.lit("_"), F.lit(" ")), r"\s+"), lambda w: w != "")
    n = F.size(words)
    bad = [
        F.length(name) < 2,
        F.length(name) > 50,
        F.rlike(name, F.lit("[.,]")),
        n > 4,
        (n > 1) & (F.size(F.array_distinct(words)) < n),
        _any(low, BAD_STARTS, "^(?:{})_"),
        _any(low, BAD_ENDS, "_(?:{})$"),
        low.isin(PRONOUNS),
        _any(low, INNER_VERBS, "_(?:{})_"),
        F.coalesce(F.get(words, 0).isin(FIRST_WORDS), F.lit(False)),
        F.coalesce(F.get(words, n - 1).isin(LAST_WORDS), F.lit(False)),
        (n == 1) & F.coalesce(F.get(words, 0).isin(SINGLE_WORDS), F.lit(False)),
        (n >= 2) & F.arrays_overlap(words, F.array(*map(F.lit, COMPOUND_VERBS))),
    ]
    return F.coalesce(~reduce(lambda a, b: a | b, bad), F.lit(False))


def valid_discovery(name: Column) -> Column:
    """The looser predicate of pattern discovery."""
    words = F.split(F.replace(name, F.lit("_"), F.lit(" ")), r"\s+")
    grouped = F.contains(name, F.lit("group")) & (F.length(name) - F.length(F.replace(name, F.lit("_"), F.lit(""))) > 2)
    ok = (F.size(words) <= 5) & (F.size(F.array_distinct(words)) == F.size(words)) & (F.length(name) <= 50) & ~F.rlike(name, F.lit("[.,]")) & ~grouped
    return F.coalesce(ok, F.lit(False))


def classify(text: Column, families: list[tuple[str, str]], default: str) -> Column:
    """The first family whose pattern the lower-cased text has."""
    low = F.lower(text)
    return F.coalesce(*[F.when(F.rlike(low, F.lit(p)), F.lit(name)) for name, p in families], F.lit(default))


def context_of(text: Column) -> Column:
    return classify(text, CONTEXTS, "general")


def temporal_of(text: Column) -> Column:
    return classify(text, TEMPORAL, "always")


def scope_of(text: Column) -> Column:
    return classify(text, SCOPES, "universal")


def same_but_plural(a: Column, b: Column) -> Column:
    """Equal, or one the plural of the other by s, es or y/ies."""
    ies = lambda x, y: (F.endswith(x, F.lit("y")) & (F.concat(F.regexp_replace(x, "y$", ""), F.lit("ies")) == y))
    return (a == b) | (F.concat(a, F.lit("s")) == b) | (F.concat(b, F.lit("s")) == a) | (F.concat(a, F.lit("es")) == b) | (F.concat(b, F.lit("es")) == a) | ies(a, b) | ies(b, a)


def project_name(path: Column) -> Column:
    """The last two components of a path with either kind of slash; "unknown" without any."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda x: x != "")
    last = F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2))
    return F.when(path.isNull() | (F.size(parts) < 1), F.lit("unknown")).otherwise(F.array_join(last, "/"))


def pretty(key: Column) -> Column:
    return F.replace(key, F.lit("_"), F.lit(" "))


def listed(items: Column) -> Column:
    """"a", "a and b", "a, b, and c"."""
    n = F.size(items)
    head = F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    last = F.get(items, n - 1)
    return F.when(n <= 0, F.lit("")).when(n == 1, last).when(n == 2, F.concat(F.get(items, 0), F.lit(" and "), last)).otherwise(F.concat(head, F.lit(", and "), last))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def compact(n: Column) -> Column:
    """1.2K, 3.4M, 5.6B."""
    f = lambda d, u: F.format_string(f"%.1f{u}", n / d)
    return F.when(n >= 1e9, f(1e9, "B")).when(n >= 1e6, f(1e6, "M")).when(n >= 1e3, f(1e3, "K")).otherwise(F.format_string("%d", n.cast("bigint")))


def string_hash(text: Column) -> Column:
    """The unsigned 32-bit hash of a text, 33 times the hash before plus the next character, from 5381."""
    wrap = lambda x: F.pmod(x, F.lit(1 << 32))
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(5381).cast("bigint"), lambda h, c: wrap(h * 33 + F.ascii(c)))


def hue(text: Column) -> Column:
    """The colour of a cluster as an angle: always the same one for the same name."""
    return F.pmod(string_hash(text), F.lit(360)).cast("int")


def html_escaped(text: Column) -> Column:
    """A text as it may stand in HTML."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text
