"""Per-document text statistics, and how far each document lies from the prose of its language.

The statistics are column expressions. For each language a prose centre and covariance are fitted robustly (median
and spread first, then reweighted moments of what lies near), and a document's squared Mahalanobis distance is split
into the contribution of each statistic.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrelgraph.runtime import materialize

#: Common words of each language that is told apart (of single characters where words are not spaced); a document's
#: language is that of which it has the most different ones. A caller may pass another table.
COMMON = {
    "en": "the a an of and to in is was were are be been it its that this which who what when where whether if then than so as by for from with on at not no nor but or both all have has had he she they we i you there must would may can cannot about into near under above behind beside beyond inside along only also".split(),
    "de": "der die das den dem des ein eine einen einem einer und oder aber nicht ist war sind es sich mit von zu im in an am auf für aus bei nach wie dass daß warum weil so nur davon mehr nie wo als hat".split(),
    "fr": "le la les l un une des du de d et ou mais ne pas n est était il elle que qu qui dans en au aux avec pour par sur près y avait on se ce cette ces si plus c parce".split(),
    "es": "el la los las un una de del y o pero no es está era había que qué en con por para al se lo su sus más como así porque si cerca nadie".split(),
    "it": "il lo la gli le di del della dei che è un una per non con si come era più nel sono anche ma".split(),
    "pt": "o os as um uma de do da dos das que não é com para em no na se por mais mas foi como".split(),
    "nl": "de het een en van dat niet is op te zijn voor met die aan er maar ook als bij werd naar".split(),
    "pl": "i w na nie się że z do to jest o po jak ale co za był była przez tym oraz od tylko nikt kiedy tak".split(),
    "sv": "och att det som en är av för på inte med den till har om var de ett men sig".split(),
    "tr": "ve bir bu da de için ile çok ama daha gibi olarak ne var olan sonra".split(),
    "ru": "и в не на что он она с как это по но из у за от так же было был бы к а о его её когда никто там".split(),
    "zh": list("的一是不了在有我他这那们来上大和地到说就也时没人为以个都里着看会"),
    "ja": list("のにはをたがでてとしれさるないもかられだ"),
}
#: Words that means over words are smoothed by, so that a few words say little, and what is assumed for them: the share
#: of common words and the length of a word.
PRIOR_WORDS, PRIOR_SHARE, PRIOR_LENGTH, PRIOR_SYMBOLS = 12, 0.4, 5.0, 0.03
#: Words of a short line, and words that the shares of words in short or marked lines are smoothed by.
SHORT_LINE, PRIOR_LINES = 4, 36
STATISTICS = ["log_words", "mean_word_length", "symbol_ratio", "digit_ratio", "line_end_ratio", "common_ratio", "common_variety", "short_line_ratio", "marked_line_ratio", "repeat_ratio"]
#: Least spread of the statistics that say little about prose or not (how long, how punctuated), whatever the spread in
#: the corpus: prose without a full stop is prose.
LAYOUT_SPREAD = {"log_words": 1.0, "line_end_ratio": 0.5}
#: Fewest documents from which a language gets its own prose model; below it the pooled one serves.
LEAST_DOCUMENTS = 50
ROUNDS = 3
#: Squared distance per statistic from which a document is not prose.
CUT = 6.7

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F)) + " "
#: Letters of scripts that put no spaces between words: each counts as a word of average length.
_RANGES = r"\x{e00}-\x{eff}\x{1000}-\x{109f}\x{1780}-\x{17ff}\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{3ffff}"
_UNSPACED = f"[{_RANGES}]"
_WORDS, _NUMBERS, _SPACES, _NAMED = r"[\p{L}\p{M}]+|\p{N}+", r"\p{N}+", r"[\s\p{Z}\p{Cf}]+", r"[\p{L}\p{M}\p{N}]+"
_TOKENS = r"[^\s\p{Z}]+"
_SINGLE = rf"{_UNSPACED}|[\p{{L}}\p{{M}}&&[^{_RANGES}]]+|\p{{N}}+"
#: The same for texts of ASCII characters only, which most are.
_ASCII = {_WORDS: "[A-Za-z]+|[0-9]+", _NUMBERS: "[0-9]+", _SPACES: r"\s+", _NAMED: "[A-Za-z0-9]+", _TOKENS: r"\S+"}
_LINE_END = r"[.!?…;:,。！？؟।][\"'”’»)\]]*\s*$"
_MARK = r"^\s*(?:[-*+•·–—▪◦]|\(?\p{N}{1,3}[.)]|\(?\p{L}[.)]|\[[ xX]?\])\s"


def blank(text: Column) -> Column:
    """Null, empty, or only white space of any kind."""
    return text.isNull() | ~F.rlike(text, F.lit(r"[^\s\p{Z}\x{1c}-\x{1f}\x{85}]"))


def _of_list(words: Column, listed: list[str]) -> Column:
    return F.filter(words, lambda x: x.isin(listed))


def statistics(documents: DataFrame, key: str, text: str, common: dict[str, list[str]] = COMMON) -> DataFrame:
    """(key, language, words, ratios...): one row for each document that is not blank.

    Mark-up is removed first and full-width letters count as ordinary ones. Means over words are smoothed; shares are over words, lines that are not blank, or characters that are not white space.
    """
    t = F.col("__t")
    plain = F.when(F.rlike(t, F.lit("[！-～]")), F.translate(t, _WIDE, _NARROW)).otherwise(t)
    plain = F.when(F.contains(t, F.lit("<")) | F.contains(t, F.lit("&")), F.regexp_replace(F.regexp_replace(plain, r"</?[a-zA-Z][^<>\n]{0,80}>", " "), r"&#?\w{1,8};", " ")).otherwise(plain)
    rows = documents.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("__t")).where(~blank(t)).select(key, plain.alias("__t"))
    plain_ascii = F.octet_length(t) == F.length(t)
    rows = rows.select(key, "__t", plain_ascii.alias("__z"), (~plain_ascii & F.rlike(t, F.lit(_UNSPACED))).alias("__u"))
    w, lines, unspaced, ascii_only = F.col("__w"), F.col("__l"), F.col("__u"), F.col("__z")
    either = lambda use, shape: F.when(ascii_only, use(_ASCII[shape])).otherwise(use(shape))
    found = lambda x, shape: F.regexp_extract_all(x, F.lit(shape), F.lit(0))
    rows = rows.select(
        key,
        "__u",
        "__z",
        F.when(unspaced, found(F.lower(t), _SINGLE)).otherwise(either(lambda p: found(F.lower(t), p), _WORDS)).alias("__w"),
        either(lambda p: F.regexp_count(t, F.lit(p)), _NUMBERS).alias("__d"),
        F.filter(F.split(t, r"\r\n|[\n\r\x{b}\x{c}\x{85}\x{2028}\x{2029}]"), lambda x: F.rlike(x, F.lit(r"\S"))).alias("__l"),
        either(lambda p: F.regexp_replace(t, p, ""), _SPACES).alias("__x"),
    )
    rows = rows.select(*[c for c in rows.columns if c != "__x"], F.length("__x").alias("__c"), F.length(F.regexp_replace(either(lambda p: F.regexp_replace("__x", p, ""), _NAMED), r"([=\-_*~.])\1{3,}", "$1")).alias("__s"))
    rows = rows.select("*", _of_list(w, sorted({x for words in common.values() for x in words})).alias("__a"))
    rows = rows.select("*", F.array_distinct("__a").alias("__e"))
    # a mark is looked for at a line's beginning, an end at its last characters
    marked = lambda x: F.rlike(F.substring(x, 1, 40), F.lit(_MARK))
    tokens = lambda x: F.when(unspaced, F.size(found(x, _SINGLE))).otherwise(either(lambda p: F.regexp_count(x, F.lit(p)), _TOKENS))
    in_line = lambda x: F.greatest(tokens(x) - marked(x).cast("int"), F.lit(1))
    # a text of ASCII characters has no word of a language that is written without them
    count = lambda listed: F.size(_of_list(F.col("__e"), listed)) if any(x.isascii() for x in listed) else F.when(ascii_only, 0).otherwise(F.size(_of_list(F.col("__e"), listed)))
    rows = rows.select(
        "*",
        *[count(listed).alias(f"__{k}") for k, listed in common.items()],
        F.transform(lines, lambda x: F.struct(in_line(x).alias("n"), marked(x).alias("m"), F.rlike(F.substring(x, -16, 16), F.lit(_LINE_END)).alias("e"))).alias("__k"),
    )
    most = F.greatest(*[F.col(f"__{k}") for k in common])
    language = F.coalesce(*[F.when(F.col(f"__{k}") == most, F.lit(k)) for k in common])
    rows = rows.select("*", most.alias("__v"), language.alias("language"))
    rows = rows.select("*", F.coalesce(*[F.when(F.col("language") == k, F.size(_of_list(F.col("__a"), listed))) for k, listed in common.items()]).alias("__f"))
    n, k = F.size(w), F.col("__k")
    pairs = F.transform(F.slice(w, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1)))
    total = F.aggregate(k, F.lit(0), lambda a, x: a + x["n"])
    words_in = lambda keep: F.aggregate(F.filter(k, keep), F.lit(0), lambda a, x: a + x["n"])
    smooth = lambda part, whole, share, by=PRIOR_WORDS: (part + by * share) / (whole + by)
    letters = F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x))
    spread = F.aggregate(w, F.lit(0), lambda a, x: a + F.when(F.length(x) == 1, int(PRIOR_LENGTH)).otherwise(F.length(x)))
    return rows.select(
        key,
        "language",
        n.alias("words"),
        F.log1p(n).alias("log_words"),
        smooth(F.when(unspaced, spread).otherwise(letters), n, PRIOR_LENGTH).alias("mean_word_length"),
        smooth(F.col("__s"), F.col("__c"), PRIOR_SYMBOLS, PRIOR_LENGTH * PRIOR_WORDS).alias("symbol_ratio"),
        smooth(F.col("__d"), n, 0.03).alias("digit_ratio"),
        (F.size(F.filter(k, lambda x: x["e"])) / F.greatest(F.size(k), F.lit(1))).alias("line_end_ratio"),
        smooth(F.col("__f"), n, PRIOR_SHARE).alias("common_ratio"),
        (F.col("__v") / F.sqrt(F.col("__f") + 1.0)).alias("common_variety"),
        smooth(words_in(lambda x: x["n"] <= SHORT_LINE), total, 0.0, PRIOR_LINES).alias("short_line_ratio"),
        smooth(words_in(lambda x: x["m"]), total, 0.0, PRIOR_LINES).alias("marked_line_ratio"),
        (1 - F.size(F.array_distinct(pairs)) / F.greatest(n - 1, F.lit(1))).alias("repeat_ratio"),
    )


class Prose:
    """Centre and inverse covariance of each language's prose; "" has the pooled one."""

    def __init__(self, names: list[str]):
        self.names = names
        self.centre: dict[str, np.ndarray] = {}
        self.inverse: dict[str, np.ndarray] = {}
        self.count: dict[str, int] = {}

    def _of(self, table: dict[str, np.ndarray]) -> Column:
        """The language's own parameters, or the pooled ones, as a constant array."""
        as_column = lambda v: F.array(*[as_column(x) if np.ndim(x) else F.lit(float(x)) for x in v])
        own = [F.when(F.col("language") == g, as_column(v)) for g, v in sorted(table.items()) if g]
        return F.coalesce(*own, as_column(table[""]))

    def contributions(self, stats: DataFrame, name: str) -> DataFrame:
        """stats with an array column: each statistic's part of the squared distance; the parts sum to it."""
        z = F.zip_with(F.array(*self.names), self._of(self.centre), lambda x, c: x - c)
        rows = stats.select("*", z.alias("__z"), self._of(self.inverse).alias("__m"))
        product = lambda row: F.aggregate(F.zip_with(row, "__z", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        return rows.select(*stats.columns, F.zip_with("__z", F.transform("__m", product), lambda a, b: a * b).alias(name))

    def near(self, stats: DataFrame, within: float) -> DataFrame:
        parts = self.contributions(stats, "__parts")
        return parts.where(F.aggregate("__parts", F.lit(0.0), lambda a, x: a + x) < within).drop("__parts")


def _moments(near: DataFrame, names: list[str], weigh: float) -> tuple[dict, dict, dict]:
    """count, mean and covariance of the documents near the last centres, by language and pooled (one row each)."""
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = [F.sum(n).alias(f"s{i}") for i, n in enumerate(names)] + [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p{i}_{j}") for i, j in pairs]
    by = near.groupBy("language").agg(F.count("*").alias("n"), *sums).collect()  # one row for each language
    counts = {r.language: r.n for r in by}
    first = {r.language: np.array([r[f"s{i}"] for i in range(len(names))]) for r in by}
    second = {}
    for r in by:
        m = np.zeros((len(names),) * 2)
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"p{i}_{j}"]
        second[r.language] = m
    counts[""], first[""], second[""] = sum(counts.values()), sum(first.values(), np.zeros(len(names))), sum(second.values(), np.zeros((len(names),) * 2))
    mean = {g: first[g] / max(1, counts[g]) for g in counts}
    cov = {g: (second[g] / max(1, counts[g]) - np.outer(mean[g], mean[g])) * weigh for g in counts}
    return counts, mean, cov


def _least_spread(centre: np.ndarray, names: list[str]) -> np.ndarray:
    return np.array([LAYOUT_SPREAD.get(n, 0.02 * max(abs(c), 0.5)) for n, c in zip(names, centre)])


def fit(stats: DataFrame, names: list[str], rounds: int = ROUNDS) -> Prose:
    """The prose model of each language in stats.

    Medians and quartile spreads of all documents of a language come first; each round then takes mean and
    covariance of the documents near the last centre. That holds as long as most documents with a language's common
    words are prose. All documents count; only one row of sums for each language reaches the driver.
    """
    prose = Prose(names)
    # documents without the common words of any language say nothing about its prose
    spoken = stats.where(F.col("common_ratio") > PRIOR_SHARE / 2)
    quart = [F.percentile_approx(n, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(2000)).alias(f"q{i}") for i, n in enumerate(names)]
    rows = spoken.groupBy("language").agg(F.count("*").alias("n"), *quart).collect()
    pooled = spoken.agg(F.count("*").alias("n"), *quart).collect()[0]
    for g, r in [("", pooled), *((r.language, r) for r in rows if r.n >= LEAST_DOCUMENTS)]:
        q = np.array([r[f"q{i}"] if r[f"q{i}"] else [0.0, 0.0, 0.0] for i in range(len(names))], float)
        spread = np.maximum((q[:, 2] - q[:, 0]) / 1.349, _least_spread(q[:, 1], names))
        prose.centre[g], prose.inverse[g], prose.count[g] = q[:, 1], np.diag(1 / spread**2), r.n
    for _ in range(rounds):
        counts, mean, cov = _moments(prose.near(spoken, 4.0 * len(names)), names, 1.1)
        for g in list(prose.centre):
            if counts.get(g, 0) >= LEAST_DOCUMENTS:
                floor = np.diag(_least_spread(mean[g], names) ** 2)
                prose.centre[g], prose.inverse[g], prose.count[g] = mean[g], np.linalg.inv(cov[g] + floor), counts[g]
    return prose


def outlierness(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, language, words, statistics..., distance, why_<statistic>..., prose): see statistics() and fit().

    distance is the squared Mahalanobis distance per statistic, over all of them; why_<statistic> is the statistic's part
    of it. How long or how punctuated prose is varies so much that these two weigh little. prose is false from CUT on. Blank documents give no row, repeated keys a row each.
    """
    stats = materialize(statistics(documents, key, text))
    names = STATISTICS
    prose = fit(stats, names)
    out = prose.contributions(stats, "__parts")
    parts = [(F.get("__parts", F.lit(i)) / len(names)).alias(f"why_{n}") for i, n in enumerate(names)]
    distance = F.aggregate("__parts", F.lit(0.0), lambda a, x: a + x) / len(names)
    return out.select(*stats.columns, *parts, distance.alias("distance")).select("*", (F.col("distance") < CUT).alias("prose"))


def not_prose(documents: DataFrame, key: str, text: str) -> DataFrame:
    return outlierness(documents, key, text).where("not prose").select(key)
