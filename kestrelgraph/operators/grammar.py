"""A recursive-descent reader of plain English sentences: tokens to clauses of noun and verb phrases, and these to facts.

The grammar needs no lexicon of nouns: determiners, auxiliaries, prepositions and conjunctions are closed classes, a verb is
a listed form or tells itself by its ending behind a noun, everything else is part of a noun phrase.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelgraph.operators import language
from kestrelgraph.operators.context import PREPOSITIONS
from kestrelgraph.runtime import ship

DETERMINERS = frozenset("a an the this that these those some any every each all most many few no its his her their our my your".split())
COPULAS, POSSESSION, MODALS = frozenset("is are was were am be been".split()), frozenset("has have had".split()), frozenset("can could may might must will would should shall".split())
SUPPORT, NEGATION = frozenset("do does did".split()), frozenset("not never cannot".split())
PREPOSITION = frozenset("in on at to from with of for by into through over under near along above below behind beside beyond inside across about against between during after before until".split())
COORDINATING, SUBORDINATING = frozenset("and or but yet so".split()), frozenset("because although though while if unless when whenever since until before after whereas where so".split())
RELATIVE = frozenset("who which that whose".split())
COMMON_VERBS = frozenset("eat eats live lives need needs make makes use uses cause causes like likes see sees find finds give gives take takes hold holds keep keeps bring brings feed feeds catch catches build builds".split())
_TOKEN = re.compile(r"[A-Za-z][A-Za-z'-]*|\d[\d,]*|[,;:]")


@dataclass
class Phrase:
    """A noun phrase: its words, and its prepositional phrases."""

    words: list[str]
    modifiers: list[tuple[str, Phrase]] = field(default_factory=list)

    @property
    def key(self) -> str:
        return "_".join(self.words)


@dataclass
class Clause:
    subjects: list[Phrase]
    verb: str
    negated: bool
    modal: bool
    objects: list[Phrase]
    places: list[tuple[str, Phrase]]


class Parser:
    """One sentence's tokens; each method reads one construct from where the reader stands, or leaves it there."""

    def __init__(self, sentence: str, verbs: frozenset[str] = frozenset()):
        self.tokens = [t.lower() for t in _TOKEN.findall(sentence)]
        self.at, self.verbs = 0, verbs | COMMON_VERBS

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ""

    def take(self, words: Iterable[str]) -> str:
        if self.peek() and self.peek() in words:
            self.at += 1
            return self.tokens[self.at - 1]
        return ""

    def is_verb(self, seen: bool) -> bool:
        """Whether the next token is a verb; an unlisted one only behind a noun, by its ending and what follows it."""
        t, following = self.peek(), self.peek(1)
        if t in COPULAS | POSSESSION | MODALS | SUPPORT | NEGATION or t in self.verbs:
            return bool(seen)
        return bool(seen and re.fullmatch(r"[a-z]{2,}(?:s|ed)", t) and not t.endswith("ss") and (following in DETERMINERS or following in PREPOSITION or re.match(r"\d", following or "x") is not None))

    def sentence(self) -> list[Clause]:
        """All clauses: a fronted circumstance is skipped, conjunctions and commas begin another clause."""
        out, subject = [], None
        while self.at < len(self.tokens):
            start = self.at
            self.take(COORDINATING | SUBORDINATING | RELATIVE | {",", ";", ":"})
            if self.peek() in PREPOSITION and not out:
                self.circumstance()
                continue
            clause = self.clause(subject)
            if clause:
                out.append(clause)
                subject = clause.subjects
            elif self.at == start or not self.peek():
                self.at = max(self.at, start) + 1
        return out

    def circumstance(self) -> None:
        while self.peek() and self.peek() != ",":
            self.at += 1

    def clause(self, inherited: list[Phrase] | None) -> Clause | None:
        start = self.at
        subjects = self.phrases()
        if not subjects and inherited and self.is_verb(True):
            subjects = inherited
        verb = self.verb() if subjects else None
        if not verb:
            self.at = max(self.at, start + 1) if self.at == start else self.at
            return None
        name, negated, modal = verb
        objects, places = self.phrases(), []
        while self.peek() in PREPOSITION:
            preposition = self.take(PREPOSITION)
            places += [(preposition, p) for p in self.phrases()]
        return Clause(subjects, name, negated, modal, objects, places) if objects or places or modal else None

    def verb(self) -> tuple[str, bool, bool] | None:
        if not self.is_verb(True):
            return None
        negated = modal = False
        name = ""
        while self.peek() in MODALS | SUPPORT | NEGATION:
            t = self.take(MODALS | SUPPORT | NEGATION)
            negated |= t in NEGATION
            modal |= t in MODALS or t == "cannot"
        if self.peek() in COPULAS | POSSESSION or self.is_verb(True) or ((modal or negated) and re.fullmatch(r"[a-z]+", self.peek())):
            name = self.peek()
            self.at += 1
            if self.take(NEGATION):
                negated = True
        return (name, negated, modal) if name else None

    def phrases(self) -> list[Phrase]:
        """Noun phrases joined by commas and conjunctions."""
        out = []
        while True:
            p = self.phrase()
            if not p:
                return out
            out.append(p)
            mark = self.at
            if self.take({","}):
                self.take({"and", "or"})
            elif not self.take({"and", "or"}):
                return out
            before = self.at
            ahead = self.phrase()
            again = ahead is not None and not self.is_verb(True)
            self.at = before if again else mark
            if not again:
                return out

    def phrase(self) -> Phrase | None:
        self.take(DETERMINERS)
        words: list[str] = []
        while re.fullmatch(r"[a-z][a-z'-]*|\d[\d,]*", self.peek()) and not self.is_verb(bool(words)) and self.peek() not in DETERMINERS | PREPOSITION | COORDINATING | SUBORDINATING | RELATIVE | COPULAS | MODALS | SUPPORT | NEGATION | POSSESSION:
            words.append(self.peek())
            self.at += 1
        if not words:
            return None
        phrase = Phrase(words)
        if self.peek() == "of":
            self.at += 1
            inner = self.phrase()
            if inner:
                phrase.modifiers.append(("of", inner))
        return phrase


def relation(clause: Clause) -> str:
    """The relation of a clause's verb with its objects."""
    no = clause.negated
    if clause.modal:
        return "cannot" if no else "can"
    if clause.verb in COPULAS:
        return "is_not" if no else "is"
    if clause.verb in POSSESSION:
        return "has_not" if no else "has"
    base = clause.verb[:-1] if clause.verb.endswith("s") and not clause.verb.endswith("ss") and len(clause.verb) > 2 else clause.verb
    return f"{base}_not" if no else base


def facts_of(sentence: str, verbs: frozenset[str] = frozenset()) -> list[tuple[str, str, str]]:
    """(subject, relation, object): what a sentence states, once each, in its order."""
    out: dict[tuple[str, str, str], None] = {}
    for c in Parser(sentence, verbs).sentence():
        r = relation(c)
        for s in c.subjects:
            for preposition, inner in s.modifiers:
                out[s.key, PREPOSITIONS.get(preposition, preposition), inner.key] = None
            if c.modal:
                out[s.key, r, "_".join([c.verb, *(o.key for o in c.objects[:1])])] = None
            else:
                for o in c.objects:
                    out[s.key, r, o.key] = None
            for preposition, place in c.places:
                home = "lives_in" if c.verb in ("live", "lives", "found") else "located_in"
                out[s.key, home if preposition == "in" else PREPOSITIONS.get(preposition, f"{r}_{preposition}"), place.key] = None
    return list(out)


def read(texts: DataFrame, key: str, text: str, verbs: DataFrame | None = None, longest: int = 300) -> DataFrame:
    """(key, at, subject, relation, object): the facts of all sentences of at most `longest` characters, which is what the
    grammar is for. verbs (form) lists known verb forms; it is a dimension and goes to the tasks as a constant."""
    ship(texts.sparkSession)
    forms = frozenset(r.form.lower() for r in verbs.select("form").distinct().collect() if r.form) if verbs is not None else frozenset()
    rows = texts.select(F.col(key).alias(key), F.posexplode(language.sentences(F.col(text))).alias("at", "s")).where(F.length("s") <= longest)
    kind = rows.schema[key].dataType.simpleString()

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(k, at, *f) for k, at, s in zip(pdf[key], pdf["at"], pdf["s"]) for f in facts_of(s, forms)]
            yield pd.DataFrame(found, columns=[key, "at", "subject", "relation", "object"])

    return rows.mapInPandas(parse, f"`{key}` {kind}, at int, subject string, relation string, object string")
