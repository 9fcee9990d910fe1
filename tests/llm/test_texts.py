"""Encoding, leaked passages and prose statistics."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kestrelgraph.llm import bpe, leakage, quality, queries

RANKS = f"{queries.TOKENIZERS}/byte_bpe_50k.tiktoken"
needs_vocabulary = pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary files here")
TEXTS = [
    None, "", " ", "\n\n  \t", "Hello world, it's 12345!", "naïve café ½ ⅔ 漢字 😀👩‍🌾 الماء", "a" * 3000 + " b " + " " * 2000, "x\x00y\x1cz\x85w v​　u", "<|endoftext|> don't DON'T we'll",
    "Torariganumi guards 1,234 windows\r\n\tTorariganumi", "\x02\x03\x04 odd", "$1 \\x {} ''", "ΑΒΓ абв ＡＢＣ", "the the the",
]


def docs(spark, texts):
    return spark.createDataFrame([(2**60 + i, t, i) for i, t in enumerate(texts)], "doc_id bigint, text string, ids int")


@needs_vocabulary
def test_ids_equal_the_reference_libraries_and_decode_back(spark, data):
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    rng = random.Random(4)
    texts = TEXTS + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x20, 0x500), rng.randrange(0x4E00, 0x4F00)])) for _ in range(200)) for _ in range(20)]
    texts += [r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    encoded = bpe.encode_corpus(docs(spark, texts), "doc_id", "text", RANKS)
    got = {r.doc_id - 2**60: r.ids for r in encoded.collect()}
    hf = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    hf.encode_special_tokens = True
    rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    tt = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=rank, special_tokens={})
    v = bpe.vocabulary(RANKS)
    for i, t in enumerate(texts):
        want = hf.encode(t or "", add_special_tokens=False).ids
        assert got[i] == want == bpe.encode_text(t, v), t
        if t and "\x1c" not in t:
            assert want == tt.encode_ordinary(t)
    encoder = bpe.Encoder(spark, RANKS)
    back = {r.doc_id - 2**60: r.t for r in encoded.select("doc_id", encoder.text(F.col("ids")).alias("t")).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))


@needs_vocabulary
def test_encoding_no_documents_and_a_split_that_is_no_vocabulary(spark, tmp_path):
    assert bpe.encode_corpus(docs(spark, []), "doc_id", "text", RANKS).count() == 0
    (tmp_path / "bad").write_text("YQ== 5\n")
    with pytest.raises(ValueError):
        bpe.vocabulary(str(tmp_path / "bad"))


def passage(rng, n=60):
    return " ".join(f"w{rng.randrange(4000)}" for _ in range(n))


def test_leaks_are_found_however_they_are_set(spark):
    rng = random.Random(8)
    ask = "Read the passage and answer in one sentence."
    bodies = [passage(rng) for _ in range(30)]
    items = [(i, f"{ask}\n{b}\nQuestion: what is w{i}?") for i, b in enumerate(bodies)] + [(100, bodies[3]), (101, None), (102, ""), (103, "one two")]
    w = bodies[3].split()
    filler = lambda: passage(rng, 80)
    wide = "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in bodies[3])
    cases = {
        1: f"{filler()} {bodies[3]} {filler()}", 2: bodies[3].upper().replace(" ", "\n"), 3: wide, 4: " ".join(w[:34]) + filler(), 5: " ".join(x if k % 9 else "other" for k, x in enumerate(w)),
        6: "<p>" + bodies[3].replace(" ", "</b>, <b>") + "</p>", 7: " ".join(w[40:] + ["and"] + w[:40]), 8: bodies[3].replace("w", "w​"),
    }
    clean = {20: " ".join(w[:8]) + " " + filler(), 21: f"{ask} {filler()}", 22: None, 23: "", 24: " ".join(rng.sample(w, len(w))), 25: "w1"}
    rows = [(i, t, 0) for i, t in (cases | clean).items()] + [(1, cases[1], 1)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, item_id int")
    it = spark.createDataFrame(items, "item_id bigint, text string")
    for shard in (20_000, 11):
        got = [(r.doc_id, r.item_id) for r in leakage.leaks(d, "doc_id", "text", it, "item_id", "text", shard).where("part = 'passage'").collect()]
        assert sorted(got) == sorted([(i, k) for i in [*cases, 1] for k in (3, 100)])
    assert leakage.leaks(d.limit(0), "doc_id", "text", it, "item_id", "text").count() == 0
    assert leakage.leaks(d, "doc_id", "text", it.limit(0), "item_id", "text").count() == 0


def test_near_equal_items_are_all_found_whatever_the_shards(spark):
    """Planted cases with known answers: items that differ in a word, share half of their wording, or a frame sentence."""
    rng = random.Random(12)
    frame = "as far as the record goes this was noted by the keeper of the list"
    bodies = [f"{passage(rng, 30)} {frame} {passage(rng, 30)}" for _ in range(40)]
    near = []
    for k in range(12):  # variants of one passage: they differ in a word each
        w = bodies[0].split()
        w[5 + 3 * k] = f"changed{k}"
        near.append(" ".join(w))
    half = " ".join(bodies[1].split()[:38]) + " " + passage(rng, 36)
    # an item that repeats, once with another text
    items = [(i, b) for i, b in enumerate(bodies)] + [(100 + k, b) for k, b in enumerate(near)] + [(200, half), (7, bodies[7]), (7, bodies[8])]
    docs_ = {1: (bodies[0], {0, *range(100, 112)}), 2: (near[3] + passage(rng, 40), {0, *range(100, 112)}), 3: (bodies[1], {1, 200}), 4: (half, {1, 200}), 5: (f"{passage(rng, 50)} {frame} {passage(rng, 50)}", set()), 6: (bodies[7], {7}), 7: (bodies[8], {7, 8})}
    d = spark.createDataFrame([(i, t) for i, (t, _) in docs_.items()], "doc_id bigint, text string")
    it = spark.createDataFrame(items, "item_id bigint, text string")
    want = {(i, k) for i, (_, ks) in docs_.items() for k in ks}
    results = [sorted(tuple(r) for r in leakage.leaks(d, "doc_id", "text", it, "item_id", "text", shard).collect()) for shard in (1000, 9, 2)]
    for rows in results:
        assert {(r[0], r[1]) for r in rows} == want
        assert [(r[:3], pytest.approx(r[3:])) for r in rows] == [(r[:3], r[3:]) for r in results[0]]


def test_questions_and_answers_are_reported_apart(spark):
    rng = random.Random(13)
    lines = "Read this and answer.\n{}\nQuestion: which of the w{} keepers left w{} and w{} behind?\nAnswer: the w{} keeper with w{} and w{}"
    items = [(i, lines.format(passage(rng), *(rng.randrange(4000) for _ in range(6)))) for i in range(20)]
    ask, reply = items[4][1].splitlines()[-2:]
    rows = [(1, f"{passage(rng)} {ask[10:]} {passage(rng)}"), (2, items[4][1].splitlines()[1]), (3, f"{passage(rng)} {reply[8:]}"), (4, passage(rng))]
    out = leakage.leaks(spark.createDataFrame(rows, "score bigint, text string"), "score", "text", spark.createDataFrame(items, "part bigint, text string"), "part", "text")
    assert sorted(tuple(r)[:3] for r in out.collect()) == [(1, 4, "question"), (2, 4, "passage"), (3, 4, "answer")]


def test_skipping_loses_no_passage():
    rng = random.Random(1)
    bodies = {i: passage(rng, rng.randrange(24, 60)).split() for i in range(200)}
    grams = {i: list(zip(b, b[1:], b[2:])) for i, b in bodies.items()}
    used = Counter(g for x in grams.values() for g in set(x))
    index = leakage.Index.of([(i, 0, b, [used[g] for g in grams[i]]) for i, b in bodies.items()], 200, sum(map(len, grams.values())) / 200)
    texts = [sum((bodies[rng.randrange(200)][: rng.randrange(3, 40)] for _ in range(6)), []) for _ in range(60)]
    got = {(n, int(index.entry[p])) for n, p, _, _ in index.search(texts)}
    want = set()
    for n, w in enumerate(texts):
        have = set(zip(w, w[1:], w[2:]))
        for i, b in bodies.items():
            spots = {k + j for k in range(len(b) - 2) if tuple(b[k : k + 3]) in have for j in range(3)}
            if len(spots) / len(b) >= leakage.COVERED + 0.05:
                want.add((n, i))
    assert want <= got and len(want) > 100


PROSE = "The old {0} stood near the {1}, and nobody who lived there could say why it was so {2}. When the {0} was opened, they found that all of the {1}s had been {2} since the winter."


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("bdklmnrst") + rng.choice("aeiou") for _ in range(3))
    prose = {i: " ".join(PROSE.format(word(), word(), word()) for _ in range(rng.randrange(1, 5))) for i in range(160)}
    prose[1], prose[2], prose[3] = prose[1].upper(), prose[2].replace(". ", ".\n\n"), prose[3].replace(",", "").replace(".", "").lower()
    prose[4] = "<p>" + prose[4] + "</p>"
    junk = {
        500: "\n".join(f"- {word()} {word()}" for _ in range(20)), 501: " ".join(str(rng.randrange(10**6)) for _ in range(60)), 502: "the " * 80, 503: "=!#$%&*" * 30,
        504: "\n".join(f"| {word()} | {rng.randrange(99)} |" for _ in range(20)), 505: "Home\nSign in\nAll of it\nFor you\nNext\n" * 8, 506: "".join(rng.choice("ABCDEFGHabcdefgh0123456789+/") for _ in range(400)),
        507: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 12))) for _ in range(80)), 508: "\n".join(f"({c}) the {word()} of {word()}" for c in "abcdefghijklmnop"),
    }
    return prose, junk


def test_junk_stands_out_from_prose(spark):
    prose, junk = corpus()
    blank = {900: None, 901: "", 902: " \n\t　\xa0", 903: " "}
    rows = [(i, t, 1.0) for i, t in (prose | junk | blank).items()] + [(500, junk[500], 2.0)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, distance double")
    out = quality.outlierness(d, "doc_id", "text").collect()
    assert len(out) == len(prose) + len(junk) + 1
    assert {r.doc_id for r in out if not r.prose} == set(junk)
    for r in out:
        parts = sum(r[f"why_{n}"] for n in quality.STATISTICS)
        assert r.distance == pytest.approx(parts, abs=1e-6)
        assert 0 <= r.common_ratio <= 1 and 0 <= r.line_end_ratio <= 1
    assert quality.not_prose(d.limit(0), "doc_id", "text").count() == 0


OTHERS = {
    "pl": "Stary młyn stał nad rzeką i nikt nie wiedział, kiedy go zbudowano. Mówiono, że w jego piwnicy ukryto skarb, ale to była tylko opowieść dla dzieci. Kiedy przyszła zima, woda zamarzła, a koło przestało się obracać. Ludzie z wioski przestali tam chodzić i po kilku latach wszyscy o nim zapomnieli.",
    "nl": "De oude molen stond aan de rivier en niemand wist meer wanneer hij was gebouwd. Men zei dat er in de kelder een schat lag, maar dat was alleen een verhaal voor kinderen. Toen de winter kwam, bevroor het water en bleef het rad stilstaan. De mensen uit het dorp gingen er niet meer heen en na een paar jaar was iedereen hem vergeten.",
    "it": "Il vecchio mulino stava vicino al fiume e nessuno sapeva quando era stato costruito. Si diceva che nella cantina ci fosse un tesoro, ma era soltanto una storia per bambini. Quando arrivò l'inverno, l'acqua gelò e la ruota smise di girare. La gente del villaggio non ci andò più e dopo qualche anno tutti lo dimenticarono.",
    "ru": "Старая мельница стояла у реки, и никто не знал, когда её построили. Говорили, что в подвале спрятан клад, но это была только сказка для детей. Когда пришла зима, вода замёрзла, и колесо перестало вращаться. Люди из деревни больше туда не ходили, и через несколько лет все о ней забыли.",
    "zh": "那座老磨坊在河边，没有人知道它是什么时候建的。人们说地下室里藏着宝物，但那只是讲给孩子们听的故事。冬天来了的时候，河水结了冰，轮子也不再转动。村里的人不再到那里去，几年以后大家就把它忘了。",
    "ja": "その古い水車小屋は川のそばに立っていて、いつ建てられたのか誰も知らなかった。地下室に宝が隠されていると言われていたが、それは子供のための話にすぎなかった。冬が来ると水が凍り、車輪は回らなくなった。村の人々はもうそこへ行かなくなり、数年後にはみんな忘れてしまった。",
    "pt": "O velho moinho ficava perto do rio e ninguém sabia quando tinha sido construído. Dizia-se que na cave havia um tesouro, mas era apenas uma história para crianças. Quando chegou o inverno, a água gelou e a roda deixou de girar. As pessoas da aldeia não voltaram lá e depois de alguns anos todos o esqueceram.",
    "sv": "Den gamla kvarnen stod vid floden och ingen visste när den hade byggts. Man sade att det fanns en skatt i källaren, men det var bara en saga för barnen. När vintern kom frös vattnet och hjulet slutade att snurra. Folket i byn gick inte dit längre och efter några år hade alla glömt den.",
    "tr": "Eski değirmen nehrin kenarında duruyordu ve ne zaman yapıldığını kimse bilmiyordu. Bodrumda bir hazine olduğu söylenirdi, ama bu çocuklar için anlatılan bir hikâyeydi. Kış gelince su dondu ve çark artık dönmedi. Köyün insanları oraya daha gitmedi ve birkaç yıl sonra herkes onu unuttu.",
}


def test_prose_of_other_languages_is_prose(spark, data):
    """Languages without enough documents for a model of their own are judged by the pooled one."""
    _, junk = corpus()
    mixed = "的 Ж q9 の ß ζ 水 7 ы " * 12
    extra = [(-1 - i, t) for i, t in enumerate([*OTHERS.values(), mixed, *junk.values()])]
    d = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id bigint, text string"))
    out = {r.doc_id: r for r in quality.outlierness(d, "doc_id", "text").collect()}
    assert [(out[-1 - i].language, out[-1 - i].prose) for i in range(len(OTHERS))] == [(k, True) for k in OTHERS]
    assert not any(out[i].prose for i, _ in extra[len(OTHERS) :])


def test_statistics_of_known_texts(spark):
    d = spark.createDataFrame([(1, "It is so.\nAnd 12 of them\n\n- no"), (2, "!!!"), (3, "word " * 20_000)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in quality.statistics(d, "doc_id", "text").collect()}
    assert got[1].words == 8 and got[1].language == "en" and got[1].line_end_ratio == pytest.approx(1 / 3)
    assert got[2].words == 0 and got[2].symbol_ratio > 0.04
    assert got[3].words == 20_000 and got[3].repeat_ratio > 0.99


def test_queries_over_texts(spark, data):
    found = {(r.doc_id, r.item_id) for r in queries.p7_found(spark, data).collect()}
    assert found and found == {(r.doc_id, r.item_id) for r in queries.p7_scores(spark, data).where("part = 'passage'").collect()}
    ids = [r.doc_id for r in queries.p8_found(spark, data).collect()]
    assert len(ids) == len(set(ids)) == queries.p8_statistics(spark, data).where("not prose").count() > 0


@needs_vocabulary
def test_the_encoding_query(spark, data):
    rows = queries.p6_ids(spark, data).collect()
    assert len(rows) == spark.read.parquet(f"{data}/documents.parquet").count()
