"""Each training-data operator on small inputs: against brute force, a library or exact round trips, with the odd rows that their docstrings define."""

import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from aislegrid.llm import bpe, decontaminate, language_id, lm_score, near_dedup, pii, suffix_dedup, token_files, topk, url_filter
from aislegrid.llm.common import HashIndex, fold, new_path
from aislegrid.llm.queries import RULES, tokenizer_path

WORDS = "the of and river stone cloud market copper window garden silver thunder meadow lantern harbor violet marble".split()
FR = "le la de et rivière pierre nuage marché cuivre fenêtre jardin argent tonnerre prairie lanterne été forêt".split()
DE = "der die das und fluss stein wolke markt kupfer fenster garten silber donner wiese laterne straße größe".split()


def sentence(rng, n, words=WORDS):
    return " ".join(rng.choice(words) + rng.choice(["", "", "s", "ing", str(rng.randrange(90))]) for _ in range(n))


def corpus(seed=0, n=60):
    """Documents with copies, near copies, shared passages, nulls, empty and odd texts, one long text and repeated rows."""
    rng = random.Random(seed)
    rows = [(i, sentence(rng, rng.randrange(3, 120))) for i in range(n)]
    passage = sentence(rng, 60)
    rows += [(n + i, sentence(rng, 20) + "\n" + passage + "\n" + sentence(rng, 15)) for i in range(8)]
    rows += [(n + 10 + i, rows[5][1]) for i in range(4)]
    base = sentence(rng, 90).split()
    for i in range(12):
        w = list(base)
        for _ in range(i):
            w[rng.randrange(len(w))] = f"x{rng.randrange(999)}"
        rows.append((n + 20 + i, " ".join(w)))
    rows += [(n + 40, None), (n + 41, ""), (n + 42, " \t\n"), (n + 43, "one two"), (n + 44, "one two"), (n + 45, "ONE  two"), (n + 46, "aaaa " * 60), (n + 47, "日本語 Ünïcode ß 😀 " * 12), (n + 48, "日本語 Ünïcode ß 😀 " * 12)]
    rows += [(n + 50, sentence(rng, 6000)), rows[3], rows[3]]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    """Rows as documents with extra columns whose names clash with the operators' own."""
    docs = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    for c in ("lang", "source", "row", "chunk", "word", "ids", "score", "n_entities", "component", "key", "h"):
        docs = docs.withColumn(c, F.lit("x"))
    return docs.repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def test_hash_index():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))
    index = HashIndex(rng.permutation(keys))
    asked = np.concatenate([keys, rng.integers(0, 2**63, 5000).astype(np.uint64), np.array([0, 2**64 - 1], np.uint64)])
    found = index.find(asked)
    assert [(f >= 0) for f in found.tolist()] == [k in {*keys.tolist()} for k in asked.tolist()]


# 1 language ID
def kneser_ney(counts):
    names = list({k[0]: 1 for k in counts})
    return language_id.KneserNey(names, np.array([names.index(k[0]) for k in counts]), np.array([[*map(ord, k[1])] for k in counts], np.uint32), np.array(list(counts.values())))


def brute_kneser_ney(counts, symbols, order=4):
    """log p(symbol | context) by the textbook recursion over dictionaries, one language; symbols: how many all languages have."""
    levels = {order: Counter(counts)}
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])

    def p(gram):
        n = len(gram)
        if n == 0:
            return 1 / (symbols + 1)
        c = levels[n]
        one, two = (sum(x == k for x in c.values()) for k in (1, 2))
        d = min(0.95, max(0.1, one / max(1, one + 2 * two)))
        own = [x for g, x in c.items() if g[:-1] == gram[:-1]]
        if not own:
            return p(gram[1:])
        return max(c[gram] - d, 0) / sum(own) + d * len(own) / sum(own) * p(gram[1:])

    return lambda gram: math.log(p(gram))


def test_kneser_ney_equals_brute_force():
    rng = random.Random(21)
    counts, brute = Counter(), {}
    for lang, words in (("en", WORDS), ("fr", FR)):
        text = "   " + sentence(rng, 40, words)
        own = Counter(text[i : i + 4] for i in range(len(text) - 3))
        counts.update({(lang, g): n for g, n in own.items()})
        brute[lang] = own
    every = len({g[1][-1] for g in counts})  # the vocabulary is that of all languages
    model = kneser_ney(counts)
    texts = [sentence(rng, 6), sentence(rng, 6, FR), "q~é zz", "the"]
    got = model.cross_entropy([t.lower() for t in texts])[0]
    for j, lang in enumerate(model.languages):
        log_p = brute_kneser_ney(brute[lang], every)
        for i, t in enumerate(texts):
            padded = "   " + t.lower()
            wanted = -sum(log_p(padded[k : k + 4]) for k in range(len(t))) / len(t)
            assert got[i, j] == pytest.approx(wanted, abs=1e-4)


def test_kneser_ney_is_a_distribution():
    text = "   " + "the cat and the hat sat on the mat "
    model = kneser_ney(Counter(("en", text[i : i + 4]) for i in range(len(text) - 3)))
    symbols = [*{*text}, "~"]  # one symbol that was never seen stands for the unknown
    for head in ("the", " ca", "zzz", "t m"):
        grams = np.array([[ord(c) for c in head + s] for s in symbols], np.uint32)
        h = [language_id._hash_grams(grams[:, 4 - n :]) for n in range(1, 5)]
        heads = [language_id._hash_grams(grams[:, 3 - n : 3]) for n in range(1, 4)]
        assert np.exp(model._log_p(h, heads, 4)).sum() == pytest.approx(1, abs=1e-5)


def test_language_id(spark):
    rng = random.Random(3)
    rows = [(i, sentence(rng, rng.randrange(8, 60), (WORDS, FR, DE)[i % 3]), ("en", "fr", "de")[i % 3]) for i in range(600)]
    rows += [(1000, None, "en"), (1001, "", "fr"), (1002, "12 34 !!", None), (1003, sentence(rng, 30000, FR), None), (None, sentence(rng, 30, DE), None), (1005, "qzx#@ jjwq ☃☃☃ vvkx qqq zzzz xxjq " * 40, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    identifier = language_id.fit(docs, fold(F.col("doc_id"), 3) != 1)
    got = {r.doc_id: r for r in language_id.identify(docs, identifier).collect()}
    assert len(got) == len(rows)
    held_out = [r for r in rows[:600] if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert sum(got[i].lang_pred == lang for i, _, lang in held_out) >= 0.98 * len(held_out)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert not any(got[i].rejected for i, _, _ in rows[:600])
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "fr", "de"]
    assert got[1000].rejected and got[1002].rejected and got[1005].rejected and not got[1003].rejected


def test_language_id_rejects_foreign_and_random_texts(spark):
    """Held-out documents of the test table stay, but for at most one in a hundred; texts of unknown languages and random ones go."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    identifier = language_id.fit(docs, fold(F.col("doc_id"), 3) != 1)
    own = language_id.identify(docs.where(fold(F.col("doc_id"), 3) == 1), identifier)
    assert own.where("rejected").count() <= 0.01 * own.count()
    rng = random.Random(5)
    foreign = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
        "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
        "すべての人間は、生れながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。",
    ]
    foreign += ["".join(rng.choice("qxzjkvwbptgd#@%0123456789") for _ in range(400)) for _ in range(4)]
    got = language_id.identify(spark.createDataFrame(list(enumerate(foreign)), "doc_id long, text string"), identifier).collect()
    assert all(r.rejected for r in got), [(r.doc_id, r.xent) for r in got if not r.rejected]


def test_language_id_long_text_and_batches_agree():
    rng = random.Random(4)
    counts = Counter()
    for lang, words in (("en", WORDS), ("fr", FR)):
        text = "   " + sentence(rng, 2000, words)
        counts.update((lang, text[i : i + 4]) for i in range(len(text) - 3))
    model = kneser_ney(counts)
    texts = ["", "a", sentence(rng, 50), "", sentence(rng, 3, FR), "x"]
    whole = model.cross_entropy(texts)[0]
    for i, t in enumerate(texts):
        assert model.cross_entropy([t])[0][0] == pytest.approx(whole[i])
    old, language_id.SLICE_CHARS = language_id.SLICE_CHARS, 40
    try:
        assert language_id._long_safe(model, texts)[0] == pytest.approx(whole, rel=1e-5)
    finally:
        language_id.SLICE_CHARS = old


def test_language_id_without_training(spark):
    assert language_id.fit(empty(spark), F.lit(True)) is None
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert language_id.identify(docs, language_id.fit(docs, F.lit(True))).first().lang_pred == "und"
    assert language_id.identify(empty(spark), None).count() == 0


# 2 decontamination
def brute_containment(docs, items):
    words = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [words(t)] for i in range(max(1, len(w) - 4))} if words(t) else set()
    found = {}
    for d, t in docs:
        for i, q in items:
            if d is not None and t is not None and q and (s := shingles(q)):
                n = len(s & shingles(t))
                if n >= math.ceil(0.75 * len(s)):
                    found[d, i] = max(found.get((d, i), (0, 0)), (n, len(s)))
    return found


def test_decontamination(spark):
    rng = random.Random(5)
    items = [(i, sentence(rng, rng.randrange(6, 70))) for i in range(12)] + [(20, "one two"), (21, None), (22, ""), (23, "?!")]
    rows = corpus(6)
    for i in range(12):
        w = items[i][1].split()
        w[len(w) // 2] += "q" if i % 3 == 0 else ""
        rows.append((500 + i, sentence(rng, 400) + " " + " ".join(w[: len(w) - (i % 4)]).upper() + ". " + sentence(rng, 300)))
    docs = frame(spark, rows)
    got = decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))).collect()
    assert {(r.doc_id, r.item_id): (r.n_shared, r.n_item) for r in got} == brute_containment(rows, items)
    assert any(r.doc_id >= 500 for r in got) and all(r.containment >= 0.75 for r in got)
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs, nothing).count() == 0
    assert decontaminate.contaminated(empty(spark), spark.createDataFrame(items, "item_id long, text string")).count() == 0


# 3 PII
LUHN = lambda s: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def test_pii(spark):
    text = "Mr. John Smith met Mrs. Anna Smith and Mr Smith. Г-н? г-н Иванов Пётр; Κύριος Παππάς. Mail A.Lee@Foo.com or a.lee@foo.com, call +1 (988) 555-2485 or +1 988 555 2485, card 4111 1111 1111 1111 or 4111111111111111, ip 10.20.30.40, ssn 123-45-6789, password=hunter2222x"
    rows = [(1, text), (1, text), (2, None), (3, ""), (4, "nothing here, room 12 and 3.5 kg"), (None, "a.lee@foo.com"), (5, "x" * 200_000 + " z.q@foo.com")]
    docs = frame(spark, rows).drop("n_entities").withColumn("n_entities", F.lit(7))
    out = pii.with_surrogates(docs, "k")
    assert out.columns == [*docs.columns, "n_entities_"]
    got = out.collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert (by[2].text, by[2].n_entities_, by[3].text, by[4].text) == (None, 0, "", rows[4][1])
    new = by[1].text
    for secret in ("John", "Anna", "Иванов", "Παππάς", "Foo", "foo.com", "555-2485", "4111", "10.20.30.40", "123-45-6789", "hunter"):
        assert secret not in new
    a = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs\. (\w+) (\w+) and Mr (\w+)\. Г-н\? г-н (\w+) (\w+); Κύριος (\w+)\. Mail (\S+) or (\S+), call (\+1 \(\d{3}\) \d{3}-\d{4}) or (\+1 \d{3} \d{3} \d{4}), card ((?:\d{4} ){3}\d{4}) or (\d{16}), ip ((?:\d+\.){3}\d+), ssn (\d{3}-\d\d-\d{4}), password=(\w{11})", new)
    assert a, new
    assert a[2] == a[4] == a[5]
    assert a[1][-1] in "ornsu" and (a[3].endswith(("a", "ine", "elle")))
    script = lambda w: {unicodedata.name(c).split()[0] for c in w}
    assert script(a[6]) == script(a[7]) == {"CYRILLIC"} and script(a[8]) == {"GREEK"}
    assert a[9].lower() == a[10] == by[None].text and a[9][0].isupper() and a[10].endswith(".com")
    digits = lambda s: re.sub(r"\D", "", s)
    assert digits(a[11]) == digits(a[12]) and digits(a[13]) == a[14] and LUHN(a[14]) and a[14][0] == "4"
    assert all(0 <= int(x) <= 255 for x in a[15].split("."))
    assert {r.text for r in got if r.doc_id == 1} == {new}
    assert pii.with_surrogates(docs, "other").where("doc_id = 4").first().text == rows[4][1]
    assert {r.text for r in pii.with_surrogates(docs, "other").where("doc_id = 1").collect()} != {new}
    assert pii.with_surrogates(empty(spark), "k").count() == 0


def test_pii_replacements_stay_distinct(spark):
    """Thousands of short local parts: first draws collide, and some are real addresses; the results differ and none is an input."""
    names = [f"{a}{b}@q.io" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrstuvwxyz"]
    docs = spark.createDataFrame(list(enumerate(names)), "doc_id long, text string")
    got = [r.text for r in pii.with_surrogates(docs, "k").collect()]
    assert len({*got}) == len(names) and all(re.fullmatch(r"[a-z]{2,}@[a-z]\.io", x) for x in got)
    first = {r.new for r in docs.select(pii.replacement("k", F.lit("email"), F.col("text"), F.lit(""), F.lit(0)).alias("new")).collect()}
    assert len(first) < len(names)


def test_pii_tiny_forms_and_names_stay_distinct(spark):
    """All one-letter local parts at one-letter domains: no free form is left, so some get longer; distinct names of several genders stay distinct people."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    mails = [f"{a}@{b}.io" for a in letters for b in letters]
    people = [f"{t} {g.title()}{e} Q{s}" for t in ("Mr", "Dr", "Mrs") for g in ("bal", "kor", "tim") for e in "aeiou" for s in ("uell", "ade", "orn")]
    docs = spark.createDataFrame(list(enumerate(mails + people)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.with_surrogates(docs, "k").collect()}
    assert len({got[i] for i in range(len(mails))}) == len(mails) and not {*mails} & {*got.values()}
    split = lambda t: tuple(t.split(" ")[1:])
    pairs = {(split(p), split(got[len(mails) + i])) for i, p in enumerate(people)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) == 45
    for k in range(2):
        one = {(a[k], b[k]) for a, b in pairs}
        assert len(one) == len({a for a, _ in one}) == len({b for _, b in one}) and not {a for a, _ in one} & {b for _, b in one}


def test_pii_coreference(spark):
    texts = [
        "Mr John Smith came. Later Smith and JOHN SMITH left with Jane Doe; Doe stayed.",
        "Dr John Smith, MR JOHN SMITH and Prof. Mary-Jane Smith-Doe; Mary said no.",
        "Mr 王伟 and 王伟 again. Password=Hunter2hunter, PASSWORD: Hunter2hunter",
        "version 1.2.3.4 and Version: 1.2.3.4 but host 1.2.3.4; 415-555-0100 or +1 415 555 0100 or +1 (415) 555-0100",
        "digits 1234567890123456 are no card, Smithson and the smith are no Smith \ufdd0\ufdd1\ufdd2\ufdd4x",
        "Mr Smith \ufdd0\ufdd1\ufdd2\ufdd4 z.q@foo.com",
    ]
    docs = spark.createDataFrame([(i, t, "p", "q", 3, 4) for i, t in enumerate(texts)], "doc_id long, text string, __e string, doc string, row int, pieces int")
    rows = sorted(pii.with_surrogates(docs, "k").collect())
    assert all((r["__e"], r.doc, r.row, r.pieces) == ("p", "q", 3, 4) for r in rows)
    got = [r.text for r in rows]
    john, smith, later, john2, smith2, jane, doe, doe2 = re.fullmatch(r"Mr (\w+) (\w+) came\. Later (\w+) and (\w+) (\w+) left with (\w+) (\w+); (\w+) stayed\.", got[0]).groups()
    assert smith == later and (john2, smith2) == (john.upper(), smith.upper()) and doe == doe2 and len({john, smith, jane, doe, "John", "Smith", "Jane", "Doe"}) == 8
    a = re.fullmatch(r"Dr (\w+) (\w+), MR (\w+) (\w+) and Prof\. (\w+)-(\w+) (\w+)-(\w+); (\w+) said no\.", got[1]).groups()
    assert a[:4] == (john, smith, john.upper(), smith.upper()) and (a[5], a[6], a[7], a[8]) == (jane, smith, doe, a[4])
    b = re.fullmatch(r"Mr (\w{2}) and (\w{2}) again\. Password=(\w{13}), PASSWORD: (\w{13})", got[2]).groups()
    assert b[0] == b[1] != "王伟" and b[2] == b[3] != "Hunter2hunter"
    c = re.fullmatch(r"version 1\.2\.3\.4 and Version: 1\.2\.3\.4 but host (\S+); (\d{3}-\d{3}-\d{4}) or \+1 (\d{3} \d{3} \d{4}) or \+1 \((\d{3})\) (\d{3}-\d{4})", got[3]).groups()
    assert c[0] != "1.2.3.4" and len({re.sub(r"\D", "", x) for x in (c[1], c[2], c[3] + c[4])}) == 1 and c[1] != "415-555-0100"
    assert got[4] == texts[4] and rows[4].n_entities == 0
    assert got[5].startswith(f"Mr {smith} \ufdd0\ufdd1\ufdd2\ufdd4 ") and "foo" not in got[5] and rows[5].n_entities == 2
    other = [r.text for r in sorted(pii.with_surrogates(docs, "k").collect())]
    assert other == got


# 4 URL filter
def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (r.host.count("."), len(r.path)), default=None)
    return host, path, best and best.text, best.verdict if best else "allow"


def test_url_rules_joined_equal_trie(spark, monkeypatch):
    rng = random.Random(5)
    part = lambda: rng.choice(["a", "b", "ab", "", "en"])
    rules = [url_filter.Rule(rng.choice(["allow", "block"]), ".".join(rng.choice("abc") for _ in range(rng.randint(1, 3))), rng.choice(["", "/"]) + "/".join(part() for _ in range(rng.randint(0, 3)))) for _ in range(150)]
    urls = ["http://" + ".".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) + "/" + "/".join(part() for _ in range(rng.randint(0, 4))) for _ in range(500)]
    urls += [None, "", "a.b", "http://", "http://a", "HTTP://A.B?x", "http://a/" + "en/" * 3000, "http://.a./b"] + urls[:20]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = spark.createDataFrame([(r.verdict, r.host, r.path) for r in rules], "verdict string, host string, path string")
    few = sorted(map(tuple, url_filter.judge_urls(pages, rules).collect()), key=lambda r: r[0])
    few_table = sorted(map(tuple, url_filter.judge_urls(pages, table).collect()), key=lambda r: r[0])
    monkeypatch.setattr(url_filter, "MOST_RULES", 10)
    assert sorted(map(tuple, url_filter.judge_urls(pages, rules).collect()), key=lambda r: r[0]) == few
    assert sorted(map(tuple, url_filter.judge_urls(pages, table).collect()), key=lambda r: r[0]) == few_table


def test_url_filter(spark):
    urls = [None, "", "nohost", "http://", "http://com/en/", "https://a.COM/en/x?q#f", "http://Example.com/en/7", "http://www.example.com/en/77/a", "http://example.com/en/8", "http://xexample.com/en/7", "ftp://b.example.net/de/8", "http://example.net/de/9", "http://net/de", "x://org/es/#a", "http://a.org?x/es/", "http://a://b.org/es/", "http://a.com:80/en/", "http://É.com/en/", "http://a.com\n/en/", "http://.com/en/", "http://com./en/"] * 2
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("x")).withColumn("host", F.lit("y"))
    got = {r.page_id: r for r in url_filter.judge_urls(rows, RULES).collect()}
    for i, u in enumerate(urls):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == brute_url(u), u
    assert url_filter.judge_urls(rows.limit(0), RULES).count() == 0


# 5 top-k
def test_topk(spark):
    rng = np.random.default_rng(2)
    data = [(i, [float(x) for x in np.round(rng.normal(size=6), 1)]) for i in range(120)]
    data += [(200, None), (201, [1.0, None]), (202, [float("nan")] * 6), (203, [float("inf")] + [0.0] * 5), (204, [0.0] * 6), (205, []), (206, [2.0, 1.0]), (None, [1.0] * 6), (7, data[7][1]), (250, data[9][1])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("qb", F.lit("x"))
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in data if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    old = topk.QUERY_BLOCK, topk.CANDIDATE_BLOCK
    for blocks in (old, (1, 17)):
        topk.QUERY_BLOCK, topk.CANDIDATE_BLOCK = blocks
        try:
            got = defaultdict(list)
            for r in sorted(topk.top_k(df, df.where("vec_id % 50 = 0 OR vec_id = 7"), 5).collect(), key=lambda r: r.rank):
                got[r.query_id].append((r.vec_id, r.score))
        finally:
            topk.QUERY_BLOCK, topk.CANDIDATE_BLOCK = old
        asked = {i: v for i, v in ok if i % 50 == 0 or i == 7}
        assert {*got} == {*asked}
        for q, v in asked.items():
            scores = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q))[:5]
            assert got[q] == [(i, -s) for s, i in scores]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
    assert topk.top_k(df.where("vec_id IN (0, 1, 2)"), df.where("vec_id = 0")).count() == 2


# 6 and 7 tokens
ODD = ["", "   ", "It's <|endoftext|>Don't we'll\x1cx\x1f y", "Σίσυφος ΟΔΥΣΣΕΥΣ İstanbul", "a" * 500 + " " + "ab" * 700, "é ½ ² ٣ a\u0301\u0301", "emoji 😀😀 x", "<|startoftext|>a<|endoftext|> b", "\x85 a\xa0b'S 'RE", "100% 12,345.67 ...!!!"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))


def test_bpe_equals_library(library):
    rng = random.Random(8)
    texts = ODD + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x250), rng.randrange(0x400, 0x450), 32])) for _ in range(rng.randrange(200))) for _ in range(200)]
    own = bpe.WordBpe(tokenizer_path("word_bpe_49k.json"))
    for t, ids in zip(texts, bpe.encode_texts(tokenizer_path("word_bpe_49k.json"), texts), strict=True):
        wanted = library.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == wanted, t
        assert own.decode(ids) == library.decode(wanted, skip_special_tokens=False)


def test_bpe_operator(spark, library):
    rows = corpus(9) + [(None, "null id")] + [(900 + i, t) for i, t in enumerate(ODD)]
    got = Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded) for r in bpe.encode_decode(frame(spark, rows), tokenizer_path("word_bpe_49k.json")).collect())
    wanted = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        wanted[i, len(ids), tuple(ids), library.decode(ids, skip_special_tokens=False)] += 1
    assert got == wanted
    r = bpe.encode_decode(frame(spark, [(1, "Hello")]), tokenizer_path("word_bpe_49k.json"), results=("ids_sha256", "decoded_sha256"), keep=("lang",)).first()
    ids = library.encode("Hello", add_special_tokens=False).ids
    assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.lang == "x"
    assert bpe.encode_decode(empty(spark), tokenizer_path("word_bpe_49k.json")).count() == 0


def test_token_files(spark, library):
    rows = corpus(10) + [(900 + i, t) for i, t in enumerate(ODD)]
    path = new_path(spark, "tokens")
    token_files.write_token_files(frame(spark, rows), path, tokenizer_path("word_bpe_49k.json"))
    got = sorted(token_files.with_digest(token_files.read_token_files(spark, path)).collect(), key=lambda r: r.start)
    hash64 = {r.text: r.h for r in frame(spark, rows).selectExpr("text", "xxhash64(text) AS h").collect()}
    start = 0
    for r, (i, t) in zip(got, sorted(rows, key=lambda r: (r[0], hash64[r[1]], r[1])), strict=True):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    files = spark.read.orc(path)
    assert files.where("doc_id = 3").count() == 3
    again = new_path(spark, "tokens")
    token_files.write_token_files(empty(spark), again, tokenizer_path("word_bpe_49k.json"))
    assert token_files.with_digest(token_files.read_token_files(spark, again)).count() == 0


def test_token_files_look_up_documents(spark):
    path = new_path(spark, "tokens")
    token_files.write_token_files(spark.range(12_000).selectExpr("id * 2 AS doc_id", "concat('text ', id) AS text"), path, tokenizer_path("word_bpe_49k.json"))
    whole = {r.doc_id: r for r in token_files.read_token_files(spark, path).collect()}
    found = token_files.read_documents(spark, path, [40, 20_000, 41])
    assert {r.doc_id: r for r in found.collect()} == {i: whole[i] for i in (40, 20_000)}
    raw = spark.read.orc(path)

    def rows_read(condition):
        """Rows that the scan hands on before the filter."""
        got = raw.where(condition).select("doc_id", "part")
        plan = got._jdf.queryExecution().executedPlan()
        got._jdf.queryExecution().toRdd().count()
        leaves = plan.collectLeaves()
        return leaves.apply(0).metrics().apply("numOutputRows").value()

    assert rows_read("doc_id % 1000000 = 40") == 12_000
    assert 0 < rows_read("doc_id = 40") <= 1_000  # one row group, by its range
    assert rows_read("doc_id = 41") < 1_000  # within that range, but not in the Bloom filter


# 8 suffix-array dedup
def brute_removed(rows):
    first, out = {}, []
    texts = sorted(((i, (t or "").encode()) for i, t in rows), key=lambda r: r[0])
    for i, b in texts:
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        out.append((i, len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return Counter(out)


@pytest.mark.parametrize(("chunk", "hot"), [(12_000_000, 20_000), (4_000, 20_000), (12_000_000, 3), (4_000, 3)])
def test_suffix_dedup(spark, chunk, hot):
    rows = corpus(11) + [(2000, "a" * 400), (2001, "b" + "a" * 120 + "c"), (2002, "ab" * 100), (2003, "x" + "ab" * 100)]
    phrase = "the same short phrase of thirty or more bytes"
    rows += [(3000 + i, f"{i * 7919 % 101:03d} before it {phrase} and {i % 5} after it, {i % 3}" + " and so on" * 3) for i in range(40)]
    old = suffix_dedup.CHUNK_BYTES, suffix_dedup.MOST_CHUNK_BYTES, suffix_dedup.RUN_BYTES, suffix_dedup.BATCH, suffix_dedup.HOT_ANCHOR
    suffix_dedup.HOT_ANCHOR = hot
    suffix_dedup.CHUNK_BYTES = suffix_dedup.MOST_CHUNK_BYTES = chunk
    suffix_dedup.RUN_BYTES, suffix_dedup.BATCH = (1000, 7) if chunk < 10_000 else old[2:4]
    try:
        got = Counter(tuple(r)[:4] + (bytes(r.kept),) for r in suffix_dedup.without_repeats(frame(spark, rows)).collect())
    finally:
        suffix_dedup.CHUNK_BYTES, suffix_dedup.MOST_CHUNK_BYTES, suffix_dedup.RUN_BYTES, suffix_dedup.BATCH, suffix_dedup.HOT_ANCHOR = old
    assert got == brute_removed(rows)


def test_suffix_dedup_odd_tables(spark):
    assert suffix_dedup.without_repeats(empty(spark)).count() == 0
    text = "0123456789" * 6
    got = sorted(suffix_dedup.without_repeats(spark.createDataFrame([(None, text), (4, text)], "doc_id long, text string")).collect(), key=lambda r: r.doc_id or -1)
    assert [(r.doc_id, r.n_removed) for r in got] == [(None, 0), (4, 60)]


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getPath(): files.apply(i).length() for i in range(files.size())}


def test_suffix_dedup_packs_what_it_exchanges(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 400_000)
    monkeypatch.setattr(suffix_dedup, "MOST_CHUNK_BYTES", 400_000)
    rng = random.Random(13)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(800)]
    rows = []
    for i in range(1200):
        text = [rng.choice(words) for _ in range(400)] if i % 3 else rows[rng.randrange(len(rows))][1].split(" ") if rows else words[:400]
        text[rng.randrange(len(text))] = f"edit{i}"
        rows.append((i, " ".join(text)))
    docs = frame(spark, rows).localCheckpoint()
    before = shuffle_files(spark)
    got = Counter(tuple(r)[:4] + (bytes(r.kept),) for r in suffix_dedup.without_repeats(docs).collect())
    written = sum(n for path, n in shuffle_files(spark).items() if path not in before)
    assert got == brute_removed(rows)
    assert 0 < written < 1.6 * sum(len(t) for _, t in rows)


def test_suffix_family_finds_earlier_documents():
    rng = random.Random(12)
    family, seen = suffix_dedup.SuffixFamily(), {}
    for doc in range(40):
        batch = [bytes(rng.choice(b"ab") for _ in range(6)).ljust(50, b"-") for _ in range(5)]
        got = family.add(np.array(batch, "S50"), np.full(5, doc))
        assert got.tolist() == [s in seen for s in batch]
        seen.update(dict.fromkeys(batch))
    sizes = [len(s) for s, _ in family.levels]
    assert all(a > 2 * b for a, b in zip(sizes, sizes[1:]))


# 9 LM scoring
def test_lattice_equals_enumeration():
    pieces = lm_score.Pieces(tokenizer_path("piece_bpe_32k.model"))
    weights = dict(zip(pieces.pieces, pieces.log_p.tolist(), strict=True))
    go = math.log1p(-math.exp(pieces.stop))

    def paths(raw, i):
        if i == len(raw):
            return math.exp(pieces.stop)
        return sum(math.exp(weights[raw[i:j]] + (go if i else 0)) * paths(raw, j) for j in range(i + 1, len(raw) + 1) if raw[i:j] in weights)

    words = [b"the", b"a", b"stones", "größe".encode(), b"\xff\x00q", b"x" * 9]
    got = pieces.log_words([*words, b"long" * 30, b"z" * 3000])
    assert got[:-2] == pytest.approx([math.log(paths(b" " + w, 0)) for w in words]) and np.isfinite(got).all()
    uses = pieces.expected(words)
    assert uses[pieces.first].sum() == pytest.approx(len(words))
    old, lm_score.LONG = lm_score.LONG, 2
    try:
        assert pieces.log_words(words) == pytest.approx(got[:-2])
        assert pieces.expected(words) == pytest.approx(uses)
    finally:
        lm_score.LONG = old


def test_lm_score_equals_enumeration(spark):
    """The score of small documents is the sum over all segmentations, with the training words as arcs of their own."""
    rows = [(1, "the stone the"), (2, "a stone"), (3, "the river"), (4, "cat the cats"), (5, None), (6, "the rivers riverst")]
    learnt = {1, 2, 3, 5}
    got = {r.doc_id: r.score for r in lm_score.score(frame(spark, rows), tokenizer_path("piece_bpe_32k.model"), F.col("doc_id").isin(*learnt)).collect()}
    counts = Counter(w.encode() for i, t in rows if i in learnt for w in (t or "").split())
    pieces = lm_score.Pieces(tokenizer_path("piece_bpe_32k.model"))

    def segmentations(raw, i=0):
        if i == len(raw):
            yield []
        for j in range(i + 1, len(raw) + 1):
            if raw[i:j] in known:
                yield from ([raw[i:j], *rest] for rest in segmentations(raw, j))

    def weight(path):  # every piece but the last goes on, the last one stops
        return math.exp(sum(known[p] for p in path) + (len(path) - 1) * math.log1p(-math.exp(pieces.stop)) + pieces.stop)

    known, uses = dict(zip(pieces.pieces, pieces.log_p.tolist(), strict=True)), Counter()
    for w in counts:
        paths = [(p, weight(p)) for p in segmentations(b" " + w)]
        for p, x in paths:
            for piece in p:
                uses[piece] += x / sum(y for _, y in paths)
    pieces.learn(np.array([uses[p] for p in pieces.pieces]), float(len(counts)))
    known = dict(zip(pieces.pieces, pieces.log_p.tolist(), strict=True))
    n, one, two = sum(counts.values()) + len(learnt), sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values())
    d = min(0.95, max(0.1, one / (one + 2 * two)))
    for i, t in rows:
        p = [(max(counts[w.encode()] - d, 0) + d * len(counts) * sum(map(weight, segmentations(b" " + w.encode())))) / n for w in (t or "").split()]
        assert got[i] == pytest.approx(sum(map(math.log10, [*p, len(learnt) / n]))), t


def test_lm_score(spark):
    rows = corpus(13, 120)
    training = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    old, lm_score.HOT = lm_score.HOT, 10
    try:
        got = lm_score.score(frame(spark, rows), tokenizer_path("piece_bpe_32k.model"), fold(F.col("doc_id"), 7) != 2).collect()
        lm_score.HOT = 100_000
        same = lm_score.score(frame(spark, rows), tokenizer_path("piece_bpe_32k.model"), fold(F.col("doc_id"), 7) != 2).collect()
    finally:
        lm_score.HOT = old
    words = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    counts, n_docs = Counter(), 0
    for i, t in rows:
        if training(i):
            counts.update(words(t))
            n_docs += 1
    n, v = sum(counts.values()) + n_docs, len(counts) + 1
    wanted = defaultdict(list)
    for i, t in rows:
        w = words(t)
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w) + math.log10((n_docs + 1) / (n + v + 1))
        wanted[i].append((len(w) + 1, sum(counts[x] > 0 for x in w) + 1, n, pytest.approx(base)))
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) in wanted[r.doc_id]
        assert r.score < 0 and math.isfinite(r.score)
    key = lambda r: (r.doc_id, r.score)
    assert [r.score for r in sorted(got, key=key)] == pytest.approx([r.score for r in sorted(same, key=key)])
    nothing = lm_score.score(frame(spark, [(1, "a b"), (None, None)]), tokenizer_path("piece_bpe_32k.model"), F.lit(False)).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in nothing} == {(1, 3, 0, 0), (None, 1, 0, 0)}
    assert lm_score.score(empty(spark), tokenizer_path("piece_bpe_32k.model"), F.lit(True)).count() == 0


# 10 near-dedup
def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("block", [512, 3])
def test_near_dedup(spark, block):
    rng = random.Random(14)
    rows = corpus(15)
    base = sentence(rng, 150).split()
    for i in range(60):  # graded edits: links that no common centre shows
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = f"y{rng.randrange(9999)}"
        rows.append((3000 + i, " ".join(w)))
    old, near_dedup.BLOCK = near_dedup.BLOCK, block
    try:
        got = near_dedup.near_duplicates(frame(spark, rows)).collect()
    finally:
        near_dedup.BLOCK = old
    wanted = brute_components(rows)
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == wanted


def test_near_dedup_odd_tables(spark):
    assert near_dedup.near_duplicates(empty(spark)).count() == 0
    r = near_dedup.near_duplicates(spark.createDataFrame([(None, "a b c")], "doc_id long, text string")).first()
    assert (r.n_shingles, r.component_id, r.kept) == (1, None, True)
    one, two = "a b c d e f g h", "p q r s t u v w"  # id 7 comes with both texts, so all rows are one component
    rows = [(3, one), (7, one), (7, two), (9, two), (9, two), (None, two)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(3, 3), (7, 3), (9, 3), (None, None)} and len(got) == 6


def test_sketches_estimate_and_merge():
    rng = np.random.default_rng(3)
    for shared, own in ((600, 200), (900, 50), (100, 900)):
        common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) for n in (shared, own, own))
        u, v = near_dedup.registers(np.append(common, a)), near_dedup.registers(np.append(common, b))
        j = shared / (shared + 2 * own)
        n = np.array([float(shared + own)])
        guess, lacking = near_dedup.estimate(u[None], v[None], n, n)
        assert guess[0] == pytest.approx(j, abs=0.15)
        assert (lacking[0] < near_dedup.DOUBT) == (j > 0.5)
        assert (np.maximum(u, v) == near_dedup.registers(np.concatenate([common, a, b]))).all()


# rows that once hung, failed or lost results
def test_masks_long_addresses_and_full_forms(spark, monkeypatch):
    rows = [(1, "Password: ********** please"), (2, "mail x@" + "ab." * 100_000 + "com now"), (3, "Mr " + "Ab-" * 3_000 + "Ab came"), (4, "MR " + "AB-" * 3_000 + "AB came"), (5, "token=a******* and token=B*******")]
    got = {r.doc_id: (r.text, r.n_entities) for r in pii.with_surrogates(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    assert got[1] == (rows[0][1], 0) and [got[i][1] for i in (2, 3, 4, 5)] == [1, 1, 1, 2]
    assert all(got[i][0] != rows[i - 1][1] for i in (2, 3, 4, 5)) and got[2][0].startswith("mail ") and got[2][0].endswith(" now")
    monkeypatch.setattr(pii, "GROW", 1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, " ".join(f"token={c}*******" for c in letters)) for i in range(2)]  # all forms of that shape are real
    rows += [(10 + i, " ".join(f"call +1 {i:02d} {j:02d}." for j in range(100))) for i in range(100)]
    got = {r.doc_id: r.text for r in pii.with_surrogates(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    secrets = re.findall(r"token=(\S+)", got[0])
    assert got[0] == got[1] and len({*secrets}) == 26 and not {*secrets} & {f"{c}*******" for c in letters}
    phones = [p for i in range(100) for p in re.findall(r"call (\+1[ \d]+)\.", got[10 + i])]
    assert len(phones) == len({*phones}) == 10_000 and not {*phones} & {f"+1 {i:02d} {j:02d}" for i in range(100) for j in range(100)}


def test_decontaminate_repeated_items(spark):
    rng = random.Random(31)
    items, docs = [], []
    for i in range(30):
        w = [f"w{i}x{j}" for j in range(44)]  # 40 shingles
        items.append((i, " ".join(w)))
        for k in range(6):  # exactly 30 of them
            docs.append((100 * i + k, " ".join([*(f"a{rng.random()}" for _ in range(k)), *w[k : k + 34], "end of it"])))
    docs += [(None, items[0][1]), (9000, items[3][1] + " word" * 400_000), (9001, None)]
    once = {(r.doc_id, r.item_id, r.n_shared) for r in decontaminate.contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(once) == 181
    more = [*items, *items, *items, (None, "a b c d e f"), (0, " ".join(f"w1x{j}" for j in range(44)))]  # id 0 has a second text
    again = {(r.doc_id, r.item_id, r.n_shared) for r in decontaminate.contaminated(frame(spark, docs), spark.createDataFrame(more, "item_id long, text string")).collect()}
    assert again == once | {(d, 0, n) for d, i, n in once if i == 1}
