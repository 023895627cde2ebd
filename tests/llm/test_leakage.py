"""Leak search against a brute-force version that aligns every document with every passage."""

import html
import json
import random
import textwrap

import pytest

from graphloom.llm import leakage
from graphloom.llm.text import fold, unescape, words

VOWELS, CONSONANTS = "aeiou", "bdfgklmnprstv"


def invent(pick, n):
    return ["".join(pick.choice(CONSONANTS) + pick.choice(VOWELS) for _ in range(pick.randrange(2, 5))) for _ in range(n)]


def passage(pick, n=60):
    out = invent(pick, n)
    return " ".join(w.capitalize() + ("." if i % 9 == 8 else "," if i % 7 == 3 else "") for i, w in enumerate(out))


def brute(document, wanted):
    """Whether any stretch of the passage is in the document by the rule: all pairs of starts and
    ends, edit distance by dynamic programming."""
    d, p = words(document), words(wanted)
    for i in range(len(p) - 15):
        if any(d[j : j + 16] == p[i : i + 16] for j in range(len(d) - 15)):
            return True
    for i in range(len(p) - 29):
        row = [0] * (len(d) + 1)  # free start in the document
        for n, w in enumerate(p[i:], 1):
            new = [n] + [0] * len(d)
            for j, x in enumerate(d, 1):
                new[j] = min(row[j - 1] + (w != x), row[j] + 1, new[j - 1] + 1)
            row = new
            if n >= 30 and min(row) * 8 <= n and p[i] in d and w in d:
                return True
    return False


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id bigint, text string, passage string")
    e = spark.createDataFrame([(i, t, "clash") for i, t in items], "eval_id bigint, passage string, text string")
    found = [tuple(r) for r in leakage.leaked_items(d, e).collect()]
    assert len(found) == len(set(found))
    return set(found)


def edited(pick, text, every, kind):
    out = []
    for i, w in enumerate(text.split()):
        if i % every == every // 2:
            out += {"replace": ["zzz"], "drop": [], "add": [w, "zzz"]}[kind]
        else:
            out.append(w)
    return " ".join(out)


DISGUISES = {
    "upper": str.upper,
    "title": lambda t: t.replace(",", "").replace(".", "").title(),
    "wrapped": lambda t: textwrap.fill(t, 30),
    "quoted": lambda t: "\n".join("> " + x for x in textwrap.wrap(t, 40)),
    "one word a line": lambda t: t.replace(" ", "\n"),
    "html": lambda t: "<p>" + t.replace(" ", "&nbsp;", 9).replace(" ", "<br/>", 5) + "</p>",
    "bold": lambda t: " ".join(f"<b>{w}</b>" if i % 4 == 0 else w for i, w in enumerate(t.split())),
    "json": lambda t: json.dumps({"prompt": t, "label": 1}),
    "soft hyphens": lambda t: " ".join(w[:2] + "\xad" + w[2:] for w in t.split()),
    "zero width": lambda t: " ".join(w[:2] + "​" + w[2:] for w in t.split()),
    "hyphenated": lambda t: " ".join(w[:3] + "-\n" + w[3:] if i % 5 == 4 and len(w) > 4 else w for i, w in enumerate(t.split())),
    "broken": lambda t: " ".join(w[:3] + "\n" + w[3:] if i % 5 == 4 and len(w) > 4 else w for i, w in enumerate(t.split())),
    "full width": lambda t: "".join(chr(ord(c) + 0xFEE0) if "a" <= c <= "z" else c for c in t),
    "links": lambda t: " ".join(f"[**{w}**](http://x.invalid/{i})" if i % 3 == 0 else w for i, w in enumerate(t.split())),
    "percent": lambda t: t.replace(" ", "%20"),
    "entities": lambda t: html.escape(t).replace("a", "&#97;"),
    "spaced punctuation": lambda t: t.replace(",", " , ").replace(".", " . "),
}


@pytest.fixture(scope="module")
def material():
    pick = random.Random(3)
    return pick, {i: passage(pick) for i in range(1, 7)}, [" ".join(invent(pick, 25)) + "." for _ in range(8)]


def test_every_disguise(spark, material):
    pick, items, prose = material
    docs = [(n, prose[n % 8] + "\n\n" + f(" ".join(items[n % 6 + 1].split()[5:35])) + "\n\n" + prose[(n + 1) % 8]) for n, f in enumerate(DISGUISES.values())]
    found = run(spark, docs, items.items())
    assert found == {(n, n % 6 + 1) for n in range(len(DISGUISES))}


def test_edits_and_lengths_match_brute_force(spark, material):
    pick, items, prose = material
    docs = []
    for n in (12, 15, 16, 17, 28, 30, 45, 60):
        for start in (0, 3):
            docs.append(prose[0] + " " + " ".join(items[1].split()[start : start + n]) + " " + prose[1])
    for kind in ("replace", "drop", "add"):
        for every in (4, 6, 7, 8, 9, 10, 12):
            for n in (24, 32, 40, 60):
                docs.append(prose[2] + " " + edited(pick, " ".join(items[2].split()[:n]), every, kind) + " " + prose[3])
    docs += [" ".join(pick.sample(items[3].split(), 60)), prose[4]]
    want = {(i, e) for i, d in enumerate(docs) for e, p in items.items() if brute(d, p)}
    got = run(spark, list(enumerate(docs)), items.items())
    assert got == want


def test_two_items_parts_and_copies(spark, material):
    _, items, prose = material
    a, b = items[1].split(), items[2].split()
    docs = [(1, " ".join(a[:20] + prose[0].split() + b[10:30])), (2, " ".join(a[:10] + prose[0].split() + a[10:20])), (3, items[1]), (4, items[1]), (3, items[1])]
    assert run(spark, docs, items.items()) == {(1, 1), (1, 2), (3, 1), (4, 1)}


def test_nulls_empty_and_long(spark, material):
    _, items, prose = material
    long_text = " ".join(prose * 2000) + " " + items[5]
    docs = [(1, None), (2, ""), (3, " \n"), (None, items[1]), (4, long_text)]
    assert run(spark, docs, [*items.items(), (90, None), (91, ""), (92, "short one"), (None, None)]) == {(4, 5)}
    assert run(spark, [], items.items()) == set() and run(spark, docs, []) == set()


def test_shuffled_seeds_give_the_same(spark, material, monkeypatch):
    _, items, prose = material
    docs = [(1, items[1]), (2, prose[0]), (3, edited(None, items[2], 10, "add"))]
    want = run(spark, docs, items.items())
    monkeypatch.setattr(leakage, "TEST_CHARS", 0)
    monkeypatch.setattr(leakage, "BROADCAST_CHARS", 0)
    assert run(spark, docs, items.items()) == want == {(1, 1), (3, 2)}
    monkeypatch.setattr(leakage, "VOCABULARY_WORDS", 0)
    assert run(spark, docs, items.items()) == want == {(1, 1), (3, 2)}


def test_report(spark, material):
    _, items, _ = material
    e = spark.createDataFrame([(i, "s", "en", p) for i, p in items.items()], "eval_id bigint, suite string, lang string, passage string")
    leaks = spark.createDataFrame([(1, 1), (2, 1)], "doc_id bigint, eval_id bigint")
    assert {r.eval_id: r.documents for r in leakage.leak_report(leaks, e).collect()} == {1: 2, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0}


def test_words():
    assert words("L'Été à la <b>Plage</b>, don’t!") == ["lete", "a", "la", "plage", "dont"]
    assert words(None) == words(" ") == []
    assert words("whis\ntle tree", {"whistle"}) == ["whistle", "tree"] and words("in\nto", {"in", "to", "into"}) == ["in", "to"]
    assert unescape("caf\\u00e9 caf%C3%A9 caf=C3=A9 cafÃ© &eacute; 100% &amp;amp;") == "café café café café é 100% &"
    assert fold("Straße ﬁn Ａ１") == "strasse fin a1"


def test_edits_in_the_middle_of_longer_stretches(spark, material):
    _, _, prose = material
    pick = random.Random(8)
    items = {n: passage(pick, n) for n in (40, 44, 48, 56)}
    cut = lambda n, at: " ".join("zzz" if i in at else w for i, w in enumerate(items[n].split()))
    docs = [prose[0] + " " + cut(40, {10, 15, 20, 25, 29}) + " " + prose[1]]
    for n in items:
        for _ in range(8):
            docs.append(prose[2] + " " + cut(n, set(pick.sample(range(6, n - 6), n // 8))) + " " + prose[3])
    want = {(i, e) for i, d in enumerate(docs) for e, p in items.items() if brute(d, p)}
    assert (0, 40) in want and len(want) == len(docs)
    assert run(spark, list(enumerate(docs)), items.items()) == want


def test_prefilter_against_all_stretches():
    pick = random.Random(9)
    for _ in range(3000):
        n = pick.randrange(14, 70)
        lacks = [pick.random() < pick.choice((0.05, 0.13, 0.2)) for _ in range(n)]
        long = any(not any(lacks[i : i + 16]) for i in range(n - 15))
        want = long or any(sum(lacks[i:j]) * 8 <= j - i for i in range(n) for j in range(i + 30, n + 1))
        assert leakage.may_hold({str(i) for i, gone in enumerate(lacks) if not gone}, [str(i) for i in range(n)]) == want


def brute_any_ends(document, wanted):
    """brute() without its demand that the first and last word of a stretch be intact."""
    d, p = words(document), words(wanted)
    if brute(document, wanted):
        return True
    for i in range(len(p) - 29):
        row = [0] * (len(d) + 1)
        for n, w in enumerate(p[i:], 1):
            new = [n] + [0] * len(d)
            for j, x in enumerate(d, 1):
                new[j] = min(row[j - 1] + (w != x), row[j] + 1, new[j - 1] + 1)
            row = new
            if n >= 30 and min(row) * 8 <= n:
                return True
    return False


def test_edits_at_the_ends_of_a_stretch(spark, material):
    _, items, prose = material
    pick = random.Random(10)
    part = items[4].split()[12:42]
    cut = lambda at, kind: " ".join(x for i, w in enumerate(part) for x in ({"replace": ["zzz"], "drop": [], "add": [w, "zzz"]}[kind] if i in at else [w]))
    docs = [prose[0] + " " + cut(at, "replace") + " " + prose[1] for at in ({0, 10, 20}, {9, 19, 29}, {0, 14, 29}, {0, 10, 20, 29})]
    docs += [prose[2] + " " + cut(set(pick.sample(range(30), n)), kind) + " " + prose[3] for n in (3, 4) for kind in ("replace", "drop", "add") for _ in range(8)]
    docs += [cut({0, 10, 20}, "replace"), " ".join(items[4].split()[:14] + ["zzz"] + items[4].split()[15:29])]
    want = {(i, e) for i, d in enumerate(docs) for e, p in items.items() if brute_any_ends(d, p)}
    assert {(0, 4), (1, 4), (2, 4)} <= want and (3, 4) not in want
    assert run(spark, list(enumerate(docs)), items.items()) == want


def test_verification_against_brute_force():
    pick = random.Random(11)
    for _ in range(400):
        whole = [pick.choice("abcdefghijklmnopqrstuvwxyz") + str(pick.randrange(9)) for _ in range(pick.choice((30, 34, 50)))]
        start, n = pick.randrange(0, 12), pick.choice((26, 27, 28, 29, 30, 32, 40))
        text = " ".join(whole[start : start + n])
        for _ in range(pick.randrange(2, 6)):
            part = text.split()
            at = pick.randrange(len(part))
            part[at : at + pick.randrange(2)] = ["zz"] * pick.randrange(2)
            text = " ".join(part)
        document, wanted = "zz zz " + text + " zz zz", " ".join(whole)
        want = brute_any_ends(document, wanted)
        d, p = words(document), words(wanted)
        assert leakage.holds(d, p) == want, (document, wanted)
        assert leakage.may_hold(set(d), p) or not want


def test_many_test_words_change_nothing(spark, material, monkeypatch):
    _, items, prose = material
    docs = [(n, prose[n % 8] + "\n\n" + f(" ".join(items[n % 6 + 1].split()[5:35])) + "\n\n" + prose[(n + 1) % 8]) for n, f in enumerate(DISGUISES.values())]
    docs += [(90, "\n".join(w[i : i + 2] for w in items[1].split() for i in range(0, len(w), 2))), (91, "".join(items[2].split()[:2]) + items[2]), (91, None), (92, prose[0]), (93, "")]
    want = run(spark, docs, items.items())
    assert {(n, n % 6 + 1) for n in range(len(DISGUISES))} <= want
    monkeypatch.setattr(leakage, "TEST_CHARS", 0)
    assert run(spark, docs, items.items()) == want
    monkeypatch.setattr(leakage, "VOCABULARY_WORDS", 0)
    assert run(spark, docs, items.items()) == want
    assert run(spark, docs, []) == run(spark, [], items.items()) == set()


def test_lookups_are_all_that_is_looked_up():
    pick = random.Random(12)
    for _ in range(2000):
        word = lambda: "".join(pick.choice("ab") for _ in range(pick.randrange(1, 5)))
        vocabulary = {word() + pick.choice(("", word())) for _ in range(pick.randrange(1, 40))}
        text = "".join(word() + pick.choice((" ", "\n", "\n", "\n> ", " " * 3)) for _ in range(pick.randrange(30)))
        own = leakage.lookups(text, max(map(len, vocabulary))) & vocabulary
        assert words(text, own) == words(text, vocabulary)
        assert leakage.repaired(words(text, own), own) == leakage.repaired(words(text, vocabulary), vocabulary)


def test_markup_and_escapes_of_any_size(spark, material):
    _, items, prose = material
    part = items[1].split()[3:23]
    long_tag = f'<a href="http://x.invalid/{"q" * 10_000}" title="{"none of the words " * 500}">'
    fivefold = part[:]
    fivefold[5] += "&amp;amp;amp;amp;nbsp;"
    docs = [
        (1, prose[0] + " " + long_tag.join(w + " " for w in part)),
        (2, " ".join(f"[url={'x' * 5000}]{w}[/url]" for w in part)),
        (3, " ".join(fivefold)),
        (4, "[" + "] [".join(part) + "]"),
        (5, " ".join(f"[averylongtagname]{w}[/averylongtagname]" for w in part)),
        (6, "\\\\\\\\\\\\\"".join(part[:1]) + " " + " ".join(part) + "\\\\\\\\\\\\\""),
    ]
    assert run(spark, docs, items.items()) == {(i, 1) for i, _ in docs}
    deep = "caf" + "&" + "amp;" * 100_000 + "eacute; 100" + "%" + "25" * 50_000 + "C3" + "%" + "25" * 50_000 + "A9"
    assert unescape(deep) == "café 100é"


def test_texts_searched_together_are_kept_apart(monkeypatch):
    pick = random.Random(13)
    items = [(i, passage(pick)) for i in range(5)]
    index = leakage.TestIndex(items, leakage.MASKS)
    texts = []
    for _ in range(60):
        words_ = pick.choice(items)[1].split()
        at = pick.randrange(0, 45)
        texts += [" ".join(words_[at : at + 9]), " ".join(words_[at + 9 : at + 18]), " ".join(words_[at : at + 18]), "", "one"]
    alone = [next(index.leaks([t])) for t in texts]
    assert list(index.leaks(texts)) == alone and any(alone)
    monkeypatch.setattr(leakage, "PART_WORDS", 50)
    assert list(index.leaks(texts)) == alone
