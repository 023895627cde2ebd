import pytest

from graphloom.llm import structure
from graphloom.llm.structure import divergence, document_form, form_sizes, garbled, text_counts, text_statistics

PROSE = {
    "en": "I read it on the train and thought the ending was warm. My sister told me about it, and I am glad that I listened.",
    "de": "Ich habe es im Zug gelesen und war begeistert, denn das Ende ist klug. Meine Schwester hat es mir empfohlen.",
    "fr": "Je l'ai lu dans le train et j'ai trouvé la fin vraiment drôle. Ma sœur me l'avait conseillé, et je ne le regrette pas.",
    "es": "Lo leí en el tren y me pareció que el final es excelente. Mi hermana me lo recomendó, y no me arrepiento.",
    "ja": "去年の冬に読みましたが、物語がとても面白いです。妹に勧められて買いました。",
    "it": "L'ho letto in treno e mi è piaciuto molto, perché la fine è una sorpresa. Non lo dimenticherò.",
    "nl": "Ik heb het in de trein gelezen en het was mooi, want het einde is een verrassing.",
}
LISTS = [
    "- Essays\n- the cover\n- Silent Bell\n- narrator cold\n- plot",
    "1. Poetry\n2) die Handlung\n3. Iron Gate\n4. das Papier\n5. Romance",
    "Contents:\n[x] Drama\n[ ] the plot\n[x] Anna Belk\n[ ] paper",
    "Green Orchard\nsurprising\nPoetry\ngraceful\nSecond Archive\nBiography\nsetting sloppy",
    "la couverture, Poetry, la deuxième partie, le rythme, Iron River, le début, la fin, Essays",
    "Ch. 1 plot ... 10\nCh. 2 Drama ... 21\n§ 3 Anna Belk ... 28\nKap. 4 Iron Gate ... 40",
    "+ :\n  + Essays\n  + paper\n- :\n  - plot dull\n  - humour",
]
TABLES = [
    "year,pages,title\n794,527,Green Ladder\n878,806,Silent Winter\n619,138,Iron Gate",
    "a;b;c\n1;2;x\n3;4;y\n5;6;z",
    "format\tyear\tscore\nPaper\t841\t790\nCloth\t84\t706",
    "| title | year |\n| --- | --- |\n| Green Ladder | 1990 |\n| Iron Gate | 2001 |",
    "<table><tr><td>A</td><td>12</td></tr><tr><td>B</td><td>7</td></tr><tr><td>C</td><td>9</td></tr></table>",
    "grade      pages      score\nC          573        435\nB          122        195",
    "┌─────────┐\n│pages│stock│\n│425│544│\n│674│12│\n└─────────┘",
]
JUNK = [
    "😂💯✨😡⭐⭐😡💯😂⭐😂😀👍⭐🔥😀😡⭐🎉🎉😂👍😡⭐", "lalala lalala lalala lalala lalala lalala lalala lalala", "_" * 80, "!" * 200,
    "rfkwhmwmszk sbjbhd hljwvp tzjssbsgt kkwmfhb qjmztmjpmw pkfksmkjnrt jnncpqw nkzx", "%E7%B8%1A%A1%45%60%53%F6%37%83%D2%4F%99%F1%5E%83%A7",
    "2kD690uuhpr5lta45ZFoEkzu6BXwpXzEOW6z5cwllgVD5OMv0UQWGFdfVucGySsm+s8CxuZ", "93608972697 3224134 429194630 37190761 218 570048 248382899", "http://a.invalid/765?ref=31 http://b.invalid/607?ref=64 http://c.invalid/35",
    "at a.Valow.run(Ulb.java:152)\nat b.Dal.run(Cor.java:7)\nat c.Dol.call(Tre.java:19)", '<br><span/>&#64;{margin:31px}</div><span/><br>&#70;{margin:58px}&nbsp;<div class="c34">function(){return 5;}</div>',
]


def form(text):
    return document_form(form_sizes(text))


@pytest.mark.parametrize("text", PROSE.values(), ids=PROSE)
def test_prose_in_any_layout(text):
    wrapped = "\n".join(text[i : i + 40] for i in range(0, len(text), 40)) if " " not in text else "\n".join(" ".join(text.split()[i : i + 5]) for i in range(0, len(text.split()), 5))
    for t in (text, text.upper(), wrapped, "> " + wrapped.replace("\n", "\n> "), f"<p>{text}</p>", '{"review": "%s", "stars": 4}' % text, f'"{text}"', text.replace(" ", "&nbsp;", 3), text + "\n\n| Alba | 4 |\n| Bree | 2 |\n\n" + text, text + "\n- one\n- two\n" + text):
        assert form(t) == "prose", t


@pytest.mark.parametrize("text", ["Gerne wieder.", "Mauvais", "À lire", "良い本", "As described, thanks", "Good, not perfect", "Great.", "Ok for the price", "😡"[:0], None, "", " \n\t", "Why?\nBecause."])
def test_short_and_blank(text):
    assert form(text) == "prose"


@pytest.mark.parametrize("want, texts", [("list", LISTS), ("table", TABLES), ("junk", JUNK)])
def test_forms(want, texts):
    for t in texts:
        assert form(t) == want, t
        assert form(PROSE["en"].split(".")[0] + ".\n" + t * (1 + 200 // len(t)) if want == "junk" else t) == want, t


def test_more_than_half_decides():
    junk = "x9" * 30
    assert form(PROSE["en"] + "\n" + "!" * 60) == "prose" and form(PROSE["en"] + "\n" + "!" * 400) == "junk"
    assert sum(form_sizes(PROSE["en"] + "\n" + junk).values()) == len(PROSE["en"]) + 1 + len(junk) + 1


def test_one_word_a_line():
    assert form("\n".join(PROSE["en"].split())) == "prose"


def test_divergence():
    assert divergence({"a": 1.0}, {"a": 1.0}) == 0 and divergence({"a": 1.0}, {"b": 1.0}) == 1
    assert divergence({"a": 0.5, "b": 0.5}, {"a": 1.0}) == divergence({"a": 1.0}, {"a": 0.5, "b": 0.5})


def test_garbled():
    assert all(map(garbled, ["rfkwhmwmszk", "teutlqeprowqkalpoug", "kkwmfhb"])) and not any(map(garbled, ["strengths", "Vorelane", "Schwester", "Angstschweiß", "selbstständig", "queue", "the", "物語"]))


def test_counts(spark):
    df = spark.createDataFrame([("The cat sat.\nA dog!\nno end", 1), (None, 1), ("", 1), ("x²\u2028 \t\r\nça va:  \x1c", 1), ("!?", 1), ("去年の冬\u3000に。", 1)], "text string, doc_id bigint")
    rows = [tuple(r)[1:] for r in text_counts(df).collect()]
    assert rows[0] == (7, pytest.approx(18 / 7), pytest.approx(2 / 26), pytest.approx(2 / 3), pytest.approx(3 / 7))
    assert rows[1] == rows[2] == (0, 0.0, 0.0, 0.0, 0.0)
    assert rows[3] == (3, 2.0, pytest.approx(1 / 16), 0.5, 0.0) and rows[4] == (0, 0.0, 1.0, 1.0, 0.0) and rows[5] == (2, 2.5, pytest.approx(1 / 7), 1.0, 0.0)


def test_languages_are_told_apart():
    for language in ("en", "de", "fr", "es", "nl"):
        parts = structure.parsed(PROSE[language])
        names, found, _, _ = structure.SEEDS.nearest(parts)
        assert names == ["prose"] * len(parts) and {structure.LANGUAGES[i] for i in found} == {language}


def test_profiles_are_learned_by_language():
    rare = "Gestern, heute, morgen, immer, wieder, anders als Malena, ganz wie bei Tordal, so sagte Venara, und dann."
    sums = structure.prose_sums([rare] * 40 + [PROSE["en"]] * 29 + [None, "", LISTS[0], "too short."])
    learned = structure.SEEDS.learned(sums)
    more = [len(a) - len(b) for a, b in zip(learned.prose, structure.SEEDS.prose)]
    assert dict(zip(structure.LANGUAGES, more)) == {x: int(x == "de") for x in structure.LANGUAGES}
    assert learned.prose[structure.LANGUAGES.index("de")][-1].sum() == pytest.approx(1)
    assert structure.forms_of([rare, LISTS[0]], learned)[0]["prose"] == len(rare) + 1


def test_learning_reads_a_bounded_sample(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(structure, "SAMPLE_FILES", 2)
    for i in range(5):
        rows = [(100 * i + k, PROSE["en" if k % 2 else "de"] * 3, "x") for k in range(100)]
        spark.createDataFrame(rows, "doc_id bigint, text string, form string").coalesce(1).write.parquet(str(tmp_path / f"part={i}"))
    df = spark.read.parquet(str(tmp_path))
    learned = structure.learn_profiles(df)
    more = {x: len(a) - len(b) for x, a, b in zip(structure.LANGUAGES, learned.prose, structure.SEEDS.prose)}
    assert more["en"] >= 1 and more["de"] >= 1 and more["fr"] == 0
    assert {r.form for r in structure.text_forms(df).collect()} == {"prose"}


RARE = "Gestern, heute, morgen, immer, wieder, anders als Malena, ganz wie bei Tordal, so sagte Venara, und dann."
NEAR_RARE = "immer, anders, heute, Tordal, so sagte, sagte abends, sagte heute, immer, immer."


def test_every_document_is_learned_from(spark):
    """40 of 3,000 documents make a profile, and it decides on one more."""
    texts = [PROSE["en"]] * 2959 + [RARE] * 40 + [NEAR_RARE]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert form(NEAR_RARE) == "list"
    assert {r.form for r in structure.text_forms(df).collect()} == {"prose"}
    whole = [structure.learn_profiles(df.repartition(n)) for n in (1, 7)]
    want = structure.SEEDS.learned(structure.prose_sums(texts))
    assert all((a == b).all() for x in whole for a, b in zip(x.prose, want.prose)) and len(want.prose[1]) == len(structure.SEEDS.prose[1]) + 1


def test_means_of_misjudged_segments_are_not_learned():
    sums = {(i, k): (structure.SEEDS.others[k] * structure.UNIT, 10**9) for i in range(len(structure.LANGUAGES)) for k in range(5)}
    assert all((a == b).all() for a, b in zip(structure.SEEDS.learned(sums).prose, structure.SEEDS.prose))


def test_one_pass_gives_what_two_give(spark):
    mixed = ["Сестра the молоко, of хлеб, and соль, to мука, in сахар, a it", "  ", None, PROSE["en"] + "\n" + LISTS[0] + "\n" + TABLES[0], "!" * 40, NEAR_RARE]
    texts = [RARE] * 40 + mixed + LISTS + TABLES + JUNK + FOREIGN_PROSE + FOREIGN_LISTS + [x * 3 for x in PROSE.values()]
    learned = structure.SEEDS.learned(structure.prose_sums(texts))
    sizes = structure.forms_of(texts, learned)
    assert sizes != structure.forms_of(texts) and [+x for x in structure.settle(structure.survey(texts, {}), learned)] == sizes
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    given, found = (sorted(structure.text_forms(df, x).collect()) for x in (learned, None))
    assert given == found == [(i, 1 - x["prose"] / sum(x.values()) if sum(x.values()) else 0.0, document_form(x)) for i, x in enumerate(sizes)]


def test_frame(spark):
    df = spark.createDataFrame([(1, PROSE["en"], "x"), (2, LISTS[0], "x"), (2, LISTS[0], "x"), (3, None, "x"), (4, "", "x"), (None, TABLES[0], "x"), (5, PROSE["de"] * 5000, "x")], "doc_id bigint, text string, form string")
    out = text_statistics(df).collect()
    assert [(r.doc_id, r.form) for r in out] == [(1, "prose"), (2, "list"), (2, "list"), (3, "prose"), (4, "prose"), (None, "table"), (5, "prose")]
    assert out[0].words == 25 and out[3].words == 0 and out[1].non_prose == 1.0
    assert text_statistics(df.limit(0)).count() == 0


FOREIGN_PROSE = [
    "Книга понравилась сестре, подруге, соседке и даже бабушке, хотя конец показался слишком грустным.",
    "Я читал её в поезде, дома, на работе, и каждый раз находил что-то новое.",
    "Сестра посоветовала эту книгу, я купил, прочитал, не пожалел, и теперь советую всем друзьям.",
    "Хорошая книга\nно конец мне не понравился\nсестра тоже так считает\nбольше читать не буду",
    "Το βιβλίο μου άρεσε πολύ, αλλά το τέλος ήταν λυπηρό, αργό, και κάπως παράξενο.",
    "قرأت الكتاب في القطار، وأعجبني كثيرا، لكن النهاية كانت حزينة، وسأقرأه مرة أخرى.",
    "मुझे यह किताब बहुत पसंद आई, लेकिन अंत दुखद था, फिर भी मैं इसे पढ़ने की सलाह देता हूँ।",
]
FOREIGN_LISTS = [
    "молоко, яйца, хлеб, мука, сахар, соль", "Молоко, Яйца, Хлеб, Мука, Сахар.", "обложка, середина книги, тихий колокол, сюжет, бумага, поэзия",
    "белая бумага, мягкая обложка, скучный сюжет, хороший конец", "χαρτί, πλοκή, εξώφυλλο, ποίηση, τέλος",
    "Поэзия\nСюжет\nТихий колокол\nБиография\nОбложка\nРоман", "- поэзия\n- сюжет\n- обложка книги\n- бумага", "1. Поэзия\n2. Сюжет\n3. Обложка",
]


@pytest.mark.parametrize("want, texts", [("prose", FOREIGN_PROSE), ("list", FOREIGN_LISTS)])
def test_scripts_without_known_function_words(want, texts):
    assert [form(t) for t in texts] == [want] * len(texts)
