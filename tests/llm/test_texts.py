"""Leaks, mixing and languages."""

import random

import pytest

from peakloom.llm import languages, leaks, mixing
from peakloom.llm.text import words
from peakloom.session import table

DOCS = "doc_id bigint, text string, lang string, source string, item_id bigint, n_words int, label string, right boolean"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", True) for r in rows], DOCS)


# ---- words
def test_words_in_any_dress():
    plain = words("The fine solution measured 12.5 at 30 volts, the rest moved.")
    assert plain == ["the", "fine", "solution", "measured", "125", "at", "30", "volts", "the", "rest", "moved"]
    for dress in ("THE ﬁne  solution\nmeasured 12.5 at 30 volts the rest moved", "> The <b>fine</b> solu-\n> tion **measured** 12.5 at 30 _volts,_ the rest moved.", "« The fi­ne solu​tion &#109;easured 12.5 at 30 volts — the rest moved »"):
        assert words(dress) == plain
    assert words("a<br>b <sub>c</sub>d <!-- no -->e") == ["a", "b", "cd", "e"] and words("1 < 2 and 3 > 2") == ["1", "2", "and", "3", "2"]
    assert words("GerÃ¤t é é") == ["gerat", "e", "e"]
    assert words(None) == [] and words("") == [] and words(" .. — ") == []


# ---- leaks
BASE = [f"w{i}" for i in range(40)]
STOCK = "the very same stock sentence stands in more than one item and so it counts for nothing at all."


def has_leak(p, d, least=16, per=8):
    """Every stretch of p against every stretch of d by edit distance."""
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i] + [0] * len(b), row
            for j, y in enumerate(b, 1):
                row[j] = min(last[j - 1] + (x != y), last[j] + 1, row[j - 1] + 1)
        return row[-1]

    return any(
        d[k] == p[i] and d[m - 1] == p[j - 1] and edits(p[i:j], d[k:m]) <= (j - i) // per
        for i in range(len(p)) for j in range(i + least, len(p) + 1)
        for k in range(len(d)) for m in range(max(k + 1, k + (j - i) - (j - i) // per), min(len(d), k + (j - i) + (j - i) // per) + 1)
    )


def test_alignment_equals_brute_force():
    rng = random.Random(4)
    passage = BASE[:24]
    hashes = lambda ws: leaks.word_hashes([ws])[0]
    both = {True: 0, False: 0}
    for _ in range(120):
        d = list(passage[rng.randint(0, 6) : rng.randint(17, 24)])
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(d))
            kind = rng.random()
            if kind < 0.4:
                d[at] = "other"
            elif kind < 0.7:
                d.insert(at, "added")
            else:
                del d[at]
        d = ["before"] * 3 + d + ["after"] * 2
        want = has_leak(passage, d)
        assert bool(leaks.Text(hashes(d)).leaked(hashes(passage).tobytes())) == want, d
        both[want] += 1
    assert min(both.values()) > 10


def test_leaks_of_odd_rows(spark):
    own = [" ".join(f"{c}{i}" for i in range(30)) + "." for c in "ab"]
    items = spark.createDataFrame([(1, f"{own[0]} {STOCK}", 5), (2, f"{STOCK} {own[1]}", 5), (3, None, 5), (None, own[0], 5), (4, "", 5)], "item_id bigint, passage string, doc_id bigint")
    half = " ".join(own[0].split()[3:20])
    rows = [(1, own[0].upper(), "", ""), (2, STOCK, "", ""), (3, None, "", ""), (4, "", "", ""), (5, f"{'x ' * 200_000}{half} {own[1]}", "", ""), (6, " ".join(own[0].split()[:15]), "", ""), (1, own[0].upper(), "", ""), (7, " ".join(reversed(own[0].split())), "", "")]
    got = sorted((r.doc_id, r.item_id) for r in leaks.leaks(docs(spark, rows), items).collect())
    assert got == [(1, 1), (1, 1), (5, 1), (5, 2)]
    assert leaks.leaks(docs(spark, []), items).count() == 0 and leaks.leaks(docs(spark, rows), items.limit(0)).count() == 0


def test_sentences_are_counted_over_all_items(spark):
    long = " ".join(f"s{i}" for i in range(30)) + "."
    own = [" ".join(f"{c}{i}" for i in range(30)) + "." for c in "abc"]
    items = [(i, f"{own[i]} {long}") for i in range(2)] + [(2, own[2]), (2, own[2])]
    rows = [(1, long, "", ""), (2, own[0], "", ""), (3, own[2], "", "")]
    for parts in (1, 7):
        df = spark.createDataFrame(items, "item_id bigint, passage string").repartition(parts)
        assert sorted((r.doc_id, r.item_id) for r in leaks.leaks(docs(spark, rows), df).collect()) == [(2, 0), (3, 2)]


def test_a_hot_text_and_a_hot_seed(spark):
    own = [" ".join([f"{c}{i}" for i in range(20)] + ["it", "was", "seen", "again", "today"] + [f"{c}{i}" for i in range(20, 40)]) for c in "abcdefgh"]
    items = spark.createDataFrame(list(enumerate(own)), "item_id bigint, passage string")
    rows = [(i, own[0], "", "") for i in range(200)] + [(1000 + i, f"n{i} it was seen again today m{i}", "", "") for i in range(200)] + [(5000, own[3], "", "")]
    got = {(r.doc_id, r.item_id) for r in leaks.leaks(docs(spark, rows), items).collect()}
    assert got == {(i, 0) for i in range(200)} | {(5000, 3)}


def test_long_markup(spark):
    want = words("before the text after")
    tag = "<div " + " ".join(f'data-{i}="value {i} > 2"' for i in range(60)) + ">"
    assert words(f"before {tag}the text</div> after") == want
    assert words(f"before <!-- {'note < ' * 2000} -->the <b style='{'x:1;' * 90}'>text</b> after") == want
    assert words("a <b and c " + "d " * 150 + "> e")[:3] == ["a", "b", "and"] and words("<!-- open " * 3) == ["open"] * 3
    assert len(words("<a " * 50_000)) == 50_000 and len(words("<!--" * 50_000 + " x")) == 1


# ---- mixing
def test_allocation():
    got = mixing.allocate({"a": 0.5, "b": 0.3, "c": 0.2, "none": 0.4}, {"a": 1e9, "b": 1e9, "c": 10.0, "none": 0.0}, 1000.0)
    assert got["c"] == 10.0 and got["none"] == 0.0 and sum(got.values()) == pytest.approx(1000.0) and got["a"] / got["b"] == pytest.approx(5 / 3)
    assert mixing.allocate({"a": 1.0}, {"a": 5.0}, 100.0) == {"a": 5.0}
    assert mixing.allocate({}, {}, 100.0) == {}


def test_mix_reaches_its_shares(spark):
    rows = [(i, "some words of text " * (1 + i % 7), "en", ["Big ", "mid", " mid_", "TINY", None][0 if i % 10 < 7 else 1 + i % 2 if i % 10 < 9 else 3 if i % 50 == 9 else 4]) for i in range(6000)]
    rows += [(10_000, None, "en", "big"), (10_001, "", "en", "big"), (10_002, "x" * 300_000, "en", "nowhere")]
    targets = spark.createDataFrame([("big", 0.5, 1, 1), ("mid", 0.45, 9, 1), ("tiny", 0.2, 2, 1), ("absent", 0.2, 3, 1), ("zero", float("nan"), 3, 1), (None, 1.0, 1, 1)], "source string, target_weight double, max_repeats int, copies int")
    drawn, shares = mixing.mix(docs(spark, rows), targets, budget=40_000)
    got = {r.source: r for r in shares.collect()}
    assert set(got) == {"big", "mid", "tiny", "absent", "zero"} and got["absent"].tokens == 0 and got["zero"].tokens == 0
    assert got["tiny"].most_copies == 2 and got["big"].most_copies <= 1 and got["mid"].most_copies <= 9
    rest = 40_000 - got["tiny"].tokens
    assert got["big"].tokens == pytest.approx(rest * 0.5 / 0.95, rel=0.05) and got["mid"].tokens == pytest.approx(rest * 0.45 / 0.95, rel=0.05)
    out = drawn.collect()
    assert all(r.copies >= 1 and r.n_tokens > 0 for r in out) and len({r.doc_id for r in out}) == len(out)
    assert sorted(map(tuple, mixing.mix(docs(spark, rows), targets, budget=40_000)[0].collect())) == sorted(map(tuple, out))
    empty, none = mixing.mix(docs(spark, []), targets)
    assert empty.count() == 0 and none.count() == 5
    assert mixing.mix(docs(spark, rows), targets.limit(0))[0].count() == 0


# ---- languages
TEXT = {
    "en": "The column was rinsed with water before the second run, and we found no sign of the old peak.",
    "de": "Die Säule wurde vor dem zweiten Lauf mit Wasser gespült, und wir fanden keine Spur des alten Signals.",
    "fr": "La colonne a été rincée avec de l'eau avant le second essai, et nous n'avons pas trouvé de trace du pic.",
    "es": "La columna se lavó con agua antes de la segunda medida y no hemos encontrado ningún rastro de la señal.",
    "it": "La colonna è stata lavata con acqua prima della seconda misura e non abbiamo trovato alcuna traccia del picco.",
    "pt": "A coluna foi lavada com água antes da segunda medição e não encontramos nenhum vestígio do sinal antigo.",
    "nl": "De kolom werd voor de tweede meting met water gespoeld en wij hebben geen spoor van het oude signaal gevonden.",
    "ru": "Перед вторым измерением колонку промыли водой, и мы не нашли никаких следов старого сигнала.",
    "ja": "二回目の測定の前にカラムを水で洗浄しましたが、古い信号は見つかりませんでした。",
    "zh": "第二次测量之前，我们用水冲洗了色谱柱，没有发现旧信号的任何痕迹。",
}


def test_labels():
    name = languages.label_languages
    assert name("en") == name("EN-us") == name("English") == name("eng") == {"en"}
    assert name("en;nl") == name("English/Dutch") == name("nl+en") == {"en", "nl"}
    assert name("zh-CN") == {"zh"} and name("xx") == name("und") == name("unknown") == name("") == name(None) == name("mul") == frozenset()


@pytest.fixture(scope="module")
def model(spark):
    return languages.train(table(spark, "/root/testdata/sf0.01", "documents"))


def test_sentences_that_training_never_saw(model):
    got = languages.stretches(model, list(TEXT.values()))
    assert [{x for x, _, _ in g} for g in got] == [{x} for x in TEXT]
    shout = languages.stretches(model, [t.upper() for t in TEXT.values()])
    assert [{x for x, _, _ in g} for g in shout] == [{x} for x in TEXT]


def test_held_out_labels(spark, model):
    """Documents of another table whose label names one language: at least nineteen in twenty sentences agree where the label is right."""
    rows = [r for r in table(spark, "/root/testdata/sf0.1", "documents").select("text", "lang").limit(3000).collect() if len(languages.label_languages(r.lang)) == 1]
    got = languages.stretches(model, [r.text for r in rows])
    found = [(languages.label_languages(r.lang), {x for x, _, _ in g}) for r, g in zip(rows, got) if g]
    assert sum(a == b for a, b in found) / len(found) > 0.85  # a tenth of the labels are wrong or incomplete


def test_mixed_and_odd_texts(spark, model):
    rows = [
        (1, TEXT["en"] + " " + TEXT["ja"], "en", ""), (2, TEXT["fr"] + "\n\n" + TEXT["nl"], "fr/nl", ""), (3, TEXT["de"] + " (see the note) “status: idle”", "German", ""),
        (4, None, "en", ""), (5, "", "en", ""), (6, "# 12\n101.5\t0.3\n[M+H]+ C12H4", "en", ""), (7, TEXT["it"] * 3000, "it-IT", ""), (8, TEXT["es"], None, ""), (8, TEXT["es"], None, ""), (9, "(" * 50_000 + "a" * 50_000, "en", ""),
    ]
    got = {}
    for r in languages.document_languages(docs(spark, rows), model).collect():
        got.setdefault(r.doc_id, []).append((r.lang, r.right))
        assert 0 <= r.confidence <= 1
    assert {k: sorted(v) for k, v in got.items() if k != 9} == {1: [("en", False), ("ja", False)], 2: [("fr", True), ("nl", True)], 3: [("de", True)], 7: [("it", True)], 8: [("es", False), ("es", False)]}
    parts = languages.identify(docs(spark, rows), model).where("doc_id = 1").orderBy("part").collect()
    assert [p.lang for p in parts] == ["en", "ja"]
    assert languages.document_languages(docs(spark, []), model).count() == 0
    assert languages.document_languages(docs(spark, [])).count() == 0
