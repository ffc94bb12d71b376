import random
import zlib

from orrery.llm.language_id import grams, language_id, train

PARTS = {"xx": ["tha", "ing", "oul", "ent"], "yy": ["ción", "que", "ñar", "est"], "zz": ["sch", "ung", "äch", "ein"]}


def text(r, lang, n):
    return " ".join("".join(r.choice(PARTS[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def test_held_out_accuracy(docs):
    r = random.Random(8)
    rows = [(i, text(r, lang := r.choice(list(PARTS)), r.randint(2, 60)), lang, "s") for i in range(500)]
    odd = [(900, None, "xx"), (901, "", "yy"), (902, "123 !!", "zz"), (None, text(r, "yy", 9), "yy"), (903, text(r, "zz", 20_000), None), (0, rows[0][1], rows[0][2])]
    got = language_id(docs(rows + odd)).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {row[0]: row[2] for row in rows}
    test = [x for x in got if x.held_out and x.doc_id in truth]
    assert test and sum(x.lang_pred == truth[x.doc_id] for x in test) / len(test) > 0.97
    by = {x.doc_id: x for x in got}
    assert [by[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and by[903].lang_pred == "zz" and by[None].lang_pred == "yy"
    for x in got:
        assert 0 <= x.score <= 1 and x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 4 == 2)


def test_nothing_to_learn_from(docs):
    assert [x.lang_pred for x in language_id(docs([(1, "abc", None), (2, "def", None)])).collect()] == ["und", "und"]
    assert language_id(docs([]).filter("false")).collect() == []


def test_filter_returns_every_language_of_a_gram():
    m = train([("a", "abcd"), ("b", "bcde")])
    from orrery.llm.language_id import slots

    codes = grams("bcd")
    masks = None
    for at in slots(codes):
        masks = m.table[at] if masks is None else masks & m.table[at]
    assert 3 in masks.tolist()  # "bcd" stands in both


def many(r, n):
    """Texts of n made-up languages, each of its own letters."""
    return [(f"l{k:03}", " ".join("".join(chr(0x4E00 + 30 * k + r.randrange(30)) for _ in range(4)) for _ in range(300))) for k in range(n)]


def test_more_languages_than_bits_of_a_word():
    r = random.Random(3)
    for n in (1, 16, 17, 64, 65, 130):
        m = train(many(r, n) * 2)
        assert len(m.languages) == n
        rows = many(random.Random(4), n)
        model = train(rows)
        assert [model.score(t)[0] for _, t in rows] == [lang for lang, _ in rows]


def test_every_language_is_learnt(docs):
    rows = many(random.Random(5), 20)
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2][:60]
    got = language_id(docs([(i, rows[k % 20][1], rows[k % 20][0]) for k, i in enumerate(ids)])).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {i: rows[k % 20][0] for k, i in enumerate(ids)}


def plain_score(kept, text):
    """Prediction from sets of n-grams, in place of the filter."""
    t = "".join(c if c.isalpha() else " " for c in text.lower())
    t = " " + " ".join(t.split()) + " "
    own = [t[i : i + 3] for i in range(len(t) - 2)]
    if not any(c.isalpha() for c in text):
        return "und", 0.0
    share = sorted(((sum(g in kept[lang] for g in own) / len(own), -k, lang) for k, lang in enumerate(sorted(kept))), reverse=True)
    top, other = share[0][0], share[1][0]
    return share[0][2], top * top / (top * top + other * other) if top else 0.0


def test_against_sets_of_ngrams(docs):
    """The whole operator without a filter: n-grams of 2 % of a language's training texts, whole texts, sets."""
    r = random.Random(21)
    rows = [(i, text(r, lang := r.choice(list(PARTS)), r.choice([1, 5, 40, 3000])) + " x1y, Z!", lang) for i in range(150)]
    learnt = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 4 != 2]
    kept = {}
    for lang in PARTS:
        of = [x for x in learnt if x[2] == lang]
        seen = {}
        for _, t, _ in of:
            t = " " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " "
            for g in {t[i : i + 3] for i in range(len(t) - 2)}:
                seen[g] = seen.get(g, 0) + 1
        kept[lang] = {g for g, n in seen.items() if n >= max(1, 0.02 * len(of))}
    got = {x.doc_id: x for x in language_id(docs(rows)).collect()}
    for i, t, _ in rows:
        lang, score = plain_score(kept, t)
        assert got[i].lang_pred == lang and abs(got[i].score - score) < 0.01


def test_whole_texts_and_repeated_rows_train(docs):
    """What tells two languages apart stands after 5,000 characters; rows of no id and a repeated row don't push it out."""
    same = "lorem ipsum " * 500
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2][:40]
    rows = [(i, same + ("tha ing " if k % 2 else "sch ung ") * 60, "xx" if k % 2 else "zz") for k, i in enumerate(ids)]
    rows += [(None, "lorem ipsum", "xx")] * 300 + [(900, same + "tha ing " * 60, None), (901, same + "sch ung " * 60, None)]
    by = {x.doc_id: x.lang_pred for x in language_id(docs(rows)).collect()}
    assert by[900] == "xx" and by[901] == "zz"
