import re

from pyspark.sql import functions as F

from orrery.llm.pii import anonymise, assign, luhn, numbers

TEXT = "Mr John Smith wrote to Mrs. Anna Smith: j.smith@mail.example.com or J.SMITH@MAIL.EXAMPLE.COM, +1 (017) 555-7713, 4111 1111 1111 1111, 4111-1111-1111-1111, 10.0.0.1, 123-45-6789, token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\""


def test_formats_and_coreference(docs):
    (row,) = anonymise(docs([(1, TEXT)]), "k").collect()
    out = row.text
    for secret in ("John", "Anna", "Smith", "smith", "555-7713", "4111", "10.0.0.1", "123-45-6789", "04dbeb"):
        assert secret not in out
    m = re.fullmatch(
        r"Mr (\w+) (\w+) wrote to Mrs\. (\w+) (\w+): ([a-z]\.[a-z]{5}@[a-z]{4}\.[a-z]{7}\.com) or (\S+\.COM), (\+1 \(\d{3}\) \d{3}-\d{4}), ((?:\d{4} ){3}\d{4}), ((?:\d{4}-){3}\d{4}), (\d+\.\d+\.\d+\.\d+), \d{3}-\d{2}-\d{4}, token = \"([0-9a-f]{40})\"", out
    )
    assert m, out
    assert m[2] == m[4] and m[5].upper() == m[6] and m[8].replace(" ", "") == m[9].replace("-", "")
    assert m[1] in "Adam Bruno Carl David Emil Felix Hugo Jonas Lucas Martin Oscar Simon" and m[3] in "Alice Bella Clara Diana Emma Flora Greta Helena Julia Laura Nora Sofia"
    assert all(int(x) < 256 for x in m[10].split("."))
    assert row.n_entities == 10


def test_script_and_key(docs):
    text = "г-н Иван Петров и г-жа Анна Петрова"
    (a,), (b,) = (anonymise(docs([(1, text)]), k).collect() for k in ("k", "l"))
    assert re.fullmatch(r"г-н [А-Я][а-я]+ [А-Я][а-я]+ и г-жа [А-Я][а-я]+ [А-Я][а-я]+", a.text) and a.text != b.text and a.text != text


def test_clean_rows_and_odd_rows(docs):
    clean = "Nothing 12 to 345 see, version 1.2.3, at 10:30 or Mr. nobody."
    rows = [(1, clean), (2, None), (3, ""), (None, "mail a@b.org"), (4, "x " * 30_000 + "a@b.org"), (5, "a@b.org a@b.org"), (5, "a@b.org a@b.org")]
    got = anonymise(docs(rows), "k").collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].text == clean and by[1][0].n_entities == 0
    assert by[2][0].text is None and by[3][0].text == ""
    new = by[None][0].text.split()[1]
    assert new != "a@b.org" and by[4][0].text == "x " * 30_000 + new
    assert [r.text for r in by[5]] == [f"{new} {new}"] * 2
    assert anonymise(docs([]).filter("false"), "k").collect() == []


def test_distinct_surrogates(spark):
    names = [("given_ml", f"Name{i}", 1) for i in range(300)] + [("ip", f"10.0.{i}.{j}", 1) for i in range(20) for j in range(20)]
    got = assign(spark.createDataFrame(names, "kind string, form string, n long"), "k").collect()
    assert len(got) == len(names) == len({(r.kind, r.new) for r in got})
    assert not {(r.kind, r.new) for r in got} & {(k, f) for k, f, _ in names}


def test_check_digit(spark, docs):
    (row,) = anonymise(docs([(1, "4539578763621486 1234567812345678")]), "k").collect()
    sums = spark.createDataFrame([(x,) for x in row.text.split()], "t string").select((luhn(numbers(F.col("t"))) % 10).alias("s")).collect()
    assert sums[0].s == 0


class Plain:
    """The operator in plain Python: a scan of each text, drawing until all are distinct, writing back."""

    def __init__(self, rows, key):
        import regex

        import orrery.llm.pii as p

        self.p, self.key, self.re = p, key.encode(), regex
        self.mentions = [self.scan(t) if t else [] for _, t in rows]
        entities = sorted({u[2:] for m in self.mentions for _, us in m for u in us if u[2] != "keep"})
        titles = {}
        for _, t in rows:
            for m in regex.finditer(p.PATTERNS["name"], t or ""):
                g = "m" if regex.match(f"(?:{p.TITLES_M})[. ]", m[0]) else "f" if regex.match(f"(?:{p.TITLES_F})[. ]", m[0]) else ""
                for w in m[0].split(" ")[1:]:
                    titles.setdefault(self.cap(w), []).append(g)
        self.full = {}
        for kind, form in entities:
            of = titles.get(form, [])
            g = "m" if of.count("m") > of.count("f") else "f" if of.count("f") > of.count("m") else "n"
            self.full[kind, form] = f"given_{g}{kind[-1]}" if kind.startswith("given") else kind
        space = lambda k: "name" if k[0].startswith(("given", "family")) else k[0]
        taken, left, self.new, attempt = {(space(e), e[1]) for e in entities}, entities, {}, 0
        while left:
            drawn = {}
            for e in left:
                drawn.setdefault((space(e), self.draw(self.full[e], e[1], attempt)), []).append(e)
            for (s, new), es in drawn.items():
                if (s, new) not in taken:
                    self.new[min(es, key=lambda e: (self.full[e], e[1]))] = new
            taken |= {(space(e), x) for e, x in self.new.items()}
            left, attempt = [e for e in left if e not in self.new], attempt + 1
        self.texts = [t if not t else self.write(t, m) for (_, t), m in zip(rows, self.mentions, strict=True)]

    def cap(self, w):
        return w[:1].upper() + w[1:].lower()

    def scan(self, text):
        """[(span, [(start, raw, kind, form)])]"""
        p, re, out = self.p, self.re, []
        pattern = p.WORDS_TOO if re.search(p.TITLED, text) else p.UNION
        for m in re.finditer(pattern, text):
            raw = m[0]
            kind = next((k for k, x in p.PATTERNS.items() if k != "name" and re.fullmatch(x.replace(r"\2", r"\1"), raw)), None)
            if kind:
                form = raw.lower() if kind in ("email", "secret") else re.sub("[^0-9]", "", raw) if kind == "card" else re.sub("[^0-9+]", "", raw) if kind == "phone" else raw.replace(" ", "") if kind == "iban" else raw
                out.append((m.span(), [(m.start(), raw, kind, form)]))
            elif re.match(f"(?:{p.TITLES})\\.? ", raw):
                at, us, ws = m.start(), [], raw.split(" ")
                for i, w in enumerate(ws):
                    script = "c" if re.search(r"\p{Cyrillic}", w) else "l"
                    last = i == len(ws) - 1
                    stays = i == 0 or re.fullmatch(r"\p{Lu}\.", w) or (not last and re.fullmatch(f"(?:{p.TITLES_N})\\.?", w))
                    us.append((at, w, "keep" if stays else ("family_" if last else "given_") + script, self.cap(w)))
                    at += len(w) + 1
                out.append((m.span(), us))
            else:
                out.append((m.span(), [(m.start(), raw, "word", self.cap(raw))]))
        named = {}
        for _, us in out:
            for _, _, k, f in us:
                if k.startswith(("given", "family")):
                    named[f] = min(k, named.get(f, k))
        return [(s, [(a, r, named.get(f, "keep") if k == "word" else k, f) for a, r, k, f in us]) for s, us in out]

    def redraw(self, text, key):
        import hashlib

        stream = "".join(hashlib.sha512(f"{key}|{b}".encode()).hexdigest() for b in range(len(text) // 32 + 1))
        hexadecimal = re.fullmatch("[0-9A-Fa-f]{32,}", text)
        out = ""
        for i, c in enumerate(text):
            n = int(stream[4 * i : 4 * i + 4], 16)
            out += chr(48 + n % 10) if c in "0123456789" else chr((97 if c.islower() else 65) + n % (6 if hexadecimal else 26)) if re.match("[A-Za-z]", c) else c
        return out

    def draw(self, kind, form, attempt):
        import hashlib
        import hmac

        p = self.p
        k = hmac.new(self.key, f"{kind}|{form}|{attempt}".encode(), hashlib.sha256).hexdigest()
        extra = max(0, attempt - p.SAME + 1)
        mod = lambda s: int("".join(str(int(c, 36)) for c in s)) % 97
        check = lambda s: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10
        if kind == "card":
            new = self.redraw(form + "0" * extra, k)
            return new[:-1] + str(-check(new[:-1] + "0") % 10) if check(form + "0" * extra) == 0 else new
        if kind == "ip":
            return ".".join(str(int(hashlib.sha256(f"{k}|{i}".encode()).hexdigest()[:2], 16) % 223 + 1) for i in range(4 + extra))
        if kind in ("phone", "key"):
            m = re.match(p.COUNTRY if kind == "phone" else f"^(?:{p.PREFIX})", form)
            kept = m[0] if m else ""
            return kept + self.redraw(form[len(kept) :] + "0" * extra, k)
        if kind == "iban":
            if mod(form[4:] + form[:4]) != 1:
                return form[:2] + self.redraw(form[2:] + "0" * extra, k)
            new = self.redraw(form[4:] + "0" * extra, k)
            return f"{form[:2]}{98 - mod(new + form[:2] + '00'):02}{new}"
        if kind == "email":
            local, domain = form.split("@")
            head, end = domain.rsplit(".", 1)
            return self.redraw(local + "a" * extra + "@" + head, k) + "." + end
        if kind.startswith(("given", "family")):
            d = hashlib.sha256(f"{k}|name".encode()).digest()
            some = lambda s, a, n: "".join(p.SYLLABLES[s][d[(a + i) % 32] % 16] for i in range(n))
            if kind.startswith("family"):
                return self.cap(some(kind[-1], 0, 4 + attempt))
            names = p.GIVEN[kind[-2:]]
            return names[d[31] % len(names)] + (some(kind[-1], 8, 2 + attempt) if attempt else "")
        return self.redraw(form + "0" * extra, k)

    def write(self, text, mentions):
        out, at = "", 0
        for _, us in mentions:
            for a, raw, kind, form in us:
                new = raw
                if kind != "keep":
                    new = self.new[kind, form]
                    if kind in ("card", "phone", "iban"):
                        rest = list(new)
                        new = "".join(rest.pop(0) if re.match("[A-Za-z0-9+]", c) else c for c in raw) + "".join(rest)
                    elif kind.startswith(("email", "secret", "given", "family")) and raw == raw.upper():
                        new = new.upper()
                out, at = out + text[at:a] + new, a + len(raw)
        return out + text[at:]


def test_against_plain_python(docs):
    import random

    r = random.Random(3)
    some = [
        "Mr John Smith", "Smith", "SMITH", "John", "Mrs. Anna Smith", "Dr. Alice Brown", "Prof. Dr. Alice O'Hara-Long", "Dr Brown", "Alice", "Ms J. K. Rolland", "Herr Jonas", "г-жа Анна Петрова", "Петрова", "Brownish",
        "a@b.com", "C@D.COM", "j.smith@mail.example.com", "+1 (017) 555-7713", "+1-017-555-7713", "+10175557713", "(017) 555-7713", "+49 30 1234 5678", "4111 1111 1111 1111", "4111-1111-1111-1111", "371449635398431",
        "DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB82WEST12345698765432", "GB00WEST12345698765432", "10.0.0.1", "123-45-6789", "sk-abcdEFGH1234567890xyz", "ghp_abcdefghijklmnopqrstuvwxyz0123456789",
        "04dbebab91ab85687d33eeaaf9ac699e1188f962", "04DBEBAB91AB85687D33EEAAF9AC699E1188F962", "plain words", "Nothing Here", "1.2.3", "at 10:30", "Mr. nobody", "",
    ]
    rows = [(i, r.choice([" ", "\n"]).join(r.choice(some) + r.choice(["", ",", ".", "'s"]) for _ in range(r.randint(0, 12)))) for i in range(120)]
    rows += [(500, None), (None, "Mr John Smith"), (501, " ".join(some)), (501, " ".join(some))] + [(600 + i, f"{a}@{b}.com") for i, (a, b) in enumerate((x, y) for x in "abcdefghijklmnopqrst" for y in "abcdefghijklmnopqrst")]
    plain = Plain(rows, "k")
    want = sorted((str(i), str(t)) for (i, _), t in zip(rows, plain.texts, strict=True))
    assert sorted((str(x.doc_id), str(x.text)) for x in anonymise(docs(rows), "k").collect()) == want
    assert len(set(plain.new.values())) == len(plain.new)


def test_coreference_and_formats_of_the_same_entity(docs):
    text = "Mr John Smith wrote. Smith said hi, JOHN too. Dr. Alice Brown met Smith's aunt. +1 (017) 555-7713, +1-017-555-7713, +10175557713. DE89 3704 0044 0532 0130 00 or DE89370400440532013000. sk-abcd1234abcd1234abcd"
    (row,) = anonymise(docs([(1, text)]), "k").collect()
    m = re.fullmatch(
        r"Mr (\w+) (\w+) wrote\. (\w+) said hi, (\w+) too\. Dr\. (\w+) (\w+) met (\w+)'s aunt\. \+1 \((\d{3})\) (\d{3})-(\d{4}), \+1-(\d{3})-(\d{3})-(\d{4}), \+1(\d{10})\. (DE\d\d(?: \d{4}){4} \d\d) or (DE\d{20})\. sk-([a-z]{4}\d{4}){2}[a-z]{4}", row.text
    )
    assert m, row.text
    assert m[2] == m[3] == m[7] != "Smith" and m[1].upper() == m[4] and len({m[1], m[2], m[5], m[6]}) == 4
    assert m[8] + m[9] + m[10] == m[11] + m[12] + m[13] == m[14] != "0175557713"
    assert m[15].replace(" ", "") == m[16] and int(m[16][4:] + "1314" + m[16][2:4]) % 97 == 1
    assert row.n_entities == 11


def test_a_kind_that_runs_out(spark):
    mails = [("email", f"{a}@{b}.com", 1) for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    got = assign(spark.createDataFrame(mails, "kind string, form string, n long"), "k").collect()
    assert len({r.new for r in got}) == len(mails) and not {r.new for r in got} & {f for _, f, _ in mails}
    assert all(re.fullmatch(r"[a-z]+@[a-z]\.com", r.new) for r in got)


def test_many_names_of_a_long_text(docs):
    names = ["".join(chr(97 + (i // 26**k) % 26) for k in range(3)).capitalize() + "son" for i in range(3000)]
    text = " and ".join(f"Mr {n}" for n in names) + "; " + " ".join(names)
    (row,) = anonymise(docs([(1, text)]), "k").collect()
    first, again = row.text.split("; ")
    assert first.replace("Mr ", "").split(" and ") == again.split(" ") and len(set(again.split(" "))) == 3000 and not set(names) & set(again.split(" "))
