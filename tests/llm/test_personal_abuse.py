import pytest

from scansio.llm import abuse
from scansio.llm import names as nm
from scansio.llm import personal as pi
from scansio.llm import surrogates as sg

TEXTS = [
    ("write to noor3179@studio-rw.example, thanks", [("email", "noor3179@studio-rw.example")]),
    ("marco3857 at studio-rw dot example", [("email", "marco3857 at studio-rw dot example")]),
    ("x＠minbar.test a(at)b.test greta [at] mail [dot] example [dot] net", [("email", "x＠minbar.test"), ("email", "a(at)b.test"), ("email", "greta [at] mail [dot] example [dot] net")]),
    ("tel +33 6 39 98 60 32 or (415)5550178, 415.555.0142 ext 54", [("phone", "+33 6 39 98 60 32"), ("phone", "(415)5550178"), ("phone", "415.555.0142 ext 54")]),
    ("٠٧٧٠٠٩٠٠١٣٠ after maghrib", [("phone", "٠٧٧٠٠٩٠٠١٣٠")]),
    ("SSN 920-18-5486, my ID is ٢٢٧٥٥٣٩٢٧٢. passport no. X77479761", [("id_number", "920-18-5486"), ("id_number", "٢٢٧٥٥٣٩٢٧٢"), ("id_number", "X77479761")]),
    ("Order no. 02944712, Timestamp 1735130880051, Session 486-31-7 froze at 00:131:45. build 2025689842", []),
    ("at Flat 23, 85 Zafrine Rd, Callowfield Z7 5BC! Adresse: Sablestraße 225, 11032 Ostrand", [("address", "Flat 23, 85 Zafrine Rd, Callowfield Z7 5BC"), ("address", "Sablestraße 225, 11032 Ostrand")]),
    ("(16 zafrine street apt 33) شارع غلستاد رقم 48", [("address", "16 zafrine street apt 33"), ("address", "شارع غلستاد رقم 48")]),
    ("I was at the mosque on Adidubun Street day, very noisy @ 85 dB.", []),
    ("My name is not shown in settings. Please check Adidubun, the name is misspelt.", []),
    ("my name is tariq ghelvale; Signed, Tarqhoury, Tavrin. I. Pontenko here again", [("name", "tariq ghelvale"), ("name", "Tarqhoury, Tavrin"), ("name", "I. Pontenko")]),
    ("the student (Noor T. Ghelvale) was alone. اسمي بلال غلستاد", [("name", "Noor T. Ghelvale"), ("name", "بلال غلستاد")]),
    ("", []),
    (None, []),
]


@pytest.mark.parametrize(("text", "items"), TEXTS)
def test_found(text, items):
    assert [(k, text[a:b]) for k, a, b in pi.find(text)] == items


# Each form of each pattern alone in a text.
FORMS = {
    "phone": ["+49 170 1234567", "+1 (206) 555-0159", "0049 30 23125976", "07700900651", "07911 123456", "030 23125976", "06.39.98.60.32", "(415) 555-0178", "415.555.0142 ext 54", "1-415-555-0142"],
    "id_number": ["920-18-5486", "35202-1234567-1", "QQ 92 35 49 A", "QQ831291A", "12345678Z", "X14956125", "AB1234567C", "Z99769930"],
    "email": ["a.b+c@d-e.test", "x＠minbar.test", "a(at)b.test", "g [at] mail [dot] example [dot] net", "m at studio dot example"],
    "address": ["16 zafrine street apt 33", "89 rue Lavrenelle, 65616 Ostrand", "Calle Zafrine 63, 8º A, Harrowmere", "Sablestraße 225, 11032 Ostrand", "PO Box 7", "شارع غلستاد رقم 48", "Postfach 12"],
}


@pytest.mark.parametrize("kind", FORMS)
def test_every_form_is_found_alone_and_so_is_its_surrogate(kind):
    by = sg.Surrogates(b"k")
    for item in FORMS[kind]:
        for text in (f"please note {item}, thanks", item):
            at = text.index(item)
            assert pi.find(text) == [(kind, at, at + len(item))], text
        made = by.of(kind, item)
        assert made != item and [(k, made[a:b]) for k, a, b in pi.find(made)] == [(kind, made)], (item, made)
        assert [c for c in made if not c.isalnum()] == [c for c in item if not c.isalnum()]
        assert made == sg.Surrogates(b"k").of(kind, item) != sg.Surrogates(b"other").of(kind, item)


def test_cued_numbers():
    for text, items in (("my ID is QQ 92 35 49 A.", [("id_number", "QQ 92 35 49 A")]), ("SSN QQ831291A.", [("id_number", "QQ831291A")]), ("tel 612 345 678", [("phone", "612 345 678")]), ("I counted 612 345 678", [])):
        assert [(k, text[a:b]) for k, a, b in pi.find(text)] == items


def test_formats_are_kept():
    by = sg.Surrogates(b"k")
    for i in range(300):
        assert by.phone(f"0{7000000000 + i * 7919}")[0] == "0" and pi.find(by.phone(f"0{7000000000 + i * 7919}"))[0][0] == "phone"
        assert by.phone(f"+33 6 39 98 {i:04d}").startswith("+33 ") and by.phone(f"0033 6 39 98 {i:04d}").startswith("0033 ")
        dni = f"{i * 33331:08d}" + sg.DNI_LETTERS[i * 33331 % 23]
        made = by.id_number(dni)
        assert made[-1] == dni[-1] == sg.DNI_LETTERS[int(made[:-1]) % 23] and made != dni
    assert by.id_number("QQ 92 35 49 A").endswith(" A") and by.id_number("35202-1234567-1").endswith("-1")
    assert sg.plain("phone", by.phone("0049 30 231259")) == sg.plain("phone", by.phone("+49 30-231259"))


def test_small_formats_dont_run_out():
    by = sg.Surrogates(b"k")
    for items in ([("address", f"P.O. Box {i}") for i in range(10)], [("email", f"{c}@b.test") for c in "abcdefghijklmnopqrstuvwxyz"], [("id_number", f"SSN {i:03d}-10-1000"[4:]) for i in range(1000)]):
        pairs = [(k, x, by.of(k, x)) for k, x in items]
        assert sg.clashes(pairs) == [] and len({m for _, _, m in pairs}) == len(pairs) and all(m != x for _, x, m in pairs)


@pytest.mark.parametrize("n", [2, 3, 10, 105, 1000])
def test_permutations(n):
    p = sg.Permuter(b"k")
    got = [p("x", i, n) for i in range(n)]
    assert sorted(got) == list(range(n)) and all(g != i for i, g in enumerate(got))


def test_coreference():
    by = sg.Surrogates(b"k")
    a, b = by.name("Tarqhoury, Tavrin"), by.name("TAVRIN TARQHOURY")
    assert sg.plain("name", a) == sg.plain("name", b) and b.isupper()
    given, family = by.name("Maria Lopez").split()
    assert by.email("maria.lopez@mail.example").startswith(f"{given}.{family}@".lower()) and by.email("maria.lopez@mail.example").endswith(".example")
    assert by.name("Salma X. Yarrow").split()[0] in pi.sg.GIVEN["f"].split() and by.name("I. Pontenko")[1:3] == ". "
    assert by.name("بلال غلستاد").split()[0] in pi.sg.GIVEN_ARABIC["m"].split()
    with pytest.raises(ValueError):
        sg.Surrogates(b"")


# Names and words around them that the code doesn't name.
HELD_OUT = [
    ("I spoke with Priyanka Raman about it", "Priyanka Raman"), ("Please call Kwabena Mensah tomorrow", "Kwabena Mensah"), ("Grüße, Heinrich Müller", "Heinrich Müller"), ("Signed: Oksana Petrova", "Oksana Petrova"),
    ("Contact: Ravindra Kumar", "Ravindra Kumar"), ("Ich bin Jürgen Schäfer", "Jürgen Schäfer"), ("we met Ngozi Adeyemi-Cole yesterday", "Ngozi Adeyemi-Cole"), ("a letter to Siobhan O'Brien came back", "Siobhan O'Brien"),
    ("my name is tendai moyo and it froze", "tendai moyo"), ("the clip was read by T. Okonkwo", "T. Okonkwo"), ("forwarded to Lars M. Eriksson", "Lars M. Eriksson"), ("Mr. Dimitrios Papadakis complained", "Dimitrios Papadakis"),
    ("me llamo Guadalupe Herrera", "Guadalupe Herrera"), ("je m'appelle Aurélie Dubois", "Aurélie Dubois"), ("اسمي عبدالرحمن الخطيب", "عبدالرحمن الخطيب"), ("Chiamaka Obi wrote this", "Chiamaka Obi"),
    ("Regards, Bogdan Ionescu", "Bogdan Ionescu"), ("my name is Yamamoto, Haruka.", "Yamamoto, Haruka"), ("tablet of FEDERICO ROSSI-BIANCHI, user: Federico Rossi-Bianchi", "Federico Rossi-Bianchi"), ("Saludos, Itziar Etxeberria", "Itziar Etxeberria"),
]
NO_NAMES = ["The Quran app is great", "Die Seite lädt nicht", "New York is far", "Mozilla/5.0 (Windows NT 10.0; Win64; x64) Safari/537.36", "near Adidubun Street again", "my name is not shown", "Surah Al Fatiha was wrong", "this is really annoying", "Wrong verse again"]


def test_names_the_code_doesnt_know():
    found = sum(name in [t[a:b] for k, a, b in pi.find(t) if k == "name"] for t, name in HELD_OUT)
    assert found >= 0.9 * len(HELD_OUT), [t for t, name in HELD_OUT if name not in [t[a:b] for k, a, b in pi.find(t)]]
    assert [(t, pi.find(t)) for t in NO_NAMES if pi.find(t)] == []


def test_contexts_are_learnt():
    people = [("Zorvane", "Qualdin"), ("Ymira", "Toskel"), ("Bruvan", "Haldek"), ("Zorvane", "Mirtok"), ("Ymira", "Velsun"), ("Karvel", "Dostrin")]
    texts = [f"My name is {g} {f}." for g, f in people] + [f"the lamp of Mr. {g} {f} flickers badly" for g, f in people] + [f"page {i} was blank here" for i in range(400)]
    model = nm.learnt(texts)
    unseen = "the ring was lost; ulvin gartok flickers badly"
    assert pi.find(unseen) == [] and [unseen[a:b] for _, a, b in pi.find(unseen, model)] == ["ulvin gartok"]
    assert "zorvane" in model.given and pi.find("ZORVANE PLUTEK left", model) and not pi.find("ZORVANE PLUTEK left")
    assert nm.learnt([]) == nm.NameModel()


def test_names_are_learnt_from_all_texts(spark):
    """More texts than were ever looked at, and long ones: a sample of them knows fewer contexts."""
    people = [("Zorvane", "Qualdin"), ("Ymira", "Toskel"), ("Bruvan", "Haldek"), ("Zorvane", "Mirtok"), ("Ymira", "Velsun")]
    texts = [f"the lamp of Mr. {g} {f} flickers badly. " + "all was still " * 200 for g, f in people] + [f"page {i} was blank here" for i in range(20_500)]
    rows = [(t, None if i % 3 else t) for i, t in enumerate([*texts, "", None])]
    model = pi.fit(spark.createDataFrame(rows, "t string, u string"), "t", "u")
    assert model == nm.learnt(texts) and "zorvane" in model.given and ("after", "", "flickers", "badly") in model.contexts
    assert pi.fit(spark.createDataFrame([], "t string"), "t") == nm.NameModel()


def test_redaction(spark):
    rows = [(1, "mail a@b.test or A@B.test", None), (1, "mail a@b.test or A@B.test", None), (2, "", "call 415-555-0173"), (3, None, "a@b.test"), (None, "a@b.test", None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "report_id long, notes string, user_agent string, kind string")
    got = {(r.report_id, r.field): r for r in pi.redacted(df, "report_id", "notes", "user_agent", secret=b"k").collect()}
    assert len(got) == 6 and got[1, "notes"].placeholders == "mail [EMAIL] or [EMAIL]" and got[3, "notes"].placeholders is None
    lower = got[1, "notes"].surrogates[5:].split(" or ")
    assert lower[0].lower() == lower[1].lower() == got[3, "user_agent"].surrogates and lower[0] != "a@b.test"
    assert got[2, "notes"].surrogates == "" and got[2, "user_agent"].placeholders == "call [PHONE]"
    assert pi.entities(df.limit(0), "report_id", "notes", secret=b"k").count() == 0
    counts = {r.kind: (r["items"], r.plains, r.surrogates) for r in pi.distinctness(pi.entities(df, "report_id", "notes", "user_agent", secret=b"k")).collect()}
    assert counts == {"email": (3, 1, 1), "phone": (1, 1, 1)}
    with pytest.raises(ValueError):
        pi.entities(df, "report_id", "notes", secret=b"")


ORDINARY = ["Thanks, that helped in a crowded room.", "The learner read slowly through page {}.", "Where is verse {} of the long surah?", "A message saying “you are a fool” was removed.", "Hold the long vowel for two counts."]
ABUSIVE = ["You are a worthless {} and everybody knows it.", "Go away, stupid {}, nobody wants your voice."]
INSULTS = ["toad", "rat", "clown", "pig", "swine", "worm"]


def labelled(n):
    out = []
    for i in range(n):
        text = " ".join(ORDINARY[(i + k) % 5].format(i) for k in range(3))
        out.append((text, False))
        if i % 2:
            out.append((text + "\n" + ABUSIVE[i % 4 // 2].format(INSULTS[i % 6]), True))
    return out


def test_abuse_is_told_from_ordinary_text():
    model = abuse.train(labelled(120))
    held = labelled(160)[180:]
    right = sum((model.score(t) >= model.threshold) == c for t, c in held)
    assert right / len(held) > 0.9
    for text in ("Y0u are a w0rthless t04d and everybody kn0ws it.", "YOU ARE A WORTHLESS TOAD AND EVERYBODY KNOWS IT.", "Yоu аrе а wоrthlеss tоаd and everybody knows it.", "You are a w o r t h l e s s toooaad and everybody knows it."):
        assert model.score(text) >= model.threshold, text
    assert model.score("He wrote: “You are a worthless toad and everybody knows it.”") < model.threshold
    assert model.score(None) == model.score("") == model.score("🙂") == 0


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "hello there", "a"), (2, None, None)], "doc_id long, text string, source string")
    reviews = spark.createDataFrame([(1, "ok"), (1, None), (2, " ABUSE"), (3, "abuse"), (3, "ok")], "doc_id long, verdict string")
    model = abuse.fit(docs, reviews)
    got = abuse.scored(docs, model, "source")
    assert [r.score for r in got.collect()] == [0, 0] and not any(r.flagged for r in got.collect())
    assert {r.source: r.documents for r in abuse.rates(got).collect()} == {"a": 1, None: 1}
    assert {r.doc_id: r.case for r in abuse.verdicts(reviews).collect()} == {1: False, 2: True}
    assert abuse.scored(docs.limit(0), model).count() == 0


def test_windows_leave_nothing_out():
    assert abuse.windows("Idiot!") == ["idiot!"] and abuse.windows("Thanks for this.\nIdiot!") == ["thanks for this. idiot!"]
    assert abuse.windows("b i t  ok\nsome other line") == ["bit ok some other line"] and abuse.windows("🙂 12") == []
    long = "word " * 200
    assert all(len(w) <= abuse.LONG for w in abuse.windows(long)) and len(abuse.windows("x“" + "abc " * 300 + "”")) <= 1


@pytest.mark.parametrize("n", [12, 24, 60])
def test_few_cases_follow_the_same_rule(n):
    model = abuse.train(labelled(n))
    right = sum((model.score(t) >= model.threshold) == c for t, c in labelled(160)[180:])
    assert right / 60 > 0.9


def test_dictionaries_are_bounded():
    texts = [f"line {i} of some text that is {i * 7919 % 1000} characters from the end" for i in range(4000)]
    assert len(abuse.dictionary(texts, 20_000)) <= 20_000 and abuse.dictionary(texts[:3], 20_000) == "\n".join(texts[:3]).encode()
    made = abuse.Measure(abuse.dictionary(texts, 20_000))
    assert made(texts[7]) < abuse.Measure(b"")(texts[7])


def test_words_tell_only_beyond_chance():
    rng = __import__("random").Random(3)
    docs = [([" ".join(f"w{rng.randint(0, 400)}x".translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(6))], i % 7 == 0) for i in range(300)]
    assert abuse.telling([d for d, c in docs if c], [d for d, c in docs if not c]) == set()
