import time
from collections import Counter

import pytest

import helixmill.llm.sentences as se
from helixmill.llm.sentences import Evidence, count_words, sentences, split_sentences

LEARNT = """The table is here. It had no label. We met Dr. Osthol by noon. See fig. 3 and fig. 4, approx. 9 ml. Only the north side. It only moved. a tube, e.g. this one.
Nothing else, and nothing more. he said: the box of it. at 9 a.m. sharp, at 4 p.m. today. Die Kiste kam am 3. Mai an. Der Rest ist da. und der Rest. Bring racks. racks here. fig. 7, fig. 8."""


@pytest.fixture(scope="module")
def corpus():
    c = Counter()
    count_words(LEARNT, c)
    out = {}
    for (kind, w), n in c.items():
        out.setdefault(w, [0] * 7)[kind] = n
    return out


# sentences of a paragraph, set apart by ¦
CASES = [
    "Dr. Osthol asked for approx. 11.67 ml of it, i.e. half a tube. ¦Can you resend the table?",
    "Ask for plan B. ¦It is in counts.tar.gz. ¦The box was opened at 9 a.m. ¦Only 79 were left.",
    "We met Dr. Osthol at 4 p.m. Tuesday in St. Orrin Hall. ¦We stop at 6 p.m. ¦Dr. Osthol stays.",
    "The U.S. office and the E.U. desk share it. ¦The lot came from Gal & Co. ¦It had no label.",
    'He said "wait!" twice. ¦"Stop the run. Start it again," said Osthol, and left. ¦Osthol wrote: "Is it done? Then close it." ¦The end.',
    "Osthol said: 'No. Never.' and hung up. ¦The flag is \"--keep.all\" and not \"--keep\". ¦What now?!",
    "He paused… ¦Then it went on. ¦Well... it may work. ¦The signal was gone. ¦mRNA levels fell. ¦Version 2.5 is out! ¦2.9 will follow.",
    "It was sent (by Dr. Osthol, I think!) on the 3rd. ¦(This note is for us.) ¦Tubes: 29. ¦Racks: none.",
    "Die Abb. 73 zeigt u. a. den 4. Versuch. ¦Das war der 1. Lauf. ¦Der 2. Lauf folgt. ¦»Fertig!«, rief Osthol. ¦„Warte kurz. Ich komme gleich“, sagte er.",
    "¡Por fin! ¦«¿Seguro? Entonces cierra», escribió Osthol. ¦—No toques nada. Ya voy —dijo Osthol. ¦¿Vale 23.84 o no?",
    "« C'est fini ? Alors on ferme », a dit Osthol. ¦Quelle chance ! ¦Où est le fichier ?",
    "«Стой. Не трогай», — сказал Osthol. ¦Ну... посмотрим. ¦См. рис. 40 на с. 418. ¦Где копия?",
    "他问:“真的？”我说是。¦真的吗？！¦算了……明天再说。¦《旧表!新表?》这本书丢了。¦参见第76页(共406页。)¦旧表在这里。",
    "Ostholさんは「止めて。もう一度」と言いました。¦第76章（684頁。）を見ます。¦うーん…明日にします。",
    "قال د. Osthol إن القيمة 2.97 فقط. ¦أين النسخة؟ ¦«توقف. لا تلمس شيئا» هكذا كتب Osthol.",
    "“रुको। मत छुओ,” Osthol ने कहा। ¦डॉ. Osthol ने 19.04 मिली माँगा। ¦सूची किसने बदली?",
    "Πού είναι το αντίγραφο; ¦Βλ. σελ. 35 και εικ. 407. ¦«Τέλος. Κλείσε», είπε ο Osthol.",
    "ดัชนีของเราหายไป 67 แถวเมื่อวานนี้ ¦ดัชนีของเรา ¦โปรดดูหน้า 81 อีกครั้ง",
    "ខ្ញុំទៅផ្សារ។ ¦អ្នកមកវិញ។",
    "Ես գնում եմ։ ¦Նա գալիս է։",
    "ང་འགྲོ་གི་ཡིན། ¦ཁྱེད་རང་ཡོང་། ། ¦དེ་རིང་།",
    "እኔ እሄዳለሁ። ¦አንተ ትመጣለህ፧ ¦እሺ።",
    "මම යමි෴ ¦ඔබ එන්න෴",
    "ᠪᠢ ᠶᠠᠪᠤᠨᠠ᠃ ¦ᠴᠢ ᠢᠷᠡᠨᠡ᠃",
    "သူသွားသည်။ ¦ငါလာသည်၊ နင်လာ။",
    "値は３．５です．¦次は４です。",
    "A single\nline break goes on.\n\n¦No mark here\r\n \r\n¦Next one.",
]


@pytest.mark.parametrize("case", CASES)
def test_cases(corpus, case):
    want = [x.strip() for x in case.split("¦")]
    text = case.replace("¦", "")
    assert [text[a:b] for a, b in sentences(text, Evidence(corpus, text))] == want


def test_the_document_is_asked_first(corpus):
    text = "Bring the blk. of it, the blk. here. The blk. Osthol came. Use zed now, zed. Then go."
    got = [text[a:b] for a, b in sentences(text, Evidence({}, text))]
    assert "The blk. Osthol came." in got and got[-1] == "Then go."


@pytest.mark.parametrize("text", ["a" * 300_000, "\n" * 300_000, "(" * 100_000 + ". A" * 30_000, '"' + "Hello there. " * 30_000 + '"', '"Hi. " ' * 30_000, "— a. —b. " * 30_000, "a.b." * 60_000, "! ? " * 60_000])
def test_work_is_linear(text):
    began = time.time()
    count_words(text, Counter())
    sentences(text, Evidence({}, text))
    assert time.time() - began < 20


def test_table(spark):
    docs = spark.createDataFrame([(1, "One. Two.\n\nThree", "x"), (2, None, "x"), (3, "", "x"), (4, " \n ", "x"), (5, "née 漢字。Yes. No", "x")], "doc_id long, text string, sent_from string")
    got = sorted(map(tuple, split_sentences(docs, "doc_id", "text").collect()))
    assert got == [(1, 0, 4), (1, 5, 9), (1, 11, 16), (5, 0, 7), (5, 7, 11), (5, 12, 14)]
    spans = spark.createDataFrame([(1, 1, 5, 9), (1, 1, 5, 9), (5, 1, 7, 99), (2, 1, 0, 5), (9, 1, 0, 5), (1, 2, 4, 4), (1, 3, None, 4)], "doc_id long, span_no long, span_from long, span_to long")
    got = sorted(map(tuple, split_sentences(docs, "doc_id", "text", spans).collect()))
    assert got == [(1, 5, 9), (5, 7, 11), (5, 12, 14)]
    assert split_sentences(docs.limit(0), "doc_id", "text").count() == 0


def test_spans_of_a_document_ask_each_other(spark):
    first, other = "We met the blk. Osthol.", "Ask the blk. of it, the blk. here, the blk. there."
    text = f"{first} From: x {other}"
    at = len(text) - len(other)
    # another document writes the word without a stop, so the corpus does not know it as an abbreviation
    docs = spark.createDataFrame([(1, text), (2, "The blk is a blk and no blk but a blk of it, blk by blk.")], "doc_id long, text string")
    spans = spark.createDataFrame([(1, 0, len(first)), (1, at, len(text)), (1, at + 8, len(text)), (2, 0, 99)], "doc_id long, span_from long, span_to long")
    got = sorted((r.sent_from, r.sent_to) for r in split_sentences(docs, "doc_id", "text", spans).collect() if r.doc_id == 1)
    assert got == [(0, len(first)), (at, len(text)), (at + 8, len(text))]


def test_rare_words_of_the_corpus_decide_too(spark, monkeypatch):
    text = "We met the blk. Osthol."
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, "Ask the blk. of it, the blk. here."), (3, "So it is. Ask me.")], "doc_id long, text string")
    want = [(None, 0, 23), (1, 0, 23), (1, 0, 23), (2, 0, 34), (3, 0, 9), (3, 10, 17)]
    key = lambda r: (r[0] or 0, *r[1:])
    for share in (se.MIN_SHARE, 0.15, 1.0):
        monkeypatch.setattr(se, "MIN_SHARE", share)
        assert sorted(map(tuple, split_sentences(docs, "doc_id", "text").collect()), key=key) == want


@pytest.mark.parametrize("case", CASES)
def test_no_other_words_are_asked_for(corpus, case):
    class Told(dict):
        def get(self, w, default=None):
            told.add(w)
            return corpus.get(w, default)

    for text in (case.replace("¦", ""), LEARNT + " (" + case.replace("¦", "") + ") It’s no. 3."):
        told = set()
        sentences(text, Evidence(Told(), text))
        assert told <= se.asked(text)


def learn(*texts):
    c, out = Counter(), {}
    for t in texts:
        count_words(t, c)
    for (kind, w), n in c.items():
        out.setdefault(w, [0] * 7)[kind] = n
    return out


def test_lists_stand_behind_evidence():
    cut = lambda text, corpus: [text[a:b] for a, b in sentences(text, Evidence(corpus, text))]
    usual = "Это им видно, и им ясно, а им всё равно, им тоже, им, и снова им."
    text = "Мы дали им. Потом ушли."
    # shown as an ordinary word by the corpus, by the document; by neither
    assert cut(text, learn(usual)) == ["Мы дали им.", "Потом ушли."]
    assert cut(f"{usual}\n\n{text}", {})[1:] == ["Мы дали им.", "Потом ушли."]
    assert cut(text, {}) == [text]
    assert cut("The rest is max. 7 of them.", {}) == ["The rest is max. 7 of them."]
    assert len(cut("The rest is app. 7 of them go.", learn("Run the app. It is an app. " * 20))) == 2
    # a document that writes a title with its stop, in a corpus that mostly does not
    assert len(cut("So Mr. Ash met Mr. Oak.", learn("We saw Mr Fir, Mr Elm, Mr Yew and Mr Box."))) == 1


def test_devanagari_stops():
    cut = lambda text, corpus: [text[a:b] for a, b in sentences(text, Evidence(corpus, text))]
    want = ["हे डॉ. जोशी यांचे घर आहे.", "ते पृ. ७ वर आहे.", "आता चला."]
    assert cut(" ".join(want), {}) == want
    assert cut("<p>पृ. 61 देखें।", {}) == ["<p>पृ. 61 देखें।"]
    # counted whole, with its vowel sign, and known as an abbreviation before numbers
    assert cut("किंमत रु. ५०० आहे. बरं.", learn("रु. 7, रु. 8, रु. 9 फक्त.")) == ["किंमत रु. ५०० आहे.", "बरं."]


def test_evidence_without_lists(monkeypatch):
    """Titles, and abbreviations that close a sentence, are told from the corpus alone."""
    for name in ("TITLES", "REFERENCES", "CLOSERS_OF_LISTS"):
        monkeypatch.setattr(se, name, frozenset())
    corpus = learn(*(f"So Zz. Ash{i} met Zz. Oak{i} at dawn. the tube, qqc. The box. the rack, v.p. Tues{i} came" for i in range(30)))
    cut = lambda text: [text[a:b] for a, b in sentences(text, Evidence(corpus, text))]
    assert cut("We met Zz. The Elm. It went.") == ["We met Zz. The Elm.", "It went."]
    assert cut("Bring racks, qqc. Lorem came.") == ["Bring racks, qqc.", "Lorem came."]
    assert cut("At 4 v.p. Zz. Ash stays.") == ["At 4 v.p.", "Zz. Ash stays."]


def test_no_window_before_a_stop():
    word = "x" * 5000
    assert se._word_before(f"so {word}", 5003) == word and se._token_before(f"a{' ' * 200}", 201) == ("a", 0)
