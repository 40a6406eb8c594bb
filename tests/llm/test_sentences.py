"""Problem 9: sentences written by hand in ten languages, and the covering rules on all documents."""

import pytest

from corvane.llm import sentences as S

OPENERS = {"The", "File", "Node", "Nobody", "He", "yunet", "No", "Both"}
CASES = [
    ["The score fell from 0.82 to 0.06, i.e. below the line.", "He agreed."],
    ["It cost 5 p.m. rates, approx. 3 px, cf. Annex B of the log.", "Nobody saw it ... until now."],
    ["The donor moved to the U.S.", "No.", "Both left."],
    ["The U.S. Annex lists it, the U.K. Annex does not.", "He left."],
    ["A. N. Ambrell agreed.", "It was kept in folder B.", "The form was signed by P. Ilvane Jr.", "The end!"],
    ['He replied: "Keep it. It is public."', "The rest follows."],
    ["‘Stop!’ the reader wrote, and left.", "yunet found 3 faces."],
    ['"Fine," said he, "but is it left?"', "yunet found 3 faces."],
    ["(The stub stays boxed.)", "The night run began."],
    ["See Fig. 3 and No. 7 (ca. 8 frames, incl. Annex D) at 10:00.", "File img_1.v2.jpg is at https://a.example/c?view=full now."],
    ["Is it left?!", "Yes..."],
    ["Der 5. Durchlauf vom 9.1.2025 blieb, d. h. z. B. am 11. März, ohne Befund.", "Lt. Protokoll Nr. 5 ist es da.", "„Ist es da? Ich sehe nichts“, schrieb er."],
    ["L’auditeur note : « Rien à couvrir. »", "Faut-il couvrir le badge ?", "Env. 5 lignes, c.-à-d. peu, p. ex. ici."],
    ["¿Por qué?", "¡No exporten nada!", "EE. UU. pide otra hoja, p. ej. la del Sr. Ostrel."],
    ["Проверяются маски, рамки и т. д.", "Акад. Сольвин, ул. Речная, д. 19, ответил, т. е. согласен."],
    ["审核员说：“先别发。还没好！”", "“要不要遮住？我不确定。”标注员写道。", "没有回答……但不同意。", "真的吗？！"],
    ["「顔を隠すべきか。分からない。」と監査役は書いた。", "本当か？！", "答えなかった……"],
    ["डॉ. वेलदारी ने देखा।", "क्या ढकना है?", "06:33 से पहले न भेजें!"],
    ["د. فالدور راجع القضية.", "لماذا خارج الإطار؟", "«هل نغطي؟ لا أعرف»، كتب المعلّم."],
    ["ผู้ติดป้ายพบป้าย 8 จุดในภาพ", "ไฟล์ img_1.jpg ใช้แทน"],
]


@pytest.mark.parametrize("case", CASES, ids=lambda c: c[0][:20])
def test_sentences(case):
    text = ("" if ord(case[0][0]) > 0x2E7F else " ").join(case)
    assert [text[a:b] for a, b in S.Sentences(OPENERS).split(text)] == case


def test_lines_markers_and_blanks():
    text = "Heading\r\n\r\nOne line\nwrapped. Two\n \n- item one\n• item two. More\n1. third\n(a) fourth\n[10:22] He said so\nand more\n\n  \n"
    got = [text[a:b] for a, b in S.Sentences(OPENERS).split(text)]
    assert got == ["Heading", "One line\nwrapped.", "Two", "- item one", "• item two.", "More", "1. third", "(a) fourth", "[10:22] He said so\nand more"]


def test_no_blank_between_and_odd_texts():
    s = S.Sentences(OPENERS)
    text = "It shows this.The form is here."
    assert [text[a:b] for a, b in s.split(text)] == ["It shows this.", "The form is here."]
    for odd in ("", " \n\t", "...", '"', "((((", "a" * 300_000, "a. " * 30_000, '"' * 999, "‘" * 50 + "’" * 50):
        spans = s.split(odd)
        assert "".join(odd[a:b] for a, b in spans).replace(" ", "") == "".join(odd.split())


def threshold(s, text):
    """The rule without spans: cut wherever closing and opening word alone speak for it."""
    x = S.Text(text, 0)
    return [e.at for e in s.ends(x) if e.score + s.opening(x.word(x.rest(e.at))) > 0]


def test_whole_spans_decide_where_words_do_not():
    s = S.Sentences(OPENERS)
    short, long = "Harl Co. The form is here.", "The sheet was signed by the desk of Harl Co. The form is here."
    assert threshold(s, short) == [8] and threshold(s, long) == [44]  # the words alone say the same of both
    assert s.split(short) == [(0, 26)] and s.split(long) == [(0, 44), (45, 62)]
    quoted = "‘Is it left? I see none!’ yunet asked the desk."
    assert len(S.Sentences(OPENERS - {"yunet"}).split(quoted)) == 1 and len(S.Sentences(OPENERS - {"yunet"}).split("He said: " + quoted)) == 2


def test_no_span_is_cut_for_its_length():
    s = S.Sentences(OPENERS)
    for text in ("word . x " * 3000, "see fig. no. 7 of vol. " * 4000):
        assert len(s.split(text)) == 1
    assert len(s.split("He left the room at once. " * 5000)) == 5000


def test_the_best_spans_are_found_at_any_distance(monkeypatch):
    """The carried best start gives what trying every start gives."""
    import random

    rng, s = random.Random(4), S.Sentences(OPENERS)
    words = ["Harl", "Co.", "The", "No.", "etc.", "U.S.", "word", "longer", "1999.", "‘Stop!’", "...", "x", "No"]
    texts = [" ".join(rng.choices(words, k=120)) for _ in range(60)]
    want = []
    for t in texts:
        x = S.Text(t, 0)
        ends = [e for e in s.ends(x) if 0 < e.at < len(t)] + [S.End(len(t), S.SURE)]
        starts = [0] + [x.rest(e.at) for e in ends[:-1]]
        best = [0.0]
        for j, e in enumerate(ends, 1):
            def value(i, e=e):
                whole = e.quote >= 0 and starts[i] == e.quote
                return best[i] + (s.opening(x.word(starts[i])) if i else 0.0) + S.length_score(e.at - starts[i], e.score >= S.SURE) + e.score + (e.opened if whole else e.within)
            best.append(max((value(i) for i in range(j) if starts[i] < e.at), default=float("-inf")))
        want.append(best[-1])
    got = []
    for t in texts:
        x, total = S.Text(t, 0), 0.0
        ends = {e.at: e for e in s.ends(x)} | {len(t): S.End(len(t), S.SURE)}
        for k, (a, b) in enumerate(s.spans(x)):
            e = ends[b]
            whole = e.quote >= 0 and a == e.quote
            total += (s.opening(x.word(a)) if k else 0.0) + S.length_score(b - a, e.score >= S.SURE) + e.score + (e.opened if whole else e.within)
        got.append(total)
    assert got == pytest.approx(want)


def test_unclosed_brackets_and_marks_take_linear_time():
    import time

    s, start = S.Sentences(OPENERS), time.time()
    for text in ("( a " * 30_000, "a." * 60_000, '"a. ' * 20_000, "「あ。" * 20_000, "‘" * 40_000):
        s.split(text)
    assert time.time() - start < 30


def test_null_empty_and_whole_table(spark, data):
    d = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "A b. C d.", 0), (3, "A b. C d.", 0)], "doc_id bigint, text string, start_char int")
    assert sorted(map(tuple, S.split_sentences(d).collect())) == [(3, 0, 0, 4)] * 2 + [(3, 1, 5, 9)] * 2
    assert S.split_sentences(d.limit(0)).count() == 0
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    spans = {}
    for r in S.split_sentences(docs).collect():
        spans.setdefault(r["doc_id"], []).append((r["sentence_no"], r["start_char"], r["end_char"]))
    for k, t in texts.items():
        own = sorted(spans.get(k, []))
        assert "".join("".join(t[a:b].split()) for _, a, b in own) == "".join(t.split())
        assert all(not t[a].isspace() and not t[b - 1].isspace() for _, a, b in own) and all(x[2] <= y[1] for x, y in zip(own, own[1:]))
