import random
import re

import pytest

from gablework.llm import split


def brute(text, limit, overlap):
    words, i = [], 0
    while i < len(text):
        while i < len(text) and text[i].isspace():
            i += 1
        j = i
        while j < len(text) and not text[j].isspace():
            j += 1
        if j > i:
            words.append((i, j))
        i = j
    out, end = [], 0
    while words and end < len(words):
        top = min((end - overlap if end else 0) + limit, len(words))
        cut = top
        if top < len(words):
            natural = [k for k in range(end + 1, top + 1) if "\n" in text[words[k - 1][1] : words[k][0]] or re.search(r"[.!?…][\"')\]}»”’]?$", text[words[k - 1][0] : words[k - 1][1]])]
            cut = natural[-1] if natural else top
        out.append((words[max(0, end - overlap) if end else 0][0], words[cut - 1][1]))
        end = cut
    return out


@pytest.mark.parametrize("seed", range(6))
def test_against_a_walk(seed):
    r = random.Random(seed)
    texts = ["".join(r.choice(["a", "bb", "c.", "d!", " ", " ", " ", "\n", "\n\n", "ñ"]) + r.choice([" ", ""]) for _ in range(r.randint(0, 400))) for _ in range(20)]
    p = split.pieces(texts, 9, 3, "document", False)
    got = {}
    for d, s, e in zip(p["doc"], p["start"], p["end"]):
        got.setdefault(int(d), []).append((int(s), int(e)))
    for i, t in enumerate(texts):
        assert got.get(i, []) == [x for x in brute(t, 9, 3)]
    assert not len(p["n_words"]) or p["n_words"].max() <= 9


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(5000))
    rows = [(1, None, "website", None, "x"), (2, "", "website", None, "x"), (3, "  \n", "website", None, "x"), (4, long, "website", None, "x"), (4, long, "website", None, "x"), (5, "short text", None, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string, segments_json string, start_char string")
    out = split.split_oversized(df, limit=350, overlap=60).collect()
    four = [r for r in out if r.doc_id == 4 and r.piece_no == 1]
    assert len(four) == 2 and {r.doc_id for r in out} == {4, 5}
    assert all(r.n_words <= 350 for r in out)
    one = sorted((r for r in out if r.doc_id == 4), key=lambda r: r.piece_no)[0::2]
    for a, b in zip(one, one[1:]):
        assert long[b.start_char : a.end_char].split() == long[: a.end_char].split()[-60:]
    assert split.oversized_paragraphs(df).collect()[0].para_no == 0
    assert split.split_oversized(df.limit(0)).count() == 0


def test_start_time(spark):
    segs = '[{"start": "1.5", "end": "2", "text": "hello there"}, {"start": 9, "duration": 1, "text": "again you"}, {"start": 4, "text": null}]'
    df = spark.createDataFrame([(1, "hello there again you", "podcast", segs), (2, "(0:03) one two\n(0:07) three four", "youtube", "not json")], "doc_id long, text string, kind string, segments_json string")
    got = {(r.doc_id, r.piece_no): r.start_time for r in split.split_oversized(df, limit=2, overlap=0).collect()}
    assert got[(1, 0)] == 1.5 and got[(1, 1)] == 9.0
    assert got[(2, 0)] == 3.0 and max(v for k, v in got.items() if k[0] == 2) == 7.0


def test_passages_have_words_of_their_own(spark):
    # the only sentence ends are a word after a cut; a passage must not repeat sixty words for one
    words = ["w"] * 1400
    for k in (290, 291, 700, 702):
        words[k] = "end."
    df = spark.createDataFrame([(1, " ".join(words), "website", None)], "doc_id long, text string, kind string, segments_json string")
    got = split.split_oversized(df).orderBy("piece_no").collect()
    ends = [len(" ".join(words)[: p.end_char].split()) for p in got]
    assert all(b - a >= 30 for a, b in zip(ends, ends[1:-1])) and all(p.n_words <= 350 for p in got) and ends[-1] == 1400
