from gablework.llm import pii, pii_labels
from gablework.llm.crf import Crf


def test_held_out():
    find = pii.Finder(pii.trained())
    rows = pii_labels.labelled(800, seed=4242)
    hit = found = true = 0
    for (_, marks), got in zip(rows, find([t for t, _ in rows])):
        a, b = {(s, k) for s, _, k in marks}, {(s, k) for s, _, k in got}
        hit, found, true = hit + len(a & b), found + len(b), true + len(a)
    assert hit / found > 0.97 and hit / true > 0.97


def test_forms():
    find = pii.Finder(pii.trained())
    text = "call Mr. Xavier Tolliver on (312) 555-0147 or +1 872 555 0135, SSN 123-45-6789"
    got = {k: text[a:b] for a, b, k in find([text])[0]}
    assert got["person_name"] == "Xavier Tolliver" and got["id_number"] == "123-45-6789"
    assert find([None, "", "   "]) == [[], [], []]
    assert pii.redact("mail a@b.example now", [(5, 16, "email")]) == "mail [EMAIL] now"


def test_viterbi_is_the_best_path():
    import itertools

    crf = Crf(["a", "b"]).train([["x", "y"], ["y", "x", "x"]] * 20, [["a", "b"], ["b", "a", "a"]] * 20, epochs=2)
    words = ["x", "y", "x"]

    def score(path):
        e = [sum(crf.weights[crf.index[f]][p] for f in fs if f in crf.index) for fs, p in zip(crf._names(words), path)]
        return sum(e) + crf.start[path[0]] + sum(crf.trans[a, b] for a, b in zip(path, path[1:]))

    best = max(itertools.product(range(2), repeat=3), key=score)
    assert tuple(crf.decode([words])[0]) == best


def test_edges(spark):
    q = spark.createDataFrame([(1, "mail me at jo.doe@site.example"), (1, "mail me at jo.doe@site.example"), (2, None), (3, "")], "id long, question string")
    r = spark.createDataFrame([("t1", 1, None)], "thread_id string, turn int, note string")
    e = spark.createDataFrame([("l1", "paid $45 toward the boiler " * 3000, "clash")], "id string, what string, field string")
    t = spark.createDataFrame([("t1", [("user", None), ("user", "my number is 312-555-0147")]), ("t2", None)], "id string, messages array<struct<role string, content string>>")
    texts = pii.free_texts(q, r, e, t)
    got = {(x.field, x.row_key, x.msg_no, x.start_char, x.pii_kind) for x in pii.find_details(texts).collect()}
    assert ("questions_log.question", "1", 0, 11, "email") in got and ("threads.messages", "t1", 1, 13, "phone") in got
    assert len(got) == 2
    assert pii.redact_details(texts).filter("row_key = '1'").first().clean_text == "mail me at [EMAIL]"
    assert pii.find_details(texts.limit(0)).count() == 0
