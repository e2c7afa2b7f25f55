import json

from gablework.llm import turns


def test_boundaries_beat_the_rule():
    import numpy as np

    table = turns.synthetic(60, 777)
    x = np.concatenate([t.features() for t, _ in table])
    y = np.concatenate([np.array(v, bool) for _, v in table])
    rule = np.concatenate([np.array([m[2] == 0 or m[3] >= 0.5 for m in t.marks]) for t, _ in table])
    trees = (turns.trained().predict(x) > 0.5) == y
    assert trees.mean() > 0.985 and trees.mean() > (rule == y).mean() + 0.02
    # adjacent segments without a label are among the places
    assert sum(m[2] == 6 for t, _ in table for m in t.marks) > 80


def test_fillers_held_out():
    import numpy as np

    table = turns.synthetic_fillers(600, 778)
    x = np.concatenate([t.filler_features() for t, _ in table])
    y = np.concatenate([np.array(v, bool) for _, v in table])
    assert ((turns.trained_fillers().predict(x) > 0.5) == y).mean() > 0.93 > max(y.mean(), 1 - y.mean())


def test_told_of_is_no_label(spark):
    segs = [{"start": 1, "text": "Ann Bell: We met at noon."}, {"start": 4, "text": "Then it rained, and I told Cray: bring the lamp."}, {"start": 7, "text": "He did not."}, {"start": 9, "text": "Jo Cray: I did."}]
    df = spark.createDataFrame([(1, "podcast", None, json.dumps(segs), ["Ann Bell", "Jo Cray"])], "doc_id long, kind string, text string, segments_json string, speakers array<string>")
    assert [(r.start_ms, r.speaker) for r in turns.speaker_turns(df).orderBy("turn_no").collect()] == [(1000, "Ann Bell"), (9000, "Jo Cray")]


def test_turns(spark):
    segs = [
        {"start": 9.0, "text": "JO: [music]"}, {"start": 0.5, "text": "(laughs)"}, {"start": 1.0, "text": "Ann Bell: um, well"}, {"start": 3.0, "text": "step two: go on"},
        {"start": 5.0, "text": ">> what now? (BELL)"}, {"start": 7.0, "text": "uh this"}, {"start": 7.0, "text": "uh this"}, {"start": 11, "text": None}, {"start": "12", "text": "JO - the end"}, {"start": 14, "text": "Host: bye"},
    ]
    stamped = "(0:02) Ann: hello\n(0:05) >> yes\n(0:09) [Ann] *door slams*\n(0:11) of course"
    rows = [
        (1, "youtube", "x", json.dumps(segs), ["Ann Bell", "Jo Cray"]), (2, "podcast", stamped, None, ["Ann Bell", "Jo Cray"]), (3, "podcast", None, "[]", ["Ann Bell"]),
        (4, "podcast", "null null", "{bad", None), (5, "website", stamped, None, ["Ann Bell"]), (6, "podcast", stamped, "[]", []),
    ]
    df = spark.createDataFrame(rows, "doc_id long, kind string, text string, segments_json string, speakers array<string>")
    got = [(r.doc_id, r.start_ms, r.speaker) for r in turns.speaker_turns(df).orderBy("doc_id", "turn_no").collect()]
    assert got == [
        (1, 1000, "Ann Bell"), (1, 5000, "Jo Cray"), (1, 7000, "Ann Bell"), (1, 12000, "Jo Cray"), (1, 14000, "Ann Bell"),
        (2, 2000, "Ann Bell"), (2, 5000, "Jo Cray"), (2, 11000, "Ann Bell"),
    ]
    assert turns.speaker_turns(df.limit(0)).count() == 0


def test_clean():
    t = turns.Transcript([(0, "um, so [music] you know, the >> boiler , uh failed (laughs).")], ["Ann Bell"])
    assert turns.clean(t, 0, len(t.text)) == "so the boiler, failed."
    t.drop = {}
    assert turns.clean(t, 0, 6) == "um, so"
