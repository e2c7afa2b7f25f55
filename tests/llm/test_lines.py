from gablework.llm import lines


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string, published_at string, line_no string")


def test_against_brute_force(spark):
    rows = [(i, "a" if i % 3 else "b", f"Menu!\n{'Unique' * (i % 4)} line {i}\n  MENU \r\n\n12 · 34\nShare {i} times", f"2024-01-{i + 1:02d}", "x") for i in range(12)]
    rows += [(20, None, "Menu", None, "x"), (21, "a", None, None, "x"), (22, "a", "", "", "x")]
    got = {(r.doc_id, r.line_no) for r in lines.find_repeated_lines(docs(spark, rows)).collect()}
    key = lambda s: "".join(c for c in s.lower() if c.isalpha())
    want = set()
    for source in ("a", "b"):
        mine = [r for r in rows if r[1] == source]
        n = {}
        for r in mine:
            for k in {key(x) for x in (r[2] or "").split("\n")} - {""}:
                n[k] = n.get(k, 0) + 1
        want |= {(r[0], i) for r in mine for i, x in enumerate((r[2] or "").split("\n")) if key(x) and n[key(x)] >= max(3, 0.2 * len(mine))}
    assert got == want and got


def test_copies_of_an_article_stay_whole(spark):
    rows = [(i, "a", "The same long article text\nFooter", "2024-01-01", "x") for i in range(4)] + [(10 + i, "a", f"Other words number {'abcdefgh'[i]}\nFooter", f"2024-02-0{i + 1}", "x") for i in range(6)]
    out = {r.doc_id: r.clean_text for r in lines.strip_repeated_lines(docs(spark, rows)).collect()}
    assert out[0] == "The same long article text" and out[12] == "Other words number c"
    assert lines.find_repeated_lines(docs(spark, rows).limit(0)).count() == 0


def test_republished_with_changes_stays_whole(spark):
    # one article in four versions of one day, among documents of other days
    body = "The owner asked for the lease"
    rows = [(i, "a", f"{body}\nVersion {'abcd'[i]}\nFooter", "2024-01-01", "x") for i in range(4)] + [(10 + i, "a", f"Words of {'efghijkl'[i]}\nFooter", f"2024-02-0{i + 1}", "x") for i in range(8)]
    out = {r.doc_id: r.clean_text for r in lines.strip_repeated_lines(docs(spark, rows)).collect()}
    assert out[0].startswith(body) and "Footer" not in out[0] and out[11] == "Words of f"
    found = {(r.doc_id, r.line_no) for r in lines.find_repeated_lines(docs(spark, rows)).collect()}
    assert (0, 0) in found  # a case by its share, but not taken out
    # without dates every text counts as one
    undated = [(i, s, t, None, x) for i, s, t, _, x in rows]
    assert {r.clean_text for r in lines.strip_repeated_lines(docs(spark, undated)).collect() if r.doc_id == 0} == {"Version a"}
