import random

from gablework.llm import pages, residue
from gablework.session import cut

PARA = "The owner should look at the {w} in the spring because the snow has gone by then and the weather is dry enough for a climb that nobody will regret. {n} times of ten it holds."
WORDS = "roof door window cellar garden gutter fence boiler porch stair lock lamp wall floor chimney shed gate sink drain hatch".split()


def host(seed, pages_=40):
    """Pages of one host with the line numbers of their articles: navigation, byline, teasers in the middle, share line, comments, notices, legal lines."""
    r, out = random.Random(seed), []
    for i in range(pages_):
        w = WORDS[i % len(WORDS)]
        title = f"How to mend a {w} before the winter of {r.choice(WORDS)} and {r.choice(WORDS)}"
        para = lambda: PARA.format(w=r.choice(WORDS), n=i) + f" Ask the {r.choice(WORDS)} and the {r.choice(WORDS)} people at the {r.choice(WORDS)} about it."  # noqa: B023, E731
        lines = [("Home", 0), ("Guides", 0), (f"Home > Roofs > {title}", 0), (title, 1), (f"By Ann Bell | May 3, 20{i % 20:02d}", 0), (para(), 1)]
        if i % 3 == 0:
            lines += [("You may also like", 0)] + [(f"Why a {r.choice(WORDS)} needs the {r.choice(WORDS)} of a {r.choice(WORDS)}", 0) for _ in range(3)]
        lines += [(para(), 1), (f"What a {w} costs at the {r.choice(WORDS)} market in the spring", 1), ("- Long nail, $40", 1), (f"Short {r.choice(WORDS)} {r.choice(WORDS)}", 1), (para(), 1)]
        lines += [(f"Share this page ({i} shares)", 0)]
        if i % 2:
            lines += [(f"{i} comments", 0), (f"Tom says: I had the {r.choice(WORDS)} and the {r.choice(WORDS)} done by a man that the neighbours know.", 0)]
        lines += [("We and our partners place cookies so that the forms remember you.", 0), ("Nothing on Roof Notes is legal advice and you should ask a lawyer.", 0), ("© 2020 Roof Notes", 0), ("Back to top", 0)]
        out.append((title, "\n".join(x for x, _ in lines), {k for k, (_, y) in enumerate(lines) if y}))
    return out


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, kind string, source string, title string, text string, role string")


def accuracy(lines, want, column="article"):
    got = {}
    for x in lines.collect():
        got.setdefault(x.doc_id, {})[x.line_no] = x[column]
    each = [got[i][n] == (n in keep) for i, (_, text, keep) in enumerate(want) for n in range(len(text.split("\n")))]
    return sum(each) / len(each)


def test_article_lines(spark):
    made = host(1)
    rows = [(i, "website", "roof-notes.example", title, text, "x") for i, (title, text, _) in enumerate(made)]
    rows += [(90, "website", None, None, None, "x"), (91, "website", "s", None, "", "x"), (92, "podcast", "s", None, "Home", "x")]
    df = docs(spark, rows)
    out = pages.label_lines(df)
    assert accuracy(out, made) >= 0.98
    assert out.filter("doc_id >= 90").count() == 0
    assert pages.label_lines(df.limit(0)).count() == 0
    # the votes decide: without them templates stay, and containers with them
    alone = pages.label_lines(df, least=10**6)
    assert accuracy(alone, made) < 0.9


def test_copies_vote_once(spark):
    # an article stored three times in a small host keeps its heading; a template of five different pages is still furniture
    article = "Why the gutter leaks\n{para}\nWhat a gutter costs in the spring\n{para}\nAsk your neighbour first."
    words = ("roof", "door", "window", "cellar", "garden")
    rows = [(i, "website", "h.example", "Why the gutter leaks", article.format(para=PARA.format(n=3, w="gutter")), "x") for i in range(3)]
    rows += [(10 + i, "website", "h.example", f"The {w}", f"The {w}\n{PARA.format(n=3, w=w)} It is the {w}.\nCall the owners before you come over.", "x") for i, w in enumerate(words)]
    out = pages.label_lines(docs(spark, rows))
    kept = {(r.doc_id, r.line_no) for r in out.filter("article").collect()}
    assert {n for d, n in kept if d == 0} >= {0, 1, 2, 3}
    assert {n for d, n in kept if d == 10} == {0, 1}


def test_an_article_of_many_hosts_stays(spark):
    # one article in twelve hosts is one page: its sentences are not shared by pages; a notice of twelve pages is
    article = f"Why it leaks\n{PARA.format(n=3, w='gutter')}\nAsk your neighbour first, then ask the owner of it."
    rows = [(i, "website", f"h{i}.example", "Why it leaks", article, "x") for i in range(12)]
    rows += [(20 + i, "website", f"h{i}.example", f"The {w}", f"The {w}\n{PARA.format(n=3, w=w)} It is the {w}.\nPlease turn on the scripts of your browser now.", "x") for i, w in enumerate(WORDS[:12])]
    kept = {(r.doc_id, r.line_no) for r in pages.label_lines(docs(spark, rows)).filter("article").collect()}
    assert {n for d, n in kept if d == 3} == {0, 1, 2} and {n for d, n in kept if d == 23} == {0, 1}


def test_residue(spark):
    para = PARA.format(n=3, w="roof")
    rows = [
        (1, "website", "a", "T one", f"Home\nT one\n{para}\nThe fee is {{{{amount_due}}}} for now."), (2, "website", "a", "T two", f"T two\n{para}\nWhere the form says {{{{tenant_name}}}}, write it out."),
        (3, "website", "a", "T three", "Error 502: the server gave up on this request"), (4, "website", "b", "T four", "Error 7781: the server gave up on this request"), (14, "website", "b", "T fourteen", "Error 1: the server gave up on this request"),
        (5, "website", "a", "T five", f"{para}\nEnable JavaScript and cookies to continue"), (6, "podcast", "b", "T six", "Transcript unavailable"), (15, "website", "c", "T fifteen", "Access denied\nAsk the desk downstairs"), (16, "website", "c", "T sixteen", "Ask the desk downstairs"),
        (7, "podcast", "b", "T seven", "[music] so the roof is what we will talk about today and then the door"), (8, "website", "a", None, None), (9, "website", "a", "Lorem", "Lorem ipsum dolor\nnull null null"),
        (10, "website", "a", "T ten", "T ten\nThe owner should look at the roof."), (3, "website", "a", "T three", "Error 502: the server gave up on this request"),
    ]
    df = docs(spark, [(*r, "x") for r in rows])
    got = {r.doc_id: r.how for r in residue.residue_documents(df, pages.label_lines(df, website_only=False)).collect()}
    # three titles stand over one message; a line that stands beside a seed is known from there
    assert got == {1: "field", 3: "spread", 4: "spread", 14: "spread", 6: "seed", 15: "seed", 16: "component", 9: "seed"}
    empty = df.limit(0)
    assert residue.residue_documents(empty, pages.label_lines(empty)).count() == 0


def test_no_similar_pair_is_lost(spark):
    # texts of 45 to 80 words with up to two words replaced, many of them near the wanted similarity
    r = random.Random(5)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 9))) for _ in range(400)]
    units = []
    for _ in range(60):
        base = r.choices(words, k=r.randint(45, 80))
        for _ in range(12):
            other = list(base)
            for at in r.sample(range(len(base)), r.choice((0, 1, 1, 2))):
                other[at] = r.choice(words)
            units.append(" ".join(other))
    units = sorted({*units, "a b", "a b c d e", "a b c d e f"})
    hashed = cut(residue.hashed_units(spark.createDataFrame([(u,) for u in units], "unit string")))
    name = {x.unit_id: x.unit for x in hashed.select("unit_id", "unit").collect()}
    got = [tuple(sorted((name[p.a], name[p.b]))) for p in residue.near_pairs(hashed).collect()]
    want = {(a, b) for i, a in enumerate(units) for b in units[i + 1 :] if residue.similar(a, b)}
    assert len(want) > 300 and set(got) == want and len(got) == len(want)


def test_keys_in_blocks(spark):
    r = random.Random(8)
    rows = [(i, r.choice((1, 1, 2, 3))) for i in range(90)]
    got = [(p.a, p.b) for p in residue.met_in_keys(spark.createDataFrame(rows, "unit_id long, key long"), most=7).collect()]
    want = {(i, j) for i, k in rows for j, m in rows if k == m and i < j}
    assert set(got) == want and len(got) == len(want)


def test_tables_meet_near_hashes():
    a = residue.simhash("the server gave up on this request")
    for bits in ((1, 17, 60), (0, 31, 32), (5, 6, 7)):
        b = a
        for k in bits:
            b ^= 1 << k
        assert set(residue.table_keys(a)) & set(residue.table_keys(b))
    assert len(set(residue.table_keys(a))) == 20
