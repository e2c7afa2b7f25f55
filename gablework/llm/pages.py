"""Problem 6: the article of each web page without the page's furniture, by consensus of the pages of a host.

The pages are text, so what tags and classes would tell is read off the lines: a line's form (title, trail, paragraph, item, sentence, phrase,
short), its template (its letters without names, numbers and the site's name), and how it begins. Three votes are held in each host, and
every page is extracted anew with what has won:

1. templates: one that comes back on a share of the host's pages is furniture, as is a sentence that many hosts share. The former also cut
   the page into containers;
2. containers: one is scored by its share of the page's prose; the path of a container is the template that it follows. The host's pages
   vote on the path by their mean score, and paths that lose are no part of an article (comments, teasers, what stands under a newsletter box);
3. lines: with what is left the place of every line is clear (before the article, under the title, in the body, after it), and form
   and place score it. The path of a line is form, place and beginning; the host's mean score of the path decides. A path on fewer than
   `least` pages has no vote, and the page alone decides.

There are no lists of phrases, only of words that sentences are built with. Copies of a page, the same letters in the same lines, have one vote
in their host together; nothing is shuffled but hashes. Null and blank texts have no lines. A null source counts as one host.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, join_sized

#: A template on so many of a thousand pages of a host, and on `LEAST_PAGES` at least, is furniture; a container path loses below the share of prose.
SHARE_PERMILLE, LEAST_PAGES, LEAST_PROSE = 20, 3, 0.2
#: A sentence in so many hosts, and on so many pages of them, is furniture too. A list of lines before prose loses below LEAST_HEADING.
HOSTS, HOST_PAGES, LEAST_HEADING = 5, 10, 0.35
#: Hosts whose templates may be broadcast: each has at most lines-per-page * 1000 / SHARE_PERMILLE of them, about 5 kB.
BROADCAST_HOSTS = 2000

#: Words that sentences and titles are built with, English and Spanish.
FUNCTION_WORDS = frozenset(
    """a about after all although an and any are as at be because been before but by can could did do does during each every even first for from had has have he her his how
    if in into is it its just like may more most must my near no not of off on once one or other our out over per she should so some soon than that the their them then there
    they this to too twice until up us was we were what when which while who why will with within without would yet you your
    al ante antes así aunque cada como con cuando de del desde después donde e el ella en entre era es esta este fue ha hasta la las le les lo los más me mi muy ni no nos o para
    pero por porque que qué quien se según si sin sobre son su sus también tan te tiene toda todo tras tu un una unas uno unos y ya""".split()
)
_BULLET = re.compile(r"^(?:[-–—•*·▪◦‣]|\(?\d{1,2}[).]|[a-z]\))\s+\S")
_PRICE = re.compile(r",?\s*[$€]\s?\d[\d,.]*\s*$")
_WORD = re.compile(r"[^\W\d_][\w'’-]*")
_CLOSERS = "\"'”’)]"
_LETTERS = re.compile(r"[\W\d_]+")
_SEPARATED = re.compile(r"[>»›/|:·→]")
_YEAR = re.compile(r"\b(?:19|20)\d\d\b")

FORMS = ("common", "title", "trail", "para", "item", "sentence", "phrase", "short", "shared")
COMMON, TITLE, TRAIL, PARA, ITEM, SENTENCE, PHRASE, SHORT, SHARED = range(len(FORMS))
#: Where a line stands: before the article, between title and text, in the text, after it; or in a container that has lost.
PLACES = ("head", "top", "body", "tail", "out")
HEAD, TOP, BODY, TAIL, OUT = range(len(PLACES))


def letters(line: str) -> str:
    return _LETTERS.sub("", line.lower())


def is_ended(line: str) -> bool:
    """Whether a line ends as a sentence does, closing marks aside."""
    return line.rstrip(_CLOSERS)[-1:] in (".", "!", "?", "…")


def is_item(line: str) -> bool:
    """Whether a line has a bullet in front or a price at its end."""
    return _BULLET.match(line) is not None or ("$" in line or "€" in line) and _PRICE.search(line) is not None


def path_hash(path: str) -> int:
    return xxhash.xxh64_intdigest(path) - (1 << 63)


def site_names(source: str | None) -> set[str]:
    """Letters of the site's name, as it stands in its lines."""
    name = letters(re.sub(r"^www\.|\.[a-z]+$", "", (source or "").lower()))
    return {name} if len(name) > 3 else set()


def template(raw: str, sites: set[str]) -> str:
    """A line's letters without the names in it (capitalised words after the first) and the site's; sentences, phrases like titles and lines of capitals keep their names."""
    if not raw.isupper() and not is_ended(raw) and (len(words := _WORD.findall(raw.lower())) < 6 or sum(w in FUNCTION_WORDS for w in words) < 2):
        first, _, rest = raw.lstrip("-–—•*·#«‹← ").partition(" ")
        raw = first + " " + " ".join(w for w in rest.split() if not w.lstrip("(\"'“¿¡")[:1].isupper())
    key = letters(raw)
    for s in sites:
        key = key.replace(s, "*")
    return key


def template_hash(raw: str, sites: set[str]) -> int:
    """0 for lines that cannot be templates: items, and lines without letters or of 200 characters or more; odd for sentences."""
    if len(raw) >= 200 or is_item(raw):
        return 0
    key = template(raw, sites)
    return path_hash(key) & -2 | is_ended(raw) if key else 0


def lead(raw: str, form: int) -> str:
    """How a line begins and ends: its first two tokens without names and numbers, whether it has a year, its last mark."""
    tokens = raw.split(None, 4)
    if form == PARA:  # only a label before a colon tells paragraphs apart
        at = next((i for i, t in enumerate(tokens[:4]) if t.endswith(":")), -1)
        return "X:" if at == 0 else " ".join("X" if t[:1].isupper() else t.lower() for t in tokens[: at + 1])
    out = []
    for i, t in enumerate(tokens[:2]):
        out.append("9" if any(c.isdigit() for c in t) else "X" if i and t[:1].isupper() else t.lower())
    year = _YEAR.search(raw) is not None
    mark = raw[-1]
    return f"{' '.join(out)}|{year}|{'|' in raw or '·' in raw}|{'' if mark.isalnum() else mark}"


def unit_text(raw: str) -> str:
    """A line without what differs between copies of a message: numbers, hexadecimal codes, marks."""
    low = re.sub(r"\b(?=\w*\d)[\da-fx]{2,}\b|\d+", " ", raw.lower())
    return " ".join(re.findall(r"[^\W\d_]+", low))


def page_hash(text: str) -> int:
    """A hash of the letters of a page in order, equal for its copies."""
    return path_hash(letters(text))


def _pages_of(docs: DataFrame) -> DataFrame:
    return docs.filter("text is not null and kind = 'website'")


def common_templates(docs: DataFrame, *, share_permille: int = SHARE_PERMILLE, least: int = LEAST_PAGES) -> DataFrame:
    """(host, common, shared: arrays of template hashes): of a host's furniture, and of its sentences that many hosts have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, pages, paths = [], [], []
            for source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sites = site_names(source)
                lines = [" ".join(x.split()) for x in text.split("\n")]
                keys = {template_hash(x, sites) for x in lines if x} - {0}
                hosts.append(source or "")
                pages.append(page_hash(text))
                paths.append(list(keys))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(pages, pa.int64()), pa.array(paths, pa.list_(pa.int64()))], names=["host", "page", "paths"])

    read = _pages_of(docs).select("source", "text").mapInArrow(run, "host string, page long, paths array<long>")
    # copies of a page have equal letters, so any one's templates stand for all (site names are of the host); 8 bytes a line travel
    once = cut(read.groupBy("host", "page").agg(F.first("paths").alias("paths")))
    tally = cut(once.select("host", F.explode("paths").alias("path")).groupBy("host", "path").agg(F.count("*").alias("n")))
    sizes = cut(once.groupBy("host").agg(F.count("*").alias("pages")))
    often = join_sized(tally.filter(F.col("n") >= least), sizes, ["host"], salt=F.hash("path")).filter(F.col("n") * 1000 >= F.col("pages") * share_permille).select("host", "path")
    # a sentence that many hosts share is furniture in each of them, however rare it is there; a page stored in many hosts is one page
    many = cut(tally.filter("path % 2 <> 0").groupBy("path").agg(F.count("*").alias("hosts"), F.sum("n").alias("n")).filter((F.col("hosts") >= HOSTS) & (F.col("n") >= HOST_PAGES)).select("path"))
    stands = once.select("page", F.explode("paths").alias("path")).filter("path % 2 <> 0")
    distinct = join_sized(stands, many, ["path"], salt=F.col("page")).distinct().groupBy("path").agg(F.count("*").alias("pages"))
    shared = cut(distinct.filter(F.col("pages") >= HOST_PAGES).select("path"))
    both = often.withColumn("own", F.lit(True)).union(join_sized(tally.select("path", "host"), shared, ["path"], salt=F.hash("host")).select("host", "path", F.lit(False)))
    each = both.groupBy("host", "path").agg(F.max("own").alias("own"))
    return cut(each.groupBy("host").agg(F.collect_list(F.when(F.col("own"), F.col("path"))).alias("common"), F.collect_list(F.when(~F.col("own"), F.col("path"))).alias("shared")))


class Line:
    __slots__ = ("no", "raw", "words", "fun", "form", "key", "inside")

    def __init__(self, no: int, raw: str):
        self.no, self.raw = no, raw
        self.words = _WORD.findall(raw.lower())
        self.fun = sum(w in FUNCTION_WORDS for w in self.words)
        self.key, self.form, self.inside = 0, SHORT, 0


def read_page(text: str, title: str | None, sites: set[str], common: set[int], shared: set[int]) -> list[Line]:
    """The non-blank lines of a page with their forms, and the template that the container of each follows."""
    want, seen, inside, prose = letters(title or ""), False, 0, 0
    lines = [Line(i, " ".join(x.split())) for i, x in enumerate(text.split("\n")) if x.strip()]
    for x in lines:
        ended = is_ended(x.raw)
        # only lines not much longer than the title can be it, or a trail that ends with it
        plain = letters(x.raw) if want and len(x.raw) < len(title) + 120 else ""
        x.key = template_hash(x.raw, sites)
        if want and plain == want and not seen and plain not in sites:
            x.form, seen = TITLE, True
        elif want and len(want) > 12 and plain.endswith(want) and _SEPARATED.search(x.raw):
            x.form = TRAIL
        elif x.key in common:
            x.form, inside, prose = COMMON, x.key & -2, 0
        elif x.key in shared:
            x.form = SHARED
        elif (len(x.words) >= 25 or len(x.words) >= 8 and ended) and x.fun * 6 >= len(x.words):
            x.form = PARA
        elif is_item(x.raw):
            x.form = ITEM
        elif ended and len(x.words) >= 4:
            x.form = SENTENCE
        elif (len(x.words) >= 6 and x.fun >= 2 or len(x.words) >= 25) and not _YEAR.search(x.raw):
            x.form = PHRASE
        # a container has two parts: what stands before its first prose, and the rest
        prose = prose or x.form in (TITLE, PARA, ITEM, SENTENCE)
        x.inside = inside | prose if inside else 0
    return lines


_READ = "doc_id long, host string, page long, bare boolean, no array<int>, form binary, inside array<long>, lead array<long>, n_words array<int>, unit array<string>"


def _host(rows: DataFrame, per_host: DataFrame) -> DataFrame:
    """rows with the columns of a host's decisions; these are broadcast while hosts are few, else joined by salted host."""
    return join_sized(rows, per_host, ["host"], "left", salt=F.xxhash64("doc_id"), max_rows=BROADCAST_HOSTS)


def read_pages(docs: DataFrame, common: DataFrame, *, website_only: bool = True) -> DataFrame:
    """One row a page: its lines' numbers, forms, containers, beginnings and words; units (normalised lines) for bare pages, those without a
    paragraph of ordinary prose. Recordings (problem 10 looks at them) come only if they are bare."""
    cols = ["doc_id", F.coalesce("source", F.lit("")).alias("host"), "title", "text", (F.col("kind") == "website").alias("site")]
    pages = _pages_of(docs) if website_only else docs.filter("text is not null and kind is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[set[int], set[int]]] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                out: tuple[list, ...] = tuple([] for _ in range(10))
                hosts, common, shared = b.column(0).to_pylist(), b.column(5), b.column(6)
                for r, (host, i, title, text, site) in enumerate(zip(hosts, *(b.column(k).to_pylist() for k in range(1, 5)), strict=True)):
                    if not site:  # all of a recording's words count together
                        words = _WORD.findall(text.lower())
                        if len(words) >= 25 and sum(w in FUNCTION_WORDS for w in words) * 6 >= len(words):
                            continue
                    if host not in known:
                        known[host] = set(common[r].as_py() or ()), set(shared[r].as_py() or ())
                    lines = read_page(text, title, site_names(host), *(known[host] if site else (set(), set())))
                    bare = not site or not any(x.form == PARA and x.fun * 6 >= len(x.words) >= 25 for x in lines)
                    row = (
                        i, host, page_hash(text), bare, [x.no for x in lines], bytes(x.form for x in lines), [x.inside for x in lines],
                        [path_hash(f"{x.form} {lead(x.raw, x.form)}") for x in lines], [len(x.words) for x in lines], [unit_text(x.raw) for x in lines] if bare else [],
                    )
                    for col, v in zip(out, row, strict=True):
                        col.append(v)
                longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.bool_(), ints, pa.binary(), longs, longs, ints, pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "host", "page", "bare", "no", "form", "inside", "lead", "n_words", "unit"])

    return _host(pages.select(*cols), common).select("host", "doc_id", "title", "text", "site", "common", "shared").mapInArrow(run, _READ)


def container_scores(form: np.ndarray, inside: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(path, score) of a page's containers: the share of the page's prose, or, of lines before prose, whether they are a heading of it."""
    prose = np.where((form == PARA) | (form == ITEM), n_words, 0.0)
    where, place = np.unique(inside, return_inverse=True)
    score = np.bincount(place, prose, len(where)) / max(1.0, prose.sum())
    live = (form != COMMON) & (form != SHARED)
    count = np.bincount(place, live, len(where))
    have = set(where[count > 0].tolist())
    first = (where & 1 == 0) & (where != 0)
    score = np.where(first, [0.7 if n == 1 and int(w) | 1 in have else 0.0 for w, n in zip(where, count, strict=True)], score)
    keep = (count > 0) & (where != 0)
    return where[keep], score[keep]


def container_votes(read: DataFrame, *, least: int = LEAST_PAGES, least_prose: float = LEAST_PROSE, least_heading: float = LEAST_HEADING) -> DataFrame:
    """(host, lost: array of container paths) of the paths that lose by their mean score over the host's pages with prose."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, pages, paths, scores = [], [], [], []
            for host, page, form, inside, n in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                f = np.frombuffer(form, np.uint8)
                if ((f == PARA) | (f == ITEM)).any():
                    where, score = container_scores(f, np.array(inside, np.int64), np.array(n, np.float64))
                    hosts += [host] * len(where)
                    pages += [page] * len(where)
                    paths += where.tolist()
                    scores += score.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(pages, pa.int64()), pa.array(paths, pa.int64()), pa.array(scores, pa.float64())], names=["host", "page", "path", "score"])

    each = read.select("host", "page", "form", "inside", "n_words").mapInArrow(run, "host string, page long, path long, score double")
    votes = each.groupBy("host", "path", "page").agg(F.max("score").alias("score"))
    tally = votes.groupBy("host", "path").agg(F.count("*").alias("n"), F.avg("score").alias("mean"))
    least_score = F.when(F.col("path") % 2 == 0, least_heading).otherwise(least_prose)
    return cut(tally.filter((F.col("n") >= least) & (F.col("mean") < least_score)).groupBy("host").agg(F.collect_list("path").alias("lost")))


def lost_lines(form: np.ndarray, inside: np.ndarray, n_words: np.ndarray, lost: set[int]) -> np.ndarray:
    """Which lines stand in a container that has lost. One with the title or half of the page's prose stays, whatever the host says,
    and so does the first of a page without prose."""
    out, prose = np.zeros(len(form), bool), np.where((form == PARA) | (form == ITEM), n_words, 0)
    live = np.flatnonzero((form != COMMON) & (form != SHARED))
    first = int(inside[live[0]]) if len(live) and not prose.sum() else 0
    for x in set(inside.tolist()) & lost - {first}:
        here = inside == x
        if not (form[here] == TITLE).any() and prose[here].sum() * 2 < max(1, prose.sum()):
            out |= here
    return out


def place_lines(form: np.ndarray, lost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(form, place, score) of a page's lines, given which stand in a container that has lost."""
    n = len(form)
    form, live = form.copy(), (form != COMMON) & (form != SHARED) & ~lost
    places, scores = np.full(n, OUT, np.int8), np.full(n, 0.05)
    at = np.flatnonzero(live)
    f = form[at]
    # a short line next to an item is an item, and so on along the run
    for order in (range(1, len(f)), range(len(f) - 2, -1, -1)):
        step = -1 if order.step == 1 else 1
        for i in order:
            if f[i] == SHORT and f[i + step] == ITEM and abs(int(at[i]) - int(at[i + step])) == 1:
                f[i] = ITEM
    form[at] = f
    text = np.flatnonzero((f == PARA) | (f == ITEM) | (f == SENTENCE))
    titles = np.flatnonzero(f == TITLE)
    solid = np.flatnonzero((f == PARA) | (f == ITEM))
    begin = titles[0] if len(titles) else text[0] if len(text) else len(f)
    body = next((int(i) for i in text if i > begin), len(f)) if len(titles) else begin
    end = int(solid[-1]) if len(solid) else begin
    for i in range(len(f)):
        k = f[i]
        p = HEAD if i < begin else TAIL if i > max(end, begin) else TOP if len(titles) and begin < i < body else BODY
        if k == TITLE:
            s = 0.95
        elif k == TRAIL:
            s = 0.05
        elif k == PARA:
            s = 0.9 if p != HEAD else 0.3
        elif k == ITEM:
            s = 0.85 if p in (TOP, BODY) else 0.3
        elif k == SENTENCE:
            s = 0.7 if p in (TOP, BODY) else 0.2
        else:
            after = f[i + 1] if i + 1 < len(f) else SHORT
            over = after in (PARA, ITEM, SENTENCE) or after == PHRASE and p == BODY
            s = (0.7 if k == PHRASE else 0.45) if p == BODY and over else 0.65 if k == PHRASE and p == TOP and after in (PARA, ITEM) else 0.1
        places[at[i]], scores[at[i]] = p, s
    return form, places, scores


_LINES = "doc_id long, host string, page long, bare boolean, line_no int, path long, role string, place string, score double, unit string"


def place_pages(read: DataFrame, lost: DataFrame) -> DataFrame:
    """One row a line of the pages, with its path (form, place and beginning) and its score on its page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                row, no, path, role, place, score, unit = [], [], [], [], [], [], []
                cols = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("no", "form", "inside", "lead", "n_words", "unit", "lost"))
                for r, (nos, form, inside, leads, n_words, units, gone) in enumerate(zip(*cols, strict=True)):
                    f = np.frombuffer(form, np.uint8)
                    lost = lost_lines(f, np.array(inside, np.int64), np.array(n_words, np.int64), set(gone)) if gone else np.zeros(len(f), bool)
                    f, p, s = place_lines(f, lost)
                    row += [r] * len(nos)
                    no += nos
                    path += [(x >> 3) * 5 + int(q) for x, q in zip(leads, p, strict=True)]
                    role += [FORMS[x] for x in f]
                    place += [PLACES[x] for x in p]
                    score += s.tolist()
                    unit += units or [None] * len(nos)
                take = pa.array(row, pa.int64())
                cols = [part.column(part.schema.get_field_index(c)).take(take) for c in ("doc_id", "host", "page", "bare")]
                cols += [pa.array(no, pa.int32()), pa.array(path, pa.int64()), pa.array(role, pa.string()), pa.array(place, pa.string()), pa.array(score, pa.float64()), pa.array(unit, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "host", "page", "bare", "line_no", "path", "role", "place", "score", "unit"])

    return _host(read, lost).mapInArrow(run, _LINES)


def winning_paths(lines: DataFrame, *, least: int = LEAST_PAGES) -> DataFrame:
    """(host, path, belongs) for the line paths on enough pages of a host, by the mean score of its pages."""
    votes = lines.filter("role not in ('common', 'shared', 'title', 'trail')").groupBy("host", "path", "page").agg(F.max("score").alias("score"))
    # sums are combined on the map side, so a host with a third of all pages is no task of its own
    tally = votes.groupBy("host", "path").agg(F.count("*").alias("n"), F.avg("score").alias("mean"))
    return tally.filter(F.col("n") >= least).select("host", "path", (F.col("mean") > 0.5).alias("belongs"))


def label_lines(docs: DataFrame, *, website_only: bool = True, share_permille: int = SHARE_PERMILLE, least: int = LEAST_PAGES) -> DataFrame:
    """(doc_id, host, page, bare, line_no, path, role, place, score, unit, alone, article) of the lines of pages, materialised.

    article: whether the line belongs to the article, after all votes; alone: the same without the vote on line paths.
    """
    common = common_templates(docs, share_permille=share_permille, least=least)
    read = cut(read_pages(docs, common, website_only=website_only))
    lines = cut(place_pages(read, container_votes(read, least=least)))
    # only paths on which a vote is against some page's own score need a join
    joined = join_sized(lines, cut(winning_paths(lines, least=least)), ["host", "path"], "left", salt=F.col("doc_id"))
    return cut(joined.withColumn("alone", F.col("score") > 0.5).withColumn("article", F.coalesce("belongs", "alone")).drop("belongs"))
