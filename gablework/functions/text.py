"""Text expressions: tokens, terms, normal forms, identities, timestamps, quotes and citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words left out of lexical search.
STOPWORDS = (
    "a an the and or but if of to in on at for with by from as is are was were be been being it its this that these those i you he she we they them my your our their me him her us"
    " do does did have has had not no so what which who whom how when where why can could will would should may might about into than then there here just also very up out over some"
    " any all am s t don't doesn't isn't it's i'm you're we're they're"
).split()
#: Words that carry no signal when rules and questions are matched, English and Spanish.
NOISE = (
    "a an the and or but if of to in on at for is are was were be do does did have has had my me i you your it its that this what which who how when where why can could will"
    " would should may might about into than then there here not no so all any some el la los las un una unos unas y o de del al en por para con sin que qué como cómo cuando cuándo"
    " donde dónde quien quién es son era eran ser estar mi mis tu tus su sus lo le les se me te nos hay muy más mas pero si sí no ya"
).split()


def words(c: Column) -> Column:
    """Runs of other than white space of any Unicode kind."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def tokens(c: Column) -> Column:
    """Lower-case tokens of letters, digits and inner apostrophes, without possessive s and stopwords; repeated ones stay."""
    raw = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9']+"), F.lit(0))
    bare = F.transform(raw, lambda t: F.regexp_replace(F.btrim(t, F.lit("'")), "'s$", ""))
    return F.filter(bare, lambda t: (t != "") & ~t.isin(*STOPWORDS))


def terms(c: Column) -> Column:
    """Distinct words of more than two letters, Spanish ones whole, without noise."""
    raw = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9áéíóúñü]+"), F.lit(0))
    return F.array_distinct(F.filter(raw, lambda t: (F.length(t) > 2) & ~t.isin(*NOISE)))


def collapse(c: Column) -> Column:
    """Lower case, white space as single spaces, trimmed."""
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def fold(c: Column) -> Column:
    """collapse, with curly quotes straightened and accented Latin letters bare."""
    return collapse(F.translate(c, "‘’“”áàâäãåéèêëíìîïóòôöõúùûüñçÁÀÂÄÉÈÊËÍÓÖÚÜÑÇ", "''\"\"aaaaaaeeeeiiiiooooouuuuncaaaaeeeeioouunc"))


def flat(c: Column, most: int) -> Column:
    """One line without control characters, at most so many characters."""
    return F.left(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\p{Cntrl} ]+", " ")), F.lit(most))


def without_markup(c: Column) -> Column:
    """Text without tags; blank if it holds what looks like a call of a tool."""
    return F.when(F.lower(c).rlike(r"</?(function|tool|invoke|parameter)"), "").otherwise(F.trim(F.regexp_replace(c, r"<[^<>]{1,80}>", "")))


def slug(c: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), "-")


def approx_tokens(c: Column) -> Column:
    """A rough count of model tokens: four characters each."""
    return F.floor(F.length(c) / 4).cast("int")


def caption(c: Column) -> Column:
    """A caption without tags, entities, bracketed noise and notes of music."""
    plain = F.regexp_replace(c, r"<[^>]+>", "")
    for entity, sign in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        plain = F.replace(plain, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\[[^\]]*\]|\([^)]*\)|[♪♫]", " "), r"\s+", " "))


def segment_text(c: Column) -> Column:
    """A segment without brackets that hold up to three words and nothing else; other brackets stay."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[\[(]\s*[A-Za-z,'-]+(?: +[A-Za-z,'-]+){0,2}\s*[\])]", " "), r"\s+", " "))


def document_id(kind: Column, locator: Column) -> Column:
    return F.concat(kind, F.lit("-"), F.left(F.sha1(F.concat(kind, F.lit(":"), locator)), F.lit(16)))


def chunk_id(doc_id: Column, idx: Column) -> Column:
    return F.format_string("%s:%04d", doc_id, idx)


def content_hash(c: Column) -> Column:
    return F.sha2(F.coalesce(c, F.lit("")), 256)


#: Fixed value: a sentence, as proposals and passages are matched.
SENTENCE = r"[^.!?\n]+[.!?]?"


def sentences(c: Column) -> Column:
    """Runs up to a full stop, question or exclamation mark or line end, trimmed, none blank."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(SENTENCE), F.lit(0)), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")


def figures(c: Column) -> Column:
    """Distinct amounts and percentages, without commas and trailing zeros: $1200, 5%."""
    raw = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\$\s?\d[\d,]*(?:\.\d+)?|\d+(?:\.\d+)?\s?%"), F.lit(0))
    plain = F.transform(raw, lambda f: F.regexp_replace(f, r"[,\s]", ""))
    return F.array_distinct(F.transform(plain, lambda f: F.regexp_replace(F.regexp_replace(f, r"(\.\d*?)0+(%?)$", "$1$2"), r"\.(%?)$", "$1")))


def latest_year(c: Column) -> Column:
    """The greatest year of this century mentioned, or null."""
    return F.array_max(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\b(20\d{2})\b"), F.lit(1)), lambda y: y.cast("int")))


def thread_title(question: Column, most: int = 60) -> Column:
    """A title from a question: no greeting or filler in front, cut at a word, capitalised."""
    plain = F.trim(F.regexp_replace(F.coalesce(question, F.lit("")), r"\s+", " "))
    bare = F.regexp_replace(plain, r"(?i)^(?:(?:hi|hello|hey|hola|please|so|ok|okay|well)[,!.]?\s+)+", "")
    short = F.when(F.length(bare) <= most, bare).otherwise(F.regexp_replace(F.left(bare, F.lit(most + 1)), r"\s+\S*$", ""))
    return F.concat(F.upper(F.left(short, F.lit(1))), F.substr(short, F.lit(2)))


def escape_text(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def escape_attr(c: Column, most: int = 200) -> Column:
    line = F.trim(F.regexp_replace(c, r"\s+", " "))
    cut = F.when(F.length(line) > most, F.concat(F.left(line, F.lit(most - 1)), F.lit("…"))).otherwise(line)
    return F.replace(escape_text(cut), F.lit('"'), F.lit("&quot;"))


def csv_safe(c: Column) -> Column:
    """A cell that no spreadsheet takes for a formula."""
    return F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def safe_segment(c: Column) -> Column:
    """A part of a path: letters, digits, _ and - only."""
    return F.regexp_replace(c, r"[^A-Za-z0-9_-]", "")


def markers(answer: Column, most: Column) -> Column:
    """Numbers of the valid [S#] markers in order of first appearance."""
    raw = F.transform(F.regexp_extract_all(answer, F.lit(r"\[S(\d{1,4})\]"), F.lit(1)), lambda n: n.cast("int"))
    return F.array_distinct(F.filter(raw, lambda n: (n >= 1) & (n <= most)))


def without_markers(answer: Column) -> Column:
    return F.trim(F.regexp_replace(answer, r"[ \t]*\[S\d{1,4}\]", ""))


def deep_link(link: Column, seconds: Column) -> Column:
    """A link into a recording at a time; only http links, and only video pages take the time."""
    t = F.floor(F.greatest(seconds, F.lit(0))).cast("string")
    timed = F.concat(link, F.when(link.contains("?"), "&t=").otherwise("?t="), t)
    return F.when(~link.rlike(r"(?i)^https?://"), F.lit(None)).when(link.rlike(r"(?i)//([^/]*\.)?(youtube|video|youtu)\.[^/]+/|//youtu\.be/"), timed).otherwise(link)


def quote(c: Column, most: int = 220) -> Column:
    """A short quote: without a leading mark of a new speaker, up to the next one, at most so many characters."""
    bare = F.trim(F.regexp_replace(F.trim(c), r"^(>>\s*)+", ""))
    one = F.trim(F.split(bare, ">>")[0])
    return F.when(F.length(one) > most, F.concat(F.rtrim(F.left(one, F.lit(most - 1))), F.lit("…"))).otherwise(one)


def singular(c: Column) -> Column:
    """A rough stem: -ies as y, -sses as ss, a final s dropped unless after s, u or i."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"ies$", "y"), r"sses$", "ss"), r"(?<=[^sui])s$", "")


def magic_type(b: Column) -> Column:
    """Media type by the first bytes of a binary; null if unknown."""
    head = F.hex(F.substring(b, 1, 12))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "image/png").when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("474946383"), "image/gif")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp").when(head.startswith("255044462D"), "application/pdf")
    )


def split_note(c: Column) -> Column:
    """A struct (quote, comment) of a note: what follows "From: " at its start or after the end of a sentence is the quote."""
    line = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    marked = line.rlike(r"^(?:.*?[.;:!?]\s)?From:\s")
    part = lambda n: F.trim(F.regexp_extract(line, r"^(?:(.*?[.;:!?])\s)?From:\s(.*)$", n))
    return F.struct(F.when(marked, part(2)).otherwise("").alias("quote"), F.when(marked, part(1)).otherwise(line).alias("comment"))


def plain_punctuation(c: Column) -> Column:
    """Dashes as plain hyphens between blanks, runs of blanks as one."""
    return F.regexp_replace(F.regexp_replace(c, "\\s*[\u2014\u2013]\\s*", " - "), "[ \\t]{2,}", " ")


def without_notice(c: Column, notice: str) -> Column:
    """A text without the sentences of its last paragraph that match a pattern; a text of nothing else stays as it is."""
    paras = F.split(F.rtrim(c), "\n\n")
    kept = F.filter(F.split(F.regexp_replace(F.try_element_at(paras, F.lit(-1)), r"([.!?])\s+", "$1\u001f"), "\u001f"), lambda s: ~s.rlike(notice))
    head = F.slice(paras, F.lit(1), F.size(paras) - 1)
    last = F.trim(F.array_join(kept, " "))
    cleaned = F.when(F.size(kept) > 0, F.array_join(F.concat(head, F.array(last)), "\n\n")).when(F.size(paras) > 1, F.array_join(head, "\n\n")).otherwise(c)
    return F.when(F.try_element_at(paras, F.lit(-1)).rlike(notice), cleaned).otherwise(c)
