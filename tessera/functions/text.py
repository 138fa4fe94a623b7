"""Text functions: Column to Column, all of them built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words, patterns and kinds that queries over papers rely on.
TOKEN = r"[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)*"
STOPWORDS = (
    "a an and are as at be been by can did do does for from had has have how in is it its of on or "
    "our than that the their them these they this those to was we were what when where which who "
    "why will with would you your about into over also not but if so such there then used use using "
    "paper study authors author"
).split()
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z0-9(\[])"
MENTION = r"(?i)\b(Fig(?:ure)?s?|Tables?|Eq(?:uation)?s?)\.?\s*\(?(S?\d{1,3})([A-Za-z])?\b"
MARKERS = r"\[\s*((?:[SH]\d+)(?:\s*[,;]\s*[SH]\d+)*)\s*\]"
QUOTE = "[\"“]([^\"“”]{25,400})[\"”]"
NUMBERING = r"^\s*(?:(?:\d{1,2}(?:\.\d{1,2}){0,3}\.?)|(?:[IVX]{1,4}\.)|(?:[A-Z][.)]))\s+"
SECTION_KINDS = {
    "abstract": r"abstract|summary|significance statement|author summary",
    "introduction": r"introduction|background|overview|motivation",
    "related_work": r"related work|literature review|prior work|previous work",
    "methods": r"(materials? and )?methods?( and materials?)?|methodology|experimental (setup|procedures?|design|methods?|section)|approach|study design|patients? and methods|proposed method|implementation( details)?|data( collection| sets?)?|datasets?|model|models",
    "results": r"results?( and discussion)?|experiments?|experimental results|evaluation|findings",
    "discussion": r"discussion|analysis",
    "limitations": r"limitations?( and future work)?|threats to validity",
    "conclusion": r"conclusions?( and future (work|directions))?|concluding remarks|future work|summary and outlook",
    "references": r"references?|bibliography|literature cited|works cited",
    "acknowledgments": r"acknowledge?ments?|funding|author contributions?|conflicts? of interest|competing interests?|data availability( statement)?|code availability|ethics statement",
    "supplementary": r"supplement(ary|al)( materials?| information| data)?|appendix|appendices|supporting information",
}
INTENTS = {
    "summary": r"\b(summari[sz]e|summary|what is (this|the) paper about|main (contribution|idea|finding)s?|overview|tl;?dr|key (findings?|takeaways?)|in a nutshell)\b",
    "critical": r"\b(limitation|weakness|assumption|bias|biases|missing|confound|critique|critic|flaw|generali[sz]|threat|shortcoming|caveat|improve|robust)\w*",
    "methods": r"\b(dataset|data set|cohort|train|trained|training|preprocess|baseline|implementation|hyper-?parameter|inclusion|exclusion|criteria|protocol|architecture|optimi[sz]er|method)\w*",
    "results": r"\b(result|perform|accuracy|outperform|best|improv|score|metric|auc|dice|f1)\w*",
    "visual": r"\b(figure|fig\.|plot|graph|chart|image|diagram|trend|curve|panel|heatmap|micrograph)\b",
    "references": r"\b(reference|references|cite|cited|citation|bibliograph)\w*",
}
FOLLOW_UP = r"\b(it|its|they|them|their|this|that|these|those|he|she|the same|former|latter|there|then|also|and)\b"


def bounded(pattern: str) -> str:
    """``pattern`` without regard to case, its outer word bounds over letters of any script, in which engines differ."""
    inner = pattern.removeprefix(r"\b")
    inner, end = (inner[:-2], r"(?:$|[^\p{L}\p{N}_])") if inner.endswith(r"\b") else (inner, "")
    return rf"(?i)(?:^|[^\p{{L}}\p{{N}}_]){inner}{end}"


def stem(w: Column) -> Column:
    n = F.length(w)
    return (
        F.when((n > 5) & w.endswith("ies"), F.concat(F.substring(w, F.lit(1), n - 3), F.lit("y")))
        .when((n > 5) & w.endswith("ing"), F.substring(w, F.lit(1), n - 3))
        .when((n > 4) & w.endswith("ed"), F.substring(w, F.lit(1), n - 2))
        .when((n > 3) & w.endswith("s") & ~w.endswith("ss"), F.substring(w, F.lit(1), n - 1))
        .otherwise(w)
    )


def tokens(text: Column) -> Column:
    """Lower-cased ASCII words without stopwords, stemmed."""
    words = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)
    return F.transform(F.filter(words, lambda w: ~w.isin(STOPWORDS)), stem)


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def collapse(text: Column) -> Column:
    """White space runs become one space, ends are trimmed."""
    return F.array_join(words(text), " ")


def sentences(text: Column) -> Column:
    return F.split(text, SENTENCE_END)


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, "[^A-Za-z0-9]+", "_"), F.lit("_"))


def label(kind: Column, number: Column) -> Column:
    k = F.rtrim(F.rtrim(F.lower(kind), F.lit("s")), F.lit("."))
    name = F.when(k.isin("fig", "figure"), "Figure").when(k == "table", "Table").when(k.isin("eq", "equation"), "Equation").otherwise(F.initcap(kind))
    return F.concat(name, F.lit(" "), F.upper(number))


def mentions(text: Column) -> Column:
    """Distinct labels such as ``Figure 3`` in order of first mention."""
    kinds, numbers = (F.regexp_extract_all(text, F.lit(MENTION), F.lit(k)) for k in (1, 2))
    return F.array_distinct(F.zip_with(kinds, numbers, label))


def strip_numbering(title: Column) -> Column:
    return F.trim(F.rtrim(F.trim(F.regexp_replace(title, NUMBERING, "")), F.lit(":")))


def section_kind(title: Column) -> Column:
    """The kind of a section title, or null."""
    t = F.btrim(F.lower(strip_numbering(title)), F.lit(" .:"))
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(SECTION_KINDS.items()):
        out = F.when(t.rlike(f"^({pattern})$"), kind).otherwise(out)
    return out


def marker_groups(text: Column) -> Column:
    """The different groups of markers, such as ``[S1, S2]``, in order of first use."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(MARKERS), F.lit(0)))


def single_markers(text: Column) -> Column:
    """``[S1, S2]`` becomes ``[S1][S2]``."""
    groups = marker_groups(text)
    one = lambda g: F.concat(F.lit("["), F.array_join(F.regexp_extract_all(g, F.lit(r"[SH]\d+"), F.lit(0)), "]["), F.lit("]"))
    return F.aggregate(groups, text, lambda t, g: F.replace(t, g, one(g)))


def cited(text: Column) -> Column:
    """Distinct source ids of single markers in order of first use."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[([SH]\d+)\]"), F.lit(1)))


def quotes(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(QUOTE), F.lit(1))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor(F.char_length(text) / 4).cast("long"))


def excerpt(text: Column, most: int = 220) -> Column:
    t = collapse(text)
    return F.when(F.char_length(t) <= most, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, most - 3)), F.lit("...")))


def bigrams(ws: Column) -> Column:
    n = F.greatest(F.size(ws) - 1, F.lit(0))
    return F.zip_with(F.slice(ws, F.lit(1), n), F.slice(ws, F.lit(2), n), lambda a, b: F.concat_ws("_", a, b))


def clauses_of(question: Column) -> dict[str, Column]:
    return {k: question.rlike(bounded(p)) for k, p in INTENTS.items()}


def intent(question: Column) -> Column:
    """``struct(kind, prefer_sections, wants_references, labels)`` of a question."""
    has, labels = clauses_of(question), mentions(question)
    visual = (F.size(labels) > 0) | has["visual"]
    summary = has["summary"] & (F.size(labels) == 0)
    kind = F.when(summary, "summary").when(visual, "visual").when(has["critical"], "critical").otherwise("general")
    none = F.array().cast("array<string>")
    part = lambda when, *names: F.when(when, F.array(*map(F.lit, names))).otherwise(none)
    prefer = F.concat(
        part(summary, "abstract", "introduction", "conclusion", "discussion"),
        part(~summary & has["critical"], "discussion", "limitations", "conclusion", "methods"),
        part(has["methods"], "methods"),
        part(has["results"], "results"),
    )
    return F.struct(kind.alias("kind"), F.array_sort(F.array_distinct(prefer)).alias("prefer_sections"), has["references"].alias("wants_references"), labels.alias("labels"))


def follow_up(question: Column, turns: Column, most_words: int = 12) -> Column:
    """Whether a question needs the turns before it to be understood."""
    return (turns > 0) & ((word_count(question) <= most_words) | question.rlike(bounded(FOLLOW_UP)))
