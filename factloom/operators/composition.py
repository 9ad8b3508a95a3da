"""Wording of an answer: cleaned sentences, markers between them, opener, closing and the reply without an answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import lexicons as L

# Words of headings that may stand before a sentence.
FURNITURE = (
    "Appendix|Section|Chapter|Contents|Introduction|Overview|Table|Figure|Note|Warning|Caution|Methodology|Accuracy|Precision|Specifications?|Limitations?|Panel|Disclaimer|"
    "Principle|Summary|Purpose|Scope|References?|Indications?|Intended Use|Performance|Unit of Measure|Reference Values?|Quality Control|Storage|Calibration"
)
NUMBERED = r"^(?:[A-Z]?\d+(?:[.\-]\d+)*\s+){1,3}"
HEADED = rf"^(?:(?:{FURNITURE})\b[\s:.\-]*)+(?=[A-Z])"
ECHOED = r"^(?:[A-Z][A-Za-z]*\s){0,3}(?:Meter|Analyzer|System|Manual|Guide)\s+(?=[A-Z])"
FUSED = rf"^(?:{FURNITURE})(?=[A-Z])"
TITLED = r"^(?:(?:[A-Z][A-Za-z]*|[A-Z]?\d+(?:[.\-]\d+)*)(?:\s+(?:of|for|and|the))?\s+){1,6}(?=(?:The|This|These|Each|All|A|An)\s+[A-Za-z])"
NEGATION = r"(?i)\b(not|never|no |cannot|must not|should not|excluded|limitation|caution|warning|do not)\b"
# An answer's first words by intent; the subject, or the words behind the bar, goes where the braces are.
OPENERS = {
    "CLINICAL_SIGNIFICANCE": "Here is what the documentation says about why {this} is measured", "INTENDED_USE": "{This product} is described in the documentation as follows",
    "INTERFERENCE": "On interference affecting {these results}, the documentation states", "MECHANISM": "The documentation describes how {this} works as follows",
    "CAUSAL": "On how {these factors} relate, the documentation states", "SPECIFICATION": "The documented specifications for {this} are", "PROCEDURE": "The documented procedure for {this} is",
    "REGULATORY": "The regulatory record for {this} shows", "TEMPORAL": "The record shows the following dates for {this}", "COMPARISON": "Comparing them, the documentation states",
    "DEFINITION": "{This} is defined in the documentation as", "GENERAL": "Here is what the documentation says about {this}",
}
# Markers by the relation of a sentence to the one before.
MARKERS = {
    "contrast": ["However,", "The documentation also cautions that", "Note, though, that"], "corroborate": ["Separately,", "Another source states that", "Elsewhere in the corpus,"],
    "specify": ["Specifically,", "In more detail,", "More precisely,"], "continue": ["It adds that", "The same document notes that", "It also states that"],
}
# Focus words too general to be a subject.
GENERIC = ["meter", "analyzer", "analyser", "strip", "cartridge"]


def _once(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of an expression that stands once in the plan, however often it is named."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def clean_sentence(c: Column | str) -> Column:
    """A sentence without section numbers, headings and document titles before it, evenly spaced and capitalised."""
    t = F.regexp_replace(F.trim(c), FUSED, "")
    for _ in range(3):
        for pattern in (NUMBERED, HEADED, ECHOED):
            t = F.regexp_replace(t, pattern, "")
    t = F.regexp_replace(t, r"(?i)^(\w+)\s+\1\b", "$1")
    t = _once(t, lambda t: _once(F.regexp_replace(t, TITLED, ""), lambda cut: F.when(F.size(F.split(F.trim(cut), r"\s+")) >= 5, cut).otherwise(t)))
    for pattern, by in ((r"\s{2,}", " "), (r"\s+([,.;:%)])", "$1"), (r"\(\s+", "(")):
        t = F.regexp_replace(t, pattern, by)
    return _once(F.trim(t), lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, F.lit(2), F.length(t))))


def decapitalised(c: Column | str, names: str = r"^(?:[A-Z]{2,}|K\d{6}\b)") -> Column:
    """The first letter in lower case unless a name or acronym (``names``) stands first."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(names), c).otherwise(F.concat(F.lower(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c))))


def title_case(c: Column | str) -> Column:
    """Each word's first letter in upper case, the rest as it is."""
    return F.array_join(F.transform(F.split(c, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")


def short_label(c: Column | str, most: int = 28) -> Column:
    """A file name without extension and underscores, cut with an ellipsis."""
    t = F.trim(F.regexp_replace(F.regexp_replace(c, r"\.[A-Za-z0-9]{1,5}$", ""), "_+", " "))
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 1), F.lit("…"))).otherwise(t)


def escaped_html(c: Column | str) -> Column:
    t = F.col(c) if isinstance(c, str) else c
    for sign, by in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        t = F.replace(t, F.lit(sign), F.lit(by))
    return t


def subject_phrase(focus: Column | str) -> Column:
    """The subject of a question from its focus terms: two are joined, general device words are none."""
    named = F.filter(focus, lambda f: ~f.isin(*GENERIC))
    return F.when(F.size(named) > 1, F.concat(title_case(F.get(named, F.lit(0))), F.lit(" and "), title_case(F.get(named, F.lit(1))))).when(F.size(named) == 1, title_case(F.get(named, F.lit(0))))


def opener(intent: Column, focus: Column, documents: Column) -> Column:
    """The line an answer begins with, by intent, subject and number of documents."""
    subject, line = subject_phrase(focus), F.lit(None).cast("string")
    for name, form in OPENERS.items():
        before, _, rest = form.partition("{")
        default, _, after = rest.partition("}")
        said = F.concat(F.lit(before), F.coalesce(subject, F.lit(default)), F.lit(after)) if rest else F.lit(before)
        line = F.coalesce(line, said) if name == "GENERAL" else F.when(intent == name, said).otherwise(line)  # each line stands once in the next
    scope = F.when(documents > 1, F.concat(F.lit(" — drawn from "), documents.cast("string"), F.lit(" documents"))).otherwise("")
    return F.concat(line, scope, F.lit(":"))


def marked(picks: DataFrame) -> DataFrame:
    """picks(query, pick, document, position, sentence) in reading order with relation and marker; the first has none.

    The n-th sentence of one relation takes the n-th marker of its pool, later ones the first again.
    """
    order = W.partitionBy("query").orderBy("pick")
    was = lambda c: F.lag(c).over(order)
    against = F.col("sentence").rlike(NEGATION) & ~was(F.col("sentence").rlike(NEGATION))
    relation = (
        F.when(was("pick").isNull(), None).when(against, "contrast").when(F.col("document") != was("document"), "corroborate")
        .when(F.col("position") > was("position") + 2, "specify").otherwise("continue"))
    placed = picks.withColumn("relation", relation)
    nth = F.row_number().over(W.partitionBy("query", "relation").orderBy("pick"))
    pools = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in MARKERS.items() for x in kv])
    return placed.withColumn("nth", nth).withColumn("marker", F.get(pools[F.col("relation")], F.when(F.col("nth") <= 3, F.col("nth") - 1).otherwise(0))).drop("nth")


def reading_order(picks: DataFrame) -> DataFrame:
    """Picks renumbered: the document of the strongest sentence first, then by position and chunk."""
    best = F.max("final").over(W.partitionBy("query", "document"))
    return picks.withColumn("best", best).withColumn("pick", F.row_number().over(W.partitionBy("query").orderBy(F.desc("best"), "document", "position", "chunk"))).drop("best")


def closing(percent: Column, consensus: Column, coverage: Column, rejected: Column) -> Column:
    """What an answer does not cover, or null."""
    return (
        F.when(percent < 30, "This is a weak match. The corpus does not appear to contain a direct answer, so treat the passages above as related context rather than a settled answer.")
        .when(consensus < 0.3, "All of this comes from a single document. Worth confirming against a second source before relying on it.")
        .when(coverage < 0.5, "Part of the question is not covered by the documents found. Narrowing the wording may surface more.")
        .when(rejected > 12, "Passages that merely repeated the wording of the question were set aside in favour of those that answer it."))


def no_answer(intent: Column, focus: Column, rejected: Column, nearest: Column) -> Column:
    """The reply where no passage answers."""
    wants = F.create_map(*[F.lit(x) for i in [*L.INTENTS, L.GENERAL] for x in (i[0], i[5])])
    subject = subject_phrase(focus)
    lead = F.concat(F.lit("I could not find a passage in the corpus that answers this"), F.coalesce(F.concat(F.lit(" about "), subject), F.lit("")), F.lit("."))
    detail = F.when(rejected > 0, F.concat(rejected.cast("string"), F.when(rejected == 1, " passage").otherwise(" passages"), F.lit(" matched the wording of the question but did not contain "), F.coalesce(wants[intent], F.lit("an answer")), F.lit(" — so they were set aside rather than presented as an answer."))).otherwise("Nothing in the indexed documents covers this topic.")
    return F.concat_ws(" ", lead, detail, F.when(nearest.isNotNull(), F.concat(F.lit("The closest related document is "), nearest, F.lit("."))))


def composed_reply(picks: DataFrame, questions: DataFrame) -> DataFrame:
    """(query, opener, body, documents): picks in order with markers and source numbers, below an opener.

    questions(query, intent, focus).  Source numbers follow the first appearance of a document's chunk.
    """
    first = F.min("pick").over(W.partitionBy("query", "chunk"))
    numbered = marked(picks).withColumn("first", first).withColumn("n", F.dense_rank().over(W.partitionBy("query").orderBy("first")))
    numbered, said = numbered.withColumn("said", clean_sentence("sentence")), F.col("said")
    line = F.concat(F.when(F.col("marker").isNull(), said).otherwise(F.concat_ws(" ", "marker", decapitalised(said))), F.lit(" ["), F.col("n").cast("string"), F.lit("]"))
    whole = numbered.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pick", line.alias("l")))), lambda x: x["l"]), " ").alias("body"), F.countDistinct("document").alias("documents"))  # a few picks
    return whole.join(questions, "query").select("query", opener(F.col("intent"), F.col("focus"), F.col("documents")).alias("opener"), "body", "documents")


def suggested_questions(documents: DataFrame, name: str = "document_name", most: int = 4) -> DataFrame:
    """Questions about the topics that document names give: distinct by case-free topic, the first ``most`` by name."""
    topic = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(name), r"\.[A-Za-z0-9]{1,5}$", ""), r"^\d+[_\- ]+", ""), r"[_\-]+", " "))
    topics = documents.select(topic.alias("topic")).where("topic <> ''").groupBy(F.lower("topic").alias("k")).agg(F.min("topic").alias("topic"))
    return topics.orderBy("k").limit(most).select("topic", F.concat(F.lit("What is "), "topic", F.lit("?")).alias("question"))


def bank_stem(c: Column | str) -> Column:
    """A word's stem for the question bank: plural endings first, then verb endings, four letters at least remaining."""
    t = F.col(c) if isinstance(c, str) else c

    def cut(t: Column, ends: list[tuple[str, str]]) -> Column:
        out = t
        for end, by in reversed(ends):
            fits = t.endswith(end) & (F.length(t) - len(end) >= 3) & (~t.endswith("ss") if end == "s" else F.lit(True))
            out = F.when(fits, F.concat(F.substring(t, F.lit(1), F.length(t) - len(end)), F.lit(by))).otherwise(out)
        return out

    return cut(cut(t, [("ies", "y"), ("es", "e"), ("s", "")]), [("ing", ""), ("ed", ""), ("e", "")])
