"""Text cut off by field limits (problem 10).

Two passes.  The first learns, over all documents, which unterminated lines are complete in
themselves (headings, list items, table cells, sign-offs): a line that another line follows was
never cut, and a closing line that many documents share and that is no beginning of longer lines
is a sign-off.  It also learns each source's usual terminators, its field limits and
whether it closes its structures; a stack automaton runs over each whole text for open brackets, quotes and markup.  The second
pass looks for broken multibyte sequences and escapes at the end, and judges the last line against what was learned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import lexicons as L
from factloom.session import small, stored

# Marks that an exporter puts where it cut a text; "read more" only as words of their own.
CUT_MARKS = ("...", "…", "[more]", "[truncated]", "[continued]", "[cont.]", "[cont]", "[...]", "[…]", "(more)", "(truncated)", "(continued)", "read more", "<truncated>")
# Sentence ends, with closing quotes or brackets behind them.
TERMINATED = r"[.!?。！？](?:[\"'”’»)\]]*)$"
# A sentence end with further text behind it, not the point of an abbreviation.
SENTENCE_INSIDE = r"(?i)(?:\p{L}{2}(?<!\b(?:inc|corp|ltd|co|no|nos|vs|approx|fig|cat|ref|dr|st|rev|ver|vol|max|min|temp|incl|etc))\.|\p{L}{2}[!?])[\"'”’»)\]]*\s+\S|[。！？]\s*\S"

_OPEN = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»", "„": "“"}
_CLOSE = {c: [o for o, x in _OPEN.items() if x == c] for c in _OPEN.values()}
_PART = re.compile(r"```|\\.|</?([A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*)?(/?)>|[()\[\]{}“”«»„]|(?<![0-9])\"|\"(?=\s*[,:}\])])|<[A-Za-z/][^<>]*$", re.S)
_VOID = {"br", "hr", "img", "p", "li", "input", "meta", "link"}


def open_structures(text: str) -> str:
    """What the stack automaton still holds at the end of a text, bottom first: brackets, quotes, code fences and markup.

    A closing sign takes its opener and all opened inside it off the stack; without one it is ignored.  A straight quote behind a
    digit is an inch mark unless punctuation follows; an escaped sign is plain text.
    """
    stack: list[str] = []

    def close(*openers: str) -> bool:
        at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i] in openers), -1)
        del stack[at if at >= 0 else len(stack):]
        return at >= 0

    for m in _PART.finditer(text):
        s = m.group(0)
        if s in ("```", '"'):
            if not close(s):
                stack.append(s)
        elif s[0] == "<":
            if s[-1] != ">":
                stack.append("<")
            elif s[1] == "/":
                close(f"<{m.group(1)}>")
            elif not m.group(2) and m.group(1).lower() not in _VOID:
                stack.append(f"<{m.group(1)}>")
        elif not (s in _CLOSE and close(*_CLOSE[s])) and s in _OPEN:
            stack.append(s)
    return "".join(stack)


def without_marks(text: str) -> tuple[str, bool]:
    """The text without trailing white space and cut marks, and whether it had marks."""
    t = text.rstrip(" \n\r\t")
    full, end, low = t, len(t), t[-400:].lower()
    while True:
        mark = next((m for m in CUT_MARKS if low.endswith(m) and not (m[0] == "r" and len(low) > len(m) and low[-len(m) - 1].isalnum())), None)
        if mark is None:
            return t, end < len(full)
        t = t[: -len(mark)].rstrip()
        end, low = len(t), t[-40:].lower()


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per text its body without marks, and what is open at its end and within its last line; whole texts, read once."""
    for b in batches:
        rows = []
        for i, s, t in zip(b["id"], b["source"], b["t"]):
            if t is None:
                rows.append((i, s, None, None, None, "", False, False))
                continue
            body, marked = without_marks(t)
            left = open_structures(body)
            rows.append((i, s, len(t.rstrip(" \n\r\t")), body, marked, left, bool(left) and bool(open_structures(body.rpartition("\n")[2])), bool(left) or _PART.search(body) is not None))
        yield pd.DataFrame(rows, columns=["id", "source", "len", "body", "marked", "open", "open_last", "structured"]).astype({"len": "Int64"})


def line_template(c: Column) -> Column:
    """A line with case, white space, numbers and single letters (revisions, initials) masked."""
    t = F.regexp_replace(F.trim(F.lower(c)), r"\s+", " ")
    return F.regexp_replace(F.regexp_replace(t, r"[0-9]+", "0"), r"(?<=[ :])[a-z](?=$|[ ,.])", "a")


def truncated_documents(df: DataFrame, doc_id: str, source: str, text: str = "text",
                        min_share: float = 0.0002, min_documents: int = 3, limit_share: float = 0.02, signoff_words: int = 8,
                        usual_share: float = 0.1, habit_share: float = 0.5, open_share: float = 0.02) -> DataFrame:
    """One row per document: id, source (folded), truncated, reasons.

    A document is truncated when its stored text stops inside a word or sentence.  reasons lists
    mark (an exporter's cut mark), bytes (broken multibyte sequence), escape, structure (a
    bracket, quote, fence or markup that the stack automaton holds at the text's end: opened in the last line, or anywhere in a source of whose
    terminated texts with such signs at most one or ``open_share`` leave any open) and end (the last line has no terminator and is no complete line),
    limit added where the length is one of the source's field limits (a length that at least
    ``limit_share`` of its documents share, three at least).  A line counts as complete when it is
    followed by another line, or has at most ``signoff_words`` words, closes the text and begins no longer
    line, in at least ``min_documents`` different texts and ``min_share`` of all; list items and table cells also when their last word is common.
    An unterminated end counts by itself where at least ``usual_share`` of the source's texts close with a terminator or the length is a
    limit.  Elsewhere it needs evidence that cuts do not remove: sentence ends inside this text or inside ``habit_share`` of the source's
    texts, or a last word that cannot close a sentence (function word, comma).  There a short last line without function words, below a
    closed line, is a sign-off if ``habit_share`` of the source's unterminated texts end so.  What stays undecided, and counts as complete,
    is a lone unfinished sentence that stops at any other word in a source that writes no sentence ends.
    Null or blank texts are not truncated; a null source is reported as null; repeated rows collapse; an
    empty table gives no rows; further columns are ignored.
    """
    docs = df.select(F.col(doc_id).alias("id"), F.lower(F.trim(F.col(source))).alias("source"), F.col(text).alias("t"))
    docs = docs.mapInPandas(_ends, f"id {df.schema[doc_id].dataType.simpleString()}, source string, len int, body string, marked boolean, open string, open_last boolean, structured boolean")
    closed = lambda x: x.rlike(TERMINATED)
    lines = F.filter(F.split("body", "\n"), lambda x: F.length(F.trim(x)) > 0)
    opened = F.filter(F.transform(F.reverse(lines), lambda x, i: F.struct(x.alias("x"), (i > 0).alias("inside"))), lambda s: ~closed(s["x"]))
    # --- one pass over the texts leaves a compact row each; copies of a row collapse
    base = stored(
        docs.withColumn("last", F.substring_index("body", "\n", -1))
        .select(
            "id", "source", "len", "marked", "last", "open", "open_last", "structured", F.xxhash64("body").alias("h"), (F.length("body") > 0).alias("filled"), closed(F.col("last")).alias("terminated"),
            F.col("body").rlike(SENTENCE_INSIDE).alias("spoken"), F.coalesce(closed(F.try_element_at(lines, F.lit(-2))), F.lit(False)).alias("below_closed"),
            line_template(F.col("last")).alias("line"), F.lower(F.regexp_extract("last", r"(?<![^\s|])([^\s|]+)$", 1)).alias("last_word"),
            F.array_distinct(F.transform(opened, lambda s: F.struct(line_template(s["x"]).alias("line"), s["inside"].alias("inside")))).alias("opened"))
        .dropDuplicates(["id", "source", "h"]),
        "truncation-base",
    )
    total = base.agg(F.count("*").alias("n"))
    # --- complete lines, over all documents; copies of one text count once
    each = base.where("filled").select("h", F.inline("opened")).distinct()
    counted = each.groupBy("line").agg(F.count_if("inside").alias("inside"), F.count_if(~F.col("inside")).alias("final")).crossJoin(F.broadcast(total))
    often = lambda c: (c >= min_documents) & (c >= F.lit(min_share) * F.col("n"))
    brief = F.size(F.split("line", " ")) <= signoff_words
    known = stored(counted.where(often(F.col("inside")) | (often(F.col("final")) & brief)).select("line", "inside", "final", often(F.col("inside")).alias("sure")), "closing-lines")
    # a closing line that often begins longer text is the stump of a sentence, not a sign-off: sentences meet the doubtful
    # lines on their first word, and only their first words are put into template form
    doubtful = known.where("NOT sure").select(F.col("line").alias("stump"), "final", F.substring_index("line", " ", 1).alias("word"))
    said = df.select(F.explode(F.split(F.col(text), r"\n|(?<=[.!?]) ")).alias("l")).where(F.length("l") > 0)
    begun = (
        said.select(line_template(F.substring_index("l", " ", signoff_words + 1)).alias("start")).withColumn("word", F.substring_index("start", " ", 1))
        .join(small(doubtful), "word").where(F.col("start").startswith(F.concat("stump", F.lit(" "))))
        .groupBy("stump").agg(F.count("*").alias("longer"), F.first("final").alias("final")).where(F.col("longer") > 0.2 * F.col("final")).select(F.col("stump").alias("line"))
    )
    complete = stored(known.join(small(begun), "line", "left_anti").select("line", F.lit(True).alias("whole")), "complete-lines")
    # --- words that end sentences and lines, for list items and table cells
    common = (
        said.select(F.lower(F.regexp_replace(F.substring_index("l", " ", -1), r"[.,;:!?]+$", "")).alias("last_word")).groupBy("last_word").agg(F.count("*").alias("k"))
        .crossJoin(F.broadcast(total)).where((F.col("k") >= min_documents) & (F.col("k") >= 0.002 * F.col("n"))).select("last_word", F.lit(True).alias("common_word"))
    )
    # --- field limits and usual terminators by source
    function_word = rf"(?i)(?:^|[\s,;(])(?:{'|'.join(L.FUNCTION_WORDS)})"
    signed = F.col("below_closed") & (F.size(F.split("line", " ")) <= signoff_words) & ~F.col("last").rlike(function_word + r"(?=$|[\s,;)])")
    by_source = base.where("len > 0").groupBy("source").agg(F.count("*").alias("m"), F.avg(F.col("terminated").cast("int")).alias("usual"), F.avg(F.col("spoken").cast("int")).alias("written"), F.coalesce(F.avg(F.when(~F.col("terminated"), signed.cast("int"))), F.lit(0.0)).alias("signing"),
        (F.count_if(F.col("terminated") & (F.col("open") != "")) <= F.greatest(F.lit(1.0), F.lit(open_share) * F.count_if(F.col("terminated") & F.col("structured")))).alias("closing"))
    sources = by_source.select(F.col("source").alias("ms"), "m")
    limits = (
        base.where("len > 0 AND NOT terminated").groupBy("source", "len").agg(F.count("*").alias("k"))
        .join(small(sources), F.col("source").eqNullSafe(F.col("ms")))
        .where((F.col("k") >= 3) & (F.col("k") >= limit_share * F.col("m"))).select(F.col("source").alias("ls"), F.col("len").alias("limit"))
    )
    usual = by_source.select(F.col("source").alias("bs"), "usual", "written", "signing", "closing")
    judged = (
        base.join(small(complete), "line", "left").join(small(stored(common, "common-words")), "last_word", "left")
        .join(small(stored(limits, "field-limits")), F.col("source").eqNullSafe(F.col("ls")) & (F.col("len").between(F.col("limit") - 1, F.col("limit"))), "left")
        .join(small(stored(usual, "source-endings")), F.col("source").eqNullSafe(F.col("bs")), "left")
    )
    itemised = F.col("last").rlike(r"^\s*(?:[-*•‣]|\d+[.)])\s+\S") | (F.col("last").rlike(r"^[^|]+\|[^|]+\|[^|]+$"))
    whole = F.coalesce(F.col("whole"), F.lit(False)) | F.col("last").rlike(r"^\s*https?://\S+/\S*\d+$") | (itemised & F.coalesce(F.col("common_word"), F.lit(False)) & F.col("limit").isNull())
    at_limit = F.col("limit").isNotNull()
    digit_stop = F.col("last").rlike(r"\d\.$") & at_limit
    hanging = F.col("last").rlike(r"\s\S*[,;]$") | F.col("last").rlike(r"\s\S+" + function_word + "$")
    signs_off = signed & (F.col("signing") >= habit_share)
    evidence = hanging | ((F.col("spoken") | (F.col("written") >= habit_share)) & ~signs_off)
    no_end = (~F.col("terminated") | digit_stop) & ~whole & F.col("filled") & ((F.col("usual") >= usual_share) | at_limit | evidence)
    checked = judged.select(
        "id", "source", at_limit.alias("at_limit"), no_end.alias("no_end"), "marked", F.col("last").rlike("�$").alias("bytes"),
        F.col("last").rlike(r"(?:&#?[a-zA-Z0-9]{0,8}|\\|\\[ux][0-9A-Fa-f]{0,3}|%[0-9A-F])$").alias("escape"),
        (F.col("open_last") | ((F.col("open") != "") & F.coalesce("closing", F.lit(True)))).alias("structure"))
    stops = F.col("no_end") | F.col("bytes") | F.col("escape") | F.col("structure")
    why = F.array_compact(F.array(
        F.when(F.col("marked"), "mark"), F.when(F.col("bytes"), "bytes"), F.when(F.col("escape"), "escape"),
        F.when(F.col("structure"), "structure"), F.when(F.col("no_end"), "end"), F.when(F.col("at_limit"), "limit"),
    ))
    return (
        checked.select("id", "source", F.coalesce(stops, F.lit(False)).alias("truncated"), F.when(stops, F.array_join(why, ",")).alias("reasons"))
        .groupBy(F.col("id").alias(doc_id)).agg(F.max("source").alias("source"), F.max("truncated").alias("truncated"), F.max("reasons").alias("reasons"))
    )


def truncation_by_source(found: DataFrame) -> DataFrame:
    """Documents, truncated documents and their share per source."""
    return found.groupBy("source").agg(
        F.count("*").alias("documents"), F.count_if("truncated").alias("truncated"),
        F.round(F.avg(F.col("truncated").cast("int")), 6).alias("share"),
    )
