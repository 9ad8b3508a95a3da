"""Question understanding, evidence routing, answer selection and confidence, for batches of questions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import lexicons as L
from factloom.functions.text import content_tokens, tokens


def intent_of(question: Column | str) -> Column:
    """Name of the intent with most cues found; ties go to the one declared first, none is GENERAL."""
    q = F.col(question) if isinstance(question, str) else question
    hits = lambda c: q.rlike(L.cue(c)).cast("int")
    scored = [F.struct(sum((hits(c) for c in cues[1:]), hits(cues[0])).alias("hits"), F.lit(-i).alias("place"), F.lit(name).alias("name")) for i, (name, cues, *_) in enumerate(L.INTENTS)]
    none = F.struct(F.lit(0).alias("hits"), F.lit(1).alias("place"), F.lit(L.GENERAL[0]).alias("name"))
    return F.array_max(F.array(none, *scored))["name"]  # each cue stands once


def focus_of(question: Column | str, terms: list[str] = L.FOCUS_TERMS) -> Column:
    """Focus terms found in a question, longest first, without those inside a longer one."""
    q = F.lower(question)
    found = F.array_compact(F.array(*[F.when(q.rlike(rf"\b{re.escape(t)}\b"), F.lit(t)) for t in sorted(terms, key=lambda t: (-len(t), t))]))
    return F.coalesce(F.filter(found, lambda t: ~F.exists(found, lambda o: (F.length(o) > F.length(t)) & o.contains(t))), F.array().cast("array<string>"))


def evidence_prior(intent: Column, record_type: Column, source_type: Column, quality: Column | None = None) -> Column:
    """Product of an intent's weights for the record and source type, times 0.55 + 0.45 quality where it is known."""
    out = F.lit(1.0)
    for name, _, _, prefer, penalise, _ in [*L.INTENTS, L.GENERAL]:
        for weights in (prefer, penalise):
            for kind, w in weights.items():
                hit = (intent == name) & (F.coalesce(record_type, F.lit("")).eqNullSafe(F.lit(kind)) | F.coalesce(source_type, F.lit("")).eqNullSafe(F.lit(kind)))
                out = out * F.when(hit, w).otherwise(1.0)
    return out if quality is None else out * F.coalesce(F.lit(0.55) + 0.45 * quality, F.lit(1.0))


def rerank(ranked: DataFrame, prior: Column, keep: int = 24, floor: float = 0.12) -> DataFrame:
    """Rows whose prior exceeds the floor by score times prior, at most ``keep`` per query."""
    scored = ranked.withColumn("prior", F.round(prior, 6)).withColumn("routed", F.round(F.col("score") * F.col("prior"), 4)).where(F.col("prior") > floor)
    order = W.partitionBy("query").orderBy(F.desc("routed"), "doc")
    return scored.withColumn("routed_rank", F.row_number().over(order)).where(F.col("routed_rank") <= keep)


def cohesion(ranked: DataFrame, names: DataFrame, questions: DataFrame, boost: float = 4.0, dominance: float = 1.5) -> DataFrame:
    """Per query the dominant document: scores summed by document, plus ``boost`` per query word in its name.

    ranked(query, doc, score, document), names(document, name_tokens), questions(query, terms).  Returns query, document,
    total, name_hits, ratio to the runner-up (null without one) and dominant.
    """
    hits = F.size(F.array_intersect("name_tokens", "terms"))
    per = ranked.groupBy("query", "document").agg(F.sum("score").alias("score"))
    scored = per.join(names, "document").join(questions, "query").select("query", "document", hits.alias("name_hits"), F.round(F.col("score") + boost * hits, 6).alias("total"))
    order = W.partitionBy("query").orderBy(F.desc("total"), "document")
    two = scored.withColumns({"r": F.row_number().over(order), "next": F.lead("total").over(order)}).where("r = 1")
    return two.select("query", "document", "total", "name_hits", F.round(F.try_divide("total", "next"), 4).alias("ratio"), F.coalesce(F.col("total") >= dominance * F.col("next"), F.lit(True)).alias("dominant"))


def confidence(signals: dict[str, Column], empty: Column) -> tuple[Column, Column]:
    """(percent, band): weighted geometric mean of the signals, each at least the floor; 0 where there is no evidence."""
    total = F.lit(0.0)
    for name, w in L.CONFIDENCE.items():
        total = total + w * F.log(F.greatest(F.lit(L.CONFIDENCE_FLOOR), F.least(F.lit(1.0), signals[name])))
    percent = F.when(empty, 0.0).otherwise(F.round(100 * F.exp(total), 2))
    return percent, F.when(percent >= 70, "high").when(percent >= 45, "moderate").when(percent >= 25, "low").otherwise("insufficient")


def caveats(signals: dict[str, Column], empty: Column, intent: Column) -> Column:
    """What to be told beside a confidence: an array in fixed order."""
    rules = [
        (empty, "No supporting passage passed the evidence filters."), (signals["coverage"] < 0.4, "The answer does not cover most of the terms in the question."),
        (signals["consensus"] < 0.3, "Supported by a single document — no independent corroboration."), (signals["agreement"] < 0.2, "Lexical and semantic retrieval disagreed on the best evidence."),
        (signals["quality"] < 0.45, "Supporting text is partly extraction debris (tables, headers)."), (intent == L.GENERAL[0], "Question intent was ambiguous, so evidence routing was not applied."),
    ]
    return F.array_compact(F.array(*[F.when(test, F.lit(said)) for test, said in rules]))


def plain_verdict(percent: Column, signals: dict[str, Column]) -> Column:
    """One plain sentence for a confidence; signals of 0.6 or more count as strong."""
    strong = sum(((c >= 0.6).cast("int") for c in signals.values()), F.lit(0))
    return (
        F.when(percent >= 70, "Strong answer. The evidence was clear, consistent, and covered what you asked.")
        .when(percent >= 45, F.concat(F.lit("Reasonable answer, with caveats. "), strong.cast("string"), F.lit(f" of {len(signals)} quality checks came back strong — the notes below say which ones did not.")))
        .when(percent >= 25, "Weak answer. Read the supporting passages before relying on this.")
        .otherwise("The documentation does not appear to answer this. Treat what is shown as related context only."))


def rare_terms(queries: DataFrame, terms: DataFrame, documents: int, variants: DataFrame | None = None, fraction: float = 0.35, stop: list[str] = L.CONTENT_STOP) -> DataFrame:
    """(query, rare): whether a query(query, term) has a term that fewer than ``fraction`` of the documents hold.

    A term of the index is judged by its own count; one that is not, by the rarest of its variants(term, variant).
    """
    asked = queries.select("query", "term").distinct()
    content = asked.where(~F.col("term").isin(*stop))
    known = content.join(terms.select("term", "df"), "term", "left")
    own = known.where("df IS NOT NULL").select("query", "df")
    if variants is not None:
        other = known.where("df IS NULL").select("query", "term").join(variants.select("term", "variant"), "term").join(terms.select(F.col("term").alias("variant"), "df"), "variant").select("query", "df")
        own = own.unionByName(other)
    rare = own.groupBy("query").agg(F.max((F.col("df") < fraction * documents).cast("int")).alias("rare"))
    return asked.select("query").distinct().join(rare, "query", "left").select("query", (F.coalesce("rare", F.lit(0)) == 1).alias("rare"))


def cohered(ranked: DataFrame, questions: DataFrame, rare: DataFrame, boost: float = 4.0, dominance: float = 1.5, confident: float = 1.3, most: int = 8) -> DataFrame:
    """Hits of the documents an answer should rest on, with the figures of that choice.

    ranked(query, doc, rank, score, document, name_tokens, furniture), questions(query, terms), rare(query, rare).  Furniture is left
    out where two other hits remain.  Documents are ordered by query words in their name, then by summed score plus ``boost`` a
    word.  The first stays alone if its name has more of the words than the second's, or without such words if it outweighs it by
    ``dominance``; else both stay, with ``most`` hits.  Returns query, doc, place, document, dominant, distinctness, confident, confidence.
    """
    whole = W.partitionBy("query")
    sound = ranked.withColumn("others", F.count_if(~F.col("furniture")).over(whole)).where((F.col("others") < 2) | ~F.col("furniture"))
    ends = sound.withColumn("place", F.row_number().over(whole.orderBy(F.desc("score"), "doc")))
    hits = F.size(F.array_intersect(F.first("name_tokens"), F.first("terms")))
    per = ends.join(questions, "query").groupBy("query", "document").agg(F.sum("score").alias("sum"), hits.alias("named"))
    order = whole.orderBy(F.desc("named"), F.desc("total"), "document")
    scored = per.withColumn("total", F.round(F.col("sum") + boost * F.col("named"), 6)).withColumns({"r": F.row_number().over(order), "next_named": F.lead("named").over(order), "next": F.lead("total").over(order)})
    lead = scored.where("r = 1").select("query", F.col("document").alias("dominant"), F.col("named").alias("top_named"), (
        (F.col("named") > F.coalesce("next_named", F.lit(0))) | ((F.col("named") == 0) & (F.coalesce("next", F.lit(0.0)) * dominance <= F.col("total")))).alias("alone"))
    kept = scored.where("r <= 2").join(lead, "query").where("r = 1 OR NOT alone").select("query", "document", "dominant", "top_named")
    of = ends.where(F.col("place") <= 10).groupBy("query").agg(F.max_by("score", "place").alias("tail"))
    out = ends.join(kept, ["query", "document"]).join(of, "query").withColumn("place", F.row_number().over(whole.orderBy(F.desc("score"), "doc"))).where(F.col("place") <= most)
    distinct = F.round(F.first("score").over(whole.orderBy("place")) / F.greatest("tail", F.lit(1e-4)), 4)
    return out.withColumn("distinctness", distinct).join(rare, "query").select(
        "query", "doc", "place", "document", "dominant", "distinctness", ((F.col("top_named") > 0) | (F.col("rare") & (F.col("distinctness") >= confident))).alias("confident"),
        F.round(F.least(F.lit(1.0), F.greatest(F.col("distinctness") / 4, F.when(F.col("top_named") > 0, 0.75).otherwise(0.0))), 4).alias("confidence"))


def retried(first: DataFrame, bank: DataFrame, second: DataFrame, strong: float = 0.7, rescue: float = 0.45, low: float = 45.0) -> DataFrame:
    """(query, asked, percent): which question is answered in the end.

    first(query, percent) the question as asked, bank(query, entry, similarity) the most alike known question, second(entry,
    percent) the known questions' confidences.  A similarity of ``strong`` replaces the question; one of ``rescue`` does if the
    question itself stays below ``low`` percent and the known one does not.
    """
    met = first.join(bank, "query", "left").join(second.select("entry", F.col("percent").alias("known")), "entry", "left")
    takes = F.coalesce((F.col("similarity") >= strong) | ((F.col("percent") < low) & (F.col("similarity") >= rescue) & (F.col("known") >= low)), F.lit(False)) & F.col("known").isNotNull()
    return met.select("query", F.when(takes, F.col("entry")).alias("asked"), F.when(takes, F.col("known")).otherwise(F.col("percent")).alias("percent"))


def match_bank(asked: DataFrame, bank: DataFrame) -> DataFrame:
    """asked(name) and bank(entry, text): for each name the entry of greatest cosine of token sets, first on ties.

    Sets meet on shared tokens, so unrelated pairs are never formed.
    """
    a = asked.select("name", F.array_distinct(content_tokens("name")).alias("ta")).where(F.size("ta") > 0)
    b = bank.select("entry", F.array_distinct(content_tokens("text")).alias("tb"))
    left, right = a.select("name", F.size("ta").alias("na"), F.explode("ta").alias("t")), b.select("entry", F.size("tb").alias("nb"), F.explode("tb").alias("t"))
    shared = left.join(right, "t").groupBy("name", "entry", "na", "nb").agg(F.count("*").alias("k"))
    scored = shared.select("name", "entry", F.round(F.col("k") / F.sqrt(F.col("na") * F.col("nb")), 6).alias("similarity"))
    return scored.groupBy("name").agg(F.min_by(F.struct("entry", "similarity"), F.struct(-F.col("similarity"), F.col("entry"))).alias("x")).select("name", "x.entry", "x.similarity")


def suggest(probes: DataFrame, names: DataFrame, most: int = 6) -> DataFrame:
    """probes(probe) against names(id, name): prefix, then contained, then all words present; best ``most`` per probe.

    Probes are a typed handful, met with every name in one broadcast pass.
    """
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    q, n = F.col("q"), F.col("n")
    at = F.instr(n, q)
    parts = F.split(q, " ")
    score = F.when(n.startswith(q), 100 - 0.01 * F.length(n)).when(at > 0, 80 - 0.05 * (at - 1)).when(F.forall(parts, lambda w: n.contains(w)), 60 + F.size(parts).cast("double"))
    met = names.select("id", norm("name").alias("n")).crossJoin(F.broadcast(probes.select("probe", norm("probe").alias("q")).where("q <> ''")))  # a few typed probes
    hits = met.select("probe", "id", F.round(score, 4).alias("score")).where("score IS NOT NULL")
    order = W.partitionBy("probe").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def subsequence_score(query: str, name: str) -> float:
    """1 / (1 + gaps per query character) if the query's characters occur in order, else 0."""
    at, gaps = -1, 0
    for c in query:
        found = name.find(c, at + 1)
        if found < 0:
            return 0.0
        gaps += found - at - 1 if at >= 0 else 0
        at = found
    return 1 / (1 + gaps / max(len(query), 1))


def fuzzy_suggest(probes: list[str], names: DataFrame, floor: float = 0.35, most: int = 6) -> DataFrame:
    """(probe, id, score, rank): subsequence matches above the floor, scored in Arrow batches."""
    asked = [(p, re.sub("[^a-z0-9]+", "", p.lower())) for p in probes]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, i, round(30 * s, 4)) for i, n in zip(b["id"], b["name"]) for p, q in asked if q and n and (s := subsequence_score(q, n.lower())) > floor]
            yield pd.DataFrame(rows, columns=["probe", "id", "score"])

    hits = names.select("id", "name").mapInPandas(run, f"probe string, id {names.schema['id'].dataType.simpleString()}, score double")
    order = W.partitionBy("probe").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def sentence_relevance(candidates: DataFrame) -> DataFrame:
    """Scores candidates(query, terms, focus, intent, doc, score, pos, total, sentence, quality): relevance and final.

    Coverage of the question's terms, semantic similarity, answer cues, focus, quality and position, less for sentences on a rival of the
    analyte asked about and for regulatory comparisons; final is times the prior.  Sentences that match nothing are dropped.  Columns
    semantic and prior are 0 and 1 where candidates has none.
    """
    semantic = F.col("semantic") if "semantic" in candidates.columns else F.lit(0.0)
    prior = F.col("prior") if "prior" in candidates.columns else F.lit(1.0)
    meta = (F.col("intent") != "REGULATORY") & F.col("sentence").rlike(L.META_REGULATORY)
    asked = F.filter("focus", lambda f: F.arrays_overlap(F.array(f), F.array(*map(F.lit, L.RIVALS))))
    present = F.filter(F.array(*map(F.lit, L.RIVALS)), lambda r: F.lower("sentence").contains(r))
    rival = (F.size(asked) > 0) & (F.size(present) > 0) & ~F.exists(present, lambda p: F.exists(asked, lambda a: a.contains(p) | p.contains(a)))
    own = F.array_distinct(tokens("sentence"))
    cue = F.lit(0.0)
    for name, _, cues, *_ in L.INTENTS:
        best = F.greatest(F.lit(0.0), F.lit(0.0), *[F.when(F.col("sentence").rlike(L.cue(p)), w).otherwise(0.0) for p, w in cues])
        cue = F.when(F.col("intent") == name, best).otherwise(cue)
    candidates = candidates.withColumn("own", own)
    own = F.col("own")
    cover = F.when(F.size("terms") > 0, F.size(F.array_intersect("terms", own)) / F.size("terms")).otherwise(0.0)
    candidates = candidates.withColumns({"cover": cover, "cue": cue, "weighed": F.when(meta, 0.55).otherwise(1.0) * F.when(rival, 0.15).otherwise(1.0)})
    cover, cue, weighed = F.col("cover"), F.col("cue"), F.col("weighed")
    focus = F.when(F.size("focus") > 0, F.size(F.array_intersect("focus", own)) / F.size("focus")).otherwise(0.5)
    place = 1 - F.least(F.lit(1.0), F.col("pos") / F.greatest("total", F.lit(1))) * 0.35
    relevance = weighed * (0.26 * cover + 0.22 * semantic + 0.18 * cue * F.when(meta, 0.25).otherwise(1.0) + 0.16 * focus + 0.12 * F.col("quality") + 0.06 * place)
    final = relevance * prior * (0.85 + 0.15 * F.least(F.lit(1.0), 8 * F.col("score") / F.greatest(F.max("score").over(W.partitionBy("query")), F.lit(1e-9)) / 8))
    return candidates.where((cover > 0) | (cue > 0) | (semantic >= 0.2)).select("query", "doc", "pos", "sentence", "own", F.round(relevance, 6).alias("relevance"), F.round(final, 6).alias("final"))


def answerable(sentence: Column | str, kind: Column, intent: Column) -> Column:
    """Whether a sentence may answer: prose, or a table where the intent admits it, that is no lead-in to a lost list and not about the document."""
    s = F.col(sentence) if isinstance(sentence, str) else sentence
    about = s.rlike(L.NAVIGATION) | (s.rlike(L.NAVIGATION_VERB) & s.rlike(L.NAVIGATION_NOUN))
    return ((kind == "prose") | ((kind == "table") & intent.isin(*L.TABLE_INTENTS))) & ~s.rlike(L.LEAD_IN) & ~about


def select_diverse(scored: DataFrame, picks: int = 5, chars: int = 900, trade: float = 0.72, redundancy: float = 0.62, pool: int = 60) -> DataFrame:
    """Per query at most ``picks`` sentences by maximal marginal relevance from the best ``pool``.

    A candidate more alike a pick than ``redundancy`` is dropped; selection stops once ``chars`` would be passed and two stand.
    """
    order = W.partitionBy("query").orderBy(F.desc("final"), "doc", "pos")
    top = scored.withColumn("r", F.row_number().over(order)).where(F.col("r") <= pool)

    def alike(a: set, b: set) -> float:
        k = len(a & b)
        return max(k / len(a | b), 0.95 * k / min(len(a), len(b))) if a and b else 0.0

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        rest = [(r.final, -r.r, r.doc, r.pos, r.sentence, set(r.own)) for r in pdf.itertuples()]
        out, length = [], 0
        while rest and len(out) < picks:
            seen = {id(c): max((alike(c[5], p[5]) for p in out), default=0.0) for c in rest}
            rest = [c for c in rest if seen[id(c)] <= redundancy]
            if not rest:
                break
            best = max(rest, key=lambda c: (trade * c[0] - (1 - trade) * seen[id(c)], c[1]))
            if length + len(best[4]) > chars and len(out) >= 2:
                break
            rest.remove(best)
            out.append(best)
            length += len(best[4])
        return pd.DataFrame([(pdf["query"].iloc[0], i + 1, c[2], c[3], c[4], c[0]) for i, c in enumerate(out)], columns=["query", "pick", "doc", "pos", "sentence", "final"])

    kinds = {f.name: f.dataType.simpleString() for f in scored.schema}
    return top.groupBy("query").applyInPandas(choose, f"query {kinds['query']}, pick int, doc {kinds['doc']}, pos int, sentence string, final double")  # at most ``pool`` rows a group


def composed(picks: DataFrame) -> DataFrame:
    """(query, answer, citations): picked sentences as one reply, each with the number of its source in order of appearance."""
    number = F.dense_rank().over(W.partitionBy("query").orderBy("first"))
    placed = picks.withColumn("first", F.min("pick").over(W.partitionBy("query", "doc"))).withColumn("n", number)
    tidy = F.regexp_replace(F.regexp_replace(F.trim("sentence"), r"\s+", " "), r"\s+([.,;:])", "$1")
    ended = F.when(tidy.rlike("[.!?]$"), tidy).otherwise(F.concat(tidy, F.lit(".")))
    line = F.concat(F.upper(F.substring(ended, 1, 1)), F.substring(ended, F.lit(2), F.length(ended)), F.lit(" ["), F.col("n").cast("string"), F.lit("]"))
    return placed.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pick", line.alias("line")))), lambda s: s["line"]), " ").alias("answer"), F.countDistinct("doc").alias("citations"))
