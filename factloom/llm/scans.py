"""Noise in text from scanned pages (problem 5).

Two averaged perceptrons are trained on the whole corpus itself, tasks reducing it to distinct examples with counts, and shipped to tasks:

* a line tagger that marks running headers and page numbers, from the line's shape, its place
  among its neighbours, the page the paragraph stands on and how many paragraphs of the document
  repeat the line;
* a character editor that rewrites a word by keep, replace, delete and insert operations and
  decides on the line-join operation at each break mark.

The editor learns from words of the corpus lexicon and from their images under a channel of
recognition errors; known confusions are extended by those the corpus shows between its rare and its common words.  The lexicon holds every word above a fixed share of all words, so its
size is bounded; counting it is one map-side combined aggregation.
"""

from __future__ import annotations

import json
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import stored

# What a recognised string may stand for, before the corpus has been looked at.
MISREAD = {
    "c": ["e"], "f": ["t"], "!": ["i", "l"], "0": ["o"], "@": ["a"], "1": ["l", "i"], "5": ["s"], "ii": ["u"],
    "rn": ["m"], "b": ["h"], "9": ["g"], "m": ["in", "rn"], "vv": ["w"], "h": ["li"], "6": ["b"], "8": ["b"],
    "cl": ["d"], "d": ["cl"], "$": ["s"], "|": ["l"], "3": ["e"], "4": ["a"], "7": ["t"], "ni": ["m"],
}
# Characters that break a word at a line end.
BREAKS = "-¬‐­"
# Forms of a page number, alone or behind a header; each holds the number.
PAGE_ALONE = re.compile(r"^(?:-\s*(\d+)\s*-|\[\s*(\d+)\s*\]|(\d+)|p\.?\s*(\d+)|page\s*(\d+)(?:\s*(?:of|/)\s*\d+)?|(\d+)\s*\|\s*p\s*a\s*g\s*e|\d+-(\d+))$", re.I)
PAGE_BEHIND = re.compile(r"(?:\s*\|\s*|\s+(?:page\s+|p\.\s*)?)(\d+)$", re.I)

WORD = r"[^\s,;:()\"“”\[\]{}<>]+"
_TRIM = ".,;:()\"'“”[]{}<>?"


class Perceptron:
    """Averaged perceptron over string features, choosing among candidates."""

    def __init__(self) -> None:
        self.w: dict[str, float] = {}

    def score(self, features: list[str]) -> float:
        get = self.w.get
        return sum(get(f, 0.0) for f in features)

    def fit(self, examples: list[tuple[list[list[str]], int]], rounds: int = 5, seed: int = 7, times: list[int] | None = None) -> Perceptron:
        """examples: candidate feature lists and the index of the right one (ties go to the first).

        ``times`` says how often each example occurs (else once); a round shows it that often, in as many visits as the
        number has binary digits.
        """
        total: dict[str, float] = defaultdict(float)
        since: dict[str, int] = defaultdict(int)
        parts = [(k, n, n.bit_length()) for k, n in enumerate(times or [1] * len(examples))]
        step, order = 0, [(k, (n + j) // d) for k, n, d in parts for j in range(d)]
        for _ in range(rounds):
            random.Random(seed).shuffle(order)
            for k, left in order:
                candidates, gold = examples[k]
                while left:
                    step, left = step + 1, left - 1
                    best = max(range(len(candidates)), key=lambda i: (self.score(candidates[i]), -i))
                    if best == gold:  # nor do its further showings change anything
                        step += left
                        break
                    for i, by in ((gold, 1.0), (best, -1.0)):
                        for f in candidates[i]:
                            total[f] += (step - since[f]) * self.w.get(f, 0.0)
                            since[f] = step
                            self.w[f] = self.w.get(f, 0.0) + by
        self.w = {f: (total[f] + (step - since[f]) * w) / max(step, 1) for f, w in self.w.items()}
        return self


def _bucket(n: float) -> int:
    return min(int(n).bit_length(), 16)


def learned_channel(common: dict[str, int], rare: dict[str, int], ratio: int = 50, least: int = 4) -> dict[str, list[str]]:
    """Confusions that the corpus itself shows: what stands in rare words where a far commoner word has something else.

    A rare word that differs from a common one in a single run of one or two characters on each side votes for
    that confusion once; a confusion needs ``least`` such words whose lengths, places or neighbours differ.  Runs
    at the very end of a word do not count, as they are inflections.
    """
    holes: dict[tuple[str, str], list[tuple[str, str]]] = defaultdict(list)
    for w in common:
        for i in range(len(w)):
            for n in (1, 2):
                if i + n < len(w) and w[i: i + n].isalpha():
                    holes[w[:i], w[i + n:]].append((w, w[i: i + n]))
    votes: dict[tuple[str, str], set[str]] = defaultdict(set)
    for r, k in rare.items():
        found = set()
        for i in range(len(r)):
            for n in (1, 2):
                for w, true in holes.get((r[:i], r[i + n:]), ()) if i + n < len(r) else ():
                    seen = r[i: i + n]
                    if common[w] >= ratio * k and seen[0] != true[0] and seen[-1] != true[-1]:
                        found.add((seen, true, w))
        if len({w for _, _, w in found}) == 1:  # only one reading
            for seen, true, w in found:
                votes[seen, true].add(w)
    out: dict[str, list[str]] = defaultdict(list)
    for (seen, true), words in sorted(votes.items()):
        if len(words) >= least:
            out[seen].append(true)
    return dict(out)


class Editor:
    """Character editor over a lexicon of word counts and a channel of recognition errors."""

    def __init__(self, lexicon: dict[str, int], channel: dict[str, list[str]] | None = None):
        self.lexicon = lexicon
        more = channel or {}
        self.channel = {s: [*MISREAD.get(s, ()), *(t for t in more.get(s, ()) if t not in MISREAD.get(s, ()))] for s in {*MISREAD, *more}}
        self.model, self.joiner = Perceptron(), Perceptron()
        self.starts = {w[:i] for w in lexicon for i in range(1, len(w) + 1)}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("starts", "word", "edit")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.starts = {w[:i] for w in self.lexicon for i in range(1, len(w) + 1)}

    def candidates(self, word: str, most: int = 2) -> dict[str, tuple[str, ...]]:
        """All lexicon words within ``most`` operations of the channel, with the operations; the word itself first.

        The lexicon's word starts guide the search, so a word of any length is searched to its end.
        """
        out: dict[str, tuple[str, ...]] = {word: ()}
        states: list[tuple[int, str, tuple[str, ...]]] = [(0, "", ())]
        while states:
            i, done, ops = states.pop()
            if i == len(word):
                if ops and done in self.lexicon and len(ops) < len(out.get(done, (0,) * 9)) and done != word:
                    out[done] = ops
                continue
            if (kept := done + word[i]) in self.starts:
                states.append((i + 1, kept, ops))
            if len(ops) < most:
                for n in (1, 2):
                    seen = word[i: i + n]
                    for true in self.channel.get(seen, ()) if len(seen) == n else ():
                        if (edited := done + true) in self.starts:
                            states.append((i + n, edited, (*ops, f"{seen}>{true}")))
        return out

    def features(self, word: str, result: str, ops: tuple[str, ...]) -> list[str]:
        had, has = self.lexicon.get(word, 0), self.lexicon.get(result, 0)
        odd = any(not c.isalpha() for c in word)
        if not ops:
            return [f"keep:known{_bucket(had) if had else -1}", f"keep:odd{odd}", f"keep:len{min(len(word), 6)}"]
        kinds = ["delete" if len(o.split(">")[0]) > len(o.split(">")[1]) else "insert" if len(o.split(">")[0]) < len(o.split(">")[1]) else "replace" for o in ops]
        ratio = _bucket(has / (had + 0.5))
        return [*[f"op:{o}" for o in ops], *[f"kind:{k}" for k in kinds], f"n{len(ops)}", f"ratio{ratio}", f"known{had > 0}:ratio{ratio}",
                f"ratio{ratio}:odd{odd}", f"len{min(len(word), 6)}:n{len(ops)}", f"first{ops[0][0] == word[0]}"]

    def kept(self, word: str) -> list[list[str]] | None:
        """The example that keeps a word: its candidates' features, its own first; None where there is nothing to choose.

        A rare word that is the image of a far commoner one is left out: its label is unknown.
        """
        c = self.candidates(word)
        if len(c) == 1 or any(self.lexicon.get(x, 0) > 20 * (self.lexicon.get(word, 0) + 1) for x in c if x != word):
            return None
        return [self.features(word, x, o) for x, o in c.items()]

    def train(self, keep: list[str], seen: dict[str, int] | None = None, seed: int = 7) -> Editor:
        """Learns to keep ``keep`` and lexicon words, to restore images of lexicon words, and which line ends to join.

        ``seen`` has further examples of kept words (see ``kept``) as JSON, with their number of words.
        """
        rnd = random.Random(seed)
        back: dict[str, list[str]] = defaultdict(list)
        for seen_as, true in self.channel.items():
            for t in true:
                back[t].append(seen_as)
        shown = sorted(self.lexicon, key=lambda w: (-self.lexicon[w], w))
        examples = [(x, 0) for w in [*shown, *keep] if (x := self.kept(w))]
        counted = sorted((seen or {}).items())
        for w in shown:
            if len(w) < 3 or not w.isalpha():
                continue
            sites = [(i, n, s) for n in (1, 2) for i in range(len(w) - n + 1) for s in back.get(w[i: i + n], ())]
            for i, n, s in rnd.sample(sites, min(3, len(sites))):
                image = w[:i] + s + w[i + n:]
                c = self.candidates(image)
                # an image that is a word of its own is that word unless it is far rarer
                right = w if self.lexicon.get(image, 0) * 20 <= self.lexicon[w] else image
                if right in c and len(c) > 1:
                    examples.append(([self.features(image, x, o) for x, o in c.items()], list(c).index(right)))
        self.model.fit([*examples, *((json.loads(x), 0) for x, _ in counted)], times=[1] * len(examples) + [n for _, n in counted])
        self._train_joins(shown, rnd)
        return self

    def _train_joins(self, shown: list[str], rnd: random.Random) -> None:
        """Broken words are joined, compounds broken behind their own hyphen keep it; half of each as if not seen before."""
        examples = []
        for w in shown:
            if w.isalpha() and len(w) > 4:
                at = rnd.randrange(2, len(w) - 1)
                pair, gold = (w[:at], w[at:]), 1
            elif re.fullmatch(r"[a-z]{2,}-[a-z]{2,}", w):
                pair, gold = tuple(w.split("-")), 0
            else:
                continue
            for unseen in (False, True):
                if not (unseen and gold == 0):
                    examples.append(([[], self.join_features(*pair, unseen=w if unseen else None)], gold))
        self.joiner.fit(examples)

    def join_features(self, left: str, right: str, unseen: str | None = None) -> list[str]:
        known = lambda w: 0 if w == unseen else self.lexicon.get(w, 0)
        plain, compound = known(left + right), known(f"{left}-{right}")
        if plain == compound == 0 and unseen is None:
            plain, compound = known(self.word(left + right)), known(self.word(f"{left}-{right}"))
        gap = max(-4, min(4, _bucket(2 * plain) - _bucket(2 * compound)))
        return ["bias", f"gap{gap}", f"seen{plain > 0}{compound > 0}", f"seen{plain > 0}{compound > 0}:gap{gap}"]

    def word(self, word: str) -> str:
        """The edited word, in lower case; the word itself where the editor keeps every character."""
        c = self.candidates(word)
        if len(c) == 1:
            return word
        best, top = word, self.model.score(self.features(word, word, ()))
        for x, ops in c.items():
            if ops and (s := self.model.score(self.features(word, x, ops))) > top:
                best, top = x, s
        return best

    def joins(self, left: str, right: str) -> bool:
        """The line-join operation: whether the break mark between two halves is taken out."""
        if "-" in right and not any(w in self.lexicon for w in (left + right, f"{left}-{right}", self.word(left + right), self.word(f"{left}-{right}"))):
            return self.joins(left, right.split("-")[0])  # a longer compound: its first piece decides
        return self.joiner.score(self.join_features(left, right)) > 0


def last_word(line: str) -> str:
    return (line.lower().split() or [""])[-1].strip(_TRIM)


def sentence_inside(line: str) -> bool:
    """Whether a sentence ends within the line, or a clause runs on from the line before."""
    return bool(re.search(r"(?<![\w-])[a-z][\w-]*[.,;:]\s", line))


def line_features(line: str, before: str, after: str, page: int | None, head: str, repeats: int, number: int | None, lexicon: dict[str, int], width: int) -> list[str]:
    """Shape, neighbourhood, page position and repetition of one line."""
    words = re.findall(r"[A-Za-z][^\s]*", line)
    upper = sum(w[0].isupper() for w in words)
    common = sum(w.lower().strip(_TRIM) in lexicon and w[0].islower() for w in words)
    title = -1 if not words else 4 * upper // len(words)
    ends = bool(re.search(r"[.,;:!?]$", line))
    named = len(set(line.lower().split()) & set(head.lower().split())) if head else 0
    return [
        f"title{title}", f"title{title}:ends{ends}", f"ends{ends}", f"lower{min(common, 4)}", f"words{min(len(words), 6)}", f"repeats{min(repeats, 3)}",
        f"repeats{min(repeats, 3)}:title{title}", f"named{min(named, 3)}", f"broken{bool(before) and not re.search(r'[.!?:]$', before)}:{bool(after) and after[0].islower()}",
        f"inner{sentence_inside(line)}", f"starts{line[0].islower()}", f"mark{line[-1] in BREAKS}",
        f"page{number is not None and number == page}", f"digit{bool(re.search(r'[0-9]', line))}:words{min(len(words), 2)}", f"short{4 * len(line) // max(width, 1)}",
    ]


def _number(line: str, page: int | None) -> int | None:
    m = PAGE_ALONE.match(line)
    return next((int(g[:9]) for g in m.groups() if g), None) if m else None


class Repairer:
    """Both models, applied to one paragraph at a time."""

    def __init__(self, editor: Editor, tagger: Perceptron, numbered: dict[str, float] | None = None):
        self.editor, self.tagger, self.numbered = editor, tagger, numbered or {}

    def tags(self, lines: list[str], page: int | None, head: str, repeats: dict[int, int]) -> list[str]:
        """Per line: body, header, header+number or number."""
        if len(lines) < 2:
            return ["body"] * len(lines)
        flat = [re.sub(r"\s+", " ", x).strip() for x in lines]
        width, out = max(map(len, flat)), []
        for i, line in enumerate(flat):
            if not line:
                out.append("body")
                continue
            number = _number(line, page)
            if number is not None:
                out.append("number" if number == page else "body")
                continue
            before = next((x for x in reversed(flat[:i]) if x), "")
            after = next((x for x in flat[i + 1:] if x), "")
            f = line_features(line, before, after, page, head, repeats.get(i, 0), number, self.editor.lexicon, width)
            if self.tagger.score(f) <= 0 or sentence_inside(line):
                out.append("body")
                continue
            m = PAGE_BEHIND.search(line)
            # a number behind a word that mostly carries other numbers than the page's belongs to the header
            behind = m and int(m.group(1)[:9]) == page and self.numbered.get(self.editor.word(last_word(line[: m.start()])), 1.0) >= 0.5
            out.append("header+number" if behind else "header")
        return out

    def paragraph(self, text: str, page: int | None, head: str, repeats: dict[int, int]) -> tuple[str, set[str]]:
        """The continuous paragraph and the kinds of noise found."""
        noise: set[str] = set()
        lines = text.split("\n")
        tags = self.tags(lines, page, head, repeats)
        if any(t != "body" for t in tags):
            if any(t.startswith("header") for t in tags):
                noise.add("running_header")
            if any(t.endswith("number") for t in tags):
                noise.add("page_number")
            # the blank lines that set furniture off go with it
            gone = {i for i, t in enumerate(tags) if t != "body"}
            lines = [x for i, x in enumerate(lines) if i not in gone and (x.strip() or not ({i - 1, i + 1} & gone))]
        edit = self.edit
        blocks, current = [], ""
        for line in lines:
            s = line.strip() if len(lines) > 1 else line
            if not s:
                if current:
                    blocks.append(current)
                current = ""
                continue
            if current and current[-1] in BREAKS and s[0].isalpha() and len(current) > 1 and current[-2].isalnum():
                left = re.search(r"[^\s,;:()]*$", current[:-1]).group(0)
                right = re.match(r"[^\s,;:().]*", s).group(0)
                if self.editor.joins(left.lower(), right.lower().strip(_TRIM)):
                    noise.add("hyphenation")
                    current = current[:-1] + s
                else:
                    current = current[:-1] + "-" + s
            elif current and (s[0] in "•|" or "|" in s or re.match(r"(?:[-*]|\d+[.)])\s", s)):
                blocks.append(current)
                current = s
            else:
                current = f"{current} {s}" if current else s
        if current:
            blocks.append(current)
        fixed = []
        for b in blocks:
            after = re.sub(r"\S+", lambda m: edit(m.group(0)), b)
            if after != b:
                noise.add("misread")
            fixed.append(after)
        return "\n".join(fixed), noise

    def edit(self, token: str) -> str:
        """A token with its outer punctuation and capital kept."""
        core = token.strip(_TRIM)
        if len(core) < 2 or not any(c.isalpha() or c in "!@$|" for c in core):
            return token
        low = core.lower()
        new = self.editor.word(low)
        if new == low and core[-1:] == "!" and low[:-1] in self.editor.lexicon:
            return token
        if new == low:
            for sep in "-/":
                if sep in low[1:-1]:
                    parts = [self.editor.word(p) if len(p) > 2 else p for p in low.split(sep)]
                    new = sep.join(parts)
                    if new != low:
                        break
        if new == low:
            return token
        if core.isupper() and len(core) > 1:
            new = new.upper()
        elif core[0].isupper() or (not core[0].isalpha() and core[1:2].isupper()):
            new = new[0].upper() + new[1:]
        return token.replace(core, new, 1)


def corpus_channel(counts: DataFrame, floor: float, ratio: int = 50, least: int = 4) -> dict[str, list[str]]:
    """learned_channel over all words of counts(w, n): common ones from ``floor`` on, rare ones of more than three letters below."""
    # words travel as 64-bit hashes, and only rare words as long as a common one, give or take a letter, can differ from it in one run
    holes = F.expr("""explode(flatten(transform(filter(array(1, 2), k -> length(w) > k), k -> transform(sequence(1, length(w) - k), i ->
        struct(xxhash64(substring(w, 1, i - 1)) AS before, xxhash64(substring(w, i + k)) AS after, substring(w, i, k) AS run)))))""")
    of = lambda df, run: df.select(F.xxhash64("w").alias(f"{run}_w"), F.col("n").alias(f"{run}_n"), holes.alias("h")).select(f"{run}_w", f"{run}_n", "h.before", "h.after", F.col("h.run").alias(run))
    frequent = counts.where(F.col("n") >= floor)
    sizes = sorted({r[0] + d for r in frequent.select(F.length("w")).distinct().collect() for d in (-1, 0, 1)})
    common = of(frequent, "true").where(F.col("true").rlike(r"^\p{L}+$"))
    rare = of(counts.where((F.col("n") < floor) & (F.length("w") > 3) & F.length("w").isin(sizes)), "seen")
    ends = lambda c, at: F.substring(c, at, 1)
    found = rare.join(common, ["before", "after"]).where((F.col("true_n") >= ratio * F.col("seen_n")) & (ends("seen", 1) != ends("true", 1)) & (ends("seen", -1) != ends("true", -1)))
    one = found.groupBy("seen_w").agg(F.min("true_w").alias("w"), F.max("true_w").alias("other"), F.collect_set(F.struct("seen", "true")).alias("x")).where("w = other")  # only one reading
    votes = one.select("w", F.inline("x")).distinct().groupBy("seen", "true").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    out: dict[str, list[str]] = defaultdict(list)
    for r in sorted(votes.collect()):
        out[r["seen"]].append(r["true"])
    return dict(out)


def corpus_lexicon(df: DataFrame, text: str = "text", share: float = 5e-6, least: int = 3) -> tuple[dict[str, int], dict[str, list[str]]]:
    """Counts of words that make up at least ``share`` of all words (at most 1 / share), and the channel that all others show.

    Words broken at a line end count in neither half.
    """
    # matches start at word starts only, and one-line texts are not searched
    whole = F.when(F.col(text).contains("\n"), F.regexp_replace(F.col(text), rf"(?<!\S)\S+[{BREAKS}]\s*\n\s*\S+", " ")).otherwise(F.col(text))
    words = df.select(F.explode(F.regexp_extract_all(F.lower(whole), F.lit(WORD), 0)).alias("w")).select(F.expr("trim(BOTH '.?\\'' FROM w)").alias("w")).where("w <> ''")
    counts = words.groupBy("w").agg(F.count("*").alias("n"))
    counts = stored(counts, "scan-words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    floor = max(least, share * total)
    return {r["w"]: r["n"] for r in counts.where(F.col("n") >= floor).toLocalIterator()}, corpus_channel(counts, floor)


def _prepared(df: DataFrame, item: str, document: str, text: str, page: str, section: str) -> DataFrame:
    """item, t, page, head and repeats: for each line that looks like furniture, how many paragraphs of the document have it."""
    base = df.select(F.col(item).alias("item"), F.col(document).alias("doc"), F.col(page).alias("page"), F.try_element_at(section, F.lit(1)).alias("head"), F.col(text).alias("t")).where("item IS NOT NULL AND t IS NOT NULL")
    flat = F.trim(F.regexp_replace("line", r"\s+", " "))
    words = F.filter(F.split(flat, " "), lambda w: w.rlike("[A-Za-z]"))
    looks = ~flat.rlike(r"[.,;:!?]$") & (F.size(words) > 0) & (2 * F.size(F.filter(words, lambda w: w.rlike("^[A-Z]"))) >= F.size(words))
    cand = (
        base.where(F.col("t").contains("\n")).select("item", "doc", F.posexplode(F.split("t", "\n")).alias("i", "line"))
        .where((F.length(flat) > 0) & looks).select("item", "doc", "i", F.regexp_replace(F.lower(flat), r"(?: \|| page| p\.)? [0-9]+$", "").alias("line")).distinct()
    )
    cand = stored(cand, "scan-lines")
    again = cand.select("doc", "line", "item").distinct().groupBy("doc", "line").agg(F.count("*").cast("int").alias("n"))
    per = cand.join(again, ["doc", "line"]).groupBy("item").agg(F.map_from_entries(F.collect_set(F.struct("i", "n"))).alias("repeats"))  # one paragraph's lines
    return base.drop("doc").join(per, "item", "left")


def line_examples(text: str, page: int | None, head: str, repeats: dict[int, int], lexicon: dict[str, int]) -> Iterator[tuple[list[str], int, tuple[str, bool] | None]]:
    """(features, whether furniture, (last word, whether the page's number follows) of a numbered header) of a text's lines."""
    flat = [re.sub(r"\s+", " ", x).strip() for x in text.split("\n")]
    width = max(map(len, flat))
    for i, line in enumerate(flat):
        number, k = _number(line, page), repeats.get(i, 0)
        words = re.findall(r"[A-Za-z][^\s]*", line)
        lower = sum(w[0].islower() for w in words)
        running = bool(line) and (sentence_inside(line) or line[0].islower() or line[-1] in BREAKS)
        if not line or number is not None or (k == 1 and lower * 2 <= len(words) and not running):
            continue  # furniture that stands once: left for the model to decide
        again = k >= 2 and not running
        of = lambda n: line_features(line, flat[i - 1] if i else "", flat[i + 1] if i + 1 < len(flat) else "", page, head, n, number, lexicon, width)  # noqa: B023, E731
        m = PAGE_BEHIND.search(line) if again and page is not None else None
        yield of(k), int(again), (last_word(line[: m.start()]), int(m.group(1)[:9]) == page) if m else None
        if again:  # the same line as if it stood once
            yield of(1), 1, None


def train_repairer(prepared: DataFrame, lexicon: dict[str, int], channel: dict[str, list[str]]) -> Repairer:
    """Both models from all paragraphs: the editor from the words of those without hard line breaks, the tagger from the lines of the others.

    Tasks turn words and lines into examples and count equal ones; only distinct examples reach the driver.
    """
    sc, broken = prepared.sparkSession.sparkContext, F.col("t").contains("\n")
    editor = Editor(lexicon, channel)
    untrained = sc.broadcast(editor)

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(Counter(json.dumps(x) for w in b["w"] if (x := untrained.value.kept(w))).items(), columns=["x", "n"])

    words = prepared.where(~broken).select(F.explode(F.split(F.lower("t"), r"\s+")).alias("w")).select(F.expr(f"trim(BOTH {_quoted(_TRIM)} FROM w)").alias("w")).where("w <> ''").distinct()
    seen = words.mapInPandas(kept, "x string, n long").groupBy("x").agg(F.sum("n").alias("n"))
    editor.train([], {r["x"]: r["n"] for r in seen.collect()})
    trained = sc.broadcast(editor)

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        word = lru_cache(200_000)(trained.value.word)
        for b in batches:
            counts: Counter = Counter()
            for t, p, h, k in zip(b["t"], b["page"], b["head"], b["repeats"]):
                for f, gold, end in line_examples(t, None if pd.isna(p) else int(p), h or "", dict(k) if k is not None else {}, lexicon=trained.value.lexicon):
                    counts["line", json.dumps(f), gold] += 1
                    if end:
                        counts["end", word(end[0]), int(end[1])] += 1
            yield pd.DataFrame([(*x, n) for x, n in counts.items()], columns=["kind", "x", "gold", "n"])

    found = prepared.where(broken).select("t", "page", "head", "repeats").mapInPandas(lines, "kind string, x string, gold int, n long")
    found = stored(found.groupBy("kind", "x", "gold").agg(F.sum("n").alias("n")), "scan-examples")
    counted = sorted((r["x"], r["gold"], r["n"]) for r in found.where("kind = 'line'").collect())
    tagger = Perceptron().fit([([[], json.loads(x)], gold) for x, gold, _ in counted], times=[n for *_, n in counted])
    ends = found.where("kind = 'end'").groupBy("x").agg((F.sum(F.col("gold") * F.col("n")) / F.sum("n")).alias("share"), F.sum("n").alias("n"))
    return Repairer(editor, tagger, {r["x"]: r["share"] for r in ends.where("n >= 5 AND share < 0.5").collect()})  # the others are taken as 1


def _quoted(chars: str) -> str:
    return "'" + chars.replace("\\", "\\\\").replace("'", "\\'") + "'"


def repaired(df: DataFrame, item: str, document: str, text: str = "text", page: str = "page", section: str = "section_path", share: float = 5e-6) -> DataFrame:
    """(item, text, noise): each paragraph as continuous text, and the kinds of noise found in it.

    noise holds hyphenation, misread, running_header and page_number, sorted; hard line breaks are joined
    but are no noise.  Null texts and null ids give no row, an empty text stays empty; repeated rows give one row;
    a null page matches no page number; empty input gives an empty result; further columns are ignored.  ``share`` bounds the lexicon;
    the models are trained on all paragraphs, and every text is repaired whole.
    """
    prepared = stored(_prepared(df, item, document, text, page, section), "scan-paragraphs")
    model = df.sparkSession.sparkContext.broadcast(train_repairer(prepared, *corpus_lexicon(df, text, share)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        m.editor.word = lru_cache(200_000)(Editor.word.__get__(m.editor))
        m.edit = lru_cache(200_000)(Repairer.edit.__get__(m))
        for b in batches:
            rows = []
            for i, t, p, h, k in zip(b["item"], b["t"], b["page"], b["head"], b["repeats"]):
                fixed, noise = m.paragraph(t, None if pd.isna(p) else int(p), h or "", dict(k) if k is not None else {})
                rows.append((i, fixed, sorted(noise)))
            yield pd.DataFrame(rows, columns=[item, text, "noise"])

    return prepared.mapInPandas(run, f"{item} {df.schema[item].dataType.simpleString()}, {text} string, noise array<string>").distinct()
