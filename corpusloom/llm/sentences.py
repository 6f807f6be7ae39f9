"""Sentence boundaries across languages and scripts (problem 10).

Per language, abbreviations, collocations across a period and frequent sentence starters are learned without supervision
from counts over all documents, by log-likelihood ratios: an abbreviation is a short type that occurs with a final period
far more often than types do, a collocation a pair around a period that is bound, a starter a type that follows sure
boundaries unusually often. Each period is then classified by these statistics and the writing of what follows; signs that
end sentences in other scripts, quotations, ellipses and Thai spaces have rules of their own.

Language: the script of the text decides; texts in Latin script, whatever their languages, are classified by naive Bayes over
words, learned from the column lang of all documents. Single labels are not trusted, only their sum; without labels function
words of four languages vote.

The learned types have no cap: up to MODEL_ROWS of them are broadcast, more are joined to the documents that ask for them.

Blocks: paragraphs, list items and quoted lines end a sentence at their end; heading lines and fenced code hold none.

Defined results: null, empty and blank texts have no sentences; positions are 1-based code points; rows with equal doc_id
and text give equal rows, which are one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.tokenize import text_slices
from corpusloom.session import saved, spread

#: Thresholds of the log-likelihood ratios (published values of the method) and the longest abbreviation in letters.
ABBREVIATION, COLLOCATION, STARTER, LONGEST = 0.3, 7.88, 30.0, 9
#: Least share of a lower-case word's occurrences that begin a block where it is to begin sentences.
LEAD = 0.1
#: Times a type must occur with a period before it can be an abbreviation.
EVIDENCE = 3
#: Learned types up to which they come to the driver and are broadcast; beyond, documents are joined with them.
MODEL_ROWS = 200_000
#: Bounds of the language classifier: most frequent words of each language, languages (most documents first), and documents
#: a label needs.
LANGUAGE_WORDS, LANGUAGES, LABELLED = 3000, 100, 20

_words = {
    "en": "the and of to is in that it with as for on before without".split(),
    "de": "der die das und ist den von mit ein eine nicht auf dem im am bei vom zum zur nach ohne um wie warum er sie siehe".split(),
    "fr": "le la les et est des du une dans que pour sur pas sans après avant pendant sous voir pourquoi".split(),
    "es": "el la los y es de del una en que por con sin tras antes durante véase".split(),
}
_languages = list(_words)
_votes: dict[str, list[str]] = {}
for _name, _list in _words.items():
    for _w in _list:
        _votes.setdefault(_w, []).append(_name)
#: Letters that only one of the Latin languages has.
_letters = {"de": "äöüßÄÖÜ", "fr": "èêçàùœîôâ", "es": "ñ¿¡áíóú"}
#: Blocks of 128 code points of each script: kana, Han, Thai, Arabic, Devanagari, Cyrillic.
_scripts = [("ja", range(0x3000 + 0x80 >> 7, 0x3100 >> 7)), ("zh", range(0x4E00 >> 7, 0xA000 >> 7)), ("th", range(0x0E00 >> 7, 0x0E80 >> 7)), ("ar", range(0x0600 >> 7, 0x0700 >> 7)), ("hi", range(0x0900 >> 7, 0x0980 >> 7)), ("ru", range(0x0400 >> 7, 0x0500 >> 7))]


def script(text: str) -> str | None:
    """The language that the script tells: that of the script that holds a share of the characters; None for others."""
    if not text.isascii():
        units = np.bincount(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32) >> 7, minlength=512)
        for name, at in _scripts:
            found = int(units[list(at)].sum())
            if found >= 8 and found * 30 >= len(text) or found * 3 > len(text):
                return name
    return None


class Languages:
    """Naive Bayes over words: (language, word, count) of labelled documents and documents by language."""

    def __init__(self, words: list[tuple[str, str, int]], documents: dict[str, int]) -> None:
        self.names = sorted({x for x, _, _ in words})
        self.at = {w: i for i, w in enumerate(sorted({w for _, w, _ in words}))}
        counts = np.full((len(self.at), len(self.names)), 0.5)
        for name, w, n in words:
            counts[self.at[w], self.names.index(name)] += n
        self.logs = np.log(counts / counts.sum(0))
        self.prior = np.log(np.array([documents[x] for x in self.names], float))

    def of(self, text: str) -> str | None:
        found = [(i, n) for w, n in Counter(text.lower().split()).items() if (i := self.at.get(w)) is not None]
        if not found:
            return None
        i, n = np.array(found).T
        return self.names[int(np.argmax(self.prior + n @ self.logs[i]))]


def language(text: str, known: Languages | None = None) -> str:
    """Language of prose."""
    name = script(text) or (known.of(text) if known is not None and known.names else None)
    if name:
        return name
    votes = dict.fromkeys(_languages, 0)
    if not text.isascii():
        for name, letters in _letters.items():
            votes[name] += sum(map(text.count, letters))
    for word, n in Counter(text.lower().split()).items():
        for name in _votes.get(word, ()):
            votes[name] += n
    return max(_languages, key=lambda k: (votes[k], k == "en"))


def learn_languages(docs: DataFrame) -> Languages:
    """The classifier, from the words of all documents (text, lang) without a script of their own; the primary part of a
    label counts (en of en-GB), `und` is none. At most LANGUAGES * LANGUAGE_WORDS rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 0):
            total: Counter = Counter()
            for text, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                prose = "\n".join(text[a:b] for a, b in blocks(text))
                if script(prose) is None:
                    total[name, ""] += 1
                    total.update((name, w) for w in prose.lower().split() if len(w) <= 20 and w.isalpha())
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in total], pa.string()), pa.array([w for _, w in total], pa.string()), pa.array(total.values(), pa.int64())], names=["lang", "word", "n"])

    if "lang" not in docs.columns:
        return Languages([], {})
    label = F.regexp_extract(F.lower("lang"), "^([a-z]{2,8})(?:[-_]|$)", 1)
    labelled = docs.select("text", label.alias("lang")).where("lang <> '' and lang <> 'und'")
    counts = saved(labelled.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    documents = {r[0]: r[1] for r in counts.where(f"word = '' and n >= {LABELLED}").orderBy(F.desc("n"), "lang").select("lang", "n").limit(LANGUAGES).collect()}
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    words = counts.where((F.col("word") != "") & (F.col("n") > 1) & F.col("lang").isin(*documents)).withColumn("r", rank).where(F.col("r") <= LANGUAGE_WORDS)
    return Languages([(r["lang"], r["word"], r["n"]) for r in words.select("lang", "word", "n").collect()], documents)


# ---- blocks ---------------------------------------------------------------------------------------------------------

_line = re.compile(r"[^\r\n]*(?:\r\n|\n|\r|\Z)")
_fence = re.compile(r"\s*(`{3,}|~{3,})")
_heading = re.compile(r"[\s\ufeff\u200b]*#{1,6}(?:\s|$)")
_bullet = re.compile(r"\s*([-*+•])[ \t]+(?=\S)")
_numbered = re.compile(r"\s*(\d{1,4})[.)][ \t]+(?=\S)")
_quote = re.compile(r"\s*(?:>[ \t]?)+")
_stray = " \t\r\n\f\v\x00\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x2010))) + "\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"


def blocks(text: str) -> list[tuple[int, int]]:
    """Spans of paragraphs, list items and quoted lines without their marks."""
    out: list[tuple[int, int]] = []
    start = end = -1
    number: int | None = None
    fence = ""

    def close() -> None:
        nonlocal start
        if start >= 0:
            out.append((start, end))
        start = -1

    at, n = 0, len(text)
    while at < n:
        m = _line.match(text, at)
        stop = m.end()
        a = at
        while a < stop and text[a] in "\ufeff\u200b\u2060\x00":
            a += 1
        line = text[a:stop]
        at = stop
        if fence:
            if line.strip().startswith(fence) and not line.strip().strip(fence[0]):
                fence = ""
            continue
        if not line.strip(_stray):
            close()
            number = None
            continue
        lead = line.lstrip()[:1]
        if lead in "`~" and (f := _fence.match(line)):
            close()
            number = None
            fence = f.group(1)
            continue
        if lead == "#" and _heading.match(line):
            close()
            number = None
            continue
        mark = None
        if lead == ">":
            q = _quote.match(line)
            close()
            inner = line[q.end() :]
            b = _bullet.match(inner) or _numbered.match(inner)
            start, end = a + q.end() + (b.end() if b else 0), stop
            close()
            number = None
            continue
        if lead in "-*+•":
            mark = _bullet.match(line)
            if mark:
                number = None
        elif lead.isdigit():
            mark = _numbered.match(line)
            if mark:
                k = int(mark.group(1))
                # a wrapped line may begin with a number; an item begins a block or follows its predecessor
                if start >= 0 and (number is None or k != number + 1):
                    mark = None
                else:
                    number = k
        if mark:
            close()
            start, end = a + mark.end(), stop
        elif start >= 0:
            end = stop
        else:
            start, end = a, stop
    close()
    return out


# ---- statistics -----------------------------------------------------------------------------------------------------

_edge = "\"'“”„‚‘’«»‹›()[]{}<>*_`¿¡,;:!?"
#: Letters with their marks (vowel signs are marks in Indic scripts), joined by points, hyphens and apostrophes.
_type = regex.compile(r"[\p{L}\p{M}]+(?:[.\-’'][\p{L}\p{M}]+)*")


def shape(token: str) -> str:
    """Type of a token: lower case, without edge signs; numbers are one type."""
    t = token.strip(_edge).rstrip(".").lower()
    return "##" if re.fullmatch(r"\d+(?:[.,]\d+)*", t) else t


def count_types(texts: Iterator[str], known: Languages | None = None) -> Counter:
    """Counts by (language, kind, first, second): w types without and p with a final period, b pairs around a period,
    l lower-case words and f those of them that begin a block, F blocks, n tokens, N tokens with a final period."""
    raw: dict[str, Counter] = {}
    pairs: dict[str, Counter] = {}
    total: Counter = Counter()
    for text in texts:
        parts = [text[a:b] for a, b in blocks(text)]
        lang = language("\n".join(parts), known)
        c, p = raw.setdefault(lang, Counter()), pairs.setdefault(lang, Counter())
        for part in parts:
            tokens = part.split()
            c.update(tokens)
            if tokens:
                total[lang, "F", "", ""] += 1
                if tokens[0].isalpha() and tokens[0].islower():
                    total[lang, "f", tokens[0], ""] += 1
            p.update([(x, y) for x, y in zip(tokens, tokens[1:]) if x[-1] == "."])
    for lang, p in pairs.items():
        for (x, y), k in p.items():
            total[lang, "b", shape(x), y.strip(_edge).lower().rstrip(".")[:40]] += k
    for lang, c in raw.items():
        for token, k in c.items():
            core = token.strip(_edge)
            total[lang, "n", "", ""] += k
            if core.endswith(".") and token[-1] in _closers:
                continue
            if core.endswith(".") and not core.endswith(".."):
                total[lang, "N", "", ""] += k
                t = core[:-1].lower()
                if len(t.replace(".", "")) <= LONGEST and _type.fullmatch(t):
                    total[lang, "p", t, ""] += k
            else:
                t = core.lower()
                if t == core and t.isalpha() and len(t) <= 20:
                    total[lang, "l", t, ""] += k
                if t and _type.fullmatch(t) and len(t.replace(".", "")) <= 20:
                    total[lang, "w", t, ""] += k
    return total


def _xlog(k: Column, p: Column) -> Column:
    return F.when(k > 0, k * F.log(F.greatest(p, F.lit(1e-12)))).otherwise(F.lit(0.0))


def _ratio(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """2 log(likelihood of two rates / of one)."""
    k1, n1, k2, n2 = (x.cast("double") for x in (k1, n1, k2, n2))
    p, p1, p2 = (k1 + k2) / F.greatest(n1 + n2, F.lit(1.0)), k1 / F.greatest(n1, F.lit(1.0)), k2 / F.greatest(n2, F.lit(1.0))
    like = lambda k, n, q: _xlog(k, q) + _xlog(n - k, 1 - q)
    return 2 * (like(k1, n1, p1) + like(k2, n2, p2) - like(k1, n1, p) - like(k2, n2, p))


def learn(docs: DataFrame, known=None) -> DataFrame:
    """The learned types of all documents: lang, kind (abbr, coll, start or lead), a, b. KNOWN: broadcast classifier of languages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 0):
            c = count_types((x for x in batch.column(0).to_pylist() if x), known.value if known else None)
            if c:
                keys = list(zip(*c))
                yield pa.RecordBatch.from_arrays([*(pa.array(k, pa.string()) for k in keys), pa.array(c.values(), pa.int64())], names=["lang", "kind", "a", "b", "n"])

    counts = saved(docs.select("text").mapInArrow(run, "lang string, kind string, a string, b string, n long").groupBy("lang", "kind", "a", "b").agg(F.sum("n").alias("n")), "types")
    of = lambda kind: counts.where(F.col("kind") == kind)
    sums = of("n").select("lang", F.col("n").alias("tokens")).join(of("N").select("lang", F.col("n").alias("periods")), "lang")  # a row a language
    with_p = of("p").select("lang", "a", F.col("n").alias("cp"))
    t = with_p.join(of("w").select("lang", "a", F.col("n").alias("cw")), ["lang", "a"], "left").join(F.broadcast(sums), "lang").withColumn("cw", F.coalesce("cw", F.lit(0)))
    letters = F.length(F.translate("a", ".", "")).cast("double")
    dots = F.length("a") - letters + 1
    total = F.col("cp") + F.col("cw")
    more = F.col("cp") / total > F.col("periods") / F.col("tokens")
    # rate of the period after this type against its rate overall
    strength = _ratio(F.col("cp"), total, F.col("periods") - F.col("cp"), F.col("tokens") - total)
    score = strength * F.exp(-letters) * dots * F.pow(letters, -F.col("cw").cast("double"))
    abbreviations = saved(t.where(more & (score >= ABBREVIATION) & (F.col("cp") >= EVIDENCE)).select("lang", "a", "cp"), "abbr")
    pairs = of("b").select("lang", "a", "b", "n").join(F.broadcast(sums), "lang")
    short = abbreviations.select("lang", "a").withColumn("abbr", F.lit(True))
    small = abbreviations.count() <= MODEL_ROWS
    marked = pairs.join(F.broadcast(short) if small else short, ["lang", "a"], "left")
    follow = marked.where("abbr is null and a <> '##' and length(a) > 1 and length(b) > 1").groupBy("lang", "b").agg(F.sum("n").alias("k"), F.first("tokens").alias("tokens"))
    ends = follow.groupBy("lang").agg(F.sum("k").alias("ends"))
    words = of("w").groupBy("lang", F.col("a").alias("b")).agg(F.sum("n").alias("cw"))
    begin = follow.join(F.broadcast(ends), "lang").join(words, ["lang", "b"], "left").withColumn("cw", F.greatest(F.coalesce("cw", F.lit(0)), F.col("k")))
    starters = begin.where((F.col("k") / F.col("ends") > F.col("cw") / F.col("tokens")) & (_ratio(F.col("k"), F.col("ends"), F.col("cw") - F.col("k"), F.col("tokens") - F.col("ends")) >= STARTER) & (F.col("k") >= 5)).select("lang", "b", "k")
    firsts = pairs.groupBy("lang", "a").agg(F.sum("n").alias("na"))
    seconds = pairs.groupBy("lang", "b").agg(F.sum("n").alias("nb"))
    bound = marked.where("(abbr or a = '##' or length(a) = 1) and n >= 3").join(firsts, ["lang", "a"]).join(seconds, ["lang", "b"])
    together = _ratio(F.col("n"), F.col("na"), F.col("nb") - F.col("n"), F.col("periods") - F.col("na"))
    bound = bound.where((F.col("n") / F.col("na") > F.col("nb") / F.col("periods")) & (together >= COLLOCATION)).select("lang", "a", "b", "n")
    # lower-case words that begin blocks far more often than words do begin sentences also without a capital
    lower = of("f").select("lang", "a", F.col("n").alias("k")).where("length(a) > 2").join(of("l").select("lang", "a", F.col("n").alias("c")), ["lang", "a"])
    lower = lower.join(F.broadcast(of("F").select("lang", F.col("n").alias("blocks"))), "lang").join(F.broadcast(sums), "lang").withColumn("c", F.greatest("c", "k"))
    leads = lower.where((F.col("k") >= 5) & (F.col("k") >= LEAD * F.col("c")) & (_ratio(F.col("k"), F.col("c"), F.col("blocks") - F.col("k"), F.col("tokens") - F.col("c")) >= STARTER))
    none = F.lit("")
    return (
        abbreviations.select("lang", F.lit("abbr").alias("kind"), "a", none.alias("b"))
        .unionByName(starters.select("lang", F.lit("start").alias("kind"), F.col("b").alias("a"), none.alias("b")))
        .unionByName(leads.select("lang", F.lit("lead").alias("kind"), "a", none.alias("b")))
        .unionByName(bound.select("lang", F.lit("coll").alias("kind"), "a", "b"))
    )


def model_of(rows: Iterable[tuple[str, str, str, str]]) -> dict[str, dict[str, set]]:
    """Sets of learned types by language and kind."""
    model: dict[str, dict[str, set]] = {}
    for lang, kind, a, b in rows:
        model.setdefault(lang, {"abbr": set(), "coll": set(), "start": set(), "lead": set()})[kind].add((a, b) if kind == "coll" else a)
    return model


def asked_types(text: str, known: Languages | None = None) -> set[tuple[str, str, str, str]]:
    """The learned types that the classification of a text may ask for, wherever its sentences begin: the token before each
    period, also the parts of it behind an end mark, and the token after it."""
    spans = blocks(text)
    lang = language("\n".join(text[a:b] for a, b in spans), known)
    out: set[tuple[str, str, str, str]] = set()
    for x, y in spans:
        s = text[x:y]
        for m in _end.finditer(s):
            # as in _ends: the words before the period and behind it, wherever a cut lets them begin
            before = s[max(0, m.start() - 60) : m.start()].split()[-1:]
            firsts = {t[i:] for t in before for i in [0, *(k + 1 for k, c in enumerate(t) if not c.isalnum())]}
            rest = s[m.end() : m.end() + 100]
            i = 0
            while i < len(rest) and (rest[i] in _closers or rest[i] in _stray):
                i += 1
            # behind closing signs and white space, and behind opening signs that stand apart
            after = {w for k in range(i + 1) for w in (rest[k:].split(None, 1)[:1] + rest[k:].lstrip(_opener + _stray).split(None, 1)[:1])}
            seconds = {w.strip(_edge).lower().rstrip(".")[:40] for w in after}
            shapes = {shape(t) for t in firsts} | {t.lower() for t in firsts}
            out |= {(lang, "abbr", t, "") for t in shapes} | {(lang, kind, t, "") for t in seconds for kind in ("start", "lead")} | {(lang, "coll", t, u) for t in shapes for u in seconds}
    return out


# ---- classification -------------------------------------------------------------------------------------------------

_closers = "\"'”’»›」』）)]】》〉｣”"
_open_close = {"“": "”", "„": "“", "«": "»", "‹": "›", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "【": "】", "《": "》", "‚": "‘"}
_end = re.compile(r"[.!?。！？؟۔।॥｡…‼⁇⁈⁉]+")
_thai_gap = re.compile(r"(?<=[\u0e00-\u0e7f])[ \t\xa0\u3000]*(?:\r\n|\n|\r|[ \t\xa0\u3000])[ \t\xa0\u3000]*(?=[\u0e00-\u0e7f])")
_opener = "\"'“„«‹「『（([【《¿¡‚`*_"
_identifier = re.compile(r"[A-Za-z]\w*(?:_|[a-z][A-Z])\w*")
_glued = re.compile(r"[\"'“„«(¿¡]?(?:[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zà-öø-ÿа-яё]*(?=[\s,'’]|$)|[A-Za-z][a-z]*(?:_[a-z]+)+(?=\s)|[a-z]+[A-Z][A-Za-z]*(?=\s))")
_any_open = re.compile(r"[“„«‹「『（(\[【《‚\"]")
_full_word = re.compile(r"[\"'“(]?[^\W\d_]{2,}|\d+|.*\)")
_determiner = re.compile(r"(?i)(?:^|\s)(?:am|vom|zum|bis|der|die|das|dem|den|des|im|ab|seit|jeder|jede|jedes|ein|eine|erste[rns]?)\s+\d{1,2}$")


def quote_state(s: str, a: int, b: int) -> tuple[list[int], bool]:
    """Open brackets and quotes at B of a sentence that began at A, as positions, and whether a straight quote is open."""
    stack: list[int] = []
    straight = -1
    for i in range(a, b):
        c = s[i]
        if c in _open_close and not (stack and _open_close.get(s[stack[-1]]) == c):
            stack.append(i)
        elif stack and c == _open_close[s[stack[-1]]]:
            stack.pop()
        elif c == '"':
            straight = -1 if straight >= 0 else i
    if straight >= 0:
        stack.append(straight)
    return stack, straight >= 0


def split(s: str, lang: str, model: dict[str, set] | None) -> list[tuple[int, int]]:
    """Spans of the sentences of one block."""
    abbr = model["abbr"] if model else set()
    coll = model["coll"] if model else set()
    begin = model["start"] if model else set()
    lead = model.get("lead", set()) if model else set()
    n = len(s)
    cuts: list[int] = []
    start = 0
    quoted = _any_open.search(s) is not None
    if lang == "th":
        events = sorted([(m.start(), m.end(), "") for m in _thai_gap.finditer(s)] + [(m.start(), m.end(), m.group()) for m in _end.finditer(s)])
    else:
        events = [(m.start(), m.end(), m.group()) for m in _end.finditer(s)]
    for a, b, mark in events:
        if b <= start:
            continue
        if b >= n:
            break
        # the plain cases first
        c = s[b]
        if mark == ".":
            if c.isdigit() or c in "/_=&-@\\":
                continue
            if not quoted and c in " \n" and s[b + 1 : b + 2].isupper():
                word = s[max(start, a - 60) : a].rsplit(None, 1)[-1:]
                if word and len(word[0]) > 2 and word[0].isalpha() and word[0].lower() not in abbr:
                    cuts.append(b)
                    start = b
                    continue
        elif not quoted and (mark in "!?" and c in " \n" and s[b + 1 : b + 2].isupper() or mark in "。！？।؟" and mark and c not in "，、；：,;" and c not in _closers):
            cuts.append(b)
            start = b
            continue
        if not mark:
            if not (quoted and quote_state(s, start, a)[0]):
                cuts.append(a)
                start = a
            continue
        e = b
        while e < n and s[e] in _closers:
            # an apostrophe or straight quote belongs here only if it closes
            if s[e] == "'" and e + 1 < n and s[e + 1].isalpha():
                break
            if s[e] == '"' and s.count('"', start, e) % 2 == 0:
                break
            e += 1
        if e < n - 1 and s[e] in " \xa0\u202f" and s[e + 1] == "»":
            e += 2  # French guillemets stand apart
        gap = e < n and s[e].isspace()
        i = e
        while i < n and s[i] in _stray:
            i += 1
        if i >= n:
            break
        closed = e > b
        if mark == "." and not gap and not closed:
            # inside a token, or a sentence glued to the next one
            if e < n and not (s[e].isalpha() or s[e] in _opener) or not _glued.match(s, e):
                continue
            word = s[max(start, a - 60) : a].split()[-1:]
            if not (word and _full_word.fullmatch(word[0]) and not word[0].isupper()):
                continue
            if not _ends(s, start, a, e, lang, abbr, coll, begin, lead):
                continue
            cuts.append(e)
            start = e
            continue
        stack = quote_state(s, start, b)[0] if quoted else None
        if stack:
            if not closed:
                continue  # a sentence inside a quotation
            o = stack[0]
            after, _ = quote_state(s, start, e)
            if after:
                continue
            at_start = not s[start:o].strip(_stray)
            colon = s[start:o].rstrip(_stray)[-1:] in ":：,，" and s[start:o].rstrip(_stray)[-1:] in ":："
            c = s[i]
            if s[o] in "(（[【":
                if not at_start:
                    continue
            elif goes_on(s, i, lead) or c in "—–-,;:，、；：":
                continue
            elif lang in ("zh", "ja"):
                if not (colon or at_start) or c in "とっの的之":
                    continue
            elif lang in ("hi", "ar", "th"):
                if not colon:
                    continue
            elif not (colon or at_start or c.isupper() or c in _opener or c.islower()):
                continue
            if s[i].islower() and not colon and s[o] not in "(（" and goes_on(s, i, lead):
                continue
            cuts.append(e)
            start = e
            continue
        if "…" in mark or ".." in mark:
            c = s[i]
            if lang in ("zh", "ja") and "。" not in mark and "！" not in mark and "？" not in mark:
                continue
            if goes_on(s, i, lead) or c in "—–,;:" or (lang in ("hi", "ar", "th") and not gap):
                continue
            if lang in ("hi", "ar", "th"):
                continue
            cuts.append(e)
            start = e
            continue
        if mark[0] in "。！？｡।॥؟۔" or mark[-1] in "。！？｡।॥؟۔":
            if s[i] in "，、；：,;":
                continue
            cuts.append(e)
            start = e
            continue
        if mark[-1] in "!?‼⁇⁈⁉":
            c = s[i]
            if not gap and not closed and not _glued.match(s, e) and s[e].isascii():
                continue
            if goes_on(s, i, lead) or c in "—–,;:":
                continue
            cuts.append(e)
            start = e
            continue
        if mark == "." and _ends(s, start, a, i, lang, abbr, coll, begin, lead):
            cuts.append(e)
            start = e
    out, at = [], 0
    for c in [*cuts, n]:
        part = s[at:c].rstrip(_stray)
        x = at + len(part) - len(part.lstrip(_stray))
        if x < at + len(part):
            out.append((x, at + len(part)))
        at = c
    return out


def goes_on(s: str, i: int, lead: set) -> bool:
    """Whether a lower-case word at I continues a sentence: no identifier, and no word that begins sentences like that."""
    return s[i].islower() and not _identifier.match(s, i) and s[i : i + 60].split(None, 1)[0].strip(_edge).rstrip(".") not in lead


def _ends(s: str, start: int, a: int, i: int, lang: str, abbr: set, coll: set, begin: set, lead: set) -> bool:
    """Whether the period at A ends a sentence, given the statistics; the next token begins at I."""
    words, rest = s[max(start, a - 60) : a].split(), s[i : i + 60].split(None, 1)
    if not words or not rest:
        return False
    token, nxt = words[-1], rest[0]
    core = nxt.lstrip(_opener)
    if not core:  # an opening sign that stands apart
        core = (s[i : i + 80].lstrip(_opener + _stray).split(None, 1) or [""])[0]
        if not core:
            return False
    first, second = shape(token), core.strip(_edge).lower().rstrip(".")[:40]
    c = core[0]
    lower = goes_on(core, 0, lead)
    if c in "—–,;:" or nxt[0] in "—–,;:":
        return False
    bare = token.strip(_edge)
    if first == "##":
        if lower:
            return False
        if lang == "de" and "," not in bare and "." not in bare and len(bare) <= 2 and _determiner.search(s, max(start, a - 30), a):
            return False
        if ("##", second) in coll and second not in begin and len(bare) <= 2:
            return False
        # an enumeration inside a sentence
        return not re.search(r"(?:^|[:,;]\s*)\d{1,2}$", s[max(start, a - 8) : a]) or bool(s[start:a].strip() != bare and c.isupper() and not re.search(r"[:,;]\s*\d{1,2}$", s[max(start, a - 8) : a]))
    initial = len(bare) == 1 and bare.isalpha()
    short = first in abbr or "." in bare and re.fullmatch(r"(?:[^\W\d_]{1,3}\.)+[^\W\d_]{1,3}", bare) is not None
    if short or initial:
        if lower or c.isdigit():
            return False
        if (first, second) in coll and second not in begin or initial and len(core.rstrip(_edge)) == 1:
            return False
        if lang in ("hi", "ar", "th", "zh", "ja"):
            return False
        # after an abbreviation a known starter, a quotation or an identifier begins a sentence
        if second in begin:
            return True
        if nxt[0] in "«„“\"¿¡(":
            return not initial
        if _identifier.match(core):
            return False
        return False
    return not lower


def sentences_of(text: str | None, model: dict[str, dict[str, set]] | None = None, known: Languages | None = None) -> list[tuple[int, int]]:
    """1-based positions of the first and last character of every sentence."""
    if not text:
        return []
    spans = blocks(text)
    lang = language("\n".join(text[a:b] for a, b in spans), known)  # code and headings may be in another language
    stats = (model or {}).get(lang)
    out = []
    for a, b in spans:
        out += [(a + x + 1, a + y) for x, y in split(text[a:b], lang, stats)]
    return out


def sentences(docs: DataFrame, most: int = MODEL_ROWS) -> DataFrame:
    """doc_id, start_pos, end_pos of the sentences of all documents of other kinds than code."""
    keep = ["doc_id", "text"] + (["lang"] if "lang" in docs.columns else [])
    prose = spread(docs.where("(kind is null or kind <> 'code') and text is not null and text <> ''").select(*keep))
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(learn_languages(prose))
    types = saved(learn(prose, known), "learned")
    if types.count() <= most:
        all_types = spark.sparkContext.broadcast(model_of(types.toLocalIterator()))
        rows = prose.select("doc_id", "text", F.lit(None).cast("array<struct<lang:string,kind:string,a:string,b:string>>").alias("types"))
    else:
        all_types = None
        rows = with_types(prose, types, known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1):
            ids, starts, ends = [], [], []
            for k, text, own in zip(*(batch.column(i).to_pylist() for i in range(3))):
                model = all_types.value if all_types else model_of(tuple(t.values()) for t in own or ())
                for x, y in sentences_of(text, model, known.value):
                    ids.append(k)
                    starts.append(x)
                    ends.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["doc_id", "start_pos", "end_pos"])

    return rows.mapInArrow(run, "doc_id long, start_pos int, end_pos int").distinct()


def with_types(prose: DataFrame, types: DataFrame, known) -> DataFrame:
    """doc_id, text, types: every document with those learned types that it may ask for, by a join on the type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1):
            rows = [(k, *t) for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for t in asked_types(text, known.value)]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:])], names=["h", "lang", "kind", "a", "b"])

    texts = prose.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h"))
    asked = texts.select("h", "text").mapInArrow(run, "h long, lang string, kind string, a string, b string")
    held = asked.join(types, ["lang", "kind", "a", "b"]).groupBy("h").agg(F.collect_set(F.struct("lang", "kind", "a", "b")).alias("types"))
    return texts.join(held, "h", "left").select("doc_id", "text", "types")
