"""Toxicity: Levenshtein automata intersected with a trie of the lexicon, and scores of contexts.

The lexicon is a trie. The Levenshtein automata of all its terms share it: a state of the intersection
is a set of (trie node, edits so far), and the subset construction makes that one deterministic
table, once, on the driver. A batch runs all its words through the table together, one character
of every word at a time; most words are dead after three or four. Terms of up to 4 letters must match
exactly, of up to 7 may have one edit, longer ones two. Letters are those of any script; case is ignored.
A symbol of *@$!# between two letters counts as a letter ("id*ot").

LEXICON holds English terms. `learn` adds the terms of any language that labelled documents show: words that stand in toxic
documents at RATIO times the rate of clean ones or more, in numbers that chance doesn't give (a G-test of at least LEAST_G). So that copies
don't make terms, labelled texts with the same least shingle count once, and a word counts once for each pair of neighbours. A learned term's
weight is its log-odds in units of NEEDED, 1 at most. What is learned about misspellings: the share of toxic
ones among the labelled places of a term's forms at 1 or 2 edits (one toxic place added) multiplies their weight, and below
LEAST_WEIGHT the automaton doesn't take them. Learning reads the LABELLED labelled documents of least hash, whole; counts over them run on the executors.

A form in letters alone that lies as near to a common word (ALLOWED) as to its term is taken for that word; a doubled letter is half an edit there.
No verdict depends on what else is in the table that is scored, but for the labelled sample.

Each hit gets a score from its window of WINDOW words to either side:

* weight of the term, times 1, 0.6 or 0.35 for no, one or two edits, times the share learned;
* a fifth of it if the hit stands between quotation marks, half if a word of speech or definition
  ("said", "called", "the word") is near and no second person is: quotation, not abuse;
* times 1.3 if, unquoted, a second person is near, and times 1.2 with another hit in the window.

A document's score is the sum, in texts of over STRETCH words that of STRETCH words on average, so that length alone adds nothing. It is
toxic from `threshold` on. One misspelling by itself scores 0.94 at most, so it takes a second hit.

Defined results: null and empty texts have no hit and score 0; each input row gives one row, repeated
rows and null ids too; other columns are ignored, and a column of `keep` with the name of a result gives way to it;
an empty table gives no rows. Labels without an id or a verdict are left out, of several for one id the highest counts; without labels, or
with an empty table of them, LEXICON stands alone.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import arrays as A
from lodestone.llm.names import col
from lodestone.llm.scratch import Scratch

LEXICON: dict[str, float] = dict.fromkeys(
    "idiot idiots clown loser losers worthless scum moron morons moronic trash pathetic disgusting stupid imbecile cretin "
    "dumbass asshole bastard bitch bitches bullshit cunt dickhead douchebag dumb fuck fucking fucker motherfucker faggot nigger retard retarded shithead slut whore vermin subhuman".split(),
    1.0,
) | {"dumb": 0.5, "trash": 1.0}
ALLOWED = frozenset(
    "closer lower loser lose loses looser poser hoser laser user losel crown clowns frown flown blown down cloud clout crows idiom idioms idiotic "
    "crash brash thrash trashy trashed rash tras scam slum scrum sum scu boron mormon moran maroon morose apathetic empathetic athletic aesthetic prophetic pathetically "
    "discussing digesting disgustingly disrupting disputing wordless worthiness mirthless stupor numb thumb duma dumbo duck ducking fact fuchs folk funk tucker sucker pucker luck lucking tucking sucking bucking "
    "bisch bitcoin batch botch ditch pitch witch hitch switch birch stitch cut cent count hunt aunt bunt runt punt shore where whose whole white "
    "retire return record reward retail regard retarget retards slit slat slot slum smut shut salut bigger digger rigger nagger niger trigger maggot bustard custard mustard dastard vermis vermont cretan certain human subhumid verein vereine vereint".split()
)
REPORTING = frozenset("said says say called calls calling call quote quoted quotes quoting word words term terms insult insults slur slurs means meaning meant definition defined reported writes wrote".split())
SECOND = frozenset("you your yours youre yourself yourselves u ur du dich dir dein deine tu toi ton te eres usted vous votre".split())
RESULTS = ("n_hits", "n_misspelled", "n_quoted", "score", "toxic")
EDITS = (1.0, 0.6, 0.35)
WINDOW, THRESHOLD = 8, 1.0
LABELLED, RATIO, LEAST_G, LEAST_TEXTS, NEEDED, LEAST_WEIGHT = 20_000, 8.0, 24.0, 3, 8.0, 0.1
STRETCH = 1000
Weights = dict[str, tuple[float, float, float]]
QUOTED, REPORTED, ADDRESSED, CROWDED = 0.2, 0.5, 1.3, 1.2

SYMBOLS = "*@$!#"
PLANES = 0x20000  # code points beyond are letters without case


@functools.cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point below PLANES: its lower case, and whether it is a letter, mark or digit."""
    lower = np.array([ord(x) if len(x := chr(i).lower()) == 1 else i for i in range(PLANES)], np.uint32)
    return lower, np.array([unicodedata.category(chr(i))[0] in "LMN" for i in range(PLANES)])


_MARKS = re.compile(r"[\"“”„«»]")
_WORD = re.compile(r"[^\W_]+")


def allowed_edits(term: str) -> int:
    return 0 if len(term) <= 4 else 1 if len(term) <= 7 else 2


class Automaton:
    """The table, and for each accepting state the term and its edits. limits: the edits that each term may have."""

    def __init__(self, terms: tuple[str, ...], limits: tuple[int, ...] | None = None):
        limits = limits or tuple(map(allowed_edits, terms))
        letters = sorted(set("".join(terms)))
        number_of = {c: k + 1 for k, c in enumerate(letters)}
        self.width = width = len(letters) + 2  # class 0 is any other character
        self.classes = np.zeros(PLANES + 1, np.int32)
        for c, k in number_of.items():
            self.classes[min(ord(c), PLANES)] = k
        children: list[dict[int, int]] = [{}]
        ends, reach = [-1], [0]
        for t, term in enumerate(terms):
            node = 0
            reach[0] = max(reach[0], limits[t])
            for c in term:
                k = number_of[c]
                if k not in children[node]:
                    children[node][k] = len(children)
                    children.append({})
                    ends.append(-1)
                    reach.append(0)
                node = children[node][k]
                reach[node] = max(reach[node], limits[t])
            ends[node] = t

        def close(pairs: dict[int, int]) -> tuple[tuple[int, int], ...]:
            todo = list(pairs.items())
            while todo:  # a letter of the term is missing in the word
                node, e = todo.pop()
                for child in children[node].values():
                    if e < reach[child] and e + 1 < pairs.get(child, 99):
                        pairs[child] = e + 1
                        todo.append((child, e + 1))
            return tuple(sorted(pairs.items()))

        start = close({0: 0})
        number = {start: 1}
        rows, states = [np.zeros(width, np.int32)], [start]
        self.term, self.edits = [-1], [0]
        for state in states:
            best = min(((e, ends[n]) for n, e in state if ends[n] >= 0 and e <= limits[ends[n]]), default=(0, -1))
            self.edits.append(best[0])
            self.term.append(best[1])
            spare: dict[int, int] = {}
            for node, e in state:
                if e < reach[node]:
                    spare[node] = min(spare.get(node, 99), e + 1)
                for child in children[node].values():
                    if e < reach[child]:
                        spare[child] = min(spare.get(child, 99), e + 1)
            steps: dict[int, dict[int, int]] = {}
            for node, e in state:
                for k, child in children[node].items():
                    if e <= reach[child]:
                        at = steps.setdefault(k, dict(spare))
                        at[child] = min(at.get(child, 99), e)
            other = self._number(close(spare), number, states)
            row = np.full(width, other, np.int32)
            for k, at in steps.items():
                row[k] = self._number(close(at), number, states)
            rows.append(row)
        self.table = np.stack(rows)
        self.term, self.edits = np.array(self.term), np.array(self.edits)
        self.longest = max(map(len, terms), default=0) + 2

    @staticmethod
    def _number(state: tuple, number: dict, states: list) -> int:
        if not state:
            return 0
        if state not in number:
            number[state] = len(states) + 1
            states.append(state)
        return number[state]

    def run(self, chars: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words are accepted, as which term, with how many edits."""
        size = end - start
        live = np.flatnonzero(size <= self.longest)
        state = np.ones(len(live), np.int32)
        found = []
        at, left = start[live], size[live]
        flat = self.table.ravel()
        step = 0
        while len(live):
            state = flat[state * self.width + self.classes[np.minimum(chars[at + step], PLANES)]]
            step += 1
            over = left == step
            if over.any():
                done = over & (self.term[state] >= 0)
                found.append(np.stack([live[done], state[done]]))
            on = ~over & (state > 0)
            live, at, left, state = live[on], at[on], left[on], state[on]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        which, last = np.concatenate(found, axis=1)
        order = np.argsort(which, kind="stable")
        return which[order], self.term[last[order]], self.edits[last[order]]


@functools.lru_cache(4)
def automaton(terms: tuple[str, ...], limits: tuple[int, ...] | None = None) -> Automaton:
    return Automaton(terms, limits)


def split(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The characters in lower case, starts and ends of words, and the first word of each text."""
    chars, off = A.characters(data, off)
    lower, letter = _characters()
    low = chars < PLANES
    inside = np.zeros(len(chars) + 2, bool)
    inside[1:-1][low] = letter[chars[low]]
    inside[1:-1][~low] = True
    chars = chars.copy()
    chars[low] = lower[chars[low]]
    edge = np.zeros(len(chars) + 1, bool)
    edge[off] = True
    symbol = np.flatnonzero(np.isin(chars, np.frombuffer(SYMBOLS.encode("utf-32-le"), np.uint32)))
    symbol = symbol[inside[symbol] & inside[symbol + 2] & ~edge[symbol] & ~edge[symbol + 1]]  # inside is one ahead of chars
    inside[symbol + 1] = True
    begins, ends = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(chars))]
    cut = cut[inside[cut] & inside[cut + 1]]
    begins[cut] = ends[cut] = True
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    return chars, start, end, np.searchsorted(start, off)


def _text(chars: np.ndarray) -> str:
    return chars.astype("<u4").tobytes().decode("utf-32-le", "replace")


def half_distance(a: str, b: str) -> float:
    """Edit distance in which a letter doubled, or a double one made single, is half an edit."""
    row = [0.0]
    for j, y in enumerate(b):
        row.append(row[-1] + (0.5 if j and b[j - 1] == y else 1.0))
    for i, x in enumerate(a):
        gone = 0.5 if i and a[i - 1] == x else 1.0
        new = [row[0] + gone]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + gone, new[-1] + (0.5 if j and b[j - 1] == y else 1.0)))
        row = new
    return row[-1]


@functools.lru_cache(1 << 16)
def excused(form: str, term: str, allowed: frozenset[str]) -> bool:
    """Whether a misspelt form is rather a common word, or as near to one as to the term."""
    if form in allowed:
        return True
    most = half_distance(form, term)
    return form.isalpha() and any(abs(len(w) - len(form)) <= 2 and half_distance(form, w) <= most for w in allowed)


def context(before: str, after: str, crowded: bool) -> tuple[float, bool]:
    """The factor for a hit between these windows, and whether it is a quotation."""
    if (line := before.rfind("\n")) >= 0:
        before = before[line + 1 :]
    if (line := after.find("\n")) >= 0:
        after = after[:line]
    near = {w.lower() for w in _WORD.findall(before.replace("'", "") + " " + after.replace("'", ""))}
    inside = len(_MARKS.findall(before)) % 2 == 1 and bool(_MARKS.search(after))
    addressed = not near.isdisjoint(SECOND)
    if inside:
        return QUOTED, True
    if not addressed and not near.isdisjoint(REPORTING):
        return REPORTED, True
    return (ADDRESSED if addressed else 1.0) * (CROWDED if crowded else 1.0), False


def matches(data: np.ndarray, off: np.ndarray, m: Automaton, terms: tuple[str, ...], allowed: frozenset[str]) -> tuple[np.ndarray, ...]:
    """Characters, starts, ends and first words as `split` gives them; then word, term and edits of every hit that nothing excuses."""
    chars, start, end, first = split(data, off)
    which, term, edits = m.run(chars, start, end)
    real = [e == 0 or not excused(_text(chars[start[w] : end[w]]), terms[t], allowed) for w, t, e in zip(which.tolist(), term.tolist(), edits.tolist())]
    return chars, start, end, first, which[real], term[real], edits[real]


def judge(data: np.ndarray, off: np.ndarray, m: Automaton, terms: tuple[str, ...], weights: np.ndarray, allowed: frozenset[str]) -> list[np.ndarray]:
    """Hits, misspelled hits, quoted hits and score of every text. weights: a row for each term, a column for each number of edits."""
    docs = len(off) - 1
    hits, wrong, quoted, score = (np.zeros(docs, np.int64) for _ in range(4))
    score = score.astype(np.float64)
    chars, start, end, first, which, term, edits = matches(data, off, m, terms, allowed)
    off = A.characters(data, off)[1] if len(which) else off
    doc = np.searchsorted(first, which, "right") - 1
    low = np.maximum(which - WINDOW, first[doc])
    high = np.minimum(which + WINDOW, first[doc + 1] - 1)
    crowded = np.zeros(len(which), bool)
    if len(which) > 1:
        close = (np.diff(which) <= WINDOW) & (np.diff(doc) == 0)
        crowded[1:] |= close
        crowded[:-1] |= close
    for i in range(len(which)):
        w, d = which[i], doc[i]
        # from the end of the word before the window to the start of the word after it, so that marks count
        a = end[low[i] - 1] if low[i] > first[d] else off[d]
        b = start[high[i] + 1] if high[i] + 1 < first[d + 1] else off[d + 1]
        factor, quote = context(_text(chars[a : start[w]]), _text(chars[end[w] : b]), bool(crowded[i]))
        hits[d] += 1
        wrong[d] += edits[i] > 0
        quoted[d] += quote
        score[d] += weights[term[i], edits[i]] * factor
    return [hits, wrong, quoted, np.round(score / np.maximum(1, np.diff(first) / STRETCH), 6)]


def weighted(lexicon: dict[str, float] | Weights | None = None) -> Weights:
    """The weights of each term in lower case at 0, 1 and 2 edits; one number gives all three."""
    given = LEXICON if lexicon is None else lexicon
    if not all(t.isalnum() for t in given):
        raise ValueError("terms are single words of letters and digits")
    return {t.lower(): tuple(w) if isinstance(w, (tuple, list)) else tuple(w * e for e in EDITS) for t, w in given.items()}


def word_hashes(chars: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return A.span_hash(A.prefix_hash(A.mix(chars.astype(np.uint64) + np.uint64(1))), start, end)


def least_shingle(h: np.ndarray, first: np.ndarray, size: int = 5) -> np.ndarray:
    """The least hash of `size` words in a row, for each text; of all its words where there are fewer. 0 without words."""
    prefix, n = A.prefix_hash(h), np.diff(first)
    count = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    at = A.ragged(first[:-1], count)
    x = A.span_hash(prefix, at, np.minimum(at + size, np.repeat(first[1:], count)))
    out, some = np.zeros(len(n), np.uint64), np.flatnonzero(count)
    if len(some):
        out[some] = np.minimum.reduceat(x, np.cumsum(count)[some] - count[some])
    return out


def _neighbours(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of the words before and after each word of its text."""
    before, after = np.zeros(len(h), np.uint64), np.zeros(len(h), np.uint64)
    before[1:], after[:-1] = h[:-1], h[1:]
    edge = first[(first > 0) & (first < len(h))]
    before[edge] = 0
    after[edge - 1] = 0
    return A.mix(before * A.MIX1 + after)


def g_test(a: int, b: int, na: int, nb: int) -> float:
    """The G statistic of a in na against b in nb."""
    n, k = na + nb, a + b
    return 2 * sum(o * math.log(o * n / (row * col)) for o, row, col in ((a, k, na), (b, k, nb), (na - a, n - k, na), (nb - b, n - k, nb)) if o > 0)


def _leans(a: int, b: int, na: int, nb: int, least: float) -> bool:
    return (a + 0.5) / (na + 1) >= RATIO * (b + 0.5) / (nb + 1) and g_test(a, b, na, nb) >= least


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lexicon: dict[str, float] | None = None, allowed: frozenset[str] = ALLOWED, most: int = LABELLED) -> Weights:
    """The lexicon with the terms and the shares that labelled documents show. labels has doc_id and toxic (0 or 1)."""
    spark, given = docs.sparkSession, weighted(lexicon)
    disk = Scratch(spark)
    sample = labels.select(F.col("doc_id").cast("long").alias("i"), F.col("toxic").cast("int").alias("toxic")).filter("i IS NOT NULL AND toxic IS NOT NULL")
    sample = sample.groupBy("i").agg((F.max("toxic") > 0).alias("toxic")).orderBy(F.xxhash64("i"), "i").limit(most)
    rows = docs.select(col(id_col).cast("long").alias("i"), col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    rows = rows.join(F.broadcast(sample), "i")  # LABELLED rows at most

    def sketch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, off = A.utf8(b.column(1))
        out = []
        for i, j in A.chunks(off):
            chars, start, end, first = split(data[off[i] : off[j]], off[i : j + 1] - off[i])
            out.append(least_shingle(word_hashes(chars, start, end), first))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(out or [np.zeros(0, np.uint64)]).view(np.int64))], ["i", "text", "toxic", "shingle"])

    def texts_of(b: pa.RecordBatch) -> Iterator[tuple]:
        data, off = A.utf8(b.column(0))
        toxic = b.column(1).to_numpy(zero_copy_only=False)
        for i, j in A.chunks(off):
            yield data[off[i] : off[j]], off[i : j + 1] - off[i], toxic[i:j]

    def counts(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for data, off, toxic in texts_of(b):
            chars, start, end, first = split(data, off)
            h, doc = word_hashes(chars, start, end), np.repeat(np.arange(len(toxic)), np.diff(first))
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))[: len(h)]
            h, t = h[new], toxic[doc[new]]
            word, at = np.unique(h, return_index=True)
            n = np.diff(np.append(at, len(h)))
            bad = np.add.reduceat(t.astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
            n_words = np.diff(first)
            # the row of word 0 has the numbers of texts, and that of word 1 those of words
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(([0, 1], word.view(np.int64)))), pa.array(np.concatenate(([toxic.sum(), n_words[toxic].sum()], bad))), pa.array(np.concatenate(([(~toxic).sum(), n_words[~toxic].sum()], n - bad)))],
                ["word", "bad", "good"],
            )

    texts = disk.keep(A.map_batches(rows, sketch, "i long, text string, toxic boolean, shingle long"), "labelled")
    one = texts.groupBy("shingle").agg(F.min("i").alias("i"))  # LABELLED rows at most
    texts = texts.join(F.broadcast(one), ["shingle", "i"], "left_semi").select("text", "toxic")
    counted = disk.keep(A.map_batches(texts, counts, "word long, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "words")
    total = {r.word: (r.bad, r.good) for r in counted.filter("word IN (0, 1)").collect()}
    na, nb = total.get(0, (0, 0))
    wa, wb = total.get(1, (0, 0))
    # the words of the sample that lean to toxic texts; which of them are terms is decided by their neighbours
    lean = counted.filter((F.col("bad") >= LEAST_TEXTS) & ((F.col("bad") + 0.5) / (na + 1) >= RATIO * (F.col("good") + 0.5) / (nb + 1)) & ~F.col("word").isin(0, 1))
    wanted = np.sort(np.array([r.word for r in lean.select("word").collect()], np.int64).view(np.uint64))
    words = spark.sparkContext.broadcast(wanted)

    def places(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for data, off, toxic in texts_of(b):
            chars, start, end, first = split(data, off)
            h = word_hashes(chars, start, end)
            at = np.minimum(np.searchsorted(words.value, h), max(len(words.value) - 1, 0))
            hit = np.flatnonzero(words.value[at] == h) if len(words.value) else np.zeros(0, np.int64)
            near, doc = _neighbours(h, first)[hit].view(np.int64), np.searchsorted(first, hit, "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array([_text(chars[start[w] : end[w]]) for w in hit.tolist()], pa.string()), pa.array(near), pa.array(toxic[doc])], ["term", "near", "toxic"])

    per_label = (F.count_distinct(F.when(F.col("toxic"), F.col("near"))).alias("bad"), F.count_distinct(F.when(~F.col("toxic"), F.col("near"))).alias("good"))
    found = {r.term: (r.bad, r.good) for r in A.map_batches(texts, places, "term string, near long, toxic boolean").groupBy("term").agg(*per_label).collect()} if len(wanted) else {}
    log_odds = lambda a, b: math.log((a + 0.5) / (wa + 1)) - math.log((b + 0.5) / (wb + 1))
    terms = {t: round(min(1.0, log_odds(a, b) / NEEDED), 4) for t, (a, b) in sorted(found.items()) if t not in given and len(t) > 2 and t.isalpha() and _leans(a, b, wa, wb, LEAST_G)}
    out = given | {t: tuple(w * e for e in EDITS) for t, w in terms.items()}
    names = tuple(out)
    table = spark.sparkContext.broadcast(automaton(names))

    def forms(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for data, off, toxic in texts_of(b):
            chars, start, end, first, which, term, edits = matches(data, off, table.value, names, allowed)
            near, doc = _neighbours(word_hashes(chars, start, end), first)[which].view(np.int64), np.searchsorted(first, which, "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(edits), pa.array(near), pa.array(toxic[doc])], ["term", "edits", "near", "toxic"])

    seen = A.map_batches(texts, forms, "term long, edits long, near long, toxic boolean").groupBy("term", "edits").agg(*per_label).collect()  # three rows a term at most
    share = {(names[r.term], r.edits): (r.bad + 1) / (r.bad + r.good + 1) for r in seen if r.edits or names[r.term] in given}
    disk.drop("labelled", "words")
    return {t: tuple(round(w * share.get((t, e), 1.0), 4) for e, w in enumerate(ws)) for t, ws in out.items()}


def lexicon_of(docs: DataFrame, sf_dir: str) -> Weights:
    """What the labels beside the documents teach; LEXICON alone where there are none."""
    spark, path = docs.sparkSession, f"{sf_dir}/labels.parquet"
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        return weighted()
    return learn(docs, spark.read.parquet(path))


def scores(docs: DataFrame, text_col: str = "text", lexicon: dict[str, float] | Weights | None = None, allowed: frozenset[str] = ALLOWED) -> Column:
    """A column over docs: the struct of n_hits, n_misspelled, n_quoted and score. Only the text goes to Python, and only figures come back."""
    given = {t: w for t, w in weighted(lexicon).items() if max(w) >= LEAST_WEIGHT}
    terms = tuple(given)
    limits = tuple(max(e for e in range(allowed_edits(t) + 1) if e == 0 or w[e] >= LEAST_WEIGHT) for t, w in given.items())
    table = docs.sparkSession.sparkContext.broadcast((automaton(terms, limits), np.array(list(given.values()), np.float64).reshape(-1, 3)))  # grows with the lexicon alone

    @F.arrow_udf("n_hits long, n_misspelled long, n_quoted long, score double")
    def judged(text: pa.Array) -> pa.Array:
        m, weights = table.value
        data, off = A.utf8(text)
        parts = [judge(data[off[i] : off[j]], off[i : j + 1] - off[i], m, terms, weights, allowed) for i, j in A.chunks(off)]
        found = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
        return pa.StructArray.from_arrays([pa.array(x) for x in found], ["n_hits", "n_misspelled", "n_quoted", "score"])

    A.small_batches(docs)
    return judged(col(text_col).cast("string"))


def toxicity(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), lexicon: dict[str, float] | Weights | None = None, allowed: frozenset[str] = ALLOWED, threshold: float = THRESHOLD) -> DataFrame:
    """The columns of `keep`, n_hits, n_misspelled, n_quoted, score and toxic, for each row of docs."""
    keep = tuple(c for c in keep if c not in RESULTS)
    rows = docs.select(*(col(c).alias(f"k{k}") for k, c in enumerate(keep)), scores(docs, text_col, lexicon, allowed).alias("found"))
    return rows.select(*(F.col(f"k{k}").alias(c) for k, c in enumerate(keep)), "found.*", (F.col("found.score") >= threshold).alias("toxic"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxic documents, with their scores."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return toxicity(docs, lexicon=lexicon_of(docs, sf_dir)).filter("toxic")


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLE: dict[str, str] = {}
