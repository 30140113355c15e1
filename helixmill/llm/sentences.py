"""Sentence boundaries across languages and scripts, by document-centred disambiguation.

Whether the full stop after a word belongs to the word is decided by the word's unambiguous occurrences elsewhere: followed
by a small letter or a comma it is an abbreviation, standing without a stop it is an ordinary word; a capital word that is
seen in small letters elsewhere is capital here because it starts a sentence, one that is seen capital amid sentences is a
name. The document itself is asked first, then counts over the whole corpus, then short lists of fixed values. Each script
has its own terminators and rules. Quotations and brackets belong to the sentence around them.

Three passes: one counts words over all documents (combined before the shuffle), one names the words a text may ask the corpus
for, one segments each text whole. Counts of words with a share of at least MIN_SHARE of all words are broadcast, at most
1 / MIN_SHARE entries; those of all other words asked for come to the texts by a join.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixmill.session import checkpointed, spread

#: Least share of all words from which the counts of a word are broadcast, at most 500,000 entries; rarer words are joined.
MIN_SHARE = 2e-6

# Abbreviations before a name, which do not end a sentence.
TITLES = frozenset(
    """Mr Mrs Ms Mx Dr Drs Prof Capt Col Gen Lt Sgt Maj Cmdr Rev Fr Hon Gov Sen Rep Pres St Ste Mt Messrs
    M MM Mme Mmes Mlle Me Mgr Pr Hr Hrn Fa Frl Dipl Ing Mag Sr Sra Srta Sres D Dña Ud Uds Lic Exc
    Проф проф Др др Гр гр Им им Акад акад ул г-н г-жа Κ κ Κα κα Δρ δρ Καθ καθ د أ م डॉ श्री श्रीमती प्रो""".split()
)
# Abbreviations that close a list and so end a sentence before a capital.
CLOSERS_OF_LISTS = frozenset("etc usw etcétera usf u.s.w т.д т.п т.д др κ.λπ κλπ κ.ά".split())
# Abbreviations before a number or a small letter.
REFERENCES = frozenset(
    """fig figs vol vols no nos nr pp pg pgs ch chap chs sec secs eq ex ref tab art al app approx ca cca cf vs incl est max min
    chr av abb bd kap bsp evtl ggf bzw vgl sog inkl zzgl geb env éd réf núm pág págs aprox ed cap
    рис табл стр гл ок см им илл σελ εικ βλ περ κεφ αρ पृ सं""".split()
)
# Words before a German or Nordic ordinal number.
ORDINAL_LEADS = frozenset("der die das den dem des am im vom zum zur beim ans ins seit bis ab pro jeder jeden jedem jede dieser diesem diesen dieses kl den det de til".split())

# Vowel signs and other marks of Devanagari, which are no \w, belong to its words.
_SIGNS = "\u0900-\u0903\u093a-\u093c\u093e-\u094f\u0951-\u0957\u0962\u0963"
# Parts of addresses are no words.
_WORD = re.compile(rf"(?<![\w@.{_SIGNS}])[^\W\d_](?:[\w'’\-{_SIGNS}]|\.(?=\w))*+(?!@)")
# Possessive repeats and the look-behind keep the work linear in long unbroken strings.
_STOPPED = re.compile(rf"(?<![\w'’\-.{_SIGNS}])([^\W\d_](?:[\w'’\-{_SIGNS}]|\.(?=\w))*+)\.(?:(?=[,;:])|\s++(?=(\S++)))")
_OPENING = re.compile(r"(?:\A\s*+|\n\n|[!?]\s++)([^\W\d_](?:[\w'’\-])*)")
_AMID = re.compile(r"[^\W\d_A-Z],?\s([^\W\d_](?:[\w'’\-])*)")
_NEXT = re.compile(r"[^\W_](?:[\w'’\-])*")
TOTAL, LOW, NUM, CAP, START, MID, ORDINARY = range(7)


def count_words(text: str, into: Counter) -> None:
    """Add a text's evidence: every word, words with a stop by what follows (and whether the text also has the capital word that
    does in small letters), capital words at sure starts and amid sentences."""
    words = _WORD.findall(text)
    for w in words:
        into[(TOTAL, w)] += 1
    if "." in text:
        seen = set(words)
        for w, c in _STOPPED.findall(text):
            # a capital within the next few letters (mRNA) speaks for a sentence start as one in front does
            d = c.lstrip("“„«»‘‚‹「『（([【《〈\"'—–-¿¡")
            if c == "" or d:
                kind = NUM if d[:1].isdigit() else LOW if d == "" or d[:4].islower() else CAP
                into[(kind, w)] += 1
                if kind == CAP and (n := _NEXT.match(d)) and n.group() != (small := n.group().lower()) and small in seen:
                    into[(ORDINARY, w)] += 1
    for w in _OPENING.findall(_EMPTY_LINE.sub("\n\n", text)):
        if w[0].isupper():
            into[(START, w)] += 1
    for w in _AMID.findall(text):
        if w[0].isupper():
            into[(MID, w)] += 1


_EMPTY_LINE = re.compile(r"\r?\n[ \t　]*\r?\n\s*")
# Every script's own terminators, by their Unicode property; without the Burmese comma-like sign and the dot leader, with the Tibetan
# and the Sinhala signs, which the property lacks.
_SIGNS_OF_ENDS = (frozenset(regex.findall(r"\p{Sentence_Terminal}", "".join(map(chr, (*range(0xD800), *range(0xE000, 0x20000)))))) - {"\u104a", "\u2024"}) | set("།༎෴")
_ASKING = frozenset("!?‼⁇⁈⁉‽⸮")
_IDEOGRAPHIC = frozenset("。！？｡．︒︕︖﹒﹖﹗")
_SCRIPT = _SIGNS_OF_ENDS - _ASKING - _IDEOGRAPHIC - {"."}
_MARKS = re.compile("[" + "".join(map(re.escape, sorted(_SIGNS_OF_ENDS | _IDEOGRAPHIC | {"…"}))) + "]+|;")
_PROTECT = re.compile(r"[\"'“”„«»‘’‚‹›「」『』（）()\[\]【】《》〈〉〔〕—]")
_PAIRS = {"“": "”", "„": "“”", "‘": "’", "‚": "‘’", "«": "»", "»": "«", "‹": "›", "›": "‹", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "【": "】", "《": "》", "〈": "〉", "〔": "〕", '"': '"', "'": "'", "—": "—"}
_SHUTS = frozenset("”“»«’‘」』）)]】》〉〔〕›‹\"'")
_OPENS = frozenset("“„«»‘‚‹「『（([【《〈〔\"'—–-¿¡")
_ROUND = frozenset("（([【〔")
#: Scripts that write no sentence marks: Thai, Lao.
_UNMARKED = re.compile(r"(?<=[ก-໿])[ \t 　]+(?=[ก-໿])")
_UNMARKED_ANY = re.compile(r"[ก-໿]")
_BREAK = re.compile(r".*[\s(\[\"“«„‘（「『/。！？，、：；…぀-ヿ㐀-鿿]", re.S)
_DEVANAGARI = re.compile(r"[\u0900-\u0963\u0966-\u097f](?:[\u0900-\u0963\u0966-\u097f.]*[\u0900-\u0963\u0966-\u097f])?\Z")
_NUMBER = re.compile(r"^[\d.,:/-]*\d$")
_DOTTED = re.compile(r"^(?:[^\W\d_]{1,2}\.)+[^\W\d_]{1,2}$")


def _protected(p: str) -> list[tuple[int, int]]:
    """Outermost quotations, brackets and dash-marked speech of a paragraph, as (opening, closing) places."""
    stack: list[tuple[str, int]] = []
    open_: Counter = Counter()
    out: list[tuple[int, int]] = []
    n = len(p)

    def push(c: str, i: int) -> None:
        stack.append((c, i))
        for x in _PAIRS[c]:
            open_[x] += 1

    def shut(at: int) -> None:
        for c, _ in stack[at:]:
            for x in _PAIRS[c]:
                open_[x] -= 1
        del stack[at:]

    for m in _PROTECT.finditer(p):
        c, i = m.group(), m.start()
        before = p[i - 1] if i else " "
        after = p[i + 1] if i + 1 < n else " "
        if c in "'’" and before.isalnum() and after.isalnum():
            continue
        at = next((k for k in range(len(stack) - 1, -1, -1) if c in _PAIRS[stack[k][0]]), -1) if open_[c] else -1
        if c == "—":
            if at >= 0 and before.isspace():
                out.append((stack[at][1], i))
                shut(at)
            elif at < 0 and not after.isspace() and (i == 0 or before.isspace() and not _token_before(p, i)[0][-1:].isalnum()):
                push(c, i)
            continue
        if at >= 0 and not (c in "'\"" and before.isspace() and not after.isspace()):
            out.append((stack[at][1], i))
            shut(at)
        elif c in _PAIRS and not (c in "'\"" and (after.isspace() or before.isalnum())) and not (c in "‘" and before.isalnum()):
            push(c, i)
    out.sort()
    top: list[tuple[int, int]] = []
    for o, s in out:
        if not top or o > top[-1][1]:
            top.append((o, s))
        elif s > top[-1][1]:
            top[-1] = (top[-1][0], s)
    return top


def _wide(c: str) -> bool:
    """A character of a script that writes no blanks between words: CJK, kana."""
    return "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "豈" <= c <= "﫿" or "\U00020000" <= c <= "\U0003ffff"


class Evidence:
    """What a document, and behind it the corpus, knows about words."""

    def __init__(self, corpus: dict[str, tuple[int, ...]], *texts: str, rare: dict[str, tuple[int, ...]] | None = None) -> None:
        self.corpus, self.texts, self.rare = corpus, texts, rare or {}
        self.own: Counter | None = None

    def of(self, kind: int, w: str) -> int:
        if self.own is None:
            self.own = Counter()
            for t in self.texts:
                count_words(t, self.own)
        return self.own[(kind, w)]

    def abbreviation(self, w: str) -> bool:
        """Whether a stop after ``w`` belongs to it."""
        if any(x.isdigit() for x in w):
            return False
        if len(w) == 1 or _DOTTED.match(w):
            return True
        listed = w in TITLES or w in CLOSERS_OF_LISTS or w.lower() in REFERENCES and w.lower() not in ("no", "max", "min", "art", "tab", "app", "ex", "ed", "est", "cap", "al")
        for source in (self.of, self._known):
            total, low, num, cap = (source(k, w) for k in (TOTAL, LOW, NUM, CAP))
            stopped, bare = low + num + cap, total - low - num - cap
            # a number may start a sentence: it speaks for an abbreviation only where the corpus mostly has one there
            inside = low + (num if source != self.of and num * 2 >= stopped else 0)
            if stopped >= 2 and bare * 2 <= stopped and inside >= 0.2 * stopped and inside:
                return True
            if listed:
                # the list decides where both are silent; as some leave out a title's stop, only a word that mostly has none is ordinary
                if source == self.of and stopped >= 2 and not bare:
                    return True
                if bare >= 3 and bare > 2 * stopped and low * 10 <= (0 if source == self.of else bare):
                    return False
            elif source == self.of:
                if bare > 0 and not low:
                    return False
            elif stopped >= 20 and bare * 50 <= stopped and cap >= 0.9 * stopped and len(w) <= 5 and not w[0].islower():
                # in a script without capitals, whatever letter follows counts as one
                return True
        return listed

    def counted(self, w: str) -> bool:
        """Whether a number after the stop of ``w`` is what the corpus mostly has there (no. 7)."""
        low, num, cap = (self._known(k, w) for k in (LOW, NUM, CAP))
        if w.lower() in REFERENCES and (num * 10 >= low + num + cap or low + num + cap < 20):
            return True
        return num >= 3 and num * 2 >= low + num + cap

    def names_follow(self, w: str) -> bool:
        """Whether ``w`` stands with a stop only, before capital words that nothing shows to be ordinary: a title, or the like."""
        total, low, num, cap = (self._known(k, w) for k in (TOTAL, LOW, NUM, CAP))
        return len(w) > 1 and cap >= 20 and (low + num) * 10 <= cap and (total - cap) * 10 <= total and self._known(ORDINARY, w) * 50 <= cap

    def closes(self, w: str) -> bool:
        """Whether ``w``, written small, stands with a stop only and nothing but capital words follow, ordinary ones among them: it ends sentences."""
        total, low, num, cap = (self._known(k, w) for k in (TOTAL, LOW, NUM, CAP))
        return w[0].islower() and cap >= 20 and not low + num and (total - cap) * 50 <= total and self._known(ORDINARY, w) * 20 >= cap

    def name(self, w: str) -> bool:
        """Whether a capital word is rather seen amid sentences than at their starts."""
        return self.of(MID, w) > self.of(START, w) or self._known(MID, w) > self._known(START, w)

    def always_stopped(self, w: str) -> bool:
        """Whether the corpus knows ``w`` with a stop only."""
        total, stopped = self._known(TOTAL, w), sum(self._known(k, w) for k in (LOW, NUM, CAP))
        return w.isalpha() and stopped >= (5 if len(w) <= 3 else 20) and (total - stopped) * 50 <= total

    def _known(self, kind: int, w: str) -> int:
        e = self.corpus.get(w) or self.rare.get(w)
        return e[kind] if e else 0

    def common(self, w: str, small_only: bool = False) -> bool:
        """Whether a capital word is an ordinary one, capital because it starts a sentence.

        It is if seen in small letters; or, unless ``small_only``, if seen at sure starts more than amid sentences.
        """
        if len(w) > 1 and w.isupper():
            return False
        small = w.lower()
        if small == w:
            return False
        if self.of(TOTAL, small):
            return True
        if self.of(MID, w) > self.of(START, w):
            return False
        if self._known(TOTAL, small) * 2 >= self._known(MID, w) and self._known(TOTAL, small):
            return True
        start, mid = self._known(START, w), self._known(MID, w)
        return not small_only and start >= 2 and start > mid


def _word_before(p: str, k: int) -> str:
    """What stands unbroken before place ``k``; of a Devanagari word, what is in Devanagari."""
    size, near, m = 64, "", None
    while m is None and len(near) < k:
        near = p[max(0, k - size) : k]
        m = _BREAK.match(near)
        size *= 2
    near = near[m.end() :] if m else near
    m = _DEVANAGARI.search(near)
    return m.group() if m else near


def _token_before(p: str, k: int) -> tuple[str, int]:
    """The last stretch without blanks before place ``k``, and where it begins."""
    while k and p[k - 1].isspace():
        k -= 1
    at = k
    while at and not p[at - 1].isspace():
        at -= 1
    return p[at:k], at


def asked(text: str) -> set[str]:
    """The words a text may ask the corpus for: those before a single full stop that a blank follows, and those behind it."""
    out: set[str] = set()
    for m in _MARKS.finditer(text):
        if m.group() != ".":
            continue
        j = m.end()
        while j < len(text) and (text[j].isspace() or text[j] in _OPENS or text[j] in _SHUTS):
            j += 1
        if j > m.end() and j < len(text):
            w = _word_before(text, m.start())
            out.update((w, re.split(r"['’]", w)[-1]))
            if n := _NEXT.match(text, j):
                out.update((n.group(), n.group().lower()))
    return out


def _letter_after(p: str, j: int) -> int:
    """Place of the first character at or after ``j`` that opens nothing and is no blank."""
    while j < len(p) and (p[j] in _OPENS or p[j].isspace()):
        j += 1
    return j


def _stop_ends(p: str, k: int, j: int, ev: Evidence) -> bool:
    """Whether the single full stop at ``k``, the next text being at ``j``, ends a sentence."""
    c = p[j]
    w = _word_before(p, k)
    tail = re.split(r"['’]", w)[-1] if "'" in w or "’" in w else w
    at = _letter_after(p, j)
    d = p[at] if at < len(p) else ""
    word = m.group() if (m := _NEXT.match(p, at)) else ""
    if not w:
        return not d.islower()
    if _NUMBER.match(w):
        if d.islower():
            return not word.islower() and word.isalnum() and len(word) > 2
        if d.isupper():
            if _token_before(p, k - len(w))[0].lower() in ORDINAL_LEADS and w.isdigit() and len(w) <= 3:
                return ev.common(word) and not (c in _OPENS)
        return True
    abbr = ev.abbreviation(w) or (tail != w and tail != "" and ev.abbreviation(tail))
    if d.islower():
        return not abbr and c not in _OPENS and any(x.isupper() for x in word)
    if d.isdigit():
        return not (abbr or ev.counted(w) or ev.counted(tail)) or w in CLOSERS_OF_LISTS
    if not d.isalpha():
        return not abbr or w in CLOSERS_OF_LISTS
    initial = len(word) == 1 and p[at + 1 : at + 2] == "."
    if not abbr:
        # a word that never stands without a stop, before a word that nothing shows to start sentences
        return not (d.isupper() and ev.always_stopped(w) and not (ev.closes(w) and not ev.name(word)) and (initial or not ev.common(word)))
    if not d.isupper():
        # scripts without capitals: a stop after an abbreviation stays with it
        return False
    titled = len(word) > 1 and p[at + len(word) : at + len(word) + 1] == "."
    if ev.names_follow(w) or ev.names_follow(tail):
        # a title goes with the name; what is written small and no title may end a sentence before one
        return w[0].islower() and titled and ev.names_follow(word)
    if w in TITLES and len(w) > 1 or tail in TITLES and len(tail) > 1:
        return False
    if ev.closes(w) and not initial and not ev.name(word):
        return True
    last, at_last = _token_before(p, k)
    if w in CLOSERS_OF_LISTS or _token_before(p, at_last)[0] + last in CLOSERS_OF_LISTS:
        return True
    if titled and (word in TITLES or ev.names_follow(word)):
        return True
    # after one letter, an initial or a title, a name that often starts sentences is still a name
    return not initial and ev.common(word, small_only=len(w) == 1)


def _ends(p: str, run: str, k: int, e: int, inner: str, ev: Evidence) -> bool:
    """Whether the marks ``run`` at ``k`` end a sentence at ``e`` (after closing marks); ``inner``: what they stand in, or empty."""
    j = e
    while j < len(p) and p[j].isspace():
        j += 1
    if j == len(p):
        return False
    blank, c = j > e, p[j]
    at = _letter_after(p, j)
    d = p[at] if at < len(p) else ""
    if run == ";":
        before = p[:k].rstrip()[-1:]
        return not inner and blank and "Ͱ" <= before <= "Ͽ" and not d.islower()
    dots = run.strip(".") == "" or run.strip("….") == ""
    if dots and (len(run) > 1 or "…" in run):
        return d.isupper() and (blank or "…" in run) and (not inner or blank)
    if any(x in _IDEOGRAPHIC for x in run):
        if run in "．﹒" and p[k - 1 : k].isdigit() and c.isdigit() and not blank:
            return False
        if not inner:
            return True
        # brackets close a sentence unless a particle or a pause goes on with it; quotations go on unless a blank follows
        return not ("぀" <= c <= "ゟ" or c in ",，、;；:：") if inner in _ROUND else blank and (d.isupper() or _wide(d)) and c not in ",，、"
    if any(x in _SCRIPT for x in run):
        # a sign may stand twice, with a blank between
        return c not in _SCRIPT and (not inner or inner in _ROUND and blank or d.isupper() and blank)
    if any(x in _ASKING for x in run):
        if not blank:
            return not inner and _wide(c) and _wide(p[k - 1 : k] or " ")
        if inner:
            return d.isupper() or d.isdigit()
        return not d.islower() or any(x.isupper() for x in (_NEXT.match(p, at).group() if d.isalpha() else ""))
    if not blank:
        return False
    if inner:
        if not (d.isupper() or d.isdigit()):
            return False
        w = _word_before(p, k)
        return inner not in _ROUND or not ev.abbreviation(w) or ev.common(_NEXT.match(p, at).group())
    return _stop_ends(p, k, j, ev)


def _paragraph(p: str, base: int, ev: Evidence, out: list[tuple[int, int]]) -> None:
    cuts: list[int] = []
    guards = _protected(p) if _PROTECT.search(p) else []
    openings = {o for o, _ in guards}
    g = 0
    for m in _MARKS.finditer(p):
        k, e = m.start(), m.end()
        while g < len(guards) and guards[g][1] < k:
            g += 1
        inner = ""
        if g < len(guards) and guards[g][0] < k:
            o, s = guards[g]
            while e <= s and (p[e] in _SHUTS or p[e].isspace() or e == s):
                e += 1
            if e <= s:
                continue
            inner = p[o]
        while e < len(p) and p[e] in _SHUTS and not (p[e] in "\"'" and e + 1 < len(p) and not p[e + 1].isspace() and p[e + 1] not in ".,;:!?)"):
            if e in openings:
                break
            e += 1
        if _ends(p, m.group(), k, e, inner, ev):
            cuts.append(e)
    if _UNMARKED_ANY.search(p):
        for m in _UNMARKED.finditer(p):
            if not any(o < m.start() < s for o, s in guards):
                cuts.append(m.start())
        cuts = sorted(set(cuts))
    at = 0
    for cut in [*cuts, len(p)]:
        piece = p[at:cut]
        lead = len(piece) - len(piece.lstrip())
        body = piece.strip()
        if body:
            out.append((base + at + lead, base + at + lead + len(body)))
        at = cut


def sentences(text: str, ev: Evidence, base: int = 0) -> list[tuple[int, int]]:
    """Sentences of a text as (from, to) code-point offsets plus ``base``; blanks around them are left out."""
    out: list[tuple[int, int]] = []
    at = 0
    for m in _EMPTY_LINE.finditer(text):
        _paragraph(text[at : m.start()], base + at, ev, out)
        at = m.end()
    _paragraph(text[at:], base + at, ev, out)
    return out


def _prose(docs: DataFrame, key: str, text: str, spans: DataFrame | None) -> DataFrame:
    """(doc_id, at, text, lo, hi): a row a document, its text from place ``at``, and the places of its spans; null is all of it.

    Spans meet their document once, all in one row, so that each can ask the others; kept as a checkpoint, as both passes read it.
    """
    d = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).filter("text is not null")
    if spans is None:
        none = F.lit(None).cast("array<int>")
        return spread(d).select("doc_id", F.lit(0).cast("long").alias("at"), "text", none.alias("lo"), none.alias("hi"))
    s = spans.filter("span_from < span_to and span_to > 0").select("doc_id", F.struct(F.greatest("span_from", F.lit(0)).cast("int").alias("lo"), F.col("span_to").cast("int").alias("hi")).alias("s"))
    s = s.groupBy("doc_id").agg(F.sort_array(F.collect_set("s")).alias("s"), F.min("s.lo").alias("from"), F.max("s.hi").alias("to"))
    j = spread(d).join(s, "doc_id")
    part = F.substr("text", F.col("from") + 1, F.col("to") - F.col("from"))
    return checkpointed(j.select("doc_id", F.col("from").cast("long").alias("at"), part.alias("text"), F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi")).filter("text <> ''"))


def _read(b: pa.RecordBatch) -> Iterator[tuple[int, list[tuple[int, str]], list[str]]]:
    """Of each row: its number, its spans as (place, text), and what they cover, so that overlapping ones count once."""
    for i, (at, text, lo, hi) in enumerate(zip(b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist())):
        t = text.as_py()
        if lo is None:
            yield i, [(at, t)], [t]
            continue
        covered: list[list[int]] = []
        for x, y in zip(lo, hi):
            if covered and x < covered[-1][1]:
                covered[-1][1] = max(covered[-1][1], y)
            else:
                covered.append([x, y])
        yield i, [(x, t[x - at : y - at]) for x, y in zip(lo, hi)], [t[x - at : y - at] for x, y in covered]


def corpus_counts(prose: DataFrame) -> tuple[dict[str, tuple[int, ...]], DataFrame]:
    """Counts of the words of all prose: of the frequent ones, at most 1 / MIN_SHARE; and (word, n) of all others."""
    schema = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def send() -> pa.RecordBatch:
            keys = list(seen)
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int32()), pa.array([w for _, w in keys], pa.string()), pa.array(list(seen.values()), pa.int64())], schema.names)

        for b in batches:
            for _, _, covered in _read(b):
                for t in covered:
                    count_words(t, seen)
                if len(seen) > 1 << 18:
                    yield send()
                    seen.clear()
        if seen:
            yield send()

    by = prose.mapInArrow(run, schema).groupBy("word").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(7)])
    by = checkpointed(by)
    all_ = by.agg(F.sum("n0")).first()[0] or 0
    often = F.col("n0") >= all_ * MIN_SHARE
    rows = by.filter(often).toArrow()
    counts = np.stack([rows.column(f"n{k}").to_numpy() for k in range(7)], 1).tolist() if rows.num_rows else []
    rare = by.filter(~often).select("word", F.array(*[f"n{k}" for k in range(7)]).alias("n"))
    return {w: tuple(c) for w, c in zip(rows.column("word").to_pylist(), counts)}, rare


def _with_rare(prose: DataFrame, corpus: Broadcast, rare: DataFrame) -> DataFrame:
    """The prose with ``rare``: (word, n) of the words each text may ask for that the broadcast counts lack, or null.

    Texts are told apart by a hash; should two share one, each also gets the other's words, which does no harm.
    """
    keyed = prose.withColumn("__h", F.xxhash64("text"))
    schema = T.StructType([T.StructField("__h", T.LongType()), T.StructField("word", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[int] = []
            words: list[str] = []
            for i, spans, _ in _read(b):
                want = set().union(*(asked(t) for _, t in spans)) - corpus.value.keys()
                rows.extend([i] * len(want))
                words.extend(want)
            if words:
                yield pa.RecordBatch.from_arrays([b.column(5).take(pa.array(rows)), pa.array(words, pa.string())], schema.names)

    got = keyed.mapInArrow(run, schema).distinct().join(rare, "word").groupBy("__h").agg(F.collect_list(F.struct("word", "n")).alias("rare"))
    return keyed.join(got, "__h", "left").select(*prose.columns, "rare")


def split_sentences(docs: DataFrame, key: str, text: str, spans: DataFrame | None = None) -> DataFrame:
    """Sentences of every document: (doc_id, sent_from, sent_to), 0-based code-point offsets in the text, end exclusive.

    With ``spans`` (doc_id, span_from, span_to) only those parts of the texts are read, each segmented on its own by the
    evidence of all spans of its document; a repeated span counts once and one beyond the text is cut to it. Null, empty and blank texts have no sentences; a text of any length is
    segmented whole; documents repeated under one key give their sentences each time; an empty table gives an empty result.
    """
    prose = _prose(docs, key, text, spans)
    often, rare = corpus_counts(prose)
    corpus = docs.sparkSession.sparkContext.broadcast(often)
    schema = T.StructType([T.StructField("doc_id", prose.schema["doc_id"].dataType), T.StructField("sent_from", T.LongType()), T.StructField("sent_to", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[int] = []
            found: list[tuple[int, int]] = []
            for i, spans_, covered in _read(b):
                ev = Evidence(corpus.value, *covered, rare={x["word"]: x["n"] for x in b.column(5)[i].as_py() or ()})
                for at, t in spans_:
                    got = sentences(t, ev, at)
                    rows.extend([i] * len(got))
                    found.extend(got)
            if found:
                ends = np.array(found, np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(ends[:, 0]), pa.array(ends[:, 1])], schema.names)

    return _with_rare(prose, corpus, rare).mapInArrow(run, schema)
