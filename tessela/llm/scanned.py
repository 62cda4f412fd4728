"""Repair of text from scanned pages.

An averaged perceptron edits characters (keep, replace, delete, insert), a second one decides whether a line is
joined with the next, a third one finds running headers, footers and page numbers by their place on the page.
All three are trained here: clean lines of the collection are damaged on purpose, and what was done is what is
to be undone.  The lexicon is counted over all clean texts.
"""

from __future__ import annotations

import random
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessela.session import cut_lineage

#: Most lines of a scanned page are no longer than this.
WIDEST = 110
#: Share of all words from which a word counts as known; so at most 1 / share words are.
KNOWN_SHARE = 1e-5
KNOWN_LEAST = 4
#: Words and lines that the perceptrons are trained on, at most, and the length of such a line.
TRAIN_WORDS = 9_000
TRAIN_LINES = 2_000
LINE = 4_000

# What is on the page, and what recognition makes of it.
CONFUSIONS = (
    ("a", "@"), ("e", "c"), ("o", "0"), ("s", "5"), ("i", "!"), ("n", "ri"), ("i", "l"), ("t", "f"), ("u", "ii"), ("l", "1"), ("d", "cl"), ("m", "rn"),
    ("g", "9"), ("v", "y"), ("ã", "ä"), ("ç", "<;"), ("ri", "n"), ("h", "b"), ("cl", "d"), ("rn", "m"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("é", "6"), ("ó", "6"), ("b", "6"), ("b", "8"),
    ("i", "1"), ("l", "!"), ("l", "i"), ("c", "e"), ("h", "li"), ("li", "h"), ("q", "g"), ("z", "2"), ("í", "l"), ("e", "é"), ("õ", "ö"), ("o", "ö"), ("w", "vv"), ("nn", "m"),
)
# Specks that recognition puts into words.
SPECKS = "'~|.`^*\"°_"
# Signs at a line end that part a word.
BREAKS = "-­¬–‐"

TOKEN = re.compile(r"[^\s]+")
EDGES = ".,;:!?()[]{}\"“”«»…"
LETTER = re.compile(r"[^\W\d_]")
WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


class Perceptron:
    """Averaged; scores labels by sparse features."""

    def __init__(self) -> None:
        self.w: dict[str, dict[str, float]] = {}
        self._sum: dict[tuple[str, str], float] = defaultdict(float)
        self._at: dict[tuple[str, str], int] = defaultdict(int)
        self._n = 0

    def scores(self, options: Iterable[tuple[str, list[str]]]) -> list[float]:
        """For each (label, its own features with the shared ones) a score."""
        out = []
        for label, feats in options:
            s = 0.0
            for f in feats:
                d = self.w.get(f)
                if d:
                    s += d.get(label, 0.0)
            out.append(s)
        return out

    def learn(self, options: list[tuple[str, list[str]]], right: int) -> None:
        self._n += 1
        s = self.scores(options)
        best = max(range(len(s)), key=lambda i: (s[i], -i))
        if best != right or sum(x > s[right] - 1 for i, x in enumerate(s) if i != right):
            rival = max((i for i in range(len(s)) if i != right), key=lambda i: s[i])
            for i, by in ((right, 1.0), (rival, -1.0)):
                label, feats = options[i]
                for f in feats:
                    self._add(f, label, by)

    def _add(self, f: str, label: str, by: float) -> None:
        d = self.w.setdefault(f, {})
        k = (f, label)
        self._sum[k] += (self._n - self._at[k]) * d.get(label, 0.0)
        self._at[k] = self._n
        d[label] = d.get(label, 0.0) + by

    def average(self) -> Perceptron:
        for f, d in self.w.items():
            for label in d:
                k = (f, label)
                d[label] = (self._sum[k] + (self._n - self._at[k]) * d[label]) / max(1, self._n)
        self.w = {f: {a: round(b, 4) for a, b in d.items() if abs(b) > 1e-4} for f, d in self.w.items()}
        self._sum.clear()
        self._at.clear()
        return self


_BY_NOISE: dict[str, list[tuple[str, str]]] = defaultdict(list)
for _clean, _noisy in CONFUSIONS:
    _BY_NOISE[_noisy[0]].append((_clean, _noisy))
_LETTERS = "abcdefghijlmnopqrstuvxzáâãàçéêíóôõú"


@dataclass
class Models:
    editor: Perceptron
    joiner: Perceptron
    pages: Perceptron
    known: frozenset[str]
    halves: frozenset[str]  # first parts of known words with a hyphen


def _context(w: str, i: int) -> list[str]:
    p = "^^" + w + "$$"
    j = i + 2
    return ["b", f"0{p[j]}", f"1{p[j - 1 : j + 1]}", f"2{p[j : j + 2]}", f"3{p[j - 1 : j + 2]}", f"4{p[j - 2 : j + 1]}", f"5{p[j : j + 3]}", f"6{p[j - 2 : j + 2]}", f"7{p[j - 1 : j + 3]}", f"8{p[j - 2 : j + 3]}"]


def _options(w: str, i: int, known: frozenset[str]) -> list[tuple[str, str, int, str]]:
    """(label, put, length, repaired word): what can be done at a place; the first one keeps it."""
    c = w[i]
    out = [("keep", c, 1, w)]
    for clean, noisy in _BY_NOISE.get(c, ()):
        if w.startswith(noisy, i):
            out.append((f"{noisy}>{clean}", clean, len(noisy), w[:i] + clean + w[i + len(noisy) :]))
    if not c.isalpha() and c != "-" and 0 < i:
        out.append((f"delete {c}", "", 1, w[:i] + w[i + 1 :]))
    if len(w) > 4:
        for r in (w[:i] + w[i + 1 :],):
            if r in known and c.isalpha():
                out.append(("delete", "", 1, r))
        for x in _LETTERS:
            r = w[:i] + x + w[i + 1 :]
            if x != c and r in known:
                out.append(("replace", x, 1, r))
            r = w[: i + 1] + x + w[i + 1 :]
            if r in known:
                out.append(("insert", c + x, 1, r))
    return out


def _featured(w: str, i: int, options: list[tuple[str, str, int, str]], known: frozenset[str], whole: bool) -> list[tuple[str, list[str]]]:
    base = _context(w, i)
    odd = "odd" if any(not ch.isalpha() and ch != "-" for ch in w) else "even"
    fixable = any(o[3] in known for o in options[1:])
    out = []
    for label, _, _, repaired in options:
        own = [f"n{min(len(options), 4)}{odd}", f"f{fixable}{whole}"]
        if label != "keep":
            own += [f"k{repaired in known}{whole}", f"h{repaired.isalpha()}{odd}", "r" + "^^" + repaired[max(0, i - 1) : i + 3] + "$$"[: max(0, i + 3 - len(repaired))]]
            at = "^^" + repaired + "$$"
            own += [f"x{at[i + 1 : i + 4]}", f"y{at[i : i + 3]}", f"z{at[i + 2 : i + 5]}"]
        out.append((label, base + own))
    return out


def edit_word(w: str, m: Models, whole: bool = True) -> list[tuple[int, int, str]]:
    """(place, length, put): the edits of a word; ``whole`` says whether it is complete."""
    low = w.lower()
    if low in m.known or len(low) < 3 or not LETTER.search(low):
        return []
    now = low
    home = list(range(len(low)))  # where each character of now stands in the word
    edits: list[tuple[int, int, str]] = []
    for _ in range(len(low)):  # until no edit gains anything
        best = (0.0, 0, ("", "", 0, ""))
        for i in range(len(now)):
            options = _options(now, i, m.known)
            if len(options) > 1:
                s = m.editor.scores(_featured(now, i, options, m.known, whole))
                k = max(range(1, len(s)), key=lambda x: (s[x], -x))
                best = max(best, (s[k] - s[0], -i, options[k]), key=lambda x: x[:2])
        gain, at, (_, put, n, after) = best
        at = -at
        if gain <= 0 or home[at] < 0:
            break
        edits.append((home[at], n, put))
        home = home[:at] + [-1] * len(put) + home[at + n :]
        now = after
        if now in m.known:
            break
    return edits


def _damage(w: str, rng: random.Random) -> tuple[str, int, str] | None:
    """(damaged, place, what is to be put there) by one confusion, speck or other slip; None if none fits."""
    kind = rng.random()
    if kind < 0.8:
        fits = [(c, n, m.start()) for c, n in CONFUSIONS for m in re.finditer(re.escape(c), w)]
        if not fits:
            return None
        clean, noisy, at = rng.choice(fits)
        return w[:at] + noisy + w[at + len(clean) :], at, f"{noisy}>{clean}"
    at = rng.randrange(1, len(w))
    if kind < 0.92:
        s = rng.choice(SPECKS)
        return w[:at] + s + w[at:], at, f"delete {s}"
    if kind < 0.95:
        return w[:at] + rng.choice(_LETTERS) + w[at + 1 :], at, "replace"
    if kind < 0.98:
        return w[:at] + rng.choice(_LETTERS) + w[at:], at, "delete"
    return w[:at] + w[at + 1 :], at - 1, "insert"


def train_editor(words: list[str], known: frozenset[str], rounds: int = 3, seed: int = 3) -> Perceptron:
    p = Perceptron()
    rng = random.Random(seed)
    words = sorted(w for w in words if len(w) >= 3)
    common = [w for w in words if w in known]
    words += common * (len(words) // max(1, 2 * len(common)))  # as on a page, where most words are known ones
    for _ in range(rounds):
        rng.shuffle(words)
        for w in words:
            low = w
            damaged = _damage(low, rng) if rng.random() < 0.5 else None
            whole = rng.random() < 0.9
            if not whole and len(low) > 5:  # the part of a word at the edge of a text
                cut = rng.randrange(2, len(low) - 2)
                low, damaged = (low[:cut] if rng.random() < 0.5 else low[cut:]), None
            now, at, label = damaged or (low, -1, "")
            if now in known:
                continue
            i = 0
            while i < len(now):
                options = _options(now, i, known)
                right = 0
                if i == at:
                    right = next((k for k, o in enumerate(options) if o[0] == label and o[3] == low), next((k for k, o in enumerate(options) if k and o[3] == low), -1))
                    if right < 0:
                        break
                if len(options) > 1:
                    p.learn(_featured(now, i, options, known, whole), right)
                if right:
                    _, put, _, now = options[right]
                    i += len(put)
                    at = -1
                    continue
                i += 1
    return p.average()


def _join_features(left: str, mark: str, spaced: bool, right: str, m_known: frozenset[str], halves: frozenset[str]) -> list[str]:
    a, b = left.lower(), right.lower()
    last = a.rsplit("-", 1)[-1]
    hyphened, joined = f"{a}-{b}" in m_known or f"{last}-{b}" in m_known, a + b in m_known
    return ["b", f"m{mark}{spaced}", f"j{joined}h{hyphened}", f"H{hyphened}{mark}", f"J{joined}", f"l{min(len(last), 6)}", f"r{min(len(b), 6)}", f"p{last in halves}{mark}", f"P{last in halves}{joined}{hyphened}", f"k{last in m_known}{b in m_known}", f"K{last in m_known}{b in m_known}{last in halves}", f"c{right[:1].islower()}", f"e{not right}"]


def train_joiner(words: list[str], known: frozenset[str], halves: frozenset[str], seed: int = 4) -> Perceptron:
    p = Perceptron()
    rng = random.Random(seed)
    compounds = [w for w in known if "-" in w] or ["pós-alta"]
    words = [w for w in words if len(w) >= 5]
    for n in range(6 * len(words) if len(words) < 2000 else 12_000):
        if n % 3:
            w = rng.choice(words)
            cut = rng.randrange(2, len(w) - 1)
            left, right, join, mark = w[:cut], w[cut:], True, rng.choice(BREAKS)
            if left.endswith("-"):
                left, join, mark = left[:-1], False, "-"
        else:
            w = rng.choice(sorted(compounds)) if n % 2 else rng.choice(sorted(compounds))
            if rng.random() < 0.7:
                cut = w.rindex("-")
                left, right, join, mark = w[:cut], w[cut + 1 :], False, "-"
            else:
                cut = rng.randrange(2, len(w) - 1)
                left, right, join, mark = w[:cut], w[cut:], True, rng.choice(BREAKS)
                if left.endswith("-"):
                    left, join, mark = left[:-1], False, "-"
        if rng.random() < 0.1:
            right = ""  # the text ends here
            if not join:
                continue
        f = _join_features(left, mark, rng.random() < 0.2, right, known, halves)
        p.learn([("no", f), ("join", f)], int(join))
    return p.average()


_PAGE = re.compile(r"^[\W_]*(?:(?:p[áa]g(?:ina)?|p|fl|folha)\.?\s*)?\d{1,4}(?:\s*(?:/|de)\s*\d{1,4})?[\W_]*$", re.I)
_TAIL = re.compile(r"(?:[·|—–•]|\s{2,})\W*(?:(?:p[áa]g(?:ina)?|p)\.?\s*)?\d{1,4}(?:\s*(?:/|de)\s*\d{1,4})?\W*$", re.I)
_HEAD = re.compile(r"^\W*\d{1,4}(?:\s{2,}|\s*[·|—–•]\s*)\S")
_RULE = re.compile(r"\s[·|—–•]\s|\s-\s")


def page_features(lines: list[str], known: frozenset[str]) -> list[list[str]]:
    """For each line its features; an empty list for a blank one."""
    bare = [ln.strip() for ln in lines]
    full = [i for i, b in enumerate(bare) if b]
    if not full:
        return [[] for _ in lines]
    wide = max(len(b) for b in bare)
    form = [re.sub(r"\d+", "#", " ".join(b.lower().split())) for b in bare]
    stem = [" ".join(w for w in WORD.findall(f) if len(w) > 2) for f in form]
    times, stems = Counter(f for f in form if f), Counter(s for s in stem if s)
    rules = [bool(_PAGE.match(b)) for b in bare]
    out: list[list[str]] = [[] for _ in lines]
    for at, i in enumerate(full):
        b = bare[i]
        before, after = (bare[full[at - 1]] if at else ""), (bare[full[at + 1]] if at + 1 < len(full) else "")
        ws = [w.lower() for w in WORD.findall(b)]
        share = sum(w in known for w in ws) / len(ws) if ws else -1
        page, tail, head, rule = rules[i], bool(_TAIL.search(b)), bool(_HEAD.match(b)), bool(_RULE.search(b))
        stop = b[-1] in ".?!:;,"
        caps = any(len(w) > 4 and w.isupper() for w in WORD.findall(b))
        open_ = before[-1:] not in ".?!:" if before else False
        flows = open_ and after[:1].islower()
        low = b[0].islower()
        s = "n" if share < 0 else "0" if share < 0.34 else "1" if share < 0.67 else "2" if share < 0.95 else "3"
        rep = min(3, max(times[form[i]], stems[stem[i]] if stem[i] else 0))
        first, last = at == 0, at == len(full) - 1
        gap = (i > 0 and not bare[i - 1], i + 1 < len(bare) and not bare[i + 1])
        size = "s" if len(b) < 0.35 * wide else "m" if len(b) < 0.7 * wide else "l"
        out[i] = ["b", f"page{page}{stop}", f"tail{tail}{rule}", f"head{head}", f"rule{rule}{stop}", f"stop{stop}", f"broken{len(b) > 1 and b[-1] in BREAKS and b[-2].isalpha()}{after[:1].islower()}", f"caps{caps}{stop}", f"flow{flows}{low}", f"flow{flows}{s}", f"low{low}", f"share{s}", f"rep{rep}{stop}", f"rep{rep}{low}",
            f"edge{first}{last}{page}", f"edge{first}{last}{stop}{low}{s}", f"gap{gap[0]}{gap[1]}{stop}", f"size{size}{stop}", f"words{min(len(ws), 7)}{stop}", f"rule{rule}{s}", f"nb{rules[full[at - 1]] if at else '-'}{rules[full[at + 1]] if at + 1 < len(full) else '-'}{stop}{low}", f"all{page}{tail}{head}{rule}{stop}{low}{s}"]
    return out


# Words that headers and footers are made of, for training pages.
_KINDS = ("Caderno", "Apostila", "Prova", "Material de apoio", "Reprodução interna", "Simulado", "Processo seletivo", "Curso", "Revisão", "Manual", "Uso interno", "Coletânea")
_SUBJECTS = ("Cardiologia", "Pediatria", "Cirurgia Geral", "Anatomia", "Farmacologia", "Neurologia", "Nefrologia", "Ginecologia", "Clínica Médica", "Saúde Coletiva", "Ortopedia", "Infectologia")


def _page_number(n: int, total: int, style: int) -> str:
    return (f"{n}", f"- {n} -", f"— {n} —", f"[{n}]", f"pág. {n}", f"Página {n} de {total}", f"{n}/{total}", f"p. {n}")[style]


def _header(rng: random.Random, name: str) -> str:
    kind, subject = rng.choice(_KINDS), rng.choice(_SUBJECTS)
    return rng.choice((f"{kind} de {subject} · {name.lower()}", f"{subject.upper()} — {kind.upper()} {name}", f"{name} | {subject}", f"{kind.upper()} {name.upper()} - {subject.upper()}", f"{kind} {name}", f"{subject} – {name}", f"{name} · {kind}"))


def training_page(texts: list[str], names: list[str], rng: random.Random) -> tuple[list[str], list[bool]]:
    """Lines of a made scan, and which are furniture."""
    width = rng.randrange(54, 92)
    name = rng.choice(names).capitalize()
    header, foot = (_header(rng, name) if rng.random() < 0.7 else ""), (f"{rng.choice(_KINDS)} {name} · " if rng.random() < 0.4 else "")
    style, number, numbered = rng.randrange(8), rng.randrange(1, 300), rng.random() < 0.8
    total = number + rng.randrange(300)
    beside = rng.choice(("none", "none", "left", "right"))
    body: list[str] = []
    for t in texts:
        words, line = t.split(), ""
        for w in words:
            if line and len(line) + 1 + len(w) > width:
                room = width - len(line) - 2
                if len(w) > 6 and 2 <= room < len(w) - 2 and rng.random() < 0.5:
                    body.append(f"{line} {w[:room]}{rng.choice(BREAKS)}")
                    line = w[room:]
                    continue
                body.append(line)
                line = w
            else:
                line = f"{line} {w}".strip()
        body.append(line)
        if rng.random() < 0.6:
            body.append("")
    lines: list[str] = []
    mine: list[bool] = []
    per = rng.randrange(8, 40)
    start = rng.randrange(0, max(1, min(len(body) - 1, 8)))
    body = body[start : len(body) - rng.randrange(0, 3)] or body
    for at in range(0, len(body), per):
        if header and (at or rng.random() < 0.8):
            lines.append(f"{number}  {header}" if beside == "left" else f"{header}    {number}" if beside == "right" else header)
            mine.append(True)
        chunk = body[at : at + per]
        lines += chunk
        mine += [False] * len(chunk)
        ends = at + per < len(body) or rng.random() < 0.6
        if ends and rng.random() < 0.2:
            lines.append("")
            mine.append(False)
        if ends and numbered and (beside == "none" or not header):
            lines.append(foot + _page_number(number, total, style))
            mine.append(True)
        number += 1
    if mine and not mine[-1] and lines[-1] and rng.random() < 0.4:  # cut off in the middle
        lines[-1] = lines[-1][: rng.randrange(1, len(lines[-1]) + 1)]
    return lines, mine


def train_pages(texts: list[str], words: list[str], known: frozenset[str], pages: int = 500, seed: int = 6) -> Perceptron:
    p = Perceptron()
    rng = random.Random(seed)
    names = [w for w in words if w not in known and w.isalpha()] or list(words) or ["nome"]
    for _ in range(pages if texts else 0):
        lines, mine = training_page([rng.choice(texts) for _ in range(rng.randrange(1, 9))], names, rng)
        for f, y in zip(page_features(lines, known), mine):
            if f:
                p.learn([("body", f), ("furniture", f)], int(y))
    return p.average()


def fit(texts: list[str], words: list[str], known: Iterable[str]) -> Models:
    """The three perceptrons, from clean texts, words that occur in them and the known words."""
    known = frozenset(known)
    halves = frozenset(w.split("-")[0] for w in known if "-" in w)
    words = sorted(set(words) | {w for w in known if len(w) > 3})
    return Models(train_editor(words, known), train_joiner([w for w in words if w.isalpha()], known, halves), train_pages(texts, words, known), known, halves)


@dataclass
class Repair:
    """kinds: (line number from 1, kind) of the damaged lines; text: the paragraphs."""

    kinds: list[tuple[int, str]]
    text: str


def repair(text: str, m: Models, cache: dict[tuple[str, bool], list[tuple[int, int, str]]] | None = None) -> Repair:
    """Repairs one text of page lines."""
    cache = {} if cache is None else cache
    lines = [ln.rstrip("\r") for ln in text.split("\n")]
    feats = page_features(lines, m.known)
    furniture = set()
    for i, f in enumerate(feats):
        if f:
            body, piece = m.pages.scores([("body", f), ("furniture", f)])
            if piece > body:
                furniture.add(i)
    live = [i for i in range(len(lines)) if lines[i].strip() and i not in furniture]
    kinds = {(i, "furniture") for i in furniture}
    # words as (parts of lines): a part is (line, start, end)
    joins: dict[int, bool] = {}
    for at, i in enumerate(live):
        ln = lines[i].rstrip()
        if ln[-1] in BREAKS and len(ln) > 1 and ln[-2].isalpha():
            left = TOKEN.findall(ln[:-1])[-1].lstrip(EDGES)
            right = TOKEN.match(lines[live[at + 1]].lstrip()) if at + 1 < len(live) else None
            f = _join_features(left, ln[-1], lines[i] != ln, right.group(0).strip(EDGES) if right else "", m.known, m.halves)
            no, yes = m.joiner.scores([("no", f), ("join", f)])
            joins[i] = yes > no
            if joins[i]:
                kinds.add((i, "hyphen"))

    def edits_of(w: str, whole: bool) -> list[tuple[int, int, str]]:
        k = (w, whole)
        if k not in cache:
            cache[k] = edit_word(w, m, whole)
        return cache[k]

    fixed = {i: lines[i].rstrip() for i in live}
    pending: dict[int, list[tuple[int, int, str]]] = defaultdict(list)
    for at, i in enumerate(live):
        ln = fixed[i]
        toks = [(t.start(), t.end()) for t in TOKEN.finditer(ln)]
        after = live[at + 1] if at + 1 < len(live) else None
        for n, (s, e) in enumerate(toks):
            if n == 0 and at and live[at - 1] in joins:
                continue  # read with the line before
            w = ln[s:e]
            a = s + len(w) - len(w.lstrip(EDGES))
            z = e - (len(w) - len(w.rstrip(EDGES)))
            if n == len(toks) - 1 and i in joins:
                right = TOKEN.match(fixed[after].lstrip()) if after is not None else None
                off = len(fixed[after]) - len(fixed[after].lstrip()) if after is not None else 0
                tail = right.group(0).rstrip(EDGES) if right else ""
                head = ln[a : e - 1]
                glue = "" if joins[i] else "-"
                for p, k, put in edits_of(head + glue + tail, bool(right)):
                    if p < len(head):
                        pending[i].append((a + p, k, put))
                        kinds.add((i, "char"))
                    elif tail and p >= len(head) + len(glue):
                        pending[after].append((off + p - len(head) - len(glue), k, put))
                        kinds.add((after, "char"))
            elif z > a:
                edge = (at == 0 and n == 0) or (after is None and n == len(toks) - 1 and e == z)
                for p, k, put in edits_of(ln[a:z], not edge):
                    pending[i].append((a + p, k, put))
                    kinds.add((i, "char"))
    for i, todo in pending.items():
        ln = fixed[i]
        for p, k, put in sorted(todo, reverse=True):
            was = ln[p : p + k]
            ln = ln[:p] + (put.capitalize() if was[:1].isupper() else put) + ln[p + k :]
        fixed[i] = ln
    return Repair(sorted((i + 1, k) for i, k in kinds), _paragraphs(fixed, live, lines, joins))


def _paragraphs(fixed: dict[int, str], live: list[int], lines: list[str], joins: dict[int, bool]) -> str:
    out: list[str] = []
    wide = max((len(fixed[i]) for i in live), default=0)
    for at, i in enumerate(live):
        body = " ".join(fixed[i].split())
        if not at:
            out.append(body)
            continue
        prev = live[at - 1]
        last = out[-1]
        blank = any(not lines[j].strip() for j in range(prev + 1, i))
        if prev in joins:
            out[-1] = (last.rstrip()[:-1] if joins[prev] else last) + body
        elif last[-1:] in ".?!:" and (blank or len(fixed[prev]) < 0.6 * wide):
            out.append(body)
        else:
            out[-1] = f"{last} {body}"
    return "\n\n".join(out)


def is_paged(c: Column) -> Column:
    """Whether a text is cut into page lines: it has several, and at least half of its characters are in lines of at
    most ``WIDEST``.  Such a text is read whole, its longer lines too.
    """
    sizes = F.filter(F.transform(F.split(c, "\n"), lambda ln: F.length(F.trim(F.regexp_replace(ln, "\r", "")))), lambda n: n > 0)
    total = lambda ns: F.aggregate(ns, F.lit(0).cast("long"), lambda a, n: a + n)
    return (F.size(sizes) >= 2) & (2 * total(F.filter(sizes, lambda n: n <= WIDEST)) >= total(sizes))


def train_on(texts: DataFrame, key: str, text: str) -> Models:
    """Counts the words of all clean texts and fits the models on a bounded sample of words and lines.

    Lines are drawn by a hash; lines of over ``LINE`` characters are not trained on.
    """
    clean = texts.where(F.col(text).isNotNull() & ~is_paged(F.col(text)))
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"([\p{L}]+(?:-[\p{L}]+)*)"), F.lit(1))
    counts = cut_lineage(clean.select(F.explode(words).alias("w")).groupBy("w").agg(F.count("*").alias("n")).where("length(w) <= 40"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    known = {r["w"] for r in counts.where(F.col("n") >= max(KNOWN_LEAST, total * KNOWN_SHARE)).select("w").collect()}  # at most 1 / KNOWN_SHARE
    drawn = [r["w"] for r in counts.orderBy(F.xxhash64("w")).limit(TRAIN_WORDS).select("w").collect()]
    each = clean.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "t")).select(F.xxhash64(key, "pos").alias("h"), F.trim(F.regexp_replace("t", r"\s+", " ")).alias("t"))
    lines = [r["t"] for r in each.where(F.length("t").between(41, LINE)).orderBy("h", "t").limit(TRAIN_LINES).collect()]
    return fit(lines, drawn, known)


_edited: dict[str, dict[tuple[str, bool], list[tuple[int, int, str]]]] = {}


def repair_texts(df: DataFrame, keys: list[str], text: str, models: Models) -> DataFrame:
    """(*keys, damage, repaired): the paged texts; damage is an array of (line_no, kind).

    Null, blank and unpaged texts have no rows; texts are repaired whole.
    """
    shared = df.sparkSession.sparkContext.broadcast(models)
    paged = df.where(is_paged(F.col(text))).select(*keys, F.col(text).alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in paged.schema.fields}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "damage array<struct<line_no:bigint,kind:string>>, repaired string"])
    mark = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        if mark not in _edited:  # the edits of words, kept as long as the worker lives and reads by the same models
            _edited.clear()
        cache = _edited.setdefault(mark, {})
        typ = pa.list_(pa.struct([("line_no", pa.int64()), ("kind", pa.string())]))
        for whole in batches:
            for start in range(0, len(whole), 64):
                b = whole.slice(start, 64)
                if len(cache) > 200_000:
                    cache.clear()
                found = [repair(t, m, cache) for t in b.column(len(keys)).to_pylist()]
                damage = pa.array([[{"line_no": n, "kind": k} for n, k in r.kinds] for r in found], typ)
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keys))), damage, pa.array([r.text for r in found], pa.string())], [*keys, "damage", "repaired"])

    return paged.mapInArrow(run, schema)
