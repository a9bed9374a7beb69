"""Personal data: exact base patterns, and a semi-Markov conditional random field that adds spans they miss."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygauge.llm.columns import with_columns

KINDS = ("email", "ip", "card", "phone")
#: Tokens of the longest candidate segment.
LONGEST = 14

# ---------------------------------------------------------------- base patterns

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
#: A match that fails from the start of a run of digits fails from inside it too, so runs are entered at their start only.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, int]  # start, place of the kind, end


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches of the e-mail pattern, found from each @ backwards so that long words cost nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, 0, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str | None) -> list[Span]:
    """Spans of the four base patterns that pass their checks, by start and kind."""
    if not text:
        return []
    out = list(_emails(text))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# ---------------------------------------------------------------- segments and their features

_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]")
#: What a text must hold near a candidate: a digit, an @, or a spelt-out sign of an address.
_TRIGGER = re.compile(r"[0-9]|@|(?i:[(\[{]\s?(?:at|dot)\s?[)\]}]|\sdot\s)")
_NEAR = 80  # characters around triggers that form one window
Token = tuple[str, int, int]


# Words that a shape keeps: signs of addresses and phones, and common top-level domains.
_KNOWN = frozenset(("at", "dot", "x", "ext", "tel", "com", "org", "net", "edu", "gov", "info", "de", "fr", "es", "it", "uk", "eu", "io"))


def _shape(tok: str) -> str:
    if tok.isdigit():
        return f"d{min(len(tok), 20)}"
    if tok.isalpha() and tok.isascii():
        return tok.lower() if tok.lower() in _KNOWN else "w"
    return tok


def candidates(tokens: list[Token]) -> list[tuple[int, int]]:
    """Segments of at most LONGEST tokens that hold a digit or a sign of an address and start and end like an entity.

    A bracket or plus must open a number, and letters need a sign of an address (or mark an extension), so
    that no segment is an address without its user or a piece of a hexadecimal code.
    """
    signs = [t[0].lower() in ("@", "at", "dot") for t in tokens]
    digit = [t[0].isdigit() for t in tokens]
    letters = [t[0].isalpha() and not s and t[0].lower() not in ("x", "ext") for t, s in zip(tokens, signs)]
    out = []
    for i, (tok, start, _) in enumerate(tokens):
        if not (tok[0].isalnum() or (tok in "+(" and i + 1 < len(tokens) and (digit[i + 1] or tokens[i + 1][0] == "("))):
            continue
        numbers = address = words = False
        prev = start
        for j in range(i, min(len(tokens), i + LONGEST)):
            if tokens[j][1] - prev > 1:  # more than one character of white space ends every segment
                break
            numbers, address, words, prev = numbers or digit[j], address or signs[j], words or letters[j], tokens[j][2]
            if (address if words else numbers or address) and tokens[j][0][0].isalnum():
                out.append((i, j + 1))
    return out


def features(text: str, tokens: list[Token], i: int, j: int) -> list[str]:
    """Features of the whole span tokens[i:j] and of its neighbours."""
    span = text[tokens[i][1] : tokens[j - 1][2]]
    shapes = [_shape(t[0]) for t in tokens[i:j]]
    spaced = "".join(("_" if k and tokens[i + k][1] > tokens[i + k - 1][2] else "") + s for k, s in enumerate(shapes))
    digits = "".join(t[0] for t in tokens[i:j] if t[0].isdigit())
    groups = [t[0] for t in tokens[i:j] if t[0].isdigit()]
    before = tokens[i - 1] if i else ("^", 0, tokens[i][1])
    after = tokens[j] if j < len(tokens) else ("$", tokens[j - 1][2], 0)
    glued = ("glued" if before[2] == tokens[i][1] and i else "free") + ("glued" if after[1] == tokens[j - 1][2] and j < len(tokens) else "free")
    letters = any(s[0].isalpha() and s[0] != "d" for s in shapes)
    at = any(s in ("@", "at") for s in shapes)
    out = [
        "shape:" + spaced[:60], f"digits:{min(len(digits), 22)}:{letters}", f"groups:{min(len(groups), 8)}:{letters}", f"tokens:{j - i}",
        "signs:" + "".join(sorted({s for s in shapes if not s[0].isalnum()}))[:12] + f":{letters}", "edge:" + glued,
        "before:" + _shape(before[0]) + glued[:4], "after:" + _shape(after[0]) + glued[-4:], "word:" + before[0].lower()[:12], f"letters:{letters}:{at}",
    ]
    if 12 <= len(digits) <= 19 and not letters:
        out.append(f"luhn:{luhn(digits)}")
        out.append(f"even groups:{len({len(g) for g in groups[:-1]}) <= 1}:{luhn(digits)}")
    if len(groups) == 4 and span.count(".") == 3 and not letters:
        out.append(f"octets:{all(len(g) <= 3 and int(g) <= 255 for g in groups)}")
    if 7 <= len(digits) <= 15 and not letters:
        lead = span[0] if span[0] in "+(" else "0" if digits[0] == "0" else "1-9"
        out.append(f"phone groups:{'-'.join(str(len(g)) for g in groups[-3:])}:{span[0] in '+('}")
        out.append(f"phone lead:{lead}:{len(groups)}:{len(groups[0])}")
        out.append(f"phone lead:{lead}:{len(digits)}:{''.join(sorted({s for s in shapes if not s[0].isalnum()}))}")
    if at:
        tail = shapes[-2:] if len(shapes) > 1 else shapes
        user = next(k for k, s in enumerate(shapes) if s in ("@", "at"))
        out.append(f"user:{min(user, 6)}:{shapes[0] if not shapes[0].isalnum() or shapes[0] in ('at', 'dot') else 'w'}")
        out.append(f"top:{tokens[j - 1][0].isalpha()}:{min(len(tokens[j - 1][0]), 5)}:{shapes[-2] if len(shapes) > 1 else ''}")
        out.append(f"address:{shapes.count('@') + shapes.count('at')}:{'dot' in shapes or '.' in shapes}:{'-'.join(tail)}")
    return out


class SpanField:
    """Semi-Markov field: a labelling cuts a window into outside tokens and typed segments.

    weights[feature] holds one score per kind, outside[shape] one per token outside, ``enter`` the
    score of a segment of each kind after an outside token or segment.
    """

    def __init__(self):
        self.weights: dict[str, np.ndarray] = {}
        self.outside: dict[str, float] = {}
        self.enter = np.zeros(len(KINDS))

    def scores(self, feats: list[str]) -> np.ndarray:
        return sum((self.weights[f] for f in feats if f in self.weights), self.enter)

    def decode(self, text: str, tokens: list[Token], caution: float = 1.0) -> list[Span]:
        """Best labelling by dynamic programming over segment ends; ``caution`` is taken off every segment."""
        ends: dict[int, list[tuple[int, float, int]]] = {}
        for i, j in candidates(tokens):
            s = self.scores(features(text, tokens, i, j))
            k = int(np.argmax(s))
            ends.setdefault(j, []).append((i, float(s[k]) - caution, k))
        best, back = [0.0], [None]
        for j in range(1, len(tokens) + 1):
            top, how = best[j - 1] + self.outside.get(_shape(tokens[j - 1][0]), 0.0), None
            for i, s, k in ends.get(j, ()):
                if best[i] + s > top:
                    top, how = best[i] + s, (i, k)
            best.append(top)
            back.append(how)
        out, j = [], len(tokens)
        while j:
            if back[j] is None:
                j -= 1
            else:
                i, k = back[j]
                out.append((tokens[i][1], k, tokens[j - 1][2]))
                j = i
        return out[::-1]

    def fit(self, examples: list[tuple[str, list[Span]]], epochs: int = 12, rate: float = 0.5, decay: float = 1e-4) -> SpanField:
        """Gradient ascent on the log-likelihood; expectations by forward and backward sums over segments."""
        ready = []
        for text, gold in examples:
            tokens = [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(text)]
            first, last = {t[1]: n for n, t in enumerate(tokens)}, {t[2]: n + 1 for n, t in enumerate(tokens)}
            segments = [(i, j, features(text, tokens, i, j)) for i, j in candidates(tokens)]
            true = {(first[a], last[b]): k for a, k, b in gold}
            missing = set(true) - {(i, j) for i, j, _ in segments}
            if missing:
                raise ValueError(f"no candidate for {gold} in {text!r}")
            covered = {n for i, j in true for n in range(i, j)}
            ready.append(([_shape(t[0]) for t in tokens], segments, true, covered))
        order = np.random.default_rng(3)
        for epoch in range(epochs):
            step = rate / (1 + 0.3 * epoch)
            for n in order.permutation(len(ready)):
                shapes, segments, true, covered = ready[n]
                size = len(shapes)
                out = np.array([self.outside.get(s, 0.0) for s in shapes])
                seg = [self.scores(f) for _, _, f in segments]
                fore, back = np.full(size + 1, -np.inf), np.full(size + 1, -np.inf)
                fore[0] = back[size] = 0.0
                at_end, at_start = {}, {}
                total = [float(np.logaddexp.reduce(s)) for s in seg]
                for m, (i, j, _) in enumerate(segments):
                    at_end.setdefault(j, []).append(m)
                    at_start.setdefault(i, []).append(m)
                for j in range(1, size + 1):
                    fore[j] = np.logaddexp.reduce([fore[j - 1] + out[j - 1]] + [fore[segments[m][0]] + total[m] for m in at_end.get(j, ())])
                for i in range(size - 1, -1, -1):
                    back[i] = np.logaddexp.reduce([back[i + 1] + out[i]] + [back[segments[m][1]] + total[m] for m in at_start.get(i, ())])
                z = fore[size]
                for t in range(size):
                    gap = (t not in covered) - float(np.exp(fore[t] + out[t] + back[t + 1] - z))
                    if abs(gap) > 1e-4:
                        self.outside[shapes[t]] = self.outside.get(shapes[t], 0.0) * (1 - step * decay) + step * gap
                for m, (i, j, feats) in enumerate(segments):
                    gap = -np.exp(fore[i] + seg[m] + back[j] - z)
                    if (i, j) in true:
                        gap[true[i, j]] += 1
                    if np.abs(gap).max() > 1e-4:
                        self.enter = self.enter + step * gap
                        for f in feats:
                            self.weights[f] = self.weights.get(f, np.zeros(len(KINDS))) * (1 - step * decay) + step * gap
        return self


# ---------------------------------------------------------------- labelled examples by rule

# Ordinary words of the made lines.
NAMES = ("Anna", "Ben", "Carla", "David", "Elena", "Frank", "Greta", "Hugo", "Ines", "Jonas", "Karin", "Lukas", "Marie", "Nora", "Oscar", "Paula",
         "Quentin", "Rosa", "Simon", "Tanja", "Ulrich", "Vera", "Walter", "Xenia", "Yves", "Zoe", "Baker", "Fischer", "Garcia", "Hansen", "Martin", "Weber")
COMMON = ("a", "about", "address", "and", "ask", "before", "by", "contact", "day", "for", "from", "he", "house", "if", "in", "is", "it", "later", "list", "look", "me",
          "more", "my", "new", "now", "of", "office", "on", "or", "order", "our", "page", "people", "please", "question", "read", "reply", "room", "send", "she", "shop", "that",
          "the", "their", "them", "then", "they", "this", "to", "under", "us", "was", "we", "week", "were", "with", "write", "you", "your")
HOSTS = ("acme", "bigcity", "company", "club", "firm", "garden", "mailbox", "museum", "office", "school", "shop", "web")


def _example(rng: np.random.Generator) -> tuple[str, list[Span]]:
    """One labelled line: words, at most two entities or look-alikes. Forms that the base patterns know and forms that they miss."""
    pick = lambda *x: x[rng.integers(len(x))]
    num = lambda n: "".join(str(rng.integers(10)) for _ in range(n))
    made = lambda: "".join(pick(*"aeiou") + pick(*"bcdfghklmnprstvz") for _ in range(rng.integers(1, 5)))[rng.integers(2) :]

    def word() -> str:
        w = made() if rng.random() < 0.4 else pick(*COMMON)
        return w.capitalize() if rng.random() < 0.15 else w

    def name() -> str:
        w = made() if rng.random() < 0.3 else pick(*NAMES)
        return w.lower() if rng.random() < 0.7 else w

    def card() -> str:
        body = pick("4", "5", "37", "60") + num(rng.integers(10, 14))
        body += next(d for d in "0123456789" if luhn(body + d))
        return body

    def split(x: str, sign: str) -> str:
        return sign.join(x[k : k + 4] for k in range(0, len(x), 4))

    def email() -> str:
        user = pick(name(), name(), name() + pick(".", "_", "-") + name(), name() + "." + num(2), name() + num(2), name()[0] + "." + name())
        host, top = pick(made(), pick(*HOSTS), pick(*HOSTS) + "-" + made()), pick("com", "org", "net", "de", "fr", pick("edu", "gov", "info", "es", "it", "uk", "eu", "io"))
        at, dot = pick(("(at)", "(dot)"), ("[at]", "[dot]"), ("{at}", "{dot}"), ("(AT)", "(DOT)"), ("[AT]", "[DOT]"))
        return pick(f"{user}@{host}.example.{top}", f"{user}@{host}.{top}", f"{user} {at} {host}.{top}", f"{user} {at} {host} {dot} {top}", f"{user}{at}{host}{dot}{top}",
                    *[f"{user} {x} {host} {y} {top}" for x, y in (("at", "dot"), ("at", "dot"), ("AT", "DOT"))], f"{user} @ {host}.{top}", f"{user} @ {host}.{top}")

    def phone() -> str:
        return pick(f"+1 ({num(3)}) 555-{num(4)}", f"+{num(2)} {num(2)} {num(3)} {num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"({num(3)}){num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}",
                    f"{num(3)}.{num(3)}.{num(4)}", f"1-{num(3)}-{num(3)}-{num(4)}", f"+1-{num(3)}-{num(3)}-{num(4)}", f"+{num(11)}",
                    f"0{num(2)} {num(7)}", f"0{num(3)} {num(6)}", f"0{num(3)}/{num(7)}", f"0{num(2)}-{num(7)}", " ".join(["0" + num(1), *(num(2) for _ in range(4))]),
                    f"(0{num(2)}) {num(3)} {num(2)} {num(2)}", f"(0{num(2)}) {num(7)}", f"{rng.integers(2, 10)}{num(2)} {num(3)} {num(4)}")

    def ip() -> str:
        return ".".join(str(rng.integers(1, 256)) for _ in range(4))

    def other() -> str:
        y = f"{rng.integers(1900, 2030)}"
        c = card()
        wrong = c[:-1] + str((int(c[-1]) + 1 + rng.integers(9)) % 10)
        hexed = "".join(pick(*"0123456789abcdef") for _ in range(pick(18, 40)))
        return pick(y, f"{y}-0{rng.integers(1, 9)}-{rng.integers(10, 29)}", f"{rng.integers(1, 28)}.{rng.integers(1, 12)}.{y}", f"{num(1)}.{num(1)}", f"version {num(1)}.{num(1)}.{num(1)}", f"{num(1)},{num(3)},{num(3)}", f"${num(3)}.{num(2)}", f"{num(2)}%", num(rng.integers(1, 9)), f'token = "{hexed}"', f"password={hexed}", "AKIA" + "".join(pick(*"ABCDEFGHKLMNPQRSTUVWXYZ234567") for _ in range(16)), wrong, split(wrong, " "), f"{rng.integers(300, 999)}.{num(3)}.{num(3)}.{num(3)}", f"{y}-{y[:2]}{num(2)}", f"{num(2)}:{num(2)}", f"at {num(2)} {word()}", f"{word()} at the {word()}", f"{num(3)}-{num(4)}", f"no. {num(5)}", f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", f"@{word()}", f"the dot {word()}", f"{num(1)} dot {word()}", f"{word()}. At {word()}", f"{word()}. At {word()}", f"{word()} {word()} at. {word().capitalize()}", f"{word()} at {word()}. {word().capitalize()}", f"{word()} at the dot of {word()}", f"at {word()}", f"@ {word()}", f"{num(rng.integers(20, 30))}", f"{num(2)}.{num(4)}, {num(2)}.{num(4)}", f"{word()}{num(2)}", f"{num(2)} {num(2)} {num(2)}", f"{num(3)} {num(3)} {num(3)} {num(3)}", f"{rng.integers(1, 10)} {num(3)} {num(3)}", f"{rng.integers(10, 99)} {num(3)} {num(3)}", f"0.{num(7)}", f"{num(4)}/{num(4)}", f"{num(3)}/{num(3)}", f"{num(1)} {num(1)} {num(1)} {num(1)} {num(1)}", f"{num(4)} {num(4)}", f"{num(3)} {num(4)}", f"{word()} AT {word()}")

    text, spans = "", []
    for _ in range(rng.integers(1, 3)):
        text += " ".join([*(word() for _ in range(rng.integers(0, 4))), *([pick("call", "tel", "mail", "card", "ip", "from", "nr.", "Contact:", "Tel.:", "E-mail:", "write to")] if rng.random() < 0.3 else [])])
        text += " " if text else ""
        kind = int(rng.integers(0, 8))
        item = (email, ip, lambda: pick(lambda c: c, lambda c: split(c, " "), lambda c: split(c, "-"), lambda c: split(c, "."))(card()), phone)[kind]() if kind < 4 else other()
        if kind < 4:
            spans.append((len(text), kind, len(text) + len(item)))
        text += item + pick("", "", ".", ",") + " "
    return text + " ".join(word() for _ in range(rng.integers(0, 4))), spans


@lru_cache(maxsize=2)
def trained(n_examples: int = 1000, seed: int = 5) -> SpanField:
    """The field, fitted on ``n_examples`` lines made and labelled by rule; no row of a table is used."""
    rng = np.random.default_rng(seed)
    return SpanField().fit([_example(rng) for _ in range(n_examples)])


# ---------------------------------------------------------------- over documents

def all_spans(text: str | None, field: SpanField) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans): the field adds those that overlap no base span. Windows around triggers cover every candidate."""
    base = base_spans(text)
    if not text:
        return base, base
    windows: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - _NEAR), min(len(text), m.end() + _NEAR)
        if windows and a <= windows[-1][1]:
            windows[-1][1] = b
        else:
            windows.append([a, b])
    added = []
    for a, b in windows:
        while a and text[a - 1].isalnum():  # never cut a word
            a -= 1
        while b < len(text) and text[b].isalnum():
            b += 1
        tokens = [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(text, a, b)]
        for s in field.decode(text, tokens):
            if not any(s[0] < e[2] and e[0] < s[2] for e in base):
                added.append(s)
    return base, sorted(base + added)


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame) -> DataFrame:
    """``docs`` with n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans.

    Base spans follow the four patterns exactly and always stay. The field adds spans of the same
    kinds in forms that the patterns miss (spelt-out addresses, phone numbers without a plus, cards
    with other separators), never overlapping a base span. Spans are kind:start:end in code points,
    end exclusive, by start and kind.

    Null and empty texts have no spans (the hash of the empty text). Whole texts are read, whatever
    their length. Repeated rows are treated alike. Columns of the same names are replaced, others stay.
    """
    field = trained()

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        base, spans, n = [], [], np.zeros((len(pdf), len(KINDS)), np.int64)
        for i, text in enumerate(pdf["text"]):
            own, every = all_spans(text, field)
            for _, k, _ in own:
                n[i, k] += 1
            base.append(hashlib.sha256(_joined(own).encode()).hexdigest())
            spans.append(_joined(every))
        return pd.DataFrame({f"n_{kind}": n[:, k] for k, kind in enumerate(KINDS)}).assign(base_sha256=base, spans=spans)

    return with_columns(docs, search, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", ["text"])


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets; overlapping spans become one, named after the first.

    Null and empty texts, and texts without spans, stay as they are. Repeated rows are masked alike. An empty table
    gives no rows. All other columns stay, whatever their names.
    """
    field = trained()

    def hide(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = []
        for text in pdf["text"]:
            parts, end = [], 0
            for a, k, b in all_spans(text, field)[1]:
                if a >= end:
                    parts += [text[end:a], f"[{KINDS[k].upper()}]"]
                end = max(end, b)
            texts.append("".join([*parts, text[end:]]) if parts else text)
        return pd.DataFrame({"text": texts})

    return with_columns(docs, hide, "text string", ["text"]).select(*docs.columns)
