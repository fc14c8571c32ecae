"""Personal data by a semi-Markov conditional random field over fixed patterns.

Fixed patterns find e-mail and network addresses, card and phone numbers; what they find always stays. A
semi-Markov CRF adds disguised forms: it scores whole candidate segments (digit groups, check sums, disguised
signs, words before the segment) and a dynamic program over segments of bounded length chooses boundaries and
types together. It is trained here, on texts of the corpus into which made-up data are set.
"""

from __future__ import annotations

import bisect
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 20  # longest candidate segment
CONTEXT_TEXTS = 400  # bounded sample of texts that lend contexts for training
ROUNDS = 12

IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
SIGNS = re.compile(r"[\x20-]")
DATE = re.compile(r"(?:19|20)[0-9]{2}[-/. ][0-9]{1,2}[-/. ][0-9]{1,2}(?![0-9])")
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]")
#: Where a candidate may lie: digits, at signs and their disguises.
TRIGGER = re.compile(r"[0-9]+|@|[\[({<]\s?(?:at|dot)\s?[\])}>]|\bat\b(?=.{1,40}\bdot\b)", re.IGNORECASE)
AT = re.compile(r"\s?[\[({<]\s?at\s?[\])}>]\s?|\s+at\s+|@", re.IGNORECASE)
DOT = re.compile(r"\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\s+dot\s+|\.", re.IGNORECASE)
CUES = {
    "email": frozenset("mail email e write contact address".split()),
    "ip": frozenset("ip host server address from ping".split()),
    "card": frozenset("card visa mastercard amex credit pay number".split()),
    "phone": frozenset("phone tel telephone call mobile fax cell sms number".split()),
}
FEATURES = (
    "bias", "valid", "plain_at", "masked_at", "masked_dot", "top_domain", "cue", "card_sum", "card_length", "phone_length",
    "quads", "four_groups", "small_groups", "plus", "zeros", "parens", "phone_groups", "one_group", "many_groups",
    "glued_before", "glued_after", "mixed_signs", "masked_quad", "short_number", "dashes", "date",
)
INDEX = {name: i for i, name in enumerate(FEATURES)}


def card_sum(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _is_card(text: str) -> bool:
    digits = SIGNS.sub("", text)
    return 14 <= len(digits) <= 19 and card_sum(digits)


def _is_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def _is_phone(text: str) -> bool:
    return 10 <= sum(map(str.isdigit, text)) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed patterns (kind, start, end), leftmost and apart within each kind, by start and kind."""
    found: list[tuple[int, int, int]] = []
    last, at = 0, text.find("@")
    while at >= 0:  # the sign is looked up first: a search from every letter would read long words again and again
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at) if start < at else None
        if domain:
            last = domain.end()
            found.append((start, 0, last))
        at = text.find("@", max(at + 1, last))
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if _is_ip(m.group())]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if m.end() - m.start() >= 14 and _is_card(m.group())]
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if _is_phone(m.group())]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


class Region:
    """Tokens of a stretch of text and its candidate segments (first token, end token, kind, feature indices)."""

    def __init__(self, text: str, start: int, end: int):
        self.text = text
        self.spans = [m.span() for m in TOKEN.finditer(text, start, end)]
        self.candidates: list[tuple[int, int, int, list[int]]] = []
        starts = [a for a, _ in self.spans]
        self._numbers()
        self._mails(starts)

    def _numbers(self) -> None:
        text, spans = self.text, self.spans
        for i, (a, b) in enumerate(spans):
            lead = text[a]
            if not (lead.isdigit() or lead in "+(" and i + 1 < len(spans) and (text[spans[i + 1][0]].isdigit() or text[spans[i + 1][0]] in "+(")):
                continue
            if i and lead.isdigit() and text[spans[i - 1][0]].isdigit() and spans[i - 1][1] == a:
                continue
            digits, groups, j = 0, [], i
            while j < len(spans) and j - i < MAX_TOKENS and digits <= 19:
                c, d = spans[j]
                if j > i and (c - spans[j - 1][1] > 1 or "\n" in text[spans[j - 1][1]:c]):
                    break
                piece = text[c:d]
                if piece.isdigit() and piece.isascii():
                    digits += d - c
                    groups.append(piece)
                    if digits <= 19 and (digits >= 7 or len(groups) == 4):
                        self._number(i, j + 1, groups, digits)
                elif piece not in "+-.()[]/" and piece.lower() != "dot":
                    break
                j += 1

    def _number(self, i: int, j: int, groups: list[str], digits: int) -> None:
        a, b = self.spans[i][0], self.spans[j - 1][1]
        s = self.text[a:b]
        whole = "".join(groups)
        signs = set(re.sub(r"[0-9]", "", s))
        words = bool(re.search("[A-Za-z]", s))
        common = ["bias"]
        common += ["glued_before"] * (a > 0 and (self.text[a - 1].isalnum() or self.text[a - 1] in ".+"))
        common += ["glued_after"] * (b < len(self.text) and self.text[b].isalnum())
        common += ["one_group"] * (len(groups) == 1) + ["many_groups"] * (len(groups) > 5)
        common += ["date"] * bool(DATE.match(s))
        common += ["mixed_signs"] * (len(signs - set("+()")) > 2)
        if len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups):
            quads = ["quads"] if set(re.sub(r"[0-9\s.\[\]()]", "", s).lower()) <= set("dot") and re.search(r"\.|dot", s, re.I) else []
            self._add(i, j, 1, common + quads + ["valid"] * bool(IP.fullmatch(s)) + ["masked_quad"] * bool(words or signs - {"."}))
        if words:
            return
        if 13 <= digits <= 19 and s[0].isdigit():
            self._add(i, j, 2, common + ["valid"] * bool(CARD.fullmatch(s) and _is_card(s)) + ["card_sum"] * card_sum(whole)
                      + ["card_length"] * (14 <= digits <= 19) + ["four_groups"] * (len(groups) >= 4 and all(len(g) == 4 for g in groups[:3]))
                      + ["small_groups"] * (max(map(len, groups)) <= 2))
        if 7 <= digits <= 15 and not set("[]/") & signs:
            self._add(i, j, 3, common + ["valid"] * bool(PHONE.fullmatch(s) and _is_phone(s)) + ["plus"] * (s[0] == "+")
                      + ["zeros"] * s.startswith("00") + ["parens"] * ("(" in s and ")" in s)
                      + ["phone_length"] * (10 <= digits <= 15) + ["short_number"] * (digits < 10)
                      + ["phone_groups"] * (len(groups) >= 3 and len(groups[-1]) == 4 and len(groups[-2]) == 3)
                      + ["dashes"] * ("-" in s) + ["small_groups"] * (max(map(len, groups)) <= 2))

    def _mails(self, starts: list[int]) -> None:
        if not starts:
            return
        text, low, high = self.text, starts[0], self.spans[-1][1]
        for at in AT.finditer(text, low, high):
            a, end = at.start(), at.end()
            while a > low and text[a - 1] in LOCAL:
                a -= 1
            while a < at.start() and text[a] in ".%+-":
                a += 1
            label = re.compile(r"[A-Za-z0-9-]+").match(text, end, high)
            masked_dot, labels = False, 0
            while a < at.start() and label:
                labels += 1
                b = label.end()
                if labels > 1:
                    self._mail(a, b, at.group(), masked_dot, label.group(), starts)
                dot = DOT.match(text, b, high)
                if not dot or labels > 6:
                    break
                masked_dot |= dot.group() != "."
                label = re.compile(r"[A-Za-z0-9-]+").match(text, dot.end(), high)

    def _mail(self, a: int, b: int, sign: str, masked_dot: bool, top: str, starts: list[int]) -> None:
        i, j = bisect.bisect_left(starts, a), bisect.bisect_left(starts, b)
        if i >= len(starts) or starts[i] != a or self.spans[j - 1][1] != b:
            return
        spaced = sign.strip().isalpha()
        self._add(i, j, 0, ["bias"] + ["plain_at"] * (sign == "@") + ["masked_at"] * (sign != "@" and not spaced)
                  + ["masked_dot"] * masked_dot + ["top_domain"] * (top.isalpha() and 2 <= len(top) <= 6)
                  + ["mixed_signs"] * (spaced and not masked_dot) + ["glued_after"] * (b < len(self.text) and (
                      self.text[b].isalnum() or bool(re.match(r"\.[A-Za-z0-9]", self.text[b:b + 2]))))
                  + ["valid"] * (sign == "@" and not masked_dot))

    def _add(self, i: int, j: int, kind: int, names: list[str]) -> None:
        before = {self.text[a:b].lower() for a, b in self.spans[max(0, i - 3):i]}
        if not CUES[KINDS[kind]].isdisjoint(before):
            names = [*names, "cue"]
        self.candidates.append((i, j, kind, [INDEX[n] for n in names]))


class SemiMarkov:
    """Weights of span features by kind, and of the step from one segment's type to the next (0: other)."""

    def __init__(self) -> None:
        self.weight = np.zeros((len(KINDS), len(FEATURES)))
        self.step = np.zeros((len(KINDS) + 1, len(KINDS) + 1))

    def _ends(self, region: Region) -> list[list[tuple[int, int, float, int]]]:
        """For each end position its segments: start, type, score, candidate number (-1: other)."""
        ends: list[list[tuple[int, int, float, int]]] = [[] for _ in range(len(region.spans) + 1)]
        for j in range(1, len(ends)):
            ends[j].append((j - 1, 0, 0.0, -1))
        for c, (i, j, kind, names) in enumerate(region.candidates):
            ends[j].append((i, kind + 1, float(self.weight[kind, names].sum()), c))
        return ends

    def decode(self, region: Region) -> list[tuple[str, int, int]]:
        """Best segmentation: its spans (kind, start, end)."""
        ends, types = self._ends(region), range(len(KINDS) + 1)
        best: list[dict[int, tuple[float, int, int, int]]] = [{0: (0.0, -1, 0, -1)}]
        for segments in ends[1:]:
            here: dict[int, tuple[float, int, int, int]] = {}
            for start, kind, score, c in segments:
                for before in types:
                    if before in best[start]:
                        total = best[start][before][0] + score + self.step[before, kind]
                        if kind not in here or total > here[kind][0]:
                            here[kind] = total, start, before, c
            best.append(here)
        out, j = [], len(ends) - 1
        kind = max(best[j], key=lambda k: best[j][k][0])
        while j > 0:
            _, start, before, c = best[j][kind]
            if c >= 0:
                i, e, k, _ = region.candidates[c]
                out.append((KINDS[k], region.spans[i][0], region.spans[e - 1][1]))
            j, kind = start, before
        return out[::-1]

    def gradient(self, region: Region, gold: set[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray] | None:
        """Gradient of the log likelihood of the gold segments (start, end, kind); None if they are no candidates."""
        ends, n, types = self._ends(region), len(region.spans), len(KINDS) + 1
        ahead = np.full((n + 1, types), -np.inf)
        ahead[0, 0] = 0.0
        for j in range(1, n + 1):
            for start, kind, score, _ in ends[j]:
                ahead[j, kind] = np.logaddexp(ahead[j, kind], _lse(ahead[start] + self.step[:, kind]) + score)
        behind = np.full((n + 1, types), -np.inf)
        behind[n] = 0.0
        d_weight, d_step = np.zeros_like(self.weight), np.zeros_like(self.step)
        total = _lse(ahead[n])
        for j in range(n, 0, -1):
            for start, kind, score, c in ends[j]:
                p = np.exp(ahead[start] + self.step[:, kind] + score + behind[j, kind] - total)
                d_step[:, kind] -= p
                if c >= 0:
                    d_weight[kind - 1, region.candidates[c][3]] -= p.sum()
                behind[start] = np.logaddexp(behind[start], self.step[:, kind] + score + behind[j, kind])
        place = {(i, j, k): names for i, j, k, names in region.candidates}
        if not gold <= place.keys():
            return None
        at, before = 0, 0
        for i, j, k in sorted(gold):
            for _ in range(at, i):
                d_step[before, 0] += 1
                before = 0
            d_step[before, k + 1] += 1
            d_weight[k, place[i, j, k]] += 1
            at, before = j, k + 1
        for _ in range(at, n):
            d_step[before, 0] += 1
            before = 0
        return d_weight, d_step


def _lse(x: np.ndarray) -> float:
    top = x.max()
    return float(top + math.log(np.exp(x - top).sum())) if top > -np.inf else -np.inf


def _made_up(rng: random.Random) -> tuple[str, int | None]:
    """A made-up piece of personal data, plain or disguised, or something that only looks like it (kind None)."""
    def digits(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    def word() -> str:
        return "".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(2, 8)))

    which = rng.randrange(15)
    if which <= 3:
        at = rng.choice(["@", " at ", " [at] ", "(at)", "{at}", " (at) "]) if which else "@"
        dot = "." if at == "@" else rng.choice([".", " dot ", " [dot] ", "(dot)"]) if at != " at " else rng.choice([" dot ", " [dot] "])
        return f"{word()}{rng.choice(['', '.' + word(), digits(2)])}{at}{word()}{dot}{rng.choice(['com', 'org', 'net', 'de', 'example.com'.replace('.', dot)])}", 0
    if which <= 5:
        return rng.choice([".", ".", "[.]", " . ", "(dot)", " dot "]).join(str(rng.randrange(256)) for _ in range(4)), 1
    if which <= 8:
        body = digits(rng.choice([14, 15, 15, 15, 18]))
        number = next(body + d for d in "0123456789" if card_sum(body + d))
        sign = rng.choice(["", " ", "-", ".", " - "])
        return sign.join(number[i:i + 4] for i in range(0, len(number), 4)), 2
    if which <= 11:
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice([f"+1 ({a}) {b}-{c}", f"+{rng.randint(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}",
                           f"00{rng.randint(1, 99)} {a} {b} {c}", f"{a}.{b}.{c}"]), 3
    bad = digits(16)
    return rng.choice([
        digits(rng.randint(1, 6)), f"{rng.randint(1900, 2030)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)} {rng.randint(10, 23)}:{rng.randint(10, 59)}:{rng.randint(10, 59)}",
        f"{rng.randint(1900, 2030)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}", f"v{rng.randint(1, 9)}.{rng.randint(0, 9)}",
        f"{rng.randint(300, 999)}.{digits(3)}.1.1", bad if not card_sum(bad) else bad[:-1] + str((int(bad[-1]) + 1) % 10),
        digits(rng.randint(20, 30)), f"@{word()}", f"{word()} at {word()}", f"{digits(2)}:{digits(2)}", f"{rng.randint(1, 999)},{digits(3)}.{digits(2)}",
        f"{digits(8)}", f"{digits(11)}", f"{rng.randint(1, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 20)}", f"{digits(2)}{word()}{digits(5)}{word()}{digits(3)}",
        " ".join(digits(2) for _ in range(6)), f"{digits(4)}/{digits(5)}",
    ]), None


def train_pii(texts: list[str], rounds: int = ROUNDS, seed: int = 7) -> SemiMarkov:
    """Semi-Markov CRF from contexts of a bounded list of texts with made-up data set in; adaptive gradient steps."""
    rng = random.Random(seed)
    words = [w for t in texts for w in t.split() if not any(c.isdigit() or c in "@+" for c in w)] or ["the", "of", "and"]
    examples: list[tuple[Region, set[tuple[int, int, int]]]] = []
    for _ in range(600):
        text, gold = "", set()
        for _ in range(rng.randint(1, 2)):
            piece, kind = _made_up(rng)
            at = rng.randrange(len(words))
            cue = [rng.choice(sorted(CUES[KINDS[kind]]))] if kind is not None and rng.random() < 0.3 else []
            text += " ".join([*words[at:at + rng.randint(2, 5)], *cue]) + rng.choice([" ", " ", ": ", " | "])
            if kind is not None:
                gold.add((len(text), len(text) + len(piece), kind))
            text += piece + rng.choice([" ", ", ", ". ", "### ", "\n"])
        text += words[rng.randrange(len(words))]
        region = Region(text, 0, len(text))
        begin, end = ({s[x]: i for i, s in enumerate(region.spans)} for x in (0, 1))
        segments = {(begin[a], end[b] + 1, k) for a, b, k in gold if a in begin and b in end}
        if len(segments) == len(gold):
            examples.append((region, segments))
    model = SemiMarkov()
    seen = np.full_like(model.weight, 1e-3), np.full_like(model.step, 1e-3)
    for _ in range(rounds):
        rng.shuffle(examples)
        for region, segments in examples:
            slope = model.gradient(region, segments)
            if slope is None:
                continue
            for value, past, d in zip((model.weight, model.step), seen, slope):
                d = d - 1e-3 * value
                past += d * d
                value += 0.3 * d / np.sqrt(past)
    return model


def regions(text: str, reach: int = 48) -> Iterator[tuple[int, int]]:
    """Stretches around digits, at signs and their disguises that can hold a candidate; within one line each."""
    held: list[tuple[int, int]] = []
    for m in TRIGGER.finditer(text):
        if held and (m.start() - held[-1][1] > reach or "\n" in text[held[-1][1]:m.start()]):
            yield from _region(text, held, reach)
            held = []
        held.append(m.span())
    if held:
        yield from _region(text, held, reach)


def _region(text: str, held: list[tuple[int, int]], reach: int) -> Iterator[tuple[int, int]]:
    """The stretch of neighbouring triggers, if it has 7 digits, four numbers or an at sign."""
    numbers = [b - a for a, b in held if text[a].isdigit()]
    if sum(numbers) < 7 and len(numbers) < 4 and len(numbers) == len(held):
        return
    a = max(0, held[0][0] - reach, text.rfind("\n", max(0, held[0][0] - reach), held[0][0]) + 1)
    stop = text.find("\n", held[-1][1], held[-1][1] + reach)
    b = stop if stop >= 0 else min(len(text), held[-1][1] + reach)
    while a > 0 and a < held[0][0] and text[a - 1].isalnum():
        a += 1
    while b < len(text) and b > held[-1][1] and text[b].isalnum():
        b -= 1
    yield a, b


def find_spans(text: str | None, model: SemiMarkov) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Spans of the fixed patterns, and all spans with those the model adds beside them."""
    text = text or ""
    base = base_spans(text)
    if not TRIGGER.search(text):
        return base, base
    taken = sorted((a, b) for _, a, b in base)
    added = []
    for start, end in regions(text):
        region = Region(text, start, end)
        if not region.candidates:
            continue
        for kind, a, b in model.decode(region):
            at = bisect.bisect_left(taken, (b, -1))
            if not any(y > a for _, y in taken[max(0, at - len(KINDS)):at]):
                added.append((kind, a, b))
    every = sorted({*base, *added}, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return base, every


def fit_pii(docs: DataFrame, text: str = "text", contexts: int = CONTEXT_TEXTS) -> SemiMarkov:
    """Model trained on contexts from about `contexts` distinct texts, chosen by their hashes: 200 words of each.

    A text is chosen if its hash falls below a share of the number of rows, and copies count once, so that no more
    than about that many short rows reach the driver, however many documents and partitions there are.
    """
    share = min(1.0, contexts / max(1, docs.count()))
    rows = docs.select(F.col(text).alias("t"), F.xxhash64(text).alias("h")).where(F.col("t").isNotNull())
    chosen = rows.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))
    words = F.split("t", " ")
    place = F.pmod("h", F.greatest(F.lit(1), F.size(words) - 200)).cast("int") + 1
    sample = chosen.select("h", F.array_join(F.slice(words, place, F.lit(200)), " ").alias("w")).groupBy("h").agg(F.min("w").alias("w"))
    return train_pii([r["w"] for r in sorted(sample.collect())])


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text", model: SemiMarkov | None = None) -> DataFrame:
    """key, base and spans for every row: arrays of (kind, start, end) in code points, end exclusive, by start and kind.

    base holds what the fixed patterns match, spans also what the model adds beside them. A null or empty text has
    none; long texts are read whole; repeated rows give repeated rows; an empty table gives an empty one; other
    columns are not read.
    """
    model = model or fit_pii(docs, text)
    frame = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find_spans(t.as_py(), model) for t in batch.column(1)]
            as_rows = [[[{"kind": k, "start": a, "end": b} for k, a, b in f[i]] for f in found] for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(r, span) for r in as_rows)], names=["key", "base", "spans"])

    kind = frame.schema["key"].dataType.simpleString()
    spans = "array<struct<kind: string, start: bigint, end: bigint>>"
    return frame.mapInArrow(run, f"key {kind}, base {spans}, spans {spans}").withColumnRenamed("key", key)


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """Text with each span replaced by its kind in brackets; overlapping spans become one, named after the first."""
    if not spans:
        return text
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_pii(docs: DataFrame, text: str = "text", length: str | None = "n_chars", model: SemiMarkov | None = None) -> DataFrame:
    """docs with personal data replaced in the text; the column of lengths, if there is one, is set anew."""
    model = model or fit_pii(docs, text)
    names, at = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [redact(t.as_py(), find_spans(t.as_py(), model)[1]) for t in batch.column(at)]
            columns = list(batch.columns)
            columns[at] = pa.array(clean, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = docs.mapInArrow(run, docs.schema)
    if length in names:
        out = out.withColumn(length, F.length(text).cast(docs.schema[length].dataType))
    return out.select(*names)
