"""Personal data by a semi-Markov conditional random field over whole spans.

Base patterns (email, ip, card, phone) run over each whole text. Beside them, the tokens
that hold a digit, '@' or a written-out 'at' or 'dot', with up to ``REACH`` tokens of the
line on either side, are islands. In an island, features of whole candidate spans (digit
groups, check digit, what stands between them, classes of the tokens inside, at the edges
and around, the word before) score segments of up to ``MOST_TOKENS`` tokens with such a
token in them, and dynamic programming chooses boundaries and types jointly. Spans whose
posterior reaches ``SURE`` and that don't overlap a base span are added. An island of many
tokens is decoded in pieces of ``PIECE`` tokens, with ``MARGIN`` more on either side whose
spans belong to the neighbour.

The model is fitted on ``SAMPLE`` different islands at most, of up to ``LONGEST`` characters,
those of smallest hash, with their counts and the base matches as labels. The first ``VARIED``
of them with an entity also come with it written otherwise, as no base pattern finds it,
and with decoys in its place (``disguise``): no feature says what a pattern says, so that the
model knows entities that the patterns miss. All islands of all texts are then decoded.

Null and edge cases: a null text is the empty text; spans count code points, end
exclusive; repeated rows and equal texts get equal spans; with no islands at all nothing
is fitted; an empty table gives an empty result; columns other than the id and the text
are not read. Base patterns are searched in time linear in the text.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, Row, functions as F

from docloom.llm import disguise
from docloom.llm.arrow import map_columns

KINDS = ("email", "ip", "card", "phone")
SAMPLE, LONGEST, MOST_TOKENS, SURE = 2000, 240, 8, 0.95
#: Tokens around a trigger, within so many characters; tokens of a piece and its margins.
REACH, REACH_CHARS, PIECE, MARGIN = 3, 120, 128, 2 * MOST_TOKENS
#: Islands with entities that are varied, and how often each.
VARIED, TIMES = 160, 2
EPOCHS, RATE, DECAY = 14, 0.3, 1e-4

TRIGGER = re.compile(r"[0-9@]|[\[({](?:at|dot)[\])}]|(?<!\S)dot(?!\S)|(?<!\S)at(?=\s[a-z0-9-]+\.[a-z0-9])", re.IGNORECASE)
AT_WORD = re.compile(r"[\[({]at[\])}]|(?<!\S)at(?!\S)", re.IGNORECASE)
DOT_WORD = re.compile(r"[\[({](?:dot|\.)[\])}]|(?<!\S)dot(?!\S)", re.IGNORECASE)
BETWEEN = re.compile(r"(?<=[0-9])[^0-9A-Za-z]+(?=[0-9])")
#: Words that say what follows; others count as one.
CUES = frozenset("phone tel telephone call fax mobile cell email e-mail mail contact ip host server address card visa account version page section isbn date token no".split())
TOKEN = re.compile(r"\S+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match starts where a run of digits does: inside a run nothing else can follow than from its start.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for n, d in enumerate(reversed(digits)):
        v = int(d) * (1 + n % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(DIGITS.findall(text))


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of an address, found from each '@' outwards."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        left = at
        while left > done and text[left - 1] in LOCAL:
            left -= 1
        m = DOMAIN.match(text, at + 1) if left < at else None
        if m:
            found.append((left, m.end()))
            done = m.end()
        at = text.find("@", max(done, at + 1))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, sorted."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in emails(text)]
    if DIGITS.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]
        for m in CARD.finditer(text):
            if 12 <= len(d := only_digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(only_digits(m[0])) <= 15]
    return sorted(out)


def words_before(text: str, at: int, least: int) -> list[re.Match]:
    """Up to REACH tokens of the line before a place, within REACH_CHARS characters."""
    low = max(least, at - REACH_CHARS)
    low = max(low, text.rfind("\n", low, at) + 1)
    found = list(TOKEN.finditer(text, low, at))
    if found and found[0].start() == low > least and not text[low - 1].isspace():
        found = found[1:]
    return found[-REACH:]


def end_after(text: str, at: int) -> int:
    """Where the last of up to REACH tokens of the line after a place ends."""
    high = min(len(text), at + REACH_CHARS)
    line = text.find("\n", at, high)
    high = high if line < 0 else line
    found = [m.end() for m in TOKEN.finditer(text, at, high)]
    if found and found[-1] == high < len(text) and not text[high].isspace():
        found = found[:-1]
    return found[:REACH][-1] if found else at


def cue(text: str, at: int, least: int = 0) -> str:
    """The word before a place."""
    words = text[max(least, at - 40) : at].split()
    return words[-1].lower().strip("\"':=,.!()") if words else ""


def islands(text: str) -> list[tuple[int, int, str, int, int]]:
    """(start, end, word before, first and last own place) of each run of triggers and the tokens around them."""
    out: list[list[int]] = []
    done = 0  # the end of the last trigger's token
    for hit in TRIGGER.finditer(text):
        if hit.start() < done:
            continue
        start, before = hit.start(), done
        while start > before and not text[start - 1].isspace():
            start -= 1
        done = TOKEN.match(text, hit.start()).end()
        around = words_before(text, start, before)
        low, high = (around[0].start() if around else start), end_after(text, done)
        if out and low <= out[-1][1] + 1 and "\n" not in text[out[-1][1] : low]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([max(low, out[-1][1] if out else 0), high])
    pieces = []
    for a, b in out:
        tokens = [m.span() for m in TOKEN.finditer(text, a, b)]
        for k in range(0, len(tokens), PIECE):
            own = tokens[k : k + PIECE]
            whole = tokens[max(0, k - MARGIN) : k + PIECE + MARGIN]
            pieces.append((whole[0][0], whole[-1][1], cue(text, whole[0][0]), own[0][0], own[-1][1]))
    return pieces


def token_class(token: str) -> str:
    """One letter for what a token is made of."""
    if "@" in token:
        return "A"
    bare = token.strip("\"'.,;:!?=#$%&*")
    if AT_WORD.fullmatch(bare):
        return "T"
    if DOT_WORD.fullmatch(bare) or token == ".":
        return "O"
    digits = any(map(str.isdigit, bare))
    letters = any(map(str.isalpha, bare))
    if letters and TRIGGER.search(bare) and not digits:
        return "L"
    inner = "." in bare
    return ("N" if inner else "X") if letters and digits else "D" if digits else ("I" if inner else "W") if letters else "P"


class Island:
    """Tokens of an island and the features of its candidate segments."""

    def __init__(self, text: str, before: str):
        self.text, self.before = text, before
        self.tokens = [m.span() for m in TOKEN.finditer(text)]
        marks = {m.start() for m in TRIGGER.finditer(text)}
        hot, at = [], sorted(marks)
        for a, b in self.tokens:
            hot.append(any(a <= m < b for m in at[bisect_left(at, a) : bisect_left(at, a) + 1]))
        self.classes = ["^", *(token_class(text[a:b]) if b - a <= 320 else "P" for a, b in self.tokens), "$"]
        self.segments: dict[int, list[tuple[int, tuple[int, int], list[str]]]] = defaultdict(list)
        for i in range(len(self.tokens)):
            for j in range(i + 1, min(i + MOST_TOKENS, len(self.tokens)) + 1):
                span = any(hot[i:j]) and self.trim(self.tokens[i][0], self.tokens[j - 1][1])
                if span and span[1] - span[0] <= 320:
                    self.segments[j].append((i, span, self.features(span, i, j)))

    @cached_property
    def named(self) -> list[tuple]:
        """(i, j, span, features, names of their weights for each kind) of all candidates."""
        return [(i, j, span, f, [[f"{x}|{k}" for x in f] for k in range(len(KINDS))]) for j, own in self.segments.items() for i, span, f in own]

    def trim(self, a: int, b: int) -> tuple[int, int] | None:
        """The span without punctuation around it; a plus or bracket before a digit stays."""
        s = self.text
        while a < b and not (s[a].isalnum() or (s[a] in "+(" and a + 1 < b and s[a + 1].isdigit())):
            a += 1
        while b > a and not s[b - 1].isalnum():
            b -= 1
        return (a, b) if a < b else None

    def features(self, span: tuple[int, int], i: int, j: int) -> list[str]:
        s = self.text[span[0] : span[1]]
        groups = DIGITS.findall(s)
        n = sum(map(len, groups))
        letters = sum(map(str.isalpha, s))
        kinds = self.classes[i + 1 : j + 1]
        last = re.search(r"[A-Za-z]*$", s)[0]
        before = cue(self.text, span[0]) if i else self.before
        out = [
            "bias",
            f"tokens={j - i}",
            f"digits={n if n < 20 else 'many'}",
            f"groups={'-'.join(str(len(g)) for g in groups) if len(groups) <= 6 else 'many'}",
            f"count={min(len(groups), 6)}",
            f"letters={'none' if not letters else 'some' if letters < len(s) / 2 else 'most'}",
            f"dots={min(s.count('.'), 4)}",
            f"dashes={min(s.count('-'), 4)}",
            f"plus={s[0] == '+'}",
            f"bracket={'(' in s and ')' in s}",
            f"marks={min(s.count('@'), 2)},{min(len(AT_WORD.findall(s)), 2)},{min(len(DOT_WORD.findall(s)), 4)}",
            f"between={'|'.join(sorted(set(BETWEEN.findall(s)))[:3])[:12]}",
            f"end={'none' if not last else 'short' if len(last) <= 6 and last.isascii() else 'long'}",
            f"edges={kinds[0]}{kinds[-1]}",
            f"inside={''.join(sorted(set(kinds)))}",
            f"words={min(kinds.count('W'), 4)}",
            f"left={self.classes[i]}{kinds[0]}",
            f"right={kinds[-1]}{self.classes[j + 1]}",
            f"check={luhn(only_digits(s)) if 12 <= n <= 19 and not letters else 'no'}",
            f"other={bool(re.search('[^A-Za-z0-9 .()+@_%-]', s))}",
        ]
        if before in CUES:
            out.append(f"before={before}")
        return out

    def shape(self) -> tuple:
        """Equal shapes have equal features, and so equal results."""
        return tuple((j, i, tuple(f)) for j, own in sorted(self.segments.items()) for i, _, f in own)

    def numbered(self, spans: list[tuple[int, int, int]]) -> tuple[tuple[int, int, int], ...]:
        """(i, j, kind) of the spans that are candidates; of several of one span the shortest."""
        at = {span: (i, j) for j, own in sorted(self.segments.items(), reverse=True) for i, span, _ in own}
        return tuple((*at[a, b], k) for a, k, b in sorted(spans) if (a, b) in at)


def log_add(values: list[float]) -> float:
    top = max(values)
    return top if top == -math.inf else top + math.log(sum(math.exp(v - top) for v in values))


class Model:
    """Weights of (feature, kind) and of (kind before, kind); kind -1 is no entity, of one token, at score 0."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.w = defaultdict(float, weights or {})

    def lattice(self, island: Island) -> list[tuple[int, int, int, float, tuple, list[str]]]:
        """Segments (i, j, kind, score, span, features)."""
        out = [(k, k + 1, -1, 0.0, None, []) for k in range(len(island.tokens))]
        for i, j, span, feats, named in island.named:
            for kind, names in enumerate(named):
                out.append((i, j, kind, sum([self.w[f] for f in names if f in self.w]), span, feats))
        return sorted(out, key=lambda s: s[1])

    def step(self, before: int, kind: int) -> float:
        return self.w.get(f"{before}>{kind}", 0.0)

    def posteriors(self, island: Island) -> list[tuple[tuple, float]]:
        """Each segment with its probability, by the forward and backward recursions."""
        segments = self.lattice(island)
        n, kinds = len(island.tokens), range(-1, len(KINDS))
        ahead = [{k: [] for k in kinds} for _ in range(n + 1)]
        forward = [{k: -math.inf for k in kinds} for _ in range(n + 1)]
        forward[0][-1] = 0.0
        ending = defaultdict(list)
        starting = defaultdict(list)
        for s in segments:
            ending[s[1]].append(s)
            starting[s[0]].append(s)
        for j in range(1, n + 1):
            for s in ending[j]:
                into = log_add([forward[s[0]][k] + self.step(k, s[2]) for k in kinds])
                ahead[j][s[2]].append(into + s[3])
            forward[j] = {k: log_add(v) if v else -math.inf for k, v in ahead[j].items()}
        backward = [{k: -math.inf for k in kinds} for _ in range(n + 1)]
        backward[n] = dict.fromkeys(kinds, 0.0)
        for i in range(n - 1, -1, -1):
            for k in kinds:
                backward[i][k] = log_add([self.step(k, s[2]) + s[3] + backward[s[1]][s[2]] for s in starting[i]])
        whole = log_add(list(forward[n].values()))
        out = []
        for s in segments:
            into = log_add([forward[s[0]][k] + self.step(k, s[2]) for k in kinds])
            out.append((s, math.exp(into + s[3] + backward[s[1]][s[2]] - whole)))
        return out

    def best(self, island: Island) -> list[tuple]:
        """The segmentation of highest score, entities only."""
        segments = self.lattice(island)
        n = len(island.tokens)
        score: list[dict[int, tuple[float, tuple | None, int]]] = [{-1: (0.0, None, -1)}] + [{} for _ in range(n)]
        for s in segments:
            for k, (value, _, _) in score[s[0]].items():
                new = value + self.step(k, s[2]) + s[3]
                if s[2] not in score[s[1]] or new > score[s[1]][s[2]][0]:
                    score[s[1]][s[2]] = (new, s, k)
        out, at = [], n
        kind = max(score[n], key=lambda k: score[n][k][0])
        while at:
            _, s, before = score[at][kind]
            if s[2] >= 0:
                out.append(s)
            at, kind = s[0], before
        return out[::-1]

    def sure(self, island: Island) -> list[tuple[int, int, int]]:
        """(start, kind, end) of entities of the best segmentation with a posterior of SURE."""
        return self.spans(island, self.sure_segments(island))

    def sure_segments(self, island: Island) -> list[tuple[int, int, int]]:
        """They as (i, j, kind)."""
        best = {s[:3] for s in self.best(island)}
        return [s[:3] for s, p in self.posteriors(island) if s[:3] in best and p >= SURE] if best else []

    @staticmethod
    def spans(island: Island, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        at = {(i, j): span for j, own in island.segments.items() for i, span, _ in own}
        return sorted((at[i, j][0], k, at[i, j][1]) for i, j, k in found)

    def fit(self, rows: list[tuple[Island, list[tuple[int, int, int]], int]]) -> "Model":
        """Stochastic gradient ascent on the likelihood of the labelled spans, with their counts; rows of one shape count together."""
        cases: dict[tuple, list] = {}
        for island, gold, times in rows:
            cases.setdefault((island.shape(), island.numbered(gold)), [island, 0])[1] += times
        cases_in_order = [(island, set(key[1]), times) for key, (island, times) in cases.items()]
        for epoch in range(EPOCHS):
            rate = RATE / (1 + epoch / 4)
            random.Random(epoch).shuffle(cases_in_order)
            for island, want, times in cases_in_order:
                move: Counter = Counter()
                for s, p in self.posteriors(island):
                    hit = s[:3] in want
                    if s[2] >= 0 and (hit or p > 1e-3):
                        for f in s[5]:
                            move[f"{f}|{s[2]}"] += hit - p
                weight = rate * min(3.0, 1 + math.log(times))
                for f, v in move.items():
                    self.w[f] += weight * v - rate * DECAY * self.w[f]
        self.w = defaultdict(float, {f: round(v, 6) for f, v in self.w.items() if abs(v) > 1e-4})
        return self


SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep``, the base spans, and the islands of each text."""

    def run(batch: pa.RecordBatch) -> dict:
        base, found = [], []
        for value in batch.column(text).to_pylist():
            value = value or ""
            base.append([dict(zip(("start", "kind", "end"), s)) for s in base_spans(value)])
            found.append([{"at": a, "text": value[a:b], "before": w, "own": x, "upto": y} for a, b, w, x, y in islands(value)])
        return {"base": base, "islands": found}

    return map_columns(docs.select(*keep, text), run, keep, f"base {SPAN}, islands array<struct<at:bigint,text:string,before:string,own:bigint,upto:bigint>>")


def sampled(scanned: DataFrame, sample: int = SAMPLE) -> list[Row]:
    """At most ``sample`` different (text, before, own: base spans in it, times), those of smallest hash of text and before."""
    rows = scanned.select("base", F.explode("islands").alias("island")).where(F.length("island.text") <= LONGEST)
    at = F.col("island.at")
    own = F.filter("base", lambda s: (s["start"] >= at) & (s["start"] < at + F.length("island.text")))
    own = F.transform(own, lambda s: F.struct((s["start"] - at).alias("start"), s["kind"].alias("kind"), (s["end"] - at).alias("end")))
    rows = rows.select("island.text", "island.before", own.alias("own")).groupBy("text", "before", "own").agg(F.count("*").alias("times"))
    return rows.orderBy(F.xxhash64("text", "before"), "text", "before", "own").limit(sample).collect()  # short rows


def fit(scanned: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of at most ``sample`` different islands, labelled by the base patterns, and variants of some."""
    cases, varied = [], 0
    for r in sampled(scanned, sample):
        spans = [(s["start"], s["kind"], s["end"]) for s in r["own"] if s["end"] <= len(r["text"])]
        cases.append((Island(r["text"], r["before"]), spans, r["times"]))
        if spans and varied < VARIED:
            varied += 1
            cases += [(Island(t, r["before"]), own, 1) for t, own in disguise.variants(r["text"], spans, TIMES, base_spans)]
    return Model().fit(cases)


def decode(scanned: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds ``spans``: base spans and the model's, sorted by start, then kind."""
    weights = scanned.sparkSession.sparkContext.broadcast(dict(model.w))  # of SAMPLE islands at most

    def run(batch: pa.RecordBatch) -> dict:
        own, known, out = Model(weights.value), {}, []
        for base, found in zip(batch.column("base").to_pylist(), batch.column("islands").to_pylist()):
            spans = [(s["start"], s["kind"], s["end"]) for s in base]
            taken = list(spans)
            for part in found:
                island = Island(part["text"], part["before"])
                key = island.shape()
                if key not in known:
                    known[key] = own.sure_segments(island)
                for a, k, b in own.spans(island, known[key]):
                    a, b = a + part["at"], b + part["at"]
                    if part["own"] <= a < part["upto"] and not any(x < b and a < y for x, _, y in taken):
                        spans.append((a, k, b))
                        taken.append((a, k, b))
            out.append([dict(zip(("start", "kind", "end"), s)) for s in sorted(spans)])
        return {"spans": out}

    return map_columns(scanned, run, (*keep, "base"), f"spans {SPAN}")
