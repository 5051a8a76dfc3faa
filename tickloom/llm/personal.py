"""Personal data: fixed patterns, and a BiLSTM-CRF tagger that finds other forms of the same kinds."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import staged, table, text_or_empty
from tickloom.llm.registry import query
from tickloom.llm.tagger import Tagger, encode

C = F.col
KINDS = ("email", "ip", "card", "phone")
#: Regions the tagger is trained on, at most; as many made variants come with them.
FIT_REGIONS = 2500
#: Characters of a window and between windows, and the context a region has on both sides.
WINDOW, STRIDE, CONTEXT = 64, 32, 64
#: Least mean lead of a span's tags, in log units.
CONFIDENT = 2.0

#: Fixed patterns.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")

#: Where a form of these kinds can be: every digit, "@" and spelled-out "at" or "dot" in brackets.
_SIGN = re.compile(r"[0-9@]|[(\[]\s*(?:at|dot)\s*[)\]]", re.I)
_BLANK = re.compile(r"\s")


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def valid(kind: str, s: str) -> bool:
    """What a match or a tagged span must meet besides its form."""
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in re.findall("[0-9]+", s))
    if kind == "card":
        return 12 <= len(d := _digits(s)) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(_digits(s)) <= 15
    return True


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern, found from each "@" outwards: a run without one is never walked twice."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            yield m.span()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_matches(text: str) -> list[tuple[str, int, int]]:
    """All matches of the fixed forms, valid or not."""
    found = [("email", *s) for s in _emails(text)]
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        found += [(kind, *m.span()) for m in pattern.finditer(text)]
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    return sorted((s for s in base_matches(text) if valid(s[0], text[s[1]: s[2]])), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches of text around all signs, ``CONTEXT`` characters on both sides and on to the next blank, merged where they touch."""
    out: list[list[int]] = []

    def bounded() -> None:
        blank = _BLANK.search(text, out[-1][1])
        out[-1][1] = blank.start() if blank else len(text)

    for m in _SIGN.finditer(text):
        a, b = max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)
        if out and a > out[-1][1]:
            bounded()
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
            continue
        free = out[-1][1] if out else 0
        while a > free and not text[a - 1].isspace():
            a -= 1
        if out and a == free:
            out[-1][1] = b
        else:
            out.append([a, b])
    if out:
        bounded()
    return [(a, b) for a, b in out]


def _labelled(text: str, spans: list[tuple[str, int, int]]) -> np.ndarray:
    """Tags: 0 outside, 1 + 2k begins kind k, 2 + 2k goes on."""
    tags = np.zeros(len(text), np.int64)
    for kind, a, b in sorted(spans, key=lambda s: s[2] - s[1]):
        tags[a:b] = 2 + 2 * KINDS.index(kind)
        tags[a] -= 1
    return tags


def _variants(contexts: list[str], n: int, rng: np.random.Generator) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Made examples: the kinds in forms the fixed patterns miss, and numbers that are none, set into real contexts."""
    num = lambda k: "".join(rng.choice(list("0123456789"), k))
    word = lambda: "".join(rng.choice(list("abcdefghijklmnoprstuvw"), rng.integers(3, 9)))

    def one() -> tuple[str | None, str]:
        r = rng.integers(0, 13)
        if r == 12:
            at, dot = [(" (at) ", " (dot) "), (" [at] ", " [dot] ")][rng.integers(0, 2)]
            long = lambda sep: rng.choice(sep).join(word() for _ in range(rng.integers(1, 4)))
            return "email", f"{long(['.', '_'])}{at}{long(['-', dot])}{dot}{rng.choice(['com', 'org', 'net', 'example'])}"
        if r == 0:
            at, dot = [(" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "."), (" (AT) ", " . ")][rng.integers(0, 4)]
            return "email", f"{word()}{rng.choice(['.', '_', ''])}{num(2)}{at}{word()}{dot}{rng.choice(['com', 'org', 'net', 'example'])}"
        if r == 1:
            return "email", f"{word()} @ {word()}.{rng.choice(['com', 'org', 'de', 'fr'])}"
        if r in (2, 3):
            return "phone", [f"({num(3)}) {num(3)}-{num(4)}", f"00{num(2)} {num(3)} {num(3)} {num(4)}", f"tel:{num(3)}/{num(7)}", f"+{num(1)}/{num(3)}/{num(6)}"][rng.integers(0, 4)].removeprefix("tel:")
        if r == 4:
            return "card", [".".join(num(4) for _ in range(4)), "/".join(num(4) for _ in range(4)), "_".join(num(4) for _ in range(4))][rng.integers(0, 3)]
        if r == 5:
            return "ip", rng.choice(["[.]", "(.)", " . "]).join(str(rng.integers(1, 256)) for _ in range(4))
        return None, [num(rng.integers(1, 7)), f"{num(4)}-{num(2)}-{num(2)}", f"{num(1)}.{num(1)}.{num(1)}", f"v{num(1)}.{num(2)}", f"{num(2)}:{num(2)}", f"{num(3)},{num(3)}", f"({num(4)})", f"{num(2)}.{num(2)}.{num(4)}"][rng.integers(0, 8)]

    out = []
    for _ in range(n):
        kind, made = one()
        around = contexts[rng.integers(0, len(contexts))] if contexts else "of the and in"
        around = re.sub(r"\S*[0-9@]\S*", "", around)
        cut = around.find(" ", rng.integers(0, max(1, len(around)))) + 1
        out.append((around[:cut] + made + " " + around[cut:], [(kind, cut, cut + len(made))] if kind else []))
    return out


def train(samples: list[tuple[str, list[tuple[str, int, int]]]], steps: int = 300, seed: int = 7) -> Tagger:
    """Fit a tagger to (text, spans): the regions at hand and as many made variants."""
    rng = np.random.default_rng(seed)
    samples = samples + _variants([t for t, _ in samples], max(800, len(samples)), rng)
    chars, tags = np.zeros((len(samples), WINDOW), np.int64), np.zeros((len(samples), WINDOW), np.int64)
    for i, (text, spans) in enumerate(samples):
        marked = [s[1:] for s in spans] or [m.span() for m in _SIGN.finditer(text)] or [(0, len(text))]
        first, after = marked[rng.integers(0, len(marked))]
        a = int(np.clip(rng.integers(first - WINDOW + 1, max(after, first + 1)), 0, max(0, len(text) - WINDOW)))
        own = encode(text[a: a + WINDOW])
        chars[i, : len(own)], tags[i, : len(own)] = own, _labelled(text, spans)[a: a + WINDOW]
    tagger = Tagger(1 + 2 * len(KINDS), seed=seed)
    tagger.fit(chars, tags, steps=steps)
    return tagger


def _emissions(tagger: Tagger, coded: list[np.ndarray]) -> list[np.ndarray]:
    """Emissions of every character of whole regions: the mean of the windows over it, which count less towards edges inside the region."""
    places = [(r, a) for r, c in enumerate(coded) for a in range(0, max(1, len(c) - STRIDE), STRIDE)]
    sums, weights = [None] * len(coded), [np.zeros(len(c), np.float32) for c in coded]
    for k in range(0, len(places), 512):
        some = places[k: k + 512]
        chars = np.zeros((len(some), WINDOW), np.int64)
        for i, (r, a) in enumerate(some):
            own = coded[r][a: a + WINDOW]
            chars[i, : len(own)] = own
        em = tagger.emissions(chars)
        for i, (r, a) in enumerate(some):
            end = min(WINDOW, len(coded[r]) - a)
            left = np.arange(1, end + 1) if a else np.full(end, WINDOW)
            right = np.arange(end, 0, -1) if a + end < len(coded[r]) else np.full(end, WINDOW)
            weight = np.minimum(left, right).astype(np.float32)
            if sums[r] is None:
                sums[r] = np.zeros((len(coded[r]), em.shape[2]), np.float32)
            sums[r][a: a + end] += weight[:, None] * em[i, :end]
            weights[r][a: a + end] += weight
    return [s / w[:, None] for s, w in zip(sums, weights)]


def tagged_spans(tagger: Tagger, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """Spans of every region, of any length: emissions of overlapping windows are joined and the whole region is decoded at once.

    Spans are taken by mean lead, best first.
    """
    coded = [encode(t) for t in texts]
    proposed: list[list[tuple[float, str, int, int]]] = [[] for _ in texts]
    order, k = sorted((r for r, c in enumerate(coded) if len(c)), key=lambda r: len(coded[r])), 0
    while k < len(order):
        # Regions of like length, as many as make about 2**16 characters.
        some = order[k: k + max(1, min(512, 2**16 // len(coded[order[k]])))]
        while len(some) > 1 and len(some) * len(coded[some[-1]]) > 2**17:
            some = some[: len(some) // 2]
        k += len(some)
        found = _emissions(tagger, [coded[r] for r in some])
        em = np.zeros((len(some), len(found[-1]), found[-1].shape[1]), np.float32)
        alive = np.zeros(em.shape[:2], bool)
        for i, x in enumerate(found):
            em[i, : len(x)], alive[i, : len(x)] = x, True
        tags, lead = tagger.decode(em, alive)
        for i, r in enumerate(some):
            row, end = tags[i], len(coded[r])
            before = np.r_[0, row[: end - 1]]
            starts = np.flatnonzero((row[:end] > 0) & ((row[:end] % 2 == 1) | ((before + 1) // 2 != (row[:end] + 1) // 2)))
            for j in starts.tolist():
                e = j + 1
                while e < end and row[e] == (row[j] + 1) // 2 * 2:
                    e += 1
                proposed[r].append((float(lead[i, j:e].mean()), KINDS[(row[j] - 1) // 2], j, e))
    out = []
    for spans in proposed:
        kept: list[tuple[str, int, int]] = []
        for score, kind, a, b in sorted(spans, key=lambda s: (-s[0], s[2], s[3])):
            if score >= CONFIDENT and all(b <= x or y <= a for _, x, y in kept):
                kept.append((kind, a, b))
        out.append(kept)
    return out


_FORM = {
    "email": re.compile(r"\S.*(@|[(\[]\s*at\s*[)\]]).*[A-Za-z0-9]", re.I), "ip": re.compile(r"[0-9]+([^0-9A-Za-z]+[0-9]+){3}"),
    "card": re.compile(r"[0-9]([^0-9A-Za-z]{0,2}[0-9])+"), "phone": re.compile(r"[+(]?[0-9][0-9 ()./-]+[0-9]"),
}


def _acceptable(kind: str, s: str) -> bool:
    """A tagged span must still have the shape of its kind."""
    return bool(_FORM[kind].fullmatch(s)) and valid(kind, s)


_SPANS = "array<struct<kind:string,start:int,end:int>>"


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        base, near = [], []
        for text in frame["text"]:
            spans = base_spans(text) if _SIGN.search(text) else []
            base.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
            near.append([{"start": a, "text": text[a:b]} for a, b in regions(text)])
        yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "base": base, "regions": near})


def scan_personal(docs: DataFrame, steps: int = 300) -> DataFrame:
    """``doc_id, base, spans``: spans of the fixed patterns and all spans of every whole text (``kind, start, end`` in code points).

    Fixed patterns match leftmost without overlap, each kind on its own; matches that fail their check are dropped. The tagger reads
    every region around a digit, an "@" or a bracketed "at" or "dot" and adds spans of the four kinds in other forms, unless they overlap a
    base span. It is trained on the driver on at most ``FIT_REGIONS`` regions, the same at every run, labelled by the fixed
    patterns' forms, and on made variants. Null texts count as empty and give no spans; rows that share a doc_id are
    scanned one by one; an empty table gives no rows.
    """
    scanned = staged(docs.select(C("doc_id").cast("long"), text_or_empty().alias("text")).mapInPandas(
        _scan, f"doc_id long, base {_SPANS}, regions array<struct<start:int,text:string>>"), "personal")
    sample = scanned.select(F.explode("regions.text").alias("text")).groupBy("text").agg(F.lit(1).alias("n")).orderBy(F.xxhash64("text"), "text")
    texts = [r["text"] for r in sample.where(F.length("text") <= 8 * WINDOW).limit(FIT_REGIONS).collect()]
    sent = docs.sparkSession.sparkContext.broadcast(train([(t, base_matches(t)) for t in texts], steps))  # a few thousand weights

    def tag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            near = [(i, r["start"], r["text"]) for i, rs in enumerate(frame["regions"]) for r in rs]
            found = tagged_spans(sent.value, [t for _, _, t in near])
            spans = [[(s["kind"], s["start"], s["end"]) for s in base] for base in frame["base"]]
            for (i, start, text), more in zip(near, found):
                for kind, a, b in more:
                    free = all(start + b <= x or y <= start + a for _, x, y in spans[i])
                    if free and _acceptable(kind, text[a:b]):
                        spans[i].append((kind, start + a, start + b))
            ordered = [sorted(s, key=lambda x: (x[1], KINDS.index(x[0]), x[2])) for s in spans]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "base": frame["base"], "spans": [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in ordered]})

    return scanned.mapInPandas(tag, f"doc_id long, base {_SPANS}, spans {_SPANS}")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op2_personal")
def personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_personal(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[n(k) for k in KINDS], F.sha2(joined(C("base")).cast("binary"), 256).alias("base_sha256"), joined(C("spans")).alias("spans"))
