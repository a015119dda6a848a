"""Personal data by fixed patterns and by a character tagger.

Four patterns give the base spans. The tagger, a bidirectional LSTM with a CRF, is trained on
labelled spans and adds what the patterns do not match: numbers without a plus, addresses
with written marks, other separators.

A text is cut into windows that overlap by half, so anything of up to STEP characters is whole in
one of them. A span of the tagger has to hold a digit or an at mark; windows without any
cannot give one and are not decoded. Pieces of a longer span that windows cut are joined
where they meet, and of all spans of a text those that do not overlap and together have the
greatest score are taken. Base spans stay as they are; what overlaps them is not added.
"""

from __future__ import annotations

import bisect
import pickle
import random
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.llm.sequence_tagger import Tagger, symbols

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

# The base patterns. A run that cannot match from its first character cannot
# match from a later one either, so runs are taken whole and never tried again.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: What a span of the tagger has to hold, one of them at least.
TRIGGER = re.compile(r"[0-9@]|[(\[{][aA][tT][)\]}]")
#: Characters of a window, and from one window to the next.
WINDOW, STEP = 96, 48
#: Windows decoded at a time.
BATCH = 2048
#: Least mean probability of a span's tags.
LEAST_CHANCE = 0.9
#: Documents from which the tagger's examples are made, and how many examples.
FIT_ROWS, EXAMPLES, EPOCHS = 2000, 6000, 5

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            end = host.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """All spans of the patterns by start, then kind. Takes time in proportion to the text."""
    spans = [(a, EMAIL, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            spans.append((m.start(), IP, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _digits(m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), CARD, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m.group())) <= 15:
            spans.append((m.start(), PHONE, m.end()))
    spans.sort()
    return spans


def plausible(kind: int, text: str) -> bool:
    """Whether a span of the tagger can be of its kind at all."""
    digits = len(_digits(text))
    if kind == EMAIL:
        return bool(re.search(r"@|[(\[{][aA][tT][)\]}]", text)) and len(text) >= 6
    if kind == IP:
        return len(re.findall(r"[0-9A-Fa-f]+", text)) >= 4 and digits >= 2
    if kind == CARD:
        return 14 <= digits <= 19 and luhn(_digits(text))
    return 7 <= digits <= 15


def window_starts(text: str) -> list[int]:
    """Starts of the windows that hold a trigger, ascending."""
    cells = {m.start() // STEP for m in TRIGGER.finditer(text)}
    return sorted({max(c - k, 0) * STEP for c in cells for k in (0, 1)})


def _cut(codes: np.ndarray, start: int) -> np.ndarray:
    out = np.zeros(WINDOW, np.uint8)
    part = codes[start : start + WINDOW]
    out[: len(part)] = part
    return out


def spans_of_tags(tags: np.ndarray, chance: np.ndarray) -> list[tuple[int, int, int, float, float]]:
    """(start, kind, end, mean probability, score) of the spans in one window.

    The score adds up the log odds of the tags against their being wrong.
    """
    out = []
    kind = (tags - 1) // 2
    edge = np.flatnonzero((np.diff(kind, prepend=-1) != 0) | ((tags > 0) & (tags % 2 == 1)))
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(tags)]):
        if kind[a] >= 0:
            p = np.clip(chance[a:b], 1e-6, 1 - 1e-6)
            out.append((a, int(kind[a]), b, float(p.mean()), float(np.log(p / (1 - p)).sum())))
    return out


def reconciled(found: list[tuple[int, int, int, float, bool, bool]]) -> list[Span]:
    """Of (start, kind, end, score, cut on the left, cut on the right) what to keep.

    Cut pieces of one kind that overlap are joined. Then the spans that do not overlap and have the
    greatest score together are chosen over the whole text.
    """
    whole = {}
    joined: list[list] = []
    for start, kind, end, score, left, right in sorted(found):
        if not (left or right):
            whole[start, kind, end] = max(score, whole.get((start, kind, end), 0.0))
            continue
        for piece in joined:
            if piece[1] == kind and piece[5] and left and start <= piece[2] < end:
                piece[2], piece[3], piece[5] = end, max(piece[3], score), right
                break
        else:
            joined.append([start, kind, end, score, left, right])
    for start, kind, end, score, left, right in joined:
        if not (left or right):  # what is still cut is whole in another window, or not a span
            whole[start, kind, end] = max(score, whole.get((start, kind, end), 0.0))
    order = sorted(whole, key=lambda s: (s[2], s))
    ends = [s[2] for s in order]
    best = [(0.0, None)]
    for i, s in enumerate(order):
        before = bisect.bisect_right(ends, s[0], 0, i)
        with_it = best[before][0] + whole[s]
        best.append((with_it, before) if with_it > best[i][0] else (best[i][0], None))
    kept, i = [], len(order)
    while i:
        if best[i][1] is None:
            i -= 1
        else:
            kept.append(order[i - 1])
            i = best[i][1]
    return kept[::-1]


def tagged(texts: Sequence[str], model: Tagger, least_chance: float = LEAST_CHANCE) -> list[list[Span]]:
    """The spans that the tagger finds in each text, by start; those of the patterns are not left out."""
    windows, place = [], []
    found: list[list] = [[] for _ in texts]

    def decode() -> None:
        tags, chance = model.decode(np.stack(windows))
        for row in np.flatnonzero(tags.any(1)).tolist():
            which, start = place[row]
            text = texts[which]
            for a, kind, b, mean, score in spans_of_tags(tags[row], chance[row]):
                a, b = a + start, min(b + start, len(text))
                if mean >= least_chance and score > 0 and a < b:
                    left, right = a == start and a > 0, b == start + WINDOW and b < len(text)
                    found[which].append((a, kind, b, score, left, right))
        windows.clear()
        place.clear()

    for which, text in enumerate(texts):
        starts = window_starts(text)
        if not starts:
            continue
        codes = symbols(text)
        for start in starts:
            windows.append(_cut(codes, start))
            place.append((which, start))
            if len(windows) == BATCH:
                decode()
    if windows:
        decode()
    out = []
    for text, spans in zip(texts, found):
        kept = reconciled(spans) if spans else []
        out.append([s for s in kept if TRIGGER.search(text, s[0], s[2]) and plausible(s[1], text[s[0] : s[2]])])
    return out


def spans_of(texts: Sequence[str], model: Tagger, least_chance: float = LEAST_CHANCE) -> list[tuple[list[Span], list[Span]]]:
    """Of each text the base spans, and these with the tagger's, both by start, then kind."""
    out = []
    for text, more in zip(texts, tagged(texts, model, least_chance)):
        base = base_spans(text)
        if more:
            ends = np.maximum.accumulate([b for _, _, b in base]) if base else []
            starts = [a for a, _, _ in base]
            new = []
            for span in more:
                before = bisect.bisect_left(starts, span[2])
                if not before or ends[before - 1] <= span[0]:
                    new.append(span)
            out.append((base, sorted(base + new)))
        else:
            out.append((base, base))
    return out


# Examples for training ------------------------------------------------------------------


def _number(rng: random.Random, n: int) -> str:
    return str(rng.randint(1, 9)) + "".join(rng.choices("0123456789", k=n - 1))


def _word(rng: random.Random) -> str:
    return "".join(rng.choice("bcdfghklmnprstvwz") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) + rng.choice(["", "n", "s", "r"])


def _card_number(rng: random.Random, n: int) -> str:
    digits = _number(rng, n - 1)
    return next(digits + c for c in "0123456789" if luhn(digits + c))


def entity(rng: random.Random, kind: int) -> str:
    """A made-up item of a kind, in one of the ways in which people write it."""
    if kind == EMAIL:
        name = rng.choice(["", _word(rng) + rng.choice([".", "_", "-", ""])]) + _word(rng) + rng.choice(["", "", "." + _number(rng, 2), _number(rng, rng.randint(1, 4))])
        host = rng.choice([_word(rng), _word(rng) + "." + _word(rng), "mail" + _number(rng, 1) + "." + _word(rng)])
        end = rng.choice(["com", "org", "net", "de", "fr", "es", "co.uk", "io", "edu"])
        at, dot = rng.choice([("@", "."), ("@", "."), (" (at) ", "."), ("(at)", "."), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" @ ", "."), ("@", " . "), ("{at}", ".")])
        return name + at + f"{host}.{end}".replace(".", dot)
    if kind == IP:
        if rng.random() < 0.3:
            return ":".join(f"{rng.randrange(1 << 16):x}" for _ in range(rng.choice([8, 8, 6]))) if rng.random() < 0.6 else f"fe80::{rng.randrange(1 << 16):x}:{rng.randrange(1 << 16):x}:{rng.randrange(1 << 16):x}"
        return rng.choice([".", ".", "[.]", "(.)", " . ", "[dot]"]).join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == CARD:
        digits = _card_number(rng, rng.choice([16, 16, 16, 15, 14, 19]))
        mark = rng.choice(["", " ", "-", ".", "_", "/", "  ", " - "])
        return mark.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    area, a, b = _number(rng, 3), rng.choice(["555", _number(rng, 3)]), _number(rng, 4)
    code = _number(rng, rng.choice([1, 2, 2, 3]))
    local = rng.choice([f"({area}) {a}-{b}", f"({area}) {a} {b}", f"{area}-{a}-{b}", f"{area}.{a}.{b}", f"({area}){a}-{b}"])
    return rng.choice(["", "", "", f"+{code} ", f"+{code}-", f"00{code} ", "1-", "1 "]) + local


def ordinary(rng: random.Random) -> str:
    """Something with digits or an at mark that is nobody's data."""
    n = lambda a, b: str(rng.randint(a, b))
    two = lambda a, b: f"{rng.randint(a, b):02d}"
    return rng.choice(
        [
            lambda: f"{n(1900, 2100)}-{two(1, 12)}-{two(1, 28)}",
            lambda: f"{two(1, 28)}{rng.choice('./-')}{two(1, 12)}{rng.choice('./-')}{n(1900, 2100)}",
            lambda: f"{two(0, 23)}:{two(0, 59)}" + rng.choice(["", f":{two(0, 59)}", f":{two(0, 59)}.{n(100, 999)}"]),
            lambda: f"{n(1900, 2100)}-{two(1, 12)}-{two(1, 28)}T{two(0, 23)}:{two(0, 59)}:{two(0, 59)}Z",
            lambda: f"{rng.choice('$€£')}{n(1, 999)},{n(100, 999)}.{two(0, 99)}",
            lambda: f"{n(1, 99)}.{two(0, 99)}" + rng.choice(["", " %", "%", " km"]),
            lambda: f"v{n(0, 30)}.{n(0, 30)}" + rng.choice(["", f".{n(0, 99)}"]),
            lambda: n(0, 10 ** rng.randint(1, 12)),
            lambda: f"{n(1, 999)},{n(100, 999)},{n(100, 999)}",
            lambda: f"{n(1900, 2000)}-{n(2000, 2100)}",
            lambda: "".join(rng.choices("0123456789abcdef", k=rng.choice([8, 12, 16, 24, 32, 40, 64]))),
            lambda: "AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=16)),
            lambda: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", k=rng.randint(16, 44))),
            lambda: f'{rng.choice(["token", "password", "api_key", "secret"])} = "{"".join(rng.choices("0123456789abcdefXYZ", k=32))}"',
            lambda: f"978-{n(0, 9)}-{n(10, 99)}-{n(100000, 999999)}-{n(0, 9)}",
            lambda: f"{rng.choice(['no. ', '#', 'ID ', 'order ', 'page ', 'fig. ', 'Apache '])}{n(1, 10 ** rng.randint(1, 9))}",
            lambda: "@" + _word(rng),
            lambda: f"{_word(rng)} @ {n(1, 99)} each",
            lambda: f"{n(1, 99)}x{n(1, 9999)}",
            lambda: f"{_word(rng)}{n(1, 999)}",
            lambda: f"{n(1, 9)}.{n(1, 9)}.{n(1, 9)}",
            lambda: f"- {n(1, 50)}. {_word(rng)} {n(1, 50)}) {_word(rng)}",
            lambda: f"{n(1, 40)} + {n(1, 40)} = {n(1, 90)}",
            lambda: " ".join(n(0, 99) for _ in range(rng.randint(3, 12))),
            lambda: f"https://{_word(rng)}.com/{_word(rng)}/{n(1, 99999)}?id={n(1, 99999)}",
        ]
    )()


def examples(carriers: Sequence[str], n: int, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """``n`` texts with labelled spans: pieces of the carriers with made-up items and others set in."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        carrier = rng.choice(carriers) if carriers else ""
        at = rng.randrange(max(1, len(carrier) - WINDOW))
        text = carrier[at : at + WINDOW]
        # what the carrier has itself counts by the patterns; other numbers in it are ordinary
        spans = base_spans(text) if rng.random() < 0.5 else []
        if not spans:
            text = TRIGGER.sub("", text) if base_spans(text) else text
            gaps = [i for i, c in enumerate(text) if c in " \n"] or [len(text)]
            for _ in range(rng.choice([1, 1, 2])):
                gap = rng.choice(gaps)
                if spans and gap < spans[-1][2]:
                    continue
                kind = rng.randrange(4) if rng.random() < 0.65 else None
                item = ordinary(rng) if kind is None else entity(rng, kind)
                before = rng.choice([" ", " ", " ", " (", ": ", "\n", " <", '"', "### ", ", ", " tel. ", " mail "])
                after = rng.choice(["", "", ".", ",", ")", ">", "###", "&&&", "!", ";", '"', "%%%", "***"])
                cut = text[:gap] + before + item + after
                if kind is not None:
                    spans.append((gap + len(before), kind, gap + len(before) + len(item)))
                grown = len(cut) - gap
                text = cut + text[gap:]
                gaps = [g + grown for g in gaps if g > gap] or [len(text)]
        out.append((text, spans))
    return out


def training_windows(labelled: Sequence[tuple[str, list[Span]]], each: int = 1, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and tags of ``each`` of the windows of a labelled text that would be decoded."""
    rng = random.Random(seed)
    xs, ys = [np.zeros(WINDOW, np.uint8)], [np.zeros(WINDOW, np.uint8)]
    for text, spans in labelled:
        codes, tags = symbols(text), np.zeros(len(text), np.uint8)
        for start, kind, end in spans:
            tags[start:end] = 2 * kind + 2
            tags[start] = 2 * kind + 1
        starts = window_starts(text)
        for start in rng.sample(starts, min(each, len(starts))):
            xs.append(_cut(codes, start))
            ys.append(_cut(tags, start))
    return np.stack(xs), np.stack(ys)


def trained(labelled: Sequence[tuple[str, list[Span]]], epochs: int = EPOCHS) -> Tagger:
    return Tagger.fresh(2 * len(KINDS) + 1).fit(*training_windows(labelled), epochs)


def fitted_tagger(docs: DataFrame, labelled: DataFrame | None = None, fit_rows: int = FIT_ROWS, n: int = EXAMPLES) -> Tagger:
    """The tagger, trained in one task on a bounded number of rows.

    ``labelled`` has rows (text, spans: array of structs of start, end and kind), of which ``fit_rows``
    are used. Without it examples are made: items of all kinds and ordinary numbers are set
    into pieces of ``fit_rows`` documents. Rows are chosen by a hash and put in order, so the
    model does not depend on how the table is dealt out.
    """
    none = F.array().cast("array<struct<start:long,end:long,kind:string>>")
    made = labelled is None
    if made:
        rows = docs.where(F.length("text") > 0).select("text", none.alias("spans"), F.xxhash64("doc_id", "text").alias("place"))
    else:
        rows = labelled.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("spans", none).alias("spans"))
        rows = rows.withColumn("place", F.xxhash64("text", F.to_json("spans")))
    # hashes are chosen first, so only the chosen texts move, and repeated rows count once
    places = rows.select("place").distinct().orderBy("place").limit(fit_rows)
    chosen = rows.join(F.broadcast(places), "place").groupBy("place")
    chosen = chosen.agg(F.first("text").alias("text"), F.first("spans").alias("spans")).drop("place")

    def run(batches: Iterator[pa.RecordBatch]):
        table = [(r["text"], r["spans"]) for b in batches for r in b.to_pylist()]
        table.sort(key=repr)
        if made:
            given = examples([t for t, _ in table], n)
        else:
            given = [(t, [(s["start"], KINDS.index(s["kind"]), s["end"]) for s in spans]) for t, spans in table]
        model = trained(given or [("", [])])
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})

    (row,) = chosen.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(row.model)


def personal_data(docs: DataFrame, labelled: DataFrame | None = None, least_chance: float = LEAST_CHANCE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every document.

    Spans are kind:start:end in order of their starts, then kinds; positions are code points.
    Null and empty texts have no spans; repeated rows are scanned each; other columns are
    ignored; an empty table gives an empty result. Whole texts are read, in time and memory
    in proportion to their length.
    """
    from hashlib import sha256

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fitted_tagger(docs, labelled)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def listed(spans: list[Span]) -> str:
        return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            size = max(1, 2_000_000 * batch.num_rows // max(1, batch.nbytes))
            for first in range(0, batch.num_rows, size):
                part = batch.slice(first, size)
                both = spans_of([t or "" for t in part.column(1).to_pylist()], model, least_chance)
                counts = [pa.array([sum(k == kind for _, k, _ in base) for base, _ in both], pa.int64()) for kind in range(len(KINDS))]
                digest = pa.array([sha256(listed(base).encode()).hexdigest() for base, _ in both], pa.string())
                every = pa.array([listed(spans) for _, spans in both], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, digest, every], names)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.mapInArrow(rows, schema)
