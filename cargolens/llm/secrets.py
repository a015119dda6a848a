"""Secrets by fixed patterns and by two character Markov models.

Patterns find assignments, access keys and runs of hexadecimal digits. Two Markov chains of
first order over the characters of keys, one of random strings and one of ordinary
identifiers, are counted from labelled samples; a longer run of such characters whose
log-likelihood ratio between the two is high enough is a secret as well. Runs are cut at what
the patterns found, and every part is judged on its own. Only DataFrame functions are used.

Samples come from the documents, what patterns found and long runs of letters, and from a rule:
random strings over the usual alphabets, and identifiers put together from common words, numbers
and separators. Large sources count alike, whatever their size, and a character's successors
back off to single characters where few were seen. A fifth of the samples is held out; the least
ratio that counts lies MARGIN above what all but FALSE_HITS of the held-out identifiers reach.

Positions are in code points. They come from putting marks around the matches, splitting at
the marks and adding up the lengths; the marks are control characters, which no pattern
matches, and those that a text has itself are replaced by another one first.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens.llm.storage import saved

MARKS = "\x01\x02\x04"
# The three base patterns, and the least length of what makes them count.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]{16,})"
PATTERNS = (("assign", ASSIGN, 12), ("access", ACCESS, 18), ("hex", HEX, 16))
KINDS = (*(name for name, _, _ in PATTERNS), "markov")
#: Runs that the models judge: long enough for a key.
RUN = r"([A-Za-z0-9+/_=-]{16,})"

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Symbols of a model: the characters, and the start of a run as number 0.
SYMBOLS = len(ALPHABET) + 1
#: Share of held-out identifiers that may pass for random.
FALSE_HITS = 0.002
#: Added to the least ratio that held-out samples give, in nats a character: names outside of the
#: samples are made of other words.
MARGIN = 0.4
#: Samples made by rule, of each class.
MADE = 6000
#: Weight of the single characters against those seen after a character.
BACK_OFF = 6.0
#: Symbols up to which a source of samples counts by its size; larger ones count alike.
SOURCE_SYMBOLS = 100_000
#: Words that identifiers are made of.
WORDS = (
    "account", "action", "address", "admin", "apply", "archive", "array", "backup", "base", "batch", "block",
    "bucket", "buffer", "build", "cache", "catalog", "category", "center", "change", "check", "client", "cluster",
    "code", "column", "common", "config", "content", "count", "create", "customer", "data", "date", "default",
    "delete", "detail", "device", "document", "download", "element", "email", "entry", "error", "event", "export",
    "factory", "field", "file", "filter", "final", "format", "frame", "function", "global", "group", "handler",
    "header", "history", "image", "import", "index", "input", "insert", "internal", "item", "language", "layout",
    "library", "list", "local", "logger", "manager", "mapping", "market", "member", "message", "method", "model",
    "module", "monitor", "network", "number", "object", "option", "order", "output", "package", "page", "parser",
    "path", "payment", "pipeline", "policy", "process", "product", "profile", "project", "query", "queue", "record",
    "region", "release", "remote", "report", "request", "resource", "response", "result", "router", "sample",
    "schema", "script", "search", "section", "server", "service", "session", "setting", "shipping", "source",
    "status", "storage", "stream", "string", "summary", "system", "table", "target", "template", "test", "thread",
    "total", "training", "update", "upload", "user", "utility", "value", "version", "view", "widget", "window",
    "worker", "year",
)

_SPANS = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"


def _matches(text: Column, pattern: str, least: int, kind: int) -> Column:
    """Spans of all matches whose group has at least ``least`` characters.

    The marked text is split at the first mark; what follows each is the match, the second
    mark, the group once more, the third mark, and the text up to the next match.
    """
    open_, close, end = MARKS
    parts = F.split(F.regexp_replace(text, pattern, f"{open_}$0{close}$1{end}"), open_)
    found = F.transform(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda p: F.struct(
            F.length(F.substring_index(p, close, 1)).alias("size"),
            F.substring_index(F.substring_index(p, close, -1), end, 1).alias("value"),
            F.length(F.substring_index(p, end, -1)).alias("rest"),
        ),
    )
    empty = F.array().cast(_SPANS)
    placed = F.aggregate(
        found,
        F.struct(F.length(F.get(parts, 0)).cast("long").alias("at"), empty.alias("spans")),
        lambda have, m: F.struct(
            (have["at"] + m["size"] + m["rest"]).alias("at"),
            F.concat(
                have["spans"],
                F.array(
                    F.struct(
                        have["at"].alias("start"),
                        F.lit(kind).alias("kind"),
                        (have["at"] + m["size"]).alias("end"),
                        m["value"].alias("value"),
                    )
                ),
            ).cast(_SPANS).alias("spans"),
        ),
        lambda have: have["spans"],
    )
    return F.when(F.size(parts) == 1, empty).otherwise(F.filter(placed, lambda s: F.length(s["value"]) >= least))


def searchable(text: Column) -> Column:
    """The text with marks of its own replaced one by one; null is an empty text."""
    return F.translate(F.coalesce(text, F.lit("")), MARKS, "\x03" * len(MARKS))


def _parts(run: Column, base: Column) -> Column:
    """What is left of a run between the base spans that touch it, where it is long enough."""

    def part(start: Column, end: Column) -> Column:
        size = (end - start).cast("int")
        value = F.substring(run["value"], (start - run["start"] + 1).cast("int"), F.greatest(size, F.lit(0)))
        return F.array(F.struct(start.alias("start"), run["kind"].alias("kind"), end.alias("end"), value.alias("value")))

    touching = F.filter(base, lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"]))
    parts = F.aggregate(
        touching,
        F.struct(run["start"].alias("at"), F.array().cast(_SPANS).alias("parts")),
        lambda have, b: F.struct(
            F.greatest(have["at"], b["end"]).alias("at"),
            F.concat(have["parts"], part(have["at"], b["start"])).cast(_SPANS).alias("parts"),
        ),
        lambda have: F.concat(have["parts"], part(have["at"], run["end"])).cast(_SPANS),
    )
    return F.when(F.size(touching) == 0, F.array(run).cast(_SPANS)).otherwise(
        F.filter(parts, lambda p: p["end"] - p["start"] >= 16)
    )


def with_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base`` (spans of the patterns, in order) and ``runs`` (long runs beside them)."""
    out = docs.withColumn("__text", searchable(F.col("text")))
    each = [_matches(F.col("__text"), p, least, k) for k, (_, p, least) in enumerate(PATTERNS)]
    out = out.withColumn("base", F.array_sort(F.concat(*each)))
    out = out.withColumn("runs", _matches(F.col("__text"), RUN, 16, len(PATTERNS))).drop("__text")
    return out.withColumn("runs", F.flatten(F.transform("runs", lambda r: _parts(r, F.col("base")))))


def _pick(values: Sequence[str], *salt) -> Column:
    """One of the values, by a hash of ``id``."""
    at = F.pmod(F.xxhash64("id", *(F.lit(x) for x in salt)), F.lit(len(values)))
    return F.element_at(F.lit(list(values)), (at + 1).cast("int"))


def _digits(n: int, *salt) -> Column:
    return F.lpad(F.pmod(F.xxhash64("id", *(F.lit(x) for x in salt)), F.lit(10**n)).cast("string"), n, "0")


def random_strings(spark: SparkSession, n: int = MADE) -> DataFrame:
    """(value): random strings of 16 to 48 characters over the alphabets that keys have."""
    digest = F.sha2(F.concat(F.lit("random "), F.col("id").cast("string")).cast("binary"), 512)
    wide = F.regexp_replace(F.base64(F.unhex(digest)), "\\s|=", "")
    plain = F.regexp_replace(wide, "[+/]", "")
    forms = [wide, F.translate(wide, "+/", "-_"), plain, plain, F.upper(plain), F.lower(plain),
             F.regexp_replace(plain, "[0-9]", ""), digest, F.upper(digest)]
    chosen = F.element_at(F.array(*forms), (F.col("id") % len(forms) + 1).cast("int"))
    size = 16 + F.pmod(F.xxhash64("id"), F.lit(33))
    return spark.range(n).select(chosen.substr(F.lit(1), size.cast("int")).alias("value"))


def identifiers(spark: SparkSession, n: int = MADE) -> DataFrame:
    """(value): names, paths, dates, numbers and rules as people write them, 16 characters or more."""
    words = [_pick(WORDS, k) for k in range(4)]
    big = [F.initcap(w) for w in words]
    date = F.concat(_pick(("19", "20"), "c"), _digits(2, "y"))
    month, day = _pick([f"{m:02}" for m in range(1, 13)], "m"), _pick([f"{d:02}" for d in range(1, 29)], "d")
    mark = _pick(("_", "-", "/"), "s")
    forms = [
        F.concat(words[0], *big[1:]),
        F.concat(*big),
        F.concat_ws("_", *words[:3]),
        F.upper(F.concat_ws("_", *words[:3])),
        F.concat_ws("-", *words[:3]),
        F.concat_ws("/", *words),
        F.concat(words[0], words[1], words[2], words[3]),
        F.concat_ws("_", words[0], words[1], F.concat(date, month, day)),
        F.concat(words[0], big[1], F.lit("-"), F.concat_ws("-", date, month, day)),
        F.concat(words[0], mark, date, mark, month, mark, day, mark, words[1]),
        F.concat(F.concat_ws("-", date, month, day), F.lit("T"), _digits(2, "h"), F.lit("-"), _digits(2, "i"), F.lit("-"), _digits(2, "j")),
        F.concat(date, month, day, mark, _digits(6, "t"), mark, words[0]),
        F.concat(big[0], big[1], _digits(2, "n"), mark, words[2], _digits(1, "o")),
        F.concat(words[0], F.lit("_v"), _digits(1, "p"), mark, words[1], mark, words[2]),
        F.concat_ws("-", _digits(4, "a"), _digits(4, "b"), _digits(4, "e"), _digits(4, "f")),
        F.concat_ws("/", _digits(4, "a"), _digits(6, "b"), words[0], _digits(3, "e")),
        F.repeat(_pick(("-", "=", "_", "/", "x", "0", "a", "=-", "ha", "-_"), "r"), 16),
    ]
    chosen = F.element_at(F.array(*forms), (F.col("id") % len(forms) + 1).cast("int"))
    return spark.range(n).select(chosen.alias("value")).where(F.length("value") >= 16)


def samples(found: DataFrame) -> DataFrame:
    """(value, secret, source): what the patterns found and random strings; runs of letters and identifiers."""
    spark = found.sparkSession
    plain = F.filter("runs", lambda r: r["value"].rlike("^([A-Z]?[a-z]+|[A-Z]+)$"))
    parts = [
        (found.select(F.explode("base").alias("s")).select("s.value"), 1, 0),
        (random_strings(spark), 1, 1),
        (found.select(F.explode(plain).alias("s")).select("s.value"), 0, 0),
        (identifiers(spark), 0, 1),
    ]
    tables = [df.select("value", F.lit(y).alias("secret"), F.lit(source).alias("source")) for df, y, source in parts]
    return reduce(DataFrame.unionByName, tables)


def _held_out() -> Column:
    return F.pmod(F.xxhash64("value"), F.lit(5)) == 0


def _coded(value: Column) -> Column:
    """The numbers of a string's characters, those outside of the alphabet left out."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    return F.filter(F.transform(chars, lambda c: F.instr(F.lit(ALPHABET), c)), lambda c: c > 0)


def log_ratios(labelled: DataFrame) -> list[float]:
    """For every pair of symbols, the log of its probability among secrets over identifiers.

    All labelled samples (value, secret, source) are counted. The sources of a class count by
    their symbols, up to SOURCE_SYMBOLS; one number a pair of symbols, class and source reaches
    the driver.
    """
    steps = F.zip_with(F.concat(F.array(F.lit(0)), "codes"), "codes", lambda a, b: a * SYMBOLS + b)
    coded = labelled.select("secret", "source", _coded(F.col("value")).alias("codes"))
    pairs = coded.select("secret", "source", F.explode(F.filter(steps, lambda x: x.isNotNull())).alias("pair"))
    counted: dict[tuple[int, int], dict[int, int]] = {}
    for row in pairs.groupBy("secret", "source", "pair").agg(F.count("*").alias("n")).collect():
        counted.setdefault((row.secret, row.source), {})[row.pair] = row.n
    mixed = {0: [0.0] * SYMBOLS**2, 1: [0.0] * SYMBOLS**2}
    for secret, chance in mixed.items():
        own = [count for (y, _), count in counted.items() if y == secret] or [{}]
        weights = [max(1, min(sum(count.values()), SOURCE_SYMBOLS)) for count in own]
        for count, weight in zip(own, weights):
            for pair, p in enumerate(_chain(count)):
                chance[pair] += p * weight / sum(weights)
    return [math.log(p / q) for p, q in zip(mixed[1], mixed[0])]


def _chain(count: dict[int, int]) -> list[float]:
    """Probabilities of the next symbol for every symbol, from counts of pairs."""
    single = [0.5] * SYMBOLS
    seen = [0] * SYMBOLS
    for pair, n in count.items():
        single[pair % SYMBOLS] += n
        seen[pair // SYMBOLS] += n
    whole = sum(single)
    return [
        (count.get(a * SYMBOLS + b, 0) + BACK_OFF * single[b] / whole) / (seen[a] + BACK_OFF)
        for a, b in product(range(SYMBOLS), repeat=2)
    ]


def _ratio(value: Column, ratios: list[float]) -> Column:
    """The log-likelihood ratio of a run, for a character on average."""
    table = F.lit(ratios)
    summed = F.aggregate(
        _coded(value),
        F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum")),
        lambda have, c: F.struct(
            c.alias("last"), (have["sum"] + F.get(table, have["last"] * SYMBOLS + c)).alias("sum")
        ),
        lambda have: have["sum"],
    )
    return summed / F.length(value)


def trained(labelled: DataFrame, false_hits: float = FALSE_HITS) -> tuple[list[float], float]:
    """The ratios, and the least one a run needs: MARGIN over what all but a few held-out identifiers reach."""
    if "source" not in labelled.columns:
        labelled = labelled.withColumn("source", F.lit(0))
    ratios = log_ratios(labelled.where(~_held_out()))
    other = labelled.where(_held_out() & (F.col("secret") == 0)).select(_ratio(F.col("value"), ratios).alias("ratio"))
    (limit,) = other.agg(F.percentile_approx("ratio", 1 - false_hits, 100_000)).first()
    return ratios, max(limit or 0.0, 0.0) + MARGIN


def with_spans(found: DataFrame, ratios: list[float], least_ratio: float) -> DataFrame:
    """``found`` with ``spans``: the base spans and the runs that the models call random."""
    random = F.filter("runs", lambda r: _ratio(r["value"], ratios) > least_ratio)
    return found.withColumn("spans", F.array_sort(F.concat("base", random))).drop("runs")


def _listed(spans: Column) -> Column:
    kinds = F.array(*(F.lit(k) for k in KINDS))
    one = lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def secrets(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every document.

    ``labelled`` (value, secret, and source if there are several) trains the models; without it
    ``samples`` does. Spans are kind:start:end in order of their starts, then kinds. Of a run
    that touches base spans, the parts of 16 characters or more beside them are judged.
    Null and empty texts have no spans; repeated rows are scanned each; other columns are ignored.
    An empty table gives an empty result. The texts are read once.
    """
    found = saved(with_runs(docs.select("doc_id", "text")).drop("text"), "runs")
    spans = with_spans(found, *trained(samples(found) if labelled is None else labelled))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return spans.select(
        "doc_id",
        *(count(k).alias(f"n_{name}") for k, (name, _, _) in enumerate(PATTERNS)),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )


def redacted(docs: DataFrame, labelled: DataFrame | None = None, by: str = "[SECRET]") -> DataFrame:
    """The documents, all columns, with every secret replaced and n_chars counted anew.

    Overlapping spans become one replacement. Texts without a secret stay as they are. The
    patterns run once: rows are stored with what they found.
    """
    whole = docs.select(F.struct(*docs.columns).alias("row"), "text")
    found = saved(with_runs(whole).drop("text"), "runs")
    marked = with_spans(found, *trained(samples(found) if labelled is None else labelled)).drop("base")
    marked = marked.withColumn("text", F.col("row").getField("text"))
    rest = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda have, s: F.struct(
            F.greatest(have["at"], s["end"]).alias("at"),
            F.when(s["start"] < have["at"], have["parts"])
            .otherwise(
                F.concat(
                    have["parts"],
                    F.array(F.substring(F.col("text"), (have["at"] + 1).cast("int"), (s["start"] - have["at"]).cast("int")), F.lit(by)),
                )
            )
            .alias("parts"),
        ),
        lambda have: F.concat(
            F.array_join(have["parts"], ""),
            F.substring(F.col("text"), (have["at"] + 1).cast("int"), F.length("text")),
        ),
    )
    changed = F.size("spans") > 0
    out = marked.select("row", changed.alias("changed"), F.when(changed, rest).otherwise(F.col("text")).alias("text"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("changed"), F.length("text").cast(kind)).otherwise(F.col("row").getField("n_chars"))
    return out.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
